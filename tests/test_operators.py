"""Scenarios of the catalogue operators, and their sharp edges."""

import datetime as dt
import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinspark.functions import filters, scalars
from twinspark.operators import align, archives, catalogue, compare, duplicates, organise, similar, sync
from twinspark.streaming import updates

FILES = "repo string, repo_ord int, rel_path string, size long, hash string, modified_ms long, missing boolean, mime string, origin string, img_w int, img_h int, taken_ms long, camera string"


def entry(repo, path, size=1, content="h", ms=1000, missing=False, mime=None, origin=None, w=None, h=None):
    return (repo, int(repo[-1]), path, size, content, ms, missing, mime, origin, w, h, None, None)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), FILES)


def test_groups_by_waste_and_best_copy(spark):
    f = table(spark, entry("r0", "f1", 100, "1"), entry("r0", "f2", 100, "1", 2000), entry("r0", "z", 500, "2", 2000, w=10, h=10), entry("r0", "a", 500, "2"), entry("r0", "b", 500, "2", 2000), entry("r0", "c", 500, "2", 2000), entry("r0", "gone", 100, "1", missing=True))
    assert [r["wasted"] for r in duplicates.group_keys(f).orderBy(F.desc("wasted")).collect()] == [1500, 100]
    ranked = [r["rel_path"] for r in duplicates.ranked(f).orderBy(F.desc("size"), "rank").collect()]
    assert ranked == ["z", "a", "b", "c", "f1", "f2"]


def test_accepted_copies_are_never_deleted(spark):
    f = table(spark, entry("r0", "a"), entry("r1", "b", ms=500))
    accepted = spark.createDataFrame([("r0", 1, "h")], "repo string, size long, hash string")
    assert [r["rel_path"] for r in duplicates.to_delete(f, accepted).collect()] == ["b"]
    assert duplicates.to_delete(f, accepted, read_only=("r1",)).count() == 0


def test_relations_by_hash_and_path(spark):
    left = table(spark, entry("r0", "same"), entry("r0", "old", content="n"), entry("r0", "only", content="l"), entry("r0", "clash", content="x"))
    right = table(spark, entry("r1", "same"), entry("r1", "new", content="n"), entry("r1", "right", content="r"), entry("r1", "clash", content="y"), entry("r1", "was", content="l", missing=True))
    got = {(r["left_paths"], r["right_paths"]): (r["relation"], r["deleted_in_right"]) for r in compare.rows_by_hash(left, right).collect()}
    assert got[("same", "same")] == ("Equal", False) and got[("old", "new")] == ("Renamed", False) and got[("only", None)] == ("OnlyLeft", True) and got[(None, "right")] == ("OnlyRight", False)
    assert {r["rel_path"]: r["relation"] for r in compare.rows_by_path(left, right).collect()}["clash"] == "Conflict"


def test_tombstones_block_a_copy_but_not_a_sync(spark):
    main, sink = table(spark, entry("r0", "a")), table(spark, entry("r1", "a", missing=True))
    assert compare.unseen(main, sink).count() == 0
    assert sync.copies(main, sink).count() == 1 and sync.resurrections(main, sink).count() == 1


def test_moved_inside_the_source_is_deleted_unless_guarded(spark):
    main, sink = table(spark, entry("r0", "old", missing=True), entry("r0", "new")), table(spark, entry("r1", "old"))
    assert sync.deletes_missing(main, sink).count() == 1
    assert sync.deletes_missing(main, sink, guard_live_source=True).count() == 0


def test_run_copies_first_free_path(spark):
    main, sink = table(spark, entry("r0", "a"), entry("r0", "b"), entry("r0", "c")), table(spark, entry("r1", "a", content="other"))
    assert {r["rel_path"]: r["outcome"] for r in sync.run_copies(main, sink).collect()} == {"a": "skipped", "b": "copied", "c": "equal"}


def test_deleting_sinks_need_a_main_with_files(spark):
    groups = spark.createDataFrame([("g", "r0", [("r1", "Mirror")])], "name string, main string, sinks array<struct<repo: string, mode: string>>")
    with pytest.raises(sync.EmptyMain):
        sync.guard_main(table(spark, entry("r1", "a")), groups)
    sync.guard_main(table(spark, entry("r0", "a")), groups)


def test_snapshots(spark):
    f = table(spark, entry("r0", "a"), entry("r0", "b"))
    path = spark.createDataFrame([("r0", "a"), ("r0", "zz")], "repo string, rel_path string")
    assert {r["rel_path"]: r["missing"] for r in catalogue.mark_missing(f, path).collect()} == {"a": True, "b": False}
    assert catalogue.remove(f, path).count() == 1 and catalogue.rename(f, "r0", "a", "c").where("rel_path = 'c'").count() == 1
    walk = spark.createDataFrame([("r0", "a", 1, 1000), ("r0", "n", 5, 1)], "repo string, rel_path string, size long, modified_ms long")
    assert {r["rel_path"]: r["status"] for r in catalogue.changes(f, walk).collect()} == {"a": "unchanged", "b": "vanished", "n": "added"}
    after = catalogue.updated(f, walk, table(spark, entry("r0", "n", 5, "nn", 1)))
    assert {r["rel_path"]: r["missing"] for r in after.collect()} == {"a": False, "b": True, "n": False}
    with pytest.raises(catalogue.WouldEmptyIndex):
        catalogue.updated(f, walk.where("false"), f.where("false"))
    tags = spark.createDataFrame([("r0", "a", [" x", "x", ""]), ("r0", "b", [" "])], "repo string, rel_path string, tags array<string>")
    assert [r["tags"] for r in catalogue.set_tags(tags.where("false"), tags).collect()] == [["x"]]


@pytest.mark.parametrize("text", ["bogus", "size:abc", "date:2020-13", "!case:insensitive", "accepted:maybe"])
def test_filter_errors(text):
    with pytest.raises(filters.FilterError):
        filters.parse(text)


def test_filter_quirks(spark):
    f = table(spark, entry("r0", "a.txt"), entry("r0", "b.jpg", mime="image/jpeg"))
    run = lambda e: sorted(r["rel_path"] for r in filters.matching(f, e).collect())
    assert run(None) == run(" ") == ["a.txt", "b.jpg"]
    assert run("!mime:image") == ["a.txt"] and run("! name:a") == [] and run("name:A case:insensitive") == ["a.txt"]
    assert filters.date_span("2021-02-31") == filters.date_span("2021-03-03")
    assert filters.date_span("1969")[0] == -31536000000


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab*/", max_size=5), min_size=1, max_size=4), st.text("ab*/", min_size=1, max_size=4))
def test_globs_as_python_says(spark, paths, pattern):
    import fnmatch
    import re

    rows = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    want = [bool(re.match(fnmatch.translate(pattern), p, re.S)) if "*" in pattern else pattern in p for p in paths]
    got = [r[0] for r in rows.select(filters.predicate(filters.FileFilter((filters.Condition("name", pattern),)))).collect()]
    assert got == want


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.normal_path(F.lit(" a //./b. /c"))) == "a/b/c" and one(scalars.normal_path(F.lit("a/../b"))) is None
    assert one(scalars.text_hash(F.lit("A b\n"))) == one(scalars.text_hash(F.lit("ab"))) and one(scalars.text_hash(F.lit(" "))) is None
    assert one(scalars.text_file_hash(F.lit("﻿a\r\nb \n"))) == one(scalars.text_file_hash(F.lit("a\nb")))
    f = table(spark, entry("r0", "d/x.JPG", ms=0))
    assert f.select(scalars.rendered('{year}/{camera|origin|"none"}/{o-stem}.{o-ext}{huh}')).first()[0] == "1970/none/x.jpg"
    moves = spark.createDataFrame([("r0", "a", "t/x.txt"), ("r0", "b", "t/x.txt"), ("r0", "c", "t/.y")], "repo string, rel_path string, target string")
    assert [r["final"] for r in organise.with_suffixes(moves).orderBy("rel_path").collect()] == ["t/x.txt", "t/x (2).txt", "t/.y"]


def test_seed_phrase(spark):
    words = tuple("abcdefghijkl")
    kind = lambda text: spark.range(1).select(scalars.sensitive(F.lit("a.txt"), F.lit("text/plain"), F.lit(99), F.lit(text), words)).first()[0]
    assert kind(" ".join(words)) == "Wallet" and kind(" ".join(words[:11])) is None


def greedy(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leader = {}
    for v in sorted(near):
        if v not in leader:
            leader[v] = v
            for w in near[v]:
                if w > v and w not in leader:
                    leader[w] = v
    sizes = {}
    for x in leader.values():
        sizes[x] = sizes.get(x, 0) + 1
    return {k: x for k, x in leader.items() if sizes[x] > 1}


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_groups_are_not_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(1, 2), (2, 3)] if not seed else [tuple(rng.sample(range(40), 2)) for _ in range(45)]
    got = {r["member"]: r["leader"] for r in similar.greedy_groups(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == greedy(pairs)


def test_similar_prints(spark):
    rows = spark.createDataFrame([(1, [0, 0]), (2, [0, 0]), (3, [0, 3]), (4, [9, 9])], "vec_id long, bands array<long>")
    assert {(r["a"], r["b"]) for r in similar.banded_pairs(rows, 16, 80.0).collect()} == {(1, 2), (1, 3), (2, 3)}
    prints = spark.createDataFrame([([1, 2, 3, 4, 5], [9999, 1, 2, 3, 4, 5]), ([], [1])], "a_print array<long>, b_print array<long>")
    assert [r["similarity"] for r in similar.audio_similarity(prints).collect()] == [100.0, 0.0]


def test_archives(spark):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        z.writestr("d/a.txt", "hello")
    rows = archives.list_archives(spark.createDataFrame([("a.zip", bytearray(blob.getvalue())), ("b.tar", bytearray(b"junk"))], "path string, content binary")).collect()
    assert [(r["member_name"], r["size"], r["locked"]) for r in rows] == [("d/a.txt", 5, False)]


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_segments_make_up_both_sides(a, b):
    at = (0, 0)
    for s in align.segments(a, b):
        assert (s["a_start"], s["b_start"]) == at
        if s["kind"] == "equal":
            assert a[s["a_start"] : s["a_end"]] == b[s["b_start"] : s["b_end"]]
        at = (s["a_end"], s["b_end"])
    assert at == (len(a), len(b))


def test_stream_of_walks(spark, tmp_path):
    kind = "repo string, rel_path string, size long, modified_ms long, hash string"
    state = {"now": spark.createDataFrame([("r0", "a", 1, 1, "h", False)], kind + ", missing boolean")}
    for k, rows in enumerate([[("r0", "a", 1, 1, "h"), ("r0", "b", 2, 2, "i")], [("r0", "b", 2, 2, "i"), ("r0", "a", 9, 3, "j")]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "walks"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "walks"))

        def write(df, number):
            state["now"] = spark.createDataFrame(df.collect(), df.schema)

        query = updates.update_from(stream, lambda: state["now"], write, str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    assert {(r["rel_path"], r["size"]) for r in state["now"].collect()} == {("a", 9), ("b", 2)}


def test_stream_of_rates(spark, tmp_path):
    spark.createDataFrame([("op", 0, 10), ("op", 20000, 2000)], "operation string, ms long, bytes long").coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("operation string, ms long, bytes long").parquet(str(tmp_path / "p"))
    query = updates.rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert round(spark.table("rates").agg(F.max("rate")).first()[0], 3) == round(100 * (1 - 2.718281828459045**-1), 3)


def test_dates_are_utc(spark):
    assert filters.date_span("2020-01")[1] - filters.date_span("2020-01")[0] == dt.timedelta(days=31) / dt.timedelta(milliseconds=1)


def test_line_diff_pairs_long_texts_too(spark):
    from twinspark.plans import queries

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = queries.source.base(spark, "/root/testdata/sf0.01").select("repo", "rel_path").collect()
    left, right = ([r["rel_path"] for r in base if r["repo"] == repo] for repo in ("r0", "r1"))
    assert docs.count() == len(base)
    assert queries.QUERIES["line_diff"](spark, "/root/testdata/sf0.01").count() == sum(left.count(p) * right.count(p) for p in set(left))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def made_up(found, a, b):
    left = right = b""
    for s in found:
        x, y = a[s["a_start"] : s["a_end"]], b[s["b_start"] : s["b_end"]]
        assert (x == y) == (s["kind"] == "equal")
        left, right = left + x, right + y
    return left == a and right == b


def test_alignment_is_longest_and_anchored(monkeypatch):
    rng = random.Random(11)
    for _ in range(40):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(60))) for _ in range(2))
        found, degraded = align.aligned(a, b)
        assert made_up(found, a, b) and not degraded
        assert sum(s["a_end"] - s["a_start"] for s in found if s["kind"] == "equal") == lcs(a, b)
    long = bytes(rng.randrange(256) for _ in range(9000))
    found, degraded = align.aligned(long, b"x" + long)
    assert made_up(found, long, b"x" + long) and not degraded and len(found) == 2
    other = long[:3000] + b"between" + long[3500:8000] + b"end"
    found, degraded = align.aligned(long, other)
    assert made_up(found, long, other) and not degraded and sum(s["a_end"] - s["a_start"] for s in found if s["kind"] == "equal") >= 7500
    noise = bytes(rng.randrange(256) for _ in range(9000))
    found, degraded = align.aligned(long, noise)
    assert made_up(found, long, noise) and degraded


def test_hex_rows(spark):
    pairs = spark.createDataFrame([("abcdefghijklmnopqr", "abcXefghijklmnopq")], "a string, b string")
    rows = align.hex_rows(align.byte_alignment(pairs)).first()["rows"]
    assert [r["kinds"] for r in rows] == ["===!============", "=-"] and rows[0]["b_hex"].split()[3] == "58" and rows[1]["a_hex"] == "71 72"


def test_registry_rules(spark):
    from twinspark.operators import registry
    from twinspark.sources import catalogue as source

    repos, groups = source.repositories(spark), source.sync_groups(spark)
    for edit in (
        lambda: registry.create_repo(repos, "r0", "/x"),
        lambda: registry.rename_repo(repos, groups, "r1", "other"),
        lambda: registry.remove_repo(repos, groups, "m0"),
        lambda: registry.create_group(groups, "g", "r3"),
        lambda: registry.add_sink(groups, "g", "r1", "Mirror"),
        lambda: registry.add_sink(groups, "g", "r3", "Other"),
        lambda: registry.remove_sink(groups, "g", "r0"),
        lambda: registry.set_main(groups, "none", "r1"),
    ):
        with pytest.raises(registry.Refused):
            edit()
    main = registry.members(registry.set_main(groups, "g", "r1")).collect()
    assert ("g", "r0", "AddOnly") in [tuple(r) for r in main] and ("g", "r1", "main") in [tuple(r) for r in main]
    assert registry.delete_group(groups, "g").count() == 0


def test_blank_purges_match_nothing(spark):
    f = table(spark, entry("r0", "a"), entry("r0", "b", missing=True))
    assert catalogue.purge(f, " ").count() == catalogue.purge(f, None).count() == 0 and catalogue.purge(f, "size:>0").count() == 1


def test_wallets_in_either_byte_order(spark):
    rows = [("x" * 12 + "b1\x05\x00",), ("x" * 12 + "\x00\x051b",), ("x" * 11 + "b1\x05\x00",)]
    frame = spark.createDataFrame(rows, "content string").select(scalars.sensitive(F.lit("a.bin"), F.lit(None).cast("string"), F.octet_length("content").cast("long"), F.col("content")).alias("c"))
    assert [r["c"] for r in frame.collect()] == ["Wallet", "Wallet", None]


def test_exports_take_free_numbers(spark):
    from twinspark.operators import views

    f = table(spark, entry("r0", "a/x.txt", 1, "1"), entry("r0", "b/x.txt", 2, "2"), entry("r1", "x.txt", 1, "1"), entry("r1", "c/x.txt", 3, "3"), entry("r1", "d/x.txt", 4, "4"))
    there = spark.createDataFrame([("1970/01/x (2).txt", 4, "4"), ("1970/01/x.txt", 9, "9")], "path string, size long, hash string")
    got = {(r["repo"], r["rel_path"]): (r["action"], r["path"]) for r in views.exported_by_date(f, there).collect()}
    assert got == {("r0", "a/x.txt"): ("copy", "1970/01/x (3).txt"), ("r0", "b/x.txt"): ("copy", "1970/01/x (4).txt"), ("r1", "x.txt"): ("skip", None), ("r1", "c/x.txt"): ("copy", "1970/01/x (5).txt"), ("r1", "d/x.txt"): ("skip", None)}


def test_large_groups_are_ranked_over_several_tasks(spark):
    rows = [entry(f"r{i % 3}", f"p{i * 37 % 101:03d}", 5, f"h{i % 2}", 1000 + i % 7, w=i % 4, h=3) for i in range(300)] + [entry("r0", "x", 6, "s"), entry("r1", "y", 6, "s")]
    f = table(spark, *rows).dropDuplicates(["repo", "rel_path"]).repartition(7)
    whole = {(r["repo"], r["rel_path"]): r["rank"] for r in duplicates.ranked(f).collect()}
    assert {(r["repo"], r["rel_path"]): r["rank"] for r in duplicates.ranked(f, most=10).collect()} == whole and max(whole.values()) > 100
    for guard in (None, F.col("repo") == "r1"):
        assert sorted(r["rel_path"] for r in duplicates.ranked(f, guard).where("rank > 1").collect()) == sorted(r["rel_path"] for r in duplicates.rest(f, guard).collect())


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=24))
def test_groups_of_distinct_hashes_are_groups_of_all(spark, bands):
    rows = spark.createDataFrame([(i, list(b)) for i, b in enumerate(bands)], "vec_id long, bands array<long>")
    want = similar.greedy_groups(similar.banded_pairs(rows, 4, 75.0))
    assert sorted(map(tuple, similar.similar_groups(rows, 4, 75.0).collect())) == sorted(map(tuple, want.collect()))
