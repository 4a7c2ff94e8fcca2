"""Names of exports and moves against taking files one by one."""

import random

import pytest
from pyspark.sql import functions as F

from twinspark.operators import naming, organise, views

FILES = "repo string, repo_ord int, rel_path string, size long, hash string, modified_ms long, missing boolean, mime string, origin string, img_w int, img_h int, taken_ms long, camera string"


def split(path, dotfiles):
    folder, slash, name = path.rpartition("/")
    at = name.rfind(".")
    if at < 0 or (not dotfiles and at == 0):
        return path, ""
    return folder + slash + name[:at], "" if not dotfiles and at == len(name) - 1 else name[at:]


def numbered(wish, n, dotfiles):
    stem, rest = split(wish, dotfiles)
    return wish if n == 1 else f"{stem} ({n}){rest}"


def one_by_one(files, held, same_in_run, dotfiles):
    names, out = {p: (c, False) for p, c in held}, []
    for wish, turn, content in sorted(files, key=lambda f: f[1]):
        for n in range(1, 10_000):
            path = numbered(wish, n, dotfiles)
            if path not in names:
                names[path] = content, True
                out.append((wish, turn, False, n, path))
                break
            if names[path][0] == content and (same_in_run or not names[path][1]):
                out.append((wish, turn, True, None, None))
                break
        else:
            out.append((wish, turn, False, None, None))
    return sorted(out, key=repr)


def placed(spark, files, held, same_in_run, dotfiles):
    f = spark.createDataFrame([(w, t, 1, c) for w, t, c in files], "wish string, turn long, size long, hash string")
    h = spark.createDataFrame([(p, 1, c) for p, c in held], "path string, size long, hash string")
    rows = naming.free_names(f, h, same_in_run, dotfiles).collect()
    return sorted([(r["wish"], r["turn"], r["skip"], None if r["skip"] else r["number"], r["path"]) for r in rows], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_same_as_one_by_one(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(naming, "SPAN", 4)  # places of one name counted by many tasks
    rng = random.Random(seed)
    names = ["d/a.jpg", "d/a (2).jpg", "d/a (3).jpg", "d/a (2) (2).jpg", "d/a (2) (3).jpg", "d/a (02).jpg", "d/b", "d/b (2)", ".h", ".h (2)", "d/.h", "x.", " (2).h"]
    names = names[:4] if seed == 2 else rng.sample(names, rng.choice([4, 9, 13]))
    same_in_run, dotfiles = seed % 2 == 0, seed < 2
    files = [(rng.choice(names), t, f"c{rng.randrange(12)}") for t in rng.sample(range(1000), 60)]
    if same_in_run:  # what is alike is one file for free_names
        files = list({(w, c): (w, t, c) for w, t, c in sorted(files, key=lambda f: -f[1])}.values())
    held = [(p, f"c{rng.randrange(5)}") for p in rng.sample(sorted({numbered(b, n, dotfiles) for b in names for n in range(1, 9)}), rng.choice([4, 15]))]
    got = placed(spark, files, held, same_in_run, dotfiles)
    assert got == one_by_one(files, held, same_in_run, dotfiles)
    paths = [p for *_, p in got if p]
    assert len(set(paths)) == len(paths) and not set(paths) & {p for p, _ in held}


def test_many_equal_names_and_the_last_number(spark):
    """100,000 files of one name take as many numbers as there are, and the rest none; in time that grows with their count."""
    n = 100_000
    files = spark.range(n).select(F.lit("IMG_0001.jpg").alias("wish"), F.col("id").alias("turn"), F.lit(1).cast("long").alias("size"), F.col("id").cast("string").alias("hash"))
    held = spark.createDataFrame([("IMG_0001 (5).jpg", 1, "x"), ("IMG_0001.jpg", 1, "7")], "path string, size long, hash string")
    out = naming.free_names(files, held, True, True)
    got = out.agg(F.count("path").alias("named"), F.countDistinct("path").alias("paths"), F.max("number").alias("last"), F.count_if("skip").alias("skipped")).first()
    assert tuple(got) == (naming.LAST - 2, naming.LAST - 2, naming.LAST, 1)
    assert {r["turn"]: r["path"] for r in out.where("turn < 9").collect()} == {k: f"IMG_0001 ({k + 2 + (k > 2) - (k > 7)}).jpg" for k in range(9) if k != 7} | {7: None}


def entry(repo, path, content, ms=1000, missing=False):
    return (repo, int(repo[-1]), path, 1, content, ms, missing, None, None, None, None, None, None)


def test_exports_never_overwrite(spark):
    """A numbered name that is there, or that another file wants, is never taken twice."""
    there = spark.createDataFrame([("1970/01/a (2).jpg", 1, "old")], "path string, size long, hash string")
    files = spark.createDataFrame([entry("r0", "p/a.jpg", "1"), entry("r0", "q/a (2).jpg", "2"), entry("r0", "s/a.jpg", "3"), entry("r1", "t/a (2).jpg", "old"), entry("r1", "u/a.jpg", "4", missing=True)], FILES)
    got = {r["rel_path"]: r["path"] for r in views.exported_by_date(files, there).collect()}
    assert got == {"p/a.jpg": "1970/01/a.jpg", "q/a (2).jpg": "1970/01/a (2) (2).jpg", "s/a.jpg": "1970/01/a (3).jpg", "t/a (2).jpg": None}
    none = there.where("false")
    got = {r["rel_path"]: r["path"] for r in views.exported_by_date(files, none).collect()}
    assert got == {"p/a.jpg": "1970/01/a.jpg", "q/a (2).jpg": "1970/01/a (2).jpg", "s/a.jpg": "1970/01/a (3).jpg", "t/a (2).jpg": "1970/01/a (2) (2).jpg"}
    contents = {"p/a.jpg": "1", "q/a (2).jpg": "2", "s/a.jpg": "3", "t/a (2).jpg": "old"}
    again = spark.createDataFrame([(p, 1, contents[k]) for k, p in got.items()], "path string, size long, hash string")
    assert {r["action"] for r in views.exported_by_date(files, again).collect()} == {"skip"}
    assert views.exported_by_date(files.where("false"), there).count() == 0


def test_dates_are_utc_in_any_session(spark):
    files = spark.createDataFrame([entry("r0", "a.jpg", "1", 1577836800000), entry("r0", "b.jpg", "2", -1)], FILES)
    none = spark.createDataFrame([], "path string, size long, hash string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(r["path"] for r in views.exported_by_date(files, none).collect()) == ["1969/12/b.jpg", "2020/01/a.jpg"]
            assert {(r["year"], r["month"]) for r in organise.timeline(files).collect()} == {(2020, 1), (1969, 12)}
            assert {r["target"] for r in organise.plan(files, [("size:>0", "{year}-{month}-{day}.{o-ext}")]).collect()} == {"2020-01-01.jpg", "1969-12-31.jpg"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_moves_heed_what_is_there(spark):
    files = spark.createDataFrame([entry("r0", "one/report.pdf", "1"), entry("r0", "two/report.pdf", "2"), entry("r0", "archive/report (2).pdf", "3"), entry("r0", "x/report.pdf", "3"), entry("r0", "archive/gone.pdf", "4", missing=True), entry("r1", "z/report.pdf", "1")], FILES)
    rules = [("name:report", "archive/report.pdf")]
    moves = organise.with_suffixes(organise.plan(files, rules), files)
    got = {(r["repo"], r["rel_path"]): r["final"] for r in moves.collect()}
    # In the order of paths: one/ takes the plain name, two/ passes (2), which holds other content; the file at (2) and its copy stay.
    assert got == {("r0", "archive/report (2).pdf"): "archive/report.pdf", ("r0", "one/report.pdf"): "archive/report (3).pdf", ("r0", "two/report.pdf"): "archive/report (4).pdf", ("r0", "x/report.pdf"): None, ("r1", "z/report.pdf"): "archive/report.pdf"}
    after = [(r["repo"], r["rel_path"]) for r in organise.moved(files, rules).collect()]
    assert len(after) == 6 == len(set(after)) and ("r0", "archive/gone.pdf") in after and ("r0", "one/report.pdf") not in after
