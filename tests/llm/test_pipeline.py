"""The pipeline's stages, each on what its predecessor kept."""

import collections
import random

import corpus_pipeline

FOLDER = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= rows
        rows = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == rows
    text = " ".join(r["text"] for r in docs.collect())
    assert text


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, shared ids and null ids: exactly one row of each group of copies, exact and near."""
    rng = random.Random(5)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(150))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, a), (1, a), (2, b), (3, b), (2, c), (None, a), (None, d), (None, d), (None, near(d)), (None, e), (None, e), (7, near(e)), (7, c), (7, near(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    of = {a: "a", b: "b", c: "c", d: "d", e: "e", near(d): "near d", near(e): "near e", near(b): "near b"}
    once = corpus_pipeline.without_copies(spark, docs, FOLDER)
    got = sorted((of[r["text"]], r["doc_id"]) for r in once.collect())
    assert [x for x, _ in got] == sorted(of.values())
    want = {t: min((i for i, u in rows if u == t and i is not None), default=None) for t in of}
    assert dict(got) == {of[t]: i for t, i in want.items()}
    for frame in (once, docs):
        left = corpus_pipeline.without_near_copies(spark, frame, FOLDER).collect()
        assert collections.Counter(of[r["text"]][-1] for r in left) == dict.fromkeys("abcde", 1)
    cut = corpus_pipeline.without_passages(spark, corpus_pipeline.without_near_copies(spark, once, FOLDER), FOLDER)
    assert cut.count() == 5


def uneven():
    """Rows with nulls, blanks, repeated rows, shared and missing ids, near copies and shared passages; extra columns that clash."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(n))
    a, b, c, passage = text(150), text(150), text(400), text(90)
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, a), (None, a), (2, near), (3, b), (3, c), (4, None), (5, ""), (None, " \n\t"), (6, b.replace(" ", "  ")), (7, text(40) + " " + passage), (8, passage + " " + text(60)), (9, "short"), (9, "short")]
    return [(i, t, "row", 7, k, 0.5) for k, (i, t) in enumerate(rows)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, _row string, row long, node long, score double").repartition(3)


def test_each_stage_equals_brute_force(spark):
    rows = uneven()
    frame = table(spark, rows)
    plain = lambda out: sorted((r["node"] for r in out.collect()))
    tight = lambda t: "".join((t or "").split())
    # Quality: rows stay or go by their texts, with all their columns.
    good = corpus_pipeline.good(spark, frame, FOLDER)
    assert good.columns == frame.columns
    stayed = {r["text"] for r in good.collect()}
    assert plain(good) == sorted(r[4] for r in rows if r[1] in stayed)
    # Exact copies: of each text the row of most characters, then of the least id, stays.
    once = corpus_pipeline.without_copies(spark, frame, FOLDER)
    assert once.columns == frame.columns
    got = collections.Counter(tight(r["text"]) for r in once.collect())
    assert got == dict.fromkeys({tight(r[1]) for r in rows}, 1)
    best = {}
    for i, t, *_ in rows:
        key = (-len(t or ""), i is None, i or 0)
        best[tight(t)] = min(best.get(tight(t), key), key)
    assert all((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) == best[tight(r["text"])] for r in once.collect())
    # Near copies: one row of each class of sets of five words; rows without words all stay.
    left = corpus_pipeline.without_near_copies(spark, frame, FOLDER)
    assert left.columns == frame.columns
    words = [(r[1] or "").split() for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                root = [min(root[x], root[y]) if r in (root[x], root[y]) else r for r in root]
    assert collections.Counter(root[k] for k in plain(left)) == dict.fromkeys(set(root), 1)
    # Passages: bytes under strings of PASSAGE bytes that start elsewhere too; what is left blank goes.
    raw = [(r[1] or "").encode() for r in rows]
    n = corpus_pipeline.PASSAGE
    seen = collections.Counter(x[k : k + n] for x in raw for k in range(len(x) - n + 1))
    want = {}
    for r, x in zip(rows, raw, strict=True):
        gone = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g).decode()
        if kept.strip():
            want[r[4]] = kept
    cut = corpus_pipeline.without_passages(spark, frame, FOLDER)
    assert cut.columns == frame.columns and {r["node"]: r["text"] for r in cut.collect()} == want
    assert want[10] != rows[10][1] and want[11] != rows[11][1]  # the shared passage is out of both
    # Packing: every row's tokens once.
    packed = corpus_pipeline.packed(spark, frame, FOLDER).collect()
    assert sum(r["length"] for r in packed if r["start"] == 0) and collections.Counter(r["doc_id"] for r in packed if r["start"] == 0) == collections.Counter(r[0] for r in rows)


def test_stages_of_an_empty_table(spark):
    docs = table(spark, uneven()).where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0
