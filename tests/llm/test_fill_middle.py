"""Fill-in-the-middle against a plain rewriting of whole texts, with pieces of several sizes."""

import glob
import hashlib
import os
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinspark.llm import fill_middle, queries


def plainly(i, text, seed="1"):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((a % (len(tokens) + 1), b % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or c % 100 >= 90:
        return i, len(tokens), "plain", None, None, text
    if d % 100 < 20:
        return i, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(12)
    some = ["a", "Pq", "<", ">", "<P", "S>", "<M>", "é", "日本", "🙂", " ", "\n", "\r\n", "\x00", "word", "P", "x" * 70, "<<S>"]
    out = [(i, "".join(rng.choice(some[: 6 if i % 3 else None] + some[7:]) for _ in range(rng.randrange(60)))) for i in range(300)]
    long = "".join(rng.choice(["alpha", " ", "β", ".", "x" * 300]) for _ in range(4000))
    return [*out, (1, None), (2, ""), (3, "<"), (4, "<P>"), (5, "<" * 200), (6, "Z" * 500), (None, "no id"), (None, None), (7, long), (7, long), (7, long[1:]), (-8, "é" * 129), (9, "🙂" * 64), (10, "<P" + ">" * 130)]


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", 1, None, "y") for i, t in data], "doc_id long, text string, n string, key long, form string, cuts string")


@pytest.mark.parametrize("piece_bytes", [64, 1000, fill_middle.PIECE_BYTES])
def test_same_as_plainly(spark, piece_bytes):
    out = fill_middle.fill_in_middle(frame(spark, rows()), piece_bytes=piece_bytes)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plainly(i, t) for i, t in rows()), key=repr)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows())


def test_other_shares_and_no_rows(spark):
    data = rows()[:50]
    forms = lambda **kw: {r["form"] for r in fill_middle.fill_in_middle(frame(spark, data), **kw).where("output <> ''").collect() if not re.search("<[PSM]>.*<[PSM]>.*<[PSM]>.*<[PSM]>", r["output"], re.S)}
    assert forms(plain_from=0) == {"plain"} and "psm" not in forms(spm_below=100)
    assert fill_middle.fill_in_middle(frame(spark, data).where("false")).count() == 0


def test_composition_of_pieces_is_the_whole():
    """A text scanned in pieces of any size, from any state, is the text scanned at once."""
    rng = random.Random(5)
    text = "".join(rng.choice(["<P>", "<", "S", "ab", "é", "🙂", ".", "q" * 90]) for _ in range(400)).encode()
    to, tokens, marks = (x[0] for x in fill_middle._scan(pa.array([text])).pieces())
    for size in (1, 63, 64, 65, 1000):
        parts = fill_middle._scan(pa.array([text[k : k + size] for k in range(0, len(text), size)])).pieces()
        for entry in range(4):
            state, n, mark = entry, 0, 0
            for a, b, c in zip(*parts, strict=True):
                n, mark, state = n + b[state], mark | c[state], a[state]
            assert (state, n, mark) == (to[entry], tokens[entry], marks[entry])


def test_query_same_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for p in glob.glob(f"{folder}/documents.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = db.execute(queries.ORACLE_SQL["op12_fill_middle"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op12_fill_middle"](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
