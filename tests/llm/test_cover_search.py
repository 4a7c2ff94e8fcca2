"""Exact top-k search against all inner products, on odd vectors and over many blocks."""

import glob
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.llm import cover_search, queries

COLUMNS = "vec_id long, embedding array<double>, part int, v string, row string, rank string"


def plainly(rows, k=5, every=50):
    usable = [(n, i, [math.floor(256 * x) for x in e]) for n, (i, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, i, e in usable:
        if i is not None and i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), j is None, j or 0) for m, j, f in usable if m != n and len(e) == len(f))
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, rows, **kw):
    frame = spark.createDataFrame([(i, e, 1, "x", "y", None) for i, e in rows], COLUMNS).repartition(3)
    return sorted(map(tuple, cover_search.top_inner_products(frame, F.col("vec_id") % 50 == 0, **kw).collect()), key=repr)


def odd():
    rng = random.Random(13)
    near = lambda c, s: [x + rng.gauss(0, s) for x in c]
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, near(rng.choice(centres), 0.05)) for i in range(500)]
    rows += [(i, centres[0]) for i in range(500, 900)]  # one vector many times
    rows += [(0, rows[0][1]), (0, centres[1]), (50, rows[50][1]), (50, rows[50][1]), (None, centres[2]), (None, centres[2])]
    rows += [(1000, None), (1050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1100, [math.nan] * 6), (1150, [math.inf] + [0.0] * 5), (1200, [1.0, 2.0]), (1201, [0.5, -0.5]), (1250, []), (1251, []), (1300, [3.0])]
    return rows


@pytest.mark.parametrize("sizes", [(4096, 8192), (40, 10)])
def test_same_as_all_products(spark, monkeypatch, sizes):
    monkeypatch.setattr(cover_search, "BLOCK_ROWS", sizes[0])
    monkeypatch.setattr(cover_search, "STRIP_ROWS", sizes[1])
    assert searched(spark, odd()) == plainly(odd())
    assert searched(spark, odd(), k=40) == plainly(odd(), k=40)


def test_large_components_and_no_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-4e5, 4e5) for _ in range(5)]) for i in range(120)]  # products beyond 2 ** 53
    assert searched(spark, rows) == plainly(rows)
    assert searched(spark, [(50, [1.0])]) == [] and searched(spark, []) == []
    with pytest.raises(Exception, match="too large|too big|Overflow"):
        searched(spark, [(50, [1e12]), (51, [1e12])])


def test_trees_cover_and_keep_apart():
    """Every row is one node, under its parent's radius; nodes that split large covers are apart by their level's distance."""
    rng = np.random.default_rng(1)
    for x in (rng.integers(-9, 9, (300, 3)).astype(float), np.zeros((50, 4)), rng.normal(size=(1, 2)), np.repeat(rng.normal(size=(5, 2)), 30, axis=0)):
        order, parent, size, radius = cover_search.cover_tree(x)
        assert sorted(order) == list(range(len(x))) and parent[0] == -1 and size[0] == len(x)
        x = x[order]
        for k in range(len(x)):
            under = range(k + 1, k + int(size[k]))
            assert all(parent[j] >= k for j in under)
            assert np.isclose(radius[k], max((np.linalg.norm(x[j] - x[k]) for j in under), default=0))
    chain = np.concatenate([np.linspace(0, 1, 200), [50, 51, 200]])[:, None]
    order, parent, size, radius = cover_search.cover_tree(chain)
    assert (radius[size > cover_search.LEAF * 4] > 0.1).all() and (size > 1).sum() > 5


def test_nodes_are_dropped(spark):
    """Over clustered vectors most inner products are never taken."""
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([c * 400 + rng.normal(size=(300, 8)) * 4 for c in rng.normal(size=(12, 8))]))
    import pyarrow as pa

    def tree(some):
        order, parent, size, radius = cover_search.cover_tree(x[some])
        return cover_search.Tree(pa.table({"place": np.arange(len(some)), "parent": parent, "size": size, "radius": radius, "row": some[order], "vec_id": some[order], "v": pa.array(x[some][order].tolist())}))

    taken = []

    class Counted(cover_search.Search):
        def products(self, queries, rows):
            taken.append(len(queries) * len(rows))
            return super().products(queries, rows)

    asked = np.arange(0, len(x), 9)
    got = Counted(tree(asked), tree(np.arange(len(x))), 5, np.full(len(asked), -np.inf))
    assert sum(taken) < 0.5 * len(asked) * len(x)
    for q, scores in zip(got.q.row, got.score, strict=True):
        assert scores.tolist() == sorted(np.delete(x @ x[q], q).tolist(), reverse=True)[:5]


def test_query_same_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{glob.glob(f'{folder}/embeddings.parquet')[0]}'")
    want = db.execute(queries.ORACLE_SQL["op13_cover_search"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op13_cover_search"](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
