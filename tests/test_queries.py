"""Every query with SQL against DuckDB over the same tables; the rest yields rows."""

import glob
import os

import duckdb
import pytest

from twinspark.plans.registered import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    want = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(map(tuple, got.select(*names).collect())) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_alignments_make_up_both_sides(spark, name):
    rows = QUERIES[name](spark, FOLDER).limit(20).collect()
    assert rows
    for r in rows:
        at = (0, 0)
        for s in r["segments"]:
            assert (s["a_start"], s["b_start"]) == at
            at = (s["a_end"], s["b_end"])
