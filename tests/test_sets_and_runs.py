"""Sets of paths told apart without gathering them, and runs of near values."""

import random

import pytest
from pyspark.sql import functions as F

from twinspark.operators import compare, similar, views

FILES = "repo string, repo_ord int, rel_path string, size long, hash string, modified_ms long, missing boolean, mime string, origin string, img_w int, img_h int, taken_ms long, camera string"


def table(spark, *rows):
    return spark.createDataFrame([(r, 0, p, 1, c, 1, m, None, None, None, None, None, None) for r, p, c, m in rows], FILES)


def test_paths_with_bars_and_large_sets(spark):
    left = table(spark, ("a", "x|y", "1", False), ("a", "p", "2", False), ("a", "q", "2", False), ("a", "only", "3", False), ("a", "old", "5", True), ("a", "s", "6", False))
    right = table(spark, ("b", "x", "1", False), ("b", "y", "1", False), ("b", "q", "2", False), ("b", "p", "2", False), ("b", "gone", "3", True), ("b", "back", "5", False), ("b", "s", "6", True), ("b", "t", "6", False))
    rows = {r["hash"]: r for r in compare.relations(left, right).collect()}
    assert {k: r["relation"] for k, r in rows.items()} == {"1": "Renamed", "2": "Equal", "3": "OnlyLeft", "5": "OnlyRight", "6": "Renamed"}
    assert (rows["1"]["left_count"], rows["1"]["right_count"], rows["1"]["left_path"], rows["1"]["right_path"]) == (1, 2, "x|y", "x")
    assert (rows["3"]["right_count"], rows["3"]["right_path"], rows["3"]["deleted_in_right"], rows["5"]["deleted_in_left"]) == (0, None, True, True)
    states = {r["key"]: r["commands"] for r in views.states(compare.relations(left, right)).collect()}
    assert states["x|y|x"] == ["rename_left", "delete_all_right", "keep_one_right", "hide"]
    assert sorted((r["side"], r["rel_path"]) for r in compare.path_rows(left, right).where("hash = '1'").collect()) == [("left", "x|y"), ("right", "x"), ("right", "y")]
    assert compare.relations(left.where("false"), right.where("false")).count() == 0
    many = spark.range(20_000).select(F.lit("a").alias("repo"), F.lit(0).alias("repo_ord"), F.concat(F.lit("p"), "id").alias("rel_path"), F.lit(1).cast("long").alias("size"), F.lit("h").alias("hash"), F.lit(False).alias("missing"))
    assert compare.relations(many, many.orderBy(F.desc("rel_path"))).first()["relation"] == "Equal"
    assert compare.relations(many, many.where("rel_path <> 'p77'")).first()["relation"] == "Renamed"


def test_commands_say_from_where_to_where(spark):
    row = spark.createDataFrame([("l", "r")], "l string, r string")
    said = lambda command, several=False: tuple(row.select(views.operation(F.lit(command), F.col("l"), F.col("r"), F.lit(several)).alias("o")).first()["o"] or ())
    assert said("copy_right") == ("copy", "l", "l") and said("copy_left") == ("copy", "r", "r")
    assert said("overwrite_right") == ("overwrite", "l", "r") and said("overwrite_left") == ("overwrite", "r", "l")
    assert said("rename_left") == ("rename", "l", "r") and said("rename_right") == ("rename", "r", "l")
    assert said("delete_left") == ("delete", "l", None) and said("delete_all_right", True) == ("delete", "r", None)
    assert said("keep_one_left", True) == ("pick", None, None) and said("hide") == ()


@pytest.mark.parametrize("seed", range(3))
def test_runs_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 0, -5, 100, 102, 105, rng.randrange(-3000, 3000)])) for i in rng.sample(range(10**6), 80)]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "id long, ms long, place int").repartition(3)
    order = sorted((ms, i) for i, ms in rows if ms is not None)
    got = sorted((r["place"], r["id"], r["ms"], r["last_place"]) for r in similar.interval_runs(frame, 5).collect())
    assert got == [(k, i, ms, sum(other <= ms + 5 for other, _ in order)) for k, (ms, i) in enumerate(order, 1)]
    pairs = sorted((min(a, b), max(a, b)) for k, (m, a) in enumerate(order) for n, b in order[k + 1 :] if n - m <= 5)
    assert sorted(map(tuple, similar.interval_pairs(frame, 5).collect())) == pairs
    assert similar.interval_pairs(frame.where("false")).count() == 0


def test_a_constant_value_makes_a_row_for_each_row(spark):
    n = 100_000
    runs = similar.interval_runs(spark.range(n).select("id", F.lit(7).alias("ms")))
    assert tuple(runs.agg(F.count("*"), F.countDistinct("place"), F.min("last_place"), F.max("last_place")).first()) == (n, n, n, n)
