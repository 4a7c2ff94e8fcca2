"""Synchronisation plans: what to copy, what to delete, and what a run would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.operators.compare import tombstoned
from twinspark.operators.duplicates import KEY, live


class EmptyMain(ValueError):
    """A sink that deletes would be emptied."""


def copies(source: DataFrame, target: DataFrame) -> DataFrame:
    """Live source files whose content the target does not have live."""
    return live(source).join(live(target), KEY, "left_anti")


def deletes_missing(source: DataFrame, target: DataFrame, guard_live_source: bool = False) -> DataFrame:
    """Live target files whose content the source deleted; with the guard, unless it has another copy."""
    gone = source.where("missing").select(*KEY)
    if guard_live_source:
        gone = gone.join(live(source), KEY, "left_anti")
    return live(target).join(gone, KEY, "left_semi")


def deletes_absent(source: DataFrame, target: DataFrame) -> DataFrame:
    """Live target files whose content the source does not have live."""
    return live(target).join(live(source), KEY, "left_anti")


def resurrections(source: DataFrame, target: DataFrame) -> DataFrame:
    """Copies whose content the target knows only as deleted."""
    return copies(source, target).join(tombstoned(target), KEY, "left_semi")


def run_copies(source: DataFrame, target: DataFrame) -> DataFrame:
    """Of the planned copies, what a run does: the first of each content with a free path is copied."""
    taken = live(target).select("rel_path", F.lit(True).alias("taken"))
    rows = copies(source, target).join(taken, "rel_path", "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    place = F.row_number().over(W.partitionBy(*KEY).orderBy("taken", "rel_path"))
    before = F.min(F.when(~F.col("taken"), F.col("rel_path"))).over(W.partitionBy(*KEY))
    done = F.when(~F.col("taken") & (place == 1), "copied").when(~F.col("taken"), "equal").when(before.isNull() | (F.col("rel_path") < before), "skipped").otherwise("equal")
    return rows.select("rel_path", *KEY, done.alias("outcome"))


def group_plan(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, sink, action, rel_path, size, hash) for all sinks of all groups in one job."""
    sinks = groups.select("name", "main", F.explode("sinks").alias("s")).select("name", "main", F.col("s.repo").alias("sink"), F.col("s.mode").alias("mode"))
    main = files.join(F.broadcast(sinks), files["repo"] == sinks["main"]).select("name", "sink", "mode", "rel_path", *KEY, "missing")
    target = files.join(F.broadcast(sinks), files["repo"] == sinks["sink"]).select("name", "sink", "mode", "rel_path", *KEY, "missing")
    on = ["name", "sink", *KEY]
    adds = live(main).join(live(target), on, "left_anti").withColumn("action", F.lit("copy"))
    missing = live(target).where("mode = 'ApplyChanges'").join(main.where("missing"), on, "left_semi").withColumn("action", F.lit("delete_missing"))
    absent = live(target).where("mode = 'Mirror'").join(live(main), on, "left_anti").withColumn("action", F.lit("delete_absent"))
    return adds.unionByName(missing).unionByName(absent).select("name", "sink", "action", "rel_path", *KEY)


def guard_main(files: DataFrame, groups: DataFrame) -> None:
    """Refuse a group with a deleting sink whose main has no live file."""
    deleting = groups.where(F.exists("sinks", lambda s: s["mode"] != "AddOnly"))
    empty = deleting.join(live(files), deleting["main"] == live(files)["repo"], "left_anti")
    if not empty.isEmpty():
        raise EmptyMain(empty.first()["name"])


def wholesale(files: DataFrame, groups: DataFrame) -> DataFrame:
    """Sinks that the plan would empty."""
    gone = group_plan(files, groups).where("action <> 'copy'").groupBy("name", "sink").agg(F.count("*").alias("deletes"))
    held = live(files).groupBy(F.col("repo").alias("sink")).agg(F.count("*").alias("live_files"))
    return gone.join(held, "sink").where("deletes >= live_files AND live_files > 0").select("name", "sink", "deletes", "live_files")
