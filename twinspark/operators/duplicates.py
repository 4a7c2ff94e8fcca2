"""Exact duplicates: groups of equal content, ranked members, what may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinspark.operators.similar import cut

KEY = ["size", "hash"]
#: Members of a group that one task orders.
MOST_MEMBERS = 100_000


def live(files: DataFrame) -> DataFrame:
    return files.where(~F.col("missing"))


def group_keys(files: DataFrame) -> DataFrame:
    """size, hash, copies and wasted bytes of each content that several live files hold."""
    return live(files).groupBy(*KEY).agg(F.count("*").alias("copies")).where("copies > 1").withColumn("wasted", (F.col("copies") - 1) * F.col("size"))


def _order(protected: Column | None) -> list[Column]:
    """What makes a copy better than another, as columns that all ascend."""
    return [
        *([(~protected).alias("o0")] if protected is not None else []),
        (-F.coalesce(F.col("img_w") * F.col("img_h"), F.lit(-1))).alias("o1"),
        (F.col("taken_ms").isNull() & F.col("camera").isNull()).alias("o2"),
        F.col("taken_ms").isNull().alias("o3"),
        F.col("taken_ms").alias("o4"),
        F.col("modified_ms").alias("o5"),
        F.lower("rel_path").alias("o6"),
        F.col("repo_ord").alias("o7"),
        F.col("rel_path").alias("o8"),
    ]


def ranked(files: DataFrame, protected: Column | None = None, most: int = MOST_MEMBERS) -> DataFrame:
    """Members of each group with their rank: the best copy is 1.

    Groups of more than `most` members are not ordered in one task: their rows are dealt by ranges
    of content and order, numbered within a range, and lifted by what stands in the ranges before.
    """
    keys = group_keys(files)
    members = live(files).join(keys, KEY)
    if protected is not None:
        members = members.withColumn("protected", protected)
    order = _order(protected)
    by_rank = F.row_number().over(W.partitionBy(*KEY).orderBy(*order)).cast("long")
    if keys.where(F.col("copies") > most).isEmpty():
        return members.withColumn("rank", by_rank)
    usual = members.where(F.col("copies") <= most).withColumn("rank", by_rank)
    large = members.where(F.col("copies") > most).repartitionByRange(*KEY, *order).sortWithinPartitions(*KEY, *order)
    large = cut(large.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ranges = large.groupBy(*KEY, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(*KEY).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before).drop("_rows")
    lifted = large.join(ranges, [*KEY, "_range"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return usual.unionByName(lifted.drop("_range", "_at", "_first", "_before"))


def rest(files: DataFrame, protected: Column | None = None) -> DataFrame:
    """Members of each group but the best, which an aggregation finds: no group is ordered."""
    order = F.struct(*_order(protected))
    members = live(files)
    if protected is not None:
        members = members.withColumn("protected", protected)
    best = members.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min(order).alias("_best")).where("copies > 1").drop("copies")
    return members.join(best.hint("merge"), KEY).where(order != F.col("_best")).drop("_best")


def with_accepted(files: DataFrame, accepted: DataFrame) -> DataFrame:
    """`files` with is_accepted: whether its repository accepts its content."""
    return files.join(accepted.withColumn("is_accepted", F.lit(True)), ["repo", *KEY], "left").withColumn("is_accepted", F.coalesce("is_accepted", F.lit(False)))


def to_delete(files: DataFrame, accepted: DataFrame, read_only: tuple[str, ...] = ()) -> DataFrame:
    """Copies beyond the best that neither are accepted nor lie in a read-only repository."""
    guarded = F.col("is_accepted") | F.col("repo").isin(*read_only) if read_only else F.col("is_accepted")
    return rest(with_accepted(files, accepted), guarded).where(~F.col("protected"))


def groups_with_any(files: DataFrame, matching: DataFrame) -> DataFrame:
    """Whole groups of which any member matches."""
    return group_keys(files).join(matching, KEY, "left_semi")


def fully_accepted(files: DataFrame, accepted: DataFrame) -> DataFrame:
    members = with_accepted(live(files), accepted).join(group_keys(files), KEY)
    return members.groupBy(*KEY).agg(F.bool_and("is_accepted").alias("all_accepted"), F.count("*").alias("copies")).where("all_accepted").select(*KEY, "copies")


def paths_by_repo(files: DataFrame) -> DataFrame:
    """Within each repository, the sorted paths of each content that it holds more than once."""
    out = live(files).groupBy("repo", *KEY).agg(F.sort_array(F.collect_list("rel_path")).alias("paths"))
    return out.where(F.size("paths") > 1).select("repo", *KEY, F.array_join("paths", "|").alias("paths"))


def path_rows_by_repo(files: DataFrame) -> DataFrame:
    """Within each repository, a row for each path of a content that it holds more than once, with their number."""
    counts = live(files).groupBy("repo", *KEY).agg(F.count("*").alias("copies")).where("copies > 1")
    return live(files).join(counts, ["repo", *KEY]).select("repo", *KEY, "copies", "rel_path")


def page(files: DataFrame, number: int, rows: int = 50) -> DataFrame:
    """One page of groups, most wasteful first."""
    return group_keys(files).orderBy(F.desc("wasted"), F.desc("size"), "hash").offset(number * rows).limit(rows)


def survive_only_in_archives(files: DataFrame, marked: DataFrame, members: DataFrame) -> DataFrame:
    """Contents all of whose live copies are `marked` (repo, rel_path) to go, though an archive still holds them."""
    chosen = marked.select("repo", "rel_path").distinct().withColumn("_marked", F.lit(True))
    copies = live(files).join(chosen, ["repo", "rel_path"], "left").groupBy(*KEY).agg(F.count("*").alias("copies"), F.count("_marked").alias("marked"))
    held = members.where("hash IS NOT NULL").select(*KEY)
    return copies.where("marked = copies").join(held, KEY, "left_semi").select(*KEY, "copies")


def only_in_archives(files: DataFrame, accepted: DataFrame, members: DataFrame) -> DataFrame:
    """survive_only_in_archives() of what to_delete() would take: none, as long as the best copy stays."""
    return survive_only_in_archives(files, to_delete(files, accepted), members)
