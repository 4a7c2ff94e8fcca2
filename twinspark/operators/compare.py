"""Comparison of repositories by content and by path, and the sets of files that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.operators.duplicates import KEY, live, rest


def content_index(files: DataFrame) -> DataFrame:
    """Of each content, whether it is there and whether it is known as missing."""
    return files.groupBy(*KEY).agg(F.bool_or(~F.col("missing")).alias("present"), F.bool_or("missing").alias("tombstone"))


def tombstoned(files: DataFrame) -> DataFrame:
    return content_index(files).where("tombstone AND NOT present")


def of(files: DataFrame, *repos: str) -> DataFrame:
    return files.where(F.col("repo").isin(*repos))


def classified(source: DataFrame, references: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Live source files: New, Equal with the first reference's path, or DeletedInReference.

    References come first as `order` names them, or else by repo_ord.
    """
    turn = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("repo")) if order else F.col("repo_ord")
    known = references.groupBy(*KEY).agg(
        F.bool_or(~F.col("missing")).alias("present"), F.min(F.when(~F.col("missing"), F.struct(turn.alias("turn"), "rel_path"))).alias("first")
    )
    relation = F.when(F.col("present").isNull(), "New").when(F.col("present"), "Equal").otherwise("DeletedInReference")
    return live(source).join(known, KEY, "left").select("repo", "rel_path", *KEY, relation.alias("relation"), F.col("first.rel_path").alias("reference_path"))


def unseen(source: DataFrame, references: DataFrame) -> DataFrame:
    """Live source files whose content no reference has or had."""
    return live(source).join(references, KEY, "left_anti")


def known_elsewhere(source: DataFrame, references: DataFrame, accepted: DataFrame) -> DataFrame:
    """Live source files whose content a reference has or had, and the source does not accept."""
    return live(source).join(references, KEY, "left_semi").join(accepted, ["repo", *KEY], "left_anti")


def path_set(path: Column) -> Column:
    """{n, a, b}: an aggregate that tells sets of paths apart without gathering them, in whatever order they come.

    `n` paths, and the sums of two independent 64-bit hashes of them: sets that differ agree with a
    probability of about 2 ** -128.
    """
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), path).cast("decimal(38,0)"))
    return F.struct(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b"))


def relations(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for each content: how many paths and which least one either side has, how the sides relate, and deletions.

    Equal is the same set of paths on both sides.  No content's paths are gathered: their number may
    be any; path_rows() has them as rows.
    """
    side = lambda x, n: live(x).groupBy(*KEY).agg(path_set(F.col("rel_path")).alias(n), F.min("rel_path").alias(f"{n}_path"))
    both = side(left, "left").join(side(right, "right"), KEY, "full_outer")
    relation = F.when(F.col("right").isNull(), "OnlyLeft").when(F.col("left").isNull(), "OnlyRight").when(F.col("left") == F.col("right"), "Equal").otherwise("Renamed")
    gone = lambda x, n: tombstoned(x).select(*KEY, F.lit(True).alias(n))
    out = both.withColumn("relation", relation).join(gone(right, "gone_right"), KEY, "left").join(gone(left, "gone_left"), KEY, "left")
    count = lambda n: F.coalesce(F.col(f"{n}.n"), F.lit(0).cast("long")).alias(f"{n}_count")
    return out.select(
        *KEY, count("left"), count("right"), "left_path", "right_path", "relation",
        ((F.col("relation") == "OnlyLeft") & F.coalesce("gone_right", F.lit(False))).alias("deleted_in_right"),
        ((F.col("relation") == "OnlyRight") & F.coalesce("gone_left", F.lit(False))).alias("deleted_in_left"),
    )


def path_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """The paths of relations() as rows: size, hash, relation, side, rel_path."""
    every = live(left).select(*KEY, "rel_path", F.lit("left").alias("side")).unionByName(live(right).select(*KEY, "rel_path", F.lit("right").alias("side")))
    return every.join(relations(left, right).select(*KEY, "relation"), KEY).select(*KEY, "relation", "side", "rel_path")


def rows_by_hash(left: DataFrame, right: DataFrame) -> DataFrame:
    """relations() with the paths of each side as one text to be shown, joined by `|`; nothing is read back from these texts."""
    listed = lambda x, n: live(x).groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_list("rel_path")), "|").alias(n))
    shown = relations(left, right).join(listed(left, "left_paths"), KEY, "left").join(listed(right, "right_paths"), KEY, "left")
    return shown.select(*KEY, "left_paths", "right_paths", "relation", "deleted_in_right", "deleted_in_left", "left_count", "right_count", "left_path", "right_path")


def rows_by_path(left: DataFrame, right: DataFrame) -> DataFrame:
    side = lambda x, n: live(x).select("rel_path", F.col("size").alias(f"{n}_size"), F.col("hash").alias(f"{n}_hash"))
    both = side(left, "left").join(side(right, "right"), "rel_path", "full_outer")
    same = (F.col("left_size") == F.col("right_size")) & (F.col("left_hash") == F.col("right_hash"))
    relation = F.when(F.col("right_hash").isNull(), "OnlyLeft").when(F.col("left_hash").isNull(), "OnlyRight").when(same, "Equal").otherwise("Conflict")
    return both.withColumn("relation", relation)


def overview(files: DataFrame, reference: str) -> DataFrame:
    """Of each other repository: live files the reference lacks, shares, and reference files it lacks."""
    live_files = live(files)
    ref = live_files.where(F.col("repo") == reference)
    held = ref.select(*KEY).distinct().withColumn("held", F.lit(True))
    own = live_files.where(F.col("repo") != reference).join(held, KEY, "left").groupBy("repo").agg(F.count_if(F.col("held").isNull()).alias("unique_files"), F.count_if(F.col("held")).alias("shared_files"))
    has = live_files.where(F.col("repo") != reference).select("repo", *KEY).distinct().join(ref.groupBy(*KEY).agg(F.count("*").alias("n")), KEY).groupBy("repo").agg(F.sum("n").alias("covered"))
    total = F.broadcast(ref.agg(F.count("*").alias("total")))  # one row
    return own.join(has, "repo", "left").crossJoin(total).select("repo", "unique_files", "shared_files", (F.col("total") - F.coalesce("covered", F.lit(0))).cast("long").alias("missing_files"))


def sync_back(sink: DataFrame, main: DataFrame) -> DataFrame:
    """Live sink files that the main lacks: New, or a Resurrection of what it deleted; and path conflicts."""
    found = classified(sink, main).where("relation <> 'Equal'")
    taken = live(main).select("rel_path", F.lit(True).alias("conflict"))
    return found.join(taken, "rel_path", "left").select("repo", "rel_path", *KEY, F.when(F.col("relation") == "New", "New").otherwise("Resurrection").alias("status"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def folder_export(source: DataFrame, references: DataFrame, redundant: bool = False) -> DataFrame:
    """Live source files unknown to the references: one of each content, or else the rest of the copies."""
    copies = rest(source).select("repo", "rel_path")
    return unseen(source, references).join(copies, ["repo", "rel_path"], "left_semi" if redundant else "left_anti")
