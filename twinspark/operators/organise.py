"""Dates, rules and target names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.functions.filters import parse, predicate
from twinspark.functions.scalars import normal_path, rendered, utc_date
from twinspark.operators.duplicates import KEY, live
from twinspark.operators.naming import free_names
from twinspark.operators.similar import cut


def timeline(files: DataFrame) -> DataFrame:
    """Live files and bytes of each month of the best date."""
    best = utc_date(F.coalesce("taken_ms", "modified_ms"))
    return files.where("NOT missing").groupBy(F.year(best).cast("long").alias("year"), F.month(best).cast("long").alias("month")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def plan(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Moves by the first rule (filter, template) that a live file matches, if its target is another valid path."""
    blank = files.withColumns({"tags": F.array().cast("array<string>"), "accepted": F.lit(False)})
    target = F.lit(None).cast("string")
    for expression, template in reversed(rules):
        target = F.when(predicate(parse(expression)), normal_path(rendered(template))).otherwise(target)
    out = blank.where(~F.col("missing")).withColumn("target", target)
    return out.where("target IS NOT NULL AND target <> rel_path").select("repo", "rel_path", *(["size", "hash"]), "target")


def with_suffixes(moves: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`moves` with `final`: the target, or its first numbered form that is free; null if the file stays where it is.

    Sources are taken in the order of their paths.  Targets that `files` has live are not free,
    those of files that move away neither, so that moves can be carried out in any order; where one
    that is passed holds the file's content, the file stays: naming.free_names.  Moves without size
    and hash have no content that could be there.
    """
    within = lambda path: F.concat("repo", F.lit("/"), path)
    unknown = {c: F.lit(None).cast(t) for c, t in zip(KEY, ("long", "string"), strict=True) if c not in moves.columns}
    wanted = moves.withColumns(unknown).withColumns({"wish": within("target"), "turn": F.struct("repo", "rel_path")})
    held = (wanted if files is None else live(files)).select(within("rel_path").alias("path"), *KEY)
    placed = free_names(cut(wanted), held.where("false") if files is None else held, same_in_run=False, dotfiles=False)
    return placed.select(*moves.columns, F.when(~F.col("skip"), F.expr("substr(path, length(repo) + 2)")).alias("final"))


def moved(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The catalogue after the moves of `rules`: files under their final paths, all others as they are."""
    moves = with_suffixes(plan(files, rules), files).where("final IS NOT NULL").select("repo", "rel_path", "final")
    rows = files.join(moves, ["repo", "rel_path"], "left")
    return rows.withColumn("rel_path", F.when(~F.col("missing"), F.coalesce("final", "rel_path")).otherwise(F.col("rel_path"))).select(*files.columns)
