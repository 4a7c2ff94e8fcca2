"""Rows as a reviewer sees them: selections, states and commands, previews and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.functions.scalars import utc_date
from twinspark.operators.duplicates import KEY, live
from twinspark.operators.naming import free_names
from twinspark.operators.similar import cut


def selected(rows: DataFrame, side: str, only: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Rows whose key, `s:` or `t:` and the path, is among `only`, if given, and not among `exclude` (key)."""
    keyed = rows.withColumn("key", F.concat(F.lit(f"{side}:"), "rel_path"))
    if only is not None:
        keyed = keyed.join(only.select("key"), "key", "left_semi")
    if exclude is not None:
        keyed = keyed.join(exclude.select("key"), "key", "left_anti")
    return keyed.drop("key")


def first_of_path(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Live files with abs_path; of rows that are one file on disk, that of the first repository stays."""
    placed = live(files).join(roots, "repo").withColumn("abs_path", F.concat("root", F.lit("/"), "rel_path"))
    first = placed.groupBy("abs_path").agg(F.min(F.struct("repo_ord", "repo")).alias("first"))
    return placed.join(first, "abs_path").where("repo_ord = first.repo_ord AND repo = first.repo").drop("first", "root")


def states(diff: DataFrame, left_locked: bool = False, right_locked: bool = False) -> DataFrame:
    """Rows of compare.relations() as states of either side and the commands on offer, and the least paths as key.

    A side that once had the content and deleted it is to be
    resurrected; commands that delete or overwrite in a locked repository are left out.
    """
    r = F.col("relation")
    there = lambda deleted: F.when(deleted, "resurrect").otherwise("absent")
    left = F.when(r == "Equal", "same").when(r == "OnlyLeft", "only_here").when(r == "OnlyRight", there(F.col("deleted_in_left"))).otherwise("differs")
    right = F.when(r == "Equal", "same").when(r == "OnlyRight", "only_here").when(r == "OnlyLeft", there(F.col("deleted_in_right"))).otherwise("differs")
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    renamed = lambda side: F.when(F.col(f"{side}_count") > 1, words(f"delete_all_{side}", f"keep_one_{side}")).otherwise(words(f"rename_{side}"))
    commands = F.when(r == "OnlyLeft", words("copy_right", "delete_left")).when(r == "OnlyRight", words("copy_left", "delete_right"))
    commands = commands.when(r == "Renamed", F.concat(renamed("left"), renamed("right"))).when(r == "Conflict", words("compare", "overwrite_right", "overwrite_left", "delete_left", "delete_right")).otherwise(words())
    locked = [f"{verb}_{side}" for side, on in (("left", left_locked), ("right", right_locked)) if on for verb in ("delete", "delete_all", "keep_one", "overwrite")]
    allowed = F.array_except(F.concat(commands, words("hide")), words(*locked)) if locked else F.concat(commands, words("hide"))
    key = F.concat(F.coalesce("left_path", F.lit("")), F.lit("|"), F.coalesce("right_path", F.lit("")))
    return diff.select(key.alias("key"), "relation", left.alias("left_state"), right.alias("right_state"), allowed.alias("commands"))


def board(rows: DataFrame, hidden: DataFrame | None = None, unchanged: bool = False, resurrections: bool = False) -> DataFrame:
    """Rows of states() that are shown: equal ones if asked for, resurrections alone if asked for, none that is hidden (key)."""
    out = rows if unchanged else rows.where("relation <> 'Equal'")
    out = out.where("left_state = 'resurrect' OR right_state = 'resurrect'") if resurrections else out
    return out if hidden is None else out.join(hidden.select("key"), "key", "left_anti")


def operation(command: Column, left: Column, right: Column, several: Column) -> Column:
    """What a command does to files: {op, from, to}; a choice where a side has `several` paths is op `pick`, others are null.

    A copy goes to the path it comes from, an overwrite and a rename to the other side's.
    """
    act = lambda op, a, b: F.struct(F.lit(op).alias("op"), a.cast("string").alias("from"), b.cast("string").alias("to"))
    none = F.lit(None)
    out = F.when(several & command.rlike("^(copy|overwrite|rename|keep_one)_"), act("pick", none, none))
    for name, op, a, b in (("copy_right", "copy", left, left), ("copy_left", "copy", right, right), ("overwrite_right", "overwrite", left, right), ("overwrite_left", "overwrite", right, left), ("rename_left", "rename", left, right), ("rename_right", "rename", right, left), ("delete_left", "delete", left, none), ("delete_right", "delete", right, none), ("delete_all_left", "delete", left, none), ("delete_all_right", "delete", right, none)):
        out = out.when(command == name, act(op, a, b))
    return out


def info(width: Column, height: Column, duration_ms: Column) -> Column:
    """Size of an image, or the minutes and seconds of a sound; else empty."""
    seconds = F.floor(duration_ms / 1000)
    sound = F.format_string("%d:%02d", F.floor(seconds / 60), (seconds % 60).cast("long"))
    return F.when(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("×"), height.cast("string"))).when(duration_ms.isNotNull(), sound).otherwise("")


def listed(files: DataFrame, annotations: DataFrame, accepted: DataFrame) -> DataFrame:
    """Live rows with what a listing shows: info, tags as text, and whether the content is accepted."""
    tags = annotations.select("repo", "rel_path", F.array_join(F.array_sort("tags"), ", ").alias("tags"))
    known = accepted.select("repo", *KEY, F.lit(True).alias("accepted"))
    out = live(files).join(tags, ["repo", "rel_path"], "left").join(known, ["repo", *KEY], "left")
    return out.select("repo", "rel_path", "size", info(F.col("img_w"), F.col("img_h"), F.lit(None).cast("long")).alias("info"), F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("accepted", F.lit(False)).alias("accepted"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """Files and bytes that a group's plan copies and deletes, by sink."""
    copied, deleted = F.col("action") == "copy", F.col("action") != "copy"
    zero = F.lit(0).cast("long")
    return plan.groupBy("name", "sink").agg(F.count_if(copied).alias("copies"), F.coalesce(F.sum(F.when(copied, F.col("size"))), zero).alias("copy_bytes"), F.count_if(deleted).alias("deletes"), F.coalesce(F.sum(F.when(deleted, F.col("size"))), zero).alias("delete_bytes"))


def transfer_totals(classified: DataFrame, move: bool = False) -> DataFrame:
    """One row of what a copy or a move of compare.classified() rows does: files and bytes that come, files that go, stay as they are, or are left out as the target deleted them."""
    new = F.col("relation") == "New"
    comes = F.coalesce(F.sum(F.when(new, F.col("size"))), F.lit(0)).cast("long")
    goes = F.count_if(new) if move else F.lit(0).cast("long")
    return classified.agg(F.count_if(new).alias("copies"), comes.alias("copy_bytes"), goes.alias("deletes"), F.count_if(F.col("relation") == "Equal").alias("unchanged"), F.count_if(F.col("relation") == "DeletedInReference").alias("skipped"))


def copied_entries(candidates: DataFrame, to: str, on_disk: DataFrame) -> DataFrame:
    """Rows of the files that a copy adds to `to`: not missing, with their time on disk (rel_path, disk_ms) and their provenance."""
    out = candidates.join(on_disk, "rel_path", "left")
    return out.select(F.lit(to).alias("repo"), "rel_path", *KEY, F.coalesce("disk_ms", "modified_ms").alias("modified_ms"), F.lit(False).alias("missing"), F.coalesce("origin", "repo").alias("origin"))


def exported_by_date(files: DataFrame, target: DataFrame) -> DataFrame:
    """Where each live file goes under year/month, by UTC: action copy, skip or exhausted, and its path.

    `target` (path, size, hash) is what is there.  By repo_ord and path, each file takes the first
    free of its name and its numbered forms; it is skipped if one that it passes holds its content,
    be it there from before or from this export.  Nothing is overwritten: naming.free_names.
    """
    best = utc_date(F.coalesce("taken_ms", "modified_ms"))
    name = F.element_at(F.split("rel_path", "/"), -1)
    folder = F.concat(F.year(best).cast("string"), F.lit("/"), F.lpad(F.month(best).cast("string"), 2, "0"), F.lit("/"))
    turn = F.struct("repo_ord", "rel_path")
    wanted = cut(live(files).select("repo", "rel_path", *KEY, F.concat(folder, name).alias("wish"), turn.alias("turn")))
    # Of files of one wish and content all but the first meet the first's.
    distinct = wanted.groupBy("wish", *KEY).agg(F.min("turn").alias("turn"))
    placed = free_names(distinct, target, same_in_run=True, dotfiles=True).select("wish", *KEY, "turn", "skip", "path").withColumnRenamed("turn", "first")
    out = wanted.join(placed, ["wish", *KEY])
    copies = (F.col("turn") == F.col("first")) & ~F.col("skip")
    action = F.when(copies, F.when(F.col("path").isNull(), "exhausted").otherwise("copy")).otherwise("skip")
    return out.select("repo", "rel_path", action.alias("action"), F.when(copies, F.col("path")).alias("path"))
