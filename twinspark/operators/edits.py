"""Strict edits of single files: renames, copies, overwrites and deletes that are refused rather than guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.functions.scalars import stays_within
from twinspark.operators.duplicates import live

OPS = ("rename", "copy", "overwrite", "delete")


def _invalid(path: Column) -> Column:
    return F.coalesce((F.trim(path) == "") | ~stays_within(path), F.lit(True))


def outcomes(files: DataFrame, requests: DataFrame) -> DataFrame:
    """`requests` (n, op, from_repo, from_rel, to_repo, to_rel) with what comes of each: `outcome`.

    A rename stays in from_repo, a delete has no target.  `done`; `same` where source and target
    are one file, which is no edit; or a refusal: `unknown_op`, `invalid_path`, `no_such_file` (a
    delete takes a missing entry too, as it may be gone from the disk already), `already_exists`
    (an overwrite takes what is there).  A request that could be done is a `conflict` if one before
    it by n, which no two share, writes a path that it reads or writes, or reads one that it writes.
    """
    asked = requests.select("n", "op", "from_repo", "from_rel", F.when(F.col("op") == "rename", F.col("from_repo")).when(F.col("op") != "delete", F.col("to_repo")).alias("to_repo"), F.when(F.col("op") != "delete", F.col("to_rel")).alias("to_rel"))
    source = files.select(F.col("repo").alias("from_repo"), F.col("rel_path").alias("from_rel"), F.col("missing").alias("_gone"))
    target = live(files).select(F.col("repo").alias("to_repo"), F.col("rel_path").alias("to_rel"), F.lit(True).alias("_taken"))
    rows = asked.join(source, ["from_repo", "from_rel"], "left").join(target, ["to_repo", "to_rel"], "left")
    op, one = F.col("op"), F.coalesce((F.col("from_repo") == F.col("to_repo")) & (F.col("from_rel") == F.col("to_rel")), F.lit(False))
    bad = _invalid(F.col("from_rel")) | ((op != "delete") & _invalid(F.col("to_rel")))
    outcome = (
        F.when(op.isNull() | ~op.isin(*OPS), "unknown_op")
        .when((op == "rename") & one, "same")
        .when(bad, "invalid_path")
        .when(one, "same")
        .when(F.col("_gone").isNull() | (F.col("_gone") & (op != "delete")), "no_such_file")
        .when(op.isin("rename", "copy") & F.col("_taken"), "already_exists")
        .otherwise("done")
    )
    rows = rows.withColumn("outcome", outcome).drop("_gone", "_taken")
    touch = lambda repo, path, writes: F.struct(F.col(repo).alias("repo"), F.col(path).alias("path"), writes.alias("writes"))
    touched = rows.where("outcome = 'done'").select("n", F.explode(F.array(touch("from_repo", "from_rel", op.isin("rename", "delete")), touch("to_repo", "to_rel", F.lit(True)))).alias("t")).select("n", "t.*").where("path IS NOT NULL")
    crowded = touched.groupBy("repo", "path").agg(F.min("n").alias("first"), F.min(F.when(F.col("writes"), F.col("n"))).alias("first_write"), F.count("*").alias("all")).where("first_write IS NOT NULL AND all > 1")
    late = touched.join(crowded, ["repo", "path"]).where("n > CASE WHEN writes THEN first ELSE first_write END").select("n", F.lit(True).alias("_late")).distinct()
    out = rows.join(late, "n", "left").withColumn("outcome", F.when(F.col("_late"), "conflict").otherwise(F.col("outcome")))
    return out.select("n", "op", "from_repo", "from_rel", "to_repo", "to_rel", "outcome")


def edited(files: DataFrame, requests: DataFrame) -> DataFrame:
    """The catalogue after the requests that outcomes() says are done.

    A rename keeps the entry under its new path; a copy is a new entry whose origin is the source's
    repository; what lay at a target, be it overwritten or a missing entry, is replaced; a deleted entry is missing.
    """
    done = outcomes(files, requests).where("outcome = 'done'")
    places = files.groupBy("repo").agg(F.min("repo_ord").alias("_ord"))
    gone = done.where("op = 'rename'").select(F.col("from_repo").alias("repo"), F.col("from_rel").alias("rel_path"))
    gone = gone.unionByName(done.where("op <> 'delete'").select(F.col("to_repo").alias("repo"), F.col("to_rel").alias("rel_path")))
    dropped = done.where("op = 'delete'").select(F.col("from_repo").alias("repo"), F.col("from_rel").alias("rel_path"), F.lit(True).alias("_deleted"))
    kept = files.join(gone, ["repo", "rel_path"], "left_anti").join(dropped, ["repo", "rel_path"], "left")
    kept = kept.withColumn("missing", F.col("missing") | F.coalesce("_deleted", F.lit(False))).select(*files.columns)
    new = files.join(done.where("op <> 'delete'"), (F.col("repo") == F.col("from_repo")) & (F.col("rel_path") == F.col("from_rel"))).join(places.withColumnRenamed("repo", "_to"), F.col("to_repo") == F.col("_to"), "left")
    values = {"repo": F.col("to_repo"), "rel_path": F.col("to_rel"), "repo_ord": F.coalesce("_ord", "repo_ord"), "origin": F.when(F.col("op") == "rename", F.col("origin")).otherwise(F.col("from_repo"))}
    return kept.unionByName(new.select(*(values.get(c, F.col(c)).alias(c) for c in files.columns)))
