"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import BLANKS, cut_lineage, numbered

#: Distinct buckets of (length, prefix hash) that can be broadcast: a proven bound of the side's rows.
SURVIVOR_BUCKETS = 1 << 18
#: Characters of the normalised text under the prefix hash.
PREFIX_CHARS = 64


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest: bool = False, row: str | None = None) -> DataFrame:
    """Group rows whose texts are equal but for ASCII white space.

    Returns one row per input row: doc_id, keep_id, group_size, kept, and with `digest` also
    text_sha256 of the normalised text (rows outside surviving groups are then hashed for the
    report only).  The row with most code points, then the smallest doc_id, stays; a null doc_id
    counts as the largest.  Null texts count as empty, so all null, empty and blank texts are one
    group.  Of repeated rows with one doc_id and text, one row stays.  Other columns are not read,
    but for `row`, a number of each row, which comes back as the column row.

    A first pass groups lengths, then prefix hashes of texts that share their length.  Only rows
    that may be in a group of both get the full hash: their buckets, at most SURVIVOR_BUCKETS
    rows, are broadcast, and a row that meets one by chance is merely hashed as well.  No text is
    shuffled.
    """
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS + "+", "")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.char_length(F.col(text)), F.lit(0)).alias("points"), normal.alias("normal"), *([F.col(row).alias("row")] if row else []))
    keyed = rows.withColumns({"length": F.octet_length("normal"), "prefix": F.xxhash64(F.substring("normal", 1, PREFIX_CHARS))})
    seen = cut_lineage(keyed.groupBy("length", "prefix").agg(F.count("*").alias("n")))
    shared_length = seen.groupBy("length").agg(F.sum("n").alias("of_length")).where("of_length > 1")
    shared_prefix = seen.where("n > 1").join(shared_length, "length", "left_semi")
    bucket = F.pmod(F.xxhash64("length", "prefix"), F.lit(SURVIVOR_BUCKETS)).alias("bucket")
    buckets = shared_prefix.select(bucket).distinct().withColumn("survives", F.lit(True))
    marked = keyed.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left")
    full = F.sha2(F.col("normal"), 256)
    hashed = cut_lineage(
        marked.select(
            F.col("row") if row else F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "points",
            "length",
            F.when(F.col("survives"), full).alias("full"),
            *([F.when(F.col("survives").isNull(), full).alias("alone")] if digest else []),
        )
    )
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    groups = (
        hashed.where("full is not null")
        .groupBy("length", "full")
        .agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        .where("group_size > 1")
        .select("length", "full", "group_size", F.col("best.i").alias("keep"), F.col("best.r").alias("keep_row"))
    )
    # Written first, so that both sides of the join are plain shuffles and the rows of a large group can be split.
    out = hashed.hint("merge").join(cut_lineage(groups).hint("merge"), ["length", "full"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        *([F.coalesce("full", "alone").alias("text_sha256")] if digest else []),
        *(["row"] if row else []),
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns."""
    rows = numbered(docs)
    stays = exact_dedup(rows, row="_row").where("kept").select(F.col("row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*docs.columns)
