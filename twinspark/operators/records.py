"""Stored entries of all versions as rows of the newest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.operators.catalogue import is_stale

#: Fixed value: the version that is written now.
NEWEST = 10
#: Each column with its place in an entry, its type, and the version from which that place holds it in this form.
FIELDS = {
    "size": ("$.size", "bigint", 1),
    "hash": ("$.hash", "string", 1),
    "modified_ms": ("$.modified_ms", "bigint", 1),
    "missing": ("$.missing", "boolean", 1),
    "mime": ("$.mime", "string", 1),
    "text_hash": ("$.pdf_hash", "string", 1),
    "img_w": ("$.img_size[0]", "int", 1),
    "img_h": ("$.img_size[1]", "int", 1),
    "duration_ms": ("$.audio.duration_ms", "bigint", 1),
    "img_words": ("$.img_fingerprint", "array<bigint>", 2),  # one word of 64 bits before
    "origin": ("$.origin", "string", 3),
    "taken_ms": ("$.exif.taken_ms", "bigint", 4),
    "camera": ("$.exif.camera", "string", 4),
    "frame_words": ("$.video_hash", "array<array<bigint>>", 8),  # a word for each frame before
    "audio_words": ("$.audio.fingerprint", "array<bigint>", 10),  # hashes of chunks before
}


def migrated(records: DataFrame, version: str = "version", body: str = "body") -> DataFrame:
    """`records` (version, body: the entry as JSON, and keys) with FIELDS, `stale` and `error` in place of the body.

    Every version goes through one plan: what a version did not have yet, or had in another form,
    is null, and an entry whose fingerprint is missing for that is stale, to be scanned again.  Sounds before
    the last version keep their duration with an empty print.  A version that is not known, no
    body, or one that is no JSON object give an `error` and no values; so does a field that cannot be read as its type.
    """
    entry = F.try_parse_json(F.col(body))
    v = F.col(version)
    rows = records.withColumn("_entry", entry)
    known = v.between(1, NEWEST)
    whole = F.col(body).isNotNull() & F.coalesce(F.schema_of_variant("_entry").startswith("OBJECT"), F.lit(False))

    def value(path: str, kind: str, since: int) -> Column:
        return F.when(known & whole & (v >= since), F.try_variant_get("_entry", path, kind))

    broken = [F.when((v >= since) & (F.try_variant_get("_entry", path, "variant").isNotNull()) & ~F.coalesce(F.is_variant_null(F.try_variant_get("_entry", path, "variant")), F.lit(False)) & value(path, kind, since).isNull(), name) for name, (path, kind, since) in FIELDS.items()]
    error = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("version "), F.coalesce(v.cast("string"), F.lit("missing")))).when(~whole, "no entry").otherwise(F.concat(F.lit("field "), F.coalesce(*broken)))
    rows = rows.select("*", error.alias("error"), *(value(*f).alias(name) for name, f in FIELDS.items()))
    good = F.col("error").isNull()
    old_sound = good & F.col("duration_ms").isNotNull() & F.col("audio_words").isNull()
    rows = rows.withColumn("audio_words", F.when(old_sound, F.array().cast("array<bigint>")).otherwise(F.col("audio_words")))
    rows = rows.withColumns({name: F.when(good, F.col(name)) for name in FIELDS})
    return rows.withColumn("stale", F.when(good, is_stale(F.col("mime"), v, F.col("rel_path")))).drop(body, "_entry")
