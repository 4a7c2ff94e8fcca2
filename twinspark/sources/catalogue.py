"""The catalogue that the shared tables stand for: files, side tables, archives, a directory snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def base(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories r0 to r3, one file for each document, with its text as `content`."""
    d = table(spark, folder, "documents")
    s, k = F.expr("CAST(substr(source, 4) AS INT)"), F.expr("doc_id div 20")
    d = d.withColumns({"s": s, "k": k})
    return d.select(
        "doc_id",
        F.expr("concat('r', s % 4)").alias("repo"),
        F.expr("s % 4").alias("repo_ord"),
        F.expr("concat(lang, '/', s div 4, '/doc_', k, '.', CASE k % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'csv' WHEN 3 THEN 'eml' ELSE 'bin' END)").alias("rel_path"),
        F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("hash"),
        F.expr("1514764800000 + ((doc_id * 7919) % 2500) * 86400000 + doc_id * 1000").alias("modified_ms"),
        F.expr("doc_id % 11 = 3").alias("missing"),
        F.expr("CASE k % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/csv' WHEN 3 THEN 'message/rfc822' END").alias("mime"),
        F.expr("CASE WHEN doc_id % 6 = 0 THEN concat('r', (s + 1) % 4) END").alias("origin"),
        F.expr("CASE WHEN doc_id % 3 <> 0 THEN 640 + (doc_id % 5) * 160 END").alias("img_w"),
        F.expr("CASE WHEN doc_id % 3 <> 0 THEN 480 + (doc_id % 7) * 120 END").alias("img_h"),
        F.expr("CASE WHEN doc_id % 4 = 1 THEN 1388534400000 + ((doc_id * 104729) % 4000) * 86400000 END").alias("taken_ms"),
        F.expr("CASE WHEN doc_id % 4 IN (1, 2) THEN concat('Cam ', doc_id % 3) END").alias("camera"),
        F.col("text").alias("content"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    """r0 to r3, and m0, an imperfect copy of r0."""
    b = base(spark, folder)
    changed = F.expr("doc_id % 17 = 2")
    mirror = b.where("repo = 'r0' AND doc_id % 7 <> 0").withColumns(
        {
            "repo": F.lit("m0"),
            "repo_ord": F.lit(4),
            "rel_path": F.expr("concat(CASE WHEN doc_id % 13 = 1 THEN 'moved/' ELSE '' END, rel_path)"),
            "size": F.col("size") + changed.cast("long"),
            "hash": F.when(changed, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("hash")),
            "modified_ms": F.col("modified_ms") + F.when(changed, 86400000).otherwise(0),
            "missing": F.expr("doc_id % 9 = 4"),
            "origin": F.lit("r0"),
        }
    )
    return b.unionByName(mirror).drop("content")


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    known = files(spark, folder).where("repo <> 'm0'").join(table(spark, folder, "labels"), "doc_id")
    tags = F.expr("filter(array(CASE WHEN quality = 1 THEN 'keep' ELSE 'review' END, CASE WHEN toxic = 1 THEN 'toxic' END), t -> t IS NOT NULL)")
    return known.select("repo", "rel_path", tags.alias("tags"))


def accepted(spark: SparkSession, folder: str) -> DataFrame:
    known = files(spark, folder).where("repo <> 'm0' AND doc_id % 5 = 0").join(table(spark, folder, "labels").where("quality = 1 AND toxic = 0"), "doc_id")
    return known.select("repo", "size", "hash").distinct()


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    locked = F.expr("doc_id % 29 = 0")
    return base(spark, folder).select(
        F.lit("arch").alias("repo"), F.expr("concat('backup_', doc_id div 16, '.zip')").alias("archive_rel"), F.expr("doc_id % 16").alias("member_ord"), F.col("rel_path").alias("member_name"), "size", F.when(~locked, F.col("hash")).alias("hash"), locked.alias("locked")
    )


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A walk of the directories some time after the last scan: files gone, changed and new."""
    live = files(spark, folder).where("NOT missing")
    seen = live.where("doc_id % 10 <> 7").select("repo", "rel_path", "size", F.expr("modified_ms + CASE WHEN doc_id % 8 = 5 THEN 1 ELSE 0 END").alias("modified_ms"))
    new = live.where("doc_id % 14 = 9").select("repo", F.expr("concat('new/', rel_path)").alias("rel_path"), "size", "modified_ms")
    return seen.unionByName(new)


def sync_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("g", "r0", [("m0", "Mirror"), ("r1", "AddOnly"), ("r2", "ApplyChanges")])], "name string, main string, sinks array<struct<repo: string, mode: string>>")


def sign_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """64-bit sign hash of each embedding, as eight 8-bit bands."""
    bit = lambda x, i: F.when(x > 0, F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2), F.pmod(i, F.lit(8))).cast("long")).otherwise(F.lit(0).cast("long"))
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", bit).alias("bits"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.aggregate(F.slice("bits", b * 8 + 1, F.lit(8)), F.lit(0).cast("long"), lambda a, x: a + x))
    return e.select("vec_id", bands.alias("bands"))


def durations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), (F.octet_length("text").cast("long") * 37).alias("ms"))


def roots(spark: SparkSession, folder: str) -> DataFrame:
    """Where repositories lie; m0 overlaps r0."""
    return spark.createDataFrame([("r0", "/vol/a"), ("r1", "/vol/b"), ("r2", "/vol/c"), ("r3", "/vol/d"), ("m0", "/vol/a")], "repo string, root string")


def repositories(spark: SparkSession) -> DataFrame:
    rows = [("r0", "/vol/a", False, 0), ("r1", "/vol/b", False, 1514764800000), ("r2", "/vol/c", True, 1514761200000), ("r3", "/vol/d", False, 1514764790000), ("m0", "/vol/a", False, 1514592000000)]
    return spark.createDataFrame(rows, "repo string, abs_path string, remote boolean, last_scan_ms long")


def scanned_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files with their contents, some under names, or with contents, that the classifier looks for."""
    b = base(spark, folder)
    path = F.expr("""CASE doc_id % 23 WHEN 1 THEN concat('w/', doc_id, '/wallet.dat') WHEN 2 THEN concat('v/pass', doc_id, '.kdbx') WHEN 3 THEN concat('.gnupg/ring', doc_id) WHEN 4 THEN concat('h', doc_id, '/.ssh/id_rsa')
        WHEN 5 THEN concat('c/cert', doc_id, '.pem') WHEN 6 THEN concat('f/Rechnung-', doc_id, '.txt') WHEN 7 THEN concat('p/my passport ', doc_id, '.jpg') WHEN 8 THEN concat('h', doc_id, '/.ssh/id_rsa.pub') ELSE rel_path END""")  # fmt: skip
    content = F.expr("""CASE doc_id % 19 WHEN 1 THEN concat('-----BEGIN EC PRIVATE KEY-----', content) WHEN 2 THEN concat('{"cipher":1,"kdfparams":2,"Crypto":3}', content) WHEN 3 THEN concat('{"seed_version":4}', content)
        WHEN 4 THEN concat(repeat('abandon ability ', 6), content) WHEN 5 THEN concat(repeat('abandon ability ', 5), content) WHEN 6 THEN concat('twelve bytes', 'b1', chr(5), chr(0), content) ELSE content END""")  # fmt: skip
    return b.withColumns({"rel_path": path, "content": content}).withColumn("size", F.octet_length("content").cast("long"))


def prints_512(spark: SparkSession, folder: str) -> DataFrame:
    """512-bit prints of the embeddings, eight bits for each value, as 32 words of 16 bits in `bands`."""
    levels = [-0.15, -0.1, -0.05, 0.0, 0.05, 0.1, 0.15, 0.2]
    eight = lambda x: sum((F.when(x > level, 1 << k).otherwise(0) for k, level in enumerate(levels)), F.lit(0))
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", eight).alias("v"))
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda w: F.get("v", 2 * w) + F.get("v", 2 * w + 1) * 256).alias("bands"))


def prints_1536(spark: SparkSession, folder: str) -> DataFrame:
    """1536-bit prints, as of videos, in 96 words of 16 bits: random ones, and copies with a bit of every word, two of ten words, or none changed."""
    words = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda w: F.conv(F.substr(F.sha2(F.concat(F.lit("v"), "vec_id", F.lit(":"), F.floor(w / 16)), 256), (w % 16) * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    own = table(spark, folder, "embeddings").select("vec_id", words.alias("bands"))
    change = F.transform("bands", lambda v, w: v.bitwiseXOR(F.expr("CASE vec_id % 3 WHEN 0 THEN 1L WHEN 1 THEN 3L ELSE 0L END") * ((F.col("vec_id") % 3 == 0) | (w < 10)).cast("long")))
    return own.unionByName(own.withColumn("bands", change).withColumn("vec_id", F.col("vec_id") + 1000000))


def pictures(spark: SparkSession, folder: str, side: int) -> DataFrame:
    """Square pictures (vec_id, n, p: brightness row by row), each pixel from two components of an embedding."""
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    y, x = (lambda i: F.floor(i / side)), (lambda i: i % side)
    value = lambda i: F.floor(128 + 300 * (F.get("e", ((y(i) * 7 + x(i) * 3) % 64).cast("int")) + F.get("e", ((y(i) * x(i)) % 64).cast("int"))))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.greatest(F.lit(0), F.least(F.lit(255), value(i))).cast("int"))
    return e.select("vec_id", F.lit(side).alias("n"), pixels.alias("p"))


def turned(pixels: Column, side: int, turn: Column) -> Column:
    """A square picture in one of its eight turns and mirrorings, by number."""
    last = side - 1
    y, x = (lambda i: F.floor(i / side)), (lambda i: i % side)
    places = [
        lambda i: i,
        lambda i: (last - x(i)) * side + y(i),
        lambda i: side * side - 1 - i,
        lambda i: x(i) * side + last - y(i),
        lambda i: y(i) * side + last - x(i),
        lambda i: (last - y(i)) * side + x(i),
        lambda i: x(i) * side + y(i),
        lambda i: (last - x(i)) * side + last - y(i),
    ]

    def moved(place) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.get(pixels, place(i).cast("int")))

    out = F.when(turn == 0, moved(places[0]))
    for k, place in enumerate(places[1:], 1):
        out = out.when(turn == k, moved(place))
    return out


def sounds(spark: SparkSession, folder: str) -> DataFrame:
    """Prints of 64 words from the embeddings (vec_id, ms, print), and copies, as vec_id + 1000000, that begin later and differ in a few bits."""
    word = lambda x: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(0.9999), x.cast("double"))) + 1) * 2147483648.0)
    own = table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 7 * 1500).alias("ms"), F.transform("embedding", word).alias("print"))
    late = F.slice(F.transform("print", lambda w, k: F.when(k % 10 == 0, w.bitwiseXOR(F.lit(3).cast("long"))).otherwise(w)), (F.col("vec_id") % 5 + 1).cast("int"), F.lit(64))
    return own.unionByName(own.select((F.col("vec_id") + 1000000).alias("vec_id"), (F.col("ms") + F.col("vec_id") % 3 * 900).alias("ms"), late.alias("print")))
