"""Queries over stored entries, archives' members and the event log; and the SQL that says the same."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.functions import scalars
from twinspark.operators import archives, duplicates, records, registry, sync
from twinspark.operators.duplicates import live
from twinspark.operators.similar import shared_folder
from twinspark.plans.queries import query
from twinspark.sources import catalogue as source
from twinspark.streaming import updates

_MIMES = "CASE doc_id % 8 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'audio/mpeg' WHEN 3 THEN 'application/msword' WHEN 4 THEN 'text/plain' WHEN 5 THEN 'message/rfc822' WHEN 6 THEN 'video/x-matroska' END"
_NAME = "rel_path || CASE WHEN doc_id % 16 = 1 THEN '.m4b' ELSE '' END"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Entries as each version wrote them: of versions 1 to 10, and some of 0 and 11 that nobody knows."""
    b = source.base(spark, d).drop("content", "mime").withColumns({"version": F.expr("CAST((doc_id * 7) % 12 AS INT)"), "mime": F.expr(_MIMES), "rel_path": F.expr(_NAME)})
    v = F.col("version")
    word = lambda k: F.conv(F.substring("hash", 8 * k + 1, 8), 16, 10)
    listed = lambda *w: F.concat(F.lit("["), F.concat_ws(",", *w), F.lit("]"))
    eight = listed(*(word(k) for k in range(8)))
    common = F.to_json(F.struct("size", "hash", "modified_ms", "missing", "mime", F.when(F.expr("doc_id % 8 IN (3, 4, 5)"), F.sha2("hash", 256)).alias("pdf_hash"), F.when(F.col("img_w").isNotNull(), F.array("img_w", "img_h")).alias("img_size"), F.when(v >= 3, F.col("origin")).alias("origin"), F.when(v >= 4, F.struct("taken_ms", "camera")).alias("exif")))
    image = F.when(F.expr("doc_id % 8 = 0"), F.concat(F.lit('"img_fingerprint":'), F.when(v == 1, word(0)).otherwise(eight)))
    video = F.when(F.expr("doc_id % 8 IN (1, 6)"), F.concat(F.lit('"video_hash":'), F.when(v < 8, listed(word(0), word(1), word(2))).otherwise(listed(eight, eight, eight))))
    audio = F.when(F.expr("doc_id % 8 = 2"), F.concat(F.lit('"audio":{"duration_ms":'), (F.col("size") * 10).cast("string"), F.when(v < 10, F.concat(F.lit(',"chunk_hashes":["'), "hash", F.lit('"]}'))).otherwise(F.concat(F.lit(',"fingerprint":'), eight, F.lit("}")))))
    body = F.concat(F.expr("substr(c, 1, length(c) - 1)"), F.coalesce(F.concat(F.lit(","), F.concat_ws(",", "i", "v", "a")), F.lit("")), F.lit("}"))
    body = F.regexp_replace(body, ",}$", "}")
    rows = b.withColumns({"c": common, "i": image, "v": video, "a": audio})
    return rows.select("repo", "rel_path", "version", F.when(F.expr("doc_id % 97 <> 5"), body).alias("body"))


query(
    "migrated_entries",
    f""", e AS (SELECT * REPLACE ({_NAME} AS rel_path, {_MIMES} AS mime), ((doc_id * 7) % 12)::INT AS version FROM base),
    g AS (SELECT *, CASE WHEN version NOT BETWEEN 1 AND 10 THEN 'version ' || version WHEN doc_id % 97 = 5 THEN 'no entry' END AS error,
        array_to_string(list_transform(range(8), lambda k: ('0x' || substr(hash, 8 * k + 1, 8))::BIGINT), ',') AS words FROM e)
    SELECT repo, rel_path, version, error, CASE WHEN error IS NULL THEN size END AS size, CASE WHEN error IS NULL THEN hash END AS hash, CASE WHEN error IS NULL THEN modified_ms END AS modified_ms,
        CASE WHEN error IS NULL THEN missing END AS missing, CASE WHEN error IS NULL THEN mime END AS mime, CASE WHEN error IS NULL AND doc_id % 8 IN (3, 4, 5) THEN sha256(hash) END AS text_hash,
        CASE WHEN error IS NULL THEN img_w END AS img_w, CASE WHEN error IS NULL THEN img_h END AS img_h, CASE WHEN error IS NULL AND doc_id % 8 = 2 THEN size * 10 END AS duration_ms,
        CASE WHEN error IS NULL AND doc_id % 8 = 0 AND version >= 2 THEN words END AS img_words, CASE WHEN error IS NULL AND version >= 3 THEN origin END AS origin,
        CASE WHEN error IS NULL AND version >= 4 THEN taken_ms END AS taken_ms, CASE WHEN error IS NULL AND version >= 4 THEN camera END AS camera,
        CASE WHEN error IS NULL AND doc_id % 8 IN (1, 6) AND version >= 8 THEN words || ',' || words || ',' || words END AS frame_words,
        CASE WHEN error IS NULL AND doc_id % 8 = 2 THEN CASE WHEN version >= 10 THEN words ELSE '' END END AS audio_words,
        CASE WHEN error IS NULL THEN coalesce(CASE WHEN doc_id % 8 = 0 THEN version < 4 WHEN doc_id % 8 = 2 THEN version < 10 WHEN doc_id % 8 = 3 THEN version < 5 WHEN doc_id % 8 = 4 THEN version < 6
            WHEN doc_id % 8 = 5 THEN version < 7 WHEN doc_id % 16 = 1 THEN version < 9 WHEN doc_id % 8 IN (1, 6) THEN version < 8 END, false) END AS stale
    FROM g""",
)(
    lambda spark, d: records.migrated(_records(spark, d)).withColumns(
        {"img_words": F.array_join("img_words", ","), "audio_words": F.array_join("audio_words", ","), "frame_words": F.array_join(F.flatten("frame_words"), ",")}
    )
)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen documents each as an archive (path, content): zip files, and tar.gz files."""

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        number, blob, rows = key[0].as_py(), io.BytesIO(), group.sort_by("doc_id").to_pylist()
        if number % 2:
            with tarfile.open(fileobj=blob, mode="w:gz") as t:
                for r in rows:
                    data = r["text"].encode()
                    info = tarfile.TarInfo(r["rel_path"])
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        else:
            with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("folder/", "")
                for r in rows:
                    z.writestr(zipfile.ZipInfo(r["rel_path"]), r["text"], zipfile.ZIP_DEFLATED)
        return pa.table({"path": [f"backup_{number}" + (".tar.gz" if number % 2 else ".zip")], "content": pa.array([blob.getvalue()], pa.binary())})

    docs = source.base(spark, d).select("doc_id", F.concat_ws("/", "doc_id", "rel_path").alias("rel_path"), F.coalesce("content", F.lit("")).alias("text"), F.expr("doc_id div 16").alias("archive"))
    return docs.groupBy("archive").applyInArrow(pack, "path string, content binary")


#: Limits that some of the archives meet.
_MOST, _BYTES = 12, 40_000
query(
    "archive_listings",
    f""", m AS (SELECT doc_id // 16 AS a, doc_id, doc_id || '/' || rel_path AS rel_path, size, hash, row_number() OVER w AS n, sum(size) OVER w AS used FROM base WINDOW w AS (PARTITION BY doc_id // 16 ORDER BY doc_id)),
    ends AS (SELECT a, min(n) FILTER (used > {_BYTES}) AS over_at, count(*) AS n FROM m GROUP BY a),
    listed AS (SELECT m.*, 'backup_' || a || CASE WHEN a % 2 = 1 THEN '.tar.gz' ELSE '.zip' END AS path FROM m WHERE n <= {_MOST} AND used <= {_BYTES})
    SELECT path, n - 1 AS member_ord, rel_path AS member_name, size, hash, false AS locked, NULL AS capped, false AS last FROM listed
    UNION ALL SELECT 'backup_' || a || CASE WHEN a % 2 = 1 THEN '.tar.gz' ELSE '.zip' END, (SELECT count(*) FROM listed WHERE listed.a = ends.a), NULL, (SELECT coalesce(sum(size), 0)::BIGINT FROM listed WHERE listed.a = ends.a), NULL, NULL,
        CASE WHEN over_at <= {_MOST} THEN 'unpacked' WHEN n > {_MOST} THEN 'members' END, true FROM ends""",
)(lambda spark, d: archives.listings(_packed(spark, d), _MOST, 0, _BYTES))


@query("event_log", "SELECT event_id % 2 AS batch, event_type, count(*) AS lines, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL".replace("SELECT", "WITH e AS (SELECT 1) SELECT", 1))
def _logged(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of events in a log, the first of which came twice."""
    folder, events = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}", source.table(spark, d, "events").select("event_id", "event_type")
    for number in (0, 1, 0):
        updates.append_batch(events.where(F.col("event_id") % 2 == number), number, folder)
    return updates.read_log(spark, folder).groupBy(F.col("batch").cast("long").alias("batch"), "event_type").agg(F.count("*").alias("lines"), F.sum("event_id").alias("ids"))


# Archives that hold what is to go, sinks that would lose all, a registry of folders
query("marked_but_archived", "SELECT size, hash, count(*) AS copies FROM live WHERE (size, hash) IN (SELECT (size, hash) FROM members WHERE hash IS NOT NULL) GROUP BY size, hash HAVING bool_and(doc_id % 3 = 0)")(
    lambda spark, d: duplicates.survive_only_in_archives(source.files(spark, d), live(source.files(spark, d)).where("doc_id % 3 = 0"), source.archive_members(spark, d))
)


def _wholesale(spark: SparkSession, d: str) -> DataFrame:
    """A mirror of r3 that holds nothing of it, beside one that holds some."""
    files = source.files(spark, d)
    kept = live(files).where("repo = 'r3'").select("size", "hash")
    mirror = files.where("repo = 'm0'").join(kept, ["size", "hash"], "left_anti").select(*files.columns)
    groups = spark.createDataFrame([("g", "r3", [("m0", "Mirror"), ("r1", "Mirror")])], "name string, main string, sinks array<struct<repo: string, mode: string>>")
    return sync.wholesale(files.where("repo <> 'm0'").unionByName(mirror), groups)


query("wholesale_mirrors", "SELECT 'g' AS name, 'm0' AS sink, count(*) AS deletes, count(*) AS live_files FROM live WHERE repo = 'm0' AND (size, hash) NOT IN (SELECT (size, hash) FROM live WHERE repo = 'r3')")(_wholesale)


def _folders(spark: SparkSession, d: str) -> DataFrame:
    """A repository for each source of documents, last scanned when its newest file was written."""
    rows = source.table(spark, d, "documents").selectExpr("source AS repo", "concat('/vol/', source) AS abs_path", "1514764800000 + ((doc_id * 7919) % 2500) * 86400000 AS ms")
    return rows.groupBy("repo", "abs_path").agg((F.count("*") % 2 == 0).alias("remote"), F.max("ms").alias("last_scan_ms"))


def _edited_folders(spark: SparkSession, d: str) -> DataFrame:
    repos = _folders(spark, d)
    first, last = repos.agg(F.min("repo"), F.max("repo")).first()
    groups = spark.createDataFrame([], "name string, main string, sinks array<struct<repo: string, mode: string>>")
    repos = registry.relocate_repo(registry.create_repo(repos, "newer", "/vol/e"), first, "/mnt/moved", True)
    return registry.rename_repo(repos, groups, last, "renamed")


_FOLDERS = "WITH r AS (SELECT source AS repo, '/vol/' || source AS abs_path, count(*) % 2 = 0 AS remote, max(1514764800000 + ((doc_id * 7919) % 2500) * 86400000) AS last_scan_ms FROM documents GROUP BY source)"
query(
    "registry_of_folders",
    _FOLDERS + """ SELECT CASE WHEN repo = (SELECT max(repo) FROM r) THEN 'renamed' ELSE repo END AS repo, CASE WHEN repo = (SELECT min(repo) FROM r) THEN '/mnt/moved' ELSE abs_path END AS abs_path,
    remote OR repo = (SELECT min(repo) FROM r) AS remote, last_scan_ms FROM r UNION ALL SELECT 'newer', '/vol/e', false, 0""",
)(_edited_folders)
query(
    "folder_ages",
    _FOLDERS + """, a AS (SELECT repo, ((SELECT max(last_scan_ms) FROM r) + 7200000 * (1 + length(repo)) - last_scan_ms) // 1000 AS s FROM r)
    SELECT repo, CASE WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END END AS age FROM a""",
)(
    lambda spark, d: _folders(spark, d).join(F.broadcast(_folders(spark, d).agg(F.max("last_scan_ms").alias("latest"))))  # one row
    .select("repo", scalars.age_in_words(F.col("last_scan_ms"), F.col("latest") + 7200000 * (1 + F.length("repo"))).alias("age"))
)
