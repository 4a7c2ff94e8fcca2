"""Queries over names that files are to get: exports and moves that never overwrite; and the SQL that goes file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.operators import compare, edits, organise, views
from twinspark.operators.duplicates import KEY, live
from twinspark.plans.queries import _CLASSIFY, query
from twinspark.plans.reviews import _SCAN, _flags
from twinspark.sources import catalogue as source


def _one_by_one(files: str, held: str, same_in_run: bool, stem: str, rest: str) -> str:
    """SQL for the sequential rule: `files` (i from 1, wish, c) in order take names that `held` (path, c) and those before leave free."""
    return f"""o AS (SELECT *, {stem} AS stem, {rest} AS rest FROM ({files})),
    r AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS path, true AS skip, (SELECT coalesce(list(path ORDER BY path), []) FROM ({held}) h) AS paths, (SELECT coalesce(list(c ORDER BY path), []) FROM ({held}) h) AS cs
        UNION ALL SELECT i, CASE WHEN there_at IS NULL THEN pick END, there_at IS NOT NULL, CASE WHEN there_at IS NULL THEN list_append(paths, pick) ELSE paths END, CASE WHEN there_at IS NULL THEN list_append(cs, {"c" if same_in_run else "NULL"}) ELSE cs END
        FROM (SELECT *, list_position(paths, pick) AS there_at FROM (
            SELECT o.i, o.c, r.paths, r.cs, list_filter(list_transform(range(1, 120), lambda n: CASE WHEN n = 1 THEN wish ELSE stem || ' (' || n || ')' || rest END), lambda p: list_position(r.paths, p) IS NULL OR coalesce(r.cs[list_position(r.paths, p)] = o.c, false))[1] AS pick
            FROM r JOIN o ON o.i = r.i + 1)))"""


_NAMED = """, w AS (SELECT repo, repo_ord, rel_path, doc_id, size, hash, strftime(make_timestamp(best_ms * 1000), '%Y/%m/') || 'img_' || (doc_id % 3) || CASE doc_id % 5 WHEN 1 THEN ' (2)' WHEN 2 THEN ' (3)' WHEN 3 THEN ' (2) (2)' ELSE '' END || '.jpg' AS wish FROM best),
    there AS (SELECT wish AS path, min(size || hash) AS c FROM w WHERE repo = 'r3' GROUP BY wish),
    f AS (SELECT row_number() OVER (ORDER BY repo_ord, rel_path) AS i, repo, rel_path, wish, size || hash AS c FROM w WHERE repo <> 'r3'), """


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Live files under names of few stems, many of them numbered."""
    name = F.expr("concat('img_', doc_id % 3, CASE doc_id % 5 WHEN 1 THEN ' (2)' WHEN 2 THEN ' (3)' WHEN 3 THEN ' (2) (2)' ELSE '' END, '.jpg')")
    return live(source.files(spark, d)).withColumn("named", F.concat("rel_path", F.lit("/"), name))


def _there(files: DataFrame) -> DataFrame:
    """What an earlier export of r3 left: one content under each name."""
    best = views.utc_date(F.coalesce("taken_ms", "modified_ms"))
    path = F.concat(F.date_format(best, "yyyy/MM/"), F.element_at(F.split("named", "/"), -1))
    return files.where("repo = 'r3'").groupBy(path.alias("path")).agg(F.min_by(F.struct(*KEY), F.concat(F.col("size").cast("string"), "hash")).alias("k")).select("path", "k.*")


query(
    "export_numbered_names",
    "WITH RECURSIVE {files} " + _NAMED + _one_by_one("SELECT * FROM f", "SELECT * FROM there", True, r"regexp_replace(wish, '\.[^./]*$', '')", r"regexp_extract(wish, '(\.[^./]*)$', 1)") + """
    SELECT repo, rel_path, CASE WHEN skip THEN 'skip' ELSE 'copy' END AS action, path FROM f JOIN r USING (i)""",
)(lambda spark, d: _exported(_named(spark, d)))


def _exported(files: DataFrame) -> DataFrame:
    own = files.select("repo", "repo_ord", "named", F.col("rel_path").alias("own"))
    out = views.exported_by_date(files.where("repo <> 'r3'").withColumn("rel_path", F.col("named")), _there(files))
    return out.withColumnRenamed("rel_path", "named").join(own, ["repo", "named"]).select("repo", F.col("own").alias("rel_path"), "action", "path")


#: All live files of a repository into one folder for each language, numbered names among them.
FLAT = [("name:*1.*", "flat/{mimetop}/{o-stem} (2).{o-ext}"), ("size:>0", "flat/{mimetop}/doc_2.{o-ext}")]
query(
    "organize_moves",
    "WITH RECURSIVE {files} " + r""", n AS (SELECT repo, rel_path, size || hash AS c, string_split(rel_path, '/')[-1] AS name, coalesce(string_split(mime, '/')[1], '') AS top FROM live WHERE size > 0),
    p AS (SELECT *, regexp_replace('flat/' || top || '/', '//', '/') || CASE WHEN regexp_matches(name, '1\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') || ' (2).' ELSE 'doc_2.' END || regexp_extract(name, '\.([^.]*)$', 1) AS target FROM n),
    f AS (SELECT row_number() OVER (ORDER BY repo, rel_path) AS i, *, repo || '/' || target AS wish FROM p WHERE target <> rel_path), """
    + _one_by_one("SELECT * FROM f", "SELECT repo || '/' || rel_path AS path, size || hash AS c FROM live", False, r"regexp_replace(wish, '\.[^./]*$', '')", r"regexp_extract(wish, '(\.[^./]+)$', 1)")
    + " SELECT repo, rel_path, target, substr(path, length(repo) + 2) AS final FROM f JOIN r USING (i)",
)(lambda spark, d: organise.with_suffixes(organise.plan(source.files(spark, d), FLAT), source.files(spark, d)).select("repo", "rel_path", "target", "final"))


# Edits of single files
_REQUESTS = """, fr AS (SELECT min(rel_path) AS other FROM live WHERE repo = 'r1'),
    q AS (SELECT doc_id AS n, CASE doc_id % 5 WHEN 0 THEN 'rename' WHEN 1 THEN 'copy' WHEN 2 THEN 'overwrite' WHEN 3 THEN 'delete' ELSE CASE WHEN doc_id % 7 = 0 THEN 'shred' ELSE 'copy' END END AS op, 'r0' AS from_repo,
        CASE doc_id % 13 WHEN 0 THEN '../' || rel_path WHEN 1 THEN rel_path || '.none' ELSE rel_path END AS from_rel, 'r1' AS to_repo,
        CASE doc_id % 11 WHEN 0 THEN rel_path WHEN 1 THEN other WHEN 2 THEN ' ' WHEN 3 THEN 'many/' || doc_id % 4 ELSE 'new/' || doc_id END AS to_rel FROM files, fr WHERE repo = 'r0' AND doc_id % 2 = 0),
    a AS (SELECT n, op, from_repo, from_rel, CASE op WHEN 'rename' THEN from_repo WHEN 'delete' THEN NULL ELSE to_repo END AS to_repo, CASE WHEN op <> 'delete' THEN to_rel END AS to_rel FROM q),
    s1 AS (SELECT a.*, f.missing AS gone, t.rel_path IS NOT NULL AS taken, coalesce(a.from_repo = a.to_repo AND a.from_rel = a.to_rel, false) AS one FROM a LEFT JOIN files f ON f.repo = a.from_repo AND f.rel_path = a.from_rel LEFT JOIN live t ON t.repo = a.to_repo AND t.rel_path = a.to_rel),
    s2 AS (SELECT *, CASE WHEN op NOT IN ('rename', 'copy', 'overwrite', 'delete') THEN 'unknown_op' WHEN op = 'rename' AND one THEN 'same' WHEN from_rel LIKE '../%' OR (op <> 'delete' AND trim(to_rel) = '') THEN 'invalid_path' WHEN one THEN 'same'
        WHEN gone IS NULL OR (gone AND op <> 'delete') THEN 'no_such_file' WHEN op IN ('rename', 'copy') AND taken THEN 'already_exists' ELSE 'done' END AS o FROM s1),
    tt AS (SELECT n, from_repo AS repo, from_rel AS path, op IN ('rename', 'delete') AS writes FROM s2 WHERE o = 'done' UNION ALL SELECT n, to_repo, to_rel, true FROM s2 WHERE o = 'done' AND to_rel IS NOT NULL),
    late AS (SELECT DISTINCT n FROM (SELECT n, writes, min(n) OVER w AS first, min(n) FILTER (writes) OVER w AS first_write FROM tt WINDOW w AS (PARTITION BY repo, path)) WHERE n > CASE WHEN writes THEN first ELSE first_write END AND first_write IS NOT NULL),
    res AS (SELECT n, op, from_repo, from_rel, to_repo, to_rel, CASE WHEN n IN (SELECT n FROM late) THEN 'conflict' ELSE o END AS outcome FROM s2) """


def _requests(spark: SparkSession, d: str) -> DataFrame:
    files = source.files(spark, d)
    some = F.broadcast(live(files).where("repo = 'r1'").agg(F.min("rel_path").alias("other")))  # one row
    return files.where("repo = 'r0' AND doc_id % 2 = 0").join(some).selectExpr(
        "doc_id AS n", "CASE doc_id % 5 WHEN 0 THEN 'rename' WHEN 1 THEN 'copy' WHEN 2 THEN 'overwrite' WHEN 3 THEN 'delete' ELSE CASE WHEN doc_id % 7 = 0 THEN 'shred' ELSE 'copy' END END AS op", "'r0' AS from_repo",
        "CASE doc_id % 13 WHEN 0 THEN '../' || rel_path WHEN 1 THEN rel_path || '.none' ELSE rel_path END AS from_rel", "'r1' AS to_repo",
        "CASE doc_id % 11 WHEN 0 THEN rel_path WHEN 1 THEN other WHEN 2 THEN ' ' WHEN 3 THEN 'many/' || CAST(doc_id % 4 AS STRING) ELSE 'new/' || CAST(doc_id AS STRING) END AS to_rel",
    )


query("edit_outcomes", _REQUESTS + "SELECT * FROM res")(lambda spark, d: edits.outcomes(source.files(spark, d), _requests(spark, d)))
query(
    "edited_catalogue",
    _REQUESTS
    + """, dn AS (SELECT * FROM res WHERE outcome = 'done')
    SELECT repo, repo_ord, rel_path, size, hash, missing OR (repo, rel_path) IN (SELECT (from_repo, from_rel) FROM dn WHERE op = 'delete') AS missing, origin FROM files
    WHERE (repo, rel_path) NOT IN (SELECT (from_repo, from_rel) FROM dn WHERE op = 'rename') AND (repo, rel_path) NOT IN (SELECT (to_repo, to_rel) FROM dn WHERE op <> 'delete')
    UNION ALL SELECT to_repo, CASE to_repo WHEN 'r0' THEN 0 ELSE 1 END, to_rel, size, hash, missing, CASE WHEN op = 'rename' THEN origin ELSE from_repo END FROM dn JOIN files ON repo = from_repo AND rel_path = from_rel WHERE op <> 'delete'""",
)(lambda spark, d: edits.edited(source.files(spark, d), _requests(spark, d)).select("repo", "repo_ord", "rel_path", "size", "hash", "missing", "origin"))

# Totals of previews, and what is flagged
query(
    "transfer_totals",
    "WITH {files}, k AS (" + _CLASSIFY.format(refs="('m0')").replace(", ref AS", "WITH ref AS", 1) + """), c AS (SELECT count(*) FILTER (relation = 'New') AS copies, coalesce(sum(size) FILTER (relation = 'New'), 0)::BIGINT AS copy_bytes,
    count(*) FILTER (relation = 'Equal') AS unchanged, count(*) FILTER (relation = 'DeletedInReference') AS skipped FROM k)
    SELECT 'copy' AS what, copies, copy_bytes, 0::BIGINT AS deletes, unchanged, skipped FROM c UNION ALL SELECT 'move', copies, copy_bytes, copies, unchanged, skipped FROM c""",
)(lambda spark, d: _transfers(compare.classified(compare.of(source.files(spark, d), "r0"), compare.of(source.files(spark, d), "m0"))))


def _transfers(classified: DataFrame) -> DataFrame:
    return views.transfer_totals(classified).select(F.lit("copy").alias("what"), "*").unionByName(views.transfer_totals(classified, move=True).select(F.lit("move").alias("what"), "*"))


#: The categories of flagged files, in the order of a report.
CATEGORIES = ("Wallet", "Key", "Vault", "Identity", "Financial")
query("report_flags", _SCAN + "SELECT repo, " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c.lower()}" for c in CATEGORIES) + " FROM flags GROUP BY repo")(
    lambda spark, d: _flags(spark, d).groupBy("repo").agg(*(F.count_if(F.col("category") == c).alias(c.lower()) for c in CATEGORIES))
)
