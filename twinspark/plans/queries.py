"""The registered queries over the derived catalogue, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.functions import filters, scalars
from twinspark.operators import align, archives, catalogue, compare, duplicates, organise, similar, sync
from twinspark.operators.duplicates import KEY, live
from twinspark.sources import catalogue as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The derived catalogue in SQL, the same as sources/catalogue.py.
_FILES = """
b AS (SELECT *, CAST(substr(source, 4) AS INTEGER) AS s, doc_id // 20 AS k FROM documents),
base AS (
 SELECT doc_id, 'r' || (s % 4) AS repo, s % 4 AS repo_ord,
  lang || '/' || (s // 4) || '/doc_' || k || '.' || (CASE k % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'csv' WHEN 3 THEN 'eml' ELSE 'bin' END) AS rel_path,
  strlen(text) AS size, sha256(text) AS hash,
  1514764800000 + ((doc_id * 7919) % 2500) * 86400000 + doc_id * 1000 AS modified_ms,
  doc_id % 11 = 3 AS missing,
  CASE k % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/csv' WHEN 3 THEN 'message/rfc822' END AS mime,
  CASE WHEN doc_id % 6 = 0 THEN 'r' || ((s + 1) % 4) END AS origin,
  CASE WHEN doc_id % 3 <> 0 THEN 640 + (doc_id % 5) * 160 END AS img_w,
  CASE WHEN doc_id % 3 <> 0 THEN 480 + (doc_id % 7) * 120 END AS img_h,
  CASE WHEN doc_id % 4 = 1 THEN 1388534400000 + ((doc_id * 104729) % 4000) * 86400000 END AS taken_ms,
  CASE WHEN doc_id % 4 IN (1, 2) THEN 'Cam ' || (doc_id % 3) END AS camera, text
 FROM b),
mirror AS (
 SELECT doc_id, 'm0' AS repo, 4 AS repo_ord, CASE WHEN doc_id % 13 = 1 THEN 'moved/' ELSE '' END || rel_path AS rel_path,
  size + (doc_id % 17 = 2)::INT AS size, CASE WHEN doc_id % 17 = 2 THEN sha256(text || 'x') ELSE hash END AS hash,
  modified_ms + CASE WHEN doc_id % 17 = 2 THEN 86400000 ELSE 0 END AS modified_ms,
  doc_id % 9 = 4 AS missing, mime, 'r0' AS origin, img_w, img_h, taken_ms, camera
 FROM base WHERE repo = 'r0' AND doc_id % 7 <> 0),
files AS (SELECT * EXCLUDE (text) FROM base UNION ALL SELECT * FROM mirror),
live AS (SELECT * FROM files WHERE NOT missing),
annotations AS (SELECT repo, rel_path, list_filter([CASE WHEN quality = 1 THEN 'keep' ELSE 'review' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda t: t IS NOT NULL) AS tags
 FROM files JOIN labels USING (doc_id) WHERE repo <> 'm0'),
accepted AS (SELECT DISTINCT repo, size, hash FROM files JOIN labels USING (doc_id) WHERE repo <> 'm0' AND doc_id % 5 = 0 AND quality = 1 AND toxic = 0),
members AS (SELECT 'arch' AS repo, 'backup_' || (doc_id // 16) || '.zip' AS archive_rel, doc_id % 16 AS member_ord, rel_path AS member_name, size, CASE WHEN doc_id % 29 <> 0 THEN hash END AS hash, doc_id % 29 = 0 AS locked FROM base),
snap AS (
 SELECT repo, rel_path, size, modified_ms + CASE WHEN doc_id % 8 = 5 THEN 1 ELSE 0 END AS modified_ms FROM live WHERE doc_id % 10 <> 7
 UNION ALL SELECT repo, 'new/' || rel_path, size, modified_ms FROM live WHERE doc_id % 14 = 9),
dupes AS (SELECT size, hash, count(*) AS copies, (count(*) - 1) * size AS wasted FROM live GROUP BY size, hash HAVING count(*) > 1),
ranked AS (
 SELECT live.*, accepted.hash IS NOT NULL AS is_accepted, row_number() OVER (PARTITION BY size, hash ORDER BY coalesce(img_w * img_h, -1) DESC, (taken_ms IS NOT NULL OR camera IS NOT NULL) DESC,
  taken_ms ASC NULLS LAST, size DESC, modified_ms, lower(rel_path), repo_ord, rel_path) AS rank,
  row_number() OVER (PARTITION BY size, hash ORDER BY (accepted.hash IS NOT NULL) DESC, coalesce(img_w * img_h, -1) DESC, (taken_ms IS NOT NULL OR camera IS NOT NULL) DESC,
  taken_ms ASC NULLS LAST, size DESC, modified_ms, lower(rel_path), repo_ord, rel_path) AS safe_rank
 FROM live JOIN dupes USING (size, hash) LEFT JOIN accepted USING (repo, size, hash)),
best AS (SELECT *, coalesce(taken_ms, modified_ms) AS best_ms FROM live),
r0 AS (SELECT * FROM files WHERE repo = 'r0'), m0 AS (SELECT * FROM files WHERE repo = 'm0')
"""


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.replace("{files}", _FILES) if sql.lstrip().startswith("WITH") else f"WITH {_FILES} {sql}"
        return f

    return register


def _only(f: Callable[[DataFrame], DataFrame]):
    return lambda spark, d: f(source.files(spark, d))


def _accepting(f: Callable[[DataFrame, DataFrame], DataFrame]):
    return lambda spark, d: f(source.files(spark, d), source.accepted(spark, d))


# Duplicates
query("exact_duplicate_groups", "SELECT size, hash, copies, wasted FROM dupes ORDER BY wasted DESC, size DESC, hash")(
    _only(lambda f: duplicates.group_keys(f).orderBy(F.desc("wasted"), F.desc("size"), "hash"))
)
query("duplicate_members_ranked", "SELECT repo, rel_path, size, hash, rank FROM ranked")(_only(lambda f: duplicates.ranked(f).select("repo", "rel_path", *KEY, "rank")))
query("duplicates_protected_first", "SELECT repo, rel_path, size, hash, safe_rank AS rank, is_accepted AS protected FROM ranked")(
    _accepting(lambda f, a: duplicates.ranked(duplicates.with_accepted(f, a), F.col("is_accepted")).select("repo", "rel_path", *KEY, "rank", "protected"))
)
query("duplicates_to_delete", "SELECT repo, rel_path, size, hash FROM ranked WHERE safe_rank > 1 AND NOT is_accepted")(_accepting(lambda f, a: duplicates.to_delete(f, a).select("repo", "rel_path", *KEY)))
query("similar_wasted_bytes", "SELECT size, hash, sum(size) FILTER (rank > 1)::BIGINT AS wasted FROM ranked GROUP BY size, hash")(
    _only(lambda f: duplicates.ranked(f).groupBy(*KEY).agg(F.sum(F.when(F.col("rank") > 1, F.col("size"))).alias("wasted")))
)
query("duplicate_groups_filtered_any_member", "SELECT * FROM dupes WHERE (size, hash) IN (SELECT (size, hash) FROM live WHERE rel_path LIKE 'en/%doc_1%')")(
    _only(lambda f: duplicates.groups_with_any(f, filters.matching(f, "name:en/*doc_1*")))
)
query("fully_accepted_groups", "SELECT size, hash, count(*) AS copies FROM ranked GROUP BY size, hash HAVING bool_and(is_accepted)")(_accepting(duplicates.fully_accepted))
query("per_repo_duplicate_paths", "SELECT repo, size, hash, string_agg(rel_path, '|' ORDER BY rel_path) AS paths FROM live GROUP BY repo, size, hash HAVING count(*) > 1")(_only(duplicates.paths_by_repo))
query("dupe_page", "SELECT * FROM dupes ORDER BY wasted DESC, size DESC, hash LIMIT 50 OFFSET 50")(_only(lambda f: duplicates.page(f, 1)))
query(
    "archive_only_survivors",
    """, gone AS (SELECT size, hash, count(*) AS marked FROM ranked WHERE safe_rank > 1 AND NOT is_accepted GROUP BY size, hash)
    SELECT size, hash, copies FROM (SELECT size, hash, count(*) AS copies FROM live GROUP BY size, hash) JOIN gone USING (size, hash)
    WHERE marked = copies AND (size, hash) IN (SELECT (size, hash) FROM members WHERE hash IS NOT NULL)""",
)(lambda spark, d: duplicates.only_in_archives(source.files(spark, d), source.accepted(spark, d), source.archive_members(spark, d)))

# The catalogue
query("repo_stats", "SELECT repo, count(*) FILTER (NOT missing) AS files, coalesce(sum(size) FILTER (NOT missing), 0)::BIGINT AS bytes, count(*) FILTER (missing) AS missing_files FROM files GROUP BY repo")(_only(catalogue.stats))
query("mime_histogram", "SELECT repo, mime, count(*) AS files FROM live WHERE mime IS NOT NULL GROUP BY repo, mime")(_only(catalogue.mime_histogram))
query("top_mimes", "SELECT repo, mime, files FROM (SELECT repo, mime, count(*) AS files, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, mime) AS r FROM live WHERE mime IS NOT NULL GROUP BY repo, mime) WHERE r <= 8")(
    lambda spark, d: catalogue.mime_histogram(source.files(spark, d)).withColumn("r", F.expr("row_number() OVER (PARTITION BY repo ORDER BY files DESC, mime)")).where("r <= 8").drop("r")
)
query(
    "mime_share",
    """SELECT repo, mime, files, greatest(round(files * 100.0 / sum(files) OVER (PARTITION BY repo), 0)::BIGINT, 1) AS percent
    FROM (SELECT repo, mime, count(*) AS files FROM live WHERE mime IS NOT NULL GROUP BY repo, mime)""",
)(_only(catalogue.mime_share))
query("registry_totals", "SELECT count(DISTINCT repo) AS repos, count(*) FILTER (NOT missing) AS files, sum(size) FILTER (NOT missing)::BIGINT AS bytes FROM files")(
    _only(lambda f: catalogue.stats(f).agg(F.count("*").alias("repos"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")))
)
query("content_state_index", "SELECT size, hash, bool_or(NOT missing) AS present, bool_or(missing) AS tombstone FROM files GROUP BY size, hash")(_only(compare.content_index))
query("tombstoned_contents", "SELECT size, hash FROM files GROUP BY size, hash HAVING bool_and(missing)")(_only(lambda f: compare.tombstoned(f).select(*KEY)))
query("content_lookup", "SELECT repo, rel_path FROM live WHERE (size, hash) = (SELECT (size, hash) FROM files WHERE doc_id = 1 AND repo <> 'm0')")(
    lambda spark, d: live(source.files(spark, d)).join(source.files(spark, d).where("doc_id = 1 AND repo <> 'm0'").select(*KEY), KEY, "left_semi").select("repo", "rel_path")
)
query("point_lookup", "SELECT repo, rel_path, size, hash, missing FROM files WHERE repo = 'r1' AND rel_path LIKE '%/doc_3.eml'")(
    _only(lambda f: f.where("repo = 'r1' AND rel_path LIKE '%/doc_3.eml'").select("repo", "rel_path", *KEY, "missing"))
)
query("accepted_paths", "SELECT repo, rel_path, size, hash FROM live WHERE (repo, size, hash) IN (SELECT (repo, size, hash) FROM accepted)")(_accepting(lambda f, a: catalogue.accepted_paths(f, a).select("repo", "rel_path", *KEY)))
query("annotations_all", "SELECT repo, rel_path, array_to_string(tags, '|') AS tags FROM annotations")(lambda spark, d: source.annotations(spark, d).select("repo", "rel_path", F.array_join("tags", "|").alias("tags")))
query("clone_stats", "SELECT repo, count(*) AS rows FROM (SELECT repo FROM files UNION ALL SELECT 'copy' FROM files WHERE repo = 'r1') GROUP BY repo")(
    _only(lambda f: catalogue.clone(f, "r1", "copy").groupBy("repo").agg(F.count("*").alias("rows")))
)
query("pruned_rows", "SELECT repo, count(*) AS rows FROM live GROUP BY repo")(_only(lambda f: catalogue.prune(f).groupBy("repo").agg(F.count("*").alias("rows"))))
_CHANGES = """, ch AS (SELECT coalesce(s.repo, f.repo) AS repo, coalesce(s.rel_path, f.rel_path) AS rel_path, coalesce(s.size, f.size) AS size,
    CASE WHEN s.size IS NULL THEN CASE WHEN f.missing THEN 'known_missing' ELSE 'vanished' END WHEN f.size IS NULL THEN 'added' WHEN f.missing THEN 'updated'
         WHEN s.size = f.size AND s.modified_ms = f.modified_ms THEN 'unchanged' ELSE 'updated' END AS status
    FROM snap s FULL JOIN files f ON s.repo = f.repo AND s.rel_path = f.rel_path) """
query("change_detection", _CHANGES + "SELECT * FROM ch")(lambda spark, d: catalogue.changes(source.files(spark, d), source.snapshot(spark, d)))
query(
    "update_stats",
    _CHANGES
    + """SELECT repo, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'unchanged') AS unchanged,
    count(*) FILTER (status = 'vanished') AS marked_missing, coalesce(sum(size) FILTER (status IN ('added', 'updated')), 0)::BIGINT AS hashed_bytes FROM ch GROUP BY repo""",
)(lambda spark, d: catalogue.change_counts(source.files(spark, d), source.snapshot(spark, d)))
query(
    "stale_entries",
    """SELECT repo, rel_path FROM files WHERE coalesce(CASE WHEN mime LIKE 'image/%' THEN doc_id % 11 < 4 WHEN mime LIKE 'audio/%' THEN doc_id % 11 < 10
    WHEN mime LIKE 'text/%' THEN doc_id % 11 < 6 WHEN mime = 'message/rfc822' THEN doc_id % 11 < 7 WHEN mime LIKE 'video/%' THEN doc_id % 11 < 8 END, false)""",
)(_only(lambda f: f.where(catalogue.is_stale(F.col("mime"), F.expr("doc_id % 11"))).select("repo", "rel_path")))
query("purge_preview", ", m AS (SELECT repo, rel_path, size FROM live WHERE mime LIKE '%csv%') SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY repo, rel_path LIMIT 25")(
    _only(lambda f: catalogue.preview(filters.matching(f, "mime:csv"), 25))
)
query("prune_preview", ", m AS (SELECT repo, rel_path, size FROM files WHERE missing) SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY repo, rel_path LIMIT 25")(_only(lambda f: catalogue.preview(f.where("missing"), 25)))
query(
    "empty_dirs",
    """, p AS (SELECT repo, missing, string_split(rel_path, '/') AS parts FROM files), d AS (SELECT repo, missing, unnest([array_to_string(parts[1:k], '/') FOR k IN range(1, len(parts))]) AS dir FROM p)
    SELECT repo, dir, len(string_split(dir, '/')) AS depth FROM d GROUP BY repo, dir HAVING bool_and(missing)""",
)(_only(lambda f: catalogue.empty_directories(f, catalogue.parents(f))))
query(
    "browse_listing",
    """, x AS (SELECT substr(rel_path, 4) AS rest, size FROM live WHERE repo = 'r0' AND starts_with(rel_path, 'en/'))
    SELECT split_part(rest, '/', 1) AS name, contains(rest, '/') AS is_dir, count(*) AS files, sum(size)::BIGINT AS bytes FROM x GROUP BY ALL""",
)(_only(lambda f: catalogue.listing(f, "r0", "en/")))
query("browse_flat", "SELECT rel_path, size FROM live WHERE repo = 'r0' AND starts_with(rel_path, 'en/')")(_only(lambda f: catalogue.flat_listing(f, "r0", "en/")))
query("board_sorted", "SELECT rel_path, size FROM live WHERE repo = 'r2' ORDER BY size DESC, lower(rel_path) DESC LIMIT 100")(
    _only(lambda f: live(f).where("repo = 'r2'").select("rel_path", "size").orderBy(F.desc("size"), F.desc(F.lower("rel_path"))).limit(100))
)
query("representations", "SELECT repo, rel_path, CASE WHEN mime LIKE 'text/%' OR mime = 'message/rfc822' THEN 'text' WHEN mime IS NULL THEN '' END AS views FROM live")(
    _only(lambda f: live(f).select("repo", "rel_path", catalogue.representations(F.col("mime")).alias("views")))
)

# Filters
_FILTERS = {
    "filter_mime": ("mime:text/", "mime LIKE '%text/%'"),
    "filter_not_mime_null_safe": ("!mime:text", "coalesce(mime NOT LIKE '%text%', true)"),
    "filter_name_glob": ("name:*/1/doc_*2.*", "rel_path LIKE '%/1/doc\\_%2.%' ESCAPE '\\'"),
    "filter_name_ci": ("name:EN/ case:insensitive", "lower(rel_path) LIKE '%en/%'"),
    "filter_size": ("size:>=2000 size:<5000", "size >= 2000 AND size < 5000"),
    "filter_date_span": ("date:2019-03", "best_ms >= 1551398400000 AND best_ms < 1554076800000"),
    "filter_after_before": ("after:2016 before:2018-02-10", "best_ms >= 1451606400000 AND best_ms < 1518220800000"),
    "filter_origin": ("origin:r1", "coalesce(origin LIKE '%r1%', false)"),
    "filter_tag": ("tag:tox", "(repo, rel_path) IN (SELECT (repo, rel_path) FROM annotations WHERE list_contains(tags, 'toxic'))"),
    "filter_accepted": ("accepted:yes", "(repo, size, hash) IN (SELECT (repo, size, hash) FROM accepted)"),
    "filter_combined": ("!name:doc_1 mime:text tag:keep accepted:no size:>100", "rel_path NOT LIKE '%doc\\_1%' ESCAPE '\\' AND coalesce(mime LIKE '%text%', false) AND size > 100 AND (repo, rel_path) IN (SELECT (repo, rel_path) FROM annotations WHERE list_contains(tags, 'keep')) AND NOT (repo, size, hash) IN (SELECT (repo, size, hash) FROM accepted)"),
}
for _name, (_expression, _where) in _FILTERS.items():
    query(_name, f"SELECT repo, rel_path, size, hash FROM best WHERE {_where}")(
        lambda spark, d, e=_expression: filters.matching(source.files(spark, d), e, source.annotations(spark, d), source.accepted(spark, d)).select("repo", "rel_path", *KEY)
    )
query("filtered_count", "SELECT count(*) AS files FROM live WHERE mime LIKE '%text/%'")(_only(lambda f: filters.matching(f, "mime:text/").agg(F.count("*").alias("files"))))

# Comparison
_CLASSIFY = """, ref AS (SELECT size, hash, bool_or(NOT missing) AS present, (arg_min(rel_path, (repo_ord, rel_path)) FILTER (NOT missing)) AS reference_path FROM files WHERE repo IN {refs} GROUP BY size, hash)
    SELECT l.repo, l.rel_path, l.size, l.hash, CASE WHEN present IS NULL THEN 'New' WHEN present THEN 'Equal' ELSE 'DeletedInReference' END AS relation, reference_path
    FROM live l LEFT JOIN ref USING (size, hash) WHERE l.repo = 'r0'"""
query("diff_classify", _CLASSIFY.format(refs="('m0')"))(_only(lambda f: compare.classified(compare.of(f, "r0"), compare.of(f, "m0"))))
query("diff_classify_multi_ref", _CLASSIFY.format(refs="('r1', 'r2')"))(_only(lambda f: compare.classified(compare.of(f, "r0"), compare.of(f, "r1", "r2"))))
query("copy_candidates", "SELECT rel_path, size, hash FROM r0 WHERE NOT missing AND (size, hash) NOT IN (SELECT (size, hash) FROM m0)")(
    _only(lambda f: compare.unseen(compare.of(f, "r0"), compare.of(f, "m0")).select("rel_path", *KEY))
)
query("delete_candidates", "SELECT rel_path, size, hash FROM r0 WHERE NOT missing AND (size, hash) IN (SELECT (size, hash) FROM m0) AND (repo, size, hash) NOT IN (SELECT (repo, size, hash) FROM accepted)")(
    _accepting(lambda f, a: compare.known_elsewhere(compare.of(f, "r0"), compare.of(f, "m0"), a).select("rel_path", *KEY))
)
query("dedupe_against_plan", "SELECT rel_path, relation, reference_path FROM (" + _CLASSIFY.format(refs="('m0')").replace(", ref AS", "WITH ref AS", 1) + ") WHERE relation <> 'New' AND (repo, size, hash) NOT IN (SELECT (repo, size, hash) FROM accepted)")(
    _accepting(lambda f, a: compare.classified(compare.of(f, "r0"), compare.of(f, "m0")).where("relation <> 'New'").join(a, ["repo", *KEY], "left_anti").select("rel_path", "relation", "reference_path"))
)
_BY_HASH = """, l AS (SELECT size, hash, string_agg(rel_path, '|' ORDER BY rel_path) AS left_paths FROM r0 WHERE NOT missing GROUP BY size, hash),
    r AS (SELECT size, hash, string_agg(rel_path, '|' ORDER BY rel_path) AS right_paths FROM m0 WHERE NOT missing GROUP BY size, hash),
    h AS (SELECT size, hash, left_paths, right_paths, CASE WHEN right_paths IS NULL THEN 'OnlyLeft' WHEN left_paths IS NULL THEN 'OnlyRight' WHEN left_paths = right_paths THEN 'Equal' ELSE 'Renamed' END AS relation
          FROM l FULL JOIN r USING (size, hash)),
    byhash AS (SELECT *, relation = 'OnlyLeft' AND (size, hash) IN (SELECT (size, hash) FROM m0 GROUP BY size, hash HAVING bool_and(missing)) AS deleted_in_right,
          relation = 'OnlyRight' AND (size, hash) IN (SELECT (size, hash) FROM r0 GROUP BY size, hash HAVING bool_and(missing)) AS deleted_in_left FROM h) """
query("repo_diff_by_hash", _BY_HASH + "SELECT * FROM byhash")(_only(lambda f: compare.rows_by_hash(compare.of(f, "r0"), compare.of(f, "m0")).drop("left_count", "right_count", "left_path", "right_path")))
query("content_relations", _BY_HASH + """, n AS (SELECT size, hash, count(*) FILTER (repo = 'r0') AS left_count, count(*) FILTER (repo = 'm0') AS right_count, min(rel_path) FILTER (repo = 'r0') AS left_path, min(rel_path) FILTER (repo = 'm0') AS right_path
    FROM live WHERE repo IN ('r0', 'm0') GROUP BY ALL) SELECT size, hash, left_count, right_count, left_path, right_path, relation, deleted_in_right, deleted_in_left FROM byhash JOIN n USING (size, hash)""")(
    _only(lambda f: compare.relations(compare.of(f, "r0"), compare.of(f, "m0")))
)
query("content_path_rows", _BY_HASH + "SELECT size, hash, relation, CASE WHEN repo = 'r0' THEN 'left' ELSE 'right' END AS side, rel_path FROM live JOIN byhash USING (size, hash) WHERE repo IN ('r0', 'm0')")(
    _only(lambda f: compare.path_rows(compare.of(f, "r0"), compare.of(f, "m0")))
)
query("per_repo_duplicate_path_rows", "SELECT * FROM (SELECT repo, size, hash, count(*) OVER (PARTITION BY repo, size, hash) AS copies, rel_path FROM live) WHERE copies > 1")(_only(duplicates.path_rows_by_repo))
query("repo_diff_tombstone_flags", _BY_HASH + "SELECT relation, deleted_in_right, deleted_in_left, count(*) AS rows FROM byhash GROUP BY ALL")(
    _only(lambda f: compare.relations(compare.of(f, "r0"), compare.of(f, "m0")).groupBy("relation", "deleted_in_right", "deleted_in_left").agg(F.count("*").alias("rows")))
)
query("repo_diff_totals", _BY_HASH + "SELECT relation, count(*) AS rows FROM byhash GROUP BY ALL")(
    _only(lambda f: compare.relations(compare.of(f, "r0"), compare.of(f, "m0")).groupBy("relation").agg(F.count("*").alias("rows")))
)
query("bulk_renames", _BY_HASH + "SELECT left_paths AS old_path, right_paths AS new_path FROM byhash WHERE relation = 'Renamed' AND NOT contains(left_paths, '|') AND NOT contains(right_paths, '|')")(
    _only(lambda f: compare.relations(compare.of(f, "r0"), compare.of(f, "m0")).where("relation = 'Renamed' AND left_count = 1 AND right_count = 1").select(F.col("left_path").alias("old_path"), F.col("right_path").alias("new_path")))
)
query(
    "repo_diff_by_path",
    """SELECT coalesce(l.rel_path, r.rel_path) AS rel_path, l.size AS left_size, l.hash AS left_hash, r.size AS right_size, r.hash AS right_hash,
    CASE WHEN r.hash IS NULL THEN 'OnlyLeft' WHEN l.hash IS NULL THEN 'OnlyRight' WHEN l.size = r.size AND l.hash = r.hash THEN 'Equal' ELSE 'Conflict' END AS relation
    FROM (SELECT * FROM r0 WHERE NOT missing) l FULL JOIN (SELECT * FROM m0 WHERE NOT missing) r ON l.rel_path = r.rel_path""",
)(_only(lambda f: compare.rows_by_path(compare.of(f, "r0"), compare.of(f, "m0"))))
query(
    "sync_back_plan",
    """, k AS (SELECT size, hash, bool_or(NOT missing) AS present FROM r0 GROUP BY size, hash)
    SELECT s.repo, s.rel_path, s.size, s.hash, CASE WHEN present IS NULL THEN 'New' ELSE 'Resurrection' END AS status, s.rel_path IN (SELECT rel_path FROM r0 WHERE NOT missing) AS conflict
    FROM m0 s LEFT JOIN k USING (size, hash) WHERE NOT s.missing AND NOT coalesce(present, false)""",
)(_only(lambda f: compare.sync_back(compare.of(f, "m0"), compare.of(f, "r0"))))
query(
    "repo_overview",
    """, ref AS (SELECT size, hash FROM r0 WHERE NOT missing), cov AS (SELECT x.repo, count(*) AS covered FROM ref JOIN (SELECT DISTINCT repo, size, hash FROM live) x USING (size, hash) GROUP BY x.repo)
    SELECT l.repo, count(*) FILTER ((size, hash) NOT IN (SELECT (size, hash) FROM ref)) AS unique_files, count(*) FILTER ((size, hash) IN (SELECT (size, hash) FROM ref)) AS shared_files,
    (SELECT count(*) FROM ref) - coalesce(any_value(covered), 0) AS missing_files FROM live l LEFT JOIN cov USING (repo) WHERE l.repo <> 'r0' GROUP BY l.repo""",
)(_only(lambda f: compare.overview(f, "r0")))
_EXPORT = """, rk AS (SELECT repo, rel_path, row_number() OVER (PARTITION BY size, hash ORDER BY coalesce(img_w * img_h, -1) DESC, (taken_ms IS NOT NULL OR camera IS NOT NULL) DESC, taken_ms ASC NULLS LAST, size DESC, modified_ms, lower(rel_path), repo_ord, rel_path) AS rank FROM live WHERE repo = 'r0')
    SELECT l.rel_path, size, hash FROM live l JOIN rk USING (repo, rel_path) WHERE (size, hash) NOT IN (SELECT (size, hash) FROM files WHERE repo = 'r1') AND rank """
query("folder_export_unique", _EXPORT + "= 1")(_only(lambda f: compare.folder_export(compare.of(f, "r0"), compare.of(f, "r1")).select("rel_path", *KEY)))
query("folder_export_redundant", _EXPORT + "> 1")(_only(lambda f: compare.folder_export(compare.of(f, "r0"), compare.of(f, "r1"), redundant=True).select("rel_path", *KEY)))

# Synchronisation
_COPIES = "SELECT rel_path, size, hash FROM r0 WHERE NOT missing AND (size, hash) NOT IN (SELECT (size, hash) FROM m0 WHERE NOT missing)"
query("sync_copies", _COPIES)(_only(lambda f: sync.copies(compare.of(f, "r0"), compare.of(f, "m0")).select("rel_path", *KEY)))
query("sync_delete_missing", "SELECT rel_path, size, hash FROM m0 WHERE NOT missing AND (size, hash) IN (SELECT (size, hash) FROM r0 WHERE missing)")(
    _only(lambda f: sync.deletes_missing(compare.of(f, "r0"), compare.of(f, "m0")).select("rel_path", *KEY))
)
query("sync_delete_absent", "SELECT rel_path, size, hash FROM m0 WHERE NOT missing AND (size, hash) NOT IN (SELECT (size, hash) FROM r0 WHERE NOT missing)")(
    _only(lambda f: sync.deletes_absent(compare.of(f, "r0"), compare.of(f, "m0")).select("rel_path", *KEY))
)
query("sync_resurrections", _COPIES + " AND (size, hash) IN (SELECT (size, hash) FROM m0 WHERE missing)")(_only(lambda f: sync.resurrections(compare.of(f, "r0"), compare.of(f, "m0")).select("rel_path", *KEY)))
query(
    "sync_run_first_per_content",
    f""", c AS ({_COPIES}), t AS (SELECT *, rel_path IN (SELECT rel_path FROM m0 WHERE NOT missing) AS taken FROM c),
    u AS (SELECT *, min(rel_path) FILTER (NOT taken) OVER (PARTITION BY size, hash) AS first FROM t)
    SELECT rel_path, size, hash, CASE WHEN NOT taken AND rel_path = first THEN 'copied' WHEN NOT taken THEN 'equal' WHEN first IS NULL OR rel_path < first THEN 'skipped' ELSE 'equal' END AS outcome FROM u""",
)(_only(lambda f: sync.run_copies(compare.of(f, "r0"), compare.of(f, "m0"))))
_GROUP = """, g AS (SELECT * FROM (VALUES ('m0', 'Mirror'), ('r1', 'AddOnly'), ('r2', 'ApplyChanges')) v(sink, mode)), t AS (SELECT g.*, f.rel_path, f.size, f.hash FROM g JOIN live f ON f.repo = g.sink),
    plan AS (SELECT 'g' AS name, sink, 'copy' AS action, rel_path, size, hash FROM g, r0 WHERE NOT missing AND (sink, size, hash) NOT IN (SELECT (sink, size, hash) FROM t)
    UNION ALL SELECT 'g', sink, 'delete_missing', rel_path, size, hash FROM t WHERE mode = 'ApplyChanges' AND (size, hash) IN (SELECT (size, hash) FROM r0 WHERE missing)
    UNION ALL SELECT 'g', sink, 'delete_absent', rel_path, size, hash FROM t WHERE mode = 'Mirror' AND (size, hash) NOT IN (SELECT (size, hash) FROM r0 WHERE NOT missing)) """
query("group_sync_plan", _GROUP + "SELECT * FROM plan")(lambda spark, d: sync.group_plan(source.files(spark, d), source.sync_groups(spark)))
query("wholesale_sinks", _GROUP + "SELECT name, sink, count(*) AS deletes, any_value(n) AS live_files FROM plan JOIN (SELECT repo, count(*) AS n FROM live GROUP BY repo) ON repo = sink WHERE action <> 'copy' GROUP BY name, sink HAVING count(*) >= any_value(n)")(
    lambda spark, d: sync.wholesale(source.files(spark, d), source.sync_groups(spark))
)

# Dates, rules, archives, texts
query("timeline_buckets", "SELECT year(make_timestamp(best_ms * 1000)) AS year, month(make_timestamp(best_ms * 1000)) AS month, count(*) AS files, sum(size)::BIGINT AS bytes FROM best GROUP BY ALL")(_only(organise.timeline))
RULES = [("name:*.eml", 'mail/{year}/{month}/{o-stem}.{o-ext|"none"}'), ("size:<1000", "{size}/{camera|origin|\"other\"}/{o-name}"), ("mime:text", "texts/{year}-{month}-{day}.{o-ext}")]
_PLAN = """, n AS (SELECT *, make_timestamp(best_ms * 1000) AS t, string_split(rel_path, '/')[-1] AS name FROM best),
    m AS (SELECT repo, rel_path, size, hash, CASE WHEN rel_path LIKE '%.eml' THEN 'mail/' || strftime(t, '%Y/%m/') || name WHEN size < 1000 THEN 'tiny/' || coalesce(camera, origin, 'other') || '/' || name
          WHEN coalesce(mime LIKE '%text%', false) THEN 'texts/' || strftime(t, '%Y-%m-%d') || '.' || string_split(name, '.')[-1] END AS target FROM n),
    moves AS (SELECT * FROM m WHERE target IS NOT NULL AND target <> rel_path) """
query("organize_plan", _PLAN + "SELECT * FROM moves")(_only(lambda f: organise.plan(f, RULES)))
query(
    "organize_suffixes",
    _PLAN + """, p AS (SELECT *, row_number() OVER (PARTITION BY repo, target ORDER BY rel_path) AS place FROM moves)
    SELECT repo, rel_path, size, hash, target, CASE WHEN place = 1 THEN target ELSE regexp_replace(target, '\\.[^./]*$', '') || ' (' || place || ')' || regexp_extract(target, '(\\.[^./]*)$', 1) END AS final FROM p""",
)(_only(lambda f: organise.with_suffixes(organise.plan(f, RULES))))
query("size_buckets", "SELECT CASE WHEN size < 102400 THEN 'tiny' WHEN size < 10485760 THEN 'small' WHEN size < 104857600 THEN 'medium' WHEN size < 1073741824 THEN 'large' ELSE 'huge' END AS bucket, count(*) AS files FROM live GROUP BY ALL")(
    _only(lambda f: live(f).groupBy(scalars.size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("files")))
)
query(
    "archive_coverage",
    """SELECT repo, archive_rel, count(*) AS members, count(*) FILTER (held) AS present, count(*) FILTER (locked) AS locked, count(*) = count(*) FILTER (held) AS redundant, round(count(*) FILTER (held) * 100.0 / count(*), 6)::DOUBLE AS percent
    FROM (SELECT *, coalesce((size, hash) IN (SELECT (size, hash) FROM live WHERE repo <> 'm0') AND hash IS NOT NULL, false) AS held FROM members) GROUP BY repo, archive_rel""",
)(lambda spark, d: archives.coverage(source.archive_members(spark, d), source.files(spark, d).where("repo <> 'm0'")))
query("members_by_content", "SELECT size, hash, count(*) AS occurrences, string_agg(repo || '/' || archive_rel || '/' || member_name, '|' ORDER BY repo || '/' || archive_rel || '/' || member_name) AS places FROM members WHERE hash IS NOT NULL GROUP BY size, hash")(
    lambda spark, d: archives.members_by_content(source.archive_members(spark, d))
)
query("member_places", "SELECT size, hash, count(*) OVER (PARTITION BY size, hash) AS occurrences, repo, archive_rel, member_name FROM members WHERE hash IS NOT NULL")(lambda spark, d: archives.member_places(source.archive_members(spark, d)))
query("text_hash_groups", "SELECT sha256(lower(regexp_replace(text, '\\s+', '', 'g'))) AS text_hash, count(*) AS files FROM documents GROUP BY 1 HAVING count(*) > 1".replace("SELECT", "WITH d AS (SELECT 1) SELECT", 1))(
    lambda spark, d: source.table(spark, d, "documents").groupBy(scalars.text_hash(F.col("text")).alias("text_hash")).agg(F.count("*").alias("files")).where("files > 1")
)
query("text_file_hash_groups", "WITH d AS (SELECT sha256(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\s+$', '')) AS text_hash FROM documents) SELECT text_hash, count(*) AS files FROM d GROUP BY 1 HAVING count(*) > 1")(
    lambda spark, d: source.table(spark, d, "documents").groupBy(scalars.text_file_hash(F.col("text")).alias("text_hash")).agg(F.count("*").alias("files")).where("files > 1")
)
query("printable_strings", "WITH d AS (SELECT url, regexp_extract_all(html, '[ -~]{20,}')[1:50] AS runs FROM pages) SELECT url, len(runs) AS runs, runs[1] AS first FROM d")(
    lambda spark, d: source.table(spark, d, "pages").select("url", scalars.printable_runs(F.col("html"), 20, 50).alias("r")).select("url", F.size("r").cast("long").alias("runs"), F.try_element_at("r", F.lit(1)).alias("first"))
)

#: Paths and contents for the classifier; none of them is in the tables.
SCAN = [
    ("w/wallet.dat", None, "x"), ("a/b.wallet", None, "x"), ("k/pass.kdbx", None, "x"), ("k/x.1pif", None, "x"), (".gnupg/ring", None, "x"), ("h/.ssh/config", "text/plain", "x"), ("h/.ssh/id_rsa.pub", "text/plain", "x"),
    ("h/id_ed25519", None, "x"), ("c/a.pem", None, "x"), ("c/talk.key", "application/zip", "x"), ("c/own.key", None, "x"), ("f/Rechnung-2020.txt", "text/plain", "x"), ("f/tax_testament.txt", "text/plain", "x"), ("f/my passport.jpg", "image/jpeg", "x"),
    ("t/a.txt", "text/plain", "-----BEGIN RSA PRIVATE KEY-----"), ("t/b.json", None, '{"cipher":1,"kdfparams":2,"Crypto":3}'), ("t/c.json", None, '{"wallet_type":1,"keystore":2}'), ("t/d.jpg", "image/jpeg", "BEGIN RSA PRIVATE KEY"), ("t/taxi.txt", "text/plain", "syntax"),
]
_KINDS = ["Wallet", "Wallet", "Vault", "Vault", "Key", "Key", None, "Key", "Key", None, "Key", "Financial", "Financial", "Identity", "Key", "Wallet", "Wallet", None, None]


def _scanned(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SCAN, "rel_path string, mime string, content string")
    return rows.select("rel_path", scalars.sensitive(F.col("rel_path"), F.col("mime"), F.octet_length("content").cast("long"), F.col("content")).alias("category"))


_SCANNED = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {repr(k) if k else 'NULL'})" for (p, _, _), k in zip(SCAN, _KINDS, strict=True)) + ") v(rel_path, category)"
query("scan_flags", f"WITH s AS ({_SCANNED}) SELECT * FROM s")(lambda spark, d: _scanned(spark))
query("flag_counts", f"WITH s AS ({_SCANNED}) SELECT category, count(*) AS files FROM s WHERE category IS NOT NULL GROUP BY category")(lambda spark, d: _scanned(spark).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("files")))
query(
    "triage_report",
    """, g AS (SELECT repo, count(*) AS groups, sum((n - 1) * size)::BIGINT AS reclaimable FROM (SELECT repo, size, hash, count(*) AS n FROM live GROUP BY repo, size, hash HAVING count(*) > 1) GROUP BY repo)
    SELECT repo, count(*) FILTER (NOT missing) AS files, sum(size) FILTER (NOT missing)::BIGINT AS bytes, count(*) FILTER (missing) AS missing_files, coalesce(any_value(groups), 0) AS duplicate_groups, coalesce(any_value(reclaimable), 0)::BIGINT AS reclaimable
    FROM files LEFT JOIN g USING (repo) GROUP BY repo""",
)(
    _only(
        lambda f: catalogue.stats(f)
        .join(live(f).groupBy("repo", *KEY).agg(F.count("*").alias("n")).where("n > 1").groupBy("repo").agg(F.count("*").alias("g"), F.sum((F.col("n") - 1) * F.col("size")).alias("w")), "repo", "left")
        .select("repo", "files", "bytes", "missing_files", F.coalesce("g", F.lit(0)).alias("duplicate_groups"), F.coalesce("w", F.lit(0)).alias("reclaimable"))
    )
)

# Similarity
_PAIRS = """e AS (SELECT vec_id, [list_sum([CASE WHEN embedding[k * 8 + i + 1] > 0 THEN 1 << i ELSE 0 END FOR i IN range(8)])::BIGINT FOR k IN range(8)] AS bands FROM embeddings),
    u AS (SELECT vec_id, unnest(range(8)) AS k, unnest(bands) AS v FROM e), c AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.k = b.k AND a.v = b.v AND a.vec_id < b.vec_id),
    pairs AS (SELECT a, b, (1 - list_sum([bit_count(xor(x.bands[k], y.bands[k])) FOR k IN range(1, 9)]) / 64) * 100 AS similarity FROM c JOIN e x ON x.vec_id = a JOIN e y ON y.vec_id = b)"""
query("similar_pairs_banded", f"WITH {_PAIRS} SELECT a, b, similarity::DOUBLE AS similarity FROM pairs WHERE similarity >= 70")(lambda spark, d: similar.banded_pairs(source.sign_hashes(spark, d), 64, 70.0, width=8))
query(
    "similar_groups_greedy",
    f"""WITH RECURSIVE {_PAIRS}, p AS (SELECT a, b FROM pairs WHERE similarity >= 70), n AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, (SELECT coalesce(list(a), []) FROM p WHERE b = v) AS before FROM (SELECT a AS v FROM p UNION SELECT b FROM p)),
    s(rn, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.rn, CASE WHEN list_has_any(s.leaders, n.before) THEN s.leaders ELSE list_append(s.leaders, n.v) END FROM s JOIN n ON n.rn = s.rn + 1),
    l AS (SELECT leaders FROM s ORDER BY rn DESC LIMIT 1), g AS (SELECT v AS member, coalesce(list_min(list_intersect(before, leaders)), v) AS leader FROM n, l)
    SELECT member, leader FROM g WHERE leader IN (SELECT leader FROM g GROUP BY leader HAVING count(*) > 1)""",
)(lambda spark, d: similar.similar_groups(source.sign_hashes(spark, d), 64, 70.0, width=8))
query("duration_runs", "WITH d AS (SELECT conv_id * 1000 + turn AS id, strlen(text) * 37 AS ms FROM conversations) SELECT id, ms, row_number() OVER (ORDER BY ms, id) AS place, count(*) OVER (ORDER BY ms RANGE BETWEEN UNBOUNDED PRECEDING AND 2000 FOLLOWING) AS last_place FROM d")(
    lambda spark, d: similar.interval_runs(source.durations(spark, d))
)
query("duration_window_pairs", "WITH d AS (SELECT conv_id * 1000 + turn AS id, strlen(text) * 37 AS ms FROM conversations) SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.id < y.id AND abs(x.ms - y.ms) <= 2000")(
    lambda spark, d: similar.interval_pairs(source.durations(spark, d))
)


def _pairs_of_paths(spark: SparkSession, d: str) -> DataFrame:
    renamed = compare.rows_by_hash(compare.of(source.files(spark, d), "r0"), compare.of(source.files(spark, d), "m0")).where("relation = 'Renamed'")
    return renamed.select(F.col("left_paths").alias("a"), F.col("right_paths").alias("b"))


def _texts_of_one_path(spark: SparkSession, d: str) -> DataFrame:
    """Documents of r0 beside those of r1 that have the same path."""
    b = source.base(spark, d)
    left = b.where("repo = 'r0'").select("rel_path", F.col("content").alias("a"))
    return left.join(b.where("repo = 'r1'").select("rel_path", F.col("content").alias("b")), "rel_path")


query("byte_alignment")(lambda spark, d: align.byte_alignment(_pairs_of_paths(spark, d)))
query("line_diff")(lambda spark, d: align.line_rows(_texts_of_one_path(spark, d)).select("rel_path", "segments", "degraded", "rows"))
query("name_diff")(lambda spark, d: align.name_diff(_pairs_of_paths(spark, d)))
