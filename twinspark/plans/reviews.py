"""More registered queries: scans, similar files, selections, previews, registry edits; and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.functions import scalars
from twinspark.operators import align, catalogue, compare, duplicates, registry, similar, sync, views
from twinspark.operators.duplicates import KEY, live
from twinspark.plans.queries import _BY_HASH, _CHANGES, _COPIES, _GROUP, ORACLE_SQL, QUERIES, _pairs_of_paths, query
from twinspark.sources import catalogue as source

__all__ = ["ORACLE_SQL", "QUERIES"]

# Paths: of rows that are one file on disk, the first repository's stays
_PLACED = """, roots AS (SELECT * FROM (VALUES ('r0', '/vol/a'), ('r1', '/vol/b'), ('r2', '/vol/c'), ('r3', '/vol/d'), ('m0', '/vol/a')) v(repo, root)),
    placed AS (SELECT * FROM (SELECT l.*, root || '/' || rel_path AS abs_path, row_number() OVER (PARTITION BY root || '/' || rel_path ORDER BY repo_ord) AS turn FROM live l JOIN roots USING (repo)) WHERE turn = 1) """


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return views.first_of_path(source.files(spark, d), source.roots(spark, d))


query("first_repository_of_path", _PLACED + "SELECT repo, rel_path, abs_path FROM placed")(lambda spark, d: _placed(spark, d).select("repo", "rel_path", "abs_path"))
query("duplicate_groups_by_path", _PLACED + "SELECT size, hash, count(*) AS copies, (count(*) - 1) * size AS wasted FROM placed GROUP BY size, hash HAVING count(*) > 1")(lambda spark, d: duplicates.group_keys(_placed(spark, d)))

# Similar files
_512 = """lv AS (SELECT * FROM (VALUES (0, -0.15), (1, -0.1), (2, -0.05), (3, 0.0), (4, 0.05), (5, 0.1), (6, 0.15), (7, 0.2)) v(k, level)),
    x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
    w AS (SELECT vec_id, p // 2 AS w, sum(CASE WHEN value > level::DOUBLE THEN 1 << (8 * (p % 2) + k) ELSE 0 END)::BIGINT AS v FROM x, lv GROUP BY ALL),
    c AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.w = b.w AND a.v = b.v AND a.vec_id < b.vec_id),
    pairs AS (SELECT c.a, c.b, (1 - sum(bit_count(xor(x.v, y.v))) / 512) * 100 AS similarity FROM c JOIN w x ON x.vec_id = c.a JOIN w y ON y.vec_id = c.b AND y.w = x.w GROUP BY c.a, c.b)"""
query("similar_pairs_512", f"WITH {_512} SELECT a, b, similarity::DOUBLE AS similarity FROM pairs WHERE similarity >= 75")(lambda spark, d: similar.banded_pairs(source.prints_512(spark, d), 512, 75.0))

_1536 = """o AS (SELECT vec_id, j * 16 + k AS w, ('0x' || substr(sha256('v' || vec_id || ':' || j), k * 4 + 1, 4))::BIGINT AS v FROM embeddings, range(6) a(j), range(16) b(k)),
    w AS (SELECT * FROM o UNION ALL SELECT vec_id + 1000000, w, CASE WHEN vec_id % 3 = 0 THEN xor(v, 1) WHEN vec_id % 3 = 1 AND w < 10 THEN xor(v, 3) ELSE v END FROM o),
    pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, (1 - sum(bit_count(xor(a.v, b.v))) / 1536) * 100 AS similarity FROM w a JOIN w b ON a.w = b.w AND a.vec_id < b.vec_id GROUP BY ALL)"""
query("video_pairs", f"WITH {_1536} SELECT a, b, similarity::DOUBLE AS similarity FROM pairs WHERE similarity >= 93")(
    lambda spark, d: similar.banded_pairs(source.prints_1536(spark, d), 1536, 93.0, radius=similar.sure_radius(1536, 93.0))
)


def _kinds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Live files with the print of an image, or the identity of a document, one row for each path on disk."""
    placed = _placed(spark, d).select("doc_id", "repo", "rel_path", "repo_ord")
    prints = source.prints_512(spark, d).select(F.col("vec_id").alias("doc_id"), "bands")
    texts = source.table(spark, d, "documents").select("doc_id", scalars.text_hash(F.col("text")).alias("identity"))
    number = (F.col("doc_id") * 8 + F.col("repo_ord")).alias("id")
    images = placed.where("doc_id % 2 = 0").join(prints, "doc_id").select(number, "bands")
    return images, placed.where("doc_id % 2 = 1").join(texts, "doc_id").where("identity IS NOT NULL").select(number, "identity")


query(
    "find_similar",
    # A group has the file that leads it: the first of a document's, or of images in order the first that no earlier leader took.
    _PLACED
    + """, ids AS (SELECT doc_id, doc_id * 8 + repo_ord AS id FROM placed), """
    + _512.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 2 = 0)")
    + """, near AS (SELECT a, b FROM pairs WHERE similarity >= 75 UNION ALL SELECT vec_id, vec_id FROM embeddings WHERE vec_id % 2 = 0),
    p AS (SELECT DISTINCT least(i.id, j.id) AS a, greatest(i.id, j.id) AS b FROM near JOIN ids i ON i.doc_id = near.a JOIN ids j ON j.doc_id = near.b WHERE i.id <> j.id),
    n AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, (SELECT coalesce(list(a), []) FROM p WHERE b = v) AS before FROM (SELECT a AS v FROM p UNION SELECT b FROM p)),
    s(rn, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.rn, CASE WHEN list_has_any(s.leaders, n.before) THEN s.leaders ELSE list_append(s.leaders, n.v) END FROM s JOIN n ON n.rn = s.rn + 1),
    l AS (SELECT leaders FROM s ORDER BY rn DESC LIMIT 1), g AS (SELECT v AS member, coalesce(list_min(list_intersect(before, leaders)), v) AS leader FROM n, l),
    d AS (SELECT id, sha256(lower(regexp_replace(text, '\\s+', '', 'g'))) AS identity FROM ids JOIN documents USING (doc_id) WHERE doc_id % 2 = 1 AND regexp_replace(text, '\\s+', '', 'g') <> '')
    SELECT 'image' AS kind, member, leader FROM g WHERE leader IN (SELECT leader FROM g GROUP BY leader HAVING count(*) > 1)
    UNION ALL SELECT 'document', id, first FROM (SELECT id, min(id) OVER (PARTITION BY identity) AS first, count(*) OVER (PARTITION BY identity) AS m FROM d) WHERE m > 1""",
)(lambda spark, d: similar.find_similar(*_kinds(spark, d), 512, 75.0))
ORACLE_SQL["find_similar"] = ORACLE_SQL["find_similar"].replace("WITH ", "WITH RECURSIVE ", 1)

# Scans
SEED_WORDS = ("abandon", "ability", "able", "about")
_SCAN = """, f0 AS (SELECT b.*, CASE doc_id % 23 WHEN 1 THEN 'w/' || doc_id || '/wallet.dat' WHEN 2 THEN 'v/pass' || doc_id || '.kdbx' WHEN 3 THEN '.gnupg/ring' || doc_id WHEN 4 THEN 'h' || doc_id || '/.ssh/id_rsa'
      WHEN 5 THEN 'c/cert' || doc_id || '.pem' WHEN 6 THEN 'f/Rechnung-' || doc_id || '.txt' WHEN 7 THEN 'p/my passport ' || doc_id || '.jpg' WHEN 8 THEN 'h' || doc_id || '/.ssh/id_rsa.pub' ELSE rel_path END AS path,
      CASE doc_id % 19 WHEN 1 THEN '-----BEGIN EC PRIVATE KEY-----' || text WHEN 2 THEN '{"cipher":1,"kdfparams":2,"Crypto":3}' || text WHEN 3 THEN '{"seed_version":4}' || text
      WHEN 4 THEN repeat('abandon ability ', 6) || text WHEN 5 THEN repeat('abandon ability ', 5) || text WHEN 6 THEN 'twelve bytesb1' || chr(5) || chr(0) || text ELSE text END AS body FROM base b WHERE NOT missing),
    f1 AS (SELECT *, strlen(body) AS n FROM f0),
    f2 AS (SELECT repo, path AS rel_path, CASE WHEN path LIKE '%/wallet.dat' THEN ['Wallet', 'filename matches wallet.dat'] WHEN path LIKE '%.kdbx' THEN ['Vault', 'KeePass database'] WHEN path LIKE '.gnupg/%' THEN ['Key', 'GnuPG keyring path']
      WHEN path LIKE '%/.ssh/id_rsa' THEN ['Key', 'SSH key material'] WHEN path LIKE '%.pem' THEN ['Key', 'key/cert file (.pem)'] WHEN path LIKE 'f/Rechnung%' THEN ['Financial', 'financial-document filename keyword']
      WHEN path LIKE '%passport%' THEN ['Identity', 'vital-record filename keyword'] WHEN n > 1048576 THEN NULL WHEN substr(body, 13, 4) = 'b1' || chr(5) || chr(0) THEN ['Wallet', 'Berkeley DB (wallet.dat family)']
      WHEN contains(substr(body, 1, 200), 'BEGIN EC PRIVATE KEY') THEN ['Key', 'private key header (BEGIN EC PRIVATE KEY)']
      WHEN n <= 262144 AND contains(body, '"cipher"') AND contains(body, '"kdfparams"') AND (contains(body, '"crypto"') OR contains(body, '"Crypto"')) THEN ['Wallet', 'Ethereum keystore JSON (crypto/cipher/kdfparams)']
      WHEN n <= 262144 AND (contains(body, '"seed_version"') OR (contains(body, '"wallet_type"') AND contains(body, '"keystore"'))) THEN ['Wallet', 'Electrum wallet JSON']
      WHEN n <= 16384 AND regexp_matches(lower(body), '(^|[^a-z])((abandon|ability|able|about)[^a-z]+){11}(abandon|ability|able|about)($|[^a-z])') THEN ['Wallet', 'contains a BIP-39 seed phrase (12+ wordlist words)'] END AS flag FROM f1),
    flags AS (SELECT repo, rel_path, flag[1] AS category, flag[2] AS reason FROM f2 WHERE flag IS NOT NULL) """


def _flags(spark: SparkSession, d: str) -> DataFrame:
    rows = live(source.scanned_files(spark, d))
    flag = scalars.flagged(F.col("rel_path"), F.col("mime"), F.col("size"), F.col("content"), SEED_WORDS)
    return rows.select("repo", "rel_path", flag.alias("flag")).where("flag IS NOT NULL").select("repo", "rel_path", "flag.category", "flag.reason")


query("scan_repositories", _SCAN + "SELECT * FROM flags")(_flags)
query("scan_totals", _SCAN + "SELECT repo, category, count(*) AS files FROM flags GROUP BY repo, category")(lambda spark, d: _flags(spark, d).groupBy("repo", "category").agg(F.count("*").alias("files")))


def _report(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository: files, duplicate groups, flagged files, and its eight commonest MIME types."""
    files = source.files(spark, d).where("repo <> 'm0'")
    groups = live(files).groupBy("repo", *KEY).agg(F.count("*").alias("n")).where("n > 1").groupBy("repo").agg(F.count("*").alias("groups"), F.sum((F.col("n") - 1) * F.col("size")).alias("reclaimable"))
    flags = _flags(spark, d).groupBy("repo").agg(F.count("*").alias("flagged"), F.count_if(F.col("category") == "Key").alias("keys"))
    mimes = catalogue.mime_histogram(files).withColumn("r", F.expr("row_number() OVER (PARTITION BY repo ORDER BY files DESC, mime)")).where("r <= 8")
    top = mimes.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "mime"))), lambda x: x["mime"]), ",").alias("top_mimes"))
    out = catalogue.stats(files).join(groups, "repo", "left").join(flags, "repo", "left").join(top, "repo", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("repo", "files", "bytes", "missing_files", zero("groups"), zero("reclaimable"), zero("flagged"), zero("keys"), F.coalesce("top_mimes", F.lit("")).alias("top_mimes"))


query(
    "repository_report",
    _SCAN
    + """, g AS (SELECT repo, count(*) AS groups, sum((n - 1) * size)::BIGINT AS reclaimable FROM (SELECT repo, size, hash, count(*) AS n FROM live GROUP BY repo, size, hash HAVING count(*) > 1) GROUP BY repo),
    k AS (SELECT repo, count(*) AS flagged, count(*) FILTER (category = 'Key') AS keys FROM flags GROUP BY repo),
    t AS (SELECT repo, string_agg(mime, ',' ORDER BY c DESC, mime) AS top_mimes FROM (SELECT repo, mime, count(*) AS c, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, mime) AS r FROM live WHERE mime IS NOT NULL GROUP BY repo, mime) WHERE r <= 8 GROUP BY repo)
    SELECT repo, count(*) FILTER (NOT missing) AS files, coalesce(sum(size) FILTER (NOT missing), 0)::BIGINT AS bytes, count(*) FILTER (missing) AS missing_files, coalesce(any_value(groups), 0) AS groups, coalesce(any_value(reclaimable), 0)::BIGINT AS reclaimable,
    coalesce(any_value(flagged), 0) AS flagged, coalesce(any_value(keys), 0) AS keys, coalesce(any_value(top_mimes), '') AS top_mimes FROM files LEFT JOIN g USING (repo) LEFT JOIN k USING (repo) LEFT JOIN t USING (repo) WHERE repo <> 'm0' GROUP BY repo""",
)(_report)

# Selections, boards, commands
query("selected_copies", ", c AS (" + _COPIES + ") SELECT rel_path, size, hash FROM c WHERE rel_path LIKE 'en/%' AND rel_path NOT LIKE '%.csv'")(
    lambda spark, d: views.selected(
        sync.copies(compare.of(source.files(spark, d), "r0"), compare.of(source.files(spark, d), "m0")).select("rel_path", *KEY),
        "s",
        only=source.files(spark, d).where("rel_path LIKE 'en/%'").select(F.concat(F.lit("s:"), "rel_path").alias("key")),
        exclude=source.files(spark, d).where("rel_path LIKE '%.csv'").select(F.concat(F.lit("s:"), "rel_path").alias("key")),
    )
)
_STATES = (
    _BY_HASH
    + """, st AS (SELECT coalesce(string_split(left_paths, '|')[1], '') || '|' || coalesce(string_split(right_paths, '|')[1], '') AS key, relation, left_paths, right_paths,
    CASE relation WHEN 'Equal' THEN 'same' WHEN 'OnlyLeft' THEN 'only_here' WHEN 'OnlyRight' THEN CASE WHEN deleted_in_left THEN 'resurrect' ELSE 'absent' END ELSE 'differs' END AS left_state,
    CASE relation WHEN 'Equal' THEN 'same' WHEN 'OnlyRight' THEN 'only_here' WHEN 'OnlyLeft' THEN CASE WHEN deleted_in_right THEN 'resurrect' ELSE 'absent' END ELSE 'differs' END AS right_state,
    CASE relation WHEN 'Equal' THEN 'hide' WHEN 'OnlyLeft' THEN 'copy_right,delete_left,hide' WHEN 'OnlyRight' THEN 'copy_left,hide'
      ELSE CASE WHEN contains(left_paths, '|') THEN 'delete_all_left,keep_one_left' ELSE 'rename_left' END || CASE WHEN contains(right_paths, '|') THEN '' ELSE ',rename_right' END || ',hide' END AS commands FROM byhash) """
)


def _states(spark: SparkSession, d: str) -> DataFrame:
    f = source.files(spark, d)
    return views.states(compare.relations(compare.of(f, "r0"), compare.of(f, "m0")), right_locked=True)


query("diff_states_and_commands", _STATES + "SELECT key, relation, left_state, right_state, commands FROM st")(lambda spark, d: _states(spark, d).withColumn("commands", F.array_join("commands", ",")))
query("board_resurrections", _STATES + "SELECT key, left_state, right_state FROM st WHERE relation <> 'Equal' AND (left_state = 'resurrect' OR right_state = 'resurrect') AND key NOT LIKE '%.md%'")(
    lambda spark, d: views.board(_states(spark, d), hidden=_states(spark, d).where("key LIKE '%.md%'"), resurrections=True).select("key", "left_state", "right_state")
)
query(
    "commands_as_operations",
    _STATES
    + """SELECT left_paths, right_paths, command, CASE WHEN several AND regexp_matches(command, '^(copy|overwrite|rename|keep_one)_') THEN 'pick' WHEN command LIKE 'copy%' THEN 'copy' WHEN command LIKE 'rename%' THEN 'rename' WHEN command LIKE 'delete%' THEN 'delete' END AS op
    FROM (SELECT left_paths, right_paths, contains(coalesce(left_paths, ''), '|') OR contains(coalesce(right_paths, ''), '|') AS several, unnest(string_split(commands, ',')) AS command FROM st)""",
)(
    lambda spark, d: compare.rows_by_hash(compare.of(source.files(spark, d), "r0"), compare.of(source.files(spark, d), "m0"))
    .withColumn("key", F.concat(F.coalesce("left_path", F.lit("")), F.lit("|"), F.coalesce("right_path", F.lit(""))))
    .join(_states(spark, d).select("key", F.explode("commands").alias("command")), "key")
    .select("left_paths", "right_paths", "command", views.operation(F.col("command"), F.col("left_path"), F.col("right_path"), (F.col("left_count") > 1) | (F.col("right_count") > 1))["op"].alias("op"))
)
query(
    "listing_rows",
    """SELECT l.repo, l.rel_path, l.size, CASE WHEN img_w IS NOT NULL THEN img_w || '×' || img_h ELSE '' END AS info, coalesce(array_to_string(list_sort(tags), ', '), '') AS tags, a.hash IS NOT NULL AS accepted
    FROM live l LEFT JOIN annotations t ON t.repo = l.repo AND t.rel_path = l.rel_path LEFT JOIN accepted a ON a.repo = l.repo AND a.size = l.size AND a.hash = l.hash""",
)(lambda spark, d: views.listed(source.files(spark, d), source.annotations(spark, d), source.accepted(spark, d)))
query(
    "sync_preview_totals",
    _GROUP + """SELECT name, sink, count(*) FILTER (action = 'copy') AS copies, coalesce(sum(size) FILTER (action = 'copy'), 0)::BIGINT AS copy_bytes, count(*) FILTER (action <> 'copy') AS deletes,
    coalesce(sum(size) FILTER (action <> 'copy'), 0)::BIGINT AS delete_bytes FROM plan GROUP BY name, sink""",
)(lambda spark, d: views.plan_totals(sync.group_plan(source.files(spark, d), source.sync_groups(spark))))
query(
    "copied_entries",
    "SELECT 'm0' AS repo, rel_path, size, hash, CASE WHEN doc_id % 3 = 0 THEN modified_ms + 5 ELSE modified_ms END AS modified_ms, false AS missing, coalesce(origin, repo) AS origin FROM r0 WHERE NOT missing AND (size, hash) NOT IN (SELECT (size, hash) FROM m0 WHERE NOT missing)",
)(
    lambda spark, d: views.copied_entries(
        sync.copies(compare.of(source.files(spark, d), "r0"), compare.of(source.files(spark, d), "m0")), "m0", source.files(spark, d).where("repo = 'r0' AND doc_id % 3 = 0").select("rel_path", (F.col("modified_ms") + 5).alias("disk_ms"))
    )
)
query(
    "export_by_date",
    """, w AS (SELECT repo, repo_ord, rel_path, size, hash, strftime(make_timestamp(best_ms * 1000), '%Y/%m/') || string_split(rel_path, '/')[-1] AS wish FROM best),
    there AS (SELECT wish, 1 AS number, size, hash FROM w WHERE repo = 'r3' AND rel_path IN (SELECT min(rel_path) FROM w WHERE repo = 'r3' GROUP BY wish)),
    d AS (SELECT wish, size, hash, min((repo_ord, rel_path)) AS turn FROM w WHERE repo <> 'r3' GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY wish ORDER BY turn) + (wish IN (SELECT wish FROM there))::INT AS number FROM d WHERE (wish, size, hash) NOT IN (SELECT (wish, size, hash) FROM there))
    SELECT w.repo, w.rel_path, CASE WHEN n.turn = (w.repo_ord, w.rel_path) THEN 'copy' ELSE 'skip' END AS action,
    CASE WHEN n.turn = (w.repo_ord, w.rel_path) THEN CASE WHEN number = 1 THEN wish ELSE regexp_replace(wish, '\\.[^./]*$', '') || ' (' || number || ')' || regexp_extract(wish, '(\\.[^./]*)$', 1) END END AS path
    FROM w LEFT JOIN n USING (wish, size, hash) WHERE w.repo <> 'r3'""",
)(lambda spark, d: views.exported_by_date(source.files(spark, d).where("repo <> 'r3'"), _exported_before(spark, d)))


def _exported_before(spark: SparkSession, d: str) -> DataFrame:
    """What an earlier export of r3 left: one file for each name."""
    best = F.timestamp_millis(F.coalesce("taken_ms", "modified_ms"))
    rows = live(source.files(spark, d)).where("repo = 'r3'").withColumn("path", F.concat(F.date_format(best, "yyyy/MM/"), F.element_at(F.split("rel_path", "/"), -1)))
    return rows.groupBy("path").agg(F.min(F.struct("rel_path", *KEY)).alias("one")).select("path", "one.size", "one.hash")


# Names, types, mails, numbers
query(
    "detected_mimes",
    """SELECT repo, rel_path, CASE WHEN doc_id % 5 = 1 THEN 'application/pdf' WHEN doc_id % 5 = 2 THEN 'application/zip' WHEN doc_id % 5 = 3 AND rel_path LIKE '%.m4a' THEN 'audio/m4a' WHEN doc_id % 5 = 3 THEN 'video/mp4'
    WHEN rel_path LIKE '%.txt' THEN 'text/plain' WHEN rel_path LIKE '%.md' THEN 'text/markdown' WHEN rel_path LIKE '%.csv' THEN 'text/csv' WHEN rel_path LIKE '%.eml' THEN 'message/rfc822' END AS mime FROM base""".replace("rel_path LIKE '%.m4a'", "doc_id % 2 = 0").replace("SELECT repo, rel_path,", "SELECT doc_id, repo,"),
)(
    lambda spark, d: source.base(spark, d)
    .withColumn("content", F.expr("concat(CASE doc_id % 5 WHEN 1 THEN '%PDF-1.4' WHEN 2 THEN concat('PK', chr(3), chr(4)) WHEN 3 THEN '____ftypisom' ELSE ' ' END, content)"))
    .withColumn("rel_path", F.expr("CASE WHEN doc_id % 5 = 3 AND doc_id % 2 = 0 THEN concat(rel_path, '.m4a') ELSE rel_path END"))
    .select("doc_id", "repo", scalars.detected_mime(F.col("rel_path"), F.col("content")).alias("mime"))
)
query(
    "mail_identities",
    """, m AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'message-id:' || (doc_id // 6) || '@x' ELSE 'Subject ' || (doc_id % 7) || chr(10) || text END AS basis FROM documents)
    SELECT sha256(lower(regexp_replace(basis, '\\s+', '', 'g'))) AS identity, count(*) AS mails FROM m GROUP BY 1 HAVING count(*) > 1""",
)(
    lambda spark, d: source.table(spark, d, "documents")
    .select(F.concat(F.lit("From: a@b\r\n"), F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('Message-ID: <', doc_id div 6, '@x>') ELSE 'X-No: id' END"), F.lit("\r\nSubject: Subject\r\n "), F.expr("doc_id % 7"), F.lit("\r\n\r\n"), "text").alias("mail"))
    .groupBy(scalars.email_identity(F.col("mail")).alias("identity")).agg(F.count("*").alias("mails")).where("mails > 1")
)
query(
    "human_sizes",
    """SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824) ELSE printf('%.2f TB', b / 1099511627776) END AS size
    FROM (SELECT doc_id, strlen(text) * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS b FROM documents)""",
)(lambda spark, d: source.table(spark, d, "documents").select("doc_id", scalars.human_size(F.octet_length("text").cast("long") * F.expr("CASE doc_id % 4 WHEN 0 THEN 1L WHEN 1 THEN 1024L WHEN 2 THEN 1048576L ELSE 1073741824L END")).alias("size")))
query(
    "guarded_paths",
    """, g AS (SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '../' WHEN 2 THEN '/' WHEN 3 THEN './a/' WHEN 4 THEN 'a\\..\\b//' WHEN 5 THEN 'x/../' ELSE '' END || rel_path AS p FROM base)
    SELECT doc_id, NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AS inside, array_to_string(list_filter(string_split(replace(p, '\\', '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS member FROM g""",
)(
    lambda spark, d: source.base(spark, d)
    .select("doc_id", F.concat(F.expr(r"CASE doc_id % 6 WHEN 1 THEN '../' WHEN 2 THEN '/' WHEN 3 THEN './a/' WHEN 4 THEN r'a\..\b//' WHEN 5 THEN 'x/../' ELSE '' END"), "rel_path").alias("p"))
    .select("doc_id", scalars.stays_within(F.col("p")).alias("inside"), scalars.member_path(F.col("p")).alias("member"))
)
_MIMES = ["audio/mpeg", "audio/x-scpls", "application/x-mpegurl", "application/pdf", "message/rfc822", "application/vnd.ms-excel", None, "text/plain"]
query(
    "mime_predicates",
    f"""SELECT doc_id, coalesce(m LIKE 'audio/%' AND m <> 'audio/x-scpls', false) AS audio, coalesce(m IN ('audio/x-scpls', 'application/x-mpegurl'), false) AS playlist, coalesce(m = 'application/vnd.ms-excel', false) AS office,
    coalesce(m IN ('application/vnd.ms-excel', 'application/pdf', 'message/rfc822'), false) AS extractable FROM (SELECT doc_id, ([{", ".join(repr(m) if m else "NULL" for m in _MIMES)}])[doc_id % 8 + 1] AS m FROM documents)""",
)(
    lambda spark, d: source.table(spark, d, "documents")
    .select("doc_id", F.get(F.array(*[F.lit(m).cast("string") for m in _MIMES]), (F.col("doc_id") % 8).cast("int")).alias("m"))
    .select("doc_id", scalars.is_audio(F.col("m")).alias("audio"), scalars.is_playlist(F.col("m")).alias("playlist"), scalars.is_office(F.col("m")).alias("office"), scalars.is_extractable(F.col("m")).alias("extractable"))
)
query(
    "print_seeds",
    "WITH e AS (SELECT vec_id, list_transform(embedding[1:vec_id % 5], lambda x: (x > 0)::INT) AS w FROM embeddings) SELECT vec_id, CASE WHEN len(w) > 0 THEN sha256(array_to_string(w, ',')) END AS seed FROM e",
)(lambda spark, d: source.table(spark, d, "embeddings").select("vec_id", scalars.words_seed(F.transform(F.slice("embedding", 1, (F.col("vec_id") % 5).cast("int")), lambda x: (x > 0).cast("int"))).alias("seed")))

# The registry
_REPOS = "(VALUES ('r0', '/vol/a', false, 0), ('r1', '/vol/b', false, 1514764800000), ('r2', '/vol/c', true, 1514761200000), ('r3', '/vol/d', false, 1514764790000), ('m0', '/vol/a', false, 1514592000000)) v(repo, abs_path, remote, last_scan_ms)"


def _edited_repos(spark: SparkSession, d: str) -> DataFrame:
    groups = source.sync_groups(spark)
    repos = registry.create_repo(source.repositories(spark), "new", "/vol/e")
    repos = registry.rename_repo(registry.remove_repo(repos, groups, "r3"), groups, "new", "newer")
    return registry.relocate_repo(repos, "r1", "/mnt/b", remote=True)


query("registry_edits", f"WITH r AS (SELECT * FROM {_REPOS}) SELECT repo, CASE WHEN repo = 'r1' THEN '/mnt/b' ELSE abs_path END AS abs_path, remote OR repo = 'r1' AS remote, last_scan_ms::BIGINT AS last_scan_ms FROM r WHERE repo <> 'r3' UNION ALL SELECT 'newer', '/vol/e', false, 0")(_edited_repos)
query(
    "scan_ages",
    f"""WITH r AS (SELECT repo, last_scan_ms, (1514764800000 - last_scan_ms) // 1000 AS s FROM {_REPOS}) SELECT repo, CASE WHEN last_scan_ms = 0 THEN 'never' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minutes ago'
    WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END END AS age FROM r""",
)(lambda spark, d: source.repositories(spark).select("repo", scalars.age_in_words(F.col("last_scan_ms"), F.lit(1514764800000)).alias("age")))


def _edited_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = registry.add_sink(registry.create_group(source.sync_groups(spark), "h", "r3"), "h", "new", "Mirror")
    groups = registry.set_mode(registry.set_main(registry.remove_sink(groups, "g", "r2"), "g", "m0"), "g", "r1", "ApplyChanges")
    return registry.members(groups)


query("sync_group_edits", "WITH v AS (SELECT * FROM (VALUES ('g', 'm0', 'main'), ('g', 'r1', 'ApplyChanges'), ('g', 'r0', 'AddOnly'), ('h', 'r3', 'main'), ('h', 'new', 'Mirror')) t(name, repo, role)) SELECT * FROM v")(_edited_groups)
query("repository_roles", "SELECT repo, CASE WHEN repo = 'r0' THEN 'main' WHEN repo IN ('m0', 'r1', 'r2') THEN 'sink' ELSE 'free' END AS role, count(*) AS files FROM live GROUP BY repo")(
    lambda spark, d: live(source.files(spark, d)).groupBy("repo").agg(F.count("*").alias("files")).join(registry.members(source.sync_groups(spark)), "repo", "left")
    .select("repo", F.when(F.col("role") == "main", "main").when(F.col("role").isNotNull(), "sink").otherwise("free").alias("role"), "files")
)
query("change_events", _CHANGES + "SELECT status, repo, count(*) AS events FROM ch WHERE status IN ('added', 'updated', 'vanished') GROUP BY ALL")(
    lambda spark, d: registry.events(
        catalogue.changes(source.files(spark, d), source.snapshot(spark, d)).where("status NOT IN ('added', 'updated', 'vanished')"), catalogue.changes(source.files(spark, d), source.snapshot(spark, d)), "scan"
    ).select(F.get_json_object("detail", "$.status").alias("status"), F.get_json_object("detail", "$.repo").alias("repo")).groupBy("status", "repo").agg(F.count("*").alias("events"))
)
query(
    "diff_classify_given_order",
    """, ref AS (SELECT size, hash, bool_or(NOT missing) AS present, (arg_min(rel_path, (CASE repo WHEN 'r2' THEN 1 ELSE 2 END, rel_path)) FILTER (NOT missing)) AS reference_path FROM files WHERE repo IN ('r1', 'r2') GROUP BY size, hash)
    SELECT l.repo, l.rel_path, l.size, l.hash, CASE WHEN present IS NULL THEN 'New' WHEN present THEN 'Equal' ELSE 'DeletedInReference' END AS relation, reference_path
    FROM live l LEFT JOIN ref USING (size, hash) WHERE l.repo = 'r0'""",
)(lambda spark, d: compare.classified(compare.of(source.files(spark, d), "r0"), compare.of(source.files(spark, d), "r1", "r2"), ("r2", "r1")))
query("purge_candidates", "SELECT repo, rel_path FROM live WHERE mime LIKE '%csv%' AND size > 2000")(lambda spark, d: catalogue.purge(source.files(spark, d), "mime:csv size:>2000").select("repo", "rel_path"))
query("refreshed_entry", "SELECT repo, rel_path, CASE WHEN doc_id = 20 AND repo = 'r0' THEN 7 ELSE size END AS size, missing AND NOT (doc_id = 20 AND repo = 'r0') AS missing, origin FROM files")(
    lambda spark, d: catalogue.refreshed(source.files(spark, d), source.files(spark, d).where("doc_id = 20 AND repo = 'r0'").select("repo", "rel_path", F.lit(7).cast("long").alias("size"), "hash", "modified_ms", "mime")).select("repo", "rel_path", "size", "missing", "origin")
)
query("entry_lookup", "SELECT repo, rel_path, size, hash FROM files WHERE repo = 'r1' AND rel_path = (SELECT min(rel_path) FROM files WHERE repo = 'r1')")(
    lambda spark, d: source.files(spark, d).join(source.files(spark, d).where("repo = 'r1'").groupBy("repo").agg(F.min("rel_path").alias("rel_path")), ["repo", "rel_path"], "left_semi").select("repo", "rel_path", *KEY)
)
query("diff_in_order", _BY_HASH + "SELECT row_number() OVER (ORDER BY lower(coalesce(left_paths, right_paths)), coalesce(left_paths, right_paths), relation) AS place, relation, coalesce(left_paths, right_paths) AS first FROM byhash ORDER BY 1 LIMIT 200")(
    lambda spark, d: compare.rows_by_hash(compare.of(source.files(spark, d), "r0"), compare.of(source.files(spark, d), "m0"))
    .select("relation", F.coalesce("left_paths", "right_paths").alias("first")).orderBy(F.lower("first"), "first", "relation").limit(200)
    .withColumn("place", F.expr("row_number() OVER (ORDER BY lower(first), first, relation)").cast("long"))
)
query("hex_rows")(lambda spark, d: align.hex_rows(align.byte_alignment(_pairs_of_paths(spark, d))))
query("printable_runs_counted", "WITH d AS (SELECT url, regexp_extract_all(html, '[ -~]{20,}') AS runs FROM pages) SELECT url, len(runs) AS runs, runs[-1] AS last FROM d")(
    lambda spark, d: source.table(spark, d, "pages").select("url", scalars.printable_runs(F.col("html"), 20, None).alias("r")).select("url", F.size("r").cast("long").alias("runs"), F.try_element_at("r", F.lit(-1)).alias("last"))
)
