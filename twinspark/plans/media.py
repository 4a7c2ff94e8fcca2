"""Queries over pictures and sounds, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.functions import pictures, scalars
from twinspark.operators import similar, sounds
from twinspark.plans.queries import _FILES, query
from twinspark.plans.reviews import _1536, _512, _PLACED, _placed
from twinspark.sources import catalogue as source

# Pixels: values of a picture come from two components each; every picture also lies turned or mirrored
_PIXELS = """WITH px AS (SELECT vec_id, {side} AS n, list_transform(range({side} * {side}), lambda i: greatest(0, least(255, floor(128 + 300 * (embedding[((i // {side}) * 7 + (i % {side}) * 3) % 64 + 1]::DOUBLE + embedding[((i // {side}) * (i % {side})) % 64 + 1]::DOUBLE))))::BIGINT) AS p FROM embeddings),
    turned AS (SELECT vec_id, t AS turn, n, list_transform(range(n * n), lambda i: CASE t
        WHEN 0 THEN p[i + 1] WHEN 1 THEN p[(n - 1 - i % n) * n + i // n + 1] WHEN 2 THEN p[n * n - i] WHEN 3 THEN p[(i % n) * n + n - 1 - i // n + 1]
        WHEN 4 THEN p[(i // n) * n + n - 1 - i % n + 1] WHEN 5 THEN p[(n - 1 - i // n) * n + i % n + 1] WHEN 6 THEN p[(i % n) * n + i // n + 1] ELSE p[(n - 1 - i % n) * n + n - 1 - i // n + 1] END) AS p
        FROM px, range({turns}) r(t))"""
_FLIPPED = "list_transform(range(289), lambda i: {p}[{at}])"
_MOMENT = "list_sum(list_transform(range(289), lambda i: {p}[i + 1] * ({at} - 8)))"


def _moment(p: str, across: bool) -> str:
    return _MOMENT.format(p=p, at="i % 17" if across else "i // 17")


query(
    "picture_hashes",
    _PIXELS.format(side=34, turns=2)
    # Half as many cells as pixels each way: four pixels give 1, 3, 3 and 1 of eight; at the rim three give 3, 3 and 1 of seven.
    + f""", taps AS (SELECT c, 2 * c + k - 1 AS x, CASE WHEN k IN (1, 2) THEN 3 ELSE 1 END AS w FROM range(17) a(c), range(4) b(k) WHERE 2 * c + k - 1 BETWEEN 0 AND 33),
    weights AS (SELECT c, x, w::DOUBLE / sum(w) OVER (PARTITION BY c) AS w FROM taps),
    cells AS (SELECT vec_id, turn, y.c AS cy, x.c AS cx, floor(round(sum(p[y.x * 34 + x.x + 1] * y.w * x.w), 6) + 0.5)::BIGINT AS v FROM turned, weights y, weights x GROUP BY ALL),
    g0 AS (SELECT vec_id, turn, list(v ORDER BY cy, cx) AS g FROM cells GROUP BY ALL),
    g1 AS (SELECT vec_id, turn, CASE WHEN {_moment("g", True)} > 0 THEN {_FLIPPED.format(p="g", at="(i // 17) * 17 + 17 - i % 17")} ELSE g END AS g FROM g0),
    g2 AS (SELECT vec_id, turn, CASE WHEN {_moment("g", False)} > 0 THEN {_FLIPPED.format(p="g", at="(16 - i // 17) * 17 + i % 17 + 1")} ELSE g END AS g FROM g1),
    g3 AS (SELECT vec_id, turn, CASE WHEN {_moment("g", True)} > {_moment("g", False)} THEN {_FLIPPED.format(p="g", at="(i % 17) * 17 + i // 17 + 1")} ELSE g END AS g FROM g2),
    bits AS (SELECT vec_id, turn, list_transform(range(512), lambda i: (g[(i % 256) // 16 * 17 + i % 16 + 1] > g[(i % 256) // 16 * 17 + i % 16 + CASE WHEN i < 256 THEN 2 ELSE 18 END])::BIGINT) AS b FROM g3)
    SELECT vec_id, turn::INT AS turn, array_to_string(list_transform(range(32), lambda w: list_sum(list_transform(range(16), lambda k: b[w * 16 + k + 1] << k))::BIGINT), ',') AS bands FROM bits""",
)(lambda spark, d: _turned(spark, d, 34, 2).select("vec_id", "turn", F.array_join(pictures.bands(pictures.picture_hash(F.col("p"), F.col("n"), F.col("n"))), ",").alias("bands")))

query(
    "frame_hashes",
    _PIXELS.format(side=9, turns=8)
    + """, best AS (SELECT vec_id, max(p) AS p FROM turned GROUP BY vec_id),
    hashed AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: (p[(i // 8) * 9 + i % 8 + 1] > p[(i // 8) * 9 + i % 8 + 2])::INT::HUGEINT * (1::HUGEINT << i::INT)))::HUGEINT AS h FROM best)
    SELECT vec_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS dhash, 8::BIGINT AS turns, 1::BIGINT AS hashes FROM hashed""",
)(
    lambda spark, d: _turned(spark, d, 9, 8)
    .select("vec_id", "turn", pictures.frame_hash(F.col("p"), F.col("n"), F.col("n")).alias("dhash"))
    .groupBy("vec_id")
    .agg(F.max("dhash").alias("dhash"), F.count("*").alias("turns"), F.countDistinct("dhash").alias("hashes"))
)


def _turned(spark: SparkSession, d: str, side: int, turns: int) -> DataFrame:
    """Pictures of side x side pixels from the embeddings, in some of their eight turns and mirrorings (turn, p, n)."""
    return source.pictures(spark, d, side).crossJoin(F.broadcast(spark.range(turns).select(F.col("id").cast("int").alias("turn")))).withColumn("p", source.turned(F.col("p"), side, F.col("turn")))


# Sounds: an index of words' keys, whose votes align two prints
_SOUNDS = """own AS (SELECT vec_id AS id, vec_id % 7 * 1500 AS ms, list_transform(embedding, lambda x: floor((greatest(-1.0, least(0.9999::DOUBLE, x::DOUBLE)) + 1) * 2147483648.0::DOUBLE)::BIGINT) AS print FROM embeddings),
    s AS (SELECT * FROM own UNION ALL SELECT id + 1000000, ms + id % 3 * 900, list_transform(range(id % 5, 64), lambda k: CASE WHEN k % 10 = 0 THEN xor(print[k + 1], 3) ELSE print[k + 1] END) FROM own),
    {more}
    seat AS (SELECT id, ms, print[k + 1] >> 16 AS key, min(k) AS k FROM s, range(64) r(k) WHERE k < len(print) GROUP BY ALL),
    votes AS (SELECT a.id AS x, b.id AS y, a.k - b.k AS o, count(*) AS n FROM seat a JOIN seat b ON a.key = b.key AND (b.ms, b.id) > (a.ms, a.id) AND b.ms - a.ms <= 2000 GROUP BY ALL),
    tuned AS (SELECT x, y, arg_max(o, (n, -abs(o), -o)) AS o FROM votes GROUP BY x, y),
    off AS (SELECT x, y, o, least(len(a.print), len(b.print)) AS shorter, list_filter(list_transform(range(0, least(len(a.print) - greatest(o, 0), len(b.print) - greatest(-o, 0))), lambda k: bit_count(xor(a.print[k + 1 + greatest(o, 0)], b.print[k + 1 + greatest(-o, 0)]))), lambda w: w < 16) AS w
        FROM tuned JOIN s a ON a.id = x JOIN s b ON b.id = y),
    heard AS (SELECT x, y, o AS "offset", CASE WHEN len(w) > 0 AND len(w) >= shorter * 0.8 THEN (1 - list_sum(w) / len(w) / 32) * 100 ELSE 0 END::DOUBLE AS similarity FROM off)"""
query("sound_pairs", "WITH " + _SOUNDS.format(more="") + ' SELECT x, y, "offset", round(similarity, 9) AS similarity FROM heard')(
    lambda spark, d: sounds.sound_pairs(source.sounds(spark, d).withColumnRenamed("vec_id", "id")).withColumns({"offset": F.col("offset").cast("long"), "similarity": F.round("similarity", 9)})
)


def _kinds(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Live files, one row for each path on disk, as images, videos, documents and sounds by their ids; and those in English."""
    placed = _placed(spark, d).withColumn("id", F.col("doc_id") * 8 + F.col("repo_ord"))
    of = lambda rest, prints, vec: placed.where(rest).withColumn("vec_id", F.expr(vec)).join(prints, "vec_id")
    late = "CASE WHEN doc_id % 8 >= 4 THEN doc_id - 4 + 1000000 ELSE doc_id END"
    texts = source.table(spark, d, "documents").select("doc_id", scalars.text_hash(F.col("text")).alias("identity"))
    images = of("doc_id % 4 = 0", source.prints_512(spark, d), "doc_id").select("id", "bands")
    videos = of("doc_id % 4 = 1", source.prints_1536(spark, d), late).select("id", "bands")
    heard = of("doc_id % 4 = 3", source.sounds(spark, d), late).select("id", "ms", "print")
    return placed, images, videos, placed.where("doc_id % 4 = 2").join(texts, "doc_id").select("id", "identity"), heard, placed.where("rel_path LIKE '%en/%'").select("id")


def _similar_files(spark: SparkSession, d: str) -> DataFrame:
    files, images, videos, documents, heard, english = _kinds(spark, d)
    return sounds.similar_files(files, 93.0, images, videos, documents, heard, english)


#: One order of nodes for all kinds: the kind, for sounds the duration, then the id.
_PLACES = 10_000_000_000_000
query(
    "similar_files",
    "WITH RECURSIVE "
    + _FILES
    + _PLACED
    + """, f AS (SELECT *, doc_id * 8 + repo_ord AS id, CASE WHEN doc_id % 8 >= 4 THEN doc_id - 4 + 1000000 ELSE doc_id END AS late FROM placed), """
    + _512.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 4 = 0)").replace("pairs AS", "pairs5 AS").replace("c AS (", "c5 AS (").replace("FROM c JOIN", "FROM c5 c JOIN").replace("x AS (", "x5 AS (").replace("FROM x, lv", "FROM x5 x, lv").replace("w AS (", "w5 AS (").replace("FROM w a JOIN w b", "FROM w5 a JOIN w5 b").replace("JOIN w x ON", "JOIN w5 x ON").replace("JOIN w y ON", "JOIN w5 y ON")
    + ", "
    + _1536
    + ", "
    + _SOUNDS.format(more="").replace("s AS (SELECT * FROM own", "s AS (SELECT * FROM own", 1)
    + f""", heard_of AS (SELECT f.id, s.ms FROM f JOIN s ON s.id = f.late WHERE doc_id % 4 = 3),
    node AS (SELECT f.id, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'document' ELSE 'audio' END AS kind, CASE doc_id % 4 WHEN 0 THEN doc_id WHEN 2 THEN doc_id ELSE late END AS vec,
        (doc_id % 4) * {_PLACES} + coalesce(h.ms, 0) * 10000000 + f.id AS v FROM f LEFT JOIN heard_of h ON h.id = f.id),
    near AS (SELECT 'image' AS kind, a, b FROM pairs5 WHERE similarity >= 93 UNION ALL SELECT 'image', vec_id, vec_id FROM embeddings UNION ALL SELECT 'video', a, b FROM pairs WHERE similarity >= 93 UNION ALL SELECT 'video', vec_id, vec_id FROM w
        UNION ALL SELECT 'audio', x, y FROM heard WHERE similarity >= 93 UNION ALL SELECT 'audio', id, id FROM s
        UNION ALL SELECT 'document', a.doc_id, b.doc_id FROM documents a JOIN documents b ON lower(regexp_replace(a.text, '\\s+', '', 'g')) = lower(regexp_replace(b.text, '\\s+', '', 'g')) WHERE a.doc_id % 4 = 2 AND b.doc_id % 4 = 2 AND regexp_replace(a.text, '\\s+', '', 'g') <> ''),
    p AS (SELECT DISTINCT least(i.v, j.v) AS a, greatest(i.v, j.v) AS b FROM near JOIN node i ON i.vec = near.a AND i.kind = near.kind JOIN node j ON j.vec = near.b AND j.kind = near.kind WHERE i.v <> j.v),
    n AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, (SELECT coalesce(list(a), []) FROM p WHERE b = v) AS before FROM (SELECT a AS v FROM p UNION SELECT b FROM p)),
    st(rn, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.rn, CASE WHEN list_has_any(st.leaders, n.before) THEN st.leaders ELSE list_append(st.leaders, n.v) END FROM st JOIN n ON n.rn = st.rn + 1),
    l AS (SELECT leaders FROM st ORDER BY rn DESC LIMIT 1), g0 AS (SELECT v, coalesce(list_min(list_intersect(before, leaders)), v) AS lead FROM n, l),
    g AS (SELECT a.kind, b.id AS leader, a.id AS member FROM g0 JOIN node a ON a.v = g0.v JOIN node b ON b.v = g0.lead WHERE lead IN (SELECT lead FROM g0 GROUP BY lead HAVING count(*) > 1)),
    r AS (SELECT g.*, f.rel_path, size, row_number() OVER (PARTITION BY kind, leader ORDER BY coalesce(img_w * img_h, -1) DESC, (taken_ms IS NOT NULL OR camera IS NOT NULL) DESC, taken_ms IS NULL, taken_ms, modified_ms, lower(rel_path), repo_ord, rel_path, id) = 1 AS best FROM g JOIN f ON f.id = member),
    t AS (SELECT kind, leader, sum(size) FILTER (NOT best)::BIGINT AS wasted FROM r GROUP BY ALL HAVING bool_or(rel_path LIKE '%en/%')),
    pl AS (SELECT *, row_number() OVER (ORDER BY wasted DESC, kind, leader) AS place FROM t)
    SELECT place, kind, leader, member, best, wasted FROM r JOIN pl USING (kind, leader)""",
)(_similar_files)
