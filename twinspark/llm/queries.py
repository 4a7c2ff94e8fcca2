"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.llm import chat_format, cover_search, exact_dedup, fill_middle, fingerprints, lm_score, ngram_join, packing, piece_codec, quality, suffix_dedup, toxicity, turn_repair
from twinspark.llm.shared import read_table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain dialogue of `conversations` as calls (a user's turn, which needs the one before) and results (the next assistant's)."""
    return chat_format.format_chat(chat_format.dialogue_turns(read_table(spark, sf_dir, "conversations")), chat_format.DIALOGUE_SCHEMAS, needs=True).drop("in_cycle")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read_table(spark, sf_dir, "documents"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packer()(read_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), digest=True)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lm_score.sampled_out("doc_id", 5, 0)
    scored = quality.score_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(read_table(spark, sf_dir, "documents"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose fingerprints are alike: the banding and verification of op7's operator."""
    return fingerprints.near_documents(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lm_score.sampled_out("doc_id", 3, 1)
    scored = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.transform("evidence", lambda e: e["doc_id"]).alias("evidence"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_passages(read_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"), ~lm_score.sampled_out("doc_id", 7, 2), public_tokenizers.path("piece_bpe_32k.model"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_conversations(turn_repair.damaged(read_table(spark, sf_dir, "conversations")))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(f"{name}_sha256") for name, c in (("output", F.col("output")), ("restored", fill_middle.restored(F.col("output"), F.col("form"))))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_inner_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_join": op2_ngram_join,
    "op3_piece_codec": op3_piece_codec,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "fingerprint_classes": fingerprint_classes,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_turn_repair": op11_turn_repair,
    "op12_fill_middle": op12_fill_middle,
    "op13_cover_search": op13_cover_search,
}

ORACLE_SQL = {
    "op1_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, role, text,
                   CASE WHEN role = 'user' THEN coalesce(conv_id::VARCHAR, '') || ':' || turn::VARCHAR END AS call_id,
                   CASE WHEN role = 'assistant' THEN coalesce(conv_id::VARCHAR, '') || ':' || (turn - 1)::VARCHAR END AS result_of,
                   len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
            FROM conversations),
        c AS (SELECT conv_id AS of_conv, call_id AS of_call, min(turn) AS call_turn, count(*) AS n FROM t WHERE call_id IS NOT NULL GROUP BY ALL),
        g AS (SELECT *, call_turn - 2 * row_number() OVER (PARTITION BY of_conv, call_turn & 1 ORDER BY call_turn) AS chain FROM c),
        v AS (SELECT of_conv AS v_conv, of_call AS v_call, row_number() OVER (PARTITION BY of_conv, call_turn & 1, chain ORDER BY call_turn) - 1 AS level FROM g)
        SELECT t.conv_id, t.turn, t.role, t.call_id, t.result_of,
               CASE WHEN t.call_id IS NULL AND t.result_of IS NOT NULL THEN c.of_call IS NOT NULL END AS linked,
               c.call_turn, coalesce(c.n, 0) AS same_id_calls,
               CASE WHEN t.call_id IS NOT NULL THEN t.text IS NOT NULL AND t.words >= 1 END AS valid_arguments,
               coalesce(c.call_turn, t.turn) AS order_turn, coalesce(v.level, 0)::BIGINT AS order_level,
               CASE WHEN t.result_of IS NOT NULL AND c.of_call IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS order_step,
               '{' || array_to_string(list_filter([
                   '"content":' || to_json(t.text)::VARCHAR,
                   '"role":' || to_json(t.role)::VARCHAR,
                   CASE WHEN c.of_call IS NOT NULL THEN '"tool_call_id":' || to_json(t.result_of)::VARCHAR END,
                   CASE WHEN t.call_id IS NOT NULL THEN '"tool_calls":[{"arguments":{' || coalesce('"prompt":' || to_json(t.text)::VARCHAR || ',', '')
                       || '"words":' || t.words || '},"id":' || to_json(t.call_id)::VARCHAR || ',"name":"reply"}]' END,
                   '"turn":' || t.turn], lambda x: x IS NOT NULL), ',') || '}' AS json
        FROM t LEFT JOIN c ON t.conv_id IS NOT DISTINCT FROM c.of_conv AND coalesce(t.call_id, t.result_of) = c.of_call
        LEFT JOIN v ON c.of_conv IS NOT DISTINCT FROM v.v_conv AND c.of_call = v.v_call
    """,
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(length(text), 0) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        r AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
    """,
    "op12_fill_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents),
        u AS (SELECT *, len(tokens)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS w FROM t),
        v AS (
            SELECT *, least(w[1] % (n + 1), w[2] % (n + 1)) AS a, greatest(w[1] % (n + 1), w[2] % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR w[3] % 100 >= 90 THEN 'plain'
                        WHEN w[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM u),
        p AS (
            SELECT doc_id, n, form, text, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle,
                   coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix
            FROM v)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_cover_search": r"""
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.r AS q, q.vec_id AS query_id, c.r, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.r <> c.r AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r)::INT AS rank FROM s)
        WHERE rank <= 5
    """,
}
