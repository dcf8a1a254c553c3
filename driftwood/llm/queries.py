"""The ten operators over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm import bpe, chat_format, exact_dedup, language_id, line_dedup, lm_scoring, media, mixing, simhash, token_counts
from driftwood.llm.common import held_out, table, written


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is: in ``$PUBLIC_TOKENIZERS``, or the installed package."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    model = language_id.train(docs.where("not held_out and lang is not null"))
    return language_id.predict(docs, model, keep=["doc_id", "held_out"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_format.derive_calls(table(spark, sf_dir, "conversations"))
    out = chat_format.format_calls(calls, results, chat_format.conversation_tools(spark))
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").alias("turn"), "call_id", F.col("name").alias("tool"), "ready", F.col("level").cast("long").alias("level"), "cyclic", "n_results",
        F.array_join("violations", ",").alias("violations"), F.sha2("message", 256).alias("message_sha256"), F.length("message").cast("long").alias("message_chars"),
    )


OP4_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, role, text, conv_id || ':' || turn AS call_id, coalesce(length(text), 0) AS size,
         CASE WHEN conv_id % 13 = 0 THEN 'ask' WHEN role = 'user' THEN 'answer' ELSE 'configure' END AS tool, turn // 2 % 2 = 1 AS odd
  FROM conversations WHERE role IN ('user', 'system')
), results AS (
  SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, arg_min(coalesce(to_json(text), 'null'), (turn, text)) AS result
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2
), edges AS (  -- a call and one it depends on
  SELECT a.conv_id, a.turn AS x, b.turn AS y FROM calls a JOIN calls b ON a.conv_id = b.conv_id AND a.role = 'user'
  WHERE (b.turn = a.turn - 2 AND (a.conv_id % 4 = 0 OR (a.conv_id % 4 = 2 AND a.odd)))
     OR (b.turn = a.turn + 2 AND (a.conv_id % 4 = 1 OR (a.conv_id % 4 IN (2, 3) AND NOT a.odd)))
), reach AS (SELECT * FROM edges UNION SELECT r.conv_id, r.x, e.y FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.x = r.y
), times AS (
  SELECT c.conv_id, c.turn, greatest(c.turn, coalesce(max(r.y), c.turn)) AS ready FROM calls c LEFT JOIN reach r ON r.conv_id = c.conv_id AND r.x = c.turn GROUP BY 1, 2
), tied AS (
  SELECT e.* FROM edges e JOIN times a ON a.conv_id = e.conv_id AND a.turn = e.x JOIN times b ON b.conv_id = e.conv_id AND b.turn = e.y WHERE a.ready = b.ready
), closed AS (SELECT * FROM tied UNION SELECT r.conv_id, r.x, e.y FROM closed r JOIN tied e ON e.conv_id = r.conv_id AND e.x = r.y
), circles AS (SELECT conv_id, x FROM closed WHERE x = y UNION SELECT r.conv_id, r.x FROM closed r JOIN closed c ON c.conv_id = r.conv_id AND c.x = c.y AND c.x = r.y
), paths AS (
  SELECT conv_id, x, y, 1::BIGINT AS steps FROM tied WHERE (conv_id, x) NOT IN (SELECT conv_id, x FROM circles)
  UNION SELECT p.conv_id, p.x, e.y, p.steps + 1 FROM paths p JOIN tied e ON e.conv_id = p.conv_id AND e.x = p.y
), levels AS (SELECT conv_id, x, max(steps) AS level FROM paths GROUP BY 1, 2
), args AS (
  SELECT *, CASE WHEN conv_id % 11 = 0 THEN NULL ELSE text END AS said, ['short', 'long', 'loud'][1 + size % 3] AS style,
         CASE WHEN size % 12 = 0 THEN '0' WHEN size % 12 = 10 THEN '1' WHEN size % 12 = 11 THEN '1.1' ELSE '0.' || (size % 12) END AS temperature FROM calls
), checked AS (
  SELECT a.*, t.ready, coalesce(r.n_results, 0) AS n_results, coalesce(r.result, 'null') AS result, c.x IS NOT NULL AS cyclic, CASE WHEN c.x IS NULL THEN coalesce(l.level, 0) END AS level,
         CASE WHEN a.conv_id % 17 = 0 THEN ['object:'] WHEN a.conv_id % 13 = 0 THEN ['tool:'] WHEN role = 'user' THEN [
           CASE WHEN style = 'loud' THEN 'enum:style' END, CASE WHEN length(said) < 25 THEN 'minLength:query' END, CASE WHEN a.turn < 1 AND a.conv_id % 7 <> 1 THEN 'minimum:turn' END,
           CASE WHEN said IS NULL THEN 'missing:query' END, CASE WHEN a.conv_id % 7 = 1 THEN 'type:turn' END, CASE WHEN a.conv_id % 5 = 0 THEN 'unknown:debug' END]
         ELSE [CASE WHEN size % 12 = 11 THEN 'maximum:temperature' END, CASE WHEN length(said) < 1 THEN 'minLength:instructions' END, CASE WHEN said IS NULL THEN 'missing:instructions' END,
           CASE WHEN a.conv_id % 5 = 0 THEN 'unknown:debug' END] END AS broken,
         CASE WHEN a.conv_id % 17 = 0 THEN to_json(to_json([text])::VARCHAR)::VARCHAR ELSE '{' || array_to_string(list_filter(CASE WHEN role = 'user' THEN [
           CASE WHEN a.conv_id % 5 = 0 THEN '"debug":true' END, '"query":' || to_json(said)::VARCHAR, '"style":"' || style || '"',
           '"turn":' || CASE WHEN a.conv_id % 7 = 1 THEN '"' || (a.turn - 1) || '"' ELSE (a.turn - 1)::VARCHAR END]
         ELSE [CASE WHEN a.conv_id % 5 = 0 THEN '"debug":true' END, '"instructions":' || to_json(said)::VARCHAR, '"temperature":' || temperature] END, lambda f: f IS NOT NULL), ',') || '}' END AS arguments
  FROM args a JOIN times t USING (conv_id, turn) LEFT JOIN results r USING (conv_id, turn)
  LEFT JOIN circles c ON c.conv_id = a.conv_id AND c.x = a.turn LEFT JOIN levels l ON l.conv_id = a.conv_id AND l.x = a.turn
), messages AS (
  SELECT *, array_to_string(list_filter(broken, lambda b: b IS NOT NULL), ',') AS violations,
         '{"arguments":' || arguments || ',"call_id":"' || call_id || '","name":"' || tool || '","result":' || result || ',"valid":' || CASE WHEN len(list_filter(broken, lambda b: b IS NOT NULL)) = 0 THEN 'true' ELSE 'false' END || '}' AS message FROM checked
)
SELECT conv_id, turn, call_id, tool, ready, level, cyclic, n_results, violations, sha256(message) AS message_sha256, length(message) AS message_chars FROM messages
"""


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight FROM by_source
), ranked AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_size,
         (sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_weight
  FROM weighted WINDOW fill AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, encode(source))
), stopped AS (SELECT *, 3 * source_size * rest_weight <= weight * rest_size AS stops FROM ranked
), targets AS (
  SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE
         ELSE (weight * max(CASE WHEN NOT stops THEN rest_size END) OVER ())::DOUBLE / (max(CASE WHEN NOT stops THEN rest_weight END) OVER ())::DOUBLE END AS target FROM stopped
), rates AS (SELECT *, least(3.0::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rates s ON d.source IS NOT DISTINCT FROM s.source
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), marked AS (SELECT k.*, r.last IS NOT NULL AND r.last IS DISTINCT FROM k.doc_id AS dropped FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"], decoded_col="decoded")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams are written to the shared folder, and what is read from there is decoded."""
    stored = media.store(table(spark, sf_dir, "documents"), keep=["doc_id"])
    stored = written(stored.select("doc_id", "n_bytes", "media"))
    stored = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    back = media.read_back(stored, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return back.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), media.tail_crc32("pcm").alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature",
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, ~held_out("doc_id", 7))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_language_id, op3_simhash, op4_chat_format, op5_mix_sources, op6_line_dedup, op7_exact_dedup, op8_bpe, op9_media, op10_lm_scores)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op5_mix_sources": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_exact_dedup": OP7_SQL}
