"""Queries that apply each operator to its whole table, and their DuckDB twins where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm import alignment, chat, decontaminate, packing, quality_model, quality_rules, repeats, shards, simhash, spelling, stats, token_counts, urls, warc
from wayfind.llm.shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> tuple[str, str]:
    """Where the 50k byte-level vocabulary lies, as ranks, and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_bytes=50, keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of op2_quality_rules and its base rules alone."""
    found = stats.with_stats(_table(spark, sf_dir, "documents"))
    return found.withColumn("base_failed", quality_rules.base_failed())


WORD = r"[^\x20\x09-\x0D]"
RULES_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
tokens AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
grams AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS g FROM tokens WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
numbers AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN again a ON a.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM numbers
"""


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_table(spark, sf_dir, "documents"), n_shards=24)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = rf"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
judged AS (
  SELECT p.page_id, p.host, p.path,
         (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)) AS rule
  FROM parts p)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce((SELECT r.verdict FROM rules r WHERE r.host || r.path = j.rule),
                CASE WHEN regexp_matches(j.host || j.path, '^(?:[^/]*\.)?spam-[a-z0-9-]+\.') OR regexp_matches(j.host || j.path, '(?:^|[./_-])(?:{'|'.join(urls.WORDS)})(?:[./_-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j
"""


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(_table(spark, sf_dir, "documents"), *byte_bpe(), room=2048)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    chats = chat.format_chats(turns.unionByName(own))
    read = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumns({"read": read, "under": loss}).select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), bits=2)


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for c in chat.DEFAULT.controls:
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


OP9_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length({_escaped("text")}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20 + length({_escaped("role")}) END AS chars,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before IS NULL
                          WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                          WHEN 'assistant' THEN before IS NOT NULL AND before = 'user' ELSE false END)
         AND bool_or(after IS NULL AND role = 'assistant') AS valid
FROM sized GROUP BY conv_id
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = warc.archive_pages(pages, f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}")
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast(pages.schema["page_id"].dataType)
    return found.select(number("page_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.score_links(_table(spark, sf_dir, "documents"), *byte_bpe(), public_tokenizers.path("piece_bpe_32k.model"))


OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
heads AS (SELECT html, max(page_id) AS head FROM p GROUP BY 1),
bits AS (SELECT page_id, hex, (SELECT string_agg(right('0000' || bin(instr('0123456789ABCDEF', hex[k]) - 1), 4), '' ORDER BY k) FROM range(1, 41) r(k)) AS b FROM p),
digests AS (SELECT page_id, (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform([16, 8, 4, 2, 1], lambda w, i: w * b[5 * k + i]::INT))::INT], '' ORDER BY k) FROM range(0, 32) r(k)) AS payload_digest FROM bits)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, d.payload_digest, CASE WHEN p.page_id = h.head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> h.head THEN h.head END AS refers_to
FROM p JOIN heads h ON h.html = p.html JOIN digests d ON d.page_id = p.page_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_repeats, op2_quality_rules, op3_shards, op4_url_filter, op5_pack, op6_decontaminate, op7_token_counts, op8_quality_model, op9_chat_format, op10_simhash, op11_spelling, op12_warc, op13_alignment, rule_statistics)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op9_chat_format": OP9_SQL, "op12_warc": OP12_SQL, "rule_statistics": RULES_SQL}
