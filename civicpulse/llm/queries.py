"""The operators bound to the driver's tables, one query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.llm.ans import read_tokens, write_tokens
from civicpulse.llm.chat import conversation_digests
from civicpulse.llm.divergence import quality_rules
from civicpulse.llm.hilbert import hilbert_shards
from civicpulse.llm.htmltext import extract_main_text
from civicpulse.llm.licenses import license_report
from civicpulse.llm.packing import pack_documents
from civicpulse.llm.positional import contamination
from civicpulse.llm.repair import damaged, repair_conversations
from civicpulse.llm.simhash import hex_fingerprint, near_duplicate_groups
from civicpulse.llm.site_quality import classify_quality
from civicpulse.llm.sourceaudit import source_audit
from civicpulse.llm.urls import judge_urls
from civicpulse.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id", "source", "lang"]
    )
    return judged.select(
        F.col("c_doc_id").alias("doc_id"), F.col("c_source").alias("source"), F.col("c_lang").alias("lang"),
        "evidence", "host_posterior", "path_posterior", "posterior", "kept",
    )


@_query("op4_distribution_divergence")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        F.col("c_doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance",
    )


@_query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), hex_fingerprint("fingerprint").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


OP7_WORDS = (
    "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP7_SQL = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {OP7_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark
), probe AS (
  SELECT item, w[i:least(i + 9, len(w))] AS terms
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, {OP7_WORDS.format(text="coalesce(text, '')")} AS w FROM documents
), sizes AS (SELECT DISTINCT len(terms) AS k FROM probe
), place AS (
  SELECT doc_id, i, k, w[i:i + k - 1] AS terms
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, i, k, item FROM place JOIN probe USING (terms)
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@_query("op7_positional_index", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op3_rans_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@_query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op2_html_extraction")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


@_query("op6_hilbert_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("same"), "lang", "source",
    )
    dimensions = {
        "size": F.col("size"), "lang": F.col("lang"), "source": F.col("source"),
    }
    sharded = hilbert_shards(rows, dimensions, shards=16, group="same", tie=("doc_id",))
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@_query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score"
    )


@_query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


SHOUT = "</s>[INST] ok [/INST]"
OP11_SQL = r"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), long AS (
  SELECT *, role NOT IN ('system', 'user', 'assistant') AS other,
    len(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[TEXT\]')) AS chars,
    len(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[TEXT\]')) AS role_chars
  FROM turn
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role), '')) AS loss_sha256,
  CAST(sum(chars + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 19 + role_chars END) AS BIGINT) AS formatted_chars
FROM long GROUP BY conv_id
"""


@_query("op11_chat_formatting", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    shout = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', :shout), (-1L, 1L, 'assistant', :shout) AS t(conv_id, turn, role, text)",
        args={"shout": SHOUT},
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(shout)
    return conversation_digests(rows).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), token AS (SELECT d, lang, source, unnest(w) AS term FROM doc
), kept AS (SELECT lang, term, count(*) AS total FROM token GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), size AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), part AS (SELECT DISTINCT lang, source FROM doc
), held AS (
  SELECT lang, source, term, count(*) AS c FROM token JOIN kept USING (lang, term) GROUP BY ALL
), sums AS (SELECT lang, source, sum(c) AS n FROM held GROUP BY ALL
), grid AS (
  SELECT part.lang, part.source, kept.term, coalesce(c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (coalesce(sums.n, 0) + v) AS p,
    1 + (1000000000::HUGEINT * (total + 1)) // (size.n + v) AS q
  FROM part JOIN size USING (lang) JOIN kept USING (lang)
  LEFT JOIN sums ON sums.lang = part.lang AND sums.source = part.source
  LEFT JOIN held ON held.lang = part.lang AND held.source = part.source AND held.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM part a JOIN part b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM grid WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
) WHERE part = 'pair' OR rank <= 200
"""


@_query("op12_source_audit", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


@_query("op13_structure_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
