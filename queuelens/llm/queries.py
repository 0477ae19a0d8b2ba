"""One registered query for each operator, with production parameters over its whole table, and its SQL if there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from queuelens.llm import alignment, divergence, embed_dedup, exact_dedup, langid, line_dedup, mixing, packing, pitman_yor, quality, sharding, simhash, url_filters
from queuelens.session import scratch_path

QUERIES, ORACLES = {}, {}

#: The rank file of the vocabulary of byte_bpe_50k.json: the same ids, several times as fast.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 24


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_url_filters", """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1, 's') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM parts
), hosts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split
), rules(host, path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT h.page_id, h.host, h.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
  FROM hosts h LEFT JOIN rules r ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path)
  GROUP BY h.page_id, h.host, h.path
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM hosts h JOIN fits f USING (page_id, host, path)
""")  # fmt: skip
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf, "pages"), url_filters.rule_table(spark))


@query("op2_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), TOKENIZER)


@query("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(table(spark, sf, "documents"))


@query("op4_mixing", """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sources
), capped AS (
  SELECT *, (source_size * 2)::DOUBLE AS cap, (source_size * 2)::DOUBLE / weight AS ratio FROM weighted
), ranked AS (
  SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open,
    sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0) AS rest
  FROM capped WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN rest / open <= ratio THEN rest / open END) OVER () * weight, cap)) AS target FROM ranked
), ordered AS (
  SELECT s.*, t.source_size, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS UNBOUNDED PRECEDING) AS run,
    row_number() OVER () AS uid
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT uid, source, key, size, copy, (run + source_size * copy) / target AS finish FROM ordered, (VALUES (0), (1)) c(copy) WHERE size > 0
), placed AS (
  SELECT uid, sum(size) OVER (ORDER BY finish, source NULLS FIRST, key, size, copy ROWS UNBOUNDED PRECEDING) AS position FROM copies
), taken AS (
  SELECT uid, count(*) AS n FROM placed WHERE position <= (SELECT sum(source_size) * 1.5::DOUBLE FROM targets) GROUP BY uid
)
SELECT doc_id, size::BIGINT AS size, source, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken FROM ordered LEFT JOIN taken USING (uid)
""")  # fmt: skip
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf, "documents"))


@query("op5_quality")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("text_hash")


@query("op6_embedding_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf, "embeddings"))


@query("op7_exact_dedup", """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  (doc_id IS NOT DISTINCT FROM max(doc_id) OVER same) AND row_number() OVER (PARTITION BY text, doc_id) = 1 AS kept, sha256(text) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY text)
""")  # fmt: skip
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf, "documents")).withColumnRenamed("digest", "text_sha256")


@query("op8_line_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document: its lines, how many were dropped, and the digest of the text that stays."""
    cleaned = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op9_sharding")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf, "documents"), SHARDS, map_path=scratch_path(spark, "shard-map"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@query("op10_simhash_dedup")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op11_source_divergence", """
WITH rows AS (
  SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), words AS (
  SELECT uid, lang, source, unnest(terms) AS term FROM rows
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT uid) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang
), cells AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, l.total AS lang_total, l.v
  FROM (SELECT DISTINCT lang, source FROM rows) g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v)::HUGEINT AS q FROM cells
), pairs AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value
  FROM (SELECT DISTINCT a.lang, a.source, b.source AS item FROM rows a JOIN rows b ON a.lang = b.lang AND a.source <> b.source)
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) USING (lang, source, item)
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""")  # fmt: skip
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergences(table(spark, sf, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"), TOKENIZER, PIECES)


@query("op12_lm_scoring")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return pitman_yor.score_corpus(table(spark, sf, "documents"))
