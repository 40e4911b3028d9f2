"""The queries of the corpus operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer

from . import ann, bpe, exact_dedup, mixing, repair, simhash, suffix_dedup, token_counts, toxicity, url_filter

RANKS, LIBRARY = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"
#: The end-of-document id of the library model's vocabulary, which no ordinary text has.
END_OF_DOCUMENT = 50256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents")).drop("text_xxh64")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer(LIBRARY), END_OF_DOCUMENT)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer(RANKS))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(_table(spark, sf_dir, "documents"), tokenizer(LIBRARY))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(_table(spark, sf_dir, "documents")), size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_nearest_neighbours": op1,
    "op2_exact_dedup": op2,
    "op3_toxicity": op3,
    "op4_token_counts": op4,
    "op5_byte_bpe": op5,
    "op6_token_files": op6,
    "op7_substring_dedup": op7,
    "op8_near_dedup": op8,
    "op9_mixing": op9,
    "op10_url_filter": op10,
    "pipeline": pipeline,
}

_OP2 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 5) AS class FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3.0::DOUBLE AS cap,
             [1.0::DOUBLE, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT first(level ORDER BY cap / weight, source NULLS LAST) AS shared FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN shared IS NULL THEN cap ELSE least(cap, shared * weight) END AS target,
             ('0x' || substr(md5('/' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l CROSS JOIN f),
r AS (SELECT c.doc_id, c.size, t.source_size, t.target, t.u,
             CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY c.source ORDER BY c.class, substr(c.h, 1, 2), c.h, c.size) AS k
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(floor(k * rate + u) - floor((k - 1) * rate + u), 3) * size)::BIGINT AS taken FROM r
"""

_OP10 = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT p.page_id, p.host, p.path, r.h || r.q AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h || r.q) DESC, length(r.h) DESC) AS k
      FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

ORACLES = {"op2_exact_dedup": _OP2, "op9_mixing": _OP9, "op10_url_filter": _OP10}
