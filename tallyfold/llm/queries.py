"""The operators' queries over the standard tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontam, exact, licenses, minhash, packing, pii, quality, sharding, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def judged(scored: DataFrame, modulus: int, held: int, threshold: float) -> DataFrame:
    out = F.crc32(F.col("doc_id").cast("string")) % modulus == held
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(documents(spark, sf_dir)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 4, 2, toxicity.THRESHOLD)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judged(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 5, 0, quality.THRESHOLD)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "reason")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(sharding.shard(documents(spark, sf_dir)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decide(documents(spark, sf_dir))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_packing, op2_decontamination, op3_pii, op4_toxicity, op5_quality, op6_url_filter, op7_minhash, op8_sharding, op9_exact_dedup, op10_licenses)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _url_sql() -> str:
    """Every rule on every URL, in order."""

    def first(rules, value: str) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches(host || path, '{r.pattern}') THEN '{getattr(r, value)}'" for r in rules) + " END"

    base, extra = sorted(urlfilter.base_rules(), key=lambda r: (-len(r.name), r.name)), urlfilter.default_rules()
    return rf"""
WITH r AS (SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://((?s).*)$', 1), '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, {first(base, "name")} AS rule, {first(base, "verdict")} AS v, {first(extra, "name")} AS x, {first(extra, "verdict")} AS w FROM p)
SELECT page_id, host, path, rule, coalesce(v, w, 'allow') AS verdict, CASE WHEN rule IS NULL THEN x END AS reason FROM j
"""


ORACLE_SQL = {
    "op6_url_filter": _url_sql(),
    "op2_decontamination": rf"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, list_slice(ws, pos, pos + least(len(ws), 13) - 1) AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS pos FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, pos, list_slice(ws, pos, pos + n - 1) AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS pos FROM docs, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, p.n, pos, item_id FROM places p JOIN windows x ON p.n = x.n AND p.w = x.w),
words AS (SELECT doc_id, count(DISTINCT pos + k) AS n_hit FROM hits, range(0, 13) r(k) WHERE k < n GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOW} AS low FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(low) AS text_sha256
FROM t WINDOW w AS (PARTITION BY low)
""",
}
