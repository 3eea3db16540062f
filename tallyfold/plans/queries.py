"""The operators over the standard tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.dates import parse_date
from tallyfold.functions.decimals import TYPE, evidence, format_decimal, parse_decimal
from tallyfold.functions.text import norm_key
from tallyfold.operators import hierarchy, infer, keys, reconcile
from tallyfold.operators.reconcile import Mapping
from tallyfold.plans import surface

KEY, AMOUNT = Mapping("key", 0, "order", "order", "raw"), Mapping("compare", 0, "amount", "amount")
L0, L1 = Mapping("key", 0, "l_orderkey", "l_orderkey", "raw"), Mapping("key", 1, "l_linenumber", "l_linenumber", "raw")
PRICE = Mapping("compare", 0, "l_extendedprice", "l_extendedprice")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str):
    return F.col(c).cast("decimal(18,2)").cast(TYPE)


def orders_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), money("o_totalprice").alias("amount"))
    return a, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), money("l_extendedprice").alias("amount"))


def perturbed_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money("l_extendedprice").alias("l_extendedprice"))
    b = li.filter("l_orderkey % 97 <> 0").withColumn("l_extendedprice", (F.col("l_extendedprice") + F.when(F.col("l_partkey") % 101 == 0, 10).otherwise(0)).cast(TYPE))
    return li.filter("l_orderkey % 89 <> 0"), b


def recon_orders_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Every order: its price against the sum of its lines."""
    f = reconcile.reconcile(*orders_sides(spark, d), [KEY, AMOUNT], all_buckets=True)
    return f.select("key_json", "bucket", F.col("value_a").cast("double").alias("value_a"), F.col("value_b").cast("double").alias("value_b"), F.col("delta").cast("double").alias("delta"), "rows_a", "rows_b", "severity")


def perturbed(spark: SparkSession, d: str, all_buckets: bool = False) -> DataFrame:
    return reconcile.reconcile(*perturbed_sides(spark, d), [L0, L1, PRICE], all_buckets=all_buckets)


def recon_levels(spark: SparkSession, d: str) -> DataFrame:
    f = perturbed(spark, d)
    return f.select("level", "bucket", "key_json", "parent_json", F.col("delta").cast("double").alias("delta"), "rows_a", "rows_b", "severity")


def recon_level_stats(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.level_stats(perturbed(spark, d, True))


def recon_lineage(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.withColumn("src_row", F.col("l_linenumber").cast("long")) for x in perturbed_sides(spark, d))
    f = reconcile.reconcile(a, b, [L0, PRICE], lineage=True)
    return f.select("key_json", "bucket", F.array_join("lineage_a", ",").alias("lineage_a"), F.array_join("lineage_b", ",").alias("lineage_b"))


def recon_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Deltas on either side of the tolerance and on it."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("order"), money("o_totalprice").alias("amount"))
    b = a.withColumn("amount", (F.col("amount") + F.when(F.col("order") % 3 == 0, F.lit("0.01").cast(TYPE)).when(F.col("order") % 3 == 1, F.lit("0.010001").cast(TYPE)).otherwise(0)).cast(TYPE))
    f = reconcile.reconcile(a, b, [KEY, AMOUNT], all_buckets=True)
    return f.select("key_json", "bucket", F.col("delta").cast("double").alias("delta"))


def m2m_pairs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.m2m_pairs(*perturbed_sides(spark, d), [Mapping("key", 0, "l_suppkey", "l_suppkey", "raw")]).select(F.col("k0").alias("supplier"), "rows_a", "rows_b", F.col("pairs").cast("long").alias("pairs"))


FD = {
    "fd_nation": (("n_nationkey", "n_name", "n_regionkey"), "nation"),
    "fd_part": (("p_brand", "p_type", "p_size"), "part"),
    "fd_customer": (("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "customer"),
    "fd_lineitem": (("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"), "lineitem"),
}


def _pairs(names: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(p, c) for p in names for c in names if p != c]


def fd_query(name: str):
    columns, source = FD[name]
    return lambda spark, d: hierarchy.fd_matrix(table(spark, d, source), _pairs(columns)).select("parent", "child", "total", "violating", F.round(1 - F.col("violating") / F.col("total"), 3).alias("consistency"))


def fd_sql(name: str) -> str:
    columns, source = FD[name]
    part = "SELECT '{p}' AS parent, '{c}' AS child, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS BIGINT) AS violating FROM (SELECT {c}, count({p}) AS n, count(DISTINCT {p}) AS k FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})"
    return "SELECT *, round(1 - violating / total, 3) AS consistency FROM (" + " UNION ALL ".join(part.format(p=p, c=c, t=source) for p, c in _pairs(columns)) + ")"


STATS = {"col_stats_orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), "col_stats_events": ("events", ["event_id", "user_id", "event_type", "props"])}


def stats_query(name: str):
    source, columns = STATS[name]
    return lambda spark, d: infer.column_stats(table(spark, d, source), columns)


def stats_sql(name: str) -> str:
    source, columns = STATS[name]
    return " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM {source}" for c in columns)


def top_values(spark: SparkSession, d: str) -> DataFrame:
    return infer.top_values(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = keys.overlaps(table(spark, d, "orders"), table(spark, d, "customer"), ["o_custkey", "o_orderkey"], ["c_custkey", "c_nationkey"])
    ua, ub = F.col("distinct_a") / F.col("rows_a"), F.col("distinct_b") / F.col("rows_b")
    overlap = F.col("common") / F.least("distinct_a", "distinct_b")
    return o.select("col_a", "col_b", F.round(ua, 3).alias("unique_a"), F.round(ub, 3).alias("unique_b"), F.round(overlap, 3).alias("overlap"), F.round(overlap * F.sqrt(ua * ub), 3).alias("rank"))


def norm_keys(spark: SparkSession, d: str) -> DataFrame:
    code = F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    return table(spark, d, "customer").select("c_custkey", norm_key(F.col("c_name")).alias("name"), norm_key(code).alias("code"), norm_key(code, "raw").alias("raw"))


def decimal_parse(spark: SparkSession, d: str) -> DataFrame:
    """Prices written the standard and the Greek way, and read again."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    standard = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "(").otherwise(""), F.format_number(price, 2), F.when(F.col("o_orderkey") % 2 == 0, ")").otherwise(""))
    greek = F.concat(F.translate(F.format_number(price, 2), ",.", ".,"), F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", format_decimal(parse_decimal(standard)).alias("standard"), format_decimal(parse_decimal(greek, "greek")).alias("greek"))


def dates_day_first(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("o_orderdate", "d/M/yyyy")
    bad = F.concat(F.lit("31/2/"), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", parse_date(text).cast("string").alias("iso"), parse_date(bad).cast("string").alias("none"))


def number_evidence(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "orders").select(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("t"))
    g, s, sep = evidence(F.col("t"))
    return text.agg(g.alias("greek"), s.alias("standard"), sep.alias("separators"))


def infer_types(spark: SparkSession, d: str) -> DataFrame:
    names = ["event_id", "event_type", "value", "day", "code"]
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("value").cast("decimal(18,2)").cast("string").alias("value"), F.date_format("ts", "dd.MM.yyyy").alias("day"), F.lpad(F.col("user_id").cast("string"), 12, "0").alias("code"))
    return spark.createDataFrame([(c.name, c.type) for c in infer.infer(infer.trimmed(e, names), names)], "col string, type string")


_ONE = """SELECT {k} AS k, {json} AS key_json, va AS value_a, vb AS value_b, coalesce(ra, 0) AS rows_a, coalesce(rb, 0) AS rows_b,
  CASE WHEN rb IS NULL THEN va WHEN ra IS NULL THEN -vb ELSE va - vb END AS delta,
  CASE WHEN rb IS NULL THEN 'ONLY_A' WHEN ra IS NULL THEN 'ONLY_B' WHEN abs(va - vb) <= 0.01 THEN 'MATCH' ELSE 'DIFFER' END AS bucket
FROM (SELECT {g}, sum(v) AS va, count(*) AS ra FROM {a} GROUP BY ALL) x FULL JOIN (SELECT {g}, sum(v) AS vb, count(*) AS rb FROM {b} GROUP BY ALL) y USING ({g})"""
_SEVERITY = "CASE WHEN bucket = 'MATCH' THEN NULL WHEN bucket <> 'DIFFER' OR abs(delta) >= 10 THEN 'high' ELSE 'medium' END"
_PERTURBED = """WITH li AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey, l_suppkey AS s, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem),
a AS (SELECT * FROM li WHERE o % 89 <> 0),
b AS (SELECT o, l, s, v + CASE WHEN l_partkey % 101 = 0 THEN 10 ELSE 0 END AS v FROM li WHERE o % 97 <> 0),
"""
_J0, _J1 = """'{"l_orderkey":"' || o || '"}'""", """'{"l_orderkey":"' || o || '","l_linenumber":"' || l || '"}'"""
_LEVELS = _PERTURBED + "l0 AS (" + _ONE.format(k="o", json=_J0, g="o", a="a", b="b") + "),\nl1 AS (SELECT f.*, p.key_json AS parent_json FROM (" + _ONE.format(k="o", json=_J1, g="o, l", a="a", b="b") + ") f JOIN l0 p ON f.k = p.k AND p.bucket = 'DIFFER')"

QUERIES = {
    "recon_orders_lineitem": recon_orders_lineitem,
    "recon_levels": recon_levels,
    "recon_level_stats": recon_level_stats,
    "recon_lineage": recon_lineage,
    "recon_tolerance": recon_tolerance,
    "m2m_pairs": m2m_pairs,
    **{n: fd_query(n) for n in FD},
    **{n: stats_query(n) for n in STATS},
    "top_values": top_values,
    "key_overlap": key_overlap,
    "norm_keys": norm_keys,
    "decimal_parse": decimal_parse,
    "dates_day_first": dates_day_first,
    "number_evidence": number_evidence,
    "infer_types": infer_types,
    **surface.QUERIES,
}

_TYPED = "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders"
_STRIP = "regexp_replace(CAST({} AS VARCHAR), '\\.?0+$', '')"
_TOP = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, count(*) AS freq FROM part GROUP BY {c}" for c in ("p_name", "p_brand", "p_type"))
_SET = " UNION ALL ".join("SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY {c}".format(c=c, t=t) for c, t in (("o_custkey", "orders"), ("o_orderkey", "orders"), ("c_custkey", "customer"), ("c_nationkey", "customer")))

ORACLE_SQL = {
    "recon_orders_lineitem": "WITH a AS (SELECT o_orderkey AS o, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders), b AS (SELECT l_orderkey AS o, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem), f AS ("
    + _ONE.format(k="o", json="""'{"order":"' || o || '"}'""", g="o", a="a", b="b")
    + f") SELECT key_json, bucket, CAST(value_a AS DOUBLE) AS value_a, CAST(value_b AS DOUBLE) AS value_b, CAST(delta AS DOUBLE) AS delta, rows_a, rows_b, {_SEVERITY} AS severity FROM f",
    "recon_levels": _LEVELS + f" SELECT 0 AS level, bucket, key_json, NULL AS parent_json, CAST(delta AS DOUBLE) AS delta, rows_a, rows_b, {_SEVERITY} AS severity FROM l0 WHERE bucket <> 'MATCH' UNION ALL SELECT 1, bucket, key_json, parent_json, CAST(delta AS DOUBLE), rows_a, rows_b, 'low' FROM l1 WHERE bucket <> 'MATCH'",
    "recon_level_stats": _LEVELS + ", e AS (SELECT 0 AS level, bucket FROM l0 UNION ALL SELECT 1, bucket FROM l1) SELECT level, count(*) AS examined, count(*) FILTER (bucket = 'MATCH') AS matched, count(*) FILTER (bucket = 'ONLY_A') AS only_a, count(*) FILTER (bucket = 'ONLY_B') AS only_b, count(*) FILTER (bucket = 'DIFFER') AS differ FROM e GROUP BY level",
    "recon_lineage": _LEVELS + ", x AS (SELECT o, string_agg(l, ',' ORDER BY l) AS la FROM a GROUP BY o), y AS (SELECT o, string_agg(l, ',' ORDER BY l) AS lb FROM b GROUP BY o) SELECT key_json, bucket, la AS lineage_a, lb AS lineage_b FROM l0 LEFT JOIN x ON x.o = k LEFT JOIN y ON y.o = k WHERE bucket <> 'MATCH'",
    "recon_tolerance": """SELECT '{"order":"' || o_orderkey || '"}' AS key_json, CASE WHEN o_orderkey % 3 = 1 THEN 'DIFFER' ELSE 'MATCH' END AS bucket, CAST(CASE o_orderkey % 3 WHEN 0 THEN -0.01 WHEN 1 THEN -0.010001 ELSE 0 END AS DOUBLE) AS delta FROM orders""",
    "m2m_pairs": _PERTURBED + "x AS (SELECT s, count(*) AS n FROM a GROUP BY s), y AS (SELECT s, count(*) AS m FROM b GROUP BY s) SELECT CAST(s AS VARCHAR) AS supplier, n AS rows_a, m AS rows_b, n * m AS pairs FROM x JOIN y USING (s)",
    **{n: fd_sql(n) for n in FD},
    **{n: stats_sql(n) for n in STATS},
    "top_values": f"SELECT col, value, freq, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY col ORDER BY freq DESC, value) AS INTEGER) AS rank FROM ({_TOP}) WHERE value IS NOT NULL) WHERE rank <= 20",
    "key_overlap": f"WITH s AS ({_SET}), z AS (SELECT c, count(*) AS d, sum(n) AS r FROM s WHERE v IS NOT NULL GROUP BY c), m AS (SELECT x.c AS a, y.c AS b, count(*) AS k FROM s x JOIN s y ON x.v = y.v GROUP BY ALL), e AS (SELECT a.c AS col_a, b.c AS col_b, a.d / a.r AS ua, b.d / b.r AS ub, coalesce(k, 0) / least(a.d, b.d) AS o FROM z a CROSS JOIN z b LEFT JOIN m ON m.a = a.c AND m.b = b.c WHERE a.c LIKE 'o%' AND b.c LIKE 'c%') SELECT col_a, col_b, round(ua, 3) AS unique_a, round(ub, 3) AS unique_b, round(o, 3) AS overlap, round(o * sqrt(ua * ub), 3) AS rank FROM e",
    "norm_keys": "SELECT c_custkey, lower(trim(c_name)) AS name, regexp_replace(regexp_replace(c, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1') AS code, c AS raw FROM (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS c FROM customer)",
    "decimal_parse": f"SELECT o_orderkey, {_STRIP.format('CASE WHEN o_orderkey % 2 = 0 THEN -p ELSE p END')} AS standard, {_STRIP.format('CASE WHEN o_orderkey % 3 = 0 THEN -p ELSE p END')} AS greek FROM ({_TYPED})",
    "dates_day_first": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(NULL AS VARCHAR) AS none FROM orders",
    "number_evidence": r"WITH t AS (SELECT format('{:,.2f}', o_totalprice) AS t FROM orders) SELECT count(*) FILTER (regexp_matches(t, '(,[0-9]{1,6}-?$)|(-?[0-9]{1,3}(\.[0-9]{3}){2,},?)|([0-9]-$)')) AS greek, count(*) FILTER (regexp_matches(t, '(\.[0-9]{1,6}\)?$)|(-?\(?[0-9]{1,3}(,[0-9]{3}){1,})|(^\()')) AS standard, count(*) FILTER (regexp_matches(t, '[.,]')) AS separators FROM t",
    "infer_types": "SELECT col, type FROM (VALUES ('event_id', CASE WHEN (SELECT bool_and(regexp_full_match(CAST(event_id AS VARCHAR), '-?(0|[1-9][0-9]{0,17})')) FROM events) THEN 'integer' ELSE 'text' END), ('event_type', CASE WHEN (SELECT bool_and(regexp_full_match(event_type, '-?[0-9].*')) FROM events) THEN 'integer' ELSE 'text' END), ('value', CASE WHEN (SELECT bool_or(regexp_matches(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '^-?0[0-9]')) FROM events) THEN 'text' ELSE 'decimal' END), ('day', 'date'), ('code', CASE WHEN (SELECT bool_and(regexp_full_match(lpad(CAST(user_id AS VARCHAR), 12, '0'), '-?(0|[1-9][0-9]{0,17})')) FROM events) THEN 'integer' ELSE 'text' END)) v(col, type)",
    **surface.ORACLE_SQL,
}
