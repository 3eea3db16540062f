"""Queries over the rest of the surface: scans, scalars, inference, recognition, suggestion, and the engine with its memory.

Those of files write them first, from whole tables, in the folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.errors import ManyToManyKeyError, ReconError
from tallyfold.functions.decimals import TYPE, div, format_decimal, mul, parse_decimal
from tallyfold.functions.text import column_set_hash, hmac16, jaro_winkler, norm_column_name, sql_name
from tallyfold.operators import fingerprint as fp
from tallyfold.operators import hierarchy, infer, keys, reconcile
from tallyfold.operators.reconcile import Mapping
from tallyfold.plans.engine import Engine
from tallyfold.sources import delimited, encoding, scan
from tallyfold.sources import spec as specs

SALT = "00" * 32


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that executors share: in spark.checkpoint.dir; elsewhere only on one machine."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return f"{at.rstrip('/')}/tallyfold-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ReconError("spark.checkpoint.dir must name a folder that executors share")
    return tempfile.mkdtemp(prefix="tallyfold-")


def error_of(f) -> str | None:
    try:
        f()
    except ReconError as e:
        return type(e).__name__
    return None


def values(rows: list[tuple]) -> str:
    """Rows as SQL."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


# Scalars


def decimal_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Seven decimals are no amount unless rounding is asked for, which also reads scientific notation."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    long = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(""), price.cast("string"), F.lit("00005"))
    sci = F.concat((price * 100).cast("bigint").cast("string"), F.lit("E-2"))
    out = [format_decimal(parse_decimal(long, "standard", True)).alias("rounded"), format_decimal(parse_decimal(long)).alias("strict"), format_decimal(parse_decimal(sci, "standard", True)).alias("scientific"), format_decimal(parse_decimal(sci)).alias("unread")]
    return table(spark, d, "orders").select("o_orderkey", *out)


def decimal_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    price, rate = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mul(price, rate).cast("double").alias("product"), div(-price, F.lit(7)).cast("double").alias("seventh"), F.abs((-price).cast(TYPE)).cast("double").alias("size"))


NAMES = [("Order  Key", "order key", "order_key"), (" ORDER key ", "order key", "order_key_2"), ("2nd Total (EUR)", "2nd total (eur)", "c_2nd_total_eur"), ("Αξία €", "αξία €", "αξία"), ("%", "%", "col"), ("ＦＵＬＬ", "full", "full"), ("src_row", "src_row", "src_row_2")]


def names(spark: SparkSession, d: str) -> DataFrame:
    taken = {"src_row"}
    return spark.createDataFrame([(r, norm_column_name(r), sql_name(r, taken)) for r, _, _ in NAMES], "raw string, norm string, sql string")


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Of all columns of customer and of part. (The SQL's function drops half transpositions; between these names there are none.)"""
    a, b = table(spark, d, "customer").columns, table(spark, d, "part").columns
    return spark.createDataFrame([(x, y, round(jaro_winkler(x, y), 6)) for x in a for y in b], "a string, b string, sim double")


def _jaro(a: str, b: str) -> str:
    prefix = " + ".join(f"CASE WHEN left({a}, {n}) = left({b}, {n}) AND length({a}) >= {n} AND length({b}) >= {n} THEN 1 ELSE 0 END" for n in (1, 2, 3, 4))
    return f"(jaro_similarity({a}, {b}) + 0.1 * ({prefix}) * (1 - jaro_similarity({a}, {b})))"


PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
CUSTOMER, ORDERS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def value_hmac(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", hmac16(F.lower("n_name"), SALT).alias("h"))


def _hmac(v: str) -> str:
    """With a key of zeros: the pads are the characters 6 and backslash."""
    return f"left(sha256(encode(repeat('\\', 64)) || unhex(sha256(repeat('6', 64) || {v}))), 16)"


def column_hash(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(column_set_hash(table(spark, d, "orders").columns),)], "h string")


# Inference and recognition


def text_customer(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "customer")
    return t.select("c_custkey", F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).otherwise("  ").alias("segment"), F.format_number(F.col("c_acctbal").cast("decimal(18,2)"), 2).alias("balance"), F.concat(F.lit("0"), F.col("c_nationkey").cast("string")).alias("code"), F.lit("1,234").alias("mixed"), F.lit(" ").alias("none"))


TEXTS = ["key", "name", "segment", "balance", "code", "mixed", "none"]


def infer_forms(spark: SparkSession, d: str) -> DataFrame:
    found = infer.infer(infer.trimmed(text_customer(spark, d), TEXTS), TEXTS)
    return spark.createDataFrame([(c.name, c.type, c.format, c.nulls) for c in found], "col string, type string, format string, nulls long")


def infer_values(spark: SparkSession, d: str) -> DataFrame:
    """Values as they are stored, by their inferred types."""
    raw = infer.trimmed(text_customer(spark, d), TEXTS)
    typed = infer.canonical(raw, infer.infer(raw, TEXTS))
    return typed.select("c_custkey", "key", "name", "segment", F.col("balance").cast("double").alias("balance"), "code", "none")


def forced_types(spark: SparkSession, d: str) -> DataFrame:
    """Forced integers are kept as written where a value is none; forced amounts and dates that a value doesn't fit are errors."""
    raw = infer.trimmed(text_customer(spark, d), TEXTS)
    typed = infer.canonical(raw, infer.infer(raw, ["key", "name"], forced={"key": ("integer", None), "name": ("integer", None)}))
    bad = [error_of(lambda k=k: infer.infer(raw, ["name"], forced={"name": (k, None)})) for k in ("decimal", "date")]
    return typed.select("c_custkey", "key", "name", F.lit(bad[0]).alias("amount"), F.lit(bad[1]).alias("day"))


def printed(spark: SparkSession, df: DataFrame, columns: list[str]) -> fp.Fingerprint:
    raw = infer.trimmed(df.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns)
    found = infer.infer(raw, columns)
    typed = infer.canonical(raw, found)
    stats = {r["col"]: r for r in infer.column_stats(typed, columns).collect()}
    for c in found:
        c.nulls, c.distinct = stats[c.name].nulls, stats[c.name].distinct
    return fp.compute(typed, "utf-8", found, stats[columns[0]].rows, SALT)


def fingerprint_columns(spark: SparkSession, d: str) -> DataFrame:
    f = printed(spark, text_customer(spark, d), ["key", "name", "segment", "balance", "code"])
    rows = [(c, f.types[c], f.type_bag[f.types[c]], f.null_rates[c], f.bands[c], f.row_band) for c in f.types]
    return spark.createDataFrame(rows, "col string, type string, of_type long, null_rate double, band long, row_band long")


def fingerprint_sketch(spark: SparkSession, d: str) -> DataFrame:
    f = printed(spark, text_customer(spark, d), ["segment", "code"])
    return spark.createDataFrame([(c, h) for c, hs in f.sketch.items() for h in hs], "col string, h string")


def part_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").withColumn("p_type", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")))
    return p, p.filter("p_partkey % 4 <> 0").withColumnRenamed("p_size", "size2")


def similarity(spark: SparkSession, d: str) -> DataFrame:
    a, b = part_sides(spark, d)
    s = fp.similarity(printed(spark, a, ["p_brand", "p_type", "p_size"]), printed(spark, b, ["p_brand", "p_type", "size2"]))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in s.items()], "part string, value double")


OLD = [("key", "integer", 10), ("amount", "integer", 4), ("note", "text", 3), ("day", "date", 5), ("gone", "text", 1), ("left", "text", 1), ("code", "text", 6)]
NEW = [("key", "integer", 12), ("amount", "decimal", 4), ("note", "integer", 3), ("day", "text", 5), ("code", "decimal", 6), ("extra", "text", 2)]
MAPPED = ["key", "amount", "day", "gone"]


def _made(rows: list[tuple], band: int) -> fp.Fingerprint:
    return fp.Fingerprint("utf-8" if band < 9 else "cp1253", "", {c: t for c, t, _ in rows}, {}, {}, {c: b for c, _, b in rows}, band)


def drift_report(spark: SparkSession, d: str) -> DataFrame:
    found = fp.drift(_made(OLD, 6), _made(NEW, 9), set(MAPPED))
    return spark.createDataFrame([(k, x.split(":")[0], x.split(": ")[1].split(" ")[0] if "BAND" not in x.split(":")[0] and "ENCODING" not in x else x.split(": ")[1]) for k, xs in found.items() for x in xs], "severity string, code string, what string")


# Hierarchy and suggestion

GEO = ["r_name", "n_name", "s_name"]


def geo(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(*GEO)


def geo_deps(spark: SparkSession, d: str) -> list[hierarchy.Dependency]:
    df = geo(spark, d).persist()
    try:
        return hierarchy.detect(df, {r["col"]: r.distinct for r in infer.column_stats(df, GEO).collect()})
    finally:
        df.unpersist()


def hierarchy_geo(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, x.parent, x.child, x.parent_distinct, x.child_distinct, x.consistency, x.kind) for i, x in enumerate(geo_deps(spark, d))]
    return spark.createDataFrame(rows, "place long, parent string, child string, parent_distinct long, child_distinct long, consistency double, kind string")


def chains_geo(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(">".join(c),) for c in hierarchy.chains(geo_deps(spark, d))], "chain string")


def suggest_levels(spark: SparkSession, d: str) -> DataFrame:
    deps = geo_deps(spark, d)
    rows = [(x["level"], x["col_a"], x["col_b"]) for x in hierarchy.propose_levels(deps, deps, [(c, c) for c in ("s_name", "r_name", "n_name")])]
    return spark.createDataFrame(rows, "level long, col_a string, col_b string")


_EDGES = "WITH geo AS (SELECT r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), dist AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n FROM geo" for c in GEO) + "), fd AS (" + " UNION ALL ".join(f"SELECT '{p}' AS parent, '{c}' AS child, sum(n) AS total, coalesce(sum(n) FILTER (k > 1), 0) AS bad FROM (SELECT {c}, count({p}) AS n, count(DISTINCT {p}) AS k FROM geo GROUP BY {c})" for p in GEO for c in GEO if p != c) + "), deps AS (SELECT parent, child, p.n AS parent_distinct, c.n AS child_distinct, round(1 - bad / total, 3) AS consistency, CASE WHEN c.n / p.n >= 1.5 THEN 'aggregation' ELSE 'descriptive' END AS kind FROM fd JOIN dist p ON p.c = parent JOIN dist c ON c.c = child WHERE p.n BETWEEN 2 AND 10000 AND c.n > 1 AND c.n >= p.n AND round(1 - bad / total, 3) >= 0.95)"


KEYS_A, KEYS_B = ["c_custkey", "c_nationkey", "c_name"], ["o_custkey", "o_orderkey", "o_orderstatus"]


def suggest_keys(spark: SparkSession, d: str) -> DataFrame:
    """Key candidates of customer and orders, in their order."""
    columns = lambda ns: [infer.Column(n, "integer" if n.endswith("key") else "text", None) for n in ns]
    found, _ = keys.suggest(table(spark, d, "customer"), table(spark, d, "orders"), columns(KEYS_A), columns(KEYS_B))
    return spark.createDataFrame([(i, k.col_a, k.col_b, k.name_sim, k.unique_a, k.unique_b, k.overlap, k.rank) for i, k in enumerate(found)], "place long, col_a string, col_b string, name_sim double, unique_a double, unique_b double, overlap double, rank double")


def suggest_compares(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of part and supplier by likeness of their names, the twenty most alike."""
    a, b = (infer.trimmed(table(spark, d, t).select(*[F.col(c).cast("string").alias(c) for c in cs]), cs) for t, cs in (("part", NUMBERS), ("supplier", OTHERS)))
    numbers = [[infer.Column(c, "decimal", "standard") for c in df.columns] for df in (a, b)]
    _, found = keys.suggest(a, b, *numbers)
    return spark.createDataFrame([(i, x, y, s) for i, (x, y, s) in enumerate(found)], "place long, col_a string, col_b string, name_sim double")


NUMBERS, OTHERS = ["p_partkey", "p_size", "p_retailprice"], ["s_suppkey", "s_nationkey", "s_acctbal"]


def _picked(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    columns = lambda df: [infer.Column(n, "decimal" if t.startswith("decimal") else "integer", None) for n, t in df.dtypes]
    maps, warnings = keys.auto_pick(a, b, columns(a), columns(b))
    return spark.createDataFrame([(m.role, m.level, m.col_a, m.col_b, len(warnings)) for m in maps], "role string, level long, col_a string, col_b string, warnings long")


def auto_pick(spark: SparkSession, d: str) -> DataFrame:
    """No amounts of like names: the largest on either side are compared, with a warning."""
    money = lambda c, n: F.col(c).cast("decimal(18,2)").cast(TYPE).alias(n)
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", money("o_totalprice", "gross"))
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", money("l_extendedprice", "v"), money("l_tax", "x"))
    return _picked(spark, a, b)


def mapped_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of one profile that any pair maps, on either side."""
    e = Engine(spark, scratch(spark))
    for p in ("x", "y"):
        e.catalog.add("Profile", name=p)
    for name, a, b in (("p", "x", "y"), ("q", "y", "x"), ("r", "x", "x")):
        e.create_pair(name, a, b)
    e.map("p", ["order=id"], ["amount=total"])
    e.map("q", ["id=order"], ["total=tax"])
    e.map("r", ["order=parent"], [], ["note=memo"])
    return spark.createDataFrame([(c,) for c in e._mapped(e.catalog.one("Profile", name="x")["id"])], "col string")


# Scans


def _quoted(v: str) -> str:
    return '"' + v.replace('"', '""') + '"'


def nations(spark: SparkSession, d: str) -> list:
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


def scan_delimited(spark: SparkSession, d: str) -> DataFrame:
    """nation as a file of its own: quotes, doubled quotes and line ends in cells, blank lines, short rows, bare returns."""
    lines = ["Key;Name;Note;Region"] + [f"{r.n_nationkey}; {r.n_name.lower()} ;{_quoted(f'a;{r.n_name!s}, ' + chr(34) + 'q' + chr(34))}" + (f";{r.n_regionkey}" if r.n_nationkey % 20 else "") for r in nations(spark, d)]
    text = "﻿" + "\r\n".join(lines[:5]) + "\r\r" + "\n\n".join(lines[5:]) + "\n"
    found = scan.parse("nation.csv", text.encode(), None)
    return found.frame(spark, ["key", "name", "note", "region"]).withColumn("encoding", F.lit(found.encoding))


def scan_fixed_cp1253(spark: SparkSession, d: str) -> DataFrame:
    """supplier as a printed list in Windows-1253, with page heads, rules and Greek amounts."""
    page = "Κατάσταση προμηθευτών   Σελίδα 1\n" + "=" * 30 + "\n"
    rows = table(spark, d, "supplier").orderBy("s_suppkey").select("s_suppkey", F.translate(F.format_number(F.abs(F.col("s_acctbal").cast("decimal(18,2)")), 2), ",.", ".,").alias("v"), (F.col("s_acctbal") < 0).alias("less")).collect()
    text = "".join((page if i % 40 == 0 else "") + f"{r.s_suppkey:<10}{r.v + ('-' if r.less else ''):>16}\n" for i, r in enumerate(rows))
    spec = {"type": "fixed", "columns": [{"name": "Κωδικός", "start": 0, "end": 10}, {"name": "Υπόλοιπο", "start": 10, "end": 26, "type": "decimal", "numberFormat": "greek"}], "skipLineRegexes": ["Σελίδα", "^=+$"]}
    found = scan.parse("list.txt", encoding.encode_cp1253(text), specs.validate(spec))
    raw = infer.trimmed(found.frame(spark, ["code", "balance"]), ["code", "balance"])
    typed = infer.canonical(raw, infer.infer(raw, ["code", "balance"], "greek", forced={"balance": found.forced["Υπόλοιπο"]}))
    return typed.select("src_row", "code", F.col("balance").cast("double").alias("balance"), F.lit(found.encoding).alias("encoding"), F.lit(found.header[1]).alias("header"))


def workbook(rows: list[list[str]]) -> bytes:
    """A spreadsheet with shared strings, inline strings, numbers, and gaps."""
    shared: dict[str, int] = {}

    def cell(v: str, r: int, i: int) -> str:
        at = f'r="{chr(65 + i)}{r}"'
        if v == "":
            return ""
        if v.replace(".", "").replace("E", "").replace("-", "").isdigit():
            return f"<c {at}><v>{v}</v></c>"
        if i % 2:
            return f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f'<c {at} t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'

    body = "".join(f'<row r="{r}">' + "".join(cell(v, r, i) for i, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(v)}</t></si>" for v in shared) + "</sst>")
    return out.getvalue()


def scan_xlsx(spark: SparkSession, d: str) -> DataFrame:
    """nation as a spreadsheet whose header repeats a name; entities and missing cells."""
    rows = [["Key", "Name", "Name", "Rate"]] + [[str(r.n_nationkey), r.n_name, f"<{r.n_name} & co>" if r.n_nationkey % 2 else "", f"{r.n_nationkey + 1}.0000000000000004E-1"] for r in nations(spark, d)]
    found = scan.parse("nation.xlsx", workbook(rows), None)
    raw = infer.trimmed(found.frame(spark, found.header), found.header)
    typed = infer.canonical(raw, infer.infer(raw, found.header, None, True), True)
    return typed.select("src_row", F.col("Key").alias("key"), F.col("Name").alias("name"), F.col("`Name (2)`").alias("again"), F.col("Rate").cast("double").alias("rate"))


def scan_xlsx_spec(spark: SparkSession, d: str) -> DataFrame:
    """Title rows skipped, columns named by the spec."""
    rows = [["Report", "", ""], ["", "", ""]] + [[str(r.n_nationkey), r.n_name, str(r.n_regionkey)] for r in nations(spark, d)]
    spec = specs.validate({"type": "xlsx", "skipLeadingRows": 2, "hasHeader": False, "columns": ["key", "name", "region"]})
    found = scan.parse("r.xlsx", workbook(rows), spec)
    return found.frame(spark, found.header)


def scan_delimited_spec(spark: SparkSession, d: str) -> DataFrame:
    text = "printed today\n" + "\n".join(f"{r.n_nationkey}#{r.n_name}" for r in nations(spark, d))
    spec = specs.validate({"type": "delimited", "delimiter": "#", "hasHeader": False, "columns": ["key", "name"], "skipLeadingLines": 1})
    found = scan.parse("n.txt", text.encode(), spec)
    return found.frame(spark, found.header)


def scan_splits(spark: SparkSession, d: str) -> DataFrame:
    """orders written as delimited files and read in splits, numbered through: nothing comes to the driver."""
    at = scratch(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.concat(F.col("o_orderstatus"), F.lit('; "'), F.col("o_custkey").cast("string"), F.lit('"')).alias("note")).write.csv(f"{at}/in", sep="|", header=True, quote='"', escape='"', quoteAll=True)
    found, _, _ = scan.scan_staged(spark, f"{at}/in", f"{at}/staged")
    t = found.table.toDF("src_row", *found.header)
    n = t.count()
    numbered = t.agg(F.countDistinct("src_row").alias("n"), F.min("src_row").alias("lo"), F.max("src_row").alias("hi")).first()
    whole = tuple(numbered) == (n, 1, n)
    return t.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", "note", F.lit(whole).alias("numbered"))


def scan_fixed_splits(spark: SparkSession, d: str) -> DataFrame:
    """customer as fixed-width lines, read in splits by a spec."""
    at = scratch(spark)
    line = F.concat(F.rpad(F.col("c_custkey").cast("string"), 10, " "), F.rpad("c_mktsegment", 12, " "), F.lpad(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), 14, " "))
    table(spark, d, "customer").select(F.explode(F.array(line, F.lit("-" * 20), F.lit(""))).alias("value")).write.text(f"{at}/in")
    spec = specs.validate({"kind": "fixed", "columns": [{"name": "key", "start": 0, "end": 10}, {"name": "segment", "start": 10, "end": 22}, {"name": "balance", "start": 22, "end": 36, "type": "decimal"}], "skip_patterns": ["^-+$"]})
    found, _, _ = scan.scan_staged(spark, f"{at}/in", f"{at}/staged", None, spec)
    t = found.table.toDF("src_row", *found.header)
    return t.select(F.col("key").cast("long").alias("c_custkey"), "segment", parse_decimal(F.col("balance")).cast("double").alias("balance"))


RULES = [
    ("delimited: row too long", lambda: delimited.parse("f", "a,b\n1,2,3", ","), "DelimitedParseError"),
    ("delimited: open quote", lambda: delimited.parse("f", 'a,b\n"1,2', ","), "DelimitedParseError"),
    ("delimited: short row", lambda: delimited.parse("f", "a,b\n1", ","), None),
    ("sniff: none", lambda: delimited.sniff("f", "abc\nd"), "DelimiterDetectionError"),
    ("sniff: tie", lambda: delimited.sniff("f", "a;b,c\n1;2,3"), "DelimiterDetectionError"),
    ("sniff: tab", lambda: delimited.sniff("f", "a\tb\n1\t2"), None),
    ("encoding: not Greek", lambda: encoding.detect("f", b"a\xe9"), "EncodingDetectionError"),
    ("encoding: undefined byte", lambda: encoding.detect("f", b"\xaa" + encoding.encode_cp1253("Κατάσταση")), "EncodingDetectionError"),
    ("encoding: bad after the mark", lambda: encoding.detect("f", b"\xef\xbb\xbf\xff"), "EncodingDetectionError"),
    ("encoding: Greek", lambda: encoding.detect("f", encoding.encode_cp1253("Κατάσταση")), None),
    ("header: one column", lambda: delimited.assert_header("f", ["a"]), "HeaderDetectionError"),
    ("header: a number", lambda: delimited.assert_header("f", ["a", "1.5"]), "HeaderDetectionError"),
    ("header: one name twice", lambda: delimited.assert_header("f", ["a", "Ａ"]), "HeaderDetectionError"),
    ("header: fine", lambda: delimited.assert_header("f", ["a", "b"]), None),
    ("spec: no kind", lambda: specs.validate({}), "ParseSpecError"),
    ("spec: one column", lambda: specs.validate({"type": "fixed", "columns": [{"name": "a", "start": 0, "end": 1}]}), "ParseSpecError"),
    ("spec: start after end", lambda: specs.validate({"type": "fixed", "columns": [{"name": "a", "start": 2, "end": 1}, {"name": "b", "start": 2, "end": 3}]}), "ParseSpecError"),
    ("spec: bad pattern", lambda: specs.validate({"type": "fixed", "columns": [{"name": "a", "start": 0, "end": 1}, {"name": "b", "start": 2, "end": 3}], "skipLineRegexes": ["("]}), "ParseSpecError"),
    ("spec: long delimiter", lambda: specs.validate({"type": "delimited", "delimiter": ";;", "hasHeader": True}), "ParseSpecError"),
    ("spec: nameless", lambda: specs.validate({"type": "xlsx", "hasHeader": False}), "ParseSpecError"),
    ("spec: fine", lambda: specs.validate({"type": "xlsx", "columns": ["a", "b"], "skipLeadingRows": 1}), None),
]


def source_rules(spark: SparkSession, d: str) -> DataFrame:
    """What sources refuse, by the name of the error."""
    return spark.createDataFrame([(n, error_of(f)) for n, f, _ in RULES], "rule string, error string")


HEADERS = ["a", "b", "a", "c", "b", "a"]


def dedupe_headers(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(delimited.dedupe_headers(HEADERS))), "place long, name string")


# Reconciliation


def smart_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders by customers' codes, written with dashes and zeros on one side; some codes are missing."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").cast(TYPE).alias("amount"), F.lit(1).cast("long").alias("units"), F.col("o_orderpriority").alias("prio"))
    code = F.lpad(F.col("o_custkey").cast("string"), 8, "0")
    a = o.filter("o_custkey % 13 <> 0").withColumn("code", F.when(F.col("o_orderkey") % 50 != 0, F.concat(F.substring(code, 1, 4), F.lit("-"), F.substring(code, 5, 4))))
    b = o.filter("o_custkey % 17 <> 0").withColumn("code no", F.when(F.col("o_orderkey") % 75 != 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))))
    return a, b.withColumn("amount", (F.col("amount") + F.when(F.col("o_custkey") % 11 == 0, 5).otherwise(0)).cast(TYPE))


def recon_smart_keys(spark: SparkSession, d: str) -> DataFrame:
    maps = [Mapping("key", 0, "code", "code no"), Mapping("compare", 0, "amount", "amount"), Mapping("compare", 0, "units", "units"), Mapping("display", 0, "prio", "prio")]
    a, b = (x.withColumn("src_row", F.col("o_orderkey").cast("long")) for x in smart_sides(spark, d))
    f = reconcile.reconcile(a, b, maps, reconcile.Policy(m2m_cap=None), lineage=True)
    return f.select("key_json", "bucket", "compare_col", *[F.col(c).cast("double").alias(c) for c in ("value_a", "value_b", "delta")], "rows_a", "rows_b", "severity", "note", reconcile.lineage_json().alias("lineage_json"))


def recon_totals(spark: SparkSession, d: str) -> DataFrame:
    """What a run reports: findings of level 0, and severe ones."""
    from tallyfold.plans.queries import perturbed

    level0 = F.col("level") == 0
    return perturbed(spark, d).agg(F.count_if(level0).alias("total"), F.count_if(F.col("severity") == "high").alias("high"))


def m2m_guard(spark: SparkSession, d: str) -> DataFrame:
    """The one key with more pairs of rows than the cap, as the error names it."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").cast("long").alias("v")).filter("k = 2 OR v < 5")
    maps = [Mapping("key", 0, "k", "k", "raw"), Mapping("compare", 0, "v", "v")]
    said = None
    try:
        with reconcile.named_errors():
            reconcile.reconcile(n, n, maps, reconcile.Policy(m2m_cap=24), all_buckets=True).collect()
    except ManyToManyKeyError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "error string")


def refused(spark: SparkSession, d: str) -> DataFrame:
    """Mappings that cannot be reconciled."""
    n = table(spark, d, "nation")
    key, value = Mapping("key", 0, "n_regionkey", "n_regionkey", "raw"), Mapping("compare", 0, "n_nationkey", "n_nationkey")
    sets = {"no key": [value], "no compare": [key], "no column": [key, Mapping("compare", 0, "x", "x")], "no number": [key, Mapping("compare", 0, "n_name", "n_name")], "only deeper keys": [Mapping("key", 1, "n_regionkey", "n_regionkey"), value], "fine": [key, value]}
    return spark.createDataFrame([(k, error_of(lambda m=m: reconcile.check(n, n, m))) for k, m in sets.items()], "what string, error string")


# The engine


def supplier_files(spark: SparkSession, d: str, at: str) -> tuple[str, str]:
    """Two files of suppliers' balances by nation and code."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).orderBy("s_suppkey").select("s_suppkey", "n_name", F.col("s_acctbal").cast("decimal(18,2)").alias("v"))
    rows = s.collect()
    a = "Nation,Code,Balance\n" + "".join(f"{r.n_name},{r.s_suppkey:05d},{r.v}\n" for r in rows if r.s_suppkey % 13)
    b = "Nation Name;Supplier Code;Balance Eur\n" + "".join(f"{r.n_name.lower()};{r.s_suppkey};{r.v + (5 if r.s_suppkey % 7 == 0 else 0)}\n" for r in rows if r.s_suppkey % 11)
    for name, text in (("a.csv", a), ("b.csv", b)):
        spark.createDataFrame([(text.rstrip("\n"),)], "t string").coalesce(1).write.text(f"{at}/{name}")
    return f"{at}/a.csv", f"{at}/b.csv"


def _one_file(spark: SparkSession, folder: str) -> str:
    return spark.read.format("binaryFile").load(folder).select("path").first().path


def flow(spark: SparkSession, d: str) -> tuple[Engine, dict]:
    at = scratch(spark)
    a, b = (_one_file(spark, f) for f in supplier_files(spark, d, at))
    e = Engine(spark, f"{at}/store")
    first = e.run(a, b, profile_a="ours", profile_b="theirs")
    pair = e.pairs()[0]["name"]
    e.map(pair, ["nation=nation name", "code=supplier code:1"], ["balance=balance eur"])
    return e, {"first": first, "run": e.run(a, b)}


def engine_findings(spark: SparkSession, d: str) -> DataFrame:
    """From two files to findings that name their parents."""
    e, _ = flow(spark, d)
    return e.sql("SELECT c.level, c.bucket, c.key_json, c.delta_micros, c.rows_a, c.rows_b, c.severity, p.key_json AS parent FROM RunFinding c LEFT JOIN RunFinding p ON p.id = c.parent_finding_id")


def engine_memory(spark: SparkSession, d: str) -> DataFrame:
    """What is remembered after that: files once each, profiles, pair and mappings; and what the commands answered."""
    e, said = flow(spark, d)
    rows = [(t, str(len(e.catalog.rows[t]))) for t in ("Profile", "LoadedFile", "Fingerprint", "DatasetColumn", "ReconPair", "ColumnMapping", "Run", "RunLevelStat")]
    rows += [("first", said["first"]["status"]), ("second", said["run"]["status"]), ("again", e.ingest(e.catalog.rows["LoadedFile"][0]["absolute_path"])["status"])]
    rows += [(f"files of {p['name']}", str(p["files"])) for p in e.profiles()] + [(f"mappings of {p['name']}", str(p["mappings"])) for p in e.pairs()]
    rows += [("unknown pair", error_of(lambda: e.reconcile("none"))), ("keys", "|".join(sorted(k["col_a"] + "=" + k["col_b"] for k in e.suggest(e.pairs()[0]["name"])["keys"])))]
    rows += [("type", f"{c.name}:{c.type}") for c in e.columns(1)]
    doc = e.document()
    rows += [("document", str(all(f"## {t}" in doc for t in ("Meta", "RunFinding", "Dataset1", "Dataset2")) and "references Run.id" in doc))]
    return spark.createDataFrame(rows, "what string, said string")


ROUTES = [("first", "Key,Name,Region", "created_new_profile"), ("same again", "Key,Name,Region", "attached_existing"), ("two of three", "Key,Name,Population", "unattached_suggest"), ("other", "Code;Label", "created_new_profile")]


def routing(spark: SparkSession, d: str) -> DataFrame:
    """How files of nations are recognised, one after another."""
    at, out = scratch(spark), []
    e, rows = Engine(spark, f"{at}/store"), nations(spark, d)
    for i, (name, header, _) in enumerate(ROUTES):
        sep = ";" if ";" in header else ","
        cells = [[str(r.n_nationkey + (0 if sep == "," else 500)), r.n_name.lower() if sep == "," else f"x{r.n_nationkey}", str(r.n_regionkey + (i > 1) * (r.n_nationkey + 9))][: header.count(sep) + 1] for r in rows[: 25 - i]]
        text = "\n".join([header, *[sep.join(c) for c in cells]])
        spark.createDataFrame([(text,)], "t string").coalesce(1).write.text(f"{at}/f{i}")
        out.append((name, e.ingest(_one_file(spark, f"{at}/f{i}"))["routing"]))
    return spark.createDataFrame(out, "file string, routing string")


QUERIES = {
    f.__name__: f
    for f in (decimal_rounding, decimal_arithmetic, names, name_similarity, value_hmac, column_hash, infer_forms, infer_values, forced_types, fingerprint_columns, fingerprint_sketch, similarity, drift_report, hierarchy_geo, chains_geo, suggest_levels, suggest_keys, suggest_compares, auto_pick, mapped_columns, scan_delimited, scan_fixed_cp1253, scan_xlsx, scan_xlsx_spec, scan_delimited_spec, scan_splits, scan_fixed_splits, source_rules, dedupe_headers, recon_smart_keys, recon_totals, m2m_guard, refused, engine_findings, engine_memory, routing)
}

_STRIP = "regexp_replace(CAST({} AS VARCHAR), '\\.?0+$', '')"
_P = "CAST(o_totalprice AS DECIMAL(18,2))"
_BAND = "CAST(floor(log2(count(DISTINCT {}) + 1)) AS BIGINT)"
_SEGMENT = "CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END"
_CODE = "'0' || c_nationkey"


def _top(column: str, source: str) -> str:
    return f"SELECT {column} AS v FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 20"


def _similarity_sql() -> str:
    p = "(SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS p_type FROM part{})"
    a, b = p.format(""), p.format(" WHERE p_partkey % 4 <> 0")
    held = lambda c: f"(SELECT (SELECT count(*) FROM x JOIN y USING (v)) / least((SELECT count(*) FROM x), (SELECT count(*) FROM y)) FROM (SELECT 1)) AS h_{c}"
    inner = ", ".join(held(c).replace("FROM x", f"FROM ({_top(c, a)}) x").replace("FROM y", f"FROM ({_top(c, b)}) y").replace("JOIN y", f"JOIN ({_top(c, b)}) y") for c in ("p_brand", "p_type"))
    rate = "round((count(*) - count(p_type)) / count(*), 3)"
    return f"""WITH s AS (SELECT {inner}, abs((SELECT {rate} FROM {a}) - (SELECT {rate} FROM {b})) AS off,
  abs((SELECT floor(log2(count(*) + 1)) FROM {a}) - (SELECT floor(log2(count(*) + 1)) FROM {b})) AS bands),
t AS (SELECT 0.5 AS names, 1.0 AS types, 1 - off / 2 AS nulls, 1 / (1 + bands) AS rows, (h_p_brand + h_p_type) / 2 AS sketch FROM s),
u AS (SELECT *, 0.4 * names + 0.2 * types + 0.1 * nulls + 0.1 * rows + 0.2 * sketch AS score FROM t)
SELECT part, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM u) UNPIVOT (value FOR part IN (names, types, nulls, rows, sketch, score))"""


def _drift_sql() -> str:
    width = "CASE {} WHEN 'integer' THEN 0 WHEN 'decimal' THEN 1 WHEN 'text' THEN 2 END"
    return f"""WITH o AS (SELECT * FROM {values(OLD)} t(c, t, b)), n AS (SELECT * FROM {values(NEW)} t(c, t, b)), m AS (SELECT * FROM {values([(c,) for c in MAPPED])} t(c)),
j AS (SELECT o.c AS oc, n.c AS nc, o.t AS ot, n.t AS nt, o.b AS ob, n.b AS nb, coalesce(o.c, n.c) IN (SELECT c FROM m) AS mapped, 'date' NOT IN (o.t, n.t) AND {width.format('n.t')} > {width.format('o.t')} AS wider FROM o FULL JOIN n ON o.c = n.c)
SELECT CASE WHEN mapped THEN 'hard' ELSE 'soft' END AS severity, CASE WHEN mapped THEN 'MAPPED_COLUMN_MISSING' ELSE 'UNMAPPED_COLUMN_REMOVED' END AS code, oc AS what FROM j WHERE nc IS NULL
UNION ALL SELECT 'soft', 'COLUMN_ADDED', nc FROM j WHERE oc IS NULL
UNION ALL SELECT CASE WHEN wider OR NOT mapped THEN 'soft' ELSE 'hard' END, CASE WHEN wider THEN 'TYPE_WIDENED' WHEN mapped THEN 'TYPE_NARROWED' ELSE 'TYPE_NARROWED_UNMAPPED' END, oc FROM j WHERE ot <> nt
UNION ALL SELECT 'soft', 'CARDINALITY_BAND_CHANGED', oc || ' ' || ob || ' -> ' || nb FROM j WHERE mapped AND abs(ob - nb) >= 2
UNION ALL SELECT 'hard', 'ENCODING_CHANGED', 'utf-8 -> cp1253' UNION ALL SELECT 'soft', 'ROW_COUNT_BAND_CHANGED', '6 -> 9'"""


def _overlap_sql(a: str, cols_a: list[str], b: str, cols_b: list[str]) -> str:
    """col_a, col_b, place, ua, ub, o: of values normalised as codes or in lower case."""
    norm = "CASE WHEN regexp_full_match(v, '[0-9][0-9 .\\-/]*') THEN regexp_replace(regexp_replace(v, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1') ELSE lower(v) END"
    each = lambda t, cs: " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS i, trim(CAST({c} AS VARCHAR)) AS v FROM {t}" for i, c in enumerate(cs))
    sets = lambda t, cs: f"SELECT c, i, {norm} AS v, count(*) AS n FROM ({each(t, cs)}) WHERE v IS NOT NULL GROUP BY ALL"
    size = "SELECT c, i, count(*) AS d, sum(n) AS r FROM {} GROUP BY ALL"
    return f"""sa AS ({sets(a, cols_a)}), sb AS ({sets(b, cols_b)}), za AS ({size.format('sa')}), zb AS ({size.format('sb')}),
m AS (SELECT x.c AS a, y.c AS b, count(*) AS k FROM sa x JOIN sb y ON x.v = y.v GROUP BY ALL),
ov AS (SELECT za.c AS col_a, zb.c AS col_b, za.i * 100 + zb.i AS pos, za.d / za.r AS ua, zb.d / zb.r AS ub, coalesce(k, 0) / least(za.d, zb.d) AS o, {_jaro('za.c', 'zb.c')} AS sim FROM za CROSS JOIN zb LEFT JOIN m ON m.a = za.c AND m.b = zb.c),
good AS (SELECT col_a, col_b, pos, round(sim, 3) AS name_sim, round(ua, 3) AS unique_a, round(ub, 3) AS unique_b, round(o, 3) AS overlap, round(o * sqrt(ua * ub), 3) AS rank FROM ov WHERE (sim >= 0.5 OR (ua >= 0.9 AND ub >= 0.9)) AND round(o, 3) > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY rank DESC, name_sim DESC, pos) - 1 AS place FROM good)"""


def _smart_sql() -> str:
    side = """SELECT CAST(nullif(c, '') AS BIGINT) AS k, sum({v}) AS v, count(*) AS n, min(raw) AS raw, min(p) AS lo, max(p) AS hi, '[' || string_agg(o, ',' ORDER BY o) || ']' AS rows FROM (
  SELECT CASE WHEN {has} THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS c, CASE WHEN {has} THEN {raw} END AS raw, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey AS cust, o_orderpriority AS p, o_orderkey AS o FROM orders WHERE o_custkey % {drop} <> 0) GROUP BY c"""
    a = side.format(v="price", has="o_orderkey % 50 <> 0", raw="left(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 4) || '-' || right(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 4)", drop=13)
    b = side.format(v="price + CASE WHEN cust % 11 = 0 THEN 5 ELSE 0 END", has="o_orderkey % 75 <> 0", raw="' ' || o_custkey", drop=17)
    return f"""WITH a AS ({a}), b AS ({b}), j AS (SELECT a.v AS av, b.v AS bv, a.n AS an, b.n AS bn, a.raw AS ar, b.raw AS br, CASE WHEN a.lo = a.hi THEN a.lo END AS ap, CASE WHEN b.lo = b.hi THEN b.lo END AS bp, a.rows AS arows, b.rows AS brows FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k),
c AS (SELECT *, 'amount=amount' AS compare_col, CAST(av AS DOUBLE) AS value_a, CAST(bv AS DOUBLE) AS value_b, av - bv AS diff FROM j UNION ALL SELECT *, 'units=units', an, bn, an - bn FROM j),
f AS (SELECT *, CASE WHEN bn IS NULL THEN 'ONLY_A' WHEN an IS NULL THEN 'ONLY_B' WHEN abs(diff) <= 0.01 THEN 'MATCH' ELSE 'DIFFER' END AS bucket, CAST(CASE WHEN bn IS NULL THEN value_a WHEN an IS NULL THEN -value_b ELSE diff END AS DOUBLE) AS delta FROM c)
SELECT CASE WHEN coalesce(ar, br) IS NULL THEN '{{}}' ELSE '{{"code":"' || coalesce(ar, br) || '"}}' END AS key_json, bucket, compare_col, value_a, value_b, delta, coalesce(an, 0) AS rows_a, coalesce(bn, 0) AS rows_b,
  CASE WHEN bucket <> 'DIFFER' OR abs(delta) >= 10 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN coalesce(ap, bp) IS NULL THEN '{{}}' ELSE '{{"prio":"' || coalesce(ap, bp) || '"}}' END AS note,
  '{{' || concat_ws(',', '"a":' || arows, '"b":' || brows) || '}}' AS lineage_json FROM f WHERE bucket <> 'MATCH'"""


_FLOW = """WITH s AS (SELECT s_suppkey AS k, n_name AS n, CAST(s_acctbal AS DECIMAL(18,2)) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT * FROM s WHERE k % 13 <> 0), b AS (SELECT k, n, v + CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END AS v FROM s WHERE k % 11 <> 0),
l0 AS (SELECT n, x.v AS av, y.v AS bv, x.c AS ac, y.c AS bc FROM (SELECT n, sum(v) AS v, count(*) AS c FROM a GROUP BY n) x FULL JOIN (SELECT n, sum(v) AS v, count(*) AS c FROM b GROUP BY n) y USING (n)),
l1 AS (SELECT coalesce(x.n, y.n) AS n, coalesce(x.k, y.k) AS k, x.n IS NOT NULL AS in_a, x.v AS av, y.v AS bv, CASE WHEN x.n IS NULL THEN NULL ELSE 1 END AS ac, CASE WHEN y.n IS NULL THEN NULL ELSE 1 END AS bc FROM a x FULL JOIN b y ON x.n = y.n AND x.k = y.k),
f AS (SELECT 0 AS level, n, CASE WHEN ac IS NULL THEN lower(n) ELSE n END AS shown, NULL AS code, av, bv, ac, bc FROM l0 UNION ALL
  SELECT 1, n, CASE WHEN in_a THEN n ELSE lower(n) END, CASE WHEN in_a THEN lpad(CAST(k AS VARCHAR), 5, '0') ELSE CAST(k AS VARCHAR) END, av, bv, ac, bc FROM l1),
g AS (SELECT *, CASE WHEN bc IS NULL THEN 'ONLY_A' WHEN ac IS NULL THEN 'ONLY_B' WHEN abs(av - bv) <= 0.01 THEN 'MATCH' ELSE 'DIFFER' END AS bucket, CASE WHEN bc IS NULL THEN av WHEN ac IS NULL THEN -bv ELSE av - bv END AS delta FROM f)
"""

ORACLE_SQL = {
    "decimal_rounding": f"SELECT o_orderkey, {_STRIP.format(f'CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * ({_P} + 0.000001) AS DECIMAL(28,6))')} AS rounded, CAST(NULL AS VARCHAR) AS strict, {_STRIP.format(_P)} AS scientific, CAST(NULL AS VARCHAR) AS unread FROM orders",
    "decimal_arithmetic": "SELECT l_orderkey, l_linenumber, CAST(p * r AS DOUBLE) AS product, round(-CAST(p AS DOUBLE) / 7, 6) AS seventh, CAST(p AS DOUBLE) AS size FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS r FROM lineitem)",
    "names": f"SELECT * FROM {values(NAMES)} t(raw, norm, sql)",
    "name_similarity": f"SELECT a, b, round({_jaro('a', 'b')}, 6) AS sim FROM {values([(c,) for c in CUSTOMER])} x(a), {values([(c,) for c in PART])} y(b)",
    "value_hmac": f"SELECT n_nationkey, {_hmac('lower(n_name)')} AS h FROM nation",
    "column_hash": f"SELECT sha256(string_agg(n, chr(10) ORDER BY n)) AS h FROM {values([(c,) for c in ORDERS])} t(n)",
    "infer_forms": f"""SELECT 'key' AS col, 'integer' AS type, NULL AS format, CAST(0 AS BIGINT) AS nulls UNION ALL SELECT 'name', 'text', NULL, 0 UNION ALL SELECT 'segment', 'text', NULL, (SELECT count(*) - count({_SEGMENT}) FROM customer)
UNION ALL SELECT 'balance', 'decimal', 'standard', 0 UNION ALL SELECT 'code', 'text', NULL, 0 UNION ALL SELECT 'mixed', 'text', NULL, 0 UNION ALL SELECT 'none', 'text', NULL, (SELECT count(*) FROM customer)""",
    "infer_values": f"SELECT c_custkey, c_custkey AS key, c_name AS name, {_SEGMENT} AS segment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance, {_CODE} AS code, CAST(NULL AS VARCHAR) AS none FROM customer",
    "forced_types": "SELECT c_custkey, c_custkey AS key, c_name AS name, 'NumberFormatError' AS amount, 'NumberFormatError' AS day FROM customer",
    "fingerprint_columns": "WITH n AS (SELECT CAST(floor(log2(count(*) + 1)) AS BIGINT) AS row_band, count(*) AS n FROM customer) SELECT x.*, row_band FROM n, ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, '{t}' AS type, CAST({k} AS BIGINT) AS of_type, (SELECT round((count(*) - count({v})) / count(*), 3) FROM customer) AS null_rate, (SELECT {_BAND.format(v)} FROM customer) AS band" for c, t, k, v in (("key", "integer", 1, "c_custkey"), ("name", "text", 3, "c_name"), ("segment", "text", 3, _SEGMENT), ("balance", "decimal", 1, "CAST(c_acctbal AS DECIMAL(18,2))"), ("code", "text", 3, _CODE)))
    + ") x",
    "fingerprint_sketch": " UNION ALL ".join(f"SELECT '{c}' AS col, {_hmac('lower(v)')} AS h FROM ({_top(v, 'customer')})" for c, v in (("segment", _SEGMENT), ("code", _CODE))),
    "similarity": _similarity_sql(),
    "drift_report": _drift_sql(),
    "hierarchy_geo": _EDGES + " SELECT row_number() OVER (ORDER BY kind, parent_distinct, parent, child) - 1 AS place, * FROM deps",
    "chains_geo": _EDGES.replace("WITH geo", "WITH RECURSIVE geo")
    + ", e AS (SELECT * FROM deps WHERE kind = 'aggregation'), w AS (SELECT [parent] AS path FROM e WHERE parent NOT IN (SELECT child FROM e) GROUP BY parent UNION ALL SELECT list_append(path, child) FROM w JOIN e ON e.parent = path[-1] AND NOT list_contains(path, child)) SELECT array_to_string(path, '>') AS chain FROM w WHERE len(path) > 1 AND NOT EXISTS (SELECT 1 FROM e WHERE parent = path[-1] AND NOT list_contains(path, child))",
    "suggest_levels": _EDGES + " SELECT row_number() OVER (ORDER BY n) - 1 AS level, c AS col_a, c AS col_b FROM dist WHERE (SELECT count(*) FROM deps WHERE (parent, child) IN (('r_name', 'n_name'), ('n_name', 's_name'))) = 2",
    "suggest_keys": f"WITH {_overlap_sql('customer', KEYS_A, 'orders', KEYS_B)} SELECT place, col_a, col_b, name_sim, unique_a, unique_b, overlap, rank FROM ranked WHERE place < 20",
    "suggest_compares": f"SELECT place, a AS col_a, b AS col_b, sim AS name_sim FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, i, j) - 1 AS place FROM (SELECT a, b, i, j, round({_jaro('a', 'b')}, 3) AS sim FROM {values([(c, i) for i, c in enumerate(NUMBERS)])} x(a, i), {values([(c, i) for i, c in enumerate(OTHERS)])} y(b, j))) WHERE place < 20",
    "auto_pick": f"""WITH {_overlap_sql('orders', ['o_orderkey', 'o_custkey'], 'lineitem', ['l_orderkey', 'l_linenumber'])}, ok AS (SELECT *, row_number() OVER (ORDER BY place) AS p FROM ranked WHERE rank >= 0.02 AND overlap >= 0.5)
SELECT 'key' AS role, 0 AS level, col_a, col_b, 1 AS warnings FROM ok WHERE p = 1
UNION ALL SELECT * FROM (SELECT 'key', 1, x.col_a, x.col_b, 1 FROM ok x JOIN ok f ON f.p = 1 AND x.col_a <> f.col_a AND x.col_b <> f.col_b ORDER BY x.p LIMIT 1)
UNION ALL SELECT 'compare', 0, 'gross', (SELECT CASE WHEN sum(abs(l_extendedprice)) >= sum(abs(l_tax)) THEN 'v' ELSE 'x' END FROM lineitem), 1""",
    "mapped_columns": f"SELECT * FROM {values([('order',), ('amount',), ('tax',), ('parent',), ('note',), ('memo',)])} t(col)",
    "scan_delimited": "SELECT row_number() OVER (ORDER BY n_nationkey) AS src_row, CAST(n_nationkey AS VARCHAR) AS key, lower(n_name) AS name, 'a;' || n_name || ', \"q\"' AS note, CASE WHEN n_nationkey % 20 <> 0 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END AS region, 'utf-8-bom' AS encoding FROM nation",
    "scan_fixed_cp1253": "SELECT row_number() OVER (ORDER BY s_suppkey) AS src_row, s_suppkey AS code, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance, 'cp1253' AS encoding, 'Υπόλοιπο' AS header FROM supplier",
    "scan_xlsx": "SELECT row_number() OVER (ORDER BY n_nationkey) AS src_row, n_nationkey AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN '<' || n_name || ' & co>' END AS again, (n_nationkey + 1) / 10 AS rate FROM nation",
    "scan_xlsx_spec": "SELECT row_number() OVER (ORDER BY n_nationkey) AS src_row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation",
    "scan_delimited_spec": "SELECT row_number() OVER (ORDER BY n_nationkey) AS src_row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation",
    "scan_splits": "SELECT o_orderkey, o_orderpriority, o_orderstatus || '; \"' || o_custkey || '\"' AS note, true AS numbered FROM orders",
    "scan_fixed_splits": "SELECT c_custkey, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM customer",
    "source_rules": f"SELECT * FROM {values([(n, e) for n, _, e in RULES])} t(rule, error)",
    "dedupe_headers": f"SELECT place, name || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place) AS k FROM {values(list(enumerate(HEADERS)))} t(place, name))",
    "recon_smart_keys": _smart_sql(),
    "recon_totals": """WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem WHERE l_orderkey % 89 <> 0 GROUP BY k),
b AS (SELECT l_orderkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2)) + CASE WHEN l_partkey % 101 = 0 THEN 10 ELSE 0 END) AS v FROM lineitem WHERE l_orderkey % 97 <> 0 GROUP BY k),
f AS (SELECT coalesce(a.v, 0) - coalesce(b.v, 0) AS delta, a.k IS NULL OR b.k IS NULL AS one FROM a FULL JOIN b USING (k)) SELECT count(*) AS total, count(*) FILTER (one OR abs(delta) >= 10) AS high FROM f WHERE one OR abs(delta) > 0.01""",
    "m2m_guard": "SELECT 'key (' || n_regionkey || ') has ' || count(*) || ' x ' || count(*) || ', more than 24' AS error FROM nation WHERE n_regionkey = 2 OR n_nationkey < 5 GROUP BY n_regionkey HAVING count(*) * count(*) > 24",
    "refused": f"SELECT * FROM {values([(x, 'SchemaMismatchError') for x in ('no key', 'no compare', 'no column', 'no number', 'only deeper keys')] + [('fine', None)])} t(what, error)",
    "engine_findings": _FLOW
    + f"""SELECT c.level, c.bucket, '{{"nation":"' || c.shown || '"' || CASE WHEN c.level = 1 THEN ',"code":"' || c.code || '"' ELSE '' END || '}}' AS key_json, {_STRIP.format('CAST(c.delta AS DECIMAL(28,6))')} AS delta_micros, coalesce(c.ac, 0) AS rows_a, coalesce(c.bc, 0) AS rows_b,
  CASE WHEN c.level = 1 THEN 'low' WHEN c.bucket <> 'DIFFER' OR abs(c.delta) >= 10 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN c.level = 1 THEN '{{"nation":"' || p.shown || '"}}' END AS parent
FROM g c LEFT JOIN g p ON c.level = 1 AND p.level = 0 AND p.n = c.n WHERE c.bucket <> 'MATCH' AND (c.level = 0 OR p.bucket = 'DIFFER')""",
    "engine_memory": f"SELECT * FROM {values([('Profile', '2'), ('LoadedFile', '2'), ('Fingerprint', '2'), ('DatasetColumn', '6'), ('ReconPair', '1'), ('ColumnMapping', '3'), ('Run', '1'), ('RunLevelStat', '2'), ('first', 'decisions_needed'), ('second', 'completed'), ('again', 'already_loaded'), ('files of ours', '1'), ('files of theirs', '1'), ('mappings of ours vs theirs', '3'), ('unknown pair', 'NotFoundError'), ('keys', 'code=supplier code|nation=nation name'), ('type', 'nation:text'), ('type', 'code:text'), ('type', 'balance:decimal'), ('document', 'True')])} t(what, said)",
    "routing": f"SELECT * FROM {values([(n, r) for n, _, r in ROUTES])} t(file, routing)",
}
