"""Files as DataFrames of text columns with their row numbers."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.errors import DelimitedParseError, EncodingDetectionError, HeaderDetectionError, ParseSpecError
from tallyfold.functions.text import trim_all
from tallyfold.sources import delimited, encoding, xlsx
from tallyfold.sources import spec as specs


@dataclass
class Scanned:
    """What a file holds: names and rows of texts, and how it was read."""

    name: str
    format: str
    encoding: str
    header: list[str]
    rows: list[list[str]]
    forced: dict[str, tuple[str, str | None]]
    table: DataFrame | None = None  # in place of rows: src_row and the columns in order
    count: int | None = None

    @property
    def size(self) -> int:
        return len(self.rows) if self.count is None else self.count

    def frame(self, spark: SparkSession, names: list[str]) -> DataFrame:
        if self.table is not None:
            return self.table.toDF("src_row", *names)
        data = pd.DataFrame(self.rows, columns=range(len(names)), dtype=object)
        data.insert(0, "src_row", range(1, len(data) + 1))
        schema = "src_row long, " + ", ".join(f"`{n}` string" for n in names)
        data.columns = ["src_row", *names]
        return spark.createDataFrame(data, schema)


def parse(name: str, content: bytes, spec: specs.Spec | None = None) -> Scanned:
    """By spec, or as the file explains itself."""
    if name.lower().endswith(".xlsx"):
        matrix = xlsx.read_first_sheet(name, content)
        if spec:
            header, rows = specs.apply_xlsx(name, matrix, spec)
        else:
            header, rows = delimited.dedupe_headers(matrix[0]) if matrix else [], matrix[1:]
            delimited.assert_header(name, header)
        return Scanned(name, "xlsx", "xlsx", header, rows, {})
    enc, text = encoding.detect(name, content)
    if spec and spec.kind == "fixed":
        header, rows = specs.parse_fixed(text, spec)
        return Scanned(name, "fixed", enc, header, rows, specs.forced(spec))
    if spec:
        header, rows = specs.parse_delimited(name, text, spec)
    else:
        rows = delimited.parse(name, text, delimited.sniff(name, text))
        header, rows = (rows[0], rows[1:]) if rows else ([], [])
        delimited.assert_header(name, header)
    return Scanned(name, "delimited", enc, header, rows, {})


def read_bytes(spark: SparkSession, path: str) -> tuple[str, bytes, str]:
    """(file name, content, SHA-256) of one file, by Spark's own reader."""
    r = spark.read.format("binaryFile").load(path).select("content").first()
    content = bytes(r.content)
    return os.path.basename(path), content, hashlib.sha256(content).hexdigest()


def size_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and number of the files; no content is read."""
    r = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    return r.size, r.n


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of bytes as Windows-1253: text (null where a byte is undefined) and how many Greek letters it has."""
    for b in batches:
        text, greek = [], []
        for x in b.column("value"):
            try:
                t = x.as_py().decode("cp1253")
            except UnicodeDecodeError:
                t = None
            text.append(t)
            greek.append(encoding.greek_letters(t or ""))
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(greek, pa.int64()), b.column("file"), b.column("block")], ["value", "greek", "file", "block"])


def text_lines(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, str]:
    """value, file and block of every line of files of any size, and their encoding: as encoding.detect() decides, but in splits."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if raw.filter(~F.is_valid_utf8("value")).isEmpty():
        first = raw.first()
        return raw, "utf-8-bom" if first and first.value.startswith("\ufeff") else "utf-8"
    text = raw.select(F.col("value").cast("binary").alias("value"), "file", "block").mapInArrow(_decode, "value string, greek long, file string, block long")
    r = text.agg(F.sum("greek").alias("greek"), F.count_if(F.col("value").isNull()).alias("bad")).first()
    if r.bad:
        raise EncodingDetectionError(f"{name}: neither UTF-8 nor Windows-1253: {r.bad} lines")
    if r.greek < encoding.GREEK_LEAST:
        raise EncodingDetectionError(f"{name}: not UTF-8, and too little Greek for Windows-1253; refusing to guess")
    return text.drop("greek"), "cp1253"


def scan_staged(spark: SparkSession, path: str, staging: str, delimiter: str | None = None, spec: specs.Spec | None = None) -> tuple[Scanned, int, str]:
    """Delimited or fixed-width files of any size, read in splits, checked whole and numbered: what they hold, bytes, identity.

    Without a spec or a delimiter, this is found from the first lines. Delimited files have a header each (unless the spec
    names the columns); rows may be short, not long; a quote must close on its line. Lines are written once, parsed, to the
    staging folder with the split they come from; a row's number is its place in its split and the rows of the splits before
    (files by path). The identity is of all rows with their numbers and the header.
    """
    name = os.path.basename(path.rstrip("/"))
    line = F.col("value")
    lines, enc = text_lines(spark, path, name)
    fixed = spec is not None and spec.kind == "fixed"
    head = 1 if not fixed and (spec is None or spec.has_header) else 0
    if fixed:
        kept = lines.filter(F.length(trim_all(line)) >= spec.min_length)
        for p in spec.skip_patterns:
            kept = kept.filter(~line.rlike(p))
        header = [c["name"] for c in spec.columns]
        cells = F.struct(*[trim_all(F.substring(line, c["start"] + 1, c["end"] - c["start"])).alias(f"c{i}") for i, c in enumerate(spec.columns)])
        wrong = F.lit(None).cast("string")
    else:
        kept = lines.filter(F.length(F.trim(line)) > 0)
        top = [r.value for r in kept.select("value").limit(delimited.SNIFFED).collect()]
        if not top:
            raise HeaderDetectionError(f"{name} is empty")
        top[0] = top[0].removeprefix("\ufeff")
        delimiter = delimiter or (spec and spec.delimiter) or delimited.sniff(name, "\n".join(top))
        header = delimited.parse(name, top[0], delimiter)[0]
        names = [c["name"] for c in spec.columns] if spec else []
        if names and len(names) != len(header):
            raise ParseSpecError(f"{name}: {len(names)} names for {len(header)} columns")
        if spec is None:
            delimited.assert_header(name, header)
        cells = F.from_csv(line, ", ".join(f"c{i} string" for i in range(len(header))), {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
        fields = F.size(F.split(F.regexp_replace(line, '"[^"]*"', ""), re.escape(delimiter), -1))
        quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
        wrong = F.when(quotes % 2 == 1, "quote").when(fields > len(header), "long")
        header = names or header
    kept = kept.select(cells.alias("cells"), wrong.alias("wrong"), "file", "block", F.octet_length("value").alias("bytes"), F.monotonically_increasing_id().alias("id"))
    kept.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    # A row for each split: their number grows with the input, at one for 128 MB.
    splits = staged.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    heads = F.when(F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1, head).otherwise(0)
    splits = splits.withColumn("head", heads).withColumn("before", F.coalesce(F.sum(F.col("n") - F.col("head")).over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = staged.join(splits, ["file", "block"]).withColumn("at", F.col("id") - F.col("least") + 1 - F.col("head"))
    own = [F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(f"c{i}") for i in range(len(header))]
    if head:
        found = placed.filter("at = 0").select(F.regexp_replace(F.to_json("cells"), "\ufeff", "").alias("h")).distinct().limit(2).collect()
        if len(found) > 1:
            raise HeaderDetectionError(f"{name}: its files have different headers")
    table = placed.filter("at > 0").select((F.col("before") + F.col("at")).alias("src_row"), *own)
    bad = staged.filter("wrong IS NOT NULL").groupBy("wrong").count().orderBy("wrong").first()
    if bad:
        raise DelimitedParseError(f"{name}: {bad['count']} lines have " + ("more fields than the header" if bad.wrong == "long" else "a quote that does not close"))
    size = staged.agg(F.sum(F.col("bytes").cast("long") + 1)).first()[0] or 0
    r = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")).alias("h")).first()
    identity = hashlib.sha256(f"{header}:{r.n}:{r.h}".encode()).hexdigest()
    return Scanned(name, "fixed" if fixed else "delimited", enc, header, [], specs.forced(spec) if fixed else {}, table, r.n), size, identity
