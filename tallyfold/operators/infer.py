"""Column inference: types from all values of all columns in one aggregation, canonical values in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.errors import NumberFormatError
from tallyfold.functions.dates import parse_date
from tallyfold.functions.decimals import INTEGER, LEADING_ZERO, TYPE, evidence, number_format, parse_decimal
from tallyfold.functions.text import blank_to_null

TOP, SKETCH_CAP = 20, 10_000


@dataclass
class Column:
    name: str
    type: str
    format: str | None
    nulls: int = 0
    distinct: int = 0
    as_text: bool = False  # said to be integers, but some value is none: kept as written


def trimmed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: blank_to_null(F.col(f"`{c}`")) for c in columns})


def infer(df: DataFrame, columns: list[str], hint: str | None = None, rounding: bool = False, forced: dict[str, tuple[str, str | None]] | None = None) -> list[Column]:
    """Types of trimmed text columns. Dates come before integers, these before decimals; all else is text.

    A forced date or decimal that a value doesn't fit is an error: no amount goes missing. Forced integers that some value
    doesn't fit are kept as they are written.
    """
    forced = forced or {}
    if not columns:
        return []
    aggs = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        greek, standard, separators = evidence(c)
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.isNull()).alias(f"null{i}"),
            F.coalesce(F.bool_and(F.when(c.isNotNull(), parse_date(c).isNotNull())), F.lit(False)).alias(f"date{i}"),
            F.coalesce(F.bool_and(c.rlike(INTEGER)), F.lit(False)).alias(f"int{i}"),
            F.count_if(c.rlike(LEADING_ZERO)).alias(f"zero{i}"),
            greek.alias(f"g{i}"),
            standard.alias(f"s{i}"),
            separators.alias(f"sep{i}"),
            *[F.coalesce(F.bool_and(F.when(c.isNotNull(), parse_decimal(c, f, rounding).isNotNull())), F.lit(False)).alias(f"{f}{i}") for f in ("standard", "greek")],
        ]
    r = df.agg(*aggs).first()
    out = []
    for i, name in enumerate(columns):
        try:
            fmt = number_format(r[f"g{i}"], r[f"s{i}"], r[f"sep{i}"], hint)
        except NumberFormatError:
            fmt = None
        if name in forced:
            kind, given = forced[name]
            if kind == "date" and r[f"n{i}"] and not r[f"date{i}"]:
                raise NumberFormatError(f"{name}: a value is no date")
            own = (given or fmt or hint or "standard") if kind == "decimal" else None
            if own and r[f"n{i}"] and not r[f"{own}{i}"]:
                raise NumberFormatError(f"{name}: a value is no amount of the {own} format")
            out.append(Column(name, kind, own, r[f"null{i}"], as_text=kind == "integer" and bool(r[f"n{i}"]) and not r[f"int{i}"]))
        elif not r[f"n{i}"]:
            out.append(Column(name, "text", None, r[f"null{i}"]))
        elif r[f"date{i}"]:
            out.append(Column(name, "date", None, r[f"null{i}"]))
        elif r[f"int{i}"]:
            out.append(Column(name, "integer", None, r[f"null{i}"]))
        elif not r[f"zero{i}"] and fmt and r[f"{fmt}{i}"]:
            out.append(Column(name, "decimal", fmt, r[f"null{i}"]))
        else:
            out.append(Column(name, "text", None, r[f"null{i}"]))
    return out


def canonical(df: DataFrame, columns: list[Column], rounding: bool = False) -> DataFrame:
    """Typed columns: date, bigint, decimal(28,6) or text; of values that the types of infer() fit."""
    made = {}
    for c in columns:
        v = F.col(f"`{c.name}`")
        if c.type == "date":
            made[c.name] = parse_date(v)
        elif c.type == "integer" and not c.as_text:
            made[c.name] = v.try_cast("bigint")
        elif c.type == "decimal":
            made[c.name] = parse_decimal(v, c.format or "standard", rounding).cast(TYPE)
    return df.withColumns(made) if made else df


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """col and value (as a text) of every cell. Names may hold any character."""
    each = [F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*each)).alias("_v")).select("_v.*")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """col, rows, nulls and distinct non-null values, exactly: values counted once each by one shuffle."""
    each = long_form(df, columns).groupBy("col", "value").agg(F.count("*").alias("n"))
    return each.groupBy("col").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct"))


def top_values(df: DataFrame, columns: list[str], k: int = TOP) -> DataFrame:
    """The k most frequent values of each column (ties by value), with their rank."""
    counts = long_form(df, columns).filter("value IS NOT NULL").groupBy("col", "value").agg(F.count("*").alias("freq"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("freq"), "value"))).filter(F.col("rank") <= k)
