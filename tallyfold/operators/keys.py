"""Join keys and compare columns: suggested from overlap and uniqueness, picked where they are clear."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import jaro_winkler, norm_key
from tallyfold.operators.infer import Column, long_form
from tallyfold.operators.reconcile import Mapping

NAME_SIM, HIGH_UNIQUE, MOST = 0.5, 0.9, 20
KEY_OVERLAP, KEY_RANK, COMPARE_SIM = 0.5, 0.02, 0.6


def round3(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


def value_sets(df: DataFrame, columns: list[str]) -> DataFrame:
    """col, norm and n: the distinct normalised values of each column and how often each occurs."""
    long = long_form(df, columns).filter("value IS NOT NULL").select("col", norm_key(F.col("value")).alias("norm"))
    return long.groupBy("col", "norm").agg(F.count("*").alias("n"))


def overlaps(a: DataFrame, b: DataFrame, cols_a: list[str], cols_b: list[str]) -> DataFrame:
    """col_a, col_b, distinct values and non-nulls of either, and common values, of all pairs of columns: one join."""
    x, y = value_sets(a, cols_a), value_sets(b, cols_b)
    size = lambda v, s: v.groupBy(F.col("col").alias(f"col_{s}")).agg(F.count("*").alias(f"distinct_{s}"), F.sum("n").alias(f"rows_{s}"))
    common = x.select(F.col("col").alias("col_a"), "norm").join(y.select(F.col("col").alias("col_b"), "norm"), "norm").groupBy("col_a", "col_b").agg(F.count("*").alias("common"))
    every = size(x, "a").crossJoin(size(y, "b"))  # a row for each pair of columns
    return every.join(common, ["col_a", "col_b"], "left").fillna(0, ["common"])


@dataclass(frozen=True)
class KeyCandidate:
    col_a: str
    col_b: str
    name_sim: float
    unique_a: float
    unique_b: float
    overlap: float
    rank: float


def suggest(a: DataFrame, b: DataFrame, cols_a: list[Column], cols_b: list[Column]) -> tuple[list[KeyCandidate], list[tuple[str, str, float]]]:
    """Key candidates by rank, and compare candidates (col_a, col_b, similarity of names)."""
    keys_a, keys_b = ([c.name for c in cs if c.type != "decimal"] for cs in (cols_a, cols_b))
    place = {(x, y): (i, j) for i, x in enumerate(keys_a) for j, y in enumerate(keys_b)}
    found = []
    for r in overlaps(a, b, keys_a, keys_b).collect() if keys_a and keys_b else []:
        sim = jaro_winkler(r.col_a, r.col_b)
        ua, ub = r.distinct_a / r.rows_a, r.distinct_b / r.rows_b
        overlap = r.common / min(r.distinct_a, r.distinct_b)
        if (sim >= NAME_SIM or (ua >= HIGH_UNIQUE and ub >= HIGH_UNIQUE)) and round3(overlap) > 0:
            found.append(KeyCandidate(r.col_a, r.col_b, round3(sim), round3(ua), round3(ub), round3(overlap), round3(overlap * math.sqrt(ua * ub))))
    found.sort(key=lambda c: (-c.rank, -c.name_sim, place[c.col_a, c.col_b]))
    numbers = [[c.name for c in cs if c.type in ("integer", "decimal")] for cs in (cols_a, cols_b)]
    compare = sorted(((x, y, round3(jaro_winkler(x, y))) for x in numbers[0] for y in numbers[1]), key=lambda c: -c[2])
    return found[:MOST], compare[:MOST]


def auto_pick(a: DataFrame, b: DataFrame, cols_a: list[Column], cols_b: list[Column]) -> tuple[list[Mapping], list[str]]:
    """Mappings that are clear without being asked, and warnings."""
    keys, _ = suggest(a, b, cols_a, cols_b)
    good = [k for k in keys if k.rank >= KEY_RANK and k.overlap >= KEY_OVERLAP]
    out, warnings = [], []
    if good:
        first = good[0]
        out.append(Mapping("key", 0, first.col_a, first.col_b))
        second = next((k for k in good[1:] if k.col_a != first.col_a and k.col_b != first.col_b), None)
        if second:
            out.append(Mapping("key", 1, second.col_a, second.col_b))
    dec_a, dec_b = ([c.name for c in cs if c.type == "decimal"] for cs in (cols_a, cols_b))
    if not dec_a or not dec_b:
        warnings.append("a side has no decimal column to compare")
        return out, warnings
    named = [(x, y) for x in dec_a for y in dec_b if round3(jaro_winkler(x, y)) >= COMPARE_SIM]
    if not named:
        named = [(largest_total(a, dec_a), largest_total(b, dec_b))]
        warnings.append(f"no amounts have like names; {named[0][0]} and {named[0][1]} are the largest")
    return out + [Mapping("compare", 0, x, y) for x, y in named], warnings


def largest_total(df: DataFrame, columns: list[str]) -> str:
    """The column whose absolute values sum to most."""
    r = df.agg(*[F.coalesce(F.sum(F.abs(f"`{c}`")), F.lit(0)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return max(enumerate(columns), key=lambda x: (r[x[0]], -x[0]))[1]
