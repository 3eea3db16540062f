"""Functional dependencies between columns, the chains they form, and the levels they propose."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONSISTENCY, MOST_PARENTS, RATIO = 0.95, 10_000, 1.5


@dataclass(frozen=True)
class Dependency:
    parent: str
    child: str
    parent_distinct: int
    child_distinct: int
    consistency: float
    kind: str


def fd_matrix(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """parent, child, total and violating rows of each pair: one aggregation over grouping sets of the children.

    A child's group violates if its parents differ, that is if their minimum and maximum do. Those of texts can't be hashed, so
    texts stand for two hashes of 64 bits each: only values that agree in both would pass for one.
    """
    children = sorted({c for _, c in pairs})
    parents = sorted({p for p, _ in pairs})
    kinds = dict(df.dtypes)
    cols, ends = [F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(children)], []
    for i, p in enumerate(parents):
        v = F.col(f"`{p}`")
        each = [F.xxhash64(v), F.xxhash64(v, F.lit(1))] if kinds[p].startswith(("string", "varchar", "char", "binary")) else [v]
        cols += [F.when(v.isNotNull(), x).alias(f"p_{i}_{j}") for j, x in enumerate(each)]
        ends.append([f"p_{i}_{j}" for j in range(len(each))])
    src = df.select(*cols)
    aggs = [F.grouping_id().alias("gid")]
    for i, names in enumerate(ends):
        differ = [F.min(n) != F.max(n) for n in names]
        aggs += [F.count(names[0]).alias(f"n_{i}"), (differ[0] if len(differ) == 1 else differ[0] | differ[1]).alias(f"v_{i}")]
    keys = [F.col(f"c_{i}") for i in range(len(children))]
    grouped = src.groupingSets([[k] for k in keys], *keys).agg(*aggs)
    full = (1 << len(children)) - 1
    rows = []
    for p, c in pairs:
        i, j = parents.index(p), children.index(c)
        mine = (F.col("gid") == full - (1 << (len(children) - 1 - j))) & F.col(f"c_{j}").isNotNull()
        rows.append(F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child"), F.when(mine, F.col(f"n_{i}")).otherwise(0).alias("total"), F.when(mine & F.col(f"v_{i}"), F.col(f"n_{i}")).otherwise(0).alias("violating")))
    return grouped.select(F.explode(F.array(*rows)).alias("r")).select("r.*").groupBy("parent", "child").agg(F.sum("total").alias("total"), F.sum("violating").alias("violating"))


def detect(df: DataFrame, distinct: dict[str, int]) -> list[Dependency]:
    """Dependencies child -> parent among the given columns (text, integer or date) and their distinct counts."""
    names = list(distinct)
    pairs = [(p, c) for p in names for c in names if p != c and 2 <= distinct[p] <= MOST_PARENTS and distinct[c] > 1 and distinct[c] >= distinct[p]]
    out = []
    for r in fd_matrix(df, pairs).collect() if pairs else []:  # a row for each pair of columns
        if r.total and (share := math.floor((1 - r.violating / r.total) * 1000 + 0.5) / 1000) >= CONSISTENCY:
            kind = "aggregation" if distinct[r.child] / distinct[r.parent] >= RATIO else "descriptive"
            out.append(Dependency(r.parent, r.child, distinct[r.parent], distinct[r.child], share, kind))
    return sorted(out, key=lambda d: (d.kind != "aggregation", d.parent_distinct, d.parent.lower(), d.child.lower()))


def chains(deps: list[Dependency]) -> list[list[str]]:
    """Paths of aggregation from columns that are nobody's child; children by their distinct counts."""
    below: dict[str, list[Dependency]] = {}
    for d in deps:
        if d.kind == "aggregation":
            below.setdefault(d.parent, []).append(d)
    for v in below.values():
        v.sort(key=lambda d: d.child_distinct)
    out: list[list[str]] = []

    def walk(path: list[str]) -> None:
        more = [d.child for d in below.get(path[-1], []) if d.child not in path]
        if not more and len(path) > 1:
            out.append(path)
        for c in more:
            walk([*path, c])

    for root in [p for p in below if not any(d.child == p for v in below.values() for d in v)]:
        walk([root])
    return out


def propose_levels(deps_a: list[Dependency], deps_b: list[Dependency], candidates: list[tuple[str, str]]) -> list[dict]:
    """An order of key candidates from coarse to fine in which each depends on the next on both sides."""

    def card(deps: list[Dependency], name: str) -> float:
        return next((n for d in deps for c, n in ((d.parent, d.parent_distinct), (d.child, d.child_distinct)) if c == name), math.inf)

    ranked = sorted(candidates, key=lambda x: max(card(deps_a, x[0]), card(deps_b, x[1])))
    out: list[dict] = []
    for a, b in ranked:
        if not out:
            out.append({"level": 0, "col_a": a, "col_b": b, "why": "root"})
            continue
        p = out[-1]
        if any(d.parent == p["col_a"] and d.child == a for d in deps_a) and any(d.parent == p["col_b"] and d.child == b for d in deps_b):
            out.append({"level": len(out), "col_a": a, "col_b": b, "why": f"{p['col_a']} -> {a} and {p['col_b']} -> {b}"})
    return out
