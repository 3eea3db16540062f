"""Structural fingerprints of files, how alike two are, and what has drifted between them."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import column_set_hash, hmac16, nfkc
from tallyfold.operators.infer import SKETCH_CAP, Column, top_values

AUTO_ATTACH, SUGGEST = 0.95, 0.70
WEIGHTS = {"names": 0.40, "types": 0.20, "sketch": 0.20, "nulls": 0.10, "rows": 0.10}
WIDTH = {"integer": 0, "decimal": 1, "text": 2}


@dataclass
class Fingerprint:
    encoding: str
    column_set_hash: str
    types: dict[str, str]
    type_bag: dict[str, int]
    null_rates: dict[str, float]
    bands: dict[str, int]
    row_band: int
    sketch: dict[str, list[str]] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)


def band(n: int) -> int:
    return int(math.log2(n + 1))


def compute(df: DataFrame, encoding: str, columns: list[Column], rows: int, salt: str) -> Fingerprint:
    """Of typed columns named as in `columns`. The sketch has salted hashes of the top values of columns that aren't amounts."""
    sketched = [c.name for c in columns if c.type != "decimal" and 0 < c.distinct <= SKETCH_CAP]
    sketch: dict[str, list[str]] = {}
    if sketched:
        top = top_values(df, sketched).withColumn("v", F.lower(nfkc(F.col("value"))))
        for r in top.withColumn("h", hmac16(F.col("v"), salt)).groupBy("col").agg(F.sort_array(F.collect_set("h")).alias("hs")).collect():  # 20 a column at most
            sketch[r["col"]] = list(r.hs)
    round3 = lambda x: math.floor(x * 1000 + 0.5) / 1000
    return Fingerprint(
        encoding,
        column_set_hash([c.name for c in columns]),
        {c.name: c.type for c in columns},
        dict(Counter(c.type for c in columns)),
        {c.name: round3(c.nulls / rows) if rows else 0.0 for c in columns},
        {c.name: band(c.distinct) for c in columns},
        band(rows),
        sketch,
    )


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def similarity(a: Fingerprint, b: Fingerprint) -> dict[str, float | None]:
    total = sum(a.type_bag.values()) + sum(b.type_bag.values())
    off = sum(abs(a.type_bag.get(t, 0) - b.type_bag.get(t, 0)) for t in {*a.type_bag, *b.type_bag})
    shared = set(a.null_rates) & set(b.null_rates)
    both = [c for c in a.sketch if a.sketch[c] and b.sketch.get(c)]
    parts = {
        "names": jaccard(set(a.types), set(b.types)),
        "types": 1 - off / total if total else 1.0,
        "nulls": 1 - sum(abs(a.null_rates[c] - b.null_rates[c]) for c in shared) / len(shared) if shared else 0.0,
        "rows": 1 / (1 + abs(a.row_band - b.row_band)),
        "sketch": sum(len({*a.sketch[c]} & {*b.sketch[c]}) / min(len({*a.sketch[c]}), len({*b.sketch[c]})) for c in both) / len(both) if both else None,
    }
    used = {k: v for k, v in parts.items() if v is not None}
    return parts | {"score": sum(WEIGHTS[k] * v for k, v in used.items()) / sum(WEIGHTS[k] for k in used)}


def drift(old: Fingerprint, new: Fingerprint, mapped: set[str]) -> dict[str, list[str]]:
    """What changed: hard where a run over mapped columns would be wrong, soft otherwise."""
    hard, soft = [], []
    if old.encoding != new.encoding:
        hard.append(f"ENCODING_CHANGED: {old.encoding} -> {new.encoding}")
    for c, t in old.types.items():
        if c not in new.types:
            hard.append(f"MAPPED_COLUMN_MISSING: {c}") if c in mapped else soft.append(f"UNMAPPED_COLUMN_REMOVED: {c}")
            continue
        now = new.types[c]
        if now != t:
            wider = "date" not in (t, now) and WIDTH[now] > WIDTH[t]
            if wider:
                soft.append(f"TYPE_WIDENED: {c} {t} -> {now}")
            else:
                hard.append(f"TYPE_NARROWED: {c} {t} -> {now}") if c in mapped else soft.append(f"TYPE_NARROWED_UNMAPPED: {c} {t} -> {now}")
        if c in mapped and abs(old.bands.get(c, 0) - new.bands.get(c, 0)) >= 2:
            soft.append(f"CARDINALITY_BAND_CHANGED: {c} {old.bands.get(c, 0)} -> {new.bands.get(c, 0)}")
    soft += [f"COLUMN_ADDED: {c}" for c in new.types if c not in old.types]
    if abs(old.row_band - new.row_band) >= 2:
        soft.append(f"ROW_COUNT_BAND_CHANGED: {old.row_band} -> {new.row_band}")
    return {"hard": hard, "soft": soft}
