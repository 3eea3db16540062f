"""Reproducible shuffling and sharding by a Feistel permutation with cycle walking.

Rows are numbered globally: by bucket of the hash of doc_id, then doc_id, size and checksum within the bucket; buckets are
counted first, so a number needs no global sort. The number goes through a keyed Feistel network over a square domain of at
least as many places, again and again until it is below the number of rows: a permutation of the row numbers. Shard and slot
are remainder and quotient by the number of shards, so counts differ by at most one (the law is `rows`), slots have no gaps,
and the place of any row number can be computed alone.

Only doc_id, size and checksum are shuffled, never texts. Null texts have size 16. Rows that repeat (also with a null doc_id)
are numbered each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of, written
from tallyfold.llm.words import mix

SHARDS, ROUNDS, KEY, BUCKETS = 40, 6, 0x5EED, 4096


def permute(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Each of 0..n-1 to one of 0..n-1, all different."""
    side = max(1, math.isqrt(max(0, n - 1)) + 1)
    out = np.asarray(x, np.int64).copy()
    if ((out < 0) | (out >= n)).any():
        raise ValueError("a row number is out of range")
    at = np.arange(len(out))
    while len(at):
        left, right = out[at] // side, out[at] % side
        for r in range(rounds):
            f = mix(right.astype(np.uint64) ^ mix(np.full(len(right), (key * 1_000_003 + r * 7919 + n) & (2**64 - 1), np.uint64)))
            left, right = right, (left + (f % np.uint64(side)).astype(np.int64)) % side
        out[at] = left * side + right
        at = at[out[at] >= n]
    return out


def numbered(docs: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32 and the global row number (from 0); and how many rows there are."""
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = written(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), "part")
    counts = sorted(tuple(r) for r in rows.groupBy("bucket").count().collect())  # as many as buckets at most
    starts, n = [], 0
    for bucket, count in counts:
        starts.append((bucket, n))
        n += count
    before = rows.sparkSession.createDataFrame(starts, "bucket int, before long")
    order = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32")
    return rows.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(before), "bucket").select("doc_id", "size", "text_crc32", (F.col("before") + F.col("at")).alias("row")), n


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row, place (its permuted number), shard and slot of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    rows, n = numbered(docs)

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permute(part.to_numpy(np.int64), n, key))

    out = rows.withColumn("place", place("row"))
    return out.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}")})


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
