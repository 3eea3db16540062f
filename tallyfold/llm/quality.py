"""Quality by nearest-neighbour voting among latent-semantic vectors.

Terms of a text are its lower-cased words (hashed to a fixed number of terms), trigrams of its character shapes (case, digit,
space, line end, each common mark) and, of its words, whether one repeats a neighbour or an earlier run. Log counts times
inverse document frequency, those of words at half weight, projected on the leading singular directions of
labelled texts, make its latent-semantic vector. Every document meets all labelled vectors in blocks of exact cosine
products; the nearest of them vote with their similarity to a power.

The fit reads at most `sample` labelled rows (those with the smallest hashes of doc_id), so what is broadcast has a fixed
bound: sample * (rank + 1) numbers and the projection. Everything else runs over all rows and whole texts, without a shuffle.

Null and empty texts have no terms; their score is the share of good labels in the sample. Without any labelled row the score
is 0.5. Null labels are left out. Labelled documents that repeat count as often as they occur, up to 2 * sample rows in all
(those with the smallest doc_ids).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import flat, in_slices, text_of
from tallyfold.llm.words import LOWER, bounds, hashes, mix

SAMPLE, RANK, NEAREST, POWER, THRESHOLD = 3000, 48, 25, 4.0, 0.3
SHAPES, REPEATS, WORDS, WORD_WEIGHT = 16, 32, 1024, 0.5
#: Texts whose vectors a worker holds at once: their counts take 60 kB each.
BLOCK = 512
DIMS = SHAPES**3 + REPEATS + WORDS

_SHAPE = np.full(256, 15, np.uint8)  # other marks and control characters
_SHAPE[97:123] = 0
_SHAPE[65:91] = 1
_SHAPE[48:58] = 2
_SHAPE[128:] = 3
_SHAPE[[32, 9]] = 4
_SHAPE[[10, 13]] = 5
for _i, _marks in enumerate((b".", b",", b"!", b"?", b"|", b"#$%&*", b"<>{}[]()=/\\_", b"-:;'\"@+")):
    _SHAPE[list(_marks)] = 6 + _i


def terms(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Log counts of terms, a row for each text."""
    n = len(off) - 1
    out = np.zeros((n, DIMS), np.float32)
    if not len(data):
        return out
    text = np.repeat(np.arange(n), np.diff(off))
    s = _SHAPE[data].astype(np.int64)
    code = (s[:-2] * SHAPES + s[1:-1]) * SHAPES + s[2:]
    inner = text[:-2] == text[2:]
    out[:, : SHAPES**3] = np.bincount(text[:-2][inner] * SHAPES**3 + code[inner], minlength=n * SHAPES**3).reshape(n, -1)
    low = LOWER[data]
    starts, ends, of = bounds(low, off)
    if len(starts):
        h = hashes(low, starts, ends)
        own = np.repeat(np.arange(n), np.diff(of))
        words = np.diff(of).astype(np.float64)
        out[:, -WORDS:] = np.bincount(own * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        ratio = np.zeros((2, n))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        ratio[0] = np.bincount(own[same], minlength=n)
        # A run of three words that has stood before in this text.
        if len(h) > 2:
            tri = mix(h[:-2] ^ mix(h[1:-1] ^ mix(h[2:])))
            inside = own[:-2] == own[2:]
            key = mix(tri[inside] ^ mix(own[:-2][inside].astype(np.uint64)))
            order = np.argsort(key, kind="stable")
            again = np.zeros(len(key), bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            ratio[1] = np.bincount(own[:-2][inside][again], minlength=n)
        ratio /= np.maximum(words, 1)
        step = np.minimum((ratio * 16).astype(int), 15)
        for j in range(2):
            rows = np.flatnonzero(step[j] > 0)
            # a term for each sixteenth reached: many of them stand for much repetition
            for k in range(1, 16):
                hit = rows[step[j][rows] >= k]
                out[hit, SHAPES**3 + 16 * j + k] = words[hit]
    np.log1p(out, out=out)
    out[:, -WORDS:] *= WORD_WEIGHT
    return out


def directions(z: np.ndarray, rank: int, steps: int = 8) -> np.ndarray:
    """The leading right singular vectors of z, by subspace iteration: no square matrix of terms is made."""
    q = np.random.default_rng(0).standard_normal((z.shape[1], rank + 8)).astype(np.float32)
    for _ in range(steps):
        q, _ = np.linalg.qr(z.T @ (z @ q))
    _, _, turn = np.linalg.svd(z @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :rank]).astype(np.float32)


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int, nearest: int, power: float):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.nearest, self.power = nearest, power
        self.idf = np.log((1 + len(y)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        if len(y):
            x *= self.idf  # in its place: the sample is the largest thing the driver holds
            z = self._unit(x)
            self.axes = directions(z, rank)
            self.known, self.labels = self._unit(z @ self.axes), y.astype(np.float32)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        """x, scaled in its place."""
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        return x

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if self.prior in (0.0, 1.0) or not hasattr(self, "axes"):
            return out
        k = min(self.nearest, len(self.labels))
        for i in range(0, len(x), block):
            part = x[i : i + block]
            v = self._unit(self._weigh(part) @ self.axes)
            cos = v @ self.known.T
            at = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cos, at, 1), 0) ** self.power
            total = w.sum(1)
            vote = (w * self.labels[at]).sum(1) / np.maximum(total, 1e-9)
            seen = (part.any(1)) & (total > 1e-9)
            out[i : i + block][seen] = vote[seen]
        return np.clip(out, 0, 1)


def chosen_labels(labels: DataFrame, label: str, sample: int, modulus: int, held: int) -> list[tuple]:
    """At most `sample` (doc_id, label) of rows outside the held-out part."""
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % modulus != held))
    return [tuple(r) for r in own.select(F.col("doc_id").cast("long"), F.col(label).cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(sample).collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, sample: int = SAMPLE, rank: int = RANK, nearest: int = NEAREST, power: float = POWER) -> Model:
    spark = docs.sparkSession
    known = chosen_labels(labels, label, sample, modulus, held)
    if not known:
        return Model(np.zeros((0, DIMS), np.float32), np.zeros(0), rank, nearest, power)
    ids = spark.createDataFrame(known, "doc_id long, y int")
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(F.broadcast(ids), "doc_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = terms(*flat(b.column("text")))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], ["doc_id", "y", "x"])

    got = rows.mapInArrow(in_slices(run, most=1 << 20, rows=BLOCK), "doc_id long, y int, x binary").orderBy("doc_id").limit(2 * sample).collect()
    x = np.zeros((len(got), DIMS), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(zlib.decompress(r.x), np.float32)
    return Model(x, np.array([r.y for r in got], np.float64), rank, nearest, power)


def score(docs: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1; any column of that name is replaced."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = kept.value.score(terms(*flat(b.column("text"))))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["row", "text", "s"])

    own = [c for c in docs.columns if c != to]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != "text"], F.lit(0).alias("_tallyfold_none")).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields, T.StructField("s", T.DoubleType())])
    out = rows.mapInArrow(in_slices(run, most=1 << 20, rows=BLOCK), schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in own], F.col("s").alias(to))
