"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of `n` consecutive words of the items (a shorter item is one window). Words are the letters of
the search: blocks of up to three words index a table of safe shifts, so that text without a block of the test set is skipped
almost a window at a time; at shift zero the block's hash names a bucket of windows, a prefix hash thins it, and comparison
of the very bytes confirms an occurrence. All lanes of a batch advance together in array operations.

The test set is read a part at a time, in blocks of at most `most_bytes` of text (a longer item is a block of its own). A block
is broadcast as plain text; its tables are arrays of about 60 bytes a word, built by the Python worker that searches. With one
block a worker keeps them; with more it holds `ahead` bytes of documents, takes them through one block after another and lets
each block go. So there is one pass over the documents whatever the number of blocks, nothing is written in between, and
memory is bounded by a block and by `ahead`. The searched side is never shuffled: one source or text however frequent makes no
hot task.

Null texts have no words: n_words and n_hit are 0, contaminated is false. Items without words have no windows. Items with one
id count once; an item without an id is searched but names nothing. Other columns are ignored by decontaminate() and kept by
keep_clean(). An empty test set hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import flat, slices, worker_cache
from tallyfold.llm.words import LOWER, MUL, bounds, grams, hashes, mix

N, MOST_BYTES, AHEAD, LANE, LEAST_HIT = 13, 4 << 20, 32 << 20, 128, 1


def block_hashes(h: np.ndarray, b: int) -> np.ndarray:
    """Of the b words that end at each place (b - 1 fewer places)."""
    out = h[b - 1 :].copy()
    for j in range(1, b):
        out = out * MUL + h[b - 1 - j : len(h) - j]
    return mix(out)


class Class:
    """Shift, bucket and prefix tables of the windows that share one search; m is the shortest of them.

    first and length: the windows' places among the items' words, whose hashes are h.
    """

    def __init__(self, h: np.ndarray, first: np.ndarray, length: np.ndarray, item: np.ndarray):
        self.h, self.m = h, int(length.min())
        m, self.b = self.m, min(3, self.m)
        b = self.b
        blocks = block_hashes(h, b)  # of the b words from each place on
        self.bits = int(min(24, max(16, np.ceil(np.log2(len(first) * (m - b + 1) + 1)) + 3)))
        self.shift = np.full(1 << self.bits, min(m - b + 1, 255), np.uint8)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, blocks[first + j] >> np.uint64(64 - self.bits), min(m - b - j, 255))
        suffix, prefix = blocks[first + m - b], blocks[first]
        order = np.lexsort((prefix, suffix))
        self.suffix, self.prefix = suffix[order], prefix[order]
        self.first, self.length, self.item = first[order], length[order], item[order]

    def ends(self, blocks: np.ndarray, n_words: int) -> np.ndarray:
        """Places of the last of m words whose last block has shift zero. blocks: by place, from b - 1 on."""
        at = np.arange(self.m - 1, n_words, LANE)
        stop = np.minimum(at + LANE, n_words)
        found = []
        while len(at):
            s = self.shift[blocks[at - self.b + 1] >> np.uint64(64 - self.bits)]
            if not s.all():
                found.append(at[s == 0])
            at = at + np.maximum(s, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.concatenate(found) if found else at

    def candidates(self, blocks: np.ndarray, n_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First words and windows for which suffix bucket and prefix agree, a part at a time."""
        end = self.ends(blocks, n_words)
        last, first = blocks[end - self.b + 1], blocks[end - self.m + 1]
        lo, hi = np.searchsorted(self.suffix, last, "left"), np.searchsorted(self.suffix, last, "right")
        some = hi > lo
        end, first, lo, n = end[some], first[some], lo[some], (hi - lo)[some]
        through = np.concatenate([[0], np.cumsum(n)])
        k = 0
        while k < len(end):  # a frequent block meets its whole bucket
            stop = max(k + 1, int(np.searchsorted(through, through[k] + 200_000, "right")) - 1)
            which = np.repeat(np.arange(k, stop), n[k:stop])
            p = np.arange(len(which)) - (through[which] - through[k]) + lo[which]
            ok = self.prefix[p] == first[which]
            yield end[which[ok]] - self.m + 1, p[ok]
            k = stop


class Patterns:
    """The windows of (item_id, text) rows. Those of full length and the shorter ones are two searches."""

    def __init__(self, items: list[tuple], n: int = N):
        texts = [(t or "").encode() for _, t in items]
        self.items = [i for i, _ in items]
        self.data = LOWER[np.frombuffer(bytearray().join(texts), np.uint8)]
        self.starts, self.ends, of = bounds(self.data, np.cumsum([0, *map(len, texts)]))
        self.h = hashes(self.data, self.starts, self.ends)
        count = np.diff(of)
        own = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), own)
        first = np.arange(len(item)) - np.repeat(np.cumsum(own) - own, own) + of[:-1][item]
        length = np.minimum(count, n)[item]
        full = length == n
        keep = self._distinct(first[full], item[full], n)
        split = ((first[full][keep], length[full][keep], item[full][keep]), (first[~full], length[~full], item[~full]))
        self.classes = [Class(self.h, *x) for x in split if len(x[0])]

    def _distinct(self, first: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
        """Places of windows, each once for an item that repeats it: equal hashes are compared in full."""
        if not len(first):
            return first
        g = grams(self.h, n)[first]
        order = np.lexsort((first, g, item))
        same = np.zeros(len(order), bool)
        same[1:] = (g[order[1:]] == g[order[:-1]]) & (item[order[1:]] == item[order[:-1]])
        for i in np.flatnonzero(same):
            same[i] = self.words(first[order[i]], n) == self.words(first[order[i - 1]], n)
        return np.sort(order[~same])

    def words(self, first: int, n: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[first : first + n], self.ends[first : first + n], strict=True)]

    def search(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, words, item) of every occurrence. of: places of each text's first word, one more at the end."""
        found: list[tuple[int, int, int]] = []
        for c in self.classes:
            if len(h) < c.m:
                continue
            for at, which in c.candidates(block_hashes(h, c.b), len(h)):
                if not len(at):
                    continue
                size, first = c.length[which], c.first[which]
                fits = (at + size <= of[np.searchsorted(of, at, "right")]) & (h[at[:, None] + np.arange(c.m)] == self.h[first[:, None] + np.arange(c.m)]).all(1)
                for a, p, n, i in zip(at[fits].tolist(), first[fits].tolist(), size[fits].tolist(), c.item[which][fits].tolist(), strict=True):
                    if all(data[s:e].tobytes() == x for s, e, x in zip(starts[a : a + n], ends[a : a + n], self.words(p, n), strict=True)):
                        found.append((a, n, i))
        return found


HITS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("item", pa.string())]))
HITS_SQL = "array<struct<start:int,words:int,item:string>>"


class Text:
    """A slice of rows with its words."""

    def __init__(self, b: pa.RecordBatch):
        self.batch = b
        data, off = flat(b.column(b.schema.get_field_index("text")))
        self.data = LOWER[data]
        self.starts, self.ends, self.of = bounds(self.data, off)
        self.h = hashes(self.data, self.starts, self.ends)
        self.rows: list[list] = [[] for _ in range(b.num_rows)]

    def search(self, p: Patterns) -> None:
        found = p.search(self.data, self.starts, self.ends, self.of, self.h)
        text = np.searchsorted(self.of, [a for a, _, _ in found], "right") - 1
        for (a, n, item), t in zip(found, text.tolist(), strict=True):
            self.rows[t].append({"start": a - int(self.of[t]), "words": n, "item": None if (i := p.items[item]) is None else str(i)})

    def out(self) -> pa.RecordBatch:
        more = [pa.array(np.diff(self.of), pa.int64()), pa.array(self.rows, HITS)]
        return pa.RecordBatch.from_arrays([*self.batch.columns, *more], [*self.batch.schema.names, "n_words", "hits"])


def _patterns(kept, n: int, only: bool) -> Patterns:
    """Of a block: kept by the worker if it is the only one, else let go after use."""
    cache = worker_cache().__dict__
    if only and cache.get("patterns_of") == (kept._path, n):
        return cache["patterns"]
    items = kept.value
    kept.__dict__.pop("_value", None)
    made = Patterns(items, n)
    if only:
        cache["patterns_of"], cache["patterns"] = (kept._path, n), made
    return made


def blocks(bench: DataFrame, most_bytes: int) -> Iterator[list[tuple]]:
    """(item_id, text) rows of the test set, at most so many bytes of text at once: the driver holds one block."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    held: list[tuple] = []
    size = 0
    for r in items.toLocalIterator():
        own = len((r.text or "").encode())
        if held and size + own > most_bytes:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += own
    yield held


def occurrences(docs: DataFrame, bench: DataFrame, n: int = N, most_bytes: int = MOST_BYTES, ahead: int = AHEAD) -> DataFrame:
    """docs (with text, and other columns too) with n_words and hits: array of first word, words and item of each occurrence."""
    sc = docs.sparkSession.sparkContext
    kept = [sc.broadcast(b) for b in blocks(bench, most_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(kept) == 1:
            p = None
            for b in slices(batches, "text"):
                p = p or _patterns(kept[0], n, True)
                t = Text(b)
                t.search(p)
                yield t.out()
            return
        held: list[Text] = []
        size = 0
        for b in slices(batches, "text"):
            held.append(Text(b))
            size += len(held[-1].data)
            if size >= ahead:
                yield from through(held)
                held, size = [], 0
        if held:
            yield from through(held)

    def through(held: list[Text]) -> Iterator[pa.RecordBatch]:
        for k in kept:
            p = _patterns(k, n, False)
            for t in held:
                t.search(p)
        yield from (t.out() for t in held)

    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "hits")])
    more = [T.StructField("n_words", T.LongType()), T.StructField("hits", T._parse_datatype_string(HITS_SQL))]
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *more]))


def judged(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items and contaminated from hits; words inside any occurrence are hit once."""
    ordered = F.array_sort("hits")
    acc = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    hit = F.aggregate(
        ordered,
        acc,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["words"] - F.greatest(a["end"], x["start"]))).cast("long").alias("n"),
            F.greatest(a["end"], x["start"] + x["words"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda x: x["item"]), lambda x: x.isNotNull())))
    out = found.withColumns({"n_hit": F.coalesce(hit, F.lit(0).cast("long")), "items": F.coalesce(items, F.array().cast("array<string>"))})
    return out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = N, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), hits and contaminated of each document."""
    return judged(occurrences(docs.select("doc_id", F.col("text").cast("string").alias("text")), bench, n, most_bytes)).drop("text")


def keep_clean(docs: DataFrame, bench: DataFrame, n: int = N, most_bytes: int = MOST_BYTES, least_hit: int = LEAST_HIT) -> DataFrame:
    """The rows of docs with fewer than `least_hit` hit words, with all their columns.

    One verbatim window is a leak however long the document, so by default any hit removes it; this is stricter than
    `contaminated`, which is a share of the document's words.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("_tallyfold_none"))
    found = judged(occurrences(docs.select(rest.alias("rest"), F.col("text").cast("string").alias("text")), bench, n, most_bytes))
    return found.filter(F.col("n_hit") < least_hit).select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
