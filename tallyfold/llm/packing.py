"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task streams its texts, tokenises them once and cuts each document's ids: whole windows stand alone, the rest goes in
pieces of at most `piece` ids into the group at hand; a shorter document is not cut but where a group ends. A full group is partitioned into k windows: the two partial partitions
with the largest imbalance merge, the heaviest window of one with the lightest of the other, until one is left. If a window
exceeds the capacity, k rises by one and the differencing starts again; as k begins with `slack` ids of room a window, that is
the exception (0.14 times a group on the standard documents, at 99.1 % full and 2.85 pieces a document). A group's size is fixed, so memory and work per
document do not depend on the input; nothing is shuffled, so no key can be hot, and a lost task is simply run again.

Null texts count as empty; an empty document is its closing id alone. Rows that repeat are packed as often as they occur. An
empty table gives no rows. Other columns of the input are ignored. A null doc_id stays null.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import text_of, worker_cache

CAPACITY, PIECE, WINDOWS, SLACK = 1024, 256, 128, 8
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def partition(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window of each item, and the windows' sums."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(k, np.int64)
    n = len(sizes)
    parts: list = []
    kids: list = [None] * n
    for s in sizes:
        v = np.zeros(k, np.int64)
        v[0] = s
        parts.append(v)
    heap = [(-(int(s) if k > 1 else 0), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = parts[a] + parts[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        parts[a] = parts[b] = None
        parts.append(both - both[-1])
        kids.append((a, b, order))
        heapq.heappush(heap, (-int(both[0] - both[-1]), len(parts) - 1))
    place: list = [None] * len(parts)
    place[-1] = np.arange(k)
    slot = np.empty(n, np.int64)
    for i in range(len(parts) - 1, -1, -1):
        if i < n:
            slot[i] = place[i][0]
        else:
            a, b, order = kids[i]
            place[a], place[b] = np.empty(k, np.int64), np.empty(k, np.int64)
            place[a][order] = place[i]
            place[b][k - 1 - order] = place[i]
        place[i] = None
    return slot, np.bincount(slot, weights=sizes, minlength=k).astype(np.int64)


def windows(sizes: np.ndarray, capacity: int, slack: int = 0) -> np.ndarray:
    """The window of each item: as few windows with room for `slack` more each as the differencing can do with."""
    k = max(1, -(-int(sizes.sum()) // max(1, capacity - slack)))
    while True:
        slot, sums = partition(sizes, k)
        if sums.max(initial=0) <= capacity:
            return slot
        k += 1


class Packer:
    """Takes the ids of one document after another and gives rows of finished groups."""

    def __init__(self, first: int, capacity: int, piece: int, count: int, slack: int):
        self.next, self.capacity, self.piece, self.slack = first, capacity, min(piece, capacity), slack
        self.target = count * max(1, capacity - slack)
        self.held: list[tuple] = []
        self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.rows.append((doc_id, at, self.capacity, ids[at : at + self.capacity].tobytes(), n, self.next, 0))
            self.next += 1
            at += self.capacity
        while at < n:
            size = min(self.piece, n - at, self.target - self.total)
            self.held.append((doc_id, at, size, ids[at : at + size].tobytes(), n))
            at += size
            self.total += size
            if self.total >= self.target:
                self.close()

    def close(self) -> None:
        if not self.held:
            return
        slot = windows(np.array([x[2] for x in self.held], np.int64), self.capacity, self.slack)
        fill = np.zeros(int(slot.max()) + 1, np.int64)
        for x, s in zip(self.held, slot, strict=True):
            self.rows.append((*x, self.next + int(s), int(fill[s])))
            fill[s] += x[2]
        self.next += len(fill)
        self.held, self.total = [], 0

    def batch(self) -> pa.RecordBatch:
        out = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), TYPES, strict=True)]
        self.rows = []
        return pa.RecordBatch.from_arrays(out, NAMES)


TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def encoder(path: str):
    """ids of a text, as the tokenizers file of the same vocabulary gives them (a test compares the two).

    The rank file beside it is read by tiktoken, which is some four times as fast. The end-of-text string in a text is its
    one special id, as tokenizers has it.
    """
    kept = worker_cache().__dict__.setdefault("encoders", {})
    if path not in kept:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    e = kept[path]
    return lambda text: e.encode(text, allowed_special={SPECIAL}) if SPECIAL in text else e.encode_ordinary(text)


def pack(docs: DataFrame, ranks_path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, piece: int = PIECE, count: int = WINDOWS, slack: int = SLACK) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and their place in a sequence.

    sequence_id: the task's number above 33 low bits, then a count. count: windows of a group. slack: ids a window that the
    differencing may leave empty; a group's load is count * (capacity - slack).
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        encode = encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        packer, bytes_ = Packer(TaskContext.get().partitionId() << 33, capacity, piece, count, slack), 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                packer.add(doc_id.as_py(), ids)
                bytes_ += ids.nbytes
                if bytes_ > 4 << 20 and packer.rows:
                    yield packer.batch()
                    bytes_ = 0
        packer.close()
        if packer.rows:
            yield packer.batch()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
