"""Exact deduplication by Grace hashing.

Texts are equal when identical after lower-casing A-Z only. A GraceTable takes records into an open-addressing table that
compares complete content; whenever what it holds exceeds its budget, the records, merged so far, go to spill files by some bits
of their hash, and each file is treated likewise with the next bits, until a bucket fits. It runs twice: within each task's own rows,
so that a text however frequent leaves a task once, and after a shuffle by hash over what is left.

Null counts as empty. Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any; of rows that
repeat with one doc_id, one stays. An empty table gives no rows. Other columns are ignored by decide() and kept by keep().
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import slices, text_of, written

BUDGET, FANOUT_BITS, CHUNK = 96 << 20, 4, 1 << 16


class GraceTable:
    """Merges records (hash, content, payload) of equal content: merge(payload held, payload new) gives the one to hold.

    size: bytes of a payload, which count in the budget like the content. full: whether a payload leaves at once, so that a
    content's payload has a bound however often it occurs: it goes to `ready`, for the caller to take, and the content goes on
    without one. Records that no longer fit are merged as far as the budget reaches before they are spilled.
    """

    def __init__(self, merge: Callable, budget: int = BUDGET, size: Callable = lambda p: 0, full: Callable = lambda p: False, depth: int = 0, folder: str | None = None):
        self.merge, self.budget, self.size, self.full, self.depth, self.folder = merge, budget, size, full, depth, folder
        self.slots: list = [None] * 1024
        self.count = self.bytes = self.spilled = 0
        self.files: list | None = None
        self.ready: list[tuple] = []

    def add(self, h: bytes, content: bytes, payload) -> None:
        i = self._find(h, content)
        held = self.slots[i]
        if held is None:
            held = self.slots[i] = [h, content, payload]
            self.count += 1
            self.bytes += len(content) + 200 + self.size(payload)
            if 3 * self.count > 2 * len(self.slots):
                self._grow()
        elif held[2] is None:
            held[2] = payload
            self.bytes += self.size(payload)
        else:
            self.bytes -= self.size(held[2])
            held[2] = self.merge(held[2], payload)
            self.bytes += self.size(held[2])
        if self.full(held[2]):
            self.ready.append(tuple(held))
            self.bytes -= self.size(held[2])
            held[2] = None
        if self.bytes > self.budget and self.count > 1 and (self.depth + 1) * FANOUT_BITS <= 64:
            self._flush()

    def _find(self, h: bytes, content: bytes) -> int:
        """Linear probing: the place of this content, or the free one where it belongs."""
        mask = len(self.slots) - 1
        i = int.from_bytes(h[8:16], "little") & mask
        while (held := self.slots[i]) is not None and not (held[0] == h and held[1] == content):
            i = (i + 1) & mask
        return i

    def _grow(self) -> None:
        old, self.slots = self.slots, [None] * (2 * len(self.slots))
        for x in old:
            if x is not None:
                self.slots[self._find(x[0], x[1])] = x

    def _flush(self) -> None:
        """All that is held goes to the spill files; the table starts anew."""
        if self.files is None:
            self.folder = self.folder or tempfile.mkdtemp(prefix="grace-")
            self.files = [open(os.path.join(self.folder, f"{self.depth}-{id(self)}-{j}"), "w+b") for j in range(1 << FANOUT_BITS)]  # noqa: SIM115
        for x in self.slots:
            if x is not None and x[2] is not None:
                j = (int.from_bytes(x[0][:8], "little") >> (self.depth * FANOUT_BITS)) & ((1 << FANOUT_BITS) - 1)
                pickle.dump(tuple(x), self.files[j], 5)
                self.spilled += 1
        self.slots, self.count, self.bytes = [None] * 1024, 0, 0

    def taken(self) -> list[tuple]:
        """What is ready since the last call."""
        out, self.ready = self.ready, []
        return out

    def results(self) -> Iterator[tuple]:
        """Each content once, but for those that left before; the spill files go as they are read."""
        try:
            yield from self.taken()
            if self.files is None:
                yield from (tuple(x) for x in self.slots if x is not None and x[2] is not None)
                return
            self._flush()
            for f in self.files:
                f.seek(0)
                inner = GraceTable(self.merge, self.budget, self.size, self.full, self.depth + 1, self.folder)
                while True:
                    try:
                        x = pickle.load(f)
                    except EOFError:
                        break
                    inner.add(*x)
                    yield from inner.taken()
                f.close()
                os.unlink(f.name)
                yield from inner.results()
        finally:
            if self.depth == 0 and self.folder:
                shutil.rmtree(self.folder, ignore_errors=True)


def normal(text: str | None) -> bytes:
    return (text or "").encode().lower()  # of bytes, lower() changes A-Z alone


def _out(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r, n in rows:
        held.append(r)
        size += n
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _later(a, b) -> bool:
    """Whether row id a stays rather than b."""
    return a is not None and (b is None or a > b)


PARTIAL = pa.schema([("task", pa.int64()), ("local", pa.int64()), ("sha256", pa.binary()), ("text", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("most", pa.int64()), ("most_at", pa.int64())])
MERGED = pa.schema([("task", pa.int64()), ("local", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keeps", pa.bool_()), ("text_sha256", pa.string())])
MERGE_SQL = "task long, local long, keep_id long, group_size long, keeps boolean, text_sha256 string"


def _extend(a: list, b: list) -> list:
    a += b
    return a


def decide(docs: DataFrame, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    A task's texts, each once with the ids of its rows there (in lists of at most about `chunk`, each with the text), are
    written to the shared folder; they are merged across tasks by hash without those ids, and meet them again by task and
    place, where no key is frequent. So a text of any number of rows takes memory and time in proportion to them.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        table = GraceTable(_extend, budget, lambda ids: 40 * len(ids or ()), lambda ids: len(ids) >= chunk)

        def records():
            for b in slices(batches, "text"):
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    content = normal(text.as_py())
                    table.add(hashlib.sha256(content).digest(), content, [doc_id])
                yield from table.taken()
            yield from table.results()

        def rows():
            for i, (h, c, ids) in enumerate(records()):
                most = max((x for x in ids if x is not None), default=None)
                yield {"task": task, "local": i, "sha256": h, "text": c, "doc_ids": ids, "most": most, "most_at": ids.index(most)}, len(c) + 8 * len(ids) + 64

        yield from _out(rows(), PARTIAL)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def both(a, b):
            return (b[0] if _later(b[0], a[0]) else a[0], a[1] + b[1], _extend(a[2], b[2]))

        table = GraceTable(both, budget, lambda x: 120 * len(x[2]) if x else 0)
        for b in slices(batches, "text"):
            for task, place, h, text, n, most in zip(*(b.column(x).to_pylist() for x in ("task", "local", "sha256", "text", "n", "most")), strict=True):
                table.add(h, text, (most, n, [(task, place, most)]))

        def rows():
            for h, _, (keep, n, parts) in table.results():
                winner = min((t, p) for t, p, most in parts if most == keep)
                for t, p, _ in parts:
                    yield {"task": t, "local": p, "keep_id": keep, "group_size": n, "keeps": (t, p) == winner, "text_sha256": h.hex()}, 120

        yield from _out(rows(), MERGED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    partial = written(rows.mapInArrow(local, "task long, local long, sha256 binary, text binary, doc_ids array<long>, most long, most_at long"), "exact")
    merged = partial.select("task", "local", "sha256", "text", F.size("doc_ids").cast("long").alias("n"), "most").repartition("sha256").mapInArrow(merge, MERGE_SQL)
    each = partial.select("task", "local", "doc_ids", "most_at").join(merged, ["task", "local"])
    each = each.select("keep_id", "group_size", "text_sha256", "keeps", "most_at", F.posexplode("doc_ids").alias("at", "doc_id"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("keeps") & (F.col("at") == F.col("most_at"))).alias("kept"), "text_sha256")


def keep(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows that stay, with all their columns: each task's own first, then those of all tasks by hash."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GraceTable(lambda a, b: b if _later(b["doc_id"], a["doc_id"]) else a, budget, lambda r: len(r["text"] or "") + 100 if r else 0)
        schema = None
        for b in slices(batches, "text"):
            schema = b.schema
            for r in b.to_pylist():
                content = normal(r["text"])
                table.add(hashlib.sha256(content).digest(), content, r)
        if schema is not None:
            yield from _out(((r, len(c) + 100) for _, c, r in table.results()), schema)

    own = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_tallyfold_none")).alias("rest"))
    one = own.mapInArrow(first, own.schema)
    # Only the place of the row depends on this hash; equality is decided by content.
    again = one.repartition(F.sha2(F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)).mapInArrow(first, own.schema)
    return again.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns])
