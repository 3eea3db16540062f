"""Near-duplicates by DartMinHash signatures and banded joining.

A document is the weighted set of its shingles of five words (lower-cased A-Z; a shorter text is one shingle), weighted by
how often each occurs. Over the region of an element and one unit of its weight, hashed darts fall as a Poisson process in
rank: the gaps between darts are exponential, drawn from hashes of element, unit and number of the dart, so that equal regions
catch equal darts in every document. Each dart names one coordinate; the earliest dart of a coordinate is kept. As many darts
are thrown as cover all coordinates with near certainty, and more where one is left empty. Two documents agree in a coordinate
with the probability of their weighted Jaccard similarity.

Pairs are defined by their sets of shingles, whose similarity can be far above the weighted one where shingles repeat. So a
text in which any does also has the signature of its plain set (each shingle once), bands of both, and what rules pairs out before
the exact check is the plain sets' signature. Where nothing repeats the two signatures are one.

Documents with equal shingles are one class before anything is joined. A band's bucket of many classes gives a pair of
each with a leader; pairs are confirmed by the exact Jaccard similarity of their sets of shingles. Where members are not
all of one component by then, bounds and shingles that the leader lacks find the further pairs (see linked()): no link between
different texts of a bucket is lost, and copies, however many, are never expanded into pairs. Components are found by joins with cut
lineage, those of a graph of few links (SMALL) in one task; nothing but counts comes to the driver. What a join reads twice is
written first: else Spark would run the Python before it twice.

Null and empty texts have no shingles: each is a class of its own kind (all of them one class of equal texts), never linked. A
document that repeats is a member each time. An empty table gives no rows. Rows with a null doc_id are members of their class; one of such rows
only has a null copy_id, a group of them a null class_id. A row's doc_id and the hash of its text (mark) find it again: different texts may have one doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import flat, in_slices, text_of, written
from tallyfold.llm.words import LOWER, bounds, grams, hashes, mix

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 32, 6
PAIRED, FEW, SPLIT = 3, 24, 1024
SMALL = 1 << 18
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and for each text the place of its first (one more at the end)."""
    low = LOWER[data]
    starts, ends, of = bounds(low, off)
    h = hashes(low, starts, ends)
    count = np.diff(of)
    own = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(own)])
    out = np.zeros(first[-1], np.uint64)
    full = grams(h, n)
    text = np.repeat(np.arange(len(count)), own)
    at = of[:-1][text] + np.arange(len(out)) - first[:-1][text]
    long = count[text] >= n
    out[long] = full[at[long]]
    for t in np.flatnonzero((count > 0) & (count < n)):
        x = np.uint64(count[t])
        for w in h[of[t] : of[t + 1]]:
            x = mix(np.array([x ^ w], np.uint64))[0]
        out[first[t]] = x
    return out, first


def weighted(out: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, unit), sorted: the unit counts a shingle's occurrences in its text from 0."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((out, text))
    text, out = text[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    return text, out, np.arange(len(out)) - np.repeat(start, np.diff([*start, len(out)]))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, element: np.ndarray, unit: np.ndarray, n: int, k: int) -> np.ndarray:
    """DartMinHash: k values for each of n texts; 0 in all coordinates of a text without elements."""
    total = np.bincount(text, minlength=n)
    rank, value = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    left = np.flatnonzero(total)
    below = (k * np.log(k) + 2 * k) / np.maximum(total, 1)  # darts up to this rank cover all coordinates as a rule
    done = np.zeros(n)
    region = mix(element ^ mix(unit.astype(np.uint64) + GOLD))
    at, r, dart = np.arange(len(text)), np.zeros(len(text)), np.zeros(len(text), np.uint64)
    waiting: list = []
    while len(left):
        while len(at):
            seed = mix(region[at] + (dart + np.uint64(1)) * GOLD)
            r = r - np.log(_uniform(seed))
            dart = dart + np.uint64(1)
            hit = r < below[text[at]]
            waiting.append((at[~hit], r[~hit], dart[~hit], seed[~hit]))
            at, r, dart, seed = at[hit], r[hit], dart[hit], seed[hit]
            _throw(rank, value, text[at] * k, r, seed, k)
        bad = np.flatnonzero(np.isinf(rank.reshape(n, k)[left]).any(1))
        if not len(bad):
            break
        left = left[bad]
        again = np.zeros(n, bool)
        again[left] = True
        below[left] *= 2
        # Darts already drawn that now lie below the bound count; the process goes on from there.
        parts = [tuple(c[again[text[w[0]]]] for c in w) for w in waiting]
        a, ar, ad, aseed = (np.concatenate(c) for c in zip(*parts, strict=True))
        hit = ar < below[text[a]]
        waiting = [(a[~hit], ar[~hit], ad[~hit], aseed[~hit])]
        at, r, dart = a[hit], ar[hit], ad[hit]
        _throw(rank, value, text[at] * k, r, aseed[hit], k)
    del done
    return value.reshape(n, k)


def _throw(rank: np.ndarray, value: np.ndarray, base: np.ndarray, r: np.ndarray, seed: np.ndarray, k: int) -> None:
    """Keeps the earliest dart of each coordinate."""
    dart = mix(seed)
    cell = base + (dart % np.uint64(k)).astype(np.int64)
    np.minimum.at(rank, cell, r)
    won = rank[cell] == r
    value[cell[won]] = dart[won]


def _or_none(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-1).cast("long"))


def _key(shingles_: np.ndarray) -> bytes:
    """Of the ordered shingles: equal for copies."""
    return hashlib.sha256(shingles_.tobytes()).digest()[:16]


def _banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bands' hashes of each signature; a band's hash is its own."""
    band = sig[:, ::rows].copy()
    for j in range(1, rows):
        band = mix(band * GOLD + sig[:, j::rows])
    return mix(band + np.arange(bands, dtype=np.uint64))


def described(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """doc_id, mark (of the text as it is), key (of the ordered shingles), size (how many), hashes of the bands of either signature, and the plain set's signature's low bytes."""
    k = bands * rows

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, first = shingles(*flat(b.column("text")), n=shingle)
        n = b.num_rows
        text, element, unit = weighted(raw, first)
        sig = signatures(text, element, unit, n, k)
        band = _banded(sig, bands, rows)
        repeats = np.bincount(text[unit > 0], minlength=n) > 0
        once = (unit == 0) & repeats[text]
        plain = np.where(repeats[:, None], signatures(text[once], element[once], unit[once], n, k), sig)
        more = _banded(plain, bands, rows)
        own = np.hstack([np.ones((n, bands), bool), more != band])  # a text is in a bucket once
        ends = np.concatenate([[0], np.cumsum(own.sum(1))])
        keys = [_key(raw[first[i] : first[i + 1]]) for i in range(n)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.hstack([band, more])[own].view(np.int64)))
        low = [r.tobytes() for r in (plain >> np.uint64(40)).astype(np.uint8)]
        cols = [b.column("doc_id"), b.column("mark"), pa.array(keys, pa.binary()), pa.array(np.diff(first), pa.int64()), lists, pa.array(low, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "key", "size", "bands", "sig"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    return rows_.mapInArrow(in_slices(run, most=2 << 20), "doc_id long, mark long, key binary, size long, bands array<long>, sig binary")


def sets_of(docs: DataFrame, need: DataFrame, shingle: int) -> DataFrame:
    """The set of shingles (sorted, 64-bit) of each needed class (class, key, and its row's doc and mark)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, first = shingles(*flat(b.column("text")), n=shingle)
        own = [raw[first[i] : first[i + 1]] for i in range(b.num_rows)]
        ok = pa.array([_key(x) == k.as_py() for x, k in zip(own, b.column("key"), strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([b.column("class"), pa.array([np.unique(x).tobytes() for x in own], pa.binary())], ["class", "shingles"]).filter(ok)

    rows = docs.select(_or_none("doc_id").alias("doc"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text")).join(need, ["doc", "mark"])
    return rows.select("class", "key", "text").mapInArrow(in_slices(run), "class long, shingles binary").dropDuplicates(["class"])


def beside(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b, s) with the value x of a and y of b.

    s deals the pairs of one a over parts, and a's value goes to each part it has: an a of however many pairs makes no hot task.
    """
    heads = pairs.select("a", "s").distinct().join(values.select(F.col("class").alias("a"), F.col(column).alias("x")), "a")
    return pairs.join(heads, ["a", "s"]).join(values.select(F.col("class").alias("b"), F.col(column).alias("y")), "b")


def dealt() -> Column:
    """s of pairs (a, b) of groups that are few."""
    return F.pmod(F.xxhash64("b"), F.lit(16)).cast("long")


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs whose plain sets' signatures don't rule them out: agreement 4.5 deviations and more below `least` does."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("x", "y"))
            same = ((x == y).mean(1) - 1 / 256) / (255 / 256)
            bound = least - 4.5 * np.sqrt(least * (1 - least) / x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in "abs"], ["a", "b", "s"]).filter(pa.array(same >= bound))

    return beside(pairs, reps, "sig").select("a", "b", "s", "x", "y").mapInArrow(run, "a long, b long, s long")


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose sets of shingles are at least so similar."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # Lengths alone rule some out.
    m, n = F.octet_length("x"), F.octet_length("y")
    return beside(pairs, sets, "shingles").filter(F.least(m, n) >= F.greatest(m, n) * least).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b, s, root): a, b, root, how many shingles b has, how many of them are a's, and which are not."""

    def run(batches):
        for b in batches:
            size, same, other = [], [], []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                rest = np.setdiff1d(q, p, assume_unique=True)
                size.append(len(q))
                same.append(len(q) - len(rest))
                other.append(rest.view(np.int64))
            cols = [b.column("a"), b.column("b"), b.column("root"), pa.array(size, pa.int64()), pa.array(same, pa.int64()), pa.array(other, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "root", "size", "same", "other"])

    return beside(pairs, sets, "shingles").select("a", "b", "root", "x", "y").mapInArrow(run, "a long, b long, root long, size long, same long, other array<long>")


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and for each its component's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node and root (its component's smallest node) for every node of the edges (a, b).

    Of edges that are `small` in number, one task finds them; more are joined with their labels until none moves.
    """

    def run(batches):
        a, b = zip(*((x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if x.num_rows), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in roots(np.concatenate(a), np.concatenate(b))], ["node", "root"])

    if not (n := edges.count()):
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if n <= small:
        return written(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "part")
    each = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "part")
    label = written(each.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "part")
    while True:
        near = each.join(label, each.b == label.node).groupBy("a").agg(F.min("root").alias("m"))
        low = label.join(near, label.node == near.a).select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        up = low.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = written(low.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("was")).alias("moved")), "part")
        moved = not new.filter("moved").isEmpty()
        label = new.select("node", "root")
        if not moved:
            return label


def linked(docs: DataFrame, reps: DataFrame, least: float, shingle: int) -> DataFrame:
    """Components (node, root) of the classes (see described()) under confirmed similarity.

    Groups are at first the bands' buckets. Members of the smallest are compared with each other, those of others with a
    leader: of the classes that any member meets anywhere, the one that meets most. So all groups around one text have it as
    their leader, and a member is compared with it once, in parts of about SPLIT members. Let a member
    share p shingles with the leader and have u others, a second one q and v. If no other shingle is common to both, their
    similarity is at most min(p, q) / (max(p, q) + u + v). So what can still be similar, among members of one leader that are
    not of one component by then, either passes that bound, found by size, or shares a shingle the leader lacks. As the
    two have at least `least` of either's shingles in common, they share one even of the rarest of those, but for as many of
    the most frequent as they must share. Few sharing one are compared at once; many are a group of the next round, where a
    group has to be eight times as large not to count as few: so the rounds end.
    """
    spots = reps.select("class", F.explode("bands").alias("g")).repartition("g")
    groups = written(spots.join(spots.groupBy("g").count().filter("count > 1"), "g"), "groups")
    need = groups.select("class").distinct().join(reps, "class").select("class", "key", "doc", "mark")
    sets = written(sets_of(docs, need, shingle), "sets")
    compare = lambda pairs: written(confirmed(written(likely(pairs, reps, least), "part"), sets, least), "part")
    found, most = None, FEW

    def joined(more: DataFrame) -> DataFrame:
        """Components with further edges: those so far stand as edges of each node and its root."""
        return components(more if found is None else found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    while not groups.isEmpty():
        few = groups.filter(F.col("count") <= PAIRED)
        direct = few.select("g", F.col("class").alias("a")).join(few.select("g", F.col("class").alias("b")), "g").filter("a < b")
        many = written(groups.filter(F.col("count") > PAIRED), "part")
        meets = groups.groupBy("class").agg(F.sum("count").alias("meets"))
        rank = F.struct("meets", (-F.col("class")).alias("minus"))
        best = many.join(meets, "class").groupBy("g").agg(F.max(rank).alias("best"))
        best = many.join(best, "g").groupBy("class").agg(F.max("best").alias("best"))
        lead = many.join(best, "class").groupBy("g").agg(F.max("best").alias("best"))
        led = many.join(lead, "g").select((-F.col("best.minus")).alias("a"), F.col("class").alias("b"), F.struct("g", "count").alias("at")).filter("a != b")
        # A pair with a leader (star) stands in the part of one of its groups.
        pairs = led.union(direct.select("a", "b", F.lit(None).cast(led.schema["at"].dataType))).groupBy("a", "b").agg(F.min("at").alias("at"))
        part = F.xxhash64("at.g", F.pmod(F.xxhash64("b"), F.ceil(F.col("at.count") / SPLIT)))
        star = F.col("at").isNotNull()
        pairs = written(pairs.select("a", "b", F.when(star, part).otherwise(dealt()).alias("s"), star.alias("star")), "part")
        star = pairs.filter("star").select("a", "b", "s")
        found = joined(compare(pairs))
        named = star.join(found, star["b"] == found["node"], "left").select("a", "b", "s", F.coalesce("root", "b").alias("root"))
        mixed = named.groupBy("a").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("a")
        open_ = written(named.join(star.select("a", "s").distinct().join(mixed, "a"), ["a", "s"]), "part")
        if open_.isEmpty():
            break
        parts = written(differences(open_, sets), "part")
        ratio = F.lit(1 / least)
        reach = F.floor(ratio * F.col("same") - (F.col("size") - F.col("same")) + 1e-9)
        low = F.ceil(F.col("size") * least - 1e-9)
        x = parts.filter(reach >= low).select("a", F.col("b").alias("x"), F.col("root").alias("rx"), F.col("same").alias("p"), F.explode(F.sequence(low, reach)).alias("size"))
        y = parts.select("a", F.col("b").alias("y"), F.col("root").alias("ry"), F.col("same").alias("q"), "size")
        sized = x.join(y, ["a", "size"]).filter("p <= q AND rx != ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        least_common = F.greatest(F.lit(1), F.ceil(F.col("size") * least - F.col("same") - 1e-9))
        own = parts.select("a", "b", "root", (F.size("other") - least_common + 1).alias("prefix"), F.explode("other").alias("w"))
        own = own.join(own.groupBy("a", "w").agg(F.count("*").alias("often")), ["a", "w"])
        own = own.withColumn("at", F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "w"))).filter("at <= prefix AND often > 1")
        own = written(own.select("a", "b", "root", "w"), "part")
        by = own.groupBy("a", "w").agg(F.count("*").alias("count"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("a", "w", "count")
        shared = written(own.join(by, ["a", "w"]), "part")
        few = shared.filter(F.col("count") <= most)
        x = few.select("a", "w", F.col("b").alias("x"), F.col("root").alias("rx"))
        y = few.select("a", "w", F.col("b").alias("y"), F.col("root").alias("ry"))
        paired = x.join(y, ["a", "w"]).filter("x < y AND rx != ry").select(F.col("x").alias("a"), F.col("y").alias("b"))
        further = written(sized.union(paired).distinct().withColumn("s", dealt()), "part")
        if not further.isEmpty() and not (further := compare(further)).isEmpty():
            found = joined(further)
        groups = written(shared.filter(F.col("count") > most).select(F.xxhash64("a", "w").alias("g"), F.col("b").alias("class"), "count"), "part")
        most *= 8
    return found if found is not None else reps.select(F.col("class").alias("node"), F.col("class").alias("root"))


def _classed(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, mark, copy_id, class_id and root (its group's own number) of every row."""
    all_ = written(described(docs, bands, rows, shingle), "darts")
    # Equal rows of the table meet once per task: min and the first set are combined before the shuffle.
    copies = written(all_.groupBy("key").agg(F.min("doc_id").alias("first")), "part")
    # A class has the number of its first document; where that is null or of several classes, all have numbers of their own.
    odd = not copies.filter("first IS NULL").isEmpty() or not copies.groupBy("first").count().filter("count > 1").isEmpty()
    copies = written(copies.withColumn("class", F.monotonically_increasing_id()), "part") if odd else copies.withColumn("class", F.col("first"))
    # By doc_id too: a key however frequent makes no hot task here.
    one = all_.withColumn("doc", _or_none("doc_id")).filter("size > 0")
    reps = one.join(copies.select("key", "class", _or_none("first").alias("doc")), ["doc", "key"]).dropDuplicates(["class"])
    reps = written(reps.select("class", "key", "doc", "mark", "bands", "sig"), "classes")
    found = linked(docs, reps, least, shingle)
    named = copies.join(found, copies["class"] == found["node"], "left").select("key", F.col("first").alias("copy_id"), F.coalesce("root", "class").alias("root"))
    if odd:
        named = written(named, "part")
        named = named.join(named.groupBy("root").agg(F.min("copy_id").alias("class_id")), "root")
    else:
        named = named.withColumn("class_id", F.col("root"))
    return all_.select("doc_id", "mark", "key").join(named, "key").select("doc_id", "mark", "copy_id", "class_id", "root")


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, copy_id (smallest doc_id with equal shingles) and class_id (smallest of its group of near-duplicates) of every row."""
    return _classed(docs, **how).select("doc_id", "copy_id", "class_id")


def keep(docs: DataFrame, **how) -> DataFrame:
    """The rows that stay, with all their columns: of each group the one with the smallest doc_id.

    Of a group's rows that repeat with that doc_id, one stays. Texts without words are one group.
    """
    rows = written(_classed(docs, **how), "part")
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    tied = written(rows.filter(first).groupBy("root").agg(F.count("*").alias("n"), F.min("mark").alias("least")).filter("n > 1"), "part")
    gone = rows.filter(~first).select("doc_id", "mark")
    marked = docs.withColumns({"_doc": F.col("doc_id").cast("long"), "_mark": F.xxhash64(text_of())})
    own = [F.col(f"`{c}`") for c in docs.columns]

    def joined(these: DataFrame, how_: str) -> DataFrame:
        these = written(these.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).distinct(), "part")
        return marked.join(these, marked["_doc"].eqNullSafe(these["_d"]) & (marked["_mark"] == these["_m"]), how_)

    if tied.isEmpty():
        return joined(gone, "left_anti").select(*own)
    ties = rows.filter(first).join(tied, "root")
    back = joined(ties.filter("mark = least"), "left_semi").dropDuplicates(["_doc", "_mark"])
    return joined(gone.union(ties.select("doc_id", "mark")), "left_anti").select(*own).union(back.select(*own))
