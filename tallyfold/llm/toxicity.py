"""Toxicity by a subsequence string kernel and a linear support vector machine on Nystrom features.

The kernel counts common subsequences of three characters whose span is at most `SPAN`, each discounted by DECAY per
character spanned, so that insults with gaps or inserted characters stay near the plain ones. Words are its strings: tokens
between spaces with a mark at the start, letters spelled one by one joined. Training words come from the sentences of labelled
documents; a sentence has its document's label. Landmarks are training words; k(w, landmarks) times the inverse root of their
Gram matrix gives Nystrom features, and a squared-hinge SVM is trained on them. As kernel and machine are linear in the
subsequences, its decision is one weight for each of them: exact, and without landmarks at scoring. A sentence scores as its
worst word, a document by its worst words; a logistic step on labelled documents turns that into a probability.

Words are gathered from at most `sample` labelled documents, and at most so many words of either kind train the machine; all
else runs over all rows and whole texts without a shuffle.

Null and empty texts score as documents without any toxic word. Without labels of both kinds the score is the share of toxic
labels (0 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import flat, in_slices, text_of
from tallyfold.llm.quality import chosen_labels
from tallyfold.llm.words import bounds, hashes

SAMPLE, THRESHOLD = 8000, 0.3
SPAN, DECAY, SYMBOLS, LANDMARKS, WORDS, TOP = 6, 0.6, 64, 480, 6000, 3
PROOF, ROUNDS, BALANCE, COST = 12.0, 5, 8, 1000.0

#: Characters of strings, by byte: 0 none, 1 the start mark, 2-27 letters, 28-37 digits, 63 the end mark; other bytes
#: share the rest.
_SYMBOL = np.array([38 + b % 25 for b in range(256)], np.int64)
END = 63
_SYMBOL[97:123] = np.arange(2, 28)
_SYMBOL[65:91] = np.arange(2, 28)
_SYMBOL[48:58] = np.arange(28, 38)
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False  # what ends a token
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
LONGEST = 64


def norms() -> np.ndarray:
    """Root of the self-kernel of a string of distinct characters, by length."""
    n = np.arange(LONGEST + 3)
    return np.sqrt(np.maximum(sum(np.maximum(n - b, 0) * DECAY ** (2 * (b + 1)) for _, b in _PAIRS), 1e-9))


NORM = norms()


def strings(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, ends, text) of the strings: tokens and joined runs of single letters; longer tokens in parts."""
    starts, ends, of = bounds(data, off, _SPACE)
    text = np.repeat(np.arange(len(off) - 1), np.diff(of))
    # strip marks at either end: they aren't inserted characters
    letter = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | ((data >= 48) & (data <= 57))
    for _ in range(8):
        if not len(starts):
            break
        s = ~letter[starts] & (ends - starts > 1)
        e = ~letter[ends - 1] & (ends - starts - s > 1)
        if not (s.any() or e.any()):
            break
        starts, ends = starts + s, ends - e
    sym = _SYMBOL[data]
    size = ends - starts
    if (long := size > LONGEST).any():
        parts = np.where(long, -(-size // (LONGEST // 2)), 1)
        which = np.repeat(np.arange(len(size)), parts)
        k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = starts[which] + k * (LONGEST // 2)
        ends = np.minimum(starts + np.where(long[which], LONGEST, LONGEST), ends[which])
        text, size = text[which], ends - starts
    one = (size == 1) & letter[starts] if len(starts) else np.zeros(0, bool)
    # Runs of at least three single letters of one text become a further string.
    extra_s, extra_n, extra_t = [], [], []
    if one.any():
        at = np.flatnonzero(one)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])
        first = np.flatnonzero(new)
        count = np.diff([*first, len(at)])
        for i, n in zip(first[count >= 3].tolist(), count[count >= 3].tolist(), strict=True):
            for j in range(0, n, LONGEST // 2):
                extra_s.append(sym[starts[at[i + j : i + min(n, j + LONGEST)]]])
                extra_n.append(len(extra_s[-1]))
                extra_t.append(text[at[i]])
    if extra_s:
        more = np.cumsum([0, *extra_n]) + len(sym)
        sym = np.concatenate([sym, *extra_s])
        starts, ends, text = np.concatenate([starts, more[:-1]]), np.concatenate([ends, more[1:]]), np.concatenate([text, extra_t])
    return sym, starts, ends, text


def padded(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The strings between their marks as rows of symbols, then zeros."""
    wide = int((ends - starts).max(initial=0))
    col = np.arange(wide)
    at = starts[:, None] + col
    inside = at < ends[:, None]
    out = np.zeros((len(starts), wide + 2 + SPAN), np.int64)
    out[:, 0] = 1
    out[:, 1 : wide + 1] = np.where(inside, sym[np.minimum(at, max(0, len(sym) - 1))], 0) if len(sym) else 0
    out[np.arange(len(starts)), ends - starts + 1] = END
    return out


def codes(rows: np.ndarray):
    """For each pair of gaps: the subsequences' numbers by start (0: none), and their discount."""
    n = rows.shape[1] - SPAN
    for a, b in _PAIRS:
        x, y, z = rows[:, :n], rows[:, a : a + n], rows[:, b : b + n]
        yield np.where((x > 0) & (y > 0) & (z > 0), (x * SYMBOLS + y) * SYMBOLS + z, 0), DECAY ** (b + 1)


def decide(rows: np.ndarray, weights: np.ndarray, index: np.ndarray | None = None) -> np.ndarray:
    """For each string the sum of weights over its subsequences, normalised. weights may have several columns.

    index: by subsequence, its row in weights.
    """
    total = 0.0
    for code, d in codes(rows):
        total = total + d * weights[code if index is None else index[code]].sum(1)
    norm = NORM[np.minimum((rows > 0).sum(1), LONGEST + 2)]
    return total / (norm[:, None] if weights.ndim > 1 else norm)


def spread(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised subsequence counts, a column for each string and a row for each subsequence of any; and the rows' index."""
    every = np.unique(np.concatenate([[0], *(np.unique(code) for code, _ in codes(rows))]))
    index = np.zeros(SYMBOLS**3, np.int32)
    index[every] = np.arange(len(every))
    out = np.zeros((len(every), len(rows)))
    for code, d in codes(rows):
        np.add.at(out, (index[code], np.arange(len(rows))[:, None]), d)
    out[0] = 0
    return out / NORM[np.minimum((rows > 0).sum(1), LONGEST + 2)], index


def as_rows(words: list[str]) -> np.ndarray:
    data = [w.encode()[:LONGEST] for w in words]
    off = np.cumsum([0, *map(len, data)])
    sym = _SYMBOL[np.frombuffer(b"".join(data), np.uint8)] if off[-1] else np.zeros(0, np.int64)
    return padded(sym, off[:-1], off[1:])


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = COST) -> np.ndarray:
    """Weights and bias of a squared-hinge linear SVM, by Newton steps on its active set."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(40):
        on = y * (x @ w) < 1
        xs, ws = x[on], weight[on]
        new = np.linalg.solve(ridge + c * (xs * ws[:, None]).T @ xs, c * (xs * ws[:, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


class Model:
    def __init__(self, prior: float):
        self.prior, self.weights, self.bias, self.platt = prior, None, 0.0, None

    def train(self, pos: list[str], neg: list[str], landmarks: int, seen: np.ndarray, anew: bool) -> None:
        """Of the landmarks, three in four are toxic words, half of these the surest ones; of the others half are the last.

        neg only grows from call to call; landmarks are chosen anew on demand, else features of words seen before stay.
        """
        if anew:
            own, more = landmarks * 3 // 8, landmarks // 8
            fair = neg[:: max(1, len(neg) // more)][:more] + neg[-more:]
            marks = as_rows(list(dict.fromkeys(pos[:own] + pos[own :: max(1, (len(pos) - own) // own)][:own] + fair)))
            self.columns, self.index = spread(marks)
            gram = decide(marks, self.columns, self.index)
            value, vector = np.linalg.eigh((gram + gram.T) / 2)
            self.root = vector * (np.maximum(value, 0) + 1e-4) ** -0.5 @ vector.T
            self.columns = self.columns.astype(np.float32)
            self.x = np.zeros((0, len(marks)))
        rows = as_rows((pos + neg)[len(self.x) :])
        fresh = [decide(rows[i : i + 250], self.columns, self.index) @ self.root for i in range(0, len(rows), 250)]
        self.x = np.concatenate([self.x, *fresh])
        y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        w = svm(self.x, y, np.log1p(seen) * np.where(y > 0, max(1.0, len(neg) / len(pos) / BALANCE), 1.0))
        used = self.index > 0
        self.weights = np.zeros(SYMBOLS**3)
        self.weights[used] = (self.columns @ (self.root @ w[:-1]))[self.index[used]]
        self.bias = float(w[-1])

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("prior", "weights", "bias", "platt")}

    def worst(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The decisions of the TOP worst distinct words of each text, worst first; -1 where there are fewer."""
        n = len(off) - 1
        out = np.full((n, TOP), -1.0)
        sym, starts, ends, text = strings(data, off)
        if not len(starts):
            return out
        h = hashes(sym.astype(np.uint8), starts, ends)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        size = (ends - starts)[first]
        f = np.empty(len(first))
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), 20_000):  # rows of like length together
            at = order[i : i + 20_000]
            f[at] = decide(padded(sym, starts[first[at]], ends[first[at]]), self.weights)
        f = np.clip(f + self.bias, -1, 1.5)
        hot = f[which] > -1
        key = text[hot] * (len(first) + 1) + which[hot]
        key = np.unique(key)
        t, v = key // (len(first) + 1), f[key % (len(first) + 1)]
        o = np.lexsort((-v, t))
        t, v = t[o], v[o]
        begin = np.searchsorted(t, np.arange(n))
        place = np.arange(len(t)) - begin[t]
        top = place < TOP
        out[t[top], place[top]] = v[top]
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.weights is None or self.platt is None:
            return np.full(len(off) - 1, self.prior)
        z = self.worst(data, off) @ self.platt[:-1] + self.platt[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
    return w


def sentence_words(docs: DataFrame) -> DataFrame:
    """Words of sentences (doc_id, y, half, text): in how many toxic and other sentences and documents each occurs."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sentences = docs.select("doc_id", "y", F.explode(F.split(low, r"[.!?]+\s+|\n+")).alias("sentence"))
    words = sentences.select("doc_id", "y", F.explode(F.array_distinct(F.split("sentence", r"[ \t\n\x0B\f\r]+"))).alias("w"))
    words = words.select("doc_id", "y", F.regexp_replace("w", r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$", "").alias("w"))
    words = words.filter((F.octet_length("w") > 0) & (F.octet_length("w") <= LONGEST)).distinct()
    return words.groupBy("w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2, sample: int = SAMPLE, landmarks: int = LANDMARKS, words: int = WORDS) -> Model:
    spark = docs.sparkSession
    known = chosen_labels(labels, label, sample, modulus, held)
    bad = sum(y for _, y in known)
    model = Model(bad / len(known) if known else 0.0)
    if bad in (0, len(known)):
        return model
    ids = spark.createDataFrame(known, "doc_id long, y int")
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(F.broadcast(ids), "doc_id").persist()
    good = len(known) - bad
    counts = sentence_words(rows).persist()
    share, rate = bad / len(known), F.col("bad") / (F.col("bad") + F.col("good"))
    odds = F.log((F.col("bad") + 0.1) / bad) - F.log((F.col("good") + 0.1) / good)
    # How much likelier the counts are at the word's own rate than at the overall one: chance hits stay below.
    proof = F.col("bad") * F.log(rate / share) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    positive = counts.filter((odds > 2.5) & (proof > PROOF) & (F.octet_length("w") > 2)).orderBy(F.desc(proof), "w").limit(words // 2).select("w", F.col("bad").alias("n")).collect()
    other = counts.filter((odds < 1) & (F.col("good") > 0)).select("w", F.col("good").alias("n"))
    negative = [*other.orderBy(F.desc("n"), "w").limit(words // 2).collect(), *other.orderBy(F.xxhash64("w"), "w").limit(words // 2).collect()]
    if positive and negative:
        pos, neg = [r.w for r in positive], list(dict.fromkeys(r.w for r in negative))
        seen = {r.w: float(r.n) for r in [*positive, *negative]}
        for step in range(ROUNDS + 1):
            model.train(pos, neg, landmarks, np.array([seen.get(w, 1.0) for w in pos + neg]), step in (0, 2))
            kept = spark.sparkContext.broadcast(model)
            if step < ROUNDS:  # the words that pass for toxic against their labels

                def judge(b: pa.RecordBatch) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([b.column("w"), pa.array(kept.value.worst(*flat(b.column("w")))[:, 0], pa.float64())], ["w", "f"])

                hard = other.select("w").mapInArrow(in_slices(judge, "w", 1 << 18), "w string, f double").orderBy(F.desc("f"), "w").limit(words // 2).collect()
                neg = list(dict.fromkeys(neg + [r.w for r in hard if r.f > -1]))

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            worst = kept.value.worst(*flat(b.column("text")))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(worst.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

        got = rows.mapInArrow(in_slices(run), "doc_id long, y int, x array<double>").orderBy("doc_id").limit(2 * sample).collect()
        model.platt = logistic(np.array([r.x for r in got]), np.array([r.y for r in got], np.float64))
    counts.unpersist()
    rows.unpersist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each document."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept.value.score(*flat(b.column("text"))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(in_slices(run), "doc_id long, score double")
