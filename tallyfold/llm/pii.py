"""Personal data by weak supervision.

Base spans are exact: patterns of e-mail addresses, IP addresses, payment cards and phone numbers with their tests. Looser
candidates (addresses spelled out, local phone numbers, names after titles, secrets, street addresses and the like) are
labelled by voters that each say yes, no or nothing: a strict pattern, a gazetteer, the words before, and the shape. Over the
votes of all candidates of all documents, expectation-maximisation estimates each voter's reliability and each kind's share
of true spans; the resulting probabilities train a logistic span classifier on votes, kind and length, and the candidates it
takes are added to the base spans, which always stay. Candidates that touch a base span are not candidates.

One pass over the texts writes spans and votes to the shared folder; votes are counted by pattern, and patterns are few
whatever the input, so only they reach the driver. Texts are never shuffled.

Null and empty texts have no spans. Rows that repeat are searched each. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import in_slices, text_of, written

#: Base kinds in their order, then the method's.
KINDS = ["email", "ip", "card", "phone", "address", "id", "name", "secret"]
TAKE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, but in linear time: each @ is looked at once."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    if not _DOTTED.search(text):
        return []
    return [m.span() for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups())]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []


def base(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) in code points, by kind and start."""
    return [(k, *s) for k, find in enumerate((emails, ips, cards, phones)) for s in find(text)]


#: Gazetteers: fixed lists of common words.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "madame", "monsieur", "sr", "sra", "don")
NAMES = frozenset(
    (
        "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew "
        "kevin brian george edward peter henry frank jack simon oliver harry mary patricia jennifer linda elizabeth barbara susan jessica "
        "sarah karen lisa nancy margaret sandra emily emma laura helen alice julia sophie hans jürgen klaus karl wolfgang stefan thomas "
        "andreas matthias uwe heinz ursula monika petra sabine claudia anna heike pierre jean michel philippe alain nicolas jacques louis "
        "marie nathalie isabelle sylvie catherine françoise luc josé juan carlos luis antonio manuel francisco javier miguel pedro maria "
        "carmen ana isabel dolores pilar rosa"
    ).split()
)
STREETS = frozenset("street st avenue ave road rd lane ln boulevard blvd drive dr platz straße strasse rue calle".split())
TLDS = frozenset("com org net edu gov de fr es uk info io".split())
NEAR = {
    0: frozenset("mail email e-mail contact write reach at".split()),
    3: frozenset("phone tel call telephone mobile fax cell contact number".split()),
    4: frozenset("address live lives at street visit located".split()),
    5: frozenset("ssn social security passport id iban account".split()),
    6: frozenset("name named by dear contact from signed i'm am".split()),
    7: frozenset("password passwd pwd key token secret api aws credential login".split()),
}
#: Numbers that forms and advertisements have shown as examples: nobody's.
SHOWN = frozenset("078-05-1120 219-09-9999 123-45-6789 987-65-4321 111-11-1111".split())
FAR = frozenset("version page pages figure table chapter section isbn order vol no year price model part".split())

#: kind, a string one of which any match contains, pattern (the span is group 1), strict pattern.
_LOOSE = [
    (0, ("dot",), re.compile(r"([A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24})"), re.compile(r".*[\[(]at[\])].*[\[(]dot[\])].*")),
    (3, ("-", ".", " "), re.compile(r"(?<![0-9+-])(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9-])"), re.compile(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}")),
    (4, (" ",), re.compile(r"(?<![0-9])([0-9]{1,5} (?:[A-ZÄÖÜÉ][\w'-]{1,30} ){1,3}(?:[Ss]t(?:reet)?|[Aa]ve(?:nue)?|[Rr]oad|[Rr]d|[Ll]ane|[Bb]lvd|[Bb]oulevard|[Dd]rive))\b"), re.compile(r"[0-9]{1,5} [A-Z].* (?:Street|Avenue|Road|Lane|Boulevard|Drive)")),
    (5, ("-",), re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"), re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")),
    (6, tuple(t[:2].title() for t in TITLES), re.compile(r"\b(?:" + "|".join(t.title() for t in TITLES) + r")\.? ([A-ZÄÖÜÉ][a-zà-ÿ]{1,30}(?: [A-ZÄÖÜÉ][a-zà-ÿ]{1,30})?)"), re.compile(r"\S+ \S+")),
    (7, ("=", ":"), re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}([^\s,;]{4,200})"), re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{8,}")),
    (7, ("AKIA", "ghp_", "sk_"), re.compile(r"\b(AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk_[a-z]{4}_[A-Za-z0-9]{16,64})\b"), re.compile(r"AKIA.*|ghp_.*|sk_.*")),
]


def dialled(digits: str) -> bool:
    """Whether the North American plan gives out such a number: neither part begins with 0 or 1 or is a service code."""
    area, exchange = digits[:3], digits[3:6]
    return area[0] > "1" and area[1] != "9" and area[1:] != "11" and exchange[0] > "1" and exchange[1:] != "11"


def votes(kind: int, text: str, start: int, end: int, strict: re.Pattern) -> tuple[int, ...]:
    """Of the pattern, the gazetteer, the context and the shape: 1 yes, -1 no, 0 nothing to say."""
    span = text[start:end]
    before = [w.strip(".,:;=()").lower() for w in text[max(0, start - 40) : start].split()[-5:]]
    words = {w.strip(".,()[]").lower() for w in span.split()}
    digits = _digits(span)
    pattern = 1 if strict.fullmatch(span) else 0
    if kind == 0:
        gazetteer = 1 if span.rsplit(" ", 1)[-1].strip("()[]").lower() in TLDS else -1
    elif kind == 4:
        gazetteer = 1 if words & STREETS else -1
    elif kind == 6:
        gazetteer = 1 if words & NAMES else 0
    elif kind == 7:
        gazetteer = 1 if span[:4] in ("AKIA", "ghp_") or span.startswith("sk_") else 0
    elif kind == 5:
        gazetteer = -1 if span in SHOWN else 0
    else:
        gazetteer = 1 if dialled(digits) else -1
    context = 1 if any(w.rstrip("=:") in NEAR[kind] for w in before) else -1 if any(w in FAR for w in before[-2:]) else 0
    if kind in (3, 5):
        shape = 1 if len(set(digits)) > 3 else -1
    elif kind == 7:
        shape = 1 if digits and len(digits) < len(span) else -1
    else:
        shape = 1 if 5 <= len(span) <= 60 else -1
    return pattern, gazetteer, context, shape


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, pattern of votes) of loose spans that touch neither a base span nor an earlier candidate."""
    out: list[tuple[int, int, int, str]] = []
    starts, ends = merged([(s, e) for _, s, e in taken])
    for kind, hints, loose, strict in _LOOSE:
        if not any(h in text for h in hints):
            continue
        for m in loose.finditer(text):
            s, e = m.span(1)
            i = bisect_left(starts, e)  # the stretch before this place is the only one that can reach past s
            if i and ends[i - 1] > s:
                continue
            starts.insert(i, s)
            ends.insert(i, e)
            v = votes(kind, text, s, e, strict)
            out.append((kind, s, e, f"{kind}:{','.join(map(str, v))}:{min(3, (e - s) // 10)}"))
    return out


SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
LOOSE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string())]))


def _extract(b: pa.RecordBatch) -> pa.RecordBatch:
    sure, loose = [], []
    for x in b.column("text"):
        text = x.as_py()
        found = base(text)
        sure.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
        loose.append([{"kind": k, "start": s, "end": e, "votes": v} for k, s, e, v in candidates(text, found)])
    return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sure, SPAN), pa.array(loose, LOOSE)], ["doc_id", "base", "loose"])


def extract(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(in_slices(_extract), "doc_id long, base array<struct<kind:int,start:int,end:int>>, loose array<struct<kind:int,start:int,end:int,votes:string>>")


def expectation_maximisation(kind: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Of patterns (kind, votes, count): the probability that a span is true, and the voters' reliabilities.

    A reliability is the chance of each vote given the truth, by voter, truth and vote + 1. Starts from the votes' majority.
    """
    p = 1 / (1 + np.exp(-(v.sum(1) - 0.5)))
    chance = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        share = np.array([(n * p)[kind == k].sum() + 1 for k in range(len(KINDS))]) / np.array([n[kind == k].sum() + 2 for k in range(len(KINDS))])
        for j in range(v.shape[1]):
            for vote in (-1, 0, 1):
                on = v[:, j] == vote
                chance[j, 1, vote + 1] = (n * p)[on].sum() + (2 if vote == 1 else 1)
                chance[j, 0, vote + 1] = (n * (1 - p))[on].sum() + (2 if vote == -1 else 1)
        chance /= chance.sum(2, keepdims=True)
        odds = np.log(share / (1 - share))[kind] + sum(np.log(chance[j, 1, v[:, j] + 1] / chance[j, 0, v[:, j] + 1]) for j in range(v.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, chance


def train(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """The span classifier's probability of each pattern of votes that occurs."""
    if not patterns:
        return {}
    parts = [p.split(":") for p, _ in patterns]
    kind = np.array([int(k) for k, _, _ in parts])
    v = np.array([[int(x) for x in s.split(",")] for _, s, _ in parts])
    size = np.array([int(s) for _, _, s in parts])
    n = np.array([c for _, c in patterns], float)
    p, _ = expectation_maximisation(kind, v, n)
    x = np.hstack([np.eye(len(KINDS))[kind], np.eye(4)[size], *(np.eye(3)[v[:, j] + 1] for j in range(v.shape[1]))])
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * 1000
    for _ in range(25):  # Newton steps of ridge logistic regression on soft labels
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (weight * (q - p)) + 0.1 * w)
    q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {s: float(y) for (s, _), y in zip(patterns, q, strict=True)}


def find(docs: DataFrame, take: float = TAKE) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), kinds by number in KINDS, sorted; spans has base and added ones."""
    found = written(extract(docs), "spans")
    counts = found.select(F.explode("loose").alias("x")).groupBy("x.votes").count()
    model = train(sorted(tuple(r) for r in counts.collect()))  # as many as there are patterns: kinds, votes and lengths
    taken = [s for s, p in model.items() if p >= take]
    kind = "array<struct<kind:int,start:int,end:int>>"
    if taken:
        table = F.array(*[F.lit(s) for s in taken])
        added = F.transform(F.filter("loose", lambda x: F.array_contains(table, x["votes"])), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    else:
        added = F.array().cast(kind)
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("spans"))


def digests(result: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return result.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _is(k: int):
    return lambda x: x["kind"] == k
