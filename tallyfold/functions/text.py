"""Names and keys: normalising, comparing, hashing."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed set: white space as trimmed from cells.
SPACE = r"[\s   -     　﻿]"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def nfkc(c: Column) -> Column:
    """Unicode's compatible composition, by the library that Spark brings along: no Python worker, and only for values beyond ASCII.

    Spark takes calls by reflection for nondeterministic: put this in a projection of its own, not in grouping or join expressions.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def norm_key(c: Column, mode: str = "smart") -> Column:
    """smart: codes of digits with spaces, dots, slashes and dashes lose these and leading zeros, all else its case. raw: as is."""
    if mode == "raw":
        return c
    t = trim_all(nfkc(c.cast("string")))
    digits = F.regexp_replace(F.regexp_replace(t, r"[^0-9]", ""), r"^0+(?=[0-9])", "")
    return F.when(t.rlike(r"^[0-9][0-9 .\-/]*$"), digits).otherwise(F.lower(t))


def norm_column_name(raw: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw).lower().strip())


def sql_name(raw: str, taken: set[str]) -> str:
    """A name for a column: letters, digits, Greek and _; never taken twice."""
    base = re.sub(r"[^a-z0-9_Ͱ-Ͽ]+", "_", norm_column_name(raw)).strip("_") or "col"
    if base[0].isdigit():
        base = f"c_{base}"
    name, k = base, 2
    while name in taken:
        name, k = f"{base}_{k}", k + 1
    taken.add(name)
    return name


def jaro_winkler(a: str, b: str) -> float:
    """Case-insensitive; the common prefix (up to four) always counts a tenth each."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, mine = [True] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            mine.append(c)
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    m, t = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True))
    jaro = (m / len(a) + m / len(b) + (m - t / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def column_set_hash(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()


def hmac16(c: Column, salt_hex: str) -> Column:
    """The first 16 hex digits of HMAC-SHA256, by two nested digests."""
    key = bytes.fromhex(salt_hex)
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in key)), F.encode(c, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in key)), inner), 256), 1, 16)
