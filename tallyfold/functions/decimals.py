"""Exact decimal amounts: decimal(28,6) values, decimal(38,6) sums, never doubles."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.errors import NumberFormatError

TYPE = "decimal(28,6)"
# Fixed patterns of evidence for a number format; a value may match both.
GREEK_EVIDENCE = r"(,[0-9]{1,6}-?$)|(-?[0-9]{1,3}(\.[0-9]{3}){2,},?)|([0-9]-$)"
STANDARD_EVIDENCE = r"(\.[0-9]{1,6}\)?$)|(-?\(?[0-9]{1,3}(,[0-9]{3}){1,})|(^\()"
INTEGER = r"^-?(0|[1-9][0-9]{0,17})$"
LEADING_ZERO = r"^-?0[0-9]"
SCIENTIFIC = r"^-?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+$"


def parse_decimal(c: Column, fmt: str = "standard", rounding: bool = False) -> Column:
    """The amount a text states, or null where it states none.

    standard: 1,234.5 with (1.5) or -1.5 for negatives. greek: 1.234,5 with a minus before or after. More than six decimals
    are no amount unless rounding is asked for (half away from zero), which also admits scientific notation.
    """
    t = F.trim(c)
    if fmt == "standard":
        paren = t.rlike(r"^\(.*\)$")
        inner = F.trim(F.when(paren, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t))
        minus = inner.startswith("-")
        body = F.trim(F.when(minus, F.substring(inner, 2, 1 << 30)).otherwise(inner))
        ok = body.rlike(r"^[0-9][0-9,]*(\.[0-9]+)?$") & ~(paren & minus)
        plain = F.replace(body, F.lit(","), F.lit(""))
        negative = paren | minus
    elif fmt == "greek":
        before, after = t.startswith("-"), t.endswith("-")
        body = F.trim(F.regexp_replace(t, r"^-|-$", ""))
        ok = body.rlike(r"^[0-9][0-9.]*(,[0-9]+)?$") & ~(before & after)
        plain = F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        negative = before | after
    else:
        raise NumberFormatError(f"unknown number format {fmt!r}")
    if not rounding:
        ok = ok & ~plain.rlike(r"\.[0-9]{7,}$")
    value = F.when(ok, plain.try_cast(TYPE))
    value = F.when(negative, -value).otherwise(value).cast(TYPE)
    if rounding:
        value = F.when(t.rlike(SCIENTIFIC), t.try_cast(TYPE)).otherwise(value)
    return value


def format_decimal(c: Column) -> Column:
    """Plain decimal text without trailing zeros."""
    return F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")  # wide enough for sums


def mul(a: Column, b: Column) -> Column:
    return F.round(a.cast(TYPE) * b.cast(TYPE), 6).cast(TYPE)


def div(a: Column, b: Column) -> Column:
    """Half away from zero at the sixth decimal; division by zero is an error."""
    return F.round(a.cast(TYPE) / b.cast(TYPE), 6).cast(TYPE)


def div_exact(a: Decimal, b: Decimal) -> Decimal:
    """The same on the driver."""
    return (a / b).quantize(Decimal("0.000001"), ROUND_HALF_UP)


def evidence(c: Column) -> tuple[Column, Column, Column]:
    """Aggregates: values that look Greek, standard, and that have any separator."""
    t = F.trim(c)
    return F.count_if(t.rlike(GREEK_EVIDENCE)), F.count_if(t.rlike(STANDARD_EVIDENCE)), F.count_if(t.rlike(r"[.,]"))


def number_format(greek: int, standard: int, separators: int, hint: str | None = None) -> str | None:
    """The format the evidence shows; both at once is an error, none at all is the hint if there are separators."""
    if greek and standard:
        raise NumberFormatError("the values mix number formats")
    return "greek" if greek else "standard" if standard else hint if separators else None
