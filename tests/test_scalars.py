from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyfold.errors import DelimitedParseError, DelimiterDetectionError, EncodingDetectionError, HeaderDetectionError, NumberFormatError, ParseSpecError
from tallyfold.functions import decimals
from tallyfold.functions.dates import parse_date
from tallyfold.functions.text import hmac16, jaro_winkler, norm_column_name, norm_key, sql_name
from tallyfold.sources import delimited, encoding
from tallyfold.sources import spec as specs


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "fmt", "want"),
    [("1,234,567.89", "standard", "1234567.89"), ("(2.25)", "standard", "-2.25"), ("1,50-", "greek", "-1.5"), ("2.718.281.828,45", "greek", "2718281828.45"), ("1.1234567", "standard", None), ("(-1)", "standard", None), ("-1-", "greek", None), ("", "standard", None), ("abc", "greek", None)],
)
def test_decimal_parse(spark, text, fmt, want):
    v = one(spark, text, lambda c: decimals.parse_decimal(c, fmt))
    assert v == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("text", "want"), [("5120.2500000000004", "5120.25"), ("3.0000000000000001E-1", "0.3"), ("-4.1E+2", "-410"), ("-0.0000005", "-0.000001")])
def test_decimal_rounding(spark, text, want):
    assert one(spark, text, lambda c: decimals.format_decimal(decimals.parse_decimal(c, "standard", True))) == want


def test_decimal_division():
    assert decimals.div_exact(Decimal("0.000001"), Decimal(2)) == Decimal("0.000001")
    assert decimals.div_exact(Decimal("-0.000001"), Decimal(2)) == Decimal("-0.000001")
    with pytest.raises(NumberFormatError):
        decimals.number_format(1, 1, 1)


@pytest.mark.parametrize(("text", "want"), [("2025-04-30", "2025-04-30"), ("3.4.2025", "2025-04-03"), ("31/2/2025", None), ("1/1/0999", None), ("x", None)])
def test_dates(spark, text, want):
    v = one(spark, text, parse_date)
    assert (v and str(v)) == want


@pytest.mark.parametrize(("text", "want"), [("31-07550000", "3107550000"), ("031", "31"), ("  Mixed Case ", "mixed case"), ("000", "0"), ("ＡＢ", "ab"), (None, None)])
def test_norm_key(spark, text, want):
    assert one(spark, text, norm_key) == want


def test_names(spark):
    assert norm_column_name("  GL  Account ") == "gl account"
    taken = {"src_row"}
    assert [sql_name(x, taken) for x in ("GL Account", "gl account", "2nd", "%")] == ["gl_account", "gl_account_2", "c_2nd", "col"]
    for a, b, want in (("amount eur", "sum amount", 0.7208), ("account", "gl account", 0.9), ("amount", "sum amount", 0.7833), ("product", "product code", 0.9167)):
        assert abs(jaro_winkler(a, b) - want) < 1e-4


def test_hmac(spark):
    import hashlib
    import hmac

    assert one(spark, "αβγ", lambda c: hmac16(c, "ab" * 32)) == hmac.new(bytes.fromhex("ab" * 32), "αβγ".encode(), hashlib.sha256).hexdigest()[:16]


def test_delimited():
    assert delimited.parse("f", 'a,b\r\n"x, ""y""\nz",1\r\rc\n', ",") == [["a", "b"], ['x, "y"\nz', "1"], ["c", ""]]
    for bad in ("a,b\n1,2,3", 'a,b\n"x'):
        with pytest.raises(DelimitedParseError):
            delimited.parse("f", bad, ",")
    assert delimited.sniff("f", 'a;b\n"x;y";2\n') == ";"
    with pytest.raises(DelimiterDetectionError):
        delimited.sniff("f", "abc\ndef")
    for bad in (["a"], ["a", ""], ["a", "1.5"], ["a", "A"]):
        with pytest.raises(HeaderDetectionError):
            delimited.assert_header("f", bad)
    assert delimited.dedupe_headers(["a", "b", "a"]) == ["a", "b", "a (2)"]


def test_encoding():
    assert encoding.detect("f", "é".encode()) == ("utf-8", "é")
    assert encoding.detect("f", b"\xef\xbb\xbfa") == ("utf-8-bom", "a")
    assert encoding.detect("f", encoding.encode_cp1253("Λογαριασμός"))[0] == "cp1253"
    for bad in (encoding.encode_cp1253("Λογ"), b"\xef\xbb\xbf\xff", b"\xaa\xd2\xff"):
        with pytest.raises(EncodingDetectionError):
            encoding.detect("f", bad)


@pytest.mark.parametrize("bad", ["{", {"kind": "x"}, {"kind": "fixed", "columns": []}, {"kind": "delimited", "delimiter": "ab"}, {"kind": "delimited", "has_header": False}, {"kind": "xlsx", "skip_patterns": ["("]}, {"type": "delimited", "delimiter": ";", "hasHeader": False, "columns": ["a"]}, {"type": "xlsx", "columns": ["a", " "]}, {"type": "fixed", "kind": "fixed"}, {"kind": "xlsx", "more": 1}])
def test_specs(bad):
    with pytest.raises(ParseSpecError):
        specs.validate(bad)


def test_spec_shapes():
    """Fields of specs that other tools wrote mean the same."""
    ours = specs.validate({"kind": "xlsx", "columns": [{"name": "a"}, {"name": "b"}], "skip_lines": 2, "has_header": False})
    assert specs.validate({"type": "xlsx", "columns": ["a", "b"], "skipLeadingRows": 2, "hasHeader": False}) == ours
    fixed = specs.validate({"type": "fixed", "columns": [{"name": "a", "start": 0, "end": 2, "type": "decimal", "numberFormat": "greek"}, {"name": "b", "start": 2, "end": 4}], "minLineLength": 3})
    assert fixed.min_length == 3 and specs.forced(fixed) == {"a": ("decimal", "greek")}
    assert specs.validate(fixed.to_json()) == fixed
