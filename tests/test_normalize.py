import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabloom.config import Field, Target
from tabloom.errors import ConfigError
from tabloom.functions import codes
from tabloom.functions.normalize import field_type, java_pattern, matches, normalize

BAD = object()
TODAY = dt.date(2026, 3, 15)


def field(kind, **options):
    return Field("x", kind, Target("t", "x"), **options)


CASES = [
    (field("string"), [("  a b \n", "a b"), (" x ", "x"), ("", None), (" \t", None), (None, None)]),
    (field("string", min_length=2, max_length=3), [("a", BAD), ("ab", "ab"), ("abc", "abc"), ("abcd", BAD), ("🎉🎉", "🎉🎉")]),
    (field("string", required=True), [("", BAD), (None, BAD), ("x", "x")]),
    (field("integer"), [("42.9", 42), ("-5", -5), ("-0.9", 0), ("1e3", 1000), ("1_000", 1000), ("1.5d", BAD), ("inf", BAD), ("nan", BAD), ("abc", BAD), ("1e30", BAD), ("12abc", BAD)]),
    (field("integer", min=0, max=10), [("-0.5", 0), ("10.9", 10), ("11", BAD), ("-1", BAD)]),
    (field("number", max=10.0), [("1e3", BAD), ("9.5", 9.5), (".5", 0.5), ("5.", 5.0), ("nope", BAD), ("-inf", float("-inf")), ("inf", BAD)]),
    (field("currency"), [("$1,234.56", "1234.56"), ("(5)", "-5.00"), ("(-5)", "-5.00"), ("--5", "5.00"), ("-$3", "-3.00"), ("1.005", "1.00"), ("1.015", "1.02"), ("$", None), ("()", None), ("1.", "1.00"), (".5", "0.50"), ("1e3", "1000.00"), ("x", BAD), ("1.2.3", BAD), ("inf", BAD)]),
    (field("phone"), [("(555) 123-4567", "(555) 123-4567"), ("1-555-123-4567", "(555) 123-4567"), ("5551234", BAD), ("25551234567", BAD), ("555.123.4567 x", "(555) 123-4567")]),
    (field("url"), [("acme.com", "http://acme.com"), ("https://a.b/c?d", "https://a.b/c?d"), ("ftp://x", "ftp://x"), ("a b.com", BAD), ("http://", BAD), ("http:///x", BAD)]),
    (field("email"), [(" A.B@C.Org ", "a.b@c.org"), ("a@b", BAD), ("a b@c.d", BAD), ("@c.d", BAD)]),
    (field("date"), [("3/4/2026", "2026-03-04"), ("13/4/2026", "2026-04-13"), ("2026-1-5", "2026-01-05"), ("20260105", "2026-01-05"), ("March 5, 2026", "2026-03-05"), ("5 Mar 2026", "2026-03-05"), ("01/01/99", "1999-01-01"), ("1/2/30", "2030-01-02"), ("2026-02-30", BAD), ("soon", BAD)]),
    (field("date", format="%d.%m.%y"), [("2026-01-05", "05.01.26")]),
    (field("datetime"), [("2026-01-05 2:30 PM", "2026-01-05T14:30:00"), ("1/5/2026 12:05:07 am", "2026-01-05T00:05:07"), ("2026-01-05T07:08:09Z", "2026-01-05T07:08:09"), ("2026-01-05", "2026-01-05T00:00:00")]),
    (field("enum", values=["Active", "closed"]), [("active", "ACTIVE"), (" CLOSED", "CLOSED"), ("open", BAD)]),
    (field("enum", values=["Active"], case="preserve"), [("aCtive", "aCtive")]),
    (field("enum", values=[]), [("x", BAD)]),
    (field("enum", values=["x"], case="title"), [("x", BAD)]),
    (field("enum", preset="us_states"), [("ca", "CA"), ("ON", BAD)]),
    (field("boolean"), [("Yes", True), ("t", True), ("1", True), ("OFF", False), ("n", False), ("2", BAD), ("1.0", BAD)]),
    (field("regex", pattern=r"\d+"), [("123", "123"), ("12a", BAD), ("a12", BAD)]),
    (field("subdivision", country_code="ca"), [("on", "ON"), ("NY", BAD)]),
    (field("subdivision", country_code="ZZ"), [("on", BAD)]),
    (field("country"), [("us", "US"), ("De", "DE"), ("XX", BAD), ("USA", BAD)]),
]


@pytest.mark.parametrize("f,cases", CASES, ids=lambda x: x.type if isinstance(x, Field) else "")
def test_values(spark, f, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    value, error = normalize(F.col("x"), f, today=TODAY)
    got = {r["i"]: (r["v"], r["e"]) for r in rows.select("i", value.alias("v"), error.alias("e")).collect()}
    for i, (raw, wanted) in enumerate(cases):
        v, e = got[i]
        if wanted is BAD:
            assert e is not None and v is None, (raw, v, e)
        else:
            wanted = Decimal(wanted) if f.type == "currency" and wanted is not None else wanted
            assert e is None and v == wanted, (raw, v, e)


def test_not_a_number_passes_bounds(spark):
    value, error = normalize(F.col("x"), field("number", min=0.0, max=1.0))
    r = spark.createDataFrame([("nan",)], "x string").select(value.alias("v"), error.alias("e")).first()
    assert r["v"] != r["v"] and r["e"] is None


def test_free_dates(spark):
    value, error = normalize(F.col("x"), field("date"), today=TODAY)
    r = spark.createDataFrame([("March 2026",), ("Thursday 5th of March 2026",)], "x string").select(value.alias("v")).collect()
    assert [x["v"] for x in r] == ["2026-03-15", "2026-03-05"]


def test_python_patterns(spark):
    rows = spark.createDataFrame([("ab\n",), ("ab",), (None,)], "x string")
    assert [r[0] for r in rows.select(matches(F.col("x"), r"(?P<one>a)b")).collect()] == [False, True, None]
    assert [r[0] for r in rows.select(matches(F.col("x"), r"^ab$")).collect()] == [False, True, None]


def test_registry():
    assert field_type("currency").stored.simpleString() == "decimal(12,2)"
    assert field_type("country").stored.length == 2
    with pytest.raises(ConfigError):
        field_type("nope")
    with pytest.raises(ConfigError):
        java_pattern("%Q")
    assert java_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"


def test_codes(spark):
    assert len(codes.countries()) == 249
    assert len(codes.subdivisions("us")) == 57 and len(codes.resolve_preset("ca_provinces")) == 13
    with pytest.raises(ConfigError):
        codes.resolve_preset("mars")
