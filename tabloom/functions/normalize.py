"""The field types: a column builder for each, giving a value and an error (null if there is none).

A raw value is a text. White space around it (in the Unicode sense) doesn't count; a blank value is null, and an error
only if the field is required. Everything is a Catalyst expression but dates in free form and patterns that Java's
regular expressions lack, which go through an Arrow UDF.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.config import Field
from tabloom.errors import ConfigError
from tabloom.functions import codes

#: Unicode white space and the separators that count as such in texts.
_SPACE = r"[\s\x1c-\x1f]"
_DIGITS = r"\d(?:_?\d)*"
_FLOAT = rf"(?i)\A[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)\z"
_DECIMAL = r"(?i)\A[+-]?(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:e[+-]?\d+)?\z"
# What makes a URL and an e-mail address.
_SCHEME = r"\A[a-zA-Z][a-zA-Z\d+\-.]*://"
_URL = _SCHEME + r"[^\s/$.?#][^\s]*\z"
_EMAIL = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"
# Words for true and false.
TRUE = ("true", "yes", "1", "on", "t", "y")
FALSE = ("false", "no", "0", "off", "f", "n")

Pair = tuple[Column, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def no_error() -> Column:
    return F.lit(None).cast("string")


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def _number(text: Column) -> Column:
    """A double, null if the text is no number. Digits may be grouped by underscores."""
    return F.when(text.rlike(_FLOAT), F.regexp_replace(text, "_", "").try_cast("double"))


def _bounds(value: Column, f: Field, what: str) -> Column:
    error = no_error()
    if f.min is not None:
        error = F.when(value < F.lit(f.min), F.concat(F.lit(f"{what} "), value.cast("string"), F.lit(f" is below {f.min}"))).otherwise(error)
    if f.max is not None:
        # Not a number is no larger than anything.
        over = (value > F.lit(f.max)) & ~F.isnan(value.cast("double"))
        error = F.when(over, F.concat(F.lit(f"{what} "), value.cast("string"), F.lit(f" is above {f.max}"))).otherwise(error)
    return error


def _gate(value: Column, error: Column) -> Pair:
    return F.when(error.isNull(), value), error


def string(x: Column, f: Field) -> Pair:
    n, error = F.char_length(x), no_error()
    if f.max_length is not None:
        error = F.when(n > f.max_length, F.concat(F.lit("length "), n.cast("string"), F.lit(f" is above {f.max_length}"))).otherwise(error)
    if f.min_length is not None:
        error = F.when(n < f.min_length, F.concat(F.lit("length "), n.cast("string"), F.lit(f" is below {f.min_length}"))).otherwise(error)
    return _gate(x, error)


def _once(value: Column, body: Callable[[Column], Pair]) -> Pair:
    """A pair made of a value that is computed once for both."""

    def both(c: Column) -> Column:
        shown, error = body(c)
        return F.struct(shown.alias("value"), error.alias("error"))

    found = let(value, both)
    return found["value"], found["error"]


def integer(x: Column, f: Field) -> Pair:
    def made(d: Column) -> Pair:
        whole = F.when((d < F.lit(9.2e18)) & (d > F.lit(-9.2e18)), d.cast("long"))
        error = F.when(whole.isNull(), F.concat(F.lit("no integer: "), quoted(x))).otherwise(_bounds(whole, f, "integer"))
        return _gate(whole, error)

    return _once(_number(x), made)


def number(x: Column, f: Field) -> Pair:
    def made(d: Column) -> Pair:
        fine = F.when(F.isnan(d), no_error()).otherwise(_bounds(d, f, "number"))
        return _gate(d, F.when(d.isNull(), F.concat(F.lit("no number: "), quoted(x))).otherwise(fine))

    return _once(_number(x), made)


def currency(x: Column, f: Field) -> Pair:
    """Two decimals, half to even. A sign may be a minus, parentheses or both; nothing but symbols is null, no error."""
    wrapped = x.startswith("(") & x.endswith(")") & (F.char_length(x) >= 2)
    inner = F.when(wrapped, F.substring(x, F.lit(2), F.char_length(x) - 2)).otherwise(x)
    bare = F.regexp_replace(inner, r"(?U)[$,\s]", "")

    def amount(text: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(text, r"\A-", ""), "_", "")
        value = F.when(plain.rlike(_DECIMAL), F.bround(plain.try_cast(T.DecimalType(38, 12)), 2).try_cast(T.DecimalType(28, 2)))
        signed = F.when(wrapped | text.startswith("-"), -value).otherwise(value).cast(T.DecimalType(28, 2))
        return F.struct(signed.alias("value"), ((plain != "") & value.isNull()).alias("bad"))

    found = let(bare, amount)
    return found["value"], F.when(found["bad"], F.concat(F.lit("no amount: "), quoted(x)))


def phone(x: Column, f: Field) -> Pair:
    d = F.regexp_replace(x, r"(?U)\D", "")
    n = F.char_length(d)
    ten = F.when((n == 11) & d.startswith("1"), F.substring(d, 2, 10)).when(n == 10, d)
    shown = F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
    return _gate(shown, F.when(ten.isNull(), F.concat(F.lit("no phone number of ten digits: "), quoted(x))))


def url(x: Column, f: Field) -> Pair:
    full = F.when(x.rlike(_SCHEME), x).otherwise(F.concat(F.lit("http://"), x))
    return _gate(full, F.when(~full.rlike("(?U)" + _URL), F.concat(F.lit("no URL: "), quoted(x))))


def email(x: Column, f: Field) -> Pair:
    low = F.lower(x)
    return _gate(low, F.when(~low.rlike("(?U)" + _EMAIL), F.concat(F.lit("no e-mail address: "), quoted(x))))


# The directives of strftime that have an equal in Java's patterns.
STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM",
    "a": "EEE", "A": "EEEE", "j": "DDD",
}


def java_pattern(form: str) -> str:
    """A strftime form as a Java date pattern."""
    out, i = "", 0
    while i < len(form):
        if form[i] == "%" and i + 1 < len(form):
            c = form[i + 1]
            if c != "%" and c not in STRFTIME:
                raise ConfigError(f"format: %{c} isn't supported")
            out += "%" if c == "%" else STRFTIME[c]
            i += 2
        else:
            # Letters are taken literally between quotes only.
            out += f"'{form[i]}'" if form[i].isalpha() else "''" if form[i] == "'" else form[i]
            i += 1
    return out


_TIME = r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?: *([AaPp])[Mm])?(?:Z)?)?"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
#: Forms that need no UDF: the pattern, and which of its groups are the year, the month and the day.
_FORMS = [
    (rf"(?i)\A(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}\z", (1, 2, 3), 4),
    (rf"(?i)\A(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}\z", (3, 1, 2), 4),
    (rf"(?i)\A(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}\z", (1, 2, 3), 4),
    (rf"(?i)\A{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_TIME}\z", (3, 1, 2), 4),
    (rf"(?i)\A(\d{{1,2}})(?:st|nd|rd|th)? {_MONTH},? (\d{{4}}){_TIME}\z", (3, 2, 1), 4),
]


def moment(x: Column, today: dt.date) -> Column:
    """The time in a text as a timestamp without zone, null if it's in no form known here.

    With slashes the month comes first, unless it can't be one. Two-digit years are those nearest to today.
    """
    # One text of the parts, whatever the form: year, month, day, hour, minute, second, half of the day, month first?
    parts = F.lit(None).cast("string")
    for pattern, (y, m, d), t in reversed(_FORMS):
        first = "y" if (y, m, d) == (3, 1, 2) and "jan" not in pattern else ""
        line = F.regexp_replace(x, pattern, f"${y}|${m}|${d}|${t}|${t + 1}|${t + 2}|${t + 3}|{first}")
        # What fits is replaced as a whole, and no text is its own parts: each form is tried once.
        parts = F.coalesce(let(line, lambda found: F.when(found != x, found)), parts)

    def build(p: Column) -> Column:
        number = lambda i: p[i].try_cast("int")
        near = F.lit(today.year - today.year % 100) + number(0)
        near = F.when(near > today.year + 49, near - 100).when(near < today.year - 50, near + 100).otherwise(near)
        year = F.when(F.char_length(p[0]) == 2, near).otherwise(number(0))
        named = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(p[1], 1, 3))).cast("int")
        month, day = F.coalesce(number(1), named), number(2)
        swap = (p[7] == "y") & (month > 12) & (day <= 12)
        hour, half = F.coalesce(number(3), F.lit(0)), F.lower(p[6])
        hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), F.lit(0)).otherwise(hour)
        two = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
        date = F.concat_ws("-", two(year, 4), two(F.when(swap, day).otherwise(month)), two(F.when(swap, month).otherwise(day)))
        clock = F.concat_ws(":", two(hour), two(F.coalesce(number(4), F.lit(0))), two(F.coalesce(number(5), F.lit(0))))
        return F.concat(date, F.lit(" "), clock).try_cast("timestamp_ntz")

    return let(F.split(parts, r"\|", -1), build)


def _free(x: Column, today: dt.date) -> Column:
    """Dates in free form, by dateutil where it is installed; what they leave open is today's."""
    default = dt.datetime(today.year, today.month, today.day)

    @F.pandas_udf("timestamp_ntz")
    def guess(texts):
        import pandas as pd

        try:
            from dateutil import parser
        except ImportError:
            return pd.Series([None] * len(texts), dtype="datetime64[ns]")

        def one(s):
            try:
                found = parser.parse(s, default=default).replace(tzinfo=None) if s else None
                return found if found and pd.Timestamp.min < pd.Timestamp(found) < pd.Timestamp.max else None
            except (ValueError, OverflowError):
                return None

        return pd.Series([one(s) for s in texts], dtype="datetime64[ns]")

    return guess(x)


def _dated(x: Column, form: str, what: str, today: dt.date, free: bool) -> Pair:
    at = moment(x, today)
    if free:
        at = F.coalesce(at, _free(F.when(at.isNull(), x), today))
    return _once(F.date_format(at, java_pattern(form)), lambda shown: (shown, F.when(shown.isNull(), F.concat(F.lit(f"no {what}: "), quoted(x)))))


def date(x: Column, f: Field, today: dt.date, free: bool) -> Pair:
    return _dated(x, f.format or "%Y-%m-%d", "date", today, free)


def datetime(x: Column, f: Field, today: dt.date, free: bool) -> Pair:
    return _dated(x, f.format or "%Y-%m-%dT%H:%M:%S", "time", today, free)


def enum(x: Column, f: Field) -> Pair:
    case = f.case or "upper"
    shown = {"upper": F.upper(x), "lower": F.lower(x), "preserve": x}.get(case)
    if shown is None:
        return F.lit(None).cast("string"), F.lit(f"unknown case {case!r}")
    values = codes.resolve_preset(f.preset) if f.preset else f.values
    if values is None:
        return shown, no_error()
    known = F.lower(x).isin([v.lower() for v in values]) if values else F.lit(False)
    return _gate(shown, F.when(~known, F.concat(F.lit("not among the values: "), quoted(x))))


def boolean(x: Column, f: Field) -> Pair:
    low = F.lower(x)
    value = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return _gate(value, F.when(value.isNull(), F.concat(F.lit("no boolean: "), quoted(x))))


def regex(x: Column, f: Field) -> Pair:
    fits = matches(x, f.pattern)
    return _gate(x, F.when(~fits, F.concat(F.lit("doesn't fit the pattern: "), quoted(x))))


def matches(x: Column, pattern: str) -> Column:
    """Whether a whole text fits a Python pattern: in Java's terms if they mean the same, else by an Arrow UDF."""
    re.compile(pattern)
    # Constructs that Java lacks or reads otherwise.
    if re.search(r"\(\?\(|\(\?P[=>]|\\[NZ]|\(\?[a-zA-Z]*[aLux]|\[[^\]]*(?:\[|&&)|\\[Bb]|\$", pattern):

        @F.pandas_udf("boolean")
        def fits(texts):
            import pandas as pd

            compiled = re.compile(pattern)
            return pd.Series([None if s is None else bool(compiled.fullmatch(s)) for s in texts])

        return fits(x)
    return x.rlike(rf"(?U)\A(?:{pattern.replace('(?P<', '(?<')})\z")


def subdivision(x: Column, f: Field) -> Pair:
    up, known = F.upper(x), codes.subdivisions(f.country_code or "")
    if not known:
        return F.lit(None).cast("string"), F.lit(f"no subdivisions are known of country {f.country_code!r}")
    return _gate(up, F.when(~up.isin(known), F.concat(F.lit(f"no subdivision of {f.country_code}: "), quoted(x))))


def country(x: Column, f: Field) -> Pair:
    up = F.upper(x)
    return _gate(up, F.when(~up.isin(codes.countries()), F.concat(F.lit("no country code: "), quoted(x))))


@dataclass(frozen=True)
class FieldType:
    build: Callable[..., Pair]
    value: T.DataType
    stored: T.DataType
    options: tuple[str, ...] = ()


_S = T.StringType()
REGISTRY: dict[str, FieldType] = {
    "string": FieldType(string, _S, T.VarcharType(255), ("min_length", "max_length")),
    "integer": FieldType(integer, T.LongType(), T.LongType(), ("min", "max")),
    "number": FieldType(number, T.DoubleType(), T.DoubleType(), ("min", "max")),
    "currency": FieldType(currency, T.DecimalType(28, 2), T.DecimalType(12, 2)),
    "phone": FieldType(phone, _S, T.VarcharType(20)),
    "url": FieldType(url, _S, T.VarcharType(500)),
    "email": FieldType(email, _S, T.VarcharType(255)),
    "date": FieldType(date, _S, T.DateType(), ("format",)),
    "datetime": FieldType(datetime, _S, T.TimestampNTZType(), ("format",)),
    "enum": FieldType(enum, _S, T.VarcharType(50), ("values", "preset", "case")),
    "boolean": FieldType(boolean, T.BooleanType(), T.BooleanType()),
    "regex": FieldType(regex, _S, T.VarcharType(255), ("pattern",)),
    "subdivision": FieldType(subdivision, _S, T.VarcharType(10), ("country_code",)),
    "country": FieldType(country, _S, T.VarcharType(2)),
}


def field_type(name: str) -> FieldType:
    if name not in REGISTRY:
        raise ConfigError(f"unknown field type {name!r}")
    return REGISTRY[name]


def normalize(raw: Column, f: Field, *, today: dt.date | None = None, free_dates: bool = True, stripped: bool = False) -> Pair:
    """(value, error) of a raw text column for a field. ``stripped``: white space at its ends is gone already."""
    kind = field_type(f.type)
    x = raw if stripped else strip(raw.cast("string"))
    more = {"today": today or dt.date.today(), "free": free_dates} if f.type in ("date", "datetime") else {}
    value, error = kind.build(x, f, **more)
    blank = F.coalesce(x, F.lit("")) == ""
    missing = F.lit(f"{f.name} is required") if f.required else no_error()
    return F.when(~blank, value), F.when(blank, missing).otherwise(error)
