"""Validation: every field normalised, all failing fields reported, rows split into valid and invalid."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.config import Field
from tabloom.functions.normalize import normalize, strip

ERRORS, RECORD = "_errors", "_record"


def validate(rows: DataFrame, fields: list[Field], *, keep: tuple[str, ...] = (), today: dt.date | None = None, free_dates: bool = True) -> DataFrame:
    """The ``keep`` columns, each field's value (typed), ``_record`` (the raw values) and ``_errors`` (field, message, input).

    A field that ``rows`` has no column for is blank. One projection: whatever is asked of the result, the rows are read once.
    """
    names = set(rows.columns)
    raw = {f.name: F.col(f"`{f.name}`").cast("string") if f.name in names else F.lit(None).cast("string") for f in fields}
    # Stripped in a projection of its own: the values are used many times below.
    rows = rows.select(*[F.col(f"`{k}`") for k in keep], *[raw[f.name].alias(f"_r{i}") for i, f in enumerate(fields)], *[strip(raw[f.name]).alias(f"_x{i}") for i, f in enumerate(fields)])
    raw = {f.name: F.col(f"_r{i}") for i, f in enumerate(fields)}
    pairs = {f.name: normalize(F.col(f"_x{i}"), f, today=today, free_dates=free_dates, stripped=True) for i, f in enumerate(fields)}
    errors = [F.when(e.isNotNull(), F.struct(F.lit(n).alias("field"), e.alias("message"), raw[n].alias("input"))) for n, (_, e) in pairs.items()]
    return rows.select(
        *[F.col(f"`{k}`") for k in keep], *[v.alias(n) for n, (v, _) in pairs.items()],
        F.create_map(*[x for n, c in raw.items() for x in (F.lit(n), c)]).alias(RECORD), F.array_compact(F.array(*errors)).alias(ERRORS),
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size(ERRORS) == 0).drop(ERRORS, RECORD)


def invalid(checked: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The raw records with their errors."""
    return checked.where(F.size(ERRORS) > 0).select(*keep, RECORD, ERRORS)


def errors_by_field(checked: DataFrame) -> DataFrame:
    """How many rows fail each field."""
    return checked.select(F.explode(F.col(f"{ERRORS}.field")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n_errors"))
