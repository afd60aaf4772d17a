"""Exact deduplication by key: the first row of each key stays, unless the key is stored already.

First rows are found by a partial minimum of the ordinal and brought back by a join on the ordinal, which is unique: a
key with very many rows (blank ones, say) is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDINAL = ("_file_idx", "_row_idx")


def key_columns(df: DataFrame, keys: list[str], match: str) -> list[Column]:
    """Keys as they are compared: null texts are empty; letter case is dropped for texts only, if it doesn't count."""
    out = []
    for k in keys:
        c = F.col(f"`{k}`")
        if isinstance(df.schema[k].dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
            c = F.lower(c) if match == "case_insensitive" else c
        out.append(c)
    return out


def existing_keys(stored: DataFrame, keys: list[str], match: str = "exact") -> DataFrame:
    """The distinct keys of stored rows, as k0, k1 ..."""
    return stored.select(*[c.alias(f"k{i}") for i, c in enumerate(key_columns(stored, keys, match))]).distinct()


def mark_duplicates(rows: DataFrame, keys: list[str], *, match: str = "exact", ordinal: tuple[str, ...] = ORDINAL, existing: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_duplicate``: whether an earlier row or (``existing``, see ``existing_keys``) a stored one has the key."""
    keyed = rows.select(*ordinal, *[c.alias(f"k{i}") for i, c in enumerate(key_columns(rows, keys, match))])
    names = [f"k{i}" for i in range(len(keys))]
    first = keyed.groupBy(*names).agg(F.min(F.struct(*ordinal)).alias("first"))
    if existing is not None:
        e = existing.select(*[F.col(n).cast(first.schema[n].dataType).alias(f"e_{n}") for n in names])
        same = None
        for n in names:
            one = first[n].eqNullSafe(e[f"e_{n}"])
            same = one if same is None else same & one
        first = first.join(e, same, "left_anti")
    kept = first.select(*[F.col(f"first.{o}").alias(f"_kept_{o}") for o in ordinal])
    same = None
    for o in ordinal:
        one = F.col(f"`{o}`") == F.col(f"_kept_{o}")
        same = one if same is None else same & one
    joined = rows.join(kept, same, "left")
    return joined.withColumn("_duplicate", F.col(f"_kept_{ordinal[0]}").isNull()).drop(*[f"_kept_{o}" for o in ordinal])


def unique(marked: DataFrame) -> DataFrame:
    return marked.where(~F.col("_duplicate")).drop("_duplicate")


def duplicates(marked: DataFrame) -> DataFrame:
    return marked.where("_duplicate").drop("_duplicate")
