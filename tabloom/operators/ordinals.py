"""Order made explicit: dense row numbers and surrogate keys without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows to a block, the unit that one task numbers.
BLOCK = 1_000_000


def in_order_of_scan(df: DataFrame, name: str = "_row_idx") -> DataFrame:
    """``df`` (a scan of one file) with 0, 1 ... in the order of the file: the row's number in its partition plus the
    rows of all partitions before. The table of partition sizes has a row for each partition."""
    tagged = df.withColumn("_mono", F.monotonically_increasing_id())
    part = F.shiftright("_mono", 33).alias("_part")
    sizes = tagged.select(part).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    both = tagged.withColumn("_part", F.shiftright("_mono", 33)).join(F.broadcast(before), "_part")
    return both.withColumn(name, F.col("_before") + F.col("_mono").bitwiseAND((1 << 33) - 1)).drop("_mono", "_part", "_before")


def numbered(df: DataFrame, order: list[str], name: str, *, start: Column | int = 1, block: int = BLOCK) -> DataFrame:
    """``df`` with ``start``, ``start`` + 1 ... by increasing ``order`` (integers, the last one the finest).

    Rows are numbered within blocks of the last order column; a block's offset is the number of rows in blocks before.
    """
    groups = [*order[:-1], "_block"]
    blocked = df.withColumn("_block", F.floor(F.col(order[-1]) / block))
    sizes = blocked.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*groups, (F.sum("_n").over(Window.orderBy(*groups)) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(order[-1]))
    out = blocked.join(offsets, groups).withColumn(name, (F.col("_before") + rank - 1 + start).cast("long"))
    return out.select(*df.columns, name)


def chunks(df: DataFrame, size: int, *, row: str = "_row_idx") -> DataFrame:
    """``df`` with ``_chunk_id``: runs of ``size`` rows of a file."""
    return df.withColumn("_chunk_id", F.floor(F.col(row) / size).cast("long"))


def chunk_ranges(chunked: DataFrame, size: int, *, file: str = "_file_idx") -> DataFrame:
    """file, chunk, row_range (counted from 1) and rows of each chunk."""
    n = F.count(F.lit(1))
    first = F.col("_chunk_id") * size + 1
    grouped = chunked.groupBy(file, "_chunk_id").agg(n.alias("rows"))
    label = F.concat(F.lit("rows "), first.cast("string"), F.lit("-"), (first + F.col("rows") - 1).cast("string"))
    return grouped.select(file, F.col("_chunk_id").alias("chunk"), label.alias("row_range"), "rows")
