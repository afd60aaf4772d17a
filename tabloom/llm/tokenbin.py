"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart.

``write`` encodes every row's whole text by the numbered distinct words of ``bpe``, appends an end id to each row, ranks
the vocabulary's ids by how often they occur in all rows (so that frequent ids take one byte) and writes shards in
ascending order of the row's id. ``read`` decodes them by table lookup.

A shard file: ``MAGIC``; then blocks, each of a header (number of rows, of ids, of control and of data bytes, four
unsigned 64-bit numbers), the rows' ids (signed 64-bit), flags (one byte: 1 if the row's id is null), numbers of ids
(unsigned 64-bit), control bytes (each row's begin at a byte) and data bytes. The id of each rank is in the table that
``write`` returns beside the shards, a row for each id that occurs: at most as many as the vocabulary has.

Row ids may be null (they come first) or repeated (then ordered by their ids' bytes, so that reruns agree). Null texts
are empty and have the end id alone. An empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm import bytecode
from tabloom.llm.bpe import NumberedWords
from tabloom.llm.common import filesystem, range_edges, range_of, scratch, width, written

MAGIC = b"tokrank1"
_HEAD = struct.Struct("<QQQQ")
#: About so many ids to a block of a file.
BLOCK_IDS = 1_000_000


def write_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One file for each shard of the task, named by the attempt too: a second attempt writes files of its own."""
    from pyspark import TaskContext

    attempt = TaskContext.get().taskAttemptId()
    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)
    rows, ids, held, size, made = 0, 0, [], 0, []
    out = shard = None

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        control, data = b"".join(r[2] for r in held), b"".join(r[3] for r in held)
        out.write(_HEAD.pack(len(held), size, len(control), len(data)))
        out.write(np.array([r[0] or 0 for r in held], "<i8").tobytes() + bytes([r[0] is None for r in held]))
        out.write(np.array([r[1] for r in held], "<u8").tobytes() + control)
        out.write(data)
        held, size = [], 0

    def close() -> None:
        nonlocal rows, ids
        if out is not None:
            flush()
            out.close()
            made.append((shard, f"{folder}/shard-{shard:06d}-{attempt}.ids", rows, ids))
        rows = ids = 0

    for batch in batches:
        for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                close()
                shard = s
                out = fs.open_output_stream(f"{top}/shard-{s:06d}-{attempt}.ids")
                out.write(MAGIC)
            held.append(row)
            size, rows, ids = size + row[1], rows + 1, ids + row[1]
            if size >= BLOCK_IDS:
                flush()
    close()
    yield pa.RecordBatch.from_pydict({k: [m[i] for m in made] for i, k in enumerate(("shard", "path", "n_rows", "n_ids"))}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_ids", pa.int64())]))


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_rows: int = 100_000, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(shards, ranks): shard, path, n_rows, n_ids, start (ids in all shards before); rank, id, n."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    table = NumberedWords(docs, path, id_col, text_col=text_col)
    counts = table.totals()
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("k"))
    total = slim.count()
    counts = counts.unionByName(spark.range(1).select(F.lit(end_id).cast("long").alias("id"), F.lit(total).cast("long").alias("n")))
    # As many rows as the vocabulary has ids at most.
    ranked = [(r["id"], r["n"]) for r in counts.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), "id").collect()]
    rank = np.zeros(max([end_id, *(i for i, _ in ranked)]) + 1, np.uint32)
    rank[[i for i, _ in ranked]] = np.arange(len(ranked))
    end = rank[end_id]

    def coded_rows(keys: pa.Array, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        # Each row's end id goes behind its own.
        ranks = np.insert(rank[ids], np.cumsum(n), end)
        control, data = bytecode.pack_rows(ranks, n + 1)
        return pa.RecordBatch.from_arrays([keys, pa.array(n + 1), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["k", "n", "control", "data"])

    coded = table.map(coded_rows, "k long, n long, control binary, data binary")
    edges = range_edges(slim, "k", max(width(spark), -(-total // shard_rows)))
    ordered = coded.select(range_of("k", edges).alias("shard"), "k", "n", "control", "data").repartition(max(width(spark), len(edges) + 1), "shard")
    ordered = ordered.sortWithinPartitions("shard", F.col("k").asc_nulls_first(), "n", "data", "control")
    shards = written(ordered.mapInArrow(lambda b: write_shards(b, folder), "shard int, path string, n_rows long, n_ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    ranks = spark.createDataFrame([(r, i, n) for r, (i, n) in enumerate(ranked)], "rank int, id int, n long")
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), ranks


def blocks_of(path: str) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """(row ids, null flags, numbers of ids, ranks of all rows) of each block of a shard file."""
    fs, p = filesystem(path)
    with fs.open_input_stream(p) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no shard")
        while head := f.read(_HEAD.size):
            rows, ids, n_control, n_data = _HEAD.unpack(head)
            keys = np.frombuffer(f.read(8 * rows), "<i8")
            nulls, n = f.read(rows), np.frombuffer(f.read(8 * rows), "<u8").astype(np.int64)
            codes = bytecode.TABLE[np.frombuffer(f.read(n_control), np.uint8)].reshape(-1)
            room = -(-n // 4) * 4  # each row's control bytes begin at a byte
            skip = np.repeat(np.cumsum(room - n) - (room - n), n)
            yield keys, nulls, n, bytecode.unpack_codes(codes[np.arange(ids) + skip], np.frombuffer(f.read(n_data), np.uint8))


def read(spark: SparkSession, shards: DataFrame, ranks: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(key or None, start, ids)`` for each row of the shards, as rows of ``schema``; ids: numpy, unsigned 32-bit."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    table = np.array([r["id"] for r in ranks.orderBy("rank").collect()], "<u4")  # the vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for keys, nulls, n, ranked in blocks_of(path):
                    ids, out, e = table[ranked], [], 0
                    for i in range(len(n)):
                        s, e = e, e + int(n[i])
                        out.append(fn(None if nulls[i] else int(keys[i]), at + s, ids[s:e]))
                    at += e
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)

    return shards.select("path", "start").repartition(width(spark), "path").mapInArrow(run, schema)


def digest(key: int | None, start: int, ids: np.ndarray) -> tuple:
    return key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
