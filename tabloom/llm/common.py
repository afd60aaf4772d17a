"""What the operators of this subpackage share: where large intermediate tables and files go, and small helpers.

Intermediate tables are written to the folder that the cluster shares (``spark.checkpoint.dir``), so that a lost
executor costs the recomputation of its own tasks only. Nothing is written to a machine-local folder.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set and all runs on this machine (tests) one is made and set here."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: So many bytes at most go to a Python worker at once.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds Arrow batches by bytes while a table is written: texts may be long, and a batch is held several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once and read back: lineage ends here and no consumer computes it again."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: So many bytes at most are broadcast, wherever a side's size is checked first.
BROADCAST_BYTES = 32 << 20


def give_back() -> None:
    """Hands memory that this process has freed back to the system, from the middle of the heap too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``. Workers are kept for later tasks, and without this each keeps what its largest task took."""

    def freed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return freed


def clear_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts that only tables written since had use for: it does once their plans are garbage."""
    gc.collect()
    spark._jvm.System.gc()


def join_on(left: DataFrame, right: DataFrame, key: str, row_bytes: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and is a table that was written.

    The right side is broadcast if its rows, of ``row_bytes`` each, are within bounds. Else keys with more than a ten
    thousandth of the left side's rows (at most ten thousand keys) are broadcast and the others joined by a shuffle, so that no key is hot.
    """
    if right.count() * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, how)
    if not hasattr(left, "scratch_path"):  # it is read several times
        left = written(left, "left")
    counts = written(left.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1000"), "hot-keys")
    most = (left.count() if counts.limit(1).count() else 0) // 10_000
    hot = counts.where(F.col("c") > most).select(F.col(key).alias("hot_key"))
    is_hot, same = F.col("hot_key").isNotNull(), F.col(key) == F.col("hot_key")
    marked = left.join(F.broadcast(hot), same, "left")
    few = right.join(F.broadcast(hot), same, "left_semi")
    most_of = marked.where(~is_hot).drop("hot_key").join(right, key, how)
    return most_of.unionByName(marked.where(is_hot).drop("hot_key").join(F.broadcast(few), key, how))


def private(names: list[str], base: str) -> str:
    """A column name that isn't among ``names``."""
    low, name = {n.lower() for n in names}, base
    while name in low:
        name += "_"
    return name


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(filesystem, path) of a place in the shared folder, for use in executors."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def range_edges(df: DataFrame, col: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 increasing values that cut an integer column into ranges of about as many rows.

    They only decide which task handles a row, so that they are approximate doesn't matter for any result.
    """
    if parts < 2:
        return []
    row = df.select(F.percentile_approx(F.col(col), [i / parts for i in range(1, parts)], 10_000).alias("q")).first()
    return sorted(set(row.q or []))


def range_of(col: str, edges: list[int]):
    """The index (int) of the range of ``range_edges`` that holds the value; nulls are in range 0."""
    if not edges:
        return F.lit(0)
    cuts = F.array(*[F.lit(e).cast("long") for e in edges])
    return F.coalesce(F.size(F.filter(cuts, lambda e: e <= F.col(col))), F.lit(0))
