"""Exact top-k search by inner product with vector-approximation cells.

Candidates are held in runs of vectors, each with an approximation file: every component's cell among 2**bits equal
cells of its dimension's range. For a block of queries, a scan of the cells gives each candidate's lowest and highest
possible score; the kth highest of the lowest is a threshold that rules most candidates out. Exact vectors of
the others are read in the order of their highest possible scores until the kth best exact score exceeds (ties are
read on) what any further candidate could reach. Each task sends at most k rows a query and run; the best of them are the result.

Queries are written to the shared folder once and streamed to each task in blocks: no query set has to fit a task or the driver, and no
pair of rows is made. Components must be integers. Scores are exact: in floating point where no sum can reach 2**53, else by
whole numbers of any size; one beyond 64 bits is an error.

Vectors that are null or hold a null, NaN or infinite component take no part, nor do rows without an id or without components. Vectors of
another length than a query's are no candidates for it. Rows with the query's id are its own and no candidates.
Ties go to the smaller id. A query with fewer candidates than k gets all. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import filesystem, width, written

RUN, QUERIES = 32_768, 512


def whole_numbers(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as doubles; null if any component is null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double")))


class Cells:
    """The approximation of a run of vectors (rows of ``exact``)."""

    def __init__(self, exact: np.ndarray, bits: int) -> None:
        self.low = exact.min(axis=0)
        self.step = np.maximum((exact.max(axis=0) - self.low) / (1 << bits), 1e-9)
        self.codes = np.minimum((exact - self.low) / self.step, (1 << bits) - 1).astype(np.uint8 if bits <= 8 else np.uint16)
        self.most = np.abs(exact).max(axis=0)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the cells' middles, how far off they may be): queries by vectors, and a number for each query."""
        middle = (queries * self.step) @ (self.codes.T + 0.5) + (queries @ self.low)[:, None]
        # What the sums may lose to rounding is in proportion to the terms.
        return middle, np.abs(queries) @ self.step * 0.5 * (1 + 1e-9) + np.abs(queries) @ self.most * 1e-12 + 1e-3


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of vectors of integers (as doubles) with another, as 64-bit integers."""
    if np.abs(vectors).max(axis=0, initial=0) @ np.abs(query) < 2**53:
        return (vectors @ query).astype(np.int64)
    own = [int(x) for x in query]
    scores = [sum(int(x) * y for x, y in zip(v, own, strict=True)) for v in vectors.tolist()]
    if any(not -(2**63) <= s < 2**63 for s in scores):
        raise OverflowError("a score has more than 64 bits")
    return np.array(scores, np.int64)


def best(ids: np.ndarray, exact: np.ndarray, cells: Cells, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, id, score) of the k best of one run for each query."""
    middle, off = cells.bounds(queries)
    for q in range(len(queries)):
        high = middle[q]
        own = ids == query_ids[q]
        if own.any():
            high = np.where(own, -np.inf, high)
        n = len(ids) - int(own.sum())
        if not n:
            continue
        kth = np.partition(high, len(high) - min(k, n))[len(high) - min(k, n)]
        open_ = np.flatnonzero(high >= kth - 2 * off[q])
        open_ = open_[np.argsort(-high[open_], kind="stable")]
        read, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while at < len(open_):
            if len(scores) >= k and np.partition(scores, len(scores) - k)[len(scores) - k] > high[open_[at]] + off[q]:
                break
            some = open_[at : at + 64]
            at += len(some)
            read, scores = np.concatenate([read, some]), np.concatenate([scores, exact_scores(exact[some], queries[q])])
        for i in np.lexsort((ids[read], -scores))[:k]:
            yield int(query_ids[q]), int(ids[read[i]]), int(scores[i])


def search(vectors: DataFrame, queries: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector", bits: int = 6) -> DataFrame:
    """query_id, rank, ``id_col``, score of the k best for each row of ``vectors`` where ``queries`` holds."""
    fine = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), queries.alias("asks"))
    fine = written(fine.where("id is not null and v is not null and size(v) > 0"), "vectors")
    asked = written(fine.where("asks").select("id", "v"), "queries")
    files = asked.inputFiles()
    n = width(vectors.sparkSession)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for name in files:
            fs, path = filesystem(name)
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(QUERIES, columns=["id", "v"]):
                    ids, column = batch.column(0).to_numpy(), batch.column(1)
                    size = column.value_lengths().to_numpy()
                    for d in np.unique(size):
                        rows = np.flatnonzero(size == d)
                        yield ids[rows], column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def done(d: int) -> Iterator[pa.RecordBatch]:
            ids, exact = (np.concatenate([x[i] for x in held[d]]) for i in (0, 1))
            held[d] = []
            cells = Cells(exact, bits)
            for query_ids, own in blocks():
                if own.shape[1] == d:
                    found = list(best(ids, exact, cells, query_ids, own, k))
                    yield pa.RecordBatch.from_pydict({n: [x[i] for x in found] for i, n in enumerate(("query_id", "id", "score"))}, schema=pa.schema([(n, pa.int64()) for n in ("query_id", "id", "score")]))

        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            size = column.value_lengths().to_numpy()
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                held.setdefault(d, []).append((ids[rows], column.take(pa.array(rows)).flatten().to_numpy().reshape(-1, d)))
                if sum(len(x[0]) for x in held[d]) >= RUN:
                    yield from done(d)
        for d in [d for d, x in held.items() if x]:
            yield from done(d)

    # Runs should be long, for a query costs each run something; but every core gets some.
    found = fine.select("id", "v").repartition(n, "id").mapInArrow(run, "query_id long, id long, score long")
    # A query's rows from all runs: k from each. The fold keeps the k best, on both sides of the shuffle.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
