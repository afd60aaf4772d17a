"""Review of a batch before it is loaded: approve it, reject it, or have a backend change it."""

from __future__ import annotations

import enum
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.config import Config
from tabloom.errors import EngineError, ReviewError
from tabloom.operators.extract import Backend, as_text, parse_records, revision_prompt
from tabloom.operators.relate import insert_preview
from tabloom.operators.validate import valid, validate


class ReviewStatus(enum.Enum):
    PENDING = "pending"
    APPROVED = "approved"
    REJECTED = "rejected"


class ReviewBatch:
    """Records (a DataFrame with _file_idx and _row_idx) that wait for a decision."""

    def __init__(self, spark: SparkSession, records: DataFrame, config: Config, backend: Backend, revisions: int = 0) -> None:
        self.spark, self.records, self.config, self.backend = spark, records, config, backend
        self.status, self.revisions, self.dropped = ReviewStatus.PENDING, revisions, 0

    def approve(self) -> None:
        self.status = ReviewStatus.APPROVED

    def reject(self) -> None:
        self.status = ReviewStatus.REJECTED

    def revise(self, command: str) -> ReviewBatch:
        """A new batch, changed as ``command`` says. Records that no longer validate are left out (``dropped`` counts
        them). The batch goes to the backend as a whole, so it must be of a size that a person reviews."""
        names = [f.name for f in self.config.fields]
        rows = self.records.orderBy("_file_idx", "_row_idx").select(*[F.col(f"`{n}`") for n in names]).collect()
        try:
            text = self.backend(revision_prompt(json.dumps([r.asDict() for r in rows], default=str), command))
            found = [x if isinstance(x, dict) else {} for x in parse_records(text)]
            raw = [(0, i, *[as_text(x.get(n)) for n in names]) for i, x in enumerate(found)]
            schema = T.StructType([*T.StructType.fromDDL("_file_idx int, _row_idx long").fields, *[T.StructField(n, T.StringType()) for n in names]])
            checked = validate(self.spark.createDataFrame(raw, schema), self.config.fields, keep=("_file_idx", "_row_idx"))
            fine = valid(checked)
            out = ReviewBatch(self.spark, fine, self.config, self.backend, self.revisions + 1)
            out.dropped = len(raw) - fine.count()
            return out
        except EngineError as e:
            raise ReviewError(f"the revision failed: {e}") from e

    def summary(self) -> dict:
        tables = sorted({f.db.table for f in self.config.fields})
        return {"record_count": self.records.count(), "tables_affected": tables, "status": self.status.value, "revision_count": self.revisions}

    def sql_preview(self) -> list[str]:
        return insert_preview(self.records, self.config)


def show(batch: ReviewBatch, say: Callable[[str], None]) -> None:
    s = batch.summary()
    say(f"{s['record_count']} records for {', '.join(s['tables_affected'])}; status {s['status']}, revision {s['revision_count']}")
    names = [f.name for f in batch.config.fields]
    for r in batch.records.orderBy("_file_idx", "_row_idx").limit(10).collect():
        say("  " + ", ".join(f"{n}={r[n]}" for n in names if r[n] is not None))
    for line in batch.sql_preview()[:5]:
        say("  " + line)


def run_review(batch: ReviewBatch, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> ReviewBatch:
    """Asks until the batch is approved or rejected; any other answer is a change to make."""
    while True:
        show(batch, say)
        answer = ask("[a]pprove, [r]eject, or say what to change: ").strip()
        if answer.lower() in ("a", "approve"):
            batch.approve()
            return batch
        if answer.lower() in ("r", "reject"):
            batch.reject()
            return batch
        if answer:
            try:
                batch = batch.revise(answer)
                if batch.dropped:
                    say(f"{batch.dropped} records no longer validate and were left out")
            except ReviewError as e:
                say(str(e))
