"""The whole run: read, extract, validate, deduplicate, review, relate, load."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.config import Config, with_options
from tabloom.errors import DatabaseError
from tabloom.operators.dedup import duplicates, existing_keys, mark_duplicates, unique
from tabloom.operators.extract import Backend, HttpBackend, extract
from tabloom.operators.relate import models, relate, too_long
from tabloom.operators.validate import invalid, valid, validate
from tabloom.plans.review import ReviewBatch, ReviewStatus, run_review
from tabloom.plans.shared import written
from tabloom.sources.sheets import read_all
from tabloom.sources.sinks import Sink, open_sink

log = logging.getLogger("tabloom")
ORDER = ("_file_idx", "_row_idx")


@dataclass
class Result:
    """Counts of a run, and its rows that didn't go in as DataFrames (None where a run didn't come that far)."""

    total_extracted: int = 0
    total_valid: int = 0
    total_invalid: int = 0
    total_duplicates: int = 0
    total_reviewed: int = 0
    total_inserted: int = 0
    total_skipped_chunks: int = 0
    skipped_chunks: DataFrame | None = field(default=None, repr=False)
    invalid_records: DataFrame | None = field(default=None, repr=False)
    duplicate_records: DataFrame | None = field(default=None, repr=False)
    valid_records: DataFrame | None = field(default=None, repr=False)
    tables: dict[str, DataFrame] = field(default_factory=dict, repr=False)
    dry_run: bool = False


class Pipeline:
    """Runs a configuration. ``backend`` answers prompts (by default the configured server)."""

    def __init__(self, spark: SparkSession, config: Config, *, backend: Backend | None = None, sink: Sink | None = None, today: dt.date | None = None, ask: Callable[[str], str] = input, say: Callable[[str], None] = print) -> None:
        self.spark, self.config, self.today, self.ask, self.say = spark, config, today, ask, say
        self.backend = backend or HttpBackend(config.llm)
        self._sink = sink

    def run(self, input_path: str, *, dry_run: bool = False, no_review: bool = False, create_tables: bool = False, chunk_size: int | None = None, sheet: str | int | None = None) -> Result:
        """``input_path``: a spreadsheet file or a folder of them. ``dry_run``: up to deduplication, no database."""
        config = with_options(self.config, chunk_size=chunk_size)
        result = Result(dry_run=dry_run)
        sheets = read_all(self.spark, input_path, sheet=sheet)
        if not sheets:
            log.warning("no spreadsheets in %s", input_path)
            return result
        parts = [extract(s, config.fields, self.backend, chunk_size=config.pipeline.chunk_size, hints=config.llm.extraction_hints) for s in sheets]
        records = reduce(DataFrame.unionByName, [r for r, _ in parts])
        result.skipped_chunks = reduce(DataFrame.unionByName, [s for _, s in parts]).orderBy("file", "chunk")
        result.total_skipped_chunks = result.skipped_chunks.count()
        return self.load(records, config, result, no_review=no_review, create_tables=create_tables)

    def load(self, records: DataFrame, config: Config, result: Result, *, no_review: bool = False, create_tables: bool = False) -> Result:
        """From extracted records (texts, with _file_idx and _row_idx) on."""
        checked = written(validate(records, config.fields, keep=ORDER, today=self.today), "checked")
        counts = {bool(r["bad"]): r["count"] for r in checked.groupBy((F.size("_errors") > 0).alias("bad")).count().collect()}
        result.total_valid, result.total_invalid = counts.get(False, 0), counts.get(True, 0)
        result.total_extracted = result.total_valid + result.total_invalid
        result.invalid_records, result.valid_records = invalid(checked, ORDER), valid(checked)
        if not result.total_valid:
            return result
        sink = None
        try:
            if not result.dry_run:
                sink = self._sink or open_sink(self.spark, config.database.url)
            fine = self._deduplicated(valid(checked), config, result, sink, create_tables)
            if result.dry_run or result.total_valid == result.total_duplicates:
                return result
            return self._inserted(fine, config, result, sink, no_review, create_tables)
        finally:
            if sink is not None and sink is not self._sink:
                sink.close()

    def _deduplicated(self, fine: DataFrame, config: Config, result: Result, sink: Sink | None, create_tables: bool) -> DataFrame:
        dedup = config.deduplication
        if not dedup or not dedup.key:
            return fine
        existing = None
        if dedup.check_db and sink is not None:
            targets = [config.field_named(k).db for k in dedup.key]
            if len({t.table for t in targets}) > 1:
                raise DatabaseError("check_db needs all key fields in one table")
            stored = sink.read(models(config)[targets[0].table], [t.column for t in targets])
            if stored is None and not create_tables:
                raise DatabaseError(f"Missing tables: ['{targets[0].table}']; --create-tables makes them")
            if stored is not None:
                # Stored columns as fields, in the type that validation gives (a stored date is a text again).
                same = stored.toDF(*dedup.key).select(*[F.col(f"`{k}`").cast(fine.schema[k].dataType).alias(k) for k in dedup.key])
                existing = existing_keys(same, dedup.key, dedup.match)
        marked = written(mark_duplicates(fine, dedup.key, match=dedup.match, existing=existing), "marked")
        result.duplicate_records = duplicates(marked)
        result.total_duplicates = result.duplicate_records.count()
        result.valid_records = unique(marked)
        return result.valid_records

    def _inserted(self, fine: DataFrame, config: Config, result: Result, sink: Sink, no_review: bool, create_tables: bool) -> Result:
        shapes = models(config)
        if create_tables:
            sink.create_all(shapes)
        else:
            sink.verify(list(shapes))
        if config.pipeline.review and not no_review:
            batch = run_review(ReviewBatch(self.spark, fine, config, self.backend), self.ask, self.say)
            if batch.status is not ReviewStatus.APPROVED:
                return result
            fine = batch.records
            result.total_reviewed = fine.count()
        stored = {}
        for table in config.tables:
            columns = {config.tables[table].primary_key.column, *(r.resolve_by for r in config.belongs_to if r.references == table)}
            found = sink.read(shapes[table], sorted(columns))
            if found is not None:
                stored[table] = found
        tables = relate(fine, config, stored)
        tables = {name: written(df, f"staged-{name}") for name, df in tables.items()}
        for name, df in tables.items():
            if bad := too_long(df, shapes[name].schema):
                raise DatabaseError(f"values don't fit in {name}: {', '.join(bad)}")
        sink.append(tables, shapes)
        result.tables, result.total_inserted = tables, fine.count()
        return result
