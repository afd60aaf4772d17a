"""Spreadsheet files as DataFrames of texts, with _file_idx, _row_idx (from 0) and _file.

All values are texts; missing ones, and those that stand for them, are empty. Files are read by Spark (so any store it
reads will do): CSV by its reader, XLSX and ODS, which can't be split, as binary files that a task unpacks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.errors import ExtractionError
from tabloom.operators.ordinals import in_order_of_scan

SUFFIXES = (".csv", ".xlsx", ".xls", ".ods")
# Cells that count as missing.
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def unique_names(header: list[str | None]) -> list[str]:
    """Column names: blank ones get a number, repeated ones a suffix."""
    out: list[str] = []
    for i, raw in enumerate(header):
        name = raw if raw else f"Unnamed: {i}"
        k, base = 0, name
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


def _suffix(path: str) -> str:
    m = re.search(r"\.[^./\\]+$", path)
    return m[0].lower() if m else ""


def read_sheet(spark: SparkSession, path: str, *, sheet: str | int | None = None, file_idx: int = 0) -> DataFrame:
    """One file. ``sheet``: a name or a number from 0 (the first one if None); CSV files have none."""
    kind = _suffix(path)
    if kind not in SUFFIXES:
        raise ExtractionError(f"Unsupported file format: {kind or path}")
    if kind == ".xls":
        raise ExtractionError(f"Failed to read {path}: no reader of .xls files is available; save it as .xlsx")
    try:
        found = _csv(spark, path) if kind == ".csv" else _zipped(spark, path, kind, sheet)
    except ExtractionError:
        raise
    except Exception as e:
        raise ExtractionError(f"Failed to read {path}: {str(e).splitlines()[0] if str(e) else e!r}") from e
    names = [c for c in found.columns if c != "_row_idx"]
    plain = [F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")).isin(*MISSING), "").otherwise(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in names]
    return found.select(*plain, F.lit(file_idx).alias("_file_idx"), F.col("_row_idx").cast("long"), F.lit(path.rsplit("/", 1)[-1]).alias("_file"))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    options = {"header": "false", "inferSchema": "false", "multiLine": "true", "quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}
    head = spark.read.options(**options).csv(path).limit(1).collect()
    if not head:
        raise ExtractionError(f"Failed to read {path}: it is empty")
    names = unique_names([x.lstrip("﻿") if x else x for x in head[0]])
    schema = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(len(names))], T.StructField("_bad", T.StringType())])
    rows = spark.read.options(**options | {"header": "true", "enforceSchema": "true", "columnNameOfCorruptRecord": "_bad"}).schema(schema).csv(path)
    # A row with more cells than the header fits no column.
    rows = rows.withColumn("_bad", F.when(F.size(F.split(F.coalesce("_bad", F.lit("")), ",")) > len(names), F.raise_error(F.concat(F.lit("too many cells: "), F.substring("_bad", 1, 80)))))
    some = F.coalesce(*[F.col(f"c{i}") for i in range(len(names))]).isNotNull()
    return in_order_of_scan(rows.where(some | F.col("_bad").isNotNull()).drop("_bad").toDF(*names))


# The namespaces of the two formats.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"


def _pick(names: list[str], sheet: str | int | None) -> int:
    if isinstance(sheet, str):
        if sheet not in names:
            raise ValueError(f"there is no sheet {sheet!r}")
        return names.index(sheet)
    if not 0 <= (sheet or 0) < len(names):
        raise ValueError(f"there is no sheet {sheet}")
    return sheet or 0


def xlsx_rows(raw: bytes, sheet: str | int | None) -> Iterator[list[str | None]]:
    """The rows of a sheet, cell by cell as texts; gaps are None."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
    chosen = sheets[_pick([s.get("name") for s in sheets], sheet)]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[chosen.get(f"{_REL}id")].lstrip("/")
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            out: list[str | None] = []
            for c in row:
                letters, at = re.match(r"[A-Z]*", c.get("r") or "")[0], 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                out += [None] * (at - 1 - len(out) if letters else 0)
                v = c.find(f"{_MAIN}v")
                kind = c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    text = None
                elif kind == "s":
                    text = shared[int(v.text)]
                elif kind == "b":
                    text = "True" if v.text == "1" else "False"
                else:
                    text = re.sub(r"\.0$", "", v.text) if kind in (None, "n") else v.text
                out.append(text)
            yield out
            row.clear()


def ods_rows(raw: bytes, sheet: str | int | None) -> Iterator[list[str | None]]:
    """The rows of a table; cells and rows that are said to repeat do, but for the blank rest of a sheet."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("content.xml"))
    tables = list(root.iter(f"{_TABLE}table"))
    chosen = tables[_pick([t.get(f"{_TABLE}name") for t in tables], sheet)]
    gap = 0
    for row in chosen.iter(f"{_TABLE}table-row"):
        out: list[str | None] = []
        blank = 0
        for c in row:
            if c.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                continue
            lines = ["".join(p.itertext()) for p in c.findall(f"{_TEXT}p")]
            value = c.get(f"{_OFFICE}value") if c.get(f"{_OFFICE}value-type") in ("float", "percentage", "currency") else None
            text = value if value is not None else "\n".join(lines) if lines else None
            times = int(c.get(f"{_TABLE}number-columns-repeated", "1"))
            if text is None:
                blank += times
            else:
                out += [None] * blank + [text] * times
                blank = 0
        times = int(row.get(f"{_TABLE}number-rows-repeated", "1"))
        if not out:
            gap += times
            continue
        yield from ([] for _ in range(gap))
        gap = 0
        yield from ([*out] for _ in range(times))


def _zipped(spark: SparkSession, path: str, kind: str, sheet: str | int | None) -> DataFrame:
    rows_of = xlsx_rows if kind == ".xlsx" else ods_rows
    file = spark.read.format("binaryFile").load(path).select("content")

    def header(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"h": [next(rows_of(raw, sheet), None)]}, schema=pa.schema([("h", pa.list_(pa.string()))]))

    head = file.mapInArrow(header, "h array<string>").collect()
    if not head or not head[0]["h"]:
        raise ExtractionError(f"Failed to read {path}: it is empty")
    names = unique_names(head[0]["h"])

    def body(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows, at, held = rows_of(raw, sheet), 0, []
                next(rows)
                for cells in rows:
                    if any(x is not None for x in cells[len(names) :]):
                        raise ValueError(f"row {at + 1} has more cells than the header")
                    if any(x is not None for x in cells):
                        held.append([*cells, *[None] * (len(names) - len(cells))][: len(names)] + [at])
                        at += 1
                    if len(held) == 10_000:
                        yield _batch(pa, held, len(names))
                        held = []
                if held:
                    yield _batch(pa, held, len(names))

    schema = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(len(names))], T.StructField("_row_idx", T.LongType())])
    return file.mapInArrow(body, schema).toDF(*names, "_row_idx")


def _batch(pa, rows: list[list], n: int):
    arrays = [pa.array([r[i] for r in rows], pa.string()) for i in range(n)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([r[n] for r in rows], pa.int64())], names=[*[f"c{i}" for i in range(n)], "_row_idx"])


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The spreadsheet files directly in a folder, sorted by name; of a file, itself."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise ExtractionError(f"Failed to read {path}: there is no such file")
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if _suffix(n) in SUFFIXES]


def read_all(spark: SparkSession, path: str, *, sheet: str | int | None = None) -> list[DataFrame]:
    """A DataFrame for each file of a folder (or for the one file), numbered in order."""
    return [read_sheet(spark, f, sheet=sheet, file_idx=i) for i, f in enumerate(list_files(spark, path))]
