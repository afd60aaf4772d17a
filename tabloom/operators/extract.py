"""Extraction: runs of rows go to a backend as a prompt; its answer becomes records, or an entry of the skip report.

Each chunk is one group; what the backend answered is written once, so that a later look at the records never asks
again. A retried task asks again only for its own chunks.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.config import Field, Llm
from tabloom.errors import ExtractionError
from tabloom.functions import codes
from tabloom.operators.ordinals import chunks

Backend = Callable[[str], str]


class HttpBackend:
    """A chat-completions server. Any failure is an ``ExtractionError``."""

    def __init__(self, llm: Llm, timeout: float = 120) -> None:
        self.llm, self.timeout = llm, timeout

    def __call__(self, prompt: str) -> str:
        import urllib.request

        body = {"model": self.llm.model, "temperature": 0.0, "messages": [{"role": "user", "content": prompt}]}
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.llm.api_key or 'none'}"}
        try:
            asked = urllib.request.Request(self.llm.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), head)
            with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                return json.load(answer)["choices"][0]["message"]["content"] or ""
        except Exception as e:
            raise ExtractionError(f"LLM call failed: {e}") from e


class ColumnBackend:
    """Answers from the CSV in the prompt itself: each field takes the column of its name (or the one that ``mapping`` has
    for it; letter case, spaces and underscores don't count). Deterministic and offline, for sheets whose columns are known."""

    def __init__(self, fields: list[str], mapping: dict[str, str] | None = None) -> None:
        self.fields, self.mapping = fields, mapping or {}

    def __call__(self, prompt: str) -> str:
        text = prompt.split("CSV data:\n", 1)[1].split("\n\nYou returned ", 1)[0]
        plain = lambda s: re.sub(r"[\s_]", "", s).lower()
        rows = [{plain(k or ""): v for k, v in row.items()} for row in csv.DictReader(io.StringIO(text))]
        return json.dumps([{f: row.get(plain(self.mapping.get(f, f)), "") for f in self.fields} for row in rows])


def enum_values(values: list[str]) -> str:
    """Up to ten values; of more the first five and the last two."""
    return ", ".join(values if len(values) <= 10 else [*values[:5], "...", *values[-2:]])


def describe(f: Field) -> str:
    """A field's line in a prompt."""
    kind = f.type
    if f.type == "enum":
        values = f.values if f.values is not None else codes.resolve_preset(f.preset) if f.preset else []
        kind = f"one of: {enum_values(values)}"
    elif f.type == "country":
        kind = "country, as a two-letter ISO code"
    elif f.type == "subdivision":
        kind = f"state or province of {f.country_code}, as its ISO code"
    elif f.type == "phone":
        kind = "phone number of ten digits"
    return f"{f.name} ({kind}{', required' if f.required else ''})"


def extraction_prompt(fields: list[Field], chunk_csv: str, rows: int | str, hints: str | None = None) -> str:
    lines = "\n".join(f"- {describe(f)}" for f in fields)
    more = f"\nAdditional instructions:\n{hints}\n" if hints else ""
    return (
        f"Extract these fields from every row of the CSV below:\n{lines}\n{more}\n"
        f"Answer with a JSON array of exactly {rows} objects, one for each row and in the same order. Each has all fields; "
        f'a missing value is "". Leave no row out and repeat none.\n\nCSV data:\n{chunk_csv}'
    )


def correction_prompt(expected: int, actual: int) -> str:
    return f"You returned {actual} objects, but there are {expected} rows. Return exactly {expected} objects."


def revision_prompt(batch_json: str, command: str) -> str:
    return f"These are records as JSON:\n{batch_json}\n\nChange them as follows:\n{command}\n\nAnswer with a JSON array of records with the same keys."


def parse_records(text: str) -> list[Any]:
    """The list in an answer: bare, in a code fence, amid other text, or the first list among an object's values."""
    fence = re.search(r"```[a-zA-Z]*\s*\n?(.*?)```", text, re.S)
    body = (fence[1] if fence else text).strip()
    begin = re.search(r"[\[{]", body)
    if not begin:
        raise ExtractionError("No JSON found in the answer")
    try:
        found, _ = json.JSONDecoder().raw_decode(body, begin.start())
    except ValueError as e:
        raise ExtractionError(f"Failed to parse JSON: {e}") from e
    if isinstance(found, dict):
        found = next((v for v in found.values() if isinstance(v, list)), None)
    if not isinstance(found, list):
        raise ExtractionError("There is no array value in the answer")
    return found


def ask(backend: Backend, fields: list[Field], header: list[str], rows: list[list[str]], hints: str | None) -> tuple[list[Any], str | None]:
    """(records, None), or ([], why the chunk is skipped). Another number of records than rows is asked about once more."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([header, *rows])
    prompt, n = extraction_prompt(fields, out.getvalue(), len(rows), hints), len(rows)
    try:
        found = parse_records(backend(prompt))
    except ExtractionError as e:
        return [], f"LLM error: {e}"
    if len(found) == n:
        return found, None
    try:
        again = parse_records(backend(f"{prompt}\n\n{correction_prompt(n, len(found))}"))
    except ExtractionError as e:
        return [], f"Retry failed: {e}"
    return (again, None) if len(again) == n else ([], f"Row count mismatch: expected {n}, got {len(again)}")


def chunk_prompts(sheet: DataFrame, fields: list[Field], *, chunk_size: int = 25, hints: str | None = None) -> DataFrame:
    """_file_idx, _chunk_id, rows, prompt: what ``extract`` would send, made by Spark alone (to look at, or to send elsewhere)."""
    header = [c for c in sheet.columns if c not in ("_file_idx", "_row_idx", "_file")]
    cell = lambda c: F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    lines = chunks(sheet, chunk_size).select("_file_idx", "_chunk_id", F.struct("_row_idx", F.concat_ws(",", *[cell(F.col(f"`{c}`").cast("string")) for c in header]).alias("line")).alias("l"))
    grouped = lines.groupBy("_file_idx", "_chunk_id").agg(F.sort_array(F.collect_list("l")).alias("ls"))  # chunk_size rows at most
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(header)
    body = F.concat(F.lit(out.getvalue()), F.array_join(F.col("ls.line"), "\n"), F.lit("\n"))
    mark, number = "\x00csv\x00", "\x00rows\x00"
    template = extraction_prompt(fields, mark, number, hints)
    prompt = F.replace(F.replace(F.lit(template), F.lit(number), F.size("ls").cast("string")), F.lit(mark), body)
    return grouped.select("_file_idx", "_chunk_id", F.size("ls").alias("rows"), prompt.alias("prompt"))


def as_text(value: Any) -> str | None:
    """A record's value as the text that validation reads."""
    return None if value is None else value if isinstance(value, str) else str(value)


def extract(sheet: DataFrame, fields: list[Field], backend: Backend, *, chunk_size: int = 25, hints: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, skipped) of ``sheet`` (texts, with _file_idx, _row_idx and _file).

    records: _file_idx, _row_idx and a text column for each field. A record that is no object has no values and so fails
    its required fields. skipped: file, chunk, row_range, rows_affected, reason.
    """
    from tabloom.plans.shared import written

    header = [c for c in sheet.columns if c not in ("_file_idx", "_row_idx", "_file")]
    names = [f.name for f in fields]
    report = ["file", "chunk", "row_range", "rows_affected", "reason"]
    schema = T.StructType([
        T.StructField("_file_idx", T.IntegerType()), T.StructField("_row_idx", T.LongType()), T.StructField("ok", T.BooleanType()),
        *[T.StructField(f"v{i}", T.StringType()) for i in range(len(names))],
        *T.StructType.fromDDL("file string, chunk long, row_range string, rows_affected long, reason string").fields,
    ])
    columns = [f.name for f in schema]

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("_row_idx")
        rows = [[x or "" for x in r] for r in pdf[[f"c{i}" for i in range(len(header))]].itertuples(index=False)]
        found, reason = ask(backend, fields, header, rows, hints)
        if reason is not None:
            first = int(pdf["_row_idx"].iloc[0]) + 1
            one = dict.fromkeys(columns) | {"_file_idx": int(key[0]), "ok": False, "file": pdf["_file"].iloc[0], "chunk": int(key[1]), "row_range": f"rows {first}-{first + len(rows) - 1}", "rows_affected": len(rows), "reason": reason}
            return pd.DataFrame([one], columns=columns)
        made = []
        for at, record in zip(pdf["_row_idx"], found, strict=True):
            record = record if isinstance(record, dict) else {}
            made.append(dict.fromkeys(columns) | {"_file_idx": int(key[0]), "_row_idx": int(at), "ok": True} | {f"v{i}": as_text(record.get(n)) for i, n in enumerate(names)})
        return pd.DataFrame(made, columns=columns)

    slim = sheet.select("_file_idx", "_row_idx", "_file", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(header)])
    answered = written(chunks(slim, chunk_size).groupBy("_file_idx", "_chunk_id").applyInPandas(run, schema), "extracted")
    records = answered.where("ok").select("_file_idx", "_row_idx", *[F.col(f"v{i}").alias(n) for i, n in enumerate(names)])
    return records, answered.where("not ok").select(*report)
