"""The YAML configuration: fields, tables, relationships and run options, checked as a whole before anything runs."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from tabloom.errors import ConfigError

#: The names that configurations use.
FIELD_TYPES = ("string", "integer", "number", "currency", "phone", "url", "email", "date", "datetime", "enum", "boolean", "regex", "subdivision", "country")
KEY_TYPES = ("auto_increment", "uuid")
MATCHES = ("exact", "case_insensitive")
LOG_LEVELS = ("debug", "info", "warning", "error")


@dataclass(frozen=True)
class Llm:
    base_url: str
    model: str
    api_key: str = ""
    extraction_hints: str | None = None


@dataclass(frozen=True)
class Database:
    url: str


@dataclass(frozen=True)
class Target:
    table: str
    column: str


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    db: Target
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    min: float | None = None
    max: float | None = None
    values: list[str] | None = None
    preset: str | None = None
    pattern: str | None = None
    format: str | None = None
    case: str | None = None
    country_code: str | None = None


@dataclass(frozen=True)
class PrimaryKey:
    column: str
    type: str


@dataclass(frozen=True)
class Table:
    primary_key: PrimaryKey


@dataclass(frozen=True)
class Deduplication:
    key: list[str]
    check_db: bool = False
    match: str = "exact"


@dataclass(frozen=True)
class BelongsTo:
    field: str
    table: str
    references: str
    fk_column: str
    resolve_by: str


@dataclass(frozen=True)
class Junction:
    link: list[str]
    through: str
    columns: dict[str, str]


@dataclass(frozen=True)
class Options:
    chunk_size: int = 25
    review: bool = False
    log_level: str = "info"
    log_dir: str | None = None


@dataclass(frozen=True)
class Config:
    name: str
    llm: Llm
    database: Database
    fields: list[Field]
    tables: dict[str, Table]
    deduplication: Deduplication | None = None
    relationships: list[BelongsTo | Junction] = field(default_factory=list)
    pipeline: Options = field(default_factory=Options)

    def field_named(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def columns_of(self, table: str) -> list[Field]:
        return [f for f in self.fields if f.db.table == table]

    @property
    def belongs_to(self) -> list[BelongsTo]:
        return [r for r in self.relationships if isinstance(r, BelongsTo)]

    @property
    def junctions(self) -> list[Junction]:
        return [r for r in self.relationships if isinstance(r, Junction)]


_SIMPLE = {"str": str, "bool": bool, "int": int, "float": (int, float)}


def _build(kind: type, raw: Any, where: str, **nested: Any) -> Any:
    """A dataclass from a mapping: missing and ill-typed values are errors that name their place."""
    if not isinstance(raw, dict):
        raise ConfigError(f"{where}: a mapping is needed")
    out = {}
    for f in fields(kind):
        if f.name in nested:
            out[f.name] = nested[f.name]
            continue
        value = raw.get(f.name)
        base = str(f.type).removesuffix(" | None")
        if value is None:
            if f.default is f.default_factory and f.name not in raw or (value is None and f.name in raw and "None" not in str(f.type)):
                raise ConfigError(f"{where}.{f.name}: missing")
            continue
        if base in _SIMPLE and (not isinstance(value, _SIMPLE[base]) or isinstance(value, bool) and base != "bool"):
            raise ConfigError(f"{where}.{f.name}: {value!r} is no {base}")
        if base == "list[str]" and not (isinstance(value, list) and all(isinstance(x, (str, int, float)) for x in value)):
            raise ConfigError(f"{where}.{f.name}: a list of texts is needed")
        out[f.name] = [str(x) for x in value] if base == "list[str]" else value
    return kind(**out)


def _one_of(value: Any, among: tuple[str, ...], where: str) -> None:
    if value not in among:
        raise ConfigError(f"{where}: {value!r} is none of {', '.join(among)}")


def parse(raw: Any) -> Config:
    """A checked configuration from what YAML gives."""
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    for part in ("name", "llm", "database", "schema"):
        if raw.get(part) is None:
            raise ConfigError(f"{part}: missing")
    schema = raw["schema"]
    if not isinstance(schema, dict) or not isinstance(schema.get("fields"), list) or not isinstance(schema.get("tables"), dict):
        raise ConfigError("schema: fields (a list) and tables (a mapping) are needed")
    found = []
    for i, f in enumerate(schema["fields"]):
        where = f"schema.fields[{i}]"
        target = _build(Target, (f or {}).get("db") if isinstance(f, dict) else None, f"{where}.db")
        found.append(_build(Field, f, where, db=target))
    tables = {name: Table(_build(PrimaryKey, (t or {}).get("primary_key") if isinstance(t, dict) else None, f"schema.tables.{name}.primary_key")) for name, t in schema["tables"].items()}
    relationships: list[BelongsTo | Junction] = []
    for i, r in enumerate(raw.get("relationships") or []):
        kinds = {"belongs_to": BelongsTo, "junction": Junction}
        kind = kinds.get(r.get("type") if isinstance(r, dict) else None)
        if kind is None:
            raise ConfigError(f"relationships[{i}].type: belongs_to or junction is needed")
        relationships.append(_build(kind, r, f"relationships[{i}]"))
    dedup = _build(Deduplication, schema["deduplication"], "schema.deduplication") if schema.get("deduplication") is not None else None
    config = Config(
        str(raw["name"]), _build(Llm, raw["llm"], "llm"), _build(Database, raw["database"], "database"), found, tables, dedup, relationships,
        _build(Options, raw.get("pipeline") or {}, "pipeline"),
    )
    check(config)
    return config


def check(config: Config) -> None:
    """Rules on single values and between parts."""
    names = [f.name for f in config.fields]
    if len(set(names)) < len(names):
        raise ConfigError("schema.fields: two fields have the same name")
    for f in config.fields:
        _one_of(f.type, FIELD_TYPES, f"field {f.name}: type")
        if f.db.table not in config.tables:
            raise ConfigError(f"field {f.name}: table {f.db.table!r} isn't declared")
        for low, high in ((f.min, f.max), (f.min_length, f.max_length)):
            if low is not None and high is not None and low > high:
                raise ConfigError(f"field {f.name}: the least value is above the largest")
        if f.type == "enum" and f.values is None and f.preset is None:
            raise ConfigError(f"field {f.name}: an enum needs values or a preset")
        if f.type == "regex" and not f.pattern:
            raise ConfigError(f"field {f.name}: a regex needs a pattern")
        if f.type == "subdivision" and not f.country_code:
            raise ConfigError(f"field {f.name}: a subdivision needs a country_code")
    for name, t in config.tables.items():
        _one_of(t.primary_key.type, KEY_TYPES, f"table {name}: primary_key.type")
    for r in config.relationships:
        if isinstance(r, BelongsTo):
            if r.field not in names:
                raise ConfigError(f"belongs_to: field {r.field!r} isn't declared")
            missing = [t for t in (r.table, r.references) if t not in config.tables]
        else:
            if len(r.link) != 2:
                raise ConfigError(f"junction {r.through}: exactly two tables are linked")
            missing = [t for t in r.link if t not in config.tables]
            if not missing and (not isinstance(r.columns, dict) or any(t not in r.columns for t in r.link)):
                raise ConfigError(f"junction {r.through}: columns must name both tables")
        if missing:
            raise ConfigError(f"relationships: table {missing[0]!r} isn't declared")
    if config.deduplication:
        _one_of(config.deduplication.match, MATCHES, "schema.deduplication.match")
        for k in config.deduplication.key:
            if k not in names:
                raise ConfigError(f"schema.deduplication.key: field {k!r} isn't declared")
    if config.pipeline.chunk_size < 1:
        raise ConfigError("pipeline.chunk_size: at least 1")
    _one_of(config.pipeline.log_level, LOG_LEVELS, "pipeline.log_level")


_VARIABLE = re.compile(r"\$\{([^}]+)\}")


def substitute(value: Any, env: dict[str, str]) -> Any:
    """``${NAME}`` in texts, at any depth of lists and mappings (not in keys), by environment variables."""
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] not in env:
            raise ConfigError(f"environment variable {m[1]!r} is not set")
        return env[m[1]]

    return _VARIABLE.sub(one, value)


def read_env_file(path: Path) -> dict[str, str]:
    """NAME=value lines of a ``.env`` file; quotes around values and ``export`` are dropped."""
    out = {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.is_file() else []:
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return out


def load_config(path: str | Path) -> Config:
    """The configuration in a file. A ``.env`` beside it adds variables that the environment doesn't set."""
    path = Path(path)
    try:
        text = path.read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e}") from e
    for k, v in read_env_file(path.parent / ".env").items():
        os.environ.setdefault(k, v)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML configurations need PyYAML; parse() takes a mapping") from e
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e
    return parse(substitute(raw, dict(os.environ)))


def validate_config(path: str | Path) -> list[str]:
    """What is allowed but may not be meant."""
    config, notes = load_config(path), []
    if config.deduplication is None:
        notes.append("no deduplication is configured: repeated records are loaded")
    if not config.relationships:
        notes.append("no relationships are configured: tables won't be linked")
    if not config.pipeline.review:
        notes.append("review is disabled: records are loaded without being looked at")
    return notes


def with_options(config: Config, **changes: Any) -> Config:
    """A copy with other run options; None leaves an option as it is."""
    given = {k: v for k, v in changes.items() if v is not None}
    changed = replace(config, pipeline=replace(config.pipeline, **given))
    check(changed)
    return changed


TEMPLATE = """\
# Which spreadsheet fields to extract, how to check them, and where they go.
name: "my-import"

llm:                          # any server with a chat-completions interface
  base_url: "http://localhost:11434/v1"
  model: "my-model"
  api_key: "${LLM_API_KEY}"   # from the environment or a .env file beside this one
  # extraction_hints: "Amounts are in EUR."

database:
  url: "sqlite:///out.db"     # or jdbc:..., catalog:<schema>, parquet:<folder>

schema:
  # Types: string, integer, number, currency, phone, url, email, date, datetime,
  #        enum, boolean, regex, subdivision, country
  fields:
    - name: company_name
      type: string
      required: true
      min_length: 2
      db: {table: companies, column: name}
    - name: parent_entity
      type: string
      db: {table: companies, column: parent_name}
    - name: state
      type: enum
      preset: us_states       # or values: [...]
      db: {table: addresses, column: state_code}
  tables:
    companies:
      primary_key: {column: id, type: auto_increment}   # or uuid
    addresses:
      primary_key: {column: id, type: auto_increment}
  deduplication:
    key: [company_name]
    check_db: false
    match: case_insensitive   # or exact

relationships:
  - type: belongs_to
    field: parent_entity
    table: companies
    references: companies
    fk_column: parent_id
    resolve_by: name
  - type: junction
    link: [companies, addresses]
    through: company_addresses
    columns: {companies: company_id, addresses: address_id}

pipeline:
  chunk_size: 25
  review: false
  log_level: info
"""
