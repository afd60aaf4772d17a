"""From valid records to related tables: one projection a table, generated keys, foreign keys and links.

A record's rows go in table by table, parents first. A foreign key is the key of the *latest* earlier row of the
referenced table with the wanted value (for another table also that of the same record), or else of a stored row: an
as-of join on (value, insertion order). It is done within blocks of the order, with each block's last row carried to
the next ones, so that a value with very many rows is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.config import BelongsTo, Config
from tabloom.errors import DatabaseError
from tabloom.functions.normalize import field_type
from tabloom.operators.ordinals import numbered

BLOCK = 1_000_000


@dataclass(frozen=True)
class TableModel:
    """A target table: its columns, its key and which tables its foreign keys point to."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    references: dict[str, str]


def key_type(config: Config, table: str) -> T.DataType:
    return T.LongType() if config.tables[table].primary_key.type == "auto_increment" else T.VarcharType(36)


def models(config: Config) -> dict[str, TableModel]:
    """All target tables, data tables first, then junctions."""
    out = {}
    for name, table in config.tables.items():
        columns = [T.StructField(table.primary_key.column, key_type(config, name), False)]
        columns += [T.StructField(f.db.column, field_type(f.type).stored) for f in config.columns_of(name)]
        links = {r.fk_column: r.references for r in config.belongs_to if r.table == name}
        columns += [T.StructField(c, key_type(config, t)) for c, t in links.items()]
        out[name] = TableModel(name, T.StructType(columns), (table.primary_key.column,), links)
    for j in config.junctions:
        columns = [T.StructField(j.columns[t], key_type(config, t), False) for t in j.link]
        out[j.through] = TableModel(j.through, T.StructType(columns), tuple(j.columns[t] for t in j.link), {j.columns[t]: t for t in j.link})
    return out


def table_order(config: Config) -> list[str]:
    """Tables with those they refer to first, ties as declared; a table may refer to itself."""
    needs = {t: {r.references for r in config.belongs_to if r.table == t and r.references != t} for t in config.tables}
    out: list[str] = []
    while len(out) < len(needs):
        ready = [t for t in needs if t not in out and needs[t] <= set(out)]
        if not ready:
            raise DatabaseError(f"tables refer to one another in a circle: {', '.join(sorted(set(needs) - set(out)))}")
        # Those that became ready first go first, a layer at a time.
        out += ready
    return out


def own_rows(records: DataFrame, config: Config, table: str, foreign: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """ord and the table's data columns (named as in the table) of the records that have a row in it.

    A record without any value has no row if keys are counted up; with uuid keys it always has.
    """
    fields = config.columns_of(table)
    rows = records.select("ord", *[F.col(f"`{f.name}`").alias(f.db.column) for f in fields], *foreign)
    if config.tables[table].primary_key.type == "uuid":
        return rows
    some = F.lit(False)
    for c in [f.db.column for f in fields] + list(foreign):
        some = some | F.col(f"`{c}`").isNotNull()
    return rows.where(some)


def insertion_order(records: DataFrame, config: Config, existing: DataFrame | None = None) -> DataFrame:
    """``records`` (with _file_idx and _row_idx) with ``ord``, 0, 1 ... in the order of insertion.

    With a table that refers to itself, records come after their parents as far as that goes (see ``hierarchy_order``).
    """
    rows = numbered(records, ["_file_idx", "_row_idx"], "ord", start=0)
    own = next((r for r in config.belongs_to if r.table == r.references), None)
    name = next((f.name for f in config.fields if own and (f.db.table, f.db.column) == (own.references, own.resolve_by)), None)
    if name is None:
        return rows
    passes = hierarchy_order(rows.select("ord", F.col(f"`{name}`").cast("string").alias("name"), F.col(f"`{own.field}`").cast("string").alias("parent")), existing)
    both = rows.withColumnRenamed("ord", "_old").join(passes.withColumnRenamed("ord", "_old"), "_old")
    return numbered(both, ["pass", "_old"], "ord", start=0).drop("pass", "_old")


def hierarchy_order(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """ord, pass of each row (ord, name, parent): the rows are to be inserted by (pass, ord).

    Pass 1 has rows without a parent or with a stored one (``existing``: name). Another row has its parent's pass, or
    the next one if the parent comes later; of parents of one name the one that lets it go first counts. Rows that no
    pass reaches (circles, absent parents) come last, in their order.

    Where no two rows that are parents have one name, each row points to its parent, and pointers are doubled: as many rounds as the
    logarithm of the depth. Else passes are done one after the other (``_by_passes``).
    """
    from tabloom.plans.shared import written

    blank = F.coalesce(F.col("parent"), F.lit("")) == ""
    if existing is not None:
        known = existing.select(F.col("name").cast("string").alias("parent")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "parent", "left")
        blank = blank | F.col("_known").isNotNull()
    rows = written(rows.withColumn("root", blank).select("ord", "name", "parent", "root"), "hierarchy")
    waiting = rows.where("not root")
    asked = waiting.select(F.col("parent").alias("name")).distinct()
    parents = written(rows.where(F.coalesce("name", F.lit("")) != "").join(asked, "name", "left_semi").groupBy("name").agg(F.min("ord").alias("up"), F.count(F.lit(1)).alias("c")), "parents")
    if parents.where("c > 1").limit(1).count():
        return _by_passes(rows)
    # up: the row's parent or a further ancestor, null from where its fate is known; reached: whether that is a pass, rather than
    # an absent parent; gained: passes on the way there. An ordinal may be any whole number, so none stands for "no parent".
    linked = waiting.join(parents.select(F.col("name").alias("parent"), "up"), "parent", "left")
    now = rows.where("root").select("ord", F.lit(None).cast("long").alias("up"), F.lit(1).cast("long").alias("gained"), F.lit(True).alias("reached"))
    now = now.unionByName(linked.select("ord", F.col("up").cast("long").alias("up"), F.coalesce((F.col("up") > F.col("ord")).cast("long"), F.lit(0)).alias("gained"), F.lit(False).alias("reached")))
    now, open_ = written(now, "pointers"), None
    while (left := now.where("up is not null").count()) and left != open_:
        open_ = left
        above = now.select(F.col("ord").alias("up"), F.col("up").alias("next"), F.col("gained").alias("more"), F.col("reached").alias("there"))
        doubled = now.join(above, "up", "left")
        now = written(doubled.select("ord", F.col("next").alias("up"), (F.col("gained") + F.coalesce("more", F.lit(0))).alias("gained"), F.coalesce("there", "reached").alias("reached")), "pointers")
    return now.select("ord", F.when(F.col("reached"), F.col("gained")).otherwise(2**31 - 1).cast("int").alias("pass"))


def _by_passes(rows: DataFrame) -> DataFrame:
    """``hierarchy_order`` of rows (ord, name, parent, root) in which parents may have namesakes.

    In a pass, rows reached take along those of their children that come later, and these theirs, until there are none;
    their other children begin the next pass. A name that was reached has a row (its smallest ordinal), so that a
    parent with very many children or namesakes costs no more than its links. Each pass reaches a row, so that it ends.
    """
    from tabloom.plans.shared import written

    waiting, fresh, done, k = rows.where("not root").drop("root"), rows.where("root").select("ord", "name", F.lit(1).alias("pass")), None, 0

    def heads(reached: DataFrame) -> DataFrame:
        return reached.where(F.coalesce("name", F.lit("")) != "").groupBy(F.col("name").alias("parent")).agg(F.min("ord").alias("first"))

    while True:
        k, level = k + 1, fresh
        while True:
            now = written(waiting.join(heads(fresh), "parent").where("first < ord").select("ord", "name", F.lit(k).alias("pass")), "reached")
            if not now.limit(1).count():
                break
            waiting = written(waiting.join(now.select("ord"), "ord", "left_anti"), "waiting")
            fresh, level = now, level.unionByName(now)
        done = level if done is None else done.unionByName(level)
        fresh = written(waiting.join(heads(level), "parent").select("ord", "name", F.lit(k + 1).alias("pass")), "reached")
        if not fresh.limit(1).count():
            break
        waiting = written(waiting.join(fresh.select("ord"), "ord", "left_anti"), "waiting")
    return done.unionByName(waiting.select("ord", "name", F.lit(2**31 - 1).alias("pass"))).select("ord", "pass")


def as_of(probes: DataFrame, events: DataFrame, *, strict: bool, block: int = BLOCK) -> DataFrame:
    """``probes`` (key, ord) with ``pk``: that of the latest event (key, ord, pk) before (``strict``) or up to it."""
    p = probes.select("key", "ord", F.lit(0 if strict else 1).alias("tie"), F.lit(None).cast(events.schema["pk"].dataType).alias("pk"), F.lit(True).alias("probe"))
    e = events.select("key", "ord", F.lit(1 if strict else 0).alias("tie"), "pk", F.lit(False).alias("probe"))
    fine = F.col("key").isNotNull() & (F.col("key") != "")
    both = p.unionByName(e).where(fine).withColumn("block", F.floor(F.col("ord") / block))
    inside = Window.partitionBy("key", "block").orderBy("ord", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("near", F.last("pk", ignorenulls=True).over(inside))
    # Each block's last event, carried on: a row for each key and block.
    ends = both.groupBy("key", "block").agg(F.max(F.when(~F.col("probe"), F.struct("ord", "tie", "pk"))).alias("m"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "block", F.last(F.col("m.pk"), ignorenulls=True).over(before).alias("far"))
    found = here.where("probe").join(carried, ["key", "block"])
    return found.select("key", "ord", F.coalesce("near", "far").alias("pk"))


def stored_keys(stored: dict[str, DataFrame], config: Config, table: str) -> DataFrame | None:
    """key, ord (before all records), pk of stored rows that foreign keys may point to; the largest of equal ones."""
    out = None
    for r in config.belongs_to:
        if r.references == table and table in stored:
            pk = config.tables[table].primary_key.column
            one = stored[table].select(F.col(f"`{r.resolve_by}`").cast("string").alias("key"), F.col(f"`{pk}`").alias("pk"))
            out = one if out is None else out.unionByName(one)
    return None if out is None else out.groupBy("key").agg(F.max("pk").alias("pk")).select("key", F.lit(-1).cast("long").alias("ord"), "pk")


def relate(records: DataFrame, config: Config, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The new rows of every target table. ``records``: valid ones, with _file_idx and _row_idx, each field a column.

    ``stored``: the tables' rows so far; keys are counted on from them.
    """
    from tabloom.plans.shared import written

    stored, names = stored or {}, {(f.db.table, f.db.column): f.name for f in config.fields}
    own = next((r for r in config.belongs_to if r.table == r.references), None)
    known = stored_keys(stored, config, own.references) if own else None
    ordered = written(insertion_order(records, config, known.select(F.col("key").alias("name")) if known is not None else None), "ordered")
    tables: dict[str, DataFrame] = {}

    def events(table: str, rows: DataFrame) -> DataFrame:
        """The rows that a foreign key to the table may find; values of all columns that are looked up share a space."""
        pk = config.tables[table].primary_key.column
        out = stored_keys(stored, config, table)
        for r in {x.resolve_by for x in config.belongs_to if x.references == table}:
            if (table, r) in names:
                one = rows.select(F.col(f"`{r}`").cast("string").alias("key"), F.col("ord").cast("long").alias("ord"), F.col(f"`{pk}`").alias("pk"))
                out = one if out is None else out.unionByName(one)
        return out if out is not None else rows.select(F.lit("").alias("key"), F.lit(0).cast("long").alias("ord"), F.col(f"`{pk}`").alias("pk")).limit(0)

    for table in table_order(config):
        pk, full = config.tables[table].primary_key, ordered
        links = [r for r in config.belongs_to if r.table == table]
        for r in [x for x in links if x.references != table]:
            found = as_of(_probes(full, r), events(r.references, tables[r.references]), strict=False)
            full = full.join(found.select("ord", F.col("pk").alias(r.fk_column)), "ord", "left")
        selves = [r for r in links if r.references == table]
        # Which row of the table itself is found doesn't depend on its key, which only comes with the numbering.
        named = own_rows(ordered, config, table)
        for r in selves:
            at = F.struct(F.col("ord").alias("at"), F.lit(None).cast(_plain(key_type(config, table))).alias("old"))
            mine = named.select(F.col(f"`{r.resolve_by}`").cast("string").alias("key"), "ord", at.alias("pk")) if (table, r.resolve_by) in names else None
            old = stored_keys(stored, config, table)
            if old is not None:
                old = old.select("key", "ord", F.struct(F.lit(None).cast("long").alias("at"), F.col("pk").cast(_plain(key_type(config, table))).alias("old")).alias("pk"))
            both = mine if old is None else old if mine is None else mine.unionByName(old)
            if both is None:
                full = full.withColumn(r.fk_column, F.lit(None).cast("struct<at: long, old: long>"))
                continue
            found = as_of(_probes(full, r), both, strict=True)
            full = full.join(found.select("ord", F.col("pk").alias(r.fk_column)), "ord", "left")
        rows = _keyed(own_rows(full, config, table, [r.fk_column for r in links]), pk, stored.get(table))
        rows = written(rows, f"rows-{table}")
        for r in selves:
            keys = rows.select(F.col("ord").alias("_at"), F.col(f"`{pk.column}`").alias("_pk"))
            joined = rows.join(keys, F.col(f"`{r.fk_column}`.at") == F.col("_at"), "left")
            rows = joined.withColumn(r.fk_column, F.coalesce("_pk", F.col(f"`{r.fk_column}`.old"))).drop("_at", "_pk")
        tables[table] = rows
    out = {t: rows.drop("ord") for t, rows in tables.items()}
    for j in config.junctions:
        a, b = (tables[t].select("ord", F.col(f"`{config.tables[t].primary_key.column}`").alias(j.columns[t])) for t in j.link)
        out[j.through] = a.join(b, "ord").drop("ord")
    return {name: _stored_types(df, m.schema) for name, m in models(config).items() for df in (out[name],)}


def _probes(rows: DataFrame, r: BelongsTo) -> DataFrame:
    return rows.select("ord", F.col(f"`{r.field}`").cast("string").alias("key"))


def _plain(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, T.VarcharType) else kind


def _keyed(rows: DataFrame, pk, stored: DataFrame | None) -> DataFrame:
    if pk.type == "uuid":
        return rows.withColumn(pk.column, F.uuid())
    top = (stored.agg(F.max(f"`{pk.column}`")).first()[0] if stored is not None else None) or 0
    return numbered(rows, ["ord"], pk.column, start=top + 1)


def _stored_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the table's order and types; dates become dates."""
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        plain = T.StringType() if isinstance(f.dataType, T.VarcharType) else f.dataType
        if isinstance(plain, (T.DateType, T.TimestampNTZType)) and isinstance(df.schema[f.name].dataType, T.StringType):
            c = c.try_cast("timestamp_ntz").cast(plain)
        out.append(c.cast(plain).alias(f.name))
    return df.select(*out)


def too_long(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns with values that don't fit their declared size; they are errors before anything is written."""
    limits = [(f.name, F.max(F.char_length(f"`{f.name}`")) > f.dataType.length) for f in schema if isinstance(f.dataType, T.VarcharType)]
    limits += [(f.name, F.max(F.abs(f"`{f.name}`")) >= 10 ** (f.dataType.precision - f.dataType.scale)) for f in schema if isinstance(f.dataType, T.DecimalType)]
    if not limits:
        return []
    row = df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(limits)]).first()
    return [n for i, (n, _) in enumerate(limits) if row[i]]


def insert_preview(records: DataFrame, config: Config, limit: int = 5) -> list[str]:
    """INSERT statements of the first records' values, as they would go in; keys and links aren't known yet."""
    out = []
    for row in records.orderBy("_file_idx", "_row_idx").limit(limit).collect():
        for table in table_order(config):
            some = [(f.db.column, row[f.name]) for f in config.columns_of(table) if row[f.name] is not None]
            if some:
                out.append(f"INSERT INTO {table} ({', '.join(c for c, _ in some)}) VALUES ({', '.join(repr(v) for _, v in some)})")
    return out
