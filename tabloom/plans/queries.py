"""A query for each operator, on tables that aren't spreadsheets: each first makes messy text of some columns, by an
expression that Spark and DuckDB read alike, and then applies the operator. ``oracle_sql`` has SQL with the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.config import Config, Field, Target, parse
from tabloom.errors import ExtractionError
from tabloom.functions.normalize import normalize, strip
from tabloom.operators.dedup import duplicates, existing_keys, mark_duplicates, unique
from tabloom.operators.extract import ColumnBackend, chunk_prompts, correction_prompt, extract, extraction_prompt, parse_records
from tabloom.operators.ordinals import chunk_ranges, chunks, numbered
from tabloom.operators.relate import hierarchy_order, insert_preview, relate
from tabloom.operators.validate import errors_by_field, invalid, valid, validate
from tabloom.plans.pipeline import Pipeline, Result

Query = Callable[[SparkSession, str], DataFrame]
TODAY = dt.date(2026, 1, 1)
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fld(name: str, kind: str, to: str = "t", column: str | None = None, **options) -> Field:
    return Field(name, kind, Target(to, column or name), **options)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def normalised(name: str, source: str, keys: list[str], text: str, f: Field, value_sql: str, bad_sql: str) -> None:
    """A query for a field type: keys, value, and whether there is an error. The SQL has the text as x."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).selectExpr(*keys, f"{text} as x").select(*keys, strip(F.col("x")).alias("x"))
        value, error = normalize(F.col("x"), f, today=TODAY, free_dates=False, stripped=True)
        return rows.select(*keys, value.alias("value"), error.isNotNull().alias("bad"))

    QUERIES[name] = run
    SQL[name] = f"with s as (select {', '.join(keys)}, {text} as x from {source}) select {', '.join(keys)}, case when {bad_sql} then null else {value_sql} end as value, {bad_sql} as bad from s"


S = "cast({} as varchar(50))".format
normalised("norm_string", "customer", ["c_custkey"], "case when c_custkey % 7 = 0 then '   ' when c_custkey % 5 = 0 then ' ab ' else concat('  ', c_name, '  ') end", fld("x", "string", min_length=3, max_length=40, required=True), "trim(x)", "(trim(x) = '' or length(trim(x)) < 3)")
normalised("norm_integer", "lineitem", ["l_orderkey", "l_linenumber"], f"case when l_orderkey % 11 = 0 then 'n/a' else concat(' ', {S('cast(l_quantity as bigint)')}, '.7') end", fld("x", "integer", min=5, max=45), "cast(trunc(cast(trim(x) as double)) as bigint)", "(x = 'n/a' or not (trunc(coalesce(try_cast(trim(x) as double), 0)) between 5 and 45))")
normalised("norm_number", "lineitem", ["l_orderkey", "l_linenumber"], f"case when l_orderkey % 13 = 0 then 'abc' when l_orderkey % 13 = 1 then '' else concat('1e', {S('l_linenumber')}) end", fld("x", "number", max=1_000_000), "try_cast(x as double)", "(x = 'abc' or coalesce(try_cast(nullif(x, '') as double), 0) > 1000000)")
_CENTS = "cast(round(abs(c_acctbal) * 100) as bigint)"
_WHOLE = f"cast(floor({_CENTS} / 100.0) as bigint)"
_MONEY = f"concat(case when c_acctbal < 0 then '(' else '' end, '$', case when {_WHOLE} >= 1000 then concat({S(f'cast(floor({_WHOLE} / 1000.0) as bigint)')}, ',', lpad({S(f'{_WHOLE} % 1000')}, 3, '0')) else {S(_WHOLE)} end, '.', lpad({S(f'{_CENTS} % 100')}, 2, '0'), case when c_acctbal < 0 then ')' else '' end)"
normalised("norm_currency", "customer", ["c_custkey"], f"case when c_custkey % 19 = 0 then '$' when c_custkey % 17 = 0 then 'free' else {_MONEY} end", fld("x", "currency"), "cast(case when x = '$' then null when x like '(%' then -1 else 1 end * try_cast(regexp_replace(x, '[$(),]', '', 'g') as decimal(26, 2)) as decimal(28, 2))", "(x = 'free')")
normalised("norm_phone", "customer", ["c_custkey"], f"case when c_custkey % 7 = 0 then '555-12' when c_custkey % 5 = 0 then concat('1.555.', lpad({S('c_custkey % 1000')}, 3, '0'), '.0000') else concat('(555) ', lpad({S('c_custkey % 1000')}, 3, '0'), '-', lpad({S('c_custkey')}, 4, '0')) end", fld("x", "phone"), "concat('(', substr(right(regexp_replace(x, '[^0-9]', '', 'g'), 10), 1, 3), ') ', substr(right(regexp_replace(x, '[^0-9]', '', 'g'), 10), 4, 3), '-', right(x, 4))", "(length(regexp_replace(x, '[^0-9]', '', 'g')) not in (10, 11) or (length(regexp_replace(x, '[^0-9]', '', 'g')) = 11 and substr(regexp_replace(x, '[^0-9]', '', 'g'), 1, 1) <> '1'))")
normalised("norm_url", "pages", ["page_id"], "case when page_id % 5 = 0 then 'http:// nowhere' when page_id % 3 = 0 then concat(' ', replace(url, 'http://', '')) else url end", fld("x", "url"), "case when contains(x, '://') then trim(x) else concat('http://', trim(x)) end", "(x like 'http:// %')")
normalised("norm_email", "supplier", ["s_suppkey"], f"case when s_suppkey % 9 = 0 then concat('user', {S('s_suppkey')}) else concat(' User.', {S('s_suppkey')}, '@Example.COM') end", fld("x", "email"), "lower(trim(x))", "(not contains(x, '@'))")
normalised("norm_date", "orders", ["o_orderkey"], f"case when o_orderkey % 17 = 0 then '13/13/2020' else concat({S('month(o_orderdate)')}, '/', {S('day(o_orderdate)')}, '/', {S('year(o_orderdate)')}) end", fld("x", "date"), "concat(split_part(x, '/', 3), '-', lpad(split_part(x, '/', 1), 2, '0'), '-', lpad(split_part(x, '/', 2), 2, '0'))", "(x = '13/13/2020')")
normalised("norm_datetime", "events", ["event_id"], f"concat({S('year(ts)')}, '-', lpad({S('month(ts)')}, 2, '0'), '-', lpad({S('day(ts)')}, 2, '0'), ' ', lpad({S('hour(ts)')}, 2, '0'), ':', lpad({S('minute(ts)')}, 2, '0'), ':', lpad({S('second(ts)')}, 2, '0'))", fld("x", "datetime", format="%d.%m.%Y %H:%M:%S"), "strftime(cast(x as timestamp), '%d.%m.%Y %H:%M:%S')", "(x is null)")
normalised("norm_enum", "customer", ["c_custkey"], "concat(' ', c_mktsegment)", fld("x", "enum", values=["building", "Machinery", "HOUSEHOLD"], case="lower"), "lower(trim(x))", "(lower(trim(x)) not in ('building', 'machinery', 'household'))")
normalised("norm_boolean", "labels", ["doc_id"], "case when doc_id % 3 = 0 then case when quality = 1 then 'Yes' else 'off' end when doc_id % 3 = 1 then case when quality = 1 then '1' else '0' end else 'maybe' end", fld("x", "boolean"), "(x in ('Yes', '1'))", "(x = 'maybe')")
normalised("norm_regex", "supplier", ["s_suppkey"], "case when s_suppkey % 4 = 0 then concat(s_name, 'x') else s_name end", fld("x", "regex", pattern=r"Supplier#\d{9}"), "x", r"(not regexp_full_match(x, 'Supplier#\d{9}'))")
normalised("norm_country", "nation", ["n_nationkey"], "case n_nationkey % 5 when 0 then 'us' when 1 then 'DE' when 2 then ' fr ' when 3 then 'XX' else 'usa' end", fld("x", "country"), "upper(trim(x))", "(trim(x) in ('XX', 'usa'))")
normalised("norm_subdivision", "customer", ["c_custkey"], "case c_custkey % 4 when 0 then 'ca' when 1 then ' NY' when 2 then 'ZZ' else 'on' end", fld("x", "subdivision", country_code="US"), "upper(trim(x))", "(trim(x) in ('ZZ', 'on'))")

# --- validation ---

_SHEET = {
    "name": "case when c_custkey % 11 = 0 then '' else concat(' ', c_name) end",
    "phone": "case when c_custkey % 7 = 0 then '12' else concat('555', lpad(cast(c_custkey as varchar(50)), 7, '0')) end",
    "segment": "c_mktsegment",
    "nation": "case when c_custkey % 13 = 0 then 'x1' else cast(c_nationkey as varchar(50)) end",
}
_FIELDS = [fld("name", "string", required=True), fld("phone", "phone"), fld("segment", "enum", values=["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE"]), fld("nation", "integer", max=20)]
_SHEET_SQL = f"s as (select c_custkey, {', '.join(f'{v} as {k}' for k, v in _SHEET.items())} from customer)"
_BAD = {"name": "(name = '')", "phone": "(phone = '12')", "segment": "(segment = 'HOUSEHOLD')", "nation": "(nation = 'x1' or coalesce(try_cast(nation as bigint), 0) > 20)"}
_ANY = " or ".join(_BAD.values())
_TYPED = "trim(name) as name, concat('(', substr(phone, 1, 3), ') ', substr(phone, 4, 3), '-', substr(phone, 7, 4)) as phone, upper(segment) as segment, cast(nation as bigint) as nation"


def customer_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", *[f"{v} as {k}" for k, v in _SHEET.items()])


@query("validate_valid", f"with {_SHEET_SQL} select c_custkey, {_TYPED} from s where not ({_ANY})")
def _(spark, d):
    return valid(validate(customer_sheet(spark, d), _FIELDS, keep=("c_custkey",), today=TODAY))


@query("validate_invalid", f"with {_SHEET_SQL} select c_custkey, name, phone, segment, nation, {' + '.join(f'cast({b} as bigint)' for b in _BAD.values())} as n_errors from s where {_ANY}")
def _(spark, d):
    bad = invalid(validate(customer_sheet(spark, d), _FIELDS, keep=("c_custkey",), today=TODAY), ("c_custkey",))
    return bad.select("c_custkey", *[F.col("_record")[k].alias(k) for k in _SHEET], F.size("_errors").cast("long").alias("n_errors"))


@query("validate_errors", f"with {_SHEET_SQL} " + " union all ".join(f"select '{k}' as field, count(*) as n_errors from s where {b}" for k, b in _BAD.items()))
def _(spark, d):
    return errors_by_field(validate(customer_sheet(spark, d), _FIELDS, keep=("c_custkey",), today=TODAY))


# --- deduplication ---

_EVENTS = "select event_id, user_id, case when event_id % 2 = 0 then upper(event_type) else event_type end as kind, case when user_id % 5 = 0 then null when user_id % 5 = 1 then '' else event_type end as maybe from events"
_FIRST = "select event_id, user_id, kind from (select *, row_number() over (partition by {} order by event_id) as n from ({})) where n {}"


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", "user_id", "case when event_id % 2 = 0 then upper(event_type) else event_type end as kind", "case when user_id % 5 = 0 then null when user_id % 5 = 1 then '' else event_type end as maybe")


def _marked(spark, d, keys, match="exact", existing=None):
    return mark_duplicates(event_rows(spark, d), keys, match=match, ordinal=("event_id",), existing=existing)


_OUT = ("event_id", "user_id", "kind")


@query("dedup_exact", _FIRST.format("kind", _EVENTS, "= 1"))
def _(spark, d):
    return unique(_marked(spark, d, ["kind"])).select(*_OUT)


@query("dedup_ci", _FIRST.format("lower(kind), user_id", _EVENTS, "= 1"))
def _(spark, d):
    return unique(_marked(spark, d, ["kind", "user_id"], "case_insensitive")).select(*_OUT)


@query("dedup_composite", _FIRST.format("user_id, kind", _EVENTS, "= 1"))
def _(spark, d):
    return unique(_marked(spark, d, ["user_id", "kind"])).select(*_OUT)


@query("dedup_nulls", _FIRST.format("coalesce(maybe, '')", _EVENTS, "= 1"))
def _(spark, d):
    return unique(_marked(spark, d, ["maybe"])).select(*_OUT)


@query("dedup_duplicates", _FIRST.format("user_id, lower(kind)", _EVENTS, "> 1"))
def _(spark, d):
    return duplicates(_marked(spark, d, ["user_id", "kind"], "case_insensitive")).select(*_OUT)


@query("dedup_existing", f"with e as ({_EVENTS}) select event_id, user_id, kind from (select *, row_number() over (partition by user_id, lower(kind) order by event_id) as n from e) x where n = 1 and not exists (select 1 from events k where k.event_id % 10 = 3 and k.user_id = x.user_id and lower(k.event_type) = lower(x.kind))")
def _(spark, d):
    stored = table(spark, d, "events").where("event_id % 10 = 3").select("user_id", F.col("event_type").alias("kind"))
    return unique(_marked(spark, d, ["user_id", "kind"], "case_insensitive", existing_keys(stored, ["user_id", "kind"], "case_insensitive"))).select(*_OUT)


# --- chunks and extraction ---

_ORDINAL = "select o_orderkey, row_number() over (order by o_orderkey) - 1 as r from orders"


def order_sheet(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.lit(0).alias("_file_idx"))
    return numbered(rows, ["_file_idx", "o_orderkey"], "_row_idx", start=0)


@query("chunk_ranges", f"select cast(0 as integer) as _file_idx, cast(floor(r / 25) as bigint) as chunk, concat('rows ', min(r) + 1, '-', max(r) + 1) as row_range, count(*) as rows from ({_ORDINAL}) group by floor(r / 25)")
def _(spark, d):
    return chunk_ranges(chunks(order_sheet(spark, d), 25), 25)


class _Flaky:
    """Fails on chunks whose first key is divisible by 7, and leaves a record out where it is divisible by 5."""

    def __init__(self) -> None:
        self.inner = ColumnBackend(["order", "priority"], {"order": "o_orderkey", "priority": "o_orderpriority"})

    def __call__(self, prompt: str) -> str:
        import json

        found = json.loads(self.inner(prompt))
        first = int(found[0]["order"])
        if first % 7 == 0:
            raise ExtractionError("out of order")
        return json.dumps(found[1:] if first % 5 == 0 else found)


def _extracted(spark, d):
    sheet = order_sheet(spark, d).select("_file_idx", "_row_idx", F.lit("orders").alias("_file"), F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority")
    return extract(sheet, [fld("order", "integer"), fld("priority", "string")], _Flaky(), chunk_size=37)


_CHUNKS = f"c as (select floor(r / 37) as chunk, min(r) as a, max(r) as b, min(o_orderkey) as k from ({_ORDINAL}) group by 1)"


@query("skip_report", f"with {_CHUNKS} select 'orders' as file, cast(chunk as bigint) as chunk, concat('rows ', a + 1, '-', b + 1) as row_range, b - a + 1 as rows_affected, case when k % 7 = 0 then 'LLM error: out of order' else concat('Row count mismatch: expected ', b - a + 1, ', got ', b - a) end as reason from c where k % 7 = 0 or k % 5 = 0")
def _(spark, d):
    return _extracted(spark, d)[1]


@query("extract_records", f"with {_CHUNKS} select cast(o.o_orderkey as varchar) as \"order\", o.o_orderpriority as priority from ({_ORDINAL}) r join orders o on o.o_orderkey = r.o_orderkey join c on c.chunk = floor(r.r / 37) where k % 7 <> 0 and k % 5 <> 0")
def _(spark, d):
    return _extracted(spark, d)[0].select("order", "priority")


@query("json_unwrap", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(spark, d):
    fence = "concat(chr(96), chr(96), chr(96))"
    text = f"case event_id % 4 when 0 then concat('[', props, ']') when 1 then concat({fence}, 'json', chr(10), '[', props, ']', chr(10), {fence}) when 2 then concat('{{\"n\": 1, \"data\": [', props, ']}}') else concat('Here: [', props, '] Done.') end"

    @F.pandas_udf("long")
    def first(texts):
        return texts.map(lambda t: parse_records(t)[0]["k"])

    return table(spark, d, "events").selectExpr("event_id", f"{text} as t").select("event_id", first("t").alias("k"))


_PROMPT = [fld("key", "integer", required=True), fld("name", "string")]
_quoted = lambda s: "'" + s.replace("'", "''") + "'"


@query("prompts", f"with s as (select c_custkey, c_name, row_number() over (order by c_custkey) - 1 as r from customer), c as (select cast(floor(r / 50) as bigint) as _chunk_id, count(*) as n, string_agg(concat(c_custkey, ',', c_name), chr(10) order by r) as body from s group by 1) select _chunk_id, md5(replace(replace({_quoted(extraction_prompt(_PROMPT, '<csv>', '<n>', 'Keys are numbers.'))}, '<n>', cast(n as varchar)), '<csv>', concat('c_custkey,c_name', chr(10), body, chr(10)))) as prompt, md5(concat({_quoted(correction_prompt(0, 0).split('0')[0])}, n - 1, {_quoted(correction_prompt(0, 0).split('0')[1])}, n, {_quoted(correction_prompt(0, 0).split('0')[2])}, n, {_quoted(correction_prompt(0, 0).split('0')[3])})) as correction from c")
def _(spark, d):
    sheet = numbered(table(spark, d, "customer").select("c_custkey", "c_name", F.lit(0).alias("_file_idx")), ["_file_idx", "c_custkey"], "_row_idx", start=0)
    made = chunk_prompts(sheet, _PROMPT, chunk_size=50, hints="Keys are numbers.")
    parts, n = correction_prompt(0, 0).split("0"), F.col("rows")
    fixed = F.concat(F.lit(parts[0]), (n - 1).cast("string"), F.lit(parts[1]), n.cast("string"), F.lit(parts[2]), n.cast("string"), F.lit(parts[3]))
    return made.select("_chunk_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.md5(fixed.cast("binary")).alias("correction"))


# --- relations ---


def _config(fields: list[dict], tables: dict[str, str], relationships: list[dict] = (), dedup: dict | None = None) -> Config:
    raw = {"name": "q", "llm": {"base_url": "-", "model": "-"}, "database": {"url": "parquet:/none"}, "relationships": list(relationships)}
    schema = {"fields": fields, "tables": {t: {"primary_key": {"column": "id", "type": k}} for t, k in tables.items()}}
    return parse(raw | {"schema": schema | ({"deduplication": dedup} if dedup else {})})


def _field(name: str, to: str, column: str, kind: str = "string", **options) -> dict:
    return {"name": name, "type": kind, "db": {"table": to, "column": column}} | options


_FLAT = _config(
    [_field("seller", "customers", "name"), _field("segment", "customers", "segment"), _field("ref", "purchases", "ref"), _field("buyer", "purchases", "buyer")],
    {"customers": "auto_increment", "purchases": "auto_increment"},
    [
        {"type": "belongs_to", "field": "buyer", "table": "purchases", "references": "customers", "fk_column": "customer_id", "resolve_by": "name"},
        {"type": "junction", "link": ["customers", "purchases"], "through": "links", "columns": {"customers": "customer_id", "purchases": "purchase_id"}},
    ],
)
#: A record has no purchase where ref and buyer are blank.
_FLAT_SQL = "s as (select row_number() over (order by o_orderkey) - 1 as ord, c_name as seller, c_mktsegment as segment, case when o_orderkey % 6 = 0 then null else concat('R', o_orderkey) end as ref, case when o_orderkey % 6 = 0 then null else concat('Customer#', lpad(cast((o_custkey * 7) % 2000 as varchar(50)), 9, '0')) end as buyer from orders join customer on o_custkey = c_custkey)"


def flat_records(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "0 as _file_idx", "o_orderkey as _row_idx", "c_name as seller", "c_mktsegment as segment", "case when o_orderkey % 6 = 0 then null else concat('R', o_orderkey) end as ref",
        "case when o_orderkey % 6 = 0 then null else concat('Customer#', lpad(cast((o_custkey * 7) % 2000 as varchar(50)), 9, '0')) end as buyer",
    )


_PURCHASES = f"{_FLAT_SQL}, p as (select *, row_number() over (order by ord) as id from s where ref is not null or buyer is not null)"
_ASOF = f"{_PURCHASES} select p.id, p.ref, p.buyer, e.ord + 1 as customer_id from p asof left join s e on p.buyer = e.seller and p.ord >= e.ord"


@query("split_tables", f"with {_FLAT_SQL} select ord + 1 as id, seller as name, segment from s")
def _(spark, d):
    return relate(flat_records(spark, d), _FLAT)["customers"]


@query("surrogate_keys", f"with {_PURCHASES} select id, ref from p")
def _(spark, d):
    return relate(flat_records(spark, d), _FLAT)["purchases"].select("id", "ref")


@query("fk_asof", f"with {_ASOF}")
def _(spark, d):
    return relate(flat_records(spark, d), _FLAT)["purchases"]


@query("fk_unresolved", f"with {_FLAT_SQL.rstrip(')')}), u as (select min(ord) as ord, seller from s group by seller) select s.ref, s.buyer from s left join u on u.seller = s.buyer and u.ord <= s.ord where u.seller is null and s.buyer is not null")
def _(spark, d):
    return relate(flat_records(spark, d), _FLAT)["purchases"].where("customer_id is null").select("ref", "buyer")


@query("junction", f"with {_PURCHASES} select ord + 1 as customer_id, id as purchase_id from p")
def _(spark, d):
    return relate(flat_records(spark, d), _FLAT)["links"]


@query("fk_existing", f"with {_PURCHASES}, t as (select max(c_custkey) as top from customer where c_custkey % 3 = 0) select p.id, p.ref, coalesce(e.ord + 1 + t.top, k.c_custkey) as customer_id from t, p asof left join s e on p.buyer = e.seller and p.ord >= e.ord left join customer k on k.c_name = p.buyer and k.c_custkey % 3 = 0")
def _(spark, d):
    stored = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return relate(flat_records(spark, d), _FLAT, {"customers": stored})["purchases"].select("id", "ref", "customer_id")


_UNIQUE = _config([_field("company", "companies", "name"), _field("contact", "contacts", "name")], {"companies": "auto_increment", "contacts": "auto_increment"}, [{"type": "belongs_to", "field": "company", "table": "contacts", "references": "companies", "fk_column": "company_id", "resolve_by": "name"}])


@query("fk_equi", "select row_number() over (order by c_custkey) as id, concat('C', c_custkey) as name, row_number() over (order by c_custkey) as company_id from customer")
def _(spark, d):
    rows = table(spark, d, "customer").selectExpr("0 as _file_idx", "c_custkey as _row_idx", "c_name as company", "concat('C', c_custkey) as contact")
    return relate(rows, _UNIQUE)["contacts"]


_TREE = "with recursive s as (select 100000 - p_partkey as ord, concat('P', p_partkey) as name, case when p_partkey % 4 = 0 then null when p_partkey % 97 = 0 then 'nobody' else concat('P', cast(floor(p_partkey / 3) as bigint)) end as parent from part), h as (select ord, name, 1 as pass from s where parent is null union all select s.ord, s.name, h.pass + case when h.ord > s.ord then 1 else 0 end from h join s on s.parent = h.name) select s.ord, cast(coalesce(h.pass, 2147483647) as integer) as pass from s left join h on h.ord = s.ord"


def tree_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("100000 - p_partkey as ord", "concat('P', p_partkey) as name", "case when p_partkey % 4 = 0 then null when p_partkey % 97 = 0 then 'nobody' else concat('P', cast(floor(p_partkey / 3) as bigint)) end as parent")


@query("hierarchy_order", _TREE)
def _(spark, d):
    return hierarchy_order(tree_rows(spark, d))


_SELF = _config([_field("name", "parts", "name"), _field("parent", "parts", "parent_name")], {"parts": "auto_increment"}, [{"type": "belongs_to", "field": "parent", "table": "parts", "references": "parts", "fk_column": "parent_id", "resolve_by": "name"}])


@query("self_reference", _TREE.replace("select s.ord, cast(coalesce(h.pass, 2147483647) as integer) as pass from", "select row_number() over (order by coalesce(h.pass, 2147483647), s.ord) as id, s.name, s.parent from").replace("with recursive", "with t as (with recursive", 1) + ") select t.id, t.name, t.parent as parent_name, p.id as parent_id from t left join t p on p.name = t.parent and p.id < t.id")
def _(spark, d):
    rows = tree_rows(spark, d).select(F.lit(0).alias("_file_idx"), F.col("ord").alias("_row_idx"), "name", "parent")
    return relate(rows, _SELF)["parts"]


@query("insert_preview", "select concat('INSERT INTO t (c_custkey, c_name) VALUES (', c_custkey, ', ''', c_name, ''')') as statement from customer order by c_custkey limit 5")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(0).alias("_file_idx"), F.col("c_custkey").alias("_row_idx"))
    return spark.createDataFrame([(s,) for s in insert_preview(rows, _config([_field("c_custkey", "t", "c_custkey", "integer"), _field("c_name", "t", "c_name")], {"t": "auto_increment"}))], "statement string")


_SUMMARY = _config([_field("name", "t", "name", required=True), _field("phone", "t", "phone", "phone"), _field("segment", "t", "segment", "enum", values=["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE"]), _field("nation", "t", "nation", "integer", max=20)], {"t": "auto_increment"}, dedup={"key": ["segment", "nation"], "match": "case_insensitive"})


@query("summary_counts", f"with {_SHEET_SQL}, v as (select * from s where not ({_ANY})) select (select count(*) from s) as extracted, (select count(*) from v) as valid, (select count(*) from s) - (select count(*) from v) as invalid, (select count(*) from v) - (select count(*) from (select distinct segment, nation from v)) as duplicates")
def _(spark, d):
    rows = customer_sheet(spark, d).withColumn("_file_idx", F.lit(0)).withColumnRenamed("c_custkey", "_row_idx")
    r = Pipeline(spark, _SUMMARY, backend=str, today=TODAY).load(rows, _SUMMARY, Result(dry_run=True))
    return spark.createDataFrame([(r.total_extracted, r.total_valid, r.total_invalid, r.total_duplicates)], "extracted long, valid long, invalid long, duplicates long")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
