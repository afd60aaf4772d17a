import random

import pytest
from pyspark.sql import functions as F

from tabloom.config import parse
from tabloom.errors import DatabaseError
from tabloom.operators.dedup import duplicates, existing_keys, mark_duplicates, unique
from tabloom.operators.ordinals import numbered
from tabloom.operators.relate import as_of, hierarchy_order, insert_preview, models, relate, table_order, too_long


def config(fields, tables, relationships=()):
    return parse({
        "name": "t", "llm": {"base_url": "-", "model": "-"}, "database": {"url": "sqlite://"}, "relationships": list(relationships),
        "schema": {"fields": [{"name": n, "type": "string", "db": {"table": t, "column": c}} for n, t, c in fields], "tables": {t: {"primary_key": {"column": "id", "type": k}} for t, k in tables.items()}},
    })


SELF = config([("name", "c", "name"), ("parent", "c", "parent")], {"c": "auto_increment"}, [{"type": "belongs_to", "field": "parent", "table": "c", "references": "c", "fk_column": "parent_id", "resolve_by": "name"}])


def simulate_order(rows, existing=()):
    """One record after the other: repeated passes, each taking what it can."""
    seen, rest, out = set(existing), list(rows), []
    while rest:
        left = []
        for r in rest:
            if not r[2] or r[2] in seen:
                out.append(r)
                if r[1]:
                    seen.add(r[1])
            else:
                left.append(r)
        if len(left) == len(rest):
            return out + left
        rest = left
    return out


def simulate_load(rows, existing):
    cache, out = dict(existing), []
    for k, (_, name, parent) in enumerate(simulate_order(rows, existing)):
        pk = max(existing.values(), default=0) + k + 1
        out.append((pk, name, parent, cache.get(parent) if parent else None))
        if name:
            cache[name] = pk
    return out


@pytest.mark.parametrize("seed", range(8))
def test_self_reference_like_one_by_one(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(r.choice([3, 8]))]
    rows = [(i, r.choice([*names, f"u{i}", "" if seed % 2 else None]) or None, r.choice([*names, None, "absent"])) for i in range(r.choice([6, 25]))]
    existing = {"n0": 7, "n2": 9} if seed % 3 == 0 else {}
    df = spark.createDataFrame([(0, i, n, p) for i, n, p in rows], "_file_idx int, _row_idx long, name string, parent string")
    stored = {"c": spark.createDataFrame([(v, k) for k, v in existing.items()], "id long, name string")} if existing else None
    got = sorted(tuple(x) for x in relate(df, SELF, stored)["c"].select("id", "name", "parent", "parent_id").collect())
    wanted = simulate_load([(i, n, p) for i, n, p in rows if n or p], existing)
    assert got == wanted


def test_order_of_late_namesakes(spark):
    """A parent reached by more links but in an earlier pass counts."""
    rows = [(0, "r", None), (5, "x", "late"), (6, "late", "r"), (1, "a", "r"), (2, "b", "a"), (3, "x", "b"), (4, "child", "x")]
    df = spark.createDataFrame(rows, "ord long, name string, parent string")
    got = [o for _, o in sorted((r["pass"], r["ord"]) for r in hierarchy_order(df).collect())]
    assert got == [x[0] for x in simulate_order(sorted(rows))]


def test_order_with_negative_ordinals(spark):
    """Ordinals below zero, -1 too, are rows like others: children of such parents, absent parents, circles."""
    rows = [(-9, "leaf", "mid"), (-5, "lost", "absent"), (-4, "mid", "top"), (-3, "under", "lost"), (-2, "x", "y"), (-1, "top", None), (0, "y", "x"), (1, "late", "leaf"), (2, "next", "top")]
    got = {r["ord"]: r["pass"] for r in hierarchy_order(spark.createDataFrame(rows, "ord long, name string, parent string")).collect()}
    never = 2**31 - 1
    assert got == {-1: 1, 2: 1, -4: 2, -9: 3, 1: 3, -5: never, -3: never, -2: never, 0: never}
    assert [o for o, _ in sorted(got.items(), key=lambda x: (x[1], x[0]))] == [x[0] for x in simulate_order(rows)]


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_in_small_blocks(spark, strict):
    r = random.Random(strict)
    events = [(r.choice("ab"), i, i * 10) for i in range(60) if r.random() < 0.4]
    probes = [(r.choice(["a", "b", "z", "", None]), i) for i in range(60)]
    got = {(x["key"], x["ord"]): x["pk"] for x in as_of(spark.createDataFrame(probes, "key string, ord long"), spark.createDataFrame(events, "key string, ord long, pk long"), strict=strict, block=7).collect()}
    for key, at in probes:
        if key:
            before = [pk for k, o, pk in events if k == key and (o < at if strict else o <= at)]
            assert got[key, at] == (before[-1] if before else None)


def test_junctions_empty_rows_and_uuid(spark):
    c = config([("a", "ta", "a"), ("b", "tb", "b")], {"ta": "auto_increment", "tb": "uuid"}, [{"type": "junction", "link": ["ta", "tb"], "through": "l", "columns": {"ta": "a_id", "tb": "b_id"}}])
    df = spark.createDataFrame([(0, 0, "x", "y"), (0, 1, None, "z"), (0, 2, "w", None)], "_file_idx int, _row_idx long, a string, b string")
    out = relate(df, c)
    assert [x["a"] for x in out["ta"].orderBy("id").collect()] == ["x", "w"]
    assert out["tb"].count() == 3 and len({x["id"] for x in out["tb"].collect()}) == 3
    assert out["l"].join(out["tb"], F.col("b_id") == F.col("id")).count() == 2


def test_table_order():
    r = lambda a, b: {"type": "belongs_to", "field": "f", "table": a, "references": b, "fk_column": f"{b}_id", "resolve_by": "n"}
    tables = {"teams": "auto_increment", "departments": "uuid", "orgs": "auto_increment"}
    c = config([("f", "orgs", "n")], tables, [r("teams", "departments"), r("departments", "orgs"), r("orgs", "orgs")])
    assert table_order(c) == ["orgs", "departments", "teams"]
    assert [f.dataType.simpleString() for f in models(c)["teams"].schema] == ["bigint", "varchar(36)"]
    with pytest.raises(DatabaseError):
        table_order(config([("f", "orgs", "n")], tables, [r("teams", "orgs"), r("orgs", "teams")]))


def test_dedup(spark):
    rows = spark.createDataFrame([(0, 0, "A", "x"), (0, 1, "a", "x"), (0, 2, None, "x"), (0, 3, "", "y"), (1, 0, "A", "x"), (1, 1, "b", None)], "_file_idx int, _row_idx long, k string, v string")
    at = lambda df: sorted((r["_file_idx"], r["_row_idx"]) for r in df.collect())
    assert at(unique(mark_duplicates(rows, ["k"]))) == [(0, 0), (0, 1), (0, 2), (1, 1)]
    ci = mark_duplicates(rows, ["k", "v"], match="case_insensitive")
    assert at(unique(ci)) == [(0, 0), (0, 2), (0, 3), (1, 1)] and at(duplicates(ci)) == [(0, 1), (1, 0)]
    stored = spark.createDataFrame([("B", None)], "k string, v string")
    e = existing_keys(stored, ["k", "v"], "case_insensitive")
    assert at(duplicates(mark_duplicates(rows, ["k", "v"], match="case_insensitive", existing=e))) == [(0, 1), (1, 0), (1, 1)]
    assert at(unique(mark_duplicates(rows.limit(0), ["k"]))) == []


def test_numbering_in_small_blocks(spark):
    rows = spark.createDataFrame([(f, i * 3) for f in range(3) for i in range(20)], "f int, r long").repartition(5)
    got = [r["n"] for r in numbered(rows, ["f", "r"], "n", start=5, block=8).orderBy("f", "r").collect()]
    assert got == list(range(5, 65))


def test_too_long_and_preview(spark):
    df = spark.createDataFrame([("x" * 300,)], "name string")
    assert too_long(df, models(SELF)["c"].schema.__class__([f for f in models(SELF)["c"].schema if f.name == "name"])) == ["name"]
    rows = spark.createDataFrame([(0, 0, "A'b", None)], "_file_idx int, _row_idx long, name string, parent string")
    assert insert_preview(rows, SELF) == ['INSERT INTO c (name) VALUES ("A\'b")']
