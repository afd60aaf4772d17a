import json
import sqlite3
import zipfile

import pytest
import yaml
from pyspark.sql import types as T

from tabloom.cli import main
from tabloom.config import TEMPLATE, parse, substitute
from tabloom.errors import DatabaseError, ExtractionError, ReviewError
from tabloom.operators.extract import ColumnBackend, ask, describe, enum_values, extraction_prompt, parse_records
from tabloom.operators.relate import TableModel
from tabloom.plans.pipeline import Pipeline
from tabloom.plans.review import ReviewStatus, run_review
from tabloom.sources.sheets import list_files, read_sheet
from tabloom.sources.sinks import open_sink

HEAD = ["Company Name", "Parent Entity", "State"]
ROWS = [
    ("Acme Corp", "", "CA"), ("Acme West", "Acme Corp", "CA"), ("Acme East", "Acme Corp", "NY"), ("Beta Inc", "", "TX"), ("Beta South", "Beta Inc", "FL"),
    ("Gamma LLC", "", "WA"), ("Delta Corp", "", "OR"), ("ACME corp", "", "CA"), ("Epsilon", "", "IL"), ("Acme Central", "Acme Corp", "OH"),
]


def config(url="sqlite://", **pipeline):
    raw = substitute(yaml.safe_load(TEMPLATE), {"LLM_API_KEY": ""})
    raw["database"]["url"] = url
    raw["pipeline"].update(pipeline)
    return parse(raw)


BACKEND = ColumnBackend(["company_name", "parent_entity", "state"])


def csv_file(path, rows=ROWS, head=HEAD):
    path.write_text("\n".join(",".join(f'"{x}"' for x in r) for r in [head, *rows]) + "\n")
    return str(path)


def test_golden(spark, tmp_path):
    db = tmp_path / "out.db"
    r = Pipeline(spark, config(f"sqlite+aiosqlite:///{db}"), backend=BACKEND).run(csv_file(tmp_path / "a.csv"), create_tables=True)
    assert (r.total_extracted, r.total_valid, r.total_invalid, r.total_duplicates, r.total_inserted, r.total_skipped_chunks) == (10, 10, 0, 1, 9, 0)
    con = sqlite3.connect(db)
    assert [con.execute(f"select count(*) from {t}").fetchone()[0] for t in ("companies", "addresses", "company_addresses")] == [9, 9, 9]
    children = con.execute("select c.name, p.name from companies c join companies p on p.id = c.parent_id order by 1").fetchall()
    assert children == [("Acme Central", "Acme Corp"), ("Acme East", "Acme Corp"), ("Acme West", "Acme Corp"), ("Beta South", "Beta Inc")]
    # A second run finds the stored parents, and adds its rows behind.
    r = Pipeline(spark, config(f"sqlite:///{db}"), backend=BACKEND).run(csv_file(tmp_path / "b.csv", [("New", "Gamma LLC", "CA")]))
    assert con.execute("select c.id, p.name from companies c join companies p on p.id = c.parent_id where c.name = 'New'").fetchone() == (10, "Gamma LLC")


def test_stored_keys_are_duplicates(spark, tmp_path):
    raw = substitute(yaml.safe_load(TEMPLATE), {"LLM_API_KEY": ""})
    raw["database"]["url"], raw["schema"]["deduplication"]["check_db"] = f"sqlite:///{tmp_path / 'o.db'}", True
    c = parse(raw)
    with pytest.raises(DatabaseError, match="Missing tables"):
        Pipeline(spark, c, backend=BACKEND).run(csv_file(tmp_path / "a.csv"))
    assert Pipeline(spark, c, backend=BACKEND).run(csv_file(tmp_path / "a.csv"), create_tables=True).total_inserted == 9
    again = Pipeline(spark, c, backend=BACKEND).run(csv_file(tmp_path / "b.csv", [("acme WEST", "", "CA"), ("Zeta", "", "CA")]))
    assert (again.total_duplicates, again.total_inserted) == (1, 1)


def test_dry_run_folder_and_errors(spark, tmp_path):
    csv_file(tmp_path / "b.csv", [("X", "", "CA"), ("Yy", "", "Mars")])
    csv_file(tmp_path / "a.CSV")
    (tmp_path / "notes.txt").write_text("no")
    assert [f.rsplit("/", 1)[1] for f in list_files(spark, str(tmp_path))] == ["a.CSV", "b.csv"]
    r = Pipeline(spark, config("nothing:there"), backend=BACKEND).run(str(tmp_path), dry_run=True, chunk_size=3)
    assert (r.total_extracted, r.total_invalid, r.total_duplicates, r.total_inserted) == (12, 2, 1, 0)
    bad = {x["_record"]["company_name"]: [e["field"] for e in x["_errors"]] for x in r.invalid_records.collect()}
    assert bad == {"X": ["company_name"], "Yy": ["state"]}
    empty = tmp_path / "none"
    empty.mkdir()
    assert Pipeline(spark, config(), backend=BACKEND).run(str(empty)).total_extracted == 0


def test_missing_tables_and_bad_urls(spark, tmp_path):
    with pytest.raises(DatabaseError, match="Missing tables"):
        Pipeline(spark, config(), backend=BACKEND).run(csv_file(tmp_path / "a.csv"))
    with pytest.raises(DatabaseError):
        open_sink(spark, "oracle-of-delphi")


def test_jdbc(spark, tmp_path):
    """In Derby, to which Spark can't write a null text: so all have a value."""
    c = config("jdbc:derby:memory:t1;create=true")
    r = Pipeline(spark, c, backend=BACKEND).run(csv_file(tmp_path / "a.csv", [("West", "Acme", "CA"), ("Acme", "Nobody", "NY")]), create_tables=True)
    Pipeline(spark, c, backend=BACKEND).run(csv_file(tmp_path / "b.csv", [("New", "West", "CA")]))
    from tabloom.operators.relate import models

    rows = open_sink(spark, c.database.url).read(models(c)["companies"], ["id", "name", "parent_id"]).collect()
    assert r.total_inserted == 2 and sorted((x["id"], x["name"], x["parent_id"]) for x in rows) == [(1, "West", None), (2, "Acme", None), (3, "New", 1)]


@pytest.mark.parametrize("url", ["parquet:{}/p", "catalog:loaded"])
def test_other_sinks(spark, tmp_path, url):
    c = config(url.format(tmp_path))
    assert Pipeline(spark, c, backend=BACKEND).run(csv_file(tmp_path / "a.csv"), create_tables=True).total_inserted == 9
    Pipeline(spark, c, backend=BACKEND).run(csv_file(tmp_path / "b.csv", [("New", "Gamma LLC", "CA")]))
    from tabloom.operators.relate import models

    rows = open_sink(spark, c.database.url).read(models(c)["companies"], ["id", "name", "parent_id"]).collect()
    ids = {r["name"]: r["id"] for r in rows}
    assert len(rows) == 10 and next(r["parent_id"] for r in rows if r["name"] == "New") == ids["Gamma LLC"]


def test_review(spark, tmp_path):
    answers = iter(["drop the second", "nonsense", "A"])

    def backend(prompt):
        if "CSV data:" in prompt:
            return BACKEND(prompt)
        if "nonsense" in prompt:
            return "no idea"
        rows = json.loads(prompt.split("\n")[1])
        return json.dumps([rows[0], {**rows[2], "company_name": "Renamed"}, {"company_name": ""}])

    said = []
    c = config(f"sqlite:///{tmp_path / 'r.db'}", review=True)
    r = Pipeline(spark, c, backend=backend, ask=lambda _: next(answers), say=said.append).run(csv_file(tmp_path / "a.csv"), create_tables=True)
    assert (r.total_valid, r.total_reviewed, r.total_inserted) == (10, 2, 2)
    assert any("left out" in s for s in said) and any("revision failed" in s for s in said)
    r = Pipeline(spark, c, backend=backend, ask=lambda _: "r", say=said.append).run(csv_file(tmp_path / "a.csv"))
    assert r.total_inserted == 0


def test_skip_report(spark, tmp_path):
    calls = []

    def backend(prompt):
        if "Co3" in prompt:
            raise ExtractionError("LLM call failed: down")
        return "[]" if "Co6" in prompt else BACKEND(prompt)

    rows = [(f"Co{i} name", "", "CA") for i in range(10)]
    r = Pipeline(spark, config(), backend=backend).run(csv_file(tmp_path / "a.csv", rows), dry_run=True, chunk_size=3)
    report = [tuple(x) for x in r.skipped_chunks.collect()]
    assert [x[:4] for x in report] == [("a.csv", 1, "rows 4-6", 3), ("a.csv", 2, "rows 7-9", 3)] and not calls
    assert report[0][4].startswith("LLM error:") and report[1][4] == "Row count mismatch: expected 3, got 0"
    assert r.total_extracted == 4


def test_ask_again():
    f = config().fields
    seen = []

    def short_once(prompt):
        seen.append(prompt)
        return "[{}]" if len(seen) == 1 else "[{}, {}]"

    assert ask(short_once, f, ["a"], [["1"], ["2"]], None) == ([{}, {}], None) and "You returned 1" in seen[1]
    assert ask(lambda p: "[{}]" if "You returned" not in p else "broken", f, ["a"], [["1"], ["2"]], None)[1].startswith("Retry failed")


@pytest.mark.parametrize("text,wanted", [
    ('[{"a": 1}]', [{"a": 1}]), ('```json\n[{"a": 1}]\n```', [{"a": 1}]), ("```\n[1]\n```", [1]), ('{"data": [1]}', [1]), ('{"n": 2, "results": [3]}', [3]), ("Sure: [1, 2] done.", [1, 2]),
])
def test_parse_records(text, wanted):
    assert parse_records(text) == wanted


@pytest.mark.parametrize("text,why", [("nothing", "No JSON"), ("[1, ", "Failed to parse"), ('{"a": 1}', "no array"), ('"x"', "No JSON")])
def test_parse_failures(text, why):
    with pytest.raises(ExtractionError, match=why):
        parse_records(text)


def test_prompts():
    fields = config().fields
    text = extraction_prompt(fields, "a,b\n", 7, "Be exact.")
    assert "exactly 7 objects" in text and text.endswith("CSV data:\na,b\n") and "Be exact." in text and "company_name (string, required)" in text
    assert enum_values([str(i) for i in range(11)]) == "0, 1, 2, 3, 4, ..., 9, 10" and enum_values(["x"]) == "x"
    assert "AK, AL" in describe(fields[2])


def test_csv_details(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,a,\n" in ner ","say ""hi""\nthere",NA\n\nnull,2\n')
    df = read_sheet(spark, str(p)).orderBy("_row_idx")
    assert df.columns[:3] == ["a", "a.1", "Unnamed: 2"]
    assert [tuple(r)[:3] for r in df.collect()] == [(" in ner ", 'say "hi"\nthere', ""), ("", "2", "")]
    assert [r["_row_idx"] for r in df.collect()] == [0, 1]
    (tmp_path / "e.csv").write_text("")
    for name in ("e.csv", "none.csv", "x.txt", "x.xls"):
        with pytest.raises(ExtractionError):
            read_sheet(spark, str(tmp_path / name)).collect()


def xlsx(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Ac</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="str"><v>ok</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="b"><v>1</v></c></row><row r="3"/><row r="4"><c r="B4"><v>12.0</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="str"><v>x</v></c></row><row r="2"><c r="A2"><v>1.5</v></c></row></sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    p = str(tmp_path / "b.xlsx")
    xlsx(p)
    assert [tuple(r)[:3] for r in read_sheet(spark, p).orderBy("_row_idx").collect()] == [("Acme", "", "True"), ("", "12", "")]
    for sheet in ("Two", 1):
        assert read_sheet(spark, p, sheet=sheet).first()["x"] == "1.5"
    with pytest.raises(ExtractionError):
        read_sheet(spark, p, sheet="Three")


def test_ods(spark, tmp_path):
    p = tmp_path / "b.ods"
    names = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in (("office", "office"), ("table", "table"), ("text", "text")))
    cell = "<table:table-cell><text:p>{}</text:p></table:table-cell>".format
    blank = '<table:table-row table:number-rows-repeated="100000"><table:table-cell table:number-columns-repeated="16000"/></table:table-row>'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("content.xml", f'<office:document-content {names}><office:body><office:spreadsheet><table:table table:name="T"><table:table-row>{cell("a")}{cell("b")}</table:table-row><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"><text:p>x</text:p></table:table-cell></table:table-row><table:table-row><table:table-cell/><table:table-cell office:value-type="float" office:value="7"><text:p>7.00</text:p></table:table-cell></table:table-row>{blank}</table:table></office:spreadsheet></office:body></office:document-content>')
    assert [tuple(r)[:2] for r in read_sheet(spark, str(p)).orderBy("_row_idx").collect()] == [("x", "x"), ("x", "x"), ("", "7")]


def test_cli_run(spark, tmp_path, capsys):
    conf = tmp_path / "c.yaml"
    conf.write_text(TEMPLATE.replace("${LLM_API_KEY}", "").replace("sqlite:///out.db", f"sqlite:///{tmp_path / 'c.db'}"))
    assert main(["run", csv_file(tmp_path / "a.csv"), "-c", str(conf), "--create-tables", "-q"], spark=spark, backend=BACKEND) == 0
    assert "inserted       9" in capsys.readouterr().out
    assert main(["run", str(tmp_path / "no.csv"), "-c", str(conf)], spark=spark, backend=BACKEND) == 1


def test_review_states(spark):
    from tabloom.plans.review import ReviewBatch

    rows = spark.createDataFrame([(0, 0, "Acme", None, "CA")], "_file_idx int, _row_idx long, company_name string, parent_entity string, state string")
    batch = ReviewBatch(spark, rows, config(), lambda p: "?")
    assert batch.summary() == {"record_count": 1, "tables_affected": ["addresses", "companies"], "status": "pending", "revision_count": 0}
    with pytest.raises(ReviewError):
        batch.revise("x")
    assert run_review(batch, lambda _: "REJECT", lambda s: None).status is ReviewStatus.REJECTED


def test_names_and_references(spark, tmp_path):
    """Tables with names that SQL reserves, and foreign keys, whatever the order of the models."""
    own = TableModel("order", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("group by", T.StringType())]), ("id",), {})
    child = TableModel("select", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("order_id", T.LongType())]), ("id",), {"order_id": "order"})
    sink = open_sink(spark, f"sqlite:///{tmp_path}/names.db")
    sink.create_all({"select": child, "order": own})
    sink.append({"order": spark.createDataFrame([(1, "x")], "id long, `group by` string"), "select": spark.createDataFrame([(5, 1)], "id long, order_id long")}, {})
    assert [tuple(r) for r in sink.read(own, ["id", "group by"]).collect()] == [(1, "x")]
    assert sink.db.execute("PRAGMA foreign_key_list('select')").fetchone()[2:5] == ("order", "order_id", "id")
    sink.close()
