import os

import pytest

from tabloom.cli import main
from tabloom.config import TEMPLATE, load_config, parse, substitute, validate_config, with_options
from tabloom.errors import ConfigError

BASE = """
name: demo
llm: {base_url: "http://x/v1", model: m, api_key: "${DEMO_KEY}"}
database: {url: "sqlite://"}
schema:
  fields:
    - {name: company, type: string, required: true, db: {table: companies, column: name}}
    - {name: parent, type: string, db: {table: companies, column: parent_name}}
  tables:
    companies: {primary_key: {column: id, type: auto_increment}}
"""


@pytest.fixture
def write(tmp_path, monkeypatch):
    monkeypatch.delenv("DEMO_KEY", raising=False)

    def put(text=BASE, env="DEMO_KEY='from file'\n"):
        (tmp_path / ".env").write_text(env)
        (tmp_path / "c.yaml").write_text(text)
        return tmp_path / "c.yaml"

    yield put
    os.environ.pop("DEMO_KEY", None)


def test_loads_with_env_file(write):
    c = load_config(write())
    assert c.llm.api_key == "from file" and c.pipeline.chunk_size == 25 and c.fields[0].required


def test_environment_goes_before_the_file(write, monkeypatch):
    path = write()
    monkeypatch.setenv("DEMO_KEY", "set")
    assert load_config(path).llm.api_key == "set"


def test_unset_variable(write):
    with pytest.raises(ConfigError, match="DEMO_KEY"):
        load_config(write(env=""))
    assert substitute({"${A}": ["x${A}y", 1]}, {"A": "b"}) == {"${A}": ["xby", 1]}


@pytest.mark.parametrize("old,new", [
    ("type: string, required", "type: text, required"), ("table: companies, column: name", "table: none, column: name"), ("type: auto_increment", "type: serial"),
    ("name: demo", ""), ("type: string, db", "type: enum, db"), ("type: string, db", "type: regex, db"), ("type: string, db", "type: subdivision, db"),
    ("type: string, db", "type: string, min_length: 5, max_length: 2, db"), ("name: parent", "name: company"), ("required: true", "required: maybe"),
])
def test_rejects(write, old, new):
    with pytest.raises(ConfigError):
        load_config(write(BASE.replace(old, new)))


def test_relationship_rules(write):
    for more in ("relationships: [{type: belongs_to, field: x, table: companies, references: companies, fk_column: p, resolve_by: name}]",
                 "relationships: [{type: belongs_to, field: parent, table: other, references: companies, fk_column: p, resolve_by: name}]",
                 "relationships: [{type: junction, link: [companies], through: t, columns: {}}]", "relationships: [{type: many}]"):
        with pytest.raises(ConfigError):
            load_config(write(BASE + more))


def test_missing_and_broken_files(tmp_path):
    with pytest.raises(ConfigError):
        load_config(tmp_path / "none.yaml")
    (tmp_path / "b.yaml").write_text("a: [")
    with pytest.raises(ConfigError):
        load_config(tmp_path / "b.yaml")


def test_warnings_and_options(write):
    path = write()
    assert len(validate_config(path)) == 3
    c = load_config(path)
    assert with_options(c, chunk_size=5).pipeline.chunk_size == 5 and c.pipeline.chunk_size == 25
    with pytest.raises(ConfigError):
        with_options(c, chunk_size=0)


def test_cli(tmp_path, write, capsys):
    made = tmp_path / "new.yaml"
    assert main(["init", "-c", str(made)]) == 0 and made.read_text() == TEMPLATE
    made.write_text("x")
    assert main(["init", "-c", str(made)], ask=lambda _: "n") == 0 and made.read_text() == "x"
    assert main(["validate", "-c", str(write())]) == 0
    assert "Warning" in capsys.readouterr().out
    assert main(["validate", "-c", str(tmp_path / "none.yaml")]) == 1
    with pytest.raises(SystemExit):
        main(["--version"])


def test_template_is_valid(monkeypatch):
    import yaml

    assert parse(substitute(yaml.safe_load(TEMPLATE), {"LLM_API_KEY": "k"})).junctions[0].through == "company_addresses"
