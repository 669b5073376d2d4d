"""The session API, the configuration and the command line over one manifest."""

import json

import pytest

from tests.test_artifacts import MANIFEST
from tributary import cli
from tributary.config import read_config
from tributary.engine import Engine
from tributary.operators import lineage, lint
from tributary.operators.impact import GATES


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.load(spark, manifest_text=json.dumps(MANIFEST))


def test_verbs(engine):
    assert [r["list_name"] for r in engine.select("+fct_b").collect()] == ["fct_b", "stg_a", "t"]
    (detail,) = engine.node_detail("model.shop.stg_a").collect()
    assert detail["direct_up"] == 1 and detail["test_count"] == 2 and [c["name"] for c in detail["columns"]] == ["ID", "v"]
    nodes, edges = engine.lineage(["fct_b"], down=False)
    assert nodes.count() == 3 and edges.count() == 2
    assert [(r["node"], r["column"]) for r in engine.columns("model.shop.fct_b", "id").collect()][0] == ("model.shop.stg_a", "id")
    rules = lambda: {(r["rule"], r["unique_id"]) for r in engine.lint().collect()}
    assert ("select_star", "model.shop.stg_a") in rules()
    engine.replace_sql("model.shop.stg_a", "select id from {{ source('raw', 't') }}")
    assert ("select_star", "model.shop.stg_a") not in rules()
    engine.revert_sql("model.shop.stg_a")
    assert ("select_star", "model.shop.stg_a") in rules()


def test_registry():
    assert lineage is not None and len(lint.RULES) == 47 and len(GATES) == 10
    assert all(s.severity in ("error", "warn") and s.needs in ("graph", "sql", "facts", "catalog") for s in lint.RULES.values())


def test_config():
    assert read_config("lint: {preset: strict, rules: {select_star: off}}\nother: {x: 1}")["lint"]["preset"] == "strict"
    for bad in ("lint: {what: 1}", "lint: {rules: {nope: error}}", "check: {gates: {nope: {}}}", "lint: {preset: odd}", "- 1"):
        with pytest.raises(ValueError):
            read_config(bad)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    at = tmp_path / "manifest.json"
    at.write_text(json.dumps(MANIFEST))
    old = json.loads(json.dumps(MANIFEST))
    old["nodes"]["model.shop.fct_b"]["raw_code"] = "select 1 as id"
    (tmp_path / "old.json").write_text(json.dumps(old))
    common = ["--manifest", str(at)]
    assert cli.main(["ls", "tag:x", *common]) == 0 and capsys.readouterr().out.split() == ["stg_a"]
    assert cli.main(["ls", "tag:", *common]) == 2 and cli.main(["ls", "--manifest", str(tmp_path / "none.json")]) == 2
    assert cli.main(["impact", *common]) == 2
    capsys.readouterr()
    assert cli.main(["impact", *common, "--base", str(tmp_path / "old.json")]) == 0
    text = capsys.readouterr().out
    assert "fct_b: sql changed" in text and "## Affected exposures (1)" in text and "`fct_b+`" in text
    assert cli.main(["lint", *common]) == 1 and "trailing_semicolon" in capsys.readouterr().out
    assert cli.main(["check", *common, "--base", str(tmp_path / "old.json")]) == 0
    assert "affected_exposures\t1" in capsys.readouterr().out
    assert cli.main(["docs", *common, "--output", str(tmp_path / "out")]) == 0 and (tmp_path / "out/README.md").exists()


def test_fix_files(spark, tmp_path, capsys):
    text = json.loads(json.dumps(MANIFEST))
    node = text["nodes"]["model.shop.fct_b"]
    node |= {"raw_code": "with q as (select 1 as k) select id from {{ ref('stg_a') }} ;", "original_file_path": "models/b.sql", "meta": {}}
    other = text["nodes"]["model.shop.stg_a"]
    other |= {"raw_code": "select ID from {{ source('raw', 't') }};", "original_file_path": "models/a.sql", "meta": {}}
    (tmp_path / "manifest.json").write_text(json.dumps(text))
    (tmp_path / "models").mkdir()
    (tmp_path / "models/b.sql").write_text("\n" + node["raw_code"] + "\n")
    (tmp_path / "models/a.sql").write_text("select 2;")
    assert cli.main(["lint", "--fix", "--manifest", str(tmp_path / "manifest.json"), "--project-dir", str(tmp_path)]) == 0
    said = capsys.readouterr().out
    assert (tmp_path / "models/b.sql").read_text() == "\nselect id from {{ ref('stg_a') }}\n" and "fixed\tmodel.shop.fct_b\ttrailing_semicolon,unused_cte" in said
    assert (tmp_path / "models/a.sql").read_text() == "select 2;" and "refused\tmodel.shop.stg_a" in said
