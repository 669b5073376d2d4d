"""Detected inputs, baselines of all kinds, versions, YAML snapshots, pipes, positions, deep chains, restarts."""

import json
import os
import subprocess

import pytest

from tests.test_artifacts import MANIFEST
from tests.test_project import FILES
from tributary.functions import names as N
from tributary.functions import sql_text as S
from tributary.functions.types import types_equivalent
from tributary.operators import attributes, lineage, lint
from tributary.plans.bundle import bundle
from tributary.sources import discovery, manifest, project, reports
from tributary.streaming import watch


def written_project(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(root)


def test_discovery(spark, tmp_path):
    root = written_project(tmp_path / "shop_project", FILES)
    assert discovery.discover(spark, root) == (None, root, None, None, None)
    written_project(tmp_path / "shop_project", {
        "target/manifest.json": json.dumps(MANIFEST), "target/catalog.json": '{"nodes": {"model.shop.stg_a": {"columns": {"ID": {"type": "INT"}}, "stats": {}}}, "sources": {}}',
        "target/run_results.json": '{"results": [{"unique_id": "model.shop.stg_a", "status": "success", "execution_time": 2}]}',
        "target/compiled/shop/models/staging/stg_a.sql": "select 1 as id",
    })
    found = discovery.discover(spark, root)
    assert found == (f"{root}/target/manifest.json", None, f"{root}/target/catalog.json", f"{root}/target/run_results.json", f"{root}/target/compiled")
    assert discovery.discover(spark, root, source=root).manifest is None
    old = os.path.getmtime(f"{root}/dbt_project.yml") - 100
    for path in FILES:
        os.utime(f"{root}/{path}", (old, old))
    b = discovery.load(spark, found, root)
    assert b.catalog_columns.count() == 1 and b.run_results.count() == 1 and not any("newer" in w for w in b.warnings)
    code = lambda x: {r["unique_id"]: (r["compiled_code"], r["stale"]) for r in x.node_sql.collect()}
    assert code(b)["model.shop.stg_a"] == ("select 1 as id", False) and code(b)["model.shop.fct_b"] == (None, False)
    later = os.path.getmtime(f"{root}/target/manifest.json") + 100
    os.utime(f"{root}/models/staging/stg_a.sql", (later, later))
    b = discovery.load(spark, found, root)
    assert code(b)["model.shop.stg_a"] == ("select 1 as id", True) and any("1 project files are newer" in w for w in b.warnings)
    for bad in (lambda: discovery.discover(spark, str(tmp_path)), lambda: discovery.discover(spark, root, catalog=f"{root}/none.json"), lambda: discovery.baseline(spark, f"{root}/none")):
        with pytest.raises(FileNotFoundError):
            bad()


def test_baselines(spark, tmp_path):
    root = written_project(tmp_path / "shop_project", FILES)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    written_project(tmp_path / "shop_project", {"models/marts/more.sql": "select 1 as k"})
    ids = lambda b: {r["unique_id"] for r in b.nodes.collect()}
    now, before = ids(project.load_project(spark, root)), ids(discovery.baseline(spark, "git:HEAD", root))
    assert now - before == {"model.shop.more"} and not before - now
    assert ids(discovery.baseline(spark, root)) == now
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    assert "model.dep.extra" not in ids(discovery.baseline(spark, str(tmp_path / "m.json")))
    for bad in ("git:", "git:-p", "git:nowhere"):
        with pytest.raises(ValueError):
            discovery.baseline(spark, bad, root)


VERSIONED = {
    "dbt_project.yml": "name: shop\n",
    "models/dim_v1.sql": "select id, v from {{ source('raw', 't') }}",
    "models/dim_two.sql": "select id, v from {{ ref('dim', v=1) }}",
    "models/dim.sql": "select id, v, w from {{ ref('dim', version=2) }}",
    "models/use.sql": "select * from {{ ref('dim') }} join {{ ref('snap') }} using (id)",
    "models/s.yml": """
sources: [{name: raw, tables: [{name: t}]}]
models:
  - name: dim
    latest_version: 3
    columns: [{name: id, data_type: int}, {name: v}, {name: w}]
    versions:
      - v: 1
        columns: [{include: all, exclude: [w]}]
      - {v: 2, defined_in: dim_two, columns: [{include: [id]}, {name: extra}]}
      - v: 3
snapshots:
  - name: snap
    relation: source('raw', 't')
    config: {unique_key: id}
  - name: nothing
""",
}


def test_versions_and_yaml_snapshots(spark, tmp_path):
    b = project.load_project(spark, written_project(tmp_path / "versioned", VERSIONED))
    assert {r["unique_id"] for r in b.nodes.collect()} == {"source.shop.raw.t", "model.shop.dim.v1", "model.shop.dim.v2", "model.shop.dim.v3", "model.shop.use", "snapshot.shop.snap"}
    assert {(r["parent"], r["child"]) for r in b.edges.collect()} == {
        ("source.shop.raw.t", "model.shop.dim.v1"), ("model.shop.dim.v1", "model.shop.dim.v2"), ("model.shop.dim.v2", "model.shop.dim.v3"), ("model.shop.dim.v3", "model.shop.use"),
        ("snapshot.shop.snap", "model.shop.use"), ("source.shop.raw.t", "snapshot.shop.snap"),
    }
    columns = {}
    for r in b.columns.orderBy("unique_id", "pos").collect():
        columns.setdefault(r["unique_id"], []).append(r["name"])
    assert columns == {"model.shop.dim.v1": ["id", "v"], "model.shop.dim.v2": ["id", "extra"], "model.shop.dim.v3": ["id", "v", "w"]}
    versions = {r["unique_id"]: (r["version"], r["latest_version"]) for r in b.detail.collect() if r["version"]}
    assert versions == {f"model.shop.dim.v{k}": (str(k), "3") for k in (1, 2, 3)}
    with pytest.raises(Exception, match="not valid YAML"):
        project.load_project(spark, written_project(tmp_path / "broken", {"dbt_project.yml": "name: [x"}))


def test_lint_baseline_file(spark):
    rows = [("undocumented_models", "model.b", ["x", "x"]), ("layer_violation", "model.a", ["p"]), ("layer_violation", "model.a", ["p"])]
    text = lint.baseline_text(spark.createDataFrame(rows, "rule string, unique_id string, related array<string>"))
    assert json.loads(text)["findings"] == [{"rule": "layer_violation", "node": "model.a", "related": ["p"]}, {"rule": "undocumented_models", "node": "model.b", "related": ["x"]}] and text.endswith("}\n")
    back = lint.read_baseline(spark, text)
    assert {(r["rule"], r["unique_id"], tuple(r["related"])) for r in back.collect()} == {("layer_violation", "model.a", ("p",)), ("undocumented_models", "model.b", ())}
    for bad in ("nope", "[]", '{"schema": "other/v9", "findings": []}', "{}"):
        with pytest.raises(ValueError, match="invalid lint baseline"):
            lint.read_baseline(spark, bad)


A, PARENTS = "{{ ref('a') }}", {"ref:a": ("m.a", ["id", "x", "y"]), "ref:b": ("m.b", ["id", "z"])}


@pytest.mark.parametrize(
    ("steps", "names", "shaping"),
    [
        ("|> where x > 1", ["id", "x", "y"], {"x"}), ("|> select id, x as q", ["id", "q"], set()), ("|> extend x + y as s", ["id", "x", "y", "s"], set()), ("|> drop y", ["id", "x"], set()),
        ("|> rename x as k", ["id", "k", "y"], set()), ("|> set x = y", ["id", "x", "y"], set()), ("|> aggregate sum(x) as t group by id", ["id", "t"], {"id"}), ("|> order by y |> limit 3", ["id", "x", "y"], {"y"}),
        ("|> where x > 1 |> select id |> as q |> join {{ ref('b') }} b on q.id = b.id", ["id", "id", "z"], {"x", "id"}), ("|> select id |> union all (select z from {{ ref('b') }})", ["id"], set()),
    ],
)
def test_pipes(steps, names, shaping):
    got = S.analyse(f"from {A} {steps}", PARENTS)
    assert [c.name for c in got.outputs] == names and {c for _, c in got.shaping} >= shaping
    assert got.facts.wildcard is False


def test_more_clauses():
    got = S.analyse(f"select id from {A} prewhere x = 1 start with y is null connect by prior id = y", PARENTS)
    assert {c for _, c in got.shaping} == {"x", "y", "id"}
    with pytest.raises(S.Unreadable):
        S.analyse(f"from {A} |> frobnicate x", PARENTS)


def test_positions():
    assert S.byte_position("é\nab", 0, 3) == ((1, 1), (2, 1)) and S.byte_position("é\nab", 1, 5) == ((1, 1), (2, 3))
    assert S.line_and_column("a\nbc", 3) == (2, 2)


def test_short_names(spark):
    rows = spark.createDataFrame([("abcdefghij",), ("abc",)], "n string")
    got = [r[0] for r in rows.select(N.mid_truncated(rows["n"], 6)).collect()]
    assert got == ["ab…hij", "abc"]


def graph(spark, n, edges, columns=()):
    node = spark.createDataFrame([(f"model.p.m{i}", f"m{i}", "model", f"staging/m{i}.sql", "view") for i in range(n)], "unique_id string, name string, resource_type string, path string, materialized string")
    edge = spark.createDataFrame([(f"model.p.m{a}", f"model.p.m{b}") for a, b in edges], "parent string, child string")
    code = spark.createDataFrame([(f"model.p.m{i}", t, None, False) for i, t in columns], "unique_id string, raw_code string, compiled_code string, stale boolean")
    return bundle(spark, node, edge, node_sql=code)


def test_column_lists_of_deep_chains(spark):
    """Sixty models in a row, the third unreadable on its own branch."""
    code = [(0, "select 1 as a, 2 as b")] + [(i, f"select * from {{{{ ref('m{i - 1}') }}}}") for i in range(1, 60)] + [(60, "drop table x"), (61, "select 1 as c from {{ ref('m60') }}")]
    b = graph(spark, 62, [(i, i + 1) for i in range(59)] + [(60, 61)], code)
    got = {r["unique_id"]: r["columns"] for r in lineage.column_lists(b).collect()}
    assert got["model.p.m59"] == ["a", "b"] and got["model.p.m60"] is None and got["model.p.m61"] == ["c"]


def test_vetoes_of_unrecorded_reads(spark):
    """A hop whose other reader is only in a conditional arm isn't redundant; a model that only calls conditionally is no root."""
    plain = [(0, "select 1 as k"), (1, "select k from {{ ref('m0') }}"), (2, "select k from {{ ref('m0') }} join {{ ref('m1') }} using (k)")]
    b = graph(spark, 4, [(0, 1), (0, 2), (1, 2)], [*plain, (3, "select 1 as k")])
    maybe = graph(spark, 4, [(0, 1), (0, 2), (1, 2)], [*plain, (3, "{% if x %}select k from {{ ref('m1') }}{% endif %}")])
    found = lambda g, rule: {r["unique_id"] for r in lint.RULES[rule].run(g, {"calls": lineage.resolved_references(g)}).collect()}
    assert found(b, "rejoining_upstream") == {"model.p.m1"} and found(maybe, "rejoining_upstream") == set()
    assert found(b, "root_models") == {"model.p.m0", "model.p.m3"} and found(maybe, "root_models") == {"model.p.m0"}
    where = {(r["name"], r["line"], r["column"]) for r in lineage.resolved_references(maybe).where("conditional").collect()}
    assert where == {("m1", 1, 25)}


def test_types(spark):
    pairs = [("DOUBLE  PRECISION", "double precision", None, True), ("varchar", "VARCHAR(255)", None, True), ("varchar(10)", "VARCHAR(255)", None, False), ("decimal(10, 2)", "DECIMAL(10,2)", None, True), ("bigint", "INT64", "bigquery", True), ("bigint", "INT64", None, False), ("int", "NUMBER", "snowflake", True), ("bigint", "NUMBER(38,0)", "snowflake", True), ("int", "NUMBER(10,2)", "snowflake", False), ("decimal(10,2)", "number(10,2)", "snowflake", True), ("char", "varchar", None, False), ("float", "real", None, False)]
    for a, b, dialect, want in pairs:
        row = spark.createDataFrame([(a, b)], "a string, b string")
        assert row.select(types_equivalent(row["a"], row["b"], dialect)).first()[0] == want, (a, b, dialect)


def test_lenses_and_diagram_budget(spark):
    b = graph(spark, 3, [(0, 1), (1, 2)])
    more = attributes.lenses(
        b, b.edges.limit(1), spark.createDataFrame([("model.p.m0", "warn"), ("model.p.m0", "error")], "unique_id string, severity string"),
        spark.createDataFrame([("model.p.m1", "modified")], "unique_id string, status string"), spark.createDataFrame([("model.p.m2", "c")], "node string, column string"),
    )
    got = {r["unique_id"]: r for r in more.collect()}
    assert got["model.p.m0"]["lint"] == "error" and got["model.p.m1"]["diff"] == "modified" and got["model.p.m2"]["column_impact"] == 1
    assert sum(r["layer_violation"] == "violation" for r in got.values()) == 2
    assert reports.budgeted(b.nodes, b.edges, whole=True).count() == 6
    wide = graph(spark, 500, [(0, i) for i in range(1, 500)])
    assert reports.budgeted(wide.nodes, wide.edges) is None
    assert [r["name"] for r in b.nodes.orderBy(*reports.docs_order()).collect()] == ["m0", "m1", "m2"]


def test_watch_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    run = lambda: watch.watch(spark, str(folder), str(tmp_path / "check"), lambda b, c: seen.append(None if c is None else {(r["unique_id"], r["status"]) for r in c.collect()}), None).awaitTermination(120)
    (folder / "a.json").write_text(json.dumps(MANIFEST))
    run()
    later = json.loads(json.dumps(MANIFEST))
    later["nodes"]["model.shop.fct_b"]["raw_code"] = "select 1 as id"
    (folder / "b.json").write_text(json.dumps(later))
    run()
    assert seen == [None, {("model.shop.fct_b", "modified")}]


def test_universe_of_a_manifest(spark):
    doc = json.loads(json.dumps(MANIFEST))
    doc["disabled"] = {"model.shop.off": [{"name": "off"}], "source.shop.raw.gone": [{}], "model.shop.dim.v1": [{}]}
    doc["nodes"]["model.shop.fct_b"]["raw_code"] = "select id from {{ ref('off') }} {{ source('raw', 'gone') }} {{ ref('dim') }} {{ ref('dim', v=2) }} {{ ref('dim', v=7) }} {{ ref('extra') }} {{ ref('dep', 'extra') }} {{ ref('z') }}"
    b = attributes.root_scope(manifest.manifest_text(spark, json.dumps(doc)))
    got = [(r["name"], r["version"], r["verdict"], r["target"]) for r in lineage.resolved_references(b).where("unique_id = 'model.shop.fct_b'").orderBy("column").collect()]
    assert got == [
        ("off", None, "disabled", None), ("raw.gone", None, "disabled", None), ("dim", None, "local", "model.shop.dim.v2"), ("dim", "2", "local", "model.shop.dim.v2"), ("dim", "7", "missing", None),
        ("extra", None, "foreign_any", None), ("extra", None, "foreign", None), ("z", None, "local", "analysis.shop.z"),
    ]
