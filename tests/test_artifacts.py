"""Artifact readers, scope, selectors, reports, documentation, streaming: on a small project."""

import json
import random

import pytest

from tributary.operators import attributes, diff, impact, lint, select, traverse
from tributary.plans.bundle import bundle
from tributary.sources import manifest, reports
from tributary.streaming import watch

MANIFEST = {
    "metadata": {"project_name": "shop", "adapter_type": "duckdb"},
    "nodes": {
        "model.shop.stg_a": {"name": "stg_a", "resource_type": "model", "path": "staging/stg_a.sql", "original_file_path": "models/staging/stg_a.sql", "config": {"materialized": "view"}, "tags": ["x"], "meta": {"owner": "ann", "n": 3, "ignore": ["undocumented_models"]}, "raw_code": "select * from {{ source('raw', 't') }}", "columns": {"ID": {"name": "ID", "data_type": "int"}, "v": {"name": "v", "description": " "}}, "depends_on": {"nodes": ["source.shop.raw.t"], "macros": ["macro.shop.m"]}, "description": ""},
        "model.shop.fct_b": {"name": "fct_b", "resource_type": "model", "path": "marts/fct_b.sql", "original_file_path": "models\\marts\\fct_b.sql", "patch_path": "shop://models/marts/s.yml", "config": {"materialized": "incremental", "unique_key": ["id", " "]}, "raw_code": "select id from {{ ref('stg_a') }}", "depends_on": {"nodes": ["model.shop.stg_a"]}, "description": "B", "package_name": "shop", "contract": {"enforced": True}, "access": "public"},
        "model.shop.dim.v2": {"name": "dim", "resource_type": "model", "path": "marts/dim_v2.sql", "version": 2, "config": {"materialized": "table"}, "raw_code": "select 1 as k;", "depends_on": {"nodes": []}},
        "model.dep.extra": {"name": "extra", "resource_type": "model", "path": "extra.sql", "config": {"materialized": "view"}, "depends_on": {"nodes": ["model.shop.fct_b"]}},
        "test.shop.t1": {"name": "t1", "resource_type": "test", "attached_node": "model.shop.stg_a", "column_name": "id", "test_metadata": {"name": "unique", "kwargs": {}}, "depends_on": {"nodes": ["model.shop.stg_a"]}},
        "test.shop.t2": {"name": "t2", "resource_type": "test", "attached_node": "model.shop.fct_b", "test_metadata": {"name": "relationships", "kwargs": {"column_name": "id", "field": "ID"}}, "depends_on": {"nodes": ["model.shop.stg_a", "model.shop.fct_b"]}},
        "test.shop.t3": {"name": "t3", "resource_type": "test", "depends_on": {"nodes": ["model.shop.stg_a", "model.shop.fct_b"]}},
        "analysis.shop.z": {"name": "z", "resource_type": "analysis", "depends_on": {"nodes": []}},
        "weird.shop.w": {"name": "w", "resource_type": "weird", "depends_on": {"nodes": []}},
    },
    "sources": {"source.shop.raw.t": {"name": "t", "schema": "raw", "identifier": "T1", "freshness": {"warn_after": {"count": 12, "period": "hour"}}}},
    "exposures": {"exposure.shop.e": {"name": "e", "type": "dashboard", "owner": {"name": "Ann", "email": "a@x"}, "depends_on": {"nodes": ["model.shop.fct_b"]}}},
    "unit_tests": {"unit_test.shop.fct_b.u": {"name": "u", "model": "fct_b", "depends_on": {"nodes": ["model.shop.fct_b"]}}},
    "macros": {"macro.shop.m": {"name": "m", "macro_sql": "old", "arguments": [{"name": "p"}], "depends_on": {"macros": []}}},
    "docs": {"doc.shop.__overview__": {"block_contents": "Hello", "package_name": "shop"}},
    "parent_map": {"model.shop.stg_a": ["source.shop.raw.t"], "model.shop.fct_b": ["model.shop.stg_a", "test.shop.t1"], "model.dep.extra": ["model.shop.fct_b"]},
    "child_map": {},
}


@pytest.fixture(scope="module")
def shop(spark):
    return manifest.manifest_text(spark, json.dumps(MANIFEST))


def uids(df):
    return sorted(r["unique_id"] for r in df.select("unique_id").collect())


def test_manifest(spark, shop):
    assert {(r["parent"], r["child"]) for r in shop.edges.collect()} == {("source.shop.raw.t", "model.shop.stg_a"), ("model.shop.stg_a", "model.shop.fct_b"), ("model.shop.fct_b", "model.dep.extra"), ("model.shop.fct_b", "exposure.shop.e")}
    assert "analysis.shop.z" not in uids(shop.nodes) and shop.overview == "Hello" and shop.root_project == "shop"
    assert shop.warnings == ["1 nodes of unknown type weird"]
    d = {r["unique_id"]: r for r in shop.detail.collect()}
    assert d["model.shop.fct_b"]["unique_key"] == ["id"] and d["model.shop.stg_a"]["description"] is None
    assert d["model.shop.stg_a"]["meta"]["owner"] == "ann" and d["model.shop.stg_a"]["meta"]["n"] == "3"
    assert d["model.shop.fct_b"]["original_file_path"] == "models/marts/fct_b.sql" and d["model.shop.fct_b"]["patch_path"] == "models/marts/s.yml"
    assert d["source.shop.raw.t"]["warn_after"]["count"] == 12 and d["model.shop.dim.v2"]["version"] == "2"
    tests = {(r["unique_id"], r["kind"], r["column_name"], r["ref_uid"], r["ref_column"]) for r in shop.tests.collect()}
    assert ("model.shop.fct_b", "relationships", "id", "model.shop.stg_a", "ID") in tests and ("model.shop.stg_a", "singular", None, None, None) in tests and ("model.shop.fct_b", "unit", None, None, None) in tests
    assert [r["name"] for r in shop.columns.where("unique_id = 'model.shop.stg_a'").orderBy("pos").collect()] == ["ID", "v"]
    with pytest.raises(ValueError, match="JSON"):
        manifest.manifest_text(spark, "nope {")


def test_catalog_and_runs(spark):
    text = {"nodes": {"m": {"columns": {"ID": {"type": "INT"}}, "stats": {"num_rows": {"value": 5, "include": True}, "hidden": {"value": 1, "include": False}}}}, "sources": {}}
    columns, stats = manifest.catalog_document(spark.createDataFrame([(json.dumps(text),)], "value string"))
    assert [tuple(r) for r in columns.collect()] == [("m", "ID", "INT")] and [tuple(r) for r in stats.collect()] == [("m", "num_rows", "5")]
    runs = {"results": [{"unique_id": "m", "status": "error", "execution_time": 1.5}, {"unique_id": "m", "status": "odd", "execution_time": 2}]}
    got = manifest.run_results_document(spark.createDataFrame([(json.dumps(runs),)], "value string")).collect()
    assert [tuple(r) for r in got] == [("m", "odd", 2.0)]


def test_scope_and_selectors(spark, shop):
    scoped = attributes.root_scope(shop)
    assert "model.dep.extra" not in uids(scoped.nodes)
    assert [tuple(r) for r in scoped.pruned_adjacent.collect()] == [("model.shop.fct_b", 0, 1)]
    pick = lambda spec: uids(select.select(shop, spec))
    assert pick("+fct_b") == ["model.shop.fct_b", "model.shop.stg_a", "source.shop.raw.t"]
    assert pick("1+e") == ["exposure.shop.e", "model.shop.fct_b"] and pick("0+e") == ["exposure.shop.e"]
    assert pick("dim.v2") == pick("dim.2") == pick("dim.*") == ["model.shop.dim.v2"]
    assert pick("tag:x,stg_*") == ["model.shop.stg_a"] and pick("tag:x,fct_*") == []
    assert pick("meta:n=3") == ["model.shop.stg_a"] and pick("path:models/marts/s.yml") == ["model.shop.fct_b"]
    assert pick("path:models/st*") == ["model.shop.stg_a"] and pick("stg_[!b]") == ["model.shop.stg_a"]
    assert pick("state:modified") == []
    for bad in ("", "a,,b", "tag:", "what:x", "state:old", "+", "config.foo:x", "++a"):
        with pytest.raises(ValueError):
            select.validate(bad)
    assert select.validate("state:new a").uses_state() and not select.validate("2+a+").uses_state()


def test_diff_with_macros(spark, shop):
    changed = json.loads(json.dumps(MANIFEST))
    changed["macros"]["macro.shop.m"]["macro_sql"] = "new"
    changed["nodes"]["model.shop.fct_b"]["raw_code"] += " where id > 1"
    del changed["nodes"]["model.dep.extra"]
    later = manifest.manifest_text(spark, json.dumps(changed))
    got = {r["unique_id"]: (r["status"], r["reasons"]) for r in diff.node_changes(shop, later).collect()}
    assert got == {"model.shop.stg_a": ("modified", ["macro:m"]), "model.shop.fct_b": ("modified", ["sql changed"]), "model.dep.extra": ("removed", [])}
    assert diff.node_changes(shop, shop).isEmpty() and diff.edge_changes(shop, shop).isEmpty()
    gates = {r["gate"]: (r["status"], r["value"]) for r in impact.gate_results(later, shop, {"coverage": {"min": 90}}).collect()}
    assert gates["affected_exposures"] == ("warn", 1) and gates["coverage"] == ("fail", 66) and gates["doc_coverage"] == ("off", None)
    alone = {r["gate"]: r["status"] for r in impact.gate_results(later, None).collect()}
    assert alone["new_layer_violations"] == "skip"


def test_lint_and_reports(spark, shop):
    found, _ = lint.findings(shop)
    judged = lint.classified(lint.suppressed(shop, found, {"versions": "dim.v2"})).cache()
    by = {(r["rule"], r["unique_id"]): (r["class"], r["suppressed_by"]) for r in judged.collect()}
    assert by["undocumented_models", "model.shop.stg_a"] == ("suppressed", "meta")
    assert by["undocumented_models", "model.shop.dim.v2"] == ("suppressed", "versions")
    assert by["trailing_semicolon", "model.shop.dim.v2"][0] == "suppressed"
    assert by["missing_primary_key_tests", "model.shop.stg_a"] == ("counted", None)
    base = found.where("rule = 'missing_primary_key_tests'").select("rule", "unique_id", "related")
    again = lint.classified(found, baseline=base)
    assert {r["class"] for r in again.where("rule = 'missing_primary_key_tests'").collect()} == {"baselined"}
    assert lint.rewritten_baseline(base, found.limit(0), ["missing_primary_key_tests"]).isEmpty()
    for form in reports.FORMATS:
        lines = [r["line"] for r in reports.report(found, form, shop).orderBy("part", "n").collect()] if reports.FORMATS[form][1] else [r["line"] for r in reports.report(found, form, shop).collect()]
        text = "\n".join(lines)
        assert "trailing" in text and "semicolon" in text
        if form in ("json", "sarif", "codeclimate"):
            json.loads(text)
    assert reports.fnv1a("") == "cbf29ce484222325" and reports.fnv1a("a") == "af63dc4c8601ec8c"


def test_exports_and_docs(spark, shop, tmp_path):
    lines = [r["line"] for r in reports.mermaid(shop.nodes, shop.edges).collect()]
    assert lines[0] == "graph LR" and "    stg_a --> fct_b" in lines
    assert any('"model.shop.stg_a" -> "model.shop.fct_b"' in r["line"] for r in reports.dot(shop.nodes, shop.edges).collect())
    pages = reports.docs_pages(shop).cache()
    body = {r["path"]: r["body"] for r in pages.collect()}
    assert "- stg\\_a" in body["models/model.shop.fct_b.md"] and "## ann" in body["owners.md"] and "Hello" in body["README.md"]
    assert reports.save_pages(pages, f"file://{tmp_path}") == len(body)
    there = spark.createDataFrame([(str(p.relative_to(tmp_path)), p.read_text()) for p in tmp_path.rglob("*.md")], "path string, body string")
    assert reports.docs_drift(pages, there).isEmpty()
    moved = there.where("path <> 'tags.md'").union(spark.createDataFrame([("old.md", "x")], there.schema))
    assert {tuple(r) for r in reports.docs_drift(pages, moved).collect()} == {("tags.md", "missing"), ("old.md", "stale")}


def test_watch(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(MANIFEST))
    later = json.loads(json.dumps(MANIFEST))
    del later["nodes"]["model.dep.extra"]

    def note(b, changes):
        seen.append((b.nodes.count(), None if changes is None else [tuple(r) for r in changes.select("unique_id", "status").collect()]))

    for name, doc in (("1.json", MANIFEST), ("2.json", later)):
        (folder / name).write_text(json.dumps(doc))
    query = watch.watch(spark, str(folder), str(tmp_path / "state"), note, interval=None)
    query.awaitTermination(120)
    assert seen == [(7, None), (6, [("model.dep.extra", "removed")])]
    assert watch.stamp(spark, str(folder))[1] == 2


def random_graph(spark, seed, n=40):
    draw = random.Random(seed)
    pairs = {(f"n{a:02}", f"n{b:02}") for a in range(n) for b in range(a + 1, n) if draw.random() < 0.06}
    nodes = spark.createDataFrame([(f"n{i:02}", f"n{i:02}", "model", "m/x.sql", "view", float(i % 7)) for i in range(n)], "unique_id string, name string, resource_type string, path string, materialized string, w double")
    return nodes, spark.createDataFrame(sorted(pairs), "parent string, child string"), pairs


def test_traversal_against_plain_search(spark):
    nodes, edges, pairs = random_graph(spark, 4)
    kids, ups = {}, {}
    for a, b in pairs:
        kids.setdefault(a, set()).add(b)
        ups.setdefault(b, set()).add(a)

    def reach(start, near):
        depth, todo = {start: 0}, [start]
        for x in todo:
            for y in sorted(near.get(x, ())):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    todo.append(y)
        return {k: v for k, v in depth.items() if k != start}

    down = {(r["seed"], r["unique_id"]): r["depth"] for r in traverse.walk(edges, nodes.selectExpr("unique_id as seed", "unique_id")).collect()}
    up = {(r["unique_id"], r["seed"]) for r in traverse.walk(traverse.turned(edges), nodes.selectExpr("unique_id as seed", "unique_id")).collect()}
    assert down == {(s, k): d for s in kids for k, d in reach(s, kids).items()} and up == set(down)
    level = {r["unique_id"]: r["col"] for r in traverse.layering(nodes, edges).collect()}
    assert all(level[a] < level[b] for a, b in pairs) and all(level[x] == 0 for x in level if x not in ups)
    both = {x: kids.get(x, set()) | ups.get(x, set()) for x in level}
    start = min(kids)
    far = reach(start, both)
    target = max(far, key=lambda k: (far[k], k))
    path = traverse.shortest_path(edges, start, target)
    assert len(path) == far[target] + 1 and path[0] == target and path[-1] == start
    assert all((a, b) in pairs or (b, a) in pairs for a, b in zip(path, path[1:]))
    assert traverse.path_edges(path, edges).count() == len(path) - 1
    chain = traverse.longest_chain(nodes, edges)
    assert all(p in pairs for p in zip(chain, chain[1:])) and len(chain) == max(level.values()) + 1


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "unique_id string")
    seed = nodes.where("unique_id = 'a'")
    assert uids(traverse.closure(edges, seed)) == ["b", "c", "d"]
    assert uids(traverse.closure(edges, seed, keep_seeds=True)) == ["a", "b", "c", "d"]
    assert uids(traverse.closure(edges, seed, depth=1)) == ["b"]
    assert traverse.layering(nodes, edges).count() == 4
    with pytest.raises(RuntimeError):
        rounds, traverse.ROUNDS = traverse.ROUNDS, 12
        try:
            traverse.longest_chains(nodes, edges)
        finally:
            traverse.ROUNDS = rounds


def test_collapse(spark):
    nodes = spark.createDataFrame([("r",)] + [(f"k{i:02}",) for i in range(12)] + [("z",)], "unique_id string")
    edges = spark.createDataFrame([("r", f"k{i:02}") for i in range(12)] + [("k11", "z"), ("k10", "z")], "parent string, child string")
    shown, contracted = traverse.collapse_siblings(nodes, edges, 4, priority=nodes.where("unique_id = 'k09'"))
    marks = {r["unique_id"]: r["marker"] for r in shown.collect()}
    assert marks["k09"] is None and marks["k02"] is None and marks["k03"] == "+8 of r"
    assert {tuple(r) for r in contracted.collect()} == {("r", "k00"), ("r", "k01"), ("r", "k02"), ("r", "k09"), ("r", "+8 of r"), ("+8 of r", "z")}
    assert traverse.collapse_siblings(nodes, edges, 0)[1] is edges
    assert bundle(spark, nodes.selectExpr("unique_id", "unique_id as name", "'model' as resource_type", "'' as path", "'view' as materialized"), edges).tests.isEmpty()
