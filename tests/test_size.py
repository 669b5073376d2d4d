"""What must hold of plans and readers so that large inputs fit, shown on small ones."""

import json

import pytest
from pyspark.sql import functions as F

from tributary.operators import lineage, lint
from tributary.plans import graphs, workloads  # noqa: F401  (workloads adds to the pack)
from tributary.plans.queries import QUERIES, later, layered
from tributary.sources import manifest
from tributary.sources.fragments import fragments

#: Queries that join the details of all nodes.
DETAILED = [
    "lint_exposure_parents_materializations",
    "lint_exposures_dependent_on_private_models",
    "lint_incremental_without_unique_key",
    "lint_layer_materializations",
    "lint_model_directories",
    "lint_models_without_unit_tests",
    "lint_multiple_sources_joined",
    "lint_naming_conventions",
    "lint_sources_without_freshness",
    "lint_staging_depends_on_staging",
    "lint_trailing_semicolon",
    "rewritten_baseline",
    "select_meta_key",
    "lint_marts_depend_on_source",
    "lint_references_deprecated_model",
]


@pytest.mark.parametrize("name", DETAILED)
def test_details_are_merged_not_broadcast(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan, plan


def _small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")


def test_a_document_on_one_line_is_read_in_blocks(spark, tmp_path):
    """Members, strings and escapes lie across blocks of some 1,500 bytes; before, the line was one row."""
    said = 'a "quoted", {braced}, [x] \\ text, ' * 6
    nodes = {f"model.p.m{k}": {"name": f"m{k}", "resource_type": "model", "path": f"a/m{k}.sql", "description": said + str(k), "depends_on": {"nodes": [f"model.p.m{j}" for j in range(k)]}} for k in range(20)}
    doc = {"metadata": {"project_name": "p", "adapter_type": "duckdb", "more": {"x": [1, {"y": "}"}]}}, "nodes": nodes, "sources": {}, "list": [1, {"a": 2}], "null": None}
    try:
        _small_blocks(spark)
        for k, text in enumerate((json.dumps(doc, separators=(",", ":")), json.dumps(doc), json.dumps(doc, indent=2))):
            path = tmp_path / f"{k}.json"
            path.write_text(text)
            assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() > 5
            found = fragments(spark, str(path))
            got = {r["section"]: r["n"] for r in found.where("text rlike '[^ \\n]'").groupBy("section").agg(F.count("*").alias("n")).collect()}
            assert got == {"metadata": 3, "nodes": 20, None: 1}
            if k:
                continue
            b = manifest.manifest(spark, str(path))
            assert {r["unique_id"]: r["description"] for r in b.detail.collect()} == {u: n["description"].strip() for u, n in nodes.items()}
            assert b.edges.count() == 20 * 19 // 2 and (b.root_project, b.adapter_type) == ("p", "duckdb")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", ["", "nope {", "[1]", '{"nodes": {"a": {}}', '{"nodes": {"a": {}]}', '{"nodes": {"a": {b}}}', '{"nodes": {}} x', '{"nodes": {"a}}'])
def test_what_is_no_document_is_told(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(ValueError, match="isn't a JSON document"):
        manifest.manifest(spark, str(tmp_path / "m.json"))


def test_the_manifest_is_written_in_lines(spark, sf):
    """No row holds more than a member, and the lines together are a JSON document."""
    lines = [r["value"] for r in graphs.manifest_document(layered(spark, sf)).collect()]
    doc = json.loads("".join(lines))
    assert len(lines) == 5 + sum(len(doc[s]) for s in ("nodes", "sources", "exposures", "unit_tests")) and max(map(len, lines)) < 2000


@pytest.fixture(scope="module")
def not_built(spark, sf):
    from tributary.plans import queries

    queries._built.pop((spark.sparkContext.applicationId, sf, "read_back"), None)


#: Queries over the manifest that is written and read back.
READ_BACK = [
    "manifest_columns",
    "manifest_edges",
    "manifest_details",
    "manifest_tests",
    "manifest_exposures",
    "manifest_nodes",
]


@pytest.mark.parametrize("name", READ_BACK)
def test_no_manifest_is_read_as_one_row(spark, sf, not_built, monkeypatch, name):
    def fail(*_):
        raise AssertionError("the whole document in one row")

    monkeypatch.setattr(manifest, "read_text", fail)
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("rule", ["root_models", "unused_models", "direct_join_to_source", "too_many_joins"])
def test_rules_merge_nodes_and_edges(spark, sf, rule):
    plan = lint.RULES[rule].run(layered(spark, sf), {})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan


def test_all_rules_are_not_one_plan(spark, sf):
    """Only the rules' names are joined to what each rule has written."""
    plan = lint.findings(layered(spark, sf))[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hash" not in plan, plan


def test_a_later_state_merges_models(spark, sf):
    plan = later(spark, sf).tests._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_the_manifest_is_written_and_read_by_merging(spark, sf, monkeypatch):
    """But for the exposures, nothing is broadcast by the size of compressed files."""
    seen = {}
    for module in (graphs, manifest):
        real = module.written
        monkeypatch.setattr(module, "written", lambda df, name, real=real, of=module.__name__: seen.setdefault((of.split(".")[-1], name), _broadcasts(df)) and None or real(df, name))
    graphs.manifest_document(layered(spark, sf))
    doc = {"metadata": {}, "nodes": {"model.p.a": {"name": "a", "resource_type": "model"}, "test.p.t": {"name": "t", "resource_type": "test", "depends_on": {"nodes": ["model.p.a"]}}}}
    manifest.manifest_text(spark, json.dumps(doc))
    # one: the exposures, of which the graph has 16
    assert (seen["graphs", "members"], seen["manifest", "edges"], seen["manifest", "tests"]) == (1, 0, 0), seen
