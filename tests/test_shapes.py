"""Column edges of texts that are read once for all models of their shape, and column changes without Python."""

import pytest
from pyspark.sql import functions as F

from tributary.operators import diff, lineage
from tributary.plans import graphs, queries, workloads  # noqa: F401  (workloads adds to the pack)
from tributary.plans.bundle import SCHEMAS, bundle
from tributary.plans.queries import QUERIES, layered
from tributary.session import written

A, B, Z, S = "{{ ref('alpha') }}", "{{ ref('beta') }}", "{{ ref('zeta') }}", "{{ source('s', 'theta') }}"
#: What is shaped, and what has to be read as it is.
SHAPED = [
    f"select id, x from {A}", f"select id, x from {Z}", f"select p.id, q.z from {A} p join {B} q on p.id = q.id where q.z > 1", f"select * from {A}",
    f"select u.id as k, v.id from {A} u, {A} v", f"select t1.foo, k.id from {S} t1 join {{{{- ref('pkg', 'beta') -}}}} k using (id)", f"-- {A}\nselect upper(x) as n from {A} qualify y = 1",
    f"with q as (select id from {B}) select id, '{A}' as said from q", "select 1 as one", f"select p.* from {A} p left join {B} on p.id = 2",
]
PLAIN = [
    f"select alpha.id, x from {A}", f"select id as alpha from {A}", f"select ALPHA.x, beta.z from {A} join {B} on alpha.id = beta.id", "select id, x from {{ ref(\"alpha\") }}", "select id from {{ ref('nothing') }}",
    f"{{# {B} #}} select id from {A}", f"select {{% if v %}} x {{% else %}} y {{% endif %}} as q from {A}", f"select id from {A} {{{{ var('beta') }}}}", f"drop table {A}", f"select * from {S}",
    f"select beta.id from {B} beta", "select id from {{ source('s') }}", "select id from db.sch.alpha", "select \u0001 from x", f"select id from {A} join db.sch.alpha a2 on true", "", "select id from {{ source('s', 'alpha') }} join {{ ref('alpha') }} on true",
]


def _project(spark):
    models = [(f"model.p.m{k}", f"m{k}", text) for k, text in enumerate(SHAPED + PLAIN)]
    up = [("model.p.a", "alpha", "model"), ("model.p.b", "beta", "model"), ("model.p.z", "zeta", "model"), ("source.p.s.t", "theta", "source"), ("source.p.s.a", "alpha", "source")]
    nodes = spark.createDataFrame([(u, n, t, "", "view") for u, n, t in up + [(u, n, "model") for u, n, _ in models]], SCHEMAS["nodes"])
    edges = spark.createDataFrame([(p, u) for u, _, _ in models for p, _, _ in up], SCHEMAS["edges"])
    lists = {"model.p.a": ["id", "x", "y"], "model.p.b": ["id", "z"], "model.p.z": ["id", "x"], "source.p.s.a": ["id"]}
    columns = spark.createDataFrame([(u, k, c, "int", None, []) for u, cs in lists.items() for k, c in enumerate(cs)] + [(u, 0, "id", "int", None, []) for u, _, _ in models], SCHEMAS["columns"])
    sql = spark.createDataFrame([(u, text, None, k % 3 == 0) for k, (u, _, text) in enumerate(models)], SCHEMAS["node_sql"])
    detail = spark.createDataFrame([("model.p.a", True, "db.sch.alpha"), ("model.p.b", False, None)], "unique_id string, contract_enforced boolean, relation_name string")
    wide = spark.createDataFrame([], SCHEMAS["detail"])
    return bundle(spark, nodes, edges, columns=columns, node_sql=sql, detail=wide.unionByName(detail, allowMissingColumns=True))


def test_shaped_edges_are_those_of_each_text(spark):
    b = _project(spark)
    tasks = lineage._tasks(b, lineage.column_lists(b))
    want = {tuple(r) for r in tasks.mapInPandas(lineage._edge_rows, lineage.EDGES).distinct().collect()}
    got = [tuple(r) for r in lineage.column_edges(b).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    keys = {r["unique_id"]: r["key"] for r in lineage._shaped(tasks).collect()}
    assert all(keys[f"model.p.m{k}"] for k in range(len(SHAPED))), keys
    # a name that means more than the call, a template that does more, a parent that isn't found
    none = [len(SHAPED) + k for k, text in enumerate(PLAIN) if text not in ("", f"drop table {A}", f"select * from {S}")]
    assert not any(keys[f"model.p.m{k}"] for k in none), [((SHAPED + PLAIN)[k]) for k in none if keys[f"model.p.m{k}"]]


def test_texts_of_one_node_dont_repeat_edges(spark):
    b = _project(spark)
    twice = b.with_(node_sql=b.node_sql.unionByName(b.node_sql.where("unique_id = 'model.p.m0'")))
    assert sorted(map(tuple, lineage.column_edges(twice).collect())) == sorted(map(tuple, lineage.column_edges(b).collect()))


def test_equal_shapes_arent_read_model_by_model(spark, sf, monkeypatch):
    def fail(*_):
        raise AssertionError("every text was read")

    monkeypatch.setattr(lineage, "_edge_rows", fail)
    assert lineage.column_edges(graphs.with_joined_code(layered(spark, sf))).count() > 5000


def test_renames_are_greedy_without_python(spark):
    column = lambda names: spark.createDataFrame([("m", n) for n in names], "unique_id string, column string")
    edge = lambda rows: spark.createDataFrame([("p", f, "m", t, "rename", "exact") for f, t in rows], lineage.EDGES)
    old = edge([("1", "a"), ("2", "a"), ("1", "b"), ("3", "c")])
    new = edge([("1", "q"), ("1", "r"), ("2", "r"), ("3", "q"), ("9", "s")])
    out = diff.rename_pairs(column("abcd"), column("qrs"), old, new)
    assert {tuple(r) for r in out.collect()} == {("m", "a", "r", 2), ("m", "b", "q", 1)}
    assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("modified", [False, True])
def test_names_equal_once_normalized(spark, modified):
    """Two columns of one normalized name show a change of type where their node is modified, and only there."""
    nodes = lambda m: spark.createDataFrame([("model.p.a", "a", "model", "", m)], SCHEMAS["nodes"])
    columns = spark.createDataFrame([("model.p.a", 0, "ID", "int", None, []), ("model.p.a", 1, "id", "text", None, [])], SCHEMAS["columns"])
    b = bundle(spark, nodes("view"), spark.createDataFrame([], SCHEMAS["edges"]), columns=columns)
    none = spark.createDataFrame([], lineage.EDGES)
    found = diff.column_changes(b, b.with_(nodes=nodes("table" if modified else "view")), none, none)
    assert sorted((r["change"], r["was"]) for r in found.collect()) == ([("type", "int"), ("type", "text")] if modified else [])


def test_column_changes_dont_describe_every_node(spark, sf, monkeypatch):
    """Unlike column lists say by themselves that a node is modified."""
    def fail(*_):
        raise AssertionError("every node was described")

    base = layered(spark, sf)
    monkeypatch.setattr(diff, "_described", fail)
    none = written(spark.createDataFrame([], lineage.EDGES), "none")
    found = diff.column_changes(base, graphs.mutated(base, sf, write_edges=False), none, none)
    assert {r["change"] for r in found.groupBy("change").agg(F.count("*")).collect()} == {"added", "removed", "type"}


def test_severities_are_walked_once(spark, sf, monkeypatch):
    """Both queries read one table; the walk was made for each."""
    walks, real = [], diff.affected
    monkeypatch.setattr(diff, "affected", lambda *a: walks.append(1) or real(*a))
    queries._built.pop((spark.sparkContext.applicationId, sf, "severities"), None)
    assert QUERIES["column_severities"](spark, sf).where("severity = 'breaking'").count() == QUERIES["breaking_columns"](spark, sf).count() > 0
    assert len(walks) == 1


def test_columns_are_dealt_to_fixed_tasks(spark, sf):
    """Shuffles of a fixed number aren't merged by compressed size, which made tasks run out of memory at 60 x sf0.1."""
    plan = graphs.mutated(layered(spark, sf), sf, write_edges=False).columns._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan, plan
