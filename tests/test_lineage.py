"""SQL text analysis and column lineage on small projects."""

import pytest

from tributary.functions import sql_fixes
from tributary.functions import sql_text as S
from tributary.operators import diff, lineage, lint
from tributary.plans.bundle import SCHEMAS, bundle

PARENTS = {"ref:a": ("m.a", ["id", "x", "y"]), "ref:b": ("m.b", ["id", "z"]), "source:s.t": ("s.t", None)}
A, B = "{{ ref('a') }}", "{{ ref('b') }}"


def edges(sql):
    return {tuple(e[:4]) for e in S.edges_of(S.analyse(sql, PARENTS))}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        (f"select * from {A}", {("m.a", c, c, "passthrough") for c in ("id", "x", "y")}),
        (f"select x as q from {A}", {("m.a", "x", "q", "rename")}),
        (f"select a.x + b.z as q from {A} a cross join {B} b", {("m.a", "x", "q", "transform"), ("m.b", "z", "q", "transform")}),
        (f"select x from {A} where y > 1", {("m.a", "x", "x", "passthrough"), ("m.a", "y", "x", "filter_or_join")}),
        (f"select * except (x) from {A}", {("m.a", "id", "id", "passthrough"), ("m.a", "y", "y", "passthrough")}),
        (f"select id from {A} union all select z from {B}", {("m.a", "id", "id", "passthrough"), ("m.b", "z", "id", "rename")}),
        (f"select id from {A} except select id from {B}", {("m.a", "id", "id", "passthrough"), ("m.b", "id", "id", "filter_or_join")}),
        (f"with q(k) as (select upper(x) from {A}) select k from q", {("m.a", "x", "k", "transform")}),
        (f"select (select max(z) from {B} b where b.id = a.id) m from {A} a", {("m.b", "z", "m", "transform"), ("m.b", "id", "m", "filter_or_join"), ("m.a", "id", "m", "filter_or_join")}),
        ("select t.foo from {{ source('s', 't') }} t", {("s.t", "foo", "foo", "passthrough")}),
        (f"select date_trunc(month, x) as mm from {A}", {("m.a", "x", "mm", "transform")}),
        (f"select x, v from {A} lateral view explode(y) t as v", {("m.a", "x", "x", "passthrough"), ("m.a", "y", "v", "transform")}),
        (f"select {{% if var('p') %}} x {{% else %}} y {{% endif %}} as q from {A}", {("m.a", "x", "q", "rename")}),
        (f"select x + 1 as q, q * 2 as r from {A}", {("m.a", "x", "q", "transform"), ("m.a", "x", "r", "transform")}),
        (f"select row_number() over (partition by id order by y) as n from {A} qualify x = 1", {("m.a", "id", "n", "transform"), ("m.a", "y", "n", "transform"), ("m.a", "x", "n", "filter_or_join")}),
    ],
)
def test_edges(sql, want):
    assert edges(sql) == want


def facts(sql, trusted=("m.a",)):
    return S.analyse(sql, PARENTS, trusted).facts


def test_facts():
    assert facts(f"select * from {A}").wildcard
    assert not facts(f"with q as (select * from {A}) select id from q").wildcard
    assert facts(f"select 1 as k from {A} a, {B} b").cartesian == 1
    assert facts(f"select 1 as k from {A} a, {B} b where a.id = b.id").cartesian == 0
    assert facts(f"select 1 as k from {A} a join {B} b on 1 = 1").cartesian == 1
    assert facts(f"select 1 as k from {A} a cross join {B} b").cartesian == 0
    assert facts(f"with q as (select 1 as k), r as (select 2 as k) select k from r").unused_ctes == ["q"]
    assert facts(f"select id from {A} order by id").order_without_limit
    assert not facts(f"select id from {A} order by id limit 3").order_without_limit
    assert facts(f"select id from {A} order by id offset 3").order_without_limit
    assert facts(f"select id, x as id from {A}").duplicates == ["id"]
    assert facts(f"select a.nope from {A} a").unknown == [("m.a", "nope")]
    assert facts(f"select b.nope from {B} b").unknown == []
    assert facts("select k from raw.orders").hard_coded == ["raw.orders"]
    with pytest.raises(S.Unreadable):
        S.analyse("drop table x", PARENTS)
    with pytest.raises(S.Unreadable):
        S.analyse("select " + "(" * 600 + "1" + ")" * 600, PARENTS)


def test_calls_and_masks():
    text = "{# {{ ref('gone') }} #} select * from {{ ref('p', 'a', v=2) }} {% if x %} join {{ source('s', 't') }} {% endif %} -- ref\n{{ ref(var('q')) }}"
    found = S.calls(text)
    assert [(c.head, c.arguments, c.version, c.conditional) for c in found] == [("ref", ("p", "a"), "2", False), ("source", ("s", "t"), None, True)]
    assert len(S.masked(text)) == len(text) and "gone" not in S.masked(text)


def test_name_match():
    got = S.name_match("select ((id from {{ ref('a') }} where y", ["id", "x"], [("m.a", ["id", "x", "y"])])
    assert {(e.from_col, e.to_col, e.kind) for e in got} >= {("id", "id", "passthrough")}
    got = S.name_match(f"select id, x as q, upper(x) as u from {A} where y = 1", ["id", "q", "u"], [("m.a", ["id", "x", "y"])])
    assert {(e.from_col, e.to_col, e.kind) for e in got} == {("id", "id", "passthrough"), ("x", "q", "rename"), ("x", "u", "transform"), ("y", "id", "filter_or_join"), ("y", "q", "filter_or_join"), ("y", "u", "filter_or_join")}


@pytest.fixture(scope="module")
def project(spark):
    def make(code_of_c):
        nodes = [("source.p.raw.t", "t", "source"), ("model.p.a", "a", "model"), ("model.p.b", "b", "model"), ("model.p.c", "c", "model"), ("model.p.d", "d", "model")]
        node = spark.createDataFrame([(u, n, t, f"staging/{n}.sql", "view") for u, n, t in nodes], "unique_id string, name string, resource_type string, path string, materialized string")
        edge = spark.createDataFrame([("source.p.raw.t", "model.p.a"), ("model.p.a", "model.p.b"), ("model.p.b", "model.p.c"), ("model.p.c", "model.p.d")], "parent string, child string")
        cols = spark.createDataFrame([("source.p.raw.t", i, n, "text", None, None) for i, n in enumerate(("id", "v", "w"))] + [("model.p.c", i, n, "text", None, None) for i, n in enumerate(("id", "vv"))], "unique_id string, pos int, name string, data_type string, description string, constraints array<struct<type:string,name:string,expression:string,to:string,to_columns:array<string>,columns:array<string>>>")
        code = [("model.p.a", "select * from {{ source('raw', 't') }}"), ("model.p.b", "select id, upper(v) as v2, w from {{ ref('a') }}"), ("model.p.c", code_of_c), ("model.p.d", "select id, vv as last from {{ ref('c') }} order by id")]
        sql = spark.createDataFrame([(u, c, None, False) for u, c in code], "unique_id string, raw_code string, compiled_code string, stale boolean")
        detail = spark.createDataFrame([(u,) for u, _, _ in nodes], "unique_id string")
        b = bundle(spark, node, edge, columns=cols, node_sql=sql)
        return b.with_(detail=b.detail.unionByName(detail, allowMissingColumns=True))

    return make


def test_column_edges(spark, project):
    b = project("select id, v2 as vv from {{ ref('b') }} where w > 0")
    lists = {r["unique_id"]: r["columns"] for r in lineage.column_lists(b).collect()}
    assert lists["model.p.a"] == ["id", "v", "w"] and lists["model.p.b"] == ["id", "v2", "w"] and lists["model.p.d"] == ["id", "last"]
    e = lineage.column_edges(b).cache()
    up = {(r["node"], r["column"], r["depth"]) for r in lineage.column_closure(e, "model.p.d", "last").collect()}
    # d sorts by c.id, which feeds d.id already, so only c's filter on w shapes the rows
    assert {u[:2] for u in up} == {("model.p.c", "vv"), ("model.p.b", "v2"), ("model.p.b", "w"), ("model.p.a", "v"), ("model.p.a", "w"), ("source.p.raw.t", "v"), ("source.p.raw.t", "w")}
    report = {(r["node"], r["column"]): r for r in lineage.closure_report(e, "model.p.d", "last").collect()}
    assert report["model.p.b", "w"]["kinds"] == ["filter_or_join"] and report["model.p.a", "v"]["via"] == ["model.p.b.v2"]
    down = {(r["node"], r["column"]) for r in lineage.column_closure(e, "source.p.raw.t", "v", "down").collect()}
    assert ("model.p.d", "last") in down and ("model.p.b", "v2") in down and ("model.p.b", "id") not in down
    facts = lineage.sql_facts(b)
    found, skipped = lint.findings(b, facts=facts, only=["order_by_without_limit", "select_star", "warehouse_type_drift"])
    assert {(r["rule"], r["unique_id"]) for r in found.collect()} == {("order_by_without_limit", "model.p.d"), ("select_star", "model.p.a")}
    assert skipped == [("warehouse_type_drift", "needs catalog")]
    assert [r["unique_id"] for r in lint.RULES["unresolved_references"].run(project("select 1 as id from {{ ref('zzz') }}"), {}).collect()] == ["model.p.c"]


def test_column_diff(spark, project):
    old = project("select id, v2 as vv from {{ ref('b') }}")
    new = project("select id, v2 as renamed, w as fresh from {{ ref('b') }}")
    later = new.with_(columns=new.columns.where("unique_id <> 'model.p.c'").unionByName(spark.createDataFrame([("model.p.c", i, n, "text", None, None) for i, n in enumerate(("id", "renamed", "fresh"))], new.columns.schema)))
    eo, en = lineage.column_edges(old).cache(), lineage.column_edges(later).cache()
    changes = diff.column_changes(old, later, eo, en)
    got = {(r["unique_id"], r["column"], r["change"], r["was"], r["severity"]) for r in diff.affected(changes, eo).collect()}
    assert got == {("model.p.c", "renamed", "renamed", "vv", "breaking"), ("model.p.c", "fresh", "added", None, "non-breaking")}
    dead = diff.dead_columns(spark.createDataFrame([("model.p.c", "vv")], "node string, col string"), eo)
    assert {tuple(r) for r in dead.collect()} == {("model.p.c", "vv"), ("model.p.d", "last")}


ARMS = "{% if a %} {{ source('s', 't') }} {% elif b %} {{ source('s', 'u') }} {% else %} {% for i in z %} {{ source('s', 'v') }} {% endfor %} {% endif %}"


@pytest.mark.parametrize(
    ("sql", "tables", "want"),
    [
        (ARMS, "tuv", False),
        (ARMS + " {{ source('s', 'w') }}", "tw", True),
        (ARMS + " {{ source('s', 't') }}", "tu", True),  # t is read again outside the block
        (ARMS, "tx", True),  # nothing tells where x is read
        ("{% if a %}{{ source('s', 't') }}{% endif %}{% if b %}{{ source('s', 'u') }}{% endif %}", "tu", True),
        ("{# {% if a %} #}{{ source('s', 't') }}{# {% else %} #}{{ source('s', 'u') }}", "tu", True),
    ],
)
def test_exclusive_arms(sql, tables, want):
    assert S.read_together(sql, [f"source.p.s.{t}" for t in tables]) is want


def fixed(sql, *rules):
    return sql_fixes.fix(sql, rules, lambda t: S.analyse(t, PARENTS))


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        (f"select id from {A} ;\n;  -- end;\n", f"select id from {A}   -- end;\n"),
        (f"with q as (select 1 as k), r as (select id from {A})\nselect id from r;", f"with r as (select id from {A})\nselect id from r"),
        (f"with r as (select id from {A}), q as (select ')' as k) select id from r;", f"with r as (select id from {A}) select id from r"),
        (f"with q as (select 1 as k) select id from {A};", f"select id from {A}"),
        (f"with p as (select 1 as k), q as (select k from p), r as (select id from {A}) select id from r;", f"with r as (select id from {A}) select id from r"),
        (f"with r as (with q as (select 1 as k) select id from {A}) select id from r;", f"with r as (select id from {A}) select id from r"),
    ],
)
def test_fixes(sql, want):
    done = fixed(sql, "trailing_semicolon", "unused_cte")
    assert done.text == want and not [r for r in done.refused if r[0] == "trailing_semicolon"]


@pytest.mark.parametrize(
    ("sql", "rule", "why"),
    [
        ("select 1 as id {{ f(';') }}", "trailing_semicolon", "template tag"),
        (f"with q as (select 1 as k) {{% if x %}} select id from {A} {{% else %}} select k as id from q {{% endif %}}", "unused_cte", "used elsewhere"),
        (f"with q as (select 1 as k /* why */) select id from {A}", "unused_cte", "comment"),
        (f"with q as (select 1 as k) select id from {A} where {{{{ some_macro() }}}}", "unused_cte", "template expression"),
        (f"{{% if x %}} with q as (select 1 as k) {{% endif %}} select id from {A}", "unused_cte", "block"),
        ("with q as (select 1", "unused_cte", "unreadable"),
    ],
)
def test_refused_fixes(sql, rule, why):
    done = fixed(sql, rule)
    assert done.text == sql and not done.applied and [(r, why in w) for r, w in done.refused] == [(rule, True)]


def test_sources_that_never_meet(spark):
    ids = ["source.p.s.t", "source.p.s.u", "source.p.s.v"]
    nodes = [(u, u[-1], "source", f"s/{u}", None) for u in ids] + [(f"model.p.{n}", n, "model", f"models/{n}.sql", "view") for n in ("apart", "both")]
    edges = [(u, f"model.p.{n}") for u in ids for n in ("apart", "both")]
    table = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    b = bundle(spark, nodes=table("nodes", nodes), edges=table("edges", edges), node_sql=table("node_sql", [("model.p.apart", ARMS, None, False), ("model.p.both", ARMS + " {{ source('s', 't') }}", None, False)]))
    assert [(r["unique_id"], r["related"]) for r in lint.RULES["multiple_sources_joined"].run(b, {}).collect()] == [("model.p.both", ids)]
