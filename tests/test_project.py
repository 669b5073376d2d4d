"""A project tree read without compiling, against the same project as a manifest."""

from tributary.operators import lineage, select
from tributary.sources import project

FILES = {
    "dbt_project.yml": "name: shop\nvars: {use_old: false}\nmodels:\n  shop:\n    +tags: [all]\n    marts:\n      +materialized: table\n      +tags: late\n",
    "models/staging/stg_a.sql": "{{ config(materialized='view', tags=['x']) }}\nselect * from {{ source('raw', 't') }} {# {{ ref('nothing') }} #}",
    "models/marts/fct_b.sql": "select id, v as w from {{ ref('stg_a') }} join {{ ref('codes') }} using (id)",
    "models/marts/off.sql": "{{ config(enabled=false) }} select 1 as k",
    "models/marts/old.sql": "{{ config(enabled=\"var('use_old')\") }} select 1 as k from {{ ref('missing') }}",
    "models/marts/pm.py": "def model(dbt, session):\n    dbt.config(materialized='table')\n    return dbt.ref('fct_b')\n",
    "seeds/codes.csv": "id,label\n1,a\n",
    "snapshots/s.sql": "{% snapshot snap %}{{ config(unique_key='id') }} select * from {{ ref('fct_b') }}{% endsnapshot %}",
    "macros/m.sql": "{% macro outer(a, b=1) %}{{ inner(a) }}{% endmacro %}{% macro inner(x) %}x{% endmacro %}",
    "models/docs.md": "{% docs __overview__ %}Welcome{% enddocs %}",
    "models/s.yml": """
sources:
  - name: raw
    freshness: {warn_after: {count: 2, period: day}}
    tables:
      - name: t
        columns: [{name: id}, {name: v, description: A value}]
models:
  - name: fct_b
    description: Facts
    config: {meta: {owner: ann}, contract: {enforced: true}}
    columns:
      - name: id
        data_type: int
        tests: [unique, not_null, {relationships: {to: ref('stg_a'), field: id}}]
  - name: no_such_file
exposures:
  - name: board
    type: dashboard
    owner: {name: Ann}
    depends_on: [ref('fct_b')]
""",
}


def test_project(spark, tmp_path):
    root = tmp_path / "shop_project"
    for path, text in FILES.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    b = project.load_project(spark, str(root))
    nodes = {r["unique_id"]: r for r in b.nodes.collect()}
    assert set(nodes) == {"model.shop.stg_a", "model.shop.fct_b", "model.shop.pm", "seed.shop.codes", "snapshot.shop.snap", "source.shop.raw.t", "exposure.shop.board"}
    assert nodes["model.shop.fct_b"]["materialized"] == "table" and nodes["model.shop.stg_a"]["materialized"] == "view" and nodes["model.shop.stg_a"]["path"] == "staging/stg_a.sql"
    assert {(r["parent"], r["child"]) for r in b.edges.collect()} == {
        ("source.shop.raw.t", "model.shop.stg_a"), ("model.shop.stg_a", "model.shop.fct_b"), ("seed.shop.codes", "model.shop.fct_b"), ("model.shop.fct_b", "model.shop.pm"),
        ("model.shop.fct_b", "snapshot.shop.snap"), ("model.shop.fct_b", "exposure.shop.board"),
    }
    d = {r["unique_id"]: r for r in b.detail.collect()}
    assert d["model.shop.stg_a"]["tags"] == ["all", "x"] and d["model.shop.fct_b"]["tags"] == ["all", "late"]
    assert d["model.shop.fct_b"]["meta"] == {"owner": "ann"} and d["model.shop.fct_b"]["contract_enforced"] and d["model.shop.fct_b"]["description"] == "Facts"
    assert d["source.shop.raw.t"]["warn_after"]["count"] == 2 and d["snapshot.shop.snap"]["unique_key"] == ["id"] and d["model.shop.pm"]["language"] == "python"
    assert {(r["kind"], r["column_name"], r["ref_uid"], r["ref_column"]) for r in b.tests.collect()} == {("unique", "id", None, None), ("not_null", "id", None, None), ("relationships", "id", "model.shop.stg_a", "id")}
    assert [r["name"] for r in b.columns.where("unique_id = 'seed.shop.codes'").orderBy("pos").collect()] == ["id", "label"]
    assert [tuple(r) for r in b.macro_edges.collect()] == [("macro.shop.outer", "macro.shop.inner")]
    assert b.overview == "Welcome" and b.warnings == []
    assert sorted(r["unique_id"] for r in select.select(b, "tag:late,+board").collect()) == ["model.shop.fct_b"]
    up = {(r["node"], r["column"]) for r in lineage.column_closure(lineage.column_edges(b), "model.shop.fct_b", "w").collect()}
    assert ("source.shop.raw.t", "v") in up
    on = project.load_project(spark, str(root), {"use_old": True})
    assert "model.shop.old" in {r["unique_id"] for r in on.nodes.collect()} and on.warnings == ["1 references name nothing in the project"]


def test_enabled():
    v = {"a": True, "b": "x", "n": 3}
    assert project.enabled("{{ var('a') }}", v) and not project.enabled("{{ not var('a') }}", v) and not project.enabled("var('b') == 'y'", v)
    assert project.enabled("var('zzz')", v) and project.enabled("target.name == 'x'", v) and not project.enabled("var('zzz', false)", v)
    assert project.enabled("var('n') in [1, 3] and var('a') | as_bool", v) and not project.enabled(False, v) and not project.enabled("false", v)
