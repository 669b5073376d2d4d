"""Further queries of the pack: artifacts read back, column changes, rules on SQL text, references, names, types, macros."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import globs
from tributary.functions import names as N
from tributary.functions.types import DIALECTS, FAMILIES, types_equivalent
from tributary.operators import attributes, diff, impact, lineage, lint, select, traverse
from tributary.plans import graphs
from tributary.plans.bundle import Bundle
from tributary.plans.layered_sql import LATER, B, over
from tributary.plans.queries import _COLUMN_EDGES, _LINT, _ROOT, _changes, _column_edges, _once, later, layered, query
from tributary.session import shared_dir, table, written
from tributary.sources import manifest, reports

# --- artifacts ------------------------------------------------------------------------------------------------------


def _read_back(spark: SparkSession, sf_dir: str) -> Bundle:
    """The layered graph written as a manifest, in parts, and read by the manifest reader."""

    def make() -> Bundle:
        path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
        graphs.manifest_document(layered(spark, sf_dir)).write.text(path)
        return manifest.manifest(spark, path)

    return _once(spark, sf_dir, "read_back", make)  # type: ignore[return-value]


@query("manifest_nodes", over(B, query="select unique_id, name, resource_type, path, materialized from nodes"))
def manifest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir).nodes


@query("manifest_edges", over(B, query="select parent, child from edges"))
def manifest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir).edges


@query("manifest_columns", over(B, query="select unique_id, pos, name, data_type, nullif(trim(description), '') as description from cols"))
def manifest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir).columns.drop("constraints")


@query("manifest_tests", over(B, query="select unique_id, kind, column_name from tests"))
def manifest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir).tests.select("unique_id", "kind", "column_name")


@query("manifest_details", over(B, query="""select unique_id, case when k % 5 <> 0 then 'About ' || name end as description, case when k % 2 = 0 then 'nightly' else 'hourly' end || case when k % 5 = 0 then ',core' else '' end as tags,
 case when k % 6 <> 1 then 'team_' || (k % 4) end as owner, case k % 4 when 0 then 'public' when 1 then 'private' when 2 then 'protected' end as access, k % 6 = 0 as contract,
 case when k % 8 = 3 then 'id' else '' end as unique_key, 'models/' || dir || '/' || name || '.sql' as file, cast(null as bigint) as warn_count from m
 union all select unique_id, case when j % 2 = 0 then 'Raw table' end, '', null, null, null, '', null, case when j % 3 = 0 then 12 end from src
 union all select unique_id, case when i % 3 <> 0 then 'A dashboard' end, '', null, null, null, '', null, null from expo"""))  # fmt: skip
def manifest_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",").alias(c)
    return _read_back(spark, sf_dir).detail.select(
        "unique_id", "description", joined("tags"), F.col("meta")["owner"].alias("owner"), "access", F.col("contract_enforced").alias("contract"), joined("unique_key"),
        F.col("original_file_path").alias("file"), F.col("warn_after.count").alias("warn_count"),
    )


@query("manifest_exposures", over(B, query="select unique_id, 'dashboard' as exposure_type, 'team_' || (i % 3) as owner_name from expo"))
def manifest_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir).exposures.select("unique_id", "exposure_type", "owner_name")


@query("catalog_columns", "select 'model.p.t' || p_partkey as unique_id, c as \"column\", 'T' || (p_partkey % 3) as data_type from part, (values ('ID'), ('v')) v(c)")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir)[0]


@query("catalog_readouts", "select 'model.p.t' || p_partkey as unique_id, cast(case when p_partkey % 2 = 0 then p_partkey else p_partkey + 1 end as bigint) as row_count, cast(case when p_partkey % 3 = 0 then p_partkey * 8 end as bigint) as size_bytes from part")
def catalog_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.catalog_readouts(layered(spark, sf_dir).with_(catalog_stats=_catalog(spark, sf_dir)[1]))


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A catalog document of one table for each part: rows under one of two names, bytes of every third."""
    entry = F.expr("""concat('"model.p.t', k, '":{"columns":{"ID":{"type":"T', k % 3, '"},"v":{"type":"T', k % 3, '"}},"stats":{',
        if(k % 2 = 0, concat('"row_count":{"value":', k, ',"include":true}'), concat('"num_rows":{"value":', k + 1, '},"hidden":{"value":1,"include":false}')),
        if(k % 3 = 0, concat(',"bytes":{"value":', k * 8, '}'), ''), '}}')""")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).select(entry.alias("e"))
    text = rows.agg(F.concat(F.lit('{"sources":{},"nodes":{'), F.array_join(F.collect_list("e"), ","), F.lit("}}")).alias("value"))
    return manifest.catalog_document(text)


@query("run_results", "select 'model.p.t' || p_partkey as unique_id, case p_partkey % 3 when 0 then 'error' when 1 then 'success' else 'warn' end as status, cast(p_partkey % 7 as double) + 0.5 as execution_time from part")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part has two results, of which the later one counts."""
    entry = F.expr("""concat('{"unique_id":"model.p.t', k, '","status":"', if(n = 0, 'skipped', element_at(array('error', 'success', 'warn'), cast(k % 3 + 1 as int))), '","execution_time":', if(n = 0, '9', concat(k % 7, '.5')), '}')""")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).select("n", "k", entry.alias("e"))
    text = rows.agg(F.concat(F.lit('{"results":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "e"))), lambda x: x["e"]), ","), F.lit("]}")).alias("value"))
    return manifest.run_results_document(text)


# --- nodes ----------------------------------------------------------------------------------------------------------

_SEED = "(select unique_id from m where layer = 'staging' and k = 3)"


@query("impact_breakdown", over(B, f"d(node) as (select unique_id from {_SEED} union select e.child from d join edges e on e.parent = d.node)", f"u(node) as (select unique_id from {_SEED} union select e.parent from u join edges e on e.child = u.node)", query="""select
 (select count(*) from d where node not like 'exposure.%') - 1 as downstream, (select count(*) from d where node like 'exposure.%') as exposures, (select count(*) from u) - 1 as upstream"""))  # fmt: skip
def impact_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return attributes.impact_breakdown(b, b.nodes.where("name = 'stg_00003'").first()["unique_id"])


_TWO = "(select unique_id from m where layer = 'staging' and k in (2, 3))"


@query("neighbourhood_edges", over(B, f"d(node) as (select unique_id from {_TWO} union select e.child from d join edges e on e.parent = d.node)", f"u(node) as (select unique_id from {_TWO} union select e.parent from u join edges e on e.child = u.node)", query="""select parent, child from edges
 where parent in (select node from d union select node from u) and child in (select node from d union select node from u)"""))  # fmt: skip
def neighbourhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return traverse.subgraph(b.nodes, b.edges, b.nodes.where("name in ('stg_00002', 'stg_00003')"))[1]


@query("kept_edges", over(B, "t as (select unique_id from m where k % 5 = 0)", query="select parent, child from edges where parent in (select unique_id from t) and child in (select unique_id from t)"))
def kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return attributes.kept(b, b.nodes.join(select.select(b, "tag:core"), "unique_id", "left_semi")).edges


@query("model_list_by_owner", over(B, """t as (select unique_id, count(*) as c from tests group by 1)""", query="""select case when k % 6 <> 1 then 'team_' || (k % 4) end as grp, cast(k % 6 = 1 as int) as grp_rank, name as list_name, m.unique_id,
 row_number() over (partition by case when k % 6 <> 1 then k % 4 end order by coalesce(t.c, 0) desc, name, m.unique_id) as row_in_group from m left join t on t.unique_id = m.unique_id"""))  # fmt: skip
def model_list_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.model_list(layered(spark, sf_dir), group_by="meta:owner", key="tests")


@query("listing", over(B, query="""select '{"unique_id":"' || unique_id || '","name":"' || name || '","resource_type":"model"}' as line from m where k % 5 = 0"""))
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.listing(select.listed(layered(spark, sf_dir), ["tag:core"]), "json")


@query("listing_selector", over(B, query="select string_agg(name, ' ' order by name) as line from m where k % 5 = 0"))
def listing_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.listing(select.listed(layered(spark, sf_dir), ["tag:core"]), "selector")


@query("diagram", over(B, "s as (select unique_id, name from nodes where resource_type = 'exposure' union all select unique_id, name from m where layer = 'marts' and k < 50)", query="""select 0 as part, 'graph LR' as line
 union all select 1, '    ' || name || '["' || name || '"]' from s union all select 2, '    ' || p.name || ' --> ' || c.name from edges e join s p on p.unique_id = e.parent join s c on c.unique_id = e.child"""))  # fmt: skip
def diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    nodes = b.nodes.where("resource_type = 'exposure' or (name rlike '^(fct|dim|mar)_000[0-4][0-9]$')")
    return reports.mermaid(nodes, traverse.pruned(b.edges, nodes))


@query("box_layout", over(B, "r(node, col) as (select unique_id, 0 from nodes where unique_id not in (select child from edges) union select e.child, r.col + 1 from r join edges e on e.parent = r.node)", "lv as (select node, max(col) as col from r group by 1)", query="""select unique_id, col as x,
 row_number() over (partition by col order by name, unique_id) - 1 as y from nodes join lv on node = unique_id"""))  # fmt: skip
def box_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return reports.boxes(b.nodes, b.edges).select("unique_id", F.col("x").cast("long"), F.col("y").cast("long"))


@query("exposure_notes", over(B, query="select unique_id, ' (dashboard, owner: team_' || (i % 3) || ')' as note from expo"))
def exposure_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).exposures.select("unique_id", impact.exposure_note(F.col("exposure_type"), F.col("owner_name"), F.col("owner_email")).alias("note"))


# --- changes --------------------------------------------------------------------------------------------------------

_ALIVE = "alive as (select m.unique_id, m.idx, exists (select 1 from pr where pr.child = m.unique_id) as fed from m where idx % 211 <> 0)"
_CHANGED = """chg as (select unique_id, 'extra' as col, 'added' as change, null as was from alive where idx % 47 = 0 union all select unique_id, 'c0000', 'removed', null from alive where idx % 53 = 0
 union all select unique_id, 'c0000b', 'renamed', 'c0000' from alive where idx % 61 = 0 and idx % 53 <> 0 and fed union all select unique_id, 'c0000b', 'added', null from alive where idx % 61 = 0 and idx % 53 <> 0 and not fed
 union all select unique_id, 'c0000', 'removed', null from alive where idx % 61 = 0 and idx % 53 <> 0 and not fed union all select unique_id, 'id', 'type', 'int' from alive where idx % 59 = 0)"""


def _column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        base, edges = layered(spark, sf_dir), _column_edges(spark, sf_dir)
        current = _once(spark, sf_dir, "later_columns", lambda: graphs.mutated(base, sf_dir, write_edges=False))
        renamed = graphs.renamed_columns(current, sf_dir).select(F.col("unique_id").alias("to_node"), F.lit("c0000").alias("to_col"), F.lit("c0000b").alias("now"))
        after = edges.hint("merge").join(renamed, ["to_node", "to_col"], "left").withColumn("to_col", F.coalesce("now", "to_col")).drop("now")
        return written(diff.column_changes(base, current, edges, after.select(*edges.columns)), "column-changes")

    return _once(spark, sf_dir, "column_changes", make)  # type: ignore[return-value]


@query("column_changes", over(B, _COLUMN_EDGES, _ALIVE, _CHANGED, query="select unique_id, col as \"column\", change, was from chg"))
def column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _column_changes(spark, sf_dir)


_REACHED = """st as (select distinct unique_id, case when change = 'renamed' then was else col end as col from chg),
w(sn, sc, node, col) as (select unique_id, col, unique_id, col from st union select w.sn, w.sc, ce.to_node, ce.to_col from w join ce on ce.from_node = w.node and ce.from_col = w.col),
af as (select sn, sc, count(*) - 1 as n from w group by 1, 2),
sv as (select unique_id, chg.col, change, af.n as affected, case when change in ('removed', 'renamed') and af.n > 0 then 'breaking' when change = 'type' then 'partial' else 'non-breaking' end as severity
 from chg join af on sn = unique_id and sc = case when change = 'renamed' then was else chg.col end)"""


def _severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "severities", lambda: written(diff.affected(_column_changes(spark, sf_dir), _column_edges(spark, sf_dir)), "severities"))  # type: ignore[return-value]


@query("column_severities", over(B, _COLUMN_EDGES, _ALIVE, _CHANGED, _REACHED, query="select unique_id, col as \"column\", change, affected, severity from sv"))
def column_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _severities(spark, sf_dir).select("unique_id", "column", "change", "affected", "severity")


@query("breaking_columns", over(B, _COLUMN_EDGES, _ALIVE, _CHANGED, _REACHED, query="select unique_id, col as \"column\" from sv where severity = 'breaking'"))
def breaking_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _severities(spark, sf_dir).where("severity = 'breaking'").select("unique_id", "column")


@query("dead_columns", over(B, _COLUMN_EDGES, "d(node, col) as (select unique_id, 'c0000' from m where idx % 53 = 0 union select ce.to_node, ce.to_col from d join ce on ce.from_node = d.node and ce.from_col = d.col where kind <> 'filter_or_join')", query="select node, col from d"))
def dead_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    start = graphs._models(spark, sf_dir).where("idx % 53 = 0").select(F.col("unique_id").alias("node"), F.lit("c0000").alias("col"))
    return diff.dead_columns(start.join(b.nodes.select(F.col("unique_id").alias("node")), "node"), _column_edges(spark, sf_dir))


@query("statuses", over(B, LATER, query="""select unique_id, case when unique_id not in (select unique_id from nodes) then 'added' else 'kept' end as side from nodes2"""))
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.statuses(layered(spark, sf_dir), later(spark, sf_dir)).select("unique_id", F.when(F.col("status") == "added", "added").otherwise("kept").alias("side"))


@query("change_counts", over(B, LATER, query="select 'added' as status, count(*) as n from nodes2 where unique_id not in (select unique_id from nodes) union all select 'removed', count(*) from nodes where unique_id not in (select unique_id from nodes2)"))
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).where("status <> 'modified'").groupBy("status").agg(F.count("*").alias("n"))


@query("macro_changes", """with recursive mac as (select n_nationkey as k from nation), r(a, k) as (select k, k from mac union select r.a, (r.k - r.k % 2) / 2 from r where r.k > 0)
 select 'model.p.t' || p_partkey as unique_id, string_agg(distinct 'm_' || r.k, ',' order by 'm_' || r.k) as macros from part join r on r.a = p_partkey % 25 where r.k % 7 = 3 group by 1""")  # fmt: skip
def macro_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros in a binary tree, one for each nation; every seventh changed. A part calls one."""
    k = F.col("n_nationkey").cast("long")
    uid = lambda c: F.concat(F.lit("macro.p.m_"), c.cast("string"))
    nation, null = table(spark, sf_dir, "nation"), F.array().cast("array<string>")
    macros = nation.select(uid(k).alias("uid"), F.concat(F.lit("m_"), k.cast("string")).alias("name"), F.lit("old").alias("sql"), null.alias("params"))
    changed = macros.withColumn("sql", F.when(F.regexp_extract("name", "[0-9]+", 0).cast("int") % 7 == 3, "new").otherwise(F.col("sql")))
    calls = nation.where("n_nationkey > 0").select(uid(k).alias("caller"), uid(F.floor(k / 2).cast("long")).alias("callee"))
    users = table(spark, sf_dir, "part").select(F.concat(F.lit("model.p.t"), F.col("p_partkey").cast("string")).alias("unique_id"), uid(F.col("p_partkey") % 25).alias("macro_uid"))
    b = layered(spark, sf_dir).with_(macros=macros, macro_edges=calls, node_macros=users)
    return diff.changed_macros(b, b.with_(macros=changed)).select("unique_id", F.array_join("macros", ",").alias("macros"))


# --- columns --------------------------------------------------------------------------------------------------------

_FROM = "(select unique_id from m where layer = 'marts' and k = 4)"
_CLOSURE = f"""r(node, col, depth) as (select unique_id, 'c0000', 0 from {_FROM} union select ce.from_node, ce.from_col, r.depth + 1 from r join ce on ce.to_node = r.node and ce.to_col = r.col),
cl as (select node, col, min(depth) as depth from r group by 1, 2)"""


def _mart(spark: SparkSession, sf_dir: str) -> str:
    return layered(spark, sf_dir).nodes.where("name = 'fct_00004'").first()["unique_id"]


@query("closure_report", over(B, _COLUMN_EDGES, _CLOSURE, query="""select cl.node, cl.col as "column", cast(cl.depth as int) as depth, string_agg(distinct t.node || '.' || t.col, ',' order by t.node || '.' || t.col) as via,
 string_agg(distinct kind, ',' order by kind) as kinds, 'exact' as confidence from cl join ce on ce.from_node = cl.node and ce.from_col = cl.col join cl t on t.node = ce.to_node and t.col = ce.to_col where cl.depth > 0 group by 1, 2, 3"""))  # fmt: skip
def closure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lineage.closure_report(_column_edges(spark, sf_dir), _mart(spark, sf_dir), "c0000")
    return out.withColumns({"via": F.array_join("via", ","), "kinds": F.array_join("kinds", ",")})


@query("column_focus_edges", over(B, _COLUMN_EDGES, _CLOSURE, f"s(node, col) as (select unique_id, 'c0000' from {_FROM} union select ce.to_node, ce.to_col from s join ce on ce.from_node = s.node and ce.from_col = s.col)", query="""select parent, child from edges
 where parent in (select node from cl union select node from s) and child in (select node from cl union select node from s)"""))  # fmt: skip
def column_focus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.column_subgraph(layered(spark, sf_dir), _column_edges(spark, sf_dir), _mart(spark, sf_dir), "c0000")[1]


def _faulty(spark: SparkSession, sf_dir: str) -> Bundle:
    return _once(spark, sf_dir, "faulty", lambda: graphs.with_code(layered(spark, sf_dir), sf_dir, graphs.FAULTS))  # type: ignore[return-value]


def _faulty_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "faulty_facts", lambda: written(lineage.sql_facts(_faulty(spark, sf_dir)), "facts"))  # type: ignore[return-value]


_AT = "x as (select m.unique_id, m.k, pr.parent from m join pr on pr.child = m.unique_id and rn = 1)"
#: rule: its remainder of k, and what is related.
ON_TEXT = {
    "select_star": (0, "''"), "cartesian_join": (1, "'1'"), "duplicate_output_columns": (2, "'id'"), "unused_cte": (3, "'r'"), "order_by_without_limit": (4, "''"),
    "unparsable_sql": (5, None), "hard_coded_references": (7, "'raw.orders'"), "model_too_long": (8, "'3'"),
}


def _on_text(rule: str, options: dict) -> query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = lint.RULES[rule].run(_faulty(spark, sf_dir), {"facts": _faulty_facts(spark, sf_dir)} | options)
        related = [] if rule == "unparsable_sql" else [F.array_join("related", ",").alias("related")]
        return found.select("unique_id", *related)

    return run


for _rule, (_k, _related) in ON_TEXT.items():
    _said = f", {_related} as related" if _related else ""
    query(f"text_{_rule}", over(B, _COLUMN_EDGES, _AT, query=f"select unique_id{_said} from x where k % 9 = {_k}"))(_on_text(_rule, {"max_lines": 2} if _rule == "model_too_long" else {}))
query("text_unknown_column_reference", over(B, _COLUMN_EDGES, _AT, query="select x.unique_id, x.parent || '.nope' as related from x join m p on p.unique_id = x.parent where x.k % 9 = 6 and p.k % 6 = 0"))(_on_text("unknown_column_reference", {}))


@query("text_fixes", over(B, _COLUMN_EDGES, _AT, query="select unique_id, 'with q as (select id from x) select id from q' as fixed, 'unused_cte' as applied, 0 as refused from x where k % 9 = 3"))
def text_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _faulty(spark, sf_dir)
    found = lint.RULES["unused_cte"].run(b, {"facts": _faulty_facts(spark, sf_dir)}).withColumn("rule", F.lit("unused_cte"))
    fixed = F.regexp_replace("fixed_code", r"\{\{.*?\}\}", "x").alias("fixed")
    return lineage.fixes(b, found).select("unique_id", fixed, F.array_join("applied", ",").alias("applied"), F.size("refused").alias("refused"))


# --- references -----------------------------------------------------------------------------------------------------


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda: written(lineage.resolved_references(graphs.with_code(layered(spark, sf_dir), sf_dir, graphs.REFERENCES), ["far"]), "calls")
    return _once(spark, sf_dir, "references", make)  # type: ignore[return-value]


_VENDOR = "split_part(unique_id, '.', 2) = 'vendor'"


@query("reference_verdicts", over(B, _COLUMN_EDGES, _AT, query=f"""select unique_id, case when k % 8 in (3, 4) then 'source' else 'ref' end as head,
 case k % 8 when 0 then 'nothing' when 1 then 'stg_00009' when 2 then 'stg_00009' when 3 then 'raw.tbl_3' when 4 then 'raw.none' when 5 then (select name from m where m.unique_id = x.unique_id) when 6 then 'stg_00009' else 'x' end as name,
 false as conditional, case k % 8 when 0 then 'missing' when 1 then case when {_VENDOR} then 'local' else 'foreign' end when 2 then case when {_VENDOR} then 'local' else 'foreign_any' end when 3 then 'local' when 4 then 'missing'
 when 5 then 'local' when 6 then 'missing' else 'foreign' end as verdict, case when k % 8 in (1, 2) and {_VENDOR} then 'model.vendor.stg_00009' when k % 8 = 3 then 'source.bench.raw.tbl_3' when k % 8 = 5 then unique_id end as target from x
 union all select unique_id, 'ref', 'perhaps', true, 'missing', null from x where k % 5 = 0"""))  # fmt: skip
def reference_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).select("unique_id", "head", "name", "conditional", "verdict", "target")


@query("unresolved_references", over(B, _COLUMN_EDGES, _AT, query="select unique_id, case k % 8 when 0 then 'nothing' when 4 then 'raw.none' else 'stg_00009' end as related from x where k % 8 in (0, 4, 6)"))
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.RULES["unresolved_references"].run(layered(spark, sf_dir), {"calls": _references(spark, sf_dir)})
    return found.select("unique_id", F.array_join("related", ",").alias("related"))


@query("reference_universe", over(B, query="select 'ref' as head, name, split_part(unique_id, '.', 2) as package, unique_id as uid from m union all select 'source', 'raw.' || name, 'bench', unique_id from src"))
def reference_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.root_scope(layered(spark, sf_dir)).universe.select("head", "name", "package", "uid")


@query("root_models_in_scope", over(B, _ROOT, query="select unique_id from m where unique_id in (select unique_id from root) and unique_id not in (select child from edges)"))
def root_models_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model whose parents are all cut off by the package scope is no root."""
    return lint.RULES["root_models"].run(attributes.root_scope(layered(spark, sf_dir)), {}).select("unique_id")


# --- findings -------------------------------------------------------------------------------------------------------


def _ignoring(b: Bundle, sf_dir: str) -> Bundle:
    """k % 10 = 1 ignores all rules, 2 one rule, 3 one with a reason, 4 one with a blank reason."""
    said = F.expr("""case k % 10 when 1 then 'all' when 2 then '["undocumented_models"]' when 3 then '{"undocumented_models": "later"}' when 4 then '{"undocumented_models": " "}' end""")
    m = graphs._models(b.spark, sf_dir).select("unique_id", said.alias("said"))
    detail = b.detail.join(m, "unique_id", "left").withColumn("meta", F.when(F.col("said").isNotNull(), F.create_map(F.lit("ignore"), "said")).otherwise(F.col("meta"))).drop("said")
    return b.with_(detail=detail)


@query("suppressions_without_reason", over(B, query="select unique_id, case when k % 10 = 1 then 'all' else 'undocumented_models' end as related from m where k % 10 in (1, 2, 4)"))
def suppressions_without_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.RULES["suppressions_without_reason"].run(_ignoring(layered(spark, sf_dir), sf_dir), {})
    return found.select("unique_id", F.array_join("related", ",").alias("related"))


@query("classified_findings", over(B, _LINT, query="""select 'naming_conventions' as rule, case when k % 10 = 1 then 'suppressed' when k % 3 = 0 then 'baselined' when k % 7 = 0 then 'pre-existing' else 'counted' end as class, unique_id from lay where zone <> 'other' and by_name is null
 union all select 'public_models_without_contract', case when k % 10 = 1 then 'suppressed' when k % 7 = 0 then 'pre-existing' else 'counted' end, unique_id from m where k % 4 = 0 and k % 6 <> 0"""))  # fmt: skip
def classified_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules; the baseline holds the names of models with k % 3 = 0, the base side had all with k % 7 = 0."""
    b = _ignoring(layered(spark, sf_dir), sf_dir)
    found = written(lint.findings(b, only=["naming_conventions", "public_models_without_contract"])[0], "findings")
    m = graphs._models(spark, sf_dir).select("unique_id", "k")
    frozen = found.where("rule = 'naming_conventions'").join(m.where("k % 3 = 0"), "unique_id", "left_semi")
    old = found.join(m.where("k % 7 = 0"), "unique_id", "left_semi")
    return lint.classified(lint.suppressed(b, found), frozen, old).select("rule", "class", "unique_id")


@query("rewritten_baseline", over(B, _LINT, query="select 'naming_conventions' as rule, unique_id from lay where zone <> 'other' and by_name is null union all select 'unused_sources', 'source.bench.raw.tbl_0'"))
def rewritten_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    old = spark.createDataFrame([("unused_sources", "source.bench.raw.tbl_0", []), ("naming_conventions", "model.bench.gone", [])], "rule string, unique_id string, related array<string>")
    found, _ = lint.findings(b, only=["naming_conventions"])
    return lint.rewritten_baseline(old, found, ["naming_conventions"]).select("rule", "unique_id")


@query("finding_keys", over(B, _LINT, query="select 'undocumented_sources|' || unique_id || '|' as finding_key from src where j % 2 = 1 union all select 'unused_sources|' || unique_id || '|' from src where unique_id not in (select parent from edges)"))
def finding_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = lint.findings(layered(spark, sf_dir), only=["undocumented_sources", "unused_sources"])
    return lint.finding_key(found).select("finding_key")


# --- names and types ------------------------------------------------------------------------------------------------


@query("names", """select p_partkey as k, case p_partkey % 3 when 0 then 'Name' || p_partkey when 1 then 'name' || p_partkey else 'name' || p_partkey end as folded, cast(p_partkey % 4 as varchar) as version,
 case when p_partkey % 2 = 0 then 'n' || p_partkey || '.v' || (p_partkey % 4) else 'n' || p_partkey end as list_name, 'p.n' || p_partkey as family, p_partkey || case when p_partkey = 1 then ' model' else ' models' end as plural,
 'a/b/n' || p_partkey || '.sql' as path, 'models/s' || p_partkey || '.yml' as patch, 'raw.n' || p_partkey as shown, 'a, b' || case when p_partkey % 5 > 2 then ' and ' || (p_partkey % 5 - 2) || ' more' else '' end as capped from part where p_partkey % 5 >= 2""")  # fmt: skip
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = k.cast("string")
    name = F.concat(F.lit("n"), s)
    uid = F.when(k % 2 == 0, F.concat(F.lit("model.p."), name, F.lit(".v"), (k % 4).cast("string"))).otherwise(F.concat(F.lit("model.p."), name))
    written_as = F.when(k % 3 == 0, F.concat(F.lit('"Name'), s, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("`name"), s, F.lit("`"))).otherwise(F.concat(F.lit("NAME"), s))
    letters = F.slice(F.array(*[F.lit(x) for x in "abcd"]), 1, (k % 5).cast("int"))
    return table(spark, sf_dir, "part").where("p_partkey % 5 >= 2").select(
        k.alias("k"), N.normalize_column(written_as).alias("folded"), N.normalize_version(F.concat(F.lit("V"), (k % 4).cast("string"))).alias("version"), N.list_name(uid, name).alias("list_name"),
        N.family_name(uid, name).alias("family"), N.pluralize(k, "model").alias("plural"), N.normal_path(F.concat(F.lit("a\\b\\n"), s, F.lit(".sql"))).alias("path"),
        N.project_path(F.concat(F.lit("shop://models/s"), s, F.lit(".yml"))).alias("patch"), N.display_name(F.concat(F.lit("source.p.raw."), name), name, F.lit("source")).alias("shown"), N.capped(letters, 2).alias("capped"),
    )


@query("glob_names", over(B, query="select unique_id from m where regexp_full_match(name, '[df][ic][mt]_0[^1-9].*[24]')"))
def glob_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).nodes.where("resource_type = 'model'").where(F.col("name").rlike(globs.name_glob("[df][ic][mt]_0[!1-9]*[24]"))).select("unique_id")


_KNOWN = sorted({n for rows in (FAMILIES, *DIALECTS.values()) for row in rows for n in row} | {"date", "json"})
_ROWS = ", ".join(f"('{d}', {k}, '{n}')" for d in ("generic", *DIALECTS) for k, row in enumerate(FAMILIES + DIALECTS.get(d, ())) for n in row)
_NAMES = ", ".join(f"('{n}')" for n in _KNOWN)


@query("type_pairs", f"""with f(d, fam, n) as (values {_ROWS}), n(n) as (values {_NAMES}), d(d) as (values ('generic'), ('bigquery'), ('snowflake')),
s as (select d, n, case when d = 'snowflake' and n in ('number', 'numeric', 'decimal', 'dec') then 'number' else n end as base from n, d)
select a.d as dialect, a.n as declared, b.n as actual from s a join s b on a.d = b.d where a.base = b.base or exists (select 1 from f x join f y on x.d = y.d and x.fam = y.fam where x.d = a.d and x.n = a.base and y.n = b.base)""")  # fmt: skip
def type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bare type names are one type, of all pairs of the names that any family knows, in each dialect."""
    every = spark.createDataFrame([(n,) for n in _KNOWN], "declared string")
    pairs = every.crossJoin(F.broadcast(every.withColumnRenamed("declared", "actual")))  # some 40 names, whatever the data
    out = None
    for d in ("generic", *DIALECTS):
        part = pairs.where(types_equivalent(F.col("declared"), F.upper("actual"), d)).select(F.lit(d).alias("dialect"), "declared", "actual")
        out = part if out is None else out.unionByName(part)
    return out


@query("constraint_labels", "select p_partkey as k, 'foreign_key fk (a, b) -> t' || p_partkey || '(c)' as label from part")
def constraint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def label(c: Column) -> Column:
        return N.constraint_label(c)

    c = F.expr("named_struct('type', 'foreign_key', 'name', 'fk', 'expression', '', 'to', concat('t', cast(p_partkey as string)), 'to_columns', array('c'), 'columns', array('a', 'b'))")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), label(c).alias("label"))
