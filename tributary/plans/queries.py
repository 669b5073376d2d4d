"""The query pack over the driver's tables: each entry has a DataFrame program and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.operators import attributes, diff, impact, lineage, lint, select, traverse
from tributary.plans import graphs
from tributary.plans.bundle import Bundle
from tributary.plans.layered_sql import LATER, A, B, over

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_built: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]) -> object:
    """Graph tables are written to the shared folder once for each session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def layered(spark: SparkSession, sf_dir: str) -> Bundle:
    return _once(spark, sf_dir, "layered", lambda: graphs.layered_graph(spark, sf_dir))  # type: ignore[return-value]


def later(spark: SparkSession, sf_dir: str) -> Bundle:
    return _once(spark, sf_dir, "later", lambda: graphs.mutated(layered(spark, sf_dir), sf_dir))  # type: ignore[return-value]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- instance graph -------------------------------------------------------------------------------------------------

_REACH = """reach(node, depth) as (select 'model.tpch.r_0', 0 union select e.child, r.depth + 1 from reach r join edges e on e.parent = r.node)"""


@query("downstream_of_region", over(A, _REACH, query="""select split_part(split_part(node, '.', 3), '_', 1) as kind, depth, count(*) as n
 from (select node, min(depth) as depth from reach group by node) where depth > 0 group by 1, 2"""))  # fmt: skip
def downstream_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each kind below region 0, by their least distance."""
    edges = graphs.instance_edges(spark, sf_dir)
    seed = spark.createDataFrame([("model.tpch.r_0",)], "unique_id string")
    found = traverse.closure(edges, seed)
    kind = F.split(F.split("unique_id", r"\.")[2], "_")[0]
    return found.groupBy(kind.alias("kind"), F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


@query("instance_degrees", over(A, query="""select kind, max(up) as max_up, max(down) as max_down, sum(down) as edges from (
 select n.uid, split_part(split_part(n.uid, '.', 3), '_', 1) as kind, coalesce(u.c, 0) as up, coalesce(d.c, 0) as down
 from (select parent as uid from edges union select child from edges) n left join (select child, count(*) as c from edges group by 1) u on u.child = n.uid
 left join (select parent, count(*) as c from edges group by 1) d on d.parent = n.uid) group by kind"""))  # fmt: skip
def instance_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graphs.instance_edges(spark, sf_dir)
    counts = e.select(F.col("parent").alias("uid"), F.lit(0).alias("up"), F.lit(1).alias("down")).unionByName(e.select(F.col("child").alias("uid"), F.lit(1).alias("up"), F.lit(0).alias("down")))
    per = counts.groupBy("uid").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    kind = F.split(F.split("uid", r"\.")[2], "_")[0]
    return per.groupBy(kind.alias("kind")).agg(F.max("up").alias("max_up"), F.max("down").alias("max_down"), F.sum("down").alias("edges"))


# --- node and edge tables -------------------------------------------------------------------------------------------

@query("nodes", over(B, query="select unique_id, name, resource_type, path, materialized from nodes"))
def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).nodes


@query("edges", over(B, query="select parent, child from edges"))
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layered(spark, sf_dir).edges


@query("degrees", over(B, query="""select n.unique_id, (select count(*) from edges where child = n.unique_id) as direct_up,
 (select count(*) from edges where parent = n.unique_id) as direct_down, (select count(*) from tests t where t.unique_id = n.unique_id) as test_count from nodes n"""))  # fmt: skip
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.degrees(layered(spark, sf_dir))


@query("package_histogram", over(B, query="select split_part(unique_id, '.', 2) as package, count(*) as n from nodes group by 1"))
def package_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.package_histogram(layered(spark, sf_dir))


_ROOT = "root as (select unique_id from nodes where split_part(unique_id, '.', 2) = 'bench')"


@query("root_scope_edges", over(B, _ROOT, query="select parent, child from edges where parent in (select unique_id from root) and child in (select unique_id from root)"))
def root_scope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.root_scope(layered(spark, sf_dir)).edges


@query("root_scope_severed", over(B, _ROOT, query="""select unique_id, cast(sum(p) as bigint) as parents, cast(sum(c) as bigint) as children from (
 select child as unique_id, 1 as p, 0 as c from edges where child in (select unique_id from root) and parent not in (select unique_id from root)
 union all select parent, 0, 1 from edges where parent in (select unique_id from root) and child not in (select unique_id from root)) group by 1"""))  # fmt: skip
def root_scope_severed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.root_scope(layered(spark, sf_dir)).pruned_adjacent


@query("coverage", over(B, _ROOT, query="""select measure, covered, total, case when total = 0 then 100 else cast(floor(100 * covered / total) as bigint) end as percent from (
 select 'tests' as measure, count(*) filter (m.unique_id in (select unique_id from tests)) as covered, count(*) as total from m where m.unique_id in (select unique_id from root)
 union all select 'column_tests', count(*) filter (exists (select 1 from tests t where t.unique_id = c.unique_id and lower(t.column_name) = lower(c.name))), count(*) from cols c where c.unique_id in (select unique_id from root)
 union all select 'docs', count(*) filter (k % 5 <> 0), count(*) from m where unique_id in (select unique_id from root)
 union all select 'column_docs', count(*) filter (coalesce(trim(description), '') <> ''), count(*) from cols where unique_id in (select unique_id from root))"""))  # fmt: skip
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.coverage(layered(spark, sf_dir))


@query("layer_coverage", over(B, query="""select dir as layer, count(*) as models, count(*) filter (unique_id in (select unique_id from tests)) as tested,
 cast(floor(100 * count(*) filter (unique_id in (select unique_id from tests)) / count(*)) as bigint) as percent from m group by 1"""))  # fmt: skip
def layer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.layer_coverage(layered(spark, sf_dir))


@query("coverage_gaps", over(B, query="select unique_id from m where unique_id not in (select unique_id from tests)"))
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.coverage_gaps(layered(spark, sf_dir)).select("unique_id")


_PK = """pk as (select unique_id from tests where column_name is not null group by unique_id, column_name having bool_or(kind = 'unique') and bool_or(kind = 'not_null')
 union select unique_id from tests where kind like '%unique_combination_of_columns')"""


@query("primary_keys", over(B, _PK, query="select unique_id from pk"))
def primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.primary_keys(layered(spark, sf_dir))


_ALL = """walk(seed, node) as (select unique_id, unique_id from nodes union select w.seed, e.child from walk w join edges e on e.parent = w.node),
down as (select seed, count(*) filter (node <> seed) as n, count(*) filter (node <> seed and node like 'exposure.%') as x from walk group by seed)"""


@query("downstream_counts", over(B, _ALL, query="select seed as unique_id, n as downstream, x as exposures from down"))
def downstream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.downstream_counts(layered(spark, sf_dir))


@query("top_hubs", over(B, query="""select unique_id, c as degree from (select unique_id, count(*) as c from (select parent as unique_id from edges union all select child from edges) group by 1)
 order by c desc, unique_id limit 5"""))  # fmt: skip
def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.hubs(layered(spark, sf_dir))


@query("transitive_hubs", over(B, _ALL, query="select seed as unique_id, n as downstream from down order by n desc, seed limit 5"))
def transitive_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.transitive_hubs(layered(spark, sf_dir))


@query("dashboard", over(B, query="""select 'nodes' as metric, (select count(*) from nodes) as value union all select 'models', (select count(*) from m)
 union all select 'orphans', (select count(*) from nodes where unique_id not in (select parent from edges) and unique_id not in (select child from edges))
 union all select 'models_without_children', (select count(*) from m where unique_id not in (select parent from edges))
 union all select 'undocumented_models', (select count(*) from m where k % 5 = 0) union all select 'untested', (select count(*) from m where unique_id not in (select unique_id from tests))
 union all select 'tests', (select count(*) from tests)"""))  # fmt: skip
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.stats(layered(spark, sf_dir))


@query("counts_by_type", over(B, query="select resource_type, count(*) as n from nodes group by 1"))
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.counts_by(layered(spark, sf_dir), "resource_type")


@query("counts_by_materialization", over(B, query="select materialized, count(*) as n from nodes group by 1"))
def counts_by_materialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.counts_by(layered(spark, sf_dir), "materialized")


_RANK = "case dir when 'staging' then 0 when 'intermediate' then 1 when 'marts' then 2 when 'utilities' then 3 else 4 end"


@query("model_list", over(B, query=f"""select dir as grp, {_RANK} as grp_rank, name as list_name, unique_id, row_number() over (partition by dir order by name, unique_id) as row_in_group from m"""))
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.model_list(layered(spark, sf_dir))


@query("model_list_by_downstream", over(B, _ALL, query=f"""select dir as grp, {_RANK} as grp_rank, name as list_name, unique_id,
 row_number() over (partition by dir order by n desc, name, unique_id) as row_in_group from m join down on seed = unique_id"""))  # fmt: skip
def model_list_by_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.model_list(layered(spark, sf_dir), key="downstream")


@query("fuzzy_names", over(B, query="select unique_id from m where regexp_matches(lower(name), 's.*g.*0.*7')"))
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return b.nodes.where("resource_type = 'model'").where(N.name_matches(F.col("name"), "S g07")).select("unique_id")


@query("full_text", over(B, query="""select unique_id from m where (k % 5 <> 0 and contains(lower('About ' || name), 'fct_0000')) or contains('select id, c0000 from t_' || name, 'fct_0000')"""))
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.full_text(layered(spark, sf_dir), "FCT_0000").select("unique_id")


@query("lenses", over(B, _ALL, _PK, query="""select n.unique_id, case when n.resource_type <> 'model' then 'none' when n.unique_id in (select unique_id from tests) then 'tested' else 'untested' end as coverage,
 case when d.n <= 0 then 'none' when d.n <= 2 then 'low' when d.n <= 6 then 'mid' else 'high' end as degree_heat, n.dir_layer as layer,
 case when m.k % 5 = 1 then 'error' when m.k % 5 = 2 then 'warn' when m.k % 5 = 3 then 'skipped' else 'none' end as run_status,
 case when m.k is null or (m.k * 7) % 130 < 1 then 'none' when (m.k * 7) % 130 < 10 then 'low' when (m.k * 7) % 130 < 60 then 'mid' else 'high' end as run_time,
 n.unique_id in (select unique_id from pk) as primary_key from nodes n join down d on d.seed = n.unique_id left join m on m.unique_id = n.unique_id"""))  # fmt: skip
def lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.lenses(layered(spark, sf_dir))


@query("tags_index", over(B, query="""select bucket, string_agg(name, ',' order by name) as models from (select name, case when k % 2 = 0 then 'nightly' else 'hourly' end as bucket from m
 union all select name, 'core' from m where k % 5 = 0) group by 1"""))  # fmt: skip
def tags_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.index_by(layered(spark, sf_dir), "tags").select("bucket", F.array_join("models", ",").alias("models"))


@query("owners_index", over(B, query="select case when k % 6 = 1 then null else 'team_' || (k % 4) end as bucket, string_agg(name, ',' order by name) as models from m group by 1"))
def owners_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.index_by(layered(spark, sf_dir), "meta:owner").select("bucket", F.array_join("models", ",").alias("models"))


# --- traversal ------------------------------------------------------------------------------------------------------

_SEED = "(select unique_id from m where layer = 'staging' and k = 3)"


@query("closure_down", over(B, f"r(node, depth) as (select unique_id, 0 from {_SEED} union select e.child, r.depth + 1 from r join edges e on e.parent = r.node)", query="select node as unique_id, cast(min(depth) as bigint) as depth from r where depth > 0 group by 1"))
def closure_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    found = traverse.closure(b.edges, b.nodes.where("name = 'stg_00003'"))
    return found.select("unique_id", F.col("depth").cast("long").alias("depth"))


_UP = "r(node, depth) as (select 'exposure.bench.exp_3', 0 union select e.parent, r.depth + 1 from r join edges e on e.child = r.node where r.depth < {})"


@query("closure_up_two_levels", over(B, _UP.format(2), query="select node as unique_id, cast(min(depth) as bigint) as depth from r where depth > 0 group by 1"))
def closure_up_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    found = traverse.closure(b.edges, b.nodes.where("unique_id = 'exposure.bench.exp_3'"), "up", 2)
    return found.select("unique_id", F.col("depth").cast("long").alias("depth"))


@query("subgraph_edges", over(B, _UP.format(99), query="select parent, child from edges where parent in (select node from r) and child in (select node from r)"))
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return traverse.subgraph(b.nodes, b.edges, b.nodes.where("unique_id = 'exposure.bench.exp_3'"), down=False)[1]


@query("layering", over(B, "r(node, col) as (select unique_id, 0 from nodes where unique_id not in (select child from edges) union select e.child, r.col + 1 from r join edges e on e.parent = r.node)", query="select node as unique_id, cast(max(col) as bigint) as col from r group by 1"))
def layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return traverse.layering(b.nodes, b.edges).select("unique_id", F.col("col").cast("long").alias("col"))


@query("longest_chain_hops", over(B, "r(node, hops) as (select unique_id, 0 from nodes union select e.parent, r.hops + 1 from r join edges e on e.child = r.node)", query="select node as unique_id, cast(max(hops) as bigint) as hops from r group by 1"))
def longest_chain_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return traverse.longest_chains(b.nodes, b.edges).select("unique_id", F.col("hops").cast("long").alias("hops"))


@query("critical_seconds", over(B, """own as (select n.unique_id, coalesce(cast((m.k * 7) % 130 as double), 0) as w from nodes n left join m on m.unique_id = n.unique_id),
r(node, w) as (select unique_id, w from own union select e.parent, r.w + o.w from r join edges e on e.child = r.node join own o on o.unique_id = e.parent)""", query="select node as unique_id, max(w) as seconds from r group by 1"))  # fmt: skip
def critical_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    weighted = b.nodes.join(b.run_results, "unique_id", "left")
    return traverse.longest_chains(weighted, b.edges, "execution_time").select("unique_id", F.col("weight").alias("seconds"))


@query("downstream_exposures", over(B, f"r(node) as (select unique_id from {_SEED} union select e.child from r join edges e on e.parent = r.node)", query="select unique_id, name, 'team_' || (i % 3) as owner_name from expo where unique_id in (select node from r)"))
def downstream_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    uid = b.nodes.where("name = 'stg_00003'").first()["unique_id"]
    return attributes.downstream_exposures(b, uid).select("unique_id", "name", "owner_name")


@query("shortest_path_length", over(B, """both_ways as (select parent as a, child as b from edges union select child, parent from edges),
r(node, depth) as (select 'source.bench.raw.tbl_1', 0 union select b, depth + 1 from r join both_ways on a = node where depth < 4)""", query="select min(depth) + 1 as nodes from r where node = 'exposure.bench.exp_5'"))  # fmt: skip
def shortest_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = traverse.shortest_path(layered(spark, sf_dir).edges, "source.bench.raw.tbl_1", "exposure.bench.exp_5")
    return spark.createDataFrame([(len(path),)], "nodes int")


@query("collapsed_siblings", over(B, "r(node, col) as (select unique_id, 0 from nodes where unique_id not in (select child from edges) union select e.child, r.col + 1 from r join edges e on e.parent = r.node)", """lv as (select node, max(col) as col from r group by 1),
dp as (select child, parent, row_number() over (partition by child order by col desc, parent) as rn from edges join lv on node = parent),
rk as (select child, parent as anchor, row_number() over (partition by parent order by child) as rk, count(*) over (partition by parent) as sz from dp where rn = 1)""", query="select unique_id, case when sz > 8 and rk > 8 then '+' || (sz - 8) || ' of ' || anchor end as marker from nodes left join rk on child = unique_id"))  # fmt: skip
def collapsed_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    return traverse.collapse_siblings(b.nodes, b.edges, 8)[0]


# --- selectors ------------------------------------------------------------------------------------------------------

_DOWN_TAG = "t as (select unique_id from m where k % 2 = 0)"
SELECTORS = {
    "tag": ("tag:core", over(B, query="select unique_id from m where k % 5 = 0")),
    "materialized": ("config.materialized:incremental", over(B, query="select unique_id from m where k % 4 = 3")),
    "meta": ("meta:owner=team_2", over(B, query="select unique_id from m where k % 6 <> 1 and k % 4 = 2")),
    "meta_key": ("meta:owner", over(B, query="select unique_id from m where k % 6 <> 1")),
    "glob": ("fct_000?[02468] dim_*7", over(B, query="select unique_id from m where regexp_full_match(name, 'fct_000.[02468]') or regexp_full_match(name, 'dim_.*7')")),
    "path": ("path:models/marts", over(B, query="select unique_id from m where dir = 'marts'")),
    "path_glob": ("path:models/**/*_0001?.sql", over(B, query="select unique_id from m where regexp_full_match(name, '.*_0001.')")),
    "exposure": ("exposure:exp_2", over(B, "r(node) as (select 'exposure.bench.exp_2' union select e.parent from r join edges e on e.child = r.node)", query="select node as unique_id from r")),
    "hops_up": ("2+exp_4", over(B, "r(node, d) as (select 'exposure.bench.exp_4', 0 union select e.parent, d + 1 from r join edges e on e.child = r.node where d < 2)", query="select distinct node as unique_id from r")),
    "up_and_down": ("+int_00004+", over(B, "u(node) as (select unique_id from m where name = 'int_00004' union select e.parent from u join edges e on e.child = u.node)", "d(node) as (select unique_id from m where name = 'int_00004' union select e.child from d join edges e on e.parent = d.node)", query="select node as unique_id from u union select node from d")),
    "intersection": ("tag:nightly,config.materialized:view tag:core,path:models/staging", over(B, query="select unique_id from m where (k % 2 = 0 and k % 4 = 0) or (k % 5 = 0 and dir = 'staging')")),
}


def _selector(spec: str) -> Query:
    return lambda spark, sf_dir: select.select(layered(spark, sf_dir), select.validate(spec))


for _name, (_spec, _sql) in SELECTORS.items():
    query(f"select_{_name}", _sql)(_selector(_spec))


@query("select_exclude", over(B, query="select unique_id, name as list_name, 'model' as resource_type from m where k % 2 = 0 and not k % 5 = 0"))
def select_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.listed(layered(spark, sf_dir), ["tag:nightly"], ["tag:core"])


_REASONS = """p1 as (select child, string_agg(parent, ',' order by parent) as p from edges group by 1), p2 as (select child, string_agg(parent, ',' order by parent) as p from edges2 group by 1),
t1 as (select unique_id, count(*) as c from tests group by 1), t2 as (select unique_id, count(*) as c from tests2 group by 1),
mods as (select n.unique_id, concat_ws(';', case when n.materialized is distinct from o.materialized then 'materialized: ' || coalesce(o.materialized, 'none') || ' -> ' || coalesce(n.materialized, 'none') end,
 case when p1.p is distinct from p2.p then 'parents changed' end, case when m.idx % 47 = 0 or m.idx % 53 = 0 or m.idx % 59 = 0 or m.idx % 61 = 0 then 'columns changed' end,
 case when coalesce(t1.c, 0) <> coalesce(t2.c, 0) then 'tests: ' || coalesce(t1.c, 0) || ' -> ' || coalesce(t2.c, 0) end,
 case when m.idx % 37 = 0 then 'sql changed' end) as reasons
 from nodes2 n join nodes o on o.unique_id = n.unique_id left join m on m.unique_id = n.unique_id left join p1 on p1.child = n.unique_id left join p2 on p2.child = n.unique_id
 left join t1 on t1.unique_id = n.unique_id left join t2 on t2.unique_id = n.unique_id),
changes as (select unique_id, 'modified' as status, reasons from mods where reasons <> '' union all select unique_id, 'added', '' from nodes2 where unique_id not in (select unique_id from nodes)
 union all select unique_id, 'removed', '' from nodes where unique_id not in (select unique_id from nodes2)),
changed as (select c.unique_id, n.name from changes c join nodes2 n on n.unique_id = c.unique_id where c.status <> 'removed' and n.resource_type = 'model')"""


@query("node_changes", over(B, LATER, _REASONS, query="select unique_id, status, reasons from changes"))
def node_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.node_changes(layered(spark, sf_dir), later(spark, sf_dir)).select("unique_id", "status", F.array_join("reasons", ";").alias("reasons"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.session import written

    return _once(spark, sf_dir, "changes", lambda: written(diff.node_changes(layered(spark, sf_dir), later(spark, sf_dir)), "changes"))  # type: ignore[return-value]


@query("edge_changes", over(B, LATER, query="""select parent, child, 'added' as side from (select * from edges2 except select * from edges)
 union all select parent, child, 'removed' from (select * from edges except select * from edges2)"""))  # fmt: skip
def edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.edge_changes(layered(spark, sf_dir), later(spark, sf_dir))


@query("select_state", over(B, LATER, _REASONS, query="select unique_id from changes where status in ('added', 'modified')"))
def select_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select(later(spark, sf_dir), "state:modified", _changes(spark, sf_dir))


_BELOW = """below(node) as (select unique_id from changed union select e.child from below b join edges2 e on e.parent = b.node),
hit as (select unique_id, name, resource_type, dir_layer from nodes2 where unique_id in (select node from below) and unique_id not in (select unique_id from changed))"""


@query("affected_nodes", over(B, LATER, _REASONS, _BELOW, query="""select unique_id, case when resource_type = 'exposure' then 'exposure' when dir_layer = 'marts' then 'mart' else 'model' end as kind
 from hit where resource_type = 'exposure' or (resource_type = 'model' and split_part(unique_id, '.', 2) = 'bench')"""))  # fmt: skip
def affected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.affected_nodes(later(spark, sf_dir), _changes(spark, sf_dir)).select("unique_id", "kind")


@query("changed_hubs", over(B, LATER, _REASONS, """w(seed, node) as (select unique_id, unique_id from changed union select w.seed, e.child from w join edges2 e on e.parent = w.node)""", query="""select c.unique_id, c.name, count(*) filter (node <> seed and node not like 'exposure.%') as downstream
 from changed c join w on w.seed = c.unique_id group by 1, 2 having count(*) filter (node <> seed and node not like 'exposure.%') >= 5"""))  # fmt: skip
def changed_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.changed_hubs(later(spark, sf_dir), _changes(spark, sf_dir))


@query("untested_changes", over(B, LATER, _REASONS, query="select unique_id, name from changed where unique_id not in (select unique_id from tests2)"))
def untested_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.untested_changes(later(spark, sf_dir), _changes(spark, sf_dir))


@query("ci_selector", over(B, LATER, _REASONS, query="select string_agg(distinct name || '+', ' ' order by name || '+') as selector from changed"))
def ci_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.ci_selectors(later(spark, sf_dir), _changes(spark, sf_dir))


@query("affected_owners", over(B, LATER, _REASONS, query="select distinct 'team_' || (k % 4) as owner from m where k % 6 <> 1 and unique_id in (select unique_id from changed)"))
def affected_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = later(spark, sf_dir)
    return impact.owners(current, impact.changed_nodes(current, _changes(spark, sf_dir)))


_VIOLATIONS = """rank(dir_layer, r) as (values ('staging', 0), ('intermediate', 1), ('marts', 2)),
bench as (select unique_id, r from nodes2 join rank using (dir_layer) where resource_type = 'model' and split_part(unique_id, '.', 2) = 'bench'),
bench1 as (select unique_id, r from nodes join rank using (dir_layer) where resource_type = 'model' and split_part(unique_id, '.', 2) = 'bench'),
viol as (select parent, child from edges2 join bench p on p.unique_id = parent join bench c on c.unique_id = child where p.r > c.r
 except select parent, child from edges join bench1 p on p.unique_id = parent join bench1 c on c.unique_id = child where p.r > c.r),
hub as (select c.unique_id from changed c join w on w.seed = c.unique_id group by 1 having count(*) filter (node <> seed and node not like 'exposure.%') >= 5),
reached as (select unique_id, resource_type from hit where resource_type = 'exposure' or (resource_type = 'model' and split_part(unique_id, '.', 2) = 'bench')),
val as (select (select cast(floor(100 * count(*) filter (unique_id in (select unique_id from tests2)) / count(*)) as bigint) from nodes2 where resource_type = 'model' and split_part(unique_id, '.', 2) = 'bench') as cov,
 (select count(*) from viol) as viol, (select count(*) from changed where unique_id not in (select unique_id from tests2)) as untested, (select count(*) from hub) as hubs,
 (select count(*) from reached where resource_type = 'exposure') as expo, (select count(*) from reached where resource_type <> 'exposure') as blast)"""
_WALK2 = "w(seed, node) as (select unique_id, unique_id from changed union select w.seed, e.child from w join edges2 e on e.parent = w.node)"


@query("gates", over(B, LATER, _REASONS, _BELOW, _WALK2, _VIOLATIONS, query="""select 0 as rank, 'coverage' as gate, 'error' as severity, case when cov < 60 then 'fail' else 'pass' end as status, cov as value, 60 as bound from val
 union all select 1, 'column_coverage', 'off', 'off', null, 80 union all select 2, 'doc_coverage', 'off', 'off', null, 80
 union all select 3, 'new_layer_violations', 'error', case when viol > 0 then 'fail' else 'pass' end, viol, null from val
 union all select 4, 'untested_changes', 'warn', case when untested > 0 then 'warn' else 'pass' end, untested, null from val union all select 5, 'breaking_columns', 'error', 'skip', null, null
 union all select 6, 'changed_hubs', 'warn', case when hubs > 0 then 'warn' else 'pass' end, hubs, 5 from val union all select 7, 'affected_exposures', 'warn', case when expo > 0 then 'warn' else 'pass' end, expo, null from val
 union all select 8, 'blast_radius', 'warn', case when blast > 10 then 'warn' else 'pass' end, blast, 10 from val union all select 9, 'docs_drift', 'off', 'off', null, null"""))  # fmt: skip
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"coverage": {"min": 60}, "blast_radius": {"max": 10}}
    return impact.gate_results(later(spark, sf_dir), layered(spark, sf_dir), config)


# --- column lineage --------------------------------------------------------------------------------------------------

_COLUMN_EDGES = """pr as (select child, parent, row_number() over (partition by child order by parent) as rn from edges where child like 'model.%'),
ce as (select parent as from_node, c as from_col, child as to_node, c as to_col, 'passthrough' as kind from pr, (values ('id'), ('c0000')) v(c) where rn = 1
 union all select parent, c, child, o, 'filter_or_join' from pr, (values ('id'), ('c0000')) v(c), (values ('id'), ('c0000')) w(o) where rn = 2)"""


def _column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tributary.session import written

    return _once(spark, sf_dir, "column_edges", lambda: written(lineage.column_edges(graphs.with_joined_code(layered(spark, sf_dir))), "column-edges"))  # type: ignore[return-value]


@query("column_edges", over(B, _COLUMN_EDGES, query="select from_node, from_col, to_node, to_col, kind, 'exact' as confidence from ce"))
def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _column_edges(spark, sf_dir)


@query("column_closure_up", over(B, _COLUMN_EDGES, "r(node, col) as (select unique_id, 'c0000' from m where layer = 'marts' and k = 4 union select ce.from_node, ce.from_col from r join ce on ce.to_node = r.node and ce.to_col = r.col)", query="select node, col as \"column\" from r where node not in (select unique_id from m where layer = 'marts' and k = 4)"))
def column_closure_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = layered(spark, sf_dir).nodes.where("name = 'fct_00004'").first()["unique_id"]
    return lineage.column_closure(_column_edges(spark, sf_dir), mart, "c0000").select("node", "column")


@query("column_counts", over(B, _COLUMN_EDGES, query="""select coalesce(i.node, o.node) as node, coalesce(i.c, o.c) as "column", coalesce(i.n, 0) as direct_in, coalesce(o.n, 0) as direct_out from
 (select to_node as node, to_col as c, count(*) as n from ce group by 1, 2) i full join (select from_node as node, from_col as c, count(*) as n from ce group by 1, 2) o on i.node = o.node and i.c = o.c"""))  # fmt: skip
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.column_counts(_column_edges(spark, sf_dir))


@query("hard_coded_references", over(B, query="select unique_id, 't_' || name as related from m"))
def hard_coded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    found = lint.RULES["hard_coded_references"].run(b, {"facts": lineage.sql_facts(b)})
    return found.select("unique_id", F.array_join("related", ",").alias("related"))


# --- lint -----------------------------------------------------------------------------------------------------------

_LINT = """lay as (select *, case when name like 'stg\\_%' escape '\\' then 'staging' when name like 'int\\_%' escape '\\' then 'intermediate'
 when name like 'fct\\_%' escape '\\' or name like 'dim\\_%' escape '\\' then 'marts' when dir in ('staging', 'intermediate', 'marts') then dir else 'other' end as zone,
 case when name like 'stg\\_%' escape '\\' then 'staging' when name like 'int\\_%' escape '\\' then 'intermediate' when name like 'fct\\_%' escape '\\' or name like 'dim\\_%' escape '\\' then 'marts' end as by_name from m),
sp as (select child, count(*) as n, string_agg(parent, ',' order by parent) as ps from edges where parent like 'source.%' and child like 'model.%' group by 1),
mp as (select child, count(*) as n, string_agg(parent, ',' order by parent) as ps from edges where parent like 'model.%' and child like 'model.%' group by 1)"""
_N = "'' as related"
LINT = {
    "direct_join_to_source": "select child as unique_id, ps as related from sp where child in (select child from mp)",
    "multiple_sources_joined": "select child as unique_id, ps as related from sp where n > 1",
    "source_fanout": "select parent as unique_id, string_agg(child, ',' order by child) as related from edges where parent like 'source.%' and child like 'model.%' group by 1 having count(*) >= 2",
    "model_fanout": "select parent as unique_id, string_agg(child, ',' order by child) as related from edges where parent like 'model.%' and child in (select unique_id from m where unique_id not in (select parent from edges where child like 'model.%')) group by 1 having count(*) >= 5",
    "root_models": f"select unique_id, {_N} from m where unique_id not in (select child from edges)",
    "rejoining_upstream": """select b as unique_id, string_agg(distinct x, ',' order by x) as related from (select ab.child as b, unnest([ab.parent, bc.c]) as x from
      (select parent as b, min(child) as c from edges where child like 'model.%' and parent like 'model.%' group by 1 having count(*) = 1) bc join edges ab on ab.child = bc.b join edges ac on ac.parent = ab.parent and ac.child = bc.c) group by 1""",
    "marts_depend_on_source": "select child as unique_id, ps as related from sp join lay on lay.unique_id = sp.child where zone in ('marts', 'intermediate')",
    "missing_primary_key_tests": f"select unique_id, {_N} from m where unique_id not in (select unique_id from pk)",
    "public_models_without_contract": f"select unique_id, {_N} from m where k % 4 = 0 and k % 6 <> 0",
    "undocumented_models": f"select unique_id, {_N} from m where k % 5 = 0",
    "naming_conventions": f"select unique_id, {_N} from lay where zone <> 'other' and (by_name is null)",
    "layer_violation": f"""select e.child as unique_id, e.parent as related from edges e join m p on p.unique_id = e.parent join m c on c.unique_id = e.child where split_part(e.parent, '.', 2) = 'bench' and split_part(e.child, '.', 2) = 'bench'
      and case p.dir when 'staging' then 0 when 'intermediate' then 1 else 2 end > case c.dir when 'staging' then 0 when 'intermediate' then 1 else 2 end""",
    "unused_sources": f"select unique_id, {_N} from src where unique_id not in (select parent from edges)",
    "duplicate_sources": "select a.unique_id, string_agg(b.unique_id, ',' order by b.unique_id) as related from src a join src b on a.j % 9 = b.j % 9 and a.j <> b.j group by 1",
    "staging_depends_on_staging": "select e.child as unique_id, string_agg(e.parent, ',' order by e.parent) as related from edges e join lay p on p.unique_id = e.parent join lay c on c.unique_id = e.child where p.zone = 'staging' and c.zone = 'staging' group by 1",
    "exposure_parents_materializations": "select e.child as unique_id, string_agg(e.parent, ',' order by e.parent) as related from edges e join m on m.unique_id = e.parent where e.child like 'exposure.%' and materialized in ('view', 'ephemeral') group by 1",
    "exposures_dependent_on_private_models": "select e.child as unique_id, string_agg(e.parent, ',' order by e.parent) as related from edges e join m on m.unique_id = e.parent where e.child like 'exposure.%' and k % 4 in (1, 2) group by 1",
    "undocumented_sources": f"select unique_id, {_N} from src where j % 2 = 1",
    "undocumented_columns": "select unique_id, string_agg(name, ',' order by pos) as related from cols where coalesce(trim(description), '') = '' group by 1",
    "model_directories": "select unique_id, by_name || ',' || dir as related from lay where by_name <> dir",
    "contract_columns_without_type": "select unique_id, string_agg(name, ',' order by name) as related from cols where data_type is null and k % 6 = 0 group by 1",
    "incremental_without_unique_key": f"select unique_id, {_N} from m where k % 4 = 3 and k % 8 <> 3 and k % 3 <> 0",
    "sources_without_freshness": f"select unique_id, {_N} from src where j % 3 <> 0",
    "warehouse_type_drift": "select unique_id, 'id' as related from m where layer = 'marts' and k % 4 = 2",
    "columns_missing_in_warehouse": "select unique_id, 'c0000' as related from m where layer = 'marts' and k % 9 = 4",
    "undeclared_warehouse_columns": "select unique_id, 'loaded_at' as related from m where layer = 'marts' and k % 8 = 1",
    "unused_models": f"select unique_id, {_N} from lay where zone in ('staging', 'intermediate') and unique_id not in (select parent from edges)",
    "references_deprecated_model": "select e.child as unique_id, string_agg(e.parent, ',' order by e.parent) as related from edges e join m on m.unique_id = e.parent where k % 23 = 5 group by 1",
    "trailing_semicolon": f"select unique_id, {_N} from m where k % 6 = 5",
    "undocumented_exposures": f"select unique_id, {_N} from expo where i % 3 = 0",
    "layer_materializations": "select unique_id, materialized as related from lay where (zone = 'staging' and materialized not in ('view', 'ephemeral')) or (zone = 'marts' and materialized = 'ephemeral')",
    "models_without_unit_tests": f"select unique_id, {_N} from lay where zone = 'marts' and unique_id not in (select unique_id from tests where kind = 'unit')",
}


def _lint(rule: str, options: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lint.RULES[rule].run(layered(spark, sf_dir), options).select("unique_id", F.array_join("related", ",").alias("related"))

    return run


for _name, _sql in LINT.items():
    query(f"lint_{_name}", over(B, _PK, _LINT, query=_sql))(_lint(_name, {}))
query("lint_required_meta_keys", over(B, query="select unique_id, 'owner' as related from m where k % 6 = 1"))(_lint("required_meta_keys", {"keys": ["owner"]}))
query("lint_forbidden_patterns", over(B, query="select unique_id, '_0000[12]' as related from m where regexp_matches(name, '_0000[12]')"))(_lint("forbidden_patterns", {"patterns": ["_0000[12]", "drop table"]}))
query("lint_too_many_joins", over(B, query="select child as unique_id, string_agg(parent, ',' order by parent) as related from edges where child like 'model.%' group by 1 having count(*) >= 3"))(_lint("too_many_joins", {"threshold": 3}))
query("lint_chained_views", over(B, """v as (select e.parent, e.child from edges e join m p on p.unique_id = e.parent join m c on c.unique_id = e.child where p.materialized in ('view', 'ephemeral') and c.materialized in ('view', 'ephemeral')),
 r(node, n) as (select unique_id, 1 from m where materialized in ('view', 'ephemeral') union select v.child, r.n + 1 from r join v on v.parent = r.node)""", query="select node as unique_id, cast(max(n) as varchar) as related from r where node not in (select parent from v) group by 1 having max(n) >= 2"))(_lint("chained_views", {"threshold": 2}))  # fmt: skip


_COUNTED = " union all ".join(
    f"select '{r}' as rule, '{lint.RULES[r].severity}' as severity, count(*) filter (unique_id not in (select unique_id from m where k % 5 = 0)) as counted, count(*) as found from ({sql}) q_{r}"
    for r, sql in LINT.items()
    if lint.RULES[r].default
)


@query("lint_summary", over(B, _PK, _LINT, query=f"""select rule, severity, counted, case when counted = 0 then 'pass' when severity = 'error' then 'fail' else 'warn' end as status from ({_COUNTED}) where found > 0"""))
def lint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layered(spark, sf_dir)
    found, _ = lint.findings(b)
    judged = lint.classified(lint.suppressed(b, found, {"core": "tag:core"}))
    return lint.gate_rows(judged).select("rule", "severity", "counted", "status")
