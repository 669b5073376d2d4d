"""Two graphs made from the driver's tables by rules that any SQL engine can follow.

``instance_graph``: rows as nodes, foreign keys as edges; shallow and wide. ``layered_graph``: a project of three model
layers (every supplier, part and order is a model) with sources and exposures, whose attributes follow from the keys by arithmetic. ``mutated`` is a later state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.plans.bundle import CONSTRAINT, FRESHNESS, Bundle, bundle
from tributary.session import dealt, table, written

SOURCES, EXPOSURES, FAN_OUT = 10, 16, 3


def instance_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, kind, key in (("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"), ("part", "p", "p_partkey"), ("orders", "o", "o_orderkey")):
        part = table(spark, sf_dir, name).select(F.concat(F.lit(f"model.tpch.{kind}_"), F.col(key).cast("string")).alias("unique_id"), F.lit(name).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def instance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child: region to nation to customer to orders, and nation to supplier to part to orders."""
    uid = lambda kind, c: F.concat(F.lit(f"model.tpch.{kind}_"), F.col(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    parts = [
        table(spark, sf_dir, "nation").select(uid("r", "n_regionkey").alias("parent"), uid("n", "n_nationkey").alias("child")),
        table(spark, sf_dir, "customer").select(uid("n", "c_nationkey").alias("parent"), uid("c", "c_custkey").alias("child")),
        table(spark, sf_dir, "supplier").select(uid("n", "s_nationkey").alias("parent"), uid("s", "s_suppkey").alias("child")),
        table(spark, sf_dir, "orders").select(uid("c", "o_custkey").alias("parent"), uid("o", "o_orderkey").alias("child")),
        lines.select("l_suppkey", "l_partkey").distinct().select(uid("s", "l_suppkey").alias("parent"), uid("p", "l_partkey").alias("child")),
        lines.select("l_partkey", "l_orderkey").distinct().select(uid("p", "l_partkey").alias("parent"), uid("o", "l_orderkey").alias("child")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, k, idx, name, unique_id, path of all models."""
    staging = table(spark, sf_dir, "supplier").select(F.lit("staging").alias("layer"), F.col("s_suppkey").alias("k"))
    middle = table(spark, sf_dir, "part").select(F.lit("intermediate").alias("layer"), F.col("p_partkey").alias("k"))
    marts = table(spark, sf_dir, "orders").select(F.lit("marts").alias("layer"), F.col("o_orderkey").alias("k"))
    n = staging.agg(F.count("*").alias("ns")).crossJoin(middle.agg(F.count("*").alias("ni")))  # one row
    every = staging.unionByName(middle).unionByName(marts).crossJoin(F.broadcast(n))
    prefix = F.expr("""case layer when 'staging' then if(k % 7 = 0, 'sta_', 'stg_') when 'intermediate' then if(k % 9 = 0, 'mid_', 'int_')
        else case when k % 11 = 0 then 'mar_' when k % 2 = 0 then 'fct_' else 'dim_' end end""")
    out = every.withColumn("name", F.concat(prefix, F.expr("if(k < 100000, lpad(cast(k as string), 5, '0'), cast(k as string))")))
    return out.select(
        "layer", "k", "ns", "ni", "name",
        F.expr("case layer when 'staging' then k when 'intermediate' then ns + k else ns + ni + k end").alias("idx"),
        F.concat(F.lit("model."), F.expr("if(k % 10 = 9, 'vendor', 'bench')"), F.lit("."), F.col("name")).alias("unique_id"),
        F.concat(F.expr("case when k % 13 = 0 then if(layer = 'staging', 'marts', 'staging') else layer end"), F.lit("/"), F.col("name"), F.lit(".sql")).alias("path"),
    )


def layered_graph(spark: SparkSession, sf_dir: str) -> Bundle:
    m = written(_models(spark, sf_dir), "models")
    sources = spark.range(SOURCES).select(F.col("id").alias("j"), F.concat(F.lit("source.bench.raw.tbl_"), F.col("id").cast("string")).alias("unique_id"), F.concat(F.lit("tbl_"), F.col("id").cast("string")).alias("name"))
    exposures = spark.range(EXPOSURES).select(F.col("id").alias("i"), F.concat(F.lit("exposure.bench.exp_"), F.col("id").cast("string")).alias("unique_id"), F.concat(F.lit("exp_"), F.col("id").cast("string")).alias("name"))
    null = F.lit(None).cast("string")
    nodes = (
        m.select("unique_id", "name", F.lit("model").alias("resource_type"), "path", F.expr("element_at(array('view', 'table', 'ephemeral', 'incremental'), cast(k % 4 + 1 as int))").alias("materialized"))
        .unionByName(sources.select("unique_id", "name", F.lit("source").alias("resource_type"), F.lit("staging/sources.yml").alias("path"), null.alias("materialized")))
        .unionByName(exposures.select("unique_id", "name", F.lit("exposure").alias("resource_type"), F.lit("exposures.yml").alias("path"), null.alias("materialized")))
    )
    by_idx = m.select(F.col("idx").alias("at"), F.col("unique_id").alias("parent"))
    # parts with k % 97 = 5 are roots; an order with k % 59 = 1 reads the one before and that one's first parent
    picks = m.where("layer = 'marts' or (layer = 'intermediate' and k % 97 <> 5)").select("unique_id", "idx", F.expr("if(layer = 'intermediate', ns, ns + ni)").alias("pool"), F.explode(F.sequence(F.lit(0), F.lit(FAN_OUT - 1))).alias("j"))
    picks = picks.withColumn("at", (F.col("idx") * 31 + F.col("j") * 7) % F.col("pool"))
    rejoin = m.where("layer = 'marts' and k % 59 = 1").select("unique_id", F.explode(F.array(F.col("idx") - 1, ((F.col("idx") - 1) * 31) % (F.col("ns") + F.col("ni")))).alias("at"))
    model_edges = picks.select("unique_id", "at").unionByName(rejoin).join(by_idx, "at").select("parent", F.col("unique_id").alias("child"))
    reads = m.where("layer = 'staging' or (layer = 'intermediate' and k % 17 = 0)").select(F.col("k").alias("j"), "unique_id")
    reads = reads.unionByName(m.where("layer = 'staging' and k % 29 = 3").select((F.col("k") + 3).alias("j"), "unique_id"))
    reads = reads.select(F.concat(F.lit("source.bench.raw.tbl_"), (F.col("j") % 8).cast("string")).alias("parent"), F.col("unique_id").alias("child"))
    staging = m.where("layer = 'staging'")
    among = staging.where("k % 19 = 1").select((F.col("k") - 1).alias("at"), F.col("unique_id").alias("child")).join(staging.select(F.col("k").alias("at"), F.col("unique_id").alias("parent")), "at").select("parent", "child")
    marts = m.where("layer = 'marts'")
    n_marts = marts.count()
    shown = exposures.select(F.col("unique_id").alias("child"), F.explode(F.array((F.col("i") * 7) % n_marts, (F.col("i") * 7 + 3) % n_marts)).alias("k")).join(marts.select("k", F.col("unique_id").alias("parent")), "k").select("parent", "child")
    edges = model_edges.unionByName(reads).unionByName(among).unionByName(shown)
    return bundle(
        spark,
        written(nodes, "nodes"),
        written(edges.distinct(), "edges"),
        detail=written(_detail(m, sources, exposures), "detail"),
        columns=_columns(m),
        tests=_tests(m),
        node_sql=m.select("unique_id", _code(F.col("k"), F.col("name")).alias("raw_code"), null.alias("compiled_code"), F.lit(False).alias("stale")),
        exposures=exposures.select("unique_id", F.lit("dashboard").alias("exposure_type"), F.concat(F.lit("team_"), (F.col("i") % 3).cast("string")).alias("owner_name"), null.alias("owner_email"), null.alias("url")),
        catalog_columns=_catalog(m),
        run_results=m.select("unique_id", F.expr("element_at(array('success', 'error', 'warn', 'skipped', 'success'), cast(k % 5 + 1 as int))").alias("status"), ((F.col("k") * 7) % 130).cast("double").alias("execution_time")),
        root_project="bench",
        adapter_type="duckdb",
    )


def _code(k, name):  # noqa: ANN001, ANN202
    return F.concat(F.lit("select id, c0000 from t_"), name, F.when(k % 6 == 5, ";").otherwise(""))


def _detail(m: DataFrame, sources: DataFrame, exposures: DataFrame) -> DataFrame:
    texts, strings = "array<string>", F.lit(None).cast("string")
    none = {
        "description": strings, "tags": F.array().cast(texts), "meta": F.lit(None).cast("map<string,string>"), "access": strings, "grp": strings,
        "contract_enforced": F.lit(None).cast("boolean"), "unique_key": F.array().cast(texts), "incremental_strategy": strings, "deprecation_date": strings,
        "language": strings, "version": strings, "latest_version": strings, "database": strings, "schema": strings, "identifier": strings, "relation_name": strings,
        "original_file_path": strings, "patch_path": strings, "package_name": strings, "semantic_dependents": F.array().cast(texts), "loaded_at_field": strings,
        "loader": strings, "warn_after": F.lit(None).cast(FRESHNESS), "error_after": F.lit(None).cast(FRESHNESS), "constraints": F.array().cast(f"array<{CONSTRAINT}>"),
    }

    def rows(df: DataFrame, **own) -> DataFrame:  # noqa: ANN003
        return df.select("unique_id", *[own.get(n, v).alias(n) for n, v in none.items()])

    models = rows(
        m,
        description=F.expr("if(k % 5 = 0, null, concat('About ', name))"),
        tags=F.expr("filter(array(if(k % 2 = 0, 'nightly', 'hourly'), if(k % 5 = 0, 'core', null)), x -> x is not null)"),
        meta=F.expr("if(k % 6 = 1, cast(null as map<string,string>), map('owner', concat('team_', cast(k % 4 as string))))"),
        access=F.expr("element_at(array('public', 'private', 'protected', null), cast(k % 4 + 1 as int))"),
        grp=F.expr("if(k % 4 = 1, 'finance', null)"),
        contract_enforced=F.expr("k % 6 = 0"),
        unique_key=F.expr("if(k % 8 = 3, array('id'), cast(array() as array<string>))"),
        incremental_strategy=F.expr("if(k % 4 = 3 and k % 3 = 0, 'append', null)"),
        deprecation_date=F.expr("if(k % 23 = 5, '2024-01-01', null)"),
        language=F.lit("sql"),
        original_file_path=F.concat(F.lit("models/"), F.col("path")),
        package_name=F.expr("if(k % 10 = 9, 'vendor', 'bench')"),
    )
    read = rows(
        sources,
        description=F.expr("if(j % 2 = 1, null, 'Raw table')"),
        database=F.expr("if(j = 9, null, 'db')"),
        schema=F.lit("raw"),
        identifier=F.concat(F.lit("TBL_"), (F.col("j") % 9).cast("string")),
        warn_after=F.expr(f"if(j % 3 = 0, cast(named_struct('count', 12L, 'period', 'hour') as {FRESHNESS}), null)"),
        package_name=F.lit("bench"),
    )
    shown = rows(exposures, description=F.expr("if(i % 3 = 0, null, 'A dashboard')"), package_name=F.lit("bench"))
    return models.unionByName(read).unionByName(shown)


def _columns(m: DataFrame) -> DataFrame:
    listed = F.expr("""array(named_struct('pos', 0, 'name', 'id', 'data_type', 'int', 'description', if(k % 3 = 0, null, 'Key')),
        named_struct('pos', 1, 'name', 'c0000', 'data_type', if(k % 7 = 2, null, 'text'), 'description', if(k % 2 = 1, null, 'A value')),
        named_struct('pos', 2, 'name', 'C0001', 'data_type', 'text', 'description', cast(' ' as string)))""")
    return m.select("unique_id", F.inline(listed), F.array().cast(f"array<{CONSTRAINT}>").alias("constraints"))


def _tests(m: DataFrame) -> DataFrame:
    listed = F.expr("""filter(array(if(k % 2 = 0, named_struct('kind', 'not_null', 'column_name', 'id'), null), if(k % 3 = 0, named_struct('kind', 'unique', 'column_name', 'id'), null),
        if(k % 5 = 1, named_struct('kind', 'not_null', 'column_name', 'c0000'), null),
        if(k % 31 = 4, named_struct('kind', 'unique_combination_of_columns', 'column_name', cast(null as string)), null),
        if(layer = 'marts' and k % 4 = 0, named_struct('kind', 'unit', 'column_name', cast(null as string)), null)), x -> x is not null)""")
    null = F.lit(None).cast("string")
    return m.select("unique_id", "name", F.inline(listed)).select("unique_id", F.concat("kind", F.lit("_"), "name").alias("name"), "kind", "column_name", null.alias("ref_uid"), null.alias("ref_name"), null.alias("ref_column"))


def _catalog(m: DataFrame) -> DataFrame:
    """What the warehouse has: id as bigint where k % 4 = 2, no c0000 where k % 9 = 4, one more column where k % 8 = 1."""
    listed = F.expr("""filter(array(named_struct('column', 'ID', 'data_type', if(k % 4 = 2, 'bigint', 'INTEGER')),
        if(k % 9 = 4, null, named_struct('column', 'C0000', 'data_type', 'VARCHAR')), named_struct('column', 'c0001', 'data_type', 'text'),
        if(k % 8 = 1, named_struct('column', 'loaded_at', 'data_type', 'timestamp'), null)), x -> x is not null)""")
    return m.where("layer = 'marts'").select("unique_id", F.inline(listed))


def mutated(b: Bundle, sf_dir: str, write_edges: bool = True) -> Bundle:
    """A later state: every 211th model dropped, every 37th with other SQL, every 41st a table, every 43rd without its
    first test kind, every 47th with a longer column list, every 53rd without c0000, every 61st of the others with c0000
    renamed, every 59th with another type of id, four new marts. Edges are a written table, or a plan where few ask for them."""
    spark, b = b.spark, b.merging()
    m = _models(spark, sf_dir)
    gone = m.where("idx % 211 = 0").select("unique_id").hint("merge")
    flags = m.select("unique_id", "idx").hint("merge")  # of millions of models, which Spark takes for few by the compressed keys
    nodes = b.nodes.join(gone, "unique_id", "left_anti").join(flags, "unique_id", "left")
    nodes = nodes.withColumn("materialized", F.expr("if(idx % 41 = 0, 'table', materialized)")).drop("idx")
    fresh = m.where("layer = 'marts' and k < 4").select(F.col("unique_id").alias("parent"), F.concat(F.lit("model.bench.fct_new_"), F.col("k").cast("string")).alias("unique_id"), F.concat(F.lit("fct_new_"), F.col("k").cast("string")).alias("name"))
    nodes = nodes.unionByName(fresh.select("unique_id", "name", F.lit("model").alias("resource_type"), F.concat(F.lit("marts/"), "name", F.lit(".sql")).alias("path"), F.lit("table").alias("materialized")))
    nodes = written(nodes, "nodes")
    edges = b.edges.unionByName(fresh.select("parent", F.col("unique_id").alias("child")))
    alive = nodes.select("unique_id").hint("merge")
    from tributary.operators.traverse import pruned

    sql = b.node_sql.join(flags, "unique_id").withColumn("raw_code", F.expr("if(idx % 37 = 0, concat(raw_code, ' where id > 1'), raw_code)")).drop("idx").join(alive, "unique_id", "left_semi")
    tests = b.tests.join(flags, "unique_id").where("not (idx % 43 = 0 and kind = 'not_null')").drop("idx").join(alive, "unique_id", "left_semi")
    more = flags.where("idx % 47 = 0").join(alive, "unique_id", "left_semi").select("unique_id", F.lit(3).alias("pos"), F.lit("extra").alias("name"), F.lit("text").alias("data_type"), F.lit(None).cast("string").alias("description"), F.array().cast(f"array<{CONSTRAINT}>").alias("constraints"))
    columns = dealt(b.columns, "unique_id").join(flags, "unique_id").where("not (idx % 53 = 0 and name = 'c0000')")
    columns = columns.withColumns({"name": F.expr("if(idx % 61 = 0 and name = 'c0000', 'c0000b', name)"), "data_type": F.expr("if(idx % 59 = 0 and name = 'id', 'bigint', data_type)")})
    columns = columns.drop("idx").join(alive, "unique_id", "left_semi").unionByName(more)
    edges = pruned(edges, alive)
    return b.with_(nodes=nodes, edges=written(edges, "edges") if write_edges else edges, node_sql=sql, tests=tests, columns=columns, detail=b.detail.join(alive, "unique_id", "left_semi"))


def renamed_columns(later: Bundle, sf_dir: str) -> DataFrame:
    """unique_id of the models of ``later`` whose c0000 is c0000b."""
    m = _models(later.spark, sf_dir).where("idx % 61 = 0 and idx % 53 <> 0").select("unique_id")
    return m.hint("merge").join(later.nodes.select("unique_id"), "unique_id", "left_semi")


def _first_parent(b: Bundle) -> DataFrame:
    """unique_id and the call of each model's first parent by uid."""
    ends = b.nodes.select(F.col("unique_id").alias("parent"), F.when(F.col("resource_type") == "source", F.concat(F.lit("{{ source('raw', '"), "name", F.lit("') }}"))).otherwise(F.concat(F.lit("{{ ref('"), "name", F.lit("') }}"))).alias("call"))
    first = b.edges.join(ends, "parent").groupBy(F.col("child").alias("unique_id")).agg(F.min_by("call", "parent").alias("call"))
    return b.nodes.where("resource_type = 'model'").select("unique_id").join(first, "unique_id")


def with_code(b: Bundle, sf_dir: str, code: str) -> Bundle:
    """Models with a parent get ``code``, an expression over ``k``, ``name`` and ``call``."""
    m = _models(b.spark, sf_dir).select("unique_id", "k", "name")
    sql = _first_parent(b).join(m, "unique_id").select("unique_id", F.expr(code).alias("raw_code"), F.lit(None).cast("string").alias("compiled_code"), F.lit(False).alias("stale"))
    return b.with_(node_sql=written(sql, "code"), catalog_columns=b.catalog_columns.limit(0))


#: One fault a model, by k % 9.
FAULTS = """element_at(array(concat('select * from ', call), concat('select a.id from ', call, ' a, ', call, ' b'), concat('select id, c0000 as id from ', call),
 concat('with q as (select id from ', call, '), r as (select id from ', call, ') select id from q'), concat('select id from ', call, ' order by id'), 'drop table x',
 concat('select a.nope from ', call, ' a'), 'select id from raw.orders', concat('select id\\nfrom ', call, '\\n\\nwhere id > 1')), cast(k % 9 + 1 as int))"""
#: One reference a model, by k % 8; stg_00009 is a model of the package vendor.
REFERENCES = """concat('select id from {{ ', element_at(array('ref(\\'nothing\\')', 'ref(\\'vendor\\', \\'stg_00009\\')', 'ref(\\'stg_00009\\')', 'source(\\'raw\\', \\'tbl_3\\')',
 'source(\\'raw\\', \\'none\\')', concat('ref(\\'', name, '\\')'), 'ref(\\'bench\\', \\'stg_00009\\')', 'ref(\\'far\\', \\'x\\')'), cast(k % 8 + 1 as int)), ' }}',
 if(k % 5 = 0, '{% if a %} join {{ ref(\\'perhaps\\') }} {% endif %}', ''))"""


def manifest_document(b: Bundle) -> DataFrame:
    """The bundle as the JSON text of a manifest, in lines in their order: a member each, as all of them would be too large a row."""
    b = b.merging()
    texts = F.array_sort(F.collect_list(F.struct("pos", "name", "data_type", "description")))
    columns = b.columns.groupBy("unique_id").agg(F.map_from_entries(F.transform(texts, lambda c: F.struct(c["name"], F.struct(c["name"].alias("name"), c["data_type"].alias("data_type"), c["description"].alias("description"))))).alias("columns")).hint("merge")
    up = b.edges.groupBy(F.col("child").alias("unique_id")).agg(F.struct(F.array_sort(F.collect_list("parent")).alias("nodes")).alias("depends_on")).hint("merge")
    rows = b.nodes.join(b.detail, "unique_id", "left").join(columns, "unique_id", "left").join(up, "unique_id", "left").join(b.node_sql.select("unique_id", "raw_code").hint("merge"), "unique_id", "left")
    config = F.struct("materialized", "unique_key", "incremental_strategy").alias("config")
    node = F.struct("name", "resource_type", "path", "original_file_path", "description", config, "columns", "tags", "meta", "depends_on", "raw_code", "package_name", "access", F.col("grp").alias("group"), F.struct(F.col("contract_enforced").alias("enforced")).alias("contract"), "deprecation_date")
    source = F.struct("name", "resource_type", "path", "description", "database", "schema", "identifier", "package_name", F.struct("warn_after", "error_after").alias("freshness"))
    exposure = F.struct("name", "path", "description", "package_name", "depends_on", F.lit("dashboard").alias("type"), F.struct(F.col("owner_name").alias("name")).alias("owner"))
    test = F.struct("name", F.lit("test").alias("resource_type"), F.col("unique_id").alias("attached_node"), "column_name", F.struct(F.col("kind").alias("name")).alias("test_metadata"), F.struct(F.array("unique_id").alias("nodes")).alias("depends_on"))
    unit = F.struct("name", F.col("model"), F.struct(F.array("unique_id").alias("nodes")).alias("depends_on"))
    models = rows.where("resource_type = 'model'").select("unique_id", node.alias("n"))
    plain = b.tests.where("kind <> 'unit'").select(F.concat_ws(".", F.lit("test.bench"), "name", F.coalesce("column_name", F.lit(""))).alias("id"), test.alias("n"))
    units = b.tests.where("kind = 'unit'").join(b.nodes.select("unique_id", F.col("name").alias("model")), "unique_id").select(F.concat(F.lit("unit_test.bench."), "name").alias("id"), unit.alias("n"))
    of = lambda rank, df, key, value: df.select(F.lit(rank).alias("rank"), F.col(key).alias("key"), F.to_json(value).alias("json"))
    members = of(2, models, "unique_id", "n").unionByName(of(2, plain, "id", "n")).unionByName(of(4, rows.where("resource_type = 'source'"), "unique_id", source))
    members = members.unionByName(of(6, rows.where("resource_type = 'exposure'").join(b.exposures, "unique_id"), "unique_id", exposure)).unionByName(of(8, units, "id", "n"))
    members = written(members, "members")
    first = members.groupBy("rank").agg(F.min("key").alias("first"))  # four rows
    name = F.to_json(F.array("key"))
    comma = F.when(F.col("key") == F.col("first"), "").otherwise(",")
    lines = members.join(F.broadcast(first), "rank").select("rank", "key", F.concat(comma, name.substr(F.lit(2), F.length(name) - 2), F.lit(":"), "json").alias("value"))
    frame = ['{"metadata":{"project_name":"bench","adapter_type":"duckdb"},"nodes":{', '},"sources":{', '},"exposures":{', '},"unit_tests":{', "}}"]
    frame = b.spark.createDataFrame([(2 * k + 1, "", line) for k, line in enumerate(frame)], "rank int, key string, value string")
    return lines.unionByName(frame).orderBy("rank", "key").select("value")


def with_joined_code(b: Bundle) -> Bundle:
    """Each model reads its first parent (by uid) and joins the second, whose value filters."""
    b = b.merging()
    ends = b.nodes.select(F.col("unique_id").alias("parent"), F.when(F.col("resource_type") == "source", F.concat(F.lit("{{ source('raw', '"), "name", F.lit("') }}"))).otherwise(F.concat(F.lit("{{ ref('"), "name", F.lit("') }}"))).alias("call"))
    kin = b.edges.join(ends, "parent").repartition("child").groupBy(F.col("child").alias("unique_id")).agg(F.array_sort(F.collect_list(F.struct("parent", "call"))).alias("p"))
    second = F.concat(F.lit(" join "), F.get("p", 1)["call"], F.lit(" p2 on p1.id = p2.id where p2.c0000 > 1"))
    code = F.concat(F.lit("select p1.id, p1.c0000 from "), F.get("p", 0)["call"], F.lit(" p1"), F.coalesce(second, F.lit("")))
    models = b.nodes.where("resource_type = 'model'").select("unique_id")
    sql = models.join(kin, "unique_id").select("unique_id", code.alias("raw_code"), F.lit(None).cast("string").alias("compiled_code"), F.lit(False).alias("stale"))
    return b.with_(node_sql=written(sql, "code"), catalog_columns=b.catalog_columns.limit(0))
