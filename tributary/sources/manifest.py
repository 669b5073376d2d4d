"""Artifact readers: manifest, catalog, run results, compiled SQL. A manifest file is read member by member (see
``fragments``), another JSON document as one text row, both with explicit schemas whose dynamic parts are maps, so uids never become columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.operators import traverse
from tributary.plans.bundle import CONSTRAINT, FRESHNESS, SCHEMAS, Bundle, bundle, universe_of
from tributary.session import written
from tributary.sources.fragments import fragments

_COLUMN = f"struct<name:string,data_type:string,description:string,constraints:array<{CONSTRAINT}>>"
_DEPENDS = "struct<nodes:array<string>,macros:array<string>>"
# meta, unique_key, version and kwargs take several shapes, so they are read as JSON text
NODE = (
    "struct<name:string,resource_type:string,path:string,original_file_path:string,patch_path:string,description:string,"
    "config:struct<materialized:string,unique_key:string,incremental_strategy:string,meta:map<string,string>>,"
    f"columns:map<string,{_COLUMN}>,tags:array<string>,meta:map<string,string>,depends_on:{_DEPENDS},raw_code:string,compiled_code:string,"
    "schema:string,database:string,package_name:string,alias:string,access:string,group:string,language:string,version:string,latest_version:string,"
    f"deprecation_date:string,relation_name:string,contract:struct<enforced:boolean>,constraints:array<{CONSTRAINT}>,"
    "test_metadata:struct<name:string,kwargs:map<string,string>>,attached_node:string,column_name:string>"
)
SOURCE = (
    "struct<name:string,resource_type:string,path:string,original_file_path:string,description:string,schema:string,database:string,package_name:string,"
    f"identifier:string,relation_name:string,loaded_at_field:string,loader:string,columns:map<string,{_COLUMN}>,meta:map<string,string>,tags:array<string>,"
    f"freshness:struct<warn_after:{FRESHNESS},error_after:{FRESHNESS}>>"
)
EXPOSURE = f"struct<name:string,type:string,url:string,description:string,path:string,original_file_path:string,tags:array<string>,meta:map<string,string>,package_name:string,owner:struct<name:string,email:string>,depends_on:{_DEPENDS}>"
SEMANTIC = f"struct<name:string,description:string,path:string,original_file_path:string,package_name:string,depends_on:{_DEPENDS}>"
UNIT_TEST = f"struct<name:string,model:string,package_name:string,version:string,depends_on:{_DEPENDS}>"
MACRO = f"struct<name:string,macro_sql:string,arguments:array<struct<name:string>>,depends_on:{_DEPENDS}>"
MANIFEST = (
    "struct<metadata:struct<project_name:string,adapter_type:string>,"
    f"nodes:map<string,{NODE}>,sources:map<string,{SOURCE}>,exposures:map<string,{EXPOSURE}>,semantic_models:map<string,{SEMANTIC}>,metrics:map<string,{SEMANTIC}>,"
    f"saved_queries:map<string,{SEMANTIC}>,unit_tests:map<string,{UNIT_TEST}>,macros:map<string,{MACRO}>,docs:map<string,struct<block_contents:string,package_name:string>>,"
    "disabled:map<string,string>,parent_map:map<string,array<string>>,child_map:map<string,array<string>>>"
)
# Resource types that are known but not handled in full.
UNSUPPORTED = ("rpc", "sql_operation", "sql operation", "function", "fixture", "group", "doc", "macro")
HANDLED = ("model", "seed", "snapshot", "source", "exposure", "metric", "semantic_model", "saved_query", "unit_test")
CATALOG = "struct<nodes:map<string,struct<columns:map<string,struct<type:string>>,stats:map<string,struct<value:string,include:boolean>>>>,sources:map<string,struct<columns:map<string,struct<type:string>>,stats:map<string,struct<value:string,include:boolean>>>>>"
RUNS = "struct<results:array<struct<unique_id:string,status:string,execution_time:double>>>"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _document(text: DataFrame, schema: str, what: str) -> DataFrame:
    d = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d"), F.try_parse_json("value").alias("v"))
    if not d.where("v is null").isEmpty():
        raise ValueError(f"the {what} isn't a JSON document")
    return d.select("d.*")


def _items(doc: DataFrame, name: str) -> DataFrame:
    return doc.select(F.explode(name).alias("unique_id", "n"))


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _blank(c: Column) -> Column:
    return F.when(N.present(c), c)


def _scalar_or_list(c: Column) -> Column:
    """A JSON string or list of strings as an array without blanks."""
    listed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.filter(listed, N.present))


def manifest(spark: SparkSession, path: str) -> Bundle:
    """A manifest file, or a folder of its parts in the order of their names; read member by member, whatever its size."""
    try:
        return _from_items(_Fragments(fragments(spark, path)))
    except ValueError as e:
        raise ValueError("the manifest isn't a JSON document") from e


def manifest_text(spark: SparkSession, text: str) -> Bundle:
    return from_document(spark.createDataFrame([(text,)], "value string"))


class _Row:
    """A manifest as one row."""

    def __init__(self, doc: DataFrame) -> None:
        self.doc = doc

    def items(self, name: str) -> DataFrame:
        return self.doc.select(F.explode(name).alias("unique_id", "n"))

    def fields(self) -> dict[str, str]:
        return self.doc.select("metadata.project_name", "metadata.adapter_type").first().asDict()

    def has_maps(self) -> bool:
        return not self.doc.where("parent_map is not null or child_map is not null").isEmpty()


class _Fragments:
    """A manifest as a row a member (section, text)."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.kinds = dict(f.split(":", 1) for f in _split_schema(MANIFEST.removeprefix("struct<").removesuffix(">")))

    def items(self, name: str) -> DataFrame:
        own = self.rows.where(F.col("section") == name)
        return own.select(F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), self.kinds[name])).alias("unique_id", "n"))

    def fields(self) -> dict[str, str]:
        own = self.rows.where("section = 'metadata'").select(F.explode(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")).alias("k", "v"))
        return {"project_name": None, "adapter_type": None} | {r["k"]: r["v"] for r in own.where("k in ('project_name', 'adapter_type')").collect()}

    def has_maps(self) -> bool:
        return not self.rows.where("section in ('parent_map', 'child_map')").isEmpty()


def from_document(text: DataFrame) -> Bundle:
    return _from_items(_Row(written(_document(text, MANIFEST, "manifest"), "manifest")))


def _from_items(doc: _Row | _Fragments) -> Bundle:
    every = written(doc.items("nodes"), "manifest-nodes")
    spark = every.sparkSession
    keep = every.where(~F.coalesce("n.resource_type", F.lit("")).isin(*N.EXCLUDED_TYPES))
    null = F.lit(None).cast("string")
    row = lambda d, kind, materialized=null: d.select("unique_id", F.col("n.name").alias("name"), kind.alias("resource_type"), F.coalesce("n.path", "n.original_file_path").alias("path"), materialized.alias("materialized"))
    terminals = {"exposure": "exposures", "semantic_model": "semantic_models", "metric": "metrics", "saved_query": "saved_queries"}
    nodes = row(keep, F.col("n.resource_type"), F.col("n.config.materialized")).unionByName(row(doc.items("sources"), F.lit("source")))
    wanted = doc.items("parent_map").select(F.col("unique_id").alias("child"), F.explode("n").alias("parent"))
    below = doc.items("child_map").select(F.col("unique_id").alias("parent"), F.explode("n").alias("child"))
    edges = wanted.unionByName(below.select("child", "parent"))
    own = keep.select(F.col("unique_id").alias("child"), F.explode("n.depends_on.nodes").alias("parent"))
    edges = edges if doc.has_maps() else edges.unionByName(own)
    for kind, name in terminals.items():
        items = doc.items(name)
        nodes = nodes.unionByName(row(items, F.lit(kind)))
        edges = edges.unionByName(items.select(F.col("unique_id").alias("child"), F.explode("n.depends_on.nodes").alias("parent")))
    nodes = written(nodes, "nodes")
    merged = nodes.hint("merge")  # by the size of its compressed files Spark would have the driver broadcast the ids of all nodes
    edges = written(traverse.pruned(edges.select("parent", "child").distinct(), merged), "edges")
    info = doc.fields()
    root = info["project_name"]
    shown = doc.items("docs").where(F.col("unique_id") == f"doc.{root}.__overview__").select("n.block_contents").first()
    overview = shown and shown["block_contents"]
    kinds = {r["resource_type"]: r["n"] for r in keep.groupBy(F.col("n.resource_type").alias("resource_type")).agg(F.count("*").alias("n")).collect()}
    warnings = [f"{n} nodes of {'unsupported' if k in UNSUPPORTED else 'unknown'} type {k}" for k, n in sorted(kinds.items(), key=lambda x: str(x[0])) if k not in HANDLED]
    macros = doc.items("macros")
    parked = doc.items("disabled").select("unique_id").where("size(split(unique_id, '[.]')) between 3 and 4")
    seg = F.split("unique_id", r"\.")
    parked = parked.select("unique_id", F.when(seg[0] == "source", F.get(seg, 3)).otherwise(seg[2]).alias("name"), seg[0].alias("resource_type"))
    # tests, analyses and operations answer a call by name too, though they are no nodes of the graph
    other = every.where(F.col("n.resource_type").isin(*N.EXCLUDED_TYPES)).select("unique_id", F.col("n.name").alias("name"), F.lit("seed").alias("resource_type"))
    universe = universe_of(nodes.select("unique_id", "name", "resource_type").unionByName(other)).unionByName(universe_of(parked).withColumn("disabled", F.lit(True)))
    return bundle(
        spark, nodes, edges,
        detail=written(_details(doc, keep, terminals), "detail"),
        columns=_columns(keep).unionByName(_columns(doc.items("sources"))),
        tests=written(_tests(doc, every, merged), "tests"),
        node_sql=keep.where("n.raw_code is not null or n.compiled_code is not null").select("unique_id", F.col("n.raw_code").alias("raw_code"), F.col("n.compiled_code").alias("compiled_code"), F.lit(False).alias("stale")),
        exposures=doc.items("exposures").select("unique_id", F.col("n.type").alias("exposure_type"), F.col("n.owner.name").alias("owner_name"), F.col("n.owner.email").alias("owner_email"), F.col("n.url").alias("url")),
        macros=macros.select(F.col("unique_id").alias("uid"), F.col("n.name").alias("name"), F.col("n.macro_sql").alias("sql"), F.transform(F.coalesce("n.arguments", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]).alias("params")),
        macro_edges=macros.select(F.col("unique_id").alias("caller"), F.explode("n.depends_on.macros").alias("callee")),
        node_macros=keep.select("unique_id", F.explode("n.depends_on.macros").alias("macro_uid")),
        universe=written(universe, "universe"), root_project=root, adapter_type=info["adapter_type"], overview=overview, warnings=warnings,
    )


def _columns(items: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("n.columns"), lambda e, i: F.struct(
        i.alias("pos"), F.coalesce(e["value"]["name"], e["key"]).alias("name"), e["value"]["data_type"].alias("data_type"), _blank(e["value"]["description"]).alias("description"),
        F.coalesce(e["value"]["constraints"], F.array().cast(f"array<{CONSTRAINT}>")).alias("constraints"),
    ))
    return items.select("unique_id", F.inline(entries))


def _details(doc: _Row | _Fragments, keep: DataFrame, terminals: dict[str, str]) -> DataFrame:
    fields = [(f.split(" ")[0], f.split(" ", 1)[1]) for f in _split_schema(SCHEMAS["detail"])][1:]

    def rows(items: DataFrame, **own: Column) -> DataFrame:
        none = {"tags": _texts(F.lit(None).cast("array<string>")), "unique_key": _texts(F.lit(None).cast("array<string>")), "semantic_dependents": _texts(F.lit(None).cast("array<string>"))}
        return items.select("unique_id", *[own.get(n, none.get(n, F.lit(None))).cast(t).alias(n) for n, t in fields])

    c = F.col
    meta = F.transform_values(F.coalesce("n.meta", "n.config.meta", F.create_map().cast("map<string,string>")), lambda _, v: N.meta_string(v))
    semantic = [doc.items(n).select(F.explode("n.depends_on.nodes").alias("unique_id"), c("unique_id").alias("d")) for k, n in terminals.items() if k != "exposure"]
    dependents = semantic[0].unionByName(semantic[1]).unionByName(semantic[2]).groupBy("unique_id").agg(F.array_sort(F.collect_set("d")).alias("dependents"))
    models = rows(
        keep.join(dependents, "unique_id", "left"),
        description=_blank(c("n.description")), tags=_texts(c("n.tags")), meta=meta, access=c("n.access"), grp=c("n.group"), contract_enforced=c("n.contract.enforced"),
        unique_key=_scalar_or_list(c("n.config.unique_key")), incremental_strategy=c("n.config.incremental_strategy"), deprecation_date=c("n.deprecation_date"), language=c("n.language"),
        version=c("n.version"), latest_version=c("n.latest_version"), database=c("n.database"), schema=c("n.schema"), identifier=c("n.alias"), relation_name=c("n.relation_name"),
        original_file_path=N.normal_path(c("n.original_file_path")), patch_path=N.project_path(c("n.patch_path")), package_name=c("n.package_name"), semantic_dependents=_texts(c("dependents")), constraints=c("n.constraints"),
    )
    plain = F.transform_values(F.coalesce("n.meta", F.create_map().cast("map<string,string>")), lambda _, v: N.meta_string(v))
    sources = rows(
        doc.items("sources"),
        description=_blank(c("n.description")), tags=_texts(c("n.tags")), meta=plain, database=c("n.database"), schema=c("n.schema"), identifier=c("n.identifier"), relation_name=c("n.relation_name"),
        original_file_path=N.normal_path(c("n.original_file_path")), package_name=c("n.package_name"), loaded_at_field=c("n.loaded_at_field"), loader=c("n.loader"),
        warn_after=F.when(c("n.freshness.warn_after.count").isNotNull(), c("n.freshness.warn_after")), error_after=F.when(c("n.freshness.error_after.count").isNotNull(), c("n.freshness.error_after")),
    )
    out = models.unionByName(sources)
    for kind, name in terminals.items():
        extra = {"tags": _texts(c("n.tags")), "meta": plain} if kind == "exposure" else {}
        out = out.unionByName(rows(doc.items(name), description=_blank(c("n.description")), original_file_path=N.normal_path(c("n.original_file_path")), package_name=c("n.package_name"), **extra))
    return out


def _split_schema(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def _tests(doc: _Row | _Fragments, every: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tests belong to their attached node, else to every node they depend on; unit tests to the model they name."""
    t = every.where("n.resource_type = 'test'")
    on = F.when(F.col("n.attached_node").isNotNull(), F.array("n.attached_node")).otherwise(_texts(F.col("n.depends_on.nodes")))
    other = F.array_sort(F.filter(_texts(F.col("n.depends_on.nodes")), lambda x: ~x.eqNullSafe(F.col("n.attached_node"))))
    relation = F.col("n.test_metadata.name") == "relationships"
    rows = t.select(
        F.explode(on).alias("unique_id"), F.col("n.name").alias("name"), F.coalesce("n.test_metadata.name", F.lit("singular")).alias("kind"),
        F.coalesce("n.column_name", F.col("n.test_metadata.kwargs")["column_name"]).alias("column_name"), F.when(relation, F.get(other, 0)).alias("ref_uid"),
        F.when(relation, F.col("n.test_metadata.kwargs")["field"]).alias("ref_column"),
    )
    rows = rows.join(nodes.select("unique_id"), "unique_id", "left_semi")
    names = nodes.select(F.col("unique_id").alias("ref_uid"), F.col("name").alias("ref_name"))
    rows = rows.join(names, "ref_uid", "left").select("unique_id", "name", "kind", "column_name", "ref_uid", "ref_name", "ref_column")
    units = doc.items("unit_tests").select("n", F.explode_outer(_texts(F.col("n.depends_on.nodes"))).alias("d"))
    target = nodes.where("resource_type = 'model'").select(F.col("unique_id").alias("target"), F.col("name").alias("target_name"))
    by_dep = units.join(target, F.col("d") == F.col("target")).select("n", "target", F.when(F.col("target").endswith(F.concat(F.lit(".v"), F.coalesce("n.version", F.lit("?")))), 0).when(F.col("target_name") == F.col("n.model"), 1).otherwise(2).alias("rank"))
    by_name = units.select("n.name", "n.model").distinct().join(target, F.col("model") == F.col("target_name")).select("name", "target", F.lit(3).alias("rank"))
    ranked = by_dep.select("n.name", "target", "rank").unionByName(by_name)
    best = ranked.groupBy("name").agg(F.min(F.struct("rank", "target")).alias("b"))
    null = F.lit(None).cast("string")
    return rows.unionByName(best.select(F.col("b.target").alias("unique_id"), "name", F.lit("unit").alias("kind"), null.alias("column_name"), null.alias("ref_uid"), null.alias("ref_name"), null.alias("ref_column")))


def catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(catalog_columns, catalog_stats); statistics that are marked as not included are left out."""
    return catalog_document(read_text(spark, path))


def catalog_document(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    doc = _document(text, CATALOG, "catalog")
    items = _items(doc, "nodes").unionByName(_items(doc, "sources"))
    columns = items.select("unique_id", F.explode("n.columns").alias("column", "c")).select("unique_id", "column", F.col("c.type").alias("data_type"))
    stats = items.select("unique_id", F.explode("n.stats").alias("stat", "s")).where("coalesce(s.include, true)").select("unique_id", "stat", F.col("s.value").alias("value"))
    return columns, stats


def run_results(spark: SparkSession, path: str) -> DataFrame:
    return run_results_document(read_text(spark, path))


def run_results_document(text: DataFrame) -> DataFrame:
    """The last result of each node counts."""
    doc = _document(text, RUNS, "run results")
    each = doc.select(F.posexplode("results").alias("pos", "r")).where("r.unique_id is not null")
    last = each.groupBy(F.col("r.unique_id").alias("unique_id")).agg(F.max_by("r", "pos").alias("r"))
    return last.select("unique_id", F.col("r.status").alias("status"), F.col("r.execution_time").alias("execution_time"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """at (path below ``folder``), modificationTime and text of the SQL files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.sql").load(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getPath().rstrip("/") + "/"
    at = F.expr("substring(path, locate(root, path) + length(root))")
    return files.withColumn("root", F.lit(root)).select(at.alias("at"), "modificationTime", F.decode("content", "UTF-8").alias("text"))


def with_compiled(b: Bundle, folder: str, project_dir: str | None = None) -> Bundle:
    """Compiled text from ``folder``/package/original path for nodes that have none. Paths that climb out of the folder match
    nothing, since files are listed, not opened by name.

    With ``project_dir``, text is stale where the node's own file is newer than the compiled one. The project's nodes have theirs
    below the project's folder, those of other packages below ``dbt_packages`` or ``dbt_internal_packages`` there and nowhere
    else; a file that isn't found tells nothing."""
    found = _files(b.spark, folder).withColumnsRenamed({"modificationTime": "compiled_at"})
    own = b.detail.select("unique_id", F.concat(F.coalesce("package_name", F.lit(b.root_project)), F.lit("/"), "original_file_path").alias("at"), "package_name", "original_file_path")
    joined = b.nodes.where(F.col("resource_type").isin("model", "snapshot")).select("unique_id").join(own, "unique_id").join(found, "at")
    if project_dir is not None:
        local = F.col("package_name").isNull() | (F.col("package_name") == F.lit(b.root_project))
        places = F.when(local, F.array("original_file_path")).otherwise(
            F.array(*[F.concat(F.lit(f"{d}/"), "package_name", F.lit("/"), "original_file_path") for d in ("dbt_packages", "dbt_internal_packages")])
        )
        sources = _files(b.spark, project_dir).select(F.col("at").alias("place"), "modificationTime")
        newer = joined.select("unique_id", "compiled_at", F.explode(places).alias("place")).join(sources, "place").where("modificationTime > compiled_at")
        joined = joined.join(newer.select("unique_id").distinct().withColumn("newer", F.lit(True)), "unique_id", "left")
    else:
        joined = joined.withColumn("newer", F.lit(False))
    sql = b.node_sql.join(joined.select("unique_id", "text", F.coalesce("newer", F.lit(False)).alias("newer")), "unique_id", "full_outer")
    stale = F.coalesce("stale", F.lit(False)) | (F.col("compiled_code").isNull() & F.coalesce("newer", F.lit(False)))
    return b.with_(node_sql=sql.select("unique_id", "raw_code", F.coalesce("compiled_code", "text").alias("compiled_code"), stale.alias("stale")))
