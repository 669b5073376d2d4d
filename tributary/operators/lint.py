"""Lint: one DataFrame for each rule, then severity, suppression, baseline and gate status.

A rule is a function of a bundle and its options that returns (unique_id, related): the node it finds fault with, and
the nodes or names that are to blame. Rules over SQL text read ``facts`` (see ``functions.sql_facts``).

Most rules are conditions on one node, or on the two ends of one edge. They are declared as such (``node_rule``,
``edge_rule``), so that ``findings`` evaluates all of them in one pass over the nodes and one over the edges.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.functions import sql_text as S
from tributary.functions.types import types_equivalent
from tributary.operators import attributes, impact, traverse
from tributary.operators.select import select
from tributary.plans.bundle import Bundle
from tributary.session import written


Rule = Callable[[Bundle, Mapping], DataFrame]
#: A condition on a row, and what is related (null: nothing), from the options.
NodeTest = Callable[[Mapping], tuple[Column, Column | None]]
#: A condition on an edge whose ends' columns are named ``p_`` and ``c_``, and the least number of such parents.
EdgeTest = Callable[[Mapping], tuple[Column, int]]


@dataclass(frozen=True)
class Spec:
    id: str
    category: str
    severity: str
    default: bool
    needs: str
    run: Rule
    message: str
    node: NodeTest | None = None
    edge: EdgeTest | None = None


RULES: dict[str, Spec] = {}


def rule(id_: str, category: str, message: str, severity: str = "warn", default: bool = True, needs: str = "graph") -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        RULES[id_] = Spec(id_, category, severity, default, needs, lambda b, o: f(b.merging(), o), message)
        return f

    return add


def node_rule(id_: str, category: str, message: str, **more: object) -> Callable[[NodeTest], NodeTest]:
    def add(f: NodeTest) -> NodeTest:
        def run(b: Bundle, o: Mapping) -> DataFrame:
            hit, related = f(o)
            return _found(_wide(b).where(hit), related)

        rule(id_, category, message, **more)(run)  # type: ignore[arg-type]
        RULES[id_] = replace(RULES[id_], node=f)
        return f

    return add


def edge_rule(id_: str, category: str, message: str, **more: object) -> Callable[[EdgeTest], EdgeTest]:
    def add(f: EdgeTest) -> EdgeTest:
        def run(b: Bundle, o: Mapping) -> DataFrame:
            hit, least = f(o)
            out = _ends(b).where(hit).groupBy(F.col("child").alias("unique_id")).agg(F.array_sort(F.collect_set("parent")).alias("related"))
            return out.where(F.size("related") >= least)

        rule(id_, category, message, **more)(run)  # type: ignore[arg-type]
        RULES[id_] = replace(RULES[id_], edge=f)
        return f

    return add


_DETAIL = ("description", "access", "contract_enforced", "unique_key", "incremental_strategy", "warn_after", "error_after", "meta", "deprecation_date")


def _wide(b: Bundle) -> DataFrame:
    """Nodes with the details that rules ask for."""
    return b.nodes.join(b.detail.select("unique_id", F.lit(True).alias("detailed"), *_DETAIL), "unique_id", "left")


def _ends(b: Bundle) -> DataFrame:
    """Edges with what rules ask for of both ends."""
    columns = ("name", "resource_type", "path", "materialized", "access", "deprecation_date")
    end = lambda node, p: _wide(b).select(F.col("unique_id").alias(node), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return b.edges.join(end("parent", "p"), "parent").join(end("child", "c"), "child")


def _is(*types: str, of: str = "resource_type") -> Column:
    return F.col(of).isin(*types)


def _zone(end: str) -> Column:
    return N.lint_layer(F.col(f"{end}_name"), F.col(f"{end}_path"))


def _found(df: DataFrame, related: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("unique_id", (related if related is not None else none).alias("related"))


def _models(b: Bundle) -> DataFrame:
    return b.nodes.where("resource_type = 'model'")


def _of(b: Bundle, *types: str) -> DataFrame:
    return b.nodes.where(F.col("resource_type").isin(*types))


def _documented(b: Bundle, *columns: str) -> DataFrame:
    return b.nodes.join(b.detail.select("unique_id", *columns), "unique_id")


def _families(b: Bundle) -> DataFrame:
    return b.nodes.select("unique_id", "resource_type", F.when(F.col("resource_type") == "model", N.family_name(F.col("unique_id"), F.col("name"))).otherwise(F.col("unique_id")).alias("family"))


def _typed(b: Bundle, o: Mapping) -> DataFrame:
    """Edges between known nodes with the types and families of both ends; ``findings`` writes them once for all its rules."""
    if o.get("typed") is not None:
        return o["typed"]
    end = lambda node, p: _families(b).select(F.col("unique_id").alias(node), F.col("resource_type").alias(f"{p}_type"), F.col("family").alias(f"{p}_family"))
    return b.edges.join(end("parent", "p"), "parent").join(end("child", "c"), "child")


@rule("direct_join_to_source", "modeling", "joins a source to a model")
def direct_join_to_source(b: Bundle, o: Mapping) -> DataFrame:
    read = _typed(b, o).where(_is("model", of="c_type") & _is("source", "model", of="p_type")).groupBy(F.col("child").alias("unique_id"))
    sources = F.array_sort(F.collect_set(F.when(F.col("p_type") == "source", F.col("parent"))))
    return _found(read.agg(sources.alias("related"), F.bool_or(F.col("p_type") == "model").alias("joined")).where("joined and size(related) > 0"), F.col("related"))


def _never_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        apart = [not S.read_together(r.raw_code, list(r.related)) for r in pdf.itertuples(index=False)]
        yield pdf.loc[apart, ["unique_id"]]


@rule("multiple_sources_joined", "modeling", "reads several sources")
def multiple_sources_joined(b: Bundle, o: Mapping) -> DataFrame:
    """Sources that only exclusive template arms read never meet in one rendering, and don't count."""
    ends = _ends(b).where(_is("model", of="c_resource_type") & _is("source", of="p_resource_type"))
    found = ends.groupBy(F.col("child").alias("unique_id")).agg(F.array_sort(F.collect_set("parent")).alias("related")).where(F.size("related") > 1)
    branching = b.node_sql.where(F.col("raw_code").rlike(r"\{%-?\s*(elif|else)\b")).select("unique_id", "raw_code")
    apart = found.join(branching, "unique_id").mapInPandas(_never_together, "unique_id string")
    return found.join(apart, "unique_id", "left_anti")


def _fan_out(edges: DataFrame, threshold: int) -> DataFrame:
    out = edges.groupBy(F.col("parent").alias("unique_id")).agg(F.count_distinct("c_family").alias("n"), F.array_sort(F.collect_set("child")).alias("related"))
    return _found(out.where(F.col("n") >= threshold), F.col("related"))


@rule("source_fanout", "modeling", "a source feeds several models")
def source_fanout(b: Bundle, o: Mapping) -> DataFrame:
    return _fan_out(_typed(b, o).where(_is("source", of="p_type") & _is("model", of="c_type")), o.get("threshold", 2))


def _unrecorded(b: Bundle, o: Mapping, side: str) -> DataFrame:
    """Nodes with parents or children that the recorded graph can't show: cut off by a package scope, or named by a
    reference (``calls``, see ``lineage.resolved_references``) to which no edge belongs."""
    cut = b.pruned_adjacent.where(F.col(side) > 0).select("unique_id")
    calls = o.get("calls")
    if calls is None:
        return cut
    if side == "parents":
        lost = calls.where("verdict <> 'missing'").join(b.edges.select(F.col("child").alias("unique_id"), F.col("parent").alias("target")), ["unique_id", "target"], "left_anti")
        return cut.unionByName(lost.select("unique_id")).distinct()
    lost = calls.where("target is not null").join(b.edges.select(F.col("child").alias("unique_id"), F.col("parent").alias("target")), ["unique_id", "target"], "left_anti")
    return cut.unionByName(lost.select(F.col("target").alias("unique_id"))).distinct()


@rule("model_fanout", "modeling", "feeds many models that nothing else reads")
def model_fanout(b: Bundle, o: Mapping) -> DataFrame:
    """A leaf feeds no data itself, as far as can be known; what may read the hub counts as reading it."""
    e = _typed(b, o)
    inner = e.where(_is(*N.DATA_TYPES, of="c_type")).select(F.col("parent").alias("child")).unionByName(_unrecorded(b, o, "children").select(F.col("unique_id").alias("child")))
    if o.get("calls") is not None:
        possible = o["calls"].where("target is not null").select(F.col("target").alias("parent"), F.col("unique_id").alias("child"))
        e = _typed(b.with_(edges=b.edges.unionByName(possible).distinct()), {})
    models = e.where(_is("model", of="p_type") & _is("model", of="c_type"))
    return _fan_out(models.join(inner.hint("merge"), "child", "left_anti"), o.get("threshold", 5))


@rule("root_models", "modeling", "has no parents")
def root_models(b: Bundle, o: Mapping) -> DataFrame:
    out = _models(b).join(b.edges.select(F.col("child").alias("unique_id")), "unique_id", "left_anti")
    return _found(out.join(_unrecorded(b, o, "parents"), "unique_id", "left_anti"))


@rule("rejoining_upstream", "modeling", "its only child also reads its parent")
def rejoining_upstream(b: Bundle, o: Mapping) -> DataFrame:
    """Any node that carries data, with one child that does; consumers of other kinds don't count as uses."""
    e = _typed(b, o).where(_is(*N.DATA_TYPES, of="p_type") & _is(*N.DATA_TYPES, of="c_type"))
    only = e.groupBy(F.col("parent").alias("b")).agg(F.count("*").alias("n"), F.min("child").alias("c")).where("n = 1").select("b", "c")
    only = only.join(_unrecorded(b, o, "children").select(F.col("unique_id").alias("b")), "b", "left_anti")
    up = e.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    both = up.join(only.hint("merge"), "b").join(e.select(F.col("parent").alias("a"), F.col("child").alias("c")), ["a", "c"], "left_semi")
    for spec in o.get("ignore_shared_parents", ()):
        both = both.join(select(b, spec).withColumnRenamed("unique_id", "a"), "a", "left_anti")
    return _found(both.groupBy(F.col("b").alias("unique_id")).agg(F.array_sort(F.array_union(F.collect_set("a"), F.collect_set("c"))).alias("related")), F.col("related"))


@edge_rule("marts_depend_on_source", "modeling", "reads a source past staging")
def marts_depend_on_source(o: Mapping) -> tuple[Column, int]:
    return _is("model", of="c_resource_type") & _zone("c").isin("marts", "intermediate") & _is("source", of="p_resource_type"), 1


@rule("missing_primary_key_tests", "testing", "no test guarantees a key", severity="error")
def missing_primary_key_tests(b: Bundle, o: Mapping) -> DataFrame:
    out = _of(b, *o.get("types", ("model",))).join(attributes.primary_keys(b), "unique_id", "left_anti")
    if o.get("accept_constraints"):
        keyed = b.detail.where(F.exists("constraints", lambda c: c["type"] == "primary_key")).select("unique_id")
        out = out.join(keyed, "unique_id", "left_anti")
    return _found(out)


@node_rule("public_models_without_contract", "governance", "public without a contract", severity="error")
def public_models_without_contract(o: Mapping) -> tuple[Column, Column | None]:
    return F.expr("detailed and resource_type = 'model' and access = 'public' and not coalesce(contract_enforced, false)"), None


def _undocumented(*types: str) -> Column:
    return F.col("detailed") & _is(*types) & F.col("description").isNull()


@node_rule("undocumented_models", "documentation", "has no description")
def undocumented_models(o: Mapping) -> tuple[Column, Column | None]:
    return _undocumented(*o.get("types", ("model",))), None


@node_rule("naming_conventions", "structure", "its name lacks its layer's prefix")
def naming_conventions(o: Mapping) -> tuple[Column, Column | None]:
    prefixes = o.get("prefixes", N.PREFIXES)
    at = N.lint_layer(F.col("name"), F.col("path"), prefixes)
    wrong = F.lit(False)
    for layer, starts in prefixes.items():
        good = F.lit(False)
        for s in starts:
            good = good | F.col("name").startswith(s)
        wrong = wrong | ((at == layer) & ~good)
    return _is("model") & wrong, None


@rule("layer_violation", "modeling", "reads a later layer")
def layer_violation(b: Bundle, o: Mapping) -> DataFrame:
    return _found(impact.layer_violations(b).withColumnRenamed("child", "unique_id"), F.array("parent"))


@rule("unused_sources", "modeling", "nothing reads the source")
def unused_sources(b: Bundle, o: Mapping) -> DataFrame:
    return _found(_of(b, "source").join(b.edges.select(F.col("parent").alias("unique_id")), "unique_id", "left_anti"))


@rule("duplicate_sources", "modeling", "declared more than once")
def duplicate_sources(b: Bundle, o: Mapping) -> DataFrame:
    """Pairs, not classes: a missing database matches any."""
    s = _documented(b, "database", "schema", "identifier").where("resource_type = 'source' and schema is not null")
    s = s.select("unique_id", F.lower("database").alias("db"), F.lower("schema").alias("sc"), F.lower(F.coalesce("identifier", "name")).alias("id"))
    other = s.select(F.col("unique_id").alias("other"), F.col("db").alias("db2"), "sc", "id")
    pairs = s.join(other, ["sc", "id"]).where("unique_id <> other and (db is null or db2 is null or db = db2)")
    return pairs.groupBy("unique_id").agg(F.array_sort(F.collect_set("other")).alias("related"))


@edge_rule("staging_depends_on_staging", "modeling", "staging reads staging")
def staging_depends_on_staging(o: Mapping) -> tuple[Column, int]:
    return _is("model", of="c_resource_type") & _is("model", of="p_resource_type") & (_zone("c") == "staging") & (_zone("p") == "staging"), 1


@rule("too_many_joins", "modeling", "reads too many parents")
def too_many_joins(b: Bundle, o: Mapping) -> DataFrame:
    e = _typed(b, o).where(_is("model", of="c_type") & _is(*N.DATA_TYPES, of="p_type"))
    out = e.groupBy(F.col("child").alias("unique_id")).agg(F.count_distinct("p_family").alias("n"), F.array_sort(F.collect_set("parent")).alias("related"))
    return _found(out.where(F.col("n") >= o.get("threshold", 7)), F.col("related"))


@rule("chained_views", "performance", "ends a long chain of views")
def chained_views(b: Bundle, o: Mapping) -> DataFrame:
    virtual = _models(b).where(F.col("materialized").isin("view", "ephemeral"))
    e = traverse.pruned(b.edges, virtual)
    depth = traverse.layering(virtual, e)
    ends = depth.where(F.col("col") + 1 >= o.get("threshold", 5)).join(e.select(F.col("parent").alias("unique_id")), "unique_id", "left_anti")
    return _found(ends, F.array((F.col("col") + 1).cast("string")))


@edge_rule("exposure_parents_materializations", "performance", "an exposure reads a source or a view")
def exposure_parents_materializations(o: Mapping) -> tuple[Column, int]:
    slow = F.expr("p_resource_type = 'source' or (p_resource_type = 'model' and p_materialized in ('view', 'ephemeral'))")
    return _is("exposure", of="c_resource_type") & slow, 1


@edge_rule("exposures_dependent_on_private_models", "governance", "an exposure reads a model that isn't public")
def exposures_dependent_on_private_models(o: Mapping) -> tuple[Column, int]:
    allowed = o.get("allowed", ("public",))
    closed = _is("model", of="p_resource_type") & F.col("p_access").isNotNull() & ~F.col("p_access").isin(*allowed)
    return (_is("exposure", of="c_resource_type") & closed if allowed else F.lit(False)), 1


@node_rule("undocumented_sources", "documentation", "has no description")
def undocumented_sources(o: Mapping) -> tuple[Column, Column | None]:
    return _undocumented("source"), None


@rule("undocumented_columns", "documentation", "columns without description")
def undocumented_columns(b: Bundle, o: Mapping) -> DataFrame:
    bare = b.columns.where(~N.present(F.col("description"))).groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("c"))
    return _found(bare.join(b.nodes.select("unique_id"), "unique_id", "left_semi"), F.transform("c", lambda x: x["name"]))


@node_rule("model_directories", "structure", "name and directory disagree on the layer")
def model_directories(o: Mapping) -> tuple[Column, Column | None]:
    by_name, by_path = N.prefix_layer(F.col("name")), N.directory_layer(F.col("path"))
    return _is("model") & (by_name != by_path), F.array(by_name, by_path)


@node_rule("required_meta_keys", "governance", "lacks meta keys")
def required_meta_keys(o: Mapping) -> tuple[Column, Column | None]:
    keys = F.array(*[F.lit(k) for k in o.get("keys", ())]).cast("array<string>")
    lack = F.array_except(keys, F.coalesce(F.map_keys("meta"), F.array().cast("array<string>")))
    return F.col("detailed") & _is("model") & (F.size(lack) > 0), lack


@rule("contract_columns_without_type", "governance", "contracted columns without a type")
def contract_columns_without_type(b: Bundle, o: Mapping) -> DataFrame:
    untyped = b.columns.where("data_type is null").groupBy("unique_id").agg(F.array_sort(F.collect_list("name")).alias("related"))
    return _found(untyped.join(b.detail.where("contract_enforced").select("unique_id"), "unique_id", "left_semi").join(_models(b).select("unique_id"), "unique_id", "left_semi"), F.col("related"))


@node_rule("incremental_without_unique_key", "modeling", "incremental without a key")
def incremental_without_unique_key(o: Mapping) -> tuple[Column, Column | None]:
    keyless = F.expr("detailed and resource_type = 'model' and materialized = 'incremental' and coalesce(size(unique_key), 0) <= 0")
    return keyless & ~F.coalesce(F.lower("incremental_strategy"), F.lit("")).isin("append", "insert_overwrite", "microbatch"), None


def has_freshness() -> Column:
    """A limit on either side with a count."""
    return F.expr("warn_after.count is not null or error_after.count is not null")


@node_rule("sources_without_freshness", "testing", "source without a freshness limit")
def sources_without_freshness(o: Mapping) -> tuple[Column, Column | None]:
    return F.col("detailed") & _is("source") & ~has_freshness(), None


@rule("forbidden_patterns", "sql", "SQL matches a forbidden pattern", needs="sql")
def forbidden_patterns(b: Bundle, o: Mapping) -> DataFrame:
    patterns = list(o.get("patterns", ()))
    hits = F.filter(F.array(*[F.when(F.col("raw_code").rlike(p), F.lit(p)) for p in patterns]).cast("array<string>"), lambda x: x.isNotNull())
    return _found(b.node_sql.join(_models(b).select("unique_id"), "unique_id", "left_semi").withColumn("hits", hits).where("size(hits) > 0"), F.col("hits"))


@rule("warehouse_type_drift", "warehouse", "declared types differ from the warehouse's", needs="catalog")
def warehouse_type_drift(b: Bundle, o: Mapping) -> DataFrame:
    both = attributes.column_of_catalog(b).where("declared_type is not null and actual_type is not null")
    unlike = both.where(~types_equivalent(F.col("declared_type"), F.col("actual_type"), b.adapter_type))
    return unlike.groupBy("unique_id").agg(F.array_sort(F.collect_list("declared")).alias("related"))


def _in_catalog(b: Bundle) -> DataFrame:
    return b.catalog_columns.select("unique_id").distinct()


@rule("columns_missing_in_warehouse", "warehouse", "declared columns aren't in the warehouse", needs="catalog")
def columns_missing_in_warehouse(b: Bundle, o: Mapping) -> DataFrame:
    lost = attributes.column_of_catalog(b).where("actual is null").join(_in_catalog(b), "unique_id", "left_semi")
    return lost.groupBy("unique_id").agg(F.array_sort(F.collect_list("declared")).alias("related"))


@rule("undeclared_warehouse_columns", "warehouse", "warehouse columns aren't declared", needs="catalog")
def undeclared_warehouse_columns(b: Bundle, o: Mapping) -> DataFrame:
    more = attributes.column_of_catalog(b).where("declared is null").join(b.columns.select("unique_id").distinct(), "unique_id", "left_semi")
    return more.groupBy("unique_id").agg(F.array_sort(F.collect_list("actual")).alias("related"))


@rule("unused_models", "modeling", "nothing reads the model")
def unused_models(b: Bundle, o: Mapping) -> DataFrame:
    at = N.lint_layer(F.col("name"), F.col("path")).isin(*o.get("layers", ("staging", "intermediate")))
    out = _models(b).where(at).join(b.edges.select(F.col("parent").alias("unique_id")), "unique_id", "left_anti")
    return _found(out.join(b.detail.where("size(semantic_dependents) > 0").select("unique_id"), "unique_id", "left_anti"))


@edge_rule("references_deprecated_model", "governance", "reads a deprecated model")
def references_deprecated_model(o: Mapping) -> tuple[Column, int]:
    return _is("model", of="p_resource_type") & N.present(F.col("p_deprecation_date")), 1


def _tail(code: Column) -> Column:
    """SQL without trailing comments, comment tags of templates and white space."""
    quiet = r"(?s)(?:\s|--[^\n]*$|/\*.*?\*/|\{#.*?#\})+$"
    lines = F.regexp_replace(code, r"(?m)--[^\n'\"]*$", "")
    return F.regexp_replace(lines, quiet, "")


@rule("trailing_semicolon", "sql", "ends in a semicolon", severity="error")
def trailing_semicolon(b: Bundle, o: Mapping) -> DataFrame:
    sql = b.node_sql.join(b.detail.where("coalesce(language, 'sql') <> 'python'").select("unique_id"), "unique_id", "left_semi").join(_models(b).select("unique_id"), "unique_id", "left_semi")
    return _found(sql.where(_tail(F.col("raw_code")).endswith(";")))


@node_rule("undocumented_exposures", "documentation", "has no description", default=False)
def undocumented_exposures(o: Mapping) -> tuple[Column, Column | None]:
    return _undocumented("exposure"), None


@rule("model_too_long", "structure", "too many lines", default=False)
def model_too_long(b: Bundle, o: Mapping) -> DataFrame:
    text = F.regexp_replace("raw_code", r"(?s)\{#.*?#\}", "")
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    sql = b.node_sql.join(_models(b).select("unique_id"), "unique_id", "left_semi")
    return _found(sql.where(lines > o.get("max_lines", 300)), F.array(lines.cast("string")))


#: Fixed value: what may be materialized how in each layer.
ALLOWED = {"staging": ("view", "ephemeral"), "intermediate": ("view", "ephemeral", "table", "incremental"), "marts": ("table", "incremental", "view")}


@node_rule("layer_materializations", "performance", "materialized against its layer's list", default=False)
def layer_materializations(o: Mapping) -> tuple[Column, Column | None]:
    at, bad = N.lint_layer(F.col("name"), F.col("path")), F.lit(False)
    for layer, allowed in o.get("allowed", ALLOWED).items():
        if allowed:
            bad = bad | ((at == layer) & ~F.col("materialized").isin(*allowed))
    return _is("model") & F.col("materialized").isNotNull() & bad, F.array("materialized")


@rule("models_without_unit_tests", "testing", "has no unit test", default=False)
def models_without_unit_tests(b: Bundle, o: Mapping) -> DataFrame:
    at = N.lint_layer(F.col("name"), F.col("path")).isin(*o.get("layers", ("marts",)))
    sql = b.detail.where("coalesce(language, 'sql') <> 'python'").select("unique_id")
    out = _models(b).where(at & ~F.col("materialized").eqNullSafe(F.lit("materialized_view"))).join(sql, "unique_id", "left_semi")
    return _found(out.join(b.tests.where("kind = 'unit'").select("unique_id"), "unique_id", "left_anti"))


@rule("suppressions_without_reason", "governance", "suppresses rules without a reason", default=False)
def suppressions_without_reason(b: Bundle, o: Mapping) -> DataFrame:
    s = ignores(b).where("reason is null")
    return s.groupBy("unique_id").agg(F.array_sort(F.collect_set(F.coalesce("rule", F.lit("all")))).alias("related"))


def ignores(b: Bundle) -> DataFrame:
    """(unique_id, rule, reason) of ``meta.ignore``: ``all`` (rule null), a list of rules, or rules with reasons."""
    d = b.nodes.select("unique_id").join(b.detail.select("unique_id", F.col("meta")["ignore"].alias("v")), "unique_id").where("v is not null")
    every = d.where(F.lower("v").isin("all", "true")).select("unique_id", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("reason"))
    lists = d.where(F.col("v").startswith("[")).select("unique_id", F.explode(F.from_json("v", "array<string>")).alias("rule"), F.lit(None).cast("string").alias("reason"))
    maps = d.where(F.col("v").startswith("{")).select("unique_id", F.explode(F.from_json("v", "map<string,string>")).alias("rule", "reason"))
    maps = maps.select("unique_id", "rule", F.when(N.present(F.col("reason")), F.col("reason")).alias("reason"))
    return every.unionByName(lists).unionByName(maps)


AUDIT = "suppressions_without_reason"
#: Fixed value: the categories that the presets switch on; ``standard`` leaves it to the rule.
PRESETS = {"minimal": ("modeling", "testing"), "strict": ("modeling", "testing", "governance", "documentation", "structure", "performance", "sql", "warehouse")}


def severity_of(spec: Spec, config: Mapping) -> str:
    """By rule, by category, by preset, by the rule's own default; ``off`` where it doesn't run."""
    own = config.get("rules", {}).get(spec.id)
    if isinstance(own, Mapping):
        own = own.get("severity")
    if own or (own := config.get("categories", {}).get(spec.category)):
        return own
    preset = config.get("preset", "standard")
    on = spec.default if preset == "standard" else spec.category in PRESETS[preset] and (spec.default or preset == "strict")
    return spec.severity if on else "off"


def findings(b: Bundle, config: Mapping | None = None, facts: DataFrame | None = None, only: list[str] | None = None, calls: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All findings (rule_rank, rule, category, severity, unique_id, related, message) of the rules that are on, in
    registry order, and (rule, why) of those that were skipped for want of input. ``facts`` and ``calls`` (see ``lineage``)
    should be written tables, as several rules read them."""
    config, skipped, parts, b = config or {}, [], [], b.merging()
    on_nodes: list[Column] = []
    on_edges: list[tuple[int, Column, int]] = []
    have = {"graph": True, "sql": True, "facts": facts is not None, "catalog": not b.catalog_columns.isEmpty()}
    typed = None if only else written(_typed(b, {}), "typed-edges")
    running: dict[int, tuple[Spec, str]] = {}
    related = lambda c: (c if c is not None else F.array()).cast("array<string>")
    for rank, spec in enumerate(RULES.values()):
        severity = severity_of(spec, config)
        if severity == "off" or (only and spec.id not in only):
            continue
        if not have[spec.needs]:
            skipped.append((spec.id, f"needs {spec.needs}"))
            continue
        options = dict(config.get("rules", {}).get(spec.id, {}) if isinstance(config.get("rules", {}).get(spec.id), Mapping) else {})
        running[rank] = (spec, severity)
        if spec.node is not None:
            hit, why = spec.node(options)
            on_nodes.append(F.when(hit, F.struct(F.lit(rank).alias("rule_rank"), related(why).alias("related"))))
        elif spec.edge is not None:
            hit, least = spec.edge(options)
            on_edges.append((rank, hit, least))
        else:
            more = {k: v for k, v in (("facts", facts), ("calls", calls), ("typed", typed)) if v is not None}
            parts.append(spec.run(b, options | more).select(F.lit(rank).alias("rule_rank"), "unique_id", "related"))
    if on_nodes:
        hits = F.filter(F.array(*on_nodes), lambda x: x.isNotNull())
        parts.append(_wide(b).select("unique_id", F.inline(hits)).select("rule_rank", "unique_id", "related"))
    if on_edges:
        hits = F.filter(F.array(*[F.when(hit, F.lit(rank)) for rank, hit, _ in on_edges]), lambda x: x.isNotNull())
        least = F.create_map(*[F.lit(x) for rank, _, n in on_edges for x in (rank, n)])
        found = _ends(b).select("parent", "child", F.explode(hits).alias("rule_rank")).groupBy("rule_rank", F.col("child").alias("unique_id"))
        parts.append(found.agg(F.array_sort(F.collect_set("parent")).alias("related")).where(F.size("related") >= least[F.col("rule_rank")]))
    out = b.spark.createDataFrame([], "rule_rank int, unique_id string, related array<string>")
    for part in parts:
        # a plan of all rules holds some hundred joins, which the driver plans anew after every stage
        out = out.unionByName(part if len(parts) == 1 else written(part, "rule-findings"))
    rows = [(rank, spec.id, spec.category, severity, spec.message) for rank, (spec, severity) in running.items()]
    named = b.spark.createDataFrame(rows, "rule_rank int, rule string, category string, severity string, message string")  # one row a rule
    out = out.join(F.broadcast(named), "rule_rank").select("rule_rank", "rule", "category", "severity", "unique_id", "related", "message")
    return out, skipped


def suppressed(b: Bundle, found: DataFrame, exclude: Mapping[str, str] | None = None) -> DataFrame:
    """``found`` with ``suppressed_by``: null, ``meta`` or the first selector that excludes the node. The audit rule is
    never suppressed."""
    own = ignores(b).select("unique_id", F.col("rule").alias("ignored")).distinct()
    key = found.select("rule", "unique_id").distinct()
    meta = key.join(own.hint("merge"), "unique_id").where("ignored is null or ignored = rule").select("rule", "unique_id").distinct().withColumn("by_meta", F.lit("meta"))
    out = found.join(meta.hint("merge"), ["rule", "unique_id"], "left")
    by = [F.col("by_meta")]
    for k, (name, spec) in enumerate((exclude or {}).items()):
        out = out.join(select(b, spec).withColumn(f"by_{k}", F.lit(name)).hint("merge"), "unique_id", "left")
        by.append(F.col(f"by_{k}"))
    reason = F.when(F.col("rule") != AUDIT, F.coalesce(*by, F.lit(None).cast("string")))
    return out.select(*found.columns, reason.alias("suppressed_by"))


def finding_key(found: DataFrame) -> DataFrame:
    """What identifies a finding: rule and node; for layer violations also what is related."""
    related = F.when(F.col("rule").isin(*BY_EDGE), F.array_join("related", ",")).otherwise(F.lit(""))
    return found.withColumn("finding_key", F.concat_ws("|", "rule", "unique_id", related))


def classified(found: DataFrame, baseline: DataFrame | None = None, before: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """``class``: baselined, pre-existing (found on the base side too) or counted; suppressed ones stay suppressed."""
    out = finding_key(found)
    if within is not None:
        out = out.join(within.select("unique_id"), "unique_id", "left_semi")
    for name, keys in (("frozen", baseline), ("old", before)):
        marks = finding_key(keys).select("finding_key").distinct().withColumn(name, F.lit(True)) if keys is not None else None
        out = out.join(marks, "finding_key", "left") if marks is not None else out.withColumn(name, F.lit(None).cast("boolean"))
    hidden = F.col("suppressed_by").isNotNull() if "suppressed_by" in found.columns else F.lit(False)
    kind = F.when(hidden, "suppressed").when(F.col("frozen"), "baselined").when(F.col("old"), "pre-existing").otherwise("counted")
    return out.withColumn("class", kind).drop("frozen", "old")


def gate_rows(judged: DataFrame, fail_on: str = "error") -> DataFrame:
    """(rule, severity, counted, status): fails where a counted finding is as severe as ``fail_on``."""
    counts = judged.groupBy("rule_rank", "rule", "severity").agg(F.count_if(F.col("class") == "counted").alias("counted"))
    fails = F.lit(fail_on == "warn") | (F.col("severity") == "error") if fail_on != "never" else F.lit(False)
    return counts.withColumn("status", F.when(F.col("counted") == 0, "pass").when(fails, "fail").otherwise("warn")).orderBy("rule_rank")


#: Stamp of a baseline file. Files of other programs with the same layout bear their own name before the dot.
BASELINE_SCHEMA = "tributary.lint-baseline/v1"
#: Rules whose findings are told apart by what is related.
BY_EDGE = ("layer_violation",)


def baseline_text(baseline: DataFrame) -> str:
    """A baseline (rule, unique_id, related) as a file's text: sorted, distinct, the same bytes for the same findings."""
    rows = {(r["rule"], r["unique_id"], tuple(sorted(set(r["related"] or [])))) for r in baseline.select("rule", "unique_id", "related").collect()}  # a file that people check in
    return json.dumps({"schema": BASELINE_SCHEMA, "findings": [{"rule": r, "node": n, "related": list(x)} for r, n, x in sorted(rows)]}, indent=2, ensure_ascii=False) + "\n"


def read_baseline(spark: SparkSession, text: str) -> DataFrame:
    """(rule, unique_id, related) of a baseline file. A wrong stamp is an error, as a misread baseline would free all findings;
    entries of unknown rules match nothing."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise ValueError(f"invalid lint baseline: {e}") from e
    stamp = doc.get("schema") if isinstance(doc, dict) else None
    if not isinstance(stamp, str) or stamp.rpartition(".")[2] != BASELINE_SCHEMA.rpartition(".")[2]:
        raise ValueError(f"invalid lint baseline schema {stamp!r} (expected {BASELINE_SCHEMA!r})")
    rows = [(f["rule"], f["node"], sorted(set(f.get("related") or [])) if f["rule"] in BY_EDGE else []) for f in doc.get("findings") or []]
    return spark.createDataFrame(rows, "rule string, unique_id string, related array<string>")


def rewritten_baseline(old: DataFrame, found: DataFrame, ran: list[str]) -> DataFrame:
    """The baseline (rule, unique_id, related) with the entries of the rules that ran replaced."""
    kept = old.where(~F.col("rule").isin(*ran)) if ran else old
    return kept.select("rule", "unique_id", "related").unionByName(found.select("rule", "unique_id", "related")).distinct().orderBy("rule", "unique_id")


