"""Derived attributes: degrees, scope, coverage, keys, histograms, ranking, lenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.operators import traverse
from tributary.plans.bundle import Bundle
from tributary.session import numbered


def degrees(b: Bundle) -> DataFrame:
    """unique_id, direct_up, direct_down, test_count of every node."""
    up = b.edges.groupBy(F.col("child").alias("unique_id")).agg(F.count("*").alias("direct_up"))
    down = b.edges.groupBy(F.col("parent").alias("unique_id")).agg(F.count("*").alias("direct_down"))
    tests = b.tests.groupBy("unique_id").agg(F.count("*").alias("test_count"))
    out = b.nodes.select("unique_id")
    for part in (up, down, tests):
        out = out.join(part, "unique_id", "left")
    return out.na.fill(0, ["direct_up", "direct_down", "test_count"])


def kept(b: Bundle, nodes: DataFrame) -> Bundle:
    """The bundle of ``nodes`` alone; macros stay whole. Degrees follow, since they are counted from the edges."""
    ids = nodes.select("unique_id")

    def cut(name: str, df: DataFrame) -> DataFrame:
        if name == "nodes":
            return nodes
        if name == "edges":
            return traverse.pruned(df, ids)
        return df.join(ids, "unique_id", "left_semi") if "unique_id" in df.columns else df

    return b.map(cut)


def package_histogram(b: Bundle) -> DataFrame:
    return b.nodes.select(N.package(F.col("unique_id")).alias("package")).where("package is not null").groupBy("package").agg(F.count("*").alias("n"))


def primary_package(b: Bundle) -> str | None:
    """The recorded project, else the most frequent package, ties to the smaller name."""
    if b.root_project:
        return b.root_project
    first = package_histogram(b).orderBy(F.desc("n"), "package").first()
    return first and first["package"]


def root_scope(b: Bundle) -> Bundle:
    """Only the root project's nodes. ``pruned_adjacent`` keeps how many parents and children each lost."""
    root = primary_package(b)
    if root is None:
        return b
    inside = b.nodes.where(N.in_package(F.col("unique_id"), root))
    ids = inside.select("unique_id")
    lost = lambda end, other, name: (
        b.edges.join(ids, F.col(end) == F.col("unique_id"), "left_semi").join(ids, F.col(other) == F.col("unique_id"), "left_anti")
        .groupBy(F.col(end).alias("unique_id")).agg(F.count("*").alias(name))
    )
    severed = lost("child", "parent", "parents").join(lost("parent", "child", "children"), "unique_id", "full_outer").na.fill(0, ["parents", "children"])
    out = kept(b, inside)
    notes = [] if b.root_project else [f"root project guessed: {root}"]
    if inside.isEmpty() and not b.nodes.isEmpty():
        notes.append(f"no node is in {root}")
    return out.with_(pruned_adjacent=severed, warnings=[*b.warnings, *notes])


def testable() -> Column:
    return F.col("resource_type").isin(*N.TESTABLE_TYPES)


def coverage_gaps(b: Bundle) -> DataFrame:
    return b.nodes.where(testable()).join(b.tests.select("unique_id"), "unique_id", "left_anti")


def primary_keys(b: Bundle) -> DataFrame:
    """unique_id of nodes with a key guarantee: unique and not_null on one column, or a test of several columns."""
    per = b.tests.groupBy("unique_id", "column_name").agg(
        (F.bool_or(F.col("kind") == "unique") & F.bool_or(F.col("kind") == "not_null") & F.col("column_name").isNotNull()).alias("both"),
        F.bool_or(F.col("kind").endswith("unique_combination_of_columns")).alias("several"),
    )
    return per.where("both or several").select("unique_id").distinct()


def _inside(b: Bundle, within: DataFrame | None) -> DataFrame:
    root = primary_package(b)
    nodes = b.nodes.where(N.in_package(F.col("unique_id"), root)) if root else b.nodes
    return nodes.join(within.select("unique_id"), "unique_id", "left_semi") if within is not None else nodes


def percent(part: Column, total: Column) -> Column:
    """Whole percent; 100 of nothing."""
    return F.when(total == 0, F.lit(100).cast("long")).otherwise(F.floor(100 * part / total))


def _counts(df: DataFrame, name: str, hit: Column) -> DataFrame:
    part, total = F.coalesce(F.sum(hit.cast("long")), F.lit(0)), F.count("*")
    return df.agg(part.alias("covered"), total.alias("total"), percent(part, total).alias("percent")).select(F.lit(name).alias("measure"), "covered", "total", "percent")


def coverage(b: Bundle, within: DataFrame | None = None) -> DataFrame:
    """Four rows: measure, covered, total, percent - tests and docs, of nodes and of columns."""
    nodes = _inside(b, within)
    tested = b.tests.select("unique_id").distinct().withColumn("hit", F.lit(True))
    models = nodes.where("resource_type = 'model'")
    columns = b.columns.withColumn("folded", N.normalize_column(F.col("name")))
    tested_columns = b.tests.where("column_name is not null").select("unique_id", N.normalize_column(F.col("column_name")).alias("folded")).distinct().withColumn("hit", F.lit(True))
    own = lambda of: columns.join(of.select("unique_id"), "unique_id", "left_semi")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    described = b.detail.select("unique_id", "description")
    parts = [
        _counts(nodes.where(testable()).join(tested, "unique_id", "left"), "tests", hit),
        _counts(own(nodes.where(testable())).join(tested_columns, ["unique_id", "folded"], "left"), "column_tests", hit),
        _counts(models.join(described, "unique_id", "left"), "docs", F.col("description").isNotNull()),
        _counts(own(models), "column_docs", N.present(F.col("description"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def layer_coverage(b: Bundle) -> DataFrame:
    tested = b.tests.select("unique_id").distinct().withColumn("hit", F.lit(1))
    models = b.nodes.where("resource_type = 'model'").join(tested, "unique_id", "left").withColumn("layer", N.layer(F.col("path")))
    out = models.groupBy("layer").agg(F.count("*").alias("models"), F.count("hit").alias("tested"))
    return out.withColumn("percent", percent(F.col("tested"), F.col("models")))


def downstream_counts(b: Bundle, of: DataFrame | None = None) -> DataFrame:
    """unique_id, downstream, exposures: transitive downstream counts for each node of ``of`` (default: all)."""
    seeds = (of if of is not None else b.nodes).select(F.col("unique_id").alias("seed"), "unique_id")
    reached = traverse.walk(b.edges, seeds).join(b.nodes.select("unique_id", "resource_type"), "unique_id")
    counts = reached.groupBy("seed").agg(F.count("*").alias("downstream"), F.count_if(F.col("resource_type") == "exposure").alias("exposures"))
    return seeds.select("unique_id").join(counts.withColumnRenamed("seed", "unique_id"), "unique_id", "left").na.fill(0, ["downstream", "exposures"])


def impact_breakdown(b: Bundle, uid: str) -> DataFrame:
    """One row: downstream without exposures, upstream, exposures."""
    seed = b.nodes.where(F.col("unique_id") == uid)
    down = traverse.closure(b.edges, seed).join(b.nodes, "unique_id")
    up = traverse.closure(b.edges, seed, "up")
    sums = down.agg(F.count_if(F.col("resource_type") != "exposure").alias("downstream"), F.count_if(F.col("resource_type") == "exposure").alias("exposures"))
    return sums.crossJoin(up.agg(F.count("*").alias("upstream")))  # one row each


def downstream_exposures(b: Bundle, uid: str) -> DataFrame:
    reached = traverse.closure(b.edges, b.nodes.where(F.col("unique_id") == uid))
    return reached.join(b.nodes.where("resource_type = 'exposure'"), "unique_id").join(b.exposures, "unique_id", "left").orderBy("name", "unique_id")


def hubs(b: Bundle, k: int = 5) -> DataFrame:
    d = degrees(b).withColumn("degree", F.col("direct_up") + F.col("direct_down"))
    return d.orderBy(F.desc("degree"), "unique_id").limit(k).select("unique_id", "degree")


def transitive_hubs(b: Bundle, k: int = 5) -> DataFrame:
    return downstream_counts(b).orderBy(F.desc("downstream"), "unique_id").limit(k).select("unique_id", "downstream")


def stats(b: Bundle) -> DataFrame:
    """metric, value: counts for a dashboard."""
    d = b.nodes.join(degrees(b), "unique_id").join(b.detail.select("unique_id", "description"), "unique_id", "left")
    model = F.col("resource_type") == "model"
    row = d.agg(
        F.count("*").alias("nodes"),
        F.count_if(model).alias("models"),
        F.count_if((F.col("direct_up") == 0) & (F.col("direct_down") == 0)).alias("orphans"),
        F.count_if(model & (F.col("direct_down") == 0)).alias("models_without_children"),
        F.count_if(model & F.col("description").isNull()).alias("undocumented_models"),
        F.count_if(testable() & (F.col("test_count") == 0)).alias("untested"),
        F.coalesce(F.sum("test_count"), F.lit(0)).alias("tests"),
    )
    names = row.columns
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])))


def counts_by(b: Bundle, column: str) -> DataFrame:
    return b.nodes.groupBy(column).agg(F.count("*").alias("n"))


def model_list(b: Bundle, group_by: str = "layer", key: str | None = None, query: str | None = None) -> DataFrame:
    """Rows in display order: group (layer in fixed rank, or ``meta:<key>``, missing last), then ``key`` descending
    (downstream or tests), name, uid. Numbered inside the group and over all."""
    d = b.nodes.where(testable()).withColumn("list_name", N.list_name(F.col("unique_id"), F.col("name")))
    if query:
        d = d.where(N.name_matches(F.col("list_name"), query))
    if group_by == "layer":
        d = d.withColumn("grp", N.layer(F.col("path"))).withColumn("grp_rank", N.layer_rank(F.col("grp")))
    else:
        d = d.join(b.detail.select("unique_id", "meta"), "unique_id", "left").withColumn("grp", F.col("meta")[group_by.removeprefix("meta:")])
        d = d.withColumn("grp_rank", F.col("grp").isNull().cast("int")).drop("meta")
    order: list[Column] = []
    if key == "tests":
        d = d.join(degrees(b).select("unique_id", "test_count"), "unique_id")
        order = [F.desc("test_count")]
    elif key == "downstream":
        d = d.join(downstream_counts(b).select("unique_id", "downstream"), "unique_id")
        order = [F.desc("downstream")]
    inside = [*order, F.col("list_name"), F.col("unique_id")]
    d = numbered(d, ["grp_rank", "grp"], inside, "row_in_group")
    return d.orderBy("grp_rank", "grp", "row_in_group").select("grp", "grp_rank", "list_name", "unique_id", "row_in_group")


def full_text(b: Bundle, needle: str) -> DataFrame:
    """Nodes whose description, column names or SQL hold ``needle``, whatever the case; the name doesn't count."""
    low = needle.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(low), F.lit(False))
    found = (
        b.detail.where(has(F.col("description"))).select("unique_id")
        .unionByName(b.columns.where(has(F.col("name"))).select("unique_id"))
        .unionByName(b.node_sql.where(has(F.col("raw_code")) | has(F.col("compiled_code"))).select("unique_id"))
    )
    return b.nodes.join(found.distinct(), "unique_id", "left_semi")


def lenses(b: Bundle, violations: DataFrame | None = None, findings: DataFrame | None = None, changes: DataFrame | None = None, reached: DataFrame | None = None) -> DataFrame:
    """unique_id and one column for each way of classifying nodes. Four of them need more than the graph: layer violations
    (parent, child), lint findings (unique_id, severity), changes (unique_id, status) and the columns that a column reaches (node)."""
    d = b.nodes.join(degrees(b), "unique_id").join(downstream_counts(b), "unique_id").join(b.run_results, "unique_id", "left")
    d = d.join(primary_keys(b).withColumn("pk", F.lit(True)), "unique_id", "left")
    more = []
    if violations is not None:
        ends = violations.select(F.explode(F.array("parent", "child")).alias("unique_id")).distinct()
        d, more = d.join(ends.withColumn("violating", F.lit("violation")), "unique_id", "left"), [*more, F.coalesce("violating", F.lit("none")).alias("layer_violation")]
    if findings is not None:
        worst = findings.groupBy("unique_id").agg(F.min("severity").alias("worst"))  # error comes before warn
        d, more = d.join(worst, "unique_id", "left"), [*more, F.coalesce("worst", F.lit("none")).alias("lint")]
    if changes is not None:
        now = changes.where("status <> 'removed'").select("unique_id", F.col("status").alias("changed"))
        d, more = d.join(now, "unique_id", "left"), [*more, F.coalesce("changed", F.lit("unchanged")).alias("diff")]
    if reached is not None:
        hit = reached.groupBy(F.col("node").alias("unique_id")).agg(F.count("*").alias("hits"))
        d, more = d.join(hit, "unique_id", "left"), [*more, F.coalesce("hits", F.lit(0)).alias("column_impact")]
    return d.select(
        "unique_id", *more,
        F.when(~testable(), "none").when(F.col("test_count") > 0, "tested").otherwise("untested").alias("coverage"),
        N.degree_heat(F.col("downstream")).alias("degree_heat"),
        N.layer(F.col("path")).alias("layer"),
        N.status_class(F.col("status")).alias("run_status"),
        N.time_heat(F.col("execution_time")).alias("run_time"),
        F.coalesce("pk", F.lit(False)).alias("primary_key"),
    )


def column_of_catalog(b: Bundle) -> DataFrame:
    """unique_id, column, declared, actual: declared columns against the warehouse's, both sides folded."""
    mine = b.columns.select("unique_id", F.lower("name").alias("k"), F.col("name").alias("declared"), F.col("data_type").alias("declared_type"))
    theirs = b.catalog_columns.select("unique_id", F.lower("column").alias("k"), F.col("column").alias("actual"), F.col("data_type").alias("actual_type"))
    return mine.join(theirs, ["unique_id", "k"], "full_outer")


def catalog_readouts(b: Bundle) -> DataFrame:
    """unique_id, row_count, size_bytes: by the first statistic there is of a few names."""
    first = lambda *keys: F.coalesce(*[F.max(F.when(F.col("stat") == k, F.col("value"))) for k in keys])
    return b.catalog_stats.groupBy("unique_id").agg(
        first("row_count", "num_rows", "rows").cast("long").alias("row_count"), first("bytes", "num_bytes", "size").cast("long").alias("size_bytes")
    )


def index_by(b: Bundle, what: str) -> DataFrame:
    """bucket, models (sorted names): by ``tags``, ``group`` or ``meta:<key>``; models of none come under null."""
    d = b.nodes.where("resource_type = 'model'").join(b.detail, "unique_id", "left")
    value = F.explode_outer("tags") if what == "tags" else F.col("grp") if what == "group" else F.col("meta")[what.removeprefix("meta:")]
    return d.select("name", value.alias("bucket")).groupBy("bucket").agg(F.array_sort(F.collect_list("name")).alias("models")).orderBy(F.asc_nulls_last("bucket"))
