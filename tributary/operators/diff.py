"""Baseline against current: nodes, edges, columns, and what they affect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.operators import traverse
from tributary.plans.bundle import Bundle
from tributary.session import dealt, written


def _parents(b: Bundle) -> DataFrame:
    return b.edges.groupBy(F.col("child").alias("unique_id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def _columns(b: Bundle) -> DataFrame:
    pair = F.struct(F.col("name").alias("n"), F.coalesce("data_type", F.lit("\u0000")).alias("t"))
    return b.columns.groupBy("unique_id").agg(F.array_sort(F.collect_list(pair)).alias("columns"))


def _tests(b: Bundle) -> DataFrame:
    pair = F.struct(F.col("kind").alias("k"), F.coalesce("column_name", F.lit("\u0000")).alias("c"))
    return b.tests.groupBy("unique_id").agg(F.array_sort(F.collect_list(pair)).alias("tests"))


def _described(b: Bundle) -> DataFrame:
    out = b.nodes.select("unique_id", "name", "resource_type", "materialized")
    for part in (_parents(b), _columns(b), _tests(b), b.node_sql.select("unique_id", F.trim("raw_code").alias("sql"))):
        out = out.join(part, "unique_id", "left")
    return out


def changed_macros(base: Bundle, current: Bundle) -> DataFrame:
    """(unique_id, macros): names of changed or removed macros that a node's macro calls reach."""
    old, new = base.macros.select("uid", F.col("name").alias("old_name"), F.col("sql").alias("old")), current.macros.select("uid", "name", "sql")
    changed = new.join(old, "uid", "full_outer").where(~F.col("sql").eqNullSafe(F.col("old"))).select("uid", F.coalesce("name", "old_name").alias("name"))
    calls = current.node_macros.select("unique_id", "macro_uid").distinct()
    seeds = calls.select(F.col("macro_uid").alias("seed"), F.col("macro_uid").alias("unique_id")).distinct()
    reached = traverse.walk(current.macro_edges.select(F.col("caller").alias("parent"), F.col("callee").alias("child")), seeds, keep_seeds=True)
    hit = reached.select("seed", F.col("unique_id").alias("uid")).join(changed, "uid").select(F.col("seed").alias("macro_uid"), "name")
    return calls.join(hit, "macro_uid").groupBy("unique_id").agg(F.array_sort(F.collect_set("name")).alias("macros"))


def modifications(base: Bundle, current: Bundle) -> DataFrame:
    """(unique_id, reasons) of nodes on both sides that differ, the reasons in fixed order: materialization, parents,
    columns (not of seeds), tests, SQL (of models, both sides present), macros."""
    base, current = base.merging(), current.merging()
    old = _described(base).select("unique_id", *[F.col(c).alias(f"old_{c}") for c in ("materialized", "parents", "columns", "tests", "sql")])
    both = _described(current).join(old, "unique_id")
    has_macros = not (base.macros.isEmpty() and current.macros.isEmpty())
    if has_macros:
        both = both.join(changed_macros(base, current), "unique_id", "left")
    none = F.array().cast("array<string>")
    unlike = lambda a, b: ~a.eqNullSafe(b)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    tests = F.when(size("tests") != size("old_tests"), F.concat(F.lit("tests: "), size("old_tests").cast("string"), F.lit(" -> "), size("tests").cast("string"))).when(
        unlike(F.col("tests"), F.col("old_tests")), "tests changed"
    )
    word = lambda c: F.coalesce(F.col(c), F.lit("none"))
    reasons = [
        F.when(unlike(F.col("materialized"), F.col("old_materialized")), F.concat(F.lit("materialized: "), word("old_materialized"), F.lit(" -> "), word("materialized"))),
        F.when(unlike(F.col("parents"), F.col("old_parents")), "parents changed"),
        F.when((F.col("resource_type") != "seed") & unlike(F.col("columns"), F.col("old_columns")), "columns changed"),
        tests,
        F.when((F.col("resource_type") == "model") & (F.col("sql") != F.col("old_sql")), "sql changed"),
    ]
    macros = F.transform(F.coalesce("macros", none), lambda m: F.concat(F.lit("macro:"), m)) if has_macros else none
    found = F.concat(F.filter(F.array(*reasons), lambda x: x.isNotNull()), macros)
    return both.select("unique_id", found.alias("reasons")).where(F.size("reasons") > 0)


def node_changes(base: Bundle, current: Bundle) -> DataFrame:
    """(unique_id, name, resource_type, status, reasons): added, removed and modified nodes."""
    none = F.array().cast("array<string>")
    own = lambda b: b.nodes.select("unique_id", "name", "resource_type")
    added = own(current).join(base.nodes.select("unique_id"), "unique_id", "left_anti").withColumns({"status": F.lit("added"), "reasons": none})
    removed = own(base).join(current.nodes.select("unique_id"), "unique_id", "left_anti").withColumns({"status": F.lit("removed"), "reasons": none})
    modified = own(current).join(modifications(base, current), "unique_id").withColumn("status", F.lit("modified"))
    return added.unionByName(removed).unionByName(modified.select(*added.columns))


def statuses(base: Bundle, current: Bundle) -> DataFrame:
    """(unique_id, status) of all current nodes, ``unchanged`` among them."""
    found = node_changes(base, current).where("status <> 'removed'").select("unique_id", "status")
    return current.nodes.select("unique_id").join(found, "unique_id", "left").na.fill("unchanged", ["status"])


def edge_changes(base: Bundle, current: Bundle) -> DataFrame:
    """(parent, child, side): edges that only one side has."""
    old, new = base.edges.select("parent", "child"), current.edges.select("parent", "child")
    return new.subtract(old).withColumn("side", F.lit("added")).unionByName(old.subtract(new).withColumn("side", F.lit("removed")))


def type_form(data_type: Column) -> Column:
    return F.lower(F.regexp_replace(data_type, r"\s", ""))


def column_changes(base: Bundle, current: Bundle, base_edges: DataFrame, current_edges: DataFrame, base_exprs: DataFrame | None = None, current_exprs: DataFrame | None = None) -> DataFrame:
    """(unique_id, column, change, was): columns added, removed, renamed, with another type or expression, of modified
    nodes that aren't seeds. ``base_edges`` and ``current_edges`` are column edges (from_node, from_col, to_node,
    to_col, kind); the expressions are (unique_id, column, expr)."""
    told = base_exprs is not None and current_exprs is not None
    base, current = base.merging(), current.merging()
    kept = lambda df: df.join(base.nodes.select("unique_id"), "unique_id", "left_semi").join(current.nodes.where("resource_type <> 'seed'"), "unique_id", "left_semi")
    listed = lambda b, p: _columns(b.with_(columns=dealt(b.columns, "unique_id"))).withColumnRenamed("columns", p)
    lists = listed(base, "old").join(listed(current, "new").hint("merge"), "unique_id", "full_outer")
    name = lambda c: N.normalize_column(c["n"])
    # unlike lists make a node modified; of equal ones only names that are equal once they are normalized can show a change
    twins = F.size(F.array_distinct(F.transform("old", name))) < F.size("old")
    lists = lists.withColumn("unlike", ~F.col("old").eqNullSafe(F.col("new")))
    lists = written(kept(written(lists.where(F.col("unlike") | twins), "column-lists").hint("merge")), "column-lists")
    if told or not lists.where("not unlike").isEmpty():
        modified = written(kept(modifications(base, current).select("unique_id")), "modified").hint("merge")
        lists = lists.join(modified, "unique_id", "left_semi")
    cols = lambda p: lists.select("unique_id", F.explode(p).alias("c")).select("unique_id", name(F.col("c")).alias("column"), F.nullif(F.col("c.t"), F.lit("\u0000")).alias(f"{p}_type"), F.lit(True).alias(p))
    both = written(cols("old").join(cols("new").hint("merge"), ["unique_id", "column"], "full_outer"), "columns")
    gone, fresh = both.where("new is null"), both.where("old is null")
    renames = written(rename_pairs(gone, fresh, base_edges, current_edges), "renames").hint("merge")
    out = renames.select("unique_id", F.col("new").alias("column"), F.lit("renamed").alias("change"), F.col("old").alias("was"))
    plain = lambda df, side, word: df.join(renames.select("unique_id", F.col(side).alias("column")), ["unique_id", "column"], "left_anti").select("unique_id", "column", F.lit(word).alias("change"), F.lit(None).cast("string").alias("was"))
    typed = both.where(F.col("old") & F.col("new") & ~type_form(F.coalesce("old_type", F.lit(""))).eqNullSafe(type_form(F.coalesce("new_type", F.lit("")))))
    out = out.unionByName(plain(gone, "old", "removed")).unionByName(plain(fresh, "new", "added"))
    out = out.unionByName(typed.select("unique_id", "column", F.lit("type").alias("change"), F.col("old_type").alias("was")))
    if told:
        pair = base_exprs.select("unique_id", "column", F.col("expr").alias("was")).join(current_exprs, ["unique_id", "column"]).join(modified, "unique_id", "left_semi")
        out = out.unionByName(pair.where("was <> expr").select("unique_id", "column", F.lit("expression").alias("change"), "was"))
    return out


def rename_pairs(gone: DataFrame, fresh: DataFrame, base_edges: DataFrame, current_edges: DataFrame) -> DataFrame:
    """(unique_id, old, new, shared): a removed and an added column that are fed by a common column. Greedy by shared
    columns, then names; each is used once. A node's pairs are folded in that order, by the executors without Python."""

    # only nodes that have both can have a pair
    nodes = written(gone.select("unique_id").distinct().hint("merge").join(fresh.select("unique_id"), "unique_id", "left_semi"), "rename-nodes").hint("merge")

    def feeds(df: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        df = df.join(nodes, "unique_id", "left_semi").select("unique_id", F.col("column").alias(name))
        fed = edges.where("kind <> 'filter_or_join'").join(nodes.withColumnRenamed("unique_id", "to_node"), "to_node", "left_semi").select(F.col("to_node").alias("unique_id"), F.col("to_col").alias(name), F.concat_ws("\u0001", "from_node", "from_col").alias("feed"))
        return df.hint("merge").join(fed.join(df.hint("merge"), ["unique_id", name], "left_semi").distinct(), ["unique_id", name])

    pairs = feeds(gone, base_edges, "old").join(feeds(fresh, current_edges, "new").hint("merge"), ["unique_id", "feed"]).groupBy("unique_id", "old", "new").agg(F.count("*").alias("shared"))
    ranked = pairs.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("rank"), "old", "new"))).alias("pairs"))
    none = F.array().cast("array<struct<rank:bigint,old:string,new:string>>")
    used = lambda keep, p, c: F.exists(keep, lambda k: k[c] == p[c])
    keep = F.aggregate("pairs", none, lambda keep, p: F.when(used(keep, p, "old") | used(keep, p, "new"), keep).otherwise(F.concat(keep, F.array(p))))
    return ranked.select("unique_id", F.inline(keep)).select("unique_id", "old", "new", (-F.col("rank")).alias("shared"))


def dead_columns(start: DataFrame, edges: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(node, col): columns that die with ``start`` (node, col). A column dies when a dead one feeds it through an edge
    that isn't row-shaping, or when its node still names a dead column (``named``: node, ref_node, ref_col)."""
    value = edges.where("kind <> 'filter_or_join'").select("from_node", "from_col", F.col("to_node").alias("node"), F.col("to_col").alias("col")).distinct()
    dead = written(start.select("node", "col").distinct(), "dead")
    outputs = edges.select(F.col("to_node").alias("node"), F.col("to_col").alias("col")).distinct()
    for _ in range(traverse.ROUNDS):
        key = dead.select(F.col("node").alias("from_node"), F.col("col").alias("from_col"))
        more = value.join(key, ["from_node", "from_col"]).select("node", "col")
        if named is not None:
            hit = named.join(dead.select(F.col("node").alias("ref_node"), F.col("col").alias("ref_col")), ["ref_node", "ref_col"]).select("node").distinct()
            more = more.unionByName(outputs.join(hit, "node", "left_semi"))
        more = written(more.distinct().join(dead, ["node", "col"], "left_anti"), "dead")
        if more.isEmpty():
            return dead
        dead = written(dead.unionByName(more), "dead")
    raise RuntimeError("dead columns still grow")


def severity(change: Column, affected: Column) -> Column:
    """breaking: removed or renamed while something still reads it; partial: type or expression; else non-breaking."""
    return F.when(change.isin("removed", "renamed") & (affected > 0), "breaking").when(change.isin("type", "expression"), "partial").otherwise("non-breaking")


def affected(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """``changes`` with affected (columns reached) and severity. A removed or renamed column is looked up by its old name."""
    start = changes.withColumn("col", F.when(F.col("change") == "renamed", F.col("was")).otherwise(F.col("column")))
    key = lambda node, col: F.concat_ws("\u0001", node, col)
    graph = edges.select(key("from_node", "from_col").alias("parent"), key("to_node", "to_col").alias("child"))  # the walk drops what is reached twice
    seeds = start.select(key("unique_id", "col").alias("seed"), key("unique_id", "col").alias("unique_id")).distinct()
    counts = traverse.walk(graph, seeds).groupBy("seed").agg(F.count("*").alias("affected"))
    out = start.withColumn("seed", key("unique_id", "col")).join(counts, "seed", "left").drop("seed", "col").na.fill(0, ["affected"])
    return out.withColumn("severity", severity(F.col("change"), F.col("affected")))
