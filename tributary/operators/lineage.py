"""Column lineage: edges from SQL text, closures over (node, column), reports, and lint rules on SQL facts.

Text is read on the executors, one row a model; a model's row carries its parents' column lists. A node's list is the
first that isn't empty of catalog, declaration and its own SELECT list; models without a list are read in rounds, after
their parents. Where text can't be read, names are matched instead. For edges, texts that differ only in the names they
call are read once (``_shaped``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.functions import sql_fixes as X
from tributary.functions import sql_text as S
from tributary.operators import lint, traverse
from tributary.plans.bundle import Bundle
from tributary.session import discard, written

EDGES = "from_node string, from_col string, to_node string, to_col string, kind string, confidence string"
FACTS = (
    "unique_id string, readable boolean, problem string, outputs array<string>, wildcard boolean, cartesian int, unused_ctes array<string>, "
    "order_without_limit boolean, duplicates array<string>, unknown array<string>, hard_coded array<string>"
)


def _listed(b: Bundle) -> DataFrame:
    """(unique_id, columns): from the catalog, else as declared, in definition order."""
    catalog = b.catalog_columns.groupBy("unique_id").agg(F.array_sort(F.collect_set(N.normalize_column(F.col("column")))).alias("catalog"))
    declared = b.columns.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("pos", N.normalize_column(F.col("name")).alias("n")))).alias("d"))
    both = b.merging().nodes.select("unique_id").join(catalog, "unique_id", "left").join(declared, "unique_id", "left")
    return both.select("unique_id", F.coalesce("catalog", F.transform("d", lambda x: x["n"])).alias("columns"))


def _trusted(b: Bundle) -> DataFrame:
    """Nodes whose column list is proven: known to the catalog, or under an enforced contract."""
    return b.catalog_columns.select("unique_id").unionByName(b.detail.where("contract_enforced").select("unique_id")).distinct().withColumn("trusted", F.lit(True))


def _tasks(b: Bundle, listed: DataFrame) -> DataFrame:
    """unique_id, sql, stale, own columns, and the parents as an array of (uid, reference, columns, trusted)."""
    b, listed = b.merging(), listed.hint("merge")
    text = b.node_sql.select("unique_id", F.coalesce("compiled_code", "raw_code").alias("sql"), F.col("raw_code").alias("raw"), F.coalesce("stale", F.lit(False)).alias("stale"))
    seg = N.segments(F.col("unique_id"))
    version = F.when(N.is_versioned(F.col("unique_id")), F.concat(F.lit(".v"), N.normalize_version(seg[3]))).otherwise(F.lit(""))
    reference = F.when(F.col("resource_type") == "source", F.concat(F.lit("source:"), seg[2], F.lit("."), F.col("name"))).otherwise(F.concat(F.lit("ref:"), "name", version))
    ends = b.nodes.select("unique_id", "name", "resource_type", reference.alias("reference")).join(listed, "unique_id").join(_trusted(b), "unique_id", "left")
    relation = b.detail.select("unique_id", F.lower("relation_name").alias("relation"))
    up = ends.join(relation, "unique_id", "left").select(F.col("unique_id").alias("parent"), F.struct(F.col("unique_id").alias("uid"), "reference", "columns", F.coalesce("trusted", F.lit(False)).alias("trusted"), "relation").alias("p"))
    # dealt by child before they are grouped: each task would else sort and serialize groups of one
    parents = b.edges.join(up, "parent").repartition("child").groupBy(F.col("child").alias("unique_id")).agg(F.array_sort(F.collect_list("p")).alias("parents"))
    models = b.nodes.where(F.col("resource_type").isin("model", "snapshot")).select("unique_id")
    return models.join(text, "unique_id").join(listed, "unique_id").join(parents, "unique_id", "left")


def _read(row) -> tuple[S.Result | None, str, dict]:  # noqa: ANN001
    parents: dict = {}
    trusted = []
    for p in row.parents if row.parents is not None else []:
        columns = None if p["columns"] is None else list(p["columns"])
        parents[p["reference"]] = (p["uid"], columns)
        if p["trusted"]:
            trusted.append(p["uid"])
    sql = row.sql or ""
    for p in row.parents if row.parents is not None else []:  # compiled text names relations
        if p["relation"]:
            plain = p["relation"].replace('"', "").replace("`", "")
            pattern = r"[\"`]?\.[\"`]?".join(re.escape(x) for x in plain.split("."))
            sql = re.sub(rf"(?i)(?<![\w.\"`])[\"`]?{pattern}[\"`]?(?![\w.\"`])", f'"{p["reference"]}"', sql)
    try:
        return S.analyse(sql, parents, trusted), "", parents
    except S.Unreadable as e:
        return None, str(e), parents


def _edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            result, _, parents = _read(r)
            own = None if r.columns is None else list(r.columns)
            if result is not None and result.outputs is not None:
                found = S.edges_of(result, "stale" if r.stale else "exact")
            else:
                lists = [(uid, columns or []) for uid, columns in parents.values()]
                found = [e._replace(confidence="stale" if r.stale else "name_match") for e in S.name_match(r.sql or "", own or [], lists)]
            rows += [(e.from_node, e.from_col, r.unique_id, e.to_col, e.kind, e.confidence) for e in found]
        yield pd.DataFrame(rows, columns=["from_node", "from_col", "to_node", "to_col", "kind", "confidence"])


def _fact_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            result, problem, _ = _read(r)
            if result is None:
                rows.append((r.unique_id, False, problem, None, False, 0, [], False, [], [], []))
                continue
            f = result.facts
            names = None if result.outputs is None else [c.name for c in result.outputs]
            rows.append((r.unique_id, True, None, names, f.wildcard, f.cartesian, f.unused_ctes, f.order_without_limit, f.duplicates, [".".join(u) for u in f.unknown], sorted(set(f.hard_coded))))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])


def column_lists(b: Bundle) -> DataFrame:
    """(unique_id, columns) of every node; null where nothing tells.

    Nodes without a list are read in rounds, each once all its parents have been read or tell their lists anyway; one that can't
    be read hence holds nobody up. There are as many rounds as such nodes follow each other. On a cycle of them nobody is first:
    their lists stay null."""
    readable = b.node_sql.select("unique_id").hint("merge")
    listed = written(_listed(b), "lists")
    unknown = written(listed.where("columns is null").select("unique_id").join(readable, "unique_id", "left_semi"), "lists-open")
    if unknown.isEmpty():
        return listed
    listed = listed.hint("merge").join(unknown.withColumn("open", F.lit(True)), "unique_id", "left").na.fill(False, ["open"])
    listed = written(listed, "lists")
    for _ in range(traverse.ROUNDS):
        open_ = listed.where("open").select("unique_id")
        blocked = b.edges.join(open_.select(F.col("unique_id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("unique_id"))
        ready = written(open_.join(blocked, "unique_id", "left_anti"), "lists-ready")
        if ready.isEmpty():
            return listed.select("unique_id", "columns")
        tasks = _tasks(b, listed.select("unique_id", "columns")).join(ready, "unique_id", "left_semi")
        got = tasks.mapInPandas(_fact_rows, FACTS).select("unique_id", F.filter("outputs", lambda x: x != "").alias("found")).where("size(found) > 0")
        after = listed.hint("merge").join(got, "unique_id", "left").join(ready.withColumn("read", F.lit(True)), "unique_id", "left")
        after = written(after.select("unique_id", F.coalesce("columns", "found").alias("columns"), (F.col("open") & F.col("read").isNull()).alias("open")), "lists")
        discard(listed, ready)
        listed = after
    raise RuntimeError(f"column lists are still incomplete after {traverse.ROUNDS} rounds")


#: A literal call whose names are plain words in single quotes: ref with or without a package, or source.
PLAIN_CALL = (
    r"\{\{-?\s*(?:(ref)\s*\(\s*(?:'[A-Za-z0-9_]+'\s*,\s*)?'([A-Za-z0-9_]+)'|(source)\s*\(\s*'([A-Za-z0-9_]+)'\s*,\s*'([A-Za-z0-9_]+)')\s*\)\s*-?\}\}"
)
#: Stands for a call in a shape; a text that has it isn't shaped.
MARK = "\u0001"
SHAPES = "key string, links array<struct<at:int,from_col:string,to_col:string,kind:string>>"
#: Shapes with up to this number of links in all (counted) are broadcast.
BROADCAST_ROWS = 100_000


def _shaped(tasks: DataFrame) -> DataFrame:
    """(unique_id, stale, key, shape, uids): the shape of a text, and the parents it calls in the order of their first calls.

    Models have one shape if their texts are equal but for the names they call, and the column lists and trust of the called
    parents are equal too: then their edges differ by the parents' ids alone. Where a name could tell more than that (it stands
    elsewhere in the text, two go by one alias, a template does more than call plain names, a parent isn't found or the
    text has a relation's name) key is null, and the text has to be read as it is."""
    # one pass of the pattern: the text's pieces stand at even places, the references called at odd ones
    out = tasks.withColumn("pieces", F.split(F.regexp_replace("sql", PLAIN_CALL, f"{MARK}$1$3:$2$4.$5{MARK}"), MARK))
    out = out.withColumns({
        "calls": F.transform(F.filter("pieces", lambda _, k: k % 2 == 1), lambda c: F.rtrim(c, F.lit("."))),
        "frame": F.array_join(F.filter("pieces", lambda _, k: k % 2 == 0), MARK), "parents": F.coalesce("parents", F.array().cast(tasks.schema["parents"].dataType)),
    })
    out = out.withColumn("called", F.array_distinct("calls"))
    out = out.withColumns({
        "found": F.transform("called", lambda r: F.filter("parents", lambda p: p["reference"] == r)),
        "aliases": F.transform("called", lambda r: F.lower(F.substring_index(F.substring_index(r, ":", -1), ".", -1))),
        "at": F.transform("calls", lambda r: F.array_position("called", r).cast("int")),
    })
    unique = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    last = lambda p: F.element_at(F.split(F.translate(p["relation"], '"`', ""), r"\."), -1)
    where = lambda p: F.lower(F.when(F.contains(p["relation"], F.lit(".")), F.col("frame")).otherwise(F.col("sql")))  # noqa: E731  (a dotted name can't be in a call)
    related = F.exists("parents", lambda p: F.coalesce(p["relation"] != "", F.lit(False)) & (F.contains(where(p), last(p)) | F.col("sql").rlike(r"[^\x00-\x7F]")))
    plain = (
        ~F.contains("sql", F.lit(MARK)) & ~F.contains("frame", F.lit("{{")) & ~F.contains("frame", F.lit("{#")) & ~F.contains("frame", F.lit("{%")) & F.forall("found", lambda f: F.size(f) == 1)
        & unique("aliases") & ~F.exists("aliases", lambda a: F.contains(F.lower("frame"), a)) & ~related
    )
    out = out.withColumn("shape", F.when(plain, F.to_json(F.struct("frame", "at", F.transform("found", lambda f: F.struct(F.get(f, 0)["columns"].alias("columns"), F.get(f, 0)["trusted"].alias("trusted"))).alias("parents")))))
    return out.select("unique_id", "stale", F.sha2("shape", 256).alias("key"), "shape", F.transform("found", lambda f: F.get(f, 0)["uid"]).alias("uids"))


def _shape_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each shape read once, with numbers from 1 for the parents; links are null where that can't be."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            shape = json.loads(r.shape)
            pieces = shape["frame"].split(MARK)
            sql = pieces[0] + "".join(f"{{{{ ref('{MARK}{at}') }}}}{piece}" for at, piece in zip(shape["at"], pieces[1:], strict=True))
            parents = {f"ref:{MARK}{k}": (str(k), p.get("columns")) for k, p in enumerate(shape["parents"], 1)}
            try:
                result = S.analyse(sql, parents, [str(k) for k, p in enumerate(shape["parents"], 1) if p["trusted"]])
            except S.Unreadable:
                result = None
            if result is None or result.outputs is None:
                rows.append((r.key, None))
            else:
                rows.append((r.key, [{"at": int(e.from_node), "from_col": e.from_col, "to_col": e.to_col, "kind": e.kind} for e in S.edges_of(result)]))
        yield pd.DataFrame(rows, columns=["key", "links"])


def column_edges(b: Bundle, nodes: DataFrame | None = None) -> DataFrame:
    """All column edges of ``nodes`` (default: of every model). Texts of one shape are read once, the others one by one."""
    tasks = _tasks(b, column_lists(b))
    if nodes is not None:
        tasks = tasks.join(nodes.select("unique_id"), "unique_id", "left_semi")
    keyed = written(_shaped(tasks), "shaped")
    shapes = written(keyed.where("key is not null").select("key", "shape").distinct().mapInPandas(_shape_rows, SHAPES), "shapes")
    size = shapes.agg(F.count("*") + F.coalesce(F.sum(F.size("links")), F.lit(0))).first()[0]
    known = F.broadcast(shapes) if size <= BROADCAST_ROWS else shapes.hint("merge")
    links = keyed.join(known.where("links is not null"), "key").select("unique_id", "stale", "uids", F.inline("links"))
    confidence = F.when(F.col("stale"), "stale").otherwise("exact")
    out = links.select(F.element_at("uids", F.col("at")).alias("from_node"), "from_col", F.col("unique_id").alias("to_node"), "to_col", "kind", confidence.alias("confidence"))
    unread = keyed.join(known.where("links is null"), "key", "left_semi").select("unique_id").unionByName(keyed.where("key is null").select("unique_id"))
    unread = written(unread.distinct(), "unshaped")
    if not unread.isEmpty():
        out = out.unionByName(tasks.join(unread.hint("merge"), "unique_id", "left_semi").mapInPandas(_edge_rows, EDGES))
    # the edges of one text are distinct, so only a node with several texts can repeat one
    once = keyed.groupBy("unique_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return out if once else out.distinct()


def sql_facts(b: Bundle) -> DataFrame:
    """What lint needs to know of every model's text."""
    return _tasks(b, column_lists(b)).mapInPandas(_fact_rows, FACTS)


#: Rules whose findings ``fixes`` can delete.
FIXABLE = ("trailing_semicolon", "unused_cte")
FIXES = "unique_id string, fixed_code string, applied array<string>, refused array<struct<rule:string,reason:string>>"


def _fix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            _, _, parents = _read(r)
            done = X.fix(r.raw or "", list(r.rules), lambda t: S.analyse(t, parents))  # noqa: B023
            rows.append((r.unique_id, done.text, done.applied, [{"rule": rule, "reason": why} for rule, why in done.refused]))
        yield pd.DataFrame(rows, columns=["unique_id", "fixed_code", "applied", "refused"])


def fixes(b: Bundle, found: DataFrame) -> DataFrame:
    """(unique_id, fixed_code, applied, refused) of the models with fixable findings: their text after the deletions that are
    safe, the rules of these (one for each deletion), and the reasons why others weren't made."""
    wanted = found.where(F.col("rule").isin(*FIXABLE)).groupBy("unique_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return _tasks(b, _listed(b)).join(wanted, "unique_id").mapInPandas(_fix_rows, FIXES)


def _key(node: str, col: str):  # noqa: ANN202
    return F.concat_ws("\u0001", node, col)


def column_closure(edges: DataFrame, node: str, column: str, direction: str = "up") -> DataFrame:
    """(node, column, depth) that a column comes from or goes to, itself left out."""
    graph = edges.select(_key("from_node", "from_col").alias("parent"), _key("to_node", "to_col").alias("child")).distinct()
    seed = edges.sparkSession.createDataFrame([(f"{node}\u0001{column}",)], "unique_id string")
    found = traverse.closure(graph, seed, direction)
    parts = F.split("unique_id", "\u0001")
    return found.select(parts[0].alias("node"), parts[1].alias("column"), "depth")


def closure_report(edges: DataFrame, node: str, column: str, direction: str = "up") -> DataFrame:
    """For each reached column its links inside the closure: via, kinds, and the weakest confidence."""
    found = written(column_closure(edges, node, column, direction), "closure")
    inside = found.select("node", "column").unionByName(edges.sparkSession.createDataFrame([(node, column)], "node string, column string"))
    near, far = (("from", "to") if direction == "up" else ("to", "from"))
    links = edges.join(inside.select(F.col("node").alias(f"{far}_node"), F.col("column").alias(f"{far}_col")), [f"{far}_node", f"{far}_col"])
    rank = F.when(F.col("confidence") == "exact", 0).when(F.col("confidence") == "name_match", 1).otherwise(2)
    grouped = links.groupBy(F.col(f"{near}_node").alias("node"), F.col(f"{near}_col").alias("column")).agg(
        F.array_sort(F.collect_set(F.concat(F.col(f"{far}_node"), F.lit("."), F.col(f"{far}_col")))).alias("via"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.max(rank).alias("r"),
    )
    weakest = F.when(F.col("r") == 0, "exact").when(F.col("r") == 1, "name_match").otherwise("stale")
    return found.join(grouped, ["node", "column"]).select("node", "column", "depth", "via", "kinds", weakest.alias("confidence")).orderBy("depth", "node", "column")


def column_counts(edges: DataFrame) -> DataFrame:
    """(node, column, direct_in, direct_out)."""
    into = edges.groupBy(F.col("to_node").alias("node"), F.col("to_col").alias("column")).agg(F.count("*").alias("direct_in"))
    out = edges.groupBy(F.col("from_node").alias("node"), F.col("from_col").alias("column")).agg(F.count("*").alias("direct_out"))
    return into.join(out, ["node", "column"], "full_outer").na.fill(0, ["direct_in", "direct_out"])


def column_subgraph(b: Bundle, edges: DataFrame, node: str, column: str) -> tuple[DataFrame, DataFrame]:
    """The nodes that a traced column touches on either side, and the edges among them."""
    seed = b.nodes.where(F.col("unique_id") == node).select("unique_id")
    reached = [column_closure(edges, node, column, d).select(F.col("node").alias("unique_id")) for d in ("up", "down")]
    kept = b.nodes.join(seed.unionByName(reached[0]).unionByName(reached[1]).distinct(), "unique_id", "left_semi")
    return kept, traverse.pruned(b.edges, kept)


def reference_calls(b: Bundle) -> DataFrame:
    """(unique_id, head, package, name, version, conditional, line, column) of every literal ref and source in the models' text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for c in S.calls(r.raw_code or ""):
                    rows.append((r.unique_id, c.head, c.arguments[0] if len(c.arguments) > 1 else None, c.arguments[-1], c.version, c.conditional, *S.line_and_column(r.raw_code, c.at)))
            yield pd.DataFrame(rows, columns=["unique_id", "head", "package", "name", "version", "conditional", "line", "column"])

    return b.node_sql.select("unique_id", "raw_code").mapInPandas(read, "unique_id string, head string, package string, name string, version string, conditional boolean, line int, column int")


# --- lint rules on facts ---------------------------------------------------------------------------------------------


def _by_fact(condition: str, related=None) -> Callable[[Bundle, Mapping], DataFrame]:  # noqa: ANN001
    def run(b: Bundle, o: Mapping) -> DataFrame:
        f = o["facts"].where(condition)
        return f.select("unique_id", (F.array().cast("array<string>") if related is None else related()).alias("related"))

    return run


lint.rule("select_star", "sql", "selects all columns", needs="facts")(_by_fact("wildcard"))
lint.rule("cartesian_join", "sql", "joins without a condition", needs="facts")(_by_fact("cartesian > 0", lambda: F.array(F.col("cartesian").cast("string"))))
lint.rule("unknown_column_reference", "sql", "names columns that a parent doesn't have", severity="error", needs="facts")(_by_fact("size(unknown) > 0", lambda: F.array_sort(F.array_distinct("unknown"))))
lint.rule("duplicate_output_columns", "sql", "an output name repeats", severity="error", needs="facts")(_by_fact("size(duplicates) > 0", lambda: F.col("duplicates")))
lint.rule("unused_cte", "sql", "a CTE that nothing reads", needs="facts")(_by_fact("size(unused_ctes) > 0", lambda: F.array_sort("unused_ctes")))
lint.rule("order_by_without_limit", "sql", "sorts its output without a limit", needs="facts")(_by_fact("order_without_limit"))
lint.rule("unparsable_sql", "sql", "text that can't be read", default=False, needs="facts")(_by_fact("not readable", lambda: F.array("problem")))


@lint.rule("hard_coded_references", "sql", "names a relation without ref or source", needs="facts")
def hard_coded_references(b: Bundle, o: Mapping) -> DataFrame:
    from tributary.functions.globs import name_glob

    kept = F.col("hard_coded")
    for glob in o.get("ignore", ()):
        kept = _without(kept, name_glob(glob))
    return o["facts"].select("unique_id", kept.alias("related")).where("size(related) > 0")


def _without(names, pattern: str):  # noqa: ANN001, ANN202
    return F.filter(names, lambda x: ~x.rlike(pattern))


def resolved_references(b: Bundle, projects: Sequence[str] = ()) -> DataFrame:
    """``reference_calls`` with ``verdict`` and ``target``.

    ``local``: the caller's own package has the name (and the version asked for), ``target`` is its node. ``foreign``: the package
    named has it, or is one of ``projects``. ``foreign_any``: no package is named and only others have it. ``disabled``:
    it is only among what is disabled. ``missing``: nobody has it. A package that is named is never replaced by another."""
    calls = reference_calls(b).withColumn("call", F.monotonically_increasing_id())
    calls = calls.withColumn("name", F.when(F.col("head") == "source", F.concat_ws(".", "package", "name")).otherwise(F.col("name")))
    calls = calls.withColumns({
        "package": F.when(F.col("head") == "ref", F.col("package")), "caller": N.package(F.col("unique_id")), "version": N.normalize_version(F.col("version")),
    })
    u = b.universe.select("head", "name", F.col("package").alias("of"), F.col("version").alias("of_version"), "disabled", "uid")
    key = lambda c: F.coalesce(c, F.lit(""))
    source, own = F.col("head") == "source", key(F.col("of")) == key(F.col("caller"))
    asked = F.col("version").isNull() | F.col("version").eqNullSafe(F.col("of_version"))
    there = F.col("uid").isNotNull() & ~F.col("disabled")
    seen = calls.join(u, ["head", "name"], "left").groupBy("unique_id", "call", "head", "package", "name", "version", "conditional", "caller", "line", "column").agg(
        F.coalesce(F.bool_or(there & asked & (source | own)), F.lit(False)).alias("home"),
        F.coalesce(F.bool_or(there & (F.col("of") == F.col("package"))), F.lit(False)).alias("named"),
        F.coalesce(F.bool_or(there & ~own), F.lit(False)).alias("others"),
        F.coalesce(F.bool_or(F.col("disabled") & asked), F.lit(False)).alias("parked"),
        # of several versions the one asked for, else the greatest; of equal ones the smallest uid
        F.min(F.when(there & asked & (source | own), F.struct((-F.coalesce(F.col("of_version").try_cast("double"), F.lit(0.0))).alias("v"), "uid"))).alias("best"),
    )
    at_home = F.col("package").isNull() | (F.col("package") == F.col("caller"))
    lost = F.when(F.col("parked"), "disabled").otherwise("missing")
    verdict = F.when(at_home & F.col("home"), "local").when(F.col("head") == "source", lost)
    verdict = verdict.when(F.col("package").isNull() & F.col("others"), "foreign_any").when(at_home, lost)
    verdict = verdict.when(F.col("named") | F.col("package").isin(*projects), "foreign").otherwise(lost)
    out = seen.withColumn("verdict", verdict)
    return out.select("unique_id", "head", "package", "name", "version", "conditional", "line", "column", "verdict", F.when(F.col("verdict") == "local", F.col("best.uid")).alias("target"))


@lint.rule("unresolved_references", "modeling", "a reference names nothing")
def unresolved_references(b: Bundle, o: Mapping) -> DataFrame:
    """Literal calls outside conditional arms that name nothing, or only what is disabled."""
    calls = o.get("calls")
    calls = calls if calls is not None else resolved_references(b, o.get("projects", ()))
    lost = calls.where("not conditional and verdict in ('missing', 'disabled')")
    return lost.groupBy("unique_id").agg(F.array_sort(F.collect_set("name")).alias("related"))
