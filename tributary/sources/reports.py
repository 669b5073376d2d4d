"""Sinks: findings and gates in eight report formats, graph exports, documentation pages, listings.

Each is a DataFrame of text lines or of (path, body); ``save_lines`` and ``save_pages`` write them. Findings are rows
of ``rule, severity, unique_id, related, message`` (as ``lint.findings`` gives), gates of ``gate, severity, status, value``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import names as N
from tributary.operators import attributes, traverse
from tributary.plans.bundle import Bundle

#: Offset basis and prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
ORDER = ("severity", "rule", "unique_id")


def fnv1a(text: str) -> str:
    h = FNV_BASIS
    for b in text.encode():
        h = ((h ^ b) * FNV_PRIME) % (1 << 64)
    return f"{h:016x}"


@F.pandas_udf(T.StringType())
def fingerprint(key):  # noqa: ANN001, ANN201
    return key.map(fnv1a)


def _related() -> Column:
    return F.when(F.size("related") > 0, F.concat(F.lit(" ("), N.capped(F.col("related")), F.lit(")"))).otherwise(F.lit(""))


def _said() -> Column:
    return F.concat("unique_id", F.lit(": "), "message", _related())


def _path(b: Bundle | None, found: DataFrame) -> DataFrame:
    if b is None:
        return found.withColumn("file", F.lit(None).cast("string"))
    files = b.nodes.select("unique_id", "path").join(b.detail.select("unique_id", "original_file_path"), "unique_id", "left")
    return found.join(files.select("unique_id", F.coalesce("original_file_path", "path").alias("file")), "unique_id", "left")


def _escaped(c: Column) -> Column:
    out = c
    for a, z in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(z))
    return out


def _md(c: Column) -> Column:
    return F.regexp_replace(c, r"([|*_`\[\]<>\\])", r"\\$1")


def _text(d: DataFrame) -> Column:
    return F.concat(F.upper("severity"), F.lit(" ["), "rule", F.lit("] "), _said())


def _concise(d: DataFrame) -> Column:
    return F.concat(F.coalesce("file", "unique_id"), F.lit(": "), F.upper(F.substring("severity", 1, 1)), F.lit(" "), "rule", F.lit(" "), "message")


def _markdown(d: DataFrame) -> Column:
    return F.concat(F.lit("| "), "severity", F.lit(" | "), _md(F.col("rule")), F.lit(" | "), _md(F.col("unique_id")), F.lit(" | "), _md(F.concat("message", _related())), F.lit(" |"))


def _json(d: DataFrame) -> Column:
    return F.to_json(F.struct("rule", "severity", F.col("unique_id").alias("node"), "related", "message", "file"))


def _github(d: DataFrame) -> Column:
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    text = F.replace(F.replace(_said(), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit("::"), level, F.lit(" file="), F.coalesce("file", F.lit("")), F.lit(",title="), "rule", F.lit("::"), text)


def _sarif(d: DataFrame) -> Column:
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    place = F.array(F.struct(F.struct(F.struct(F.coalesce("file", F.lit("")).alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(_said().alias("text")).alias("message"), place.alias("locations"), F.struct(fingerprint(_key()).alias("key/v1")).alias("partialFingerprints")))


def _junit(d: DataFrame) -> Column:
    return F.concat(F.lit('    <testcase classname="'), _escaped(F.col("rule")), F.lit('" name="'), _escaped(F.col("unique_id")), F.lit('"><failure message="'), _escaped(F.concat("message", _related())), F.lit('"/></testcase>'))


def _codeclimate(d: DataFrame) -> Column:
    level = F.when(F.col("severity") == "error", "major").otherwise("minor")
    place = F.struct(F.coalesce("file", F.lit("")).alias("path"), F.struct(F.lit(1).alias("begin")).alias("lines"))
    return F.to_json(F.struct(F.lit("issue").alias("type"), F.col("rule").alias("check_name"), _said().alias("description"), level.alias("severity"), place.alias("location"), fingerprint(_key()).alias("fingerprint")))


def _key() -> Column:
    return F.concat_ws("|", "rule", "unique_id", F.when(F.col("rule") == "layer_violation", F.array_join("related", ",")).otherwise(F.lit("")))


# format: line, first lines, last lines, what separates lines
FORMATS: dict[str, tuple[Callable[[DataFrame], Column], list[str], list[str], str]] = {
    "text": (_text, [], [], ""),
    "concise": (_concise, [], [], ""),
    "markdown": (_markdown, ["| Severity | Rule | Node | Message |", "|---|---|---|---|"], [], ""),
    "json": (_json, ["["], ["]"], ","),
    "github": (_github, [], [], ""),
    "sarif": (_sarif, ['{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"tributary"}},"results":['], ["]}]}"], ","),
    "junit": (_junit, ['<?xml version="1.0" encoding="UTF-8"?>', "<testsuites>", '  <testsuite name="lint">'], ["  </testsuite>", "</testsuites>"], ""),
    "codeclimate": (_codeclimate, ["["], ["]"], ","),
}


def report(found: DataFrame, form: str, b: Bundle | None = None) -> DataFrame:
    """(part, n, line) of a whole report: sort by part and n to print it."""
    line, head, tail, comma = FORMATS[form]
    d = _path(b, found)
    numbered = d.select(F.lit(1).alias("part"), F.row_number().over(W.orderBy(*ORDER)).alias("n"), line(d).alias("line"))  # a report is read by people
    if comma:
        numbered = numbered.withColumn("line", F.when(F.col("n") > 1, F.concat(F.lit(comma), "line")).otherwise(F.col("line")))
    ends = found.sparkSession.createDataFrame([(0, k, x) for k, x in enumerate(head)] + [(2, k, x) for k, x in enumerate(tail)], "part int, n int, line string")
    return ends.unionByName(numbered) if head or tail else numbered


def summary(gates: DataFrame) -> DataFrame:
    return gates.groupBy("status").agg(F.count("*").alias("n"))


def listing(rows: DataFrame, form: str = "names") -> DataFrame:
    """Lines of ``select.listed`` rows: names, uids, a selector, or json."""
    if form == "selector":
        return rows.agg(F.array_join(F.array_sort(F.collect_list("list_name")), " ").alias("line"))
    line = {"names": F.col("list_name"), "uids": F.col("unique_id"), "json": F.to_json(F.struct("unique_id", F.col("list_name").alias("name"), "resource_type"))}[form]
    return rows.orderBy("unique_id").select(line.alias("line"))


def node_ids(nodes: DataFrame) -> DataFrame:
    """(unique_id, id): the name with other signs as underscores; nodes that then collide get a number."""
    base = nodes.select("unique_id", F.regexp_replace("name", "[^A-Za-z0-9_]", "_").alias("base"))
    k = F.row_number().over(W.partitionBy("base").orderBy("unique_id"))
    return base.select("unique_id", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), k.cast("string"))).alias("id"))


def _named_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = node_ids(nodes)
    end = lambda c: ids.select(F.col("unique_id").alias(c), F.col("id").alias(f"{c}_id"))
    return edges.join(end("parent"), "parent").join(end("child"), "child")


def _label(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit(" "))


# The most edges and characters of a diagram, and nodes of one of the whole graph.
MAX_EDGES, MAX_CHARS, MAX_NODES = 400, 40_000, 150
# Fixed value: the order of resource types in documentation.
DOCS_TYPES = ("source", "seed", "snapshot", "model", "semantic_model", "metric", "saved_query", "exposure")


def docs_order() -> list[Column]:
    """Order of documentation: type, layer, name."""
    kind = F.lit(len(DOCS_TYPES))
    for k, name in enumerate(DOCS_TYPES):
        kind = F.when(F.col("resource_type") == name, F.lit(k)).otherwise(kind)
    return [kind, N.layer_rank(N.layer(F.col("path"))), F.col("name"), F.col("unique_id")]


def budgeted(nodes: DataFrame, edges: DataFrame, whole: bool = False) -> DataFrame | None:
    """``mermaid``, or None where a diagram would be too large to read: no more rows than the limit are ever counted."""
    if len(edges.limit(MAX_EDGES + 1).collect()) > MAX_EDGES or (whole and len(nodes.limit(MAX_NODES + 1).collect()) > MAX_NODES):
        return None
    lines = mermaid(nodes, edges)
    size = lines.agg(F.sum(F.length("line") + 1)).first()[0] or 0
    return lines if size <= MAX_CHARS else None


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): sort by both."""
    spark = nodes.sparkSession
    named = nodes.join(node_ids(nodes), "unique_id")
    boxes = named.select(F.lit(1).alias("part"), F.concat(F.lit("    "), "id", F.lit('["'), _label(F.col("name")), F.lit('"]')).alias("line"))
    arrows = _named_edges(nodes, edges).select(F.lit(2).alias("part"), F.concat(F.lit("    "), "parent_id", F.lit(" --> "), "child_id").alias("line"))
    return spark.createDataFrame([(0, "graph LR")], "part int, line string").unionByName(boxes).unionByName(arrows).orderBy("part", "line")


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    spark, quoted = nodes.sparkSession, lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    boxes = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted("unique_id"), F.lit(" [label="), quoted("name"), F.lit("];")).alias("line"))
    arrows = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), quoted("parent"), F.lit(" -> "), quoted("child"), F.lit(";")).alias("line"))
    ends = spark.createDataFrame([(0, "digraph lineage {"), (0, "  rankdir=LR;"), (3, "}")], "part int, line string")
    return ends.unionByName(boxes).unionByName(arrows).orderBy("part", "line")


def ascii_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(col, line): the names of each layer, roots first."""
    d = nodes.join(traverse.layering(nodes, edges), "unique_id")
    return d.groupBy("col").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("name")), "] ["), F.lit("]")).alias("line")).orderBy("col")


def boxes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(unique_id, x, y): the layer, and the place in it by name."""
    d = nodes.join(traverse.layering(nodes, edges), "unique_id")
    return d.select("unique_id", F.col("col").alias("x"), (F.row_number().over(W.partitionBy("col").orderBy("name", "unique_id")) - 1).alias("y"))


def docs_pages(b: Bundle, owner_key: str = "owner") -> DataFrame:
    """(path, body) of a Markdown tree: a page for each node, an overview, and indexes by owner, tag and group."""
    kin = lambda end, other, name: (
        b.edges.join(b.nodes.select(F.col("unique_id").alias(other), "name"), other).groupBy(F.col(end).alias("unique_id")).agg(F.array_sort(F.collect_list("name")).alias(name))
    )
    columns = b.columns.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("| "), _md(F.col("name")), F.lit(" | "), F.coalesce("data_type", F.lit("")), F.lit(" | "), _md(F.trim(F.coalesce("description", F.lit("")))), F.lit(" |")).alias("l")))).alias("c"))
    tests = b.tests.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.concat_ws(" on ", "kind", "column_name"))).alias("tests"))
    d = b.nodes.join(b.detail.select("unique_id", "description"), "unique_id", "left")
    for part in (kin("child", "parent", "up"), kin("parent", "child", "down"), columns, tests):
        d = d.join(part, "unique_id", "left")
    section = lambda title, body: F.when(body.isNotNull() & (body != ""), F.concat(F.lit(f"## {title}\n\n"), body))
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), _md(x))), "\n")
    table = F.concat(F.lit("| Column | Type | Description |\n|---|---|---|\n"), F.array_join(F.transform("c", lambda x: x["l"]), "\n"))
    body = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), _md(F.col("name"))), F.coalesce("description", F.lit("_No description._")), section("Columns", table),
        section("Tests", bullets("tests")), section("Reads", bullets("up")), section("Read by", bullets("down")),
    )
    pages = d.select(F.concat("resource_type", F.lit("s/"), F.regexp_replace("unique_id", "[^A-Za-z0-9_.-]", "_"), F.lit(".md")).alias("path"), body.alias("body"))
    listed = b.nodes.groupBy("resource_type").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "resource_type", F.lit(": "), F.col("n").cast("string")))), "\n").alias("l"))
    out = pages.unionByName(listed.select(F.lit("README.md").alias("path"), F.concat(F.lit(f"# {b.root_project or 'Project'}\n\n"), F.lit((b.overview or "") + "\n\n"), "l").alias("body")))
    for what, name in ((f"meta:{owner_key}", "owners"), ("tags", "tags"), ("group", "groups")):
        index = attributes.index_by(b, what).select(F.coalesce("bucket", F.lit("(none)")).alias("k"), F.col("bucket").isNull().alias("last"), "models")
        text = index.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", "k", "models"))), lambda x: F.concat(F.lit("## "), _md(x["k"]), F.lit("\n\n"), F.array_join(F.transform(x["models"], lambda m: F.concat(F.lit("- "), _md(m))), "\n"))), "\n\n").alias("t"))
        out = out.unionByName(text.select(F.lit(f"{name}.md").alias("path"), F.concat(F.lit(f"# {name.capitalize()}\n\n"), "t").alias("body")))
    return out


def docs_drift(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, drift): missing, changed or stale pages of a folder, given its (path, body)."""
    both = pages.select("path", F.col("body").alias("new")).join(existing.select("path", F.col("body").alias("old")), "path", "full_outer")
    drift = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "stale").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", drift.alias("drift")).where("drift is not null")


def save_lines(lines: DataFrame, path: str) -> None:
    """Text files; sorted lines end up in one file after another."""
    lines.select("line").write.mode("overwrite").text(path)


def save_pages(pages: DataFrame, folder: str) -> int:
    """Writes each page to its own file, on the executors, through the file system that ``folder``'s scheme names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), strict=True):
                at = f"{base}/{path}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as f:  # a repeated task writes the same bytes again
                    f.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return pages.select("path", "body").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
