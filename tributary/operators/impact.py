"""What a change reaches, and the gates that pass or fail on it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import names as N
from tributary.operators import attributes, diff, traverse
from tributary.plans.bundle import Bundle
from tributary.session import written

HUB = 5
BUILDABLE = ("model", "snapshot", "seed")


def changed_nodes(current: Bundle, changes: DataFrame) -> DataFrame:
    """Buildable nodes that were added or modified and are still there."""
    present = changes.where("status <> 'removed'").select("unique_id")
    return current.nodes.where(F.col("resource_type").isin(*BUILDABLE)).join(present, "unique_id", "left_semi")


def affected_nodes(current: Bundle, changes: DataFrame) -> DataFrame:
    """(unique_id, name, resource_type, kind): models, marts and exposures below the changed nodes, these left out."""
    changed = changed_nodes(current, changes)
    reached = traverse.closure(current.edges, changed).select("unique_id").join(changed.select("unique_id"), "unique_id", "left_anti")
    d = current.nodes.join(reached, "unique_id", "left_semi")
    root = attributes.primary_package(current)
    mine = N.in_package(F.col("unique_id"), root) if root else F.lit(True)
    kind = F.when(F.col("resource_type") == "exposure", "exposure").when((F.col("resource_type") == "model") & mine, F.when(N.layer(F.col("path")) == "marts", "mart").otherwise("model"))
    return d.withColumn("kind", kind).where("kind is not null").select("unique_id", "name", "resource_type", "kind")


def owners(current: Bundle, nodes: DataFrame, key: str = "owner") -> DataFrame:
    d = current.detail.join(nodes.select("unique_id"), "unique_id", "left_semi")
    return d.select(F.col("meta")[key].alias("owner")).where("owner is not null").distinct().orderBy("owner")


def changed_hubs(current: Bundle, changes: DataFrame, threshold: int = HUB) -> DataFrame:
    """(unique_id, name, downstream): changed nodes with many nodes below, exposures not counted."""
    changed = changed_nodes(current, changes)
    counts = attributes.downstream_counts(current, changed).select("unique_id", (F.col("downstream") - F.col("exposures")).alias("downstream"))
    return changed.select("unique_id", "name").join(counts, "unique_id").where(F.col("downstream") >= threshold).orderBy(F.desc("downstream"), "name")


def untested_changes(current: Bundle, changes: DataFrame) -> DataFrame:
    return attributes.coverage_gaps(current).join(changed_nodes(current, changes).select("unique_id"), "unique_id", "left_semi").select("unique_id", "name")


def layer_violations(b: Bundle) -> DataFrame:
    """(parent, child): model edges in the root project that go from a later layer to an earlier one."""
    root = attributes.primary_package(b)
    m = b.nodes.where("resource_type = 'model'").withColumn("layer", N.layer(F.col("path")))
    m = m.where(F.col("layer").isin("staging", "intermediate", "marts"))
    m = m.where(N.in_package(F.col("unique_id"), root)) if root else m
    end = lambda c: m.select(F.col("unique_id").alias(c), N.layer_rank(F.col("layer")).alias(f"{c}_rank"))
    return b.edges.join(end("parent"), "parent").join(end("child"), "child").where("parent_rank > child_rank").select("parent", "child")


def new_layer_violations(base: Bundle, current: Bundle) -> DataFrame:
    return layer_violations(current).subtract(layer_violations(base))


def ci_selectors(current: Bundle, changes: DataFrame) -> DataFrame:
    """One row: ``name+`` of every changed node, sorted, separated by blanks."""
    names = changed_nodes(current, changes).select(F.concat(N.list_name(F.col("unique_id"), F.col("name")), F.lit("+")).alias("s"))
    return names.agg(F.array_join(F.array_sort(F.collect_set("s")), " ").alias("selector"))


def exposure_note(kind, owner, email):  # noqa: ANN001, ANN201
    who = F.concat_ws(" ", owner, F.concat(F.lit("<"), email, F.lit(">")))
    return F.concat(F.lit(" ("), F.concat_ws(", ", kind, F.when(who != "", F.concat(F.lit("owner: "), who))), F.lit(")"))


@dataclass(frozen=True)
class Gate:
    id: str
    title: str
    severity: str
    needs_diff: bool
    parameter: str | None
    default: int | None


# The gates, their default severities and parameters.
GATES = (
    Gate("coverage", "Test coverage", "off", False, "min", 80),
    Gate("column_coverage", "Column test coverage", "off", False, "min", 80),
    Gate("doc_coverage", "Documentation coverage", "off", False, "min", 80),
    Gate("new_layer_violations", "New layer violations", "error", True, None, None),
    Gate("untested_changes", "Untested changes", "warn", True, None, None),
    Gate("breaking_columns", "Breaking column changes", "error", True, None, None),
    Gate("changed_hubs", "Changed hubs", "warn", True, "min_downstream", HUB),
    Gate("affected_exposures", "Affected exposures", "warn", True, None, None),
    Gate("blast_radius", "Blast radius", "warn", True, "max", 50),
    Gate("docs_drift", "Docs drift", "off", False, None, None),
)


def gate_results(current: Bundle, base: Bundle | None = None, config: Mapping[str, Mapping[str, object]] | None = None, breaking: DataFrame | None = None, drift: DataFrame | None = None) -> DataFrame:
    """(rank, gate, severity, status, value, bound): pass, fail, warn, skip or off for every gate. A configured gate
    that needs a baseline is skipped without one."""
    spark, config, rows = current.spark, config or {}, []
    changes = written(diff.node_changes(base, current), "changes") if base is not None else None
    reached = written(affected_nodes(current, changes), "affected") if changes is not None else None
    counted: dict[str, DataFrame | None] = {}
    if base is not None:
        counted = {
            "new_layer_violations": new_layer_violations(base, current), "untested_changes": untested_changes(current, changes),
            "affected_exposures": reached.where("kind = 'exposure'"), "blast_radius": reached.where("kind <> 'exposure'"),
            "changed_hubs": changed_hubs(current, changes, (config.get("changed_hubs") or {}).get("min_downstream", HUB)),
        }
    counted |= {"breaking_columns": breaking, "docs_drift": drift}
    # one plan for all values: a row for each gate
    measures = {"tests": "coverage", "column_tests": "column_coverage", "docs": "doc_coverage"}
    values = attributes.coverage(current).select(F.col("measure").alias("of"), F.col("percent").cast("long").alias("value"))
    for gate, found in counted.items():
        if found is not None and str((config.get(gate) or {}).get("severity", "on")) != "off":
            values = values.unionByName(found.agg(F.count("*").alias("value")).select(F.lit(gate).alias("of"), "value"))
    known = {measures.get(r["of"], r["of"]): r["value"] for r in values.collect()}
    for rank, g in enumerate(GATES):
        own = config.get(g.id, {})
        severity = str(own.get("severity", g.severity if g.severity != "off" or g.id not in config else "error"))
        bound = own.get(g.parameter, g.default) if g.parameter else None
        value: int | None = None
        if severity == "off":
            rows.append((rank, g.id, severity, "off", None, bound))
            continue
        if g.needs_diff and changes is None:
            rows.append((rank, g.id, severity, "skip", None, bound))
            continue
        if g.id not in known:
            rows.append((rank, g.id, severity, "skip", None, bound))
            continue
        value = known[g.id]
        bad = value < bound if g.parameter == "min" else value > (bound if g.parameter == "max" else 0)
        rows.append((rank, g.id, severity, ("fail" if severity == "error" else "warn") if bad else "pass", value, bound))
    return spark.createDataFrame(rows, "rank int, gate string, severity string, status string, value long, bound long")
