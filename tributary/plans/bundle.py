"""A graph as a bundle of tables.

Only ``nodes`` and ``edges`` are required; the others default to empty tables of the schemas below, so every operator
can join them. ``nodes.layer`` is the first directory of the path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRESHNESS = "struct<count:bigint,period:string>"
CONSTRAINT = "struct<type:string,name:string,expression:string,to:string,to_columns:array<string>,columns:array<string>>"
SCHEMAS = {
    "nodes": "unique_id string, name string, resource_type string, path string, materialized string",
    "edges": "parent string, child string",
    "detail": (
        "unique_id string, description string, tags array<string>, meta map<string,string>, access string, grp string, "
        "contract_enforced boolean, unique_key array<string>, incremental_strategy string, deprecation_date string, "
        "language string, version string, latest_version string, database string, schema string, identifier string, "
        "relation_name string, original_file_path string, patch_path string, package_name string, "
        f"semantic_dependents array<string>, loaded_at_field string, loader string, warn_after {FRESHNESS}, "
        f"error_after {FRESHNESS}, constraints array<{CONSTRAINT}>"
    ),
    "columns": f"unique_id string, pos int, name string, data_type string, description string, constraints array<{CONSTRAINT}>",
    "tests": "unique_id string, name string, kind string, column_name string, ref_uid string, ref_name string, ref_column string",
    "node_sql": "unique_id string, raw_code string, compiled_code string, stale boolean",
    "exposures": "unique_id string, exposure_type string, owner_name string, owner_email string, url string",
    "macros": "uid string, name string, sql string, params array<string>",
    "macro_edges": "caller string, callee string",
    "node_macros": "unique_id string, macro_uid string",
    "catalog_columns": "unique_id string, column string, data_type string",
    "catalog_stats": "unique_id string, stat string, value string",
    "run_results": "unique_id string, status string, execution_time double",
    "pruned_adjacent": "unique_id string, parents bigint, children bigint",
    # what references can name, captured before any pruning; its uid isn't called unique_id, so pruning leaves it whole
    "universe": "head string, name string, package string, version string, disabled boolean, uid string",
}


@dataclass(frozen=True)
class Bundle:
    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    detail: DataFrame
    columns: DataFrame
    tests: DataFrame
    node_sql: DataFrame
    exposures: DataFrame
    macros: DataFrame
    macro_edges: DataFrame
    node_macros: DataFrame
    catalog_columns: DataFrame
    catalog_stats: DataFrame
    run_results: DataFrame
    pruned_adjacent: DataFrame
    universe: DataFrame
    root_project: str | None = None
    adapter_type: str | None = None
    overview: str | None = None
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        # Spark takes a few columns of this wide table for a few hundredths of its compressed files, and would have the driver
        # broadcast the ids of all nodes
        object.__setattr__(self, "detail", self.detail.hint("merge"))

    def with_(self, **tables: DataFrame) -> Bundle:
        return replace(self, **tables)

    def merging(self) -> Bundle:
        """With nodes and edges that Spark merges: by the size of compressed files it takes the ids of a million nodes for a few
        MB, and would have the driver broadcast them."""
        return self.with_(nodes=self.nodes.hint("merge"), edges=self.edges.hint("merge"))

    def map(self, change: Callable[[str, DataFrame], DataFrame]) -> Bundle:
        return replace(self, **{f.name: change(f.name, getattr(self, f.name)) for f in fields(self) if f.name in SCHEMAS})


def universe_of(nodes: DataFrame) -> DataFrame:
    """What references can name: ``ref`` the models, seeds and snapshots, ``source`` the sources as ``source.table``."""
    seg = F.split("unique_id", r"\.")
    source = F.col("resource_type") == "source"
    refable = nodes.where(F.col("resource_type").isin("model", "seed", "snapshot", "source") & (F.size(seg) > 2))
    return refable.select(
        F.when(source, "source").otherwise("ref").alias("head"), F.when(source, F.concat(seg[2], F.lit("."), "name")).otherwise(F.col("name")).alias("name"),
        seg[1].alias("package"), F.when((F.col("resource_type") == "model") & (F.size(seg) == 4), F.regexp_replace(seg[3], "^[vV]", "")).alias("version"),
        F.lit(False).alias("disabled"), F.col("unique_id").alias("uid"),
    )


def bundle(spark: SparkSession, nodes: DataFrame, edges: DataFrame, **more: object) -> Bundle:
    """A bundle with empty tables for all that aren't given. ``edges`` are made distinct, but for a written table, which is
    taken to be so. The reference universe is by default what ``nodes`` names."""
    settled = edges if hasattr(edges, "_written_at") else edges.select("parent", "child").distinct()
    known: dict[str, object] = {"nodes": nodes, "edges": settled, "universe": universe_of(nodes)} | more
    for name, schema in SCHEMAS.items():
        if name not in known:
            known[name] = spark.createDataFrame([], schema)
    return Bundle(spark, **known)
