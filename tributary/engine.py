"""A session over one project: load, select, node_detail, lineage, lint, columns, replace_sql, revert_sql."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import attributes, lineage, lint, select, traverse
from tributary.plans.bundle import Bundle
from tributary.session import written
from tributary.sources import manifest, project


class Engine:
    def __init__(self, bundle: Bundle) -> None:
        self.bundle = self._loaded = bundle
        self._edges: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, *, manifest_path: str | None = None, manifest_text: str | None = None, project_dir: str | None = None, scope: str = "root") -> Engine:
        """An explicit manifest goes before a project folder. ``scope``: ``root`` or ``all`` packages."""
        if manifest_text is not None:
            b = manifest.manifest_text(spark, manifest_text)
        elif manifest_path is not None:
            b = manifest.manifest(spark, manifest_path)
        elif project_dir is not None:
            b = project.load_project(spark, project_dir)
        else:
            raise ValueError("a manifest or a project folder is needed")
        return cls(attributes.root_scope(b) if scope == "root" else b)

    def select(self, spec: str) -> DataFrame:
        return select.listed(self.bundle, [spec]) if select.validate(spec) else self.bundle.nodes

    def node_detail(self, uid: str) -> DataFrame:
        b = self.bundle
        tests = b.tests.groupBy("unique_id").agg(F.collect_list(F.struct("name", "kind", "column_name")).alias("tests"))
        columns = b.columns.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "data_type", "description"))).alias("columns"))
        d = b.nodes.where(F.col("unique_id") == uid)
        for part in (b.detail, attributes.degrees(b), tests, columns):
            d = d.join(part, "unique_id", "left")
        return d

    def lineage(self, specs: list[str], up: bool = True, down: bool = True, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges around all nodes that ``specs`` pick, in one walk."""
        return traverse.subgraph(self.bundle.nodes, self.bundle.edges, select.select(self.bundle, " ".join(specs)), up, down, depth)

    def lint(self, config: Mapping | None = None, sql: bool = True, baseline: DataFrame | None = None) -> DataFrame:
        facts = calls = None
        if sql:  # each is read by several rules
            facts = written(lineage.sql_facts(self.bundle), "facts")
            calls = written(lineage.resolved_references(self.bundle), "calls")
        found, _ = lint.findings(self.bundle, config, facts, calls=calls)
        return lint.classified(lint.suppressed(self.bundle, found, (config or {}).get("exclude")), baseline)

    def columns(self, uid: str, column: str, direction: str = "up") -> DataFrame:
        if self._edges is None:
            self._edges = written(lineage.column_edges(self.bundle), "column-edges")
        return lineage.closure_report(self._edges, uid, column, direction)

    def replace_sql(self, uid: str, code: str) -> None:
        """Another text for one model, for what-if questions; the graph's edges stay."""
        sql = self.bundle.node_sql
        new = F.when(F.col("unique_id") == uid, F.lit(code)).otherwise(F.col("raw_code"))
        compiled = F.when(F.col("unique_id") != uid, F.col("compiled_code"))
        self.bundle = self.bundle.with_(node_sql=sql.withColumns({"raw_code": new, "compiled_code": compiled}))
        self._edges = None

    def revert_sql(self, uid: str | None = None) -> None:
        """The loaded text again, of one model or of all."""
        if uid is None:
            self.bundle = self.bundle.with_(node_sql=self._loaded.node_sql)
        else:
            rest = self.bundle.node_sql.where(F.col("unique_id") != uid)
            self.bundle = self.bundle.with_(node_sql=rest.unionByName(self._loaded.node_sql.where(F.col("unique_id") == uid)))
        self._edges = None
