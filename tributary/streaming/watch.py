"""Watching artifacts: a stream of manifests, and for each new one the changes against the one before.

Every arriving file is one version. ``watch`` handles versions in order of their time with ``foreachBatch``; the last
bundle's tables are in the shared folder, so each comparison starts from files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.operators import diff
from tributary.plans.bundle import Bundle
from tributary.sources.manifest import from_document

VERSIONS = "path string, modificationTime timestamp, length long, content binary"


def versions(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """A stream of (path, modificationTime, value): whole files as they arrive."""
    files = spark.readStream.format("binaryFile").schema(VERSIONS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).load(folder)
    return files.select("path", "modificationTime", F.decode("content", "UTF-8").alias("value"))


def watch(
    spark: SparkSession, folder: str, checkpoint: str, on_change: Callable[[Bundle, DataFrame | None], None], interval: str | None = "2 seconds"
) -> StreamingQuery:
    """Calls ``on_change(bundle, changes)`` for each version; ``changes`` is None for the first. A file that vanishes is
    no change. With ``interval=None`` what is there is worked off, and the query ends. The last version's text is kept in
    ``checkpoint``, so that after a restart the next one is compared with it."""
    state: dict[str, Bundle] = {}
    kept = f"{checkpoint.rstrip('/')}/last-version"
    where = spark._jvm.org.apache.hadoop.fs.Path(kept)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        state["last"] = from_document(spark.read.schema("value string").parquet(kept))

    def handle(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("modificationTime", "path").select("path").collect():  # one file a batch
            now = from_document(batch.where(F.col("path") == row["path"]).select("value"))
            before = state.get("last")
            on_change(now, diff.node_changes(before, now) if before is not None else None)
            batch.where(F.col("path") == row["path"]).select("value").write.mode("overwrite").parquet(kept)
            state["last"] = now

    writer = versions(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def changed(before: tuple[float, int] | None, now: tuple[float, int]) -> bool:
    """Whether a folder's (latest time, file count) tells of a change: a later time or more files."""
    return before is not None and (now[0] > before[0] or now[1] > before[1])


def stamp(spark: SparkSession, folder: str, glob: str = "*") -> tuple[float, int]:
    """(latest modification time, file count) of a folder, from Spark's own file listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    row = files.agg(F.max("modificationTime").alias("t"), F.count("*").alias("n")).first()
    return (row["t"].timestamp() if row["t"] else 0.0), row["n"]
