"""The session's shared folder, and tables written there to cut the lineage of fixpoint loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the driver and all executors share. Set to a new folder only where it is unset and
    the session is local; on a cluster such a folder would be private to each machine, so the call fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later plans start from files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it was just read from a written table, else written: for tables that a loop joins again and again."""
    return df if hasattr(df, "_written_at") else written(df, name)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as the session shuffles to. Spark merges no shuffle of a fixed number: by the size of
    its compressed blocks it would merge those of repeating text into tasks that are too large for several sorts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for ``tables``, once nothing that is still to run reads it."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with a row number ``name`` inside each group, by ``order``. The rows are sorted by ranges; each range numbers its
    own, and the counts of the ranges before it are added, so no group is held by one task."""
    rows = written(df.orderBy(*groups, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    sizes = rows.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*groups).orderBy("_part")) - F.col("_n"))
    before = before.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_of"), "_before")
    on = rows["_part"] == before["_of"]
    for g in groups:
        on = on & rows[g].eqNullSafe(before[f"_{g}"])
    own = F.row_number().over(W.partitionBy("_part", *groups).orderBy("_at"))
    return rows.join(before, on).withColumn(name, (own + F.col("_before")).cast("int")).select(*df.columns, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
