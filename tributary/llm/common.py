"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
ROW = "_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the session is local (tests) a temporary
    folder is made and written into the setting, so later calls agree; on a cluster such a folder would be private to
    each machine, so the call fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``tables``, once nothing that is still to run reads it."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, each cast to the given type. Exact spelling decides, so columns that differ by case
    or repeat a name can't clash; of repeated names the first counts; an absent column reads as null."""
    names = df.columns
    return _numbered(df).select(
        *[(F.col(f"_c{names.index(n)}") if n in names else F.lit(None)).cast(t).alias(n) for n, t in columns.items()]
    )


def with_row(df: DataFrame, **columns: str) -> DataFrame:
    """``pick`` plus the whole input row as one struct ``_row``, for operators that return their input's rows."""
    names = df.columns
    return _numbered(df).select(
        F.struct(*[f"_c{i}" for i in range(len(names))]).alias(ROW),
        *[(F.col(f"_c{names.index(n)}") if n in names else F.lit(None)).cast(t).alias(n) for n, t in columns.items()],
    )


def unpack_row(df: DataFrame, names: Sequence[str], *more: str) -> DataFrame:
    """The rows that ``with_row`` packed, under their own names, plus the columns ``more``."""
    return df.select(*[F.col(f"{ROW}._c{i}").alias(n) for i, n in enumerate(names)], *more)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression. The optimizer may inline a projected column into a lambda and then
    evaluate it for each element; the variable of a one-element ``transform`` is evaluated once."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of the marks below: 128 or more for each id, within these bounds (128 KiB to 32 MiB).
MARK_BITS = (1 << 20, 1 << 28)


def with_marks(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` plus ``_maybe``: false only where ``key`` isn't in ``ids`` (a written table's column of the same name).

    One bit for each hash of an id, in bitmaps of 4 KiB, is broadcast; their size follows the number of ids up to
    32 MiB in all. Rows that aren't marked need no exact join with ``ids``, so their texts needn't be shuffled for it.
    Where ids are more than half of the greatest number of bits, marks would tell little: all rows are marked.
    """
    n, (least, most) = ids.count(), MARK_BITS
    if 2 * n > most:
        return df.withColumn("_maybe", F.lit(True))
    bits = min(most, max(least, 1 << (128 * n).bit_length()))
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    # dealt by bitmap before it is built: else every task would send a 4 KiB bitmap for each of its few ids
    places = ids.select(F.bitmap_bucket_number(h).alias("_b"), F.bitmap_bit_position(h).alias("_p")).distinct().repartition("_b")
    marks = places.groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(F.col("_m"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
    return df.withColumn("_b", F.bitmap_bucket_number(h)).join(F.broadcast(marks), "_b", "left").select(*[F.col(c) for c in df.columns], F.coalesce(bit, F.lit(False)).alias("_maybe"))
