"""Documents with the awkward cases that every operator must stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("SIZE", T.StringType()),
        T.StructField("Text", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
WORDS = " ".join(f"word{i}" for i in range(80))


def awkward():
    rows = [
        (0, None, "en", "a", None, "s", "T", "k"),
        (1, "", "en", "a", 0, None, None, None),
        (2, " \n\t ", None, None, 4, "s", "T", "k"),
        (3, LONG, "en", None, len(LONG), "s", "T", "k"),
        (4, WORDS, None, "a", None, "s", "T", "k"),
        (4, WORDS, None, "a", None, "s", "T", "k"),
        (5, WORDS, "en", "\U00010000", None, "s", "T", "k"),
        (None, "a lone word", "en", "～", 3, "s", "T", "k"),
        (None, None, None, None, None, None, None, None),
    ]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
