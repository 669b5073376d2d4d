"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontamination, licenses, line_chunks, mixing, near_dup, quality, secrets, sharding, token_counts, warc
from tributary.llm.common import materialize, read_table
from tributary.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no findings labelled by hand: the forest is fitted on those of all documents whose label is
    certain, and on invented ones of the kinds that these documents lack. They have no path column either."""
    docs = read_table(spark, sf_dir, "documents")
    known = secrets.dictionary([*secrets.DICTIONARY, *secrets.corpus_words(docs)])
    found = materialize(secrets.described(docs, known), "candidates")
    forest = secrets.grown(found.withColumn("h", F.xxhash64("doc_id", "start", "value_sha256")), secrets.invented_findings(), known=known)
    return secrets.judged(found, forest)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_findings(read_table(spark, sf_dir, "documents"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_chunks.without_repeated_chunks(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "chunks_removed", "lines_removed", F.md5(F.encode("clean_text", "UTF-8")).alias("clean_md5"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(read_table(spark, sf_dir, "documents"))
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(read_table(spark, sf_dir, "documents"))
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_licenses": op2_licenses,
    "op3_line_chunks": op3_line_chunks,
    "op4_sharding": op4_sharding,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
}
