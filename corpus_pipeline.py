"""From raw documents to sharded training text: five stages, each one operator over all that the stage before kept.

Every stage takes null, empty and very long texts, nulls in any column, ties, repeated rows, empty tables and further columns
(also such that clash with its own) without failing, and returns the columns of its input; an empty input gives an empty
output. What each does with them is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import decontamination, mixing, near_dup, quality, sharding
from tributary.llm.common import discard, materialize, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive fences reject go. Null and empty texts fail the base rules; a null language
    or source is a group of its own; repeated rows are judged alike."""
    return quality.quality_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays. Texts without words are linked with nothing and stay; repeated
    rows (one doc_id, one text) all stay or all go; rows without a doc_id stay."""
    return near_dup.deduplicated_rows(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim match of a benchmark window go. Texts without words have none and stay, as do all documents
    where the benchmark is empty."""
    return decontamination.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of short sources repeat, of long ones some are left out. Texts without words are taken no times; a null source
    is a source of its own, after all others; repeated rows share what they are given."""
    return mixing.mix_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot in it, also repeated ones and those without a doc_id or text."""
    return sharding.shard_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("sharding", shards),
]

#: The ring's bounded loads aren't expressible in SQL; the tests hold every stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{k}-{name.replace(' ', '-')}")
        if k:
            discard(before)  # the next stage's rows are written
    return docs
