"""Token counts from an exact length histogram.

Every text is encoded whole; documents are then aggregated by encoded length. The histogram has one row for each
length that occurs, is exact, and merges by adding counts. Its suffix sums (documents and tokens from a length on)
answer totals, quantiles and totals after truncation for any context limit without the documents.

The suffix sums are taken in two steps, over blocks of lengths and inside each block, so no task sees all rows.

Defined results: null and empty texts have length 0; repeated rows each count; an empty table gives an empty
histogram, whose totals are 0 and whose quantiles are null; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import materialize, pick

#: Where the ranks of a byte-level BPE vocabulary are, on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths whose suffix sums are taken together.
BLOCK = 64


@lru_cache(2)
def encoding(ranks: str):  # noqa: ANN201
    import tiktoken

    with open(ranks, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(t): int(n) for t, n in pairs}, special_tokens={})


def token_lengths(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    return pick(docs, doc_id="long", text="string").mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def merged(*histograms: DataFrame) -> DataFrame:
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length that occurs: n_docs, docs_from and tokens_from (documents at least that long, and their tokens),
    docs_upto (at most that long) and truncated_total (all tokens if texts end at that length)."""
    cells = materialize(histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block")), "length-histogram")
    sums = cells.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)  # lengths / BLOCK rows
    zero = F.lit(0).cast("long")
    beyond = sums.select(
        "block", F.coalesce(F.sum("docs").over(later), zero).alias("docs_beyond"), F.coalesce(F.sum("tokens").over(later), zero).alias("tokens_beyond")
    )
    totals = sums.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    own = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    out = cells.join(beyond, "block").crossJoin(F.broadcast(totals))  # totals is one row
    out = out.select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.col("docs_beyond") + F.sum("n_docs").over(own)).alias("docs_from"),
        (F.col("tokens_beyond") + F.sum("tokens").over(own)).alias("tokens_from"),
    )
    return out.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from",
        (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
    )


def answers(sums: DataFrame, limits: Sequence[int], quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> dict:
    """Totals, quantiles and what each context limit leaves, in one pass over the suffix sums."""
    at_least = lambda n: F.min(F.when(F.col("n_tokens") >= n, F.struct("n_tokens", "docs_from", "tokens_from")))
    first = sums.agg(at_least(0).alias("all"), *[at_least(n).alias(f"at{k}") for k, n in enumerate(limits)]).first()
    docs, tokens = (first["all"]["docs_from"], first["all"]["tokens_from"]) if first["all"] else (0, 0)
    out: dict = {"documents": docs, "tokens": tokens, "limits": {}, "quantiles": {}}
    for k, n in enumerate(limits):
        cell = first[f"at{k}"]
        longer = (cell["docs_from"], cell["tokens_from"]) if cell else (0, 0)
        out["limits"][n] = {"truncated_total": tokens - longer[1] + n * longer[0], "documents_at_or_over": longer[0]}
    if quantiles:
        need = [max(1, -int(-q * docs // 1)) for q in quantiles]
        got = sums.agg(*[F.min(F.when(F.col("docs_upto") >= n, F.col("n_tokens"))).alias(f"q{k}") for k, n in enumerate(need)]).first()
        out["quantiles"] = {q: got[f"q{k}"] for k, q in enumerate(quantiles)}
    return out
