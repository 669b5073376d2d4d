"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The documents of a source are dealt by hash into shards and laid end to end in seeded order; the words of a shard
are cut into blocks of ``block_words``. Sources get whole numbers of blocks by the highest quotients
``target / (2 k + 1)``, up to ``epochs`` times what they hold; a source's blocks go to its shards by the same rule on
the shards' sizes. A shard then takes every block ``quota // blocks`` times, and the first ``quota % blocks`` of the
seeded order once more. What a document gives is the overlap of its words with the blocks taken. As these are one run
from the shard's start, all documents but the one at its end are taken whole, so whole copies (``mix_rows``) miss a
shard's share by half a document at most, whatever the documents' lengths.

The driver sees one row for each source and shard. Shards hold ``shard_rows`` rows, more where the table would
otherwise need over ``MAX_SHARDS`` of them, so that table is bounded but for the number of sources. Beyond ``MAX_SOURCES``
of them the same plan is made by the executors: sources are ranked by ranges, the excess is shared in rounds over a written
table, and the divisor that deals the seats is found by bisection, with the last seats to the highest quotients.

Defined results: null texts have no words; a null source is a source of its own and comes last; repeated rows each
count; an empty table gives no rows; columns besides doc_id, text and source are ignored or returned untouched.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import ROW, materialize, pick, unpack_row, with_row, word_count

MAX_SHARDS = 65_536
#: Up to so many sources the plan is made by the driver.
MAX_SOURCES = 100_000


def cycling_weight(k: int) -> int:
    """1, 2, 3, 1, 2, 3, ... by the order of sources."""
    return 1 + k % 3


def targets(sizes: list[int], weights: list[float], epochs: int) -> list[float]:
    """Shares of the total by weight. None above ``epochs`` times its size: the excess is shared by weight again."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        by_weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / by_weight > epochs * sizes[i]}
        for i in over or open_:
            out[i] = float(epochs * sizes[i]) if over else left * weights[i] / by_weight
        if not over:
            break
        open_ -= over
    return out


def apportion(seats: int, votes: list[float], most: list[int]) -> list[int]:
    """Sainte-Lague: seat after seat to the highest ``votes / (2 k + 1)``, ties to the first, none beyond ``most``.

    Nearly all seats follow from rounding ``votes / step``, which is the same rule by divisors; only the rest is dealt
    one by one.
    """
    total = sum(votes)
    out = [0] * len(votes)
    if seats <= 0 or total <= 0:
        return out
    step = total / max(1, seats - len(votes))  # gives a few seats too few, so the highest quotients remain to be dealt
    out = [min(m, max(0, math.floor(v / step + 0.5) - 1)) for v, m in zip(votes, most, strict=True)]
    while sum(out) > seats:  # only by rounding of floats
        i = min((k for k in range(len(out)) if out[k]), key=lambda k: votes[k] / (2 * out[k] - 1))
        out[i] -= 1
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out, strict=True)) if n < most[i] and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _dealt(sized: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """``sized`` with what ``table`` says of its source, and its shard."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    joined = sized.join(table, sized["source"].eqNullSafe(table["of"]))
    return joined.withColumns({"h": h, "shard": F.pmod(F.shiftrightunsigned(h, 20), F.col("shards")).cast("int")})


def _driver_plan(sized: DataFrame, found: list[Row], weight: Callable[[int], float], block_words: int, epochs: int, seed: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their shard, quota of every shard): both plans are small enough for the driver."""
    spark = sized.sparkSession
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["size"] for r in found], [weight(k) for k in range(len(found))], epochs)
    per_shard = max(shard_rows, -(-sum(r["n"] for r in found) // MAX_SHARDS))
    rows = [(k, r["source"], r["size"], aims[k], -(-r["n"] // per_shard)) for k, r in enumerate(found)]
    table = spark.createDataFrame(rows, "k long, of string, source_size long, target double, shards int")
    dealt = _dealt(sized, F.broadcast(table), seed)  # one row for each source, at most MAX_SOURCES
    sizes: list[dict[int, int]] = [{} for _ in found]
    for r in dealt.groupBy("k", "shard").agg(F.sum("size").alias("size")).collect():  # MAX_SHARDS + sources at most
        sizes[r["k"]][r["shard"]] = r["size"]
    blocks = [{s: -(-n // block_words) for s, n in own.items()} for own in sizes]
    held = [epochs * sum(b.values()) for b in blocks]
    full = [aims[k] >= epochs * found[k]["size"] for k in range(len(found))]
    seats = round(sum(aim for aim, all_ in zip(aims, full, strict=True) if not all_) / block_words)
    quotas = apportion(seats, [0.0 if all_ else aim for aim, all_ in zip(aims, full, strict=True)], held)
    plan = []
    for k, own in enumerate(sizes):
        shards = sorted(own)
        most = [epochs * blocks[k][s] for s in shards]
        dealt_out = most if full[k] else apportion(quotas[k], [float(own[s]) for s in shards], most)
        for s, quota in zip(shards, dealt_out, strict=True):
            n = max(1, blocks[k][s])
            plan.append((k, s, quota // n, quota % n))
    return dealt, F.broadcast(spark.createDataFrame(plan, "k long, shard int, times long, extra long"))


def _ranked(per: DataFrame) -> DataFrame:
    """Sources with ``k``, their rank by code point, null last: ranges are sorted, each numbers its own rows."""
    sortable = per.withColumn("none", F.col("source").isNull())
    rows = materialize(sortable.orderBy("none", "source").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "mixing-sources")
    sizes = rows.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.withColumn("before", F.sum("rows").over(W.orderBy("part")) - F.col("rows")).drop("rows")  # one row for each partition
    inside = F.row_number().over(W.partitionBy("part").orderBy("at")) - 1
    return rows.join(F.broadcast(before), "part").select(F.col("source").alias("of"), "size", "n", (inside + F.col("before")).alias("k"))


def _spread_plan(sized: DataFrame, per: DataFrame, weight: Callable[[int], float], block_words: int, epochs: int, seed: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """As ``_driver_plan``, by the executors; the driver sees sums alone."""

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(w=[float(weight(int(k))) for k in pdf["k"]], target=None)

    state = materialize(_ranked(per).mapInPandas(weighed, "of string, size long, n long, k long, w double, target double"), "mixing-targets")
    total, rows = state.agg(F.sum("size"), F.sum("n")).first()
    while True:  # a round for each time that the excess is shared again
        open_ = F.col("target").isNull()
        given, by_weight = state.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(open_, F.col("w")))).first()
        if not by_weight:
            break
        share, most = F.lit((total - given) / by_weight) * F.col("w"), epochs * F.col("size")
        over = open_ & (share > most)
        last = state.where(over).isEmpty()
        nexts = F.when(open_, share) if last else F.when(over, most.cast("double"))
        state = materialize(state.withColumn("target", F.coalesce("target", nexts)), "mixing-targets")
        if last:
            break
    per_shard = max(shard_rows, -(-rows // MAX_SHARDS))
    table = state.select("k", "of", F.col("size").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.ceil(F.col("n") / per_shard).cast("int").alias("shards"))
    dealt = _dealt(sized, table, seed)
    shards = materialize(dealt.groupBy("k", "shard", "source_size", "target").agg(F.sum("size").alias("size")).withColumn("blocks", F.ceil(F.col("size") / block_words)), "mixing-shards")
    full = F.col("target") >= epochs * F.col("source_size")
    sources = materialize(shards.groupBy("k", "source_size", "target").agg((epochs * F.sum("blocks")).alias("held")).withColumn("votes", F.when(full, 0.0).otherwise(F.col("target"))), "mixing-votes")
    wanted, high = sources.agg(F.sum("votes"), F.max("votes")).first()
    seats = round((wanted or 0.0) / block_words)
    at = lambda d: F.least(F.col("held"), F.floor(F.col("votes") / d + 0.5)).cast("long")
    low, high = 0.0, 4 * (high or 0.0) + 1
    for _ in range(80):  # the smallest divisor that deals no more than the seats there are
        d = (low + high) / 2
        if not low < d < high:
            break
        if sources.agg(F.sum(at(d))).first()[0] > seats:
            low = d
        else:
            high = d
    some = materialize(sources.select("k", "votes", "held", at(high).alias("quota")), "mixing-quotas")
    rest = seats - (some.agg(F.sum("quota")).first()[0] or 0)
    quotient = F.col("votes") / (2 * F.col("quota") + 1)
    ties = some.where("quota < held and votes > 0").orderBy(F.desc(quotient), "k").limit(max(0, rest)).select("k", F.lit(1).alias("more"))
    quotas = some.join(ties, "k", "left").select("k", (F.col("quota") + F.coalesce("more", F.lit(0))).alias("quota"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        most = [epochs * int(b) for b in pdf["blocks"]]
        all_ = pdf["target"].iloc[0] >= epochs * pdf["source_size"].iloc[0]
        given = most if all_ else apportion(int(pdf["quota"].iloc[0]), [float(n) for n in pdf["size"]], most)
        n = [max(1, int(b)) for b in pdf["blocks"]]
        return pd.DataFrame({"k": pdf["k"], "shard": pdf["shard"], "times": [g // b for g, b in zip(given, n, strict=True)], "extra": [g % b for g, b in zip(given, n, strict=True)]})

    # a source has MAX_SHARDS + 1 shards at most
    quota = shards.join(quotas, "k").groupBy("k").applyInPandas(inside, "k long, shard int, times long, extra long")
    return dealt, materialize(quota, "mixing-plan")


def _taken(sized: DataFrame, weight: Callable[[int], float], block_words: int, epochs: int, seed: int, shard_rows: int) -> DataFrame:
    """``sized`` (source, doc_id, size and others) plus source_size, target, taken."""
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = per.limit(MAX_SOURCES + 1).collect()
    if len(found) <= MAX_SOURCES:
        dealt, quota = _driver_plan(sized, found, weight, block_words, epochs, seed, shard_rows)
    else:
        dealt, quota = _spread_plan(sized, per, weight, block_words, epochs, seed, shard_rows)
    upto = F.sum("size").over(W.partitionBy("k", "shard").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    laid = dealt.withColumn("upto", upto).join(quota, ["k", "shard"])
    start = F.col("upto") - F.col("size")
    once_more = F.greatest(F.least("upto", F.col("extra") * block_words) - start, F.lit(0).cast("long"))
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("times") * F.col("size") + once_more)
    return laid.select(*[sized[c] for c in sized.columns], "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, weight: Callable[[int], float] = cycling_weight, block_words: int = 256, epochs: int = 3, seed: int = 11, shard_rows: int = 2048) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    sized = materialize(pick(docs, doc_id="long", text="string", source="string").select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    return _taken(sized, weight, block_words, epochs, seed, shard_rows)


def mix_rows(docs: DataFrame, weight: Callable[[int], float] = cycling_weight, block_words: int = 256, epochs: int = 3, seed: int = 11, shard_rows: int = 2048) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: ``taken / size``, rounded, halves up."""
    narrow = materialize(pick(docs, doc_id="long", text="string", source="string").select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    taken = _taken(narrow, weight, block_words, epochs, seed, shard_rows)
    # repeated rows of one document share what they are given
    times = taken.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("all"), F.count("*").alias("n")).where("all > 0")
    copies = times.select("doc_id", "source", "size", F.floor(F.col("all") / (F.col("size") * F.col("n")) + 0.5).cast("int").alias("copies")).where("copies > 0")
    rows = with_row(docs, doc_id="long", text="string", source="string").select(ROW, "doc_id", "source", word_count(F.col("text")).alias("size"))
    on = [rows[c].eqNullSafe(copies[c]) for c in ("doc_id", "source", "size")]
    out = rows.join(copies, on[0] & on[1] & on[2])
    out = out.select(ROW, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return unpack_row(out, docs.columns)
