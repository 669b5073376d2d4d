"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every key hashes to one of ``RING_SLOTS`` places of a ring on which each shard owns ``vnodes`` places. A key belongs
to the first virtual node clockwise. Each shard has a capacity; keys beyond it continue clockwise to the next virtual
node whose shard has room. With ``slack=0`` the capacities are the two integers around rows/shards and add up to the
row count, so the shards' row counts differ by at most one (law ``rows``).

What is known centrally is one count for each ring place, a fixed number whatever the data's size. From the counts
the driver derives, for each place, which ranks go to which shard and from which slot on; the executors rank the rows
of each place and look their range up. Only four narrow columns are shuffled, by a uniform hash.

Defined results: null texts count no bytes and have CRC 0; null ids hash like a value of their own; repeated rows are
placed one by one and are interchangeable; an empty table gives no rows; further columns are ignored or, in
``shard_rows``, returned untouched.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.llm.common import ROW, materialize, pick, unpack_row, with_row

#: Places on the ring; bounds what the driver gathers, and splits the ranking of rows.
RING_SLOTS = 16_384


class Span(NamedTuple):
    """Ranks ``lo`` to ``hi`` (excluded) of a ring place go to ``shard``, from ``first_slot`` on."""

    place: int
    lo: int
    hi: int
    shard: int
    first_slot: int


def ring(shards: int, vnodes: int, seed: int, slots: int = RING_SLOTS) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, sorted. The nodes of a shard depend on its number alone, as far as no
    place is taken; a taken place is passed over."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        draw = random.Random(f"{seed}:{shard}")
        for _ in range(vnodes):
            place = draw.randrange(slots)
            while place in taken:
                place = (place + 1) % slots
            taken[place] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-(1 + slack) * rows // shards)] * shards


def assign(counts: dict[int, int], nodes: Sequence[tuple[int, int]], room: list[int], slots: int) -> list[Span]:
    """Bounded loads: first each place fills its own shard, in ring order, then what is left over goes on clockwise."""
    owner_at: list[int] = [0] * slots
    k = 0
    for place in range(slots):
        while k < len(nodes) and nodes[k][0] < place:
            k += 1
        owner_at[place] = k % len(nodes)
    room, used, spans, over = list(room), [0] * len(room), [], []

    def put(place: int, lo: int, n: int, shard: int) -> None:
        spans.append(Span(place, lo, lo + n, shard, used[shard]))
        used[shard] += n
        room[shard] -= n

    for place in sorted(counts):
        shard = nodes[owner_at[place]][1]
        if n := min(counts[place], room[shard]):
            put(place, 0, n, shard)
        if n < counts[place]:
            over.append((place, n, counts[place] - n))
    for place, lo, n in over:
        at = owner_at[place]
        while n:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            if take := min(n, room[shard]):
                put(place, lo, take, shard)
                lo, n = lo + take, n - take
    return spans


def _place(seed: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return h, F.pmod(h, F.lit(RING_SLOTS)).cast("int")


def _spans(counts: DataFrame, shards: int, vnodes: int, seed: int, slack: float) -> list[Span]:
    per_place = {r["place"]: r["n"] for r in counts.collect()}  # RING_SLOTS rows at most
    total = sum(per_place.values())
    return assign(per_place, ring(shards, vnodes, seed), capacities(total, shards, slack), RING_SLOTS)


def _located(keyed: DataFrame, spans: list[Span]) -> DataFrame:
    spark = keyed.sparkSession
    table = spark.createDataFrame(spans, "place int, lo long, hi long, shard int, first_slot long")
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy("h", "doc_id", *[c for c in ("size", "text_crc32") if c in keyed.columns])) - 1)
    hit = (ranked["place"] == table["place"]) & (ranked["rank"] >= table["lo"]) & (ranked["rank"] < table["hi"])
    # each place has one span and a few overflow spans, whatever the number of rows
    return ranked.join(F.broadcast(table), hit).select(
        *[ranked[c] for c in keyed.columns], "shard", (F.col("first_slot") + ranked["rank"] - F.col("lo")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = 64, seed: int = 7, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row."""
    h, place = _place(seed)
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keyed = materialize(
        pick(docs, doc_id="long", text="string").select(
            "doc_id",
            (F.octet_length(data) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            h.alias("h"),
            place.alias("place"),
        ),
        "sharding-keys",
    )
    spans = _spans(keyed.groupBy("place").agg(F.count("*").alias("n")), shards, vnodes, seed, slack)
    return _located(keyed, spans).select(
        "doc_id", "size", "text_crc32", F.lit("rows" if slack <= 0 else "bounded").alias("law"), "shard", "slot"
    )


def shard_rows(docs: DataFrame, shards: int = 16, vnodes: int = 64, seed: int = 7, slack: float = 0.0) -> DataFrame:
    """All rows and columns of ``docs`` plus ``shard`` and ``slot`` (named ``shard_`` and so on where taken)."""
    h, place = _place(seed)
    rows = with_row(docs, doc_id="long")
    counts = pick(docs, doc_id="long").select(place.alias("place")).groupBy("place").agg(F.count("*").alias("n"))
    spans = _spans(counts, shards, vnodes, seed, slack)
    located = _located(rows.select(ROW, "doc_id", h.alias("h"), place.alias("place")), spans)
    named = []
    for n in ("shard", "slot"):
        free = n
        while free in docs.columns:
            free += "_"
        located, named = located.withColumnRenamed(n, free), [*named, free]
    return unpack_row(located, docs.columns, *named)
