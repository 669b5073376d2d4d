"""Benchmark decontamination with suffix arrays of the training texts.

Every partition of the documents is cut into shards of up to ``SHARD_WORDS`` words. A shard's words become ordered
integers and its suffixes are sorted by doubling: by 1, 2, 4, ... words, where each round sorts only those suffixes
that are still equal to another. Then every suffix of every benchmark item is looked up by binary search, equal ones (by
their next ``WINDOW`` words, or a whole shorter item) at once; the array's range of suffixes that begin with those words gives
all places. A place holds one window of each length at most, so the places found are as many as the shard's words (times
the lengths there are), however often texts or items repeat themselves.

Words inside a found window are hit. Of the places that follow each other, each match is the longest run of words that is
also in an item: it starts where the one before ended, follows all occurrences of its first window in the items, and names the
first of those that go on the longest. The items of a document are all those that a found window occurs in; windows with the
same set of items are looked up as one.

The benchmark is sent to the executors in blocks of at most about ``BLOCK_BYTES`` of text. A task holds one block at a time,
sorts each shard once and looks up all blocks in it; documents are never shuffled, and no partition needs another one.

Defined results: null texts and texts without words have no hits; items without words are left out; items with a null
item_id mark words and count as an item named "null"; repeated rows are each looked up; of several rows with one
item_id each is searched and the id counts once; an empty table on either side gives no matches; further columns are
ignored or returned untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import ROW, pick, unpack_row, with_row
from tributary.llm.words import ALNUM, U64, hashed, mix, windows

WINDOW = 10
SHARD_WORDS = 1 << 18
BLOCK_BYTES = 8 << 20
#: Suffixes that are looked up at a time.
_STEP = 1 << 16

_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("words", pa.int64())]))
MATCHES = "array<struct<item_id:string,item_start:bigint,doc_start:bigint,words:bigint>>"


class Items(NamedTuple):
    """The items' words one after another, and their distinct windows (numbered from 0)."""

    words: np.ndarray
    item: np.ndarray  # of each word
    first: np.ndarray  # where each item's words begin
    window: np.ndarray  # that begins at each word, or -1
    length: np.ndarray  # of each window, in words
    places: np.ndarray  # of all windows, window after window
    upto: np.ndarray  # where each window's places end
    group: np.ndarray  # of each window: the set of its items
    members: np.ndarray  # of all groups, group after group
    member_upto: np.ndarray
    names: list[str]

    def occurrences(self, window: int) -> np.ndarray:
        return self.places[self.upto[window - 1] if window else 0 : self.upto[window]]


def item_windows(names: list[str | None], texts: list[str | None]) -> Items:
    words, counts = [np.empty(0, U64)], np.zeros(len(texts), np.int64)
    for part in hashed(pa.array(texts, pa.large_string()), ALNUM):
        words.append(part.hashes)
        counts[part.first : part.first + len(part.starts) - 1] = np.diff(part.starts)
    flat = np.concatenate(words)
    first = np.cumsum(counts) - counts
    item = np.repeat(np.arange(len(counts)), counts)
    ahead = counts[item] - (np.arange(len(flat)) - first[item])  # words from here to the item's end
    long = counts[item] >= WINDOW
    begins = np.flatnonzero(np.where(long, ahead >= WINDOW, ahead == counts[item]))
    size = np.minimum(counts[item[begins]], WINDOW)
    key = np.zeros(len(begins), U64)
    for n in np.unique(size):
        of = windows(np.r_[flat, np.zeros(WINDOW, U64)], int(n))
        key[size == n] = mix(of[begins[size == n]] ^ U64(n))
    _, one, number = np.unique(key, return_index=True, return_inverse=True)
    window = np.full(len(flat) + 1, -1, np.int64)
    window[begins] = number
    places = begins[np.argsort(number, kind="stable")]
    upto = np.cumsum(np.bincount(number, minlength=len(one)))
    # sets of items, told by the sum and the number of their members
    pair = np.unique(np.stack([number, item[begins]], 1), axis=0) if len(begins) else np.empty((0, 2), np.int64)
    total = np.zeros(len(one), U64)
    np.add.at(total, pair[:, 0], mix(pair[:, 1].astype(U64) + U64(1)))
    n_members = np.bincount(pair[:, 0], minlength=len(one))
    _, shown, group = np.unique(mix(total) ^ n_members.astype(U64), return_index=True, return_inverse=True)
    end = np.cumsum(n_members)
    members = [pair[end[w] - n_members[w] : end[w], 1] for w in shown]
    return Items(
        flat, item, first, window, size[one], places, upto, group, np.concatenate(members) if members else np.empty(0, np.int64),
        np.cumsum([len(m) for m in members], dtype=np.int64), ["null" if n is None else str(n) for n in names],
    )


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of all nonzero ``tokens``, sorted by the ``depth`` tokens from there; zeros end texts."""
    n = len(tokens)
    rank = np.zeros(n + depth, np.int64)
    places = np.flatnonzero(tokens)
    order = places[np.argsort(tokens[places], kind="stable")]
    new = np.r_[True, np.diff(tokens[order]) != 0] if len(order) else np.empty(0, bool)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    single = new & np.r_[new[1:], True]
    open_, k = np.flatnonzero(~single), 1
    while k < depth and len(open_):
        at = order[open_]
        key = rank[at] * (n + 1) + rank[at + k]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.r_[True, np.diff(key) != 0]
        rank[at] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        open_ = open_[~(new & np.r_[new[1:], True])]
        k *= 2
    return order


def _bounds(tokens: np.ndarray, array: np.ndarray, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of ``array`` whose suffixes begin with its first ``length`` tokens."""
    column = np.arange(query.shape[1])
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(array))
        while (busy := np.flatnonzero(lo < hi)).size:
            mid = (lo[busy] + hi[busy]) // 2
            there = tokens[array[mid][:, None] + column]
            unlike = (there != query[busy]) & (column < length[busy][:, None])
            at = unlike.argmax(axis=1)
            row = np.arange(len(busy))
            less = there[row, at] < query[busy, at]
            right = np.where(unlike[row, at], less, upper)
            lo[busy[right]] = mid[right] + 1
            hi[busy[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


def longest(found: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """Matches in a run of windows that follow each other in a text: (offset, place in the items, windows)."""
    out, k = [], 0
    while k < len(found):
        there, n = items.occurrences(found[k]), 1
        while k + n < len(found):
            if len(there) == 1:
                ahead = items.window[there[0] + n : there[0] + len(found) - k]
                unlike = np.flatnonzero(ahead != found[k + n : k + n + len(ahead)])
                n += int(unlike[0]) if len(unlike) else len(ahead)
                break
            on = there[items.window[np.minimum(there + n, len(items.window) - 1)] == found[k + n]]
            if not len(on):
                break
            there, n = on, n + 1
        out.append((k, int(there[0]), n))
        k += n
    return out


class Shard:
    """Texts (word hashes) with their suffix array, and what is found in them: hit words, (text, item name), matches."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        flat = np.concatenate(texts) if texts else np.empty(0, U64)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.known, ids = np.unique(flat, return_inverse=True)
        self.begins = np.cumsum(lengths + 1) - (lengths + 1)
        self.tokens = np.zeros(len(flat) + len(texts) + WINDOW, np.int64)
        self.tokens[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), lengths)] = 2 * ids + 2
        self.array = suffix_array(self.tokens, WINDOW)
        self.cover = np.zeros(len(self.tokens) + 1, np.int64)
        self.items: set[tuple[int, str]] = set()
        self.matches: list[tuple[int, int, str, int, int]] = []

    def look_up(self, items: Items) -> None:
        at = np.searchsorted(self.known, items.words)
        same = self.known[np.minimum(at, len(self.known) - 1)] == items.words if len(self.known) else np.zeros(len(at), bool)
        words = np.r_[np.where(same, 2 * at + 2, 2 * at + 1), np.zeros(WINDOW, np.int64)]
        strange = np.r_[0, np.cumsum(~same)]
        begin = items.places[np.r_[0, items.upto[:-1]]] if len(items.upto) else np.empty(0, np.int64)
        asked = np.flatnonzero(strange[begin + items.length] == strange[begin])  # only these can occur
        wheres, whats = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(0, len(asked), _STEP):
            some = asked[k : k + _STEP]
            lo, hi = _bounds(self.tokens, self.array, words[begin[some][:, None] + np.arange(WINDOW)], items.length[some])
            n = hi - lo
            whats.append(np.repeat(some, n))
            wheres.append(self.array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)])
        where, what = np.concatenate(wheres), np.concatenate(whats)
        length = items.length[what]
        order = np.lexsort((where, length))
        where, what, length = where[order], what[order], length[order]
        np.add.at(self.cover, where, 1)
        np.add.at(self.cover, where + length, -1)
        text = np.searchsorted(self.begins, where, "right") - 1
        for t, g in np.unique(np.stack([text, items.group[what]], 1), axis=0) if len(text) else ():
            for i in items.members[items.member_upto[g - 1] if g else 0 : items.member_upto[g]]:
                self.items.add((int(t), items.names[i]))
        # windows of full length that follow each other are one run; a shorter item is a match of its own
        new = np.r_[True, (np.diff(where) != 1) | (np.diff(length) != 0) | (length[1:] < WINDOW)] if len(where) else np.empty(0, bool)
        edges = [*np.flatnonzero(new).tolist(), len(where)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            for k, place, n in longest(what[lo:hi], items):
                i = int(items.item[place])
                t = int(text[lo])
                self.matches.append((t, int(where[lo + k] - self.begins[t]), items.names[i], int(place - items.first[i]), int(length[lo] + n - 1)))

    def hit(self) -> np.ndarray:
        """Hit words of each text."""
        inside = np.r_[0, np.cumsum(np.cumsum(self.cover) > 0)]
        ends = np.r_[self.begins[1:], len(self.cover)]
        return inside[ends] - inside[self.begins]


def _looked_up(blocks: list, at: int | None = None):  # noqa: ANN001, ANN202
    """``blocks``: broadcasts of ``Items``; with more than one, each is let go after its use. The texts are the column ``text``,
    or the field ``at`` of the packed row."""

    def found_in(texts: list[np.ndarray]) -> Shard:
        shard = Shard(texts)
        for block in blocks:
            shard.look_up(block.value)
            if len(blocks) > 1:
                del block._value
        return shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            ids: list[list[str]] = [[] for _ in range(batch.num_rows)]
            matches: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            shard: list[np.ndarray] = []
            begin = size = 0

            def close() -> None:
                got = found_in(shard)
                hits[begin : begin + len(shard)] = got.hit()
                for t, name in sorted(got.items):
                    ids[begin + t].append(name)
                for t, at, name, start, n in sorted(got.matches):
                    matches[begin + t].append({"item_id": name, "item_start": start, "doc_start": at, "words": n})

            texts = batch.column("text") if at is None else batch.column(ROW).flatten()[at]
            for part in hashed(texts, ALNUM):
                for k in range(len(part.starts) - 1):
                    own = part.hashes[part.starts[k] : part.starts[k + 1]]
                    if shard and size + len(own) > SHARD_WORDS:
                        close()
                        shard, begin, size = [], part.first + k, 0
                    size += len(own)
                    shard.append(own)
                    counts[part.first + k] = len(own)
            if shard:
                close()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts), pa.array(hits), pa.array(ids, pa.list_(pa.string())), pa.array(matches, _MATCH)],
                [*batch.schema.names, "n_words", "n_hit", "items", "matches"],
            )

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    items = pick(benchmark, item_id="string", text="string")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = part.collect()  # about block_bytes of text
        yield item_windows([r["item_id"] for r in rows], [r["text"] for r in rows])


def with_matches(rows: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, at: int | None = None) -> DataFrame:
    """``rows`` (with a column text, or with it as field ``at`` of the packed row) plus n_words, n_hit, ``items`` (sorted ids) and ``matches``: item_id, item_start,
    doc_start, words of the longest verbatim matches of ``WINDOW`` words or more (or of a whole shorter item)."""
    context = rows.sparkSession.sparkContext
    blocks = [context.broadcast(block) for block in _blocks(benchmark, block_bytes)]
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T._parse_datatype_string(MATCHES))]
    found = rows.mapInArrow(_looked_up(blocks, at), T.StructType([*rows.schema.fields, *more]))
    return found.withColumn("items", F.array_sort(F.array_distinct("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item_ids), matches of every row."""
    found = with_matches(pick(docs, doc_id="long", text="string"), benchmark, block_bytes)
    return found.select("doc_id", "n_words", "n_hit", "items", "matches")


def clean_rows(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit word, with their own columns."""
    rows = with_row(docs, text="string")
    at = docs.columns.index("text")
    if docs.schema[at].dataType == T.StringType():  # then it needn't be sent a second time
        found = with_matches(rows.select(ROW), benchmark, block_bytes, at)
    else:
        found = with_matches(rows, benchmark, block_bytes)
    return unpack_row(found.where("n_hit = 0"), docs.columns)
