"""Near-duplicate documents: one-permutation MinHash with optimal densification, bands, star-shaped candidates.

1. Each text becomes the set of its distinct 5-word shingles (64-bit hashes). Texts with equal sets form one class,
   which its smallest doc_id stands for; classes link nothing twice, however many copies there are.
2. The set is hashed once; the ``BINS`` ranges of the hash give one minimum each, and an empty bin takes the value of a
   bin that a fixed pseudo-random sequence for that bin names first among the filled ones. ``BANDS`` bands of ``ROWS``
   bins are buckets: at similarity 0.85 a pair shares none with probability (1 - 0.85^8)^32 = 4e-5.
3. Within a bucket only the star from its centre to each other member is compared: as many pairs as members. The
   centre is the member with the most fellow members over all its buckets, so in a family of edited copies the
   original. Pairs are screened on whole signatures and confirmed on full sets.
4. What a star can miss are links between members that are not yet in one component. Buckets with more than one
   component are therefore worked off whole: split into blocks, and only pairs across components of which the
   signatures agree in ``SCREEN`` of the bins leave the blocks and are confirmed on full sets. Hence stars save work,
   but lose no link except by the odds of the bands and of the screen. The estimate from the bins varies most where the
   union has few shingles: at similarity 0.85 it falls below ``SCREEN`` in up to 5e-4 of cases with 40 of them, in 1e-5
   from 300 on. Only a pair without other links to its component can be lost so. A lower screen lets pairs of one large family
   of looser copies through by the square of its size: at 0.68 100 times as many. A bucket has ``PARTS`` blocks
   at most (each of up to ``MOST`` members, beyond which there are more), so a signature is copied at most that often.
5. Components of all links; within one, the smallest doc_id stays.

Defined results: null texts, empty texts and texts without words have the empty set and are linked with nothing;
repeated rows (one doc_id, one text) are all kept or all dropped; rows with a null doc_id take the component of their
class and are kept only where it has no doc_id (``deduplicated_rows`` returns all of them); an empty table gives no rows; further columns are ignored or returned
untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import ROW, discard, materialize, pick, unpack_row, with_marks, with_row
from tributary.llm.components import components
from tributary.llm.words import SPACED, U64, hashed, mix, windows

WIDTH, BINS, ROWS = 5, 256, 8
BANDS = BINS // ROWS
#: Linked at 100 * |A and B| >= 85 * |A or B|.
PERCENT = 85
SCREEN = 0.76
#: Members of a bucket that are compared with each other at a time: at least, and at most in a block of a large bucket.
BLOCK, MOST = 64, 16_384
#: Blocks of a bucket, as long as they hold no more than ``MOST`` members.
PARTS = 64


@lru_cache(1)
def _probes() -> np.ndarray:
    """For each bin the bins to look into, attempt after attempt."""
    key = np.arange(BINS, dtype=U64)[:, None] * U64(1 << 32) + np.arange(64 * BINS, dtype=U64)[None, :]
    return (mix(key + U64(1)) % U64(BINS)).astype(np.int16)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; of fewer than five words the whole sequence is one."""
    if 0 < len(words) < WIDTH:
        return windows(words, len(words)) ^ U64(len(words))
    return np.unique(windows(words, WIDTH))


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS 16-bit minima of a sorted set."""
    scrambled = np.sort(mix(shingles + U64(0x5851F42D4C957F2D)))
    bins = (scrambled >> U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out, filled = np.zeros(BINS, np.uint16), np.zeros(BINS, bool)
    out[bins[first]] = (mix(scrambled[first]) & U64(0xFFFF)).astype(np.uint16)
    filled[bins[first]] = True
    empty, probes, t = np.flatnonzero(~filled), _probes(), 0
    while len(empty):
        tries = probes[empty, t : t + 32]
        good = filled[tries]
        found = good.any(axis=1)
        out[empty[found]] = out[tries[found, good[found].argmax(axis=1)]]
        empty, t = empty[~found], (t + 32) % probes.shape[1]
    return out


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for part in hashed(texts, SPACED):
        for lo, hi in zip(part.starts[:-1].tolist(), part.starts[1:].tolist(), strict=True):
            yield shingle_set(part.hashes[lo:hi])


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            n, name, sig = [], [], []
            for s in _sets(part.column("text")):
                n.append(len(s))
                name.append(_name(s) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "name", "sig"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(_sets(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "name", "shingles"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BINS)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            halves = _matrix(part.column("sig")).view(U64).reshape(-1, BANDS, ROWS // 4)
            key = np.broadcast_to(np.arange(BANDS, dtype=U64), halves.shape[:2]).copy()
            for k in range(ROWS // 4):
                key = mix(key * U64(0xD6E8FEB86659FD93) + halves[:, :, k])
            node = np.repeat(part.column("node").to_numpy(zero_copy_only=False), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(node)], ["bucket", "band", "node"])


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            alike = (_matrix(part.column("sig_a")) == _matrix(part.column("sig_b"))).mean(axis=1) >= SCREEN
            a, b = (part.column(c).to_numpy(zero_copy_only=False)[alike] for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for x, y, s, t in zip(*[batch.column(c) for c in ("a", "b", "set_a", "set_b")], strict=True):
            s, t = np.frombuffer(s.as_buffer(), U64), np.frombuffer(t.as_buffer(), U64)
            if PERCENT * max(len(s), len(t)) > 100 * min(len(s), len(t)):
                continue
            common = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * common >= PERCENT * (len(s) + len(t) - common):
                a.append(x.as_py())
                b.append(y.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block_pairs(rows: dict[str, np.ndarray], sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block pair: across components, alike, of about equal sizes, and in no earlier common band."""
    left = np.flatnonzero(rows["block"] == rows["lo"][0])
    same_block = rows["lo"][0] == rows["hi"][0]
    right = left if same_block else np.flatnonzero(rows["block"] == rows["hi"][0])
    n, c, band = rows["n"], rows["component"], rows["band"][0]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(left), 256):  # some pairs at a time
        for to in range(at if same_block else 0, len(right), 256):
            x, y = left[at : at + 256], right[to : to + 256]
            ok = c[x][:, None] != c[y][None, :]
            ok &= 100 * np.minimum(n[x][:, None], n[y][None, :]) >= PERCENT * np.maximum(n[x][:, None], n[y][None, :])
            if same_block:
                ok &= x[:, None] < y[None, :]
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 1 << 14):
                p, q = x[i[k : k + (1 << 14)]], y[j[k : k + (1 << 14)]]
                same = sig[p] == sig[q]
                alike = same.mean(axis=1) >= SCREEN
                p, q, same = p[alike], q[alike], same[alike]
                first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                a.append(rows["node"][p[first]])
                b.append(rows["node"][q[first]])
    return np.concatenate(a), np.concatenate(b)


def _worked_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and block pair; a group may go on in the next batch."""
    rest: pa.Table | None = None

    def work(table: pa.Table) -> pa.RecordBatch:
        rows = {c: table.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block", "node", "band", "n", "component")}
        sig = _matrix(table.column("sig").combine_chunks())
        new = np.flatnonzero(np.r_[True, (np.diff(rows["bucket"]) != 0) | (np.diff(rows["lo"]) != 0) | (np.diff(rows["hi"]) != 0)])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in zip(new, [*new[1:], len(rows["node"])], strict=True):
            x, y = _block_pairs({k: v[lo:hi] for k, v in rows.items()}, sig[lo:hi])
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        key = [rest.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
        own = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
        cut = int(np.argmax(own))  # the last group may not be complete
        if cut:
            yield work(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None:
        yield work(rest)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    return joined.mapInArrow(_confirmed, "a long, b long")


def _classes_and_links(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, name), classes (name, node) and the links (a, b) between the classes' nodes."""
    rows = materialize(base.mapInArrow(_sketch, "doc_id long, n long, name binary, sig binary"), "near-rows")
    # partial aggregation leaves one row for each class and task, so large groups of copies meet no single task
    classes = materialize(rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")), "near-classes")
    known = classes.where("node is not null").select("node", "n", "sig")
    buckets = known.mapInArrow(_buckets, "bucket long, band int, node long")
    # aggregates are written before they are joined: then both sides are dealt anew, and Spark can split a hot bucket
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "near-shared")
    members = materialize(buckets.join(shared, "bucket"), "near-members")
    fellows = members.groupBy("node").agg(F.sum("members").alias("fellows"))
    centre = (
        members.join(fellows, "node").groupBy("bucket").agg(F.max(F.struct("fellows", (-F.col("node")).alias("minus"))).alias("best"))
        .select("bucket", (-F.col("best.minus")).alias("centre"))
    )
    centre = materialize(centre, "near-centres")
    centred = materialize(members.join(centre, "bucket"), "near-centred")
    discard(shared, centre)
    stars = _ordered(centred.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))).distinct()
    one = lambda c: known.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    sized = stars.join(one("a"), "a").join(one("b"), "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    alike = materialize(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_screened, "a long, b long"), "near-stars")
    wanted = materialize(members.select(F.col("node").alias("doc_id")).distinct(), "near-wanted")
    discard(members)
    texts = with_marks(base, "doc_id", wanted).where("_maybe").drop("_maybe").join(wanted, "doc_id", "left_semi")
    sets = materialize(texts.mapInArrow(_full_sets, "node long, name binary, shingles binary").groupBy("node", "name").agg(F.any_value("shingles").alias("shingles")), "near-sets")
    first = materialize(_links(alike, sets), "near-links")
    discard(alike, wanted)
    found = components(first)
    # In buckets whose members are in several components, those outside the centre's component ("strays") meet all
    # others but the centre, in blocks; so one stray costs a large bucket one pass, not its square.
    placed = centred.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.bool_or(F.col("node") == F.col("centre")).alias("central"))
    split = materialize(
        parts.groupBy("bucket").agg(
            F.sum(F.when(F.col("central"), 0).otherwise(F.col("size"))).alias("strays"),
            (F.sum(F.when(F.col("central"), F.col("size")).otherwise(0)) - 1).alias("others"),
            F.max(F.when(F.col("central"), F.col("component"))).alias("home"),
        ).where("strays > 0 and strays + others > 1"),
        "near-split",
    )
    left = placed.where("node <> centre").join(split, "bucket")
    # the size of a bucket's blocks grows with it, so that their number, and with it the copies of a signature, doesn't
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil((F.col("strays") + F.col("others")) / PARTS)))
    blocks = lambda c: F.ceil(F.col(c) / size).cast("int")
    stray, h = F.col("component") != F.col("home"), F.xxhash64("node")
    own = F.when(stray, F.pmod(h, blocks("strays"))).otherwise(-1 - F.pmod(h, F.greatest(blocks("others"), F.lit(1)))).cast("int")
    left = left.withColumn("block", own).withColumn("from", F.when(stray, -blocks("others")).otherwise(0))
    left = left.join(known, "node").withColumn("other", F.explode(F.sequence("from", blocks("strays") - 1)))
    dealt = left.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "band", "n", "component", "sig")
    keys = ["bucket", "lo", "hi"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    more = materialize(_ordered(dealt.mapInArrow(_worked_off, "a long, b long")).distinct(), "near-rest")
    second = _links(more, sets)
    links = materialize(first.unionByName(second), "near-links")
    discard(centred, split, more, sets, first, found)
    return rows.select("doc_id", "n", "name"), classes.select("name", "node"), links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    base = pick(docs, doc_id="long", text="string")
    rows, classes, links = _classes_and_links(base)
    found = components(links)
    named = classes.join(found, "node", "left").select("name", F.coalesce("component", "node").alias("component"))
    out = rows.join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    gone = materialize(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-gone")
    rows = with_marks(with_row(docs, doc_id="long"), "doc_id", gone)
    stay = rows.where("_maybe").join(gone, "doc_id", "left_anti").select(ROW)
    return unpack_row(rows.where("not _maybe").select(ROW).unionByName(stay), docs.columns)
