"""Near-duplicates and decontamination: against plain Python."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.cases import awkward, frame
from tributary.llm import decontamination, near_dup, words
from tributary.llm.common import read_table, with_marks
from tributary.llm.components import components
from tributary.llm.queries import QUERIES

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sets_of(docs):
    out = []
    for d in docs:
        w = SPACED.findall(low(d[1]))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def near_reference(docs):
    """Rows (doc_id, n, component, kept) by comparing all pairs that share a shingle."""
    sets, top = sets_of(docs), list(range(len(docs)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    common = Counter()
    for group in by.values():
        for a in range(len(group)):
            for b in range(a):
                common[group[b], group[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            top[root(a)] = root(b)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[root(i)] = min(least.get(root(i), d[0]), d[0])
    rows = []
    for i, d in enumerate(docs):
        c = least.get(root(i), d[0])
        rows.append((d[0], len(sets[i]), c, d[0] == c))
    return Counter(rows)


def near_rows(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def test_near_duplicates(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").collect()]
    assert near_rows(QUERIES["op5_near_duplicates"](spark, sf)) == near_reference(docs)


def test_near_duplicates_awkward(spark):
    assert near_rows(near_dup.near_duplicates(frame(spark))) == near_reference(awkward())
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dup.deduplicated_rows(frame(spark)).columns == frame(spark).columns


def test_families_of_edited_copies(spark):
    """Chains of edits, whose ends aren't alike, and copies that differ from the original by a varying share."""
    draw = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    docs = []
    for family in range(6):
        base = [draw.choice(vocabulary) for _ in range(120 + 60 * family)]
        for _ in range(40):
            words = list(base)
            for _ in range(draw.randrange(0, len(base) // 25)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            docs.append(words)
            if family % 2 and draw.random() < 0.3:
                base = words
    docs += [[f"s{i}" for i in range(n)] for n in range(1, 14)]
    rows = [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(docs)]
    got = near_rows(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == near_reference(rows)


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    for n in (1, 3, 20, 300, 5000):
        a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: -max(1, n // 10)] if n > 1 else a, draw.integers(0, 1 << 63, n // 10).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        true = common / (len(a) + len(b) - common)
        assert abs((near_dup.signature(a) == near_dup.signature(b)).mean() - true) < 0.15


def test_bands_and_screen_lose_few_pairs():
    """Signatures of random pairs a little above the threshold, with unions of few and of many shingles."""
    draw = np.random.default_rng(9)
    lost = trials = 0
    for union in (20, 40, 80, 140, 300, 1000):
        common = -(-85 * union // 100)
        for _ in range(1500):
            x = draw.integers(1, 1 << 63, union).astype(np.uint64)
            own = common + (union - common) // 2
            a, b = near_dup.signature(np.unique(x[:own])), near_dup.signature(np.unique(np.r_[x[:common], x[own:]]))
            same = a == b
            lost += not (same.mean() >= near_dup.SCREEN and same.reshape(near_dup.BANDS, near_dup.ROWS).all(axis=1).any())
            trials += 1
    assert lost <= 6, (lost, trials)


def test_strays_of_large_buckets_in_sub_blocks():
    """Block pairs beyond the sub-block size give what all pairs give."""
    draw = np.random.default_rng(4)
    sig = np.repeat(draw.integers(0, 1 << 16, (1, near_dup.BINS)), 700, axis=0).astype(np.uint16)
    for r in range(700):
        sig[r, draw.integers(8, near_dup.BINS, r % 90)] = r
    rows = {"node": np.arange(700), "n": draw.integers(90, 120, 700), "component": np.arange(700) // 3, "band": np.zeros(700, np.int64), "lo": np.zeros(700, np.int64), "hi": np.ones(700, np.int64), "block": (np.arange(700) >= 400).astype(np.int64)}
    want = lambda pairs: {(a, b) for a, b in pairs if rows["component"][a] != rows["component"][b] and 100 * min(rows["n"][a], rows["n"][b]) >= 85 * max(rows["n"][a], rows["n"][b]) and (sig[a] == sig[b]).mean() >= near_dup.SCREEN}
    got = list(zip(*near_dup._block_pairs(rows, sig), strict=True))
    assert set(got) == want((a, b) for a in range(400) for b in range(400, 700)) and len(got) == len(set(got)) > 100
    one = {k: v[:400] for k, v in rows.items()} | {"hi": np.zeros(400, np.int64)}
    assert set(zip(*near_dup._block_pairs(one, sig[:400]), strict=True)) == want((a, b) for a in range(400) for b in range(a + 1, 400))


def test_long_texts_are_hashed_in_pieces():
    texts = ["b", "a bc " * 50 + "d" * 100 + " e", "", "x" * 300, " y  z "]
    whole = [(w.first, w.hashes.tolist(), w.starts.tolist()) for w in near_dup.hashed(near_dup.pa.array(texts), near_dup.SPACED)]
    words.STEP = 64
    try:
        parts = list(near_dup.hashed(near_dup.pa.array(texts), near_dup.SPACED))
    finally:
        words.STEP = 1 << 20
    assert [h for w in parts for h in w.hashes.tolist()] == [h for _, hs, _ in whole for h in hs]
    assert sum(len(w.starts) - 1 for w in parts) == len(texts)


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)] + [(900, 500 + i) for i in range(40)]
    top = {n: n for e in edges for n in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == top


def decontamination_reference(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        for i in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[i : i + 10])].add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(low(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    found |= ids
                    hit |= set(range(i, i + n))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def hit_rows(df):
    return Counter(
        (r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in df.collect()
    )


def test_decontamination(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
    want = decontamination_reference(docs, items)
    got = Counter(tuple(r) for r in QUERIES["op7_decontamination"](spark, sf).collect())
    assert got == want
    assert sum(n for r, n in want.items() if r[-1]) > 0
    blocks = decontamination.contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), block_bytes=3000)
    assert hit_rows(blocks) == want
    kept = decontamination.clean_rows(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    assert kept.count() == sum(n for r, n in want.items() if not r[-1])


def test_decontamination_awkward(spark):
    items = [(1, "a b c"), (1, "LONE word"), (2, None), (3, " !! "), (None, "word3 word4"), (4, " ".join(f"word{i}" for i in range(20, 45))), (5, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x0 w14x1 w15x2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [*[r[:2] for r in awkward()], (9, "a b c a b c a b c"), (10, "word3! WORD4, word3 word4 a b")]
    docs = spark.createDataFrame(more, "doc_id long, text string")
    assert hit_rows(decontamination.contamination(docs, bench)) == decontamination_reference(more, items)
    assert hit_rows(decontamination.contamination(docs, bench.where("false"))) == decontamination_reference(more, [])
    assert decontamination.contamination(docs.where("false"), bench).count() == 0
    assert decontamination.clean_rows(frame(spark), bench).columns == frame(spark).columns


@pytest.mark.parametrize("letters", [2, 30])
def test_suffix_array_and_longest_matches(letters):
    draw = np.random.default_rng(letters)
    tokens = np.r_[draw.integers(1, letters, 700), 0, draw.integers(1, letters, 300), np.zeros(16, int)]
    got = decontamination.suffix_array(tokens, 8)
    prefixes = [tuple(tokens[p : p + 8][: np.argmin(np.r_[tokens[p : p + 8], 0])]) for p in got]
    assert sorted(got) == list(np.flatnonzero(tokens)) and prefixes == sorted(prefixes)


def test_matches_are_longest(spark):
    words = [f"q{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[5:40]) + " z " + " ".join(words[2:14]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    (row,) = decontamination.contamination(docs, bench).collect()
    assert [tuple(m) for m in row["matches"]] == [("7", 5, 2, 35), ("7", 2, 38, 12)]


def test_longest_matches_choose_among_items(spark):
    """The first half of a passage is in one item, the whole of it in another: one match, of the whole."""
    words = [f"q{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words) + " y")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words[:30])), (8, "a b " + " ".join(words))], "item_id long, text string")
    (row,) = decontamination.contamination(docs, bench).collect()
    assert [tuple(m) for m in row["matches"]] == [("8", 2, 1, 60)] and row["items"] == ["7", "8"] and row["n_hit"] == 60


def test_items_and_texts_of_one_word_repeated():
    """Neither pairs of places nor memory grow with the product of their lengths."""
    items = decontamination.item_windows([1, 2], ["boo " * 20_000, " ".join(f"w{i}" for i in range(30))])
    (words,) = decontamination.hashed(decontamination.pa.array(["boo " * 200_000]), decontamination.ALNUM)
    tracemalloc.start()
    shard = decontamination.Shard([words.hashes])
    shard.look_up(items)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert shard.hit().tolist() == [200_000] and shard.items == {(0, "1")}
    assert sum(m[-1] - 9 for m in shard.matches) == 200_000 - 9 and max(m[-1] for m in shard.matches) == 20_000


def test_marks_lose_no_id(spark):
    ids = spark.createDataFrame([(i * 7919,) for i in range(500)] + [(-5,), (None,)], "doc_id long")
    rows = spark.createDataFrame([(i,) for i in range(-10, 40_000)] + [(i * 7919,) for i in range(500)] + [(None,)], "doc_id long")
    got = [(r["doc_id"], r["_maybe"]) for r in with_marks(rows, "doc_id", ids).collect()]
    inside = {r["doc_id"] for r in ids.collect()}
    assert len(got) == 40_010 + 501 and all(m for i, m in got if i in inside)
    assert sum(m for i, m in got if i not in inside) < 60


def test_deduplicated_rows(spark, sf):
    docs = read_table(spark, sf, "documents")
    want = near_reference([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = near_dup.deduplicated_rows(docs)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in want.elements() if r[3])
