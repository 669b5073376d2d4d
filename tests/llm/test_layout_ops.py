"""Sharding, mixing, archives, quality: against plain Python."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, frame
from tributary.llm import mixing, quality, sharding, warc
from tributary.llm.common import read_table
from tributary.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def check_sharding(docs, got):
    text = Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == text
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, sf):
    docs = read_table(spark, sf, "documents")
    got = rows_of(QUERIES["op4_sharding"](spark, sf))
    check_sharding([(r["doc_id"], r["text"]) for r in docs.collect()], got)
    again = rows_of(QUERIES["op4_sharding"](spark, sf))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_sharding_awkward(spark):
    check_sharding(awkward(), rows_of(sharding.shard_documents(frame(spark))))
    assert sharding.shard_documents(frame(spark, [])).count() == 0
    out = sharding.shard_rows(frame(spark).withColumn("shard", F.lit("x")))
    assert out.columns[-2:] == ["shard_", "slot"] and out.count() == len(awkward())


def test_ring_moves_little_and_honours_capacity():
    slots, n = sharding.RING_SLOTS, 200_000
    counts = Counter(zlib.crc32(str(i).encode()) % slots for i in range(n))
    where = []
    for shards in (16, 17):
        room = sharding.capacities(n, shards, 0.0)
        spans = sharding.assign(counts, sharding.ring(shards, 64, 7), room, slots)
        got = Counter()
        place = {}
        for s in spans:
            got[s.shard] += s.hi - s.lo
            for k in range(s.lo, s.hi):
                place[s.place, k] = s.shard
        assert [got[s] for s in range(shards)] == room
        where.append(place)
    moved = sum(where[0][k] != where[1][k] for k in where[0]) / n
    assert moved < 0.3, moved


def reference_targets(sizes, weights, epochs):
    left, out = dict(enumerate(weights)), {}
    while left:
        rest = sum(sizes) - sum(out.values())
        over = [k for k, w in left.items() if rest * w / sum(left.values()) > epochs * sizes[k]]
        for k in over or list(left):
            out[k] = epochs * sizes[k] if over else rest * weights[k] / sum(left.values())
        left = {} if not over else {k: w for k, w in left.items() if k not in over}
    return [out[k] for k in range(len(sizes))]


def check_mixing(docs, got, block=256):
    size = lambda t: len(WORD.findall(t or ""))
    per = defaultdict(int)
    for d in docs:
        per[d[2]] += size(d[1])
    order = sorted(per, key=lambda s: (s is None, s or ""))
    aims = dict(zip(order, reference_targets([per[s] for s in order], [1 + k % 3 for k in range(len(order))], 3), strict=True))
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in got) == Counter((d[0], d[2], size(d[1]), per[d[2]]) for d in docs)
    taken = defaultdict(int)
    for r in got:
        assert math.isclose(r["target"], aims[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - aims[s]) <= 2 * block + 0.02 * aims[s], (s, taken[s], aims[s])


def test_mixing(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in read_table(spark, sf, "documents").collect()]
    got = rows_of(mixing.mix_documents(read_table(spark, sf, "documents")))
    check_mixing(docs, got)
    few = rows_of(mixing.mix_documents(read_table(spark, sf, "documents"), shard_rows=5, block_words=16))
    check_mixing(docs, few)
    again = rows_of(mixing.mix_documents(read_table(spark, sf, "documents").repartition(3)))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_of_many_sources(spark, sf, monkeypatch):
    """The executors' plan is the driver's, also where the excess of small sources is shared again."""
    docs = [(i, "w " * (1 + (i * 7919) % 900), f"s{(i * i) % 37:02d}" if i % 50 else None) for i in range(900)] + [(1000 + i, "w w w", f"t{i}") for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for df, rows in ((table, docs), (read_table(spark, sf, "documents"), None)):
        monkeypatch.setattr(mixing, "MAX_SOURCES", 100_000)
        want = {r["doc_id"]: r for r in rows_of(mixing.mix_documents(df, block_words=64, shard_rows=20))}
        monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
        got = rows_of(mixing.mix_documents(df, block_words=64, shard_rows=20))
        assert len(got) == len(want) and all(r["taken"] == want[r["doc_id"]]["taken"] and math.isclose(r["target"], want[r["doc_id"]]["target"], rel_tol=1e-9) for r in got)
        if rows:
            check_mixing(rows, got, block=64)


def test_mixing_awkward(spark):
    got = rows_of(mixing.mix_documents(frame(spark)))
    check_mixing([(r[0], r[1], r[3]) for r in awkward()], got)
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    out = mixing.mix_rows(frame(spark))
    assert out.columns == frame(spark).columns
    assert mixing.mix_rows(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seats", [0, 1, 7, 50, 333])
def test_apportionment_is_highest_quotients(seats):
    votes, most = [7.0, 3.5, 0.0, 21.0, 1.25], [400, 30, 400, 60, 400]
    out = [0] * 5
    for _ in range(seats):
        open_ = [i for i in range(5) if out[i] < most[i] and votes[i]]
        i = max(open_, key=lambda k: (votes[k] / (2 * out[k] + 1), -k))
        out[i] += 1
    assert mixing.apportion(seats, votes, most) == out


def check_archive(pages, got):
    first = {}
    for p, h in pages:
        b = (h or "").encode()
        if p is not None:
            first[b] = min(first.get(b, p), p)
    want = Counter()
    for p, h in pages:
        b = (h or "").encode()
        revisit = p is not None and p != first[b]
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[b] if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


def test_archives(spark, sf):
    pages = [(r["page_id"], r["html"]) for r in read_table(spark, sf, "pages").collect()]
    check_archive(pages, rows_of(QUERIES["op8_warc"](spark, sf)))


def test_archives_awkward(spark):
    rows = [(1, "u", "x"), (2, None, "x"), (3, "u\r\nbad: header", None), (4, "u", ""), (None, "u", "x"), (1, "u", "x"),
            (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 3), (6, "u", "y" * (17 << 20)), (-7, None, "\x1f\x8b\x08")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, HTML string")
    check_archive([(r[0], r[2]) for r in rows], rows_of(warc.archive_round_trip(pages)))
    assert warc.archive_round_trip(spark.createDataFrame([], pages.schema)).count() == 0


def test_salvage():
    parts = [warc.member(i, f"u{i}", f"payload {i} " * 50, i, "2024-01-01T00:00:00Z") for i in range(6)]
    good = list(warc.salvage(b"".join(parts)))
    assert [r["page_id"] for r in good] == list(range(6)) and all(r["kind"] == "record" for r in good)
    broken = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    broken[at] ^= 0xFF
    broken[len(broken) - 3 :] = b""
    got = list(warc.salvage(bytes(broken)))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2, 3, 4]
    gaps = [(r["start"], r["bytes"]) for r in got if r["kind"] == "gap"]
    assert gaps == [(len(parts[0]), len(parts[1])), (sum(map(len, parts[:5])), len(parts[5]) - 3)]
    assert sum(r["bytes"] for r in got) == len(broken)
    plain = [zlib.decompress(p, 31) for p in parts]
    text = plain[0] + b"noise" + plain[1] + plain[2].replace(b"payload 2 p", b"payload X p") + plain[3]
    got = list(warc.salvage(text))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 1, 3]
    assert sum(r["bytes"] for r in got if r["kind"] == "gap") == 5 + len(plain[2])
    assert list(warc.salvage(b"")) == []


def base_counts(text):
    t = text or ""
    words = WORD.findall(t)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def check_quality(docs, got):
    want, have = Counter(), Counter()
    for d in docs:
        n = base_counts(d[1])
        want[(d[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    for r in got:
        have[(r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r["base_failed"])] += 1
        assert not (r["base_failed"] and r["kept"])
    assert have == want


def test_quality(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, sf, "documents").collect()]
    got = rows_of(QUERIES["op6_quality"](spark, sf))
    check_quality(docs, got)
    passed = [r for r in got if not r["base_failed"]]
    assert sum(r["kept"] for r in passed) > 0.9 * len(passed)


def test_quality_awkward(spark):
    check_quality(awkward(), rows_of(quality.quality_verdicts(frame(spark))))
    assert quality.quality_verdicts(frame(spark, [])).count() == 0
    out = quality.quality_rows(frame(spark))
    assert out.columns == frame(spark).columns


def test_sketches_merge(spark, sf):
    from tributary.llm.common import pick

    docs = pick(read_table(spark, sf, "documents"), doc_id="long", text="string", lang="string", source="string")
    measured = quality._measured(docs).cache()
    whole = {tuple(r) for r in quality.merged(quality.sketches(measured)).collect()}
    halves = quality.sketches(measured.where("doc_id % 2 = 0")).unionByName(quality.sketches(measured.where("doc_id % 2 = 1")))
    assert {tuple(r) for r in quality.merged(halves).collect()} == whole


@pytest.mark.parametrize("share", [8, 12, 30, 50])
def test_fences_of_a_source_with_much_junk(spark, share):
    text = lambda i: " ".join(f"word{(i * 37 + k * k) % 997}" for k in range(60 + i % 20))
    junk = lambda i: " ".join(w + "#" if k % 2 else w for k, w in enumerate(text(i).split()))
    rows = [(i, junk(i) if i % 100 < share else text(i), "en", "hot") for i in range(400)]
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"] for r in rows_of(got) if not r["base_failed"] and not r["kept"]} == {i for i in range(400) if i % 100 < share}
    assert sum(r["kept"] for r in rows_of(got)) == 400 - 4 * share


def test_every_metric_can_reject_and_fences_follow_the_data(spark):
    vary = lambda i: " ".join(f"w{'x' * ((i + k) % 5)}{(i * 37 + k * k) % 997}" for k in range(60 + i % 20))
    rows = [(i, vary(i), "en", f"s{i % 4}") for i in range(400)]
    line = lambda i: f"u{i} vwx{i} yz{i} abc{i}"
    rows += [
        (1001, vary(1001) + " #$%" * 20, "en", "s1"),
        (1002, "\n".join([line(i) for i in range(60)] + [f"same{k} {k}" for k in range(9)] * 2), "en", "s1"),
        (1003, vary(1003) + " " + " ".join(f"q{i}" for i in range(12)) + " middle " + " ".join(f"q{i}" for i in range(12)), "en", "s1"),
        (1004, " ".join("y" * 30 + str(i) for i in range(60)), "en", "s1"),
        (1005, " ".join("z" * (i % 2 + 1) for i in range(1)) + " " + " ".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(60)), "en", "s1"),
    ]
    base = quality.pick(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), doc_id="long", text="string", lang="string", source="string")
    measured = quality._measured(base).cache()
    fences = {r["source"]: r for r in quality.thresholds(measured).collect()}
    judged = measured.join(quality.thresholds(measured), ["lang", "source"]).where("not base_failed")
    out = {m: {r["doc_id"] for r in judged.where(quality._beyond(m)).collect()} for m in quality.METRICS}
    assert out["symbols"] == {1001} and 1002 in out["dup_lines"] and 1003 in out["repeats"] and {1004, 1005} <= out["word_length"]
    wide = spark.createDataFrame([(i, vary(i) + " " + "long" * (i % 40), "en", f"s{i % 4}") for i in range(400)], "doc_id long, text string, lang string, source string")
    other = {r["source"]: r for r in quality.thresholds(quality._measured(quality.pick(wide, doc_id="long", text="string", lang="string", source="string"))).collect()}
    assert all(other[s]["max_word_length"] > fences[s]["max_word_length"] + 1 for s in fences)


def test_whole_copies_keep_to_the_targets(spark):
    # sizes from 1 to 3,000 words; wanted shares of the sources' words: 0.08, 0.2, 0.7, 1.25
    size = lambda i: 1 + (i * 7919) % 3000
    rows = [(1000 * s + i, "w " * size(i), f"s{s}") for s in range(4) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    aims = [0.08, 0.2, 0.7, 1.25]
    weight = lambda k: aims[k] if k < 4 else 0.0
    total = sum(size(i) for i in range(600))
    scale = 4 / sum(aims)
    out = mixing.mix_rows(docs, weight=weight).select("source", F.length(F.col("text")) / 2).collect()
    given, long = defaultdict(int), defaultdict(int)
    for s, n in out:
        given[int(s[1])] += n
        long[int(s[1])] += n * (n > 1500)
    all_long = sum(size(i) for i in range(600) if size(i) > 1500)
    for s, aim in enumerate(aims):
        assert abs(given[s] / total - aim * scale) < 0.01, (s, given[s] / total, aim * scale)
        assert abs(long[s] / all_long - aim * scale) < 0.08, (s, long[s] / all_long, aim * scale)


def test_salvage_inside_members():
    texts = [zlib.decompress(warc.member(i, f"u{i}", f"payload {i} " * 50, i, "2024-01-01T00:00:00Z"), 31) for i in range(5)]
    spoilt = [t.replace(b"payload %d p" % i, b"payload X p", 1) for i, t in enumerate(texts)]
    for bad in range(5):
        content = warc.gzip_member(b"".join(spoilt[i] if i == bad else t for i, t in enumerate(texts))) + warc.gzip_member(texts[0])
        got = list(warc.salvage(content))
        assert [r["page_id"] for r in got if r["kind"] == "record"] == [i for i in range(5) if i != bad] + [0]
        lo = sum(map(len, texts[:bad]))
        assert [r["reason"] for r in got if r["kind"] == "gap"] == [f"digest doesn't hold: bytes {lo} to {lo + len(texts[bad])} of the inflated member"]
        assert sum(r["bytes"] for r in got) == len(content)


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_of_damaged_members(level):
    texts = [zlib.decompress(warc.member(i, f"u{i}", " ".join(hashlib.sha1(b"%d %d" % (i, k)).hexdigest() for k in range(3000)), i, "2024-01-01T00:00:00Z"), 31) for i in range(5)]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = packer.compress(b"".join(texts)) + packer.flush()
    after = warc.gzip_member(texts[0])
    for content in (
        whole[: len(whole) * 7 // 10] + after,  # cut in the fourth record
        whole[: len(whole) * 7 // 10],
        whole[:-8] + bytes(4) + whole[-4:] + after,  # the checksum is wrong
        whole[: len(whole) * 7 // 10] + texts[4] + after,
    ):
        got = list(warc.salvage(content))
        pages = [r["page_id"] for r in got if r["kind"] == "record"]
        assert pages[:3] == [0, 1, 2] and pages.count(1) == pages.count(2) == 1
        assert pages.count(0) == 1 + content.endswith(after) and (texts[4] not in content[len(content) // 2 :] or 4 in pages)
        assert sum(r["bytes"] for r in got) == len(content)


def test_records_without_digest():
    text = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    for content in (text * 2, warc.gzip_member(text * 2)):
        assert [(r["kind"], r["payload"], r["payload_digest"]) for r in warc.salvage(content)] == [("record", b"body", None)] * 2
    sha256 = text.replace(b"Content-Length", b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"body").hexdigest().encode() + b"\r\nContent-Length")
    assert [r["kind"] for r in warc.salvage(sha256 + sha256.replace(b"body\r", b"bodx\r"))] == ["record", "gap"]
