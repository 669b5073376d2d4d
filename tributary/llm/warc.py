"""WARC archives: a writer of one gzip member a record, and a salvage reader.

``write_archives`` sends the serialised members through Spark's own text sink, so files appear only with the job's
commit and a lost executor's work is done again, on any file system that Spark can write. The sink ends each line
with a separator that can't be empty; it is set to the zero byte with which every gzip member of less than 16 MiB
ends (the high byte of its length field), and that byte is left off the member. A larger member is followed by an
empty one, whose length field is zero.

``read_archives`` reads members one after another, and also plain WARC text. Where a member or a record's header,
length or digest doesn't hold, the reader looks for the next place at which a valid member or a version line starts,
goes on there, and reports the bytes in between as a row of kind ``gap``. It does the same inside a member of several
records: a gap between them has the member's start, no bytes of its own, and its place in the inflated text as part of
its reason. Of a member whose checks don't hold, the records before the damage are kept if more text follows them;
they have no bytes of their own either, as the member's bytes are the gap's. A digest is checked where there is one.

Defined results: null html is an empty payload, null url an absent header; rows with a null page_id are responses and
nothing refers to them; repeated rows of the smallest page_id are all responses; an empty table gives no records;
further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import fresh_path, materialize, pick, with_marks

VERSION = b"WARC/1.1\r\n"
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_GZIP = b"\x1f\x8b\x08"
#: A gzip member of this many bytes or more has another last byte than zero.
MEMBER_LIMIT = 1 << 24
_STEP = 1 << 16
#: Records of an archive. An archive is read as a whole, so this bounds a reader's memory.
FILE_RECORDS = 4_096

RECORD_SCHEMA = (
    "archive string, kind string, start long, bytes long, reason string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def _header(text: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", text or "")


def member(page_id: int | None, url: str | None, html: str | None, first: int | None, when: str) -> bytes:
    """A record as one gzip member. ``first``: the page whose response has this payload."""
    payload = (html or "").encode("utf-8")
    revisit = page_id is not None and first is not None and page_id != first
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = b"" if revisit else payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {when}"]
    if page_id is not None:
        lines += [f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        lines += [f"WARC-Target-URI: {_header(url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    record = VERSION + "\r\n".join(lines).encode("utf-8") + body + b"\r\n\r\n"
    return gzip_member(record)


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if len(data) % (1 << 32) < MEMBER_LIMIT else out + gzip_member(b"")


def write_archives(pages: DataFrame, path: str, when: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of all ``pages`` (page_id, url, html) as files below ``path``, of ``FILE_RECORDS`` records each at most."""
    base = pick(pages, page_id="long", url="string", html="string")
    base = base.withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    # written first, so that both sides of the join are dealt anew and Spark can split a hot payload; of payloads that
    # occur once nothing but the digest is shuffled
    firsts = materialize(base.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-firsts")
    marked = with_marks(base, "digest", firsts)
    labelled = marked.where("_maybe").join(firsts.hint("merge"), "digest", "left").select("page_id", "url", "html", "first")
    labelled = labelled.unionByName(marked.where("not _maybe").select("page_id", "url", "html", F.lit(None).cast("long").alias("first")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "html", "first")]
            for at in range(0, batch.num_rows, 256):
                rows = zip(*[c.slice(at, 256).to_pylist() for c in columns], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([member(*r, when)[:-1] for r in rows], pa.binary())], ["value"])

    packed = labelled.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\x00").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, bool]:
    """Contents and end of the gzip member at ``at``, and whether it is whole and its checks hold; if not, what could
    be inflated and where that ended."""
    unpack, out, start = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if at >= len(data):
                return b"".join(out), at, False
            piece = data[at : at + _STEP]
            out.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
    except zlib.error:
        # the failing piece gave nothing: once more to its start, then byte by byte up to the error
        unpack = zlib.decompressobj(31)
        for k in range(start, at, _STEP):
            unpack.decompress(data[k : k + _STEP])
        try:
            while True:
                out.append(unpack.decompress(data[at : at + 1]))
                at += 1
        except zlib.error:
            return b"".join(out), at, False
    return b"".join(out), at, True


def _digest_holds(digest: str, payload: bytes) -> bool:
    """``algorithm:value`` in base 32 or 16, or a bare SHA-1; one by an unknown algorithm can't be checked and holds."""
    algorithm, _, value = digest.rpartition(":")
    if (algorithm := algorithm.lower() or "sha1") not in ("md5", "sha1", "sha256", "sha512"):
        return True
    found = hashlib.new(algorithm, payload)
    return value.rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=") or value.lower() == found.hexdigest()


def _parse(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record that starts at ``at`` and its end, or why there is none."""
    if not (m := _VERSION_LINE.match(data, at)):
        return "no version line"
    if (head_end := data.find(b"\r\n\r\n", m.end() - 2)) < 0:
        return "header without end"
    head = {}
    for line in data[m.end() : head_end].split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if sep:
            head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (length := head.get("content-length", "")).isdecimal():
        return "no content length"
    body, end = head_end + 4, head_end + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return "length doesn't hold"
    payload, kind = data[body:end], head.get("warc-type", "")
    digest = head.get("warc-payload-digest")
    if kind == "response" and digest and not _digest_holds(digest, payload):
        return "digest doesn't hold"
    page, to = (re.fullmatch(r"<urn:page:(-?\d+)>", head.get(n, "")) for n in ("warc-record-id", "warc-refers-to"))
    full = head.get("warc-payload-length", length)
    return {
        "url": head.get("warc-target-uri"), "record_type": kind, "payload_digest": digest and digest.removeprefix("sha1:"),
        "payload_bytes": int(full) if full.isdecimal() else int(length), "page_id": int(page[1]) if page else None,
        "refers_to": int(to[1]) if to else None, "payload": payload,
    }, end + 4


def _resynced(plain: bytes) -> tuple[list[tuple[int, int, dict | str]], str]:
    """(start, end, record or reason of a gap) over the text of a member, without a hole; and the first reason."""
    out, pos, bad, why, first = [], 0, None, "", ""
    while pos < len(plain):
        if isinstance(r := _parse(plain, pos), str):
            if bad is None:
                bad, why = pos, r
                first = first or r
            line = _VERSION_LINE.search(plain, pos + 1)
            pos = line.start() if line else len(plain)
            continue
        if bad is not None:
            out.append((bad, pos, why))
            bad = None
        out.append((pos, r[1], r[0]))
        pos = r[1]
    return out + ([(bad, len(plain), why)] if bad is not None else []), first


def salvage(content: bytes) -> Iterator[dict]:
    """Records and gaps of an archive in the order of their bytes, which they cover without a hole."""
    view, at, bad, why = memoryview(content), 0, None, ""
    # records kept from damaged members, which the raw bytes up to ``until`` may show again if they aren't compressed
    kept: Counter[bytes] = Counter()
    until = 0

    def gap(start: int, end: int) -> dict:
        return {"kind": "gap", "start": start, "bytes": end - start, "reason": why}

    while at < len(content):
        parts, end, problem, whole = [], at, "", True
        if content.startswith(_GZIP, at):
            plain, end, whole = _inflate(view, at)
            parts, problem = _resynced(plain)
            if not whole:
                problem = "member is damaged"
                # nothing vouches for a record that ends with the text, and what follows the last record is the gap's
                while parts and (isinstance(parts[-1][2], str) or parts[-1][1] == len(plain)):
                    parts.pop()
        elif isinstance(r := _parse(content, at), str):
            problem = r
        elif at < until and kept[shown := hashlib.sha1(view[at : r[1]]).digest()]:
            kept[shown] -= 1
            at = r[1]
            continue
        else:
            parts, end = [(at, r[1], r[0])], r[1]
        records = any(not isinstance(p[2], str) for p in parts)
        if records or (end > at and not problem):
            if bad is not None:
                yield gap(bad, at)
                bad = None
            size = end - at if whole else 0
            for lo, hi, record in parts:
                if isinstance(record, str):
                    yield {"kind": "gap", "start": at, "bytes": 0, "reason": f"{record}: bytes {lo} to {hi} of the inflated member"}
                    continue
                yield {"kind": "record", "start": at, "bytes": size, "reason": None if whole else problem, **record}
                size = 0
            if whole:
                at = end
                continue
            kept.update(hashlib.sha1(plain[lo:hi]).digest() for lo, hi, record in parts if not isinstance(record, str))
            until = max(until, end)
        if bad is None:
            bad, why = at, problem
        line = _VERSION_LINE.search(content, at + 1)
        nexts = [content.find(_GZIP, at + 1), line.start() if line else -1]
        at = min((p for p in nexts if p >= 0), default=len(content))
    if bad is not None:
        yield gap(bad, len(content))


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all files below ``path``. ``payloads=False`` leaves the payloads out. A file
    is one row of Spark's ``binaryFile`` source, which refuses files of 2 GiB or more."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in RECORD_SCHEMA.split(", ")])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for row in salvage(content.as_py()):
                    if not payloads:
                        row.pop("payload", None)
                    rows.append({n: row.get(n) for n in names} | {"archive": archive.as_py()})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(unpack, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row a page."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    found = read_archives(pages.sparkSession, path, payloads=False).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
