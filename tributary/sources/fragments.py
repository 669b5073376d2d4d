"""A large JSON object taken apart without ever being one row: its top-level keys and the members of their values.

A file is read in blocks, as pieces between commas, so a document on one line is split too. A first pass finds how each block
changes nesting, for a start inside or outside of a string; with the starts known, a second pass cuts the blocks into members.
Members that lie across blocks are put together again. A folder is one document in parts, in the order of their names.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.session import written

_REST = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+("?)', re.S)
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+("?)|[{}\[\],]', re.S)
_SHIFT = 1 << 40  # fragments of a block


def _tokens(text: str, inside: bool) -> tuple[list[tuple[int, str]], bool]:
    """Brackets and commas outside of strings, and whether the text ends inside one."""
    at = 0
    if inside:
        m = _REST.match(text)
        if not m[1]:
            return [], True
        at = m.end()
    out = []
    for m in _TOKEN.finditer(text, at):
        c = text[m.start()]
        if c != '"':
            out.append((m.start(), c))
        elif not m[1]:
            return out, True
    return out, False


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, block), text) in order; no text ends in the middle of an escape."""
    seen = None
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("file", "block", "value")], strict=True)
        for at, group in itertools.groupby(rows, lambda r: r[:2]):
            text = ",".join(r[2] for r in group)
            yield at, text if at[1] == 0 and at != seen else "," + text
            seen = at


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for at, group in itertools.groupby(_texts(batches), lambda x: x[0]):
        state, depth = [False, True], [0, 0]
        for _, text in group:
            for k in (0, 1):
                found, state[k] = _tokens(text, state[k])
                depth[k] += sum((c in "{[") - (c in "}]") for _, c in found)
        yield pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "out_ends": state[0], "out_by": depth[0], "in_ends": state[1], "in_by": depth[1]}])


def _cut(starts: dict[tuple[str, int], tuple[int, bool, int]]):  # noqa: ANN202
    schema = pa.schema([("pos", pa.int64()), ("depth", pa.int32()), ("by", pa.string()), ("text", pa.string()), ("part", pa.bool_()), ("fresh", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, group in itertools.groupby(_texts(batches), lambda x: x[0]):
            ordinal, inside, depth = starts[at]
            seq, now, rows = 0, [], []
            for _, text in group:
                begin = 0
                found, inside = _tokens(text, inside)
                for i, c in found:
                    up = c in "{["
                    if depth < 2 if up else depth <= 2:
                        now.append(text[begin:i])
                        rows.append((ordinal * _SHIFT + seq, depth, c, "".join(now), seq == 0 and ordinal > 0, seq > 0))
                        seq, now, begin = seq + 1, [], i + 1
                    depth += 0 if c == "," else 1 if up else -1
                now.append(text[begin:])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 6, schema.types, strict=True)], schema=schema)
                rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (ordinal * _SHIFT + seq, depth, None, "".join(now), True, seq > 0 or ordinal == 0), strict=True))], schema=schema)

    return run


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(section, text): ``"key": value`` of each member of each top-level value that is an object (blank where it is empty), and
    those of top-level values that are none, with a null section. Fails with ``ValueError`` on what isn't a JSON object."""
    raw = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = raw.mapInArrow(_changes, "file string, block long, out_ends boolean, out_by long, in_ends boolean, in_by long").collect()  # a row a block
    inside, depth, starts = False, 0, {}
    for k, r in enumerate(sorted(found, key=lambda r: (r["file"], r["block"]))):
        starts[r["file"], r["block"]] = (k, inside, depth)
        inside, depth = (r["in_ends"], depth + r["in_by"]) if inside else (r["out_ends"], depth + r["out_by"])
    if not starts or inside or depth:
        raise ValueError("not a JSON object")
    cut = written(raw.mapInArrow(_cut(starts), "pos long, depth int, by string, text string, part boolean, fresh boolean"), "cuts")
    # two a block, so one task orders them
    loose = cut.where("part").withColumn("g", F.sum(F.col("fresh").cast("long")).over(W.orderBy("pos")))
    one = F.array_sort(F.collect_list(F.struct("pos", "text", "depth", "by")))
    joined = loose.groupBy("g").agg(one.alias("p")).select(
        F.col("p")[0]["pos"].alias("pos"), F.element_at("p", -1)["depth"].alias("depth"), F.element_at("p", -1)["by"].alias("by"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")
    )
    every = cut.where("not part").select("pos", "depth", "by", "text").unionByName(joined)
    heads = every.where("depth < 2 and by in ('{', '[')").orderBy("pos").collect()  # a row a top-level key
    try:
        named = [(r["pos"], json.loads("{" + r["text"] + "0}").popitem()[0], r["by"]) for r in heads if r["depth"] == 1]
    except ValueError:
        named = None
    if named is None or [(r["by"], r["text"].strip()) for r in heads if r["depth"] == 0] != [("{", "")]:
        raise ValueError("not a JSON object")
    section, bracket = F.lit(None).cast("string"), F.lit("{")
    for pos, name, by in named:
        section = F.when((F.col("depth") == 2) & (F.col("pos") > pos), name).otherwise(section)
        bracket = F.when((F.col("depth") == 2) & (F.col("pos") > pos), by).otherwise(bracket)
    rest = every.where("not (depth < 2 and coalesce(by, '') in ('{', '['))").withColumns({"section": section, "bracket": bracket})
    wrapped = F.concat(F.col("bracket"), "text", F.when(F.col("bracket") == "{", "}").otherwise("]"))
    closed = F.col("by").isNull() | (F.col("by") == ",") | (F.col("by") == F.when(F.col("bracket") == "{", "}").otherwise("]"))
    good = F.when(F.col("depth") == 0, F.trim(F.regexp_replace("text", r"\s", "")) == "").otherwise(closed & F.try_parse_json(wrapped).isNotNull())
    out = written(rest.select("section", "bracket", "text", good.alias("good")), "fragments")
    if not out.where("not good").isEmpty():
        raise ValueError("not a JSON object")
    return out.where("bracket = '{'").select("section", "text")
