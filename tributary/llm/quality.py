"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gets a few counts (all in one pass, with native expressions). Every metric of every language and source is
summarised by a sketch: counts of logarithmic buckets, in which a quantile is found with a relative error of at most
``ACCURACY``. Sketches merge by adding counts, so partial aggregation combines them before the shuffle, a language's
sketch is the sum of its sources', and the result doesn't depend on the order of rows. A source with fewer than
``MIN_GROUP`` documents that pass the base rules uses its language's sketch, a language with fewer the sketch of all.

The fences come from the sketches alone: ``median + SPREAD * (high - median)`` and the same downwards, where high and
low are the quantiles that ``METRICS`` names. Where more junk than that is in a group, its high quantile is junk itself.
So the groups vote: no spread counts for more than ``SKEW`` times the median spread of all groups of a language and source
with ``MIN_VOTE`` documents. With fewer than three such groups a group's own spread counts up to ``SKEW`` times the one to the
other side, which junk on one side can't widen while it is at most half of the group; a merged sketch's counts in full.

Three metrics are rates of counts, and most texts have none of what they count, so that a fence may well be 0. A document
is judged by its count: it fails above what the fence's rate leads to expect, by more than ``ERRORS`` standard errors of such
a count (of a Poisson variable, plus one). The mean word length is compared with its fences but for the sketch's own error.

Defined results: null texts count as empty and fail the base rules; a null language or source is a group of its own;
repeated rows each get a row; an empty table gives no rows; further columns are ignored or returned untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import ROW, let, materialize, pick, unpack_row, with_row

ACCURACY = 0.01
MIN_GROUP, MIN_VOTE = 100, 20
SPREAD, SKEW, ERRORS = 8.0, 3.0, 5.0
#: A thresholds table of more rows than this isn't broadcast.
BROADCAST_ROWS = 100_000
#: name: numerator and denominator (in thousandths), and the quantiles that tell the spread.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 0.1, 0.9),
    "dup_lines": ("n_dup_lines", "n_lines", 0.1, 0.9),
    "repeats": ("n_repeat_words", "n_words", 0.1, 0.9),
    "word_length": ("word_chars", "n_words", 0.25, 0.75),
}
#: The metrics that are rates of counts.
RATES = ("symbols", "dup_lines", "repeats")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _shift(a: Column, by: int) -> Column:
    """The array without its first ``by`` elements; empty where it has no more."""
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Of texts in which a window's hash repeats, the hashes are
    sorted with their places, so equal ones are neighbours; then the places are sorted and each covers up to three words."""

    def repeated(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast(_PAIR)), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
        after = F.concat(_shift(s, 1), F.array(F.lit(None).cast(_PAIR)))
        marked = F.zip_with(
            F.zip_with(s, before, lambda x, y: F.when(x["h"].eqNullSafe(y["h"]), -1 - x["p"]).otherwise(x["p"])),
            F.zip_with(s, after, lambda x, y: x["h"].eqNullSafe(y["h"])),
            lambda p, same: F.when(p < 0, -1 - p).when(same, p),
        )
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, _shift(at, 1), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    # one lambda for each word: three are an interpreted call each
    triples = F.slice(F.arrays_zip(words, _shift(words, 1), _shift(words, 2)), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(triples, lambda t: F.xxhash64(t))

    def counted(hs: Column) -> Column:
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(let(let(placed, repeated), covered))

    return F.coalesce(let(hashes, counted), F.lit(0)).cast("long")


_PAIR = "struct<h:bigint,p:int>"


def _measured(df: DataFrame) -> DataFrame:
    """``df`` (text and others) plus the base counts, n_lines and base_failed."""
    text = F.coalesce("text", F.lit(""))
    spaced = F.regexp_replace(text, "[\\t\\n\\x0B\\f\\r]", " ")
    words = let(
        F.array_remove(F.split(spaced, " "), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("c"), _repeat_words(w).alias("r")),
    )
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != ""),
        lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")),
    )
    kept = [c for c in df.columns if c != "text"]
    out = df.select(
        *kept,
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        words.alias("w"),
        lines.alias("l"),
    )
    return out.select(
        *kept, F.col("w.n").alias("n_words"), F.col("w.c").alias("word_chars"), "n_symbols", F.col("l.n").alias("n_lines"),
        (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _metric(name: str) -> Column:
    top, bottom = METRICS[name][:2]
    return F.floor(F.col(top) * 1000 / F.greatest(F.col(bottom), F.lit(1))).cast("long")


_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: bucket 0 holds the value 0, bucket b > 0 the values up to gamma^(b-1)."""
    values = measured.where("not base_failed").select("lang", "source", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), _metric(m).alias("value")) for m in METRICS])))
    bucket = F.when(F.col("value") <= 0, 0).otherwise(F.ceil(F.round(F.ln("value") / math.log(_GAMMA), 6)).cast("int") + 1)
    return values.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def _quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """For each sketch its count, its median and its low and high quantiles. A sketch's buckets are a few hundred at most."""
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    named = lambda k: F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v[k])])[F.col("metric")]

    def at(q: Column) -> Column:
        need = F.ceil(F.col("total") * q)
        run = F.aggregate(
            "b",
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("at")),
            lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), F.when((a["at"] < 0) & (a["sum"] + x["n"] >= need), x["bucket"]).otherwise(a["at"]).alias("at")),
        )["at"]
        return F.when(run <= 0, F.lit(0.0)).otherwise(F.round(2 * F.pow(F.lit(_GAMMA), run - 1) / (1 + _GAMMA), 3))

    lists = sketch.groupBy(*keys, "metric").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    lists = lists.withColumn("total", total).select(*keys, "metric", "total", at(named(2)).alias("low"), at(F.lit(0.5)).alias("mid"), at(named(3)).alias("high"))
    return lists.withColumns({"up": F.round(F.col("high") - F.col("mid"), 3), "down": F.round(F.col("mid") - F.col("low"), 3)}).drop("low", "high")


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and, for each metric, ``max_`` and ``min_``."""
    own = materialize(sketches(measured), "quality-sketches")
    by_lang = merged(own, "lang")
    null = F.lit(None).cast("string")
    a = _quantiles(own, "lang", "source")
    b = _quantiles(by_lang, "lang").withColumn("source", null)
    c = _quantiles(merged(by_lang)).withColumns({"lang": null, "source": null})
    vote = lambda x: F.expr(f"percentile_disc(0.5) within group (order by {x})")
    votes = a.where(F.col("total") >= MIN_VOTE).groupBy("metric").agg(F.count("*").alias("voters"), vote("up").alias("up"), vote("down").alias("down"))
    big = lambda t: F.col(f"{t}.total") >= MIN_GROUP
    joined = (
        a.alias("a").join(b.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.metric") == F.col("b.metric")))
        .join(c.alias("c"), F.col("a.metric") == F.col("c.metric")).join(votes.alias("v"), F.col("a.metric") == F.col("v.metric"), "left")
    )
    chosen = lambda n: F.when(big("a"), F.col(f"a.{n}")).when(big("b"), F.col(f"b.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    q = joined.select("a.lang", "a.source", "a.metric", chosen("mid"), chosen("up"), chosen("down"), big("a").alias("own"), "v.voters", F.col("v.up").alias("all_up"), F.col("v.down").alias("all_down"))
    elected = F.coalesce(F.col("voters") >= 3, F.lit(False))
    # without a bound the least of null and the spread is the spread
    bound = lambda side, other, voted: F.least(F.col(side), SKEW * F.when(elected, F.col(voted)).when(F.col("own"), F.col(other)))
    q = q.select(
        "lang", "source", "metric",
        (F.col("mid") + SPREAD * bound("up", "down", "all_up")).alias("max"),
        (F.col("mid") - SPREAD * bound("down", "up", "all_down")).alias("min"),
    )
    return q.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{e}_{m}") for m in METRICS for e in ("max", "min")]
    )


def _beyond(name: str) -> Column:
    """Whether a document is outside its fences for a metric."""
    top, bottom = METRICS[name][:2]
    most, least = F.col(f"max_{name}"), F.col(f"min_{name}")
    if name not in RATES:
        return (_metric(name) > most * (1 + 2 * ACCURACY)) | (_metric(name) < least * (1 - 2 * ACCURACY))
    expected = lambda rate: F.greatest(rate, F.lit(0.0)) * F.col(bottom) / 1000
    error = lambda rate: ERRORS * F.sqrt(expected(rate) + 1)
    return (F.col(top) > expected(most) + error(most)) | (F.col(top) < expected(least) - error(least))


def _judged(measured: DataFrame) -> DataFrame:
    fences = materialize(thresholds(measured), "quality-thresholds")
    if fences.count() <= BROADCAST_ROWS:
        fences = F.broadcast(fences)
    on = measured["lang"].eqNullSafe(fences["lang"]) & measured["source"].eqNullSafe(fences["source"])
    bad = F.lit(False)
    for m in METRICS:
        bad = bad | F.coalesce(_beyond(m), F.lit(False))
    joined = measured.join(fences, on, "left")
    return joined.select(*[measured[c] for c in measured.columns], (~F.col("base_failed") & ~bad).alias("kept"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row."""
    base = pick(docs, doc_id="long", text="string", lang="string", source="string")
    measured = materialize(_measured(base), "quality-counts")
    return _judged(measured).select("doc_id", *_COUNTS, "base_failed", "kept")


def quality_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    rows = with_row(docs, text="string", lang="string", source="string")
    measured = materialize(_measured(rows), "quality-rows")
    return unpack_row(_judged(measured).where("kept"), docs.columns)
