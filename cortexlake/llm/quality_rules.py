"""Quality rules with thresholds that follow the data.

Each document gets counts (word characters, symbols, repeated lines, words in repeated three-word windows). Its shares of
them go into mergeable quantile sketches per (language, source): histograms with buckets of a bounded relative width, so merging two
sketches is adding counts and Spark's partial aggregation builds them without moving a document. A group's fences are far
quantiles of its sketch: TAIL thousandths of the documents lie beyond each. The fewer documents a group has, the more its
fences lean on those of its language, and these on those of everything. A document beyond a fence of its group is rejected.

A quantile is a bucket's lower end, and a share is held against fences as its bucket's lower end, too. So a share is taken for up to
1/32 less than it is, and shares that one bucket holds are never told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cortexlake.llm.bytetext import Chunk, chunks, distinct_in_text, mix, span_hash
from cortexlake.llm.scratch import written

SYMBOLS = b"#*$%&|<>"
#: Share -> if there is a fence below it and one above it.
SHARES = {"symbol_share": (False, True), "dup_line_share": (False, True), "repeat_share": (False, True), "word_length": (True, True)}
SIDES = [(k, side) for k, both in SHARES.items() for side, there in zip(("least", "most"), both) if there]
#: Thousandths of a group's documents beyond each fence.
TAIL = 10
#: A group of this many documents leans on the wider group's fences as much as on its own.
LEAN = 200
#: Sketch buckets are exact below 2**SKETCH_BITS and of relative width 2**(1-SKETCH_BITS) above.
SKETCH_BITS = 6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _counts(c: Chunk) -> list[np.ndarray]:
    n = len(c)
    w = c.words()
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    letters = c.per_text(((c.data & 0xC0) != 0x80) & ~gap[c.data])
    symbols = c.per_text(is_symbol[c.data])

    breaks = np.flatnonzero(c.data == 10)
    begin = np.concatenate([c.offsets[:-1], breaks + 1])
    end_at = np.concatenate([breaks, c.offsets[1:]])
    begin.sort()
    end_at.sort()
    has_word = np.searchsorted(w.starts, end_at) > np.searchsorted(w.starts, begin)
    begin, end_at = begin[has_word], end_at[has_word]
    line_doc = np.searchsorted(c.offsets, begin, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    once, _ = distinct_in_text(line_doc, span_hash(c.data, begin, end_at))
    dup_lines = lines - np.bincount(once, minlength=n)

    h = w.hashes()
    at = np.flatnonzero(np.arange(len(h)) + 3 <= w.first[1:][w.doc]) if len(h) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = mix((h[at] * np.uint64(3) + h[at + 1]) * np.uint64(5) + h[at + 2] + mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[again] + k] = True
    return [np.diff(w.first), letters, symbols, dup_lines, np.bincount(w.doc[covered], minlength=n), lines]


def _with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and the counts as ``_q_...``; ``text`` itself goes back to the JVM only if it is kept."""
    fields = [docs.schema[x] for x in keep]
    schema = T.StructType([*fields, *(T.StructField(f"_q_{x}", T.LongType()) for x in COUNTS)])
    names = [f"_q_{x}" for x in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_counts(c) for c in chunks(b.column("text"))]
            cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), *(pa.array(x.astype(np.int64)) for x in cols)], [*keep, *names])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every document's whole text."""
    out = _with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"), ["doc_id", "lang", "source"])
    return out.withColumnsRenamed({f"_q_{x}": x for x in COUNTS})


def shares(counts: DataFrame) -> DataFrame:
    """Adds the shares in thousandths, the mean length of words in hundredths, and ``base_failed``."""
    return (
        counts.withColumn("symbol_share", F.when(F.col("word_chars") > 0, F.expr("n_symbols * 1000 div word_chars")).otherwise(0))
        .withColumn("dup_line_share", F.when(F.col("n_lines") > 0, F.expr("n_dup_lines * 1000 div n_lines")).otherwise(0))
        .withColumn("repeat_share", F.when(F.col("n_words") > 0, F.expr("n_repeat_words * 1000 div n_words")).otherwise(0))
        .withColumn("word_length", F.when(F.col("n_words") > 0, F.expr("word_chars * 100 div n_words")).otherwise(0))
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    )


def _bucket(x: str) -> Column:
    """The sketch bucket's lower end: x with all but its leading SKETCH_BITS bits cleared."""
    drop = f"greatest(length(bin({x})) - {SKETCH_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({x}, {drop}), {drop})")


def quantiles(table: DataFrame) -> DataFrame:
    """Number of documents and far quantiles per (level, lang, source) from the merged sketches; level 0 is (lang, source), 1 lang, 2 all.

    Documents that fail the base rule are in no sketch.
    """
    long = table.filter("not base_failed").select(
        "lang",
        "source",
        F.explode(F.array(*(F.struct(F.lit(k).alias("share"), _bucket(k).alias("bucket")) for k in SHARES))).alias("x"),
    ).select("lang", "source", "x.share", "x.bucket")
    finest = long.groupBy("lang", "source", "share", "bucket").agg(F.count(F.lit(1)).alias("n"))
    levels = (
        finest.withColumn("level", F.explode(F.array(*map(F.lit, range(3)))))
        .withColumn("lang", F.when(F.col("level") < 2, F.col("lang")))
        .withColumn("source", F.when(F.col("level") < 1, F.col("source")))
    )
    sketch = levels.groupBy("level", "lang", "source", "share", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("level", "lang", "source", "share")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group))
    beyond = {"least": TAIL, "most": 1000 - TAIL}
    at = lambda k, side: F.min(F.when((F.col("share") == k) & (F.col("upto") * 1000 >= F.col("total") * beyond[side]), F.col("bucket")))
    return placed.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *(at(k, side).alias(f"{k}_{side}") for k, side in SIDES))


def group_fences(table: DataFrame) -> DataFrame:
    """One row per (lang, source) of ``table``, null values included, with the fences that hold for it.

    A group's fence is its own quantile and the wider group's fence, weighed as its number of documents to LEAN. There are
    as many rows as groups, and the sketches behind them are written once.
    """
    wide = written(quantiles(table), "quality-quantiles")
    packed = F.struct("total", *(f"{k}_{side}" for k, side in SIDES))
    by_lang = wide.filter("level = 1").select(F.col("lang").alias("b_lang"), packed.alias("b"))
    every = wide.filter("level = 2").select(F.col("level").alias("c_level"), packed.alias("c"))

    def leaning(k: str) -> Column:
        fence = F.col(f"c.{k}")
        for level in ("b", "a"):
            fence = (F.col(f"{level}.total") * F.col(f"{level}.{k}") + LEAN * fence) / (F.col(f"{level}.total") + LEAN)
        return fence.alias(f"fence_{k}")

    return (
        wide.filter("level = 0")
        .select("lang", "source", packed.alias("a"), F.lit(2).alias("top"))
        .join(by_lang, F.col("lang").eqNullSafe(F.col("b_lang")))
        .join(every, F.col("top") == F.col("c_level"))
        .select(F.col("lang").alias("_g_lang"), F.col("source").alias("_g_source"), *(leaning(f"{k}_{side}") for k, side in SIDES))
    )


def judge(table: DataFrame, groups: DataFrame) -> DataFrame:
    """``table``, with counts and shares, joined with its groups' fences; adds ``kept``."""
    joined = table.join(groups, F.col("lang").eqNullSafe(F.col("_g_lang")) & F.col("source").eqNullSafe(F.col("_g_source")), "left").drop("_g_lang", "_g_source")
    within = ~F.col("base_failed")
    for k, side in SIDES:
        fence = F.col(f"fence_{k}_{side}")
        within = within & (_bucket(k) >= fence if side == "least" else _bucket(k) <= fence)
    return joined.withColumn("kept", F.coalesce(within, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, shares, fences, ``base_failed`` and ``kept``.

    Needs ``doc_id, text, lang, source``; more columns are ignored. Null or empty text has no words and fails
    the base rule; null language or source is a group of its own, and one in which every document fails has no fences
    (null); rows with the same id are judged one by one; an empty table gives an empty one. The counts are written once to the shared folder, so that texts are
    read a single time.
    """
    table = shares(written(features(docs), "quality-counts"))
    return judge(table, group_fences(table))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quality_rules() keeps, with just their own columns.

    Texts aren't shuffled: a first pass over them gives the fences, a second carries the rows along with their counts.
    """
    groups = written(group_fences(shares(written(features(docs), "quality-counts"))), "quality-fences")
    counted = _with_counts(docs, docs.columns)
    own = F.struct(*docs.columns).alias("_row")
    named = counted.select(own, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *(F.col(f"_q_{x}").alias(x) for x in COUNTS))
    return judge(shares(named), groups).filter("kept").select("_row.*")
