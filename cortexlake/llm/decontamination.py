"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask looks at some of the words from a place on and ignores those between them. An item's seeds are the hashes of what its masks see
at each of its places; which masks it has follows from its length, and they are such that no overlap that the rule accepts is without a
seed (tests go through all of them). Seeds of documents and of benchmark items with equal hashes are hits; around
each hit the item is laid over the document and its words are compared, whatever the masks ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortexlake.llm.scratch import numbered

# The word positions each mask looks at, and the masks of items by their size (the largest entry: that and all longer ones).
MASKS = ((0,), (0, 1), (0, 2), (0, 1, 3), (0, 2, 3), (0, 1, 2, 4), (0, 1, 4, 6), (0, 1, 2, 3, 5), (0, 1, 4, 5, 7))
MASKS_OF = {1: (0,), 2: (1,), 3: (2,), 4: (3,), 5: (3, 4), 10: (5, 6), 15: (7, 8)}
#: Least words of items and documents.
SPAN = 1
#: An overlap counts if some run of this many words (or the whole of a shorter item) agrees in PERCENT of its places.
RUN, PERCENT = 20, 80
#: Benchmark tables with more words than this are joined by shuffling seeds instead of broadcasting them.
BROADCAST_WORDS = 1_000_000

SPACES = " \t\n\x0b\f\r"
_WORD = r"[^\x20\x09-\x0D]"


def _word_hashes(text: str) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACES))
    return F.transform(F.split(trimmed, f"[{SPACES}]+"), lambda w: F.xxhash64(w))


def seed_masks(size: int) -> tuple[int, ...]:
    """Which masks serve items of ``size`` words."""
    return MASKS_OF[max(n for n in MASKS_OF if n <= size)]


def _seeds(table: DataFrame, words: str, masks: Column, *keep: str) -> DataFrame:
    """A row for each place and each of the row's ``masks`` that fits there: ``keep``, ``at`` and ``key``."""
    placed = table.select(*dict.fromkeys([*keep, words]), masks.alias("masks"), F.explode(F.sequence(F.lit(0), F.size(words) - 1)).alias("at"))
    word = lambda p: F.get(F.col(words), F.col("at") + p)
    fits = lambda m: F.array_contains("masks", m) & (F.col("at") + MASKS[m][-1] < F.size(words))
    keys = F.array(*(F.when(fits(m), F.xxhash64(F.lit(m), *map(word, mask))) for m, mask in enumerate(MASKS)))
    return placed.select(*keep, "at", F.explode(keys).alias("key")).filter("key is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document id and item found in it: ``doc_id, item_id, start, n_words, n_equal``.

    ``start`` is the document's word where the item's overlap begins, ``n_words`` how many of the item's words lie over
    the document there, ``n_equal`` how many agree. Where an item overlaps in several places, the one with most agreeing
    words counts, then the first. Words are lower-cased. Null and empty texts have no words and never match; rows with the same id are looked at one by one and reported once; items with
    the same id likewise; extra columns are ignored; empty tables give an empty result.
    """
    items = benchmark.filter(F.col("text").rlike(_WORD)).select("item_id", _word_hashes("text").alias("item_words"))
    by_run = items.groupBy(F.least(F.size("item_words"), F.lit(RUN)).alias("run")).agg(F.sum(F.size("item_words")).alias("n")).collect()
    n_words, masks = sum(r.n for r in by_run), sorted({m for r in by_run for m in seed_masks(r.run)})
    mask = F.element_at(F.array(*(F.array(*map(F.lit, seed_masks(n))) for n in range(1, RUN + 1))), F.least(F.size("item_words"), F.lit(RUN)))
    own = _seeds(items.withColumns({"item_size": F.size("item_words"), "item_key": F.xxhash64("item_words")}), "item_words", mask, "item_id", "item_size", "item_key").withColumnRenamed("at", "item_at")
    small = n_words <= BROADCAST_WORDS
    own = F.broadcast(own) if small else own
    worded = docs.filter(F.col("text").rlike(_WORD)).select(F.col("doc_id").cast("long").alias("doc_id"), _word_hashes("text").alias("words")).withColumn("text_key", F.xxhash64("words"))
    # Where the seeds are shuffled, they go without the words, which hits fetch again by id and text.
    of_docs = _seeds(worded, "words", F.array(*map(F.lit, masks)).cast("array<int>"), "doc_id", *(["words"] if small else ["text_key"]))
    hits = of_docs.join(own, "key").withColumn("offset", F.col("at") - F.col("item_at"))
    if not small:
        hits = hits.select("doc_id", "text_key", "item_id", "item_key", "item_size", "offset").distinct()
        once = worded.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("o_id"), F.col("text_key").alias("o_key"), "words")
        hits = hits.join(once, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_key") == F.col("o_key")))
    first = F.greatest("offset", F.lit(0))
    over = F.slice("words", first + 1, F.col("item_size") - F.greatest(-F.col("offset"), F.lit(0)))
    hits = hits.select("doc_id", "item_id", "item_key", "offset", over.alias("over"))
    whole = items.select(F.col("item_id").alias("w_id"), "item_words", F.xxhash64("item_words").alias("w_key")).distinct()
    whole = F.broadcast(whole) if small else whole
    laid = hits.join(whole, F.col("item_id").eqNullSafe(F.col("w_id")) & (F.col("item_key") == F.col("w_key")))
    skipped = F.greatest(-F.col("offset"), F.lit(0))
    equal = F.zip_with("over", F.slice("item_words", skipped + 1, F.size("over")), lambda a, b: F.when(a == b, 1).otherwise(0))
    counted = laid.select("doc_id", "item_id", F.greatest("offset", F.lit(0)).alias("start"), equal.alias("equal"), F.least(F.lit(RUN), F.size("item_words")).alias("run"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    runs = F.sequence(F.lit(1), F.size("equal") - F.col("run") + 1)
    enough = counted.filter(F.size("equal") >= F.col("run")).filter(total(F.col("equal")) * 100 >= F.col("run") * PERCENT)
    good = enough.filter(F.exists(runs, lambda i: total(F.slice("equal", i, F.col("run"))) * 100 >= F.col("run") * PERCENT))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(total(F.col("equal")).alias("n_equal"), (-F.col("start")).alias("back"), F.size("equal").alias("n_words"))).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).alias("start"), "x.n_words", "x.n_equal")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item was found; rows with the same id or none are judged one by one."""
    rows = numbered(docs)
    found = contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(found, "_row", "left_anti").select(*docs.columns)
