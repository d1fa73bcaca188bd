"""A hierarchical Pitman-Yor language model of words in context, over a closed vocabulary and one unknown word.

Every word that comes before opens a context restaurant; the parent of all of them is the word restaurant, and its base is uniform over
the vocabulary and the unknown word. Every word has a context and a dish of its own, and all pairs of a context and a dish that the
training texts hold are counted, whatever their number.

Gibbs sweeps draw the number of tables of every dish anew given the others, from its exact conditional for up to EXACT customers;
a restaurant's tables are its parent's customers. Dishes are drawn side by side, given the tables of the sweep before, each from
random numbers of its own hash. After the burn-in the tables of each pair and context and the probabilities of the word restaurant are
averaged; the probabilities that come of the averages sum to 1 in each context.

Spark counts words and pairs, seats all pairs and looks them up. FREQUENT only says which words' numbers the driver holds and
broadcasts: blocks of pairs of these meet blocks of their places in texts by the pair's bucket. The words beyond them and all their
pairs lie in blocks by the word's hash (``rare_blocks``), which pass on in each sweep what pairs of two such words need of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexlake.llm.bytetext import Words, chunks, mix
from cortexlake.llm.pair_blocks import CODE, cut, mixed, packed, packed_steps, parts, unpacked, unpacked_steps
from cortexlake.llm.rare_blocks import Block, Tokens, blob, pair_key, unblob
from cortexlake.llm.scratch import written
from cortexlake.llm.shingle_sets import give_back

SWEEPS, BURN_IN, STRENGTH, SEED = 6, 2, 1.0, 7
#: Customers up to which the number of tables is drawn from its exact conditional, and dishes drawn together.
EXACT, STEP = 256, 4096
#: The most frequent words, broadcast with their counts, and the most frequent pairs, broadcast for scoring: as many at most.
FREQUENT, HOT = (1 << CODE - 1), 1 << 18
#: Training tokens to a bucket of pairs, other words' tokens to a bucket of these; bytes of texts whose pairs are sorted together (a longer
#: text is sorted whole).
PER_BUCKET, PER_RARE, CHUNK = 1 << 21, 1 << 17, 1 << 22
#: Other words' training tokens that are sorted together.
TOGETHER = 1 << 17
#: Steps of a count's binary logarithm by which the least count of the frequent is chosen.
LEVELS = 64


def _held_out(modulus: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0


def word_counts(train: DataFrame) -> DataFrame:
    """``h, c``: the hash of every distinct word and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b.column("text"), 1 << 24):
                h, n = np.unique(c.words(lower=True).hashes(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _keys(h: np.ndarray, *salt: int) -> np.ndarray:
    """A number of its own for each hash and salt, as evenly spread as random ones."""
    for k in salt:
        h = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
    return h


def _seat(customers: np.ndarray, new: np.ndarray, discount: float, draw: np.random.Generator | np.ndarray) -> np.ndarray:
    """Tables of each dish given its customers: t of them have the odds S(c, t) * new ** t.

    S(c, t) counts the ways to seat c customers at t tables, weighed by the discount; ``new`` weighs a table more. The rows of S are
    built one after the other, and the dishes with as many customers drawn from each. Beyond EXACT customers the last row's draw is
    carried on by seating the rest in parties of an eighth at most. ``draw`` may be a random number (uint64) for each dish.
    """
    key = draw.integers(0, 1 << 64, len(customers), np.uint64) if isinstance(draw, np.random.Generator) else draw
    tables = np.minimum(customers, 1)
    order = np.argsort(customers, kind="stable")
    c = customers[order]
    top = int(min(EXACT, c[-1])) if len(c) else 0
    log_new = np.log(np.maximum(new, 1e-300))
    row = np.zeros(1)
    for n in range(1, top + 1):
        if n > 1:
            grown = np.concatenate([row + np.log(n - 1 - discount * np.arange(1, n)), [-np.inf]])
            row = np.logaddexp(grown, np.concatenate([[-np.inf], row]))
        lo, hi = np.searchsorted(c, n), len(c) if n == EXACT else np.searchsorted(c, n, "right")
        t = np.arange(1, n + 1)
        for k in range(lo if n > 1 else hi, hi, STEP):
            at = order[k : min(k + STEP, hi)]
            odds = row + t * log_new[at, None]
            odds = np.cumsum(np.exp(odds - odds.max(1, keepdims=True)), axis=1)
            chance = (key[at] >> np.uint64(11)) * 2.0**-53
            tables[at] = (odds[:, :-1] <= (chance * odds[:, -1])[:, None]).sum(1) + 1
    for i in np.flatnonzero(customers > EXACT).tolist():
        own, seated, t, c, more = np.random.Generator(np.random.PCG64(int(key[i]))), EXACT, int(tables[i]), int(customers[i]), float(new[i])
        while seated < c:
            party = min(seated // 8, c - seated)
            t, seated = t + int(own.binomial(party, more / (more + seated - discount * t))), seated + party
        tables[i] = t
    return tables


@dataclass
class Frequent:
    """The most frequent words by hash and their counts. A word's code is its place from 1; 0 is the end, ``others`` any other word."""

    h: np.ndarray
    count: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        """The hash of each code's word; the end's is 0."""
        return np.concatenate([np.zeros(1, np.uint64), self.h.view(np.uint64)])

    @property
    def others(self) -> int:
        return len(self.h) + 1

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and if it is there."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def pairs(self, w: Words, first: np.ndarray, at: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's context and dish, ends included, and the text that it is in. An end comes before each text."""
        n = len(first) - 1
        code = np.where(there, at + 1, self.others)
        place = np.arange(len(code)) + w.doc
        dish, before = np.zeros(len(code) + n, np.int64), np.zeros(len(code) + n + 1, np.int64)
        dish[place] = code
        before[place + 1] = code
        return before[:-1], dish, np.repeat(np.arange(n), np.diff(first) + 1)

    def rare(self, w: Words, h: np.ndarray, before: np.ndarray, dish: np.ndarray) -> tuple[Tokens, np.ndarray]:
        """The other words' tokens with the words about them, and where they are among the pairs."""
        at = np.flatnonzero(dish == self.others)
        full = np.zeros(len(dish), np.uint64)
        full[np.arange(len(h)) + w.doc] = h
        codes = before[at], dish[at + 1]
        far = tuple(np.where(c == self.others, full[i], np.uint64(0)) for c, i in zip(codes, (at - 1, at + 1)))
        return Tokens(full[at], codes, far), at


def _least(levels: dict[int, int], at_most: int) -> int:
    """The lowest level that, with those above it, holds no more than ``at_most``."""
    best, held = max(levels, default=0) + 1, 0
    for level in sorted(levels, reverse=True):
        held += levels[level]
        if held > at_most:
            break
        best = level
    return best


def _level(c):
    return F.floor(F.log2(c) * LEVELS)


def frequent_words(words: DataFrame) -> tuple[Frequent, DataFrame]:
    """The frequent words, and ``h, c`` of the others. Equally frequent words are all on one side."""
    levels = words.groupBy(_level(F.col("c")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least = _least({r["level"]: r["n"] for r in levels}, FREQUENT)
    top = words.filter(_level(F.col("c")) >= least).toArrow().sort_by("h")
    return Frequent(top["h"].to_numpy(), top["c"].to_numpy()), words.filter(_level(F.col("c")) < least)


def pair_counts(train: DataFrame, hot: Frequent, n_buckets: int, rare_buckets: int) -> DataFrame:
    """A row for each bucket: its pairs of context and dish, ascending, and how often the training texts hold each.

    The buckets of the other words (as -1 - bucket) hold these words' own pairs in ``rare``.
    """
    sent = train.sparkSession.sparkContext.broadcast(hot)
    schema = "bucket long, size long, pairs binary, n binary, rare binary"
    names = ["bucket", "size", "pairs", "n", "rare"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held = sent.value, []
        others = hot.others
        for b in batches:
            for c in chunks(b.column("text"), CHUNK):
                w = c.words(lower=True)
                h = w.hashes()
                before, dish, _ = hot.pairs(w, w.first, *hot.find(h.view(np.int64)))
                held.append(hot.rare(w, h, before, dish)[0])
                x, n = np.unique(mixed(before, dish), return_counts=True)
                yield batch([(k, s.stop - s.start, packed_steps(x[s]), packed(n[s]), None) for k, s in cut(x, n_buckets)])
                if sum(len(t.h) for t in held) >= TOGETHER:
                    yield batch([(-1 - k, None, None, None, raw) for k, raw in Tokens.together(held).blocks(rare_buckets, others)])
                    held = []
        if held:
            yield batch([(-1 - k, None, None, None, raw) for k, raw in Tokens.together(held).blocks(rare_buckets, others)])
        give_back()

    def merge(blocks: pa.Table) -> pa.Table:
        got = blocks.to_pylist()
        if got[0]["bucket"] < 0:
            others = sent.value.others
            raw = Block.of([Tokens.read(r["rare"], others)[0] for r in got], others).written()
            give_back()
            return pa.Table.from_batches([batch([(got[0]["bucket"], None, None, None, raw)])])
        x = np.concatenate([unpacked_steps(r["pairs"], r["size"]) for r in got])
        n = np.concatenate([unpacked(r["n"], r["size"]) for r in got]).astype(np.int64)
        order = np.argsort(x, kind="stable")
        x, n = x[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return pa.Table.from_batches([batch([(got[0]["bucket"], len(at), packed_steps(x[at]), packed(np.add.reduceat(n, at)), None)])])

    return written(train.select("text").mapInArrow(run, schema).groupBy("bucket").applyInArrow(merge, schema), "pairs")


def _per_code(pairs: DataFrame, each, size: int) -> np.ndarray:
    """Sums over all pairs: ``each(bucket, context, dish, n)`` gives places below ``size`` and what to add there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for r in b.to_pylist():
                before, dish = parts(unpacked_steps(r["pairs"], r["size"]))
                for at, add in each(r["bucket"], before, dish, unpacked(r["n"], r["size"]).astype(np.int64)):
                    total += np.bincount(at, add, size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = pairs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def _discount(once: float, twice: float) -> float:
    return min(max(max(once, 1) / (max(once, 1) + 2 * max(twice, 1)), 0.05), 0.95)


@dataclass
class Sample:
    """The word restaurant in a sweep: discount, base probability of a word, customers in all, and tables in all before it and after it."""

    discount: float
    base: float
    customers: float
    before: float
    tables: float = 0.0

    def seat(self, customers: np.ndarray, keys: np.ndarray, sweep: int) -> np.ndarray:
        """Tables of words, each drawn by its hash."""
        new = (STRENGTH + self.discount * self.before) * self.base
        return _seat(customers, np.full(len(customers), new), self.discount, _keys(keys, SEED, 2 * sweep))

    def probability(self, customers: np.ndarray | int, tables: np.ndarray | int) -> np.ndarray:
        new = (STRENGTH + self.discount * self.tables) * self.base
        return (np.maximum(customers - self.discount * tables, 0) + new) / (STRENGTH + self.customers)


@dataclass
class Contexts:
    """The context restaurants before a sweep seats them: the sweep, the discount, each context's tables, each dish's probability above,
    the codes' hashes, and the sweep's word restaurant."""

    sweep: int
    discount: float
    tables: np.ndarray
    above: np.ndarray
    keys: np.ndarray
    words: Sample

    def drawn(self, pairs: np.ndarray, new: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Tables of pairs, each drawn by its own hash."""
        return _seat(n, new, self.discount, _keys(pairs, SEED, 2 * self.sweep + 1))

    def seat(self, before: np.ndarray, dish: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Tables of pairs of frequent words that were seen twice or more."""
        new = (STRENGTH + self.discount * self.tables[before]) * self.above[dish]
        return self.drawn(pair_key(self.keys[before], self.keys[dish]), new, n)

    def seat_block(self, block: Block, tables: np.ndarray, customers: np.ndarray, far_tables: np.ndarray, far_customers: np.ndarray):
        """Of a block of other words: their probabilities above, the tables of their pairs as dishes and as contexts."""
        above = self.words.probability(customers, self.words.seat(customers, block.h, self.sweep))
        d, c = block.dish, block.context
        far = c.code == block.others
        own, keys = np.append(self.tables[: block.others], 0.0), np.append(self.keys, np.uint64(0))
        over = np.append(self.above[: block.others], 0.0)[c.code]
        over[far] = self.words.probability(far_customers[far], self.words.seat(far_customers[far], c.far[far], self.sweep))
        before = np.where(d.code == block.others, far_tables, own[d.code])
        as_dish = self.drawn(pair_key(keys[d.code] + d.far, block.h[d.at]), (STRENGTH + self.discount * before) * above[d.at], d.n)
        as_context = self.drawn(pair_key(block.h[c.at], keys[c.code] + c.far), (STRENGTH + self.discount * tables[c.at]) * over, c.n)
        return above, as_dish, as_context


@dataclass
class Model:
    """Averages over the kept sweeps, by code: log10 probabilities of words (0 for others), what a context leaves to the word restaurant
    as log10, that times its customers and STRENGTH (``left``), the word restaurant's probability (``above``); the sweeps themselves;
    the log10 probability of the unknown word. ``others`` stands for all other words together: ``rare_dishes`` are their tables
    in each context, ``rare_contexts`` each dish's tables in their contexts."""

    hot: Frequent
    word_log: np.ndarray
    back_log: np.ndarray
    left: np.ndarray
    above: np.ndarray
    kept: list[Contexts]
    unknown_log: float
    rare_dishes: np.ndarray
    rare_contexts: np.ndarray

    def gains(self, before: np.ndarray, dish: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What having been seen adds to each pair's log10 probability."""
        others = self.hot.others
        drawn = (n > 1) & (dish < others) & (before < others)
        tables = np.where(dish == others, self.rare_dishes[before], np.where(before == others, self.rare_contexts[dish], 1.0))
        if drawn.any():
            u, w, c = before[drawn], dish[drawn], n[drawn]
            tables[drawn] = np.mean([k.seat(u, w, c) for k in self.kept], axis=0)
        return np.log10(1 + (n - self.kept[0].discount * tables) / (self.left[before] * self.above[dish]))


class Rare:
    """The other words' blocks through the sweeps: what was written of each sweep, and its sums.

    ``source`` tells a bucket's rows apart: its words, its state before a sweep, or the bucket that a message comes from.
    """

    WORDS, FAR, STATE, LEFT = -1, -2, -3, -4
    SCHEMA = "bucket long, source long, sweep long, raw binary, at long, n long"
    KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def __init__(self, blocks: DataFrame, hot: Frequent, n_buckets: int):
        self.blocks, self.hot, self.n_buckets, self.sweeps = blocks, hot, n_buckets, []
        self.codes = hot.others + 1

    @classmethod
    def _batch(cls, rows: list[tuple]) -> list[pa.Array]:
        return [pa.array(v, k) for v, k in zip(list(zip(*rows)) or [[]] * 6, cls.KINDS)]

    def _sums(self, df: DataFrame) -> np.ndarray:
        """By context, by dish, and: pairs seen once, twice, tables of words in the next sweep, of far pairs, of contexts, customers."""
        got = df.filter("bucket IS NULL").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(2 * self.codes + 6, np.int64)
        out[got["at"].to_numpy()] = got["n"].to_numpy()
        return out

    @staticmethod
    def _added(block: Block, codes: int, dish: np.ndarray, context: np.ndarray, rest: list[int]) -> list[tuple]:
        """Rows of sums over a block's pairs of tables as a dish and as a context; far pairs count as dishes."""
        near, far = context[block.context.code < block.others], block.dish.code == block.others
        total = np.bincount(block.dish.code, dish, codes)
        total[block.others] = 0
        total = np.concatenate([total, np.bincount(block.context.code[block.context.code < block.others], near, codes), rest]).astype(np.int64)
        total[2 * codes + 3] = dish[far].sum()
        return [(None, None, None, None, int(k), int(total[k])) for k in np.flatnonzero(total)]

    @classmethod
    def _state(cls, bucket: int, sweep: int, block: Block, n_buckets: int, tables: np.ndarray, customers: np.ndarray) -> list[tuple]:
        rows = [(bucket, cls.STATE, sweep, blob(tables, customers), None, None)]
        return rows + [(to, bucket, sweep, raw, None, None) for to, raw in block.messages(n_buckets, tables, customers)]

    def start(self, words: Sample) -> np.ndarray:
        """The blocks as they go through the sweeps, and the sums before the first one: every pair has one table."""
        others, codes, n_buckets = self.hot.others, self.codes, self.n_buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    block, k = Block.read(r["raw"], others), r["bucket"]
                    live = block.live()[0]
                    near = block.context.code < others
                    seen = np.concatenate([block.dish.n, block.context.n[near]])
                    tables = int(words.seat(live.customers, live.h, 0).sum())
                    rest = [(seen == 1).sum(), (seen == 2).sum(), tables, 0, block.tables.sum(), block.customers.sum()]
                    rows = Rare._added(block, codes, np.ones(len(block.dish.at)), np.ones(len(near)), rest)
                    rows += [(k, Rare.WORDS, 0, live.written(), None, None)] + Rare._state(k, 0, live, n_buckets, live.tables, live.customers)
                    at, _ = block.far(block.context, n_buckets)
                    if len(at):
                        own = np.unique(block.context.at[at])
                        block.context = block.context.some(block.context.code == others)
                        block.context.at = np.searchsorted(own, block.context.at)
                        block.dish = block.dish.some(np.zeros(len(block.dish.at), bool))
                        kept = Block(block.h[own], block.count[own], block.tables[own], block.customers[own], block.dish, block.context, others)
                        rows.append((k, Rare.FAR, 0, kept.written(), None, None))
                    yield pa.RecordBatch.from_arrays(Rare._batch(rows), ["bucket", "source", "sweep", "raw", "at", "n"])

        first = written(self.blocks.mapInArrow(run, self.SCHEMA), "rare")
        self.live, self.far = first.filter(F.col("source") == self.WORDS), first.filter(F.col("source") == self.FAR)
        self.sweeps.append(first.filter((F.col("source") == self.STATE) | (F.col("source") >= 0)))
        return self._sums(first)

    def sweep(self, contexts) -> np.ndarray:
        """Seats the blocks' pairs; the sums of what they have beyond one table each."""
        others, codes, n_buckets = self.hot.others, self.codes, self.n_buckets

        def step(got: pa.Table) -> pa.Table:
            rows, now = got.to_pylist(), contexts.value
            (raw,) = (r["raw"] for r in rows if r["source"] == Rare.WORDS)
            block, bucket, s = Block.read(raw, others), rows[0]["bucket"], now.sweep
            tables, customers, far = Rare._held(rows, s)
            _, as_dish, as_context = now.seat_block(block, tables, customers, *block.received(n_buckets, far))
            tables = block.tables + np.bincount(block.context.at, as_context - 1, len(block.h)).astype(np.int64)
            customers = block.customers + np.bincount(block.dish.at, as_dish - 1, len(block.h)).astype(np.int64)
            after = Sample(now.words.discount, now.words.base, 0.0, now.words.tables).seat(customers, block.h, s + 1).sum()
            rest = [0, 0, after, 0, (tables - block.tables).sum(), (customers - block.customers).sum()]
            out = Rare._added(block, codes, as_dish - 1, as_context - 1, rest) + Rare._state(bucket, s + 1, block, n_buckets, tables, customers)
            give_back()
            return pa.table(Rare._batch(out), ["bucket", "source", "sweep", "raw", "at", "n"])

        both = self.live.unionByName(self.sweeps[-1])
        done = written(both.groupBy("bucket").applyInArrow(step, self.SCHEMA), "rare")
        self.sweeps.append(done.filter("bucket IS NOT NULL"))
        return self._sums(done)

    @staticmethod
    def _held(rows: list[dict], sweep: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        (state,) = (r["raw"] for r in rows if r["source"] == Rare.STATE and r["sweep"] == sweep)
        tables, customers = (v.astype(np.int64) for v in unblob(state))
        return tables, customers, [(r["source"], r["raw"]) for r in rows if r["source"] >= 0 and r["sweep"] == sweep]

    def finished(self) -> DataFrame:
        """All that a bucket's rows need for ``averaged``: words, states, messages, and the tables after the sweeps of far contexts."""
        others, n_buckets = self.hot.others, self.n_buckets
        columns = ["bucket", "source", "sweep", "raw"]
        states = [s.select(*columns) for s in self.sweeps[BURN_IN:]]
        kept = states[0]
        for s in states[1:]:
            kept = kept.unionByName(s)
        after = kept.filter((F.col("source") == self.STATE) & (F.col("sweep") > BURN_IN))

        def left(got: pa.Table) -> pa.Table:
            rows = got.to_pylist()
            far = [r["raw"] for r in rows if r["source"] == Rare.FAR]
            (live,) = (r["raw"] for r in rows if r["source"] == Rare.WORDS)
            out = []
            if far:
                block, h = Block.read(far[0], others), Block.read(live, others).h
                tables = block.tables * (SWEEPS - BURN_IN)
                there = block.count > 1
                tables[there] = sum(Rare._held(rows, s)[0] for s in range(BURN_IN + 1, SWEEPS + 1))[np.searchsorted(h, block.h[there])]
                out = [(to, rows[0]["bucket"], Rare.LEFT, raw) for to, raw in block.messages(n_buckets, tables, None)]
            return pa.table([pa.array(v, k) for v, k in zip(list(zip(*out)) or [[]] * 4, Rare.KINDS)], columns)

        needed = self.live.select(*columns).unionByName(self.far.select(*columns)).unionByName(after)
        lefts = needed.groupBy("bucket").applyInArrow(left, "bucket long, source long, sweep long, raw binary")
        whole = self.blocks.select("bucket", F.lit(self.WORDS).cast("long").alias("source"), F.lit(0).cast("long").alias("sweep"), "raw")
        return whole.unionByName(kept).unionByName(lefts)

    @staticmethod
    def averaged(rows: list[dict], model: Model, n_buckets: int) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A bucket's words, the log10 of their probabilities and of what they leave as contexts, and the gains of all their pairs."""
        (raw,) = (r["raw"] for r in rows if r["source"] == Rare.WORDS)
        block = Block.read(raw, model.hot.others)
        live, words, in_dish, in_context = block.live()
        kept, near = len(model.kept), block.context.code < block.others
        above, t_dish, t_context = np.full(len(words), sum(k.words.probability(1, 1) for k in model.kept)), np.full(len(in_dish), kept), np.full(len(in_context), kept)
        after = block.tables * kept
        sums = [np.zeros(len(v.at)) for v in (live.dish, live.context)] + [np.zeros(len(live.h))] * 2
        for k in model.kept:
            tables, customers, far = Rare._held(rows, k.sweep)
            p, as_dish, as_context = k.seat_block(live, tables, customers, *live.received(n_buckets, far))
            sums = [a + b for a, b in zip(sums, (as_dish, as_context, p, Rare._held(rows, k.sweep + 1)[0]))]
        t_dish[in_dish], t_context[in_context], above[words], after[words] = sums
        above, d = above / kept, model.kept[0].discount
        left = STRENGTH + d * after / kept
        far = block.received(n_buckets, [(r["source"], r["raw"]) for r in rows if r["sweep"] == Rare.LEFT])[0]
        before = np.where(block.dish.code == block.others, STRENGTH + d * far / kept, model.left[block.dish.code])
        gain_dish = np.log10(1 + (block.dish.n - d * t_dish / kept) / (before * above[block.dish.at]))
        gain_context = np.log10(1 + (block.context.n - d * t_context / kept) / (left[block.context.at] * model.above[block.context.code]))
        return block, np.log10(above), np.log10(left / (STRENGTH + block.count)), gain_dish, np.where(near, gain_context, 0.0)

    def words(self) -> DataFrame:
        """``h, c`` and the averaged log10 probability ``p`` of every other word."""
        n_buckets, sent = self.n_buckets, self.sent

        def run(got: pa.Table) -> pa.Table:
            block, p, *_ = Rare.averaged(got.to_pylist(), sent.value, n_buckets)
            return pa.table({"h": block.h.view(np.int64), "c": block.count, "p": p})

        return self.finished().groupBy("bucket").applyInArrow(run, "h long, c long, p double")


def fit(train: DataFrame, words: DataFrame, n_texts: int, distinct: int, total: int) -> tuple[Model, DataFrame, DataFrame, Rare]:
    """The model, ``h, c, p`` of the words that aren't frequent, the counts of pairs, and the blocks of the other words."""
    hot, rare = frequent_words(words)
    few = {r["c"]: r["n"] for r in words.filter("c < 3").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rare, rare_words, once = rare.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    rare_buckets = -(-max(n_rare, 1) // PER_RARE)
    counted = pair_counts(train, hot, -(-max(total, 1) // PER_BUCKET), rare_buckets)
    pairs = counted.filter("bucket >= 0").select("bucket", "size", "pairs", "n")
    blocks = Rare(counted.filter("bucket < 0").select((-1 - F.col("bucket")).alias("bucket"), F.col("rare").alias("raw")), hot, rare_buckets)
    others, codes, keys = hot.others, hot.others + 1, hot.keys

    def first_tables(bucket, before, dish, n):
        own = (dish < others) & (before < others)
        yield before[own], np.ones(own.sum(), np.int64)
        yield codes + dish[own], np.ones(own.sum(), np.int64)
        yield 2 * codes + n[own & (n < 3)] - 1, np.ones((own & (n < 3)).sum(), np.int64)

    got = _per_code(pairs, first_tables, 2 * codes + 2)
    discount, base, seated = _discount(few.get(1, 0), few.get(2, 0)), 1 / (distinct + 1), float(distinct)
    rare_first = rare_now = blocks.start(Sample(discount, base, 0.0, seated)) if rare_words else np.zeros(2 * codes + 6, np.int64)
    d = _discount(*(got[-2:] + rare_first[2 * codes : 2 * codes + 2]))
    first, types = got[:codes] + rare_first[:codes], got[codes : 2 * codes - 1] + rare_first[codes : 2 * codes - 1]
    first[others] = rare_first[-2]
    tables, customers, rare_customers = first.copy(), types.copy(), rare_first[-1]
    kept, parents, after, rare_sums = [], 0.0, 0.0, 0.0
    for sweep in range(SWEEPS):
        state = Sample(discount, base, float(customers.sum() + rare_customers), seated)
        own = state.seat(customers, keys, sweep)
        state.tables = seated = float(own.sum() + once + rare_now[2 * codes + 2])
        parent = state.probability(customers, own)
        contexts = Contexts(sweep, d, tables, np.append(parent, max(1 - parent.sum(), 1e-12)), keys, state)
        sent = train.sparkSession.sparkContext.broadcast(contexts)

        def more_tables(bucket, before, dish, n, sent=sent):
            drawn = (n > 1) & (dish < others) & (before < others)
            u, w = before[drawn], dish[drawn]
            more = sent.value.seat(u, w, n[drawn]) - 1
            at = more > 0
            yield u[at], more[at]
            yield codes + w[at], more[at]

        more = _per_code(pairs, more_tables, 2 * codes)
        if rare_words:
            rare_now = blocks.sweep(sent)
        extra = rare_now if rare_words else 0 * rare_now
        sent.destroy()
        tables, customers = first + more[:codes] + extra[:codes], types + more[codes : 2 * codes - 1] + extra[codes : 2 * codes - 1]
        tables[others] = first[others] + extra[-2]
        rare_customers = rare_first[-1] + extra[-1]
        if sweep >= BURN_IN:
            kept.append(contexts)
            parents, after, rare_sums = parents + parent, after + tables, rare_sums + rare_first + extra
    parents, left, rare_sums = parents / len(kept), STRENGTH + d * after / len(kept), rare_sums / len(kept)
    above = np.append(parents, max(1 - parents.sum(), 1e-12))
    seen = STRENGTH + np.concatenate([[n_texts], hot.count, [n_rare]])
    unknown = float(np.log10(np.mean([k.words.probability(0, 0) for k in kept])))
    both = rare_sums[2 * codes + 3]
    dishes, contexts = np.append(rare_sums[: codes - 1], both), np.append(rare_sums[codes : 2 * codes - 1], both)
    model = Model(hot, np.append(np.log10(parents), 0.0), np.log10(left / seen), left, above, kept, unknown, dishes, contexts)
    blocks.sent = train.sparkSession.sparkContext.broadcast(model)
    return model, blocks.words() if rare_words else rare.withColumn("p", F.lit(0.0)), pairs, blocks


def pair_gains(pairs: DataFrame, model: Model | Broadcast, least: int = 1, own: bool = False) -> DataFrame:
    """``pair, n, gain`` of the pairs seen ``least`` times or more; ``own`` leaves out those of all other words together."""
    sent = model if isinstance(model, Broadcast) else pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = sent.value.hot.others
        for b in batches:
            for r in b.to_pylist():
                x, n = unpacked_steps(r["pairs"], r["size"]), unpacked(r["n"], r["size"]).astype(np.int64)
                x, n = x[n >= least], n[n >= least]
                before, dish = parts(x)
                at = (before < others) & (dish < others) | (not own)
                gain = sent.value.gains(before[at], dish[at], n[at])
                yield pa.RecordBatch.from_arrays([pa.array(x[at].astype(np.int64)), pa.array(n[at]), pa.array(gain)], ["pair", "n", "gain"])

    return pairs.mapInArrow(run, "pair long, n long, gain double")


def _hot_pairs(pairs: DataFrame, model: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs, ascending, and their gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                level, many = np.unique(np.floor(np.log2(unpacked(r["n"], r["size"])) * LEVELS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(many)], ["level", "n"])

    levels = {r["level"]: r["n"] for r in pairs.mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least = int(np.ceil(2 ** (_least(levels, HOT) / LEVELS) - 1e-9))
    top = pair_gains(pairs, model, least, own=True).select("pair", "gain").toArrow().sort_by("pair")
    return top["pair"].to_numpy().astype(np.uint64), top["gain"].to_numpy()


def _looked_up(places: DataFrame, pairs: DataFrame, tokens: DataFrame, blocks: Rare) -> DataFrame:
    """``of_row, gain, base, known``: sums over each text's pairs of frequent words in ``places`` and its other words in ``tokens``.

    Texts without such words and without a pair that was seen are left out.
    """
    spark, n_buckets, sent = pairs.sparkSession, blocks.n_buckets, blocks.sent
    schema, names = "chunk long, size long, texts binary, gains binary, base binary, known binary", ["chunk", "size", "texts", "gains", "base", "known"]

    def met(out: list[tuple]) -> pa.Table:
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names)

    def meet(texts: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        if len(texts) and len(counts):
            (r,) = counts.to_pylist()
            x = unpacked_steps(r["pairs"], r["size"])
            gain = sent.value.gains(*parts(x), unpacked(r["n"], r["size"]).astype(np.int64))
            for block in texts.to_pylist():
                wanted, of = unpacked_steps(block["pairs"], block["size"]), unpacked(block["texts"], block["size"]).astype(np.int64)
                at = np.minimum(np.searchsorted(x, wanted), len(x) - 1)
                there = x[at] == wanted
                sums, rows = np.bincount(of[there], gain[at[there]]), np.unique(of[there])
                if len(rows):
                    out.append((block["chunk"], len(rows), packed_steps(rows.astype(np.uint64)), sums[rows].astype(np.float32).tobytes(), None, None))
        give_back()
        return met(out)

    def meet_rare(texts: pa.Table, found: pa.Table) -> pa.Table:
        out, model = [], sent.value
        others, keys = model.hot.others, np.append(model.hot.keys, np.uint64(0))
        h, pairs, gain = np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(1)
        # The last of the words and of their values stands for a word that was not seen.
        value, base = np.array([model.unknown_log]), np.log10([0.1])
        if len(texts) and len(found):
            block, p, back, of_dish, of_context = Rare.averaged(found.to_pylist(), model, n_buckets)
            d, c, near = block.dish, block.context, block.context.code < others
            h, value, base = block.h, np.append(p + back, value), np.append(np.log10(block.count + 0.1), base)
            pairs = np.concatenate([pair_key(keys[d.code] + d.far, h[d.at]), pair_key(h[c.at[near]], keys[c.code[near]])])
            order = np.argsort(pairs)
            pairs, gain = pairs[order], np.concatenate([of_dish, of_context[near]])[order]
        for block in texts.to_pylist():
            t, (of,) = Tokens.read(block["rare"], others)
            of = of.astype(np.int64)
            at = np.searchsorted(h, t.h)
            at[h[np.minimum(at, len(h) - 1)] != t.h if len(h) else slice(None)] = len(h)
            near = t.codes[1] < others
            wanted = np.concatenate([pair_key(keys[t.codes[0]] + t.far[0], t.h), pair_key(t.h[near], keys[t.codes[1][near]])])
            place = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            gains = np.where(pairs[place] == wanted, gain[place], 0.0)
            sums = np.bincount(of, value[at]) + np.bincount(np.concatenate([of, of[near]]), gains)
            rows = np.unique(of)
            known, bases = np.bincount(of, at < len(h))[rows], np.bincount(of, base[at])[rows]
            out.append((block["chunk"], len(rows), packed_steps(rows.astype(np.uint64)), sums[rows].astype(np.float32).tobytes(), bases.tobytes(), packed(known)))
        give_back()
        return met(out)

    def add_up(blocks: pa.Table) -> pa.Table:
        got = blocks.to_pylist()
        of = [unpacked_steps(r["texts"], r["size"]).astype(np.int64) for r in got]
        rows = np.unique(np.concatenate(of))
        sums = [np.bincount(np.concatenate(of), np.concatenate([np.frombuffer(r["gains"], np.float32) for r in got]))]
        rare = [(r, t) for r, t in zip(got, of) if r["base"] is not None]
        whole = np.concatenate([np.zeros(0, np.int64), *(t for _, t in rare)])
        for v in ([np.frombuffer(r["base"]) for r, _ in rare], [unpacked(r["known"], r["size"]) for r, _ in rare]):
            sums.append(np.bincount(whole, np.concatenate([np.zeros(0), *v]), rows[-1] + 1))
        gain, base, known = (v[rows] for v in sums)
        return pa.table({"of_row": got[0]["chunk"] + rows, "gain": gain, "base_more": base, "known_more": known.astype(np.int64)})

    found = blocks.finished() if blocks.sweeps else spark.createDataFrame([], "bucket long, source long, sweep long, raw binary")
    seen = places.groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(meet, schema)
    seen = seen.unionByName(tokens.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(meet_rare, schema))
    return seen.groupBy("chunk").applyInArrow(add_up, "of_row long, gain double, base_more double, known_more long")


def score_texts(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from documents whose crc32(doc_id as text) mod ``modulus`` is not 0 (a null id counts as empty text). Needs
    ``doc_id`` and ``text``; more columns are ignored. Null text is empty: one end. Rows with the same id are scored
    one by one. Without training texts every word is the unknown one, and both scores are 0; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", _held_out(modulus))
    train = named.filter(~F.col("held_out"))
    words = written(word_counts(train), "words")
    n_texts = train.count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = int(sums[0]) + n_texts, int(sums[1]) + (n_texts > 0)
    model, _, pairs, blocks = fit(train, words, n_texts, distinct, total)
    hot, n_buckets, rare_buckets = model.hot, -(-max(total, 1) // PER_BUCKET), blocks.n_buckets
    back_log = np.append(model.back_log[:-1], 0.0)
    sent = spark.sparkContext.broadcast((hot, model.word_log, back_log, *_hot_pairs(pairs, blocks.sent)))
    of_text = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score"]
    of_block, of_rare = ["bucket", "chunk", "size", "pairs", "texts"], ["bucket", "chunk", "rare"]
    kinds = dict(zip(of_text + of_block + of_rare[2:], "long long boolean long long double double long long long binary binary binary".split()))
    plain = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}

    def filled(got: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([got[k] if k in got else pa.nulls(n, plain[v]) for k, v in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, word_log, back_log, top, top_gain = sent.value
        base_log = np.log10(hot.count + 0.1)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for c in chunks(b.column("text"), CHUNK):
                w, n = c.words(lower=True), len(c)
                h = w.hashes()
                at, there = hot.find(h.view(np.int64))
                before, dish, of = hot.pairs(w, w.first, at, there)
                score = np.bincount(of, word_log[dish] + back_log[before], n)
                tokens, others = hot.rare(w, h, before, dish)
                tokens.far = tokens.far[0], np.zeros(len(others), np.uint64)
                rare = [(-1 - k, row, raw) for k, raw in tokens.blocks(rare_buckets, hot.others, of[others])]
                own = (before < hot.others) & (dish < hot.others)
                x, of = mixed(before[own], dish[own]), of[own]
                if len(top):
                    place = np.minimum(np.searchsorted(top, x), len(top) - 1)
                    is_top = top[place] == x
                    score += np.bincount(of[is_top], top_gain[place[is_top]], n)
                    x, of = x[~is_top], of[~is_top]
                known, base = np.zeros(n, np.int64), np.zeros(n)
                if len(hot.h):
                    known = np.bincount(w.doc[there], minlength=n)
                    base = base + np.bincount(w.doc[there], base_log[at[there]], n)
                part = b.slice(c.rows.start, n)
                texts = [pa.array(row + np.arange(n)), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(w.first) + 1), pa.array(known), pa.array(base, pa.float64())]
                yield filled(dict(zip(of_text, [*texts, pa.array(score, pa.float64())])), n)
                order = np.argsort(x, kind="stable")
                x, of = x[order], of[order]
                blocks = [(k, row, s.stop - s.start, packed_steps(x[s]), packed(of[s])) for k, s in cut(x, n_buckets)]
                if blocks:
                    yield filled({k: pa.array(v) for k, v in zip(of_block, zip(*blocks))}, len(blocks))
                if rare:
                    yield filled({k: pa.array(v) for k, v in zip(of_rare, zip(*rare))}, len(rare))
                row += n
        give_back()

    both = written(named.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items())), "scored")
    scored = both.filter("bucket IS NULL").select(*of_text)
    places, tokens = both.filter("bucket >= 0").select(*of_block), both.filter("bucket < 0").select((-1 - F.col("bucket")).alias("bucket"), *of_rare[1:])
    gains = _looked_up(places, pairs, tokens, blocks)
    out = scored.join(gains, F.col("row") == F.col("of_row"), "left")
    end = float(np.log10(n_texts + 0.1))
    each = float(np.log10(total + 0.1 * (distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("known_more", F.lit(0)) + F.lit(1 if n_texts else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
