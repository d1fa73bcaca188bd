"""Exact Jaccard join of shingle sets, confirmed in signature trees.

Two sets of a similarity of at least ``percent`` share a member of their prefixes, the first (100 - percent) % of their members in any
order that holds for all sets. Here common shingles come last, so sets that only share those don't meet. The sets that meet in one
shingle are a group; who has no partner there by size and place is left out, and groups with the same members are one group. Each group's sets
stand in a signature tree, whose dual traversal leaves few pairs to be intersected.

Each set's largest group comes first. Those connect most copies, and the other groups count only if they still hold different components.
A large group is cut into blocks. First each block is joined alone, which connects a crowd of copies; then blocks are cut
anew by component, and two blocks meet only if they hold different components. Groups move signatures; texts follow only for sets that may still link, once for groups that hang together. A shingle that very many sets have is dealt out by
the set's number. Everything moved is a row for a set in a group or a list of ids; nothing stands in a row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cortexlake.llm.bytetext import mix
from cortexlake.llm.links import between, components, lists_of, pack, unpack, whole_groups
from cortexlake.llm.scratch import written
from cortexlake.llm.shingle_sets import digests, labelled, sets_of
from cortexlake.llm.signature_tree import alike, signatures

WORDS, PERCENT = 4, 85
#: Shingles put last: the most frequent of those that RUN shingles of the corpus, one after the other, hold in LEAST sets.
HEAVY, RUN, LEAST = 65_536, 1 << 21, 4
#: Sets and shingles of a block; rows of a shingle that stay together.
BLOCK, WEIGHT, TOGETHER = 512, 1 << 18, 65_536
#: Bits that tell which documents are asked for.
MARKS = 1 << 23
#: Packed bytes confirmed together; each set counts as so many more.
AT_ONCE, EACH = 1 << 21, 512


class Order:
    """The order of shingles: by how often heavy ones were counted, others first, and then by hash."""

    def __init__(self, token: np.ndarray, count: np.ndarray):
        at = np.argsort(token)
        self.token, self.count = token[at], count[at]

    def counts(self, h: np.ndarray) -> np.ndarray:
        if not len(self.token):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        return np.where(self.token[at] == h, self.count[at], 0)

    def prefixes(self, at: np.ndarray, h: np.ndarray, percent: int) -> list[bytes]:
        """Each set's first members, those that a set of the least or greatest size may share."""
        size = np.diff(at)
        doc = np.repeat(np.arange(len(size)), size)
        sorted_ = h[np.lexsort((h, self.counts(h), doc))]
        long_ = np.where(size > 0, size + (-percent * size) // 100 + 1, 0)
        return [sorted_[a : a + n].tobytes() for a, n in zip(at[:-1].tolist(), long_.tolist())]


def _sets_in(b: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return sets_of(unpack(b.column("packed")) if "packed" in b.schema.names else b.column("text"), words)


def heavy_order(texts: DataFrame, words: int) -> Order:
    """``texts`` has ``text``, or ``packed`` ones. What comes to the driver is HEAVY shingles at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token[n >= LEAST].view(np.int64)), pa.array(n[n >= LEAST])], ["token", "n"])

        for b in batches:
            for _, h in _sets_in(b, words):
                held.append(h)
                if sum(map(len, held)) >= RUN:
                    yield counted()
        if held:
            yield counted()

    n = texts.select(texts.columns[-1]).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = n.orderBy(F.desc("n"), "token").limit(HEAVY).toArrow()
    return Order(top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy())


def _placed(sets: DataFrame, order: Order) -> DataFrame:
    """A row for each shingle of each prefix: ``token, salt, id, size, rest``; ``rest`` are the members from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.slice(lo, 1000)
                tokens = [np.frombuffer(p, np.uint64) for p in b.column("prefix").to_pylist()]
                many = np.array([len(t) for t in tokens], np.int64)
                token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
                ids, size = np.repeat(b.column("id").to_numpy(), many), np.repeat(b.column("size").to_numpy(), many)
                rest = size - (np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many))
                shares = -(-order.counts(token) // TOGETHER)
                salt = np.where(shares > 1, (mix(ids.astype(np.uint64)) % np.maximum(shares, 1).astype(np.uint64)).astype(np.int64), -1)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(ids), pa.array(size.astype(np.int32)), pa.array(rest.astype(np.int32))], ["token", "salt", "id", "size", "rest"])

    return sets.select("id", "size", "prefix").mapInArrow(run, "token long, salt int, id long, size int, rest int")


def _cuts(size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where blocks begin: at each of ``first``, and where BLOCK sets or WEIGHT shingles are full."""
    out = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(size)]):
        while lo < hi:
            out.append(lo)
            lo += max(1, int(np.searchsorted(np.cumsum(size[lo : min(lo + BLOCK, hi)]), WEIGHT, "right")))
    return np.array(out, np.int64)


_GROUP = "token long, digest binary, ids array<long>, sizes array<long>, rests array<long>"


def _grouped(percent: int):
    """Of rows sorted by token, salt and size: small groups with a digest of their ids, and blocks of large ones without."""

    def emit(token: np.ndarray, first: np.ndarray, ids: np.ndarray, size: np.ndarray | None, rest: np.ndarray | None) -> pa.RecordBatch:
        ends = np.append(first, len(ids))
        if size is None:
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) ^ np.uint64(s)), dtype=np.uint64)]) for s in (0, 0x5DEECE66D)]
                both = np.stack([s[ends[1:]] - s[ends[:-1]] for s in sums], axis=1)
            digest = pa.array([row.tobytes() for row in both], pa.binary())
            none = pa.nulls(len(first), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(token[first]), digest, lists_of(ends, ids), none, none], ["token", "digest", "ids", "sizes", "rests"])
        return pa.RecordBatch.from_arrays([pa.array(token[first]), pa.nulls(len(first), pa.binary()), lists_of(ends, ids), lists_of(ends, size), lists_of(ends, rest)], ["token", "digest", "ids", "sizes", "rests"])

    def groups(rows: list[np.ndarray], going_on: bool) -> Iterator[pa.RecordBatch]:
        token, salt, ids, size, rest = rows
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
        first = np.flatnonzero(new)
        many, weight = np.diff(np.append(first, len(token))), np.add.reduceat(size, first)
        large = (salt[first] >= 0) | (many > BLOCK) | ((weight > WEIGHT) & (many > 2))
        large[0] |= going_on
        inside = np.repeat(large, many)
        if large.any():
            parts = [x[inside] for x in (token, ids, size, rest)]
            starts = np.concatenate([[0], np.cumsum(many[large])[:-1]])
            yield emit(parts[0], _cuts(parts[2], starts), *parts[1:])
        some = np.repeat(~large & (many > 1), many)
        code, token, ids, size, rest = (x[some] for x in (np.cumsum(new), token, ids, size, rest))
        partner = np.zeros(len(ids), bool)
        i = np.arange(len(ids))
        for lag in range(1, BLOCK):  # sorted by size, so a set too large ends the search
            i = i[i + lag < len(ids)]
            i = i[(code[i] == code[i + lag]) & (100 * size[i] >= percent * size[i + lag])]
            if not len(i):
                break
            fits = i[(100 + percent) * np.minimum(rest[i], rest[i + lag]) >= percent * (size[i] + size[i + lag])]
            partner[fits] = partner[fits + lag] = True
        code, token, ids = code[partner], token[partner], ids[partner]
        if len(ids):
            by_id = np.lexsort((ids, code))
            code, token, ids = code[by_id], token[by_id], ids[by_id]
            yield emit(token, np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])), ids, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going_on = [np.zeros(0, np.int64)] * 5, False
        for b in batches:
            held = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, b.columns)]
            if not len(held[0]):
                continue
            others = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(others):
                last = int(others[-1]) + 1
                yield from groups([h[:last] for h in held], going_on)
                held, going_on = [h[last:] for h in held], False
            while len(held[0]) > 8 * BLOCK:
                yield from groups([h[: 8 * BLOCK] for h in held], True)
                held, going_on = [h[8 * BLOCK :] for h in held], True
        if len(held[0]):
            yield from groups(held, going_on)

    return run


def _confirm(words: int, percent: int):
    """Of whole groups ``g`` of rows ``id, side, root, packed``: links between sets of different components, less those that others imply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "g"):
            g = whole.column("g").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            weight = np.cumsum([len(p) + EACH for p in whole.column("packed").to_pylist()])
            lo = 0
            while lo < len(g):
                later = new[(new > lo) & (weight[new - 1] - (weight[lo - 1] if lo else 0) > AT_ONCE)]
                hi = int(later[0]) if len(later) else len(g)
                links = np.array(list(_links(whole.slice(lo, hi - lo), words, percent)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(links.min(1)), pa.array(links.max(1))], ["a", "b"])
                lo = hi

    return run


def _forest(b: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each row's tree, one for each side of a group, and the trees that meet."""
    g, side = b.column("g").to_numpy(), b.column("side").to_numpy()
    trees, tree = np.unique(np.stack([g, side], axis=1), axis=0, return_inverse=True)
    pairs = [(k, k + 1) for k in range(len(trees) - 1) if trees[k, 1] == 1 and trees[k + 1, 0] == trees[k, 0]]
    return tree.ravel(), [(k, k) for k in np.flatnonzero(trees[:, 1] == 0)] + pairs


def _links(b: pa.RecordBatch, words: int, percent: int) -> Iterator[tuple[int, int]]:
    sets = [h[at[i] : at[i + 1]] for at, h in _sets_in(b, words) for i in range(len(at) - 1)]
    ids = b.column("id").to_numpy()
    names, part = np.unique(b.column("root").to_numpy(), return_inverse=True)
    above = list(range(len(names)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    tried: set[tuple[int, int]] = set()
    size, head = np.array([len(s) for s in sets], np.int64), np.array([s[0] for s in sets])
    for x, y in zip(*(v.tolist() for v in alike(signatures(sets), size, head, *_forest(b), percent))):
        p, q = top(part[x]), top(part[y])
        pair = (min(ids[x], ids[y]), max(ids[x], ids[y]))
        if p != q and pair not in tried:
            tried.add(pair)
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if (100 + percent) * both >= percent * (len(sets[x]) + len(sets[y])):
                above[p] = q
                yield pair


def _signatures_of(words: int):
    """``size, head, signature`` of each text's set; signatures are compressed."""

    def of(texts: pa.Array) -> list[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        sets = [h[at[i] : at[i + 1]] for at, h in sets_of(texts, words) for i in range(len(at) - 1)]
        head = np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(head), pa.array([squeeze(x.tobytes()) for x in signatures(sets)] if sets else [], pa.binary())]

    return of, "size long, head long, signature binary"


_PACKED = (lambda texts: [pa.array(pack(texts.to_pylist()), pa.binary())], "packed binary")


class Source:
    """What is made of the texts of some sets: ``named`` has ``doc_id, text_hash, text``, ``reps`` the ``id`` of each set and its document.

    A fixed number of bits tells most documents that aren't asked for before their texts are worked on or moved.
    """

    def __init__(self, named: DataFrame, reps: DataFrame):
        key = F.struct("doc_id", "text_hash")
        self.rows = named.select(F.xxhash64("doc_id", "text_hash").alias("k"), key.alias("of"), "text")
        self.reps = reps.select("id", F.xxhash64("doc_id", "text_hash").alias("k"), key.alias("key"))

    def of(self, ids: DataFrame, made: tuple[Callable[[pa.Array], list[pa.Array]], str]) -> DataFrame:
        make, shape = made
        names = [x.split()[0] for x in shape.split(", ")]
        needed = written(self.reps.join(ids, "id", "left_semi"), "needed")
        place = F.pmod(F.xxhash64("k"), F.lit(MARKS))
        marks = np.zeros(MARKS, bool)
        for r in needed.groupBy(F.bitmap_bucket_number(place + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect():  # MARKS / 8 bytes
            lo = (r.b - 1) * 8 * len(r.bits)
            marks[lo : lo + 8 * len(r.bits)] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        bits = np.packbits(marks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                at = whole.column("place").to_numpy()
                asked = whole.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
                for lo in range(0, len(asked), 500):
                    b = asked.slice(lo, 500)
                    yield pa.RecordBatch.from_arrays([b.column("k"), b.column("of"), *make(b.column("text"))], ["k", "of", *names])

        found = self.rows.select("k", "of", "text", place.alias("place")).mapInArrow(run, f"k long, of struct<doc_id: long, text_hash: long>, {shape}").join(needed, "k")
        same = F.col("of.doc_id").eqNullSafe(F.col("key.doc_id")) & (F.col("of.text_hash") == F.col("key.text_hash"))
        return found.filter(same).groupBy("k", "id").agg(*(F.first(n).alias(n) for n in names)).select("id", *names)


class PackedTexts:
    """A source of sets whose texts are at hand as ``id, packed``."""

    def __init__(self, texts: DataFrame):
        self.texts = texts

    def of(self, ids: DataFrame, made: tuple[Callable[[pa.Array], list[pa.Array]], str]) -> DataFrame:
        make, shape = made

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("id"), *make(unpack(b.column("packed")))], ["id", *(x.split()[0] for x in shape.split(", "))])

        return self.texts.join(ids, "id", "left_semi").mapInArrow(run, f"id long, {shape}")


def prefixed(texts: DataFrame, order: Order, words: int, percent: int) -> DataFrame:
    """``id, size, prefix`` of ``id, packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, prefix = [], []
            for at, h in _sets_in(b, words):
                size += np.diff(at).tolist()
                prefix += order.prefixes(at, h, percent)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(prefix, pa.binary())], ["id", "size", "prefix"])

    return texts.select("id", "packed").mapInArrow(run, "id long, size long, prefix binary")


def _hopeful(percent: int, at_once: int = 4096):
    """Of whole groups ``g`` of signed rows: the sets that may link with a set of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor().decompress
        for whole in whole_groups(batches, "g"):
            g = whole.column("g").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            lo = 0
            while lo < len(g):
                later = new[new >= lo + at_once]
                hi = int(later[0]) if len(later) else len(g)
                b = whole.slice(lo, hi - lo)
                lo = hi
                bits = np.frombuffer(b"".join(map(back, b.column("signature").to_pylist())), np.uint64).reshape(len(b), -1)
                root = b.column("root").to_numpy()
                x, y = alike(bits, b.column("size").to_numpy(), b.column("head").to_numpy(), *_forest(b), percent)
                apart = root[x] != root[y]
                some = np.zeros(len(b), bool)
                some[x[apart]] = some[y[apart]] = True
                yield b.select(["g", "side", "id", "root", "size"]).filter(pa.array(some))

    return run


def _gathered(hopeful: DataFrame) -> DataFrame:
    """The same sets in fewer groups: those that groups connect are one group, so that a text moves once, unless that were a large one."""
    order = Window.partitionBy("g").orderBy("id")
    links = hopeful.select("id", F.lead("id").over(order).alias("b"), "g").filter("id < b").select(F.col("id").alias("a"), "b").distinct()
    parts = components(written(links, "hopeful-links"))
    if parts is None:
        return hopeful.select("g", "side", "id", "root")
    named = written(hopeful.join(parts.select(F.col("node").alias("id"), F.col("root").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id")), "hopeful-parts")
    sets = named.groupBy("part", "id").agg(F.first("root").alias("root"), F.first("size").alias("size"))
    small = sets.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight")).filter((F.col("n") <= BLOCK) & (F.col("weight") <= 4 * WEIGHT)).select("part")
    one = sets.join(small, "part", "left_semi").select((-1 - F.col("part")).alias("g"), F.lit(0).alias("side"), "id", "root")
    return one.unionByName(named.join(small, "part", "left_anti").select("g", "side", "id", "root"))


def _decided(groups: DataFrame, source: Source | PackedTexts, signed: DataFrame, labels: DataFrame | None, words: int, percent: int) -> DataFrame | None:
    """Labels after the sets of each group (``g, side, ids``) have been joined; pairs of one component aren't looked at again."""
    rows = groups.select("g", "side", F.explode("ids").alias("id"))
    if labels is None:
        rows = rows.withColumn("root", F.col("id"))
    else:
        rooted = written(rows.join(labels.withColumnRenamed("node", "id"), "id", "left").select("g", "side", "id", F.coalesce("root", "id").alias("root")), "rooted-groups")
        mixed = rooted.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("g")
        rows = rooted.join(mixed, "g", "left_semi")
    whole = lambda df, run, shape: df.repartition("g").sortWithinPartitions("g").mapInArrow(run, shape)
    hopeful = written(whole(rows.join(signed, "id").select("g", "side", "id", "root", "size", "head", "signature"), _hopeful(percent), "g long, side int, id long, root long, size long"), "hopeful-sets")
    hopeful = _gathered(hopeful)
    texts = source.of(hopeful.select("id").distinct(), _PACKED)
    links = written(whole(hopeful.join(texts, "id").select("g", "side", "id", "root", "packed"), _confirm(words, percent), "a long, b long"), "links")
    return components(links.distinct() if labels is None else between(links, labels.select(F.col("node").alias("p_b"), F.col("root").alias("p_a"))), labels)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of large groups in blocks, sorted by component and size within a token; also split where a task's rows end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            if not len(b):
                continue
            token, root, ids, size, rest = (b.column(x).to_numpy() for x in ("token", "root", "id", "size", "rest"))
            first = _cuts(size, np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])))
            ends = np.append(first, len(token))
            block = part + done + np.arange(len(first))
            done += len(first)
            cols = [token[first], block, np.minimum.reduceat(size, first), np.maximum.reduceat(size, first), np.maximum.reduceat(rest, first), np.minimum.reduceat(root, first), np.maximum.reduceat(root, first)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), lists_of(ends, ids)], ["token", "block", "least", "most", "rest", "lo", "hi", "ids"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, "token", "root", "size", "id").sortWithinPartitions("token", "root", "size", "id")
    return written(sorted_.mapInArrow(run, "token long, block long, least long, most long, rest long, lo long, hi long, ids array<long>"), "blocks")


def joined(sets: DataFrame, source: Source | PackedTexts, order: Order, labels: DataFrame | None, words: int, percent: int) -> DataFrame | None:
    """Component labels of the sets after all links between them, as ``components`` gives them.

    ``sets`` has ``id, size, prefix`` by ``order``, ``source`` the texts of these ids; ``labels`` are those of links known already.
    """
    placed = _placed(sets, order).repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "id")
    met = written(placed.mapInArrow(_grouped(percent), _GROUP), "groups")
    small = met.filter("digest is not null").groupBy("digest").agg(F.first("ids").alias("ids")).select("ids")
    groups = written(small.unionByName(met.filter("digest is null").select("ids")).select(F.monotonically_increasing_id().alias("g"), F.lit(0).alias("side"), "ids"), "distinct-groups")
    signed = written(source.of(groups.select(F.explode("ids").alias("id")).distinct(), _signatures_of(words)), "signatures")
    first = groups.select("g", F.size("ids").alias("n"), F.explode("ids").alias("id")).groupBy("id").agg(F.max(F.struct("n", "g")).alias("x")).select("x.g").distinct()
    labels = _decided(groups.join(first, "g", "left_semi"), source, signed, labels, words, percent)
    labels = _decided(groups.join(first, "g", "left_anti"), source, signed, labels, words, percent)
    large = met.filter("digest is null")
    if not large.take(1):
        return labels

    rows = large.select("token", F.explode(F.arrays_zip("ids", "sizes", "rests")).alias("x")).select("token", F.col("x.ids").alias("id"), F.col("x.sizes").alias("size"), F.col("x.rests").alias("rest"))
    root = F.col("id").alias("root")
    rows = rows.select("*", root) if labels is None else rows.join(labels.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "size", "rest", F.coalesce("root", "id").alias("root"))
    blocks = _blocks(rows)
    a, b = (blocks.select(F.col("token").alias("token"), *(F.col(c).alias(f"{c}_{s}") for c in blocks.columns[1:])) for s in "ab")
    sizes = f"100 * most_a >= {percent} * least_b AND 100 * most_b >= {percent} * least_a AND {100 + percent} * least(rest_a, rest_b) >= {percent} * (least_a + least_b)"
    cells = a.join(b, "token").filter(f"block_a <= block_b AND least(lo_a, lo_b) <> greatest(hi_a, hi_b) AND {sizes}")
    cells = written(cells.select("block_a", "block_b", "ids_a", "ids_b"), "cells").withColumn("g", F.monotonically_increasing_id())
    same = F.col("block_a") == F.col("block_b")
    sides = F.when(same, F.array(F.struct(F.lit(0).alias("side"), F.col("ids_a").alias("ids")))).otherwise(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"ids_{c}").alias("ids")) for s, c in ((1, "a"), (2, "b")))))
    return _decided(cells.select("g", F.explode(sides).alias("x")).select("g", "x.*"), source, signed, labels, words, percent)


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``; documents link where 100 * intersection >= ``percent`` * union.

    Needs ``doc_id`` and ``text``; more columns are ignored. Documents with the same set are one set with the smallest of their ids; a
    component's id is the smallest of all its documents. A text of fewer than ``words`` words is one shingle. Null and empty texts have
    no shingles and are their own component, a null id counts only where there is no other, rows with the same id are judged by their
    texts, and an empty table gives an empty one. Long texts are taken whole.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    order = heavy_order(named, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, prefix = [], [], []
            for at, h in _sets_in(b, words):
                node += digests(at, h)
                size += np.diff(at).tolist()
                prefix += order.prefixes(at, h, percent)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "text_hash", "node", "n_shingles", "prefix"])

    sets = written(named.mapInArrow(run, "doc_id long, text_hash long, node binary, n_shingles long, prefix binary"), "sets")
    of = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("of")
    distinct = sets.filter("node is not null").groupBy("node").agg(of, F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"))
    reps = written(distinct.select("node", "of.doc_id", "of.text_hash", "size", "prefix", F.monotonically_increasing_id().alias("id")), "distinct-sets")
    labels = joined(reps, Source(named, reps), order, None, words, percent)
    return labelled(sets, reps.select("id", "node", F.col("doc_id").alias("owner_id")), labels).select("doc_id", "n_shingles", "component_id")
