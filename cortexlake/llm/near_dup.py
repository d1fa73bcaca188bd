"""MinHash near-duplicates found with an LSH forest.

Every distinct shingle set has HASHES min-hashes. Each of TREES sorted orders looks at DEPTH of them, and no two orders begin
with the same ones. In an order, sets are compared with the neighbours that share the longest prefix with them: at
least LEAST_DEPTH hashes, and in a crowded region, where more than NEIGHBOURS others share that much, only the nearest and so
deepest ones. Each order is one range-partitioned sort, so a crowded region is split between tasks like any other rows. Sets of
crowded regions, where neighbours were left out, then go through an exact join among themselves, so that no link is lost to the
number of neighbours.

A sorted order is cut into short stretches, and a pair belongs to a stretch where it met. Candidates are confirmed on the full sets
stretch by stretch: each set's text goes once to each stretch where some pair of it is to be decided, so what is moved follows
the number of sets and not that of pairs, and nothing ever stands in a row for each pair. Pairs whose sets are already in one
component, or that have been decided before, aren't looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexlake.llm.bytetext import mix
from cortexlake.llm.links import between, components, lists_of, pack, unpack, whole_groups
from cortexlake.llm.scratch import numbered, written
from cortexlake.llm.set_join import PackedTexts, heavy_order, joined, prefixed
from cortexlake.llm.shingle_sets import digests, give_back, labelled, sets_of

WORDS = 5
#: Links need 100 * intersection >= percent * union.
PERCENT = 80
HASHES, TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS = 128, 32, 16, 4, 16
#: Hashes that stand together in an order; orders are made of DEPTH / GROUP such groups, the next one STEP groups further.
GROUP = HASHES // TREES
STEP = 10
#: Orders whose candidates are confirmed together.
BATCHES = ((0, 2), (2, 8), (8, TREES))
#: Sorted rows in a stretch, and at least in a sorted partition.
STRETCH, LEAST_ROWS = 128, 4096
#: Bits of the sketches that rule out pairs before their sets are intersected.
BITS = 8192

def _multipliers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _signatures(at: np.ndarray, h: np.ndarray) -> list[bytes | None]:
    """HASHES min-hashes of each set, two bytes each."""
    full = np.flatnonzero(at[1:] > at[:-1])
    out = np.empty((len(full), HASHES), ">u2")
    with np.errstate(over="ignore"):
        for k, a in enumerate(_multipliers(HASHES) if len(full) else ()):
            least = np.minimum.reduceat(h * a, at[full])
            out[:, k] = mix(least) >> np.uint64(48)
    sig: list[bytes | None] = [None] * (len(at) - 1)
    for i, row in zip(full, out):
        sig[i] = row.tobytes()
    return sig


def _sets(docs: DataFrame, signed: bool) -> DataFrame:
    """``doc_id, node, n_shingles`` and, if asked for, ``sig``; ``node`` stands for the set and is null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, sig = [], [], []
            for at, h in sets_of(b.column("text"), WORDS):
                node += digests(at, h)
                size += np.diff(at).tolist()
                sig += _signatures(at, h) if signed else []
            cols = [b.column("doc_id"), pa.array(node, pa.binary()), pa.array(size, pa.int64()), *([pa.array(sig, pa.binary())] if signed else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n_shingles", "sig"][: len(cols)])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node binary, n_shingles long" + ", sig binary" * signed)


def _tree_rows(reps: DataFrame) -> DataFrame:
    size = 2 * GROUP
    group = lambda g: F.expr(f"substring(sig, {1 + g % TREES * size}, {size})")
    keys = F.array(*(F.concat(F.unhex(F.lit(f"{t:02x}")), *(group(t + STEP * k) for k in range(DEPTH // GROUP))) for t in range(TREES)))
    return reps.select(F.explode(keys).alias("key"), "id", "size")


_PREFIX, _WIDTH = 1 + 2 * LEAST_DEPTH, 1 + 2 * DEPTH
_MET = "g long, t int, id long, earlier array<long>, crowded boolean, key binary, size long"


def _met(where: np.ndarray, tree: np.ndarray, ids: np.ndarray, lists: tuple[np.ndarray, np.ndarray], crowded: np.ndarray, keys: list | None = None, sizes: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(ids))
    return pa.RecordBatch.from_arrays(
        [pa.array(where, pa.int64()), pa.array(tree, pa.int32()), pa.array(ids, pa.int64()), lists_of(*lists), pa.array(crowded, pa.bool_()), none.cast(pa.binary()) if keys is None else pa.array(keys, pa.binary()), none.cast(pa.int64()) if sizes is None else pa.array(sizes, pa.int64())],
        ["g", "t", "id", "earlier", "crowded", "key", "size"],
    )


def _pairs_near(key: np.ndarray, size: np.ndarray, fresh: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (earlier, later) of neighbours, the later ones from ``fresh`` on, and which places are crowded.

    Sets whose sizes alone rule out a link aren't paired: no intersection is larger than the smaller, no union smaller than the larger.
    """
    head = np.ascontiguousarray(key[:, :_PREFIX]).view(f"V{_PREFIX}").ravel()
    x, y = [], []
    for lag in range(1, NEIGHBOURS + 1):
        i = np.arange(max(fresh - lag, 0), len(head) - lag)
        i = i[head[i] == head[i + lag]]
        i = i[100 * np.minimum(size[i], size[i + lag]) >= percent * np.maximum(size[i], size[i + lag])]
        x.append(i)
        y.append(i + lag)
    crowded = np.zeros(len(head), bool)
    if len(head) > NEIGHBOURS:
        crowded[NEIGHBOURS:] = head[NEIGHBOURS:] == head[:-NEIGHBOURS]
    return np.concatenate(x), np.concatenate(y), crowded


def _keys(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(-1, _WIDTH)


def _rows_met(x: np.ndarray, y: np.ndarray, where: np.ndarray, tree: np.ndarray, ids: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
    """A row for each place that has neighbours before it, with their ids, and one for each of those that has none of its own there."""
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    later, first = np.unique(y, return_index=True)
    ends = np.unique(np.stack([where[y], x]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
    own = np.zeros(len(ids), bool)
    own[later] = True
    bare = ~(own[ends[1]] & (where[ends[1]] == ends[0]))
    at = np.concatenate([later, ends[1][bare]])
    g = np.concatenate([where[later], ends[0][bare]])
    return _met(g, tree[at], ids[at], (np.concatenate([first, np.full(bare.sum() + 1, len(x))]), ids[x]), crowded[at])


def _neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """``g, t, id, earlier, crowded``: sets that met others in stretch ``g`` of order ``t``, and the ids before them that they met.

    ``rows`` are sorted within range partitions. The first and the last rows of each partition meet in a stretch of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId() << 32, 0
        key, ids, size = np.zeros((0, _WIDTH), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        start: list[tuple] = []

        def border(n: int, keys: np.ndarray, i: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            none = (np.zeros(len(i) + 1, np.int64), np.zeros(0, np.int64))
            return _met(np.full(len(i), n + 0xFFFFFFFF), keys[:, 0], i, none, np.zeros(len(i), bool), [k.tobytes() for k in keys], s)

        for b in batches:
            if not len(b):
                continue
            fresh = len(ids)
            key, ids, size = np.concatenate([key, _keys(b)]), np.concatenate([ids, b.column("id").to_numpy()]), np.concatenate([size, b.column("size").to_numpy()])
            if done < NEIGHBOURS:
                start.append((key[fresh:][: NEIGHBOURS - done], ids[fresh:][: NEIGHBOURS - done], size[fresh:][: NEIGHBOURS - done]))
            where = part + (np.arange(len(ids)) + done - fresh) // STRETCH
            x, y, crowded = _pairs_near(key, size, fresh, percent)
            done += len(ids) - fresh
            yield _rows_met(x, y, where, key[:, 0], ids, crowded)
            key, ids, size = key[-NEIGHBOURS:], ids[-NEIGHBOURS:], size[-NEIGHBOURS:]
        for head in start:
            yield border(part - (1 << 32), *head)
        yield border(part, key, ids, size)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches, "g"):
            key, ids, size, g = _keys(b), b.column("id").to_numpy(), b.column("size").to_numpy(), b.column("g").to_numpy()
            x, y, crowded = _pairs_near(key, size, 0, percent)
            same = g[x] == g[y]
            yield _rows_met(x[same], y[same], g, key[:, 0], ids, crowded)

    met = written(rows.mapInArrow(run, _MET), "met")
    borders = met.filter("key is not null").select("g", "key", "id", "size").repartition("g").sortWithinPartitions("g", "key", "id")
    cut = written(borders.mapInArrow(across, _MET), "met-at-borders")
    return met.filter("key is null").unionByName(cut).select("g", "t", "id", "earlier", "crowded")


def _sorted_orders(reps: DataFrame) -> DataFrame:
    n = max(1, min(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), reps.count() * TREES // LEAST_ROWS))
    return _tree_rows(reps).repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Numbers that are equal where all columns are."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        values, at = np.unique(c, return_inverse=True)
        out = out * (len(values) + 1) + at
    return out


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists and the row of each."""
    column = b.column(name)
    return column.flatten().to_numpy(), np.repeat(np.arange(len(b)), np.asarray(column.value_lengths().fill_null(0)))


def _by_owner(g: np.ndarray, owner: np.ndarray, partner: np.ndarray, names: list[str]) -> pa.RecordBatch:
    order = np.lexsort((partner, owner, g))
    g, owner, partner = g[order], owner[order], partner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(owner[first]), lists_of(np.append(first, len(g)), partner)], names)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole stretches: the pairs of different components, each at its larger id."""
    for b in whole_groups(batches, "g"):
        g, ids, root = (b.column(x).to_numpy() for x in ("g", "id", "root"))
        partner, row = _flat(b, "earlier")
        code = _codes(np.concatenate([g, g[row]]), np.concatenate([ids, partner]))
        order = np.argsort(code[: len(g)], kind="stable")
        its = root[order[np.searchsorted(code[: len(g)][order], code[len(g) :])]] if len(partner) else root[:0]
        live = its != root[row]
        own, partner = ids[row][live], partner[live]
        yield _by_owner(g[row][live], np.maximum(own, partner), np.minimum(own, partner), ["g", "id", "partners"])


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all pairs of a set: one stretch for each pair that hasn't been tried, the one where the set has most pairs."""
    for b in whole_groups(batches, "id"):
        tried = b.column("tried").to_numpy(zero_copy_only=False)
        g, ids = b.column("g").to_numpy(), b.column("id").to_numpy()
        partner, row = _flat(b, "partners")
        many = np.asarray(b.column("partners").value_lengths().fill_null(0))
        order = np.lexsort((g[row], -many[row], ~tried[row], partner, ids[row]))
        row, partner = row[order], partner[order]
        once = np.ones(len(row), bool)
        once[1:] = (ids[row][1:] != ids[row][:-1]) | (partner[1:] != partner[:-1])
        once &= ~tried[row]
        yield _by_owner(g[row][once], ids[row][once], partner[once], ["g", "id", "partners"])


def _with_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole stretches: the rows and an empty one for each partner without one."""
    for b in whole_groups(batches, "g"):
        g, ids = b.column("g").to_numpy(), b.column("id").to_numpy()
        partner, row = _flat(b, "partners")
        code = _codes(np.concatenate([g, g[row]]), np.concatenate([ids, partner]))
        _, at = np.unique(code, return_index=True)
        at = at[at >= len(g)] - len(g)
        first = np.concatenate([np.searchsorted(row, np.arange(len(g))), np.full(len(at) + 1, len(row))])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g, g[row][at]])), pa.array(np.concatenate([ids, partner[at]])), lists_of(first, partner)], ["g", "id", "partners"])


def _linked(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """The pairs (x, y) of sets that link, but for those that earlier ones connect already.

    Sketches have a bit for each member's hash. A bit that one of two sets lacks stands for a member of the other that isn't in
    it, so the sketches bound the intersection from above; only pairs that could link then are intersected.
    """
    size = np.array([len(s) for s in sets], np.int64)
    bits = np.zeros((len(sets), BITS), bool)
    bits[np.repeat(np.arange(len(sets)), size), (np.concatenate(sets) % np.uint64(BITS)).astype(np.int64)] = True
    sketch = np.packbits(bits, axis=1).view(np.uint64)
    del bits
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for lo in range(0, len(x), 2048):
        i, j = x[lo : lo + 2048], y[lo : lo + 2048]
        alone = [np.bitwise_count(sketch[p] & ~sketch[q]).sum(1, dtype=np.int64) for p, q in ((i, j), (j, i))]
        most = np.minimum(size[i] - alone[0], size[j] - alone[1])
        for p, q in zip(i[could := (100 + percent) * most >= percent * (size[i] + size[j])].tolist(), j[could].tolist()):
            if top(p) != top(q):
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if (100 + percent) * both >= percent * (len(sets[p]) + len(sets[q])):
                    root[top(p)] = top(q)
                    yield p, q


def _confirm(percent: int, at_once: int = 1 << 21):
    """Of whole stretches, with packed texts: links, less those that others of the stretch imply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "g"):
            g = whole.column("g").to_numpy()
            new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            weight = np.cumsum(np.asarray([len(p) for p in whole.column("packed").to_pylist()], np.int64))
            lo = 0
            while lo < len(g):
                later = new[(new > lo) & (weight[new - 1] - (weight[lo - 1] if lo else 0) > at_once)]
                hi = int(later[0]) if len(later) else len(g)
                b = whole.slice(lo, hi - lo)
                lo = hi
                sets = [h[at[i] : at[i + 1]] for at, h in sets_of(unpack(b.column("packed")), WORDS) for i in range(len(at) - 1)]
                ids, here = b.column("id").to_numpy(), b.column("g").to_numpy()
                partner, row = _flat(b, "partners")
                code = _codes(np.concatenate([here, here[row]]), np.concatenate([ids, partner]))
                order = np.argsort(code[: len(here)], kind="stable")
                other = order[np.searchsorted(code[: len(here)][order], code[len(here) :])] if len(partner) else row
                found = list(_linked(sets, row, other, percent)) if len(row) else []
                ends = np.array([(min(ids[p], ids[q]), max(ids[p], ids[q])) for p, q in found], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return run


def _round(met: DataFrame, texts: DataFrame, labels: DataFrame | None, tried: DataFrame | None, percent: int) -> tuple[DataFrame | None, DataFrame, bool]:
    """Labels and tried pairs after the pairs of ``met`` have been decided, and if there were new links."""
    shape = "g long, id long, partners array<long>"
    if labels is None:
        rooted = met.select("g", "id", "earlier", F.col("id").alias("root"))
    else:
        rooted = met.join(labels.withColumnRenamed("node", "id"), "id", "left").select("g", "id", "earlier", F.coalesce("root", "id").alias("root"))
    live = rooted.repartition("g").sortWithinPartitions("g").mapInArrow(_open, shape).withColumn("tried", F.lit(False))
    if tried is not None:
        live = live.unionByName(tried.withColumn("tried", F.lit(True)))
    chosen = written(live.repartition("id").sortWithinPartitions("id").mapInArrow(_assigned, shape), "tried-pairs")
    here = chosen.repartition("g").sortWithinPartitions("g").mapInArrow(_with_ends, shape)
    links = written(here.join(texts, "id").repartition("g").sortWithinPartitions("g").mapInArrow(_confirm(percent), "a long, b long"), "links")
    tried = chosen if tried is None else tried.unionByName(chosen)
    edges = links.distinct() if labels is None else between(links, labels.select(F.col("node").alias("p_b"), F.col("root").alias("p_a")))
    after = components(edges, labels)
    return after, tried, after is not labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Needs ``doc_id`` and ``text``; more columns are ignored. Documents with the same set are one node with the
    smallest of their ids; nodes link where 100 * intersection >= ``percent`` * union; a component's id is the smallest of all its
    documents. Null and empty texts have no shingles and are their own component, a null id counts only where there is no
    other (``component_id`` is then null and ``kept`` true), rows with the same id are judged by their texts, and an empty table
    gives an empty one.
    """
    sets = written(_sets(docs, True), "shingle-sets")
    distinct = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    reps = written(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")
    met = _neighbours(_sorted_orders(reps), percent)

    ends = met.select("id").distinct()
    needed = reps.select("id", "node", F.col("doc_id").alias("owner_id")).join(ends, "id", "left_semi")
    named = _named_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = named.join(needed, named.doc_id.eqNullSafe(needed.owner_id) & (named.digest == needed.node))
    texts = written(found.groupBy("id").agg(F.first("packed").alias("packed")), "candidate-texts")

    labels, tried = None, None
    for lo, hi in BATCHES:
        labels, tried, _ = _round(met.filter((F.col("t") >= lo) & (F.col("t") < hi)), texts, labels, tried, percent)
    crowded = written(met.filter("crowded").select("id").distinct(), "crowded")
    if crowded.take(1):
        crowd = written(texts.join(crowded, "id", "left_semi"), "crowded-texts")
        order = heavy_order(crowd, WORDS)
        labels = joined(prefixed(crowd, order, WORDS, percent), PackedTexts(crowd), order, labels, WORDS, percent)
    return labelled(sets, reps.select("id", "node", F.col("doc_id").alias("owner_id")), labels)


def _named_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` of the set, and the text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(lo, 500) for lo in range(0, len(whole), 500)):
                node = [x for at, h in sets_of(b.column("text"), WORDS) for x in digests(at, h)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node, pa.binary()), pa.array(pack(b.column("text").to_pylist()), pa.binary())], ["doc_id", "digest", "packed"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, packed binary")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id, one of them if several have it.

    Verdicts are on rows, so rows with the same id or none are judged one by one. Just the numbers of the others are joined back.
    """
    rows = numbered(docs)
    named = rows.select("_row", F.col("doc_id").cast("long").alias("_id"))
    parts = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("_row"), "component_id")
    found = written(parts.join(named, "_row"), "row-components")
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("x")).select("x._row")
    gone = found.select("_row").join(stays, "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)
