"""Merkle manifest of a table of documents, in DataFrame functions only.

The leaves of a language stand in ascending order and are cut into blocks of FAN ** LEVELS. A block is one array: ``transform`` over
``sequence`` hashes the ``slice`` of each run of FAN nodes, ``aggregate`` does so level by level, and the roots of the blocks are the
leaves of the next round, until one node is left for each language. The languages' roots are collapsed likewise. What leads from
a block's root to the top is the same for all its leaves, so it goes back down as one list of left and right siblings for each block.

Nothing holds more than a block: places come from a range-partitioned sort and the counts of its partitions, a language that holds
most of the rows is many blocks, and the rounds are written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortexlake.llm.scratch import written

FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS
#: Levels from the number of leaves: as many as leave one node, LEVELS at most.
_HEIGHT = "CASE " + " ".join(f"WHEN n <= {FAN**k} THEN {k}" for k in range(LEVELS)) + f" ELSE {LEVELS} END"
#: The arrays of all levels, from the leaves up.
_LEVELS = f"""aggregate(slice(sequence(1, {LEVELS}), 1, height), array(transform(members, m -> m.h)), (done, k) -> concat(done, array(
    transform(sequence(0, CAST((size(done[k - 1]) - 1) DIV {FAN} AS INT)), i -> sha2(array_join(slice(done[k - 1], i * {FAN} + 1, {FAN}), ''), 256)))))"""
#: Siblings left and right of leaf i, level by level; at level k its node is i DIV FAN ** k.
_PATH = f"""concat(transform(slice(sequence(0, {LEVELS - 1}), 1, height), k -> transform(array(CAST(shiftright(i, {FAN.bit_length() - 1} * k) AS INT)), j -> named_struct(
    'l', array_join(slice(levels[k], j - j % {FAN} + 1, j % {FAN}), ''), 'r', array_join(slice(levels[k], j + 2, {FAN - 1} - j % {FAN}), '')))[0]), up)"""


def _field(name: str, value: Column | None = None) -> Column:
    v = (F.col(name) if value is None else value).cast("string")
    return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, tampered``: the digest of each row, and the one of its tampered form if it is to be tampered with."""
    fixed = [_field("doc_id", F.col("doc_id").cast("long")), _field("source"), _field("lang"), _field("n_chars", F.col("n_chars").cast("long"))]
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    changed = F.when(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0, F.sha2(F.concat(*fixed, _field("text", F.translate("text", upper, lower))), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.sha2(F.concat(*fixed, _field("text")), 256).alias("leaf"), changed.alias("tampered"))


def _placed(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos``, each row's place from 0 in its group, and ``n``, the group's rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    rows = written(sorted_.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_count").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), (before - F.col("_first")).alias("_shift"), F.sum("_count").over(whole).alias("n"))
    return rows.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_g", "_shift")


def _collapsed(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks of nodes (``grp, pos, n, h`` and a leaf's own columns in ``own``), and ``grp, h`` of what remains of each group."""
    rounds: list[DataFrame] = []
    while True:
        blocks = nodes.groupBy("grp", F.expr(f"pos DIV {BLOCK}").alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "h", "own"))).alias("members"))
        rounds.append(written(blocks.withColumn("height", F.expr(_HEIGHT)).withColumn("levels", F.expr(_LEVELS)), f"{name}-{len(rounds)}"))
        nodes = rounds[-1].select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) DIV {BLOCK}").alias("n"), F.expr("levels[height][0]").alias("h"), F.lit(0).alias("own"))
        if not nodes.filter("n > 1").take(1):
            return rounds, nodes.select("grp", "h")


def _downwards(rounds: list[DataFrame], tops: DataFrame, keep: list[str], leaf: str) -> DataFrame:
    """``grp``, the columns ``keep`` of ``tops``, and the struct ``leaf`` of each member of the first round.

    ``tops`` has ``up``, the siblings from a group's root upwards; ``leaf`` is SQL over a member ``m`` and its whole ``path``.
    """
    paths = tops.withColumn("at", F.lit(0).cast("long"))
    for k, blocks in reversed(list(enumerate(rounds))):
        made = leaf if k == 0 else "named_struct('pos', m.pos, 'path', path)"
        here = blocks.join(paths.withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("at")))
        every = F.expr(f"transform(members, (m, i) -> transform(array({_PATH}), path -> {made})[0])")
        out = here.select("grp", *keep, F.explode(every).alias("x"))
        if k == 0:
            return out.select("grp", *keep, "x.*")
        paths = written(out.select("grp", *keep, F.col("x.pos").alias("at"), F.col("x.path").alias("up")), "paths")
    raise AssertionError("no rounds")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Needs ``doc_id, source, lang, n_chars, text``; more columns are ignored. A leaf is the digest of the row's values, ``-`` for a
    null; an empty text is ``0:``. Leaves ascend by ``doc_id`` in each language, a null id first, those of the same id by their digests,
    so repeated rows are leaves of their own with the same digest. Rows without a language are a group, the first one. A row
    without an id is never tampered with. A language of one row is its own subroot, one language's subroot is the root, and an empty
    table has an empty manifest. ``verified`` is false where tampering changes the text. Texts are hashed whole, whatever their length.
    """
    named = leaves(docs).withColumn("row", F.monotonically_increasing_id())
    nodes = _placed(written(named, "leaves"), "lang", ["doc_id", "leaf", "row"], "leaves-in-order")
    rounds, subroots = _collapsed(nodes.select(F.col("lang").alias("grp"), "pos", "n", F.col("leaf").alias("h"), F.struct("doc_id", "tampered").alias("own")), "blocks")
    ordered = _placed(subroots.select(F.lit(0).alias("all"), F.col("grp").alias("lang"), "h"), "all", ["lang"], "subroots")
    above, root = _collapsed(ordered.select(F.col("all").alias("grp"), "pos", "n", "h", F.struct("lang").alias("own")), "subroot-blocks")
    none = F.expr("CAST(array() AS array<struct<l: string, r: string>>)")
    tops = _downwards(above, root.select("grp", F.col("h").alias("root"), none.alias("up")), ["root"], "named_struct('lang', m.own.lang, 'subroot', m.h, 'up', path)")
    tops = written(tops.select(F.col("lang").alias("grp"), "subroot", "root", "up"), "subroot-paths")
    leaf = """named_struct('doc_id', m.own.doc_id, 'leaf', m.h, 'proof_sha256', sha2(array_join(transform(path, p -> p.l || p.r), ''), 256),
        'folded_root', aggregate(path, coalesce(m.own.tampered, m.h), (h, p) -> sha2(p.l || h || p.r, 256)))"""
    out = _downwards(rounds, tops, ["subroot", "root"], leaf)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(levels: int = 12) -> str:
    """The manifest in SQL, for up to 8 ** ``levels`` rows in a language; each level joins the runs of the one below."""
    field = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v})::VARCHAR || ':' || {v} END"
    fixed = " || ".join(map(field, ("doc_id::BIGINT::VARCHAR", "source", "lang", "n_chars::BIGINT::VARCHAR")))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    byte = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::BIGINT::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {byte}), 4294967295)"
    parts = [
        f"n0 AS (SELECT doc_id::BIGINT AS doc_id, lang, sha256({fixed} || {field('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({fixed} || {field(f"translate(text, '{upper}', '{lower}')")}) END AS tampered FROM documents)",
        "l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM n0)",
        "t0 AS MATERIALIZED (SELECT lang, pos, leaf AS h FROM l0)",
        "f0 AS MATERIALIZED (SELECT doc_id, lang, leaf, pos AS at, pos, '' AS proof, coalesce(tampered, leaf) AS h FROM l0)",
    ]

    def climb(t: str, f: str, key: str, k: int) -> list[str]:
        """Nodes and folds of level k + 1; a group with one node stays as it is."""
        count = f"(SELECT {key}, count(*) AS n FROM {t}{k} GROUP BY 1) c"
        runs = f"(SELECT {key}, pos // 8 AS run, string_agg(h, '' ORDER BY pos) AS hs, any_value(h) AS lone FROM {t}{k} GROUP BY 1, 2) r"
        left, right = "substr(hs, 1, 64 * (f.pos % 8)::INT)", "substr(hs, 64 * (f.pos % 8)::INT + 65)"
        return [
            f"{t}{k + 1} AS MATERIALIZED (SELECT r.{key}, run AS pos, CASE WHEN n = 1 THEN lone ELSE sha256(hs) END AS h FROM {runs} JOIN {count} ON c.{key} IS NOT DISTINCT FROM r.{key})",
            f"{f}{k + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (pos, proof, h), f.pos // 8 AS pos, CASE WHEN n = 1 THEN f.proof ELSE f.proof || {left} || {right} END AS proof, "
            f"CASE WHEN n = 1 THEN f.h ELSE sha256({left} || f.h || {right}) END AS h "
            f"FROM {f}{k} f JOIN {runs} ON r.{key} IS NOT DISTINCT FROM f.{key} AND run = f.pos // 8 JOIN {count} ON c.{key} IS NOT DISTINCT FROM f.{key})",
        ]

    for k in range(levels):
        parts += climb("t", "f", "lang", k)
    parts += [
        f"u0 AS MATERIALIZED (SELECT NULL::INT AS z, lang, h AS subroot, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM t{levels})",
        f"g0 AS MATERIALIZED (SELECT f.doc_id, f.leaf, u.subroot, NULL::INT AS z, u.pos, f.proof, f.h FROM f{levels} f JOIN u0 u ON u.lang IS NOT DISTINCT FROM f.lang)",
    ]
    for k in range(levels):
        parts += climb("u", "g", "z", k)
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, (SELECT h FROM u{levels}) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM u{levels}) AS verified FROM g{levels}"
