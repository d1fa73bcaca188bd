"""Best-fit packing planned on a histogram of lengths.

Every document is tokenized and cut into pieces of at most ``size`` tokens. Only the count of pieces per
length reaches the driver (``size`` numbers). Best-fit decreasing runs over these counts and gives slots:
"the pieces with ranks a to b within length n go to sequences s, s+1, ... at this offset". Pieces then find their
slot by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cortexlake.llm.scratch import written

SIZE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"


@lru_cache(2)
def _encoding(vocabulary: str):
    """The tokenizer of ``vocabulary``.json, read from the same vocabulary's ranks: the same ids several times as fast.

    Its added tokens are cut out of the text before anything else, as that tokenizer does.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, how many, first sequence, offset) of each run of slots.

    Sequences with the same free space are kept as runs of numbers, so the work depends on ``size`` and not on
    how many pieces there are. A sequence that takes a piece is the tightest one for the next piece of that length, so each one
    takes as many as fit before another is begun; of one run only the last may take fewer.
    """
    slots, free, spaces, opened = [], {}, [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(spaces, length)
            space = spaces[i] if i < len(spaces) else size
            each = space // length
            if i < len(spaces):
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[i]
            else:  # open as many new sequences as this length fills
                first, n = opened, -(-left // each)
                opened += n
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            for at, many, k in ((first, full, each), (first + full, 1, rest)):
                for j in range(k if many else 0):
                    slots.append((length, rank, many, at, size - space + j * length))
                    rank += many
                put(space - k * length, at, many if k else 0)
            used = full + (rest > 0)
            put(space, first + used, n - used)
            left -= full * each + rest
    return slots


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's pieces with the rank of each within its length and task.

    A document's ids are those of its whole text, in which the vocabulary's added tokens count as such, and then END_ID. If there are more than ``size``, its first piece
    takes what is left over after full ones. Null text counts as empty: one piece of one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        encode, added = encoding.encode_to_numpy, encoding.special_tokens_set
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            out = []
            ids_of = b.column("doc_id").to_pylist()
            for doc, text in zip(ids_of, b.column("text")):
                ids = np.append(encode(text.as_py() or "", allowed_special=added, disallowed_special=()), END_ID).astype("<u4")
                at, k = 0, 0
                cut = len(ids) % size or size
                while at < len(ids):
                    n = cut - at
                    out.append((doc, k, at, n, zlib.crc32(ids[at:cut].tobytes()), seen[n]))
                    seen[n] += 1
                    at, cut, k = cut, cut + size, k + 1
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.array(c, np.int64) if i else c, pa.int64()) for i, c in enumerate(cols)), pa.array(np.full(len(out), task), pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"],
            )

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, rank long, task long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Needs ``doc_id`` and ``text``; more columns are ignored. Rows with the same id are packed one by one, an empty
    table gives an empty one. The pieces (no texts) are written once to the shared folder: ranks are counted per
    task that wrote them, so they must not be computed twice. Only the histogram of lengths, of at most ``size``
    rows, comes to the driver, and only the plan made from it is broadcast.
    """
    spark = docs.sparkSession
    table = written(pieces(docs, size, vocabulary), "pieces")
    per_task = table.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, size), "length int, from_rank long, many long, first_sequence long, offset long")
    ranked = table.join(base.select("task", "length", "before"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    s = F.broadcast(slots).alias("s")
    at = F.col("rank") - F.col("s.from_rank")
    placed = ranked.alias("p").join(s, (F.col("p.length") == F.col("s.length")) & (at >= 0) & (at < F.col("s.many")))
    return placed.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("s.first_sequence") + at).alias("sequence_id"), F.col("s.offset").alias("offset"),
    )
