"""Documents as sets of shingle hashes: the sets, their digests, and each document's component once the sets have theirs."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexlake.llm.bytetext import chunks, distinct_in_text, mix, shingle_hashes

#: Bytes of text hashed at a time; the arrays for them are some twenty times as large.
AT_ONCE = 1 << 19


def give_back() -> None:
    """Hands freed memory back to the system at a task's end: Python workers live on through later stages, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sets_of(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts, in order: where each text's hashes begin (one more: the end), and the distinct hashes."""
    for c in chunks(texts, AT_ONCE):
        w = c.words(lower=True)
        h, first = shingle_hashes(w, words)
        doc, h = distinct_in_text(w.doc[first], h)
        yield np.searchsorted(doc, np.arange(len(c) + 1)), h


def digests(at: np.ndarray, h: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set that depend on nothing but its members; None for an empty set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (h, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
        both = np.stack([mix(s[at[1:]] - s[at[:-1]] + np.diff(at).astype(np.uint64)) for s in sums], axis=1)
    raw = both.astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if at[i + 1] > at[i] else None for i in range(len(at) - 1)]


def labelled(sets: DataFrame, owner: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        least = owner.select("node", F.col("owner_id").alias("component_id"))
    else:
        rooted = owner.join(roots.withColumnRenamed("node", "id"), "id", "left").select("node", "owner_id", F.coalesce("root", "id").alias("root"))
        smallest = rooted.groupBy("root").agg(F.min("owner_id").alias("component_id"))
        least = rooted.select("node", "root").join(smallest, "root").select("node", "component_id")
    full = sets.select("doc_id", "node", "n_shingles").join(least, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
