"""Binary recordings: continuous samples and event records with a text header of 16 KiB.

Continuous files are read in ranges of records, a task for each; a record becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cortexlake.sources.ranges import RANGE, read_ranges

# Layouts of the records.
HEADER = 16384
SAMPLES = 512
CONTINUOUS = np.dtype([("ts", "<u8"), ("ch", "<u4"), ("fs", "<u4"), ("n", "<u4"), ("v", "<i2", (SAMPLES,))])
EVENT = np.dtype([("skip1", "V6"), ("ts", "<u8"), ("skip2", "V2"), ("ttl", "<i2"), ("rest", "V166")])
FALLBACK_VOLTS = 6.103515625e-8


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _volts() -> F.Column:
    header = F.decode("head", "ISO-8859-1")
    return F.coalesce(F.regexp_extract(header, r"-ADBitVolts\s+([0-9.eE+-]+)", 1).try_cast("double"), F.lit(FALLBACK_VOLTS))


def read_continuous(spark: SparkSession, path: str, pattern: str = "*.ncs", range_bytes: int = RANGE) -> DataFrame:
    """``path, rec_no, ts_us, ch, fs, n_valid, samples, bit_volts``, a task for each ``range_bytes`` of a file; a last record that isn't whole is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first, volts, content in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), b.column("volts").to_pylist(), b.column("content")):
                r = np.frombuffer(content.as_buffer(), CONTINUOUS)
                for lo in range(0, len(r), 4096):
                    x = r[lo : lo + 4096]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * SAMPLES), pa.array(np.ascontiguousarray(x["v"]).ravel()))
                    ints = [pa.array(x[k].astype(np.int64)) for k in ("ts", "ch", "fs", "n")]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(first + np.arange(lo, lo + len(x))), *ints, values, pa.array(np.full(len(x), volts))], ["path", "rec_no", "ts_us", "ch", "fs", "n_valid", "samples", "bit_volts"])

    schema = "path string, rec_no long, ts_us long, ch long, fs long, n_valid long, samples array<short>, bit_volts double"
    rows = read_ranges(spark, path, pattern, CONTINUOUS.itemsize, HEADER, range_bytes)
    return rows.select("path", "first", _volts().alias("volts"), "content").mapInArrow(run, schema)


def read_events(spark: SparkSession, path: str, pattern: str = "*.nev") -> DataFrame:
    """``path, ts_us, ttl`` of each event record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                raw = np.frombuffer(content.as_buffer(), np.uint8)[HEADER:]
                r = raw[: len(raw) // EVENT.itemsize * EVENT.itemsize].view(EVENT)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(r)), pa.array(r["ts"].astype(np.int64)), pa.array(r["ttl"].astype(np.int32))], ["path", "ts_us", "ttl"])

    return _files(spark, path, pattern).mapInArrow(run, "path string, ts_us long, ttl int")


def to_samples(records: DataFrame, drop_partial: bool = False) -> DataFrame:
    """``path, ch, i, mv``: valid samples in millivolts, one after the other through the records of a file; with ``drop_partial`` records that aren't full go.

    A record's first place is what the records before it hold. Whole records alone are counted by their number, so that only
    the records that aren't full, few as a rule, are summed up in order.
    """
    r = records.filter(F.col("n_valid") == SAMPLES) if drop_partial else records
    lack = records.filter(F.col("n_valid") < SAMPLES)
    order = Window.partitionBy("path", "ch").orderBy("rec_no")
    short = lack.select("path", "ch", F.col("rec_no").alias("_from"), F.sum((F.lit(0) if drop_partial else F.col("n_valid")) - SAMPLES).over(order).alias("_shift"), F.lead("rec_no").over(order).alias("_to"))
    steps = short.groupBy("path", "ch").agg(F.sort_array(F.collect_list(F.struct("_from", "_shift"))).alias("_steps"))
    before = F.element_at(F.filter("_steps", lambda s: s["_from"] < F.col("rec_no")), -1)["_shift"]
    placed = r.join(steps, ["path", "ch"], "left").withColumn("_first", F.col("rec_no") * SAMPLES + F.when(F.exists("_steps", lambda s: s["_from"] < F.col("rec_no")), before).otherwise(0))
    each = placed.select("path", "ch", "_first", "bit_volts", F.posexplode(F.slice("samples", 1, F.col("n_valid").cast("int"))).alias("k", "x"))
    return each.select("path", "ch", (F.col("_first") + F.col("k")).alias("i"), (F.col("x") * F.col("bit_volts") * 1000).alias("mv"))


def continuous_files(signal: DataFrame, fs: int, bit_volts: float, start_us: int = 0, header: str = "") -> DataFrame:
    """``ch, part, content``: the bytes of a file for each channel of ``ch, i, mv``, in parts of 4096 records to be joined in order; part 0 begins with the header.

    Values are rounded and clipped to 16 bits, missing samples are 0 and keep their place, a last record is filled up with zeros, and time
    stamps are even. A part without samples is left out.
    """
    size = 4096 * SAMPLES
    last = {int(r.ch): int(r.i) // size for r in signal.groupBy("ch").agg(F.max("i").alias("i")).collect()}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ch, part = int(key[0]), int(key[1])
        at = rows["i"].to_numpy() - part * size
        v = np.zeros(int(at.max()) + 1 if part == last.get(ch) else size, "<i2")
        v[at] = np.clip(np.rint(rows["mv"].to_numpy() / 1000 / bit_volts), -32768, 32767)
        n = -(-len(v) // SAMPLES)
        r = np.zeros(n, CONTINUOUS)
        r["ts"] = start_us + np.rint((part * size + np.arange(n) * SAMPLES) * 1e6 / fs).astype(np.uint64)
        r["ch"], r["fs"], r["n"] = ch, fs, SAMPLES
        r["n"][-1] = len(v) - (n - 1) * SAMPLES
        r["v"] = np.pad(v, (0, n * SAMPLES - len(v))).reshape(n, SAMPLES)
        text = f"{header}\n-SamplingFrequency {fs}\n-ADBitVolts {bit_volts}\n".encode("latin-1").ljust(HEADER, b"\0")[:HEADER] if part == 0 else b""
        return pd.DataFrame({"ch": [ch], "part": [part], "content": [text + r.tobytes()]})

    return signal.groupBy("ch", F.floor(F.col("i") / size).alias("part")).applyInPandas(run, "ch long, part long, content binary")


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """``name, value`` of the lines ``name = value;`` of text files; what follows a # is left out."""
    line = F.regexp_extract(F.regexp_replace("value", "#.*$", ""), r"^\s*(\w+)\s*=\s*(.*?)\s*;?\s*$", 1)
    value = F.regexp_extract(F.regexp_replace("value", "#.*$", ""), r"^\s*(\w+)\s*=\s*(.*?)\s*;?\s*$", 2)
    return spark.read.text(path).select(line.alias("name"), value.alias("value")).filter("name != ''")


def read_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV logs under ``path`` with the file each row comes from; lines that don't fit give nulls instead of an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path).withColumn("file", F.col("_metadata.file_name"))
