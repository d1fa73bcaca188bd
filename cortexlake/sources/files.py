"""Other files that laboratories keep: flat binary samples, arrays, record files, workbooks, probes, settings, cards.

Files of fixed-size records are read in ranges of records, a task for each. Other binary files come as one row per file and are
cut into blocks in the task that reads them; such a file has to fit into that task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexlake.functions import names as nm
from cortexlake.sources.ranges import RANGE, read_ranges
from cortexlake.sources.recordings import HEADER, read_continuous

#: Samples of one channel in a row.
BLOCK = 1 << 16
# Layouts of record files after their header, and what tells a format by its files.
RECORDS = {
    "nse": np.dtype([("ts_us", "<u8"), ("channel", "<u4"), ("cell", "<u4"), ("features", "<u4", (8,)), ("samples", "<i2", (32,))]),
    "nvt": np.dtype([("skip", "<u2", (3,)), ("ts_us", "<u8"), ("points", "<u4", (400,)), ("crc", "<i2"), ("x", "<i4"), ("y", "<i4"), ("angle", "<i4"), ("targets", "<i4", (50,))]),
    "nts": np.dtype([("ts_us", "<u8")]),
    "nev": np.dtype([("skip", "<i2", (3,)), ("ts_us", "<u8"), ("event_id", "<i2"), ("ttl", "<i2"), ("crc", "<i2"), ("dummy", "<i2", (2,)), ("extras", "<i4", (8,)), ("text", "S128")]),
}
FORMATS = (("neuralynx", r"\.(ncs|nev|nse|nvt)$"), ("neuronexus", r"\.xdat(\.json)?$"), ("openephys", r"(structure\.oebin|continuous\.dat)$"), ("nwb", r"\.nwb$"), ("array", r"\.(npy|mat)$"), ("table", r"\.(csv|xlsx|parquet)$"))


def _content(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def file_formats(paths: DataFrame) -> DataFrame:
    """``path, format`` of a listing by the files' names; ``unknown`` for others."""
    kind = F.lit("unknown")
    for name, pattern in reversed(FORMATS):
        kind = F.when(F.lower("path").rlike(pattern), name).otherwise(kind)
    return paths.select("path", kind.alias("format"))


def read_interleaved(spark: SparkSession, path: str, channels: int, dtype: str = "<f4", pattern: str = "*.xdat", keep: list[int] | None = None, scale: float = 1.0, range_bytes: int = RANGE) -> DataFrame:
    """``path, ch, start, v``: samples of files that hold all channels of a sample one after the other, in blocks of each channel.

    ``keep`` are the channels to read (from 1), ``scale`` is a sample's unit (bit volts of integers). A last sample that isn't whole goes.
    A file is read by a task for each ``range_bytes``.
    """
    wanted = [c - 1 for c in keep] if keep else list(range(channels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first, content in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), b.column("content")):
                grid = np.frombuffer(content.as_buffer(), dtype).reshape(-1, channels)
                for lo in range(0, len(grid), BLOCK):
                    part = [grid[lo : lo + BLOCK, c].astype(np.float64) * scale for c in wanted]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(wanted)), pa.array([c + 1 for c in wanted], pa.int32()), pa.array([first + lo] * len(wanted), pa.int64()), pa.array(part, pa.list_(pa.float64()))], ["path", "ch", "start", "v"])

    rows = read_ranges(spark, path, pattern, channels * np.dtype(dtype).itemsize, size=range_bytes)
    return rows.mapInArrow(run, "path string, ch int, start long, v array<double>")


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """``path, ch, start, v`` of two-dimensional arrays, a row for each channel; the shorter side holds the channels. Pickled arrays aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.float64)
                x = x if x.shape[0] <= x.shape[1] else x.T
                for c, row in enumerate(x):
                    starts = range(0, len(row), BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts)), pa.array([c + 1] * len(starts), pa.int32()), pa.array(list(starts), pa.int64()), pa.array([row[s : s + BLOCK] for s in starts], pa.list_(pa.float64()))], ["path", "ch", "start", "v"])

    return _content(spark, path, pattern).mapInArrow(run, "path string, ch int, start long, v array<double>")


def samples(blocks: DataFrame) -> DataFrame:
    """``path, ch, i, v`` of blocks."""
    return blocks.select("path", "ch", "start", F.posexplode("v").alias("k", "v")).select("path", "ch", (F.col("start") + F.col("k")).alias("i"), "v")


def read_records(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE) -> DataFrame:
    """Records of spike (``nse``), tracking (``nvt``), time stamp (``nts``) and event (``nev``) files with the file each is from; skipped fields are left out."""
    layout = RECORDS[kind]
    fields = [f for f in layout.names if f not in ("skip", "crc", "dummy")]
    is_text = lambda f: layout[f].kind == "S"
    sql = ", ".join(f"{f} string" if is_text(f) else f"{f} array<long>" if layout[f].shape else f"{f} long" for f in fields)

    def column(x: np.ndarray) -> pa.Array:
        if x.dtype.kind == "S":
            return pa.array([t.split(b"\0")[0].decode("latin-1") for t in x.tolist()], pa.string())
        return pa.array(list(x.astype(np.int64)), pa.list_(pa.int64())) if x.ndim > 1 else pa.array(x.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                r = np.frombuffer(content.as_buffer(), layout)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(r), pa.string()), *(column(r[f]) for f in fields)], ["path", *fields])

    return read_ranges(spark, path, f"*.{kind}", layout.itemsize, HEADER, range_bytes).mapInArrow(run, f"path string, {sql}")


def record_files(records: DataFrame, kind: str, header: str = "", per_part: int = 1 << 16) -> DataFrame:
    """``name, part, content``: the bytes of a file ``file.kind`` for each ``file`` of ``records``, records by time; part 0 begins with the header.

    Fields that ``records`` lack are 0 or empty. Parts are about ``per_part`` records, ranges of time, so that no file is one task's until it is saved.
    """
    layout = RECORDS[kind]
    given = [f for f in layout.names if f in records.columns]
    head = f"{header}\n".encode("latin-1").ljust(HEADER, b"\0")[:HEADER]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, p in enumerate(parts):
            out = []
            for name, rows in p.groupby("file", sort=False):
                r = np.zeros(len(rows), layout)
                for f in given:
                    r[f] = [x.encode("latin-1") for x in rows[f]] if layout[f].kind == "S" else np.stack(rows[f].tolist()) if layout[f].shape else rows[f].to_numpy()
                out.append((f"{name}.{kind}", TaskContext.get().partitionId() << 32 | k + 1, r.tobytes()))
            yield pd.DataFrame(out, columns=["name", "part", "content"])

    n = max(1, -(-records.count() // per_part))
    body = records.select("file", *given).repartitionByRange(n, "file", "ts_us").sortWithinPartitions("file", "ts_us").mapInPandas(run, "name string, part long, content binary")
    heads = records.select(F.concat("file", F.lit(f".{kind}")).alias("name")).distinct().select("name", F.lit(0).cast("long").alias("part"), F.lit(head).alias("content"))
    return heads.unionByName(body)


def extracted(records: DataFrame, fields: list[str], mode: str = "all", values: list[int] | None = None) -> DataFrame:
    """Some fields of some records: ``all``, a range of record numbers or times (ends included), or lists of them.

    A list of numbers keeps its order in ``place``; numbers without a record are left out.
    """
    column = "rec_no" if mode.startswith("index") else "ts_us"
    if mode == "all":
        return records.select(*fields)
    if mode.endswith("range"):
        return records.filter(F.col(column).between(*values)).select(*fields)
    listed = records.sparkSession.createDataFrame(list(enumerate(values)), f"place int, {column} long")
    return records.join(F.broadcast(listed), column).select("place", *fields)


def read_workbook(spark: SparkSession, path: str, header_row: int = 1, pattern: str = "*.xlsx") -> DataFrame:
    """``path, sheet, position, row, name, value``: the cells below the header row of every sheet, as text, by the header above them.

    ``position`` is the sheet's place in the book, from 0. A sheet's cells are found by its relation, so the order of the files in the book doesn't matter.
    """
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def cells(content: bytes) -> Iterator[tuple[str, int, int, str, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            for k, listed in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", ns)):
                sheet, target = listed.get("name"), targets[listed.get(relation)]
                if "worksheets/" not in target:
                    continue  # a sheet of charts has no cells
                header: dict[str, str] = {}
                for c in ElementTree.fromstring(book.read(target[1:] if target.startswith("/") else f"xl/{target}")).iter(f"{{{ns['m']}}}c"):
                    letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    value = c.find("m:v", ns)
                    shown = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                    if int(row) == header_row and shown is not None:
                        header[letters] = shown
                    elif int(row) > header_row and shown is not None and letters in header:
                        yield sheet, k, int(row), header[letters], shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = list(zip(*cells(content))) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0]), pa.string()), *(pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], ["path", "sheet", "position", "row", "name", "value"])

    return _content(spark, path, pattern).mapInArrow(run, "path string, sheet string, position long, row long, name string, value string")


def sheet(cells: DataFrame, name: str | None, columns: list[str]) -> DataFrame:
    """A sheet of read_workbook() as a table; without one of that name, the book's first with cells. Missing cells are null."""
    first = cells.groupBy("path").agg(F.max(F.when(F.col("sheet") == name, F.col("position"))).alias("named"), F.min("position").alias("least"))
    own = cells.join(first, "path").filter(F.col("position") == F.coalesce("named", "least"))
    return own.groupBy("path", "row").pivot("name", columns).agg(F.first("value"))


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """``contact, shank, x, y`` of probe files in JSON: ``{"contacts": [{"id": .., "shank": .., "x": .., "y": ..}]}``."""
    schema = "contacts array<struct<id long, shank string, x double, y double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("contacts").alias("c")).select(F.col("c.id").alias("contact"), "c.shank", "c.x", "c.y")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``name, value`` of the scalar settings of JSON files, nested names joined by a point down to the second level."""
    flat = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))
    nested = flat.withColumn("inner", F.when(F.col("value").startswith("{"), F.from_json("value", "map<string,string>")))
    deep = nested.filter("inner is not null").select("name", F.explode("inner").alias("k", "value")).select(F.concat_ws(".", "name", "k").alias("name"), "value")
    return nested.filter("inner is null").select("name", "value").unionByName(deep)


def read_cards(spark: SparkSession, path: str, token: str = "Cage Card", most: int = 3) -> DataFrame:
    """Cards of text dumps, cut at ``token``; pages are parted by form feeds, and a page has ``most`` cards, as its layout allows."""
    pages = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\f")).alias("page", "text"))
    cards = pages.select("page", F.posexplode(F.slice(F.split("text", token), 2, most)).alias("card", "text"))
    return cards.select("page", "card", *(c.alias(n) for n, c in nm.card(F.col("text")).items()))


def read_logs_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all CSV logs under ``path`` that fit the schema, with their files; and the files with lines that don't: their number, and what could be read of one."""
    read = spark.read.schema(f"{schema}, _bad string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path).withColumn("file", F.col("_metadata.file_name"))
    bad = read.filter("_bad is not null").groupBy("file").agg(F.count(F.lit(1)).alias("n_bad"), F.min(F.struct(*(c for c in read.columns if c not in ("_bad", "file")))).alias("example"))
    return read.filter("_bad is null").drop("_bad"), bad


def slice_of(signal: DataFrame, channels: list[int], start: int, stop: int) -> DataFrame:
    """Samples ``start`` to ``stop`` (not included) of some channels; on a table kept by write_signal() only their partitions are read."""
    return signal.filter(F.col("ch").isin(channels) & (F.col("i") >= start) & (F.col("i") < stop))


def write_signal(signal: DataFrame, path: str, session: str) -> None:
    """``ch, i, v`` as Parquet by session and channel, each sorted by sample."""
    signal.withColumn("session", F.lit(session)).repartitionByRange("ch", "i").sortWithinPartitions("ch", "i").write.mode("append").partitionBy("session", "ch").parquet(path)


def write_groups(df: DataFrame, path: str, group: str) -> None:
    """One folder of CSV files for each value of ``group``."""
    df.repartition(group).write.mode("overwrite").option("header", True).partitionBy(group).csv(path)


def patched_header(content: Column, fs: int) -> Column:
    """A file's bytes with another sampling rate in the header, which keeps its size."""
    text = F.decode(F.substring(content, 1, HEADER), "ISO-8859-1")
    new = F.regexp_replace(F.rtrim(F.translate(text, "\x00", " ")), r"-SamplingFrequency\s+\S+", f"-SamplingFrequency {fs}")
    return F.concat(F.encode(F.rpad(new, HEADER, "\x00"), "ISO-8859-1"), F.substring(content, F.lit(HEADER + 1), F.length(content)))


def sorter_blocks(signal: DataFrame, channels: int, unit: float = 0.195, block: int = 1 << 16) -> DataFrame:
    """``block, content``: 16-bit integers of all channels of a sample one after the other, in blocks to be joined in order.

    Missing samples and blocks are 0, so each sample keeps its place; only the last block is shorter, up to the last sample. A channel
    outside 1 to ``channels`` is an error.
    """
    end = signal.agg(F.max("i")).first()[0]
    end = -1 if end is None else int(end)
    count = -(-(end + 1) // block)

    def run(key: tuple, places: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        lo = int(key[0]) * block
        grid = np.zeros((min(block, end + 1 - lo), channels), "<i2")
        if len(rows):
            if not rows["ch"].between(1, channels).all():
                raise ValueError(f"a channel outside 1 to {channels}")
            grid[rows["i"].to_numpy() - lo, rows["ch"].to_numpy() - 1] = np.clip(np.rint(rows["v"].fillna(0).to_numpy() / unit), -32768, 32767)
        return pd.DataFrame({"block": [int(key[0])], "content": [grid.tobytes()]})

    every = signal.sparkSession.range(count).withColumnRenamed("id", "block")
    placed = signal.select(F.floor(F.col("i") / block).alias("block"), "ch", "i", "v")
    return every.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(run, "block long, content binary")


def write_parts(parts: DataFrame, path: str, name: str, order: str) -> None:
    """Byte parts (``name`` tells the file, ``order`` their place in it) as files ``name=/part-*``, to be joined in order by name."""
    parts.select(name, order, "content").repartition(name).sortWithinPartitions(name, order).write.mode("overwrite").partitionBy(name).parquet(path)


def read_openephys(spark: SparkSession, path: str, keep: list[str] | None = None) -> DataFrame:
    """``path, stream, fs, ch, name, kind, start, v``: streams of folders with a ``structure.oebin``, in blocks of each channel.

    That file tells a stream's rate, channels and their bit volts (µV); ``kind`` is ``primary``, ``adc``, ``dac`` or ``other`` by the channel's name, and what a ``dac`` channel holds is cut to 0 to 1.
    ``keep`` are the kinds to read. A last sample that isn't whole goes. A folder without streams is an error.
    """
    stream = "struct<folder_name: string, sample_rate: double, channels: array<struct<channel_name: string, bit_volts: double>>>"
    reader = spark.read.schema(f"continuous array<{stream}>").option("multiLine", True).option("pathGlobFilter", "structure.oebin")
    told = reader.option("recursiveFileLookup", "true").json(path)
    told = told.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("root"), F.explode("continuous").alias("c"))
    told = told.select(F.concat_ws("/", "root", F.lit("continuous"), F.rtrim("c.folder_name", F.lit("/")), F.lit("continuous.dat")).alias("_path"), F.rtrim("c.folder_name", F.lit("/")).alias("stream"), F.col("c.sample_rate").alias("fs"), F.col("c.channels").alias("channels"))
    if not told.take(1):
        raise ValueError("no structure.oebin with streams")
    kind = lambda c: F.when(c["channel_name"].rlike(r"^CH?\d"), "primary").when(c["channel_name"].rlike(r"^ADC\d"), "adc").when(c["channel_name"].rlike(r"^DAC\d"), "dac").otherwise("other")
    told = told.select("_path", "stream", "fs", F.transform("channels", lambda c: F.struct(c["channel_name"].alias("name"), c["bit_volts"].alias("volts"), kind(c).alias("kind"))).alias("channels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, of, fs, channels, content in zip(b.column("path").to_pylist(), b.column("stream").to_pylist(), b.column("fs").to_pylist(), b.column("channels").to_pylist(), b.column("content")):
                flat = np.frombuffer(content.as_buffer(), np.uint8)
                grid = flat[: len(flat) // (2 * len(channels)) * 2 * len(channels)].view("<i2").reshape(-1, len(channels))
                wanted = [(k, c) for k, c in enumerate(channels) if keep is None or c["kind"] in keep]
                for lo in range(0, len(grid) if wanted else 0, BLOCK):
                    n = len(wanted)
                    part = [grid[lo : lo + BLOCK, k].astype(np.float64) * c["volts"] for k, c in wanted]
                    part = [np.clip(x, 0, 1) if c["kind"] == "dac" else x for x, (_, c) in zip(part, wanted)]
                    cols = [pa.array([name] * n), pa.array([of] * n), pa.array([fs] * n, pa.float64()), pa.array([k + 1 for k, _ in wanted], pa.int32()), pa.array([c["name"] for _, c in wanted]), pa.array([c["kind"] for _, c in wanted]), pa.array([lo] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(part, pa.list_(pa.float64()))], ["path", "stream", "fs", "ch", "name", "kind", "start", "v"])

    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    files = _content(spark, path, "continuous.dat")
    both = files.join(F.broadcast(told), plain(files.path) == plain(F.col("_path"))).select("path", "stream", "fs", "channels", "content")
    return both.mapInArrow(run, "path string, stream string, fs double, ch int, name string, kind string, start long, v array<double>")


READERS = {"neuralynx": read_continuous, "neuronexus": read_interleaved, "openephys": read_openephys, "array": read_arrays}


def read_recording(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Reads a folder by its files' format; a folder of several formats or of one without a reader is an error."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    kinds = [r.format for r in file_formats(listed).select("format").distinct().limit(10).collect() if r.format in READERS]
    if len(kinds) != 1:
        raise ValueError(f"formats with a reader: {sorted(kinds)}")
    return READERS[kinds[0]](spark, path, **options)
