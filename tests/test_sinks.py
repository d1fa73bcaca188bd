"""Ranges of records, files of bytes, and workbooks, read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexlake.sources import files as fl
from cortexlake.sources import ranges
from cortexlake.sources.recordings import CONTINUOUS, HEADER, continuous_files, read_continuous, to_samples
from cortexlake.sources.workbooks import sheet_names, workbook


def test_a_file_is_read_in_ranges_of_whole_records(spark, tmp_path):
    x = np.arange(3000, dtype="<f4").reshape(1000, 3)
    (tmp_path / "a.xdat").write_bytes(b"h" * 10 + x.tobytes() + b"\1\2")
    (tmp_path / "b.txt").write_bytes(b"no")
    got = ranges.read_ranges(spark, str(tmp_path), "*.xdat", 12, header=10, size=12 * 400)
    assert got.rdd.getNumPartitions() == 3 and [(r.first, bytes(r.head), len(r.content)) for r in got.orderBy("first").collect()] == [(0, b"h" * 10, 4800), (400, b"h" * 10, 4800), (800, b"h" * 10, 2400)]
    assert b"".join(bytes(r.content) for r in got.orderBy("first").collect()) == x.tobytes()
    assert ranges.read_ranges(spark, f"file:{tmp_path}/b.txt", "*", 12).count() == 0


def test_readers_take_a_file_in_several_tasks(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 3)).astype("<f4")
    (tmp_path / "a.xdat").write_bytes(x.tobytes())
    whole, cut = (fl.read_interleaved(spark, str(tmp_path), 3, keep=[2], range_bytes=n) for n in (1 << 26, 12 * 300))
    assert cut.rdd.getNumPartitions() == 4 and np.allclose(fl.samples(cut).orderBy("i").toPandas()["v"], x[:, 1])
    assert fl.samples(whole).exceptAll(fl.samples(cut)).count() == 0


def test_record_files_are_written_in_one_piece(spark, tmp_path):
    signal = spark.range(5_000_000).select((F.col("id") % 2 + 1).alias("ch"), F.floor(F.col("id") / 2).alias("i"), (F.col("id") % 999 * 0.001).alias("mv"))
    parts = continuous_files(signal, 32000, 1e-7).select(F.format_string("CSC%d.ncs", "ch").alias("name"), "part", "content")
    ranges.save_files(parts, str(tmp_path / "out"))
    found = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert found == ["CSC1.ncs", "CSC2.ncs"] and (tmp_path / "out/CSC1.ncs").stat().st_size == HEADER + -(-2_500_000 // 512) * CONTINUOUS.itemsize
    records = read_continuous(spark, str(tmp_path / "out"), range_bytes=CONTINUOUS.itemsize * 2000)
    assert records.rdd.getNumPartitions() == 6
    back = to_samples(records).groupBy("ch").agg(F.count("*").alias("n"), F.max("i").alias("last"), F.max("mv").alias("top")).orderBy("ch").collect()
    assert [(r.ch, r.n, r.last) for r in back] == [(1, 2_500_000, 2_499_999), (2, 2_500_000, 2_499_999)] and all(abs(r.top - 0.998) < 1e-3 for r in back)


def test_a_failed_job_leaves_no_file_and_a_second_one_replaces(spark, tmp_path):
    out = tmp_path / "out"
    rows = lambda *x: spark.createDataFrame(list(x), "name string, part long, content binary")
    with pytest.raises(Exception, match="not the name of one file"):
        ranges.save_files(rows(("a.bin", 0, b"1"), ("../b.bin", 0, b"2")), str(out))
    assert list(out.iterdir()) == []
    ranges.save_files(rows(("a.bin", 1, b"56"), ("a.bin", 0, b"1234")), str(out))
    assert (out / "a.bin").read_bytes() == b"123456"
    ranges.save_files(rows(("a.bin", 0, b"9")), str(out))
    assert (out / "a.bin").read_bytes() == b"9" and len(list(out.iterdir())) == 1


@pytest.mark.parametrize("kind", ["nse", "nts", "nev"])
def test_records_of_other_kinds_round_trip(spark, tmp_path, kind):
    if kind == "nse":
        rows = spark.range(3000).select(F.lit("x").alias("file"), (F.col("id") * 10).alias("ts_us"), F.lit(2).alias("channel"), (F.col("id") % 4).alias("cell"), F.array(*[F.lit(k) for k in range(8)]).alias("features"), F.array(*[F.col("id") % 100 - k for k in range(32)]).alias("samples"))
    elif kind == "nts":
        rows = spark.range(3000).select(F.lit("x").alias("file"), (F.col("id") * 10).alias("ts_us"))
    else:
        rows = spark.range(3000).select(F.lit("x").alias("file"), (F.col("id") * 10).alias("ts_us"), (F.col("id") % 7 - 3).alias("ttl"))
    ranges.save_files(fl.record_files(rows.repartition(5), kind, per_part=700), str(tmp_path))
    back = fl.read_records(spark, str(tmp_path), kind)
    want = rows.drop("file").select(*(F.col(c).cast(t) for c, t in back.dtypes if c in rows.columns))
    assert back.count() == 3000 and want.exceptAll(back.select(want.columns)).count() == 0
    assert [r.ts_us for r in back.collect()] == [10 * k for k in range(3000)]


def test_sheet_names():
    long = "a" * 40
    assert sheet_names([long, long + "b", "A" * 40, "x/y", "x:y", ""]) == ["a" * 31, "a" * 29 + "~2", "A" * 29 + "~3", "x_y", "x_y~2", "Sheet"]


def test_workbook_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(k, f"r<{k}>&\"", k / 3 if k % 5 else None) for k in range(500)], "k int, name string, x double").repartition(7)
    two = spark.createDataFrame([(2, "ü")], "k int, name string")
    book = workbook({"First table of all with a long name": one, "Second": two, "None": two.limit(0)}, "k", F.when(F.col("name").contains("7"), "yellow"))
    ranges.save_files(book.withColumn("name", F.lit("b.xlsx")), str(tmp_path))
    cells = fl.read_workbook(spark, str(tmp_path))
    back = fl.sheet(cells, "First table of all with a long ", ["k", "name", "x"]).orderBy("row").collect()
    assert [(int(r.k), r.name, None if r.x is None else float(r.x)) for r in back] == [(k, f"r<{k}>&\"", k / 3 if k % 5 else None) for k in range(500)]
    assert [(r.k, r.name) for r in fl.sheet(cells, "Second", ["k", "name"]).collect()] == [("2", "ü")] and cells.filter("sheet = 'None'").count() == 0
