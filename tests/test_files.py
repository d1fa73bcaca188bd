"""Readers and writers on small files made here."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexlake.sources import files as fl
from cortexlake.sources.recordings import HEADER, continuous_files, read_continuous, to_samples


def test_interleaved_samples_and_format(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 3)).astype("<f4")
    (tmp_path / "a.xdat").write_bytes(x.tobytes() + b"\1\2")
    out = fl.samples(fl.read_recording(spark, str(tmp_path), channels=3, keep=[1, 3])).toPandas().sort_values(["ch", "i"])
    assert len(out) == 2000 and np.allclose(out[out.ch == 3].v.to_numpy(), x[:, 2])
    (tmp_path / "b.npy").write_bytes(b"x")
    with pytest.raises(ValueError):
        fl.read_recording(spark, str(tmp_path))


def test_arrays_with_channels_on_the_shorter_side(spark, tmp_path):
    x = np.arange(40.0).reshape(20, 2)
    np.save(tmp_path / "x.npy", x)
    out = fl.samples(fl.read_recording(spark, str(tmp_path))).toPandas().sort_values(["ch", "i"])
    assert (out.v.to_numpy() == x.T.ravel()).all() and (out.ch.to_numpy() == np.repeat([1, 2], 20)).all()


@pytest.mark.parametrize("kind", sorted(fl.RECORDS))
def test_record_files(spark, tmp_path, kind):
    r = np.zeros(5, fl.RECORDS[kind])
    r["ts_us"] = np.arange(5) * 10
    if kind == "nse":
        r["samples"] = np.arange(160).reshape(5, 32) - 50
    (tmp_path / f"x.{kind}").write_bytes(b"h" * HEADER + r.tobytes() + b"\0")
    out = fl.read_records(spark, str(tmp_path), kind).orderBy("ts_us").collect()
    assert [x.ts_us for x in out] == [0, 10, 20, 30, 40] and (kind != "nse" or out[1].samples == list(range(-18, 14)))


def test_fields_and_modes_of_continuous_records(spark, tmp_path):
    signal = spark.range(2000).select(F.lit(4).cast("long").alias("ch"), F.col("id").alias("i"), F.sin("id").alias("mv"))
    (content,) = [r.content for r in continuous_files(signal, 1000, 1e-6).collect()]
    (tmp_path / "c.ncs").write_bytes(bytes(content))
    rec = read_continuous(spark, str(tmp_path))
    assert fl.extracted(rec, ["rec_no"]).count() == 4
    assert [r.rec_no for r in fl.extracted(rec, ["rec_no"], "index range", [1, 2]).orderBy("rec_no").collect()] == [1, 2]
    assert [r.rec_no for r in fl.extracted(rec, ["rec_no"], "index list", [3, 0, 9]).orderBy("place").collect()] == [3, 0]
    assert fl.extracted(rec, ["ts_us"], "time range", [0, 600_000]).count() == 2 and fl.extracted(rec, ["ts_us"], "time list", [512_000]).count() == 1
    patched = spark.read.format("binaryFile").load(str(tmp_path)).select(fl.patched_header(F.col("content"), 2500).alias("b")).first().b
    assert len(patched) == len(content) and b"-SamplingFrequency 2500" in patched[:HEADER] and patched[HEADER:] == content[HEADER:]


def test_workbook_with_several_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} {r}><sheets><sheet name="Zeta" r:id="r7"/><sheet name="Charts" r:id="r8"/><sheet name="Alpha" r:id="r9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r9" Target="worksheets/sheet1.xml"/><Relationship Id="r8" Target="chartsheets/sheet1.xml"/><Relationship Id="r7" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>Re</t></r><r><t>gion</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>m1</t></is></c><c r="B2"><v>3.5</v></c></row><row><c r="B3"><v>4</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    cells = fl.read_workbook(spark, str(tmp_path))
    for name in ("Zeta", "Absent"):
        rows = fl.sheet(cells, name, ["Name", "Region"]).orderBy("row").collect()
        assert [(r.Name, r.Region) for r in rows] == [("m1", "3.5"), (None, "4")]
    assert [(r.position, r.value) for r in cells.filter("sheet = 'Alpha'").collect()] == [(2, "7")]


def test_probe_settings_cards_and_logs(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"contacts": [{"id": 0, "shank": "a", "x": 0, "y": 25.5}]}, indent=1))
    assert [tuple(r) for r in fl.read_probe(spark, str(tmp_path / "p.json")).collect()] == [(0, "a", 0.0, 25.5)]
    (tmp_path / "s.json").write_text('{"main": {"fs": 30000, "out": "x"}, "n": 2}')
    assert dict(map(tuple, fl.read_settings(spark, str(tmp_path / "s.json")).collect())) == {"main.fs": "30000", "main.out": "x", "n": "2"}
    card = "Cage Card FX0-{} Sex: Male Strain: C57 DOB 1/2/23 Notes: ok Created x\n"
    (tmp_path / "t.txt").write_text("head\n" + "".join(card.format(k) for k in range(4)) + "\f" + card.format(9))
    cards = fl.read_cards(spark, str(tmp_path / "t.txt")).orderBy("page", "card").collect()
    assert [c.cage for c in cards] == ["FX0-0", "FX0-1", "FX0-2", "FX0-9"] and cards[0].sex == "Male" and cards[0].dob == "1/2/23"
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.csv").write_text("k,v\n1,2.5\n2,x\n")
    (tmp_path / "logs/b.csv").write_text("k,v\n3,1\n")
    good, bad = fl.read_logs_checked(spark, str(tmp_path / "logs"), "k int, v double")
    good, bad = good.cache(), bad.collect()
    assert sorted(r.k for r in good.collect()) == [1, 3] and [(r.file, r.n_bad, r.example.k) for r in bad] == [("a.csv", 1, 2)]


def test_written_signals_and_sorter_bytes(spark, tmp_path):
    signal = spark.range(300).select((F.col("id") % 3 + 1).cast("int").alias("ch"), F.floor(F.col("id") / 3).alias("i"), (F.col("id") * 0.195).alias("v"))
    fl.write_signal(signal, str(tmp_path / "s"), "m1s1")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert fl.slice_of(back, [2], 10, 13).count() == 3 and "PartitionFilters: [ch" in fl.slice_of(back, [2], 10, 13)._jdf.queryExecution().toString().replace("isnotnull(ch", "ch").replace("(ch", "ch")
    parts = fl.sorter_blocks(signal, 3, block=64).orderBy("block").collect()
    assert (np.frombuffer(b"".join(p.content for p in parts), "<i2") == np.arange(300)).all()
    fl.write_groups(signal.limit(9), str(tmp_path / "g"), "ch")
    assert spark.read.option("header", True).csv(str(tmp_path / "g")).count() == 9
    fl.write_parts(fl.sorter_blocks(signal, 3, block=64).withColumn("file", F.lit("a")), str(tmp_path / "b"), "file", "block")
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_sorter_bytes_keep_every_sample_in_its_place(spark):
    signal = spark.range(500).select(F.lit(1).alias("ch"), F.col("id").alias("i"), (F.col("id") * 0.195).alias("v"))
    for gone in ("i between 60 and 63", "i between 64 and 200", "i > 450"):
        parts = fl.sorter_blocks(signal.filter(f"not ({gone})"), 1, block=64).orderBy("block").collect()
        want = np.arange(500)
        a, b = {"i between 60 and 63": (60, 64), "i between 64 and 200": (64, 201), "i > 450": (451, 500)}[gone]
        want[a:b] = 0
        assert (np.frombuffer(b"".join(p.content for p in parts), "<i2") == (want[:451] if b == 500 else want)).all()
    with pytest.raises(Exception, match="outside 1 to 1"):
        fl.sorter_blocks(signal.withColumn("ch", F.lit(2)), 1).collect()
    assert fl.sorter_blocks(signal.filter("false"), 1).count() == 0


def test_streams_of_a_folder_by_its_structure(spark, tmp_path):
    x = np.random.default_rng(3).integers(-2000, 2000, (900, 3)).astype("<i2")
    (tmp_path / "continuous/probe.0").mkdir(parents=True)
    (tmp_path / "continuous/probe.0/continuous.dat").write_bytes(x.tobytes() + b"\1")
    channels = [{"channel_name": n, "bit_volts": v, "units": "uV"} for n, v in (("CH1", 0.195), ("CH2", 0.195), ("ADC1", 1.5))]
    (tmp_path / "structure.oebin").write_text(json.dumps({"GUI version": "0.6", "continuous": [{"folder_name": "probe.0/", "sample_rate": 30000, "num_channels": 3, "channels": channels}]}, indent=1))
    got = fl.read_recording(spark, str(tmp_path)).orderBy("ch").collect()
    assert [(r.stream, r.fs, r.ch, r.name, r.kind, r.start) for r in got] == [("probe.0", 30000.0, 1, "CH1", "primary", 0), ("probe.0", 30000.0, 2, "CH2", "primary", 0), ("probe.0", 30000.0, 3, "ADC1", "adc", 0)]
    assert np.allclose([r.v for r in got], (x * [0.195, 0.195, 1.5]).T)
    assert [r.ch for r in fl.read_recording(spark, str(tmp_path), keep=["adc"]).collect()] == [3]
    (tmp_path / "structure.oebin").unlink()
    with pytest.raises(ValueError):
        fl.read_recording(spark, str(tmp_path)).collect()


def test_records_that_are_not_full_and_missing_samples(spark, tmp_path):
    signal = spark.range(2000).filter("id not between 700 and 720").select(F.lit(4).cast("long").alias("ch"), F.col("id").alias("i"), (F.col("id") % 900 * 0.01).alias("mv"))
    (content,) = [r.content for r in continuous_files(signal, 1000, 1e-6).collect()]
    (tmp_path / "c.ncs").write_bytes(bytes(content))
    rec = read_continuous(spark, str(tmp_path))
    back = to_samples(rec).orderBy("i").toPandas()
    want = np.arange(2000) % 900 * 0.01
    want[700:721] = 0
    assert back["i"].tolist() == list(range(2000)) and np.abs(back["mv"] - want).max() < 1e-6
    cut = rec.withColumn("n_valid", F.when(F.col("rec_no") == 1, 100).when(F.col("rec_no") == 2, 10).otherwise(F.col("n_valid")))
    kept = np.concatenate([want[:612], want[1024:1034], want[1536:]])
    out = to_samples(cut).orderBy("i").toPandas()
    assert out["i"].tolist() == list(range(len(kept))) and np.abs(out["mv"] - kept).max() < 1e-6
    whole = to_samples(cut, drop_partial=True).orderBy("i").toPandas()
    assert whole["i"].tolist() == list(range(512)) and np.abs(whole["mv"] - want[:512]).max() < 1e-6
