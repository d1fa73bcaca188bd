"""Kernels and block-wise operators on signals whose results are known, and skewed groups against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cortexlake import plans
from cortexlake.functions import dsp
from cortexlake.operators import events as ev
from cortexlake.operators import spectral as sp
from cortexlake.operators import stats as st

from tests.test_operators import DATA

FS = 1000


def tones(n=8000):
    t = np.arange(n) / FS
    return t, np.sin(2 * np.pi * 40 * t), np.sin(2 * np.pi * 60 * t)


def frame(spark, *channels):
    return spark.createDataFrame(pd.concat(pd.DataFrame({"ch": k + 1, "i": np.arange(len(v)), "v": v}) for k, v in enumerate(channels)), "ch int, i long, v double")


def column(df, ch=1, x="v"):
    return df.filter(F.col("ch") == ch).orderBy("i").toPandas()[x].to_numpy()


def test_notch_and_fir_take_one_tone_and_leave_the_other(spark):
    _, a, b = tones()
    both = frame(spark, a + b)
    inner = slice(500, -500)
    assert np.abs(column(sp.band_stopped(both, FS, 58, 62, 2048)) - a)[inner].max() < 0.02
    assert np.abs(column(sp.fir_band_passed(both, FS, 30, 50, 200, 2048, 1024)) - a)[inner].max() < 0.02
    with pytest.raises(ValueError):
        sp.fir_band_passed(both, FS, 30, 50, 5000)
    assert (dsp.zero_phase_fir(a[:50], dsp.fir_band_pass(FS, 30, 50, 100)) == a[:50]).all()


def test_envelope_phase_and_frequency_of_a_tone(spark):
    t, a, _ = tones()
    df = frame(spark, (1 + 0.5 * np.sin(2 * np.pi * 2 * t)) * a)
    inner = slice(800, -800)
    assert np.abs(column(sp.analytic_parts(df, FS, 25, 55, 2048), x="envelope") - (1 + 0.5 * np.sin(2 * np.pi * 2 * t)))[inner].max() < 0.05
    hz = column(sp.instantaneous_frequency(df, FS, 25, 55, 2048), x="hz")
    assert np.abs(hz[inner] - 40).max() < 1 and hz.min() >= 25 and hz.max() <= 55


def test_fft_resample_of_a_tone(spark):
    _, a, _ = tones()
    out = column(sp.fft_resampled(frame(spark, a), FS, 400, 2000))
    assert len(out) == 3200 and np.abs(out - np.sin(2 * np.pi * 40 * np.arange(3200) / 400)).max() < 1e-9
    assert np.abs(dsp.fft_resample(a[:100], 250) - np.sin(2 * np.pi * 40 * np.arange(250) / 2500)).max() < 1e-9
    assert len(dsp.fft_resample(np.zeros(0), 0)) == 0


def test_spectrogram_and_scalogram_find_the_tone(spark):
    _, a, b = tones()
    df = frame(spark, np.where(np.arange(8000) < 4000, a, b))
    top = sp.spectrogram(df, FS, 250, 125, 1000).groupBy("start").agg(F.max_by("hz", "power").alias("hz")).toPandas().set_index("start").hz
    assert len(top) == (8000 - 250) // 125 + 1 and (top[top.index <= 3750] == 40).all() and (top[top.index >= 4000] == 60).all()
    power = sp.scalogram(df, FS, 20.0, 80.0, 2, 2048).filter("i between 1000 and 3000").groupBy("hz").agg(F.avg("log_power").alias("p")).toPandas().set_index("hz").p
    assert len(power) == 5 and abs(power[40.0]) < 0.01 and power[80.0] < -1


def test_amplitude_correlation_finds_the_shift(spark):
    t = np.arange(8000) / FS
    g = np.random.default_rng(2)
    slow = np.convolve(g.normal(size=8100), np.hanning(100), "same")
    slow = 2 + slow / slow.std()
    x, y = slow[100:] * np.sin(2 * np.pi * 40 * t), slow[85:-15] * np.sin(2 * np.pi * 47 * t)
    r = sp.amplitude_correlation(frame(spark, x, y), 1, 2, FS, 20, 70, 30).toPandas().set_index("lag").r
    assert r.idxmax() == 15 and r.max() > 0.9
    opposed = sp.amplitude_correlation(frame(spark, x, (4.5 - slow[85:-15]) * np.sin(2 * np.pi * 47 * t)), 1, 2, FS, 20, 70, 30).toPandas().set_index("lag").r
    assert opposed.min() < -0.5


def test_band_properties_of_two_tones(spark):
    t = np.arange(4096) / FS
    psd = sp.mean_psd(frame(spark, np.sin(2 * np.pi * 8 * t) + 0.5 * np.sin(2 * np.pi * 40 * t)), FS, 1024)
    out = sp.band_properties(psd, {"theta": (6.0, 10.0), "slow_gamma": (25.0, 55.0)}).first()
    assert abs(out.theta_hz - 8) < 1 and abs(out.slow_gamma_hz - 40) < 1 and abs(out.theta_ratio - 4) < 0.1


@pytest.mark.parametrize("name", ["D05_fft_resample", "D10_theta_band", "D11_notch", "D12_fir_band_pass", "D13_envelope_and_phase", "D14_instantaneous_frequency", "D38_spectrogram", "D39_scalogram"])
def test_block_queries_cover_every_channel(spark, name):
    out = plans.QUERIES[name](spark, DATA)
    assert out.select("ch").distinct().count() == 64 and out.filter("ch is null").count() == 0


def test_detectors_and_dispatch(spark):
    both = plans.QUERIES["D17_detected_kinds"](spark, DATA).groupBy("kind").count().collect()
    one = {"spike": plans.QUERIES["D16_peaks"](spark, DATA).count()}
    assert {r.kind for r in both} == {"ripple", "spike"} and dict(map(tuple, both))["spike"] == one["spike"]
    assert plans.QUERIES["D20_flipped_line_length"](spark, DATA).filter("off_i <= on_i").count() == 0
    assert plans.QUERIES["R30_mean_envelope"](spark, DATA).filter("off = 0").count() > 0
    assert plans.QUERIES["D40_spectral_properties"](spark, DATA).count() == 64
    assert plans.QUERIES["D43_amplitude_correlation"](spark, DATA).count() == 41


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_chains_across_blocks_equal_one_sort(spark, block):
    r, rows = random.Random(block), []
    for key in range(3):
        at = 0
        for _ in range(400):
            at += r.choice((1, 1, 1, 2, 3, 40))
            rows.append((key, at, at + (r.randrange(3) if key else 0)))
    df = spark.createDataFrame(rows, "k int, a long, b long").distinct()
    want = sorted(map(tuple, ev.merge_intervals(df, ["k"], "a", "b", 2).select("k", "a", "b", "n_merged").collect()))
    assert sorted(map(tuple, ev.chained(df, ["k"], "a", "b", 2, block).collect())) == want


def test_quantiles_of_a_group_that_holds_most_rows(spark):
    g = np.random.default_rng(4)
    v = np.concatenate([g.normal(size=5000), np.full(700, 0.25), [np.nan]])
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": "hot", "v": v}), pd.DataFrame({"k": "one", "v": [3.0]})]))
    for q in (0.0, 0.1, 0.6, 0.995, 1.0):
        got = dict(map(tuple, st.quantile(df, ["k"], "v", q).collect()))
        assert abs(got["hot"] - np.quantile(v[:-1], q)) < 1e-12 and got["one"] == 3.0
        assert abs(st.quantile(df, [], "v", q).first()[0] - np.quantile(np.append(v[:-1], 3.0), q)) < 1e-12


@pytest.mark.parametrize("block", [512, 1 << 16])
def test_scalogram_ridge_follows_a_chirp(spark, block):
    t = np.arange(6000) / FS
    hz = 20 + 15 * t
    out = sp.scalogram(frame(spark, np.sin(2 * np.pi * (20 * t + 7.5 * t**2))), FS, 10.0, 160.0, 10, block)
    ridge = out.groupBy("i").agg(F.max_by("hz", "log_power").alias("hz"), F.max("log_power").alias("p")).orderBy("i").toPandas()
    inner = slice(500, -500)
    assert len(ridge) == 6000 and np.abs(np.log2(ridge["hz"].to_numpy() / hz))[inner].max() <= 0.1 and np.abs(ridge["p"])[inner].max() < 0.02


def test_common_grid_is_bilinear(spark):
    rows = [(1, 16 * a, 15.625 * b, 2.0 * a + 3.0 * b + a * b) for a in range(6) for b in range(8)]
    got = sp.on_common_grid(spark.createDataFrame(rows, "ch int, start long, hz double, power double"), 16, 15.625, 4, 10.0).collect()
    assert len(got) == 21 * 11
    for r in got:
        a, b = r.start / 16, r.hz / 15.625
        assert abs(r.power - (2 * a + 3 * b + a * b)) < 1e-9
