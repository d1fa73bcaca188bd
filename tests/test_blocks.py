"""Filters and detectors must not depend on the blocks a channel is cut into."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cortexlake.functions import sections as sec
from cortexlake.operators import detectors as dt
from cortexlake.operators import spectral as sp
from cortexlake.operators.recursive import filtered

from tests.brute import find_peaks, prominence, width_at

BLOCKS = (256, 4096, 1 << 20)


def frame(spark, **channels):
    return spark.createDataFrame(pd.concat(pd.DataFrame({"ch": int(k[1:]), "i": np.arange(len(v)) + 40, "v": v}) for k, v in channels.items()), "ch int, i long, v double").repartition(3)


def one(df, ch, column="v"):
    return df.filter(F.col("ch") == ch).orderBy("i").toPandas()[column].to_numpy()


def plain(sections, x):
    """Sample by sample through each section, forwards and backwards, from settled states with odd padding."""
    pad = sec.system(sections).pad
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b0, b1, b2, _, a1, a2 in sections:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            s2 = (b2 - a2 * gain) * y[0]
            s1 = (b1 - a1 * gain) * y[0] + s2
            out = np.empty(len(y))
            for k, u in enumerate(y):
                out[k] = b0 * u + s1
                s1, s2 = b1 * u - a1 * out[k] + s2, b2 * u - a2 * out[k]
            y = out
        y = y[::-1]
    return y[pad : pad + len(x)]


@pytest.mark.parametrize("fs, low, high", [(1000, 6, 10), (30000, 6, 10), (1000, 120, 180)])
def test_filter_equals_an_unblocked_recursion(spark, fs, low, high):
    x = np.cumsum(np.random.default_rng(1).normal(size=3000))
    s = sec.butterworth(fs, low, high)
    want = plain(s, x)
    assert np.abs(sec.zero_phase(s, x) - want).max() < 1e-9 * np.abs(x).max()
    got = one(filtered(frame(spark, c1=x, c2=x[:1100]), {"v": s}, 900), 1)
    assert len(got) == len(x) and np.abs(got - want).max() < 1e-9 * np.abs(x).max()


def test_all_bands_in_one_pass_with_short_and_broken_channels(spark):
    r = np.random.default_rng(2)
    bands = {"theta": (6.0, 10.0), "slow": (25.0, 55.0)}
    x = r.normal(size=2000)
    df = frame(spark, c1=x, c2=r.normal(size=7), c3=np.array([2.0]))
    holed = df.filter("not (ch = 1 and i between 600 and 603)")
    out = sp.bands(df, 1000, bands, 256)
    for name, band in bands.items():
        assert np.abs(one(out, 1, name) - sec.zero_phase(sec.butterworth(1000, *band), x)).max() < 1e-9
    assert out.filter("ch = 2").count() == 7 and abs(one(out, 3, "theta")[0]) < 1e-9
    y = x.copy()
    y[560:564] = np.interp(np.arange(560, 564), [559, 564], [x[559], x[564]])
    got = sp.bands(holed, 1000, bands, 256).filter("ch = 1").orderBy("i").toPandas()
    assert len(got) == 1996 and np.abs(got["slow"].to_numpy() - np.delete(sec.zero_phase(sec.butterworth(1000, 25, 55), y), range(560, 564))).max() < 1e-9
    assert sp.bands(df.filter("false"), 1000, bands).count() == 0


def test_analytic_signal_hardly_depends_on_blocks(spark):
    t = np.arange(12000) / 1000
    df = frame(spark, c1=(1 + 0.4 * np.sin(2 * np.pi * 1.5 * t)) * np.sin(2 * np.pi * 150 * t) + np.random.default_rng(3).normal(size=12000))
    whole, cut = (one(sp.band_parts(df, 1000, 120, 180, b), 1, "envelope") for b in (1 << 20, 300))
    assert np.abs(whole - cut)[500:-500].max() < 1e-3 * whole.max()


def rough(n=9000, seed=5):
    r = np.random.default_rng(seed)
    x = np.round(np.convolve(np.cumsum(r.normal(size=n + 50)), np.hanning(9), "valid")[:n], 1)
    x[1000:1900] = 3.0  # a plateau over several borders
    x[4000] = x.max() + 9
    return x


@pytest.mark.parametrize("block", BLOCKS)
def test_peaks_prominences_and_widths_of_whole_channels(spark, block):
    x, y = rough(), np.round(np.sin(np.arange(3000) / 7) + np.arange(3000) / 400, 3)
    rows = dt.block_rows(frame(spark, c1=x, c2=y), ["v"], block)
    for ch, v in ((1, x), (2, y)):
        for distance in (1, 40):
            want = find_peaks(v, -1e9, distance)
            kept = dt.thinned(dt.local_peaks(rows, "v").filter(F.col("ch") == ch), distance)
            got = dt.crossings(rows, "v", dt.prominences(rows, "v", kept).withColumn("half", F.col("v") - F.col("prominence") / 2), "half").orderBy("i").toPandas()
            assert got["i"].tolist() == [p + 40 for p in want]
            assert np.allclose(got["prominence"], [prominence(v, p) for p in want])
            ends = np.array([width_at(v, p, v[p] - prominence(v, p) / 2) for p in want])
            assert np.allclose(got[["start", "stop"]].to_numpy() - 40, ends)


def test_distance_rule_over_a_long_chain(spark):
    r = np.random.default_rng(6)
    v = r.permutation(6000) + np.arange(6000) * r.choice((0, 0.5))
    df = spark.createDataFrame(pd.DataFrame({"ch": 1, "i": np.arange(6000) * 3, "v": v}), "ch int, i long, v double")
    for distance, values in ((7, v), (3000, v), (10, np.arange(6000.0))):
        peaks = df.drop("v").join(spark.createDataFrame(pd.DataFrame({"i": np.arange(6000) * 3, "v": values})), "i").select("ch", "i", "v")
        keep, at = np.ones(6000, bool), np.arange(6000) * 3
        for k in np.argsort(values, kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(at - at[k]) < distance
                near[k] = False
                keep[near] = False
        assert sorted(x.i for x in dt.thinned(peaks, distance).collect()) == at[keep].tolist()


def spikes_by_hand(x, raw, fs, sd, least, distance, prom):
    out = []
    for p in find_peaks(x, max(x.std() * sd, least), distance):
        stand = prominence(x, p)
        if stand >= prom:
            a, b = width_at(x, p, x[p] - stand / 2)
            lo = max(p - 10, 0)
            before, after = p - int(a), int(b) - p
            out.append((lo + int(raw[lo : p + 10].argmax()), p, x[p], stand, (b - a) / fs * 1000, (after - before) / min(before, after) * 100 if min(before, after) else None))
    return out


@pytest.mark.parametrize("block", BLOCKS)
def test_spikes(spark, block):
    r = np.random.default_rng(7)
    raw = np.convolve(r.normal(size=9100), np.hanning(25), "same")[:9000]
    x = sec.zero_phase(sec.butterworth(1000, 5, 100), raw)
    want = spikes_by_hand(x, raw, 1000, 1.0, 0.5, 20, 1.5)
    got = dt.spikes(frame(spark, c1=x), 1000, 1.0, 0.5, 0.02, 1.5, frame(spark, c1=raw), block=block).orderBy("idx_peak").collect()
    assert len(want) > 30 and [(g.idx - 40, g.idx_peak - 40) for g in got] == [w[:2] for w in want]
    assert np.allclose([(g.amp, g.prom, g.half_width) for g in got], [w[2:5] for w in want]) and [g.asym is None for g in got] == [w[5] is None for w in want]
    assert all(w[5] is None or abs(g.asym - w[5]) < 1e-6 for g, w in zip(got, want))


@pytest.mark.parametrize("block", BLOCKS)
def test_ripples(spark, block):
    fs, t = 1000, np.arange(9000) / 1000
    x = np.random.default_rng(8).normal(size=9000) * 0.05
    for at, hz, long_ in ((300, 150, 60), (2000, 150, 60), (2090, 160, 40), (4096, 130, 120), (6000, 150, 8), (7000, 170, 90), (8800, 150, 60)):
        x += np.exp(-(((np.arange(9000) - at) / (long_ / 2.5)) ** 2)) * np.sin(2 * np.pi * hz * t) * (2 if long_ > 50 else 1.6)
    v = sec.zero_phase(sec.butterworth(fs, 120, 180), x)
    z = np.fft.fft(v)
    h = np.zeros(9000)
    h[0] = h[4500] = 1
    h[1:4500] = 2
    z = np.fft.ifft(z * h)
    env, hz = np.abs(z), np.clip(np.diff(np.unwrap(np.angle(z))) * fs / (2 * np.pi), 120, 180)
    low = env.std() * 1.0
    clip = np.maximum(env, low)
    want = []
    for p in find_peaks(env, env.std() * 2.5, 60):
        if fs < p < 9000 - fs:
            a, b = width_at(clip, p, clip[p] - prominence(clip, p))
            freq = hz[p - 8 : p + 8].mean()
            if b - a > 20 and freq > 135:
                want.append((p - 40 + int(v[p - 40 : p + 40].argmax()), p, env[p], b - a, freq, int(a), int(b)))
    parts = frame(spark, c1=v).join(spark.createDataFrame(pd.DataFrame({"i": np.arange(9000) + 40, "envelope": env, "hz": np.concatenate([hz[:1], hz])})), "i")
    got = dt.ripples(parts, fs, 2.5, 1.0, 0.06, 20, 135, block=block).orderBy("idx_peak").collect()
    assert len(want) >= 3 and [(g.idx - 40, g.idx_peak - 40, g.idx_start - 40, g.idx_stop - 40) for g in got] == [(w[0], w[1], w[5], w[6]) for w in want]
    assert np.allclose([(g.amp, g.dur, g.freq) for g in got], [w[2:5] for w in want])
