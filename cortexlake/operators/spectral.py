"""Filters, envelopes, detectors and spectra over signals ``ch, i, v``, block by block.

A channel is cut into blocks of ``block`` samples with ``overlap`` more on both sides; each block is worked on by itself and what
lies in the overlap is dropped, so no channel is gathered into one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortexlake.functions import dsp
from cortexlake.functions.sections import butterworth
from cortexlake.operators.detectors import block_rows, crossings, local_peaks, prominences, thinned
from cortexlake.operators.recursive import BLOCK, filtered
from cortexlake.operators.stages import settled

OVERLAP = 1 << 12
#: Periods of a band's lowest frequency by which blocks overlap for its analytic signal.
CYCLES = 24


def blocks(signal: DataFrame, block: int, overlap: int) -> DataFrame:
    """Rows with the blocks they serve: their own, and a neighbour near its border."""
    own = F.floor(F.col("i") / block)
    place = F.pmod(F.col("i"), F.lit(block))
    serves = F.array_compact(F.array(own, F.when((place < overlap) & (own > 0), own - 1), F.when(place >= block - overlap, own + 1)))
    return signal.select("ch", "i", "v", F.explode(serves).alias("block"))


def _each_block(signal: DataFrame, kernel, schema: str, block: int, overlap: int) -> DataFrame:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        first = int(key[1]) * block
        i = rows["i"].to_numpy()
        own = (i >= first) & (i < first + block)
        return kernel(int(key[0]), i, rows["v"].to_numpy(float), own) if own.any() else kernel(int(key[0]), i[:0], np.zeros(0), own[:0])

    return blocks(signal, block, overlap).groupBy("ch", "block").applyInPandas(run, schema)


def analytic_of(passed: DataFrame, fs: float, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """``ch, i, v, envelope, phase, hz`` of a signal that has passed the band: amplitude and phase (radians) of the analytic signal, and its frequency.

    Blocks overlap by CYCLES periods of the lowest frequency, faded, so that the result hardly depends on them. The frequency is
    the phase's step to a sample, kept within the band; the first sample repeats the second's.
    """
    overlap = int(np.ceil(CYCLES * fs / low))

    def kernel(ch, i, v, own):
        z = v.astype(complex)
        if own.any():
            a, b = int(np.argmax(own)), int(np.argmax(own[::-1]))
            z = dsp.analytic_inside(v, a, b) if len(v) > 3 else z
        return pd.DataFrame({"ch": ch, "i": i[own], "v": v[own], "envelope": np.abs(z)[own], "phase": np.angle(z)[own], "hz": dsp.instantaneous_frequency(z, fs, low, high)[own]})

    return _each_block(passed, kernel, "ch int, i long, v double, envelope double, phase double, hz double", max(block, overlap), overlap)


def band_parts(signal: DataFrame, fs: float, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """As ``analytic_of``, of the signal through an order 3 Butterworth band-pass without phase shift."""
    return analytic_of(settled(filtered(signal, {"v": butterworth(fs, low, high)}, block), "band"), fs, low, high, block)


def band_passed(signal: DataFrame, fs: float, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """``ch, i, v, envelope``: the band-passed signal and its analytic amplitude."""
    return band_parts(signal, fs, low, high, block).select("ch", "i", "v", "envelope")


def bands(signal: DataFrame, fs: float, of: dict[str, tuple[float, float]], block: int = BLOCK) -> DataFrame:
    """``ch, i`` and the signal in each of the bands, in one pass."""
    return filtered(signal, {name: butterworth(fs, *band) for name, band in of.items()}, block)


def _filtered(signal: DataFrame, kernel, block: int, overlap: int) -> DataFrame:
    """``ch, i, v`` by a kernel that maps a block's samples to as many."""

    def run(ch, i, v, own):
        return pd.DataFrame({"ch": ch, "i": i[own], "v": (kernel(v) if len(v) > 3 else v)[own]})

    return _each_block(signal, run, "ch int, i long, v double", block, overlap)


def band_stopped(signal: DataFrame, fs: float, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """``ch, i, v`` without what lies between ``low`` and ``high``: one pair of poles, forwards and backwards."""
    return filtered(signal, {"v": butterworth(fs, low, high, 1, "stop")}, block)


def fir_band_passed(signal: DataFrame, fs: float, low: float, high: float, order: int, block: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """``ch, i, v`` by a windowed-sinc band-pass, forwards and backwards. Its reach, the order, has to lie within the overlap."""
    if overlap < 2 * order:
        raise ValueError("the filter reaches further than the overlap")
    taps = dsp.fir_band_pass(fs, low, high, order)
    return _filtered(signal, lambda v: dsp.zero_phase_fir(v, taps), block, overlap)


def analytic_parts(signal: DataFrame, fs: float, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """``ch, i, envelope, phase`` of the band-passed signal; the phase in radians."""
    return band_parts(signal, fs, low, high, block).select("ch", "i", "envelope", "phase")


def instantaneous_frequency(signal: DataFrame, fs: float, low: float, high: float, block: int = BLOCK) -> DataFrame:
    """``ch, i, hz``: frequency of the band-passed signal from its phase, kept within the band."""
    return band_parts(signal, fs, low, high, block).select("ch", "i", "hz")


def fft_resampled(signal: DataFrame, fs: int, to: int, block: int = BLOCK) -> DataFrame:
    """``ch, i, v``: each block resampled on its own by its spectrum; a block has a whole number of seconds' worth of samples."""
    block = max(block // fs, 1) * fs
    size = block * to // fs

    def kernel(ch, i, v, own):
        n = round(len(v) * to / fs)
        first = int(i[0]) // block * size if len(i) else 0
        return pd.DataFrame({"ch": ch, "i": first + np.arange(n), "v": dsp.fft_resample(v, n)})

    return _each_block(signal, kernel, "ch int, i long, v double", block, 0)


def spectrogram(signal: DataFrame, fs: float, size: int, hop: int, block: int = BLOCK) -> DataFrame:
    """``ch, start, hz, power``: density of every window of ``size`` samples that begins at a multiple of ``hop``; windows past the end go."""

    def kernel(ch, i, v, own):
        starts = np.flatnonzero(own & (i % hop == 0))
        starts = starts[starts + size <= len(v)]
        if not len(starts):
            return pd.DataFrame({"ch": [], "start": [], "hz": [], "power": []})
        hz = np.fft.rfftfreq(size, 1 / fs)
        each = np.stack([dsp.psd(v[s : s + size], fs)[1] for s in starts])
        return pd.DataFrame({"ch": ch, "start": np.repeat(i[starts], len(hz)), "hz": np.tile(hz, len(starts)), "power": each.ravel()})

    return _each_block(signal, kernel, "ch int, start long, hz double, power double", block, size)


def scalogram(signal: DataFrame, fs: float, low: float, high: float, voices: int = 10, block: int = BLOCK) -> DataFrame:
    """``ch, i, hz, log_power``: log10 magnitude of the Morse wavelet transform, ``voices`` frequencies to an octave from ``high`` down to ``low``.

    Blocks overlap by eight periods of the lowest frequency, beyond which a wavelet has nothing left.
    """
    frequencies = dsp.octaves(low, high, voices)
    overlap = int(np.ceil(8 * fs / frequencies[-1]))

    def kernel(ch, i, v, own):
        if not own.any():
            return pd.DataFrame({"ch": [], "i": [], "hz": [], "log_power": []})
        each = np.stack([np.log10(np.maximum(dsp.morse(v, fs, f)[own], 1e-300)) for f in frequencies])
        n = int(own.sum())
        return pd.DataFrame({"ch": ch, "i": np.tile(i[own], len(frequencies)), "hz": np.repeat(frequencies, n), "log_power": each.ravel()})

    return _each_block(signal, kernel, "ch int, i long, hz double, log_power double", max(block, overlap), overlap)


def on_common_grid(table: DataFrame, hop: int, step: float, time_step: int, hz_step: float) -> DataFrame:
    """``ch, start, hz, power`` of a spectrogram at every ``time_step`` and ``hz_step``, bilinear between the four values around.

    ``hop`` and ``step`` are the distances of the table's times and frequencies. Each value is sent to the places of the grid about it with
    its weight, so the four meet in a sum; places without all that they need are left out.
    """

    def about(x: Column, wide: float, grid: float) -> Column:
        first, last = F.ceil((x - wide) / grid + 1e-9), F.floor((x + wide) / grid - 1e-9)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    placed = table.withColumn("a", F.explode(about(F.col("start"), hop, time_step))).withColumn("b", F.explode(about(F.col("hz"), step, hz_step)))
    weight = (1 - F.abs(F.col("a") * time_step - F.col("start")) / hop) * (1 - F.abs(F.col("b") * hz_step - F.col("hz")) / step)
    found = placed.withColumn("w", weight).groupBy("ch", "a", "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("power")).alias("power")).filter(F.col("w") > 1 - 1e-6)
    return found.select("ch", (F.col("a") * time_step).alias("start"), (F.col("b") * hz_step).alias("hz"), "power")


def band_properties(psd: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Per channel of ``ch, hz, power``: each band's share of the power, its strongest frequency and that one's power, and theta over slow gamma."""
    inside = lambda lo, hi, x: F.when(F.col("hz").between(lo, hi), x)
    cols = []
    for name, (lo, hi) in bands.items():
        cols += [(F.sum(inside(lo, hi, F.col("power"))) / F.sum("power")).alias(f"{name}_share"), F.max_by("hz", inside(lo, hi, F.col("power"))).alias(f"{name}_hz"), F.max(inside(lo, hi, F.col("power"))).alias(f"{name}_peak")]
    out = psd.groupBy("ch").agg(*cols)
    return out.withColumn("theta_ratio", F.try_divide("theta_share", "slow_gamma_share")) if {"theta", "slow_gamma"} <= set(bands) else out


def amplitude_correlation(signal: DataFrame, a: int, b: int, fs: float, low: float, high: float, lag: int) -> DataFrame:
    """Cross-correlation of two channels' envelopes in a band, less their means: ``lag, r``."""
    found = band_passed(signal.filter(F.col("ch").isin(a, b)), fs, low, high)
    means = found.groupBy("ch").agg(F.avg("envelope").alias("mean"))
    return cross_correlation(found.join(means, "ch").select("ch", "i", (F.col("envelope") - F.col("mean")).alias("v")), a, b, lag)


def detected_peaks(signal: DataFrame, value: str, times_sd: float, distance: int, block: int = BLOCK) -> DataFrame:
    """Peaks of at least ``times_sd`` population deviations of the channel: ``ch, i, height, prominence, half_width, asymmetry``.

    Width is taken at half prominence, asymmetry is (after - before) / the shorter, in percent.
    """
    rows = block_rows(signal.select("ch", "i", F.col(value).alias("v")), ["v"], block)
    limits = signal.groupBy("ch").agg((F.stddev_pop(value) * times_sd).alias("limit")).filter("limit > 0")
    kept = settled(thinned(local_peaks(rows, "v").join(F.broadcast(limits), "ch").filter("v >= limit").select("ch", "i", "v"), distance), "peaks")
    stand = settled(prominences(rows, "v", kept).withColumn("half", F.col("v") - F.col("prominence") / 2), "prominences")
    wide = crossings(rows, "v", stand, "half")
    before, after = F.col("i") - F.col("start"), F.col("stop") - F.col("i")
    return wide.select("ch", "i", F.col("v").alias("height"), "prominence", (F.col("stop") - F.col("start")).alias("half_width"), (F.try_divide(after - before, F.least(before, after)) * 100).alias("asymmetry"))


def mean_psd(signal: DataFrame, fs: float, size: int) -> DataFrame:
    """Mean one-sided density over whole windows of ``size`` samples: ``ch, hz, power``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < size:
            return pd.DataFrame({"ch": [], "hz": [], "power": []})
        hz, power = dsp.psd(rows.sort_values("i")["v"].to_numpy(float), fs)
        return pd.DataFrame({"ch": int(key[0]), "hz": hz, "power": power})

    each = signal.groupBy("ch", F.floor(F.col("i") / size).alias("w")).applyInPandas(run, "ch int, hz double, power double")
    return each.groupBy("ch", "hz").agg(F.avg("power").alias("power"))


def coherence(signal: DataFrame, a: int, b: int, fs: float, size: int) -> DataFrame:
    """Magnitude-squared coherence of two channels over half-overlapping Hann windows: ``hz, coherence``."""
    half = size // 2
    pair = signal.filter(F.col("ch").isin(a, b)).groupBy("i").agg(F.max(F.when(F.col("ch") == a, F.col("v"))).alias("x"), F.max(F.when(F.col("ch") == b, F.col("v"))).alias("y"))
    k = F.floor(F.col("i") / half)
    windows = pair.select("i", "x", "y", F.explode(F.array(k, k - 1)).alias("w")).filter("w >= 0")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < size:
            return pd.DataFrame({"hz": [], "xx": [], "yy": [], "re": [], "im": []})
        rows = rows.sort_values("i")
        w = np.hanning(size + 1)[:-1]
        x, y = (np.fft.rfft((rows[c] - rows[c].mean()).to_numpy(float) * w) for c in "xy")
        cross = x * y.conj()
        return pd.DataFrame({"hz": np.fft.rfftfreq(size, 1 / fs), "xx": np.abs(x) ** 2, "yy": np.abs(y) ** 2, "re": cross.real, "im": cross.imag})

    sums = windows.groupBy("w").applyInPandas(run, "hz double, xx double, yy double, re double, im double").groupBy("hz").agg(*(F.sum(c).alias(c) for c in ("xx", "yy", "re", "im")))
    return sums.select("hz", F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("xx") * F.col("yy")).alias("coherence"))


def cross_correlation(signal: DataFrame, a: int, b: int, lag: int) -> DataFrame:
    """Normalised cross-correlation of two channels for lags -lag..lag: ``lag, r``. The lags are generated, so the join is on equal samples."""
    x = signal.filter(F.col("ch") == a).select(F.col("v").alias("x"), F.explode(F.sequence(F.lit(-lag), F.lit(lag))).alias("lag"), "i").withColumn("i", F.col("i") + F.col("lag"))
    y = signal.filter(F.col("ch") == b).select("i", F.col("v").alias("y"))
    norm = signal.filter(F.col("ch").isin(a, b)).groupBy().agg(F.sqrt(F.sum(F.when(F.col("ch") == a, F.col("v") * F.col("v"))) * F.sum(F.when(F.col("ch") == b, F.col("v") * F.col("v")))).alias("norm"), F.lit(1).alias("one"))
    sums = x.join(y, "i").groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("s")).withColumn("one", F.lit(1))
    return sums.join(F.broadcast(norm), "one").select("lag", (F.col("s") / F.col("norm")).alias("r"))
