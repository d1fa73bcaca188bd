"""Queries by kernels: filters, transforms and detectors that run on blocks of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cortexlake.operators import detectors as dt
from cortexlake.operators import spectral as sp
from cortexlake.plans.registry import S, query

# Bands in Hz.
BANDS = {"theta": (6.0, 10.0), "slow_gamma": (25.0, 55.0), "fast_gamma": (60.0, 100.0), "ripple": (120.0, 180.0)}
SPIKE = (5.0, 100.0)


@query("D05_fft_resample")
def _(t):
    return sp.fft_resampled(t.signal, 1000, 400)


@query("D10_theta_band")
def _(t):
    return sp.band_passed(t.signal, 1000, *BANDS["theta"])


@query("D11_notch")
def _(t):
    return sp.band_stopped(t.signal, 1000, 59, 61)


@query("D12_fir_band_pass")
def _(t):
    return sp.fir_band_passed(t.signal, 1000, *BANDS["slow_gamma"], order=100)


@query("D13_envelope_and_phase")
def _(t):
    return sp.analytic_parts(t.signal, 1000, *BANDS["slow_gamma"])


@query("D14_instantaneous_frequency")
def _(t):
    return sp.instantaneous_frequency(t.signal, 1000, *BANDS["ripple"])


@query("D09_five_bands")
def _(t):
    return sp.bands(t.signal, 1000, {**BANDS, "spike": SPIKE})


@query("D15_ripples")
def _(t):
    return dt.ripples(sp.band_parts(t.signal, 1000, *BANDS["ripple"]), 1000, 2.0, 1.0, distance=0.02, least_ms=5, least_hz=125, guard=0.01)


@query("D16_spikes")
def _(t):
    return dt.spikes(sp.bands(t.signal, 1000, {"v": SPIKE}), 1000, 1.5, least=0.05, distance=0.02, prominence=0.1, raw=t.signal)


@query("D17_thresholds")
def _(t):
    """What the detectors ask of each channel: heights of peaks and edges, distance (s), duration (s), frequency and amplitude."""
    lit = lambda **x: [F.lit(v).cast("double").alias(k) for k, v in x.items()]
    of = lambda df, v, sd, edge: df.groupBy("ch").agg((F.stddev_pop(v) * sd).alias("peak_height"), (F.stddev_pop(v) * edge if edge else F.lit(None).cast("double")).alias("edge_height"))
    swr = of(sp.band_parts(t.signal, 1000, *BANDS["ripple"]), "envelope", 2.0, 1.0).select("ch", F.lit("swr").alias("kind"), "peak_height", "edge_height", *lit(isi=0.02, dur=0.005, inst_freq=125, min_amp=None))
    ds = of(sp.bands(t.signal, 1000, {"v": SPIKE}), "v", 1.5, None).select("ch", F.lit("ds").alias("kind"), "peak_height", "edge_height", *lit(isi=0.02, dur=None, inst_freq=None, min_amp=0.05))
    return swr.unionByName(ds)


@query("D17_detected_kinds")
def _(t):
    """Both detectors over all channels, in one table with the kind of each event."""
    swr = sp.detected_peaks(sp.band_passed(t.signal, 1000, *BANDS["ripple"]), "envelope", 2.0, 100)
    ds = sp.detected_peaks(t.signal, "v", 2.0, 100)
    return swr.withColumn("kind", F.lit("ripple")).unionByName(ds.withColumn("kind", F.lit("spike")))


@query("D20_flipped_line_length")
def _(t):
    from cortexlake.operators.events import line_length_events

    return line_length_events(t.signal.select("ch", "i", (-F.col("v")).alias("v")), 1000, 5, 99.5, 10, 2)


#: Densities of all windows of 64 samples that begin at a multiple of 16, by a sum over a table of cosines and sines.
SPECTROGRAM = f"""(WITH x AS (SELECT ch, start, i - start AS k, v FROM (SELECT ch, i, v, unnest(generate_series(greatest(i // 16 - 3, 0), i // 16)) * 16 AS start FROM {S})), m AS (SELECT ch, start, avg(v) AS mean FROM x GROUP BY ch, start HAVING count(*) = 64),
    y AS (SELECT x.ch, x.start, x.k, (x.v - m.mean) * (0.5 - 0.5 * cos(2 * pi() * x.k / 64)) AS v FROM x JOIN m USING (ch, start)),
    f AS (SELECT y.ch, y.start, f.f, sum(y.v * cos(2 * pi() * f.f * y.k / 64)) AS re, sum(y.v * sin(2 * pi() * f.f * y.k / 64)) AS im FROM y CROSS JOIN (SELECT unnest(generate_series(0, 32)) AS f) f GROUP BY y.ch, y.start, f.f)
    SELECT ch, start, f * 1000 / 64.0 AS hz, (re * re + im * im) * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END / (1000 * 24.0) AS power FROM f)"""


@query("D38_spectrogram", f"SELECT CAST(ch AS INT) AS ch, start, hz, round(power, 9) AS power FROM {SPECTROGRAM}")
def _(t):
    return sp.spectrogram(t.signal, 1000, 64, 16).withColumn("power", F.round("power", 9))


@query("D38_common_grid", f"""WITH s AS MATERIALIZED (SELECT ch, start // 16 AS a, CAST(hz / 15.625 AS INT) AS b, power FROM {SPECTROGRAM}), e AS (SELECT max(a) AS n FROM s),
    g AS (SELECT t * 10 AS start, f * 20.0 AS hz, t * 10 / 16.0 AS x, f * 20 / 15.625 AS y FROM (SELECT unnest(generate_series(0, n * 16 // 10)) AS t FROM e) CROSS JOIN (SELECT unnest(generate_series(0, 25)) AS f))
    SELECT CAST(s.ch AS INT) AS ch, g.start, g.hz, round(sum(s.power * (1 - abs(s.a - x)) * (1 - abs(s.b - y))), 9) AS power FROM g JOIN s ON s.a IN (CAST(floor(x) AS INT), CAST(ceil(x) AS INT)) AND s.b IN (CAST(floor(y) AS INT), CAST(ceil(y) AS INT)) GROUP BY s.ch, g.start, g.hz""")
def _(t):
    """The spectrogram at every 10 samples and 20 Hz."""
    return sp.on_common_grid(sp.spectrogram(t.signal, 1000, 64, 16), 16, 15.625, 10, 20.0).withColumn("power", F.round("power", 9))


@query("D39_scalogram")
def _(t):
    return sp.scalogram(t.signal, 1000, 8.0, 150.0, voices=2)


@query("D40_spectral_properties")
def _(t):
    return sp.band_properties(sp.mean_psd(t.signal, 1000, 128), BANDS)


@query("D43_amplitude_correlation")
def _(t):
    return sp.amplitude_correlation(t.signal, 1, 2, 1000, *BANDS["slow_gamma"], lag=20)


@query("R30_mean_envelope")
def _(t):
    """Mean of the envelope about each channel's peaks, and how wide these are."""
    found = sp.band_passed(t.signal, 1000, *BANDS["ripple"])
    peaks = sp.detected_peaks(found, "envelope", 2.0, 100)
    near = peaks.select("ch", F.col("i").alias("at"), "half_width", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("off")).withColumn("i", F.col("at") + F.col("off"))
    widths = peaks.groupBy("ch").agg(F.avg("half_width").alias("mean_width"))
    return near.join(found.select("ch", "i", "envelope"), ["ch", "i"]).groupBy("ch", "off").agg(F.avg("envelope").alias("envelope")).join(widths, "ch")
