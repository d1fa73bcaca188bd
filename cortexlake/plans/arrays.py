"""Queries over the 64-channel signal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cortexlake.operators import event_blocks as eb
from cortexlake.operators import events as ev
from cortexlake.operators import signals as sg
from cortexlake.operators import spectral as sp
from cortexlake.operators import stats as st
from cortexlake.operators.clusters import dbscan, pca_clusters
from cortexlake.operators.sources_density import density_matrix, inverse_source_density
from cortexlake.operators.templates import ABOVE, BELOW, golden_template
from cortexlake.operators.templates import REGIONS as REGION_ORDER
from cortexlake.plans.registry import S, query

# Regions of a 32-channel probe.
REGIONS = (
    ("Left POR", 1, 4), ("Left PER", 5, 8), ("Right PER", 9, 12), ("Right POR", 13, 16), ("Right OFC", 17, 18), ("Right ACC", 19, 20),
    ("Left ACC", 21, 22), ("Left OFC", 23, 24), ("Left DHC", 25, 26), ("Left RSC", 27, 28), ("Right RSC", 29, 30), ("Right DHC", 31, 32),
)
REGIONS_SQL = "(VALUES " + ", ".join(f"('{r}', {a}, {b})" for r, a, b in REGIONS) + ") r(region, lo, hi)"
PRCTILE = """SELECT {keys} a + (b - a) * f AS {name} FROM (SELECT {keys} max(CASE WHEN hi >= floor(pos) AND hi - n < floor(pos) THEN v END) AS a, max(CASE WHEN hi >= ceil(pos) AND hi - n < ceil(pos) THEN v END) AS b, max(pos - floor(pos)) AS f
  FROM (SELECT *, least(greatest(total * {p} + 0.5, 1.0), total) AS pos FROM (SELECT {keys} v, n, sum(n) OVER ({part} ORDER BY v) AS hi, sum(n) OVER ({part}) AS total FROM (SELECT {keys} v, count(*) AS n FROM {src} GROUP BY {keys} v))) GROUP BY {group})"""


def prctile_sql(src: str, p: float, name: str, key: str = "") -> str:
    return PRCTILE.format(src=src, p=p, name=name, keys=f"{key}, " if key else "", part=f"PARTITION BY {key}" if key else "", group=key or "ALL")


@query("F12_even_channels", f"SELECT i, ch, v FROM {S} WHERE ch % 2 = 0")
def _(t):
    return t.signal.filter("ch % 2 = 0").select("i", "ch", "v")


@query("F13_bad_channel_substitution", f"""SELECT ch, CASE WHEN ch % 8 <> 0 THEN ch WHEN ch + 1 <= 64 THEN ch + 1 ELSE ch - 1 END AS used, round(avg(v), 6) AS mean FROM {S} GROUP BY ch""")
def _(t):
    """Every eighth channel is bad: the next one stands in, or the one before at the end."""
    used = F.when(F.col("ch") % 8 != 0, F.col("ch")).when(F.col("ch") + 1 <= 64, F.col("ch") + 1).otherwise(F.col("ch") - 1)
    return t.signal.groupBy("ch").agg(F.round(F.avg("v"), 6).alias("mean")).select("ch", used.alias("used"), "mean")


@query("J14_region_lookup", f"SELECT ch, region FROM (SELECT DISTINCT ch FROM {S}) s JOIN {REGIONS_SQL} ON s.ch BETWEEN r.lo AND r.hi")
def _(t):
    regions = t.spark.createDataFrame(REGIONS, "region string, lo int, hi int").select("region", F.explode(F.sequence("lo", "hi")).alias("ch"))
    return t.signal.select("ch").distinct().join(F.broadcast(regions), "ch").select("ch", "region")


@query("W12_source_density", f"SELECT i, ch, round(-(lag(v) OVER w - 2 * v + lead(v) OVER w), 6) AS csd FROM {S} WINDOW w AS (PARTITION BY i ORDER BY ch)")
def _(t):
    return sg.source_density(t.signal, ["i"]).select("i", "ch", F.round("csd", 6).alias("csd"))


@query("D30_source_density_replicated", f"SELECT label, ch, round(avg(csd), 5) AS mean FROM (SELECT ch, label, -(coalesce(lag(v) OVER w, v) - 2 * v + coalesce(lead(v) OVER w, v)) AS csd FROM {S} WINDOW w AS (PARTITION BY i ORDER BY ch)) GROUP BY label, ch")
def _(t):
    return sg.source_density(t.signal, ["i"], "replicate").groupBy("label", "ch").agg(F.round(F.avg("csd"), 5).alias("mean"))


@query("W11_line_length", f"""SELECT ch, i, CASE WHEN count(*) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) >= 5 THEN round(sum(d) OVER (PARTITION BY ch ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 5) END AS ll
    FROM (SELECT *, abs(lead(v) OVER (PARTITION BY ch ORDER BY i) - v) AS d FROM {S})""")  # fmt: skip
def _(t):
    w = Window.partitionBy("ch").orderBy("i")
    step = t.signal.withColumn("d", F.abs(F.lead("v").over(w) - F.col("v")))
    return step.select("ch", "i", F.when(F.lead("i", 5).over(w).isNotNull(), F.round(F.sum("d").over(w.rowsBetween(0, 3)), 5)).alias("ll"))


@query("D19_line_length_events")
def _(t):
    return ev.line_length_events(t.signal.select("ch", "i", "v"), 1000, 5, 99.5, 10, 2)


@query("W19_bin_means", f"SELECT ch, i // 16 AS bin, round(avg(v), 6) AS mean FROM {S} GROUP BY 1, 2 HAVING count(*) = 16")
def _(t):
    return sg.bin_means(t.signal, 16).select("ch", "bin", F.round("mean", 6).alias("mean"))


WINDOWS = f"(SELECT a.vec_id AS ev, o.off, s.ch, s.v FROM embeddings a CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS off) o JOIN {S} s ON s.i = a.vec_id + o.off)"


@query("J12_event_windows", f"SELECT ev, off, ch, v FROM {WINDOWS}")
def _(t):
    anchors = t.embeddings.select(F.col("vec_id").alias("ev"), F.col("vec_id").alias("at"))
    return eb.window_rows(t.samples, anchors, 5)


@query("A10_window_averages", f"SELECT ch, off, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(v) AS n FROM {WINDOWS} GROUP BY ch, off")
def _(t):
    anchors = t.embeddings.select(F.col("vec_id").alias("ev"), F.col("vec_id").alias("at"))
    out = sg.average_windows(eb.window_rows(t.samples, anchors, 5))
    return out.select("ch", "off", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query("A02_mean_sem", f"SELECT label, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n FROM {S} GROUP BY label")
def _(t):
    return st.mean_sem(t.signal, ["label"], "v").select("label", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@query("A03_extents", f"SELECT label, count(DISTINCT i) AS n, min(i) AS first_i, max(i) AS last_i FROM {S} GROUP BY label")
def _(t):
    return t.signal.groupBy("label").agg(F.countDistinct("i").alias("n"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))


@query("A07_group_sum_on_rows", "SELECT vec_id, label, sum(CAST(vec_id % 3 > 0 AS BIGINT)) OVER (PARTITION BY label) AS n_valid FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", "label", F.sum((F.col("vec_id") % 3 > 0).cast("bigint")).over(Window.partitionBy("label")).cast("decimal(38,0)").alias("n_valid"))


@query("A08_complete_channels", f"SELECT CAST(r.ch AS BIGINT) AS ch, round(m.mean, 6) AS mean, coalesce(m.n, 0) AS n FROM (SELECT unnest(generate_series(1, 70)) AS ch) r LEFT JOIN (SELECT ch, avg(v) AS mean, count(*) AS n FROM {S} WHERE v > 2 GROUP BY ch) m ON m.ch = r.ch")
def _(t):
    found = t.signal.filter("v > 2").groupBy("ch").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    return t.spark.range(1, 71).withColumnRenamed("id", "ch").join(found, "ch", "left").select("ch", F.round("mean", 6).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


@query("A14_average_null_as_zero", f"SELECT ch, round(sum(CASE WHEN v > 0 THEN v ELSE 0 END) / count(DISTINCT label), 6) AS mean FROM {S} GROUP BY ch")
def _(t):
    return t.signal.groupBy("ch").agg(F.round(F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(0.0)) / F.countDistinct("label"), 6).alias("mean"))


@query("A15_vote", f"SELECT ch, round(avg(v), 6) AS mean, CASE WHEN min(CAST(s = 1 AS INT)) = 1 THEN 1 WHEN max(CAST(s = 0 AS INT)) = 1 THEN 0 ELSE 2 END AS status FROM (SELECT ch, v, CASE WHEN v > 2.9 THEN 0 WHEN v > 2 THEN 2 ELSE 1 END AS s FROM {S}) GROUP BY ch")
def _(t):
    s = t.signal.withColumn("s", F.when(F.col("v") > 2.9, 0).when(F.col("v") > 2, 2).otherwise(1))
    return s.groupBy("ch").agg(F.round(F.avg("v"), 6).alias("mean"), st.vote(F.col("s")).alias("status"))


@query("A16_sign_split_means", f"SELECT ch, round(avg(CASE WHEN v > 0 THEN v END), 6) AS above, round(avg(CASE WHEN v < 0 THEN v END), 6) AS below FROM {S} GROUP BY ch")
def _(t):
    return t.signal.groupBy("ch").agg(F.round(F.avg(F.when(F.col("v") > 0, F.col("v"))), 6).alias("above"), F.round(F.avg(F.when(F.col("v") < 0, F.col("v"))), 6).alias("below"))


@query("A17_percentile", f"SELECT ch, round(p, 6) AS p FROM ({prctile_sql(f'(SELECT ch, abs(v) AS v FROM {S})', 0.995, 'p', 'ch')})")
def _(t):
    return st.prctile(t.signal.withColumn("v", F.abs("v")), ["ch"], "v", 99.5).select("ch", F.round("p", 6).alias("p"))


@query("A17_global_percentile", f"SELECT round(p, 6) AS p FROM ({prctile_sql(f'(SELECT v FROM {S})', 0.995, 'p')})")
def _(t):
    return st.prctile(t.signal, [], "v", 99.5).select(F.round("p", 6).alias("p"))


@query("A19_linear_percentile", f"SELECT ch, round(quantile_cont(v, 0.6), 6) AS p FROM {S} GROUP BY ch")
def _(t):
    return st.quantile(t.signal, ["ch"], "v", 0.6).select("ch", F.round("p", 6).alias("p"))


@query("A20_population_sd", f"SELECT ch, round(stddev_pop(v), 6) AS sd FROM {S} GROUP BY ch")
def _(t):
    return t.signal.groupBy("ch").agg(F.round(F.stddev_pop("v"), 6).alias("sd"))


@query("A21_baseline_threshold", f"SELECT s.ch, count(*) AS n FROM {S} s JOIN (SELECT ch, 2 * stddev_pop(v) AS k FROM {S} WHERE i < 100 GROUP BY ch) b ON b.ch = s.ch WHERE abs(s.v) > b.k GROUP BY s.ch")
def _(t):
    base = t.signal.filter("i < 100").groupBy("ch").agg((2 * F.stddev_pop("v")).alias("k"))
    return t.signal.join(F.broadcast(base), "ch").filter(F.abs("v") > F.col("k")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@query("A22_mode", "SELECT user_id, min(event_type) AS mode FROM (SELECT user_id, event_type, n, max(n) OVER (PARTITION BY user_id) AS most FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE n = most GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.mode("event_type", True).alias("mode"))


@query("A23_median_peak", f"SELECT label, round(median(peak)) AS anchor FROM (SELECT label, ch, arg_max(i, (v, -i)) AS peak FROM {S} GROUP BY label, ch) GROUP BY label")
def _(t):
    peaks = t.signal.groupBy("label", "ch").agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("peak"))
    return st.quantile(peaks, ["label"], "peak", 0.5).select("label", F.round("p").alias("anchor"))


@query("A24_argmax", f"SELECT i, arg_max(ch, (v, -ch)) AS top, arg_min(ch, (v, ch)) AS low FROM {S} GROUP BY i")
def _(t):
    return t.signal.groupBy("i").agg(F.max_by("ch", F.struct("v", -F.col("ch"))).alias("top"), F.min_by("ch", F.struct("v", "ch")).alias("low"))


@query("A27_circular_mean", f"""SELECT label, round((degrees(atan2(y, x)) % 360 + 360) % 360, 4) AS mean_deg, round(sqrt(x * x + y * y), 6) AS r, n FROM (SELECT label, avg(cos(radians(v * 40))) AS x, avg(sin(radians(v * 40))) AS y, count(v) AS n FROM {S} GROUP BY label)""")
def _(t):
    out = st.circular_mean(t.signal.withColumn("deg", F.col("v") * 40), ["label"], "deg")
    return out.select("label", F.round("mean_deg", 4).alias("mean_deg"), F.round("r", 6).alias("r"), "n")


@query("A27_circular_mean_weighted", f"""SELECT label, round((degrees(atan2(y, x)) % 360 + 360) % 360, 4) AS mean_deg, round(sqrt(x * x + y * y), 6) AS r, n FROM (SELECT label, avg(abs(v) * cos(radians(v * 40))) AS x, avg(abs(v) * sin(radians(v * 40))) AS y, count(v) AS n FROM {S} GROUP BY label)""")
def _(t):
    out = st.circular_mean(t.signal.withColumn("deg", F.col("v") * 40).withColumn("w", F.abs("v")), ["label"], "deg", "w")
    return out.select("label", F.round("mean_deg", 4).alias("mean_deg"), F.round("r", 6).alias("r"), "n")


@query("A28_rayleigh", f"""SELECT ch, round(least(greatest(exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * z ** 3 - 9 * z ** 4) / (288 * n * n)), 0), 1), 6) AS p FROM (SELECT ch, n, n * r2 AS z FROM (SELECT ch, count(v) AS n, avg(cos(radians(v * 40))) ** 2 + avg(sin(radians(v * 40))) ** 2 AS r2 FROM {S} GROUP BY ch))""")
def _(t):
    out = st.circular_mean(t.signal.withColumn("deg", F.col("v") * 40), ["ch"], "deg")
    return out.select("ch", F.round(st.rayleigh_p(F.col("r"), F.col("n")), 6).alias("p"))


@query("A31_missing_share", f"SELECT ch, round(100.0 * count(CASE WHEN v < 0 THEN 1 END) / count(*), 4) AS percent, min(CASE WHEN v >= 0 THEN i END) AS first_i, max(CASE WHEN v >= 0 THEN i END) AS last_i FROM {S} GROUP BY ch")
def _(t):
    v = F.col("v")
    return t.signal.groupBy("ch").agg(F.round(100.0 * F.count_if(v < 0) / F.count(F.lit(1)), 4).alias("percent"), F.min(F.when(v >= 0, F.col("i"))).alias("first_i"), F.max(F.when(v >= 0, F.col("i"))).alias("last_i"))


@query("X25_min_max_scaled", f"SELECT i, ch, round(CASE WHEN max(v) OVER w = min(v) OVER w THEN 0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END, 6) AS x FROM {S} WINDOW w AS (PARTITION BY ch)")
def _(t):
    return t.signal.select("i", "ch", F.round(st.min_max_scaled(F.col("v"), ["ch"]), 6).alias("x"))


@query("J13_neighbour_interpolation", f"""SELECT i, ch, round(CASE WHEN ch % 9 <> 0 THEN v ELSE (coalesce(lo, hi) + coalesce(hi, lo)) / 2 END, 6) AS v FROM (SELECT *, last_value(CASE WHEN ch % 9 <> 0 THEN v END IGNORE NULLS) OVER (PARTITION BY i ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
    first_value(CASE WHEN ch % 9 <> 0 THEN v END IGNORE NULLS) OVER (PARTITION BY i ORDER BY ch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM {S})""")  # fmt: skip
def _(t):
    """Every ninth channel is noisy: the mean of the nearest clean ones on both sides."""
    clean = F.when(F.col("ch") % 9 != 0, F.col("v"))
    w = Window.partitionBy("i").orderBy("ch")
    lo, hi = F.last(clean, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(clean, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = t.signal.select("i", "ch", clean.alias("own"), lo.alias("lo"), hi.alias("hi"))
    return both.select("i", "ch", F.round(F.coalesce("own", (F.coalesce("lo", "hi") + F.coalesce("hi", "lo")) / 2), 6).alias("v"))


@query("W03_next_channel_fill", f"SELECT i, ch, CASE WHEN ch % 2 = 1 THEN lead(v) OVER w ELSE v END AS v, CASE WHEN ch % 2 = 1 AND lead(ch) OVER w = ch + 1 THEN 'Interpolated' ELSE 'Measured' END AS kind FROM {S} WINDOW w AS (PARTITION BY i ORDER BY ch)")
def _(t):
    w = Window.partitionBy("i").orderBy("ch")
    nxt = F.lead(F.struct("ch", "v")).over(w)
    odd = (F.col("ch") % 2 == 1) & (nxt["ch"] == F.col("ch") + 1)
    return t.signal.select("i", "ch", F.when(odd, nxt["v"]).when(F.col("ch") % 2 == 0, F.col("v")).alias("v"), F.when(odd, "Interpolated").otherwise("Measured").alias("kind"))


@query("D28_polarity", f"SELECT i, CASE WHEN arg_max(v, (abs(v), -ch)) < 0 THEN -1 ELSE 1 END AS polarity FROM {S} GROUP BY i")
def _(t):
    peak = t.signal.groupBy("i").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("ch"))).alias("p"))
    return peak.select("i", F.when(F.col("p") < 0, -1).otherwise(1).alias("polarity"))


@query("R08_event_limits", f"SELECT ev, round(p, 6) AS p FROM ({prctile_sql(f'(SELECT ev, abs(v) AS v FROM {WINDOWS})', 0.99, 'p', 'ev')})")
def _(t):
    anchors = t.embeddings.select(F.col("vec_id").alias("ev"), F.col("vec_id").alias("at"))
    w = eb.window_rows(t.samples, anchors, 5).withColumn("v", F.abs("v"))
    return st.prctile(w, ["ev"], "v", 99.0).select("ev", F.round("p", 6).alias("p"))


@query("R11_waterfall_spacing", f"SELECT round(1.01 * max(d), 6) AS spacing FROM (SELECT max(v) - min(v) AS d FROM {S} GROUP BY ch)")
def _(t):
    return t.signal.groupBy("ch").agg((F.max("v") - F.min("v")).alias("d")).agg(F.round(1.01 * F.max("d"), 6).alias("spacing"))


@query("R27_channel_sums", f"SELECT i, round(sum(v), 5) AS total FROM {S} GROUP BY i")
def _(t):
    return t.signal.groupBy("i").agg(F.round(F.sum(st.missing(F.col("v"))), 5).alias("total"))


@query("R31_strict_windows", f"SELECT ev, ch FROM {WINDOWS} GROUP BY ev, ch HAVING bool_and(v < 3)")
def _(t):
    anchors = t.embeddings.select(F.col("vec_id").alias("ev"), F.col("vec_id").alias("at"))
    return eb.windows_below(t.samples, anchors, 5, 3.0)


@query("D34_template_warp", f"""WITH p AS (SELECT label AS session, CASE WHEN ch <= 10 THEN 'A' WHEN ch <= 25 THEN 'B' ELSE 'C' END AS region, ch - CASE WHEN ch <= 10 THEN 0 WHEN ch <= 25 THEN 10 ELSE 25 END AS pos, avg(v) AS v FROM {S} GROUP BY ALL),
    z AS (SELECT session, region, max(pos) AS n FROM p GROUP BY ALL), q AS (SELECT * FROM (VALUES ('A', 14), ('B', 9), ('C', 41), ('D', 2)) q(region, target)),
    g AS (SELECT s.session, q.region, q.target, unnest(generate_series(1, q.target)) AS r FROM (SELECT DISTINCT session FROM p) s CROSS JOIN q),
    x AS (SELECT g.session, g.region, g.r, z.n, 1 + (g.r - 1) * (z.n - 1) / (g.target - 1) AS x FROM g LEFT JOIN z ON z.session = g.session AND z.region = g.region)
    SELECT x.session, x.region, x.r AS row, round(a.v + (b.v - a.v) * (x.x - floor(x.x)), 5) AS v, CASE WHEN x.n IS NULL THEN 1 ELSE 0 END AS status FROM x LEFT JOIN p a ON a.session = x.session AND a.region = x.region AND a.pos = floor(x.x) LEFT JOIN p b ON b.session = x.session AND b.region = x.region AND b.pos = ceil(x.x)""")  # fmt: skip
def _(t):
    ch = F.col("ch")
    start = F.when(ch <= 10, 0).when(ch <= 25, 10).otherwise(25)
    region = F.when(ch <= 10, "A").when(ch <= 25, "B").otherwise("C")
    p = t.signal.groupBy(F.col("label").alias("session"), region.alias("region"), (ch - start).alias("pos")).agg(F.avg("v").alias("v"))
    template = t.spark.createDataFrame([("A", 14), ("B", 9), ("C", 41), ("D", 2)], "region string, target int")
    return sg.warp_to_template(p, template).select("session", "region", "row", F.round("v", 5).alias("v"), "status")


@query("D42_cross_correlation", f"""SELECT x.lag, round(sum(x.v * y.v) / (SELECT sqrt(sum(CASE WHEN ch = 1 THEN v * v END) * sum(CASE WHEN ch = 2 THEN v * v END)) FROM {S} WHERE ch IN (1, 2)), 6) AS r
    FROM (SELECT i, v, unnest(generate_series(-20, 20)) AS lag FROM {S} WHERE ch = 1) x JOIN (SELECT i, v FROM {S} WHERE ch = 2) y ON y.i = x.i + x.lag GROUP BY x.lag""")  # fmt: skip
def _(t):
    return sp.cross_correlation(t.signal, 1, 2, 20).select("lag", F.round("r", 6).alias("r"))


@query("D32_standard_source_density", f"SELECT i, ch, round(csd, 2) AS csd FROM (SELECT i, ch, -0.3 / 0.00005 * (lag(v) OVER w - 2 * v + lead(v) OVER w) AS csd FROM {S} WINDOW w AS (PARTITION BY i ORDER BY ch)) WHERE csd IS NOT NULL")
def _(t):
    return inverse_source_density(t.signal, ["i"], 64, "standard").select("i", "ch", F.round("csd", 2).alias("csd"))


def inverse_sql(method: str, **options: object) -> str:
    """The matrix's entries as a table, joined and summed."""
    m = density_matrix(64, method, **options)
    entries = ", ".join(f"({a + 1}, {b + 1}, {float(m[a, b])!r}::DOUBLE)" for a, b in zip(*np.nonzero(m)))
    return f"SELECT s.i, CAST(m.o AS INT) AS ch, round(sum(m.f * s.v) / 1e6, 6) AS csd FROM {S} s JOIN (VALUES {entries}) m(o, ch, f) ON m.ch = s.ch GROUP BY s.i, m.o"


@query("D32_delta_source_density", inverse_sql("delta"))
def _(t):
    return inverse_source_density(t.signal, ["i"], 64, "delta").select("i", "ch", F.round(F.col("csd") / 1e6, 6).alias("csd"))


@query("D32_step_source_density", inverse_sql("step"))
def _(t):
    return inverse_source_density(t.signal, ["i"], 64, "step").select("i", "ch", F.round(F.col("csd") / 1e6, 6).alias("csd"))


@query("D32_spline_source_density", inverse_sql("spline", steps=40))
def _(t):
    return inverse_source_density(t.signal, ["i"], 64, "spline", steps=40).select("i", "ch", F.round(F.col("csd") / 1e6, 6).alias("csd"))


@query("D32_smoothed_source_density", inverse_sql("delta", smooth=("gaussian", 5, 1.0)))
def _(t):
    return inverse_source_density(t.signal, ["i"], 64, "delta", ("gaussian", 5, 1.0)).select("i", "ch", F.round(F.col("csd") / 1e6, 6).alias("csd"))


@query("D32_doubled_ends", f"""SELECT i, ch, round(-0.3 / 0.00005 * (coalesce(lag(v) OVER w, v) - 2 * v + coalesce(lead(v) OVER w, v)) / 1e6, 6) AS csd FROM {S} WINDOW w AS (PARTITION BY i ORDER BY ch)""")
def _(t):
    return inverse_source_density(t.signal, ["i"], 64, "standard", doubled_ends=True).select("i", "ch", F.round(F.col("csd") / 1e6, 6).alias("csd"))


@query("D09_band_pass")
def _(t):
    return sp.band_passed(t.signal, 1000, 25, 55)


@query("D16_peaks")
def _(t):
    return sp.detected_peaks(t.signal, "v", 2.0, 100)


@query("D15_envelope_peaks")
def _(t):
    return sp.detected_peaks(sp.band_passed(t.signal, 1000, 120, 180), "envelope", 2.0, 100)


#: The one-sided density of windows of 128 samples at 1 kHz, by a sum over a table of cosines and sines.
PSD = f"""(WITH x AS (SELECT ch, i // 128 AS w, i % 128 AS k, v FROM {S}), m AS (SELECT ch, w, avg(v) AS mean FROM x GROUP BY ch, w HAVING count(*) = 128),
    y AS (SELECT x.ch, x.w, x.k, (x.v - m.mean) * (0.5 - 0.5 * cos(2 * pi() * x.k / 128)) AS v FROM x JOIN m USING (ch, w)),
    f AS (SELECT y.ch, y.w, f.f, sum(y.v * cos(2 * pi() * f.f * y.k / 128)) AS re, sum(y.v * sin(2 * pi() * f.f * y.k / 128)) AS im FROM y CROSS JOIN (SELECT unnest(generate_series(0, 64)) AS f) f GROUP BY y.ch, y.w, f.f)
    SELECT ch, f * 1000 / 128.0 AS hz, avg((re * re + im * im) * CASE WHEN f IN (0, 64) THEN 1 ELSE 2 END / (1000 * 48.0)) AS power FROM f GROUP BY ch, f)"""


@query("D37_mean_psd", f"SELECT ch, hz, round(power, 9) AS power FROM {PSD}")
def _(t):
    return sp.mean_psd(t.signal, 1000, 128).select("ch", "hz", F.round("power", 9).alias("power"))


@query("A33_band_power", f"""SELECT ch, round(sum(power) FILTER (hz BETWEEN 4 AND 12) / sum(power), 6) AS theta, round(sum(power) FILTER (hz BETWEEN 30 AND 50) / sum(power), 6) AS low_gamma,
    round(sum(power) FILTER (hz BETWEEN 70 AND 90) / sum(power), 6) AS high_gamma, arg_max(hz, power) AS peak_hz FROM {PSD} GROUP BY ch""")  # fmt: skip
def _(t):
    """Share of power in three bands and the strongest frequency of each channel."""
    p = sp.mean_psd(t.signal, 1000, 128)
    band = lambda lo, hi: F.round(F.sum(F.when(F.col("hz").between(lo, hi), F.col("power"))) / F.sum("power"), 6)
    return p.groupBy("ch").agg(band(4, 12).alias("theta"), band(30, 50).alias("low_gamma"), band(70, 90).alias("high_gamma"), F.max_by("hz", "power").alias("peak_hz"))


@query("D41_coherence", f"""WITH x AS (SELECT ch, w, i - w * 32 AS k, v FROM (SELECT ch, i, v, unnest([i // 32, i // 32 - 1]) AS w FROM {S} WHERE ch IN (1, 2)) WHERE w >= 0), m AS (SELECT ch, w, avg(v) AS mean FROM x GROUP BY ch, w HAVING count(*) = 64),
    y AS (SELECT x.ch, x.w, x.k, (x.v - m.mean) * (0.5 - 0.5 * cos(2 * pi() * x.k / 64)) AS v FROM x JOIN m USING (ch, w)),
    f AS (SELECT y.ch, y.w, f.f, sum(y.v * cos(2 * pi() * f.f * y.k / 64)) AS re, sum(y.v * sin(2 * pi() * f.f * y.k / 64)) AS im FROM y CROSS JOIN (SELECT unnest(generate_series(0, 32)) AS f) f GROUP BY y.ch, y.w, f.f),
    s AS (SELECT a.f, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im, sum(a.re * a.re + a.im * a.im) AS xx, sum(b.re * b.re + b.im * b.im) AS yy FROM f a JOIN f b ON b.w = a.w AND b.f = a.f AND a.ch = 1 AND b.ch = 2 GROUP BY a.f)
    SELECT f * 1000 / 64.0 AS hz, round((re * re + im * im) / (xx * yy), 6) AS coherence FROM s""")  # fmt: skip
def _(t):
    return sp.coherence(t.signal, 1, 2, 1000, 64).select("hz", F.round("coherence", 6).alias("coherence"))


@query("D49_pca_clusters")
def _(t):
    return pca_clusters(t.embeddings, "vec_id", "embedding")


@query("D49_density_clusters", """WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
    n AS MATERIALIZED (SELECT a.id, b.id AS other FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03::DOUBLE * 0.03::DOUBLE),
    c AS MATERIALIZED (SELECT id FROM n GROUP BY id HAVING count(*) >= 5), e AS MATERIALIZED (SELECT n.id, n.other FROM n JOIN c ON c.id = n.id JOIN c d ON d.id = n.other),
    r AS (SELECT id, other FROM e UNION SELECT r.id, e.other FROM r JOIN e ON e.id = r.other), k AS MATERIALIZED (SELECT id, min(other) AS cluster FROM r GROUP BY id)
    SELECT p.id, coalesce(any_value(k.cluster), min(o.cluster)) AS cluster, any_value(k.cluster) IS NOT NULL AS core FROM p LEFT JOIN k ON k.id = p.id JOIN n ON n.id = p.id LEFT JOIN k o ON o.id = n.other GROUP BY p.id""")
def _(t):
    """Clusters by density in the plane of the first two components; points of none have no cluster."""
    e = t.embeddings
    return dbscan(e.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y")), 0.03, 5)


_ROWS = f"(SELECT DISTINCT label AS session, ch AS row, list_extract([{', '.join(repr(r) for r in REGION_ORDER)}], CAST(floor((ch + label % 5 - 4) / 7.0) AS INT) + 1) AS region FROM {S} WHERE ch BETWEEN 1 + label % 3 AND 64)"
_NAMES = ", ".join(f"({k}, '{r}')" for k, r in enumerate((ABOVE, *REGION_ORDER, BELOW)))


@query("D36_golden_template", f"""WITH l AS (SELECT session, row, CASE WHEN row + session % 5 >= 4 THEN region END AS region FROM {_ROWS}), b AS (SELECT session, min(row) AS lo, max(row) AS hi FROM l GROUP BY session),
    x AS (SELECT l.session, l.region, count(*) AS n, min(l.row) AS top, max(l.row) AS bottom, any_value(b.lo) AS lo, any_value(b.hi) AS hi FROM l JOIN b USING (session) WHERE l.region IS NOT NULL GROUP BY l.session, l.region),
    k AS (SELECT region, n FROM x WHERE NOT (region = '{REGION_ORDER[0]}' AND top = lo) AND NOT (region = '{REGION_ORDER[-1]}' AND bottom = hi)
        UNION ALL SELECT '{ABOVE}', greatest(top - 1, 0) FROM x WHERE region = '{REGION_ORDER[0]}' AND top > 1 UNION ALL SELECT '{BELOW}', greatest(64 - bottom, 0) FROM x WHERE region = '{REGION_ORDER[-1]}' AND bottom < 64),
    m AS (SELECT region, avg(n) AS mean_thickness, CAST(round_even(avg(n), 0) AS INT) AS target FROM k GROUP BY region),
    s AS (SELECT 64 - sum(target) AS lack, max(target) FILTER (region = '{ABOVE}') AS above, max(target) FILTER (region = '{BELOW}') AS below FROM m)
    SELECT o.place, m.region, m.mean_thickness, CAST(m.target + CASE WHEN m.region = CASE WHEN above >= below THEN '{ABOVE}' WHEN above < below THEN '{BELOW}' END THEN lack ELSE 0 END AS INT) AS target FROM m JOIN (VALUES {_NAMES}) o(place, region) USING (region) CROSS JOIN s""")  # fmt: skip
def _(t):
    """Each label is a session whose regions are cut out of the channels by its number; some sessions begin below the first channel."""
    cut = F.floor((F.col("ch") + F.col("label") % 5 - 4) / 7)
    names = F.array(*map(F.lit, REGION_ORDER))
    region = F.when(cut.between(0, 7), F.get(names, cut.cast("int")))
    return golden_template(t.signal.filter(F.col("ch") > F.col("label") % 3).select(F.col("label").alias("session"), F.col("ch").alias("row"), region.alias("region")).distinct())
