"""Queries that measure events in the 64-channel signal, and that smooth and resample it. Every sample of the table is an event."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cortexlake.operators import event_blocks as eb
from cortexlake.operators import peaks as pk
from cortexlake.operators import signals as sg
from cortexlake.operators import smoothing as sm
from cortexlake.operators import stats as st
from cortexlake.plans.arrays import prctile_sql
from cortexlake.plans.registry import S, Tables, query

#: Channel whose peak an event is moved to.
REFERENCE = 32
EVENTS = f"(SELECT a.vec_id AS ev, a.vec_id AS mid, o.off, s.ch, s.v FROM embeddings a CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS off) o JOIN {S} s ON s.i = a.vec_id + o.off)"
ANCHORS = f"""(SELECT ev, arg_max(mid + off, (abs(v), -off)) AS "at" FROM {EVENTS} WHERE ch = {REFERENCE} GROUP BY ev)"""


def anchors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("ev"), F.col("vec_id").alias("at"))


def windows(t: Tables, half: int = 5):
    return eb.window_rows(t.samples, anchors(t), half)


def reference(t: Tables):
    return sg.event_windows(t.signal.filter(F.col("ch") == REFERENCE), anchors(t), 5).filter("ch is not null")


def widths_sql(trace: str, key: str, by: str, level: str) -> str:
    """The widths of peaks by joins of each trace with itself."""
    order = {"abs": "abs(v)", "max": "v", "min": "-v"}[by]
    at = "h / 2" if level == "height" else "h - (h - greatest(min(z.v) FILTER (z.off <= p), min(z.v) FILTER (z.off >= p))) / 2"
    return f"""WITH t AS (SELECT * FROM {trace}), k AS (SELECT {key}, arg_max(off, ({order}, -off)) AS p, arg_max(v, ({order}, -off)) AS a FROM t GROUP BY {key}),
    s AS (SELECT k.*, CASE WHEN a < 0 THEN -1.0 ELSE 1.0 END AS s FROM k), z AS (SELECT t.{key}, t.off, t.v * s.s AS v FROM t JOIN s USING ({key})),
    g AS (SELECT s.{key}, p, a, s, a * s AS h FROM s), l AS (SELECT g.{key}, p, a, s, {at} AS level FROM g JOIN z USING ({key}) GROUP BY g.{key}, p, a, s, h),
    c AS (SELECT l.{key}, max(z.off) FILTER (z.off < p AND z.v < level) AS lo, min(z.off) FILTER (z.off > p AND z.v < level) AS hi FROM l JOIN z USING ({key}) GROUP BY l.{key})
    SELECT l.{key}, l.p, round(l.a, 6) AS a, round((c.hi - (level - zh.v) / (zh1.v - zh.v)) - (c.lo + (level - zl.v) / (zl1.v - zl.v)), 4) AS width FROM l JOIN c USING ({key})
    LEFT JOIN z zl ON zl.{key} = l.{key} AND zl.off = c.lo LEFT JOIN z zl1 ON zl1.{key} = l.{key} AND zl1.off = c.lo + 1 LEFT JOIN z zh ON zh.{key} = l.{key} AND zh.off = c.hi LEFT JOIN z zh1 ON zh1.{key} = l.{key} AND zh1.off = c.hi - 1"""


def widths(trace, key: str, by: str, level: str):
    return pk.peak_widths(trace, [key], by, level).select(key, "p", F.round("a", 6).alias("a"), F.round("width", 4).alias("width"))


@query("D03_flip_and_reverse", f"SELECT ch, max(i) OVER (PARTITION BY ch) + min(i) OVER (PARTITION BY ch) - i AS i, -v AS v FROM {S}")
def _(t):
    ends = t.signal.groupBy("ch").agg((F.max("i") + F.min("i")).alias("both"))
    return t.signal.join(ends, "ch").select("ch", (F.col("both") - F.col("i")).alias("i"), (-F.col("v")).alias("v"))


@query("D04_rational_resample", f"""SELECT ch, i, round(sum(v * w) / sum(w), 5) AS v FROM (SELECT ch, i, v, CASE WHEN abs(d) < 1e-12 THEN 1.0 WHEN abs(d) < 4 THEN sin(pi() * d) / (pi() * d) * (0.5 + 0.5 * cos(pi() * d / 4)) ELSE 0.0 END AS w
    FROM (SELECT s.ch, m.i, s.v, (m.i * 5 / 2 - s.i) * 0.4 AS d FROM {S} s JOIN (SELECT unnest(generate_series(0, (SELECT max(vec_id) * 2 // 5 FROM embeddings))) AS i) m ON s.i BETWEEN m.i * 5 / 2 - 10 AND m.i * 5 / 2 + 10)) GROUP BY ch, i""")  # fmt: skip
def _(t):
    return sm.resampled(t.signal, 400, 1000).select("ch", "i", F.round("v", 5).alias("v"))


@query("D06_repeat_and_bin", f"SELECT ch, i, round(v, 6) AS v FROM (SELECT ch, j // 3 AS i, avg(v) AS v, count(*) AS n FROM (SELECT ch, v, unnest([2 * i, 2 * i + 1]) AS j FROM {S}) GROUP BY 1, 2) WHERE n = 3")
def _(t):
    return sm.repeated_and_binned(t.signal, 2, 3).select("ch", "i", F.round("v", 6).alias("v"))


def taps_sql(weights) -> str:
    return "(VALUES " + ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in weights) + ") k(k, w)"


LOW_PASS = sm.gaussian(2.0, 6)


@query("D44_decimate", f"SELECT p.ch, p.i, round(sum(s.v * k.w) / sum(k.w), 6) AS v FROM {S} p CROSS JOIN {taps_sql(LOW_PASS)} JOIN {S} s ON s.ch = p.ch AND s.i = p.i + k.k WHERE p.i % 4 = 0 GROUP BY p.ch, p.i")
def _(t):
    return sm.weighted(t.signal, "i", LOW_PASS, 4).select("ch", "i", F.round("v", 6).alias("v"))


SPEED = f"(SELECT ch, i, abs(v - lag(v) OVER (PARTITION BY ch ORDER BY i)) AS v FROM {S})"


@query("D46_smoothed_speed", f"SELECT p.ch, p.i, round(sum(s.v * k.w) / sum(k.w), 6) AS v FROM {S} p CROSS JOIN {taps_sql(sm.gaussian(1.5, 4))} JOIN {SPEED} s ON s.ch = p.ch AND s.i = p.i + k.k WHERE s.v IS NOT NULL AND p.i IN (SELECT i FROM {SPEED} WHERE v IS NOT NULL) GROUP BY p.ch, p.i")
def _(t):
    speed = t.signal.withColumn("v", F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("ch").orderBy("i")))).filter("v is not null")
    return sm.weighted(speed, "i", sm.gaussian(1.5, 4)).select("ch", "i", F.round("v", 6).alias("v"))


BLUR = sm.gaussian(1.0, 2)


@query("D47_blur", f"""WITH a AS (SELECT p.ch, p.i, sum(s.v * k.w) / sum(k.w) AS v FROM {S} p CROSS JOIN {taps_sql(BLUR)} JOIN {S} s ON s.i = p.i AND s.ch = p.ch + k.k GROUP BY p.ch, p.i)
    SELECT p.ch, p.i, round(sum(s.v * k.w) / sum(k.w), 6) AS v FROM a p CROSS JOIN {taps_sql(BLUR)} JOIN a s ON s.ch = p.ch AND s.i = p.i + k.k GROUP BY p.ch, p.i""")  # fmt: skip
def _(t):
    return sm.weighted(sm.weighted(t.signal, "ch", BLUR), "i", BLUR).select("ch", "i", F.round("v", 6).alias("v"))


@query("D21_anchors", f"SELECT * FROM {ANCHORS}")
def _(t):
    return pk.anchors_at_peaks(t.signal, anchors(t), 5, REFERENCE)


@query("D22_peak_aligned", f"""WITH p AS (SELECT ev, ch, arg_max(mid + off, (v, -off)) AS "at" FROM {EVENTS} GROUP BY ev, ch)
    SELECT p.ch, o.off, round(avg(s.v), 6) AS mean, count(*) AS n FROM p CROSS JOIN (SELECT unnest(generate_series(-3, 3)) AS off) o JOIN {S} s ON s.ch = p.ch AND s.i = p."at" + o.off GROUP BY p.ch, o.off""")  # fmt: skip
def _(t):
    own = pk.peak_of(windows(t), ["ev", "ch"], "max").join(anchors(t), "ev").select("ev", "ch", (F.col("at") + F.col("p")).alias("at"))
    placed = own.select("ch", "at", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("off")).withColumn("i", F.col("at") + F.col("off"))
    return placed.join(t.signal, ["ch", "i"]).groupBy("ch", "off").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("D23_padded_windows", f"SELECT a.vec_id AS ev, o.off, c.ch, s.v FROM embeddings a CROSS JOIN (SELECT unnest(generate_series(-4, 3)) AS off) o CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS ch) c LEFT JOIN {S} s ON s.i = a.vec_id + o.off AND s.ch = c.ch")
def _(t):
    return sg.padded_windows(t.signal, anchors(t), 4, 4, t.spark.range(1, 65).select(F.col("id").cast("int").alias("ch")))


@query("D24_whole_snippets", f"SELECT ev, ch, round(sum(v), 5) AS total, round(arg_min(v, off), 6) AS first_v, round(arg_max(v, off), 6) AS last_v FROM {EVENTS} GROUP BY ev, ch HAVING count(*) = 11")
def _(t):
    """Snippets that run past an end of the recording are left out."""
    each = eb.whole_windows(t.samples, anchors(t), 5)
    return each.select("ev", "ch", F.round("total", 5).alias("total"), F.round("first_v", 6).alias("first_v"), F.round("last_v", 6).alias("last_v"))


@query("D25_mean_trace_peak", widths_sql(f"(SELECT ch, off, round(avg(v), 9) AS v FROM {EVENTS} GROUP BY ch, off)", "ch", "abs", "height"))
def _(t):
    return widths(windows(t).groupBy("ch", "off").agg(F.round(F.avg("v"), 9).alias("v")), "ch", "abs", "height")


@query("D26_event_peaks", widths_sql(f"(SELECT ev, off, v FROM {EVENTS} WHERE ch = {REFERENCE})", "ev", "max", "height"))
def _(t):
    return widths(reference(t), "ev", "max", "height")


@query("D27_half_prominence", widths_sql(f"(SELECT ev, off, v FROM {EVENTS} WHERE ch = {REFERENCE})", "ev", "max", "prominence"))
def _(t):
    return widths(reference(t), "ev", "max", "prominence")


@query("W15_half_width", widths_sql(f"(SELECT label AS k, ch AS off, round(avg(v), 9) AS v FROM {S} GROUP BY label, ch)", "k", "max", "height"))
def _(t):
    return widths(t.signal.groupBy(F.col("label").alias("k"), F.col("ch").alias("off")).agg(F.round(F.avg("v"), 9).alias("v")), "k", "max", "height")


MANUAL = (3, 50, 120)


@query("D18_inserted_events", widths_sql(f"(SELECT ev, off, v FROM {EVENTS} WHERE ch = {REFERENCE} AND ev IN {MANUAL})", "ev", "abs", "height"))
def _(t):
    """Events set by hand, measured as the detected ones are."""
    by_hand = t.spark.createDataFrame([(k, k) for k in MANUAL], "ev long, at long")
    return widths(sg.event_windows(t.signal.filter(F.col("ch") == REFERENCE), by_hand, 5).filter("ch is not null"), "ev", "abs", "height")


CSD = f"(SELECT i, ch, -(lag(v) OVER w - 2 * v + lead(v) OVER w) AS csd FROM {S} WINDOW w AS (PARTITION BY i ORDER BY ch))"


@query("D29_centre_slices", f"""SELECT a.ev, c.ch, round(c.csd, 6) AS csd FROM {ANCHORS} a JOIN {CSD} c ON c.i = a."at" WHERE c.csd IS NOT NULL""")
def _(t):
    at = pk.anchors_at_peaks(t.signal, anchors(t), 5, REFERENCE)
    return at.join(sg.source_density(t.signal, ["i"]), F.col("at") == F.col("i")).filter("csd is not null").select("ev", "ch", F.round("csd", 6).alias("csd"))


@query("D31_window_means", f"SELECT ch, round(avg(near), 6) AS ground_zero, round(avg(late), 6) AS after_spike FROM (SELECT ev, ch, avg(v) FILTER (off BETWEEN -1 AND 1) AS near, avg(v) FILTER (off BETWEEN 2 AND 5) AS late FROM {EVENTS} GROUP BY ev, ch) GROUP BY ch")
def _(t):
    each = eb.mean_of_window_means(t.samples, anchors(t), 5, {"near": (-1, 1), "late": (2, 5)})
    return each.select("ch", F.round("near", 6).alias("ground_zero"), F.round("late", 6).alias("after_spike"))


@query("D33_normalised_density", f"SELECT i, ch, round(csd, 6) AS csd, round(f, 6) AS filtered, round(f / nullif(max(abs(f)) OVER (PARTITION BY i), 0), 6) AS normalised FROM (SELECT i, ch, csd, 0.25 * lag(csd) OVER w + 0.5 * csd + 0.25 * lead(csd) OVER w AS f FROM (SELECT * FROM {CSD} WHERE csd IS NOT NULL) WINDOW w AS (PARTITION BY i ORDER BY ch))")
def _(t):
    w = Window.partitionBy("i").orderBy("ch")
    raw = sg.source_density(t.signal, ["i"]).filter("csd is not null").select("i", "ch", "csd")
    smooth = raw.withColumn("f", 0.25 * F.lag("csd").over(w) + 0.5 * F.col("csd") + 0.25 * F.lead("csd").over(w))
    most = F.nullif(F.max(F.abs("f")).over(Window.partitionBy("i")), F.lit(0.0))
    return smooth.select("i", "ch", F.round("csd", 6).alias("csd"), F.round("f", 6).alias("filtered"), F.round(F.col("f") / most, 6).alias("normalised"))


GRID = f"(SELECT label, ch, avg(v) AS v, CASE WHEN ch BETWEEN 20 AND 22 THEN 1 WHEN (ch + label) % 5 = 0 OR ch < 3 THEN 2 ELSE 0 END AS status FROM {S} GROUP BY label, ch)"


@query("D35_filled_gaps", f"""SELECT label, ch, round(CASE WHEN status = 0 THEN v WHEN status = 2 THEN CASE WHEN lo.ch IS NULL THEN hi.v WHEN hi.ch IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) * (ch - lo.ch) / (hi.ch - lo.ch) END END, 6) AS v, status
    FROM (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY label ORDER BY ch) AS lo, last_value(k IGNORE NULLS) OVER (PARTITION BY label ORDER BY ch DESC) AS hi FROM (SELECT *, CASE WHEN status = 0 THEN {{'ch': ch, 'v': v}} END AS k FROM {GRID}))""")  # fmt: skip
def _(t):
    ch = F.col("ch")
    status = F.when(ch.between(20, 22), 1).when(((ch + F.col("label")) % 5 == 0) | (ch < 3), 2).otherwise(0)
    grid = t.signal.groupBy("label", "ch").agg(F.avg("v").alias("v")).withColumn("status", status)
    return sg.filled_gaps(grid, ["label"]).select("label", "ch", F.round("v", 6).alias("v"), "status")


FEATURES = f"(SELECT ch, avg(abs(v)) AS theta, stddev_pop(v) AS ripple, max(v) AS amp, count(CASE WHEN v > 2 THEN 1 END) AS n FROM {S} WHERE ch % 9 <> 0 GROUP BY ch)"


@query("D45_channel_choice", f"""SELECT (SELECT arg_max(ch, (theta, -ch)) FROM {FEATURES}) AS theta_ch, (SELECT arg_max(ch, (amp * n, -ch)) FROM {FEATURES}) AS spike_ch,
    (SELECT arg_max(ch, (ripple, -ch)) FROM (SELECT f.*, q.lim FROM {FEATURES} f CROSS JOIN (SELECT quantile_cont(ripple / theta, 0.6) AS lim FROM {FEATURES}) q) WHERE ripple / theta < lim) AS ripple_ch""")  # fmt: skip
def _(t):
    """Noisy channels, every ninth one, are left out; there are as many rows as channels."""
    f = t.signal.filter("ch % 9 <> 0").groupBy("ch").agg(F.avg(F.abs("v")).alias("theta"), F.stddev_pop("v").alias("ripple"), F.max("v").alias("amp"), F.count_if(F.col("v") > 2).alias("n"))
    limit = f.agg(F.percentile(F.col("ripple") / F.col("theta"), 0.6).alias("lim"))
    best = lambda x: F.max_by("ch", F.struct(x, -F.col("ch")))
    low = F.when(F.col("ripple") / F.col("theta") < F.col("lim"), F.col("ripple"))
    return f.join(F.broadcast(limit)).agg(best(F.col("theta")).alias("theta_ch"), best(F.col("amp") * F.col("n")).alias("spike_ch"), F.max(F.when(low.isNotNull(), F.struct(low, -F.col("ch"), "ch")))["ch"].alias("ripple_ch"))


@query("D48_noisy_interpolated", f"""WITH m AS (SELECT ch, avg(v) AS v, stddev_pop(v) AS sd FROM {S} GROUP BY ch), n AS (SELECT m.*, sd > (SELECT quantile_cont(sd, 0.8) FROM m) AS noisy FROM m)
    SELECT ch, noisy, round(CASE WHEN noisy THEN (coalesce(lo, hi) + coalesce(hi, lo)) / 2 ELSE v END, 6) AS v FROM (SELECT *, last_value(CASE WHEN NOT noisy THEN v END IGNORE NULLS) OVER (ORDER BY ch) AS lo, last_value(CASE WHEN NOT noisy THEN v END IGNORE NULLS) OVER (ORDER BY ch DESC) AS hi FROM n)""")  # fmt: skip
def _(t):
    """Channels that vary most are noisy. One row per channel, with the channel's place in its probe as the order."""
    m = t.signal.groupBy("ch").agg(F.avg("v").alias("v"), F.stddev_pop("v").alias("sd"))
    n = m.join(F.broadcast(m.agg(F.percentile("sd", 0.8).alias("lim")))).withColumn("noisy", F.col("sd") > F.col("lim")).withColumn("probe", F.lit(1))
    clean = F.when(~F.col("noisy"), F.col("v"))
    lo, hi = F.last(clean, True).over(Window.partitionBy("probe").orderBy("ch")), F.last(clean, True).over(Window.partitionBy("probe").orderBy(F.desc("ch")))
    both = n.withColumn("lo", lo).withColumn("hi", hi)
    return both.select("ch", "noisy", F.round(F.when(F.col("noisy"), (F.coalesce("lo", "hi") + F.coalesce("hi", "lo")) / 2).otherwise(F.col("v")), 6).alias("v"))


@query("D50_swapped_labels", "SELECT vec_id, CASE label WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE label END AS label FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.when(F.col("label") == 1, 2).when(F.col("label") == 2, 1).otherwise(F.col("label")).alias("label"))


@query("R07_voltage_warp", f"""WITH b AS (SELECT * FROM (VALUES ('A', 1, 10, 7), ('B', 11, 25, 9), ('C', 26, 64, 16)) b(region, lo, hi, target)), r AS (SELECT region, CAST(ceil(lo * 32 / 64.0) AS INT) AS lo, CAST(floor(hi * 32 / 64.0) AS INT) AS hi, target FROM b),
    m AS (SELECT label, (ch + 1) // 2 AS row, avg(v) AS v FROM {S} GROUP BY 1, 2), g AS (SELECT l.label, r.region, r.lo, r.hi, r.target, unnest(generate_series(1, r.target)) AS k FROM (SELECT DISTINCT label FROM m) l CROSS JOIN r),
    x AS (SELECT *, lo + (k - 1) * (hi - lo) / (target - 1.0) AS x FROM g) SELECT x.label, x.region, x.k, round(a.v + (c.v - a.v) * (x.x - floor(x.x)), 5) AS v FROM x JOIN m a ON a.label = x.label AND a.row = floor(x.x) JOIN m c ON c.label = x.label AND c.row = ceil(x.x)""")  # fmt: skip
def _(t):
    """A matrix of 32 rows stands for 64 channels: bounds are scaled to rows, rounded inwards."""
    m = t.signal.groupBy(F.col("label").alias("session"), F.floor((F.col("ch") + 1) / 2).alias("row")).agg(F.avg("v").alias("v"))
    bounds = t.spark.createDataFrame([("A", 1, 10, 7), ("B", 11, 25, 9), ("C", 26, 64, 16)], "region string, lo int, hi int, target int")
    scaled = bounds.select("region", "target", F.ceil(F.col("lo") * 32 / 64).alias("lo"), F.floor(F.col("hi") * 32 / 64).alias("hi"))
    profile = m.join(F.broadcast(scaled), F.col("row").between(F.col("lo"), F.col("hi"))).select("session", "region", (F.col("row") - F.col("lo") + 1).alias("pos"), "v")
    out = sg.warp_to_template(profile, scaled.select("region", "target"))
    return out.select(F.col("session").alias("label"), "region", F.col("row").alias("k"), F.round("v", 5).alias("v"))


@query("R09_aligned_twice", f"""WITH p AS (SELECT ev, ch, arg_max(mid + off, (v, -off)) AS "at" FROM {EVENTS} GROUP BY ev, ch),
    o AS (SELECT p.ch, o.off, s.v FROM p CROSS JOIN (SELECT unnest(generate_series(-5, 5)) AS off) o JOIN {S} s ON s.ch = p.ch AND s.i = p."at" + o.off)
    SELECT ch, off, 'midpoint' AS aligned, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem FROM {EVENTS} GROUP BY ch, off UNION ALL SELECT ch, off, 'peak', round(avg(v), 6), round(stddev_samp(v) / sqrt(count(v)), 6) FROM o GROUP BY ch, off""")  # fmt: skip
def _(t):
    w = windows(t)
    own = pk.peak_of(w, ["ev", "ch"], "max").join(anchors(t), "ev").select("ch", (F.col("at") + F.col("p")).alias("at"))
    at_peak = own.select("ch", "at", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("off")).withColumn("i", F.col("at") + F.col("off")).join(t.signal, ["ch", "i"]).select("ch", "off", "v")
    both = w.select("ch", "off", "v", F.lit("midpoint").alias("aligned")).unionByName(at_peak.withColumn("aligned", F.lit("peak")))
    return st.mean_sem(both, ["ch", "off", "aligned"], "v").select("ch", "off", "aligned", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query("R10_stacks_by_row", f"SELECT e.label, e.ch, round(avg(coalesce(s.v, e.v)), 6) AS mean FROM {S} e LEFT JOIN {S} s ON s.i = e.i AND s.ch = e.ch + e.label GROUP BY e.label, e.ch")
def _(t):
    """Each event's rows are shifted by an offset of its own; where that leads past the probe the row itself stands in."""
    moved = t.signal.select("i", F.col("ch").alias("to_ch"), F.col("v").alias("moved"))
    both = t.signal.withColumn("to_ch", F.col("ch") + F.col("label")).join(moved, ["i", "to_ch"], "left")
    return both.groupBy("label", "ch").agg(F.round(F.avg(F.coalesce("moved", "v")), 6).alias("mean"))


@query("R13_manual_anchors", f"""SELECT a.ev, coalesce(a.ev + m.ms, a."at") AS "at" FROM {ANCHORS} a LEFT JOIN (SELECT vec_id AS ev, vec_id % 7 - 3 AS ms FROM embeddings WHERE label = 4) m ON m.ev = a.ev""")
def _(t):
    """Anchors set by hand, for events of one label, come before found ones."""
    by_hand = t.embeddings.filter("label = 4").select(F.col("vec_id").alias("ev"), (F.col("vec_id") % 7 - 3).alias("ms"))
    found = pk.anchors_at_peaks(t.signal, anchors(t), 5, REFERENCE)
    return found.join(by_hand, "ev", "left").select("ev", F.coalesce(F.col("ev") + F.col("ms"), F.col("at")).alias("at"))


@query("R14_scaled_units", f"SELECT i, ch, v * 1e6 AS v, 'uV' AS unit FROM {S}")
def _(t):
    return t.signal.select("i", "ch", (F.col("v") * 1e6).alias("v"), F.lit("uV").alias("unit"))


@query("R15_zero_padded_matrix", f"SELECT g.i, c.ch, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT i FROM {S}) g CROSS JOIN (SELECT unnest(generate_series(2, 70, 2)) AS ch) c LEFT JOIN {S} s ON s.i = g.i AND s.ch = c.ch")
def _(t):
    """Even channels up to 70; the last three have no samples."""
    grid = t.embeddings.select(F.col("vec_id").alias("i"), F.explode(F.sequence(F.lit(2), F.lit(70), F.lit(2))).alias("ch"))
    return grid.join(t.signal, ["i", "ch"], "left").select("i", F.col("ch").cast("long").alias("ch"), F.coalesce("v", F.lit(0.0)).alias("v"))


@query("R16_raster_range", f"SELECT i, ch, v FROM {S} WHERE round(i / 64.0) BETWEEN 2 AND 5 AND ch NOT IN (7, 9)")
def _(t):
    """Samples by the numbers of the records that hold them, without excluded channels."""
    return t.signal.filter(F.round(F.col("i") / 64).between(2, 5) & ~F.col("ch").isin(7, 9)).select("i", "ch", "v")


@query("R18_session_view", f"SELECT s.label, s.ch, round(least(greatest(s.v, -q.p), q.p), 6) AS v FROM (SELECT label, ch, avg(v) AS v FROM {S} GROUP BY label, ch) s JOIN ({prctile_sql(f'(SELECT label, abs(v) AS v FROM {S})', 0.8, 'p', 'label')}) q ON q.label = s.label")
def _(t):
    limit = st.prctile(t.signal.withColumn("v", F.abs("v")), ["label"], "v", 80.0)
    means = t.signal.groupBy("label", "ch").agg(F.avg("v").alias("v"))
    return means.join(limit, "label").select("label", "ch", F.round(F.least(F.greatest("v", -F.col("p")), F.col("p")), 6).alias("v"))


@query("R19_blank_edge_rows", f"SELECT c.ch, round(m.v, 6) AS v FROM (SELECT unnest(generate_series(1, 64)) AS ch) c LEFT JOIN (SELECT ch, avg(v) AS v FROM {S} WHERE ch BETWEEN 2 AND 63 GROUP BY ch) m ON m.ch = c.ch")
def _(t):
    inner = t.signal.filter("ch BETWEEN 2 AND 63").groupBy("ch").agg(F.avg("v").alias("v"))
    return t.spark.range(1, 65).withColumnRenamed("id", "ch").join(inner, "ch", "left").select("ch", F.round("v", 6).alias("v"))


@query("R29_noise_left_out", f"SELECT ch, round(CASE WHEN ch % 9 = 0 THEN NULL WHEN hi = lo THEN 0 ELSE (p - lo) / (hi - lo) END, 6) AS x FROM (SELECT ch, p, max(CASE WHEN ch % 9 <> 0 THEN p END) OVER () AS hi, min(CASE WHEN ch % 9 <> 0 THEN p END) OVER () AS lo FROM (SELECT ch, avg(v * v) AS p FROM {S} GROUP BY ch))")
def _(t):
    p = t.signal.groupBy("ch").agg(F.avg(F.col("v") * F.col("v")).alias("p")).withColumn("p", F.when(F.col("ch") % 9 != 0, F.col("p")))
    ends = p.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    return p.join(F.broadcast(ends)).select("ch", F.round(F.when(F.col("p").isNull(), None).when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("x"))
