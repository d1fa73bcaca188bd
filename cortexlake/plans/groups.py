"""Queries over groups: bands, runs, orders inside groups, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cortexlake.operators import events as ev
from cortexlake.operators import stats as st
from cortexlake.plans.registry import HOUR, E, S, query


@query("A11_population_band", f"SELECT ch, avg(v) AS mean, stddev_pop(v) AS sd, stddev_pop(v) / sqrt(count(*)) AS sem FROM {S} GROUP BY 1")
def _(t):
    """The count in the error is that of all rows."""
    v = st.missing(F.col("v"))
    return t.signal.groupBy("ch").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), (F.stddev_pop(v) / F.sqrt(F.count(F.lit(1)))).alias("sem"))


@query("A12_sample_band", f"SELECT ch, label, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS se, count(v) AS n FROM {S} GROUP BY 1, 2")
def _(t):
    return st.mean_sem(t.signal, ["ch", "label"], "v").select("ch", "label", "mean", F.col("sem").alias("se"), "n")


@query("A13_mean_of_used", f"SELECT ch, sum(v) / (SELECT count(DISTINCT i) FROM {S} WHERE v > 0) AS mean FROM {S} WHERE v > 0 GROUP BY 1")
def _(t):
    """An event counts as used if any channel has a value; here, a positive one."""
    good = t.signal.filter("v > 0")
    used = good.agg(F.countDistinct("i").alias("used"))
    return good.groupBy("ch").agg(F.sum("v").alias("s")).crossJoin(F.broadcast(used)).select("ch", (F.col("s") / F.col("used")).alias("mean"))


@query("A32_channels_per_event", f"SELECT i, count(*) AS n FROM {S} WHERE v > 0.25 GROUP BY 1")
def _(t):
    return t.signal.filter("v > 0.25D").groupBy("i").agg(F.count(F.lit(1)).alias("n"))


def _islands(source: str, keys: str, at: str, gap: int, tie: str) -> str:
    return f"""(SELECT *, sum(CASE WHEN {at} - prev <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY {at}, {tie}) AS island
        FROM (SELECT *, lag({at}) OVER (PARTITION BY {keys} ORDER BY {at}, {tie}) AS prev FROM {source}))"""


@query("W08_stimulus_trains", f"SELECT session, min(t) AS first_us, max(t) - min(t) AS lasts_us, count(*) AS pulses FROM {_islands(f'(SELECT * FROM {E} WHERE code = $$click$$)', 'session', 't', 24 * HOUR, 'event_id')} GROUP BY session, island")
def _(t):
    trains = ev.with_island(t.timeline.filter("code = 'click'"), ["session"], "t", 24 * HOUR, "event_id")
    return trains.groupBy("session", "island").agg(F.min("t").alias("first_us"), (F.max("t") - F.min("t")).alias("lasts_us"), F.count(F.lit(1)).alias("pulses")).drop("island")


@query("W09_runs_above", f"SELECT ch, min(i) AS first_i, max(i) AS last_i, max(v) AS peak FROM {_islands(f'(SELECT * FROM {S} WHERE v > 0.25)', 'ch', 'i', 3, 'i')} GROUP BY ch, island")
def _(t):
    """Runs above the threshold, made one where at most three samples part them."""
    runs = ev.with_island(t.signal.filter("v > 0.25D"), ["ch"], "i", 3, "i")
    return runs.groupBy("ch", "island").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.max("v").alias("peak")).drop("island")


@query("W17_unknown_last", f"SELECT event_id, row_number() OVER (PARTITION BY session ORDER BY value < 50, t, event_id) AS place FROM {E}")
def _(t):
    w = Window.partitionBy("session").orderBy(F.col("value") < 50, "t", "event_id")
    return t.timeline.select("event_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("W21_first_of_session", f"SELECT session, event_id, code FROM {E} QUALIFY row_number() OVER (PARTITION BY session ORDER BY t, event_id) <= 5")
def _(t):
    return t.timeline.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("t", "event_id"))).filter("k <= 5").select("session", "event_id", "code")


@query("O03_preferred_first", "SELECT r_name, row_number() OVER (ORDER BY coalesce(list_position(['EUROPE', 'ASIA'], r_name), 99), r_name) AS place FROM region")
def _(t):
    """Few names, so one task ranks them; each keeps its place in the list of preferred ones, the rest follow by name."""
    preferred = F.array(F.lit("EUROPE"), F.lit("ASIA"))
    at = F.coalesce(F.nullif(F.array_position(preferred, F.col("r_name")), F.lit(0).cast("bigint")), F.lit(99))
    return t.region.select("r_name", F.row_number().over(Window.orderBy(at, "r_name")).cast("bigint").alias("place"))


@query("O06_three_of_each", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def _(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t.customer.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("c_nationkey", "c_custkey")


@query("O07_mixed_directions", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size ASC, p_retailprice DESC, p_partkey) AS place FROM part")
def _(t):
    w = Window.partitionBy("p_brand").orderBy(F.asc("p_size"), F.desc("p_retailprice"), "p_partkey")
    return t.part.select("p_partkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("O10_by_extracted_id", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)) AS place FROM customer")
def _(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.regexp_extract("c_name", r"(\d+)$", 1).try_cast("bigint"))
    return t.customer.select("c_custkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("U03_tagged_union", "SELECT c_name AS name, 'customer' AS source FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def _(t):
    tagged = [d.select(F.col(c).alias("name"), F.lit(s).alias("source")) for d, c, s in ((t.customer, "c_name", "customer"), (t.supplier, "s_name", "supplier"))]
    return tagged[0].unionByName(tagged[1])


@query("U08_melted", "SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount']) AS type, unnest([l_quantity, l_discount]) AS value FROM lineitem")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return d.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount"], "type", "value")


@query("U13_arrays_joined", "SELECT vec_id, CAST(embedding[1:4] || embedding[33:36] AS DOUBLE[]) AS both FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.concat(F.slice("embedding", 1, 4), F.slice("embedding", 33, 4)).cast("array<double>").alias("both"))


@query("U16_fixed_rows", "SELECT CAST(r AS INTEGER) AS row, coalesce(n, 0) AS n FROM range(1, 33) x(r) LEFT JOIN (SELECT p_size AS s, count(*) AS n FROM part GROUP BY 1) ON s = r")
def _(t):
    n = t.part.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    fixed = t.spark.range(1, 33).select(F.col("id").cast("int").alias("row"))
    return fixed.join(n, F.col("row") == F.col("p_size"), "left").select("row", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("F07_valid_only", "SELECT doc_id FROM labels WHERE quality = 1")
def _(t):
    return t.labels.filter("quality = 1").select("doc_id")


@query("F21_inside_recording", f"SELECT event_id FROM (SELECT e.*, max(t) OVER (PARTITION BY session) AS ends FROM {E} e) WHERE isfinite(value) AND value > 0 AND t - {HOUR} >= epoch_us(TIMESTAMP '2024-01-01') AND t + {HOUR} <= ends")
def _(t):
    """Events that are on before they are off and whose window of an hour on both sides lies inside the session."""
    ends = t.timeline.groupBy("session").agg(F.max("t").alias("ends"))
    begin = 1_704_067_200_000_000
    whole = (F.col("t") - HOUR >= begin) & (F.col("t") + HOUR <= F.col("ends")) & ~F.isnan("value") & (F.col("value") > 0)
    return t.timeline.join(ends, "session").filter(whole).select("event_id")


@query("F25_group_by_substring", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'eco') THEN 'base' WHEN contains(lower(p_type), 'pro') THEN 'cno' END AS chosen FROM part")
def _(t):
    g = F.lower("p_type")
    return t.part.select("p_partkey", F.when(g.contains("eco"), "base").when(g.contains("pro"), "cno").alias("chosen"))


@query("J04_bounds_joined", "SELECT o_orderkey, lo, hi FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    bounds = t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return t.orders.join(bounds, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "lo", "hi")


@query("J16_curated", "SELECT event_id FROM events WHERE event_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    """Event numbers read from names of images pick the events."""
    images = t.labels.filter("toxic = 1").select(F.format_string("Evt%d.png", "doc_id").alias("name"))
    picked = images.select(F.regexp_extract("name", r"Evt(\d+)", 1).try_cast("bigint").alias("event_id")).distinct()
    return t.timeline.join(picked, "event_id", "left_semi").select("event_id")
