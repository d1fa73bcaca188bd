"""Queries over timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cortexlake.operators import events as ev
from cortexlake.operators.pairing import greedy_pairs
from cortexlake.operators import stats
from cortexlake.plans.registry import HOUR, E, Tables, query

DAY, PAIR = 24 * HOUR, 6 * HOUR
# Names of codes; one code is left out so that it is unknown.
NAMES = (("click", "Click"), ("view", "Noise"), ("purchase", "Pellet Delivery"), ("signup", "Session"))
NAMES_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in NAMES) + ") n(code, name)"

DEBOUNCED = f"""(SELECT session, code, min(t) AS start_us, max(t) AS last_us, count(*) - 1 AS repeats FROM (
    SELECT *, sum(CASE WHEN t - prev <= {DAY} THEN 0 ELSE 1 END) OVER (PARTITION BY session, code ORDER BY t) AS island
    FROM (SELECT *, lag(t) OVER (PARTITION BY session, code ORDER BY t) AS prev FROM {E}))
  GROUP BY session, code, island)"""


def debounced(t: Tables) -> DataFrame:
    return ev.debounce(t.timeline, ["session", "code"], "t", DAY)


def named(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame(NAMES, "code string, name string")
    return t.timeline.join(F.broadcast(names), "code", "left").withColumn("label", F.coalesce("name", F.format_string("Unknown (%s)", F.col("code"))))


NAMED = f"(SELECT e.*, coalesce(n.name, 'Unknown (' || e.code || ')') AS label FROM {E} e LEFT JOIN {NAMES_SQL} ON e.code = n.code)"


@query("W02_debounce", f"SELECT * FROM {DEBOUNCED}")
def _(t):
    return debounced(t)


@query("W01_gap_to_next", f"SELECT session, event_id, t, coalesce(lead(t) OVER (PARTITION BY session ORDER BY t, event_id) - t, 0) AS gap_us FROM {E}")
def _(t):
    return ev.gap_to_next(t.timeline, ["session"], "t", "event_id").select("session", "event_id", "t", "gap_us")


@query("event_timeline", f"SELECT session, code, start_us, repeats, coalesce(lead(start_us) OVER (PARTITION BY session ORDER BY start_us, code) - start_us, 0) AS gap_us FROM {DEBOUNCED}")
def timeline(t):
    return ev.gap_to_next(debounced(t), ["session"], "start_us", "code").select("session", "code", "start_us", "repeats", "gap_us")


@query("J08_greedy_pairs", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT session, t, code = 'click' AS o, row_number() OVER (PARTITION BY session ORDER BY t, code = 'click') AS k FROM {E} WHERE code IN ('click', 'view')),
    r AS (SELECT DISTINCT session, 0::BIGINT AS k, []::BIGINT[] AS waits, NULL::BIGINT AS a, NULL::BIGINT AS b FROM e UNION ALL
      SELECT session, k, CASE WHEN o THEN list_append(live, t) WHEN live[1] < t THEN live[2:] ELSE live END, CASE WHEN NOT o AND live[1] < t THEN live[1] END, CASE WHEN NOT o AND live[1] < t THEN t END
      FROM (SELECT e.session, e.k, e.t, e.o, list_filter(r.waits, lambda x: x >= e.t - {PAIR}) AS live FROM r JOIN e ON e.session = r.session AND e.k = r.k + 1))
    SELECT session, a AS first_us, b AS second_us FROM r WHERE a IS NOT NULL""")
def _(t):
    return greedy_pairs(t.timeline, "session", "t", F.col("code") == "click", F.col("code") == "view", PAIR)


@query("W07_sequences", f"""SELECT session, min(t) AS first_us, max(t) AS last_us, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN t - prev <= {12 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t, event_id) AS island
    FROM (SELECT *, lag(t) OVER (PARTITION BY session ORDER BY t, event_id) AS prev FROM {E})) GROUP BY session, island""")  # fmt: skip
def _(t):
    runs = ev.with_island(t.timeline, ["session"], "t", 12 * HOUR, "event_id")
    return runs.groupBy("session", "island").agg(F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.count(F.lit(1)).alias("n")).drop("island")


INTERVALS = f"(SELECT session, code, start_us, last_us FROM {DEBOUNCED} WHERE last_us > start_us)"


@query("W10_merge_intervals", f"""SELECT session, min(start_us) AS start_us, max_by(last_us, (start_us, last_us)) AS last_us, count(*) AS n_merged FROM (
    SELECT *, sum(CASE WHEN start_us - prev < {PAIR} THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY start_us, last_us) AS island
    FROM (SELECT *, lag(last_us) OVER (PARTITION BY session ORDER BY start_us, last_us) AS prev FROM {INTERVALS})) GROUP BY session, island""")  # fmt: skip
def _(t):
    return ev.merge_intervals(debounced(t).filter("last_us > start_us"), ["session"], "start_us", "last_us", PAIR)


@query("J09_interval_overlap", f"""SELECT a.session, a.start_us AS a_on, a.last_us AS a_off, b.start_us AS b_on, b.last_us AS b_off FROM {INTERVALS} a JOIN {INTERVALS} b
    ON a.session = b.session AND a.code = 'error' AND b.code = 'purchase' AND a.start_us <= b.last_us AND b.start_us <= a.last_us""")  # fmt: skip
def _(t):
    runs = debounced(t).filter("last_us > start_us")
    side = lambda code, x: runs.filter(F.col("code") == code).select("session", F.col("start_us").alias(f"{x}_on"), F.col("last_us").alias(f"{x}_off"))
    return ev.overlap_join(side("error", "a"), side("purchase", "b"), ["session"], "a_on", "a_off", "b_on", "b_off", DAY)


@query("J10_next_and_previous", f"""SELECT p.session, p.t, (SELECT max(q.t) FROM {E} q WHERE q.session = p.session AND q.code = 'purchase' AND q.t < p.t) AS previous_us,
    (SELECT min(q.t) FROM {E} q WHERE q.session = p.session AND q.code = 'purchase' AND q.t > p.t) AS next_us FROM {E} p WHERE p.code = 'click'""")  # fmt: skip
def _(t):
    e = t.timeline
    return ev.next_and_previous(e.filter("code = 'purchase'"), e.filter("code = 'click'"), ["session"], "t")


@query("J11_nearest_value", f"""SELECT p.session, p.event_id, arg_min(q.event_id, (abs(q.t - p.t), q.t, q.event_id)) AS nearest_id FROM {E} p JOIN {E} q ON q.session = p.session AND q.code = 'purchase' AND p.code = 'click' GROUP BY ALL""")
def _(t):
    e = t.timeline
    w, down = Window.partitionBy("session").orderBy("t", "event_id"), Window.partitionBy("session").orderBy(F.desc("t"), F.desc("event_id"))
    hit = F.when(F.col("code") == "purchase", F.struct("t", "event_id"))
    both = e.filter("code in ('click', 'purchase')").withColumn("before", F.last(hit, True).over(w)).withColumn("after", F.last(hit, True).over(down))
    near = F.when(F.col("after").isNull() | ((F.col("t") - F.col("before.t")) <= (F.col("after.t") - F.col("t"))), F.col("before.event_id")).otherwise(F.col("after.event_id"))
    return both.filter("code = 'click' AND (before IS NOT NULL OR after IS NOT NULL)").select("session", "event_id", F.coalesce(near, "after.event_id").alias("nearest_id"))


@query("F01_code_label", f"SELECT event_id, label FROM {NAMED}")
def _(t):
    return named(t).select("event_id", "label")


@query("F02_drop_unknown", f"SELECT session, event_id, label FROM {NAMED} WHERE NOT contains(lower(label), 'unknown') AND code <> 'signup'")
def _(t):
    return named(t).filter(~F.coalesce(F.lower("label").contains("unknown"), F.lit(False)) & (F.col("code") != "signup")).select("session", "event_id", "label")


@query("F03_in_list", f"SELECT event_id FROM {E} WHERE code IN ('click', 'error')")
def _(t):
    return t.timeline.filter(F.col("code").isin("click", "error")).select("event_id")


@query("F04_drop_missing", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND user_id IS NOT NULL")
def _(t):
    return t.events.withColumn("value", F.nanvl("value", F.lit(None))).na.drop(subset=["value", "user_id"]).select("event_id", "value")


@query("F05_coerce_numeric", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1)).alias("k"))


@query("F06_numeric_rows", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL")
def _(t):
    return t.events.filter(F.get_json_object("props", "$.k").try_cast("double").isNotNull()).select("event_id")


@query("F08_date_text_range", "SELECT event_id FROM events WHERE coalesce(strftime(ts, '%Y-%m-%d'), 'None') <= '2024-01-10'")
def _(t):
    return t.events.filter(F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("None")) <= "2024-01-10").select("event_id")


@query("F10_participation", f"""SELECT session, count(DISTINCT code) AS n_codes FROM {E} WHERE session IN (SELECT session FROM {E} WHERE value > 90) GROUP BY session HAVING count(DISTINCT code) BETWEEN 2 AND 4""")
def _(t):
    e = t.timeline
    chosen = e.filter("value > 90").select("session").distinct()
    return e.groupBy("session").agg(F.countDistinct("code").alias("n_codes")).filter("n_codes BETWEEN 2 AND 4").join(chosen, "session", "left_semi")


@query("F11_stride", "SELECT event_id FROM events WHERE event_id % 7 = 3")
def _(t):
    return t.events.filter(F.pmod("event_id", F.lit(7)) == 3).select("event_id")


@query("F14_clamp", f"SELECT event_id, greatest(10.0, least(value, 50.0)) AS v, greatest(1, least(session, 100)) AS s FROM {E}")
def _(t):
    return t.timeline.select("event_id", F.greatest(F.lit(10.0), F.least("value", F.lit(50.0))).alias("v"), F.greatest(F.lit(1).cast("bigint"), F.least("session", F.lit(100).cast("bigint"))).alias("s"))


@query("F23_first_of_each", f"SELECT code, event_id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY t, event_id) AS k FROM {E}) WHERE k <= 5")
def _(t):
    w = Window.partitionBy("code").orderBy("t", "event_id")
    return t.timeline.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("code", "event_id")


@query("W04_forward_fill", f"""SELECT event_id, last_value(CASE WHEN code = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY session ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {E}""")
def _(t):
    w = Window.partitionBy("session").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.timeline.select("event_id", F.last(F.when(F.col("code") == "signup", F.col("value")), True).over(w).alias("filled"))


@query("W06_edges", f"""SELECT session, event_id, CASE WHEN high AND NOT prev THEN 'rise' ELSE 'fall' END AS edge FROM (
    SELECT *, value > 20 AS high, coalesce(lag(value > 20) OVER (PARTITION BY session ORDER BY t, event_id), false) AS prev FROM {E}) WHERE high <> prev""")  # fmt: skip
def _(t):
    w = Window.partitionBy("session").orderBy("t", "event_id")
    marked = t.timeline.withColumn("high", F.col("value") > 20).withColumn("prev", F.coalesce(F.lag("high").over(w), F.lit(False)))
    return marked.filter("high != prev").select("session", "event_id", F.when(F.col("high"), "rise").otherwise("fall").alias("edge"))


@query("W13_cumulative", f"""SELECT event_id, round(value - coalesce(lag(value) OVER w, 0), 4) AS step, round(sum(value) OVER (PARTITION BY session ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS total FROM {E} WINDOW w AS (PARTITION BY session ORDER BY t, event_id)""")
def _(t):
    w = Window.partitionBy("session").orderBy("t", "event_id")
    return t.timeline.select("event_id", F.round(F.col("value") - F.lag("value", 1, 0.0).over(w), 4).alias("step"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("total"))


@query("W14_timing_check", f"""SELECT event_id, CASE WHEN d > {18 * HOUR} THEN 'gap' WHEN d < {HOUR} THEN 'overlap' ELSE 'ok' END AS timing FROM (SELECT event_id, t - lag(t) OVER (PARTITION BY session ORDER BY t, event_id) AS d FROM {E}) WHERE d IS NOT NULL""")
def _(t):
    w = Window.partitionBy("session").orderBy("t", "event_id")
    d = t.timeline.select("event_id", (F.col("t") - F.lag("t").over(w)).alias("d")).filter("d IS NOT NULL")
    return d.select("event_id", F.when(F.col("d") > 18 * HOUR, "gap").when(F.col("d") < HOUR, "overlap").otherwise("ok").alias("timing"))


@query("W16_rank_by_count", f"SELECT session, n, row_number() OVER (ORDER BY n DESC, session) AS place FROM (SELECT session, count(*) AS n FROM {E} GROUP BY session)")
def _(t):
    counts = t.timeline.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return stats.place_descending(counts, "n", "session")


@query("W18_third_else_first", f"""SELECT session, coalesce(max(CASE WHEN k = 3 THEN event_id END), max(CASE WHEN k = 1 THEN event_id END)) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, event_id) AS k FROM {E}) GROUP BY session""")
def _(t):
    k = t.timeline.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy("t", "event_id"))).filter("k <= 3")
    return k.groupBy("session").agg(F.coalesce(F.max(F.when(F.col("k") == 3, F.col("event_id"))), F.max(F.when(F.col("k") == 1, F.col("event_id")))).alias("event_id"))


@query("W20_sliding_windows", f"""SELECT code, k * {6 * HOUR} AS from_us, count(*) AS n, round(sum(value), 2) AS total FROM (
    SELECT code, value, unnest(generate_series(t // {6 * HOUR} - 3, t // {6 * HOUR})) AS k FROM {E}) GROUP BY code, k""")  # fmt: skip
def _(t):
    last = F.floor(F.col("t") / (6 * HOUR))
    each = t.timeline.select("code", "value", F.explode(F.sequence(last - 3, last)).alias("k"))
    return each.groupBy("code", (F.col("k") * 6 * HOUR).alias("from_us")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("R01_edit_status", f"SELECT event_id, status, CAST(status > 0 AS INT) AS is_valid, sum(CAST(status > 0 AS BIGINT)) OVER (PARTITION BY session) AS n_valid FROM (SELECT *, CASE WHEN event_id BETWEEN 100 AND 300 THEN -1 ELSE 1 END AS status FROM {E} WHERE code <> 'error')")
def _(t):
    edited = t.timeline.filter("code != 'error'").withColumn("status", F.when(F.col("event_id").between(100, 300), -1).otherwise(1))
    valid = (F.col("status") > 0).cast("int")
    return edited.select("event_id", "status", valid.alias("is_valid"), F.sum(valid).over(Window.partitionBy("session")).cast("decimal(38,0)").alias("n_valid"))


@query("J19_control_times", f"SELECT event_id, t, t + CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END * ({5 * HOUR} + CAST(floor(h * {5 * HOUR >> 10} / 4194304.0) AS BIGINT)) AS control_us FROM (SELECT event_id, t, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM {E} WHERE code = 'click')")
def _(t):
    """A control time 5 to 10 h away on either side of each click, the same for the same event each time."""
    h = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    away = F.lit(5 * HOUR) + F.floor(h * (5 * HOUR >> 10) / (1 << 22)).cast("long")
    return t.timeline.filter("code = 'click'").select("event_id", "t", (F.col("t") + F.when(h % 2 == 0, 1).otherwise(-1) * away).alias("control_us"))


@query("A05_joined_text", f"SELECT session, string_agg(code, ' | ' ORDER BY t, event_id) AS codes FROM {E} GROUP BY session")
def _(t):
    ordered = F.array_sort(F.collect_list(F.struct("t", "event_id", "code")))
    return t.timeline.groupBy("session").agg(ordered.alias("x")).select("session", F.concat_ws(" | ", F.col("x.code")).alias("codes"))


@query("A04_group_size", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("A06_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@query("A25_session_rollup", f"""SELECT count(*) AS sessions, sum(n) AS events, round(100.0 * sum(CAST(n > 60 AS INT)) / count(*), 4) AS usable_percent, round(avg(codes), 4) AS mean_codes, round(avg(n), 4) AS mean_events FROM (SELECT session, count(*) AS n, count(DISTINCT code) AS codes FROM {E} GROUP BY session)""")
def _(t):
    per = t.timeline.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("code").alias("codes"))
    return per.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("n").cast("decimal(38,0)").alias("events"), F.round(100.0 * F.count_if(F.col("n") > 60) / F.count(F.lit(1)), 4).alias("usable_percent"),
        F.round(F.avg("codes"), 4).alias("mean_codes"), F.round(F.avg("n"), 4).alias("mean_events"),
    )


@query("A26_histogram", "SELECT CAST(floor(value / 5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.floor(F.col("value") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("O05_top_ten", f"SELECT session, count(*) AS n FROM {E} GROUP BY session ORDER BY n DESC, session LIMIT 10")
def _(t):
    return t.timeline.groupBy("session").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "session").limit(10)


@query("X32_json_walk", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("R28_label_train", f"""SELECT session, day, max_by(code, (start_us, code)) AS code FROM (
    SELECT session, code, start_us, unnest(generate_series(start_us // {DAY}, last_us // {DAY})) AS day FROM {DEBOUNCED}) GROUP BY session, day""")  # fmt: skip
def _(t):
    """Per session and day the code of the run that covers it; the run that starts later overwrites."""
    day = F.explode(F.sequence(F.floor(F.col("start_us") / DAY), F.floor(F.col("last_us") / DAY)))
    return debounced(t).select("session", "code", "start_us", day.alias("day")).groupBy("session", "day").agg(F.max_by("code", F.struct("start_us", "code")).alias("code"))
