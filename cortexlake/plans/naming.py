"""Queries that read names and make them. Names are put together from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cortexlake.functions import names as nm
from cortexlake.plans.registry import E, query


def text(*parts):
    """Columns by name, and literals between bars, as one text."""
    return F.concat(*(F.lit(p[1:-1]) if p.startswith("|") else F.col(p).cast("string") for p in parts))


def padded(number, width):
    """A whole number with zeros before it up to ``width`` digits; a longer one stays whole."""
    digits = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(digits), F.lit(0))), digits)


@query("X01_plain_ids", "SELECT c_custkey, lower(trim(' ' || c_mktsegment || '  ')) AS id FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.lower(F.trim(text("| |", "c_mktsegment", "|  |"))).alias("id"))


@query("X02_session_id", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Ignored' ELSE 'm' || c_custkey || 's' || c_nationkey END AS session_id FROM customer")
def _(t):
    path = F.when(F.col("c_custkey") % 3 == 0, text("|raw/day |", "c_custkey")).otherwise(text("|raw/M|", "c_custkey", "|S|", "c_nationkey", "|/m1s1.csv|"))
    return t.customer.select("c_custkey", nm.session_id(path).alias("session_id"))


@query("X03_marked_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", nm.marked_date(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "rec !").otherwise("rec "), day, F.lit(" a.txt"))).alias("d"))


@query("X04_suffix_date", "SELECT o_orderkey, '20' || strftime(o_orderdate, '%y-%m-%d') AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", nm.suffix_date(F.concat(F.lit("m1s2p3_"), F.date_format("o_orderdate", "MMddyy"))).alias("d"))


@query("X06_time_header_made", "SELECT c_custkey, translate(printf('T_%.2fms', c_acctbal), '.-', 'pm') AS header FROM customer")
def _(t):
    return t.customer.select("c_custkey", nm.time_header(F.col("c_acctbal")).alias("header"))


@query("X09_short_numbers", """SELECT o_orderkey, concat_ws(',', CASE WHEN length(CAST(o_orderkey AS VARCHAR)) IN (3, 4) THEN CAST(o_orderkey AS VARCHAR) END, CASE WHEN length(CAST(o_custkey AS VARCHAR)) IN (3, 4) THEN CAST(o_custkey AS VARCHAR) END) AS numbers FROM orders""")
def _(t):
    """The line in the middle holds an x, so its number doesn't count."""
    return t.orders.select("o_orderkey", F.concat_ws(",", nm.short_numbers(text("|cage |", "o_orderkey", "|\n2x |", "o_custkey", "|\nlast |", "o_custkey"))).alias("numbers"))


@query("X12_mouse_and_rest", "SELECT c_custkey, c_mktsegment AS mouse, c_nationkey || '_' || c_custkey AS rest FROM customer")
def _(t):
    parts = F.split(text("c_mktsegment", "|_|", "c_nationkey", "|_|", "c_custkey"), "_", 2)
    return t.customer.select("c_custkey", parts[0].alias("mouse"), parts[1].alias("rest"))


@query("X13_trial_name", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS trial, o_orderstatus AS a, 'CNO' AS b FROM orders")
def _(t):
    trial, a, b = nm.trial(text("|dir/mean_Trial|", "o_custkey", "|_|", "o_orderstatus", "|_vs_CNO.png|"))
    return t.orders.select("o_orderkey", trial.alias("trial"), a.alias("a"), b.alias("b"))


@query("X14_region_of_lead", "SELECT c_custkey, 'Left' || c_mktsegment AS lead FROM customer")
def _(t):
    return t.customer.select("c_custkey", nm.region_of_lead(text("|Left_|", "c_mktsegment", "|_Ch|", "c_nationkey")).alias("lead"))


@query("X17_relative_path", "SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS path FROM pages")
def _(t):
    return t.pages.select("page_id", nm.relative_path(F.replace("url", F.lit("/"), F.lit("\\")), "http://").alias("path"))


@query("X19_colour_by_name", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'red' WHEN contains(lower(p_name), 'cold') THEN 'blue' ELSE 'gray' END AS colour FROM part")
def _(t):
    low = F.lower("p_name")
    return t.part.select("p_partkey", F.when(low.contains("red"), "red").when(low.contains("cold"), "blue").otherwise("gray").alias("colour"))


@query("X20_active_channels", "SELECT vec_id, array_to_string(list_filter(range(1, 65), lambda i: embedding[i] > 0.25::FLOAT), ',') AS active FROM embeddings")
def _(t):
    numbered = F.transform("embedding", lambda v, i: F.when(v > 0.25, (i + 1).cast("string")))
    return t.embeddings.select("vec_id", F.concat_ws(",", numbered).alias("active"))


@query("X23_gain_and_seconds", f"SELECT event_id, t / 1e6 AS s, value * 6.1035e-8 * 1e6 * -1 AS uv FROM {E}")
def _(t):
    return t.timeline.select("event_id", (F.col("t") / 1e6).alias("s"), (F.col("value") * 6.1035e-8 * 1e6 * -1).alias("uv"))


@query("X28_centre_window", "SELECT vec_id, CAST(embedding[32] AS DOUBLE) AS centre, CAST(list_sum(embedding[28:36]) AS DOUBLE) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def _(t):
    x = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.element_at(x, 32).alias("centre"), F.aggregate(F.slice(x, 28, 9), F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("X31_looked_up", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'Unknown' END AS status FROM orders")
def _(t):
    known = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(known, F.col("o_orderstatus")), F.lit("Unknown")).alias("status"))


@query("X34_parsed_or_kept", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders")
def _(t):
    shown = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return t.orders.select("o_orderkey", nm.parsed_or_kept(shown, "MM/dd/yyyy").alias("d"))
