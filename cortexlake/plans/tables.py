"""Queries over the relational tables: joins, reshaping, sets, orders and text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cortexlake.operators import stats as st
from cortexlake.plans.naming import padded
from cortexlake.plans.registry import query

FLAGS = ("A", "N", "R")


@query("J01_left_join_chain", """SELECT c.c_custkey, n.n_name, r.r_name, o.n_orders FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")  # fmt: skip
def _(t):
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(orders, "c_custkey", "left").select("c_custkey", "n_name", "r_name", "n_orders")


@query("J02_first_match_lookup", """SELECT n.n_nationkey, coalesce(s.s_name, 'Unknown') AS first_supplier FROM nation n LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")
def _(t):
    first = t.supplier.filter("s_acctbal > 9000").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("s_name"))
    return t.nation.join(first, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.coalesce("s_name", F.lit("Unknown")).alias("first_supplier"))


@query("J03_full_outer_dates", """SELECT coalesce(a.d, b.d) AS d, coalesce(CAST(a.n AS VARCHAR), 'None') AS ordered, coalesce(CAST(b.n AS VARCHAR), 'None') AS shipped FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT strftime(l_shipdate, '%Y-%m-%d') AS d, count(*) AS n FROM lineitem GROUP BY 1) b ON a.d = b.d""")  # fmt: skip
def _(t):
    day = lambda df, c, n: df.groupBy(F.date_format(c, "yyyy-MM-dd").alias("d")).agg(F.count(F.lit(1)).cast("string").alias(n))
    return day(t.orders, "o_orderdate", "ordered").join(day(t.lineitem, "l_shipdate", "shipped"), "d", "full").na.fill("None", ["ordered", "shipped"])


@query("J06_containment_join", """SELECT p.p_partkey, k.name FROM part p JOIN (VALUES (1, 'RING'), (2, 'widget'), (3, 'Bolt'), (4, 'red')) k(place, name) ON contains(lower(p.p_name), lower(k.name)) QUALIFY row_number() OVER (PARTITION BY p.p_partkey ORDER BY k.place) = 1""")
def _(t):
    """The few names are tried in order inside each row; the first contained one counts."""
    low = F.lower("p_name")
    first = F.coalesce(*(F.when(low.contains(k.lower()), F.lit(k)) for k in ("RING", "widget", "Bolt", "red")))
    return t.part.select("p_partkey", first.alias("name")).filter("name is not null")


@query("J07_extracted_id_join", r"""SELECT d.page_id, o.o_orderkey FROM (SELECT page_id, CAST(nullif(regexp_extract(url, '(\d+)/?$', 1), '') AS BIGINT) AS k FROM pages) d JOIN orders o ON o.o_orderkey = d.k""")
def _(t):
    k = F.regexp_extract("url", r"(\d+)/?$", 1).try_cast("bigint")
    return t.pages.select("page_id", k.alias("o_orderkey")).join(t.orders, "o_orderkey").select("page_id", "o_orderkey")


@query("J17_semi_and_missing", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS has_large FROM customer")
def _(t):
    large = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("x")).distinct()
    return t.customer.join(large, "c_custkey", "left").select("c_custkey", F.coalesce("x", F.lit(False)).alias("has_large"))


@query("J18_pairs_of_regions", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def _(t):
    a, b = t.region.select(F.col("r_name").alias("a")), t.region.select(F.col("r_name").alias("b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


@query("F09_contains", "SELECT p_partkey FROM part WHERE contains(p_name, 'ring')")
def _(t):
    return t.part.filter(F.col("p_name").contains("ring")).select("p_partkey")


@query("F17_rename_rules", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'red') THEN 'warm_' || replace(p_name, ' ', '_') ELSE split_part(p_name, ' ', 1) END AS name FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(F.col("p_name").startswith("red"), F.concat(F.lit("warm_"), F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.substring_index("p_name", " ", 1)).alias("name"))


@query("F18_status_case", "SELECT p_partkey, CASE WHEN p_size IN (1, 50) THEN 'edge' WHEN p_retailprice <= 0 THEN 'zero' ELSE 'kept' END AS status FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(F.col("p_size").isin(1, 50), "edge").when(F.col("p_retailprice") <= 0, "zero").otherwise("kept").alias("status"))


@query("F19_separated_bars", """SELECT k, m1 - s1 > m2 + s2 OR m2 - s2 > m1 + s1 AS apart FROM (SELECT l_returnflag AS k, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS m1, stddev_samp(CASE WHEN l_linestatus = 'O' THEN l_quantity END) / sqrt(count(CASE WHEN l_linestatus = 'O' THEN l_quantity END)) AS s1,
    avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS m2, stddev_samp(CASE WHEN l_linestatus = 'F' THEN l_quantity END) / sqrt(count(CASE WHEN l_linestatus = 'F' THEN l_quantity END)) AS s2 FROM lineitem GROUP BY 1)""")  # fmt: skip
def _(t):
    part = lambda s: F.when(F.col("l_linestatus") == s, F.col("l_quantity"))
    bars = {s: (F.avg(part(s)), F.stddev_samp(part(s)) / F.sqrt(F.count(part(s)))) for s in "OF"}
    wide = t.lineitem.groupBy(F.col("l_returnflag").alias("k")).agg(*(x.alias(f"{n}{s}") for s, pair in bars.items() for n, x in zip("ms", pair)))
    return wide.select("k", F.expr("mO - sO > mF + sF OR mF - sF > mO + sO").alias("apart"))


@query("F20_category_by_name", "SELECT c_custkey, CASE WHEN contains(upper(c_mktsegment), 'AUTO') THEN 'Vehicle' WHEN contains(upper(c_mktsegment), 'HOUSE') OR contains(upper(c_mktsegment), 'FURN') THEN 'Home' ELSE 'Other' END AS category FROM customer")
def _(t):
    s = F.upper("c_mktsegment")
    return t.customer.select("c_custkey", F.when(s.contains("AUTO"), "Vehicle").when(s.contains("HOUSE") | s.contains("FURN"), "Home").otherwise("Other").alias("category"))


@query("F22_completeness", """SELECT f.o_orderkey, count(*) AS missing, string_agg(CAST(f.k AS VARCHAR), ',' ORDER BY f.k) FILTER (WHERE f.p <= 3) AS examples FROM (SELECT x.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS p FROM (SELECT o_orderkey, unnest(generate_series(1, 7)) AS k FROM orders) x
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = k)) f GROUP BY 1""")  # fmt: skip
def _(t):
    """What each order lacks of line numbers 1 to 7: how many, and the first three."""
    have = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"))
    want = F.sequence(F.lit(1), F.lit(7))
    lacks = t.orders.join(have, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.array_except(want, F.coalesce("have", F.array().cast("array<int>"))).alias("x"))
    return lacks.filter(F.size("x") > 0).select("o_orderkey", F.size("x").cast("bigint").alias("missing"), F.concat_ws(",", F.slice(F.array_sort("x"), 1, 3).cast("array<string>")).alias("examples"))


@query("F24_bool_text", "SELECT l_orderkey, l_linenumber, lower(trim(l_returnflag)) IN ('1', 't', 'true', 'y', 'yes', 'r') AS flag FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.lower(F.trim("l_returnflag")).isin("1", "t", "true", "y", "yes", "r").alias("flag"))


@query("A01_grouped_means", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS mean_l_quantity, round(avg(l_extendedprice), 4) AS mean_l_extendedprice, round(avg(l_discount), 6) AS mean_l_discount FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2")
def _(t):
    m = st.grouped_means(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"])
    return m.select("l_returnflag", "l_linestatus", F.round("mean_l_quantity", 4).alias("mean_l_quantity"), F.round("mean_l_extendedprice", 4).alias("mean_l_extendedprice"), F.round("mean_l_discount", 6).alias("mean_l_discount"))


@query("A29_sum_or_count", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("A30_padded_range", "SELECT o_orderstatus, round(lo - 0.05 * CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4) AS low, round(hi + 0.05 * CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 4) AS high FROM (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)")
def _(t):
    r = t.orders.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    pad = 0.05 * F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    return r.select("o_orderstatus", F.round(F.col("lo") - pad, 4).alias("low"), F.round(F.col("hi") + pad, 4).alias("high"))


@query("U01_union_all", "SELECT c_nationkey AS k, 'customer' AS source FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("source")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("source")))


@query("U02_union_fill", "SELECT c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, NULL FROM supplier")
def _(t):
    return t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).unionByName(t.supplier.select(F.col("s_name").alias("name")), allowMissingColumns=True)


@query("U04_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").alias("k")))


@query("U05_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("k")).join(t.orders.select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("U06_distinct_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select(F.col("s_nationkey").alias("k"))).distinct()


WIDE = "(SELECT o_orderpriority AS row, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1)"


@query("U10_pivot", f"SELECT * FROM {WIDE}")
def _(t):
    wide = t.orders.groupBy(F.col("o_orderpriority").alias("row")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query("U07_unpivot", f"SELECT row, status, n FROM {WIDE} UNPIVOT (n FOR status IN (\"F\", \"O\", \"P\"))")
def _(t):
    wide = t.orders.groupBy(F.col("o_orderpriority").alias("row")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    return wide.unpivot("row", ["F", "O", "P"], "status", "n")


@query("U09_two_branches", "SELECT l_orderkey, l_linenumber, 'GZ' AS timeframe, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'AS', l_tax FROM lineitem")
def _(t):
    both = F.array(F.struct(F.lit("GZ").alias("timeframe"), F.col("l_discount").alias("v")), F.struct(F.lit("AS").alias("timeframe"), F.col("l_tax").alias("v")))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.explode(both).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("U12_explode_ids", r"""SELECT page_id, CAST(unnest(CASE WHEN len(ids) = 0 THEN ['0'] ELSE ids END) AS BIGINT) AS id FROM (SELECT page_id, regexp_extract_all(url, '\d+') AS ids FROM pages)""")
def _(t):
    ids = F.regexp_extract_all("url", F.lit(r"(\d+)"))
    return t.pages.select("page_id", F.explode(F.when(F.size(ids) == 0, F.array(F.lit("0"))).otherwise(ids)).alias("id")).withColumn("id", F.col("id").cast("bigint"))


@query("U15_groups_with_both", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r")).filter("a AND r").select("l_orderkey")


@query("O02_custom_order", "SELECT o_orderkey, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 END AS place FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '1-URGENT', '5-LOW')")
def _(t):
    place = F.array_position(F.array(*map(F.lit, ("3-MEDIUM", "1-URGENT", "5-LOW"))), F.col("o_orderpriority")).cast("int")
    return t.orders.select("o_orderkey", place.alias("place")).filter("place > 0")


@query("O04_natural_sort", r"SELECT p_partkey, CAST(regexp_extract(p_brand, '\d+') AS INT) AS brand, row_number() OVER (PARTITION BY p_type ORDER BY CAST(regexp_extract(p_brand, '\d+') AS INT), p_partkey) AS place FROM part")
def _(t):
    p = t.part.withColumn("brand", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"))
    return p.select("p_partkey", "brand", F.row_number().over(Window.partitionBy("p_type").orderBy("brand", "p_partkey")).cast("bigint").alias("place"))


@query("O08_shallowest_path", r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, arg_min(page_id, (len(string_split(url, '/')), page_id)) AS page_id FROM pages GROUP BY 1")
def _(t):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t.pages.groupBy(host.alias("host")).agg(F.min_by("page_id", F.struct(F.size(F.split("url", "/")), F.col("page_id"))).alias("page_id"))


@query("O11_capped_groups", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def _(t):
    return t.orders.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).filter("k <= 3").select("o_custkey", "o_orderkey")


@query("X05_time_header", "SELECT l_orderkey, l_linenumber, round(CAST(replace(replace(h, 'm', '-'), 'p', '.') AS DOUBLE), 2) AS t_ms FROM (SELECT *, replace(replace(printf('%.2f', l_quantity / 4 - 6), '.', 'p'), '-', 'm') AS h FROM lineitem)")
def _(t):
    header = F.concat(F.lit("T_"), F.translate(F.format_string("%.2f", F.col("l_quantity") / 4 - 6), ".-", "pm"), F.lit("ms"))
    parts = F.regexp_extract(header, r"^T_([mp\d]+)ms$", 1)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.translate(parts, "mp", "-.").try_cast("double"), 2).alias("t_ms"))


@query("X08_digits_only", r"SELECT c_custkey, CAST(regexp_replace(c_name, '\D', '', 'g') AS BIGINT) AS k FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.regexp_replace("c_name", r"\D", "").cast("bigint").alias("k"))


@query("X11_path_parts", "SELECT page_id, p[-1] AS last_part, coalesce(p[-2], 'Unknown') AS before_last FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)")
def _(t):
    p = F.split("url", "/")
    return t.pages.select("page_id", F.try_element_at(p, F.lit(-1)).alias("last_part"), F.coalesce(F.try_element_at(p, F.lit(-2)), F.lit("Unknown")).alias("before_last"))


@query("X18_padded_names", "SELECT c_custkey, 'Ch' || repeat('0', greatest(2 - length(CAST(c_nationkey AS VARCHAR)), 0)) || CAST(c_nationkey AS VARCHAR) AS name FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.concat(F.lit("Ch"), padded(F.col("c_nationkey"), 2)).alias("name"))


@query("X21_two_roundings", "SELECT l_orderkey, l_linenumber, round(l_quantity / 2) AS away, round_even(l_quantity / 2, 0) AS even FROM lineitem")
def _(t):
    half = F.col("l_quantity") / 2
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(half).alias("away"), F.bround(half).alias("even"))


@query("X24_decibel", "SELECT o_orderkey, round(10 * log10(o_totalprice + 2.22e-16), 5) AS db FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(10 * F.log10(F.col("o_totalprice") + 2.22e-16), 5).alias("db"))


@query("X27_asymmetry", "SELECT l_orderkey, l_linenumber, round((l_tax - l_discount) / nullif(least(l_tax, l_discount), 0) * 100, 4) AS asym FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.try_divide(F.col("l_tax") - F.col("l_discount"), F.least("l_tax", "l_discount")) * 100, 4).alias("asym"))


@query("R26_circle_nodes", "SELECT n_nationkey, round(cos(radians(75 - 30 * n_nationkey)), 6) AS x, round(sin(radians(75 - 30 * n_nationkey)), 6) AS y FROM nation")
def _(t):
    a = F.radians(75 - 30 * F.col("n_nationkey"))
    return t.nation.select("n_nationkey", F.round(F.cos(a), 6).alias("x"), F.round(F.sin(a), 6).alias("y"))


@query("R04_pair_filter", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_nationkey IN (1, 5, 9) AND s_acctbal > 5000")
def _(t):
    return t.customer.filter(F.col("c_nationkey").isin(1, 5, 9)).join(t.supplier.filter("s_acctbal > 5000"), F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey")


@query("S28_listing", None)
def _(t):
    """The folder's files as a table; their contents aren't read."""
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{t.dir}/*")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
