"""Queries of fields, orders, layouts and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cortexlake.functions import names as nm
from cortexlake.operators import stats as st
from cortexlake.operators.listings import directories, tree
from cortexlake.operators.templates import ABOVE, BELOW, crop
from cortexlake.plans.arrays import prctile_sql
from cortexlake.plans.naming import padded, text
from cortexlake.plans.registry import QUERIES, SQL, E, S, query


@query("F15_clip", f"SELECT event_id, least(greatest(value, 10.0), 50.0) AS value FROM {E}")
def _(t):
    return t.timeline.select("event_id", F.least(F.greatest("value", F.lit(10.0)), F.lit(50.0)).alias("value"))


@query("F16_fixed_order", "SELECT c_custkey, c_mktsegment, c_acctbal, c_name, c_nationkey FROM customer")
def _(t):
    first = ["c_custkey", "c_mktsegment", "c_acctbal"]
    return t.customer.select(*first, *sorted(x for x in t.customer.columns if x not in first))


@query("J05_channel_features", f"SELECT e.event_id, f.mean, f.sd FROM {E} e LEFT JOIN (SELECT ch, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM {S} GROUP BY ch) f ON f.ch = e.event_id % 70")
def _(t):
    """Features of a channel for each of its events; six of the channels have none."""
    f = t.signal.groupBy("ch").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))
    return t.timeline.withColumn("ch", (F.col("event_id") % 70).cast("int")).join(f, "ch", "left").select("event_id", "mean", "sd")


LABELS = f"(SELECT DISTINCT label AS session, ch, chr(CAST(65 + (ch + label) // 20 AS INT)) AS region FROM {S})"


def labels(t):
    region = F.chr(F.lit(65) + F.floor((F.col("ch") + F.col("label")) / 20))
    return t.signal.select(F.col("label").alias("session"), "ch", region.alias("region")).distinct()


@query("J15_session_regions", f"SELECT k.session, k.region, min(l.ch) AS first_ch, max(l.ch) AS last_ch, CASE WHEN min(l.ch) IS NULL THEN 1 ELSE 0 END AS status FROM (SELECT s.session, r.region FROM (SELECT DISTINCT session FROM {LABELS}) s CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) r(region)) k LEFT JOIN {LABELS} l ON l.session = k.session AND l.region = k.region GROUP BY k.session, k.region")
def _(t):
    """A template's regions in each session's map; status 1 where the session lacks one."""
    found = labels(t)
    wanted = found.select("session").distinct().withColumn("region", F.explode(F.array(*map(F.lit, "ABCDE"))))
    ends = found.groupBy("session", "region").agg(F.min("ch").alias("first_ch"), F.max("ch").alias("last_ch"))
    return wanted.join(ends, ["session", "region"], "left").withColumn("status", F.when(F.col("first_ch").isNull(), 1).otherwise(0))


@query("A09_sem", f"SELECT ch, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem FROM {S} GROUP BY ch")
def _(t):
    return st.mean_sem(t.signal, ["ch"], "v").select("ch", F.round("sem", 6).alias("sem"))


@query("A18_padded_span", f"SELECT lo.ch, round((lo.p + hi.p) / 2, 6) AS centre, round((lo.p + hi.p) / 2 - 0.55 * (hi.p - lo.p), 6) AS low, round((lo.p + hi.p) / 2 + 0.55 * (hi.p - lo.p), 6) AS high FROM ({prctile_sql(S, 0.02, 'p', 'ch')}) lo JOIN ({prctile_sql(S, 0.98, 'p', 'ch')}) hi ON hi.ch = lo.ch")
def _(t):
    """Between two percentiles, a tenth wider."""
    both = st.prctile(t.signal, ["ch"], "v", 2.0, "lo").join(st.prctile(t.signal, ["ch"], "v", 98.0, "hi"), "ch")
    centre, half = (F.col("lo") + F.col("hi")) / 2, 0.55 * (F.col("hi") - F.col("lo"))
    return both.select("ch", F.round(centre, 6).alias("centre"), F.round(centre - half, 6).alias("low"), F.round(centre + half, 6).alias("high"))


@query("W05_region_fill", f"SELECT session, ch, last_value(CASE WHEN ch % 4 = 1 THEN region END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ch) AS region FROM {LABELS}")
def _(t):
    """Only every fourth channel is labelled; the label holds down to the next."""
    known = F.when(F.col("ch") % 4 == 1, F.col("region"))
    return labels(t).select("session", "ch", F.last(known, True).over(Window.partitionBy("session").orderBy("ch")).alias("region"))


@query("O01_sorted_keys", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus ASC NULLS LAST, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END ASC NULLS LAST, o_orderkey) AS place FROM orders")
def _(t):
    """Missing values come last."""
    price = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice"))
    w = Window.partitionBy("o_orderpriority").orderBy(F.asc_nulls_last("o_orderstatus"), price.asc_nulls_last(), "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).alias("place"))


@query("O09_sorted_columns", "SELECT ch, " + ", ".join(f"round(avg(v) FILTER (label = {k}), 6) AS s{k}" for k in range(10)) + f" FROM {S} GROUP BY ch")
def _(t):
    """One column for each of the ten labels, in order of their names."""
    wide = t.signal.groupBy("ch").pivot("label", [*range(9, -1, -1)]).agg(F.round(F.avg("v"), 6))
    named = wide.select("ch", *(F.col(str(k)).alias(f"s{k}") for k in range(9, -1, -1)))
    return named.select("ch", *sorted(x for x in named.columns if x != "ch"))


#: A column for each component, named by its time from -16 to 15.5 ms.
TIMES = ["T_" + f"{(k - 32) / 2:.2f}ms".replace("-", "m").replace(".", "p") for k in range(64)]
WIDE = "(SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {h}" for k, h in enumerate(TIMES)) + " FROM embeddings)"


@query("U11_time_columns", f"SELECT vec_id, CAST(replace(replace(replace(replace(h, 'T_', ''), 'ms', ''), 'm', '-'), 'p', '.') AS DOUBLE) AS ms, v FROM (UNPIVOT {WIDE} ON {', '.join(TIMES)} INTO NAME h VALUE v)")
def _(t):
    """Columns named by a time become rows with that time."""
    x = F.col("embedding").cast("array<double>")
    wide = t.embeddings.select("vec_id", *(F.get(x, k).alias(h) for k, h in enumerate(TIMES)))
    long = wide.unpivot("vec_id", [c for c in wide.columns if c.startswith("T_")], "h", "v")
    number = F.translate(F.regexp_replace("h", "^T_|ms$", ""), "mp", "-.")
    return long.select("vec_id", number.cast("double").alias("ms"), "v").filter("v is not null")


@query("U14_tree_surgery", "SELECT page_id, '/site/' || host || '/' || page_id || '/data' AS path FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'b' END AS host FROM pages WHERE page_id % 4 > 0)")
def _(t):
    """Groups named ``auto`` go with all below them; a dataset under ``inner`` moves up to the group around it."""
    host = F.when(F.col("page_id") % 3 == 0, "a").otherwise("b")
    path = F.concat(F.lit("/site/"), host, F.lit("/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, "/auto/data").otherwise("/inner/data"))
    tree = t.pages.select("page_id", path.alias("path")).filter(~F.array_contains(F.split("path", "/"), "auto"))
    return tree.select("page_id", F.regexp_replace("path", "/inner/", "/").alias("path"))


@query("U17_repeated_columns", "SELECT r_regionkey, k, r_name FROM region CROSS JOIN (SELECT unnest(generate_series(1, 4)) AS k) WHERE k <= r_regionkey + 1")
def _(t):
    return t.region.select("r_regionkey", "r_name", F.posexplode(F.array_repeat("r_name", F.least(F.col("r_regionkey") + 1, F.lit(4)))).alias("pos", "x")).select("r_regionkey", (F.col("pos") + 1).cast("long").alias("k"), "r_name")


@query("X07_coded_name", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS mouse, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_nationkey END AS session, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END AS phase,
    CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'a' END AS letter, CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '010223' END AS date FROM customer""")  # fmt: skip
def _(t):
    """Names with and without each of their fields."""
    k = F.col("c_custkey")
    name = F.concat(
        F.when(k % 5 == 0, "m?").otherwise(F.concat(F.lit("m"), k.cast("string"))), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("s"), F.col("c_nationkey").cast("string"))),
        F.when(k % 3 == 0, "").otherwise("p2a"), F.when(k % 2 == 0, "").otherwise("_010223"),
    )
    f = nm.coded_name(name)
    return t.customer.select("c_custkey", f["mouse"].cast("long").alias("mouse"), f["session"].alias("session"), f["phase"].alias("phase"), f["letter"].alias("letter"), f["date"].alias("date"))


@query("X10_card_fields", """SELECT c_custkey, 'FX0-' || c_custkey AS cage, CASE WHEN c_custkey % 2 = 0 THEN 'Male' END AS sex, 'C57 ' || c_mktsegment AS strain, CASE WHEN c_custkey % 3 = 0 THEN '1/2/23' END AS dob, 'seen ' || c_nationkey AS notes FROM customer""")
def _(t):
    k = F.col("c_custkey")
    body = F.concat(text("|Card FX0-|", "c_custkey", "|\n|"), F.when(k % 2 == 0, "Sex: Male\n").otherwise(""), text("|Strain: C57 |", "c_mktsegment", "|\n|"), F.when(k % 3 == 0, "DOB 1/2/23\n").otherwise(""), text("|Notes: seen |", "c_nationkey", "|\nCreated 2023|"))
    return t.customer.select("c_custkey", *(c.alias(n) for n, c in nm.card(body).items()))


@query("X15_header_value", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 6.1035e-8 ELSE c_custkey / 1e8 END AS volts FROM customer")
def _(t):
    body = F.when(F.col("c_custkey") % 4 == 0, "-ADBitVolts none").otherwise(text("|-SamplingFrequency 3\n-ADBitVolts |", "c_custkey", "|e-8\n|"))
    return t.customer.select("c_custkey", nm.header_value(body, "ADBitVolts", 6.1035e-8).alias("volts"))


@query("X16_posix_path", "SELECT c_custkey, '/data/' || c_mktsegment || '/' || c_custkey AS path FROM customer")
def _(t):
    return t.customer.select("c_custkey", nm.posix_path(F.lit("\\data\\"), F.col("c_mktsegment"), text("|\\|", "c_custkey")).alias("path"))


@query("X22_time_units", f"SELECT event_id, t / 1e6 AS s, CAST(round(t / 1e6 * 1000) AS BIGINT) AS sample, CAST(round(t / 1e6 * 1000) AS BIGINT) / 1000 AS back_s FROM {E}")
def _(t):
    s = F.col("t") / 1e6
    sample = F.round(s * 1000).cast("long")
    return t.timeline.select("event_id", s.alias("s"), sample.alias("sample"), (sample / 1000).alias("back_s"))


@query("X26_midpoint", f"SELECT event_id, (t + next_t) / 2.0 AS mid FROM (SELECT event_id, t, lead(t) OVER (PARTITION BY session ORDER BY t, event_id) AS next_t FROM {E}) WHERE next_t IS NOT NULL")
def _(t):
    nxt = F.lead("t").over(Window.partitionBy("session").orderBy("t", "event_id"))
    return t.timeline.select("event_id", "t", nxt.alias("next_t")).filter("next_t is not null").select("event_id", ((F.col("t") + F.col("next_t")) / 2.0).alias("mid"))


@query("X29_angles", f"SELECT i, ch, round(cos(radians(v * 90)), 6) AS x, round(sin(radians(v * 90)), 6) AS y, round(sqrt(v * v + 1), 6) AS r, round((degrees(atan2(v, 1)) % 360 + 360) % 360, 5) AS deg FROM {S}")
def _(t):
    a = F.radians(F.col("v") * 90)
    return t.signal.select("i", "ch", F.round(F.cos(a), 6).alias("x"), F.round(F.sin(a), 6).alias("y"), F.round(F.hypot("v", F.lit(1.0)), 6).alias("r"), F.round(F.pmod(F.degrees(F.atan2("v", F.lit(1.0))), F.lit(360.0)), 5).alias("deg"))


@query("X30_array_parts", "SELECT vec_id, CAST(embedding[5] AS DOUBLE) AS fifth, list_reverse(CAST(embedding[1:3] AS DOUBLE[]))[1] AS third, CAST(embedding[64] AS DOUBLE) AS flipped_first, CAST(embedding[8 * 2 + 3] AS DOUBLE) AS row3_col3 FROM embeddings")
def _(t):
    """An element, a flipped slice, the whole flipped, and the array read as rows of eight."""
    x = F.col("embedding").cast("array<double>")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(x, r * 8 + 1, F.lit(8)))
    return t.embeddings.select("vec_id", F.get(x, 4).alias("fifth"), F.get(F.reverse(F.slice(x, 1, 3)), 0).alias("third"), F.get(F.reverse(x), 0).alias("flipped_first"), F.get(F.get(rows, 2), 2).alias("row3_col3"))


@query("X33_first_digit", "SELECT o_orderkey, substr(CAST(o_orderkey AS VARCHAR), 1, 1) AS first FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.substring(F.col("o_orderkey").cast("string"), 1, 1).alias("first"))


@query("X35_is_number", "SELECT o_orderkey, o_orderkey % 3 > 0 AS numeric FROM orders")
def _(t):
    shown = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice").cast("string")).otherwise("-1e3"))
    return t.orders.select("o_orderkey", nm.is_number(shown).alias("numeric"))


@query("X36_unique_names", "SELECT c_custkey, CASE WHEN n = 0 THEN c_mktsegment || '.png' ELSE c_mktsegment || ' (' || n || ').png' END AS name FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS n FROM customer)")
def _(t):
    earlier = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")) - 1
    return t.customer.select("c_custkey", text("c_mktsegment", "|.png|").alias("name"), earlier.alias("n")).select("c_custkey", nm.unique_names(F.col("name"), F.col("n")).alias("name"))


@query("K03_row_styles", f"SELECT event_id, CASE WHEN code = 'error' THEN 'gray' WHEN value > 80 THEN 'yellow' END AS row_style FROM {E}")
def _(t):
    return t.timeline.select("event_id", F.when(F.col("code") == "error", "gray").when(F.col("value") > 80, "yellow").alias("row_style"))


@query("K10_report_lines", "SELECT c_nationkey, CASE WHEN count(*) >= 5 THEN 'PASS' ELSE 'FAIL' END || ': nation ' || c_nationkey || ', ' || count(*) || ' files' AS line FROM customer GROUP BY c_nationkey")
def _(t):
    n = F.count(F.lit(1))
    by = t.customer.groupBy("c_nationkey").agg(n.alias("n"))
    return by.select("c_nationkey", F.concat(F.when(F.col("n") >= 5, "PASS").otherwise("FAIL"), F.format_string(": nation %d, %d files", "c_nationkey", "n")).alias("line"))


@query("K11_shell_array", "SELECT n_regionkey, 'dirs=( ' || string_agg('\"' || n_name || '\"', ' ' ORDER BY n_name) || ' )' AS line FROM nation GROUP BY n_regionkey")
def _(t):
    """One line per region; it holds as many names as the region has nations."""
    quoted = F.array_sort(F.collect_list("n_name"))
    return t.nation.groupBy("n_regionkey").agg(quoted.alias("x")).select("n_regionkey", F.concat(F.lit('dirs=( "'), F.concat_ws('" "', "x"), F.lit('" )')).alias("line"))


@query("K12_renamed_results", "SELECT page_id, url AS old, 'Result_' || repeat('0', greatest(5 - length(CAST(page_id AS VARCHAR)), 0)) || CAST(page_id AS VARCHAR) || '.pdf' AS new FROM pages")
def _(t):
    return t.pages.select("page_id", F.col("url").alias("old"), F.concat(F.lit("Result_"), padded(F.col("page_id"), 5), F.lit(".pdf")).alias("new"))


#: Every address as a path: the host's parts from the last one, then the rest.
PARTS_SQL = "list_concat(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?]+)', 1), '.')), list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?]+/?([^?]*)', 1), '/'), lambda x: x <> ''))"


def _paths(t):
    host, rest = (F.regexp_extract("url", p, 1) for p in ("^[a-z]+://([^/?]+)", "^[a-z]+://[^/?]+/?([^?]*)"))
    return t.pages.select(F.concat_ws("/", F.reverse(F.split(host, "[.]")), rest).alias("path"))


@query("S29_directories_by_name", f"SELECT DISTINCT array_to_string(p[1:k], '/') AS name, CAST(k AS INT) AS depth FROM (SELECT p, unnest(range(1, len(p))) AS k FROM (SELECT {PARTS_SQL} AS p FROM pages)) WHERE k <= 4 AND regexp_matches(p[k], '^(e|m|t)')")
def _(t):
    """Directories of a listing by name, down to four levels."""
    return directories(_paths(t), "^(e|m|t)", 4)


@query("S30_listing_tree", f"""WITH RECURSIVE x AS MATERIALIZED (SELECT {PARTS_SQL} AS p FROM pages), r AS (SELECT p, 1 AS depth, p[1] AS name, NULL::VARCHAR AS parent FROM x WHERE len(p) > 0
    UNION ALL SELECT p, depth + 1, name || '/' || p[depth + 1], name FROM r WHERE depth < len(p)) SELECT name, parent, depth, count(*) AS n_files FROM r GROUP BY name, parent, depth""")
def _(t):
    """Each node of a listing under the one above it, with the number of files at or below it."""
    return tree(_paths(t))


@query("R03_random_snippets", f"SELECT w.label, s.i, round(avg(s.v), 6) AS mean FROM (SELECT label, CAST('0x' || substr(md5(CAST(label AS VARCHAR)), 1, 6) AS BIGINT) % (SELECT max(vec_id) - 19 FROM embeddings) AS start FROM (SELECT DISTINCT label FROM embeddings)) w JOIN {S} s ON s.i BETWEEN w.start AND w.start + 19 GROUP BY w.label, s.i")
def _(t):
    """Twenty samples of all channels from a place that follows from the session's name."""
    last = t.embeddings.agg((F.max("vec_id") - 19).alias("n"))
    start = F.conv(F.substring(F.md5(F.col("label").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % F.col("n")
    starts = t.embeddings.select("label").distinct().join(F.broadcast(last)).select("label", F.explode(F.sequence(start, start + 19)).alias("i"))
    return starts.join(t.signal.select("i", "v"), "i").groupBy("label", "i").agg(F.round(F.avg("v"), 6).alias("mean"))


INDEX = "(SELECT o_orderkey % 50 AS event, o_orderpriority AS region, count(*) AS n FROM orders GROUP BY 1, 2)"


@query("R05_both_lookups", f"SELECT 'by event' AS mode, region AS found, n FROM {INDEX} WHERE event = 7 UNION ALL SELECT 'by region', CAST(event AS VARCHAR), n FROM {INDEX} WHERE region = '1-URGENT'")
def _(t):
    index = t.orders.groupBy((F.col("o_orderkey") % 50).alias("event"), F.col("o_orderpriority").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    one = index.filter("event = 7").select(F.lit("by event").alias("mode"), F.col("region").alias("found"), "n")
    return one.unionByName(index.filter("region = '1-URGENT'").select(F.lit("by region").alias("mode"), F.col("event").cast("string").alias("found"), "n"))


@query("R06_cropped_rows", f"""SELECT region, CAST(last_row - target + 1 AS INT) AS first_row, CAST(last_row AS INT) AS last_row FROM (SELECT region, target, sum(target) OVER (ORDER BY place) AS last_row FROM ({SQL["D36_golden_template"]})) WHERE region NOT IN ('{ABOVE}', '{BELOW}')""")
def _(t):
    """Rows of the template's regions without its two pads."""
    rows = crop(QUERIES["D36_golden_template"](t.spark, t.dir))
    return rows.select("region", F.col("first_row").cast("int").alias("first_row"), F.col("last_row").cast("int").alias("last_row"))


@query("R23_missing_outputs", "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("R25_probe_layout", f"SELECT k AS contact, k // 8 AS shank, (k // 8) * 250.0 + (k % 2) * 20.0 AS x, ((k % 8) // 2) * 50.0 AS y FROM (SELECT DISTINCT CAST(ch - 1 AS BIGINT) AS k FROM {S})")
def _(t):
    """The recorded channels on shanks of two columns with eight contacts each, the group repeated with an offset."""
    contacts = t.signal.select((F.col("ch") - 1).cast("long").alias("id")).distinct()
    k, within = F.col("id"), F.col("id") % 8
    shank = F.floor(k / 8)
    return contacts.select(k.alias("contact"), shank.alias("shank"), (shank * 250.0 + (k % 2) * 20.0).alias("x"), (F.floor(within / 2) * 50.0).alias("y"))
