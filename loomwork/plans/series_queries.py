"""Queries of runs, intervals, series and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs, selection, statistics
from ..streaming import windows
from .registry import query

DAYS = "SELECT o_custkey AS g, datediff(o_orderdate, DATE '1990-01-01') AS v FROM orders"
SQL_DAYS = "SELECT o_custkey AS g, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS v FROM orders"
KEYS = "SELECT o_custkey AS g, o_orderkey % 400 AS v, o_orderkey AS o FROM orders"


@query(
    """WITH d AS (SELECT DISTINCT g, v FROM days), r AS (SELECT g, v, v - row_number() OVER (PARTITION BY g ORDER BY v) AS r FROM d)
 SELECT g, min(v) AS "first", max(v) AS "last", count(*) AS length FROM r GROUP BY g, r""",
    days="SELECT l_suppkey AS g, l_partkey AS v FROM lineitem",
)
def w4_islands(days: DataFrame) -> DataFrame:
    return runs.islands(days, "g", "v")


RUNS = """WITH m AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS n FROM ev WHERE v IS NOT NULL WINDOW w AS (PARTITION BY g ORDER BY o)), r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY o) AS run FROM m)"""
EV = "SELECT user_id AS g, event_id AS o, CASE WHEN event_id % 9 > 0 THEN event_type END AS v FROM events"


@query(f"{RUNS} SELECT g, run::BIGINT AS run, v, count(*) AS length FROM r GROUP BY g, run, v", ev=EV)
def w5_value_runs(ev: DataFrame) -> DataFrame:
    return runs.value_runs(ev, "g", ["o"], "v")


@query(
    """WITH c AS (SELECT g, o, coalesce(v > 40, false) AS c FROM ev), r AS (SELECT *, sum(CASE WHEN c THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY o) AS r FROM c),
 n AS (SELECT g, r, count(*) FILTER (WHERE c) AS n FROM r GROUP BY g, r) SELECT g, max(n) AS longest FROM n GROUP BY g""",
    ev="SELECT user_id AS g, event_id AS o, value AS v FROM events",
)
def w6_longest_run(ev: DataFrame) -> DataFrame:
    return runs.longest_run(ev, "g", ["o"], F.col("v") > 40)


@query(
    """WITH m AS (SELECT g, p, CASE WHEN p - lag(p) OVER (PARTITION BY g ORDER BY p) <= 600 THEN 0 ELSE 1 END AS n FROM pos), r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY p) AS cluster FROM m)
 SELECT g, cluster::BIGINT AS cluster, min(p) AS "first", max(p) AS "last", count(*) AS n FROM r GROUP BY g, cluster""",
    pos="SELECT o_custkey AS g, o_orderkey AS p FROM orders",
)
def w7_gap_clusters(pos: DataFrame) -> DataFrame:
    return runs.gap_clusters(pos, "g", "p", 600)


@query(
    """WITH d AS (SELECT DISTINCT g, p FROM pos), x AS (SELECT g, p - lag(p) OVER (PARTITION BY g ORDER BY p) AS gap FROM d), n AS (SELECT g, gap, count(*) AS n FROM x WHERE gap IS NOT NULL GROUP BY ALL),
 m AS (SELECT g, gap AS mode FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, gap) AS k FROM n) WHERE k = 1 AND n > 1),
 s AS (SELECT g, mode, sum(CASE WHEN abs(gap - mode) <= mode * 0.1 THEN n ELSE 0 END) / sum(n) AS share FROM n JOIN m USING (g) GROUP BY ALL) SELECT *, share >= 0.7 AS periodic FROM s""",
    pos="SELECT l_suppkey AS g, l_partkey AS p FROM lineitem",
)
def w8_modal_gap(pos: DataFrame) -> DataFrame:
    return runs.modal_gap(pos, "g", "p")


REGIONS = "SELECT o_custkey AS g, o_orderkey AS s, o_orderkey + 300 + o_orderkey % 900 AS e, o_orderkey AS w FROM orders"


@query(
    """WITH t AS (SELECT *, max(e * 1000000000 + w) OVER (PARTITION BY g ORDER BY s, e, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM regions), u AS (SELECT *, t // 1000000000 AS te, t % 1000000000 AS o FROM t)
 SELECT g, s AS start, w AS owner, o AS other, CASE WHEN s > te THEN 'gap' ELSE 'overlap' END AS kind, CASE WHEN s > te THEN s - te ELSE least(e, te) - s END AS amount FROM u WHERE t IS NOT NULL AND s <> te""",
    regions=REGIONS,
)
def j9_coverage_sweep(regions: DataFrame) -> DataFrame:
    return runs.coverage_sweep(regions, "g", "s", "e", "w")


@query(
    """WITH r AS (SELECT g, greatest(s - 50, 0) AS s, e + 50 AS e, w FROM regions), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM r),
 i AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT g, min(s) AS "first", max(e) AS "last", max(w) AS worst, count(*) AS n FROM i GROUP BY g, island""",
    regions=REGIONS,
)
def w17_pad_merge(regions: DataFrame) -> DataFrame:
    return runs.pad_merge(regions, "g", "s", "e", "w", 50)


@query(
    "SELECT g, position, max(rank) AS rank FROM (SELECT g, unnest(range(s, e + 1)) AS position, rank FROM lesions) GROUP BY g, position",
    lesions="SELECT o_custkey AS g, o_orderkey % 100 AS s, o_orderkey % 100 + o_orderkey % 7 AS e, o_orderkey % 4 AS rank FROM orders",
)
def v7_paint(lesions: DataFrame) -> DataFrame:
    return runs.paint(lesions, "g", "s", "e", "rank")


TURNS = "SELECT conv_id AS g, turn AS o, length(text) AS n, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS s FROM conversations"


@query(
    """WITH e AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY g ORDER BY o) <> s THEN 10 ELSE 0 END AS x FROM turns)
 SELECT g, o, n, s, (coalesce(sum(n + x) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + x)::BIGINT AS start FROM e""",
    turns=TURNS,
)
def w13_placed(turns: DataFrame) -> DataFrame:
    return runs.placed(turns, "g", "o", "n", "s", 10)


@query(
    """SELECT g, o, v, coalesce(min(v) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) < min(v) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING), true) AS improved FROM ev""",
    ev="SELECT user_id AS g, event_id AS o, value AS v FROM events",
)
def w14_plateau(ev: DataFrame) -> DataFrame:
    return runs.plateau(ev, "g", "o", "v", 3)


@query(
    """WITH m AS (SELECT g, o, v, list_sort(list(v) OVER (PARTITION BY g ORDER BY o ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS m FROM ev)
 SELECT g, o, v, m[len(m) // 2 + 1] AS median, v < 0.75 * m[len(m) // 2 + 1] AS is_dip FROM m""",
    ev="SELECT user_id AS g, event_id AS o, value AS v FROM events WHERE value IS NOT NULL",
)
def w11_moving_median(ev: DataFrame) -> DataFrame:
    return runs.moving_median(ev, "g", ["o"], "v", 9)


@query(
    """WITH p AS (SELECT g, o // 10 AS w, max(abs(v)) AS p FROM ev GROUP BY ALL), r AS (SELECT g, w, w - row_number() OVER (PARTITION BY g ORDER BY w) AS r FROM p WHERE p < 30)
 SELECT g, min(w) AS "first", max(w) AS "last", count(*) AS length FROM r GROUP BY g, r HAVING count(*) >= 2""",
    ev="SELECT event_type AS g, event_id AS o, value AS v FROM events",
)
def w18_silence(ev: DataFrame) -> DataFrame:
    return runs.silence(ev, "g", "o", "v", 10, 30, 2)


CHAIN = """SELECT g, s, p, CASE WHEN g % 5 = 0 AND s = 2 THEN 'x' ELSE sha2(concat(s, chr(10), t, chr(10), p), 256) END AS h, t
       FROM (SELECT conv_id AS g, turn - 0 AS s, role AS t, CASE WHEN turn = 0 THEN '' ELSE '-' END AS p FROM conversations WHERE turn < 1 OR conv_id % 3 = 0)"""


@query(
    """WITH c AS (SELECT g, s, coalesce(s = row_number() OVER w - 1 AND p = coalesce(lag(h) OVER w, '') AND h = sha256(concat(s, chr(10), t, chr(10), p)), false) AS ok FROM log WINDOW w AS (PARTITION BY g ORDER BY s))
 SELECT g, bool_and(ok) AS valid, min(CASE WHEN NOT ok THEN s END) AS first_bad FROM c GROUP BY g""",
    log=CHAIN,
)
def w9_chain_check(log: DataFrame) -> DataFrame:
    return runs.chain_check(log, "g", "s", "p", "h", ["t"])


@query(
    """SELECT g, d, max(v) AS max_v, avg(v) AS avg_v, sum(v) AS sum_v, CASE WHEN max(v) <= 50 THEN 'good' WHEN max(v) <= 90 THEN 'fair' ELSE 'poor' END AS grade FROM (SELECT g, d, coalesce(v, 0) AS v FROM ev) GROUP BY g, d""",
    ev="SELECT user_id AS g, event_id % 3 AS d, value AS v FROM events",
)
def a4_scan_summary(ev: DataFrame) -> DataFrame:
    return statistics.scan_summary(ev, ["g", "d"], ["v"], "v", [(50, "good"), (90, "fair")], "poor")


@query(
    """WITH r AS (SELECT g, v > 0 AS c, sum(CASE WHEN v > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY o) AS r FROM ev), b AS (SELECT g, max(n) AS burst FROM (SELECT g, r, count(*) FILTER (WHERE c) AS n FROM r GROUP BY g, r) GROUP BY g)
 SELECT g, avg(v) AS average, max(v) AS maximum, sum(v) AS total, quantile_disc(v, 0.95) AS p95, any_value(burst) AS burst FROM ev JOIN b USING (g) GROUP BY g""",
    ev="SELECT user_id % 50 AS g, event_id AS o, CAST(greatest(floor(value * 10) - 200, 0) AS DOUBLE) AS v FROM events",
)
def a5_error_report(ev: DataFrame) -> DataFrame:
    return statistics.error_report(ev, "g", "v", "o")


FIT = """SELECT g, n, slope, my - slope * mx AS intercept, r2, CASE WHEN n > 2 AND sxx > 0 THEN sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / sxx) END AS slope_se FROM
 (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0 END AS slope, CASE WHEN sxx > 0 AND syy > 0 THEN sxy * sxy / sxx / syy ELSE 0 END AS r2 FROM
 (SELECT g, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM xy GROUP BY g))"""


@query(f"SELECT g, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(slope_se, 6) AS slope_se FROM ({FIT})", xy="SELECT user_id AS g, CAST(event_id AS DOUBLE) / 100 AS x, value AS y FROM events")
def a7_linear_fit(xy: DataFrame) -> DataFrame:
    out = statistics.linear_fit(xy, "g", F.col("x"), F.col("y"))
    return out.select("g", "n", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "slope_se")))


@query(
    f"""WITH f AS (SELECT g, min(ts) AS t0, max(ts) AS t1 FROM hist GROUP BY g), xy AS (SELECT h.g, (epoch_us(ts) - epoch_us(t0)) / (86400e6 * 365.25) AS x, ln(greatest(v, 1)) AS y FROM hist h JOIN f USING (g)),
 fit AS ({FIT}) SELECT g, n, round(slope, 5) AS slope, CASE WHEN slope > 0 THEN round(least(greatest((ln(220) - intercept) / slope - (epoch_us(t1) - epoch_us(t0)) / (86400e6 * 365.25), 0), 500), 4) END AS years_left FROM fit JOIN f USING (g)""",
    hist="SELECT user_id AS g, ts, value AS v FROM events",
)
def a7_growth_fit(hist: DataFrame) -> DataFrame:
    out = statistics.growth_fit(hist, "g", "ts", "v", 220)
    return out.select("g", "n", F.round("slope", 5).alias("slope"), F.round("years_left", 4).alias("years_left"))


@query(
    """WITH m AS (SELECT g, sum(w * x) / sum(w) AS mean FROM vals WHERE w > 0 GROUP BY g) SELECT g, count(*) AS n, sum(w) AS w, round(any_value(mean), 4) AS mean, round(sum(w * (x - mean) * (x - mean)) / sum(w), 2) AS variance FROM vals JOIN m USING (g) WHERE w > 0 GROUP BY g""",
    vals="SELECT l_returnflag AS g, l_orderkey % 4 AS piece, l_extendedprice AS x, l_quantity AS w FROM lineitem",
)
def a8_merged_sketch(vals: DataFrame) -> DataFrame:
    parts = statistics.sketch(vals, ["g", "piece"], "x", "w")
    out = statistics.released(statistics.merge_sketches(parts, ["g"]))
    return out.select("g", "n", "w", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


@query("SELECT g, floor(o / 16)::BIGINT AS block, max(s) AS worst FROM ev GROUP BY ALL", ev="SELECT user_id AS g, event_id AS o, floor(value) AS s FROM events")
def a23_worst_of_block(ev: DataFrame) -> DataFrame:
    return statistics.worst_of_block(ev, "g", "o", "s", 16)


@query(
    """WITH s AS (SELECT g, min(o) AS lo, max(o) AS hi FROM ev GROUP BY g), m AS (SELECT g, coalesce(least(floor((o - lo) * 16 / nullif(hi - lo, 0)), 15), 0)::BIGINT AS bucket, avg(v) AS m FROM ev JOIN s USING (g) GROUP BY ALL)
 SELECT g, bucket, round(m / nullif(max(m) OVER (PARTITION BY g), 0), 9) AS share FROM m""",
    ev="SELECT user_id AS g, event_id AS o, value AS v FROM events",
)
def w12_position_buckets(ev: DataFrame) -> DataFrame:
    return statistics.position_buckets(ev, "g", "o", "v", 16).withColumn("share", F.round("share", 9))


@query("SELECT ev.* FROM ev JOIN (SELECT g, avg(d) AS md, avg(i) AS mi FROM ev GROUP BY g) USING (g) WHERE d < 0.6 * md OR i > 1.5 * mi", ev="SELECT user_id AS g, event_id AS o, value AS d, event_id % 10 AS i FROM events")
def w19_below_mean(ev: DataFrame) -> DataFrame:
    return statistics.below_mean(ev, "g", "d", "i", 0.6, 1.5)


@query(
    "SELECT g, min(a / s) AS lowest, sum(a) / sum(s) AS overall, max(a / s) AS highest, arg_min(p, {'r': a / s, 'p': p}) AS slowest_at FROM ev WHERE s > 0 GROUP BY g",
    ev="SELECT l_suppkey AS g, floor(l_extendedprice) AS a, floor(l_quantity) AS s, l_orderkey * 10 + l_linenumber AS p FROM lineitem",
)
def a16_rate_profile(ev: DataFrame) -> DataFrame:
    return statistics.rate_profile(ev, "g", "a", "s", "p")


@query("SELECT g, sum(n)::BIGINT AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM (SELECT g, s, count(*) AS n FROM sym GROUP BY g, s) GROUP BY g", sym="SELECT l_suppkey AS g, l_returnflag AS s FROM lineitem")
def a18_entropy(sym: DataFrame) -> DataFrame:
    return statistics.entropy(sym, "g", "s").withColumn("bits", F.round("bits", 6))


@query(
    "SELECT g, s, CASE WHEN bool_and(d) THEN 'data' WHEN NOT bool_or(d) THEN 'audio' ELSE 'mixed' END AS kind, min(a) AS first, max(a + n - 1) AS last, sum(n)::BIGINT AS sectors, count(*) AS tracks FROM tr GROUP BY g, s",
    tr="SELECT l_orderkey AS g, l_linenumber % 2 AS s, l_partkey % 2 = 0 AS d, l_linenumber * 1000 AS a, l_suppkey AS n FROM lineitem",
)
def a15_session_rollup(tr: DataFrame) -> DataFrame:
    return statistics.session_rollup(tr, ["g", "s"], "d", "a", "n")


@query(
    "SELECT event_type, CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL",
    ev="SELECT event_type, ts, value FROM events",
)
def streaming_hourly(ev: DataFrame) -> DataFrame:
    """The hourly totals of the streaming operator, over a batch."""
    out = windows.tumbling(ev, "ts", "1 hour", ["event_type"], "value")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT g, o, e - s AS len, gap FROM (SELECT *, s - lag(e) OVER (PARTITION BY g ORDER BY o) AS gap FROM regs)", regs="SELECT o_custkey AS g, o_orderkey AS o, o_orderkey AS s, o_orderkey + 5 AS e FROM orders")
def w20_gap_to_previous(regs: DataFrame) -> DataFrame:
    return runs.gap_to_previous(regs, "g", "o", "s", "e").select("g", "o", (F.col("e") - F.col("s")).alias("len"), "gap")


@query(
    """WITH e AS (SELECT g, min(l) AS a, max(l) AS b FROM names GROUP BY g), n AS (SELECT *, coalesce(list_max(list_filter(range(1, length(a) + 1), lambda i: a[1:i] = b[1:i])), 0) AS n FROM e) SELECT g, CASE WHEN n >= 3 THEN a[1:n] END AS prefix FROM n""",
    names="SELECT c_nationkey AS g, c_name AS l FROM customer",
)
def a13_common_prefix(names: DataFrame) -> DataFrame:
    return selection.common_prefix(names, "g", "l")
