"""Registered queries over the given tables and the SQL that gives the same rows.

Panels: weekly mean order price by priority (s1 to s5), its logs (l1 to l5), and the same by
region (system n_regionkey). Floating results are rounded the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import dist
from .operators import covariance, moments, panel, rank, replication, resample, unitroot
from .plans import boot, compare, draws, driven, fits, scoring
from .sources import panels, results, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

S5 = [f"s{k}" for k in range(1, 6)]
L5 = [f"l_s{k}" for k in range(1, 6)]

LONG = """long5 AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS d, 's' || substr(o_orderpriority, 1, 1) AS series,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS value FROM orders GROUP BY 1, 2)"""
WIDE = LONG + """, wide5 AS (SELECT d, max(CASE WHEN series = 's1' THEN value END) AS s1, max(CASE WHEN series = 's2' THEN value END) AS s2, max(CASE WHEN series = 's3' THEN value END) AS s3,
  max(CASE WHEN series = 's4' THEN value END) AS s4, max(CASE WHEN series = 's5' THEN value END) AS s5 FROM long5 GROUP BY d HAVING count(value) = 5)"""
LOGS = WIDE + """, log5 AS (SELECT *, ln(s1) AS l_s1, ln(s2) AS l_s2, ln(s3) AS l_s3, ln(s4) AS l_s4, ln(s5) AS l_s5, row_number() OVER (ORDER BY d) AS t FROM wide5)"""
DIFF = LOGS + """, diff5 AS (SELECT d, t, l_s1, l_s2, l_s3, l_s1 - lag(l_s1) OVER (ORDER BY d) AS y1, l_s2 - lag(l_s2) OVER (ORDER BY d) AS y2, lag(l_s1) OVER (ORDER BY d) AS x1, lag(l_s2) OVER (ORDER BY d) AS x2 FROM log5),
  des AS (SELECT *, lag(y1) OVER (ORDER BY d) AS z1, lag(y2) OVER (ORDER BY d) AS z2 FROM diff5)"""
REGION = """longr AS (SELECT n_regionkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
  logr AS (SELECT n_regionkey, d, ln(value) AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY d) AS t FROM longr)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql if sql.lstrip().upper().startswith("WITH") or sql.lstrip().upper().startswith("SELECT") else sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _mean(value: str):  # noqa: ANN202
    return F.sum(F.round(F.col(value) * 100).cast("bigint")) / (F.lit(100.0) * F.count("*"))


def long5(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("d"), F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)).alias("series"), "o_totalprice")
    return o.groupBy("d", "series").agg(_mean("o_totalprice").alias("value"))


def wide5(spark: SparkSession, d: str) -> DataFrame:
    """One row a week with all five series (the pivot values are given, so one job does)."""
    return long5(spark, d).groupBy("d").pivot("series", S5).agg(F.first("value")).na.drop(subset=S5)


def log5(spark: SparkSession, d: str) -> DataFrame:
    return panel.numbered(panel.logs(wide5(spark, d), S5), [])


def longr(spark: SparkSession, d: str) -> DataFrame:
    """Monthly mean order price of each region: as many systems as regions."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    o = table(spark, d, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("d"), "o_totalprice")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_regionkey", "d").agg(_mean("o_totalprice").alias("value"))


def logr(spark: SparkSession, d: str) -> DataFrame:
    return panel.numbered(longr(spark, d).withColumn("x", F.ln("value")).drop("value"), ["n_regionkey"])


def entry_query(spark: SparkSession, d: str) -> DataFrame:
    """Unit-root t statistics of log spreads between monthly order prices by priority."""
    o = table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("d"), F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)).alias("series"), "o_totalprice")
    wide = o.groupBy("d", "series").agg(_mean("o_totalprice").alias("value")).groupBy("d").pivot("series", S5).agg(F.first("value")).na.drop(subset=S5)
    spread = panel.spreads(panel.logs(wide, S5), L5).unpivot(["d"], [f"spread_{c}" for c in L5[1:]], "series", "value")
    return unitroot.adf0(spread, ["series"])


# Sources and sinks


@query("a1_year_month_matrix", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS value FROM orders GROUP BY 1""")
def a1(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m"), "o_totalprice")
    cells = o.groupBy("year", "m").agg(_mean("o_totalprice").cast("string").alias("v")).groupBy("year").pivot("m", list(range(1, 13))).agg(F.first("v"))
    names = [f"m{k}" for k in range(1, 13)]
    return panels.melt_months(cells.select("year", *(F.coalesce(F.col(str(k)), F.lit("NA")).alias(n) for k, n in zip(range(1, 13), names, strict=True))), "year", names)


@query("a2_date_value", """SELECT event_type AS series, CAST(date_trunc('day', ts) AS DATE) AS d, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2""")
def a2(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    lines = e.select(F.col("event_type").alias("series"), F.concat_ws(" ", F.col("day").cast("string"), F.col("n").cast("string")).alias("value"))
    return panels.parse_date_values(lines, ["series"], unit=None)


@query("a3_panel_with_logs", f"WITH {WIDE} SELECT d, s1, s2, s3, s4, s5, round(ln(s1), 6) AS l_s1, round(ln(s2), 6) AS l_s2, round(ln(s3), 6) AS l_s3, round(ln(s4), 6) AS l_s4, round(ln(s5), 6) AS l_s5 FROM wide5")
def a3(spark, d):  # noqa: ANN001, ANN201
    return panels.with_logs(wide5(spark, d), S5)


@query("a4_named_columns", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < DATE '1996-01-01'")
def a4(spark, d):  # noqa: ANN001, ANN201
    return panels.load_panel(spark, f"{d}/orders.parquet", ["o_totalprice", "o_orderdate"], "o_orderkey").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).drop("o_orderdate")


@query(
    "a5_read_results",
    """WITH r AS (SELECT event_type, event_id, CAST(event_id % 700 AS INTEGER) AS j, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS a, CAST(event_id AS DOUBLE) AS b FROM events)
    SELECT event_type, j, arg_max(a, event_id) AS a, max(b) AS b FROM r WHERE a IS NOT NULL GROUP BY 1, 2""",
)
def a5(spark, d):  # noqa: ANN001, ANN201
    i = F.col("event_id")
    second = F.when(i % 11 == 0, F.lit("torn!")).otherwise(F.col("user_id").cast("string"))
    line = F.when(i % 13 == 0, F.concat_ws(" ", (i % 700).cast("string"), second)).otherwise(F.concat_ws("  ", (i % 700).cast("string"), second, i.cast("string")))
    lines = table(spark, d, "events").select("event_type", i, line.alias("value"))
    return results.parse_results(lines, 2, order="event_id", keys=["event_type"]).select("event_type", "j", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@query(
    "a6_pick_run",
    """WITH f AS (SELECT DISTINCT event_type AS spec, CAST((user_id % 5 + 1) * 100 AS INTEGER) AS M, CASE WHEN user_id % 3 = 0 THEN 'cap' ELSE '' END AS tag FROM events)
    SELECT spec, M, tag FROM f QUALIFY row_number() OVER (PARTITION BY spec ORDER BY CASE WHEN tag = 'cap' THEN 1 ELSE 0 END DESC, M DESC) = 1""",
)
def a6(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events")
    name = F.concat(F.lit("out/size_"), "event_type", F.lit("_M"), ((F.col("user_id") % 5 + 1) * 100).cast("string"), F.when(F.col("user_id") % 3 == 0, "_cap").otherwise(""), F.lit(".txt"))
    runs = results.named_runs(e.select(name.alias("file")).distinct())
    return results.pick_run(runs.withColumn("rank", (F.col("tag") == "cap").cast("int")), "spec", "rank", "M").select("spec", "M", "tag")


@query("a7_missing_keys", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def a7(spark, d):  # noqa: ANN001, ANN201
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return results.todo(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("a8_export_samples", f"""WITH {WIDE} SELECT d, "column", value FROM wide5 UNPIVOT (value FOR "column" IN (s1, s2, s3, s4, s5))""")
def a8(spark, d):  # noqa: ANN001, ANN201
    return panels.export_samples(wide5(spark, d), [], S5, "d")


@query("a9_namespaces", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'F1' ELSE 'spot' END AS numeraire, count(*) AS n FROM orders GROUP BY 1")
def a9(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    both = results.namespaced(o.where("o_orderstatus = 'F'"), "F1").unionByName(results.namespaced(o.where("o_orderstatus <> 'F'"), "spot"))
    return both.groupBy("numeraire").agg(F.count("*").alias("n"))


@query("a10_report", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, 'detail' AS kind FROM events GROUP BY 1 UNION ALL SELECT NULL, CAST(count(*) AS BIGINT), 'summary' FROM events")
def a10(spark, d):  # noqa: ANN001, ANN201
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return results.report(n, n.agg(F.sum("n").alias("n")))


# Panel shaping


@query("b1_align", f"WITH {WIDE} SELECT d, s1, s2, s3, s4, s5 FROM wide5")
def b1(spark, d):  # noqa: ANN001, ANN201
    return wide5(spark, d)


@query("b2_coverage", f"WITH {LONG} SELECT series, min(d) AS first, max(d) AS last, count(value) AS n, bool_or(value <= 0) AS any_nonpositive FROM long5 GROUP BY 1")
def b2(spark, d):  # noqa: ANN001, ANN201
    return panel.coverage(long5(spark, d), ["series"])


@query("b3_log_levels", f"WITH {LOGS} SELECT d, round(l_s1, 9) AS l_s1, round(l_s5, 9) AS l_s5 FROM log5")
def b3(spark, d):  # noqa: ANN001, ANN201
    return rounded(panel.logs(wide5(spark, d), S5).select("d", "l_s1", "l_s5"), "l_s1", "l_s5", digits=9)


@query("b4_differences", f"WITH {REGION} SELECT n_regionkey, d, round(x - lag(x) OVER (PARTITION BY n_regionkey ORDER BY d), 9) AS d_x FROM logr")
def b4(spark, d):  # noqa: ANN001, ANN201
    return rounded(panel.diffs(logr(spark, d), ["x"], ["n_regionkey"]).select("n_regionkey", "d", "d_x"), "d_x", digits=9)


@query(
    "b5_lag_design",
    f"""WITH {REGION}, y AS (SELECT *, x - lag(x) OVER w AS y_x, lag(x) OVER w AS x_x FROM logr WINDOW w AS (PARTITION BY n_regionkey ORDER BY d))
    SELECT n_regionkey, d, round(y_x, 9) AS y_x, round(x_x, 9) AS x_x, round(lag(y_x, 1) OVER w, 9) AS z1_x, round(lag(y_x, 2) OVER w, 9) AS z2_x FROM y WINDOW w AS (PARTITION BY n_regionkey ORDER BY d)""",
)
def b5(spark, d):  # noqa: ANN001, ANN201
    cs = ["y_x", "x_x", "z1_x", "z2_x"]
    return rounded(panel.lag_design(logr(spark, d), ["x"], 3, ["n_regionkey"]).select("n_regionkey", "d", *cs), *cs, digits=9)


@query("b6_common_sample", f"WITH {REGION} SELECT n_regionkey, count(*) AS n, min(d) AS first FROM logr WHERE t >= 6 GROUP BY 1")
def b6(spark, d):  # noqa: ANN001, ANN201
    return panel.common_sample(logr(spark, d), 6, ["n_regionkey"]).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("d").alias("first"))


@query("b7_fourier", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, round(cos(2 * pi() * month(o_orderdate) / 12), 9) + 0 AS c1, round(sin(2 * pi() * month(o_orderdate) / 12), 9) + 0 AS s1, round(cos(4 * pi() * month(o_orderdate) / 12), 9) + 0 AS c2 FROM orders")
def b7(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("d")).distinct()
    return panel.fourier(o, 2).select("d", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("c1", "s1", "c2")))


@query("b8_dummies", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d, (quarter(o_orderdate) = 2)::DOUBLE AS q2, (quarter(o_orderdate) = 3)::DOUBLE AS q3, (quarter(o_orderdate) = 4)::DOUBLE AS q4, (month(o_orderdate) = 12)::DOUBLE AS m12 FROM orders")
def b8(spark, d):  # noqa: ANN001, ANN201
    o = table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("d")).distinct()
    return panel.dummies(panel.dummies(o, "quarter"), "month").select("d", "q2", "q3", "q4", "m12")


@query("b9_deterministics", f"WITH {REGION} SELECT n_regionkey, d, CAST(1 AS DOUBLE) AS const, CAST(t - 1 AS DOUBLE) AS trend FROM logr")
def b9(spark, d):  # noqa: ANN001, ANN201
    return panel.deterministics(logr(spark, d), ["n_regionkey"]).select("n_regionkey", "d", "const", "trend")


@query("b10_spreads", f"WITH {LOGS} SELECT d, round(l_s2 - l_s1, 9) AS spread_l_s2, round(l_s3 - 0.9 * l_s1, 9) AS spread_l_s3 FROM log5")
def b10(spark, d):  # noqa: ANN001, ANN201
    out = panel.spreads(log5(spark, d), ["l_s1", "l_s2", "l_s3"], [1.0, 0.9])
    return rounded(out.select("d", "spread_l_s2", "spread_l_s3"), "spread_l_s2", "spread_l_s3", digits=9)


DRIVER = DIFF + """, drv0 AS (SELECT d, t, (abs(lag(l_s1) OVER (ORDER BY d) - lag(l_s1, 2) OVER (ORDER BY d)) + abs(lag(l_s2) OVER (ORDER BY d) - lag(l_s2, 2) OVER (ORDER BY d))) / 2 AS m FROM log5),
  drv AS (SELECT d, t, m / avg(m) OVER () AS v FROM drv0)"""


@query("b11_volatility_driver", f"WITH {DRIVER} SELECT d, round(v, 7) AS v FROM drv")
def b11(spark, d):  # noqa: ANN001, ANN201
    return rounded(panel.volatility_driver(log5(spark, d), ["l_s1", "l_s2"], []).select("d", "v"), "v", digits=7)


@query("b12_cap_driver", f"WITH {DRIVER}, top AS (SELECT max(v) AS m FROM drv WHERE t <= 100) SELECT d, round(least(v, m), 7) AS v FROM drv, top")
def b12(spark, d):  # noqa: ANN001, ANN201
    v = panel.volatility_driver(log5(spark, d), ["l_s1", "l_s2"], []).select("d", "t", "v")
    return rounded(panel.cap_driver(v, v.where("t <= 100"), []).select("d", "v"), "v", digits=7)


@query("b13_segments", f"WITH {LOGS} SELECT CAST(CASE WHEN t > 60 THEN 1 ELSE 0 END + CASE WHEN t > 200 THEN 1 ELSE 0 END AS INTEGER) AS segment, count(*) AS n, min(d) AS first FROM log5 GROUP BY 1")
def b13(spark, d):  # noqa: ANN001, ANN201
    return log5(spark, d).withColumn("segment", panel.segment(F.col("t"), [60, 200])).groupBy("segment").agg(F.count("*").alias("n"), F.min("d").alias("first"))


_REGION_BREAKS = [(0, [20, 50]), (1, [30]), (2, [25, 40, 60]), (3, [45, 46])]


def _own_breaks(rows: DataFrame) -> DataFrame:
    """Breaks of each region's own, from a table of them; the last region has none."""
    listed = F.coalesce(*(F.when(F.col("n_regionkey") == k, F.array(*map(F.lit, ks))) for k, ks in _REGION_BREAKS))
    return rows.select("n_regionkey").distinct().select("n_regionkey", listed.alias("breaks")).where("breaks IS NOT NULL")


@query(
    "b13_segments_own",
    f"WITH {REGION}, b AS (SELECT unnest([{', '.join(str(k) for k, ks in _REGION_BREAKS for _ in ks)}]) AS r, unnest([{', '.join(str(x) for _, ks in _REGION_BREAKS for x in ks)}]) AS k), s AS (SELECT n_regionkey, t, d, CAST((SELECT count(*) FROM b WHERE r = n_regionkey AND t > k) AS INTEGER) AS segment FROM logr) SELECT n_regionkey, segment, count(*) AS n, min(d) AS first FROM s GROUP BY 1, 2",
)
def b13_own(spark, d):  # noqa: ANN001, ANN201
    rows = logr(spark, d)
    return panel.with_segments(rows, ["n_regionkey"], _own_breaks(rows)).groupBy("n_regionkey", "segment").agg(F.count("*").alias("n"), F.min("d").alias("first"))


@query("e19_fit_regime_own")
def e19_own(spark, d):  # noqa: ANN001, ANN201
    """One job, with breaks of each region's own."""
    rows = _region_system(spark, d)
    return fits.regime(rows, L5[:3], ["n_regionkey"], _own_breaks(rows)).drop("params_free", "params_one")


@query("b14_break_dates", f"WITH {LOGS} SELECT CAST(t - 1 AS INTEGER) AS k, strftime(d, '%Y-%m') AS break_date FROM log5 WHERE t IN (61, 201)")
def b14(spark, d):  # noqa: ANN001, ANN201
    return panel.break_dates(log5(spark, d), spark.createDataFrame([(60,), (200,)], "k int"), [])


@query("b15_large_moves", f"WITH {LOGS}, m AS (SELECT d, l_s1 - lag(l_s1) OVER (ORDER BY d) AS l_s1, l_s2 - lag(l_s2) OVER (ORDER BY d) AS l_s2 FROM log5) SELECT d, series, round(move, 9) AS move FROM m UNPIVOT (move FOR series IN (l_s1, l_s2)) WHERE abs(move) > 0.15")
def b15(spark, d):  # noqa: ANN001, ANN201
    return rounded(panel.large_moves(log5(spark, d), ["l_s1", "l_s2"], [], 0.15), "move", digits=9)


@query("b16_period_vol", f"WITH {LOGS}, m AS (SELECT d, l_s1 - lag(l_s1) OVER (ORDER BY d) AS l_s1, l_s2 - lag(l_s2) OVER (ORDER BY d) AS l_s2 FROM log5), u AS (SELECT d, series, move FROM m UNPIVOT (move FOR series IN (l_s1, l_s2))) SELECT series, round(stddev_samp(move), 7) AS sd_all, round(stddev_samp(move) FILTER (d < DATE '1996-01-01'), 7) AS sd_early, round(stddev_samp(move) FILTER (d >= DATE '1996-01-01'), 7) AS sd_late FROM u GROUP BY 1")
def b16(spark, d):  # noqa: ANN001, ANN201
    return rounded(panel.period_vol(log5(spark, d), ["l_s1", "l_s2"], "1996-01-01", []), "sd_all", "sd_early", "sd_late", digits=7)


@query("b17_compare_series", f"WITH {LOGS}, m AS (SELECT l_s1 - l_s2 AS gap, l_s1 - lag(l_s1) OVER (ORDER BY d) AS ra, l_s2 - lag(l_s2) OVER (ORDER BY d) AS rb FROM log5) SELECT round(stddev_samp(gap), 7) AS sd_gap, round(median(abs(exp(gap) - 1)), 7) AS median_gap, CAST(count(*) FILTER (gap = 0) AS BIGINT) AS n_equal, round(corr(ra, rb), 7) AS corr, round(stddev_samp(ra) / stddev_samp(rb), 7) AS sd_ratio FROM m")
def b17(spark, d):  # noqa: ANN001, ANN201
    return rounded(panel.compare_series(log5(spark, d), "l_s1", "l_s2", []), "sd_gap", "median_gap", "corr", "sd_ratio", digits=7)


@query("b18_bases", f"WITH {LOGS} SELECT d, line, round(value, 9) AS value FROM (SELECT d, l_s1, l_s2, l_s2 - l_s1 AS basis_l_s2 FROM log5) UNPIVOT (value FOR line IN (l_s1, l_s2, basis_l_s2))")
def b18(spark, d):  # noqa: ANN001, ANN201
    return rounded(panel.bases_table(log5(spark, d), ["l_s1", "l_s2"], []), "value", digits=9)


# Joins


def _parts(spark: SparkSession, d: str) -> list[DataFrame]:
    return [long5(spark, d).where(F.col("series") == s).select("d", F.col("value").alias(s)) for s in ("s1", "s2", "s3")]


@query("c1_inner_align", f"WITH {LONG} SELECT a.d, a.value AS s1, b.value AS s2, c.value AS s3 FROM long5 a JOIN long5 b ON a.d = b.d AND b.series = 's2' JOIN long5 c ON a.d = c.d AND c.series = 's3' WHERE a.series = 's1'")
def c1(spark, d):  # noqa: ANN001, ANN201
    return panel.inner_align(_parts(spark, d), ["d"])


@query("c2_outer_align", f"WITH {LONG} SELECT d, max(CASE WHEN series = 's1' THEN value END) AS s1, max(CASE WHEN series = 's2' THEN value END) AS s2, max(CASE WHEN series = 's3' THEN value END) AS s3 FROM long5 WHERE series IN ('s1', 's2', 's3') GROUP BY d")
def c2(spark, d):  # noqa: ANN001, ANN201
    return panel.outer_align(_parts(spark, d), ["d"])


@query("c4_requested", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def c4(spark, d):  # noqa: ANN001, ANN201
    wanted = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return results.requested(table(spark, d, "customer").select("c_custkey", "c_nationkey"), wanted, ["c_custkey"])


@query("c5_grid", f"WITH {LONG}, s AS (SELECT DISTINCT series FROM long5), g AS (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS s1) SELECT series, s1 FROM s, g")
def c5(spark, d):  # noqa: ANN001, ANN201
    return long5(spark, d).select("series").distinct().select("series", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("s1"))


@query("c6_range_segments", f"WITH {LOGS}, e(name, lo, hi) AS (VALUES ('early', 0, 60), ('mid', 60, 200), ('late', 200, 100000)) SELECT name, count(*) AS n, round(avg(l_s1), 9) AS mean FROM log5 JOIN e ON t > lo AND t <= hi GROUP BY 1")
def c6(spark, d):  # noqa: ANN001, ANN201
    edges = spark.createDataFrame([("early", 0, 60), ("mid", 60, 200), ("late", 200, 100_000)], "name string, lo int, hi int")
    return rounded(panel.segments_by_range(log5(spark, d), edges).groupBy("name").agg(F.count("*").alias("n"), F.avg("l_s1").alias("mean")), "mean", digits=9)


@query("c7_lookup", "SELECT o_orderpriority, count(*) AS n, max(cv) AS cv FROM orders JOIN (VALUES ('1-URGENT', 2.7055), ('2-HIGH', 3.8415)) v(p, cv) ON p = o_orderpriority GROUP BY 1".replace("max(cv)", "CAST(max(cv) AS DOUBLE)"))
def c7(spark, d):  # noqa: ANN001, ANN201
    values = spark.createDataFrame([("1-URGENT", 2.7055), ("2-HIGH", 3.8415)], "o_orderpriority string, cv double")
    return table(spark, d, "orders").join(F.broadcast(values), "o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("cv").alias("cv"))


@query("c8_autocovariance", f"WITH {REGION}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY n_regionkey) AS e FROM logr), l AS (SELECT *, lag(e) OVER (PARTITION BY n_regionkey ORDER BY d) AS e1 FROM c) SELECT n_regionkey, round(1000 * sum(e * e1) / count(*), 6) AS c1 FROM l GROUP BY 1")
def c8(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("n_regionkey")
    c = logr(spark, d).withColumn("e", F.col("x") - F.avg("x").over(w))
    n = c.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return moments.lag_gram(c, ["e"], 1, ["n_regionkey"]).join(n, "n_regionkey").select("n_regionkey", F.round(1000 * F.col("value") / F.col("n"), 6).alias("c1"))


# Moments



@query("d1_gram", f"WITH {DIFF}, u AS (SELECT y1, x1 - 12 AS x, z1, 1.0::DOUBLE AS one FROM des WHERE z1 IS NOT NULL), g AS (SELECT count(*) AS n, sum(y1 * y1) AS a, sum(y1 * x) AS b, sum(y1 * z1) AS c, sum(y1) AS e, sum(x * x) AS f, sum(x * z1) AS g, sum(x) AS h, sum(z1 * z1) AS k, sum(z1) AS l, sum(one) AS m FROM u) SELECT n, unnest([0, 0, 0, 0, 1, 1, 1, 2, 2, 3]) AS i, unnest([0, 1, 2, 3, 1, 2, 3, 2, 3, 3]) AS j, round(unnest([a, b, c, e, f, g, h, k, l, m]), 6) AS value FROM g")
def d1(spark, d):  # noqa: ANN001, ANN201
    rows = panel.lag_design(log5(spark, d), ["l_s1"], 2, []).withColumns({"x": F.col("x_l_s1") - 12, "one": F.lit(1.0)})
    return rounded(moments.gram(rows, ["y_l_s1", "x", "z1_l_s1", "one"], []), "value")


@query("d2_segment_gram", f"WITH {DIFF}, u AS (SELECT CASE WHEN t > 100 THEN 1 ELSE 0 END AS segment, y1, x1 - 12 AS x FROM diff5 WHERE y1 IS NOT NULL), g AS (SELECT segment, count(*) AS n, sum(y1 * y1) AS a, sum(y1 * x) AS b, sum(x * x) AS c FROM u GROUP BY 1) SELECT CAST(segment AS INTEGER) AS segment, n, unnest([0, 0, 1]) AS i, unnest([0, 1, 1]) AS j, round(unnest([a, b, c]), 6) AS value FROM g")
def d2(spark, d):  # noqa: ANN001, ANN201
    rows = panel.numbered(panel.lag_design(log5(spark, d), ["l_s1"], 1, []), []).withColumns({"x": F.col("x_l_s1") - 12, "segment": panel.segment(F.col("t"), [100])})
    return rounded(moments.gram(rows, ["y_l_s1", "x"], ["segment"]), "value")


@query("d3_prefix_gram", f"WITH {REGION}, p AS (SELECT n_regionkey, t, sum((x - 12) * (x - 12)) OVER (PARTITION BY n_regionkey ORDER BY d) AS value FROM logr) SELECT n_regionkey, CAST(t AS INTEGER) AS k, round(value, 6) AS value FROM p WHERE t IN (10, 37, 60)")
def d3(spark, d):  # noqa: ANN001, ANN201
    rows = logr(spark, d).withColumn("x", F.col("x") - 12)
    return rounded(moments.prefix_gram(rows, "x", "x", ["n_regionkey"], [10, 37, 60], block=16), "value")


@query("d4_weighted_gram", f"WITH {DIFF}, u AS (SELECT y1, x1 - 12 AS x, CASE WHEN t > 100 THEN 0.5::DOUBLE ELSE 2::DOUBLE END AS w FROM diff5 WHERE y1 IS NOT NULL), g AS (SELECT count(*) AS n, sum(w * y1 * y1) AS a, sum(w * y1 * x) AS b, sum(w * x * x) AS c FROM u) SELECT n, unnest([0, 0, 1]) AS i, unnest([0, 1, 1]) AS j, round(unnest([a, b, c]), 6) AS value FROM g")
def d4(spark, d):  # noqa: ANN001, ANN201
    rows = panel.numbered(panel.lag_design(log5(spark, d), ["l_s1"], 1, []), []).withColumn("x", F.col("x_l_s1") - 12)
    return rounded(moments.gram(rows, ["y_l_s1", "x"], [], F.when(F.col("t") > 100, 0.5).otherwise(2.0)), "value")


@query("d5_driver_power_gram", f"WITH {DRIVER}, u AS (SELECT v, y1 FROM drv JOIN diff5 USING (d) WHERE v IS NOT NULL AND y1 IS NOT NULL), g AS (SELECT count(*) AS n, sum(y1 * y1) AS a, sum(v * y1 * y1) AS b, sum(v * v * y1 * y1) AS c FROM u) SELECT unnest([0, 1, 2]) AS power, n, 0 AS i, 0 AS j, round(unnest([a, b, c]), 6) AS value FROM g")
def d5(spark, d):  # noqa: ANN001, ANN201
    rows = panel.volatility_driver(panel.diffs(log5(spark, d), ["l_s1"], []), ["l_s1", "l_s2"], []).select("v", F.col("d_l_s1").alias("y")).na.drop()
    return rounded(moments.driver_power_gram(rows, ["y"], "v", []), "value")


@query("d6_lag_gram", f"WITH {DIFF}, l AS (SELECT y1, y2, lag(y1) OVER (ORDER BY d) AS a, lag(y2) OVER (ORDER BY d) AS b FROM diff5) SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j, round(unnest([sum(y1 * a), sum(y1 * b), sum(y2 * a), sum(y2 * b)]), 6) AS value FROM l")
def d6(spark, d):  # noqa: ANN001, ANN201
    return rounded(moments.lag_gram(panel.diffs(log5(spark, d), ["l_s1", "l_s2"], []), ["d_l_s1", "d_l_s2"], 1, []), "value")


@query("d7_residual_cov", f"WITH {DIFF} SELECT count(y1) AS n, unnest([0, 0, 1]) AS i, unnest([0, 1, 1]) AS j, round(unnest([sum(y1 * y1), sum(y1 * y2), sum(y2 * y2)]) / count(y1), 9) AS value FROM diff5")
def d7(spark, d):  # noqa: ANN001, ANN201
    return rounded(moments.residual_cov(panel.diffs(log5(spark, d), ["l_s1", "l_s2"], []), ["d_l_s1", "d_l_s2"], []), "value", digits=9)


@query("d8_min_correlation", f"WITH {LOGS} SELECT round(least(corr(l_s1, l_s2), corr(l_s1, l_s3), corr(l_s2, l_s3)), 7) AS min_corr FROM log5")
def d8(spark, d):  # noqa: ANN001, ANN201
    return rounded(moments.correlations(log5(spark, d), ["l_s1", "l_s2", "l_s3"], []).select("min_corr"), "min_corr", digits=7)


@query(
    "d8_condition",
    f"""WITH {LOGS}, c AS (SELECT corr(l_s1, l_s2) AS min_corr, var_pop(l_s1) AS a, var_pop(l_s2) AS b, covar_pop(l_s1, l_s2) AS c FROM log5),
    e AS (SELECT min_corr, (a + b) / 2 AS m, sqrt((a - b) * (a - b) / 4 + c * c) AS r FROM c) SELECT round(min_corr, 7) AS min_corr, round((m + r) / (m - r), 6) AS condition FROM e""",
)
def d8_condition(spark, d):  # noqa: ANN001, ANN201
    return rounded(rounded(moments.correlations(log5(spark, d), ["l_s1", "l_s2"], []), "min_corr", digits=7), "condition")


@query("d9_regime_variances", f"WITH {LOGS} SELECT CAST(CASE WHEN t > 150 THEN 1 ELSE 0 END AS INTEGER) AS segment, count(*) AS n, round(ln(var_pop(l_s1) * var_pop(l_s2) - covar_pop(l_s1, l_s2) * covar_pop(l_s1, l_s2)), 6) AS logdet, round((var_pop(l_s1) + var_pop(l_s2)) / 2, 9) AS mean_variance FROM log5 GROUP BY 1")
def d9(spark, d):  # noqa: ANN001, ANN201
    rows = log5(spark, d).withColumn("segment", panel.segment(F.col("t"), [150]))
    return rounded(rounded(moments.regime_variances(rows, ["l_s1", "l_s2"], ["segment"]), "logdet"), "mean_variance", digits=9)


@query("d10_weight_spread", "SELECT event_type, round(quantile_cont(value, 0.9) / quantile_cont(value, 0.1), 6) AS spread FROM events WHERE value > 0 GROUP BY 1")
def d10(spark, d):  # noqa: ANN001, ANN201
    return rounded(moments.weight_spread(table(spark, d, "events").where("value > 0"), "value", ["event_type"]), "spread")


# Tests and estimators


def _det(rows: list[str], cols: list[str]) -> str:
    """SQL of the determinant of covariances c_<row>_<column>, by its first row."""
    if not rows:
        return "1"
    parts = [f"{'-' if k % 2 else '+'} c_{rows[0]}_{c} * ({_det(rows[1:], [x for x in cols if x != c])})" for k, c in enumerate(cols)]
    return " ".join(parts).lstrip("+ ")


def _covariances(y: str, x: list[str]) -> str:
    """SQL columns of all covariances of a regression's columns."""
    return ", ".join(f"covar_pop({a}, {b}) AS c_{a}_{b}" for a in [y, *x] for b in [y, *x])


def _ss(y: str, x: list[str]) -> str:
    """SQL of the residual sum of squares of y on x and a constant."""
    return f"(n * ({_det([y, *x], [y, *x])}) / ({_det(x, x)}))"


def _b(y: str, x: list[str], k: int) -> str:
    return f"(({_det(x, [y if i == k else c for i, c in enumerate(x)])}) / ({_det(x, x)}))"


def _se(y: str, x: list[str], k: int) -> str:
    rest = [c for i, c in enumerate(x) if i != k]
    return f"sqrt({_ss(y, x)} / (n - {len(x) + 1}) / n * ({_det(rest, rest)}) / ({_det(x, x)}))"


LAGGED = f"""WITH {REGION}, m1 AS (SELECT n_regionkey, t, x - lag(x) OVER w AS y, lag(x) OVER w AS l FROM logr WINDOW w AS (PARTITION BY n_regionkey ORDER BY t)),
  m AS (SELECT *, lag(y) OVER w AS z, lag(y, 2) OVER w AS z2 FROM m1 WINDOW w AS (PARTITION BY n_regionkey ORDER BY t))"""

@query(
    "dist_chi2_quantile",
    "WITH q AS (SELECT DISTINCT l_discount * 5 + 0.05::DOUBLE AS u FROM lineitem) SELECT round(u, 6) AS u, round(-2 * ln(u), 7) AS x2 FROM q",
)
def chi2_quantiles(spark, d):  # noqa: ANN001, ANN201
    u = table(spark, d, "lineitem").select((F.col("l_discount") * 5 + 0.05).alias("u")).distinct()
    return u.select(F.round("u", 6).alias("u"), F.round(dist.chi2_quantile(F.col("u"), 2), 7).alias("x2"))


@query("e1_ols_one", f"WITH {REGION}, m AS (SELECT n_regionkey, x - lag(x) OVER w AS y, lag(x) OVER w AS l FROM logr WINDOW w AS (PARTITION BY n_regionkey ORDER BY d)) SELECT n_regionkey, CAST(regr_count(y, l) AS BIGINT) AS n, round(regr_slope(y, l), 6) AS slope, round(regr_intercept(y, l), 5) AS intercept, round(sqrt((regr_syy(y, l) - regr_sxy(y, l) * regr_sxy(y, l) / regr_sxx(y, l)) / (regr_count(y, l) - 2) / regr_sxx(y, l)), 6) AS se, round(regr_r2(y, l), 6) AS r2 FROM m GROUP BY 1")
def e1(spark, d):  # noqa: ANN001, ANN201
    w = panel.ordered(["n_regionkey"])
    m = logr(spark, d).withColumns({"y": F.col("x") - F.lag("x").over(w), "l": F.lag("x").over(w)}).select("n_regionkey", "y", "l").na.drop()
    return rounded(rounded(unitroot.ols_one(m, "y", "l", ["n_regionkey"]), "slope", "se", "r2"), "intercept", digits=5)


_X = ["l", "z", "tt"]


@query(
    "e1_ols_many",
    f"""{LAGGED}, c AS (SELECT n_regionkey, count(*) AS n, {_covariances("y", _X)} FROM (SELECT *, CAST(t - 1 AS DOUBLE) AS tt FROM m WHERE z IS NOT NULL) GROUP BY 1)
    SELECT n_regionkey, n, round({_b("y", _X, 0)}, 5) AS b_level, round({_se("y", _X, 0)}, 5) AS se_level, round({_b("y", _X, 1)}, 5) AS b_lag, round({_se("y", _X, 1)}, 5) AS se_lag, round({_b("y", _X, 2)}, 6) AS b_trend, round({_ss("y", _X)} / (n - 4), 7) AS s2 FROM c""",
)
def e1_many(spark, d):  # noqa: ANN001, ANN201
    rows = panel.deterministics(panel.lag_design(logr(spark, d), ["x"], 2, ["n_regionkey"]), ["n_regionkey"])
    found = unitroot.ols(rows, "y_x", ["x_x", "z1_x", "const", "trend"], ["n_regionkey"])
    at = lambda c, k, digits: F.round(F.col(c)[k], digits)
    return found.select("n_regionkey", "n", at("b", 0, 5).alias("b_level"), at("se", 0, 5).alias("se_level"), at("b", 1, 5).alias("b_lag"), at("se", 1, 5).alias("se_lag"), at("b", 3, 6).alias("b_trend"), F.round("s2", 7).alias("s2"))


ADF = f"""WITH {LOGS}, u AS (SELECT d, series, value FROM (SELECT d, l_s2 - l_s1 AS spread_l_s2, l_s3 - l_s1 AS spread_l_s3, l_s4 - l_s1 AS spread_l_s4, l_s5 - l_s1 AS spread_l_s5 FROM log5) UNPIVOT (value FOR series IN (spread_l_s2, spread_l_s3, spread_l_s4, spread_l_s5))),
  m AS (SELECT series, value - lag(value) OVER w AS y, lag(value) OVER w AS l FROM u WINDOW w AS (PARTITION BY series ORDER BY d)),
  r AS (SELECT series, CAST(regr_count(y, l) AS BIGINT) AS n, regr_slope(y, l) / sqrt((regr_syy(y, l) - regr_sxy(y, l) * regr_sxy(y, l) / regr_sxx(y, l)) / (regr_count(y, l) - 2) / regr_sxx(y, l)) AS t FROM m GROUP BY 1)"""


def _spreads(spark: SparkSession, d: str) -> DataFrame:
    return panel.spreads(log5(spark, d), L5).unpivot(["d"], [f"spread_{c}" for c in L5[1:]], "series", "value")


@query("e2_adf", ADF + " SELECT series, n, round(t, 5) AS t, t < -2.87 AS rejects FROM r")
def e2(spark, d):  # noqa: ANN001, ANN201
    return rounded(unitroot.adf0(_spreads(spark, d), ["series"]), "t", digits=5)


_XT = ["l", "z", "z2", "tt"]


@query(
    "e2_adf_trend",
    f"""{LAGGED}, c AS (SELECT n_regionkey, count(*) AS n, {_covariances("y", _XT)} FROM (SELECT *, CAST(t AS DOUBLE) AS tt FROM m WHERE z2 IS NOT NULL) GROUP BY 1),
    r AS (SELECT n_regionkey, n, {_b("y", _XT, 0)} / {_se("y", _XT, 0)} AS t FROM c) SELECT n_regionkey, n, round(t, 5) AS t, t < -3.96 AS rejects1, t < -3.41 AS rejects5, t < -3.13 AS rejects10 FROM r""",
)
def e2_trend(spark, d):  # noqa: ANN001, ANN201
    """Levels with two lags and a trend, as each region's log price."""
    return rounded(unitroot.adf(logr(spark, d), ["n_regionkey"], 2, "ct", "x"), "t", digits=5)


ADF1 = f"""WITH {REGION}, y AS (SELECT n_regionkey, t, x - lag(x) OVER w AS y, lag(x) OVER w AS l FROM logr WINDOW w AS (PARTITION BY n_regionkey ORDER BY d)),
  z AS (SELECT *, lag(y) OVER (PARTITION BY n_regionkey ORDER BY t) AS z FROM y),
  c AS (SELECT n_regionkey, count(*) AS n, covar_pop(y, y) AS yy, covar_pop(y, l) AS yl, covar_pop(y, z) AS yz, covar_pop(l, l) AS ll, covar_pop(l, z) AS lz, covar_pop(z, z) AS zz FROM z WHERE z IS NOT NULL GROUP BY 1),
  b AS (SELECT *, (yl * zz - yz * lz) / (ll * zz - lz * lz) AS bl, (yz * ll - yl * lz) / (ll * zz - lz * lz) AS bz FROM c),
  t AS (SELECT n_regionkey, n, bl / sqrt((yy - bl * yl - bz * yz) / (n - 3) * zz / (ll * zz - lz * lz)) AS t FROM b)"""


@query("e2_adf_one_lag", ADF1 + " SELECT n_regionkey, n, round(t, 5) AS t, t < -3.43 AS rejects1, t < -2.86 AS rejects5, t < -2.57 AS rejects10 FROM t")
def e2_one_lag(spark, d):  # noqa: ANN001, ANN201
    return rounded(unitroot.adf(logr(spark, d), ["n_regionkey"], 1, "c", "x"), "t", digits=5)


@query("e3_adf_aic")
def e3(spark, d):  # noqa: ANN001, ANN201
    return unitroot.adf_aic(_spreads(spark, d), ["series"])


def _aic_sql(x: list[str]) -> str:
    return f"n * (ln(2 * pi() * {_ss('y', x)} / n) + 1) + 2 * {len(x) + 1}"


_LAGS = [["l"], ["l", "z"], ["l", "z", "z2"]]
_OWN = ", ".join(f"o{k} AS (SELECT n_regionkey, {k} AS lag, n, {_b('y', x, 0)} / {_se('y', x, 0)} AS t FROM (SELECT n_regionkey, count(*) AS n, {_covariances('y', x)} FROM m WHERE {x[-1]} IS NOT NULL GROUP BY 1))" for k, x in enumerate(_LAGS))


@query(
    "e3_adf_aic_two_lags",
    f"""{LAGGED}, c AS (SELECT n_regionkey, count(*) AS n, {_covariances("y", _LAGS[2])} FROM m WHERE z2 IS NOT NULL GROUP BY 1),
    a AS (SELECT n_regionkey, {", ".join(f"{_aic_sql(x)} AS a{k}" for k, x in enumerate(_LAGS))} FROM c),
    best AS (SELECT n_regionkey, CASE WHEN a0 <= a1 AND a0 <= a2 THEN 0 WHEN a1 <= a2 THEN 1 ELSE 2 END AS lag FROM a),
    {_OWN} SELECT n_regionkey, CAST(lag AS INTEGER) AS lag, n, round(t, 5) AS t FROM best JOIN (SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2) USING (n_regionkey, lag)""",
)
def e3_two(spark, d):  # noqa: ANN001, ANN201
    return rounded(unitroot.adf_aic(logr(spark, d), ["n_regionkey"], "x", max_lag=2).drop("p"), "t", digits=5)


@query(
    "e4_mackinnon_p",
    """WITH g AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS q FROM lineitem), t AS (SELECT q, (q - 45) / 8 AS tau FROM g),
    z AS (SELECT q, tau, CASE WHEN tau <= -1.61 THEN 2.1659 + tau * (1.4412 + tau * 0.038269) ELSE 1.7339 + tau * (0.93202 + tau * (-0.12745 + tau * -0.010368)) END::DOUBLE AS z FROM t),
    s AS (SELECT q, tau, z, 2 / sqrt(pi()) * sum(exp((2 * n + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2)) - z * z / 2 + 2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2))) AS erf FROM z, (SELECT unnest(range(0, 200))::DOUBLE AS n) GROUP BY ALL)
    SELECT q, round(CASE WHEN tau > 2.74 THEN 1 WHEN tau < -18.83 THEN 0 WHEN z >= 0 THEN (1 + erf) / 2 ELSE (1 - erf) / 2 END, 9) AS p FROM s""",
)
def e4(spark, d):  # noqa: ANN001, ANN201
    q = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q")).distinct()
    return q.select("q", F.round(dist.mackinnon_p((F.col("q") - 45) / 8), 9).alias("p"))


@query("e5_vecm_ols")
def e5(spark, d):  # noqa: ANN001, ANN201
    return unitroot.vecm_ols(log5(spark, d).select("d", *L5), L5[:4], 5, [])


@query(
    "e5_vecm_two_series",
    f"""WITH {DIFF}, u AS (SELECT y1, y2, x1, x2 FROM diff5 WHERE y1 IS NOT NULL),
    c AS (SELECT count(*) AS n, covar_pop(y1, y1) AS a11, covar_pop(y1, y2) AS a12, covar_pop(y2, y2) AS a22, covar_pop(x1, x1) AS b11, covar_pop(x1, x2) AS b12, covar_pop(x2, x2) AS b22,
      covar_pop(y1, x1) AS c11, covar_pop(y1, x2) AS c12, covar_pop(y2, x1) AS c21, covar_pop(y2, x2) AS c22 FROM u),
    i AS (SELECT *, b11 * b22 - b12 * b12 AS db FROM c),
    r AS (SELECT n, a11 - (c11 * c11 * b22 - 2 * c11 * c12 * b12 + c12 * c12 * b11) / db AS r11, a12 - (c11 * c21 * b22 - (c11 * c22 + c12 * c21) * b12 + c12 * c22 * b11) / db AS r12,
      a22 - (c21 * c21 * b22 - 2 * c21 * c22 * b12 + c22 * c22 * b11) / db AS r22 FROM i),
    l AS (SELECT n, -n / 2.0::DOUBLE * (2 * (1 + ln(2 * pi())) + ln(r11 * r22 - r12 * r12)) AS ll FROM r)
    SELECT 1 AS k, n, round(ll, 5) AS loglik, round(18 - 2 * ll, 5) AS aic, round(9 * ln(n) - 2 * ll, 5) AS bic, round(18 * ln(ln(n)) - 2 * ll, 5) AS hq FROM l""",
)
def e5_two(spark, d):  # noqa: ANN001, ANN201
    return rounded(unitroot.vecm_ols(log5(spark, d).select("d", *L5), L5[:2], 1, []), "loglik", "aic", "bic", "hq", digits=5)


@query("e6_lag_table")
def e6(spark, d):  # noqa: ANN001, ANN201
    return unitroot.lag_table(unitroot.vecm_ols(log5(spark, d).select("d", *L5), L5[:4], 5, []), [])


@query("e7_seasonal_table")
def e7(spark, d):  # noqa: ANN001, ANN201
    return unitroot.seasonal_table(log5(spark, d).select("d", *L5), L5[:4], 2, [], ["none", "quarter", "fourier1", "fourier2", "fourier3", "month"])


@query("e7_seasonal_lr")
def e7_lr(spark, d):  # noqa: ANN001, ANN201
    """Two waves against no seasonal terms, on the sample of two lags and on that of five."""
    parts = [unitroot.seasonal_lr(unitroot.seasonal_table(log5(spark, d).select("d", *L5), L5[:4], 2, [], ["none", "fourier2"], first=n), [], "fourier2", "none", 4).withColumn("first", F.lit(n)) for n in (2, 5)]
    return parts[0].unionByName(parts[1])


@query("e8_hosking")
def e8(spark, d):  # noqa: ANN001, ANN201
    rows = unitroot.residuals(log5(spark, d).select("d", *L5), L5[:3], 2, [])
    return unitroot.hosking(rows, [f"e_{c}" for c in L5[:3]], 10, 2, [])


@query("e8_ljung_box", f"WITH {REGION}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY n_regionkey) AS e FROM logr), l AS (SELECT n_regionkey, e, lag(e) OVER w AS a, lag(e, 2) OVER w AS b FROM c WINDOW w AS (PARTITION BY n_regionkey ORDER BY d)) SELECT n_regionkey, count(*) AS n, round(count(*) * (count(*) + 2) * (pow(sum(e * a) / sum(e * e), 2) / (count(*) - 1) + pow(sum(e * b) / sum(e * e), 2) / (count(*) - 2)), 5) AS q FROM l GROUP BY 1")
def e8_lb(spark, d):  # noqa: ANN001, ANN201
    return rounded(unitroot.ljung_box(logr(spark, d), ["n_regionkey"], 2, "x"), "q", digits=5)


@query("e9_var_residuals", f"WITH {REGION}, m AS (SELECT n_regionkey, d, x - lag(x) OVER w AS y, lag(x) OVER w AS l FROM logr WINDOW w AS (PARTITION BY n_regionkey ORDER BY d)), r AS (SELECT n_regionkey, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM m GROUP BY 1) SELECT n_regionkey, d, round(y - a - b * l, 6) AS e FROM m JOIN r USING (n_regionkey) WHERE y IS NOT NULL")
def e9(spark, d):  # noqa: ANN001, ANN201
    rows = logr(spark, d).drop("t")
    return unitroot.residuals(rows, ["x"], 1, ["n_regionkey"]).select("n_regionkey", "d", F.round("e_x", 6).alias("e"))


@query("e10_arch_lm", f"WITH {REGION}, m AS (SELECT n_regionkey, d, x - lag(x) OVER (PARTITION BY n_regionkey ORDER BY d) AS y FROM logr), s AS (SELECT n_regionkey, y * y AS s, lag(y * y) OVER (PARTITION BY n_regionkey ORDER BY d) AS l FROM m) SELECT n_regionkey, count(*) AS n, round(count(*) * regr_r2(s, l), 5) AS lm FROM s WHERE l IS NOT NULL GROUP BY 1")
def e10(spark, d):  # noqa: ANN001, ANN201
    rows = panel.diffs(logr(spark, d), ["x"], ["n_regionkey"])
    return rounded(unitroot.arch_lm(rows, ["n_regionkey"], "d_x"), "lm", digits=5)


_SQ = ["q1", "q2", "q3", "q4"]


@query(
    "e10_arch_lm_q",
    f"""WITH {REGION}, m AS (SELECT n_regionkey, t, (x - lag(x) OVER (PARTITION BY n_regionkey ORDER BY d)) AS y FROM logr), q AS (SELECT n_regionkey, y * y AS q0, {", ".join(f"lag(y * y, {k}) OVER (PARTITION BY n_regionkey ORDER BY t) AS q{k}" for k in range(1, 5))} FROM m),
    c AS (SELECT n_regionkey, count(*) AS n, {_covariances("q0", _SQ)} FROM q WHERE q4 IS NOT NULL GROUP BY 1), r AS (SELECT n_regionkey, n * (1 - {_ss("q0", _SQ)} / (n * c_q0_q0)) AS lm FROM c) SELECT n_regionkey, round(lm, 5) AS lm, round(exp(-lm / 2) * (1 + lm / 2), 7) AS p FROM r""",
)
def e10_q(spark, d):  # noqa: ANN001, ANN201
    found = unitroot.arch_lm_q(panel.diffs(logr(spark, d), ["x"], ["n_regionkey"]), ["n_regionkey"], 4, "d_x")
    return rounded(rounded(found, "lm", digits=5), "p", digits=7)


def _system(spark: SparkSession, d: str) -> DataFrame:
    return log5(spark, d).select("d", *L5[:4])


@query("e11_e13_trace_test")
def e13(spark, d):  # noqa: ANN001, ANN201
    rows, names, s = fits.design(_system(spark, d), L5[:4], [])
    return rank.trace_test(moments.gram_rows(rows, names, []), [], s)


@query("e12_restricted_constant")
def e12(spark, d):  # noqa: ANN001, ANN201
    rows, names, s = fits.design(_system(spark, d), L5[:4], [])
    names, s = rank.restricted_const(names, s)
    return rank.trace_test(moments.gram_rows(rows, names, []), [], s, rank.RESTRICTED, rank.RESTRICTED_AT)


# With the constant among x and nothing partialled out, S00 is not centred and the fitted part
# is n times the means' product plus that of the centred regression.
RESTRICTED2 = DIFF + """, u AS (SELECT y1, y2, x1, x2 FROM diff5 WHERE y1 IS NOT NULL),
  c AS (SELECT count(*) AS n, avg(y1) AS m1, avg(y2) AS m2, covar_pop(y1, y1) AS a11, covar_pop(y1, y2) AS a12, covar_pop(y2, y2) AS a22, covar_pop(x1, x1) AS b11, covar_pop(x1, x2) AS b12, covar_pop(x2, x2) AS b22,
    covar_pop(y1, x1) AS c11, covar_pop(y1, x2) AS c12, covar_pop(y2, x1) AS c21, covar_pop(y2, x2) AS c22 FROM u),
  i AS (SELECT *, b11 * b22 - b12 * b12 AS db FROM c),
  f AS (SELECT n, a11 + m1 * m1 AS s11, a12 + m1 * m2 AS s12, a22 + m2 * m2 AS s22, m1 * m1 + (c11 * c11 * b22 - 2 * c11 * c12 * b12 + c12 * c12 * b11) / db AS f11,
    m1 * m2 + (c11 * c21 * b22 - (c11 * c22 + c12 * c21) * b12 + c12 * c22 * b11) / db AS f12, m2 * m2 + (c21 * c21 * b22 - 2 * c21 * c22 * b12 + c22 * c22 * b11) / db AS f22 FROM i),
  e AS (SELECT n, (f11 * s22 - 2 * f12 * s12 + f22 * s11) / (s11 * s22 - s12 * s12) AS tr, (f11 * f22 - f12 * f12) / (s11 * s22 - s12 * s12) AS de FROM f),
  l AS (SELECT n, (tr + sqrt(tr * tr - 4 * de)) / 2 AS l1, (tr - sqrt(tr * tr - 4 * de)) / 2 AS l2 FROM e),
  t AS (SELECT unnest([0, 1]) AS r, unnest([l1, l2]) AS eigenvalue, unnest([-n * (ln(1 - l1) + ln(1 - l2)), -n * ln(1 - l2)]) AS trace, unnest([19.96::DOUBLE, 9.24::DOUBLE]) AS cv95, unnest([24.60::DOUBLE, 12.97::DOUBLE]) AS cv99 FROM l)"""


@query("e12_restricted_two_series", f"WITH {RESTRICTED2} SELECT CAST(r AS INTEGER) AS r, round(eigenvalue, 7) AS eigenvalue, round(trace, 4) AS trace, cv95, cv99, trace > cv95 AS rejects95, trace > cv99 AS rejects99 FROM t")
def e12_two(spark, d):  # noqa: ANN001, ANN201
    rows = panel.lag_design(_system(spark, d), L5[:2], 1, []).withColumn("one", F.lit(1.0))
    names = [*(f"y_{c}" for c in L5[:2]), *(f"x_{c}" for c in L5[:2]), "one"]
    out = rank.trace_test(moments.gram_rows(rows, names, []), [], rank.Shape(2, 3, 0), rank.RESTRICTED, rank.RESTRICTED_AT)
    return out.select("r", F.round("eigenvalue", 7).alias("eigenvalue"), F.round("trace", 4).alias("trace"), "cv95", "cv99", "rejects95", "rejects99")


TWO = DIFF + """, u AS (SELECT y1, y2, x1, x2 FROM diff5 WHERE y1 IS NOT NULL),
  c AS (SELECT count(*) AS n, covar_pop(y1, y1) AS a11, covar_pop(y1, y2) AS a12, covar_pop(y2, y2) AS a22, covar_pop(x1, x1) AS b11, covar_pop(x1, x2) AS b12, covar_pop(x2, x2) AS b22,
    covar_pop(y1, x1) AS c11, covar_pop(y1, x2) AS c12, covar_pop(y2, x1) AS c21, covar_pop(y2, x2) AS c22 FROM u),
  i AS (SELECT *, a11 * a22 - a12 * a12 AS da, b11 * b22 - b12 * b12 AS db FROM c),
  m AS (SELECT n, (c11 * c11 * a22 - 2 * c11 * c21 * a12 + c21 * c21 * a11) / da AS s11, (c11 * c12 * a22 - (c11 * c22 + c21 * c12) * a12 + c21 * c22 * a11) / da AS s12, (c12 * c12 * a22 - 2 * c12 * c22 * a12 + c22 * c22 * a11) / da AS s22, b11, b12, b22, db FROM i),
  e AS (SELECT n, (b22 * s11 - 2 * b12 * s12 + b11 * s22) / db AS tr, (s11 * s22 - s12 * s12) / db AS de FROM m)"""


@query("e13_trace_two_series", f"WITH {TWO}, l AS (SELECT n, (tr + sqrt(tr * tr - 4 * de)) / 2 AS l1, (tr - sqrt(tr * tr - 4 * de)) / 2 AS l2 FROM e), t AS (SELECT unnest([0, 1]) AS r, unnest([l1, l2]) AS eigenvalue, unnest([-n * (ln(1 - l1) + ln(1 - l2)), -n * ln(1 - l2)]) AS trace, unnest([13.4294::DOUBLE, 2.7055::DOUBLE]) AS cv90, unnest([15.4943::DOUBLE, 3.8415::DOUBLE]) AS cv95, unnest([19.9349::DOUBLE, 6.6349::DOUBLE]) AS cv99 FROM l) SELECT CAST(r AS INTEGER) AS r, round(eigenvalue, 7) AS eigenvalue, round(trace, 4) AS trace, trace > cv90 AS rejects90, trace > cv95 AS rejects95, trace > cv99 AS rejects99 FROM t")
def e13_two(spark, d):  # noqa: ANN001, ANN201
    rows = panel.lag_design(_system(spark, d), L5[:2], 1, []).withColumn("one", F.lit(1.0))
    names = [*(f"y_{c}" for c in L5[:2]), *(f"x_{c}" for c in L5[:2]), "one"]
    out = rank.trace_test(moments.gram_rows(rows, names, []), [], rank.Shape(2, 2, 1))
    return out.select("r", F.round("eigenvalue", 7).alias("eigenvalue"), F.round("trace", 4).alias("trace"), "rejects90", "rejects95", "rejects99")


@query("e14_e18_fit_iid")
def e18(spark, d):  # noqa: ANN001, ANN201
    return fits.iid(_system(spark, d), L5[:4], [])


def _part(a: str, b: str, given: list[str]) -> str:
    """SQL of the covariance of a and b with `given` and a constant taken out."""
    return f"(({_det([a, *given], [b, *given])}) / ({_det(given, given)}))"


_V = ["y1", "y2", "x1", "x2", "z1", "z2", "s"]
_PAIR = f"""WITH longq AS (SELECT n_regionkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, substr(o_orderpriority, 1, 1) AS k, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
  wideq AS (SELECT n_regionkey, d, ln(max(value) FILTER (k = '1')) AS a, ln(max(value) FILTER (k = '2')) AS b FROM longq WHERE k IN ('1', '2', '3') GROUP BY 1, 2 HAVING count(*) = 3),
  diffq AS (SELECT n_regionkey, d, a - lag(a) OVER w AS y1, b - lag(b) OVER w AS y2, lag(a) OVER w AS x1, lag(b) OVER w AS x2 FROM wideq WINDOW w AS (PARTITION BY n_regionkey ORDER BY d)),
  desq AS (SELECT *, lag(y1) OVER w AS z1, lag(y2) OVER w AS z2, x2 - x1 AS s FROM diffq WINDOW w AS (PARTITION BY n_regionkey ORDER BY d)),
  covq AS (SELECT n_regionkey, count(*) AS n, {", ".join(f"covar_pop({a}, {b}) AS c_{a}_{b}" for a in _V for b in _V)} FROM desq WHERE z1 IS NOT NULL GROUP BY 1),
  part AS (SELECT n_regionkey, n, {", ".join(f"{_part(a, b, ['z1', 'z2'])} AS p_{a}_{b}" for a in _V[:4] for b in _V[:4])}, {", ".join(f"{_part(a, b, ['s', 'z1', 'z2'])} AS o_{a}_{b}" for a in _V[:2] for b in _V[:2])} FROM covq),
  dets AS (SELECT *, p_y1_y1 * p_y2_y2 - p_y1_y2 * p_y1_y2 AS d00, p_x1_x1 * p_x2_x2 - p_x1_x2 * p_x1_x2 AS d11, p_y1_x1 * p_y2_x2 - p_y1_x2 * p_y2_x1 AS d01, o_y1_y1 * o_y2_y2 - o_y1_y2 * o_y1_y2 AS done FROM part),
  mid AS (SELECT *, (p_y2_y2 * p_y1_x1 * p_y1_x1 - 2 * p_y1_y2 * p_y1_x1 * p_y2_x1 + p_y1_y1 * p_y2_x1 * p_y2_x1) / d00 AS m11, (p_y2_y2 * p_y1_x2 * p_y1_x2 - 2 * p_y1_y2 * p_y1_x2 * p_y2_x2 + p_y1_y1 * p_y2_x2 * p_y2_x2) / d00 AS m22,
    (p_y2_y2 * p_y1_x1 * p_y1_x2 - p_y1_y2 * (p_y1_x1 * p_y2_x2 + p_y1_x2 * p_y2_x1) + p_y1_y1 * p_y2_x1 * p_y2_x2) / d00 AS m12 FROM dets),
  eig AS (SELECT *, (p_x2_x2 * m11 - 2 * p_x1_x2 * m12 + p_x1_x1 * m22) / d11 AS tr, d01 * d01 / (d00 * d11) AS de FROM mid),
  pairq AS (SELECT n_regionkey, n, -n / 2.0::DOUBLE * (2 * (1 + ln(2 * pi())) + ln(d00) + ln(1 - (tr + sqrt(tr * tr - 4 * de)) / 2)) AS free, -n / 2.0::DOUBLE * (2 * (1 + ln(2 * pi())) + ln(done)) AS one FROM eig WHERE n >= 7)"""


@query("e18_fit_iid_pairs", _PAIR + " SELECT n_regionkey, round(free, 4) AS loglik_free, round(one, 4) AS loglik_one, round(2 * (free - one), 4) AS lr FROM pairq")
def e18_pairs(spark, d):  # noqa: ANN001, ANN201
    found = fits.iid(_region_system(spark, d).drop(L5[2]), L5[:2], ["n_regionkey"])
    return rounded(found.where("error IS NULL").select("n_regionkey", "loglik_free", "loglik_one", "lr"), "loglik_free", "loglik_one", "lr", digits=4)


@query("e27_scored_rows", _PAIR + " SELECT n_regionkey, 'one' AS restriction, n, round(one, 4) AS loglik FROM pairq UNION ALL SELECT n_regionkey, 'free', n, round(free, 4) FROM pairq")
def e27_scored(spark, d):  # noqa: ANN001, ANN201
    """Rows under the parameters of their region's own fit; the densities add up to the fit's likelihood."""
    rows, system = _region_system(spark, d).drop(L5[2]), ["n_regionkey"]
    found = tables.written(fits.iid(rows, L5[:2], system), "fits")
    parts = [scoring.loglik(scoring.score(rows, L5[:2], system, found, "iid", kind)).select(*system, F.lit(kind).alias("restriction"), "n", F.round("loglik", 4).alias("loglik")) for kind in ("one", "free")]
    return parts[0].unionByName(parts[1])


@query("e17_restrictions", _PAIR + """ SELECT n_regionkey, 'unit' AS name, round(one, 4) AS loglik, round(2 * (free - one), 4) AS lr, 1 AS df FROM pairq UNION ALL SELECT n_regionkey, 'none', round(free, 4), CAST(0 AS DOUBLE), 0 FROM pairq""")
def e17_restrictions(spark, d):  # noqa: ANN001, ANN201
    """Given restrictions of each region's relation, from one table: none, and the spread itself."""
    system = ["n_regionkey"]
    rows, names, s = fits.design(_region_system(spark, d).drop(L5[2]), L5[:2], system)
    given = [("none", None, None, None, None), ("unit", [[], []], [-1.0, 1.0], None, None)]
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(None).cast("array<array<double>>").alias("h_matrix") if m is None else F.array(*(F.array().cast("array<double>") for _ in m)).alias("h_matrix"), F.lit(None).cast("array<double>").alias("h") if h is None else F.array(*map(F.lit, h)).alias("h"), F.lit(None).cast("array<array<double>>").alias("g_matrix"), F.lit(None).cast("array<double>").alias("g")) for n, m, h, _, _ in given))
    table_of = rows.select(*system).distinct().select(*system, F.explode(listed).alias("r")).select(*system, "r.*")
    found = rank.restricted_fits(moments.gram_rows(rows, names, system), system, s, 1, table_of)
    return found.where("error IS NULL").select(*system, "name", F.round("loglik", 4).alias("loglik"), (F.round(F.abs("lr"), 4) + 0.0).alias("lr"), "df")


@query("f4_bootstrap_models")
def f4_models(spark, d):  # noqa: ANN001, ANN201
    """P-values of b = 1 in each region under models with and without a driver, 99 draws each."""
    return draws.pvalues(_region_system(spark, d), L5[:3], ["n_regionkey"], ["iid", "regime", "scale", "log-precision", "quadratic-factor"], [25, 50], 99, 19510104, chunk=99)


@query("f6_standard_errors")
def f6_se(spark, d):  # noqa: ANN001, ANN201
    """Deviations of b over 199 draws from each region's free fit."""
    return draws.standard_errors(_region_system(spark, d), L5[:3], ["n_regionkey"], ["iid", "regime", "scale"], [25, 50], 199, 19510104, chunk=100)


@query("e28_scored_models")
def e28_models(spark, d):  # noqa: ANN001, ANN201
    """Every model's fits of each region, and the same likelihoods from rows scored under them."""
    system = ["n_regionkey"]
    base = _region_system(spark, d)
    rows = tables.written(panel.volatility_driver(base, L5[:3], system), "rows")
    made = {
        "iid": fits.iid(rows, L5[:3], system), "regime": fits.regime(rows, L5[:3], system, [25, 50]), "scale": fits.scale(rows, L5[:3], system, "v"), "ar1": fits.ar1(rows, L5[:3], system),
        **{m: driven.fit(rows, L5[:3], system, "v", m) for m in ("log-precision",)},
    }
    out = None
    for model, fitted in made.items():
        found = tables.written(fitted.select(*system, "loglik_free", "params_free", "params_one"), "fits")
        scored = scoring.score(rows, L5[:3], system, found, model, breaks=[25, 50])
        both = tables.joined(scoring.loglik(scored), scoring.standard_errors(scored).select(*system, "se"), system)
        one = tables.joined(both, found.select(*system, F.col("loglik_free").alias("fitted")), system).select(*system, F.lit(model).alias("spec"), "n", "loglik", "fitted", "se")
        out = one if out is None else out.unionByName(one)
    return out


@query("e19_fit_regime")
def e19(spark, d):  # noqa: ANN001, ANN201
    return fits.regime(_system(spark, d), L5[:4], [], [120, 240])


@query("e22_fit_scale")
def e22(spark, d):  # noqa: ANN001, ANN201
    rows = panel.volatility_driver(_system(spark, d), L5[:4], [])
    return fits.scale(rows, L5[:4], [], "v")


def _region_system(spark: SparkSession, d: str) -> DataFrame:
    """Monthly logs of three priorities' mean order price, for each region."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    o = table(spark, d, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("d"), F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)).alias("series"), "o_totalprice")
    long = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "d", "series").agg(_mean("o_totalprice").alias("value"))
    wide = long.groupBy("n_regionkey", "d").pivot("series", S5[:3]).agg(F.first("value")).na.drop(subset=S5[:3])
    return panel.logs(wide, S5[:3]).drop(*S5[:3])


@query("e17_many_systems")
def e17(spark, d):  # noqa: ANN001, ANN201
    """One fit a region."""
    return fits.iid(_region_system(spark, d), L5[:3], ["n_regionkey"])


@query("e29_lr_test", "WITH f AS (SELECT event_type AS spec, CAST(user_id % 50 AS BIGINT) AS j, max(value) FILTER (event_id % 2 = 0) AS free, max(value) FILTER (event_id % 2 = 1) AS one FROM events GROUP BY 1, 2) SELECT spec, j, free, one, 2 * (free - one) AS lr, round(exp(-greatest(free - one, 0)), 9) AS p FROM f")
def e29(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select(F.col("event_type").alias("spec"), (F.col("user_id") % 50).alias("j"), F.when(F.col("event_id") % 2 == 0, "free").otherwise("one").alias("restriction"), F.col("value").alias("loglik"))
    return rounded(replication.lr_test(e, ["spec", "j"], 2), "p", digits=9)


@query("e31_companion_roots")
def e31(spark, d):  # noqa: ANN001, ANN201
    rows, names, s = fits.design(_system(spark, d), L5[:4], [])
    return rank.companion_roots(moments.gram_rows(rows, names, []), [], s, 3)


@query("e33_best_start", "SELECT event_type, CAST(user_id % 40 AS BIGINT) AS j, max(value) AS best, arg_max(event_id, value) AS winner, round(max(value) - min(value), 9) AS spread FROM events GROUP BY 1, 2")
def e33(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 40).alias("j"), F.col("event_id").alias("start"), F.col("value").alias("loglik"))
    return rounded(replication.best_start(e, ["event_type", "j"]), "spread", digits=9)


@query("e33_restricted_check", "SELECT event_type AS spec, CAST(user_id % 50 AS BIGINT) AS j, max(value) FILTER (event_id % 2 = 0) AS free, max(value) FILTER (event_id % 2 = 1) AS one, max(value) FILTER (event_id % 2 = 1) <= max(value) FILTER (event_id % 2 = 0) + 1e-6 AS valid FROM events GROUP BY 1, 2")
def e33_check(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select(F.col("event_type").alias("spec"), (F.col("user_id") % 50).alias("j"), F.when(F.col("event_id") % 2 == 0, "free").otherwise("one").alias("restriction"), F.col("value").alias("loglik"))
    return replication.restricted_check(e, ["spec", "j"])


@query("e35_break_grid")
def e35(spark, d):  # noqa: ANN001, ANN201
    return fits.grid_summary(fits.break_grid(_system(spark, d), L5[:4], [], (120, 240), 6), [], 3)


@query("e37_seasonal_grid")
def e37(spark, d):  # noqa: ANN001, ANN201
    return compare.seasonal_grid(_system(spark, d), L5[:4], [], [120, 240], ["none", "quarter", "fourier2", "fourier3", "month"], ["regime", "scale"])


@query("e37_seasonal_summary")
def e37_summary(spark, d):  # noqa: ANN001, ANN201
    return compare.seasonal_summary(e37(spark, d), [])


BREAK = f"""WITH {REGION}, m AS (SELECT n_regionkey, t, x - avg(x) OVER (PARTITION BY n_regionkey) AS e, count(*) OVER (PARTITION BY n_regionkey) AS n FROM logr),
  c AS (SELECT n_regionkey, t, n, sum(e * e) OVER (PARTITION BY n_regionkey ORDER BY t) AS q, sum(e * e) OVER (PARTITION BY n_regionkey) AS tot FROM m),
  l AS (SELECT n_regionkey, CAST(t AS INTEGER) AS k, -0.5 * (t * ln(q / t) + (n - t) * ln((tot - q) / (n - t))) AS ll FROM c WHERE t >= 12 AND t <= n - 12 AND t % 6 = 0)"""


@query("e36_best_single_break", BREAK + " SELECT n_regionkey, arg_max(k, ll) AS k, round(max(ll), 6) AS ll FROM l GROUP BY 1")
def e36(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("n_regionkey")
    m = logr(spark, d).withColumns({"e": F.col("x") - F.avg("x").over(w)})
    whole = m.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("tot"))
    cuts = whole.where("n >= 24").select("n_regionkey", F.explode(F.sequence(F.lit(12), F.col("n").cast("int") - 12, F.lit(6))).alias("k"))
    sums = moments.prefix_gram(m, "e", "e", ["n_regionkey"], cuts, block=24).join(whole, "n_regionkey")
    q, k, n = F.col("value"), F.col("k"), F.col("n")
    ll = -0.5 * (k * F.ln(q / k) + (n - k) * F.ln((F.col("tot") - q) / (n - k)))
    return sums.withColumn("ll", ll).groupBy("n_regionkey").agg(F.max_by("k", "ll").alias("k"), F.round(F.max("ll"), 6).alias("ll"))


@query("e36_best_break")
def e36_best(spark, d):  # noqa: ANN001, ANN201
    """The break of each region's whole system that its likelihood likes best."""
    return fits.best_break(fits.break_profile(_region_system(spark, d), L5[:3], ["n_regionkey"]), ["n_regionkey"])


@query("d3_prefix_grams", f"""WITH {REGION}, p AS (SELECT n_regionkey, CAST(floor((t - 1) / 10) AS INTEGER) AS piece, x - 12 AS x FROM logr), g AS (SELECT n_regionkey, piece, count(*) AS n, sum(x * x) AS a, sum(x) AS b FROM p GROUP BY 1, 2)
  SELECT n_regionkey, piece, n, CAST(sum(n) OVER w AS BIGINT) AS n_before, round(sum(a) OVER w, 6) AS xx, round(sum(b) OVER w, 6) AS x1, round(sum(a) OVER (PARTITION BY n_regionkey), 6) AS total FROM g WINDOW w AS (PARTITION BY n_regionkey ORDER BY piece)""")
def d3_prefix(spark, d):  # noqa: ANN001, ANN201
    rows = logr(spark, d).select("n_regionkey", F.floor((F.col("t") - 1) / 10).cast("int").alias("piece"), (F.col("x") - 12).alias("x"), F.lit(1.0).alias("one"))
    sums = moments.prefix_gram_rows(moments.gram_rows(rows, ["x", "one"], ["n_regionkey", "piece"]), ["n_regionkey"], block=3)
    at = lambda c, k: F.round(F.col(c)[k], 6)
    return sums.select("n_regionkey", "piece", "n", "n_before", at("before", 0).alias("xx"), at("before", 1).alias("x1"), at("total", 0).alias("total"))


@query("e39_spec_compare", "WITH f AS (SELECT event_type AS spec, max(value) FILTER (event_id % 2 = 0) AS free, avg(value) FILTER (event_id % 2 = 0) AS one, max(value) FILTER (event_id % 2 = 1) AS rfree, avg(value) FILTER (event_id % 2 = 1) AS rone FROM events GROUP BY 1) SELECT spec, round(free - rfree, 6) AS diff_free, round(one - rone, 6) AS diff_one FROM f")
def e39(spark, d):  # noqa: ANN001, ANN201
    """Fits joined to recorded ones: each half of the events as a table of log-likelihoods."""
    half = lambda k: table(spark, d, "events").where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("spec")).agg(F.max("value").alias("loglik_free"), F.avg("value").alias("loglik_one"))
    return rounded(compare.with_recorded(half(0), half(1), ["spec"]).select("spec", "diff_free", "diff_one"), "diff_free", "diff_one")


#: Published log-likelihoods of the monthly oil panel, by specification.
RECORDED = [("iid", 6054.5765, 6050.8966), ("regime", 6402.0529, 6396.2563), ("quadratic", 6209.4137, 6204.4114), ("quadratic-factor", 6209.4137, 6204.4114), ("scale-log", 6211.1146, 6209.3834), ("log-precision-log", 6268.3376, 6267.0312), ("scale", 6406.4339, 6405.2891), ("log-precision", 6430.6578, 6429.7169)]


@query("e39_spec_fits")
def e39_fits(spark, d):  # noqa: ANN001, ANN201
    """Every specification's fits; the recorded values are of another panel, so the differences only show the join."""
    recorded = spark.createDataFrame(RECORDED, "spec string, loglik_free double, loglik_one double")
    return compare.with_recorded(compare.spec_fits(_system(spark, d), L5[:4], [], [120, 240]), recorded, ["spec"])


# Resampling


@query("f1_wild_weights", f"WITH {LOGS}, j AS (SELECT unnest(range(1, 21)) AS j) SELECT CAST(j AS INTEGER) AS j, CAST(t AS INTEGER) AS t, CAST(CASE WHEN substr(md5('7|' || j || '|' || t), 1, 1) < '8' THEN 1 ELSE -1 END AS INTEGER) AS s FROM log5, j")
def f1(spark, d):  # noqa: ANN001, ANN201
    return resample.wild_weights(log5(spark, d).select(F.col("t").cast("int").alias("t")), 20, 7).select("j", "t", "s")


@query("f1_normal_weights", f"WITH {LOGS}, j AS (SELECT unnest(range(1, 21)) AS j), h AS (SELECT j, t, md5('7|' || j || '|' || t) AS h FROM log5, j), u AS (SELECT j, t, (CAST('0x' || substr(h, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS a, (CAST('0x' || substr(h, 13, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS b FROM h) SELECT CAST(j AS INTEGER) AS j, CAST(t AS INTEGER) AS t, round(sqrt(-2 * ln(a)) * cos(2 * pi() * b), 9) AS s FROM u")
def f1_normal(spark, d):  # noqa: ANN001, ANN201
    return rounded(resample.wild_weights(log5(spark, d).select(F.col("t").cast("int").alias("t")), 20, 7, scheme="normal").select("j", "t", "s"), "s", digits=9)


@query(
    "f3_recursive_ar1",
    f"""WITH RECURSIVE {REGION}, m AS (SELECT n_regionkey, t, x, lag(x) OVER (PARTITION BY n_regionkey ORDER BY t) AS l FROM logr),
    r AS (SELECT n_regionkey, regr_slope(x, l) AS b, regr_intercept(x, l) AS a FROM m WHERE l IS NOT NULL GROUP BY 1),
    e AS (SELECT n_regionkey, t, a, b, x - a - b * l AS e FROM m JOIN r USING (n_regionkey) WHERE l IS NOT NULL),
    j AS (SELECT unnest(range(1, 31)) AS j),
    p AS (SELECT n_regionkey, j, 1::BIGINT AS t, x, NULL::DOUBLE AS l FROM m, j WHERE m.t = 1
      UNION ALL SELECT p.n_regionkey, p.j, e.t, a + b * p.x + e * CASE WHEN substr(md5('5|' || p.j || '|' || e.t), 1, 1) < '8' THEN 1 ELSE -1 END, p.x FROM p JOIN e ON e.n_regionkey = p.n_regionkey AND e.t = p.t + 1)
    SELECT n_regionkey, CAST(j AS INTEGER) AS j, CAST(count(l) AS BIGINT) AS n, round(regr_slope(x, l), 6) AS slope, round(arg_max(x, t), 6) AS last FROM p GROUP BY 1, 2""",
)
def f3_ar1(spark, d):  # noqa: ANN001, ANN201
    return rounded(resample.recursive_ar1(logr(spark, d), ["n_regionkey"], "x", 30, 5), "slope", "last")


@query("f2_wild_fixed", f"WITH {REGION}, m AS (SELECT n_regionkey, t, x - avg(x) OVER (PARTITION BY n_regionkey) AS e FROM logr), l AS (SELECT n_regionkey, t, e, lag(e) OVER (PARTITION BY n_regionkey ORDER BY t) AS x1 FROM m), j AS (SELECT unnest(range(1, 31)) AS j), s AS (SELECT n_regionkey, j, x1, e * CASE WHEN substr(md5('3|' || j || '|' || t), 1, 1) < '8' THEN 1 ELSE -1 END AS se FROM l, j WHERE x1 IS NOT NULL) SELECT n_regionkey, CAST(j AS INTEGER) AS j, round(sum(se * x1) / sum(x1 * x1), 7) AS slope FROM s GROUP BY 1, 2")
def f2(spark, d):  # noqa: ANN001, ANN201
    w = Window.partitionBy("n_regionkey")
    m = logr(spark, d).withColumn("e", F.col("x") - F.avg("x").over(w)).withColumn("x1", F.lag("e").over(w.orderBy("t"))).where("x1 is not null")
    return rounded(resample.wild_fixed(m, ["n_regionkey"], "e", "x1", 30, 3), "slope", digits=7)


DRAWS = "draws AS (SELECT event_type AS spec, event_id AS j, value AS lr, CAST(40 AS DOUBLE) AS observed FROM events)"


@query("f5_bootstrap_pvalue", f"WITH {DRAWS}, a AS (SELECT spec, count(lr) AS n, count(*) FILTER (lr >= observed) AS h, quantile_cont(lr, 0.95) AS q95, count(*) FILTER (lr < 0) AS neg FROM draws GROUP BY 1), p AS (SELECT *, CAST(1 + h AS DOUBLE) / (n + 1) AS p FROM a) SELECT spec, n, round(p, 9) AS p, round(sqrt(p * (1 - p) / n), 9) AS se_p, round(q95, 6) AS q95, neg AS n_negative FROM p")
def f5(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select(F.col("event_type").alias("spec"), F.col("value").alias("lr"), F.lit(40.0).alias("observed"))
    out = replication.bootstrap_pvalue(e, ["spec"], "observed")
    return rounded(rounded(out, "p", "se_p", digits=9), "q95")


@query("f6_bootstrap_se", "WITH u AS (SELECT event_type AS spec, unnest([0, 1]) AS component, unnest([value, value * 2]) AS v FROM events) SELECT spec, component, round(stddev_samp(v), 6) AS se FROM u GROUP BY 1, 2")
def f6(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").select(F.col("event_type").alias("spec"), F.array("value", F.col("value") * 2).alias("b"))
    return rounded(replication.bootstrap_se(e, ["spec"]), "se")


@query("f3_f7_bootstrap_rank")
def f7(spark, d):  # noqa: ANN001, ANN201
    return boot.rank_pvalues(_system(spark, d), L5[:4], [], 999, 11)


@query("f4_bootstrap_lr")
def f4(spark, d):  # noqa: ANN001, ANN201
    """LR of equal loadings in each region, iid and by regime, with wild-bootstrap p-values."""
    rows = _region_system(spark, d)
    return boot.lr_pvalues(rows, L5[:3], ["n_regionkey"], [26, 52], 999, 17)


# Replication tables

E0 = "rep AS (SELECT event_type AS spec, event_id AS j, value - 50 AS e FROM events)"


def _rep(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("spec"), F.col("event_id").alias("j"), (F.col("value") - 50).alias("e"), (F.col("event_id") % 7 == 0).cast("int").alias("failed"), "user_id", "value")


@query("g1_error_metrics", f"WITH {E0} SELECT spec, round(sqrt(avg(e * e)), 6) AS rmse, round(median(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, CAST(sum(CASE WHEN j % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM rep GROUP BY 1")
def g1(spark, d):  # noqa: ANN001, ANN201
    return rounded(replication.error_metrics(_rep(spark, d), ["spec"], failed="failed"), "rmse", "mae", "bias")


@query("g2_trimmed_rmse", f"WITH {E0}, r AS (SELECT spec, e, row_number() OVER (PARTITION BY spec ORDER BY abs(e) DESC, j DESC) AS k FROM rep) SELECT spec, round(sqrt(avg(e * e)), 6) AS rmse FROM r WHERE k > 5 GROUP BY 1")
def g2(spark, d):  # noqa: ANN001, ANN201
    return rounded(replication.trimmed_rmse(_rep(spark, d), ["spec"], 5), "rmse")


@query("g3_ss_concentration", f"WITH {E0}, r AS (SELECT spec, e, row_number() OVER (PARTITION BY spec ORDER BY abs(e) DESC, j DESC) AS k FROM rep) SELECT spec, round(sum(e * e) FILTER (k <= 5) / sum(e * e), 9) AS share FROM r GROUP BY 1")
def g3(spark, d):  # noqa: ANN001, ANN201
    return rounded(replication.ss_concentration(_rep(spark, d), ["spec"], 5), "share", digits=9)


@query(
    "g3_low_decile",
    f"""WITH {E0}, s AS (SELECT *, (j * 37) % 1009 AS smin FROM rep), r AS (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY smin, j) AS k, count(*) OVER (PARTITION BY spec) AS n FROM s)
    SELECT spec, round(sum(e * e) FILTER (k <= greatest(n // 10, 1)) / sum(e * e), 9) AS share_low FROM r GROUP BY 1""",
)
def g3_low(spark, d):  # noqa: ANN001, ANN201
    return rounded(replication.low_share(_rep(spark, d).withColumn("smin", F.col("j") * 37 % 1009), ["spec"], "smin"), "share_low", digits=9)


@query("g3_worst_median", f"WITH {E0}, r AS (SELECT spec, (j * 37) % 1009 AS smin, row_number() OVER (PARTITION BY spec ORDER BY abs(e) DESC, j DESC) AS k FROM rep) SELECT spec, CAST(median(smin) AS DOUBLE) AS median_worst FROM r WHERE k <= 3 GROUP BY 1")
def g3_worst(spark, d):  # noqa: ANN001, ANN201
    return replication.worst_median(_rep(spark, d).withColumn("smin", F.col("j") * 37 % 1009), ["spec"], 3, "smin")


@query("g4_spearman", "WITH r AS (SELECT event_type AS spec, rank() OVER (PARTITION BY event_type ORDER BY value) AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) AS b FROM events) SELECT spec, round(corr(a, b), 7) AS rho FROM r GROUP BY 1")
def g4(spark, d):  # noqa: ANN001, ANN201
    return rounded(replication.spearman(_rep(spark, d), "value", "user_id", ["spec"]), "rho", digits=7)


@query("g5_start_diagnostics", "SELECT event_type AS spec, round(avg(CASE WHEN user_id % 3 <> 0 AND value > 1e-6 THEN 1.0 ELSE 0.0 END), 9) AS other_won, round(median(value), 6) AS median_spread, max(value) AS max_spread FROM events GROUP BY 1")
def g5(spark, d):  # noqa: ANN001, ANN201
    rows = _rep(spark, d).withColumn("won", F.col("user_id") % 3)
    return rounded(rounded(replication.start_diagnostics(rows, ["spec"], "won", "value"), "other_won", digits=9), "median_spread")


@query("g6_efficiency_gain", "WITH m AS (SELECT event_type AS spec, CAST(user_id % 3 AS INT) AS k, avg(value) AS v FROM events GROUP BY 1, 2), w AS (SELECT spec, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, max(v) FILTER (k = 2) AS c FROM m GROUP BY 1) SELECT spec, round(1 - b / a, 7) AS gain, round(1 - c / a, 7) AS possible, round((1 - b / a) / (1 - c / a), 4) AS recovered FROM w")
def g6(spark, d):  # noqa: ANN001, ANN201
    k = F.col("user_id") % 3
    m = _rep(spark, d).withColumn("estimator", F.when(k == 0, "iid").when(k == 1, "correct").otherwise("infeasible")).groupBy("spec", "estimator").agg(F.avg("value").alias("v"))
    return rounded(rounded(replication.efficiency_gain(m, ["spec"], "v"), "gain", "possible", digits=7), "recovered", digits=4)


STARTS = "st AS (SELECT event_type AS spec, CAST(user_id % 60 AS BIGINT) AS j, value AS ll, event_id % 5 <> 0 AS conv, event_id % 20 AS iters FROM events), best AS (SELECT spec, j, max(ll) FILTER (conv) AS best FROM st GROUP BY 1, 2), gap AS (SELECT spec, j, best - ll AS gap FROM st JOIN best USING (spec, j))"


def _starts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("spec"), (F.col("user_id") % 60).alias("j"), F.col("value").alias("ll"), (i % 5 != 0).alias("conv"), (i % 20).alias("iters"), (i % 9 == 0).alias("closed"))


@query("g7_multistart", f"WITH {STARTS}, s AS (SELECT spec, j, avg(CASE WHEN gap <= 1e-6 THEN 1.0 ELSE 0.0 END) AS share, max(gap) AS worst, count(*) FILTER (gap > 1e-3) AS far FROM gap GROUP BY 1, 2), r AS (SELECT spec, median(iters) AS median_iters, quantile_cont(iters, 0.95) AS iters95, max(iters) AS max_iters, CAST(count(*) FILTER (NOT conv) AS BIGINT) AS n_dropped FROM st GROUP BY 1) SELECT s.spec, count(*) AS n_sets, round(avg(share), 7) AS share_best, round(min(share), 7) AS least_share, round(avg(CASE WHEN share = 1 THEN 1.0 ELSE 0.0 END), 7) AS all_agree, round(median(worst), 6) AS median_worst, round(max(worst), 6) AS max_worst, CAST(sum(far) AS BIGINT) AS n_far, CAST(any_value(median_iters) AS DOUBLE) AS median_iters, any_value(max_iters) AS max_iters, CAST(any_value(iters95) AS DOUBLE) AS iters95, any_value(n_dropped) AS n_dropped FROM s JOIN r USING (spec) GROUP BY 1")
def g7(spark, d):  # noqa: ANN001, ANN201
    out = replication.multistart_summary(_starts(spark, d), ["spec"], "j", "ll", "conv", "iters")
    return rounded(rounded(out, "share_best", "least_share", "all_agree", digits=7), "median_worst", "max_worst")


@query("g8_start_table", "WITH st AS (SELECT event_type AS spec, CAST(user_id % 60 AS BIGINT) AS j, value AS ll, event_id % 20 AS iters, event_id % 9 = 0 AS closed FROM events), g AS (SELECT spec, j, iters, closed, max(ll) OVER (PARTITION BY spec, j) - ll AS gap FROM st), s AS (SELECT spec, j, avg(gap) AS m, max(gap) AS t, median(gap) AS h, count(*) FILTER (iters >= 19) AS lim, max(gap) FILTER (closed) AS cg FROM g GROUP BY 1, 2) SELECT spec, CAST(sum(lim) AS BIGINT) AS n_limit, round(max(cg), 6) AS closed_gap, round(avg(m), 6) AS mean_gap, round(max(t), 6) AS max_gap, round(median(h), 6) AS median_of_medians FROM s GROUP BY 1")
def g8(spark, d):  # noqa: ANN001, ANN201
    return rounded(replication.start_table_summary(_starts(spark, d), ["spec"], "j", "ll", "iters", 19, "closed"), "mean_gap", "max_gap", "closed_gap", "median_of_medians")


@query("g9_size_summary", "WITH s AS (SELECT event_type AS spec, value / 10 AS lr, CASE WHEN event_id % 17 = 0 THEN 1 WHEN event_id % 19 = 0 THEN 2 ELSE 0 END AS status, event_id % 3 AS won, value / 100 AS spread FROM events), o AS (SELECT *, status = 0 AS ok FROM s) SELECT spec, count(*) FILTER (ok) AS usable, count(*) FILTER (status = 1) AS runaway, count(*) FILTER (status = 2) AS errors, round(avg((lr >= 6.2514)::INT) FILTER (ok), 9) AS rej10, round(avg((lr >= 7.8147)::INT) FILTER (ok), 9) AS rej5, round(avg((lr >= 11.3449)::INT) FILTER (ok), 9) AS rej1, round(quantile_cont(lr, 0.5) FILTER (ok), 6) AS q50, round(quantile_cont(lr, 0.9) FILTER (ok), 6) AS q90, round(quantile_cont(lr, 0.95) FILTER (ok), 6) AS q95, round(quantile_cont(lr, 0.99) FILTER (ok), 6) AS q99, round(avg((won = 2)::INT) FILTER (ok), 9) AS won_closed, round(median(spread) FILTER (ok), 6) AS median_spread, round(max(spread) FILTER (ok), 6) AS max_spread FROM o GROUP BY 1")
def g9(spark, d):  # noqa: ANN001, ANN201
    i = F.col("j")
    rows = _rep(spark, d).select("spec", (F.col("value") / 10).alias("lr"), F.when(i % 17 == 0, 1).when(i % 19 == 0, 2).otherwise(0).alias("status"), (i % 3).alias("won"), (F.col("value") / 100).alias("spread"))
    out = replication.size_summary(rows, ["spec"], won="won", spread="spread")
    return rounded(rounded(out, "rej10", "rej5", "rej1", "won_closed", digits=9), "q50", "q90", "q95", "q99", "median_spread", "max_spread")


@query("g10_p_discrepancy", "WITH s AS (SELECT event_type AS spec, (event_id % 997) / 997.0::DOUBLE AS p FROM events), n AS (SELECT spec, count(*) AS m FROM s GROUP BY 1), g AS (SELECT unnest(range(1, 201)) AS k), c AS (SELECT spec, k, any_value(m) AS m, count(*) FILTER (p <= k * 0.2 / 200 + 1e-12) AS c FROM s JOIN n USING (spec), g GROUP BY 1, 2) SELECT spec, CAST(k AS INTEGER) AS k, round(c / m::DOUBLE - k * 0.2 / 200, 9) AS gap, round(2 * sqrt(k * 0.2 / 200 * (1 - k * 0.2 / 200) / m), 9) AS band FROM c")
def g10(spark, d):  # noqa: ANN001, ANN201
    rows = _rep(spark, d).select("spec", (F.col("j") % 997 / 997.0).alias("p"))
    return rounded(replication.p_discrepancy(rows, ["spec"], "p"), "gap", "band", digits=9)


@query(
    "g10_first_crossing",
    """WITH s AS (SELECT event_type AS spec, pow((event_id % 997) / 997.0::DOUBLE, 1.1) AS p FROM events), n AS (SELECT spec, count(*) AS m FROM s GROUP BY 1), g AS (SELECT unnest(range(1, 201)) AS k), c AS (SELECT spec, k, any_value(m) AS m, count(*) FILTER (p <= k * 0.2 / 200 + 1e-12) AS c FROM s JOIN n USING (spec), g GROUP BY 1, 2),
    d AS (SELECT spec, k, c / m::DOUBLE - k * 0.2 / 200 AS gap, 2 * sqrt(k * 0.2 / 200 * (1 - k * 0.2 / 200) / m) AS band FROM c)
    SELECT spec, round(min(k) FILTER (gap > band) * 0.2 / 200, 6) AS clears_at, round(arg_max(gap, abs(gap)), 9) AS largest_gap, round(max(gap) FILTER (k = 10), 9) AS gap1, round(max(gap) FILTER (k = 50), 9) AS gap5, round(max(gap) FILTER (k = 100), 9) AS gap10, round(max(gap) FILTER (k = 200), 9) AS gap20 FROM d GROUP BY 1""",
)
def g10_first(spark, d):  # noqa: ANN001, ANN201
    rows = _rep(spark, d).select("spec", F.pow(F.col("j") % 997 / 997.0, F.lit(1.1)).alias("p"))
    out = replication.first_crossing(replication.p_discrepancy(rows, ["spec"], "p"), ["spec"])
    return rounded(rounded(out, "largest_gap", "gap1", "gap5", "gap10", "gap20", digits=9), "clears_at")


@query("g11_diff_vs_recorded", "WITH f AS (SELECT event_type AS spec, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT event_type AS spec, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT round(max(abs(f.v - r.v)), 6) AS worst, count(*) AS n FROM f JOIN r USING (spec)")
def g11(spark, d):  # noqa: ANN001, ANN201
    """Means of one half of the events against those recorded from the other half."""
    half = lambda k: _rep(spark, d).where(F.col("j") % 2 == k).groupBy("spec").agg(F.avg("value").alias("v"))
    return rounded(replication.worst_diff(replication.diff_vs_recorded(half(0), half(1), ["spec"], "v")), "worst")


@query(
    "g12_paired_lr",
    """WITH s AS (SELECT event_type AS spec, value AS a, user_id * 0.01::DOUBLE AS b, value * 0.9::DOUBLE AS c FROM events), l AS (SELECT *, 2 * (greatest(a, b) - c) AS lr FROM s)
    SELECT spec, count(*) AS n, round(avg(lr), 6) AS mean_lr, round(max(lr), 6) AS max_lr, count(*) FILTER (lr >= 11.3449) AS n_far, count(*) FILTER (lr >= 7.8147) AS n_tail, count(*) FILTER (lr < 0) AS n_negative, count(*) FILTER (a >= b) AS won_free1, count(*) FILTER (a < b) AS won_free2,
    count(*) AS won_one1, round(max(greatest(a, b) - least(a, b)), 6) AS spread_free, CAST(0 AS DOUBLE) AS spread_one, round(quantile_cont(lr, 0.5), 6) AS q50, round(quantile_cont(lr, 0.9), 6) AS q90, round(quantile_cont(lr, 0.95), 6) AS q95 FROM l GROUP BY 1""",
)
def g12(spark, d):  # noqa: ANN001, ANN201
    rows = _rep(spark, d).select("spec", "value", (F.col("user_id") * 0.01).alias("second"), (F.col("value") * 0.9).alias("one"))
    return rounded(replication.paired_lr(rows, ["spec"], ["value", "second"], ["one"]), "mean_lr", "max_lr", "spread_free", "q50", "q90", "q95")


@query("g13_bootstrap_starts", "SELECT event_type AS spec, count(*) FILTER (user_id * 0.01 > value + 1e-6) AS second_better, CAST(0 AS BIGINT) AS n_dropped FROM events GROUP BY 1")
def g13(spark, d):  # noqa: ANN001, ANN201
    rows = _rep(spark, d).select("spec", "value", (F.col("user_id") * 0.01).alias("second"))
    return replication.bootstrap_starts(rows, ["spec"], "value", "second")


@query(
    "h1_chi2_tail",
    """WITH g AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x FROM lineitem),
    s AS (SELECT x, 2 / sqrt(pi()) * sum(exp((2 * n + 1) * ln(x / 2) / 2 - x / 2 + 2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2))) AS erf FROM g, (SELECT unnest(range(0, 200))::DOUBLE AS n) GROUP BY ALL)
    SELECT x, round(exp(-x / 2) * (1 + x / 2), 9) AS df4, round(1 - erf + exp(-x / 2) * sqrt(2 * x / pi()), 9) AS df3 FROM s""",
)
def h1(spark, d):  # noqa: ANN001, ANN201
    x = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x")).distinct()
    return x.select("x", F.round(dist.chi2_sf(F.col("x"), 4), 9).alias("df4"), F.round(dist.chi2_sf(F.col("x"), 3), 9).alias("df3"))


# Covariances that move with a driver

W2 = [[900.0, -50.0], [-50.0, 700.0]]


def _resid(spark: SparkSession, d: str) -> DataFrame:
    """Two residual columns e1, e2 (changes less nothing) and a driver v."""
    rows = panel.volatility_driver(panel.diffs(log5(spark, d), ["l_s1", "l_s2"], []), ["l_s1", "l_s2"], [])
    return rows.select("d", F.col("d_l_s1").alias("e1"), F.col("d_l_s2").alias("e2"), "v").where("v is not null")


RES = DRIVER + ", res AS (SELECT d, y1 AS e1, y2 AS e2, v FROM drv JOIN diff5 USING (d) WHERE v IS NOT NULL AND y1 IS NOT NULL)"


@query("e21_ar1", f"WITH {RES}, l AS (SELECT e1, e2, lag(e1) OVER (ORDER BY d) AS a, lag(e2) OVER (ORDER BY d) AS b FROM res), r AS (SELECT count(*) AS n, greatest(least(sum(e1 * a + e2 * b) / sum(a * a + b * b), 0.98), -0.98) AS rho FROM l WHERE a IS NOT NULL) SELECT any_value(n) AS n, round(any_value(rho), 7) AS rho, round(avg((e1 - rho * a) * (e1 - rho * a)), 9) AS o11, round(avg((e1 - rho * a) * (e2 - rho * b)), 9) AS o12 FROM l, r WHERE a IS NOT NULL")
def e21(spark, d):  # noqa: ANN001, ANN201
    out = covariance.ar1(_resid(spark, d), ["e1", "e2"], [])
    return out.select("n", F.round("rho", 7).alias("rho"), F.round(F.col("omega")[0], 9).alias("o11"), F.round(F.col("omega")[1], 9).alias("o12"))


@query("e22_scale_profile", f"WITH {RES}, c AS (SELECT *, v - avg(v) OVER () AS u FROM res), g AS (SELECT CAST(unnest([-1.0, -0.5, 0.0, 0.5, 1.0]) AS DOUBLE) AS b), m AS (SELECT b, count(*) AS n, avg(exp(b * u) * e1 * e1) AS p, avg(exp(b * u) * e1 * e2) AS q, avg(exp(b * u) * e2 * e2) AS r FROM c, g GROUP BY b) SELECT b, round(-n / 2.0::DOUBLE * (2 * (1 + ln(2 * pi())) + ln(p * r - q * q)), 5) AS loglik FROM m")
def e22_profile(spark, d):  # noqa: ANN001, ANN201
    return rounded(covariance.scale_profile(_resid(spark, d), ["e1", "e2"], "v", [-1.0, -0.5, 0.0, 0.5, 1.0], []), "loglik", digits=5)


@query("e23_quadratic_loglik", f"WITH {RES}, w AS (SELECT *, 60 + v * 6 + v * v * 4 AS a, -5 + v * 5 + v * v * 4 AS b, 50 + v * 4 + v * v * 4 AS c FROM res) SELECT count(*) AS n, round(sum((ln(a * c - b * b) - (a * e1 * e1 + 2 * b * e1 * e2 + c * e2 * e2) - 2 * ln(2 * pi())) / 2), 5) AS loglik FROM w")
def e23(spark, d):  # noqa: ANN001, ANN201
    path = covariance.quadratic_path([[60.0, -5.0, 3.0], [-5.0, 50.0, 2.0], [3.0, 2.0, 4.0]], F.col("v"))
    return rounded(covariance.gaussian_loglik(_resid(spark, d), ["e1", "e2"], path, []), "loglik", digits=5)


@query("e25_log_precision_loglik", f"WITH {RES}, h AS (SELECT *, exp((3.5 + 0.2 * v) / 2) AS l1, exp((3.1 - 0.1 * v) / 2) AS l2 FROM res), w AS (SELECT *, l1 * l1 AS a, 0.3 * l1 * l2 AS b, l2 * l2 AS c FROM h) SELECT count(*) AS n, round(sum((ln(a * c - b * b) - (a * e1 * e1 + 2 * b * e1 * e2 + c * e2 * e2) - 2 * ln(2 * pi())) / 2), 5) AS loglik FROM w")
def e25(spark, d):  # noqa: ANN001, ANN201
    path = covariance.log_precision_path([3.5, 3.1], [0.2, -0.1], [[1.0, 0.3], [0.3, 1.0]], F.col("v"))
    return rounded(covariance.gaussian_loglik(_resid(spark, d), ["e1", "e2"], path, []), "loglik", digits=5)


@query("e26_gaussian_loglik", f"WITH {RES} SELECT count(*) AS n, round(sum((ln(40.0 * 30 - 25) - (40 * e1 * e1 - 10 * e1 * e2 + 30 * e2 * e2) - 2 * ln(2 * pi())) / 2), 5) AS loglik FROM res")
def e26(spark, d):  # noqa: ANN001, ANN201
    return rounded(covariance.gaussian_loglik(_resid(spark, d), ["e1", "e2"], covariance.constant_path([[40.0, -5.0], [-5.0, 30.0]]), []), "loglik", digits=5)


@query("e28_precision_path", f"WITH {RES}, c AS (SELECT *, v - avg(v) OVER () AS u FROM res) SELECT d, round(900 * exp(0.4 * u), 4) AS w11, round(-50 * exp(0.4 * u), 4) AS w12 FROM c")
def e28(spark, d):  # noqa: ANN001, ANN201
    rows = tables.with_mean(_resid(spark, d), [], "v", "mean").withColumn("u", F.col("v") - F.col("mean"))
    path = covariance.scale_path(W2, 0.4, F.col("u"))
    return rows.select("d", F.round(path[0][0], 4).alias("w11"), F.round(path[0][1], 4).alias("w12"))


@query("e28_regime_path", f"WITH {RES}, n AS (SELECT *, row_number() OVER (ORDER BY d) AS t FROM res), w AS (SELECT *, CASE WHEN t > 150 THEN 30.0 ELSE 50.0 END::DOUBLE AS a, CASE WHEN t > 150 THEN -4.0 ELSE 6.0 END::DOUBLE AS b, CASE WHEN t > 150 THEN 20.0 ELSE 45.0 END::DOUBLE AS c FROM n) SELECT count(*) AS n, round(sum((ln(a * c - b * b) - (a * e1 * e1 + 2 * b * e1 * e2 + c * e2 * e2) - 2 * ln(2 * pi())) / 2), 5) AS loglik FROM w")
def e28_regime(spark, d):  # noqa: ANN001, ANN201
    rows = panel.numbered(_resid(spark, d), []).withColumn("segment", panel.segment(F.col("t"), [150]))
    path = covariance.regime_path([[[50.0, 6.0], [6.0, 45.0]], [[30.0, -4.0], [-4.0, 20.0]]], "segment")
    return rounded(covariance.gaussian_loglik(rows, ["e1", "e2"], path, []), "loglik", digits=5)


@query("e25_log_precision_sums", f"WITH {RES}, h AS (SELECT *, 3.5 + 0.2 * v AS h1, 3.1 - 0.1 * v AS h2 FROM res), u AS (SELECT *, exp(h1 / 2) * e1 AS u1, exp(h2 / 2) * e2 AS u2 FROM h) SELECT count(*) AS n, round(sum(h1 + h2), 5) AS sum_h, round(sum(u1 * u2), 5) AS u12, round(sum(v * u2 * u2), 5) AS vu22, round(sum(v), 5) AS sum_v FROM u")
def e25_sums(spark, d):  # noqa: ANN001, ANN201
    out = covariance.log_precision_sums(_resid(spark, d), ["e1", "e2"], [3.5, 3.1], [0.2, -0.1], F.col("v"), [])
    return rounded(out.select("n", "sum_h", F.col("uu")[1].alias("u12"), F.col("vuu")[2].alias("vu22"), "sum_v"), "sum_h", "u12", "vu22", "sum_v", digits=5)


@query("e34_positive_path", f"WITH {RES}, w AS (SELECT *, 60 + v * 6 + v * v * 4 AS a, -5 + v * 5 + v * v * 4 AS b, 50 + v * 4 + v * v * 4 AS c FROM res) SELECT count(*) AS n, round(min(least(a, a * c - b * b)), 5) AS least_minor FROM w")
def e34_positive(spark, d):  # noqa: ANN001, ANN201
    path = covariance.quadratic_path([[60.0, -5.0, 3.0], [-5.0, 50.0, 2.0], [3.0, 2.0, 4.0]], F.col("v"))
    return rounded(covariance.positive_path(_resid(spark, d), path, []), "least_minor", digits=5)


@query("e34_block_guard", f"WITH {RES}, w AS (SELECT *, 60 + v * 6 + v * v * 4 AS a, -5 + v * 5 + v * v * 4 AS b, 50 + v * 4 + v * v * 4 AS c FROM res), s AS (SELECT a, b, c, 2 / (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) AS low FROM w), r AS (SELECT min(low) / avg(low) AS ratio FROM s) SELECT CAST(k AS INTEGER) AS k, round(ratio, 7) AS ratio, ratio >= 1e-8 AND ll <= 10 + 5000 AS valid FROM r, (VALUES (1, 100.0), (2, 5010.5), (3, NULL)) f(k, ll) WHERE ll IS NOT NULL UNION ALL SELECT 3, round(ratio, 7), false FROM r")
def e34_guard(spark, d):  # noqa: ANN001, ANN201
    """The screen of a path for three fits: one sound, one run away, one without a likelihood."""
    path = covariance.quadratic_path([[60.0, -5.0, 3.0], [-5.0, 50.0, 2.0], [3.0, 2.0, 4.0]], F.col("v"))
    tried = spark.createDataFrame([(1, 100.0, 10.0), (2, 5010.5, 10.0), (3, None, 10.0)], "k int, loglik double, reference double")
    out = covariance.block_guard(covariance.validity_screen(_resid(spark, d), path, []), tried, [])
    return rounded(out.select("k", "ratio", "valid"), "ratio", digits=7)


@query("e40_nullity", f"WITH {REGION} SELECT n_regionkey, count(*) - 2 AS n, 1::INTEGER AS nullity FROM logr GROUP BY 1")
def e40(spark, d):  # noqa: ANN001, ANN201
    """Two driver columns for three residuals leave one flat direction."""
    rows = panel.volatility_driver(logr(spark, d), ["x"], ["n_regionkey"])
    return covariance.flat_directions(rows, "v", [[1.0, 0.0], [0.5, 1.0], [0.2, -1.0]], ["n_regionkey"])


@query("e32_vecm_path", f"WITH {DIFF} SELECT d, round(-0.2 * x1 + 0.1 * x2 + 0.5 * z1 + 1, 6) AS f0, round(0.1 * x1 - 0.3 * x2 - 0.2 * z1 + 2, 6) AS f1 FROM des WHERE z1 IS NOT NULL")
def e32(spark, d):  # noqa: ANN001, ANN201
    rows = panel.lag_design(log5(spark, d), ["l_s1", "l_s2"], 2, []).withColumn("one", F.lit(1.0)).na.drop(subset=["z1_l_s1"])
    out = covariance.vecm_path(rows, ["x_l_s1", "x_l_s2"], ["z1_l_s1", "one"], [[-0.2, 0.1], [0.1, -0.3]], [[0.5, 1.0], [-0.2, 2.0]])
    return rounded(out.select("d", "f0", "f1"), "f0", "f1")


@query("e34_validity_screen", f"WITH {RES}, w AS (SELECT 60 + v * 6 + v * v * 4 AS a, -5 + v * 5 + v * v * 4 AS b, 50 + v * 4 + v * v * 4 AS c FROM res), s AS (SELECT 2 / (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) AS low FROM w) SELECT round(min(low) / avg(low), 7) AS ratio, min(low) / avg(low) >= 1e-8 AS valid FROM s")
def e34(spark, d):  # noqa: ANN001, ANN201
    path = covariance.quadratic_path([[60.0, -5.0, 3.0], [-5.0, 50.0, 2.0], [3.0, 2.0, 4.0]], F.col("v"))
    return rounded(covariance.validity_screen(_resid(spark, d), path, []), "ratio", digits=7)


@query("e38_numeraire_compare")
def e38(spark, d):  # noqa: ANN001, ANN201
    """The same system with two first series, as two systems of one job."""
    base = log5(spark, d)
    names = ["n1", "n2", "n3"]
    parts = [base.select("d", F.lit(first).alias("numeraire"), *(F.col(c).alias(n) for c, n in zip([first, *L5[2:4]], names, strict=True))) for first in L5[:2]]
    # Every specification of both, run side by side.
    return compare.spec_fits(parts[0].unionByName(parts[1]), names, ["numeraire"], [120, 240])


@query("e23_fit_quadratic")
def e23_fit(spark, d):  # noqa: ANN001, ANN201
    rows = panel.volatility_driver(log5(spark, d).select("d", *L5[:2]), L5[:2], [])
    return driven.fit(rows, L5[:2], [], "v", "quadratic")


@query("e25_fit_log_precision")
def e25_fit(spark, d):  # noqa: ANN001, ANN201
    rows = panel.volatility_driver(log5(spark, d).select("d", *L5[:2]), L5[:2], [])
    return driven.fit(rows, L5[:2], [], "v", "log-precision")


@query("e24_fit_quadratic_factor")
def e24_fit(spark, d):  # noqa: ANN001, ANN201
    """D kept positive by its factor, one fit a region."""
    rows = panel.volatility_driver(_region_system(spark, d), L5[:3], ["n_regionkey"])
    return driven.fit(rows, L5[:3], ["n_regionkey"], "v", "quadratic-factor")


@query("e20_fit_fixed")
def e20(spark, d):  # noqa: ANN001, ANN201
    """Known precisions: each region's constant one, scaled by its driver."""
    system = ["n_regionkey"]
    rows = panel.volatility_driver(_region_system(spark, d), L5[:3], system).where("v is not null")
    base = [400.0, -20.0, -10.0, 380.0, -15.0, 390.0]
    weights = rows.select(*system, "d", F.array(*(F.lit(x) / (0.5 + F.col("v")) for x in base)).alias("w"))
    return driven.fixed_fits(rows, L5[:3], system, weights)


@query("e21_fit_ar1")
def e21_fit(spark, d):  # noqa: ANN001, ANN201
    return fits.ar1(_region_system(spark, d), L5[:3], ["n_regionkey"])


@query("c3_anti_join", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def c3(spark, d):  # noqa: ANN001, ANN201
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return results.todo(table(spark, d, "customer").select("c_custkey", "c_nationkey"), done, ["c_custkey"])
