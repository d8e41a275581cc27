"""Aggregation and stratification of trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions.aggregates import profit_factor
from barspark.functions.indicators import Series, lead
from barspark.operators import strata as S
from barspark.operators.capacity import capacity_book
from barspark.operators.prefix import exact_quantiles
from barspark.plans import market as M
from barspark.plans.registry import query

PF = "sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0)"
PFC = "sum(least(ret, 0.5)) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0)"
WIN = "avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)"
SUM = f"count(*) AS n, {PF} AS pf, {PFC} AS pf_clip, {WIN} AS win, avg(ret) AS mean_ret"
SUMS = "n:i pf:f pf_clip:f win:f mean_ret:f"


@query("I1_profit_factor_per_ticker", f"ticker:i {SUMS}", f"SELECT ticker, {SUM} FROM trips GROUP BY 1")
def profit_factors(spark, sf):
    return M.trips(spark, sf).groupBy("ticker").agg(*S.summary())


@query("I2_return_distribution", "yr:i n:i win:f mean_ret:f median_ret:f total_ret:f min_ret:f max_ret:f",
       f"""SELECT year(entry_date) AS yr, count(*) AS n, {WIN} AS win, avg(ret) AS mean_ret, median(ret) AS median_ret, sum(ret) AS total_ret,
           min(ret) AS min_ret, max(ret) AS max_ret FROM trips GROUP BY 1""")
def distribution(spark, sf):
    return S.distribution(M.trips(spark, sf).withColumn("yr", F.year("entry_date")), ["yr"])


@query("I3_era_metrics", "mo:i n_pre:i pf_pre:f n_post:i pf_post:f",
       """SELECT month(entry_date) AS mo, count(*) FILTER (NOT e) AS n_pre, sum(ret) FILTER (ret > 0 AND NOT e) / nullif(-sum(ret) FILTER (ret < 0 AND NOT e), 0) AS pf_pre,
          count(*) FILTER (e) AS n_post, sum(ret) FILTER (ret > 0 AND e) / nullif(-sum(ret) FILTER (ret < 0 AND e), 0) AS pf_post
          FROM (SELECT *, entry_date >= DATE '1998-06-01' AS e FROM trips) GROUP BY 1""")
def eras(spark, sf):
    return S.era_metrics(M.trips(spark, sf).withColumn("mo", F.month("entry_date")), ["mo"], F.col("entry_date") >= F.lit("1998-06-01").cast("date"))


@query("I4_fixed_bands", f"band:i {SUMS}",
       f"""SELECT CASE WHEN rvol < 1 THEN 0 WHEN rvol < 1.25 THEN 1 WHEN rvol < 1.5 THEN 2 WHEN rvol < 2 THEN 3 ELSE 4 END AS band, {SUM} FROM trips GROUP BY 1""")
def fixed_bands(spark, sf):
    t = M.trips(spark, sf).withColumn("band", S.bands(F.col("rvol"), [1.0, 1.25, 1.5, 2.0]))
    return t.groupBy("band").agg(*S.summary())


@query("I5_equal_count_deciles", f"tile:i lo:f hi:f {SUMS}",
       f"SELECT tile, min(rvol) AS lo, max(rvol) AS hi, {SUM} FROM (SELECT *, ntile(10) OVER (ORDER BY rvol, trip_id) AS tile FROM trips) GROUP BY 1")
def deciles(spark, sf):
    t = S.tiles(M.trips(spark, sf), "rvol", "trip_id", 10)
    return t.groupBy("tile").agg(F.min("rvol").alias("lo"), F.max("rvol").alias("hi"), *S.summary())


@query("I6_value_quantile_grid", "a:i b:i n:i mean_ret:f",
       """WITH q AS (SELECT quantile_cont(rvol, [0.2, 0.4, 0.6, 0.8]) AS a, quantile_cont(pct_up, [0.2, 0.4, 0.6, 0.8]) AS b FROM trips)
          SELECT CASE WHEN rvol <= q.a[1] THEN 0 WHEN rvol <= q.a[2] THEN 1 WHEN rvol <= q.a[3] THEN 2 WHEN rvol <= q.a[4] THEN 3 ELSE 4 END AS a,
            CASE WHEN pct_up <= q.b[1] THEN 0 WHEN pct_up <= q.b[2] THEN 1 WHEN pct_up <= q.b[3] THEN 2 WHEN pct_up <= q.b[4] THEN 3 ELSE 4 END AS b,
            count(*) AS n, avg(ret) AS mean_ret FROM trips, q GROUP BY 1, 2""")
def quantile_grid(spark, sf):
    p = [0.2, 0.4, 0.6, 0.8]
    t = S.quantile_bins(S.quantile_bins(M.trips(spark, sf), "rvol", p, "a"), "pct_up", p, "b")
    return t.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))


GRID = [0.8, 1.0, 1.2, 1.5, 2.0, 3.0, 50.0]


def _sweep(op: str) -> str:
    return f"""SELECT threshold, count(ret) AS n, {PF} AS pf, {PFC} AS pf_clip, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS win,
        avg(ret) AS mean_ret FROM (SELECT CAST(unnest({GRID}) AS DOUBLE) AS threshold) LEFT JOIN trips ON rvol {op} threshold GROUP BY 1"""


@query("I7_floor_sweep", f"threshold:f {SUMS}", _sweep(">="))
def floor_sweep(spark, sf):
    return S.threshold_sweep(M.trips(spark, sf), "rvol", GRID)


@query("I7_ceiling_sweep", f"threshold:f {SUMS}", _sweep("<"))
def ceiling_sweep(spark, sf):
    return S.threshold_sweep(M.trips(spark, sf), "rvol", GRID, "ceiling")


BAND2 = "CASE WHEN pct_up < 0.2 THEN 0 WHEN pct_up < 0.5 THEN 1 ELSE 2 END"


@query("I8_grid_2d", "band:i 0_pf:f 0_n:i 1_pf:f 1_n:i 2_pf:f 2_n:i",
       "SELECT CASE WHEN rvol < 1 THEN 0 WHEN rvol < 1.5 THEN 1 ELSE 2 END AS band, " + ", ".join(
           f"""sum(ret) FILTER (ret > 0 AND {BAND2} = {k}) / nullif(-sum(ret) FILTER (ret < 0 AND {BAND2} = {k}), 0) AS "{k}_pf",
           count(*) FILTER ({BAND2} = {k}) AS "{k}_n\"""" for k in range(3)) + " FROM trips GROUP BY 1")
def grid_2d(spark, sf):
    t = M.trips(spark, sf).withColumns({"band": S.bands(F.col("rvol"), [1.0, 1.5]), "mv": S.bands(F.col("pct_up"), [0.2, 0.5])})
    return S.grid_2d(t, "band", "mv", [0, 1, 2])


@query("I9_I10_filtered_aggregates_corr", "yr:i n_big:i pf_big:f corr_rvol:f corr_move:f",
       """SELECT year(entry_date) AS yr, count(*) FILTER (rvol >= 1.5) AS n_big,
          sum(ret) FILTER (ret > 0 AND rvol >= 1.5) / nullif(-sum(ret) FILTER (ret < 0 AND rvol >= 1.5), 0) AS pf_big,
          corr(ret, rvol) AS corr_rvol, corr(ret, pct_up) AS corr_move FROM trips GROUP BY 1""")
def filtered(spark, sf):
    r = F.col("ret")
    return M.trips(spark, sf).groupBy(F.year("entry_date").alias("yr")).agg(
        F.expr("count(*) FILTER (WHERE rvol >= 1.5)").alias("n_big"), profit_factor(r, F.col("rvol") >= 1.5).alias("pf_big"),
        F.corr("ret", "rvol").alias("corr_rvol"), F.corr("ret", "pct_up").alias("corr_move"))


@query("I11_exact_quantiles", "exit_reason q05:f q25:f q50:f q95:f",
       """SELECT exit_reason, quantile_cont(ret, 0.05) AS q05, quantile_cont(ret, 0.25) AS q25, quantile_cont(ret, 0.5) AS q50,
          quantile_cont(ret, 0.95) AS q95 FROM trips GROUP BY 1""")
def quantiles(spark, sf):
    return exact_quantiles(M.trips(spark, sf), ["exit_reason"], "ret", {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q95": 0.95})


@query("I11_matched_selectivity", "variant n:i mean_ret:f",
       """WITH k AS (SELECT count(*) FILTER (rvol >= 1.5) / count(*) AS share FROM trips),
          s AS (SELECT list_sort(list(pct_up)) AS v, (1 - any_value(share)) * (count(*) - 1) AS p FROM trips, k),
          q AS (SELECT v[CAST(floor(p) AS BIGINT) + 1] + (v[CAST(ceil(p) AS BIGINT) + 1] - v[CAST(floor(p) AS BIGINT) + 1]) * (p - floor(p)) AS cut FROM s)
          SELECT 'rvol' AS variant, count(*) AS n, avg(ret) AS mean_ret FROM trips WHERE rvol >= 1.5
          UNION ALL SELECT 'move', count(*), avg(ret) FROM trips, q WHERE pct_up >= cut""")
def matched(spark, sf):
    """Two filters compared at the same selectivity: the second one's cut is the quantile that keeps as many rows."""
    t = M.trips(spark, sf)
    share = t.agg(F.avg(F.when(F.col("rvol") >= 1.5, 1.0).otherwise(0.0)).alias("s")).first()["s"]  # one number
    cut = exact_quantiles(t, [], "pct_up", {"cut": 1.0 - share})
    a = t.filter("rvol >= 1.5").select(F.lit("rvol").alias("variant"), "ret")
    b = t.join(F.broadcast(cut)).filter("pct_up >= cut").select(F.lit("move").alias("variant"), "ret")
    return a.unionByName(b).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))


@query("I12_concentration", "yr:i n_trips:i pf_all:f pf_ex1:f pf_ex3:f pf_ex5:f top1_share:f top3_share:f top5_share:f",
       f"""SELECT yr, count(*) AS n_trips, {PF} AS pf_all, """ + ", ".join(
           f"""sum(ret) FILTER (ret > 0 AND rk > {k}) / nullif(-sum(ret) FILTER (ret < 0 AND rk > {k}), 0) AS pf_ex{k},
           sum(ret) FILTER (ret > 0 AND rk <= {k}) / nullif(sum(ret) FILTER (ret > 0), 0) AS top{k}_share""" for k in (1, 3, 5))
       + " FROM (SELECT *, year(entry_date) AS yr, row_number() OVER (PARTITION BY year(entry_date) ORDER BY ret DESC, trip_id) AS rk FROM trips) GROUP BY 1")
def concentration(spark, sf):
    return S.concentration(M.trips(spark, sf).withColumn("yr", F.year("entry_date")), ["yr"], "trip_id")


@query("I13_gate_ablation", "variant n:i pf:f mean_ret:f",
       " UNION ALL ".join(f"SELECT '{name}' AS variant, count(*) AS n, {PF} AS pf, avg(ret) AS mean_ret FROM trips WHERE {w}" for name, w in (
           ("all", "rvol >= 1 AND pct_up < 1 AND tight_log < 3.5"), ("no_rvol", "pct_up < 1 AND tight_log < 3.5"),
           ("no_move", "rvol >= 1 AND tight_log < 3.5"), ("no_tight", "rvol >= 1 AND pct_up < 1"))))
def ablation(spark, sf):
    return S.ablation(M.trips(spark, sf), {"rvol": F.col("rvol") >= 1, "move": F.col("pct_up") < 1, "tight": F.col("tight_log") < 3.5})


@query("I14_worst_trip_symbol_day", "worst_trip:f worst_symbol_day:f worst_day:f",
       """SELECT (SELECT min(net_pnl) FROM trips) AS worst_trip,
          (SELECT min(p) FROM (SELECT sum(net_pnl) AS p FROM trips GROUP BY ticker, exit_date)) AS worst_symbol_day,
          (SELECT min(p) FROM (SELECT sum(net_pnl) AS p FROM trips GROUP BY exit_date)) AS worst_day""")
def worst(spark, sf):
    return S.worst(M.trips(spark, sf), "ticker", "exit_date")


@query("I15_parameterised_table", f"floor:f {SUMS}",
       " UNION ALL ".join(f"SELECT {x}::DOUBLE AS floor, {SUM} FROM trips WHERE rvol >= {x} AND pct_up < 0.5" for x in (1.0, 1.5)))
def parameterised(spark, sf):
    """A table macro as a Python function of its parameter."""
    def at(floor: float):
        return M.trips(spark, sf).filter((F.col("rvol") >= floor) & (F.col("pct_up") < 0.5)).agg(*S.summary()).withColumn("floor", F.lit(floor))

    return at(1.0).unionByName(at(1.5))


@query("I16_calendar_pnl", "part key:i n:i pnl:f4 win:f",
       " UNION ALL ".join(f"SELECT '{n}' AS part, {e} AS key, count(*) AS n, sum(net_pnl) AS pnl, {WIN} AS win FROM trips GROUP BY 2" for n, e in (
           ("dow", "dayofweek(entry_date) + 1"), ("month", "month(entry_date)"), ("quarter", "quarter(entry_date)"), ("year", "year(entry_date)"))))
def calendar(spark, sf):
    d = F.col("entry_date")
    parts = F.array(*[F.struct(F.lit(n).alias("part"), e.alias("key")) for n, e in (
        ("dow", F.dayofweek(d)), ("month", F.month(d)), ("quarter", F.quarter(d)), ("year", F.year(d)))])
    t = M.trips(spark, sf).select("ret", "net_pnl", F.explode(parts).alias("p"))
    return S.calendar_pnl(t, {"part": F.col("p.part"), "key": F.col("p.key")})


@query("I16_time_of_day", "hour:i n:i volume:i",
       "SELECT hour(make_timestamp(ts)) AS hour, count(*) AS n, sum(size) AS volume FROM tape GROUP BY 1")
def time_of_day(spark, sf):
    t = M.tape(spark, sf)
    return t.groupBy(F.hour(F.timestamp_micros("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))


@query("I17_equity_and_drawdown", "day pnl:f4 equity:f4 drawdown:f4",
       """SELECT day, pnl, equity, max(equity) OVER (ORDER BY day) - equity AS drawdown FROM (SELECT day, pnl, sum(pnl) OVER (ORDER BY day) AS equity
          FROM (SELECT exit_date AS day, sum(net_pnl) AS pnl FROM trips GROUP BY 1))""")
def equity(spark, sf):
    return S.equity_curve(M.trips(spark, sf), "exit_date")


MTM = """WITH a AS (SELECT ticker AS symbol, CAST(date_trunc('month', date) AS DATE) AS month, arg_min(open, date) AS anchor FROM daily GROUP BY 1, 2),
    t AS (SELECT *, CAST(date_trunc('month', entry_date) AS DATE) AS em, CAST(date_trunc('month', exit_date) AS DATE) AS xm, qty * 0.01 AS fees,
      (trip_id % 7) * 0.5 AS funding, exit_date - entry_date + 1 AS days FROM trips),
    e AS (SELECT *, CAST(unnest(generate_series(CAST(em AS TIMESTAMP), CAST(xm AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM t),
    j AS (SELECT e.*, s.anchor AS a0, z.anchor AS a1, CASE WHEN e.month = em THEN entry_date ELSE e.month END AS d0,
        CASE WHEN e.month = xm THEN exit_date ELSE CAST(e.month + INTERVAL 1 MONTH AS DATE) - 1 END AS d1
      FROM e LEFT JOIN a s ON s.symbol = ticker AND s.month = e.month LEFT JOIN a z ON z.symbol = ticker AND z.month = CAST(e.month + INTERVAL 1 MONTH AS DATE)),
    m AS (SELECT trip_id, month, (CASE WHEN month = xm THEN exit_price ELSE a1 END - CASE WHEN month = em THEN entry_price ELSE a0 END) * qty
        - CASE WHEN month = em AND month = xm THEN fees WHEN month = em OR month = xm THEN fees / 2 ELSE 0 END
        + funding * (d1 - d0 + 1) / days AS month_pnl FROM j)"""


def monthly(spark, sf):
    d = M.daily(spark, sf)
    anchors = d.groupBy(F.col("ticker").alias("symbol"), F.trunc("date", "month").alias("month")).agg(F.min_by("open", "date").alias("anchor_close"))
    t = M.trips(spark, sf).withColumnRenamed("ticker", "symbol").withColumns({"fees": F.col("qty") * 0.01, "funding": (F.col("trip_id") % 7) * 0.5})
    return t, S.monthly_mark_to_market(t, anchors)


@query("I18_monthly_mark_to_market", "month n:i pnl:f4", MTM + " SELECT month, count(*) AS n, sum(month_pnl) AS pnl FROM m GROUP BY 1")
def mark_to_market(spark, sf):
    return monthly(spark, sf)[1].groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("month_pnl").alias("pnl"))


@query("I18_reconciliation", "n:i mtm_sum:f2 trip_sum:f2",
       MTM + """ SELECT count(*) AS n, sum(p) AS mtm_sum, sum(net_pnl - fees + funding) AS trip_sum FROM t
          JOIN (SELECT trip_id, sum(month_pnl) AS p, bool_or(month_pnl IS NULL) AS hole FROM m GROUP BY 1) USING (trip_id) WHERE NOT hole""")
def reconciliation(spark, sf):
    """Months of a trip add up to its P&L less fees plus funding (trips with a month lacking an anchor left out)."""
    t, m = monthly(spark, sf)
    s = m.groupBy("trip_id").agg(F.sum("month_pnl").alias("p"), F.max(F.col("month_pnl").isNull()).alias("hole")).filter(~F.col("hole"))
    j = t.join(s, "trip_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("mtm_sum"), F.sum(F.col("net_pnl") - F.col("fees") + F.col("funding")).alias("trip_sum"))


EXPO = """d AS (SELECT day, sum(dn) AS dn FROM (SELECT entry_date AS day, 10000.0::DOUBLE AS dn FROM trips UNION ALL SELECT exit_date, -10000.0::DOUBLE FROM trips) GROUP BY 1),
    c AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(day) FROM d) AS TIMESTAMP), CAST((SELECT max(day) FROM d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day),
    l AS (SELECT c.day, sum(coalesce(dn, 0)) OVER (ORDER BY c.day) AS level FROM c LEFT JOIN d ON d.day = c.day),
    x AS (SELECT day, greatest(level, coalesce(lag(level) OVER (ORDER BY day), 0)) AS max_notional, level FROM l)"""


def exposure(spark, sf):
    t = M.trips(spark, sf).withColumn("notional", F.lit(10_000.0))
    return t, S.concurrent_exposure(t, "entry_date", "exit_date", "notional")


@query("I19_concurrent_exposure", "day max_notional:f level:f", f"WITH {EXPO} SELECT * FROM x")
def concurrent(spark, sf):
    return exposure(spark, sf)[1]


@query("I20_return_on_capital", "total_pnl:f2 base_peak:f base_p99:f base_p95:f base_mean:f4 roc_peak:f roc_mean:f",
       f"""WITH {EXPO}, t AS (SELECT sum(net_pnl) AS total_pnl FROM trips),
           b AS (SELECT max(max_notional) AS base_peak, quantile_cont(max_notional, 0.99) AS base_p99, quantile_cont(max_notional, 0.95) AS base_p95,
             avg(max_notional) AS base_mean FROM x)
           SELECT *, total_pnl / (base_peak * 7) AS roc_peak, total_pnl / (base_mean * 7) AS roc_mean FROM t, b""")
def roc(spark, sf):
    t, x = exposure(spark, sf)
    return S.return_on_capital(x, t.agg(F.sum("net_pnl").alias("total_pnl")), 7.0)


@query("I21_min_tercile_bucket", f"bucket:i {SUMS}",
       f"""SELECT least(CASE WHEN rvol < 1.0 THEN 1 WHEN rvol < 1.5 THEN 2 ELSE 3 END, CASE WHEN pct_up < 0.2 THEN 1 WHEN pct_up < 0.5 THEN 2 ELSE 3 END) AS bucket,
           {SUM} FROM trips GROUP BY 1""")
def min_tercile(spark, sf):
    b = S.min_bucket(F.col("rvol"), (1.0, 1.5), F.col("pct_up"), (0.2, 0.5))
    return M.trips(spark, sf).groupBy(b.alias("bucket")).agg(*S.summary())


@query("I22_capacity_limited_book", "scenario n:i accepted:i pnl:f2")
def capacity(spark, sf):
    t = M.trips(spark, sf).withColumn("notional", F.lit(10_000.0))
    a = capacity_book(t, {"small": 100_000.0, "medium": 300_000.0, "large": 1e9})
    j = a.join(t.select("trip_id", "net_pnl"), "trip_id")
    return j.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("accepted"),
                                     F.sum(F.when(F.col("accepted"), F.col("net_pnl")).otherwise(0.0)).alias("pnl"))


@query("I23_symbol_concentration_top", "ticker:i n:i pnl:f4 share:f",
       "SELECT ticker, count(*) AS n, sum(net_pnl) AS pnl, sum(net_pnl) / (SELECT sum(net_pnl) FROM trips) AS share FROM trips GROUP BY 1 ORDER BY pnl DESC, ticker LIMIT 15")
def symbol_top(spark, sf):
    return S.symbol_profile(M.trips(spark, sf), "ticker", 15)


EXC = """SELECT t.trip_id, t.ret, max(b.high) / any_value(t.entry_price) - 1 AS mfe, 1 - min(b.low) / any_value(t.entry_price) AS mae FROM trips t
    JOIN daily b ON b.ticker = t.ticker AND b.date > t.entry_date AND b.date <= t.exit_date GROUP BY 1, 2"""
BANDS = [0.0, 0.1, 0.3, 1.0]


@query("I23_excursion_bands", "mfe_band:i mae_band:i n:i mean_ret:f",
       f"""SELECT CASE WHEN mfe < 0 THEN 0 WHEN mfe < 0.1 THEN 1 WHEN mfe < 0.3 THEN 2 WHEN mfe < 1 THEN 3 ELSE 4 END AS mfe_band,
           CASE WHEN mae < 0 THEN 0 WHEN mae < 0.1 THEN 1 WHEN mae < 0.3 THEN 2 WHEN mae < 1 THEN 3 ELSE 4 END AS mae_band, count(*) AS n, avg(ret) AS mean_ret
           FROM ({EXC}) GROUP BY 1, 2""")
def excursions(spark, sf):
    """Extremes over the holding period from a window over the bars: six bars, fewer where the series ends."""
    s = Series(("ticker", "episode"), ("date",))
    b = M.episodes(spark, sf)
    w = s.ahead(M.HOLD + 1)
    b = b.select("ticker", F.col("date").alias("entry_date"), F.max("high").over(w).alias("hi"), F.min("low").over(w).alias("lo"))
    t = M.trips(spark, sf).join(b, ["ticker", "entry_date"]).filter(F.col("hi").isNotNull())
    t = t.withColumns({"mfe": F.col("hi") / F.col("entry_price") - 1, "mae": 1 - F.col("lo") / F.col("entry_price")})
    return S.excursion(t, BANDS)


@query("I23_quarterly_pnl_and_single_trip_symbols", "q:i n:i pnl:f4 single:i",
       """SELECT year(entry_date) * 10 + quarter(entry_date) AS q, count(*) AS n, sum(net_pnl) AS pnl, count(*) FILTER (k = 1) AS single
          FROM (SELECT *, count(*) OVER (PARTITION BY ticker, year(entry_date), quarter(entry_date)) AS k FROM trips) GROUP BY 1""")
def quarterly(spark, sf):
    t = M.trips(spark, sf).withColumn("q", F.year("entry_date") * 10 + F.quarter("entry_date"))
    per = t.groupBy("q", "ticker").agg(F.count(F.lit(1)).alias("k"), F.sum("net_pnl").alias("p"))
    return per.groupBy("q").agg(F.sum("k").alias("n"), F.sum("p").alias("pnl"), F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("single"))


@query("I24_size_distribution_cdf", "sign:i n:i p10:f p50:f p99:f mean_under:f mean_from:f",
       """SELECT sign, count(*) AS n, quantile_disc(size, 0.1) AS p10, any_value(mid) AS p50, quantile_disc(size, 0.99) AS p99,
            avg(size) FILTER (size < mid) AS mean_under, avg(size) FILTER (size >= mid) AS mean_from
          FROM tape JOIN (SELECT sign, quantile_disc(size, 0.5) AS mid FROM tape GROUP BY 1) USING (sign) GROUP BY 1""")
def size_cdf(spark, sf):
    x = S.size_cdf(M.tape(spark, sf), ["sign"], "size", [0.1, 0.5, 0.99])
    return x.withColumns({"p10": F.get("q", F.lit(0)), "p50": F.get("q", F.lit(1)), "p99": F.get("q", F.lit(2))})


@query("I24_size_sketch_within_bound", "sign:i n:i p10_ok p50_ok p99_ok",
       "SELECT sign, count(*) AS n, true AS p10_ok, true AS p50_ok, true AS p99_ok FROM tape GROUP BY 1")
def size_sketch(spark, sf):
    """A sketch per day and side, merged to one per side; each quantile's rank is looked up in the whole tape."""
    t = M.tape(spark, sf)
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    q = S.merged_sketches(S.size_sketches(t, ["sign", "date"], "size"), ["sign"], probs).drop("sketch")
    x = t.select("sign", "size").join(F.broadcast(q), "sign")  # a row a side
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    ok = {f"{c}_ok": (share(F.col("size") < F.col(c)) - S.RANK_ERROR <= p) & (share(F.col("size") <= F.col(c)) + S.RANK_ERROR >= p) for c, p in probs.items()}
    return x.groupBy("sign").agg(F.max("n").alias("n"), *[v.alias(c) for c, v in ok.items()])


@query("I25_forward_return_split", "d1_up:i n:i mean_day1:f mean_rest:f",
       """SELECT CAST(c1 > entry_price AS INT) AS d1_up, count(*) AS n, avg(c1 / entry_price - 1) AS mean_day1, avg(exit_price / c1 - 1) AS mean_rest FROM trips t
          JOIN (SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) AS c1 FROM daily) d ON d.ticker = t.ticker AND d.date = entry_date
          WHERE c1 IS NOT NULL GROUP BY 1""")
def forward_split(spark, sf):
    """The first day's part of the return (mechanical) against the rest (predictive)."""
    d = M.daily(spark, sf)
    d = d.select("ticker", F.col("date").alias("entry_date"), lead(Series(("ticker",), ("date",)), F.col("close")).alias("c1"))
    t = M.trips(spark, sf).join(d, ["ticker", "entry_date"]).filter(F.col("c1").isNotNull())
    return t.groupBy((F.col("c1") > F.col("entry_price")).cast("int").alias("d1_up")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("c1") / F.col("entry_price") - 1).alias("mean_day1"), F.avg(F.col("exit_price") / F.col("c1") - 1).alias("mean_rest"))


FB = "count(*) AS n, {w} AS win, sum(net_pnl) FILTER (net_pnl > 0) / nullif(-sum(net_pnl) FILTER (net_pnl < 0), 0) AS pf_raw, sum(clip) FILTER (clip > 0) / nullif(-sum(clip) FILTER (clip < 0), 0) AS pf_clip, sum(net_pnl) AS net_raw, sum(clip) AS net_clip".format(w=WIN)
FBS = "n:i win:f pf_raw:f pf_clip:f net_raw:f2 net_clip:f2"


@query("I26_feature_breakdown_quantile", f"bucket:i {FBS}",
       f"""WITH s AS (SELECT tight_log AS v, row_number() OVER (ORDER BY tight_log) - 1 AS k, count(*) OVER () AS n FROM trips WHERE tight_log IS NOT NULL),
           c AS (SELECT max(v) FILTER (k = n * 1 // 5) AS c1, max(v) FILTER (k = n * 2 // 5) AS c2, max(v) FILTER (k = n * 3 // 5) AS c3, max(v) FILTER (k = n * 4 // 5) AS c4 FROM s)
           SELECT CASE WHEN tight_log >= c4 THEN 4 WHEN tight_log >= c3 THEN 3 WHEN tight_log >= c2 THEN 2 WHEN tight_log >= c1 THEN 1 ELSE 0 END AS bucket, {FB}
           FROM (SELECT *, qty * entry_price * least(ret, 0.5) AS clip FROM trips), c WHERE tight_log IS NOT NULL GROUP BY 1""")
def feature_quantile(spark, sf):
    return S.feature_breakdown(M.trips(spark, sf), "tight_log", "trip_id", 5)


@query("I26_feature_breakdown_edges_by_year", f"yr:i bucket:i {FBS}",
       f"""SELECT year(entry_date) AS yr, CASE WHEN rvol >= 2 THEN 2 WHEN rvol >= 1.2 THEN 1 ELSE 0 END AS bucket, {FB}
           FROM (SELECT *, qty * entry_price * least(ret, 0.5) AS clip FROM trips) GROUP BY 1, 2""")
def feature_edges(spark, sf):
    return S.feature_breakdown(M.trips(spark, sf).withColumn("yr", F.year("entry_date")), "rvol", "trip_id", edges=[1.2, 2.0], by=["yr"])


@query("I27_per_year_table_of_books", f"label yr:i {SUMS} pnl:f2",
       " UNION ALL ".join(f"SELECT '{n}' AS label, {y} AS yr, {SUM}, sum(net_pnl) AS pnl FROM trips WHERE {w} GROUP BY ALL"
                          for n, w in (("base", "true"), ("rvol2", "rvol >= 2"), ("calm", "pct_up < 0.2")) for y in ("CAST(year(entry_date) AS INT)", "CAST(NULL AS INT)")))
def books_by_year(spark, sf):
    t = M.trips(spark, sf)
    b = S.labelled({"base": t, "rvol2": t.filter("rvol >= 2"), "calm": t.filter("pct_up < 0.2")})
    return S.yearly_table(b, "label", F.year("entry_date"))


@query("I28_split_by_state_at_entry", f"live:i yr:i {SUMS}",
       f"SELECT CAST(max_atr >= 0.15 AS INT) AS live, year(entry_date) AS yr, {SUM} FROM trips GROUP BY 1, 2")
def live_split(spark, sf):
    return M.trips(spark, sf).groupBy((F.col("max_atr") >= 0.15).cast("int").alias("live"), F.year("entry_date").alias("yr")).agg(*S.summary())


@query("I29_nested_quintiles", f"tile2:i {SUMS}",
       f"""SELECT tile2, {SUM} FROM (SELECT *, ntile(4) OVER (ORDER BY max_atr, trip_id) AS tile2 FROM (
             SELECT *, ntile(5) OVER (ORDER BY max_atr, trip_id) AS tile FROM trips) WHERE tile = 5) GROUP BY 1""")
def nested(spark, sf):
    top = S.tiles(M.trips(spark, sf), "max_atr", "trip_id", 5).filter("tile = 5").drop("tile")
    return S.tiles(top, "max_atr", "trip_id", 4, "tile2").groupBy("tile2").agg(*S.summary())


@query("I30_run_summary", "trips:i win:f net:f2 pf:f",
       """SELECT count(*) AS trips, avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END) AS win, sum(net_pnl) AS net,
          sum(net_pnl) FILTER (net_pnl > 0) / nullif(-sum(net_pnl) FILTER (net_pnl < 0), 0) AS pf FROM trips""")
def run_summary(spark, sf):
    return S.run_summary(M.trips(spark, sf))


# ----- K: scalar, date, string and array functions in use -----


@query("K_scalar_functions", "trip_id:i lnx:f ex:f sq:f rounded:i ym q:i dow:i yday:i span:i label ext",
       """SELECT trip_id, ln(entry_price) AS lnx, exp(ret / 10) AS ex, sqrt(abs(ret)) AS sq, CAST(floor(entry_price + 0.5) AS BIGINT) AS rounded,
          strftime(entry_date, '%Y-%m') AS ym, quarter(entry_date) AS q, dayofweek(entry_date) + 1 AS dow, dayofyear(entry_date) AS yday,
          exit_date - entry_date AS span, printf('T%06d', ticker) AS label, regexp_extract(exit_reason, '([a-z]+)', 1) AS ext FROM trips""")
def scalars(spark, sf):
    d = F.col("entry_date")
    return M.trips(spark, sf).withColumns({
        "lnx": F.ln("entry_price"), "ex": F.exp(F.col("ret") / 10), "sq": F.sqrt(F.abs("ret")), "rounded": F.floor(F.col("entry_price") + 0.5),
        "ym": F.date_format(d, "yyyy-MM"), "q": F.quarter(d), "dow": F.dayofweek(d), "yday": F.dayofyear(d),
        "span": F.datediff("exit_date", d), "label": F.format_string("T%06d", "ticker"), "ext": F.regexp_extract("exit_reason", "([a-z]+)", 1)})


@query("K_arrays_and_generated_series", "ticker:i week n:i first_price:f",
       """SELECT ticker, w AS week, count(t.ts) AS n, min(t.price) AS first_price FROM (
            SELECT ticker, CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAY)) AS DATE) AS w FROM (SELECT DISTINCT ticker FROM tape)) g
          LEFT JOIN tape t USING (ticker) WHERE t.date >= w AND t.date < w + 7 GROUP BY 1, 2""")
def arrays(spark, sf):
    t = M.tape(spark, sf)
    starts = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-29").cast("date"), F.expr("interval 7 days"))
    week = F.element_at(F.filter(starts, lambda d: d <= F.col("date")), -1)
    return t.withColumn("week", week).groupBy("ticker", "week").agg(F.count("ts").alias("n"), F.min("price").alias("first_price"))


@query("L_union_all_and_top_k", "source ticker:i pnl:f4",
       """(SELECT 'best' AS source, ticker, sum(net_pnl) AS pnl FROM trips GROUP BY 2 ORDER BY pnl DESC, ticker LIMIT 5)
          UNION ALL (SELECT 'worst', ticker, sum(net_pnl) AS pnl FROM trips GROUP BY 2 ORDER BY pnl, ticker LIMIT 5)""")
def union_top(spark, sf):
    s = M.trips(spark, sf).groupBy("ticker").agg(F.sum("net_pnl").alias("pnl"))
    best = s.orderBy(F.desc("pnl"), "ticker").limit(5).withColumn("source", F.lit("best"))
    return best.unionByName(s.orderBy("pnl", "ticker").limit(5).withColumn("source", F.lit("worst")))


