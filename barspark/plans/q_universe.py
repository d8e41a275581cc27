"""Derived reference tables: adjustment, episodes, candidates, breadth, floats, screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.operators import adjust, universe as U
from barspark.operators.bars import checkpoint_snapshots, lit_trades, market_hours
from barspark.plans import market as M
from barspark.plans.q_joins import BREADTH_SQL
from barspark.plans.registry import query

# The rule, stated on its own: a split counts for all days before it, a dividend scales all days before it by what was
# left of that day's close. A lookup takes the first later date.
LATER_SPLITS = """(SELECT a.ticker, a.execution_date, product(b.split_ratio) AS cum_split_factor
    FROM spl a JOIN spl b ON b.ticker = a.ticker AND b.execution_date >= a.execution_date GROUP BY a.ticker, a.execution_date)"""


def next_split(day: str, alias: str) -> str:
    """The product of the splits after a day, 1 without any."""
    return f"""coalesce((SELECT arg_min(z.cum_split_factor, z.execution_date) FROM {LATER_SPLITS} z
        WHERE z.ticker = {alias}.ticker AND z.execution_date > {alias}.{day}), 1)"""


PAID = f"(SELECT ticker, ex_dividend_date, cash_amount / {next_split('ex_dividend_date', 'paid')} AS adj_cash_amount, {next_split('ex_dividend_date', 'paid')} AS splits FROM divs paid)"
KEPT = f"""(SELECT q.ticker, q.ex_dividend_date, q.adj_cash_amount, CASE WHEN day.close IS NULL THEN 1.0::DOUBLE
    WHEN day.close = 0 THEN 0.000001 ELSE greatest(0.000001, 1 - q.adj_cash_amount * q.splits / day.close) END AS div_factor
    FROM {PAID} q LEFT JOIN daily day ON day.ticker = q.ticker AND day.date = q.ex_dividend_date)"""
LATER_PAID = f"""(SELECT a.ticker, a.ex_dividend_date, any_value(a.div_factor) AS div_factor,
    product(b.div_factor) AS cum_div_factor
    FROM {KEPT} a JOIN {KEPT} b ON b.ticker = a.ticker AND b.ex_dividend_date >= a.ex_dividend_date GROUP BY a.ticker, a.ex_dividend_date)"""


@query("E1_cumulative_split_factor", "ticker:i execution_date cum_split_factor:f", f"SELECT * FROM {LATER_SPLITS}")
def split_factors(spark, sf):
    return adjust.split_factors(M.splits(spark, sf))


@query("E2_split_adjusted_dividends", "ticker:i ex_dividend_date adj_cash_amount:f", f"SELECT * FROM {PAID}")
def adjusted_dividends(spark, sf):
    return adjust.adjusted_dividends(M.dividends(spark, sf), adjust.split_factors(M.splits(spark, sf)))


@query("E3_E4_dividend_factors", "ticker:i ex_dividend_date div_factor:f cum_div_factor:f", f"SELECT * FROM {LATER_PAID}")
def dividend_factors(spark, sf):
    return adjust.dividend_factors(M.dividends(spark, sf), M.daily(spark, sf), adjust.split_factors(M.splits(spark, sf)))


@query("E5_total_return_adjustment",
       "ticker:i date adj_open:f adj_high:f adj_low:f adj_close:f adj_volume:i raw_volume:i",
       f"""SELECT ticker, date, open * k / m AS adj_open, high * k / m AS adj_high, low * k / m AS adj_low, close * k / m AS adj_close,
           CAST(round(volume * m) AS BIGINT) AS adj_volume, volume AS raw_volume FROM (
             SELECT bar.*, {next_split('date', 'bar')} AS m, coalesce((SELECT arg_min(v.cum_div_factor, v.ex_dividend_date)
               FROM {LATER_PAID} v WHERE v.ticker = bar.ticker AND v.ex_dividend_date > bar.date), 1) AS k FROM daily bar)""")
def adjusted(spark, sf):
    return adjust.adjust_prices(M.daily(spark, sf), M.splits(spark, sf), M.dividends(spark, sf))


@query("E6_listing_gap_episodes", "ticker:i date episode:i",
       """SELECT ticker, date, sum(n) OVER (PARTITION BY ticker ORDER BY date) AS episode FROM (SELECT *,
          CASE WHEN date - lag(date) OVER (PARTITION BY ticker ORDER BY date) > 20 THEN 1 ELSE 0 END AS n FROM daily)""")
def episodes(spark, sf):
    """At a 20-day gap, the test series being dense; the production gap is 45 days."""
    return U.with_episodes(M.daily(spark, sf), 20)


CTX = """SELECT *, lag(close) OVER e AS prev_close_, lag(close, 3) OVER e AS close_3d, lag(close, 7) OVER e AS close_7d,
    avg(volume) OVER (PARTITION BY ticker, episode ORDER BY date ROWS 19 PRECEDING) AS avgvol20,
    lead(close, 1) OVER e AS close_fwd_1d, lead(close, 3) OVER e AS close_fwd_3d, lead(close, 5) OVER e AS close_fwd_5d,
    count(*) OVER (PARTITION BY ticker, episode) AS nbars FROM eps WINDOW e AS (PARTITION BY ticker, episode ORDER BY date)"""
LIQ = """SELECT ticker, session, median(volume) FILTER (minute BETWEEN 600 AND 659) AS med_bar_vol,
    count(*) FILTER (minute BETWEEN 600 AND 659) AS nbar, arg_min(open, minute) FILTER (minute BETWEEN 600 AND 659) AS day_open,
    coalesce(sum(volume) FILTER (minute BETWEEN 600 AND 659), 0) AS vol_open,
    sum(volume) FILTER (minute BETWEEN 570 AND 659) AS vol_pm FROM sess GROUP BY 1, 2 HAVING med_bar_vol >= 20 AND nbar >= 10"""
# the candidate day of a session (a supplier's year) is its first bar from minute 660 on
CAND = f"""SELECT * FROM (SELECT c.*, l.session, l.day_open, l.med_bar_vol, l.nbar, l.vol_open, l.vol_pm,
      l.vol_pm / nullif(c.avgvol20, 0) AS rvol_open
    FROM ({CTX}) c JOIN (SELECT ticker, session, arg_min(date, minute) FILTER (minute >= 660) AS date FROM sess GROUP BY 1, 2) k
      USING (ticker, date) JOIN ({LIQ}) l ON l.ticker = c.ticker AND l.session = k.session)
    WHERE close >= 1 AND nbars > 21 AND rvol_open >= 0.1"""
CAND_SPEC = "ticker:i date prev_close:f4 close_3d:f4 close_fwd_5d:f4 avgvol20:f day_open:f4 med_bar_vol:f nbar:i vol_open:i rvol_open:f"


def candidates(spark, sf):
    s = M.sessions(spark, sf)
    liq = U.opening_liquidity(s, ["ticker", "session"], "minute", 600, 660, 570, 20.0, 10)
    day = s.filter("minute >= 660").groupBy("ticker", "session").agg(F.min("date").alias("date"))
    return U.intraday_candidates(M.episodes(spark, sf), liq.join(day, ["ticker", "session"]), 1.0, 21, 0.1)


@query("E7_intraday_candidates", CAND_SPEC, f"SELECT * REPLACE (prev_close_ AS prev_close_), prev_close_ AS prev_close FROM ({CAND})")
def intraday_candidates(spark, sf):
    return candidates(spark, sf)


@query("E8_in_play", "ticker:i date rvol_open:f",
       f"SELECT * FROM ({CAND}) WHERE avgvol20 * prev_close_ >= 700 AND rvol_open > 12")
def in_play(spark, sf):
    return U.in_play(candidates(spark, sf), 700.0, 12.0)


@query("E9_breadth", "date n:i pct_above:f", BREADTH_SQL)
def breadth(spark, sf):
    return U.breadth(M.daily(spark, sf), 700.0)


def _heat(where: str) -> str:
    return f"""SELECT date, heat, avg(heat) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h10 FROM (
      SELECT date, avg(ret) AS heat FROM (SELECT date, ret, percent_rank() OVER (PARTITION BY date ORDER BY ret) AS pr FROM (
        SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret,
          avg(close * volume) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS adv
        FROM daily) WHERE adv >= 500 AND ret IS NOT NULL AND ret <= 10) WHERE {where} GROUP BY date)"""


@query("E10_heat", "date heat:f h10:f", _heat("pr >= 0.9"))
def heat(spark, sf):
    """Mean of the top tenth (production: the top hundredth of a few thousand names)."""
    return U.tail_heat(M.daily(spark, sf), 500.0, share=0.1)


@query("E11_cold", "date heat:f h10:f", _heat("pr <= 0.1"))
def cold(spark, sf):
    return U.tail_heat(M.daily(spark, sf), 500.0, top=False, share=0.1)


@query("E12_smoothed_breadth", "date lag1:f ma5:f ma10:f",
       f"""SELECT date, lag(pct_above) OVER (ORDER BY date) AS lag1,
           avg(pct_above) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ma5,
           avg(pct_above) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ma10 FROM ({BREADTH_SQL})""")
def smoothed_breadth(spark, sf):
    return U.lagged_breadth(U.breadth(M.daily(spark, sf), 700.0))


@query("E13_dollar_float_at_entry", "trip_id:i float_usd:f4 px_period:f4 float_alt:f4 float_at_event:f2",
       """SELECT trip_id, float_usd, px_period, shares * e.close AS float_alt,
            coalesce(CASE WHEN px_period > 0 AND e.close > 0 THEN float_usd * e.close / px_period END, shares * e.close) AS float_at_event
          FROM (SELECT x.*, p.close AS px_period FROM (
              SELECT t.*, f.value AS float_usd, f.period_end FROM trips t ASOF LEFT JOIN flo f
                ON f.ticker = t.ticker AND t.entry_date >= f.known_date) x
              ASOF LEFT JOIN daily p ON p.ticker = x.ticker AND x.period_end >= p.date) y
            ASOF LEFT JOIN shr s ON s.ticker = y.ticker AND y.entry_date >= s.as_of
            LEFT JOIN daily e ON e.ticker = y.ticker AND e.date = y.entry_date""")
def dollar_float(spark, sf):
    return U.dollar_float(M.trips(spark, sf), "ticker", "entry_date", M.floats(spark, sf), M.daily(spark, sf), M.shares(spark, sf))


@query("E14_gap_up_universe", "ticker:i date gap:f prior_high:f4",
       """SELECT * FROM (SELECT ticker, date, open, volume, open / lag(close) OVER w - 1 AS gap,
            max(high) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS prior_high
          FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE gap >= 0.1 AND volume >= 5 AND open > prior_high""")
def gap_up(spark, sf):
    return U.gap_up_universe(M.daily(spark, sf), 0.1, 5, 252)


CONT = """SELECT *, open / lag(close) OVER w - 1 AS gap, (close - low) / nullif(high - low, 0) AS close_in_range,
    lead(open) OVER w / close - 1 AS overnight_ret, lead(close) OVER w / lead(open) OVER w - 1 AS next_day_ret
    FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)"""


@query("E15_continuation_columns", "ticker:i date gap:f close_in_range:f overnight_ret:f next_day_ret:f", CONT)
def continuation(spark, sf):
    return U.continuation_columns(M.daily(spark, sf))


@query("E16_dataset_bands", "band n:i mean_ret:f",
       """SELECT CASE WHEN rvol < 2 THEN 'rvol_lt2' ELSE 'rvol_2_5' END AS band, count(*) AS n, avg(ret) AS mean_ret
          FROM trips WHERE rvol < 5 GROUP BY 1""")
def dataset_bands(spark, sf):
    t = M.trips(spark, sf)
    a = U.band(t, "rvol", None, 2.0).withColumn("band", F.lit("rvol_lt2"))
    b = U.band(t, "rvol", 2.0, 5.0).withColumn("band", F.lit("rvol_2_5"))
    return a.unionByName(b).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))


CPS = [630, 690, 750]


@query("E17_intraday_signal", "ticker:i date checkpoint:i move:f rvol:f fwd_ret:f",
       f"""WITH cp AS (SELECT ticker, session, cp AS checkpoint, sum(volume) AS cum_vol, arg_max(close, minute) AS px, max(date) AS date
            FROM sess JOIN (SELECT unnest({CPS}) AS cp) ON minute <= cp GROUP BY 1, 2, 3),
          cal AS (SELECT date, row_number() OVER (ORDER BY date) AS dnum FROM (SELECT DISTINCT date FROM daily)),
          px AS (SELECT d.*, dnum FROM daily d JOIN cal USING (date))
          SELECT c.ticker, c.date, c.checkpoint, c.px / p.close - 1 AS move,
            c.cum_vol / avg(c.cum_vol) OVER (PARTITION BY c.ticker, c.checkpoint ORDER BY c.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rvol,
            f.open / c.px - 1 AS fwd_ret
          FROM cp c ASOF LEFT JOIN daily p ON p.ticker = c.ticker AND c.date > p.date
          JOIN px cur ON cur.ticker = c.ticker AND cur.date = c.date LEFT JOIN px f ON f.ticker = c.ticker AND f.dnum = cur.dnum + 5""")
def intraday_signal(spark, sf):
    s = M.sessions(spark, sf)
    snap = checkpoint_snapshots(s, ["ticker", "session"], "minute", CPS, 0.0, start=570, rth_open=570)
    # the snapshot's date is that of its last bar
    days = s.select("ticker", "session", "minute", "date")
    last = days
    for c in CPS:
        last = last.withColumn(f"d{c}", F.when(F.col("minute") <= c, F.col("date")))
    last = last.groupBy("ticker", "session").agg(*[F.max(f"d{c}").alias(f"d{c}") for c in CPS])
    d = F.coalesce(*[F.when(F.col("checkpoint") == c, F.col(f"d{c}")) for c in CPS])
    snap = snap.join(last, ["ticker", "session"]).withColumn("date", d).select("ticker", "date", "checkpoint", "cum_vol", "px")
    return U.intraday_signal(snap, M.daily(spark, sf))


FB = """SELECT * FROM (SELECT *, max(atr_i) OVER (PARTITION BY ticker, episode ORDER BY date ROWS 125 PRECEDING) AS max_atr126
    FROM (SELECT ticker, date, episode, close, open, volume, prev_close, atr_now AS atr_i, pct_up,
      (max(high) OVER i14 - min(low) OVER i14) / nullif(avg(tr_lin) OVER i14, 0) AS tightness,
      max(close) OVER (PARTITION BY ticker, episode ORDER BY date ROWS 251 PRECEDING) AS hi_close252,
      avg(volume) OVER (PARTITION BY ticker, episode ORDER BY date ROWS 19 PRECEDING) AS avgvol20,
      count(*) OVER (PARTITION BY ticker, episode) AS nbars,
      row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM feat
      WINDOW i14 AS (PARTITION BY ticker, episode ORDER BY date ROWS 13 PRECEDING)))
    WHERE rn = 1 AND nbars > 21 AND date >= DATE '2001-11-04' - 10"""


def factors(spark, sf):
    return U.factor_base(M.episodes(spark, sf), F.lit("2001-11-04").cast("date"))


@query("E18_factor_base", "ticker:i date tightness:f atr_log:f hi_close252:f4 max_atr126:f avgvol20:f nbars:i",
       f"SELECT *, atr_i AS atr_log FROM ({FB})")
def factor_base(spark, sf):
    return factors(spark, sf)


@query("E19_screen_with_near_misses", "ticker:i gates_passed:i g_move:i g_rvol:i g_tight:i g_near_high:i",
       f"""SELECT * FROM (SELECT *, g_move + g_rvol + g_tight + g_near_high AS gates_passed FROM (SELECT ticker,
            CAST(coalesce(close / prev_close - 1 >= 0, false) AS INT) AS g_move,
            CAST(coalesce(volume / nullif(avgvol20, 0) >= 0.8, false) AS INT) AS g_rvol,
            CAST(coalesce(tightness < 3.5, false) AS INT) AS g_tight,
            CAST(coalesce(close >= 0.3 * hi_close252, false) AS INT) AS g_near_high FROM ({FB}))) WHERE gates_passed >= 2""")
def screen(spark, sf):
    c = F.col("close")
    gates = {"move": c / F.col("prev_close") - 1 >= 0, "rvol": F.col("volume") / F.nullif(F.col("avgvol20"), F.lit(0.0)) >= 0.8,
             "tight": F.col("tightness") < 3.5, "near_high": c >= F.lit(0.3) * F.col("hi_close252")}
    return U.screen(factors(spark, sf), gates, 2)


@query("E20_identity_coverage", "ticker:i last_date cik:i",
       """SELECT d.ticker, last_date, c_custkey AS cik FROM (SELECT ticker, max(date) AS last_date FROM daily GROUP BY 1) d
          LEFT JOIN customer ON c_custkey = d.ticker AND c_acctbal > 0""")
def identity(spark, sf):
    c = M.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("ticker"), F.col("c_custkey").alias("cik"))
    return U.identity_coverage(M.daily(spark, sf), c)


@query("E21_universe_breadth", "period:i median:f share_positive:f n:i",
       """SELECT ts // 3600000000 AS period, median(x) AS median, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS share_positive,
          count(*) AS n FROM (SELECT ts, price - 40 AS x FROM tape) GROUP BY 1""")
def universe_breadth(spark, sf):
    t = M.tape(spark, sf).withColumn("x", F.col("price") - 40.0)
    return U.universe_breadth(t, F.floor(F.col("ts") / 3_600_000_000), "x")


@query("E22_rolling_volatility_percentiles", "ticker:i p10:f p50:f p90:f",
       """SELECT ticker, quantile_cont(vol, 0.1) AS p10, quantile_cont(vol, 0.5) AS p50, quantile_cont(vol, 0.9) AS p90 FROM (
          SELECT ticker, CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w END AS vol FROM (
            SELECT ticker, date, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM daily)
          WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)) WHERE vol IS NOT NULL GROUP BY 1""")
def rolling_vol(spark, sf):
    return U.rolling_volatility_quantiles(M.daily(spark, sf), "ticker", "date", 20, {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query("E23_predicted_rvol", "ticker:i session:i minute:i cum_volume:i pred_rvol:f",
       """WITH tot AS (SELECT ticker, session, sum(volume) AS v FROM sess GROUP BY 1, 2),
          mv AS (SELECT minute, sum(volume) AS v FROM sess GROUP BY 1),
          prof AS (SELECT minute, sum(v) OVER (ORDER BY minute) / (SELECT sum(v) FROM mv) AS frac FROM mv),
          av AS (SELECT ticker, session, avg(v) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a FROM tot)
          SELECT s.ticker, s.session, s.minute, sum(volume) OVER w AS cum_volume,
            CASE WHEN frac > 0 AND a > 0 THEN sum(volume) OVER w / frac / a END AS pred_rvol
          FROM sess s JOIN prof USING (minute) JOIN av ON av.ticker = s.ticker AND av.session = s.session
          WINDOW w AS (PARTITION BY s.ticker, s.session ORDER BY s.minute)""")
def predicted_rvol(spark, sf):
    from pyspark.sql import Window

    s = M.sessions(spark, sf)
    mv = s.groupBy("minute").agg(F.sum("volume").alias("v"))  # one row per minute of day
    one = Window.partitionBy(F.lit(0))
    prof = mv.select("minute", (F.sum("v").over(one.orderBy("minute")) / F.sum("v").over(one)).alias("frac"))
    tot = s.groupBy("ticker", "session").agg(F.sum("volume").alias("v"))
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(-4, -1)
    av = tot.select("ticker", "session", F.avg("v").over(w).alias("avg4"))
    return U.predicted_rvol(s.join(av, ["ticker", "session"]), ["ticker", "session"], "minute", prof, "avg4")


@query("E24_fundamentals_at_date", "ticker:i date avg_volume:f gap:f",
       """SELECT ticker, date, avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS avg_volume,
          open / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS gap FROM daily""")
def fundamentals(spark, sf):
    return U.fundamentals_at(M.daily(spark, sf))


@query("E24_premarket_volume_from_tape", "ticker:i date premarket_volume:i",
       """WITH h AS (SELECT ticker, date, min(ts) FILTER (list_has_any(coalesce(conditions, []), [17, 25])) AS open_ts,
            min(ts) FILTER (list_has_any(coalesce(conditions, []), [19, 8])) AS close_ts FROM tape GROUP BY 1, 2
            HAVING open_ts IS NOT NULL AND close_ts IS NOT NULL)
          SELECT ticker, date, sum(size) FILTER (ts < open_ts AND size > 0 AND trf_id = 0 AND (
            list_has_any(coalesce(conditions, []), [17, 25, 19, 8]) OR NOT list_has_any(coalesce(conditions, []), [32]))) AS premarket_volume
          FROM tape JOIN h USING (ticker, date) GROUP BY 1, 2""")
def premarket_from_tape(spark, sf):
    t = M.tape(spark, sf)
    h = market_hours(t, ["ticker", "date"])
    pre = lit_trades(t).join(h, ["ticker", "date"]).filter("ts < open_ts").groupBy("ticker", "date").agg(F.sum("size").alias("premarket_volume"))
    return h.join(pre, ["ticker", "date"], "left")


@query("E25_continuation_day_n", "ticker:i date breakout_date gap:f close_in_range:f",
       f"""SELECT c.* FROM (SELECT *, lag(date, 2) OVER (PARTITION BY ticker ORDER BY date) AS breakout_date FROM ({CONT})) c
           JOIN (SELECT ticker, entry_date FROM trips) b ON b.ticker = c.ticker AND b.entry_date = c.breakout_date
           WHERE gap >= 0 AND close_in_range >= 0.5""")
def continuation_days(spark, sf):
    b = M.trips(spark, sf).select("ticker", F.col("entry_date").alias("date"))
    return U.continuation_days(M.daily(spark, sf), b, 2, 0.0, 0.5)


