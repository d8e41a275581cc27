"""Rolling, cumulative and session indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import features as X, indicators as I
from barspark.functions.indicators import Series
from barspark.operators import asof as A
from barspark.operators.dyadic import trailing_sums
from barspark.operators.prefix import framed, with_chunks
from barspark.plans import market as M
from barspark.plans.ctes import SE
from barspark.plans.registry import query

D = Series(("ticker",), ("date",))
S = X.SESSION
DW = "PARTITION BY ticker ORDER BY date"


@query("F1_F2_rolling_sum_mean", "ticker:i date s10:i m10:f m10_now:f",
       f"""SELECT ticker, date, sum(volume) OVER x AS s10, avg(close) OVER x AS m10,
           avg(close) OVER ({DW} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m10_now FROM daily
           WINDOW x AS ({DW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def rolling(spark, sf):
    return M.daily(spark, sf).withColumns({
        "s10": I.rolling_sum(D, F.col("volume"), 10), "m10": I.rolling_mean(D, F.col("close"), 10),
        "m10_now": I.rolling_mean(D, F.col("close"), 10, inclusive=True)})


@query("F2_rolling_mean_on_hot_tape", "seq:i m100:f8 hi100:f",
       """SELECT seq, avg(price) OVER w AS m100, max(price) OVER w AS hi100 FROM tape
          WINDOW w AS (PARTITION BY sign ORDER BY ts, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_hot(spark, sf):
    """100-trade frames over two keys that hold the whole tape, evaluated in overlapping blocks."""
    t = with_chunks(M.tape(spark, sf), ["sign"], ["ts", "seq"], M.DAY_US)
    return framed(t, ["sign"], ["ts", "seq"], F.col("__ck"), 100,
                  {"m100": F.avg("price"), "hi100": F.max("price")}, block=1000)


@query("F3_session_vwap", "ticker:i session:i minute:i vs_vwap:f", "SELECT ticker, session, minute, close / vwap - 1 AS vs_vwap FROM sfeat")
def session_vwap(spark, sf):
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    x = M.sessions(spark, sf).withColumn("vwap", I.running_ratio(S, tp * F.col("volume"), F.col("volume")))
    return x.withColumn("vs_vwap", F.col("close") / F.col("vwap") - 1)


@query("F4_rolling_extremes", "ticker:i date hi20:f4 lo20:f4 hi252:f4 lo100_now:f4",
       f"""SELECT ticker, date, max(high) OVER x AS hi20, min(low) OVER x AS lo20,
           max(close) OVER ({DW} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS hi252,
           min(low) OVER ({DW} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS lo100_now
           FROM daily WINDOW x AS ({DW} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def extremes(spark, sf):
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    return I.with_extremes(M.daily(spark, sf), D, {
        "hi20": ("max", h, 20, False), "lo20": ("min", lo, 20, False), "hi252": ("max", c, 252, False),
        "lo100_now": ("min", lo, 100, True)})


@query("F5_running_session_extremes", "ticker:i session:i minute:i hi:f4 lo:f4",
       f"SELECT ticker, session, minute, max(high) OVER w AS hi, min(low) OVER w AS lo FROM sess WINDOW w AS ({SE})")
def running_extremes(spark, sf):
    return M.sessions(spark, sf).withColumns({"hi": I.running_max(S, F.col("high")), "lo": I.running_min(S, F.col("low"))})


@query("F6_lag_and_change", "ticker:i date lag5:f4 chg5:f",
       f"SELECT ticker, date, lag(close, 5) OVER w AS lag5, close / lag(close, 5) OVER w - 1 AS chg5 FROM daily WINDOW w AS ({DW})")
def change(spark, sf):
    return M.daily(spark, sf).withColumns({"lag5": I.lag(D, F.col("close"), 5), "chg5": I.pct_change(D, F.col("close"), 5)})


@query("F7_ema_session", "ticker:i session:i minute:i ema:f", "SELECT ticker, session, minute, ema FROM sfeat")
def ema(spark, sf):
    return I.with_ema(M.sessions(spark, sf), S, F.col("close"), 9, "ema")


@query("F7_ema_long_series", "ticker:i date ema3:f ema20:f",
       f"""SELECT ticker, date, list_reduce(list(close) OVER w, lambda e, x: e + 0.5::DOUBLE * (x - e)) AS ema3,
           list_reduce(list(close) OVER w, lambda e, x: e + (2.0::DOUBLE / 21) * (x - e)) AS ema20
           FROM daily WINDOW w AS ({DW})""")
def ema_long(spark, sf):
    """Whole histories: the 3-bar mean leaves the range of one running sum and runs in blocks."""
    d = I.with_ema(M.daily(spark, sf), D, F.col("close"), 3, "ema3")
    return I.with_ema(d, D, F.col("close"), 20, "ema20")


@query("F8_calendar_mean", "ticker:i date m28:f",
       f"""SELECT ticker, date, avg(volume) OVER ({DW} RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS m28
           FROM daily""")
def calendar_mean(spark, sf):
    return M.daily(spark, sf).withColumn("m28", I.calendar_mean(("ticker",), "date", F.col("volume")))


@query("F9_rolling_ols", "ticker:i session:i minute:i slope:f r2:f",
       f"""SELECT ticker, session, minute, regr_slope(ln(close), idx) OVER w AS slope,
           CASE WHEN count(*) OVER w >= 2 THEN regr_r2(ln(close), idx) OVER w END AS r2 FROM sfeat
           WINDOW w AS ({SE} ROWS 19 PRECEDING)""")
def ols(spark, sf):
    s = M.sessions(spark, sf).withColumn("idx", I.bar_index(S))
    x = I.rolling_ols(s, S, F.ln("close"), F.col("idx"), 20)
    return x.withColumn("r2", F.when(F.col("idx") >= 1, F.col("r2")))


NEW_HI = f"close > coalesce(max(close) OVER ({SE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("F10_bars_since_and_latch", "ticker:i session:i minute:i since:i latch:i",
       f"""SELECT ticker, session, minute, coalesce(i - max(CASE WHEN ev THEN i END) OVER w, -1) AS since,
           coalesce(i - min(CASE WHEN big THEN i END) OVER w, -1) AS latch FROM (
             SELECT *, row_number() OVER ({SE}) AS i, {NEW_HI} AS ev, volume >= 60 AS big FROM sess) WINDOW w AS ({SE})""")
def since(spark, sf):
    s = M.sessions(spark, sf).withColumns({"idx": I.bar_index(S), "p": I.running_max(S, F.col("close"), False)})
    ev = F.col("close") > F.coalesce("p", F.lit(0.0))
    return s.withColumns({"since": I.bars_since(S, ev, F.col("idx")), "latch": I.latch(S, F.col("volume") >= 60, F.col("idx"))})


@query("F11_true_range_atr", "ticker:i date tr_lin:f tr_log:f atr_lin:f atr_log:f",
       "SELECT ticker, date, tr_lin, tr_log, atr_lin, atr_log FROM feat")
def true_range(spark, sf):
    return X.daily_features(M.episodes(spark, sf))


@query("F12_F14_F16_tightness_channels", "ticker:i date tight_log:f tight_lin:f d52_close:f d52_high:f d52_low_close:f d52_low:f max_atr:f",
       "SELECT ticker, date, tight_log, tight_lin, d52_close, d52_high, d52_low_close, d52_low, max_atr FROM feat")
def tightness(spark, sf):
    return X.daily_features(M.episodes(spark, sf))


@query("F13_expansion_tightness", "trip_id:i date exp_tight:f",
       """SELECT trip_id, f.date, greatest(0, f.rng_hi - greatest(f.rng_lo, t.entry_price)) / nullif(f.atr_lin, 0) AS exp_tight
          FROM trips t JOIN feat f ON f.ticker = t.ticker AND f.date = t.exit_date""")
def expansion(spark, sf):
    f = X.daily_features(M.episodes(spark, sf)).select("ticker", F.col("date").alias("exit_date"), "rng_hi", "rng_lo", "atr_lin")
    t = M.trips(spark, sf).select("trip_id", "ticker", "exit_date", "entry_price")
    j = t.join(f, ["ticker", "exit_date"])
    return j.withColumns({"exp_tight": X.expansion_tightness(F.col("entry_price")), "date": F.col("exit_date")})


@query("F15_rvol_dollar_volume_return", "ticker:i date rvol:f ln_avg_dol:f pct_up:f intraday_ret:f",
       "SELECT ticker, date, rvol, ln(avg_dol) AS ln_avg_dol, pct_up, intraday_ret FROM feat")
def rvol(spark, sf):
    return X.daily_features(M.episodes(spark, sf)).withColumn("ln_avg_dol", F.ln("avg_dol"))


TF = f"""(SELECT *, CASE WHEN e_hi_p IS NULL OR ema > e_hi_p THEN idx END AS hi_at, CASE WHEN e_lo_p IS NULL OR ema < e_lo_p THEN idx END AS lo_at,
    CASE WHEN ema_p IS NOT NULL AND close >= ema_p THEN 1 ELSE 0 END AS ab
    FROM (SELECT *, max(ema) OVER ({SE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e_hi_p,
      min(ema) OVER ({SE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e_lo_p FROM sfeat))"""


@query("F17_bars_since_ema_extreme", "ticker:i session:i minute:i bars_since_hi:i bars_since_lo:i",
       f"""SELECT ticker, session, minute, idx - max(hi_at) OVER w AS bars_since_hi, idx - max(lo_at) OVER w AS bars_since_lo
           FROM {TF} WINDOW w AS ({SE})""")
def since_extreme(spark, sf):
    return X.trend_features(X.session_features(M.sessions(spark, sf)))


@query("F18_F19_above_ema_and_volume_climb", "ticker:i session:i minute:i above6:i vol_climb:f",
       f"""SELECT ticker, session, minute, sum(ab) OVER ({SE} ROWS 5 PRECEDING) AS above6,
           (vol_ema - min(vol_ema) OVER ({SE} ROWS 19 PRECEDING)) / vol_ema AS vol_climb FROM {TF}""")
def above_climb(spark, sf):
    return X.trend_features(X.session_features(M.sessions(spark, sf)))


RUN = f"""(SELECT *, sum(CASE WHEN bl THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, session, isl ORDER BY minute) AS run_len FROM (
    SELECT *, sum(chg) OVER ({SE}) AS isl FROM (SELECT *, CASE WHEN bl IS DISTINCT FROM lag(bl) OVER ({SE}) AND idx > 0 THEN 1 ELSE 0 END AS chg
      FROM (SELECT *, coalesce(ema_p < vwap_p, false) AS bl FROM sfeat))))"""
RUNF = f"""(SELECT *, coalesce(lag(run_len) OVER ({SE}), 0) AS run_len_p,
    min(CASE WHEN bl THEN ema_p END) OVER w AS run_ema_edge, coalesce(max(CASE WHEN bl THEN (vwap_p - ema_p) / vwap_p END) OVER w, 0) AS run_depth,
    avg(CASE WHEN bl THEN tr_log END) OVER w AS run_atr, avg(CASE WHEN bl AND close > ema_p THEN volume END) OVER w AS run_up_vol,
    avg(CASE WHEN bl AND close < ema_p THEN volume END) OVER w AS run_dn_vol,
    sum(CASE WHEN bl THEN 1 ELSE 0 END) OVER fp / nullif(sum(CASE WHEN ema_p IS NOT NULL THEN 1 ELSE 0 END) OVER fp, 0) AS below_frac_p
    FROM {RUN} WINDOW w AS (PARTITION BY ticker, session, isl ORDER BY minute),
      fp AS ({SE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("F20_runs_below_vwap", "ticker:i session:i minute:i run_len:i run_len_p:i below_frac_p:f run_depth:f run_atr:f run_ema_edge:f run_up_vol:f run_dn_vol:f",
       f"SELECT * FROM {RUNF}")
def vwap_runs(spark, sf):
    return X.vwap_run_features(X.session_features(M.sessions(spark, sf)))


@query("F21_above_ema_run_slope", "ticker:i session:i minute:i run_slope:f",
       f"""SELECT ticker, session, minute, CASE WHEN ab = 1 THEN regr_slope(ln(close), idx) OVER (PARTITION BY ticker, session, isl ORDER BY minute) END AS run_slope
           FROM (SELECT *, sum(chg) OVER ({SE}) AS isl FROM (SELECT *, CASE WHEN ab IS DISTINCT FROM lag(ab) OVER ({SE}) AND idx > 0 THEN 1 ELSE 0 END AS chg FROM {TF}))""")
def run_slope(spark, sf):
    x = X.trend_features(X.session_features(M.sessions(spark, sf)))
    x = I.islands(x, S, F.col("above") == 1, "isl")
    slope = F.regr_slope(F.ln("close"), F.col("idx")).over(S.sub("isl").sofar())
    return x.withColumn("run_slope", F.when(F.col("above") == 1, slope))


@query("F22_up_down_volume_windows", "ticker:i session:i minute:i updn_10:f updn_20:f updn_30:f",
       "SELECT ticker, session, minute, " + ", ".join(
           f"""avg(CASE WHEN close > ema_p THEN volume END) OVER ({SE} ROWS {n - 1} PRECEDING) /
           nullif(avg(CASE WHEN close < ema_p THEN volume END) OVER ({SE} ROWS {n - 1} PRECEDING), 0) AS updn_{n}""" for n in (10, 20, 30))
       + " FROM sfeat")
def updn(spark, sf):
    return X.session_features(M.sessions(spark, sf)).withColumns(X.up_down_volume(S, [10, 20, 30]))


@query("F23_pace_features", "ticker:i session:i minute:i bar_rvol:f rvol5:f rvol5_open:f",
       f"""SELECT ticker, session, minute, volume / (av / 390) AS bar_rvol, avg(volume) OVER w5 / (av / 390) AS rvol5,
           avg(volume) OVER w5 / nullif(avg(CASE WHEN idx < 15 THEN volume END) OVER ({SE}), 0) AS rvol5_open
           FROM (SELECT *, avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS av,
             row_number() OVER ({SE}) - 1 AS idx FROM sess) WINDOW w5 AS ({SE} ROWS 4 PRECEDING)""")
def pace(spark, sf):
    s = M.sessions(spark, sf).withColumns({"av": I.rolling_mean(D, F.col("volume"), 20)}).withColumn("idx", I.bar_index(S))
    return s.withColumns(X.pace_features("av", S))


@query("F24_trailing_imbalance", "seq:i imb:f",
       f"""SELECT seq, (sum(CASE WHEN sign > 0 THEN size ELSE 0 END) OVER w - sum(CASE WHEN sign < 0 THEN size ELSE 0 END) OVER w)
           / nullif(sum(size) OVER w, 0) AS imb FROM tape WINDOW w AS (PARTITION BY ticker ORDER BY ts RANGE BETWEEN {M.DAY_US * 3 - 1} PRECEDING AND CURRENT ROW)""")
def imbalance(spark, sf):
    """Flows are whole numbers, summed per instant first; no frame slides over trades and no history is subtracted."""
    flow = lambda k: F.sum(F.when(F.col("sign") == k, F.col("size")).otherwise(0)).cast("long")
    t = M.tape(spark, sf)
    at = trailing_sums(t.groupBy("ticker", "ts").agg(flow(1).alias("b"), flow(-1).alias("s")), ["ticker"], "ts", ["b", "s"], 3 * M.DAY_US)
    b, s = F.col("b"), F.col("s")
    return t.select("seq", "ticker", "ts").join(at, ["ticker", "ts"]).withColumn("imb", F.when(b + s > 0, (b - s) / (b + s)))


@query("F26_past_runner", "ticker:i date max_adr14:f max_atr14:f max_ret14:f",
       f"""SELECT ticker, date, max(adr14) OVER w AS max_adr14, max(atr14) OVER w AS max_atr14, max(ret14) OVER w AS max_ret14 FROM (
           SELECT *, avg(high / low - 1) OVER i14 AS adr14, avg(greatest(high, coalesce(pc, high)) - least(low, coalesce(pc, low))) OVER i14 / close AS atr14,
             close / lag(close, 14) OVER ({DW}) - 1 AS ret14 FROM (SELECT *, lag(close) OVER ({DW}) AS pc FROM daily)
           WINDOW i14 AS ({DW} ROWS 13 PRECEDING)) WINDOW w AS ({DW} ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)""")
def past_runner(spark, sf):
    return X.past_runner(M.daily(spark, sf))


@query("F27_up_streaks", "ticker:i date up_streak:i d1_up:i d2_up:i",
       f"""SELECT ticker, date, CASE WHEN NOT coalesce(close > p1, false) THEN 0 WHEN NOT coalesce(p1 > p2, false) THEN 1
           WHEN NOT coalesce(p2 > p3, false) THEN 2 WHEN NOT coalesce(p3 > p4, false) THEN 3 WHEN NOT coalesce(p4 > p5, false) THEN 4 ELSE 5 END AS up_streak,
           CAST(n1 > close AS INT) AS d1_up, CAST(n2 > n1 AS INT) AS d2_up FROM (SELECT *, {", ".join(f"lag(close, {k}) OVER w AS p{k}" for k in range(1, 6))},
             lead(close) OVER w AS n1, lead(close, 2) OVER w AS n2 FROM daily WINDOW w AS ({DW}))""")
def streaks(spark, sf):
    c = F.col("close")
    n1, n2 = I.lead(D, c), I.lead(D, c, 2)
    x = X.up_streak(M.daily(spark, sf), D, c).withColumn("up_streak", F.least("up_streak", F.lit(5)))  # 5 stands for 5 and more
    return x.withColumns({"d1_up": (n1 > c).cast("int"), "d2_up": (n2 > n1).cast("int")})


@query("F28_candle_shape", "ticker:i date body_frac:f open_pos:f close_pos:f",
       """SELECT ticker, date, abs(close - open) / nullif(high - low, 0) AS body_frac, (open - low) / nullif(high - low, 0) AS open_pos,
          (close - low) / nullif(high - low, 0) AS close_pos FROM daily""")
def candle(spark, sf):
    return M.daily(spark, sf).withColumns(X.candle_shape())


@query("F29_depth_references", "ticker:i date vs_mean_60:f chg_60:f vs_mean_90:f vs_mean_120:f chg_120:f",
       "SELECT ticker, date, " + ", ".join(
           f"close / avg(close) OVER ({DW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) - 1 AS vs_mean_{n}, close / lag(close, {n}) OVER ({DW}) - 1 AS chg_{n}"
           for n in (60, 90, 120)) + " FROM daily")
def depth(spark, sf):
    return M.daily(spark, sf).withColumns(X.depth_references(D, F.col("close")))


@query("F31_window_arrays", "ticker:i session:i minute:i first:f4 last:f4 n_mask:i far:f4",
       f"""SELECT ticker, session, minute, coalesce(lag(close, 5) OVER w, 0) AS first, coalesce(lead(close, 2) OVER w, 0) AS last,
           count(*) OVER ({SE} ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n_mask, coalesce(lag(close, 30) OVER w, 0) AS far
           FROM sess WINDOW w AS ({SE})""")
def window_arrays(spark, sf):
    x = I.window_arrays(M.sessions(spark, sf), S, ["close"], 5, 2, "w")
    x = I.strided_picks(x, S, "close", {"coarse": (10, 3)})
    return x.withColumns({"first": F.get("w_close", F.lit(0)), "last": F.get("w_close", F.lit(7)),
                          "n_mask": F.aggregate("w_mask", F.lit(0.0), lambda a, b: a + b), "far": F.get("coarse", F.lit(0))})
