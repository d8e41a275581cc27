"""Event detectors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barspark.functions import features as X
from barspark.functions.indicators import Series
from barspark.operators import chains as C, detect as T
from barspark.operators.universe import breadth, lagged_breadth
from barspark.plans import market as M
from barspark.plans.ctes import EP, SE
from barspark.plans.q_joins import BREADTH_SQL
from barspark.plans.registry import query

S = X.SESSION
DAY = Series(("ticker", "episode"), ("date",))
EV = "ticker:i session:i minute:i close:f4"


def core(spark, sf):
    return X.session_features(M.sessions(spark, sf))


def trend(spark, sf):
    return X.trend_features(X.session_features(M.session_context(M.sessions(spark, sf))))


@query("G1_daily_breakout_production_gates", "ticker:i date pct_up:f rvol:f tight_log:f",
       """SELECT ticker, date, pct_up, rvol, tight_log FROM feat WHERE pct_up >= 0.1 AND pct_up < 0.3 AND rvol >= 1.5
          AND bars_seen > 21 AND avg_dol >= 300 AND close >= 0.95 * hi_close AND close >= 1 AND tight_log < 4.5
          AND atr_log < 0.5 AND intraday_ret >= -0.07 AND max_atr >= 0.04
          UNION ALL SELECT ticker, date, pct_up, rvol, tight_log FROM feat WHERE pct_up >= 0.05 AND pct_up < 0.5 AND rvol >= 1.0
          AND bars_seen > 21 AND avg_dol >= 300 AND close >= 0.3 * hi_high AND close >= 1 AND tight_log < 4.5
          AND atr_log < 0.5 AND intraday_ret >= -0.07 AND max_atr >= 0.04""")
def breakout(spark, sf):
    """Both channel variants: the closing high and, looser, the intraday high."""
    x = X.daily_features(M.episodes(spark, sf))
    a = T.Breakout(rvol_min=1.5, min_dollar=300.0, max_atr=0.5)
    b = T.Breakout(up=0.05, up_max=0.5, rvol_min=1.0, min_dollar=300.0, max_atr=0.5, near_high=0.3, use_high=True)
    cols = ["ticker", "date", "pct_up", "rvol", "tight_log"]
    return x.filter(a.fires()).select(*cols).unionByName(x.filter(b.fires()).select(*cols))


@query("G2_breakout_on_partial_candle", "ticker:i date entry_price:f4 pct_up:f rvol:f",
       """SELECT ticker, date, c AS entry_price, c / prev_close - 1 AS pct_up, v / avg_vol AS rvol FROM (
          SELECT *, floor((open + close) / 2 * 1e4 + 0.5) / 1e4 AS c, volume // 2 AS v FROM feat WHERE volume % 5 <> 0)
          WHERE c / prev_close - 1 >= 0.05 AND c / prev_close - 1 < 3 AND v / avg_vol >= 0.4 AND bars_seen > 21 AND avg_dol >= 100
          AND c >= 0.1 * hi_close AND c >= 1 AND tight_log < 50 AND atr_log < 5 AND c / open - 1 >= -0.2 AND max_atr >= 0.01""")
def partial_breakout(spark, sf):
    """Entries judged on a half-day candle; every fifth day has none and takes no entry."""
    x = X.daily_features(M.episodes(spark, sf))
    mid = F.floor((F.col("open") + F.col("close")) / 2 * 1e4 + 0.5) / 1e4
    candle = M.daily(spark, sf).filter("volume % 5 <> 0").select(
        "ticker", "date", "open", "high", "low", mid.alias("close"), F.floor(F.col("volume") / 2).alias("volume"))
    e = T.with_entry_candle(x, candle)
    return e.filter(replace(M.LOOSE, rvol_min=0.4).fires()).withColumn("entry_price", F.col("close"))


WASH = T.Washout(up=-0.9, up_max=-0.05, vol_frac=(0.1, 1.5), max_3d=-0.05, max_prior2d=0.2, max_60d=0.1, rvol_max=3.0, min_dollar=100.0,
                 max_tight=50.0, atr=(0.01, 5.0), breadth_max=0.45)


def _wash_sql(extreme: str, rets: str, extra: str = "") -> str:
    return f"""SELECT ticker, f.date, close, chg_3d, chg_60d, b.lag1 AS breadth_lag1 FROM (
      SELECT *, min(close) OVER w7 AS low_n, max(close) OVER w7 AS high_n, max(volume) OVER w7 AS vol_max_n,
        close / lag(close, 3) OVER w - 1 AS chg_3d, close / lag(close, 60) OVER w - 1 AS chg_60d,
        lag(close) OVER w / lag(close, 3) OVER w - 1 AS prior_2d, lag(close, 3) OVER w AS c3, lag(close, 2) OVER w AS c2,
        lag(close) OVER w AS c1 FROM feat
      WINDOW w AS ({EP}), w7 AS ({EP} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) f
      LEFT JOIN (SELECT date, lag(pct_above) OVER (ORDER BY date) AS lag1 FROM ({BREADTH_SQL})) b ON b.date = f.date
    WHERE {extreme} AND {rets} AND vol_max_n > 0 AND volume >= 0.1 * vol_max_n AND volume <= 1.5 * vol_max_n
      AND rvol <= 3 AND bars_seen > 21 AND avg_dol >= 100 AND close >= 1 AND tight_log < 50 AND atr_log >= 0.01 AND atr_log < 5 {extra}"""


def washed(spark, sf, cfg):
    x = X.daily_features(M.episodes(spark, sf)).withColumns(cfg.features(DAY))
    b = lagged_breadth(breadth(M.daily(spark, sf), 700.0)).select("date", F.col("lag1").alias("breadth_lag1"))
    return x.join(b, "date", "left").filter(cfg.fires())


@query("G3_washout_reversal", "ticker:i date close:f4 chg_3d:f chg_60d:f breadth_lag1:f",
       _wash_sql("close <= low_n", "pct_up >= -0.9 AND pct_up < -0.05 AND chg_3d <= -0.05 AND prior_2d <= 0.2 AND chg_60d <= 0.1",
                 "AND lag1 < 0.45"))
def washout(spark, sf):
    return washed(spark, sf, WASH)


@query("G3_washout_mirror_monotone", "ticker:i date close:f4 chg_3d:f chg_60d:f breadth_lag1:f",
       _wash_sql("close >= high_n", "pct_up >= 0.02 AND pct_up < 9 AND chg_3d <= 99 AND prior_2d <= 99 AND chg_60d <= 99",
                 "AND c3 > c2 AND c2 > c1"))
def washout_mirror(spark, sf):
    return washed(spark, sf, replace(WASH, mirror=True, up=0.02, up_max=9.0, max_3d=99.0, max_prior2d=99.0, max_60d=99.0, monotone=True,
                                     breadth_max=None))


@query("G4_session_low_break", EV + " vol_vs_hi:f",
       """SELECT * FROM sfeat WHERE minute >= 585 AND close < sess_loc_p AND volume >= 0.9 * vol_hi_p AND tight_p IS NOT NULL
          AND atr_log_p IS NOT NULL""")
def session_low(spark, sf):
    return core(spark, sf).filter(T.SessionExtreme().fires())


@query("G4_session_high_wick_break_with_flush", EV + " vol_vs_hi:f",
       """SELECT * FROM sfeat WHERE minute >= 585 AND high > sess_hi_p AND volume > vol_hi_p AND tight_p < 6 AND atr_log_p < 1
          AND close / prev_close - 1 >= 0.02 AND close / prev_close - 1 <= 5""")
def session_high(spark, sf):
    cfg = T.SessionExtreme(downside=False, use_close=False, wick=True, vol_frac=1.0, flush=-0.02, flush_floor=-5.0, max_tight=6.0, max_atr=1.0)
    return core(spark, sf).filter(cfg.fires())


@query("G6_vwap_reclaim", EV + " run_len_p:i stop_level:f",
       """SELECT *, coalesce(run_low, sess_lo) AS stop_level FROM runs WHERE minute BETWEEN 600 AND 810 AND ema_p <= vwap_p AND ema > vwap
          AND run_len_p >= 3 AND tight_p >= 1.5""")
def vwap_reclaim(spark, sf):
    x = X.vwap_run_features(core(spark, sf))
    cfg = T.VwapReclaim(min_run=3, min_tight=1.5)
    return x.filter(cfg.fires()).withColumn("stop_level", cfg.stop_level())


@query("G7_vwap_loss_mirrored", EV + " run_len_p:i",
       f"""SELECT * FROM (SELECT *, coalesce(lag(CASE WHEN ab THEN n ELSE 0 END) OVER ({SE}), 0) AS run_len_p FROM (
             SELECT *, count(*) OVER (PARTITION BY ticker, session, g ORDER BY minute) AS n FROM (
               SELECT *, sum(CASE WHEN ab IS DISTINCT FROM pab AND idx > 0 THEN 1 ELSE 0 END) OVER ({SE}) AS g FROM (
                 SELECT *, lag(ab) OVER ({SE}) AS pab FROM (SELECT *, coalesce(ema_p > vwap_p, false) AS ab FROM sfeat)))))
           WHERE minute BETWEEN 600 AND 810 AND ema_p >= vwap_p AND ema < vwap AND run_len_p >= 3 AND tight_p >= 1.5 AND atr_log_p < 0.9""")
def vwap_loss(spark, sf):
    x = X.vwap_run_features(core(spark, sf), mirror=True)
    return x.filter(T.VwapReclaim(min_run=3, min_tight=1.5, max_atr=0.9, mirror=True).fires())


@query("G8_dip_rebreak", EV + " below_n_p:i",
       """SELECT * FROM eruns WHERE minute BETWEEN 600 AND 810 AND close >= prev_high * (1 + 0.1 * atr_log_p) AND below_n_p >= 2
          AND below_n_p < 8 AND close / sess_open - 1 >= 0.02 AND tight_p >= 1.5""")
def dip_rebreak(spark, sf):
    cfg = T.DipRebreak(atr_mult=0.1, min_below=2, min_tight=1.5)
    return X.ema_run_features(core(spark, sf)).filter(cfg.fires())


@query("G9_dip_run_modes", EV + " mode",
       """SELECT *, 'into_run' AS mode FROM eruns WHERE minute BETWEEN 600 AND 810 AND above_n_p = 2
          UNION ALL SELECT *, 'pullback' FROM eruns WHERE minute BETWEEN 600 AND 810 AND below_n_p = 3 AND saved_run_p >= 2
          UNION ALL SELECT *, 'reclaim' FROM eruns WHERE minute BETWEEN 600 AND 810 AND below_n_p >= 1 AND close > ema_p
            AND since_break_p >= 1 AND since_break_p >= 0 AND since_break_p < 5
          UNION ALL SELECT *, 'rebreak' FROM eruns WHERE minute BETWEEN 600 AND 810 AND below_n_p >= 1 AND close >= prev_high * (1 + 0.5 * atr_log_p)""")
def dip_run(spark, sf):
    """All four entry modes in one pass over the features."""
    x = X.ema_run_features(core(spark, sf))
    cfgs = [T.DipRun("into_run", 2), T.DipRun("pullback", 3, min_run=2), T.DipRun("reclaim", since_break=(1, 5)), T.DipRun("rebreak")]
    hit = F.array_compact(F.array(*[F.when(c.fires(), F.lit(c.mode)) for c in cfgs]))
    return x.withColumn("mode", F.explode(hit))


MOM = T.Momentum(min_slope=0.0, min_atr=0.05, min_tight=1.5, min_above6=3, min_ema_vs_vwap=-0.05, max_rvol5=1.5, min_chg1d=-0.2, min_chg3d=-0.3)


def momentum_inputs(x):
    w = S.spec()
    return x.withColumns({"above6_p": F.lag("above6").over(w), "vol5_p": F.lag("vol5").over(w)})


MOM_SQL = f"""(SELECT *, minute BETWEEN 600 AND 810 AND slope_p > 0 AND atr_log_p >= 0.05 AND tight_p >= 1.5 AND above6_p >= 3
    AND ema_p / vwap_p - 1 >= -0.05 AND coalesce(vol5_p < 1.5 * permin, true) AND close / close_1d - 1 >= -0.2
    AND coalesce(close / close_3d - 1 >= -0.3, true) AS fires
    FROM (SELECT *, lag(above6) OVER ({SE}) AS above6_p, lag(vol5) OVER ({SE}) AS vol5_p FROM tfeat))"""


@query("G10_trailing_momentum", EV + " slope_p:f", f"SELECT * FROM {MOM_SQL} WHERE fires")
def momentum(spark, sf):
    return momentum_inputs(trend(spark, sf)).filter(MOM.fires())


TRIP = "ticker:i session:i entry_at:i entry_price:f4 exit_at:i exit_price:f4 exit_reason reported"


@query("G11_momentum_with_shadow_slots", TRIP,
       f"""WITH RECURSIVE x AS (SELECT *, coalesce(fires, false) AS trig, coalesce(vol_climb >= 0.3, false) AS quality,
             close - (close - lowc) * 2 / 3 AS stop_level FROM (SELECT *, min(close) OVER ({SE}) AS lowc FROM {MOM_SQL})),
           c AS (SELECT e.ticker, e.session, e.idx AS ei, e.minute AS em, e.close AS epx, e.quality,
             min(CASE WHEN b.close <= e.stop_level OR b.minute >= 960 THEN b.idx END) AS xi, max(b.idx) AS li
             FROM x e LEFT JOIN x b ON b.ticker = e.ticker AND b.session = e.session AND b.idx > e.idx
             WHERE e.trig GROUP BY 1, 2, 3, 4, 5, 6),
           r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, session ORDER BY ei) AS rn FROM c) WHERE rn = 1
             UNION ALL SELECT * EXCLUDE (k) FROM (SELECT c.*, CAST(1 AS BIGINT) AS rn, row_number() OVER (PARTITION BY c.ticker, c.session ORDER BY c.ei) AS k
               FROM r JOIN c ON c.ticker = r.ticker AND c.session = r.session AND c.ei >= r.xi) WHERE k = 1)
           SELECT r.ticker, r.session, em AS entry_at, epx AS entry_price, CASE WHEN xi IS NULL THEN coalesce(lb.minute, em) ELSE xb.minute END AS exit_at,
             CASE WHEN xi IS NULL THEN coalesce(lb.close, epx) ELSE xb.close END AS exit_price,
             CASE WHEN xi IS NULL THEN 'moc' ELSE 'stop' END AS exit_reason, CAST(quality AS VARCHAR) AS reported
           FROM r LEFT JOIN sfeat xb ON xb.ticker = r.ticker AND xb.session = r.session AND xb.idx = xi
           LEFT JOIN sfeat lb ON lb.ticker = r.ticker AND lb.session = r.session AND lb.idx = li""")
def shadow_slots(spark, sf):
    """One position per session; a trigger without volume still takes the slot and is not reported."""
    x = momentum_inputs(trend(spark, sf)).withColumn("lowc", F.min("close").over(S.sofar()))
    x = x.withColumns({"trigger": MOM.fires(), "quality": F.coalesce(F.col("vol_climb") >= 0.3, F.lit(False)),
                       "stop_level": F.col("close") - (F.col("close") - F.col("lowc")) * 2 / 3})
    t = C.one_at_a_time(x, S, F.col("trigger"), carry=("quality",))
    return t.withColumn("reported", F.col("quality").cast("string"))


@query("G12_F30_breakout_timer_and_pullback", "ticker:i session:i minute:i timer:i bars_since_high:i pb_updn:f pb_depth:f pb_atr:f",
       """WITH RECURSIVE x AS (SELECT * FROM tfeat),
          r AS (SELECT ticker, session, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS minute, -1 AS timer, 0 AS since, 0.0::DOUBLE AS up,
              0 AS nu, 0.0::DOUBLE AS dn, 0 AS nd, 0.0::DOUBLE AS depth, 0.0::DOUBLE AS atr, 0 AS na FROM (SELECT DISTINCT ticker, session FROM x)
            UNION ALL
            SELECT ticker, session, idx, minute, t2, CASE WHEN new_hi THEN 0 ELSE since + 1 END,
              CASE WHEN rs THEN 0 ELSE up END + CASE WHEN close >= ema_p THEN volume ELSE 0 END,
              CASE WHEN rs THEN 0 ELSE nu END + CASE WHEN close >= ema_p THEN 1 ELSE 0 END,
              CASE WHEN rs THEN 0 ELSE dn END + CASE WHEN close < ema_p THEN volume ELSE 0 END,
              CASE WHEN rs THEN 0 ELSE nd END + CASE WHEN close < ema_p THEN 1 ELSE 0 END,
              greatest(CASE WHEN rs THEN 0 ELSE depth END, ema_hi / ema - 1),
              CASE WHEN rs THEN 0 ELSE atr END + coalesce(atr_log, 0), CASE WHEN rs THEN 0 ELSE na END + CASE WHEN atr_log IS NULL THEN 0 ELSE 1 END
            FROM (SELECT x.ticker, x.session, x.idx, x.minute, x.new_hi, x.close, x.ema_p, x.volume, x.ema_hi, x.ema, x.atr_log,
                r.since, r.up, r.nu, r.dn, r.nd, r.depth, r.atr, r.na,
                CASE WHEN x.new_hi AND r.since >= 8 THEN 5 WHEN r.timer > 0 THEN r.timer - 1 ELSE r.timer END AS t2,
                CASE WHEN x.new_hi AND r.since >= 8 THEN false WHEN r.timer > 0 THEN r.timer = 1 ELSE x.new_hi END AS rs
              FROM r JOIN x ON x.ticker = r.ticker AND x.session = r.session AND x.idx = r.idx + 1))
          SELECT ticker, session, minute, timer, since AS bars_since_high,
            CASE WHEN nu > 0 AND nd > 0 AND dn > 0 THEN (up / nu) / (dn / nd) END AS pb_updn, depth AS pb_depth,
            CASE WHEN na > 0 THEN atr / na END AS pb_atr FROM r WHERE idx >= 0""")
def breakout_timer(spark, sf):
    return C.timed_pullback(trend(spark, sf), S, drought=8, bars=5)


def armed(spark, sf, rearm):
    ok = F.col("minute").between(600, 810) & (F.col("atr_log") >= 0.05)
    return C.rearmed(trend(spark, sf), S, ok, within=6, floors=(0.0, 1.0 / 3.0, 0.5), rearm=rearm, min_stop=0.02)


ARM_EXIT = """SELECT t.ticker, t.session, t.minute AS entry_at, t.close AS entry_price, coalesce(xb.minute, lb.minute, t.minute) AS exit_at,
    coalesce(xb.close, lb.close, t.close) AS exit_price, CASE WHEN xi IS NULL THEN 'moc' ELSE 'stop' END AS exit_reason, t.stop_level
  FROM (SELECT e.ticker, e.session, e.idx, e.minute, e.close, e.stop_level, min(CASE WHEN b.ema < e.stop_level OR b.minute >= 960 THEN b.idx END) AS xi,
      max(b.idx) AS li FROM ent e LEFT JOIN sfeat b ON b.ticker = e.ticker AND b.session = e.session AND b.idx > e.idx GROUP BY 1, 2, 3, 4, 5, 6) t
  LEFT JOIN sfeat xb ON xb.ticker = t.ticker AND xb.session = t.session AND xb.idx = xi
  LEFT JOIN sfeat lb ON lb.ticker = t.ticker AND lb.session = t.session AND lb.idx = li"""


def _armed_sql(ref: str, within: int = 6) -> str:
    step = lambda k, new: f"CASE WHEN r.{k} >= 0 THEN r.{k} + 1 WHEN x.{new} THEN 0 ELSE -1 END"
    return f"""WITH RECURSIVE x AS (SELECT *, coalesce(minute BETWEEN 600 AND 810 AND atr_log >= 0.05, false) AS ok,
        (close - ema_low20) / close >= 0.02 AS far FROM tfeat),
      r AS (SELECT ticker, session, CAST(-1 AS BIGINT) AS idx, true AS armed, -1 AS a, -1 AS b, -1 AS c, false AS fired, NULL::DOUBLE AS ls
          FROM (SELECT DISTINCT ticker, session FROM x)
        UNION ALL
        SELECT ticker, session, idx, CASE WHEN fire THEN false WHEN re THEN true ELSE armed END, CASE WHEN NOT fire AND re THEN -1 ELSE a END,
          CASE WHEN NOT fire AND re THEN -1 ELSE b END, CASE WHEN NOT fire AND re THEN -1 ELSE c END, fire, CASE WHEN fire THEN ema_low20 ELSE ls END
        FROM (SELECT *, armed AND ok AND ((a >= 0 AND a < {within}) OR (b >= 0 AND b < {within} AND vol_climb >= 1.0 / 3)
              OR (c >= 0 AND c < {within} AND vol_climb >= 0.5)) AS fire, coalesce(ema < {ref}, false) AS re
          FROM (SELECT x.ticker, x.session, x.idx, x.ok, x.vol_climb, x.ema, x.ema_low20, x.ema_low20_p, x.ema_lo_p, r.armed, r.ls,
              {step("a", "new_hi")} AS a, {step("b", "new_hi60")} AS b, {step("c", "new_hi20")} AS c
            FROM r JOIN x ON x.ticker = r.ticker AND x.session = r.session AND x.idx = r.idx + 1))),
      ent AS (SELECT x.*, x.ema_low20 AS stop_level FROM r JOIN x USING (ticker, session, idx) WHERE fired AND far AND x.ema_low20 < x.ema)
      {ARM_EXIT}"""


ARM = "ticker:i session:i entry_at:i entry_price:f4 exit_at:i exit_price:f4 exit_reason stop_level:f"


@query("G13_armed_breakout_rolling_rearm", ARM, _armed_sql("ema_low20_p"))
def armed_rolling(spark, sf):
    return armed(spark, sf, "rolling")


@query("G13_armed_breakout_session_rearm", ARM, _armed_sql("ema_lo_p"))
def armed_session(spark, sf):
    return armed(spark, sf, "session")


@query("G13_armed_breakout_last_stop_rearm", ARM, _armed_sql("ls"))
def armed_last_stop(spark, sf):
    return armed(spark, sf, "last_stop")


def _fade_sql(entry: str, legs: int) -> str:
    """Leg by leg: where it starts to wait, the bar it enters on, the bar it ends on."""
    out, ctes, start = [], ["w0 AS (SELECT ticker, session, idx AS si, idx AS wi FROM tfeat WHERE minute >= 585 AND close > sess_hic_p AND atr_log_p >= 0.05)"], 0
    waits = {"down_tick": "b.idx > w.wi AND b.ema < b.ema_p", "bars_since": "b.idx >= w.wi AND b.bars_since_hi = 3",
             "cross": "b.idx > w.wi AND b.idx <= w.wi + 60 AND b.ema < a.ema"}[entry]
    for k in range(legs):
        ctes.append(f"""n{k} AS (SELECT w.ticker, w.session, w.si, min(b.idx) AS ei FROM w{k} w JOIN tfeat a ON a.ticker = w.ticker AND a.session = w.session AND a.idx = w.wi
          JOIN tfeat b ON b.ticker = w.ticker AND b.session = w.session AND {waits} GROUP BY ALL)""")
        ctes.append(f"""x{k} AS (SELECT n.ticker, n.session, n.si, e.idx, e.minute, e.close, e.ema_hi, min(CASE WHEN b.ema > e.ema_hi OR b.minute >= 960 THEN b.idx END) AS xi,
          max(b.idx) AS li FROM n{k} n JOIN tfeat e ON e.ticker = n.ticker AND e.session = n.session AND e.idx = n.ei
          LEFT JOIN tfeat b ON b.ticker = n.ticker AND b.session = n.session AND b.idx > n.ei GROUP BY ALL)""")
        ctes.append(f"""w{k + 1} AS (SELECT x.ticker, x.session, x.si, x.xi AS wi FROM x{k} x JOIN tfeat t ON t.ticker = x.ticker AND t.session = x.session AND t.idx = x.xi
          WHERE t.ema > x.ema_hi AND t.minute < 960)""")
        out.append(f"""SELECT x.ticker, x.session, x.minute AS entry_at, x.close AS entry_price, coalesce(a.minute, l.minute, x.minute) AS exit_at,
          coalesce(a.close, l.close, x.close) AS exit_price, CASE WHEN a.ema > x.ema_hi THEN 'ema_max_stop' ELSE 'moc' END AS exit_reason, {k} AS leg
          FROM x{k} x LEFT JOIN tfeat a ON a.ticker = x.ticker AND a.session = x.session AND a.idx = x.xi
          LEFT JOIN tfeat l ON l.ticker = x.ticker AND l.session = x.session AND l.idx = x.li""")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(out)}"


def fade(spark, sf, **how):
    return C.fade_legs(trend(spark, sf), S, F.coalesce(F.col("atr_log_p") >= 0.05, F.lit(False)), **how)


@query("G5_pop_fade_single_leg", "ticker:i session:i entry_at:i entry_price:f4 exit_at:i exit_price:f4 exit_reason stop_level:f",
       """WITH sig AS (SELECT * FROM tfeat WHERE minute >= 585 AND close > sess_hic_p AND atr_log_p >= 0.05),
          ent AS (SELECT s.ticker, s.session, s.idx AS si, min(b.idx) AS ei FROM sig s JOIN tfeat b ON b.ticker = s.ticker AND b.session = s.session
            AND b.idx > s.idx AND b.ema < b.ema_p GROUP BY 1, 2, 3),
          e2 AS (SELECT t.*, e.si FROM ent e JOIN tfeat t ON t.ticker = e.ticker AND t.session = e.session AND t.idx = e.ei),
          x AS (SELECT e.ticker, e.session, e.si, e.idx, e.minute, e.close, e.ema_hi, min(CASE WHEN b.ema > e.ema_hi OR b.minute >= 960 THEN b.idx END) AS xi,
            max(b.idx) AS li FROM e2 e LEFT JOIN tfeat b ON b.ticker = e.ticker AND b.session = e.session AND b.idx > e.idx GROUP BY ALL)
          SELECT x.ticker, x.session, x.minute AS entry_at, x.close AS entry_price, coalesce(a.minute, l.minute, x.minute) AS exit_at,
            coalesce(a.close, l.close, x.close) AS exit_price, CASE WHEN xi IS NULL THEN 'moc' ELSE 'ema_max_stop' END AS exit_reason, x.ema_hi AS stop_level
          FROM x LEFT JOIN tfeat a ON a.ticker = x.ticker AND a.session = x.session AND a.idx = xi
          LEFT JOIN tfeat l ON l.ticker = x.ticker AND l.session = x.session AND l.idx = li""")
def pop_fade_single(spark, sf):
    """Without slots or re-entries every signal is on its own, which SQL can check."""
    return fade(spark, sf)


FADE = "ticker:i session:i entry_at:i entry_price:f4 exit_at:i exit_price:f4 exit_reason leg:i"


@query("G5_pop_fade_reentries", FADE, _fade_sql("down_tick", 3))
def pop_fade(spark, sf):
    return fade(spark, sf, legs=3)


@query("G5_pop_fade_cross_entry", FADE, _fade_sql("cross", 1))
def pop_fade_cross(spark, sf):
    return fade(spark, sf, entry="cross")


@query("G5_pop_fade_bars_since_high", FADE, _fade_sql("bars_since", 2))
def pop_fade_since(spark, sf):
    return fade(spark, sf, entry="bars_since", n_since=3, legs=2)


@query("G14_opening_drive_recorder", EV, "SELECT * FROM sess WHERE minute BETWEEN 585 AND 630")
def recorder(spark, sf):
    return M.sessions(spark, sf).filter(T.in_window("minute", 585, 630))


DRIVE = T.OpeningDrive(start=585, end=720, min_chg1d=0.0, chg3d=(-0.5, 3.0), min_atr=0.02, min_stop=0.01, bh_min=1, blowoff=1.9, blowoff_atr=0.05)


def drive(spark, sf):
    x = trend(spark, sf).withColumn("bar_rvol", F.col("volume") / F.col("permin"))
    return x.withColumns({"qualifies": DRIVE.qualifies(), "exhausted": DRIVE.exhausted()})


QUAL = """minute BETWEEN 585 AND 720 AND close / close_1d - 1 >= 0 AND close / close_3d - 1 >= -0.5 AND close / close_3d - 1 <= 3
    AND atr_log >= 0.02 AND (close - ema_lo) / close >= 0.01 AND bars_since_hi >= 1"""


@query("G15_opening_drive_first_qualifying", EV + " stop_level:f",
       f"""SELECT *, ema_lo AS stop_level FROM (SELECT *, row_number() OVER ({SE}) AS k FROM (SELECT *, max(CASE WHEN coalesce((sess_hic_p IS NULL OR close > sess_hic_p)
           AND volume / permin >= 1.9 AND atr_log >= 0.05, false) THEN 1 ELSE 0 END) OVER ({SE} ROWS UNBOUNDED PRECEDING) AS dead FROM tfeat)
           WHERE {QUAL} AND dead = 0) WHERE k = 1""")
def opening_drive(spark, sf):
    x = drive(spark, sf)
    x = x.withColumns(T.first_per_session(S, F.col("qualifies"), F.col("exhausted")))
    return x.filter("entry").withColumn("stop_level", F.col("ema_lo"))


def _drive_sql(legs: int, limit: bool) -> str:
    """Leg by leg, as for the fades; ``q`` is the bar that qualifies, ``e`` the one that fills."""
    quick = "q.close <= q.ema" if limit else "true"
    ctes = [f"""t AS (SELECT *, lead(low) OVER ({SE}) AS dip, max(CASE WHEN coalesce((sess_hic_p IS NULL OR close > sess_hic_p)
      AND volume / permin >= 1.9 AND atr_log >= 0.05, false) THEN 1 ELSE 0 END) OVER ({SE} ROWS UNBOUNDED PRECEDING) AS dead FROM tfeat)""",
            f"g AS (SELECT * FROM t q WHERE {QUAL} AND dead = 0 AND ({quick} OR dip <= ema))", "w0 AS (SELECT DISTINCT ticker, session, CAST(0 AS BIGINT) AS wi FROM t)"]
    out = []
    for k in range(legs):
        ctes.append(f"n{k} AS (SELECT w.ticker, w.session, min(g.idx) AS qi FROM w{k} w JOIN g ON g.ticker = w.ticker AND g.session = w.session AND g.idx >= w.wi GROUP BY ALL)")
        ctes.append(f"""e{k} AS (SELECT q.ticker, q.session, q.ema_lo AS stop, CASE WHEN {quick} THEN q.idx ELSE q.idx + 1 END AS ei,
          CASE WHEN {quick} THEN q.close ELSE q.ema END AS px FROM n{k} n JOIN t q ON q.ticker = n.ticker AND q.session = n.session AND q.idx = n.qi)""")
        ctes.append(f"""x{k} AS (SELECT e.*, min(CASE WHEN b.ema < e.stop OR b.dead = 1 OR b.minute >= 960 THEN b.idx END) AS xi, max(b.idx) AS li
          FROM e{k} e LEFT JOIN t b ON b.ticker = e.ticker AND b.session = e.session AND b.idx > e.ei GROUP BY ALL)""")
        ctes.append(f"""w{k + 1} AS (SELECT x.ticker, x.session, min(b.idx) AS wi FROM x{k} x JOIN t a ON a.ticker = x.ticker AND a.session = x.session AND a.idx = x.xi AND a.ema < x.stop
          JOIN t b ON b.ticker = x.ticker AND b.session = x.session AND b.idx > x.xi AND b.ema_lo < a.ema_lo GROUP BY ALL)""")
        out.append(f"""SELECT x.ticker, x.session, f.minute AS entry_at, px AS entry_price, coalesce(a.minute, l.minute, f.minute) AS exit_at,
          coalesce(a.close, l.close, f.close) AS exit_price, CASE WHEN a.ema < stop THEN 'stop' WHEN a.dead = 1 THEN 'exhaust' ELSE 'moc' END AS exit_reason, {k} AS leg
          FROM x{k} x JOIN t f ON f.ticker = x.ticker AND f.session = x.session AND f.idx = x.ei
          LEFT JOIN t a ON a.ticker = x.ticker AND a.session = x.session AND a.idx = x.xi LEFT JOIN t l ON l.ticker = x.ticker AND l.session = x.session AND l.idx = x.li""")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(out)}"


def drive_chain(spark, sf, **how):
    x = drive(spark, sf)
    x = x.withColumns(T.first_per_session(S, F.col("qualifies"), F.col("exhausted")))
    return C.drive_legs(x, S, F.col("qualifies"), F.col("dead"), **how)


@query("G15_opening_drive_rearm", FADE, _drive_sql(3, False))
def opening_rearm(spark, sf):
    return drive_chain(spark, sf, legs=3)


@query("G15_opening_drive_limit_entry", FADE, _drive_sql(1, True))
def opening_limit(spark, sf):
    return drive_chain(spark, sf, limit=True)
