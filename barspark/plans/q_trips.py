"""Trips: exits and sequencing."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import features as X
from barspark.functions.aggregates import clipped_profit_factor, profit_factor, win_rate
from barspark.functions.indicators import FOL, Series, run_length
from barspark.operators import chains as C, detect as T, trips as R
from barspark.plans import market as M
from barspark.plans.ctes import EP, SE
from barspark.plans.q_detect import trend
from barspark.plans.registry import query

PF = "sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0)"
PFC = "sum(least(ret, 0.5)) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0)"


@query("G1_H1_I1_breakout_by_year", "yr:i n:i pf:f pf_clip:f win:f mean_ret:f",
       f"""SELECT year(entry_date) AS yr, count(*) AS n, {PF} AS pf, {PFC} AS pf_clip,
           avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win, avg(ret) AS mean_ret FROM trips GROUP BY 1""")
def breakout_by_year(spark, sf):
    r = F.col("ret")
    return M.trips(spark, sf).groupBy(F.year("entry_date").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), profit_factor(r).alias("pf"), clipped_profit_factor(r).alias("pf_clip"),
        win_rate(r).alias("win"), F.avg(r).alias("mean_ret"))


DAY = Series(("ticker", "episode"), ("date",))
KEY = ["ticker", "episode"]
TR = "ticker:i entry_date exit_date exit_price:f exit_reason"
LOOSE_SQL = """pct_up >= 0.05 AND pct_up < 3 AND rvol >= 0.8 AND bars_seen > 21 AND avg_dol >= 100 AND close >= 0.1 * hi_close
  AND close >= 1 AND tight_log < 50 AND atr_log < 5 AND intraday_ret >= -0.2 AND max_atr >= 0.01"""


def daily_feats(spark, sf):
    return X.daily_features(M.episodes(spark, sf))


@query("H1_H2_time_exit_or_mark_to_market", "trip_id:i exit_date exit_price:f4 exit_reason open_trip:i",
       "SELECT trip_id, exit_date, exit_price, exit_reason, open_trip FROM trips")
def time_exit(spark, sf):
    return M.trips(spark, sf)


# every trip of the loose detector against the later bars of its episode: i = bar number, entry e, bar b
PAIRS = f"""(SELECT e.ticker, e.episode, e.i, e.date AS entry_date, e.close AS px, e.low AS elow, e.high AS ehigh, b.i AS bi, b.date AS bdate,
    b.open, b.high, b.low, b.close, b.stop_low, b.atr_log, b.atr_now, b.tight_log, b.rvol, b.pct_up, b.rng_hi, b.rng_lo, b.high_n
  FROM num e LEFT JOIN num b ON b.ticker = e.ticker AND b.episode = e.episode AND b.i > e.i AND b.i <= e.i + @H WHERE {LOOSE_SQL.replace(
      "pct_up", "e.pct_up").replace(" rvol", " e.rvol").replace("bars_seen", "e.bars_seen").replace("avg_dol", "e.avg_dol").replace(
      " close >=", " e.close >=").replace("hi_close", "e.hi_close").replace("tight_log", "e.tight_log").replace(
      "atr_log", "e.atr_log").replace("intraday_ret", "e.intraday_ret").replace("max_atr", "e.max_atr")})"""
NUM = f"""num AS (SELECT *, row_number() OVER ({EP}) AS i, lead(open) OVER ({EP}) AS nopen, lead(date) OVER ({EP}) AS ndate,
    max(close) OVER ({EP} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS high_n FROM feat),
  lastb AS (SELECT ticker, episode, arg_max(close, date) AS lclose, max(date) AS ldate FROM eps GROUP BY 1, 2)"""


def plan_sql(level: str, cond: str, hold: int, same_bar: str = "NULL", pre: str = "") -> str:
    """First bar on which ``cond`` gives a reason; same-bar fill where ``same_bar`` is set, else the next open."""
    return f"""WITH {NUM}, p AS (SELECT *, {level} FROM {PAIRS.replace('@H', str(hold))}),
      q AS (SELECT *, {cond} AS reason, {same_bar} AS fill FROM p),
      h AS (SELECT ticker, episode, i, any_value(entry_date) AS entry_date, min(CASE WHEN reason IS NOT NULL THEN bi END) AS hi FROM q GROUP BY 1, 2, 3),
      r AS (SELECT h.*, q.reason, q.fill, q.bdate FROM h LEFT JOIN q ON q.ticker = h.ticker AND q.episode = h.episode AND q.i = h.i AND q.bi = h.hi)
      SELECT r.ticker, entry_date, CASE WHEN hi IS NOT NULL AND fill IS NOT NULL THEN bdate WHEN hi IS NOT NULL AND n.nopen IS NOT NULL THEN n.ndate ELSE ldate END AS exit_date,
        CASE WHEN hi IS NOT NULL AND fill IS NOT NULL THEN fill WHEN hi IS NOT NULL AND n.nopen IS NOT NULL THEN n.nopen ELSE lclose END AS exit_price,
        CASE WHEN hi IS NOT NULL AND (fill IS NOT NULL OR n.nopen IS NOT NULL) THEN reason ELSE 'mtm' END AS exit_reason
      FROM r JOIN lastb l ON l.ticker = r.ticker AND l.episode = r.episode
      LEFT JOIN num n ON n.ticker = r.ticker AND n.episode = r.episode AND n.i = r.hi"""


TW = "PARTITION BY ticker, episode, i ORDER BY bi"
BEFORE = f"OVER ({TW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def planned(spark, sf, plan):
    return R.plan_exit(daily_feats(spark, sf), KEY, M.LOOSE.fires(), plan)


def _stop(hit: str, hold: int = 20) -> str:
    return f"CASE WHEN coalesce({hit}, false) THEN 'stop' WHEN bi - i >= {hold} THEN 'time_stop' END"


@query("H4_stop_window_low", TR, plan_sql("1 AS one", _stop("low <= greatest(stop_low, elow)"), 20))
def stop_window(spark, sf):
    return planned(spark, sf, R.StopPlan(mode="window_low", max_hold=20))


@query("H4_stop_fixed_pct_ratchet", TR, plan_sql(f"max(close * (1 - 0.1)) {BEFORE} AS lvl", _stop("low <= lvl"), 20))
def stop_pct(spark, sf):
    return planned(spark, sf, R.StopPlan(mode="fixed_pct", pct=0.1, max_hold=20))


@query("H4_stop_break_even_cap", TR, plan_sql(f"max(least(close * (1 - 0.05), px)) {BEFORE} AS lvl", _stop("low <= lvl"), 20))
def stop_be(spark, sf):
    return planned(spark, sf, R.StopPlan(mode="fixed_pct", pct=0.05, break_even=True, max_hold=20))


@query("H4_stop_atr_ratchet", TR, plan_sql(f"max(close * (1 - 1.5 * atr_log)) {BEFORE} AS lvl", _stop("low <= lvl"), 20))
def stop_atr(spark, sf):
    return planned(spark, sf, R.StopPlan(mode="atr_ratchet", k=1.5, max_hold=20))


@query("H4_stop_inverse_atr", TR, plan_sql(f"max(close * (1 - least(0.95, 0.1 * 0.1 / nullif(atr_log, 0)))) {BEFORE} AS lvl", _stop("low <= lvl"), 20))
def stop_inv(spark, sf):
    return planned(spark, sf, R.StopPlan(mode="inv_atr", pct=0.1, ref_atr=0.1, max_hold=20))


MARK = f"greatest(coalesce(max(close) {BEFORE}, px), px) AS mark"


@query("H4_stop_regime_chandelier", TR, plan_sql(MARK, _stop("low <= mark * (1 - CASE WHEN atr_log >= 0.12 THEN 0.1 ELSE 0.2 END)"), 20))
def stop_regime(spark, sf):
    return planned(spark, sf, R.StopPlan(mode="regime", width=0.2, tiers=((0.12, 0.1),), max_hold=20))


@query("H4_stop_ladder_chandelier", TR,
       plan_sql(MARK, _stop("low <= mark * (1 - CASE WHEN atr_log >= 0.15 THEN 0.08 WHEN atr_log >= 0.1 THEN 0.15 ELSE 0.25 END)"), 20))
def stop_ladder(spark, sf):
    return planned(spark, sf, R.StopPlan(mode="ladder", width=0.25, tiers=((0.1, 0.15), (0.15, 0.08)), max_hold=20))


@query("H4_no_stop_time_only", TR, plan_sql("1 AS one", "CASE WHEN bi - i >= 10 THEN 'time_stop' END", 10))
def stop_none(spark, sf):
    return planned(spark, sf, R.StopPlan(max_hold=10))


@query("H5_exit_priorities", TR,
       plan_sql(f"max(close * (1 - 0.25)) {BEFORE} AS lvl",
                """CASE WHEN high >= px * 1.3 THEN 'target' WHEN coalesce(low <= lvl, false) THEN 'stop'
                   WHEN coalesce(atr_now > 0.12 AND close / px - 1 < -0.1, false) THEN 'disaster'
                   WHEN coalesce(greatest(0, ln(rng_hi) - ln(greatest(rng_lo, px))) / nullif(atr_log, 0) > 4, false) THEN 'expansion'
                   WHEN coalesce(close / px - 1 < 0.1 AND tight_log > 4 AND ((rvol > 1.2 AND pct_up > 0.02) OR (rvol IS NOT NULL AND pct_up > 0.1)), false) THEN 'exhaustion'
                   WHEN bi - i >= 15 THEN 'time_stop' END""", 15, "CASE WHEN high >= px * 1.3 THEN greatest(px * 1.3, open) END"))
def exit_priorities(spark, sf):
    return planned(spark, sf, R.StopPlan(mode="fixed_pct", pct=0.25, target=0.3, disaster=(0.12, -0.1), expansion=4.0, max_hold=15,
                                         exhaustion={"tight": 4.0, "rvol": 1.2, "lo": 0.02, "hi": 0.1, "max_gain": 0.1}))


@query("H5_target_at_next_open", TR,
       plan_sql("1 AS one", "CASE WHEN high >= px * 1.2 THEN 'target_next_open' WHEN bi - i >= 15 THEN 'time_stop' END", 15))
def target_next_open(spark, sf):
    return planned(spark, sf, R.StopPlan(target=0.2, target_next_open=True, max_hold=15))


def channel_sql(mode: str, frac: float) -> str:
    lvl = f"px + {frac} * (high_n - px)"
    cond = f"high >= {lvl}" if mode == "limit" or frac < 1 else "close >= high_n"
    name = {"next_open": "target", "close": "target_moc", "limit": "target_limit"}[mode]
    fill = {"next_open": "NULL", "close": f"CASE WHEN {cond} THEN close END", "limit": f"CASE WHEN {cond} THEN {lvl} END"}[mode]
    return plan_sql("1 AS one", f"CASE WHEN {cond} THEN '{name}' WHEN bi - i >= 5 THEN 'time_stop' END", 5, fill)


CH = "ticker:i entry_date exit_price:f exit_reason"


def channel(spark, sf, mode, frac):
    x = daily_feats(spark, sf).withColumn("high_n", F.max("close").over(DAY.last(7)))
    t = R.channel_target_exit(x, KEY, M.LOOSE.fires(), mode, 5, frac)
    return t.withColumnRenamed("date", "entry_date")


@query("H3_channel_target_next_open", CH, channel_sql("next_open", 1.0))
def channel_next(spark, sf):
    return channel(spark, sf, "next_open", 1.0)


@query("H3_channel_target_at_close", CH, channel_sql("close", 1.0))
def channel_close(spark, sf):
    return channel(spark, sf, "close", 1.0)


@query("H3_channel_target_limit_fraction", CH, channel_sql("limit", 0.5))
def channel_limit(spark, sf):
    return channel(spark, sf, "limit", 0.5)


@query("H6_resting_limit_orders", "ticker:i entry_at:i entry_price:f exit_at:i exit_price:f exit_reason",
       f"""WITH n AS (SELECT *, row_number() OVER ({EP}) AS i, CAST(date - DATE '1970-01-01' AS BIGINT) AS day,
            min(low) OVER ({EP} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS entry_low, max(high) OVER ({EP} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS trail_high,
            min(low) OVER ({EP} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS slow FROM feat),
          l AS (SELECT ticker, episode, max(i) AS li, arg_max(close, i) AS lc, max(day) AS ld FROM n GROUP BY 1, 2),
          s AS (SELECT ticker, episode, i FROM n WHERE {LOOSE_SQL}),
          f AS (SELECT s.ticker, s.episode, s.i, min(b.i) AS fi FROM s LEFT JOIN n b ON b.ticker = s.ticker AND b.episode = s.episode
            AND b.i > s.i AND b.i <= s.i + 5 AND b.low <= b.entry_low GROUP BY 1, 2, 3),
          e AS (SELECT f.ticker, f.episode, f.i, b.i AS ei, b.day AS entry_at, b.low AS floor, CASE WHEN fi IS NOT NULL THEN least(b.entry_low, b.open) ELSE b.open END AS entry_price
            FROM f JOIN n b ON b.ticker = f.ticker AND b.episode = f.episode AND b.i = coalesce(f.fi, f.i + 6)),
          k AS (SELECT e.*, t.k FROM e LEFT JOIN (SELECT e.ticker, e.episode, e.i, min(b.i) AS k FROM e JOIN n b ON b.ticker = e.ticker AND b.episode = e.episode
            AND b.i > e.ei AND b.low <= greatest(b.slow, e.floor) GROUP BY 1, 2, 3) t USING (ticker, episode, i)),
          m AS (SELECT k.*, t.m FROM k LEFT JOIN (SELECT k.ticker, k.episode, k.i, min(b.i) AS m FROM k JOIN n b ON b.ticker = k.ticker AND b.episode = k.episode
            AND b.i > k.k AND b.i <= k.k + 5 AND b.high >= b.trail_high GROUP BY 1, 2, 3) t USING (ticker, episode, i))
          SELECT m.ticker, entry_at, entry_price, coalesce(a.day, o.day, ld) AS exit_at, coalesce(a.trail_high, o.open, lc) AS exit_price,
            CASE WHEN a.day IS NOT NULL THEN 'stop_limit' WHEN o.day IS NOT NULL THEN 'stop_limit_timeout' ELSE 'mtm' END AS exit_reason
          FROM m JOIN l USING (ticker, episode) LEFT JOIN n a ON a.ticker = m.ticker AND a.episode = m.episode AND a.i = m.m
          LEFT JOIN n o ON o.ticker = m.ticker AND o.episode = m.episode AND o.i = m.k + 6 AND m.m IS NULL""")
def limit_orders(spark, sf):
    x = daily_feats(spark, sf).withColumns({
        "entry_low": F.min("low").over(DAY.last(4)), "trail_high": F.max("high").over(DAY.last(6)), "day": F.unix_date("date").cast("long")})
    return C.resting_orders(x, Series(tuple(KEY), ("day",)), M.LOOSE.fires())


FROZEN = """SELECT e.ticker, e.session, e.minute, e.close AS entry_price, e.stop_level, coalesce(x.minute, l.minute, e.minute) AS exit_at,
    coalesce(x.close, l.close, e.close) AS exit_price, CASE WHEN xi IS NULL THEN 'moc' ELSE {reason} END AS exit_reason
  FROM (SELECT e.ticker, e.session, e.idx, e.minute, e.close, e.stop_level, min(CASE WHEN {cond} THEN b.idx END) AS xi, max(b.idx) AS li FROM ent e
    LEFT JOIN {bars} b ON b.ticker = e.ticker AND b.session = e.session AND b.idx > e.idx GROUP BY ALL) e
  LEFT JOIN {bars} x ON x.ticker = e.ticker AND x.session = e.session AND x.idx = xi
  LEFT JOIN {bars} l ON l.ticker = e.ticker AND l.session = e.session AND l.idx = li"""
RECLAIM = """ent AS (SELECT *, coalesce(run_low, sess_lo) AS stop_level FROM runs WHERE minute BETWEEN 600 AND 810 AND ema_p <= vwap_p
    AND ema > vwap AND run_len_p >= 3 AND tight_p >= 1.5)"""
IT = "ticker:i session:i minute:i entry_price:f4 exit_at:i exit_price:f4 exit_reason"


@query("H7_frozen_level_stop", IT,
       f"WITH {RECLAIM} " + FROZEN.format(bars="sfeat", cond="b.ema < e.stop_level * (1 - 0.002) OR b.minute >= e.minute + 120 OR b.minute >= 900",
                                         reason="CASE WHEN x.ema < e.stop_level * (1 - 0.002) THEN 'stop' WHEN x.minute >= e.minute + 120 THEN 'time_stop' ELSE 'moc' END"))
def frozen_stop(spark, sf):
    x = X.vwap_run_features(X.session_features(M.sessions(spark, sf)))
    cfg = T.VwapReclaim(min_run=3, min_tight=1.5)
    x = x.withColumn("stop_level", cfg.stop_level()).withColumn("entry_price", F.col("close"))
    return R.passage_exit(x, ["ticker", "session"], "minute", cfg.fires(), ["close", "ema"], ["entry_price", "stop_level"],
                        R.frozen_stop_rules(900, 0.002, 120))


AV = f"""(SELECT *, coalesce(lag(av) OVER ({SE}), 0) AS above_vwap_p FROM (SELECT *, CASE WHEN up THEN count(*) OVER (PARTITION BY ticker, session, g ORDER BY minute) ELSE 0 END AS av
    FROM (SELECT *, sum(CASE WHEN up IS DISTINCT FROM pup AND idx > 0 THEN 1 ELSE 0 END) OVER ({SE}) AS g FROM (SELECT *, lag(up) OVER ({SE}) AS pup
      FROM (SELECT *, ema > vwap AS up FROM tfeat)))))"""


def rich_inputs(spark, sf):
    s = X.SESSION
    x = trend(spark, sf)
    x = run_length(x, s, F.col("ema") > F.col("vwap"), "above_vwap")
    return x.withColumns({
        "above_vwap_p": F.coalesce(F.lag("above_vwap").over(s.spec()), F.lit(0)), "vol20": F.sum("volume").over(s.last(20, True)),
        "lowc": F.min("close").over(s.sofar()), "max_close": F.max("close").over(s.last(30, True)), "entry_price": F.col("close"),
        "stop_level": F.col("close") - (F.col("close") - F.min("close").over(s.sofar())) * 2 / 3})


def enters():
    fresh_high = F.coalesce((F.col("bars_since_hi") == 0) & (F.col("atr_log") >= 0.05), F.lit(False))
    return F.col("minute").between(600, 810) & fresh_high


ENT = f"""ent AS (SELECT *, close - (close - lowc) * 2 / 3 AS stop_level FROM (SELECT *, min(close) OVER ({SE}) AS lowc, max(close) OVER ({SE} ROWS 29 PRECEDING) AS max_close FROM {AV})
    WHERE minute BETWEEN 600 AND 810 AND bars_since_hi = 0 AND atr_log >= 0.05), av AS (SELECT * FROM {AV})"""


def rich_sql(rules: list[tuple[str, str, str]]) -> str:
    """rules: (reason, condition on e and b, fill on e and x)."""
    cond = " OR ".join(f"coalesce({c}, false)" for _, c, _ in rules)
    xc = lambda c: c.replace("b.", "x.")
    reason = "CASE " + " ".join(f"WHEN coalesce({xc(c)}, false) THEN '{r}'" for r, c, _ in rules) + " END"
    fill = "CASE WHEN xi IS NULL THEN coalesce(l.close, e.close) " + " ".join(
        f"WHEN coalesce({xc(c)}, false) THEN {f}" for _, c, f in rules) + " END"
    return f"""WITH {ENT} SELECT e.ticker, e.session, e.minute, e.close AS entry_price, coalesce(x.minute, l.minute, e.minute) AS exit_at,
        {fill} AS exit_price, CASE WHEN xi IS NULL THEN 'moc' ELSE {reason} END AS exit_reason
      FROM (SELECT e.ticker, e.session, e.idx, e.minute, e.close, e.stop_level, e.vol20, e.permin, e.ema, e.max_close, min(CASE WHEN {cond} THEN b.idx END) AS xi, max(b.idx) AS li FROM ent e
        LEFT JOIN av b ON b.ticker = e.ticker AND b.session = e.session AND b.idx > e.idx GROUP BY ALL) e
      LEFT JOIN av x ON x.ticker = e.ticker AND x.session = e.session AND x.idx = xi
      LEFT JOIN av l ON l.ticker = e.ticker AND l.session = e.session AND l.idx = li"""


MOC = ("moc", "b.minute >= 900", "x.close")
BAR = ["open", "high", "low", "close", "ema", "vwap", "volume", "vol20", "vol_slope", "sess_hi_p", "above_vwap_p", "ema_low20_p"]
ENTF = ["entry_price", "stop_level", "vol20", "permin", "ema", "max_close"]


def rich(spark, sf, exit_):
    return R.passage_exit(rich_inputs(spark, sf), ["ticker", "session"], "minute", enters(), BAR, ENTF, exit_.rules())


@query("H8_geometry_stop_and_volume_exits", IT,
       rich_sql([("stop", "b.close <= e.stop_level", "x.close"), ("vol_stop", "b.vol20 < e.vol20 * 0.8", "x.close"),
                 ("vol_slope_stop", "b.vol_slope < -0.08", "x.close"), MOC]))
def rich_volume(spark, sf):
    return rich(spark, sf, R.RichExit(moc=900, stop="close", vol_stop=0.8, vol_slope_stop=-0.08))


@query("H8_trailing_ema_exhaust_vwap_lost", IT,
       rich_sql([("stop", "b.ema < b.ema_low20_p", "x.close"),
                 ("exhaust", "b.volume >= e.permin * 1.5 AND b.high > b.sess_hi_p", "x.close"),
                 ("vwap_lost", "b.above_vwap_p >= 3 AND b.ema < b.vwap", "x.close"), ("time_stop", "b.minute >= e.minute + 60", "x.close"), MOC]))
def rich_trailing(spark, sf):
    return rich(spark, sf, R.RichExit(moc=900, stop="trail_ema", exhaust_mult=1.5, vwap_bars=3, time_stop=60))


@query("H8_pct_stop_and_target", IT,
       rich_sql([("pct_stop", "b.high >= e.close * (1 + 0.05)", "greatest(e.close * (1 + 0.05), x.open)"),
                 ("target", "b.low <= b.vwap", "least(x.vwap, x.open)"), MOC]))
def rich_pct(spark, sf):
    """A short: percentage stop above, limit target at VWAP below."""
    return rich(spark, sf, R.RichExit(moc=900, pct_stop=0.05, target="vwap", short=True))


@query("H8_ema_pct_and_max_close_stops", IT,
       rich_sql([("ema_pct_stop", "b.ema > e.ema * (1 + 0.03)", "x.close"), ("max_close_stop", "b.close > e.max_close * (1 + 0.01)", "x.close"), MOC]))
def rich_short_stops(spark, sf):
    """A short: the average's rise since the entry, and a close over the last 30 bars' highest at entry."""
    return rich(spark, sf, R.RichExit(moc=900, ema_pct_stop=0.03, max_close_stop=0.01, short=True))


@query("H8_intrabar_low_stop", IT, rich_sql([("stop", "b.low <= e.stop_level", "least(e.stop_level, x.open)"), MOC]))
def rich_low(spark, sf):
    return rich(spark, sf, R.RichExit(moc=900, stop="low"))


def _extreme_sql(signal: str, reached: str, price: str, stop: str, hit: str) -> str:
    return f"""WITH f AS (SELECT *, greatest(high, lag(high) OVER ({SE})) AS two FROM sfeat), sig AS (SELECT * FROM f WHERE {signal}),
      n AS (SELECT s.ticker, s.session, s.idx AS si, min(b.idx) AS ei FROM sig s JOIN f b ON b.ticker = s.ticker AND b.session = s.session AND b.idx > s.idx AND {reached} GROUP BY ALL),
      e AS (SELECT n.*, b.minute, {price} AS px, b.{stop} AS stop FROM n JOIN sig s ON s.ticker = n.ticker AND s.session = n.session AND s.idx = n.si
        JOIN f b ON b.ticker = n.ticker AND b.session = n.session AND b.idx = n.ei),
      x AS (SELECT e.*, min(CASE WHEN {hit} OR b.minute >= 960 THEN b.idx END) AS xi, max(b.idx) AS li FROM e
        LEFT JOIN f b ON b.ticker = e.ticker AND b.session = e.session AND b.idx > e.ei GROUP BY ALL)
      SELECT e.ticker, e.session, e.minute AS entry_at, px AS entry_price, coalesce(b.minute, l.minute, e.minute) AS exit_at, coalesce(b.close, l.close, z.close) AS exit_price,
        CASE WHEN {hit} THEN 'session_stop' ELSE 'moc' END AS exit_reason
      FROM x e JOIN f z ON z.ticker = e.ticker AND z.session = e.session AND z.idx = e.ei LEFT JOIN f b ON b.ticker = e.ticker AND b.session = e.session AND b.idx = xi
      LEFT JOIN f l ON l.ticker = e.ticker AND l.session = e.session AND l.idx = li"""


LOW_SIGNAL = "minute >= 585 AND close < sess_loc_p AND tight_p IS NOT NULL AND atr_log_p IS NOT NULL AND volume >= 0.9 * vol_hi_p"
HIGH_SIGNAL = "minute >= 585 AND close > sess_hic_p AND tight_p IS NOT NULL AND atr_log_p IS NOT NULL AND volume >= 0.9 * vol_hi_p"
EXTREME = "ticker:i session:i entry_at:i entry_price:f4 exit_at:i exit_price:f4 exit_reason"


@query("H9_armed_extreme_trail_entry", EXTREME,
       _extreme_sql(LOW_SIGNAL, "b.close > (SELECT min(c.two) FROM f c WHERE c.ticker = s.ticker AND c.session = s.session AND c.idx BETWEEN s.idx AND b.idx)",
                    "b.close", "sess_lo_p", "b.low <= e.stop"))
def armed_extreme(spark, sf):
    x = X.session_features(M.sessions(spark, sf))
    return C.extreme_fills(x, X.SESSION, T.SessionExtreme().fires(), trail=True)


@query("H9_armed_extreme_rise_entry", EXTREME,
       _extreme_sql(HIGH_SIGNAL, "b.high >= s.close * 1.01", "greatest(s.close * 1.01, b.open)", "sess_hi_p", "b.high >= e.stop"))
def armed_rise(spark, sf):
    x = X.session_features(M.sessions(spark, sf))
    return C.extreme_fills(x, X.SESSION, T.SessionExtreme(downside=False).fires(), trail=False, rise=0.01, downside=False)


@query("H10_scale_bars_to_candidates", "ticker:i date close:f high:f",
       """SELECT d.ticker, d.date, close * (1.0::DOUBLE + d.ticker % 3) AS close, high * (1.0::DOUBLE + d.ticker % 3) AS high
          FROM daily d WHERE EXISTS (SELECT 1 FROM trips t WHERE t.ticker = d.ticker AND t.entry_date = d.date)""")
def scale_bars(spark, sf):
    c = M.trips(spark, sf).select("ticker", F.col("entry_date").alias("date"), (F.lit(1.0) + F.col("ticker") % 3).alias("adj_ratio"))
    return R.scale_to_candidates(M.daily(spark, sf), c)


@query("H11_trip_pnl_long_short_sized", "trip_id:i side:i ret:f qty:f net_pnl:f",
       """SELECT trip_id, side, (exit_price / entry_price - 1) * side AS ret, qty * m AS qty, qty * m * (exit_price - entry_price) * side AS net_pnl
          FROM (SELECT *, CASE WHEN rvol >= 2 THEN 3 ELSE 1 END AS m FROM trips) JOIN (VALUES (1), (-1)) s(side) ON true""")
def trip_pnl(spark, sf):
    t = M.trips(spark, sf).drop("ret", "qty", "net_pnl")
    mult = F.when(F.col("rvol") >= 2, 3.0).otherwise(1.0)
    lng = R.pnl(t, size_mult=mult).withColumn("side", F.lit(1))
    return lng.unionByName(R.pnl(t, side=-1, size_mult=mult).withColumn("side", F.lit(-1)))


@query("H12_pierce_what_if_stop", "ticker:i session:i minute:i ret:f ret_stop_5:f ret_stop_20:f",
       f"""WITH x AS (SELECT *, max(high) OVER ({SE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mx,
            last_value(close) OVER ({SE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lc FROM sess)
          SELECT ticker, session, minute, 1 - lc / close AS ret, CASE WHEN mx >= close * (1 + 0.05) THEN -0.05 ELSE 1 - lc / close END AS ret_stop_5,
            CASE WHEN mx >= close * (1 + 0.2) THEN -0.2 ELSE 1 - lc / close END AS ret_stop_20 FROM x""")
def pierce(spark, sf):
    s = M.sessions(spark, sf)
    last = F.last("close").over(X.SESSION.spec().rowsBetween(0, FOL))
    t = s.withColumn("lc", last)
    t = t.select("ticker", "session", "minute", F.col("close").alias("entry_price"), (1 - F.col("lc") / F.col("close")).alias("ret"))
    return R.pierce_stop(t, s, ["ticker", "session"], "minute", [0.05, 0.2])

