"""Feature columns of daily and session bar series, computed once and shared by all detectors.

Suffix ``_p`` marks the state going INTO the bar (no lookahead); without it the current bar is included. All windows of
one call share a partitioning, so a feature set costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.indicators import (
    Series, bar_index, bars_since, calendar_mean, lag, ols_slope, rolling_max, rolling_mean, rolling_min, rolling_sum,
    run_length, islands, running_max, running_min, running_ratio, with_emas, with_extremes,
    with_true_range,
)
from barspark.functions.scalars import div, pct

SESSION = Series(("ticker", "session"), ("minute",))


def daily_features(bars: DataFrame, by: tuple[str, ...] = ("ticker", "episode"), atr: int = 14, channel: int = 252,
                   vol_bars: int = 20, vol_days: int | None = None, stop_window: int = 15,
                   max_atr: int = 126) -> DataFrame:
    """Pre-bar state of the daily detectors: ATR (log, linear), range, channels, volume baselines, past-runner ATR.

    ``vol_days`` switches the volume baseline from the last ``vol_bars`` bars to calendar days.
    """
    s = Series(by, ("date",))
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    x = with_true_range(bars, s)
    base = {
        "atr_log": rolling_mean(s, F.col("tr_log"), atr), "atr_lin": rolling_mean(s, F.col("tr_lin"), atr),
        "atr_now": rolling_mean(s, F.col("tr_log"), atr, True),
        "rng_hi": rolling_max(s, h, atr), "rng_lo": rolling_min(s, lo, atr),
        "stop_low": rolling_min(s, lo, stop_window), "stop_high": rolling_max(s, h, stop_window),
        "bars_seen": F.row_number().over(s.spec()),
    }
    if vol_days is None:
        base["avg_vol"] = rolling_mean(s, v, vol_bars)
        base["avg_dol"] = rolling_mean(s, c * v, vol_bars)
    else:
        base["avg_vol"] = calendar_mean(by, "date", v, vol_days)
        base["avg_dol"] = calendar_mean(by, "date", c * v, vol_days)
    x = x.withColumns(base)
    x = with_extremes(x, s, {
        "hi_close": ("max", c, channel, False), "hi_high": ("max", h, channel, False),
        "lo_close": ("min", c, channel, False), "lo_low": ("min", lo, channel, False),
        "max_atr": ("max", F.col("atr_now"), max_atr, False),
    })
    ok = (F.col("rng_hi") > 0) & (F.col("rng_lo") > 0)
    return x.withColumns({
        "rvol": div(v, F.col("avg_vol")), "pct_up": pct(c, F.col("prev_close")),
        "intraday_ret": pct(c, o),
        "tight_log": F.when(ok, div(F.ln("rng_hi") - F.ln("rng_lo"), F.col("atr_log"))),
        "tight_lin": div(F.col("rng_hi") - F.col("rng_lo"), F.col("atr_lin")),
        "d52_close": pct(c, F.col("hi_close")), "d52_high": pct(c, F.col("hi_high")),
        "d52_low_close": pct(c, F.col("lo_close")), "d52_low": pct(c, F.col("lo_low")),
    })


def expansion_tightness(entry_price: Column, linear: bool = True) -> Column:
    """Range above the entry price over ATR: grows as a held name runs away from its entry."""
    hi, floor = F.col("rng_hi"), F.greatest(F.col("rng_lo"), entry_price)
    if linear:
        return div(F.greatest(F.lit(0.0), hi - floor), F.col("atr_lin"))
    return div(F.greatest(F.lit(0.0), F.ln(hi) - F.ln(floor)), F.col("atr_log"))


def session_features(bars: DataFrame, s: Series = SESSION, window: int = 20, ema: int = 9) -> DataFrame:
    """Core session state: EMA, VWAP, ATR, tightness, running extremes, volume highs."""
    h, lo, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    x = with_true_range(with_emas(bars, s, {"ema": (c, ema), "vol_ema": (v, ema)}), s)
    tp = (h + lo + c) / 3.0
    x = x.withColumns({
        "idx": bar_index(s), "vwap": running_ratio(s, tp * v, v),
        "atr_log": rolling_mean(s, F.col("tr_log"), window, True), "atr_lin": rolling_mean(s, F.col("tr_lin"), window, True),
        "atr_log_p": rolling_mean(s, F.col("tr_log"), window), "atr_lin_p": rolling_mean(s, F.col("tr_lin"), window),
        "rng_hi": rolling_max(s, h, window, True), "rng_lo": rolling_min(s, lo, window, True),
        "rng_hi_p": rolling_max(s, h, window), "rng_lo_p": rolling_min(s, lo, window),
        "sess_hi_p": running_max(s, h, False), "sess_lo_p": running_min(s, lo, False),
        "sess_hic_p": running_max(s, c, False), "sess_loc_p": running_min(s, c, False),
        "sess_lo": running_min(s, lo), "vol_hi_p": running_max(s, v, False), "cum_vol": F.sum(v).over(s.sofar()),
        "prev_high": lag(s, h), "prev_low": lag(s, lo), "sess_open": F.first("open").over(s.sofar()),
        "chg20": pct(c, lag(s, c, 20)),
    })
    return x.withColumns({
        "ema_p": lag(s, F.col("ema")), "vwap_p": lag(s, F.col("vwap")),
        "tight": div(F.col("rng_hi") - F.col("rng_lo"), F.col("atr_lin")),
        "tight_p": div(F.col("rng_hi_p") - F.col("rng_lo_p"), F.col("atr_lin_p")),
        "vol_vs_hi": div(v, F.col("vol_hi_p")),
    })


def trend_features(x: DataFrame, s: Series = SESSION, window: int = 20) -> DataFrame:
    """EMA extremes and their bar counts, log-price and log-volume slopes, closes above the EMA, volume climb."""
    c, v, e = F.col("close"), F.col("volume"), F.col("ema")
    x = x.withColumns({
        "ema_hi_p": running_max(s, e, False), "ema_lo_p": running_min(s, e, False),
        "ema_hi": running_max(s, e), "ema_lo": running_min(s, e),
        "ema_low20": rolling_min(s, e, window, True), "ema_low20_p": rolling_min(s, e, window),
        "ema_hi20_p": rolling_max(s, e, 20),
        "slope": ols_slope(s, F.ln(c), F.col("idx"), window), "slope_p": ols_slope(s, F.ln(c), F.col("idx"), window, False),
        "vol_slope": ols_slope(s, F.when(v > 0, F.ln(v)), F.col("idx"), window),
        "vol_ema_min": rolling_min(s, F.col("vol_ema"), window, True),
        "vol5": rolling_mean(s, v, 5, True),
        "above": F.when(F.col("ema_p").isNotNull(), F.when(c >= F.col("ema_p"), 1).otherwise(0)).otherwise(0),
    })
    x = with_extremes(x, s, {"ema_hi60_p": ("max", e, 60, False)})
    new_hi = F.col("ema_hi_p").isNull() | (e > F.col("ema_hi_p"))
    new_lo = F.col("ema_lo_p").isNull() | (e < F.col("ema_lo_p"))
    return x.withColumns({
        "above6": rolling_sum(s, F.col("above"), 6, True),
        "bars_since_hi": bars_since(s, new_hi, F.col("idx")), "bars_since_lo": bars_since(s, new_lo, F.col("idx")),
        "vol_climb": F.when(F.col("vol_ema") > 0, (F.col("vol_ema") - F.col("vol_ema_min")) / F.col("vol_ema")),
        "new_hi": new_hi, "new_hi20": F.col("ema_hi20_p").isNull() | (e > F.col("ema_hi20_p")),
        "new_hi60": F.col("ema_hi60_p").isNull() | (e > F.col("ema_hi60_p")),
    })


def vwap_run_features(x: DataFrame, s: Series = SESSION, mirror: bool = False) -> DataFrame:
    """The run of bars whose prior EMA was below the prior VWAP (above it when mirrored): its length into the bar, its
    depth, mean true range, EMA extreme, and rising/falling volume. The crossing bar still sees the run."""
    e, vw, v, c = F.col("ema_p"), F.col("vwap_p"), F.col("volume"), F.col("close")
    below = (e > vw) if mirror else (e < vw)
    x = x.withColumn("__bl", F.coalesce(below, F.lit(False)))
    x = run_length(x, s, F.col("__bl"), "run_len")
    x = islands(x, s, F.col("__bl"), "__isl")
    r = s.sub("__isl")
    w = r.sofar()
    inside = lambda col: F.when(F.col("__bl"), col)
    dist = (e - vw) / vw if mirror else (vw - e) / vw
    edge = F.max if mirror else F.min
    known = e.isNotNull() & vw.isNotNull()
    x = x.withColumns({
        "run_len_p": F.coalesce(lag(s, F.col("run_len")), F.lit(0)),
        "__nb": F.sum(F.when(F.col("__bl"), 1).otherwise(0)).over(s.sofar(False)),
        "__nk": F.sum(F.when(known, 1).otherwise(0)).over(s.sofar(False)),
        "run_depth": F.coalesce(F.max(inside(dist)).over(w), F.lit(0.0)),
        "run_atr": F.avg(inside(F.col("tr_log"))).over(w),
        "run_ema_edge": edge(inside(e)).over(w),
        "run_up_vol": F.avg(inside(F.when(c > e, v))).over(w), "run_dn_vol": F.avg(inside(F.when(c < e, v))).over(w),
    })
    return x.withColumn("below_frac_p", div(F.col("__nb"), F.col("__nk"))).drop("__bl", "__isl", "__nb", "__nk")


def ema_run_features(x: DataFrame, s: Series = SESSION) -> DataFrame:
    """Runs of closes at/above and below the prior EMA, as known before the bar.

    below_n_p: consecutive closes below; above_n_p: length of the current run above; saved_run_p: length of the last
    finished run above; since_break_p: bars since that run broke (-1 before the first break).
    """
    e, c = F.col("ema_p"), F.col("close")
    x = run_length(x, s, c < e, "__bn")
    x = run_length(x, s, c >= e, "__an")
    broke = (c < e)
    x = x.withColumn("__ended", F.when(broke & (lag(s, F.col("__an")) > 0), lag(s, F.col("__an"))))
    x = x.withColumn("__saved", F.last("__ended", ignorenulls=True).over(s.sofar()))
    x = x.withColumn("__since", bars_since(s, broke, F.col("idx")))
    return x.withColumns({
        "below_n_p": F.coalesce(lag(s, F.col("__bn")), F.lit(0)), "above_n_p": F.coalesce(lag(s, F.col("__an")), F.lit(0)),
        "saved_run_p": lag(s, F.col("__saved")), "since_break_p": F.coalesce(lag(s, F.col("__since")), F.lit(-1)),
    }).drop("__bn", "__an", "__ended", "__saved", "__since")


def up_down_volume(s: Series, windows: list[int]) -> dict[str, Column]:
    """Mean volume of bars closing above over those closing below the prior EMA, per trailing window."""
    up = F.when(F.col("close") > F.col("ema_p"), F.col("volume"))
    dn = F.when(F.col("close") < F.col("ema_p"), F.col("volume"))
    return {f"updn_{n}": div(F.avg(up).over(s.last(n, True)), F.avg(dn).over(s.last(n, True))) for n in windows}


def pace_features(daily_avg: str, s: Series, minutes_per_day: int = 390, opening: int = 15) -> dict[str, Column]:
    """Trailing volume against the average per-minute pace and against the opening minutes' pace."""
    per_min = F.col(daily_avg) / minutes_per_day
    first = F.avg(F.when(F.col("idx") < opening, F.col("volume"))).over(s.sofar())
    v5 = F.avg("volume").over(s.last(5, True))
    return {"bar_rvol": div(F.col("volume"), per_min), "rvol5": div(v5, per_min), "rvol5_open": div(v5, first)}


def past_runner(bars: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """126-bar maxima (ending the bar before) of 14-bar mean range, true range over close, and 14-bar return."""
    s = Series(by, ("date",))
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    pc = lag(s, c)
    x = bars.withColumn("__pc", pc)
    tr = F.greatest(h, F.coalesce(F.col("__pc"), h)) - F.least(lo, F.coalesce(F.col("__pc"), lo))
    x = x.withColumns({
        "adr14": F.avg(h / lo - 1.0).over(s.last(14, True)), "atr14": div(F.avg(tr).over(s.last(14, True)), c),
        "ret14": pct(c, lag(s, c, 14)),
    })
    return with_extremes(x, s, {f"max_{n}": ("max", F.col(n), 126, False) for n in ("adr14", "atr14", "ret14")}).drop("__pc")


def candle_shape() -> dict[str, Column]:
    """Body fraction, open position and close position inside the bar's range."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = F.nullif(h - lo, F.lit(0.0))
    return {"body_frac": F.abs(c - o) / rng, "open_pos": (o - lo) / rng, "close_pos": (c - lo) / rng}


def up_streak(df: DataFrame, s: Series, c: Column, out: str = "up_streak") -> DataFrame:
    """Number of consecutive up-closes ending at the bar."""
    return run_length(df, s, c > lag(s, c), out)


def depth_references(s: Series, c: Column, windows: tuple[int, ...] = (60, 90, 120)) -> dict[str, Column]:
    """Close against its trailing means and against the close n bars back."""
    out: dict[str, Column] = {}
    for n in windows:
        out[f"vs_mean_{n}"] = pct(c, rolling_mean(s, c, n))
        out[f"chg_{n}"] = pct(c, lag(s, c, n))
    return out
