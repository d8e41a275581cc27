"""Episodes, candidate universes, market breadth and heat, floats, screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.indicators import Series, lag, lead, rolling_max, rolling_mean, with_extremes, with_true_range
from barspark.functions.scalars import div, gate, pct
from barspark.operators.asof import asof_join
from barspark.operators.prefix import ntile_of, ranked
from barspark.session import stored

GAP_DAYS = 45
DAILY = Series(("ticker", "episode"), ("date",))


def with_episodes(daily: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """Number the stretches of a ticker without a gap of more than ``gap_days`` calendar days."""
    w = Window.partitionBy("ticker").orderBy("date")
    new = F.when(F.datediff("date", F.lag("date").over(w)) > gap_days, 1).otherwise(0)
    return daily.withColumn("__new", new).withColumn(
        "episode", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("__new")


def in_types(df: DataFrame, reference: DataFrame, types: list[str]) -> DataFrame:
    """Keep tickers that have one of the instrument types; a ticker with two types is not duplicated."""
    return df.join(reference.filter(F.col("type").isin(types)), "ticker", "left_semi")


def with_trading_day(daily: DataFrame) -> DataFrame:
    """Market-wide trading-day number. The calendar is one row per date, so its global window is small by nature."""
    days = daily.select("date").distinct()
    cal = days.withColumn("dnum", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    return daily.join(cal, "date")


def daily_context(daily: DataFrame) -> DataFrame:
    """Episode-bounded lags, leads and 20-bar volume of every daily bar."""
    s = DAILY
    c = F.col("close")
    return daily.withColumns({
        "prev_close": lag(s, c), "close_3d": lag(s, c, 3), "close_7d": lag(s, c, 7),
        "avgvol20": rolling_mean(s, F.col("volume"), 20, inclusive=True),
        "close_fwd_1d": lead(s, c, 1), "close_fwd_3d": lead(s, c, 3), "close_fwd_5d": lead(s, c, 5),
        "nbars": F.count(F.lit(1)).over(s.whole()),
    })


def opening_liquidity(minutes: DataFrame, by: list[str], minute: str, start: int, scan: int, premarket: int,
                      min_median: float, min_bars: int) -> DataFrame:
    """Median bar volume, bar count, first open and volumes of the opening window; illiquid groups are dropped.

    A group is one ticker-day of minute bars (at most 960 rows), so the exact median's state is bounded.
    """
    m = F.col(minute)
    w = (m >= start) & (m < scan)
    g = minutes.filter(m < scan).groupBy(*by).agg(
        F.median(F.when(w, F.col("volume"))).alias("med_bar_vol"), F.count(F.when(w, 1)).alias("nbar"),
        F.min_by(F.when(w, F.col("open")), F.when(w, m)).alias("day_open"),
        F.sum(F.when(w, F.col("volume")).otherwise(0)).alias("vol_open"),
        F.sum(F.when(m >= premarket, F.col("volume")).otherwise(0)).alias("vol_pm"),
    )
    return g.filter((F.col("med_bar_vol") >= min_median) & (F.col("nbar") >= min_bars))


def intraday_candidates(daily: DataFrame, liquidity: DataFrame, min_price: float, warmup: int,
                        min_rvol: float) -> DataFrame:
    """Daily context joined to the liquid ticker-days, with relative volume through the opening window."""
    j = daily_context(daily).join(liquidity, ["ticker", "date"])
    rvol = div(F.col("vol_pm").cast("double"), F.col("avgvol20"))
    return j.withColumn("rvol_open", rvol).filter(
        (F.col("close") >= min_price) & (F.col("nbars") > warmup) & (F.col("rvol_open") >= min_rvol)
    )


def in_play(candidates: DataFrame, min_dollar: float, min_rvol: float) -> DataFrame:
    """The active subset: average dollar volume and relative volume floors."""
    return candidates.filter(
        (F.col("avgvol20") * F.col("prev_close") >= min_dollar) & (F.col("rvol_open") > min_rvol)
    )


def breadth(daily: DataFrame, min_dollar: float, sma: int = 20, days: int = 30) -> DataFrame:
    """Per date the number of liquid names and the share closing above their ``sma``-bar mean."""
    by_t = Series(("ticker",), ("date",))
    day = F.unix_date(F.col("date"))
    adv = F.avg(F.col("close") * F.col("volume")).over(
        Window.partitionBy("ticker").orderBy(day).rangeBetween(-days, 0))
    x = daily.withColumns({
        "ma": rolling_mean(by_t, F.col("close"), sma, inclusive=True), "adv": adv,
        "rn": F.row_number().over(by_t.spec()),
    }).filter((F.col("rn") >= sma) & (F.col("adv") >= min_dollar))
    above = F.avg(F.when(F.col("close") > F.col("ma"), 1.0).otherwise(0.0))
    return x.groupBy("date").agg(F.count(F.lit(1)).alias("n"), above.alias("pct_above"))


def _calendar(lo: int, hi: int):
    """Rows of a one-row-per-date series; its single partition holds only the calendar."""
    return Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(lo, hi)


def lagged_breadth(b: DataFrame) -> DataFrame:
    """Yesterday's breadth and its 5- and 10-day means ending yesterday."""
    x = F.col("pct_above")
    return b.withColumns({
        "lag1": F.lag(x).over(Window.partitionBy(F.lit(0)).orderBy("date")),
        "ma5": F.avg(x).over(_calendar(-5, -1)), "ma10": F.avg(x).over(_calendar(-10, -1)),
    })


def tail_heat(daily: DataFrame, min_dollar: float, top: bool = True, share: float = 0.01, max_ret: float = 10.0,
              days: int = 30) -> DataFrame:
    """Mean return of a date's top (or bottom) ``share`` by percent rank, and its lagged 10-day mean.

    Percent ranks come from ``ranked``: a date with very many names is split over value ranges.
    """
    by_t = Series(("ticker",), ("date",))
    day = F.unix_date(F.col("date"))
    adv = F.avg(F.col("close") * F.col("volume")).over(
        Window.partitionBy("ticker").orderBy(day).rangeBetween(-days, 0))
    q = daily.withColumns({"ret": pct(F.col("close"), lag(by_t, F.col("close"))), "adv": adv}).filter(
        (F.col("adv") >= min_dollar) & F.col("ret").isNotNull() & (F.col("ret") <= max_ret)
    ).select("date", "ret", F.xxhash64("ticker").alias("tie"))
    r = ranked(stored(q), ["date"], "ret", "tie")
    pr = F.when(F.col("n") > 1, (F.col("rk") - 1) / (F.col("n") - 1)).otherwise(0.0)
    keep = pr >= 1.0 - share if top else pr <= share
    h = r.filter(keep).groupBy("date").agg(F.avg("ret").alias("heat"))
    return h.withColumn("h10", F.avg("heat").over(_calendar(-10, -1)))


def dollar_float(events: DataFrame, by: str, date: str, floats: DataFrame, prices: DataFrame,
                 shares: DataFrame | None = None) -> DataFrame:
    """Dollar float at an event: the latest known filing re-anchored from its period end to the event's price; share
    count times price where there is no filing.

    ``floats``: ticker, known_date, period_end, value. ``shares``: ticker, as_of, shares. ``prices``: ticker, date, close.
    """
    ev = asof_join(events, floats.filter(F.col("value") > 0).withColumnRenamed("value", "float_usd"), [by], date,
                   "known_date", ["float_usd", "period_end"])
    px = prices.select(F.col("ticker").alias(by), F.col("date").alias("__pd"), F.col("close").alias("px_period"))
    ev = asof_join(ev, px, [by], "period_end", "__pd", ["px_period"])
    at = prices.select(F.col("ticker").alias(by), F.col("date").alias(date), F.col("close").alias("px_event"))
    ev = ev.join(at, [by, date], "left")
    ok = (F.col("px_period") > 0) & (F.col("px_event") > 0)
    val = F.when(ok, F.col("float_usd") * F.col("px_event") / F.col("px_period"))
    if shares is not None:
        ev = asof_join(ev, shares, [by], date, "as_of", ["shares"])
        ev = ev.withColumn("float_alt", F.col("shares") * F.col("px_event"))
        return ev.withColumn("float_at_event", F.coalesce(val, F.col("float_alt")))
    return ev.withColumn("float_at_event", val)


def gap_up_universe(daily: DataFrame, min_gap: float, min_volume: float, high_window: int | None = None) -> DataFrame:
    """Days that open ``min_gap`` above the prior close on enough volume; optionally above the prior high channel."""
    s = Series(("ticker",), ("date",))
    x = daily.withColumn("prev_close", lag(s, F.col("close"))).withColumn("gap", pct(F.col("open"), F.col("prev_close")))
    cond = gate(F.col("gap") >= min_gap) & (F.col("volume") >= min_volume)
    if high_window:
        x = with_extremes(x, s, {"prior_high": ("max", F.col("high"), high_window, False)})
        cond = cond & gate(F.col("open") > F.col("prior_high"))
    return x.filter(cond)


def continuation_columns(daily: DataFrame) -> DataFrame:
    """Gap, close position in the range, overnight and next-day returns."""
    s = Series(("ticker",), ("date",))
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    x = daily.withColumns({"prev_close": lag(s, c), "next_open": lead(s, o), "next_close": lead(s, c)})
    return x.withColumns({
        "gap": pct(o, F.col("prev_close")), "close_in_range": div(c - lo, h - lo),
        "overnight_ret": pct(F.col("next_open"), c), "next_day_ret": pct(F.col("next_close"), F.col("next_open")),
    })


def band(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Half-open band [lo, hi) on a metric; a missing metric is out."""
    cond = F.col(col).isNotNull()
    if lo is not None:
        cond = cond & (F.col(col) >= lo)
    if hi is not None:
        cond = cond & (F.col(col) < hi)
    return df.filter(cond)


def continuation_days(daily: DataFrame, breakouts: DataFrame, day: int, min_gap: float | None = None,
                      min_close_in_range: float | None = None) -> DataFrame:
    """The bar ``day`` rows after each breakout (ticker, date) with its own continuation columns."""
    s = Series(("ticker",), ("date",))
    x = continuation_columns(daily).withColumn("breakout_date", F.lag("date", day).over(s.spec()))
    b = breakouts.select("ticker", F.col("date").alias("breakout_date"))
    j = x.join(b, ["ticker", "breakout_date"], "left_semi")
    if min_gap is not None:
        j = j.filter(gate(F.col("gap") >= min_gap))
    if min_close_in_range is not None:
        j = j.filter(gate(F.col("close_in_range") >= min_close_in_range))
    return j


def intraday_signal(snapshots: DataFrame, daily: DataFrame, baseline: int = 20, hold: int = 5) -> DataFrame:
    """Move against the prior daily close, volume against the same checkpoint of the prior sessions, and the return to
    the open ``hold`` trading days later.

    ``snapshots``: ticker, date, checkpoint, cum_vol, px.
    """
    px = with_trading_day(daily).select("ticker", "date", "dnum", F.col("open").alias("day_open"),
                                        F.col("close").alias("day_close"))
    prev = px.select("ticker", F.col("date").alias("__pd"), F.col("day_close").alias("prevclose"))
    s = asof_join(snapshots, prev, ["ticker"], "date", "__pd", ["prevclose"], "backward", strict=True)
    s = s.join(px.select("ticker", "date", "dnum"), ["ticker", "date"])
    fwd = px.select("ticker", (F.col("dnum") - hold).alias("dnum"), F.col("day_open").alias("exit_open"))
    s = s.join(fwd, ["ticker", "dnum"], "left")
    cp = Series(("ticker", "checkpoint"), ("date",))
    s = s.withColumn("vol_baseline", rolling_mean(cp, F.col("cum_vol"), baseline))
    return s.withColumns({
        "move": pct(F.col("px"), F.col("prevclose")),
        "rvol": F.when(F.col("vol_baseline") > 0, F.col("cum_vol") / F.col("vol_baseline")),
        "fwd_ret": pct(F.col("exit_open"), F.col("px")),
    })


def factor_base(daily: DataFrame, as_of: Column, recency_days: int = 10, warmup: int = 21) -> DataFrame:
    """The screening factors of each ticker's last completed bar, if it is recent and warmed up."""
    s = DAILY
    x = with_true_range(daily, s).withColumns({
        "atr_lin": rolling_mean(s, F.col("tr_lin"), 14, True), "atr_log": rolling_mean(s, F.col("tr_log"), 14, True),
        "rng_hi": rolling_max(s, F.col("high"), 14, True), "rng_lo": F.min("low").over(s.last(14, True)),
        "avgvol20": rolling_mean(s, F.col("volume"), 20, True),
        "avgdol20": rolling_mean(s, F.col("close") * F.col("volume"), 20, True),
        "nbars": F.count(F.lit(1)).over(s.whole()),
        "rn_desc": F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))),
    })
    x = with_extremes(x, s, {"hi_close252": ("max", F.col("close"), 252, True),
                             "max_atr126": ("max", F.col("atr_log"), 126, True)})
    x = x.withColumn("tightness", F.when(F.col("atr_lin") > 0, (F.col("rng_hi") - F.col("rng_lo")) / F.col("atr_lin")))
    return x.filter(
        (F.col("rn_desc") == 1) & (F.col("nbars") > warmup) & (F.col("date") >= F.date_sub(as_of, recency_days))
    )


def screen(df: DataFrame, gates: dict[str, Column], near_miss: int = 1) -> DataFrame:
    """Evaluate every gate, count the passes and list rows failing at most ``near_miss`` of them."""
    flags = {f"g_{n}": gate(c).cast("int") for n, c in gates.items()}
    x = df.withColumns(flags)
    total = sum((F.col(f) for f in flags), F.lit(0))
    return x.withColumn("gates_passed", total).filter(F.col("gates_passed") >= len(gates) - near_miss)


def identity_coverage(daily: DataFrame, identities: DataFrame) -> DataFrame:
    """Each ticker's last trading date and its resolved identity, if any."""
    last = daily.groupBy("ticker").agg(F.max("date").alias("last_date"))
    return last.join(identities, "ticker", "left")


def universe_breadth(df: DataFrame, period: Column, value: str) -> DataFrame:
    """Per period the exact median over the universe, the share above zero and the count."""
    from barspark.operators.prefix import exact_quantiles

    x = df.withColumn("period", period).filter(F.col(value).isNotNull())
    agg = x.groupBy("period").agg(
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("share_positive"), F.count(F.lit(1)).alias("n"))
    return agg.join(exact_quantiles(x, ["period"], value, {"median": 0.5}), "period")


def rolling_volatility_quantiles(bars: DataFrame, by: str, order: str, window: int, qs: dict[str, float]) -> DataFrame:
    """Quantiles per key of the rolling deviation of log returns (full windows only)."""
    from barspark.operators.prefix import exact_quantiles

    s = Series((by,), (order,))
    x = bars.withColumn("lr", F.ln(F.col("close") / lag(s, F.col("close"))))
    w = s.last(window, True)
    x = x.withColumn("vol", F.when(F.count("lr").over(w) == window, F.stddev_samp("lr").over(w)))
    return exact_quantiles(x.filter(F.col("vol").isNotNull()), [by], "vol", qs)


def predicted_rvol(minutes: DataFrame, by: list[str], minute: str, profile: DataFrame, avg_volume: str) -> DataFrame:
    """Projected full-day relative volume: volume so far over the usual fraction by that minute, over the average.

    ``profile`` has one row per minute of day (minute, frac): at most 1440 rows.
    """
    w = Window.partitionBy(*by).orderBy(minute).rowsBetween(Window.unboundedPreceding, 0)
    x = minutes.withColumn("cum_volume", F.sum("volume").over(w)).join(profile, minute, "left")
    ok = (F.col("frac") > 0) & (F.col(avg_volume) > 0)
    return x.withColumn("pred_rvol", F.when(ok, F.col("cum_volume") / F.col("frac") / F.col(avg_volume)))


def fundamentals_at(daily: DataFrame, window: int = 20) -> DataFrame:
    """Average volume of the rows before each date and the opening gap."""
    s = Series(("ticker",), ("date",))
    return daily.withColumns({
        "avg_volume": rolling_mean(s, F.col("volume"), window), "gap": pct(F.col("open"), lag(s, F.col("close"))),
    })


def with_ntile(df: DataFrame, value: str, tie: str, tiles: int, out: str, by: list[str] | None = None) -> DataFrame:
    """NTILE over (value, tie) without a single-task sort."""
    r = ranked(df, by or [], value, tie)
    return r.withColumn(out, ntile_of(F.col("rn"), F.col("n"), tiles)).drop("rn", "rk", "n")
