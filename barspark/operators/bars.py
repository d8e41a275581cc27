"""Trade filtering and bar construction from a trade tape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.scalars import floor_bucket
from barspark.operators.asof import asof_join
from barspark.operators.prefix import UNB, running, spread, with_chunks
from barspark.session import stored

# Trade condition codes of the US consolidated tape.
EXCLUDED_CODES = [2, 7, 10, 13, 20, 21, 22, 29, 32, 52, 53]
OPENING_CODES = [17, 25]
CLOSING_CODES = [19, 8]


def _codes(codes: list[int]) -> Column:
    return F.array(*[F.lit(c) for c in codes])


def conditions_ok(conditions: Column) -> Column:
    """An auction print always counts; otherwise no excluded code may be present. NULL means no code."""
    c = F.coalesce(conditions, F.array().cast("array<int>"))
    return F.arrays_overlap(c, _codes(OPENING_CODES + CLOSING_CODES)) | ~F.arrays_overlap(c, _codes(EXCLUDED_CODES))


def lit_trades(trades: DataFrame) -> DataFrame:
    """Positive size, exchange-reported (trf_id = 0), not disqualified by its condition codes."""
    return trades.filter((F.col("size") > 0) & (F.col("trf_id") == 0) & conditions_ok(F.col("conditions")))


def effective_time(sip: str = "sip_ts", participant: str = "participant_ts") -> Column:
    """Tape time unless it is 0, then the participant's."""
    return F.coalesce(F.nullif(F.col(sip), F.lit(0).cast("long")), F.col(participant))


def prompt_trades(trades: DataFrame, max_delay: int, sip: str = "sip_ts",
                  participant: str = "participant_ts") -> DataFrame:
    """Drop late reports: keep a trade whose tape delay is at most ``max_delay`` or unknown (a time is 0)."""
    s, p = F.col(sip), F.col(participant)
    return trades.filter((s == 0) | (p == 0) | (s - p <= max_delay))


def _vwap_std() -> list[Column]:
    v, pv, p2v = F.col("volume"), F.col("dollar_volume"), F.col("__p2v")
    mean = pv / F.nullif(v.cast("double"), F.lit(0.0))
    var = p2v / F.nullif(v.cast("double"), F.lit(0.0)) - mean * mean
    return [mean.alias("vwap"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("vwstd")]


def tape_order(offset: Column, seq: Column) -> Column:
    """Order of trades inside a bucket by (time, sequence), for any 64-bit sequence.

    One decimal, the time inside the bucket above the sequence. Aggregates keep decimals in their hash tables, so min_by
    and max_by combine on the map side; a struct would force a sort of the tape.
    """
    return offset.cast("decimal(17,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + seq.cast("decimal(19,0)")


def time_bars(trades: DataFrame, by: list[str], width: int, t: str = "ts", seq: str = "seq", anchor: Column | None = None,
              first: int | None = None, last: int | None = None, mode: str = "floor") -> DataFrame:
    """OHLC, volume, dollar volume, VWAP, volume-weighted deviation and count per integer time bucket.

    ``anchor`` is subtracted from the time first; ``first``/``last`` bound the bucket numbers kept. Open and close
    follow (time, sequence). Everything combines on the map side, so a hot ticker costs one row per task and bucket.
    ``mode='round'`` centres buckets on the boundary instead of flooring.
    """
    off = F.col(t) if anchor is None else F.col(t) - anchor
    if mode == "round":
        off = off + F.lit(width // 2)
    d = trades.withColumn("bucket", floor_bucket(off, width))
    if first is not None:
        d = d.filter(F.col("bucket") >= first)
    if last is not None:
        d = d.filter(F.col("bucket") <= last)
    key = tape_order(F.pmod(off, F.lit(width)), F.col(seq))
    p, q = F.col("price"), F.col("size")
    g = d.groupBy(*by, "bucket").agg(
        F.min_by(p, key).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, key).alias("close"),
        F.sum(q).alias("volume"), F.sum(p * q).alias("dollar_volume"), F.sum(p * p * q).alias("__p2v"),
        F.count(F.lit(1)).alias("trade_count"),
    )
    return g.select(*by, "bucket", "open", "high", "low", "close", "volume", "dollar_volume", *_vwap_std(), "trade_count")


def count_bars(trades: DataFrame, by: list[str], width: int, t: str = "ts", anchor: Column | None = None,
               end_bucket: Column | None = None) -> DataFrame:
    """Volume and trade count per short bucket, buckets in [0, end_bucket)."""
    off = F.col(t) if anchor is None else F.col(t) - anchor
    d = trades.withColumn("bucket", floor_bucket(off, width)).filter(F.col("bucket") >= 0)
    if end_bucket is not None:
        d = d.filter(F.col("bucket") < end_bucket)
    return d.groupBy(*by, "bucket").agg(F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"))


def session_bars(trades: DataFrame, by: list[str], width: int, full_end: int, half_end: int, half_days: DataFrame,
                 t: str = "ts", anchor: Column | None = None) -> DataFrame:
    """``count_bars`` with an early close: ``half_days`` (one ``date`` per row, a few a year) end at ``half_end``."""
    flagged = trades.join(half_days.select("date", F.lit(True).alias("__half")), "date", "left")
    end = F.when(F.col("__half"), F.lit(half_end)).otherwise(F.lit(full_end))
    return count_bars(flagged, by, width, t, anchor, end)


def cumulative(bars: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    """Running totals of bar columns inside a session."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(UNB, 0)
    return bars.withColumns({f"cum_{c}": F.sum(c).over(w) for c in cols})


def order_flow_bars(trades: DataFrame, by: list[str], width: int, t: str = "ts", seq: str = "seq") -> DataFrame:
    """Epoch-anchored OHLCV bars with taker buy and sell dollar volume (``sign`` +1 / -1)."""
    d = trades.withColumn("bucket", floor_bucket(F.col(t), width))
    key = tape_order(F.pmod(F.col(t), F.lit(width)), F.col(seq))
    p, q = F.col("price"), F.col("size")
    flow = lambda cond: F.sum(F.when(cond, p * q).otherwise(0.0))
    g = d.groupBy(*by, "bucket").agg(
        F.min_by(p, key).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, key).alias("close"),
        F.sum(q).alias("volume"), F.sum(p * q).alias("dollar_volume"), F.sum(p * p * q).alias("__p2v"),
        F.count(F.lit(1)).alias("trade_count"), flow(F.col("sign") > 0).alias("buy_dollar_volume"),
        flow(F.col("sign") < 0).alias("sell_dollar_volume"),
    )
    ohlc = ["open", "high", "low", "close", "volume", "dollar_volume"]
    return g.select(*by, "bucket", (F.col("bucket") * width).alias("start"), ((F.col("bucket") + 1) * width).alias("end"), *ohlc,
                    *_vwap_std(), "trade_count", "buy_dollar_volume", "sell_dollar_volume")


def moment_bars(trades: DataFrame, by: list[str], width: int, t: str = "ts", per_unit: int = 100) -> DataFrame:
    """VWAP and volume-weighted deviation per fixed-length bucket in one pass, as precise as a second pass about the mean.

    A price is a whole number k of ticks (``per_unit`` make one unit of price) and a remainder. Moments of k are whole numbers, so they add up exactly and merge in
    any order, on the map side too; the spread about the mean, n * sum(k^2) - sum(k)^2, is exact, whatever the price level. The
    remainders, at most half a tick, add their own small moments. Sizes are whole numbers; a bucket without size has NULLs.
    """
    d = trades.withColumn("bucket", floor_bucket(F.col(t), width))
    q = F.col("size").cast("long")
    tick = F.lit(float(per_unit))
    k = F.round(F.col("price") * tick).cast("long")
    rest = F.col("price") - k / tick
    wide = lambda c: c.cast("decimal(19,0)")
    g = d.groupBy(*by, "bucket").agg(
        F.sum(q).alias("volume"), F.count(F.lit(1)).alias("trade_count"), F.sum(wide(q * k)).cast("decimal(28,0)").alias("__k"),
        F.sum((wide(q * k) * wide(k)).cast("decimal(38,0)")).alias("__kk"), F.sum(q * rest).alias("__d"),
        F.sum(q * k * rest).alias("__kd"), F.sum(q * rest * rest).alias("__dd"))
    n, sk, sd = F.nullif(F.col("volume").cast("double"), F.lit(0.0)), F.col("__k").cast("double"), F.col("__d")
    apart = (F.col("volume").cast("decimal(18,0)") * F.col("__kk") - F.col("__k") * F.col("__k")).cast("double")
    m2 = apart / n / (tick * tick) + 2 * (F.col("__kd") - sk * sd / n) / tick + F.col("__dd") - sd * sd / n
    return g.select(*by, "bucket", "volume", ((sk / tick + sd) / n).alias("vwap"), "trade_count",
                    F.sqrt(F.greatest(m2, F.lit(0.0)) / n).alias("vwstd"))


def resample(bars: DataFrame, by: list[str], t: str, width: int) -> DataFrame:
    """Coarser bars from finer ones."""
    b = floor_bucket(F.col(t), width)
    return bars.groupBy(*by, b.alias("bucket")).agg(
        F.min_by("open", t).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", t).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"),
    )


def bar_shape(bars: DataFrame, by: list[str], t: str) -> DataFrame:
    """Relative deviation, log return of VWAP against the previous bar, and time since it.

    The log return is that of IEEE arithmetic: infinite from a VWAP of zero, minus infinite to one, and NaN from zero to zero,
    between VWAPs of opposite signs and where one is NaN. A bar without a time is the last.
    """
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(t))
    v, p = F.col("vwap"), F.lag("vwap").over(w)
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    ratio = v / F.nullif(p, F.lit(0.0))
    # Spark has NULL for logarithms of zero and below, and NaN above all numbers
    from_zero = F.when((v > 0) & ~F.isnan(v), inf).when(v.isNotNull(), nan)
    return bars.withColumns({
        "rel_std": F.col("vwstd") / F.nullif(F.col("vwap"), F.lit(0.0)),
        "log_ret": F.when(p == 0, from_zero).when(ratio > 0, F.ln(ratio)).when(ratio == 0, -inf).when(ratio < 0, nan),
        "gap": F.col(t) - F.lag(t).over(w),
    })


def partial_candle(bars: DataFrame, by: list[str], minute: str, cutoff: int, rth_open: int = 570) -> DataFrame:
    """The day's candle as known at ``cutoff``: regular-hours OHLC before it (NULL if none), volume from premarket on."""
    m = F.col(minute)
    rth = (m >= rth_open) & (m < cutoff)
    only = lambda c: F.when(rth, F.col(c))
    at = F.when(rth, m)
    return bars.filter(m < cutoff).groupBy(*by).agg(
        F.min_by(only("open"), at).alias("open"), F.max(only("high")).alias("high"), F.min(only("low")).alias("low"),
        F.max_by(only("close"), at).alias("close"), F.sum("volume").alias("volume"),
        F.count(at).alias("n_rth"),
    )


def premarket_summary(bars: DataFrame, by: list[str], minute: str, premarket: int = 240,
                      rth_open: int = 570, rth_close: int = 960) -> DataFrame:
    """Premarket volume and the first regular-hours open per key."""
    m = F.col(minute)
    pre, rth = (m >= premarket) & (m < rth_open), (m >= rth_open) & (m < rth_close)
    return bars.groupBy(*by).agg(
        F.sum(F.when(pre, F.col("volume")).otherwise(0)).alias("premarket_volume"),
        F.min_by(F.when(rth, F.col("open")), F.when(rth, m)).alias("rth_open"),
    )


def checkpoint_snapshots(bars: DataFrame, by: list[str], minute: str, checkpoints: list[int], min_dollar: float,
                         start: int = 240, rth_open: int = 570, end: int = 960) -> DataFrame:
    """Session-so-far aggregates at each checkpoint minute for liquid (key, day) groups.

    Instead of pairing every bar with every checkpoint, a bar goes to the first checkpoint at or after it; the
    per-interval aggregates are then accumulated over the few checkpoints.
    """
    cps = sorted(checkpoints)
    m = F.col(minute)
    slot = F.lit(None).cast("int")
    for c in reversed(cps):
        slot = F.when(m <= c, F.lit(c)).otherwise(slot)
    in_rth = m >= rth_open
    cells = (
        bars.filter((m >= start) & (m < end)).withColumn("checkpoint", slot)
        .groupBy(*by, "checkpoint")
        .agg(
            F.sum("volume").alias("v"), F.sum(F.when(in_rth, F.col("volume")).otherwise(0)).alias("rv"),
            F.sum(F.when(in_rth, F.col("close") * F.col("volume"))).alias("dv"),
            F.max("high").alias("h"), F.min("low").alias("l"), F.count(F.lit(1)).alias("k"),
            F.max_by("close", minute).alias("c"),
        )
    )
    day = Window.partitionBy(*by)
    liquid = cells.withColumn("__dv", F.sum("dv").over(day)).filter(F.col("__dv") >= min_dollar)
    # one row per (group, checkpoint): at most len(checkpoints) rows per group
    per = liquid.filter(F.col("checkpoint").isNotNull()).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("checkpoint", F.struct("v", "rv", "h", "l", "k", "c")))).alias("__m")
    )
    grid = per.select(*by, F.explode(F.array(*[F.lit(c) for c in cps])).alias("checkpoint"), "__m")
    w = Window.partitionBy(*by).orderBy("checkpoint").rowsBetween(UNB, 0)
    x = grid.withColumn("__x", F.try_element_at("__m", F.col("checkpoint")))
    return x.select(
        *by, "checkpoint",
        F.sum("__x.v").over(w).alias("cum_vol"), F.sum("__x.rv").over(w).alias("rth_vol"),
        F.max("__x.h").over(w).alias("hi_sofar"), F.min("__x.l").over(w).alias("lo_sofar"),
        F.sum("__x.k").over(w).alias("n_bars"), F.last("__x.c", ignorenulls=True).over(w).alias("px"),
    ).filter(F.col("n_bars").isNotNull())


def market_hours(trades: DataFrame, by: list[str], t: str = "ts") -> DataFrame:
    """Session bounds from auction prints: earliest opening and earliest closing print, both required."""
    c = F.coalesce(F.col("conditions"), F.array().cast("array<int>"))
    g = trades.groupBy(*by).agg(
        F.min(F.when(F.arrays_overlap(c, _codes(OPENING_CODES)), F.col(t))).alias("open_ts"),
        F.min(F.when(F.arrays_overlap(c, _codes(CLOSING_CODES)), F.col(t))).alias("close_ts"),
    )
    return g.filter(F.col("open_ts").isNotNull() & F.col("close_ts").isNotNull())


def split_sessions(trades: DataFrame, hours: DataFrame, by: list[str], t: str = "ts") -> DataFrame:
    """Label each trade premarket / regular / postmarket by its group's bounds."""
    ts = F.col(t)
    label = (F.when(ts < F.col("open_ts"), "pre").when(ts < F.col("close_ts"), "regular").otherwise("post"))
    return trades.join(hours, by).withColumn("session", label)


# ----- bars closed by volume, dollars or imbalance -----

def quantity_bars(trades: DataFrame, by: list[str], threshold: float, quantity: Column, chunk: Column,
                  t: str = "ts", seq: str = "seq", keep_partial: bool = True) -> DataFrame:
    """Bars of exactly ``threshold`` units of ``quantity``; a trade that crosses a boundary is split.

    The running total places every trade on the number line, so its fragments follow from arithmetic and no loop over
    the tape is needed. ``chunk`` spreads a hot key (see ``prefix.running``). Fragments are summed per bar on the map
    side; the whole-trade count goes to the bar of the trade's first fragment. A trade may span any number of bars.
    """
    v = F.lit(float(threshold))
    d = trades.withColumn("__q", quantity.cast("double")).filter(F.col("__q") > 0)
    r = running(d, by, [t, seq], chunk, {"__c1": ("sum", F.col("__q"))})
    c0, c1 = F.col("__c1") - F.col("__q"), F.col("__c1")
    k0, k1 = F.floor(c0 / v), F.ceil(c1 / v) - 1
    r = r.withColumns({"__k0": k0.cast("long"), "__k1": F.greatest(k0, k1).cast("long")})
    frag = (
        spread(r, F.col("__k0"), F.col("__k1"), "bar")
        .withColumn("__f", F.least(c1, (F.col("bar") + 1) * v) - F.greatest(c0, F.col("bar") * v))
        .filter(F.col("__f") > 0)
    )
    key = F.struct(F.col(t), F.col(seq))
    p, f = F.col("price"), F.col("__f")
    g = frag.groupBy(*by, "bar").agg(
        F.min_by(p, key).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, key).alias("close"),
        F.sum(f).alias("volume"), F.sum(p * f).alias("dollar_volume"), F.sum(p * p * f).alias("__p2v"),
        F.sum(F.when(F.col("bar") == F.col("__k0"), 1).otherwise(0)).alias("trade_count"),
        F.min(t).alias("start_ts"), F.max(t).alias("end_ts"),
    )
    if not keep_partial:
        g = g.filter(F.col("volume") >= v * (1 - 1e-9))
    return g.select(*by, "bar", "open", "high", "low", "close", "volume", "dollar_volume", *_vwap_std(),
                    "trade_count", "start_ts", "end_ts")


def _signed_total(trades: DataFrame, by: list[str], quantity: Column, sign: Column, chunk: Column, t: str, seq: str) -> DataFrame:
    """Signed quantity __x of each trade and its running total __s; chunk ids in __ck."""
    d = trades.withColumn("__q", quantity.cast("double")).filter(F.col("__q") > 0)
    d = d.withColumn("__ck", chunk).withColumn("__x", F.col("__q") * sign)
    return running(d, by, [t, seq], "__ck", {"__s": ("sum", F.col("__x"))})


def _with_levels(s: DataFrame, by: list[str], thresholds: dict[str, Column], t: str, seq: str) -> DataFrame:
    """For each named threshold T the level index before (__k0 and the name) and after (__k1 and the name) each trade.

    A bar closes whenever S is a whole threshold away from the level k at which the previous bar closed, and k moves by
    one. After a trade k lies in [floor(S/T), ceil(S/T)]; when that interval moves up k is its lower end, when it moves
    down k is its upper end, and while it stays put k does not change. The level is therefore the latest forced value:
    a running ``last`` instead of a loop over the tape. All thresholds share one pass.
    """
    forced, aggs = {}, {}
    for name, th in thresholds.items():
        z1, z0 = F.col("__s") / th, (F.col("__s") - F.col("__x")) / th
        lo1, hi1, lo0, hi0 = F.floor(z1), F.ceil(z1), F.floor(z0), F.ceil(z0)
        up = (lo1 > lo0) | ((lo1 == lo0) & (hi1 > hi0))
        down = (lo1 < lo0) | ((lo1 == lo0) & (hi1 < hi0))
        forced[f"__f{name}"] = F.when(up, lo1).when(down, hi1).when(lo1 == hi1, lo1)
        aggs |= {f"__k1{name}": ("last", F.col(f"__f{name}")), f"__k0{name}": ("last_before", F.col(f"__f{name}"))}
    k = running(s.withColumns(forced), by, [t, seq], "__ck", aggs)
    return k.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in aggs}).drop(*forced)


def _imbalance_levels(trades: DataFrame, by: list[str], threshold: Column, quantity: Column, sign: Column,
                      chunk: Column, t: str, seq: str) -> DataFrame:
    """Running signed quantity __s, the level index before (__k0) and after (__k1) each trade, and the levels moved (__mv)."""
    k = _with_levels(_signed_total(trades, by, quantity, sign, chunk, t, seq), by, {"": threshold}, t, seq)
    return k.withColumn("__mv", F.abs(F.col("__k1") - F.col("__k0")))


def imbalance_bars(trades: DataFrame, by: list[str], threshold: float | Column, quantity: Column, sign: Column,
                   chunk: Column, t: str = "ts", seq: str = "seq") -> DataFrame:
    """Bars that close when signed quantity since the last close reaches +-threshold; trades are split exactly.

    ``bar`` counts closed bars before the fragment, so the last, open bar is included.
    """
    th = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    k = _imbalance_levels(trades, by, th, quantity, sign, chunk, t, seq)
    n = running(k, by, [t, seq], "__ck", {"__n1": ("sum", F.col("__mv"))})
    # on the signed axis the trade travels from S0 to S1 and crosses __mv levels in order
    s1, s0, dirn = F.col("__s"), F.col("__s") - F.col("__x"), F.signum(F.col("__x"))
    j = F.col("__j")
    level = lambda i: (F.col("__k0") + dirn * i) * th
    left = F.when(j == 0, s0).otherwise(level(j))
    right = F.when(j == F.col("__mv"), s1).otherwise(level(j + 1))
    frag = (
        spread(n, F.lit(0).cast("long"), F.col("__mv").cast("long"), "__j")
        .withColumn("__f", F.abs(right - left)).filter(F.col("__f") > 0)
        .withColumn("bar", (F.col("__n1") - F.col("__mv") + j).cast("long"))
    )
    p, f, key = F.col("price"), F.col("__f"), F.struct(F.col(t), F.col(seq))
    up = F.col("__x") > 0
    return frag.groupBy(*by, "bar").agg(
        F.min_by(p, key).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, key).alias("close"),
        F.sum(f).alias("quantity"), F.sum(F.when(up, f).otherwise(0.0)).alias("buy"),
        F.sum(F.when(up, 0.0).otherwise(f)).alias("sell"), F.min(t).alias("start_ts"), F.max(t).alias("end_ts"),
    ).withColumn("imbalance", F.col("buy") - F.col("sell"))


def imbalance_bar_counts(trades: DataFrame, by: list[str], thresholds: list[Column], quantity: Column, sign: Column,
                         chunk: Column, t: str = "ts", seq: str = "seq") -> DataFrame:
    """Per key the number of imbalance bars (an open one included) at each threshold, in ``n_bars`` as an array, without building
    them: one running total and one pass of levels for all thresholds. A threshold of NULL has no count."""
    names = [str(i) for i in range(len(thresholds))]
    k = _with_levels(_signed_total(trades, by, quantity, sign, chunk, t, seq), by, dict(zip(names, thresholds)), t, seq)
    last, counts = F.struct(F.col(t), F.col(seq)), []
    for name, th in zip(names, thresholds):
        moved = F.abs(F.col(f"__k1{name}") - F.col(f"__k0{name}"))
        # quantity is left over after the last close unless the last trade ends exactly on the level it closes at
        rest = F.when((moved == 0) | (F.col("__s") / th != F.col(f"__k1{name}")), 1).otherwise(0)
        known = F.max(th).isNotNull()
        counts.append(F.when(known, F.sum(moved) + F.max_by(rest, last)))
    return k.groupBy(*by).agg(F.array(*counts).alias("n_bars"))


def imbalance_bar_count(trades: DataFrame, by: list[str], threshold: Column, quantity: Column, sign: Column,
                        chunk: Column, t: str = "ts", seq: str = "seq") -> DataFrame:
    """``imbalance_bar_counts`` at a single threshold."""
    n = imbalance_bar_counts(trades, by, [threshold], quantity, sign, chunk, t, seq)
    return n.withColumn("n_bars", F.get("n_bars", F.lit(0)))


def imbalance_thresholds(trades: DataFrame, by: list[str], min_bars: int, quantity: Column, sign: Column,
                         chunk: Column, t: str = "ts", seq: str = "seq") -> DataFrame:
    """Per key the first threshold of the halving ladder (from a power of two near total / min_bars, at least 1) that
    yields ``min_bars`` bars; where none down to 1 does, the last rung, with the bars it yields.

    The ladder ends at 1, so the passes are bounded by the size of the tape's quantities. A few rungs are tried per pass, over
    the same rows, and only keys still without an answer go into the next. What passes between rounds is one row per key.
    """
    total = F.sum(F.when(quantity > 0, quantity.cast("double")))
    raw = F.greatest(total / F.lit(float(max(1, min_bars))), F.lit(1.0))
    todo = trades.groupBy(*by).agg(F.pow(F.lit(2.0), F.rint(F.log2(raw))).alias("__th"))
    todo = todo.withColumn("__th", F.greatest("__th", F.lit(1.0)))
    found, per_pass = None, 4
    while True:
        rungs = [F.col("__th") / F.lit(float(2**i)) for i in range(per_pass)]
        rungs = [F.when(r >= 1.0, r) for r in rungs]
        n = imbalance_bar_counts(trades.join(todo, by), by, rungs, quantity, sign, chunk, t, seq).join(todo, by)
        tried = F.filter(F.zip_with(F.array(*rungs), F.col("n_bars"), lambda c, m: F.struct(c.alias("c"), m.alias("m"))), lambda x: x["c"].isNotNull())
        n = n.select(*by, F.explode(tried).alias("x")).select(*by, F.col("x.c").alias("__c"), F.col("x.m").alias("n_bars"))
        ok = F.col("n_bars") >= min_bars
        best = n.groupBy(*by).agg(
            F.max(F.when(ok, F.col("__c"))).alias("threshold"),
            F.max_by("n_bars", F.when(ok, F.col("__c"))).alias("n_bars"),
            F.min("__c").alias("__low"), F.min_by("n_bars", "__c").alias("__lown"),
        )
        best = stored(best)
        final = F.col("__low") / 2.0 < 1.0
        got = best.filter(F.col("threshold").isNotNull() | final).select(
            *by, F.coalesce("threshold", "__low").alias("threshold"), F.coalesce("n_bars", "__lown").alias("n_bars"))
        found = got if found is None else found.unionByName(got)
        todo = best.filter(F.col("threshold").isNull() & ~final).select(*by, (F.col("__low") / 2.0).alias("__th"))
        if todo.isEmpty():
            return found


def anchors(times: DataFrame, by: list[str], window: int, widest: int, t: str = "ts") -> DataFrame:
    """(by, t): the times that begin a group, if a group takes all times less than ``window`` after its first one.

    ``times`` is unique by key and time. A time after a gap of at least the window begins a group for certain. From such heads
    the others are reached by pointers: every time points to the first one at least a window later, if no head comes before
    that. In each round what has been reached follows the pointers, and the pointers are doubled, so the groups of a burst of m are found in log2 m
    rounds of joins by (key, time), which no key or burst makes uneven. Rounds go to the shared folder.
    """
    d = with_chunks(times.select(*by, t), by, [t], widest)
    d = running(d, by, [t], "__ck", {"__prev": ("last", F.col(t))}, inclusive=False)
    d = d.select(*by, t, (F.col("__prev").isNull() | (F.col(t) - F.col("__prev") >= window)).alias("__head"))
    d = stored(d)
    later = d.select(*by, F.col(t).alias("__next"), F.col(t).alias("__at"), F.col("__head").alias("__stop"))
    jump = asof_join(d.withColumn("__from", F.col(t) + window), later, by, "__from", "__at", ["__next", "__stop"], "forward", chunk=widest)
    jump = stored(jump.filter(~F.col("__stop")).select(*by, t, "__next"))
    reached = d.filter("__head").select(*by, t)
    while not jump.isEmpty():
        reached = stored(reached.unionByName(reached.join(jump, [*by, t]).select(*by, F.col("__next").alias(t))))
        onward = jump.select(*by, F.col(t).alias("__next"), F.col("__next").alias("__then"))
        jump = stored(jump.join(onward, [*by, "__next"]).select(*by, t, F.col("__then").alias("__next")))
    return reached


def merge_bursts(trades: DataFrame, by: list[str], window: int, widest: int, t: str = "ts",
                 seq: str = "seq") -> DataFrame:
    """Merge trades less than ``window`` after the FIRST trade of their group (see ``anchors``).

    Trades of one time are added up first. Ordered scans are cut into chunks of at most ``widest`` time units and of bounded
    size, so a burst of any length spreads over tasks.
    """
    p, q = F.col("price"), F.col("size")
    at = trades.groupBy(*by, t).agg(
        F.sum(q).alias("size"), F.sum(p * q).alias("__pq"), F.min_by(p, seq).alias("first_price"), F.max_by(p, seq).alias("last_price"),
        F.count(F.lit(1)).alias("trade_count"))
    at = stored(at)
    firsts = anchors(at, by, window, widest, t).withColumn("__a", F.col(t))
    d = with_chunks(at.join(firsts, [*by, t], "left"), by, [t], widest)
    d = running(d, by, [t], "__ck", {"anchor": ("last", F.col("__a"))})
    return d.groupBy(*by, "anchor").agg(
        F.sum("size").alias("size"), (F.sum("__pq") / F.nullif(F.sum("size").cast("double"), F.lit(0.0))).alias("vwap"),
        F.min_by("first_price", t).alias("first_price"), F.max_by("last_price", t).alias("last_price"),
        F.sum("trade_count").alias("trade_count"), F.max(t).alias("end_ts"),
    )
