"""Chains of first events: an entry waits for a bar, that bar for an exit, an exit perhaps for another entry.

A session's (or episode's) bars are one sorted array, as long as the calendar allows. A link of a chain is the first later
bar on which a condition holds. Conditions that don't depend on the chain are pointers, made by windows before the bars
are gathered; the others look ahead in the array. All of it is column expressions, and links are bound by ``let``, so
that none is worked out more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.indicators import UNB, Series
from barspark.operators.trips import _series_arrays



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(i: Column) -> Column:
    """The bar with this number, null beyond the series."""
    return F.get(F.col("bars"), i - 1)


def after(i: Column, holds: Callable[[Column], Column], most: int | None = None) -> Column:
    """The first bar after bar i, of the next ``most``, on which the condition holds."""
    n = F.lit(most) if most is not None else F.greatest(F.size("bars") - i, F.lit(1))
    return F.get(F.filter(F.slice("bars", i + 1, n), lambda b: F.coalesce(holds(b), F.lit(False))), F.lit(0))


def next_where(s: Series, condition: Column, same: bool = False) -> Column:
    """Number of the first later bar (or this one) on which a condition holds that is the same for all chains."""
    back = Window.partitionBy(*s.by).orderBy(*[F.col(c).desc() for c in s.order]).rowsBetween(UNB, 0 if same else -1)
    return F.min(F.when(condition, F.col("i"))).over(back)


def numbered(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumn("i", F.row_number().over(s.spec()))


def _exits(e: Column, x: Column, order: str, reason: Callable[[Column], Column], price: str = "close") -> Column:
    """exit_at, exit_price, exit_reason by the exit bar, or the last bar's close if there is none."""
    last = F.element_at("bars", -1)
    return F.struct(
        F.coalesce(x[order], last[order]).cast("long").alias("exit_at"), F.coalesce(x[price], last["close"]).alias("exit_price"),
        F.when(x.isNull(), F.lit("moc")).otherwise(reason(x)).alias("exit_reason"))


def fade_legs(df: DataFrame, s: Series, arm: Column, start: int = 585, moc: int = 960, entry: str = "down_tick", legs: int = 1,
              n_since: int = 5, arm_bars: int = 60) -> DataFrame:
    """Fades of a new session closing high: a short that ends when the average makes a new high, after which the next
    leg waits for its own entry. Every signal is on its own.

    ``entry``: the next bar on which the average falls (``down_tick``), the next one ``n_since`` bars after its high
    (``bars_since``, the signal bar included), or the first of ``arm_bars`` bars on which it is under its value at the
    signal (``cross``, without further legs).
    """
    order = s.order[0]
    high = F.col("ema") > F.lag("ema_hi").over(s.spec())
    x = numbered(df, s).withColumn("is_high", F.coalesce(high, F.lit(False)))
    waits = F.col("bars_since_hi") == n_since if entry == "bars_since" else F.col("ema") < F.col("ema_p")
    x = x.withColumns({"to_entry": next_where(s, waits, same=entry == "bars_since"), "to_exit": next_where(s, F.col("is_high") | (F.col(order) >= moc))})
    signal = (F.col(order) >= start) & (F.col("close") > F.col("sess_hic_p")) & arm
    g = _series_arrays(x, list(s.by), order, signal, ["close", "ema", "ema_hi", "is_high", "to_entry", "to_exit"], ["ema"])
    empty = F.array().cast("array<struct<entry_at:bigint,entry_price:double,exit_at:bigint,exit_price:double,exit_reason:string,stop_level:double,leg:int>>")

    def leg(found: Column, k: int) -> Column:
        def trip(e: Column, b: Column) -> Column:
            out = _exits(e, b, order, lambda z: F.when(z["is_high"], "ema_max_stop").otherwise("moc"))
            row = let(out, lambda z: F.struct(e[order].cast("long").alias("entry_at"), e["close"].alias("entry_price"), z["exit_at"], z["exit_price"],
                                              z["exit_reason"], e["ema_hi"].alias("stop_level"), F.lit(k).alias("leg")))
            more = empty
            if k + 1 < legs:
                more = F.when(b["is_high"] & (b[order] < moc), leg(at(b["to_entry"]), k + 1)).otherwise(empty)
            return F.concat(F.array(row), more)

        return let(found, lambda e: F.when(e.isNull(), empty).otherwise(let(at(e["to_exit"]), lambda b: trip(e, b))))

    first = (lambda e: after(e["i"], lambda b: b["ema"] < e["ema"], arm_bars)) if entry == "cross" else (lambda e: at(at(e["i"])["to_entry"]))
    trips = F.flatten(F.transform("entries", lambda e: leg(first(e), 0)))
    return g.select(*s.by, F.explode(trips).alias("t")).select(*s.by, "t.*")


def drive_legs(df: DataFrame, s: Series, qualifies: Column, dead: Column, legs: int = 1, limit: bool = False, moc: int = 960) -> DataFrame:
    """Opening-drive entries. After a stop-out the next leg waits for a new session low of the average and then for the
    next qualifying bar. ``limit``: an entry above the average waits for one bar at the average instead."""
    order = s.order[0]
    good = F.coalesce(qualifies & ~dead, F.lit(False))
    w = s.spec()
    x = numbered(df, s).withColumns({"is_good": good, "is_dead": F.coalesce(dead, F.lit(False)), "dip": F.lead("low").over(w)})
    now = (F.col("close") <= F.col("ema")) | F.lit(not limit)
    enters = F.col("is_good") & (now | (F.col("dip") <= F.col("ema")))
    x = x.withColumns({"now": F.coalesce(now, F.lit(False)), "to_entry": next_where(s, enters, same=True)})
    g = _series_arrays(x, list(s.by), order, F.col("i") == 1, ["close", "ema", "ema_lo", "is_dead", "now", "to_entry"], ["to_entry"])
    empty = F.array().cast("array<struct<entry_at:bigint,entry_price:double,exit_at:bigint,exit_price:double,exit_reason:string,stop_level:double,leg:int>>")

    def leg(found: Column, k: int) -> Column:
        def trip(q: Column, e: Column, b: Column) -> Column:
            why = lambda z: F.when(z["ema"] < q["ema_lo"], "stop").when(z["is_dead"], "exhaust").otherwise("moc")
            row = let(_exits(e, b, order, why), lambda z: F.struct(
                e[order].cast("long").alias("entry_at"), F.when(q["now"], q["close"]).otherwise(q["ema"]).alias("entry_price"), z["exit_at"], z["exit_price"],
                z["exit_reason"], q["ema_lo"].alias("stop_level"), F.lit(k).alias("leg")))
            more = empty
            if k + 1 < legs:
                again = let(after(b["i"], lambda z: z["ema_lo"] < b["ema_lo"]), lambda z: leg(at(z["to_entry"]), k + 1))
                more = F.when(b["ema"] < q["ema_lo"], again).otherwise(empty)
            return F.concat(F.array(row), F.coalesce(more, empty))

        def filled(q: Column) -> Column:
            return let(at(q["i"] + F.when(q["now"], 0).otherwise(1)), lambda e: let(
                after(e["i"], lambda b: (b["ema"] < q["ema_lo"]) | b["is_dead"] | (b[order] >= moc)), lambda b: trip(q, e, b)))

        return let(found, lambda q: F.when(q.isNull(), empty).otherwise(filled(q)))

    trips = F.flatten(F.transform("entries", lambda e: leg(at(e["to_entry"]), 0)))
    return g.select(*s.by, F.explode(trips).alias("t")).select(*s.by, "t.*")


def extreme_fills(df: DataFrame, s: Series, signal: Column, trail: bool, rise: float = 0.0, downside: bool = True, moc: int = 960) -> DataFrame:
    """Signals at a session extreme, filled when the close leaves the best two-bar extreme since the signal (``trail``) or
    when price has run ``rise`` further, and held to the session extreme before the fill or the close."""
    order = s.order[0]
    w = s.spec()
    two = F.greatest(F.lag("high").over(w), "high") if downside else F.least(F.lag("low").over(w), "low")
    x = numbered(df, s).withColumns({"two": two, "stop_level": F.col("sess_lo_p" if downside else "sess_hi_p")})
    g = _series_arrays(x, list(s.by), order, signal, ["open", "high", "low", "close", "two", "stop_level"], ["close", "two"])

    def trailed(e: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            best = F.least(acc["best"], b["two"]) if downside else F.greatest(acc["best"], b["two"])
            out = (b["close"] > best) if downside else (b["close"] < best)
            return F.struct(best.alias("best"), F.coalesce(acc["i"], F.when(out, b["i"])).alias("i"))

        later = F.slice("bars", e["i"] + 1, F.greatest(F.size("bars") - e["i"], F.lit(1)))
        found = F.aggregate(later, F.struct(e["two"].alias("best"), F.lit(None).cast("int").alias("i")), step)
        return let(at(found["i"]), lambda b: F.struct(b.alias("b"), b["close"].alias("px")))

    def run(e: Column) -> Column:
        level = e["close"] * ((1 - rise) if downside else (1 + rise))
        reached = (lambda b: b["low"] <= level) if downside else (lambda b: b["high"] >= level)
        fill = F.least if downside else F.greatest
        return let(after(e["i"], reached), lambda b: F.struct(b.alias("b"), F.when(b.isNotNull(), fill(level, b["open"])).alias("px")))

    def trip(f: Column) -> Column:
        b = f["b"]
        hit = (lambda z: z["low"] <= b["stop_level"]) if downside else (lambda z: z["high"] >= b["stop_level"])
        ends = after(b["i"], lambda z: F.coalesce(hit(z), F.lit(False)) | (z[order] >= moc))
        why = lambda z: F.when(F.coalesce(hit(z), F.lit(False)), "session_stop").otherwise("moc")
        return let(ends, lambda z: let(_exits(b, z, order, why), lambda o: F.struct(
            b[order].cast("long").alias("entry_at"), f["px"].alias("entry_price"), o["exit_at"], o["exit_price"], o["exit_reason"])))

    fills = F.transform("entries", lambda e: trailed(e) if trail else run(e))
    trips = F.transform(F.filter(fills, lambda f: f["b"].isNotNull()), trip)
    return g.select(*s.by, F.explode(trips).alias("t")).select(*s.by, "t.*")


def resting_orders(df: DataFrame, s: Series, signal: Column, entry_cap: int = 5, exit_cap: int = 5) -> DataFrame:
    """Signals bought by a limit at ``entry_low`` within ``entry_cap`` bars, else at the open after them; a low at or under
    the stop (``stop_low``, at least the low of the entry bar) then offers at ``trail_high`` for ``exit_cap`` bars, and
    sells at the open after those. What has no bar to be filled on is no trip; what isn't sold is marked at the last close."""
    order = s.order[0]
    x = numbered(df, s)
    x = x.withColumns({"to_dip": next_where(s, F.col("low") <= F.col("entry_low")), "to_top": next_where(s, F.col("high") >= F.col("trail_high"))})
    g = _series_arrays(x, list(s.by), order, signal, ["open", "low", "close", "entry_low", "trail_high", "stop_low", "to_dip", "to_top"], ["to_dip"])
    last = F.element_at("bars", -1)

    def bought(e: Column) -> Column:
        dips = F.coalesce(e["to_dip"] <= e["i"] + entry_cap, F.lit(False))
        return let(F.when(dips, at(e["to_dip"])).otherwise(at(e["i"] + entry_cap + 1)), lambda b: F.struct(
            b.alias("b"), F.when(dips, F.least(b["entry_low"], b["open"])).otherwise(b["open"]).alias("px")))

    def sold(b: Column, k: Column) -> Column:
        """By the bar that touched the stop."""
        tops = F.coalesce(k["to_top"] <= k["i"] + exit_cap, F.lit(False))
        return let(F.when(tops, at(k["to_top"])).otherwise(at(k["i"] + exit_cap + 1)), lambda z: F.struct(
            F.coalesce(z[order], last[order]).alias("exit_at"),
            F.when(z.isNull(), last["close"]).when(tops, z["trail_high"]).otherwise(z["open"]).alias("exit_price"),
            F.when(z.isNull(), "mtm").when(tops, "stop_limit").otherwise("stop_limit_timeout").alias("exit_reason")))

    def trip(f: Column) -> Column:
        b = f["b"]
        stop = after(b["i"], lambda z: z["low"] <= F.greatest(z["stop_low"], b["low"]))
        return let(stop, lambda k: let(sold(b, k), lambda o: F.struct(
            b[order].alias("entry_at"), f["px"].alias("entry_price"), o["exit_at"], o["exit_price"], o["exit_reason"])))

    fills = F.filter(F.transform("entries", bought), lambda f: f["b"].isNotNull())
    return g.select(*s.by, F.explode(F.transform(fills, trip)).alias("t")).select(*s.by, "t.*")


def one_at_a_time(df: DataFrame, s: Series, trigger: Column, moc: int = 960, carry: tuple[str, ...] = ()) -> DataFrame:
    """Entries at the close, held to a close at or under ``stop_level`` or the end; while one is held no trigger counts.
    A trigger on the exit bar counts again."""
    order = s.order[0]
    g = _series_arrays(df, list(s.by), order, trigger, ["close"], ["close", "stop_level", *carry])

    def held(e: Column) -> Column:
        return let(after(e["i"], lambda b: (b["close"] <= e["stop_level"]) | (b[order] >= moc)), lambda b: let(
            _exits(e, b, order, lambda z: F.when(z["close"] <= e["stop_level"], "stop").otherwise("moc")),
            lambda o: F.struct(e["i"].alias("i"), F.coalesce(b["i"], F.size("bars") + 1).alias("free"), e[order].cast("long").alias("entry_at"),
                               e["close"].alias("entry_price"), o["exit_at"], o["exit_price"], o["exit_reason"], *(e[c].alias(c) for c in carry))))

    t = g.select(*s.by, F.transform("entries", held).alias("all"))
    kind = t.schema["all"].dataType.simpleString()
    step = lambda acc, x: F.when(x["i"] >= acc["free"], F.struct(x["free"], F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)
    taken = F.aggregate("all", F.struct(F.lit(0).alias("free"), F.array().cast(kind).alias("taken")), step, lambda acc: acc["taken"])
    return t.select(*s.by, F.explode(taken).alias("t")).select(*s.by, "t.*").drop("i", "free")


def rearmed(df: DataFrame, s: Series, ok: Column, within: int, floors: tuple[float, float, float], rearm: str, min_stop: float, moc: int = 960) -> DataFrame:
    """Breakouts while armed: a bar fires within ``within`` bars of a new high of the average (of the session, 60 or 20
    bars; each asks for its own volume climb), and disarms. The average under the reference arms again and forgets the
    highs: ``rolling`` and ``session`` are lows of the average, ``last_stop`` the low at the last firing.

    Whether a bar fires depends on the firings before it, so a session's bars are folded in order, for the numbers of the
    bars that fire only.
    """
    order = s.order[0]
    x = numbered(df, s).withColumn("is_ok", F.coalesce(ok, F.lit(False)))
    cols = ["close", "ema", "ema_low20", "ema_low20_p", "ema_lo_p", "vol_climb", "new_hi", "new_hi60", "new_hi20", "is_ok"]
    g = _series_arrays(x, list(s.by), order, F.col("is_ok"), cols, [])
    tick = lambda n, new: F.when(n >= 0, n + 1).when(new, F.lit(0)).otherwise(F.lit(-1))

    def step(acc: Column, b: Column) -> Column:
        return let(F.struct(tick(acc["a"], b["new_hi"]).alias("a"), tick(acc["b"], b["new_hi60"]).alias("b"), tick(acc["c"], b["new_hi20"]).alias("c")), lambda n: let(
            F.struct(fires(acc, b, n).alias("fire"), F.coalesce(b["ema"] < reference(acc, b), F.lit(False)).alias("low")), lambda d: move(acc, b, n, d)))

    def fires(acc: Column, b: Column, n: Column) -> Column:
        timed = F.lit(False)
        for k, f in zip("abc", floors):
            near = (n[k] >= 0) & (n[k] < within)
            timed = timed | (near if f <= 0 else near & F.coalesce(b["vol_climb"] >= f, F.lit(False)))
        return acc["armed"] & b["is_ok"] & timed

    def reference(acc: Column, b: Column) -> Column:
        return {"rolling": b["ema_low20_p"], "session": b["ema_lo_p"], "last_stop": acc["stop"]}[rearm]

    def move(acc: Column, b: Column, n: Column, d: Column) -> Column:
        again = ~d["fire"] & d["low"]
        return F.struct(
            F.when(d["fire"], F.lit(False)).when(d["low"], F.lit(True)).otherwise(acc["armed"]).alias("armed"),
            *(F.when(again, F.lit(-1)).otherwise(n[k]).alias(k) for k in "abc"),
            F.when(d["fire"], b["ema_low20"]).otherwise(acc["stop"]).alias("stop"),
            F.when(d["fire"], F.concat(acc["fired"], F.array(b["i"]))).otherwise(acc["fired"]).alias("fired"))

    start = F.struct(F.lit(True).alias("armed"), *(F.lit(-1).alias(k) for k in "abc"), F.lit(None).cast("double").alias("stop"), F.array().cast("array<int>").alias("fired"))
    t = g.select(*s.by, "bars", F.explode(F.aggregate("bars", start, step, lambda acc: acc["fired"])).alias("k"))
    t = t.select(*s.by, "bars", at(F.col("k")).alias("e"))
    e = F.col("e")
    t = t.where(((e["close"] - e["ema_low20"]) / e["close"] >= min_stop) & (e["ema_low20"] > 0) & (e["ema_low20"] < e["ema"]))
    ends = F.transform(F.array("e"), lambda e: let(after(e["i"], lambda b: (b["ema"] < e["ema_low20"]) | (b[order] >= moc)), lambda b: _exits(
        e, b, order, lambda z: F.when(z["ema"] < e["ema_low20"], "stop").otherwise("moc"))))
    t = t.select(*s.by, e[order].cast("long").alias("entry_at"), e["close"].alias("entry_price"), e["ema_low20"].alias("stop_level"), F.explode(ends).alias("o"))
    return t.select(*s.by, "entry_at", "entry_price", "o.*", "stop_level")


def timed_pullback(df: DataFrame, s: Series, drought: int, bars: int) -> DataFrame:
    """Per bar: a timer of ``bars`` bars since the last new high that came at least ``drought`` bars after the one before,
    the bars since the last high, and the pullback's volume ratio, depth and mean range. The pullback starts over when the
    timer runs out, and on a new high that doesn't start an idle timer: islands, over which everything is a window sum."""
    x = numbered(df, s).withColumn("new", F.coalesce("new_hi", F.lit(False)))
    before = s.sofar(inclusive=False)
    quiet = F.col("i") - 1 - F.coalesce(F.max(F.when(F.col("new"), F.col("i"))).over(before), F.lit(0))
    x = x.withColumn("quiet", quiet)
    x = x.withColumn("start", F.when(F.col("new") & (F.col("quiet") >= drought), F.col("i")))
    run = lambda since, now: F.when(since.isNull(), -1).otherwise(F.greatest(F.lit(0), bars - (now - since)))
    x = x.withColumns({"timer": run(F.max("start").over(s.sofar()), F.col("i")), "was": run(F.max("start").over(before), F.col("i") - 1)})
    over = F.col("start").isNull() & ((F.col("was") == 1) | ((F.col("was") <= 0) & F.col("new")))
    x = x.withColumn("island", F.sum(over.cast("int")).over(s.sofar()))
    own = Window.partitionBy(*s.by, "island").orderBy(*s.order).rowsBetween(UNB, 0)
    up, dn = F.col("close") >= F.col("ema_p"), F.col("close") < F.col("ema_p")
    mean = lambda c: F.avg(F.when(c, F.col("volume"))).over(own)
    falls = F.sum(F.when(dn, F.col("volume"))).over(own)
    return x.select(
        *s.by, *s.order, "timer", F.when(F.col("new"), 0).otherwise(F.col("quiet") + 1).alias("bars_since_high"),
        F.when(falls > 0, mean(up) / mean(dn)).alias("pb_updn"), F.greatest(F.lit(0.0), F.max(F.col("ema_hi") / F.col("ema") - 1).over(own)).alias("pb_depth"),
        F.avg("atr_log").over(own).alias("pb_atr"))
