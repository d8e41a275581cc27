"""Trips: from entry events to exits, P&L and derived ratios.

Exits that depend on a fixed bar offset are windows. Exits that depend on the entry are found in the series itself: each
session's (or episode's) bars form one sorted array, every entry finds its first exit bar in it by index (``passage``), and only
finished trips leave the row. An array is as long as the calendar allows, and no (trip, bar) rows are produced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.indicators import FOL, UNB, Series
from barspark.operators.passage import Rule, above, below, extremes, first_index, first_passage, least_between, once, whenever


def time_exit(s: Series, hold: int) -> dict[str, Column]:
    """Held ``hold`` bars after the signal bar, sold at the open of the bar after; the series' last close otherwise."""
    w = s.spec()
    out = F.lead("open", hold + 1).over(w)
    end = s.spec().rowsBetween(UNB, FOL)
    return {
        "exit_price": F.coalesce(out, F.last("close").over(end)),
        "exit_date": F.coalesce(F.lead("date", hold + 1).over(w), F.last("date").over(end)),
        "exit_reason": F.when(out.isNotNull(), "time_stop").otherwise("mtm"),
        "open_trip": F.when(out.isNotNull(), 0).otherwise(1),
    }


def _series_arrays(df: DataFrame, by: list[str], order: str, entry: Column, bar: list[str], ent: list[str]) -> DataFrame:
    x = df.withColumn("i", F.row_number().over(Series(tuple(by), (order,)).spec()))
    b = F.struct("i", *[c for c in dict.fromkeys([order, *bar])])
    e = F.struct("i", *[c for c in dict.fromkeys([order, *ent])])
    g = x.groupBy(*by).agg(
        F.sort_array(F.collect_list(b)).alias("bars"), F.sort_array(F.collect_list(F.when(entry, e))).alias("entries"),
    )
    return g.filter(F.size("entries") > 0)


def first_exit(df: DataFrame, by: list[str], order: str, entry: Column, bar: list[str], ent: list[str],
               rules: list[tuple[str, Callable[[Column, Column], Column], Callable[[Column, Column], Column]]],
               max_hold: int | None = None, final: str = "moc") -> DataFrame:
    """Trips that end at the first later bar on which a rule holds, for conditions on entry and bar together that no index
    serves and holds of a few bars (``max_hold``); see ``passage_exit`` for levels.

    ``rules`` are (reason, condition(entry, bar), fill(entry, bar)) in priority order; bars after the entry bar only.
    Without any hit the trip ends at the last bar's close with reason ``final``. Output: by, the entry fields, exit_i,
    exit_at (order value), exit_price, exit_reason.
    """
    g = _series_arrays(df, by, order, entry, [*bar, "close"], ent)

    def any_rule(e, b):
        out = F.lit(False)
        for _, cond, _ in rules:
            out = out | F.coalesce(cond(e, b), F.lit(False))
        return out

    def trip(e):
        n = F.lit(max_hold) if max_hold else F.greatest(F.size("bars") - e["i"], F.lit(1))
        later = F.slice("bars", e["i"] + 1, n)
        hit = F.get(F.filter(later, lambda b: any_rule(e, b)), F.lit(0))
        return F.struct(e.alias("e"), hit.alias("b"))

    t = g.select(*by, F.element_at("bars", -1).alias("last"), F.explode(F.transform("entries", trip)).alias("t"))
    e, b, last = F.col("t.e"), F.col("t.b"), F.col("last")
    reason, px = F.lit(final), last["close"]
    for name, cond, fill in reversed(rules):
        ok = F.coalesce(cond(e, b), F.lit(False))
        reason, px = F.when(ok, name).otherwise(reason), F.when(ok, fill(e, b)).otherwise(px)
    got = b.isNotNull()
    return t.select(
        *by, e["i"].alias("entry_i"), *[e[c].alias(c) for c in dict.fromkeys([order, *ent])],
        F.when(got, b["i"]).otherwise(last["i"]).alias("exit_i"),
        F.when(got, b[order]).otherwise(last[order]).alias("exit_at"),
        F.when(got, px).otherwise(last["close"]).alias("exit_price"),
        F.when(got, reason).otherwise(F.lit(final)).alias("exit_reason"),
    )


def frozen_stop_rules(moc: int, buffer: float = 0.0, time_stop: int = 0) -> list[Rule]:
    """EMA below the level frozen at entry, then the time stop, then the close of the session; all fill at the close."""
    rules = [below("stop", lambda b: b["ema"], lambda e: e["stop_level"] * (1.0 - buffer), _close)]
    if time_stop:
        rules.append(above("time_stop", lambda b: b["minute"], lambda e: e["minute"] + time_stop, _close))
    rules.append(above("moc", lambda b: b["minute"], lambda e: F.lit(moc), _close))
    return rules


def _close(e: Column, b: Column) -> Column:
    return b["close"]


@dataclass(frozen=True)
class RichExit:
    """Intraday exits in priority order. An unset rule is off."""

    moc: int = 960
    stop: str | None = None  # close | low | ema | trail_ema
    ema_pct_stop: float = 0.0  # the average against its value at entry
    max_close_stop: float | None = None  # a short's close over its ``max_close`` at entry, by this buffer
    pct_stop: float = 0.0
    vol_stop: float = 0.0  # trailing volume below this fraction of its value at entry
    vol_slope_stop: float | None = None
    exhaust_mult: float = 0.0  # volume climax on a new session high
    vwap_bars: int = 0  # EMA lost VWAP after this many bars above
    target: str | None = None
    time_stop: int = 0
    short: bool = False

    def rules(self) -> list[Rule]:
        col = lambda c: lambda b: b[c]
        out = []
        level = lambda e: e["stop_level"]
        if self.stop == "close":
            out.append(below("stop", col("close"), level, _close, strict=False))
        elif self.stop == "low":
            out.append(below("stop", col("low"), level, lambda e, b: F.least(e["stop_level"], b["open"]), strict=False))
        elif self.stop == "ema":
            out.append(below("stop", col("ema"), level, _close))
        elif self.stop == "trail_ema":
            out.append(whenever("stop", lambda b: b["ema"] < b["ema_low20_p"], _close))
        if self.ema_pct_stop:
            k = self.ema_pct_stop
            out.append(above("ema_pct_stop", col("ema"), lambda e: e["ema"] * (1 + k), _close, strict=True) if self.short
                       else below("ema_pct_stop", col("ema"), lambda e: e["ema"] * (1 - k), _close))
        if self.max_close_stop is not None:
            top = 1 + self.max_close_stop
            out.append(above("max_close_stop", col("close"), lambda e: e["max_close"] * top, _close, strict=True))
        if self.pct_stop:
            at = lambda e: e["entry_price"] * (1 + self.pct_stop if self.short else 1 - self.pct_stop)
            out.append(above("pct_stop", col("high"), at, lambda e, b: F.greatest(at(e), b["open"])) if self.short
                       else below("pct_stop", col("low"), at, lambda e, b: F.least(at(e), b["open"]), strict=False))
        if self.vol_stop:
            out.append(below("vol_stop", col("vol20"), lambda e: e["vol20"] * self.vol_stop, _close))
        if self.vol_slope_stop is not None:
            out.append(below("vol_slope_stop", col("vol_slope"), lambda e: F.lit(self.vol_slope_stop), _close))
        if self.exhaust_mult:
            m = self.exhaust_mult
            out.append(above("exhaust", lambda b: F.when(b["high"] > b["sess_hi_p"], b["volume"]), lambda e: e["permin"] * m, _close))
        if self.vwap_bars:
            out.append(whenever("vwap_lost", lambda b: (b["above_vwap_p"] >= self.vwap_bars) & (b["ema"] < b["vwap"]), _close))
        if self.target:
            tgt = self.target
            out.append(whenever("target", lambda b: b["low"] <= b[tgt], lambda e, b: F.least(b[tgt], b["open"])))
        if self.time_stop:
            out.append(above("time_stop", col("minute"), lambda e: e["minute"] + self.time_stop, _close))
        out.append(above("moc", col("minute"), lambda e: F.lit(self.moc), _close))
        return out


def passage_exit(df: DataFrame, by: list[str], order: str, entry: Column, bar: list[str], ent: list[str], rules: list[Rule],
                 final: str = "moc") -> DataFrame:
    """Trips from the ``entry`` bars of each series to the first later bar on which a rule holds (``passage.first_passage``)."""
    return first_passage(_series_arrays(df, by, order, entry, [*bar, "close"], ent), by, order, ent, rules, final)


def channel_target_exit(df: DataFrame, by: list[str], entry: Column, mode: str, hold: int, frac: float = 1.0,
                        mirror: bool = False) -> DataFrame:
    """Exit at the prior-window closing extreme (``high_n``; ``low_n`` mirrored) within ``hold`` bars.

    ``mode``: next_open (the close crosses, fill at the next open), close (fill at that close), limit (the bar touches
    the level, fill at it). ``frac`` < 1 scales the level between entry and extreme and uses the bar's high. After
    ``hold`` bars without a hit: next open. Whatever has no next bar ends at the last close ("mtm").
    """
    lvl = "low_n" if mirror else "high_n"

    def scaled(e, b):
        return e["close"] + F.lit(frac) * (b[lvl] - e["close"])

    def crosses(e, b):
        if mode == "limit" or frac < 1.0:
            return b["low"] <= scaled(e, b) if mirror else b["high"] >= scaled(e, b)
        return b["close"] <= b[lvl] if mirror else b["close"] >= b[lvl]

    nxt = lambda e, b: b["next_open"]
    s = Series(tuple(by), ("date",))
    x = df.withColumns({"next_open": F.lead("open").over(s.spec()), "next_date": F.lead("date").over(s.spec())})
    fill = {"next_open": nxt, "close": lambda e, b: b["close"], "limit": scaled}[mode]
    name = {"next_open": "target", "close": "target_moc", "limit": "target_limit"}[mode]
    rules = [(name, crosses, fill), ("time_stop", lambda e, b: b["i"] >= e["i"] + hold, nxt)]
    t = first_exit(x, by, "date", entry, ["open", "high", "low", "close", lvl, "next_open"], ["close"], rules,
                   hold, "mtm")
    late = t["exit_price"].isNull()
    last = x.groupBy(*by).agg(F.max_by("close", "date").alias("__lc"))
    j = t.join(last, by)
    return j.withColumn("exit_reason", F.when(late, "mtm").otherwise(F.col("exit_reason"))).withColumn(
        "exit_price", F.coalesce("exit_price", "__lc")).drop("__lc")


@dataclass(frozen=True)
class StopPlan:
    """Daily exit plan. ``mode`` picks the stop; the other exits are off at their defaults.

    window_low: prior-window low, floored at the entry day's low. atr_ratchet / fixed_pct / inv_atr: up-only level off
    each close, by k*ATR, p, or w*ref/ATR. fixed_pct with ``break_even`` never rises above the entry. regime / ladder:
    distance below the highest close, narrower the higher the ATR (tiers of (atr floor, width), ``width`` otherwise).
    """

    mode: str = "none"
    k: float = 2.0
    pct: float = 0.1
    break_even: bool = False
    entry_floor: bool = True
    width: float = 0.2
    tiers: tuple[tuple[float, float], ...] = ()
    ref_atr: float = 0.05
    target: float = 0.0
    target_next_open: bool = False
    max_hold: int = 0
    disaster: tuple[float, float] | None = None  # (ATR above, gain below)
    expansion: float | None = None
    exhaustion: dict | None = None  # tight, rvol, lo, hi, max_gain, min_atr
    short: bool = False


_BAR = ["date", "open", "high", "low", "close", "stop_low", "stop_high", "atr_log", "atr_now", "tight_log", "rvol", "pct_up",
        "rng_hi", "rng_lo", "atr_lin"]


def _stop_index(p: StopPlan) -> tuple[dict[str, Column], dict[str, Column], Callable[[Column], Column] | None]:
    """(tables, tables made of those, index of the stop bar of an entry) of a plan.

    A level that ratchets is the tightest of its candidates so far, so an entry is stopped by whichever candidate after it
    is reached first: each bar's own candidate has one first passage, whatever the entry, and an entry asks for the least
    of them from its own bar on. A distance that depends on the later bar's tier has a passage for each tier.
    """
    sgn = -1.0 if p.short else 1.0
    kind, reached = ("max", lambda x, lvl: x >= lvl) if p.short else ("min", lambda x, lvl: x <= lvl)
    adverse = lambda b: b["high"] if p.short else b["low"]
    table = {"__adv": extremes(F.transform("bars", adverse), kind)}
    size = F.size("bars")
    # the bar after bar j (from 0) is j + 1; an entry's i counts from 1, so it is the place of the bar after it
    if p.mode == "window_low":
        ref = "stop_high" if p.short else "stop_low"
        own = {"__win": extremes(F.transform("bars", lambda b: F.when(reached(adverse(b), b[ref]), 1)), "max")}
        win = lambda e: first_index(F.col("__win"), e["i"], lambda x: x >= 1)
        if not p.entry_floor:
            return own, {}, win
        floor = lambda e: first_index(F.col("__adv"), e["i"], lambda x: reached(x, e["high" if p.short else "low"]))
        return table | own, {}, lambda e: F.least(win(e), floor(e))
    if p.mode in ("atr_ratchet", "fixed_pct", "inv_atr"):
        frac = {"atr_ratchet": lambda b: F.lit(p.k) * b["atr_log"], "fixed_pct": lambda b: F.lit(p.pct),
                "inv_atr": lambda b: F.least(F.lit(0.95), F.lit(p.pct * p.ref_atr) / F.nullif(b["atr_log"], F.lit(0.0)))}[p.mode]
        cand = lambda b: b["close"] * (1.0 - F.lit(sgn) * frac(b))
        later = {"__next": extremes(F.transform("bars", lambda b, j: first_index(F.col("__adv"), j + 1, lambda x: reached(x, cand(b)))), "min")}
        if not p.break_even:
            return table, later, lambda e: least_between(F.col("__next"), e["i"], size)
        # from the first candidate beyond the entry on, the entry itself is the level
        table["__cand"] = extremes(F.transform("bars", cand), "min" if p.short else "max")

        def capped(e: Column) -> Column:
            free = first_index(F.col("__cand"), e["i"], lambda x: x <= e["close"] if p.short else x >= e["close"])
            even = first_index(F.col("__adv"), free + 1, lambda x: reached(x, e["close"]))
            return F.least(least_between(F.col("__next"), e["i"], F.coalesce(free, size)), F.when(free.isNotNull(), even))

        return table, later, capped
    if p.mode in ("regime", "ladder"):
        def width(b: Column) -> Column:
            out = F.lit(p.width)
            for floor, w in sorted(p.tiers):
                out = F.when(b["atr_log"] >= floor, F.lit(w)).otherwise(out)
            return out

        widths = sorted({p.width, *(w for _, w in p.tiers)})
        of_tier = lambda w: lambda b: F.when(width(b) == w, adverse(b))
        table = {f"__adv{k}": extremes(F.transform("bars", of_tier(w)), kind) for k, w in enumerate(widths)}
        first = lambda b, j: [first_index(F.col(f"__adv{k}"), j + 1, lambda x, w=w: reached(x, b["close"] * (1.0 - sgn * w))) for k, w in enumerate(widths)]
        least = lambda cols: F.least(*cols) if len(cols) > 1 else cols[0]
        return table, {"__next": extremes(F.transform("bars", lambda b, j: least(first(b, j))), "min")}, lambda e: least_between(F.col("__next"), e["i"] - 1, size)
    return {}, {}, None


def _plan_rules(p: StopPlan) -> list[Rule]:
    """The target and the exits after the stop, in order of priority; all but the target sell at the next open."""
    sgn = -1.0 if p.short else 1.0
    kind = "max" if p.short else "min"  # the close that gains least
    gain = lambda e, x: F.lit(sgn) * (x / e["close"] - 1.0)
    none = lambda e, b: F.lit(None)
    rules = []
    if p.target > 0:
        level = lambda e: e["close"] * (1.0 + F.lit(sgn * p.target))
        name = "target_next_open" if p.target_next_open else "target"
        rules.append(below(name, lambda b: b["low"], level, none, strict=False) if p.short else above(name, lambda b: b["high"], level, none))
    if p.disaster:
        rules.append(Rule("disaster", lambda b: F.when(b["atr_now"] > p.disaster[0], b["close"]), kind, lambda e, x: gain(e, x) < p.disaster[1], none))
    if p.expansion is not None:
        # the range above its own low and above the entry, each over the ATR: the first is the bar's, the second a level
        wide = lambda b: (b["atr_log"] > 0) & F.coalesce((F.ln(b["rng_hi"]) - F.ln(b["rng_lo"])) / b["atr_log"] > p.expansion, b["rng_lo"].isNull())
        rules.append(Rule("expansion", lambda b: F.when(wide(b), F.ln(b["rng_hi"]) - p.expansion * b["atr_log"]), "max", lambda e, x: x > F.ln(e["close"]), none))
    if p.exhaustion:
        x = p.exhaustion

        def worn(b: Column) -> Column:
            move = F.lit(sgn) * b["pct_up"]
            cond = (b["tight_log"] > x["tight"]) & (((b["rvol"] > x["rvol"]) & (move > x["lo"])) | (b["rvol"].isNotNull() & (move > x["hi"])))
            return cond & (b["atr_log"] > x["min_atr"]) if x.get("min_atr", 0) > 0 else cond

        rules.append(Rule("exhaustion", lambda b: F.when(worn(b), b["close"]), kind, lambda e, v: gain(e, v) < x["max_gain"], none))
    return rules


def plan_exit(df: DataFrame, by: list[str], entry: Column, plan: StopPlan, keep: list[str] = []) -> DataFrame:
    """Hold every entry (filled at its close) under a ``StopPlan``. Every exit is a first passage found by index, so an entry
    costs a few look-ups however long it is held. Priority on one bar: target, stop, disaster, expansion, exhaustion, time."""
    g = _series_arrays(df, by, "date", entry, _BAR, ["close", "high", "low", *keep])
    rules = _plan_rules(plan)
    tables, later, stop = _stop_index(plan)
    tables = tables | {f"__x{r}": extremes(F.transform("bars", rule.value), rule.kind) for r, rule in enumerate(rules)}
    g = once(once(g, tables), later)

    def hits(e: Column) -> dict[str, Column]:
        out = {rule.name: first_index(F.col(f"__x{r}"), e["i"], lambda x, rule=rule: rule.test(e, x)) for r, rule in enumerate(rules)}
        if stop is not None:
            target = {n: c for n, c in out.items() if n.startswith("target")}
            out = target | {"stop": stop(e)} | {n: c for n, c in out.items() if n not in target}
        if plan.max_hold:
            at = e["i"] + (plan.max_hold - 1)
            out["time_stop"] = F.when(at < F.size("bars"), at)
        return out

    names: list[str] = []

    def trip(e: Column) -> Column:
        found = hits(e)
        names[:] = found
        return F.struct(e.alias("e"), F.struct(*[c.cast("int").alias(n) for n, c in found.items()] or [F.lit(None).cast("int").alias("none")]).alias("h"))

    t = g.select(*by, "bars", F.explode(F.transform("entries", trip)).alias("t"))
    each = [F.col(f"t.h.{n}") for n in names] or [F.lit(None).cast("int")]
    t = t.withColumn("at", F.least(*each) if len(each) > 1 else each[0])
    e, at, last = F.col("t.e"), F.col("at"), F.element_at("bars", -1)
    reason = F.lit(None).cast("string")
    for n, c in reversed(list(zip(names, each))):
        reason = F.when(c == at, n).otherwise(reason)
    here, nxt = F.get("bars", at), F.get("bars", at + 1)
    level = e["close"] * (1.0 + F.lit((-1.0 if plan.short else 1.0) * plan.target))
    fill = (F.least if plan.short else F.greatest)(level, here["open"])
    same = F.coalesce(reason == "target", F.lit(False))
    done = at.isNotNull() & (same | nxt.isNotNull())
    return t.select(
        *by, e["i"].alias("entry_i"), e["date"].alias("entry_date"), e["close"].alias("entry_price"),
        *[e[k].alias(k) for k in keep],
        F.when(done, F.when(same, here["date"]).otherwise(nxt["date"])).otherwise(last["date"]).alias("exit_date"),
        F.when(done, F.when(same, fill).otherwise(nxt["open"])).otherwise(last["close"]).alias("exit_price"),
        F.when(done, reason).otherwise(F.lit("mtm")).alias("exit_reason"),
    )


def scale_to_candidates(minutes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keep the candidate ticker-days and put their raw prices on the adjusted scale (join strategy left to AQE)."""
    c = candidates.select("ticker", "date", "adj_ratio")
    px = {k: F.col(k) * F.col("adj_ratio") for k in ("open", "high", "low", "close")}
    return minutes.join(c, ["ticker", "date"]).withColumns(px)


def pnl(df: DataFrame, notional: float = 10_000.0, side: int = 1, size_mult: Column | None = None) -> DataFrame:
    """Return, quantity and net P&L of a fixed-notional trip; ``side`` -1 is short."""
    raw = F.col("exit_price") / F.nullif(F.col("entry_price"), F.lit(0.0)) - 1.0
    qty = F.lit(notional) / F.nullif(F.col("entry_price"), F.lit(0.0))
    if size_mult is not None:
        qty = qty * size_mult
    x = df.withColumns({"ret": raw * side, "qty": qty})
    return x.withColumn("net_pnl", F.col("qty") * (F.col("exit_price") - F.col("entry_price")) * side)


def pierce_stop(trips: DataFrame, bars: DataFrame, by: list[str], minute: str, stops: list[float]) -> DataFrame:
    """What-if stops on finished short trips: with the highest high from the entry on, each stop level is either pierced
    (the trip returns minus the stop) or not (it keeps its return).

    The running maximum from the end of the session is a window over the bars, so a trip meets one row, not all bars.
    """
    s = Series(tuple(by), (minute,))
    mx = F.max("high").over(s.spec().rowsBetween(0, FOL))
    b = bars.select(*by, F.col(minute), mx.alias("max_high"))
    j = trips.join(b, [*by, minute], "left")
    cols = {}
    for f in stops:
        hit = F.coalesce(F.col("max_high") >= F.col("entry_price") * (1.0 + f), F.lit(False))
        cols[f"ret_stop_{int(round(f * 100))}"] = F.when(hit, F.lit(-f)).otherwise(F.col("ret"))
    return j.withColumns(cols)
