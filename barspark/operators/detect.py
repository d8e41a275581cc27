"""Event detectors: one boolean column over the feature columns, driven by a frozen config.

The defaults are the production values of the strategy each rule describes. A gate whose metric is missing fails.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import all_of, div, gate, pct

INF = math.inf


@dataclass(frozen=True)
class Breakout:
    """Daily breakout on volume out of a tight base near the yearly high."""

    up: float = 0.10
    up_max: float = 0.30
    rvol_min: float = 5.0
    rvol_max: float = INF
    prior_bars: int = 21
    min_dollar: float = 100_000.0
    near_high: float = 0.95
    use_high: bool = False
    min_price: float = 1.0
    max_tight: float = 4.5
    max_atr: float = 0.10
    min_intraday: float = -0.07
    min_max_atr: float = 0.04

    def fires(self) -> Column:
        c = F.col("close")
        return all_of([
            F.col("pct_up") >= self.up, F.col("pct_up") < self.up_max,
            F.col("rvol") >= self.rvol_min, F.col("rvol") <= F.lit(self.rvol_max),
            F.col("bars_seen") > self.prior_bars, F.col("avg_dol") >= self.min_dollar,
            c >= F.lit(self.near_high) * F.col("hi_high" if self.use_high else "hi_close"),
            c >= self.min_price, F.col("tight_log") < self.max_tight, F.col("atr_log") < self.max_atr,
            F.col("intraday_ret") >= self.min_intraday, F.col("max_atr") >= self.min_max_atr,
        ])


@dataclass(frozen=True)
class Washout:
    """A new closing low after a multi-day slide, on ordinary volume, in a weak market; mirrored for new highs."""

    window: int = 7
    mirror: bool = False
    up: float = -0.40
    up_max: float = -0.05
    vol_frac: tuple[float, float] = (0.5, 1.5)
    max_3d: float = -0.15
    max_prior2d: float = -0.10
    max_60d: float = -0.40
    rvol_max: float = 3.0
    prior_bars: int = 21
    min_dollar: float = 100_000.0
    min_price: float = 1.0
    max_tight: float = 9.0
    atr: tuple[float, float] = (0.08, 0.25)
    monotone: bool = False
    breadth_max: float | None = 0.10

    def features(self, s) -> dict[str, Column]:
        c, v = F.col("close"), F.col("volume")
        at = lambda n: F.lag(c, n).over(s.spec())
        return {
            "low_n": F.min(c).over(s.last(self.window)), "high_n": F.max(c).over(s.last(self.window)),
            "vol_max_n": F.max(v).over(s.last(self.window)), "chg_3d": pct(c, at(3)), "chg_60d": pct(c, at(60)),
            "prior_2d": pct(at(1), at(3)), "falling": (at(3) > at(2)) & (at(2) > at(1)),
        }

    def fires(self) -> Column:
        c = F.col("close")
        gates = [
            (c >= F.col("high_n")) if self.mirror else (c <= F.col("low_n")),
            F.col("pct_up") >= self.up, F.col("pct_up") < self.up_max,
            F.col("vol_max_n") > 0, F.col("volume") >= F.lit(self.vol_frac[0]) * F.col("vol_max_n"),
            F.col("volume") <= F.lit(self.vol_frac[1]) * F.col("vol_max_n"),
            F.col("chg_3d") <= self.max_3d, F.col("prior_2d") <= self.max_prior2d, F.col("chg_60d") <= self.max_60d,
            F.col("rvol") <= self.rvol_max, F.col("bars_seen") > self.prior_bars,
            F.col("avg_dol") >= self.min_dollar, c >= self.min_price, F.col("tight_log") < self.max_tight,
            F.col("atr_log") >= self.atr[0], F.col("atr_log") < self.atr[1],
        ]
        if self.monotone:
            gates.append(F.col("falling"))
        if self.breadth_max is not None:
            gates.append(F.col("breadth_lag1") < self.breadth_max)
        return all_of(gates)


@dataclass(frozen=True)
class SessionExtreme:
    """Close (or wick) through the prior session extreme with volume near the session's volume high."""

    start: int = 585
    downside: bool = True
    use_close: bool = True
    wick: bool = False
    vol_frac: float = 0.90
    flush: float = 0.0
    flush_floor: float = 0.0
    max_tight: float = INF
    max_atr: float = INF

    def reference(self) -> Column:
        side = "lo" if self.downside else "hi"
        return F.col(f"sess_{side}{'c' if self.use_close else ''}_p")

    def fires(self) -> Column:
        probe = F.col(("low" if self.downside else "high") if self.wick else "close")
        ref, v, mv = self.reference(), F.col("volume"), pct(F.col("close"), F.col("prev_close"))
        gates = [F.col("minute") >= self.start, (probe < ref) if self.downside else (probe > ref),
                 F.col("tight_p") < F.lit(self.max_tight), F.col("atr_log_p") < F.lit(self.max_atr)]
        if self.vol_frac >= 1.0:
            gates.append(v > F.col("vol_hi_p"))
        elif self.vol_frac > 0.0:
            gates.append(v >= F.lit(self.vol_frac) * F.col("vol_hi_p"))
        if self.flush != 0.0:
            gates.append(mv <= self.flush if self.downside else mv >= -self.flush)
        if self.flush_floor != 0.0:
            gates.append(mv >= self.flush_floor if self.downside else mv <= -self.flush_floor)
        return all_of(gates)


@dataclass(frozen=True)
class VwapReclaim:
    """EMA at or below VWAP before the bar and above it now, after a long run below; mirrored for losses of VWAP."""

    start: int = 600
    end: int = 810
    min_run: int = 11
    min_frac: float = 0.0
    min_tight: float = 3.0
    max_tight: float = INF
    max_atr: float = INF
    mirror: bool = False

    def fires(self) -> Column:
        cross = ((F.col("ema_p") >= F.col("vwap_p")) & (F.col("ema") < F.col("vwap"))) if self.mirror else (
            (F.col("ema_p") <= F.col("vwap_p")) & (F.col("ema") > F.col("vwap")))
        gates = [F.col("minute").between(self.start, self.end), cross, F.col("run_len_p") >= self.min_run]
        if self.min_frac > 0:
            gates.append(F.col("below_frac_p") > self.min_frac)
        if self.min_tight > 0:
            gates.append(F.col("tight_p") >= self.min_tight)
        if self.max_tight != INF:
            gates.append(F.col("tight_p") < self.max_tight)
        if self.max_atr != INF:
            gates.append(F.col("atr_log_p") < self.max_atr)
        return all_of(gates)

    @staticmethod
    def stop_level() -> Column:
        """The run's EMA extreme, or the session low where the run has none."""
        return F.coalesce(F.col("run_ema_edge"), F.col("sess_lo"))


@dataclass(frozen=True)
class DipRebreak:
    """A close back above the prior bar's high after a few closes below the EMA, in an up-trending session."""

    start: int = 600
    end: int = 810
    atr_mult: float = 0.5
    min_below: int = 3
    max_below: int = 8
    min_trend: float = 0.02
    min_tight: float = 3.0

    def fires(self) -> Column:
        return all_of([
            F.col("minute").between(self.start, self.end), F.col("prev_high") > 0,
            F.col("close") >= F.col("prev_high") * (1.0 + F.lit(self.atr_mult) * F.col("atr_log_p")),
            F.col("below_n_p") >= self.min_below, F.col("below_n_p") < self.max_below,
            pct(F.col("close"), F.col("sess_open")) >= self.min_trend, F.col("tight_p") >= self.min_tight,
        ])


@dataclass(frozen=True)
class DipRun:
    """Entries around a run above the EMA: into the run (bar N), on pullback bar N, on the EMA reclaim, or re-break."""

    mode: str = "reclaim"  # into_run | pullback | reclaim | rebreak
    n: int = 0
    start: int = 600
    end: int = 810
    min_run: int = 0
    since_break: tuple[int, int] = (0, 0)  # 0 = off
    atr_mult: float = 0.5

    def fires(self) -> Column:
        window = F.col("minute").between(self.start, self.end)
        if self.mode == "into_run":
            return all_of([window, F.col("above_n_p") == self.n])
        gates = [window, F.col("below_n_p") >= 1]
        if self.min_run:
            gates.append(F.col("saved_run_p") >= self.min_run)
        lo, hi = self.since_break
        if lo:
            gates.append(F.col("since_break_p") >= lo)
        if hi:
            gates += [F.col("since_break_p") >= 0, F.col("since_break_p") < hi]
        if self.mode == "pullback":
            gates.append(F.col("below_n_p") == self.n)
        elif self.mode == "reclaim":
            gates.append(F.col("close") > F.col("ema_p"))
        else:
            gates.append(F.col("close") >= F.col("prev_high") * (1.0 + F.lit(self.atr_mult) * F.col("atr_log_p")))
        return all_of(gates)


@dataclass(frozen=True)
class Momentum:
    """Trailing-window momentum: positive price slope, volatility floor, closes above the EMA, day-strength floors."""

    start: int = 600
    end: int = 810
    min_slope: float = 0.0
    min_atr: float = 0.013
    max_atr: float = INF
    min_tight: float = 3.0
    min_above6: int = 5
    min_ema_vs_vwap: float = -0.02
    max_rvol5: float = 0.0
    min_chg1d: float | None = 0.10
    min_chg3d: float | None = 0.0

    def fires(self) -> Column:
        """Reads the state going into the bar, except the bar's own close in the day-strength floors."""
        gates = [
            F.col("minute").between(self.start, self.end), F.col("slope_p") > self.min_slope,
            F.col("atr_log_p") >= self.min_atr, F.col("tight_p") >= self.min_tight,
            F.col("above6_p") >= self.min_above6, pct(F.col("ema_p"), F.col("vwap_p")) >= self.min_ema_vs_vwap,
        ]
        if self.max_atr != INF:
            gates.append(F.col("atr_log_p") < self.max_atr)
        if self.max_rvol5 > 0:
            gates.append(F.coalesce(F.col("vol5_p") < F.lit(self.max_rvol5) * F.col("permin"), F.lit(True)))
        if self.min_chg1d is not None:
            gates.append(pct(F.col("close"), F.col("close_1d")) >= self.min_chg1d)
        if self.min_chg3d is not None:
            gates.append(F.coalesce(pct(F.col("close"), F.col("close_3d")) >= self.min_chg3d, F.lit(True)))
        return all_of(gates)


@dataclass(frozen=True)
class OpeningDrive:
    """A strong open that has pulled back from its EMA high, with room to the EMA low; cut by a blow-off bar."""

    start: int = 585
    end: int = 599
    min_chg1d: float = 0.20
    chg3d: tuple[float, float] = (0.0, 1.5)
    min_atr: float = 0.013
    min_stop: float = 0.03
    bl_max: int = 0
    bh_min: int = 1
    blowoff: float = 110.0
    blowoff_atr: float = 0.03

    def exhausted(self) -> Column:
        """A new closing high on a bar of ``blowoff`` times the average pace in a volatile session."""
        new_high = F.col("sess_hic_p").isNull() | (F.col("close") > F.col("sess_hic_p"))
        return gate(new_high & (F.col("bar_rvol") >= self.blowoff) & (F.col("atr_log") >= self.blowoff_atr))

    def qualifies(self) -> Column:
        c = F.col("close")
        gates = [
            F.col("minute").between(self.start, self.end),
            pct(c, F.col("close_1d")) >= self.min_chg1d, pct(c, F.col("close_3d")) >= self.chg3d[0],
            pct(c, F.col("close_3d")) <= self.chg3d[1], F.col("atr_log") >= self.min_atr,
            (c - F.col("ema_lo")) / c >= self.min_stop,
        ]
        if self.bl_max:
            gates.append(F.col("bars_since_lo") < self.bl_max)
        if self.bh_min:
            gates.append(F.col("bars_since_hi") >= self.bh_min)
        return all_of(gates)


def first_per_session(s, qualifies: Column, exhausted: Column) -> dict[str, Column]:
    """One-shot entry: the first qualifying bar of a session that is not preceded (or hit) by an exhaustion bar."""
    dead = F.coalesce(F.max(F.when(exhausted, 1)).over(s.sofar()), F.lit(0)) == 1
    ok = qualifies & ~dead
    nth = F.sum(F.when(ok, 1).otherwise(0)).over(s.sofar())
    return {"dead": dead, "entry": ok & (nth == 1)}


def in_window(minute: str, start: int, end: int) -> Column:
    """The recorder: every bar of a time window is an event."""
    return F.col(minute).between(start, end)


def with_entry_candle(x: DataFrame, candle: DataFrame) -> DataFrame:
    """Judge and fill the entry on another candle of the day (a partial one known at a cutoff), while the state going
    into the day stays. ``candle``: ticker, date, open, high, low, close, volume; days without one take no entry."""
    c = candle.select("ticker", "date", *[F.col(k).alias(f"__{k}") for k in ("open", "high", "low", "close", "volume")])
    j = x.join(c.filter(F.col("__close").isNotNull()), ["ticker", "date"])
    j = j.withColumns({k: F.col(f"__{k}") for k in ("open", "high", "low", "close", "volume")})
    j = j.drop(*[f"__{k}" for k in ("open", "high", "low", "close", "volume")])
    v, cl = F.col("volume"), F.col("close")
    return j.withColumns({"rvol": div(v, F.col("avg_vol")), "pct_up": pct(cl, F.col("prev_close")),
                          "intraday_ret": pct(cl, F.col("open")), "d52_close": pct(cl, F.col("hi_close"))})
