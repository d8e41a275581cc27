"""First passages by index against walks over all later bars."""

import random
import time

import pytest
from pyspark.sql import functions as F

from barspark.operators import passage as P
from barspark.operators import trips as R

SERIES = "k long, d long, x double, y double"


def test_index_is_a_walk(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([None, float(rng.randrange(20))]) for _ in range(n)]) for k, n in enumerate([1, 2, 3, 7, 8, 9, 64, 100])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    df = P.once(df, {"lo": P.extremes(F.col("v"), "min"), "hi": P.extremes(F.col("v"), "max")})
    df = df.withColumn("q", F.explode(F.sequence(F.lit(0), F.size("v")))).withColumn("lvl", F.explode(F.array(*map(F.lit, (0.0, 3.0, 12.0, 30.0)))))
    got = df.select("v", "q", "lvl", P.first_index(F.col("lo"), F.col("q"), lambda x: x < F.col("lvl")).alias("below"),
                    P.first_index(F.col("hi"), F.col("q"), lambda x: x >= F.col("lvl")).alias("above"),
                    P.least_between(F.col("lo"), F.col("q"), F.size("v")).alias("least")).collect()
    for r in got:
        later = [(i, x) for i, x in enumerate(r.v) if i >= r.q and x is not None]
        assert r.below == next((i for i, x in later if x < r.lvl), None) and r.above == next((i for i, x in later if x >= r.lvl), None)
        assert r.least == min((x for _, x in later), default=None)


def walk(bars, plan, i):
    """Bar by bar, state carried: (index of the deciding bar, reason), or None."""
    e, sgn = bars[i], -1.0 if plan.short else 1.0
    level, mark = None, e["close"]
    for held, j in enumerate(range(i + 1, len(bars)), 1):
        b = bars[j]
        adverse = b["high"] if plan.short else b["low"]
        touched = lambda lvl: lvl is not None and (adverse >= lvl if plan.short else adverse <= lvl)  # noqa: E731, B023
        tight = min if plan.short else max
        gain = sgn * (b["close"] / e["close"] - 1.0)
        stop = False
        if plan.mode == "window_low":
            stop = touched(tight(b["stop_high"], e["high"]) if plan.short else tight(b["stop_low"], e["low"]))
        elif plan.mode in ("atr_ratchet", "fixed_pct"):
            stop = touched(level)
            frac = plan.pct if plan.mode == "fixed_pct" else None if b["atr_log"] is None else plan.k * b["atr_log"]
            if frac is not None:
                cand = b["close"] * (1.0 - sgn * frac)
                if plan.break_even:
                    cand = max(cand, e["close"]) if plan.short else min(cand, e["close"])
                level = cand if level is None else tight(level, cand)
        elif plan.mode == "ladder":
            width = next((w for floor, w in sorted(plan.tiers, reverse=True) if b["atr_log"] is not None and b["atr_log"] >= floor), plan.width)
            stop = touched(mark * (1.0 - sgn * width))
            mark = tight(mark, b["close"])
        if plan.target and (b["low"] <= e["close"] * (1 - plan.target) if plan.short else b["high"] >= e["close"] * (1 + plan.target)):
            return j, "target"
        if stop:
            return j, "stop"
        if plan.disaster and b["atr_log"] is not None and b["atr_log"] > plan.disaster[0] and gain < plan.disaster[1]:
            return j, "disaster"
        if plan.max_hold and held >= plan.max_hold:
            return j, "time_stop"
    return None


PLANS = [R.StopPlan(mode=m, short=s, **kw) for s in (False, True) for m, kw in [
    ("window_low", {}), ("atr_ratchet", {"k": 1.5}), ("fixed_pct", {"pct": 0.04, "target": 0.09}), ("fixed_pct", {"pct": 0.02, "break_even": True}),
    ("atr_ratchet", {"k": 1.0, "break_even": True, "max_hold": 9}), ("ladder", {"width": 0.1, "tiers": ((0.02, 0.06), (0.04, 0.03)), "disaster": (0.03, -0.04)}),
    ("none", {"max_hold": 4}), ("none", {})]]


@pytest.mark.parametrize("part", range(4))
def test_plans_are_walks(spark, part):
    rng = random.Random(part)
    bars = {}
    for k, n in enumerate([1, 2, 5, 80]):
        px, bars[k] = 100.0, []
        for d in range(n):
            px = round(px * (1 + rng.uniform(-0.04, 0.04)), 2)
            lo, hi = round(px * (1 - rng.random() * 0.03), 2), round(px * (1 + rng.random() * 0.03), 2)
            bars[k].append({"date": d, "open": px, "high": hi, "low": lo, "close": px, "stop_low": round(px * rng.uniform(0.94, 0.99), 2),
                            "stop_high": round(px * rng.uniform(1.01, 1.06), 2), "atr_log": rng.choice([None, rng.random() * 0.05])})
    cols = ["date", "open", "high", "low", "close", "stop_low", "stop_high", "atr_log"]
    df = spark.createDataFrame([(k, *(b[c] for c in cols)) for k, bs in bars.items() for b in bs], "k long, date long, " + ", ".join(f"{c} double" for c in cols[1:]))
    df = df.withColumns({"atr_now": F.col("atr_log"), **{c: F.lit(None).cast("double") for c in ("tight_log", "rvol", "pct_up", "rng_hi", "rng_lo", "atr_lin")}})
    for plan in PLANS[part::4]:
        for r in R.plan_exit(df, ["k"], F.col("date") % 3 == 0, plan).collect():
            bs, want = bars[r.k], walk(bars[r.k], plan, r.entry_date)
            at = want and (want[0] if want[1] == "target" else want[0] + 1)
            if want is None or at >= len(bs):
                assert (r.exit_date, r.exit_reason, r.exit_price) == (len(bs) - 1, "mtm", bs[-1]["close"]), plan
            else:
                assert (r.exit_date, r.exit_reason) == (at, want[1]), (plan, r.entry_date)


def test_many_entries_on_one_long_series(spark):
    """10,000 entries on 100,000 bars, none of which exits for a long while: seconds, where a walk takes 10^9 steps."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("d"), (100.0 + F.col("id") * 1e-3).alias("close"))
    g = R._series_arrays(df.withColumn("x", F.when(F.col("d") == n - 5, -1.0).otherwise(F.col("close"))), ["k"], "d", F.col("d") % 10 == 0, ["x", "close"], ["close"])
    rules = [P.below("stop", lambda b: b["x"], lambda e: F.lit(0.0), lambda e, b: b["x"]), P.above("never", lambda b: b["close"], lambda e: e["close"] * 3, lambda e, b: b["close"])]
    begun = time.time()
    got = P.first_passage(g, ["k"], "d", ["close"], rules).groupBy("exit_reason", "exit_at").count().collect()
    assert {(r.exit_reason, r.exit_at, r["count"]) for r in got} == {("stop", n - 5, 10_000)} and time.time() - begun < 60
