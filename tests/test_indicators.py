"""Indicators on small hand-made series: warm-up, gaps, ties, NULLs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barspark.functions import features as X, indicators as I
from barspark.functions.indicators import Series
from barspark.operators import adjust, universe as U

S = Series(("k",), ("t",))


def frame(spark, vals, name="v"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], f"k string, t long, {name} double")


@pytest.mark.parametrize("period,n", [(9, 300), (3, 1500), (2, 1500), (3, 5000)])
def test_ema_any_length(spark, period, n):
    r = random.Random(1)
    vals = [r.uniform(1, 50) for _ in range(n)]
    df = frame(spark, vals)
    got = [x["e"] for x in I.with_ema(df, S, F.col("v"), period, "e").orderBy("t").collect()]
    a, e = 2 / (period + 1), vals[0]
    for i, v in enumerate(vals):
        e = v if i == 0 else e + a * (v - e)
        assert got[i] == pytest.approx(e, rel=1e-12)


@pytest.mark.parametrize("n", [1, 5, 16, 17, 33, 100, 252])
def test_extremes(spark, n):
    r = random.Random(2)
    vals = [None if r.random() < 0.05 else r.uniform(-5, 5) for _ in range(400)]
    out = I.with_extremes(frame(spark, vals), S, {
        "mx": ("max", F.col("v"), n, True), "mn": ("min", F.col("v"), n, False)}).orderBy("t").collect()
    for i in range(400):
        a = [v for v in vals[max(0, i - n + 1): i + 1] if v is not None]
        b = [v for v in vals[max(0, i - n): i] if v is not None]
        assert out[i]["mx"] == (max(a) if a else None) and out[i]["mn"] == (min(b) if b else None)


def test_calendar_mean_is_28_days_back_inclusive_without_today(spark):
    d0 = dt.date(2024, 1, 31)
    rows = [("a", d0 - dt.timedelta(days=x), float(v)) for x, v in ((29, 1), (28, 10), (1, 20), (0, 500))]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = {r["d"]: r["m"] for r in df.withColumn("m", I.calendar_mean(("k",), "d", F.col("v"))).collect()}
    assert got[d0] == 15.0 and got[d0 - dt.timedelta(days=29)] is None


def test_since_latch_and_runs(spark):
    ev = [0, 0, 1, 0, 1, 0, 0]
    df = frame(spark, [float(x) for x in ev]).withColumn("i", I.bar_index(S))
    df = df.withColumns({"s": I.bars_since(S, F.col("v") == 1, F.col("i")), "l": I.latch(S, F.col("v") == 1, F.col("i"))})
    df = I.run_length(df, S, F.col("v") == 0, "r").orderBy("t")
    got = df.collect()
    assert [x["s"] for x in got] == [-1, -1, 0, 1, 0, 1, 2]
    assert [x["l"] for x in got] == [-1, -1, 0, 1, 2, 3, 4]
    assert [x["r"] for x in got] == [1, 2, 0, 1, 0, 1, 2]


def test_up_streak_and_candle(spark):
    df = frame(spark, [5.0, 6.0, 7.0, 6.5, *(7.0 + k for k in range(9))])
    got = [x["u"] for x in X.up_streak(df, S, F.col("v"), "u").orderBy("t").collect()]
    assert got == [0, 1, 2, 0, *range(1, 10)]
    flat = spark.createDataFrame([(5.0, 5.0, 5.0, 5.0)], "open double, high double, low double, close double")
    assert flat.withColumns(X.candle_shape()).first()["body_frac"] is None


def test_window_arrays_pad_and_mask(spark):
    got = I.window_arrays(frame(spark, [1.0, 2.0, 3.0]), S, ["v"], 2, 1, "w").orderBy("t").collect()
    assert [list(x["w_v"]) for x in got] == [[0, 0, 1, 2], [0, 1, 2, 3], [1, 2, 3, 0]]
    assert [list(x["w_mask"]) for x in got] == [[0, 0, 1, 1], [0, 1, 1, 1], [1, 1, 1, 0]]


def test_episode_gap_is_strictly_above_45_days(spark):
    d = dt.date(2020, 1, 1)
    days = [d, d + dt.timedelta(45), d + dt.timedelta(45 + 46)]
    df = spark.createDataFrame([("a", x) for x in days], "ticker string, date date")
    assert [r["episode"] for r in U.with_episodes(df).orderBy("date").collect()] == [0, 0, 1]


def test_type_filter_does_not_duplicate(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "ticker string, v int")
    ref = spark.createDataFrame([("a", "n", "CS"), ("a", "n", "ADRC"), ("b", "n", "ETF")], "ticker string, name string, type string")
    assert [tuple(r) for r in U.in_types(d, ref, ["CS", "ADRC"]).collect()] == [("a", 1)]


def test_adjustment_edges(spark):
    d = lambda n: dt.date(2024, 1, n)
    px = spark.createDataFrame([("a", d(n), 10.0, 10.0, 10.0, 10.0, 100) for n in (1, 2, 3, 4)],
                               "ticker string, date date, open double, high double, low double, close double, volume long")
    sp = spark.createDataFrame([("a", d(3), 2.0)], "ticker string, execution_date date, split_ratio double")
    dv = spark.createDataFrame([("a", d(2), 2.0), ("a", dt.date(2024, 1, 9), 1.0), ("a", d(4), 50.0)],
                               "ticker string, ex_dividend_date date, cash_amount double")
    got = {r["date"]: r for r in adjust.adjust_prices(px, sp, dv).collect()}
    f = {r["ex_dividend_date"]: r["div_factor"] for r in adjust.dividend_factors(dv, px, adjust.split_factors(sp)).collect()}
    assert f[dt.date(2024, 1, 9)] == 1.0 and f[d(4)] == 1e-6 and f[d(2)] == pytest.approx(0.8)
    # strict: the split applies before its date only, the dividend before its ex-date only
    assert got[d(3)]["adj_volume"] == 100 and got[d(2)]["adj_volume"] == 200
    assert got[d(1)]["adj_close"] == pytest.approx(10 / 2 * 0.8 * 1e-6) and got[d(2)]["adj_close"] == pytest.approx(10 / 2 * 1e-6)
    assert got[d(4)]["adj_close"] == pytest.approx(10.0)


def test_daily_features_are_prior_state(spark):
    r = random.Random(5)
    d0 = dt.date(2024, 1, 1)
    bars = []
    for i in range(60):
        o, c = r.uniform(9, 11), r.uniform(9, 11)
        bars.append(("a", 0, d0 + dt.timedelta(i), o, max(o, c) + 0.1, min(o, c) - 0.1, c, 100 + i))
    df = spark.createDataFrame(bars, "ticker string, episode int, date date, open double, high double, low double, close double, volume long")
    got = X.daily_features(df).orderBy("date").collect()
    tr = [None] + [math.log(max(b[4], a[6]) / min(b[5], a[6])) for a, b in zip(bars, bars[1:])]
    for i in range(60):
        w = [x for x in tr[max(0, i - 14): i] if x is not None]
        assert got[i]["atr_log"] == (pytest.approx(sum(w) / len(w)) if w else None)
        v = [b[7] for b in bars[max(0, i - 20): i]]
        assert got[i]["rvol"] == (pytest.approx(bars[i][7] / (sum(v) / len(v))) if v else None)


@pytest.mark.parametrize("n", [1, 2, 3, 20, 252])
def test_rolling_regression_by_blocks_is_the_frame_s(spark, n):
    """Missing values, a flat stretch, an x far from zero, series shorter than the window and not a multiple of it."""
    rng = random.Random(n)
    rows = [(k, t, 1e7 + t, None if rng.random() < 0.1 else 5.0 if 100 < t < 140 else rng.gauss(1e3, 1)) for k, m in (("a", 1), ("b", 19), ("c", 800)) for t in range(m)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double")
    w = S.last(n, True)
    want = df.withColumns({"s": F.regr_slope("y", "x").over(w), "r": F.regr_r2("y", "x").over(w)})
    got = I.rolling_ols(df, S, F.col("y"), F.col("x"), n)
    for a, b in zip(got.orderBy("k", "t").collect(), want.orderBy("k", "t").collect()):
        assert (a.slope is None) == (b.s is None) and (a.r2 is None) == (b.r is None), (a, b)
        assert a.slope is None or (a.slope == pytest.approx(b.s, rel=1e-7, abs=1e-9) and a.r2 == pytest.approx(b.r, rel=1e-6, abs=1e-9))


def test_rolling_regression_costs_the_same_for_long_windows(spark):
    import time

    df = spark.range(150_000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("y"))

    def seconds(n):
        begun = time.time()
        I.rolling_ols(df, S, F.col("y"), F.col("t"), n).agg(F.sum("slope"), F.sum("r2")).collect()
        return time.time() - begun

    seconds(20)
    assert seconds(5000) < 3 * seconds(20) + 1


@pytest.mark.parametrize("period,n", [(9, 366), (3, 200), (20, 130)])
def test_ema_is_the_recursion_to_the_last_bit(spark, period, n):
    """F4 to F8: prices and means that are equal must compare so; a null leaves the mean."""
    r = random.Random(4)
    series = {"same": [21.37] * n, "some": [r.choice([20.1, 20.1, 20.3, None]) for _ in range(n)], "any": [r.uniform(20, 22) for _ in range(n)]}
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(x["k"], x["t"]): x["e"] for x in I.with_emas(df, S, {"e": (F.col("v"), period)}).collect()}
    assert len(got) == len(rows)
    a = 2 / (period + 1)
    for k, vs in series.items():
        e = None
        for i, v in enumerate(vs):
            e = e if v is None else v if e is None else e + a * (v - e)
            assert got[k, i] == e
    assert {got["same", i] for i in range(n)} == {21.37}
