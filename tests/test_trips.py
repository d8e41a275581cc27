"""Books and exits: hand-made cases and brute force."""

import datetime as dt
import heapq
import random

import pytest
from pyspark.sql import functions as F

from barspark.functions import features as X
from barspark.operators import capacity, chains as C, detect as T, strata, trips as R

BAR = "ticker string, session long, minute long, open double, high double, low double, close double, volume long"


def sessions(spark, seed, n=40, keys=3):
    r = random.Random(seed)
    rows = []
    for k in range(keys):
        px = 10.0
        for m in range(n):
            o = px
            px = max(1.0, px * (1 + r.uniform(-0.05, 0.05)))
            rows.append((f"t{k}", 1, 580 + m, o, max(o, px) * 1.01, min(o, px) * 0.99, px, r.randrange(10, 500)))
    return spark.createDataFrame(rows, BAR)


S = X.SESSION


def bars(spark, cols):
    """One session from columns; booleans as they are."""
    rows = list(zip(*cols.values()))
    kind = lambda v: "boolean" if any(isinstance(x, bool) for x in v) else "long" if all(isinstance(x, int) for x in v) else "double"
    df = spark.createDataFrame(rows, ", ".join(f"{c} {kind(v)}" for c, v in cols.items()))
    return df.withColumns({"ticker": F.lit("a"), "session": F.lit(1)})


def legs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fade_reenters_after_a_stop(spark):
    x = bars(spark, {"minute": [600, 601, 602, 603, 604, 605], "close": [10.0, 11.0, 10.5, 12.0, 11.0, 10.8],
                     "ema": [10.0, 10.5, 10.4, 11.0, 10.9, 10.8], "ema_p": [None, 10.0, 10.5, 10.4, 11.0, 10.9], "ema_hi": [10.0, 10.5, 10.5, 11.0, 11.0, 11.0],
                     "sess_hic_p": [None, 10.0, 11.0, 13.0, 13.0, 13.0], "bars_since_hi": [0, 0, 1, 0, 1, 2]})
    fade = lambda **k: legs(C.fade_legs(x, S, F.lit(True), start=600, **k), "entry_at", "exit_at", "exit_reason", "leg")
    # signalled at 601, short at 602 when the average falls, stopped at 603 by its new high, again at 604
    assert fade(legs=2) == [(602, 603, "ema_max_stop", 0), (604, 605, "moc", 1)]
    assert fade() == [(602, 603, "ema_max_stop", 0)]
    assert fade(entry="cross", arm_bars=1) == [(602, 603, "ema_max_stop", 0)]
    assert fade(entry="bars_since", n_since=2) == [(605, 605, "moc", 0)]


def test_drive_waits_for_a_new_low_between_legs(spark):
    x = bars(spark, {"minute": [600, 601, 602, 603, 604], "close": [10.0, 9.0, 9.5, 8.0, 9.0], "low": [9.9, 8.9, 9.4, 7.9, 8.9],
                     "ema": [10.0, 9.0, 9.6, 8.5, 8.9], "ema_lo": [9.5, 9.0, 9.0, 8.5, 8.5], "late": [False, False, False, True, True]})
    drive = lambda dead=F.lit(False), **k: legs(C.drive_legs(x, S, F.lit(True), dead, **k), "entry_at", "entry_price", "exit_at", "exit_reason", "leg")
    assert drive(legs=2) == [(600, 10.0, 601, "stop", 0), (603, 8.0, 604, "moc", 1)]
    assert drive() == [(600, 10.0, 601, "stop", 0)]
    assert drive(F.col("late"), legs=2) == [(600, 10.0, 601, "stop", 0)]
    above = x.withColumn("close", F.col("close") + 1)
    got = legs(C.drive_legs(above, S, F.lit(True), F.lit(False), limit=True), "entry_at", "entry_price", "exit_at", "exit_reason")
    assert got == [(601, 10.0, 603, "stop")]  # the low of 601 reaches the average of 600


def test_a_held_trigger_hides_others(spark):
    x = bars(spark, {"minute": [600, 601, 602, 603], "close": [10.0, 10.0, 8.0, 9.0], "quality": [False, True, True, True], "stop_level": [9.0, 9.0, 7.0, 7.0]})
    got = legs(C.one_at_a_time(x, S, F.lit(True), carry=("quality",)), "entry_at", "exit_at", "exit_reason", "quality")
    assert got == [(600, 602, "stop", False), (602, 603, "moc", True)]


def test_extreme_fills_after_trail_or_rise(spark):
    x = bars(spark, {"minute": [600, 601, 602], "open": [10.0, 9.0, 9.2], "high": [10.1, 9.3, 10.5], "low": [9.5, 8.9, 9.1], "close": [9.6, 9.0, 10.4],
                     "sess_lo_p": [None, 9.5, 8.9], "sess_hi_p": [None, 10.1, 10.1]})
    fill = lambda **k: legs(C.extreme_fills(x, S, F.col("minute") == 601, **k), "entry_at", "entry_price", "exit_reason")
    assert fill(trail=True) == [(602, 10.4, "moc")]
    assert fill(trail=False, rise=0.1, downside=False) == [(602, 9.9, "moc")]
    assert fill(trail=False, rise=0.5, downside=False) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_timed_pullback_is_a_loop_over_bars(spark, seed):
    r = random.Random(seed)
    n, drought, length = 120, 4, 6
    ema = [10 + r.uniform(-1, 1) for _ in range(n)]
    cols = {"minute": list(range(600, 600 + n)), "new_hi": [r.random() < 0.15 for _ in range(n)], "ema": ema, "ema_hi": [max(ema[:i + 1]) for i in range(n)],
            "ema_p": [None, *ema[:-1]], "close": [10 + r.uniform(-1, 1) for _ in range(n)], "volume": [r.randrange(1, 9) for _ in range(n)], "atr_log": [r.random() for _ in range(n)]}
    timer, since, want, got = -1, 0, [], legs(C.timed_pullback(bars(spark, cols), S, drought, length), "minute", "timer", "bars_since_high", "pb_depth", "pb_atr")
    piece = []
    for i in range(n):
        new, fresh = cols["new_hi"][i], False
        if new and since >= drought:
            timer = length
        elif timer > 0:
            timer -= 1
            fresh = timer == 0
        else:
            fresh = new
        since = 0 if new else since + 1
        piece = [i] if fresh else [*piece, i]
        want.append((600 + i, timer, since, max(0, *(cols["ema_hi"][k] / ema[k] - 1 for k in piece), 0), sum(cols["atr_log"][k] for k in piece) / len(piece)))
    assert all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:]) for a, b in zip(got, want)) and len(got) == n


def test_entry_bar_is_exempt_and_stop_precedes_close(spark):
    rows = [("a", 1, 600, 10.0, 10.0, 8.0, 9.0, 1), ("a", 1, 601, 9.0, 9.0, 7.0, 7.0, 1)]
    x = spark.createDataFrame(rows, BAR).withColumns({"entry_price": F.col("close"), "stop_level": F.lit(9.5)})
    t = R.passage_exit(x, ["ticker", "session"], "minute", F.col("minute") == 600, ["open", "low", "close"], ["entry_price", "stop_level"],
                     R.RichExit(moc=601, stop="low").rules()).first()
    assert (t["exit_at"], t["exit_price"], t["exit_reason"]) == (601, 9.0, "stop")


def test_missing_metric_fails_its_gate(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert df.filter(T.all_of([F.col("a") < 5, F.col("b") > 0])).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_capacity_book_matches_one_ordered_walk(spark, seed):
    r = random.Random(seed)
    d0 = dt.date(2024, 1, 1)
    rows = []
    for i in range(120):
        a = r.choice([r.randrange(0, 30), r.randrange(60, 90), r.randrange(0, 200)])
        rows.append((i, d0 + dt.timedelta(a), d0 + dt.timedelta(a + r.randrange(1, 9)), float(r.choice([1, 2, 5]))))
    df = spark.createDataFrame(rows, "trip_id long, entry_date date, exit_date date, notional double")
    books = {"tiny": 6.0, "mid": 20.0, "big": 1e6}
    got = {(x["scenario"], x["trip_id"]): x["accepted"] for x in capacity.capacity_book(df, books).collect()}
    assert len(got) == 360
    for name, cap in books.items():
        used, open_ = 0.0, []
        for i, a, z, n in sorted(rows, key=lambda x: (x[1], x[0])):
            while open_ and open_[0][0] <= a:
                used -= heapq.heappop(open_)[1]
            ok = used + n <= cap
            if ok:
                used += n
                heapq.heappush(open_, (z, n))
            assert got[(name, i)] == ok, (name, i)


def test_exposure_releases_before_entries(spark):
    d = lambda n: dt.date(2024, 1, n)
    t = spark.createDataFrame([(d(1), d(3), 10.0), (d(3), d(5), 10.0)], "a date, z date, n double")
    got = {x["day"]: x["max_notional"] for x in strata.concurrent_exposure(t, "a", "z", "n").collect()}
    assert got == {d(1): 10.0, d(2): 10.0, d(3): 10.0, d(4): 10.0, d(5): 10.0}


def test_profit_factor_without_losers_is_null(spark):
    t = spark.createDataFrame([(1, 0.2), (1, 0.9), (2, -0.1), (2, 0.8)], "g int, ret double")
    got = {x["g"]: x for x in t.groupBy("g").agg(*strata.summary()).collect()}
    assert got[1]["pf"] is None and got[2]["pf"] == pytest.approx(8.0) and got[2]["pf_clip"] == pytest.approx(5.0)


def test_monthly_split_of_a_three_month_trip(spark):
    d = dt.date
    t = spark.createDataFrame([(1, "a", d(2024, 1, 30), d(2024, 3, 2), 10.0, 13.0, 2.0, 4.0, 33.0)],
                              "trip_id long, symbol string, entry_date date, exit_date date, entry_price double, exit_price double, qty double, fees double, funding double")
    a = spark.createDataFrame([("a", d(2024, 2, 1), 11.0), ("a", d(2024, 3, 1), 12.0)], "symbol string, month date, anchor_close double")
    got = {x["month"]: x["month_pnl"] for x in strata.monthly_mark_to_market(t, a).collect()}
    assert got == {d(2024, 1, 1): pytest.approx(2 - 2 + 2.0), d(2024, 2, 1): pytest.approx(2 + 29.0), d(2024, 3, 1): pytest.approx(2 - 2 + 2.0)}
