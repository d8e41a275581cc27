"""Bar construction against plain loops over small tapes."""

import datetime as dt
import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from barspark.functions.scalars import eastern_minute, session_anchor_ns
from barspark.operators import bars as B
from barspark.operators.prefix import time_chunk

TAPE = "ticker string, ts long, seq long, price double, size long, sign int"


def tape(seed, n=300, tickers=("hot",) * 8 + ("cold",), big=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = r.choice([0, 1, 3, 10, 40, 500 if big else 25])
        out.append((r.choice(tickers), r.randrange(10_000), i, round(r.uniform(5, 9), 2), size, r.choice([1, -1])))
    return out


def ordered(rows, k):
    return sorted((x for x in rows if x[0] == k and x[4] > 0), key=lambda x: (x[1], x[2]))


def loop_volume(rows, v):
    bars, cur, room = [], [], v
    for _, ts, _, px, q, _ in rows:
        while q > 0:
            f = min(q, room)
            cur.append((px, f, ts))
            q, room = q - f, room - f
            if room == 0:
                bars.append(cur)
                cur, room = [], v
    return bars + ([cur] if cur else [])


@pytest.mark.parametrize("v", [7, 50, 1000])
def test_quantity_bars(spark, v):
    rows = tape(1, big=True)
    df = spark.createDataFrame(rows, TAPE)
    got = B.quantity_bars(df, ["ticker"], v, F.col("size"), time_chunk(F.col("ts"), 1000)).collect()
    for k in ("hot", "cold"):
        want = loop_volume(ordered(rows, k), v)
        mine = sorted((g for g in got if g["ticker"] == k), key=lambda g: g["bar"])
        assert len(mine) == len(want)
        for g, w in zip(mine, want):
            assert g["volume"] == sum(f for _, f, _ in w) and g["high"] == max(p for p, _, _ in w)
            assert (g["open"], g["close"]) == (w[0][0], w[-1][0]) and g["dollar_volume"] == pytest.approx(sum(p * f for p, f, _ in w))


def loop_imbalance(rows, th):
    bars, cur, theta = [], [], 0.0
    for _, ts, _, px, q, s in rows:
        while q > 0:
            if abs(theta + s * q) < th:
                cur.append((px, q, s))
                theta, q = theta + s * q, 0
            else:
                x = (th * s - theta) / s
                if x > 0:
                    cur.append((px, x, s))
                q -= x
                bars.append(cur)
                cur, theta = [], 0.0
    return bars + ([cur] if cur else [])


@pytest.mark.parametrize("seed", [2, 3])
@pytest.mark.parametrize("th", [5, 33, 400])
def test_imbalance_bars(spark, seed, th):
    rows = tape(seed, big=True)
    df = spark.createDataFrame(rows, TAPE)
    got = B.imbalance_bars(df, ["ticker"], th, F.col("size"), F.col("sign"), time_chunk(F.col("ts"), 700)).collect()
    n = {x["ticker"]: x["n_bars"] for x in B.imbalance_bar_count(
        df, ["ticker"], F.lit(float(th)), F.col("size"), F.col("sign"), time_chunk(F.col("ts"), 700)).collect()}
    for k in ("hot", "cold"):
        want = loop_imbalance(ordered(rows, k), th)
        mine = sorted((g for g in got if g["ticker"] == k), key=lambda g: g["bar"])
        assert len(mine) == len(want) == n[k]
        for g, w in zip(mine, want):
            assert g["quantity"] == pytest.approx(sum(f for _, f, _ in w))
            assert g["imbalance"] == pytest.approx(sum(f * s for _, f, s in w))
            assert (g["open"], g["close"]) == (w[0][0], w[-1][0])


def test_imbalance_threshold_search(spark):
    rows = tape(7)
    df = spark.createDataFrame(rows, TAPE)
    got = {x["ticker"]: x for x in B.imbalance_thresholds(
        df, ["ticker"], 15, F.col("size"), F.col("sign"), time_chunk(F.col("ts"), 2000)).collect()}
    for k in ("hot", "cold"):
        o = ordered(rows, k)
        th = max(1.0, 2.0 ** round(math.log2(max(1.0, sum(x[4] for x in o) / 15))))
        for _ in range(20):
            if len(loop_imbalance(o, th)) >= 15:
                break
            th /= 2
            if th < 1:
                break
        assert got[k]["threshold"] == th


def test_merge_bursts_is_anchored_on_the_first_trade(spark):
    rows = [("a", t, i, 10.0 + i, 1, 1) for i, t in enumerate([0, 60, 99, 100, 150, 199, 200, 900])]
    df = spark.createDataFrame(rows, TAPE)
    got = B.merge_bursts(df, ["ticker"], 100, 90).orderBy("anchor").collect()
    assert [(g["anchor"], g["trade_count"]) for g in got] == [(0, 3), (100, 3), (200, 1), (900, 1)]


def loop_anchors(times, window):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= window:
            out.append(t)
    return out


def test_anchors_are_those_of_the_loop(spark):
    """Random tapes with gaps, ties of time, long chains; negative times; a key of one trade."""
    rng = random.Random(3)
    keys = {k: sorted({rng.choice([rng.randrange(-500, 4000), 10_000 + rng.randrange(60)]) for _ in range(n)}) for k, n in {"a": 900, "b": 40, "c": 1}.items()}
    df = spark.createDataFrame([(k, t) for k, ts in keys.items() for t in ts], "k string, ts long")
    for window in (1, 7, 100):
        got = {}
        for r in B.anchors(df, ["k"], window, 300).collect():
            got.setdefault(r.k, []).append(r.ts)
        assert {k: sorted(v) for k, v in got.items()} == {k: loop_anchors(ts, window) for k, ts in keys.items()}


def test_one_burst_of_many_trades_meets_no_large_task(spark, monkeypatch):
    """A chain of 60,000 trades without a gap: chunks of about 2,048 rows, the groups of the loop, no Python in the plan."""
    from barspark.operators import prefix

    monkeypatch.setattr(prefix, "CHUNK_ROWS", 2048)
    df = spark.range(60_000).select(F.lit("a").alias("ticker"), (F.col("id") * 3 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("ts"), F.col("id").alias("seq"),
                                    F.lit(10.0).alias("price"), F.lit(2).cast("long").alias("size"))
    per = prefix.with_chunks(df, ["ticker"], ["ts"], 10**9).groupBy("__ck").count().agg(F.max("count"), F.count("*")).first()
    assert per[0] <= 4096 and per[1] > 20
    out = B.merge_bursts(df, ["ticker"], 100, 10**9)
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    got = out.collect()
    times = [r.ts for r in df.select("ts").collect()]
    assert sorted(r.anchor for r in got) == loop_anchors(times, 100) and sum(r.trade_count for r in got) == 60_000


def test_moments_are_as_precise_as_a_second_pass(spark):
    """Prices of a million plus hundredths, and plus what no tick holds; sizes of zero."""
    rng = random.Random(5)
    for digits in (2, 9):
        rows = [("a", rng.randrange(3) * 10, i, round(1e6 + rng.random(), digits), rng.choice([0, 1, 300, 10**6]), 1) for i in range(2000)] + [("z", 5, 1, 7.0, 0, 1)]
        got = {(r.ticker, r.bucket): r for r in B.moment_bars(spark.createDataFrame(rows, TAPE), ["ticker"], 10).collect()}
        for b in range(3):
            mine = [(Fraction(r[3]), r[4]) for r in rows if r[0] == "a" and r[1] // 10 == b]
            n = sum(q for _, q in mine)
            mean = sum(p * q for p, q in mine) / n
            sd = math.sqrt(sum(q * (p - mean) ** 2 for p, q in mine) / n)
            r = got["a", b]
            assert r.volume == n and r.trade_count == len(mine) and abs(r.vwap - float(mean)) < 1e-9
            assert r.vwstd == pytest.approx(sd, rel=1e-9)
        assert got["z", 0].vwap is None and got["z", 0].vwstd is None and got["z", 0].volume == 0


def test_condition_codes(spark):
    rows = [(1, 5, 0, [8, 32], True), (2, 5, 0, [32], False), (3, 5, 0, None, True), (4, 5, 0, [], True), (5, 0, 0, [], False),
            (6, 5, 201, [17], False), (7, 5, 0, [12, 37], True), (8, 5, 0, [53], False)]
    df = spark.createDataFrame([r[:4] for r in rows], "id long, size long, trf_id long, conditions array<int>")
    assert {r["id"] for r in B.lit_trades(df).collect()} == {r[0] for r in rows if r[4]}


def test_time_bars_ties_rounding_and_zero_deviation(spark):
    rows = [("a", 40, 2, 5.0, 10, 1), ("a", 40, 1, 4.0, 10, 1), ("b", 10, 1, 3.3, 7, 1), ("b", 11, 2, 3.3, 9, 1)]
    df = spark.createDataFrame(rows, TAPE)
    a, b = B.time_bars(df, ["ticker"], 60).orderBy("ticker").collect()
    assert (a["bucket"], a["open"], a["close"]) == (0, 4.0, 5.0)
    assert b["vwstd"] == pytest.approx(0.0, abs=1e-6) and b["vwap"] == pytest.approx(3.3)
    r = {x["ticker"]: x["bucket"] for x in B.time_bars(df, ["ticker"], 60, mode="round").collect()}
    assert r == {"a": 1, "b": 0}


def test_any_sequence_orders_a_bucket(spark):
    day = 86_400 * 10**9
    rows = [("a", day - 1, 2**62, 5.0, 1, 1), ("a", day - 1, 2**62 + 1, 6.0, 1, 1), ("a", day - 1, 2**40, 4.0, 1, 1), ("a", 7, 2**63 - 1, 3.0, 1, 1)]
    g = B.time_bars(spark.createDataFrame(rows, TAPE), ["ticker"], day).first()
    assert (g["open"], g["close"], g["trade_count"]) == (3.0, 6.0, 4)


def test_a_trade_spans_any_number_of_bars(spark):
    rows = [("a", 0, 1, 2.0, 150_000, 1), ("a", 1, 2, 3.0, 1, 1)]
    g = B.quantity_bars(spark.createDataFrame(rows, TAPE), ["ticker"], 1.0, F.col("size"), time_chunk(F.col("ts"), 10))
    x = g.agg(F.count("*"), F.sum("volume"), F.max("bar"), F.sum("trade_count")).first()
    assert tuple(x) == (150_001, 150_001.0, 150_000, 2)


def test_a_ladder_of_thirty_halvings(spark):
    # one huge trade sets the first rung near 2^30; the others alternate, so that only small thresholds close bars
    rows = [("a", 0, 0, 1.0, 2**34, 1)] + [("a", k, k, 1.0, 1, 1 - 2 * (k % 2)) for k in range(1, 9)]
    df = spark.createDataFrame(rows, TAPE)
    got = B.imbalance_thresholds(df, ["ticker"], 2**34, F.col("size"), F.col("sign"), time_chunk(F.col("ts"), 100)).first()
    assert got["threshold"] == 1.0 and got["n_bars"] >= 2**34
    deep = B.imbalance_thresholds(df.filter("ts > 0").unionAll(df.filter("ts = 0").withColumn("size", F.lit(2**31))), ["ticker"], 2**31 - 5,
                                  F.col("size"), F.col("sign"), time_chunk(F.col("ts"), 100)).first()
    assert deep["threshold"] == 1.0 and deep["n_bars"] >= 2**31 - 5


def test_daylight_saving_anchor(spark):
    days = [dt.date(2025, 3, 7), dt.date(2025, 3, 9), dt.date(2025, 3, 10), dt.date(2025, 11, 2), dt.date(2025, 11, 3)]
    df = spark.createDataFrame([(d,) for d in days], "date date").withColumn("ns", session_anchor_ns(F.col("date")))
    got = {r["date"]: r["ns"] for r in df.collect()}
    hours = {d: (got[d] // 10**9 - int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.timezone.utc).timestamp())) / 3600 for d in days}
    assert [hours[d] for d in days] == [9, 8, 8, 9, 9]  # 04:00 Eastern is 09:00 UTC in winter, 08:00 in summer
    m = df.withColumn("m", eastern_minute(F.col("ns"))).collect()
    assert all(r["m"] == 240 for r in m)


def test_early_close(spark):
    d1, d2 = dt.date(2025, 11, 26), dt.date(2025, 11, 28)
    rows = [("a", d, h * 10, 5.0, 2) for d in (d1, d2) for h in range(12)]
    t = spark.createDataFrame(rows, "ticker string, date date, ts long, price double, size long")
    half = spark.createDataFrame([(d2,)], "date date")
    got = {(r["date"], r["bucket"]) for r in B.session_bars(t, ["ticker", "date"], 10, 10, 7, half).collect()}
    assert got == {(d1, b) for b in range(10)} | {(d2, b) for b in range(7)}


def test_log_returns_from_and_to_a_free_day_are_those_of_sql(spark, tmp_path):
    """a day whose trades all cost nothing stopped the query."""
    import duckdb
    from barspark.plans.registry import ORACLES, QUERIES, query  # noqa: F401
    from barspark.plans import load

    load()
    px = [2.0, 0.0, 0.0, 3.0, 4.5]
    duckdb.execute(f"""COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) DAY AS ts, CAST(7 AS BIGINT) AS user_id, 'view' AS event_type,
        CAST({px}[i + 1] AS DOUBLE) AS value, '{{"k": 3}}' AS props FROM range({len(px)}) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLES["C16_bar_shape"]).fetchall()
    got = [tuple(r) for r in QUERIES["C16_bar_shape"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[2] for r in got} >= {float("inf"), float("-inf")} and any(r[2] is not None and r[2] != r[2] for r in got)


def test_log_returns_across_signs_and_beside_nan_are_those_of_sql(spark, tmp_path):
    """a return between prices of opposite signs was NULL, one from a NaN to zero infinite, one that underflows NULL."""
    import duckdb
    from barspark.plans import load
    from barspark.plans.registry import ORACLES, QUERIES

    load()
    nan, inf = float("nan"), float("inf")
    px = [2.0, -1.0, -3.0, 0.0, -2.0, 0.0, nan, 0.0, 5.0, nan, 2.0, 1e200, 1e-200, 1e200, inf, inf, 1.0, -inf, 3.0]
    values = ", ".join(f"({i}, CAST('{x}' AS DOUBLE))" for i, x in enumerate(px))
    duckdb.execute(f"""COPY (SELECT CAST(i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) DAY AS ts, CAST(7 AS BIGINT) AS user_id, 'view' AS event_type,
        x AS value, '{{"k": 3}}' AS props FROM (VALUES {values}) v(i, x)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLES["C16_bar_shape"]).fetchall()
    got = [tuple(r) for r in QUERIES["C16_bar_shape"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_the_bar_without_a_time_is_the_last_as_in_sql(spark, tmp_path):
    """it was the first, so that the earliest day had a return from it."""
    import duckdb
    from barspark.plans import load
    from barspark.plans.registry import ORACLES, QUERIES

    load()
    duckdb.execute(f"""COPY (SELECT CAST(i AS BIGINT) AS event_id, CASE WHEN i <> 1 THEN TIMESTAMP '2024-01-01' + INTERVAL (i) DAY END AS ts, CAST(7 AS BIGINT) AS user_id,
        'view' AS event_type, CAST(i + 2 AS DOUBLE) AS value, '{{"k": 3}}' AS props FROM range(4) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(ORACLES["C16_bar_shape"]).fetchall()
    got = [tuple(r) for r in QUERIES["C16_bar_shape"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert [r[2] for r in got if r[1] == 19723] == [None]
