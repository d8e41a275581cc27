"""Streams whose bars come out of order, and day tables that are compacted while they are read."""

import datetime as dt
import glob
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.session import scratch_path
from barspark.sources.files import Files
from barspark.streaming import bars as B
from barspark.streaming import compaction as Z

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def loop(bars, period, min_run):
    """Bar by bar: ts, ema, vwap, high, low, run, reclaim."""
    pv = v = 0.0
    ema = hi = lo = None
    run, out, a = 0, [], 2.0 / (period + 1)
    for ts, h, low, c, q in sorted(bars):
        ema_p, vwap_p, was = ema, pv / v if v > 0 else None, run
        if ema_p is not None and vwap_p is not None:
            run = run + 1 if ema_p < vwap_p else 0
        pv, v = pv + (h + low + c) / 3.0 * q, v + q
        ema = c if ema is None else ema + a * (c - ema)
        hi, lo = max(h, hi or h), min(low, lo if lo is not None else low)
        cross = ema_p is not None and vwap_p is not None and v > 0 and ema_p <= vwap_p and ema > pv / v and was >= min_run
        out.append((ts, pytest.approx(ema), pytest.approx(pv / v) if v > 0 else None, hi, lo, run, cross))
    return out


def test_shuffled_bars_in_ten_batches_with_a_restart_give_the_loop(spark, rocks):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 5, 1, 9, 30)
    bars = {}
    for k in ("a", "b", "c"):
        px = 50.0
        for m in range(60 if k != "c" else 2):
            px *= 1 + rng.uniform(-0.02, 0.02)
            bars.setdefault(k, []).append((t0 + dt.timedelta(minutes=m), px * 1.01, px * 0.99, px, 0.0 if m < 2 else float(rng.randrange(1, 90))))
    # a bar is at most 20 minutes behind a later one that came before it
    came = sorted(((b[0] + dt.timedelta(minutes=rng.uniform(0, 20)), k, *b) for k, bs in bars.items() for b in bs))
    came.append((None, "end", t0 + dt.timedelta(days=2), 1.0, 1.0, 1.0, 1.0))
    src, out, ck = (scratch_path(spark) for _ in range(3))
    schema = "k string, ts timestamp, high double, low double, close double, volume double"
    size = -(-len(came) // 10)

    def run(batches):
        for i in batches:
            spark.createDataFrame([r[1:] for r in came[i * size:(i + 1) * size]], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        B.run_available(B.session_stream(stream, ["k"], 9, 3, 24, "25 minutes"), out, ck)

    run(range(5))
    half = spark.read.parquet(out).count()
    run(range(5, 10))
    assert 0 < half < spark.read.parquet(out).count()
    got = spark.read.parquet(out).where("k <> 'end'").collect()
    assert len(got) == sum(map(len, bars.values()))
    for k, bs in bars.items():
        mine = sorted((r.ts, r.ema, r.vwap, r.sess_high, r.sess_low, r.run_below, r.reclaim) for r in got if r.k == k)
        assert mine == loop(bs, 9, 3)
    assert any(r.reclaim for r in got)


class Handle:
    """State and timers of one group, counted."""

    def __init__(self):
        self.value, self.timers, self.updates = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.updates = value, self.updates + 1

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_group_of_sessions_costs_one_state_update_a_batch():
    """state was read and written once a session; here 300 sessions come in three batches and leave by their timers."""
    rng = random.Random(2)
    t0 = pd.Timestamp("2024-05-01 09:30")
    bars = {(k, k % 7): [(t0 + pd.Timedelta(minutes=m), x * 1.01, x * 0.99, x, float(rng.randrange(0, 9)))
                         for m, x in ((m, rng.choice([20.0, 20.5, 21.0, 21.5])) for m in range(rng.randrange(1, 25)))] for k in range(300)}
    rows = pd.DataFrame([(*k, *b) for k, bs in bars.items() for b in bs], columns=["k", "d", *B.BAR]).sample(frac=1, random_state=3)
    p, h, got = B._SessionProcessor(["k", "d"], 9, 2, 24), Handle(), []
    p.init(h)
    mark = lambda t: type("T", (), {"getCurrentWatermarkInMs": lambda self: t})()
    ms = lambda minutes: (t0 + pd.Timedelta(minutes=minutes)).value // 1_000_000
    for i, (a, z, seen) in enumerate(((0, 10, 0), (5, 20, ms(5)), (15, 30, ms(15)))):
        # a batch may bring bars that are older than those before it, but none that the watermark has passed
        part = rows[(rows.ts >= t0 + pd.Timedelta(minutes=a)) & (rows.ts < t0 + pd.Timedelta(minutes=z))]
        new = part[(part.k % 2 == 0) & (part.ts >= t0 + pd.Timedelta(minutes=(0, 10, 20)[i])) | (part.k % 2 == 1) & (part.ts < t0 + pd.Timedelta(minutes=(5, 15, 30)[i]))]
        got += p.handleInputRows((0,), iter([new]), mark(seen))
        assert h.updates == i + 1 and len(h.timers) == 1
    for when in (ms(60), ms(60) + 2 * 86_400_000):
        got += p.handleExpiredTimer((0,), mark(when), None)
    assert h.value is None  # all sessions were dropped at their time
    got = pd.concat(got)
    assert len(got) == len(rows)
    for (k, d), bs in bars.items():
        g = got[(got.k == k) & (got.d == d)]
        mine = [(r.ts, r.ema, None if pd.isna(r.vwap) else r.vwap, r.sess_high, r.sess_low, r.run_below, r.reclaim) for r in g.itertuples()]
        assert mine == loop(bs, 9, 2)
    assert got.reclaim.any()


def test_many_runs_leave_one_file_a_day(spark):
    """Each run adds to every day; readers keep their version while days are merged and cleared."""
    path, merge = scratch_path(spark), [F.sum("n").alias("n"), F.max("top").alias("top")]
    days = [dt.date(2024, 5, d) for d in (1, 2, 3)]
    batch = lambda i: spark.createDataFrame([(d, 1, i) for d in (days if i % 2 else days[:2])], "date date, n long, top long")
    files = lambda: [f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]
    answer = lambda df: sorted((r.date.day, r.n, r.top) for r in df.collect())
    with pytest.raises(FileNotFoundError):
        Z.merged_days(spark, path, ["date"], merge)
    assert Z.compact(spark, path, ["date"], merge) == Z.EMPTY and Z.vacuum(spark, path) == 0
    for i in range(12):
        Z.write_parts(batch(i), path, i)
        if i % 3 == 2:
            Z.compact(spark, path, ["date"], merge)
    Z.write_parts(batch(11), path, 11)  # a batch that is run again after it was merged counts once
    reader = Z.merged_days(spark, path, ["date"], merge)
    Z.write_parts(batch(12), path, 12)
    assert Z.compact(spark, path, ["date"], merge)["version"] == 5
    Z.vacuum(spark, path, keep=1)
    assert answer(reader) == [(1, 12, 11), (2, 12, 11), (3, 6, 11)]
    assert answer(Z.merged_days(spark, path, ["date"], merge)) == [(1, 13, 12), (2, 13, 12), (3, 6, 11)]
    Z.vacuum(spark, path, keep=0)
    assert len(files()) == 3 and answer(Z.merged_days(spark, path, ["date"], merge)) == [(1, 13, 12), (2, 13, 12), (3, 6, 11)]
    assert Z.compact(spark, path, ["date"], merge)["version"] == 5


def test_a_version_is_published_once(spark):
    path = scratch_path(spark)
    files = Files(spark, path)
    files.publish("{}", f"{path}/manifest/1.json")
    with pytest.raises(RuntimeError):
        files.publish("[]", f"{path}/manifest/1.json")
    assert files.read(f"{path}/manifest/1.json") == "{}"
