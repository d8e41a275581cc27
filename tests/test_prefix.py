"""Chunked scans, ranks and quantiles against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.operators import prefix
from barspark.operators.asof import asof_join, forward_fill_on_grid
from barspark.operators.prefix import exact_quantiles, framed, ntile_of, ranked, running, time_chunk


def series(n, keys, seed=1):
    r = random.Random(seed)
    return [(r.choice(keys), r.randrange(0, 500), i, r.choice([None, 1.0, 2.0, 5.5, -3.0])) for i in range(n)]


def test_running_matches_loop_on_hot_key(spark):
    # one key holds most rows; chunks are 50 time units wide
    rows = series(400, ["a"] * 9 + ["b"])
    df = spark.createDataFrame(rows, "k string, t long, seq long, v double")
    for inclusive in (True, False):
        out = running(df, ["k"], ["t", "seq"], time_chunk(F.col("t"), 50), {
            "s": ("sum", F.col("v")), "n": ("count", F.col("v")), "mx": ("max", F.col("v")), "mn": ("min", F.col("v")),
            "ls": ("last", F.col("v"))}, inclusive)
        got = {r["seq"]: r for r in out.collect()}
        for k in "ab":
            seen = []
            for _, t, seq, v in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2])):
                if inclusive and v is not None:
                    seen.append(v)
                g = got[seq]
                assert g["s"] == pytest.approx(sum(seen)) and g["n"] == len(seen)
                assert g["mx"] == (max(seen) if seen else None) and g["mn"] == (min(seen) if seen else None)
                assert g["ls"] == (seen[-1] if seen else None)
                if not inclusive and v is not None:
                    seen.append(v)


def test_framed_matches_loop(spark):
    rows = [(k, t, s, v or 0.0) for k, t, s, v in series(300, ["a"] * 5 + ["b"], 2)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, v double")
    out = framed(df, ["k"], ["t", "seq"], time_chunk(F.col("t"), 40), 7, {"s": F.sum("v"), "mx": F.max("v")}, block=10)
    got = {r["seq"]: r for r in out.collect()}
    assert len(got) == 300
    for k in "ab":
        vals = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        for i, x in enumerate(vals):
            w = [y[3] for y in vals[max(0, i - 6): i + 1]]
            assert got[x[2]]["s"] == pytest.approx(sum(w)) and got[x[2]]["mx"] == max(w)


@pytest.mark.parametrize("heavy", [False, True])
def test_ranked_and_ntile(spark, heavy):
    r = random.Random(3)
    rows = [(i % 2, 7.0 if heavy and r.random() < 0.6 else float(r.randrange(40)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, v double, id long")
    for by in ([], ["g"]):
        out = ranked(df, by, "v", "id", buckets=8).withColumn("tile", ntile_of(F.col("rn"), F.col("n"), 7))
        got = {x["id"]: x for x in out.collect()}
        for g in ([None] if not by else [0, 1]):
            part = sorted((x for x in rows if g is None or x[0] == g), key=lambda x: (x[1], x[2]))
            n = len(part)
            for i, x in enumerate(part):
                assert got[x[2]]["rn"] == i + 1 and got[x[2]]["n"] == n
                assert got[x[2]]["rk"] == 1 + sum(y[1] < x[1] for y in part)
                q, rem = divmod(n, 7)
                want = i // (q + 1) + 1 if i < rem * (q + 1) else rem + (i - rem * (q + 1)) // q + 1
                assert got[x[2]]["tile"] == want


def test_exact_quantiles(spark):
    r = random.Random(4)
    rows = [(i % 3, 1.0 if r.random() < 0.5 else r.gauss(0, 10)) for i in range(400)] + [(9, 2.5)]
    df = spark.createDataFrame(rows, "g long, v double")
    qs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.97, "q10": 1.0}
    got = {x["g"]: x for x in exact_quantiles(df, ["g"], "v", qs, buckets=8).collect()}
    for g in (0, 1, 2, 9):
        vals = [v for k, v in rows if k == g]
        for n, q in qs.items():
            assert got[g][n] == pytest.approx(np.quantile(vals, q))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("chunked", [True, False])
def test_asof_matches_brute_force(spark, direction, strict, chunked):
    r = random.Random(5)
    left = [(r.choice("aab"), r.randrange(200), i) for i in range(150)]
    right = sorted({(r.choice("aab"), r.randrange(200)) for _ in range(60)})
    right = [(k, t, None if t % 7 == 0 else t * 10) for k, t in right]
    L = spark.createDataFrame(left, "k string, lt long, id long")
    R = spark.createDataFrame(right, "k string, rt long, v long").withColumn("m", F.col("rt"))
    ch = 25 if chunked else None
    got = {x["id"]: (x["m"], x["v"]) for x in asof_join(L, R, ["k"], "lt", "rt", ["m", "v"], direction, strict, ch).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        if direction == "backward":
            c = [x for x in right if x[0] == k and (x[1] < t if strict else x[1] <= t)]
            want = max(c, key=lambda x: x[1], default=None)
        else:
            c = [x for x in right if x[0] == k and (x[1] > t if strict else x[1] >= t)]
            want = min(c, key=lambda x: x[1], default=None)
        assert got[i] == ((want[1], want[2]) if want else (None, None))


def test_forward_fill_grid(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 4, 7.0), ("b", 2, 1.0)], "k string, t long, v double")
    got = [tuple(x) for x in forward_fill_on_grid(df, ["k"], "t", ["v"], 1).orderBy("k", "t").collect()]
    assert got == [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 5.0), ("a", 4, 7.0), ("b", 2, 1.0)]


def test_many_cuts_are_looked_up_like_few(spark):
    from barspark.operators.prefix import value_bucket

    cuts = sorted({round(x * 0.37, 3) for x in range(300)})
    df = spark.createDataFrame([(c + d,) for c in [-5.0, *cuts[::7], 500.0] for d in (-0.001, 0.0, 0.001)], "v double")
    for r in df.select("v", value_bucket(F.col("v"), cuts).alias("b")).collect():
        assert r["b"] == 2 * sum(r["v"] > c for c in cuts) + (r["v"] in cuts)


def test_ranges_follow_the_row_count(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 50)
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("g"), "id")
    assert len(prefix.value_cuts(df, "v")) == 199
    got = prefix.ranked(df, ["g"], "v", "id").collect()
    assert all(r["rn"] == r["rk"] == r["id"] // 3 + 1 for r in got) and len(got) == 10_000


def burst(spark, n=20_000):
    """A key whose rows lie to 95 % in one minute of two days (and a tenth of them at one microsecond), and a quiet key."""
    f = F.col("id")
    t = F.when(f % 20 == 0, f * 8_000_000).when(f % 10 == 1, F.lit(5_000_000_000)).otherwise(5_000_000_000 + (f * 7919) % 60_000_000)
    hot = spark.range(n).select(F.lit("hot").alias("k"), t.alias("t"), f.alias("seq"))
    return hot.unionByName(spark.range(300).select(F.lit("quiet").alias("k"), (f * 9_000_000).alias("t"), f.alias("seq")))


def test_a_burst_meets_no_chunk_over_twice_the_aim(spark):
    day = 86_400_000_000
    df = prefix.with_chunks(burst(spark), ["k"], ["t", "seq"], day, rows=1024)
    per = {(r.k, r["__ck"]): r["count"] for r in df.groupBy("k", "__ck").count().collect()}
    assert max(per.values()) <= 2048 and sum(k == "quiet" for k, _ in per) == 1 and len(per) > 12
    down = Window.partitionBy("k").orderBy("t", "seq")
    assert df.withColumn("b", F.lag("__ck").over(down)).where("b > __ck").isEmpty()
    got = prefix.running(df, ["k"], ["t", "seq"], "__ck", {"n": ("count", F.col("seq"))}).where("k = 'hot'").agg(F.max("n"), F.countDistinct("n")).first()
    assert tuple(got) == (20_000, 20_000)


def test_chunk_edges_do_not_depend_on_the_tasks(spark):
    """Rows in another order and other partitions get the same chunks, and building the query runs no job."""
    df = burst(spark)
    first = prefix.with_chunks(df, ["k"], ["t", "seq"], 10**10, rows=640)
    again = prefix.with_chunks(df.repartition(7, "seq").sortWithinPartitions(F.desc("t")), ["k"], ["t", "seq"], 10**10, rows=640)
    assert first.exceptAll(again).isEmpty() and first.select("__ck").distinct().count() > 20
    spark.sparkContext.setJobGroup("building", "no job")
    prefix.with_chunks(df, ["k"], ["t", "seq"], 10**10)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "")


def test_an_asof_join_crosses_the_chunks_of_a_burst(spark, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNK_ROWS", 640)
    df = burst(spark, 8000).groupBy("k", "t").agg(F.max("seq").alias("seq"))
    right = df.where("seq % 40 = 0").select("k", F.col("t").alias("rt"), F.col("seq").alias("rseq"))
    whole = asof_join(df, right, ["k"], "t", "rt", ["rseq"])
    parts = asof_join(df, right, ["k"], "t", "rt", ["rseq"], chunk=10**10)
    assert whole.exceptAll(parts).isEmpty() and parts.count() == whole.count()


@pytest.mark.parametrize("chunk", [None, 5])
def test_a_forward_asof_join_scans_forward_frames_once(spark, chunk):
    """a frame to the end of the partition costs rows squared; only running frames are used, either way."""
    a = spark.range(20).select(F.lit(1).alias("k"), "id", F.col("id").alias("t"))
    b = spark.range(0, 20, 7).select(F.lit(1).alias("k"), F.col("id").alias("u"), F.col("id").alias("v"))
    out = asof_join(a, b, ["k"], "t", "u", ["v"], "forward", chunk=chunk)
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    assert {r.id: r.v for r in out.collect()} == {i: next((u for u in (0, 7, 14) if u >= i), None) for i in range(20)}
