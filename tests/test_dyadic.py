"""Windowed sums from aligned blocks."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barspark.operators.dyadic import grid_sums, trailing_sums, window_blocks
from barspark.operators.prefix import running, time_chunk


@pytest.fixture(scope="module")
def cut(spark):
    def blocks(pairs, longest):
        df = spark.createDataFrame(pairs, "a long, z long")
        return [[(b["__k"], b["__b"]) for b in r.p] for r in df.select(window_blocks(F.col("a"), F.col("z"), longest).alias("p")).collect()]

    return blocks


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-200, 200), st.integers(0, 100)), min_size=1, max_size=40))
def test_blocks_tile_the_window(cut, windows):
    pairs = [(a, a + n) for a, n in windows]
    longest = max(1, max(n for _, n in windows))
    for (a, z), blocks in zip(pairs, cut(pairs, longest)):
        assert sorted(i for k, b in blocks for i in range(b << k, (b + 1) << k)) == list(range(a, z))
        assert len(blocks) <= 2 * longest.bit_length()


def test_grid_sums_are_brute_force(spark):
    rng = random.Random(1)
    bars = [(k, i, rng.randint(-50, 50)) for k in range(3) for i in range(-40, 60) if rng.random() < 0.6]
    asks = [(q, rng.randrange(4), a, a + rng.randint(-2, 37)) for q in range(300) for a in [rng.randint(-60, 80)]]
    got = grid_sums(spark.createDataFrame(bars, "k long, i long, x long"), spark.createDataFrame(asks, "q long, k long, a long, z long"), ["k"], "i", ["x"], "a", "z", 37)
    for r in got.collect():
        inside = [x for k, i, x in bars if k == r.k and r.a <= i < r.z]
        assert r.x == (sum(inside) if inside else None)
    assert got.count() == 300


def test_error_does_not_grow_with_the_history(spark):
    """A million values of a million plus noise, windows of 200: no error beyond the window's own rounding, where differences of
    running totals err by a thousand times as much."""
    n, w = 1_000_000, 200
    x = 1e6 + (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007.0)
    bars = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), x.alias("x"))
    asks = spark.range(999, n, 9973).select(F.lit(1).alias("k"), (F.col("id") - w + 1).alias("a"), (F.col("id") + 1).alias("z"))
    got = {r.z: r.x for r in grid_sums(bars, asks, ["k"], "i", ["x"], "a", "z", w).collect()}
    need = bars.join(F.broadcast(asks), (F.col("i") >= F.col("a")) & (F.col("i") < F.col("z"))).groupBy("z").agg(F.collect_list("x").alias("xs"))
    exact = {r.z: math.fsum(r.xs) for r in need.collect()}
    worst = max(abs(got[z] - exact[z]) for z in exact)
    total = running(bars, ["k"], ["i"], time_chunk(F.col("i"), 10_000), {"c": ("sum", F.col("x"))}).where(F.col("i").isin([z - 1 for z in exact] + [z - 1 - w for z in exact]))
    c = {r.i: r.c for r in total.collect()}
    differences = max(abs(c[z - 1] - c[z - 1 - w] - exact[z]) for z in exact if z - 1 - w in c)
    assert len(exact) > 90 and worst < 4e-7 and differences > 20 * worst


@pytest.mark.parametrize("width", [1, 70, 5000])
def test_trailing_sums_are_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(k, t, rng.randint(-9, 9), rng.random()) for k in "ab" for t in sorted(rng.sample(range(-3000, 3000), 150))]
    got = trailing_sums(spark.createDataFrame(rows, "k string, t long, x long, y double"), ["k"], "t", ["x", "y"], width)
    assert got.columns == ["k", "t", "x", "y"] and got.count() == len(rows)
    for r in got.collect():
        inside = [(x, y) for k, t, x, y in rows if k == r.k and r.t - width < t <= r.t]
        assert r.x == sum(x for x, _ in inside) and r.y == pytest.approx(sum(y for _, y in inside), abs=1e-12)
