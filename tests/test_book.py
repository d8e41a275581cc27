import math
import random

import pytest
from pyspark.sql import functions as F

from barspark.operators import book as K


@pytest.mark.parametrize("carried", [True, False])
def test_keys_without_a_seed_or_with_an_empty_one_keep_their_updates(spark, carried):
    side = lambda s: [f"{s}_0_price double", f"{s}_0_size double"]
    snaps = spark.createDataFrame([("full", 105, 10.0, 3.0, 11.0, 1.0), ("empty", 105, None, None, 11.0, 0.0)], ", ".join(["s string", "ts long", *side("bid"), *side("ask")]))
    rows = [(k, ts, i, True, 9.0, size) for k in ("full", "empty", "none") for i, (ts, size) in enumerate([(103, 8.0), (107, 5.0), (118, 0.0)])]
    deltas = spark.createDataFrame(rows, "s string, ts long, seq long, side_is_bid boolean, price double, size double")
    starts = snaps.select("s", "ts") if carried else None
    got = {}
    for r in K.delta_imbalance(deltas, ["s"], 10, 2, 0.0, K.seed_levels(snaps, ["s"], 1), starts=starts).collect():
        got.setdefault(r.s, []).append((r.sample, r.obi, r.bid_levels, r.ask_levels))
    # the updates at 103 are before the snapshots, which are at 105; without one the points count from 100
    want = {"full": [(115, 7 / 9, 2, 1), (125, 0.5, 1, 1)], "none": [(110, 1.0, 1, 0), (120, 0.0, 0, 0)]}
    want["empty"] = [(115, 1.0, 1, 0), (125, 0.0, 0, 0)] if carried else want["none"]
    assert {k: sorted(v) for k, v in got.items()} == {k: [(a, pytest.approx(b), c, d) for a, b, c, d in v] for k, v in want.items()}


def replay(updates, cadence, depth, decay):
    """Point by point over the live book."""
    book, out, i = {True: {}, False: {}}, [], 0
    t0 = updates[0][0] // cadence * cadence
    for k in range(1, (updates[-1][0] - t0) // cadence + 2):
        while i < len(updates) and updates[i][0] < t0 + k * cadence:
            _, bid, price, size = updates[i]
            book[bid][price] = size
            i += 1
        live = {s: sorted(((p, q) for p, q in book[s].items() if q > 0), reverse=s) for s in book}
        b, a = (sum(q * math.exp(-decay * n) for n, (_, q) in enumerate(live[s][:depth])) for s in (True, False))
        out.append((t0 + k * cadence, pytest.approx((b - a) / (b + a) if b + a > 0 else 0.0), len(live[True]), len(live[False])))
    return out


def test_points_of_many_frames_are_a_replay(spark):
    """Levels that outlive several frames, quiet frames, more levels than the depth; rows grow with points, not with levels."""
    rng = random.Random(2)
    times = sorted(rng.sample(range(1000), 250)) + [5000, 5003, 9990]
    updates = [(t, bid, float(rng.randrange(1, 15) + (0 if bid else 20)), float(rng.choice([0, 0, 1, 4, 9]))) for t in times for bid in [rng.random() < 0.5]]
    df = spark.createDataFrame([("s", t, i, *u) for i, (t, *u) in enumerate(updates)], "s string, ts long, seq long, side_is_bid boolean, price double, size double")
    out = K.delta_imbalance(df, ["s"], 10, 3, 0.4)
    assert [tuple(r)[1:] for r in out.orderBy("sample").collect()] == replay(updates, 10, 3, 0.4)
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "side_is_bid, -price" not in p and p.count("Window") <= 2  # the one window orders a level's own updates


def test_a_contested_stretch_is_walked_in_batches():
    """a stretch was one Arrow table and Python lists of it; the walk gives each batch out before it reads the next."""
    import random

    import pyarrow as pa
    from barspark.operators.capacity import walk

    r = random.Random(5)
    rows = sorted((s, g, a, i, a + r.randrange(0, 9), float(r.randrange(1, 9)), 20.0 - a % 3) for i, (s, g, a) in
                  enumerate((r.choice("xy"), r.randrange(3), r.randrange(40)) for _ in range(900)))
    names = ["scenario", "segment", "a", "trip_id", "z", "size", "cap"]
    read = []

    def batches(size):
        for k in range(0, len(rows), size):
            read.append(k)
            yield pa.RecordBatch.from_pydict({n: [x[j] for x in rows[k:k + size]] for j, n in enumerate(names)})

    want = []
    for s, g in sorted({x[:2] for x in rows}):
        held = []
        for _, _, a, i, z, n, cap in [x for x in rows if x[:2] == (s, g)]:
            held = [h for h in held if h[0] > a]
            ok = sum(h[1] for h in held) + n <= cap
            held += [(z, n)] * ok
            want.append((s, i, ok))
    for size in (7, 64, 900):
        read.clear()
        got = []
        for out in walk(batches(size)):
            assert len(read) * size - len(got) <= size
            got += list(zip(*(c.to_pylist() for c in out.columns)))
        assert got == want
    assert 0 < sum(x[2] for x in want) < len(want)
