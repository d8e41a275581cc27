"""Size distributions: exact over value ranges, and as mergeable sketches."""

import random

from pyspark.sql import functions as F

from barspark.operators import prefix
from barspark.operators import strata as S


def test_sketches_merge_in_any_order_within_the_bound(spark):
    """Days of very different sizes, heavy ties and a long tail; merged at once, in two levels and in reverse."""
    x = F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100_000.0
    rows = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.floor(F.sqrt("id") / 20).alias("day"), F.when(F.col("id") % 5 == 0, 100.0).otherwise(F.round(F.exp(x * 9), 1)).alias("v"))
    probs = {f"p{p}": p / 100 for p in (1, 10, 50, 90, 99)}
    daily = S.size_sketches(rows, ["g", "day"], "v")
    at_once = S.merged_sketches(daily, ["g"], probs)
    weekly = S.merged_sketches(daily.withColumn("week", F.floor(F.col("day") / 5)), ["g", "week"], {}).select("g", "week", "sketch")
    levels = S.merged_sketches(weekly, ["g"], probs)
    turned = S.merged_sketches(daily.repartition(3, "day").sortWithinPartitions(F.desc("day")), ["g"], probs)
    values = {g: sorted(r.v for r in rows.where(F.col("g") == g).collect()) for g in (0, 1)}
    for out in (at_once, levels, turned):
        for r in out.collect():
            vs = values[r.g]
            assert r.n == len(vs)
            for c, p in probs.items():
                below, upto = (sum(v < r[c] for v in vs) / len(vs), sum(v <= r[c] for v in vs) / len(vs))
                assert below - S.RANK_ERROR <= p <= upto + S.RANK_ERROR
    assert max(len(r.sketch) for r in at_once.collect()) < 40_000


def test_exact_sizes_over_ranges(spark, monkeypatch):
    """Many distinct sizes of one group in ranges of fifty, beside a group of one size."""
    monkeypatch.setattr(prefix, "RANGE_ROWS", 50)
    rng = random.Random(1)
    rows = [("hot", rng.randrange(5000)) for _ in range(4000)] + [("one", 7)] * 3 + [("hot", None)]
    r = {x.k: x for x in S.size_cdf(spark.createDataFrame(rows, "k string, size long"), ["k"], "size", [0.1, 0.5, 0.99]).collect()}
    vs = sorted(v for k, v in rows if k == "hot" and v is not None)
    at = lambda p: next(v for i, v in enumerate(vs, 1) if i >= p * len(vs))
    mid = at(0.5)
    under, over = [v for v in vs if v < mid], [v for v in vs if v >= mid]
    assert r["hot"].n == 4000 and list(r["hot"].q) == [at(0.1), mid, at(0.99)]
    assert abs(r["hot"].mean_under - sum(under) / len(under)) < 1e-9 and abs(r["hot"].mean_from - sum(over) / len(over)) < 1e-9
    assert (r["one"].n, list(r["one"].q), r["one"].mean_under, r["one"].mean_from) == (3, [7, 7, 7], None, 7.0)
