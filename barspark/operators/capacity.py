"""Acceptance of trips into a book of limited capital."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.strata import daily_level


def walk(batches):
    """Accept or skip trips, sorted by scenario, segment, entry day and trip, that come in any batches."""
    import heapq

    import pyarrow as pa

    at, deployed, open_ = None, 0.0, []
    for t in batches:
        ok = []
        for *segment, a, z, n, cap in zip(*(t[c].to_pylist() for c in ("scenario", "segment", "a", "z", "size", "cap"))):
            if segment != at:
                at, deployed, open_ = segment, 0.0, []
            while open_ and open_[0][0] <= a:
                deployed -= heapq.heappop(open_)[1]
            fits = deployed + n <= cap
            if fits:
                deployed += n
                heapq.heappush(open_, (z, n))
            ok.append(fits)
        yield pa.RecordBatch.from_arrays([t["scenario"], t["trip_id"], pa.array(ok, pa.bool_())], ["scenario", "trip_id", "accepted"])


def capacity_book(trips: DataFrame, scenarios: dict[str, float], size: str = "notional") -> DataFrame:
    """Accept trips in entry order while deployed capital fits each scenario's book; skip what does not fit.

    Acceptance depends on earlier decisions only while the book is contested. On a day on which all candidate trips
    together fit, every entry is accepted; those trips are settled by a daily sweep. The other days fall into segments
    no contested trip spans, and only a segment is walked in order, next to the settled trips' daily load.
    """
    sc = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(float(v)).alias("book")) for k, v in scenarios.items()])
    x = trips.withColumn("__sc", F.explode(sc)).select("*", "__sc.*").drop("__sc").withColumn("size", F.col(size).cast("double"))
    by = ["scenario"]
    demand = daily_level(x, by, "entry_date", "exit_date", "size").select(*by, F.col("day").alias("entry_date"), "level")
    x = x.join(demand, [*by, "entry_date"]).withColumn("contested", F.col("level") > F.col("book"))
    settled, rest = x.filter(~F.col("contested")), x.filter(F.col("contested"))
    load = daily_level(settled, by, "entry_date", "exit_date", "size").select(
        *by, F.col("day").alias("entry_date"), F.col("level").alias("load"))
    days = rest.groupBy(*by, "entry_date").agg(F.max("exit_date").alias("reach"))
    w = Window.partitionBy(*by).orderBy("entry_date").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.max("reach").over(w) > F.col("entry_date"), 0).otherwise(1)
    seg = days.withColumn("__n", new).withColumn(
        "segment", F.sum("__n").over(Window.partitionBy(*by).orderBy("entry_date"))).select(*by, "entry_date", "segment")
    rest = rest.join(seg, [*by, "entry_date"]).join(load, [*by, "entry_date"], "left")
    src = rest.select(*by, "segment", F.unix_date("entry_date").alias("a"), F.unix_date("exit_date").alias("z"), "trip_id",
                      "size", (F.col("book") - F.coalesce("load", F.lit(0.0))).alias("cap"))

    ids = dict(trips.dtypes)["trip_id"]
    # a segment's trips lie in one partition, in entry order; they are walked batch by batch, and only open positions are kept
    dealt = src.repartition(*by, "segment").sortWithinPartitions(*by, "segment", "a", "trip_id")
    walked = dealt.mapInArrow(walk, f"scenario string, trip_id {ids}, accepted boolean")
    sure = settled.select("scenario", "trip_id", F.lit(True).alias("accepted"))
    return sure.unionByName(walked)
