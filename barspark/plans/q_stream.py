"""Structured Streaming queries: each runs to the end of the available input and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.plans import market as M
from barspark.plans.registry import query
from barspark.session import scratch_path, stored
from barspark.streaming import bars as B
from barspark.streaming import compaction as Z

HOUR = 3_600_000_000


def event_stream(spark, sf):
    """The events table as a file-source stream in tape shape."""
    schema = M.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(
        F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"))


@query("L1_streaming_time_bars", "ticker:i start_us:i open:f high:f low:f close:f volume:i trade_count:i",
       f"""SELECT ticker, start_us, arg_min(price, ROW(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, ROW(ts, seq)) AS close,
           sum(size) AS volume, count(*) AS trade_count FROM (SELECT *, ts // {HOUR} * {HOUR} AS start_us FROM tape)
           WHERE start_us + {HOUR} <= (SELECT max(ts) // 1000 * 1000 - 600000000 FROM tape) GROUP BY 1, 2""")
def streaming_bars(spark, sf):
    """Hourly bars; those still open at the final watermark (latest trade less ten minutes) are not emitted yet."""
    out = scratch_path(spark)
    B.run_available(B.streaming_bars(event_stream(spark, sf), "1 hour"), out, scratch_path(spark))
    return spark.read.parquet(out).withColumn("start_us", F.unix_micros("start"))


@query("L2_streaming_session_state", "ticker:i session:i minute:i ema:f vs_vwap:f sess_high:f4 sess_low:f4 run_below:i reclaim:i",
       """SELECT *, close / vwap - 1 AS vs_vwap, greatest(high, coalesce(sess_hi_p, 0)) AS sess_high, sess_lo AS sess_low, run_len AS run_below,
          CAST(coalesce(ema_p <= vwap_p AND ema > vwap AND run_len_p >= 3, false) AS INT) AS reclaim FROM runs""")
def streaming_session(spark, sf):
    """Session state over a stream of bars that come out of order in four micro-batches, each a run over one checkpoint: a bar is up to forty days late. A
    last bar of no session, far ahead, moves the watermark past all others. The state store is set for this stream only."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, ck = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    s = M.sessions(spark, sf).select("ticker", "session", F.col("date").cast("timestamp").alias("ts"), "high", "low", "close", F.col("volume").cast("double").alias("volume"))
    s = stored(s)
    first, last = s.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    came = F.unix_micros("ts") + F.pmod(F.xxhash64("ticker", "ts"), F.lit(40)) * M.DAY_US
    step = (last - first) // 4 + 20 * M.DAY_US
    try:
        for k in range(4):
            batch = s.where((came >= first + k * step) & (came < first + (k + 1) * step))
            if k == 3:
                batch = batch.unionByName(s.limit(1).select(F.lit(-1).cast("long").alias("ticker"), F.lit(0).cast("long").alias("session"),
                                                           F.timestamp_micros(F.lit(last + 400 * M.DAY_US)).alias("ts"), "high", "low", "close", "volume"))
            batch.write.mode("append").parquet(src)
            stream = spark.readStream.schema(s.schema).parquet(src)
            st = B.session_stream(stream, ["ticker", "session"], min_run=3, ttl_hours=24 * 400, lateness="50 days")
            B.run_available(st, out, ck)
    finally:
        spark.conf.set(store, before)
    r = spark.read.parquet(out).where("ticker >= 0")
    return r.withColumns({"minute": F.lit(569) + F.dayofyear("ts"), "vs_vwap": F.col("close") / F.col("vwap") - 1,
                          "reclaim": F.col("reclaim").cast("int")})


@query("L3_incremental_day_partitions", "date n:i volume:i", "SELECT date, count(*) AS n, sum(size) AS volume FROM tape GROUP BY 1")
def incremental(spark, sf):
    """Every day's trades come in two files and two runs over one checkpoint; a third run finds nothing and changes nothing. The parts
    of each run are merged into one file a day."""
    src, out, ck = scratch_path(spark), scratch_path(spark), scratch_path(spark)
    tape = M.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("size"))
    kind = tape.schema
    merge = [F.sum("n").alias("n"), F.sum("volume").alias("volume")]

    def build(x):
        return x.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))

    for part in ("seq % 2 = 0", "seq % 2 = 1", None):
        if part:
            tape.where(part).write.mode("append").parquet(src)
        B.run_available_days(spark.readStream.schema(kind).parquet(src), out, ck, build)
        Z.compact(spark, out, ["date"], merge)
    return Z.merged_days(spark, out, ["date"], merge)
