"""Trade filtering and bar construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions.scalars import eastern_minute, session_anchor_ns
from barspark.operators import bars as B
from barspark.operators.prefix import running, with_chunks
from barspark.plans import market as M
from barspark.plans.registry import query

DAY = M.DAY_US
SIX_H = DAY // 4
CHUNK = 3 * DAY  # tape rows of a key are split over chunks of at most three days, and fewer where they are dense


def chunked(spark, sf):
    """The tape with chunk ids of each ticker."""
    return with_chunks(M.tape(spark, sf), ["ticker"], ["ts", "seq"], CHUNK)


LIT = """size > 0 AND trf_id = 0 AND (list_has_any(coalesce(conditions, []), [17, 25, 19, 8])
         OR NOT list_has_any(coalesce(conditions, []), [2, 7, 10, 13, 20, 21, 22, 29, 32, 52, 53]))"""


@query("C1_lit_trades", "seq:i ticker:i price:f size:i", f"SELECT seq, ticker, price, size FROM tape WHERE {LIT}")
def lit_trades(spark, sf):
    return B.lit_trades(M.tape(spark, sf))


@query("C2_latency_filter_and_fallback", "seq:i eff_ts:i",
       """SELECT seq, CASE WHEN sip_ts = 0 THEN participant_ts ELSE sip_ts END AS eff_ts FROM tape
          WHERE sip_ts = 0 OR participant_ts = 0 OR sip_ts - participant_ts <= 50000""")
def latency(spark, sf):
    return B.prompt_trades(M.tape(spark, sf), 50_000).withColumn("eff_ts", B.effective_time())


@query("C3_session_anchor", "date anchor_s:i",
       """SELECT DISTINCT date, epoch(timezone('America/New_York', CAST(date AS TIMESTAMP) + INTERVAL 4 HOUR)) AS anchor_s
          FROM daily""")
def session_anchor(spark, sf):
    d = M.daily(spark, sf).select("date").distinct()
    return d.withColumn("anchor_s", session_anchor_ns(F.col("date")) / 1_000_000_000)


@query("C4_eastern_minute", "seq:i et_min:i",
       """SELECT seq, date_part('hour', t) * 60 + date_part('minute', t) AS et_min
          FROM (SELECT seq, timezone('America/New_York', make_timestamptz(ts)) AS t FROM tape)""")
def et_minute(spark, sf):
    return M.tape(spark, sf).withColumn("et_min", eastern_minute(F.col("ts") * 1000))


BARS = "ticker:i bucket:i open:f high:f low:f close:f volume:i dollar_volume:f4 vwap:f vwstd:f5 trade_count:i"


def bars_sql(where: str, bucket: str) -> str:
    return f"""SELECT ticker, bucket, arg_min(price, ROW(ts, seq)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, ROW(ts, seq)) AS close, sum(size) AS volume, sum(price * size) AS dollar_volume,
        sum(price * size) / nullif(sum(size), 0) AS vwap,
        sqrt(greatest(sum(price * price * size) / nullif(sum(size), 0)
             - (sum(price * size) / nullif(sum(size), 0)) ** 2, 0)) AS vwstd, count(*) AS trade_count
        FROM (SELECT *, {bucket} AS bucket FROM tape WHERE {where}) GROUP BY 1, 2"""


@query("C5_time_bars", BARS.replace(" vwstd:f5", ""), bars_sql(LIT, f"ts // {SIX_H}"))
def time_bars(spark, sf):
    return B.time_bars(B.lit_trades(M.tape(spark, sf)), ["ticker"], SIX_H)


@query("C5_minute_bars_of_session", "ticker:i date bucket:i open:f close:f volume:i n:i",
       f"""SELECT ticker, date, bucket, arg_min(price, ROW(ts, seq)) AS open, arg_max(price, ROW(ts, seq)) AS close,
           sum(size) AS volume, count(*) AS n FROM (SELECT *,
             (ts - epoch_us(timezone('America/New_York', CAST(date AS TIMESTAMP) + INTERVAL 4 HOUR))) // 60000000 AS bucket
             FROM tape WHERE {LIT}
             AND ts >= epoch_us(timezone('America/New_York', CAST(date AS TIMESTAMP) + INTERVAL 4 HOUR)))
           WHERE bucket BETWEEN 0 AND 959 GROUP BY ALL""")
def minute_bars(spark, sf):
    """One-minute bars from 04:00 Eastern: buckets 0 to 959 of each ticker-day."""
    anchor = session_anchor_ns(F.col("date")) / 1000
    t = B.lit_trades(M.tape(spark, sf)).withColumn("__a", anchor.cast("long"))
    b = B.time_bars(t, ["ticker", "date"], 60_000_000, anchor=F.col("__a"), first=0, last=959)
    return b.withColumnRenamed("trade_count", "n")


@query("C5_rounded_bars", "ticker:i bucket:i open:f close:f volume:i trade_count:i",
       f"""SELECT ticker, bucket, arg_min(price, ROW(ts, seq)) AS open, arg_max(price, ROW(ts, seq)) AS close,
           sum(size) AS volume, count(*) AS trade_count
           FROM (SELECT *, (ts + {SIX_H // 2}) // {SIX_H} AS bucket FROM tape) GROUP BY 1, 2""")
def rounded_bars(spark, sf):
    return B.time_bars(M.tape(spark, sf), ["ticker"], SIX_H, mode="round")


HALF = "(dayofmonth(date) % 10 = 3)"


@query("C6_session_bars_early_close", "ticker:i date bucket:i volume:i trade_count:i",
       f"""SELECT ticker, date, bucket, sum(size) AS volume, count(*) AS trade_count FROM (
             SELECT *, (ts % {DAY}) // 3600000000 AS bucket FROM tape)
           WHERE bucket < CASE WHEN {HALF} THEN 17 ELSE 20 END GROUP BY ALL""")
def early_close(spark, sf):
    """Hourly counts; every tenth day is a half day that ends three hours early."""
    t = M.tape(spark, sf)
    half = t.select("date").distinct().filter(F.dayofmonth("date") % 10 == 3)
    return B.session_bars(t, ["ticker", "date"], 3_600_000_000, 20, 17, half, anchor=F.col("ts") - F.pmod(F.col("ts"), F.lit(DAY)))


@query("C7_cumulative_columns", "ticker:i date bucket:i cum_volume:i cum_trade_count:i",
       f"""SELECT ticker, date, bucket, sum(v) OVER w AS cum_volume, sum(n) OVER w AS cum_trade_count FROM (
             SELECT ticker, date, (ts % {DAY}) // 3600000000 AS bucket, sum(size) AS v, count(*) AS n FROM tape GROUP BY ALL)
           WINDOW w AS (PARTITION BY ticker, date ORDER BY bucket)""")
def cumulative(spark, sf):
    b = B.count_bars(M.tape(spark, sf), ["ticker", "date"], 3_600_000_000, anchor=F.col("ts") - F.pmod(F.col("ts"), F.lit(DAY)))
    return B.cumulative(b, ["ticker", "date"], "bucket", ["volume", "trade_count"])


@query("C7_cumulative_on_tape_chunked", "seq:i cum_size:i cum_max:f n:i",
       """SELECT seq, sum(size) OVER w AS cum_size, max(price) OVER w AS cum_max, count(*) OVER w AS n FROM tape
          WINDOW w AS (PARTITION BY sign ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)""")
def cumulative_tape(spark, sf):
    """Running totals over a third and two thirds of the whole tape: two hot keys, split over time chunks."""
    t = with_chunks(M.tape(spark, sf), ["sign"], ["ts", "seq"], DAY)
    return running(t, ["sign"], ["ts", "seq"], "__ck", {
        "cum_size": ("sum", F.col("size")), "cum_max": ("max", F.col("price")), "n": ("count", F.col("seq"))})


@query("C8_order_flow_bars", "ticker:i start:i end:i close:f buy_dollar_volume:f4 sell_dollar_volume:f4",
       f"""SELECT ticker, bucket * {DAY} AS start, (bucket + 1) * {DAY} AS "end", arg_max(price, ROW(ts, seq)) AS close,
           sum(CASE WHEN sign > 0 THEN price * size ELSE 0 END) AS buy_dollar_volume,
           sum(CASE WHEN sign < 0 THEN price * size ELSE 0 END) AS sell_dollar_volume
           FROM (SELECT *, ts // {DAY} AS bucket FROM tape) GROUP BY ticker, bucket""")
def order_flow(spark, sf):
    return B.order_flow_bars(M.tape(spark, sf), ["ticker"], DAY)


@query("C9_two_pass_bars", "ticker:i bucket:i volume:i vwap:f vwstd:f trade_count:i",
       f"""WITH t AS (SELECT *, ts // {DAY} AS bucket FROM tape WHERE size > 0),
           m AS (SELECT ticker, bucket, sum(size) AS volume, sum(CAST(round(price * 100) AS BIGINT) * size)::DOUBLE / 100.0::DOUBLE / sum(size)::DOUBLE AS vwap, count(*) AS n FROM t GROUP BY 1, 2)
           SELECT ticker, bucket, any_value(volume) AS volume, any_value(vwap) AS vwap, any_value(n) AS trade_count,
             sqrt(sum(size * (price - vwap) ** 2) / any_value(volume)) AS vwstd FROM t JOIN m USING (ticker, bucket) GROUP BY 1, 2""")
def two_pass(spark, sf):
    return B.moment_bars(M.tape(spark, sf).filter("size > 0"), ["ticker"], DAY)


QB = "ticker:i bar:i open:f high:f low:f close:f volume:f trade_count:i start_ts:i end_ts:i"


def quantity_sql(q: str, v: float, keep: str = "true") -> str:
    return f"""SELECT ticker, bar, arg_min(price, ROW(ts, seq)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, ROW(ts, seq)) AS close, sum(f) AS volume, sum(CASE WHEN bar = k0 THEN 1 ELSE 0 END) AS trade_count,
        min(ts) AS start_ts, max(ts) AS end_ts FROM (
          SELECT *, least(c1, (bar + 1) * {v}) - greatest(c0, bar * {v}) AS f FROM (
            SELECT *, CAST(floor(c0 / {v}) AS BIGINT) AS k0, unnest(range(CAST(floor(c0 / {v}) AS BIGINT),
                   CAST(ceil(c1 / {v}) AS BIGINT))) AS bar FROM (
              SELECT *, c1 - q AS c0 FROM (SELECT *, sum(q) OVER (PARTITION BY ticker ORDER BY ts, seq) AS c1
                FROM (SELECT *, CAST({q} AS DOUBLE) AS q FROM tape) WHERE q > 0))))
        WHERE f > 0 GROUP BY 1, 2 HAVING {keep}"""


@query("C10_volume_bars", QB, quantity_sql("size", 250.0))
def volume_bars(spark, sf):
    return B.quantity_bars(chunked(spark, sf), ["ticker"], 250.0, F.col("size"), F.col("__ck"))


@query("C10_volume_bars_full_only", QB, quantity_sql("size", 250.0, "sum(f) >= 250.0 * (1 - 1e-9)"))
def volume_bars_full(spark, sf):
    return B.quantity_bars(chunked(spark, sf), ["ticker"], 250.0, F.col("size"), F.col("__ck"), keep_partial=False)


CENTS = "round(price * 100) * size"


@query("C11_dollar_bars", QB, quantity_sql(CENTS, 2000000.0))
def dollar_bars(spark, sf):
    """Constant-dollar bars; dollars are whole cents, so the running total is exact."""
    q = F.round(F.col("price") * 100) * F.col("size")
    return B.quantity_bars(chunked(spark, sf), ["ticker"], 2_000_000.0, q, F.col("__ck"))


# the loop form of imbalance bars as a recursive CTE: one step per (trade, split)
IMB_SQL = """WITH RECURSIVE t AS (
    SELECT ticker, price, CAST(size AS DOUBLE) AS q, sign, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS i,
      ts FROM tape WHERE size > 0),
  r AS (
    SELECT ticker, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS theta, CAST(0 AS BIGINT) AS bar, 0.0::DOUBLE AS rest,
      0.0::DOUBLE AS used, CAST(0 AS BIGINT) AS fbar, 0.0::DOUBLE AS px, 0 AS sg, CAST(0 AS BIGINT) AS ts
      FROM (SELECT DISTINCT ticker FROM t)
    UNION ALL
    SELECT ticker, i,
      CASE WHEN abs(theta + sg * left_q) < @T THEN theta + sg * left_q ELSE 0.0 END,
      CASE WHEN abs(theta + sg * left_q) < @T THEN bar ELSE bar + 1 END,
      CASE WHEN abs(theta + sg * left_q) < @T THEN 0.0 ELSE left_q - (@T - sg * theta) END,
      CASE WHEN abs(theta + sg * left_q) < @T THEN left_q ELSE @T - sg * theta END, bar, px, sg, ts
    FROM (SELECT r.ticker, CASE WHEN r.rest > 0 THEN r.i ELSE n.i END AS i, r.theta, r.bar,
            CASE WHEN r.rest > 0 THEN r.rest ELSE n.q END AS left_q, CASE WHEN r.rest > 0 THEN r.px ELSE n.price END AS px,
            CASE WHEN r.rest > 0 THEN r.sg ELSE n.sign END AS sg, CASE WHEN r.rest > 0 THEN r.ts ELSE n.ts END AS ts
          FROM r LEFT JOIN t n ON n.ticker = r.ticker AND n.i = r.i + 1 AND r.rest <= 0)
    WHERE i IS NOT NULL)
  """.replace("@T", "150.0")
IMB_SQL = f"""SELECT * FROM ({IMB_SQL} SELECT ticker, fbar AS bar, arg_min(px, i) AS open, max(px) AS high, min(px) AS low,
    arg_max(px, i) AS close, sum(used) AS quantity, sum(CASE WHEN sg > 0 THEN used ELSE 0 END) AS buy,
    sum(CASE WHEN sg < 0 THEN used ELSE 0 END) AS sell, min(ts) AS start_ts, max(ts) AS end_ts
    FROM r WHERE used > 0 GROUP BY 1, 2)"""


@query("C12_imbalance_bars", "ticker:i bar:i open:f high:f low:f close:f quantity:f buy:f sell:f start_ts:i end_ts:i", IMB_SQL)
def imbalance_bars(spark, sf):
    return B.imbalance_bars(chunked(spark, sf), ["ticker"], 150.0, F.col("size"), F.col("sign"), F.col("__ck"))


# trade by trade at every rung: a bar closes whenever the sum is a whole threshold away from the level of the last close
RUNGS = """WITH RECURSIVE t AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS i, sum(size * sign) OVER (PARTITION BY ticker ORDER BY ts, seq) AS s
    FROM tape WHERE size > 0),
  b AS (SELECT ticker, greatest(1, pow(2, round(log2(greatest(sum(size) / 12.0, 1))))) AS th FROM tape WHERE size > 0 GROUP BY 1),
  g AS (SELECT ticker, th / pow(2, k) AS c FROM b, (SELECT unnest(range(0, 64)) AS k) WHERE th / pow(2, k) >= 1),
  w AS (SELECT ticker, c, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS m, CAST(0 AS DOUBLE) AS z FROM g
    UNION ALL
    SELECT ticker, c, i, nk, n + abs(nk - k), abs(nk - k), z FROM (
      SELECT w.ticker, w.c, t.i, w.k, w.n, t.s / w.c AS z, CAST(CASE WHEN t.s / w.c >= w.k + 1 THEN floor(t.s / w.c) WHEN t.s / w.c <= w.k - 1 THEN ceil(t.s / w.c) ELSE w.k END AS BIGINT) AS nk
      FROM w JOIN t ON t.ticker = w.ticker AND t.i = w.i + 1)),
  e AS (SELECT ticker, c, n + CASE WHEN m = 0 OR z <> k THEN 1 ELSE 0 END AS n_bars FROM w QUALIFY row_number() OVER (PARTITION BY ticker, c ORDER BY i DESC) = 1)
  SELECT ticker, coalesce(max(c) FILTER (n_bars >= 12), min(c)) AS threshold, coalesce(arg_max(n_bars, c) FILTER (n_bars >= 12), arg_min(n_bars, c)) AS n_bars FROM e GROUP BY 1"""


@query("C13_imbalance_threshold_search", "ticker:i threshold:f n_bars:i", RUNGS)
def imbalance_threshold(spark, sf):
    return B.imbalance_thresholds(chunked(spark, sf), ["ticker"], 12, F.col("size"), F.col("sign"), F.col("__ck"))


W14 = 6 * 3_600_000_000


@query("C14_merge_bursts", "ticker:i anchor:i size:i vwap:f first_price:f last_price:f trade_count:i end_ts:i",
       f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS i FROM tape WHERE size > 0),
           a AS (SELECT ticker, i, ts AS anchor, ts FROM t WHERE i = 1
             UNION ALL SELECT t.ticker, t.i, CASE WHEN t.ts - a.anchor < {W14} THEN a.anchor ELSE t.ts END, t.ts
             FROM a JOIN t ON t.ticker = a.ticker AND t.i = a.i + 1)
           SELECT ticker, anchor, sum(size) AS size, sum(price * size) / sum(size) AS vwap, arg_min(price, i) AS first_price,
             arg_max(price, i) AS last_price, count(*) AS trade_count, max(t.ts) AS end_ts
           FROM a JOIN t USING (ticker, i) GROUP BY 1, 2""")
def merge_bursts(spark, sf):
    """Bursts at a six-hour window, the tape being sparse; production uses 100 microseconds."""
    return B.merge_bursts(M.tape(spark, sf).filter("size > 0"), ["ticker"], W14, CHUNK)


HOURS_SQL = """SELECT ticker, date, min(ts) FILTER (list_has_any(coalesce(conditions, []), [17, 25])) AS open_ts,
    min(ts) FILTER (list_has_any(coalesce(conditions, []), [19, 8])) AS close_ts FROM tape GROUP BY 1, 2
    HAVING open_ts IS NOT NULL AND close_ts IS NOT NULL"""


@query("C15_market_hours", "ticker:i date open_ts:i close_ts:i", HOURS_SQL)
def market_hours(spark, sf):
    return B.market_hours(M.tape(spark, sf), ["ticker", "date"])


@query("C15_split_sessions", "ticker:i date session n:i",
       f"""SELECT ticker, date, session, count(*) AS n FROM (SELECT *, CASE WHEN ts < open_ts THEN 'pre' WHEN ts < close_ts
           THEN 'regular' ELSE 'post' END AS session FROM tape JOIN ({HOURS_SQL}) USING (ticker, date)) GROUP BY 1, 2, 3""")
def split_sessions(spark, sf):
    t = M.tape(spark, sf)
    s = B.split_sessions(t, B.market_hours(t, ["ticker", "date"]), ["ticker", "date"])
    return s.groupBy("ticker", "date", "session").agg(F.count(F.lit(1)).alias("n"))


@query("C16_bar_shape", "ticker:i bucket:i log_ret:f gap:i",
       f"""SELECT ticker, bucket, ln(vwap / lag(vwap) OVER w) AS log_ret, bucket - lag(bucket) OVER w AS gap
           FROM (SELECT ticker, ts // {DAY} AS bucket, sum(price * size) / sum(size) AS vwap FROM tape WHERE size > 0 GROUP BY 1, 2)
           WINDOW w AS (PARTITION BY ticker ORDER BY bucket)""")
def bar_shape(spark, sf):
    b = B.time_bars(M.tape(spark, sf).filter("size > 0"), ["ticker"], DAY)
    return B.bar_shape(b, ["ticker"], "bucket")


@query("C17_resample", "ticker:i bucket:i open:f4 high:f4 low:f4 close:f4 volume:i n_bars:i",
       """SELECT ticker, (date - DATE '1970-01-01') // 28 AS bucket, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
          arg_max(close, date) AS close, sum(volume) AS volume, count(*) AS n_bars FROM daily GROUP BY 1, 2""")
def resample(spark, sf):
    d = M.daily(spark, sf).withColumn("day", F.unix_date("date").cast("long"))
    return B.resample(d, ["ticker"], "day", 28)


@query("C18_partial_candle", "ticker:i session:i open:f4 high:f4 low:f4 close:f4 volume:i n_rth:i",
       """SELECT ticker, session, arg_min(open, minute) FILTER (minute >= 630) AS open, max(high) FILTER (minute >= 630) AS high,
          min(low) FILTER (minute >= 630) AS low, arg_max(close, minute) FILTER (minute >= 630) AS close, sum(volume) AS volume,
          count(*) FILTER (minute >= 630) AS n_rth FROM sess WHERE minute < 660 GROUP BY 1, 2""")
def partial_candle(spark, sf):
    return B.partial_candle(M.sessions(spark, sf), ["ticker", "session"], "minute", 660, rth_open=630)


@query("C19_premarket_summary", "ticker:i session:i premarket_volume:i rth_open:f4",
       """SELECT ticker, session, coalesce(sum(volume) FILTER (minute BETWEEN 570 AND 629), 0) AS premarket_volume,
          arg_min(open, minute) FILTER (minute BETWEEN 630 AND 899) AS rth_open FROM sess GROUP BY 1, 2""")
def premarket(spark, sf):
    return B.premarket_summary(M.sessions(spark, sf), ["ticker", "session"], "minute", 570, 630, 900)


CPS = list(range(600, 960, 30))


@query("C20_checkpoint_snapshots", "ticker:i session:i checkpoint:i cum_vol:i rth_vol:i hi_sofar:f4 lo_sofar:f4 n_bars:i px:f4",
       f"""WITH s AS (SELECT * FROM sess WHERE minute >= 570 AND minute < 960),
           liq AS (SELECT ticker, session FROM s WHERE minute >= 600 GROUP BY 1, 2 HAVING sum(close * volume) >= 30000)
           SELECT ticker, session, cp AS checkpoint, sum(volume) AS cum_vol,
             sum(CASE WHEN minute >= 600 THEN volume ELSE 0 END) AS rth_vol, max(high) AS hi_sofar, min(low) AS lo_sofar,
             count(*) AS n_bars, arg_max(close, minute) AS px
           FROM s JOIN liq USING (ticker, session) JOIN (SELECT unnest({CPS}) AS cp) ON minute <= cp GROUP BY 1, 2, 3""")
def checkpoints(spark, sf):
    return B.checkpoint_snapshots(M.sessions(spark, sf), ["ticker", "session"], "minute", CPS, 30_000.0, start=570, rth_open=600)


