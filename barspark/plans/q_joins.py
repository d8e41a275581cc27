"""Joins: equi, as-of, offset, grid, prefix sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions.scalars import div
from barspark.operators import asof as A
from barspark.operators.dyadic import grid_sums
from barspark.operators.universe import breadth, lagged_breadth, with_trading_day
from barspark.plans import market as M
from barspark.plans.registry import query

DAY = M.DAY_US


CHUNK = 3 * DAY


@query("D1_equi_join_ticker_date", "trip_id:i volume:i next_close:f4",
       """SELECT trip_id, d.volume, x.close AS next_close FROM trips JOIN daily d ON d.ticker = trips.ticker AND d.date = entry_date
          LEFT JOIN daily x ON x.ticker = trips.ticker AND x.date = exit_date""")
def equi(spark, sf):
    t, d = M.trips(spark, sf), M.daily(spark, sf)
    t = t.join(d.select("ticker", F.col("date").alias("entry_date"), "volume"), ["ticker", "entry_date"])
    return t.join(d.select("ticker", F.col("date").alias("exit_date"), F.col("close").alias("next_close")),
                  ["ticker", "exit_date"], "left")


@query("D2_asof_forward_strict", "ticker:i date execution_date split_ratio:f",
       """SELECT d.ticker, d.date, s.execution_date, s.split_ratio FROM daily d ASOF LEFT JOIN spl s
          ON d.ticker = s.ticker AND d.date < s.execution_date""")
def asof_forward(spark, sf):
    s = M.splits(spark, sf).withColumn("xd", F.col("execution_date"))
    return A.asof_join(M.daily(spark, sf), s, ["ticker"], "date", "xd", ["execution_date", "split_ratio"], "forward", True)


@query("D3_asof_backward_inclusive", "ticker:i date known_date value:f",
       """SELECT d.ticker, d.date, f.known_date, f.value FROM daily d ASOF LEFT JOIN flo f
          ON d.ticker = f.ticker AND d.date >= f.known_date""")
def asof_backward(spark, sf):
    f = M.floats(spark, sf).withColumn("kd", F.col("known_date"))
    return A.asof_join(M.daily(spark, sf), f, ["ticker"], "date", "kd", ["known_date", "value"])


@query("D4_asof_backward_strict_hot_key", "seq:i prev_seq:i prev_price:f",
       """SELECT a.seq, b.seq AS prev_seq, b.price AS prev_price FROM (SELECT * FROM tape WHERE sign = 1) a
          ASOF LEFT JOIN (SELECT * FROM tape WHERE sign = -1) b ON a.ts > b.ts""")
def asof_strict(spark, sf):
    """The latest sell strictly before each buy, over the whole market: one key, split over time chunks."""
    t = M.tape(spark, sf).withColumn("k", F.lit(1))
    buys = t.filter("sign = 1").select("k", "seq", "ts")
    sells = t.filter("sign = -1").select("k", F.col("ts").alias("bt"), F.col("seq").alias("prev_seq"), F.col("price").alias("prev_price"))
    return A.asof_join(buys, sells, ["k"], "ts", "bt", ["prev_seq", "prev_price"], "backward", True, CHUNK)


@query("D4_asof_forward_inclusive_chunked", "seq:i next_seq:i",
       """SELECT a.seq, b.seq AS next_seq FROM (SELECT * FROM tape WHERE sign = 1) a
          ASOF LEFT JOIN (SELECT * FROM tape WHERE sign = -1) b ON a.ts <= b.ts""")
def asof_fwd_inc(spark, sf):
    t = M.tape(spark, sf).withColumn("k", F.lit(1))
    sells = t.filter("sign = -1").select("k", F.col("ts").alias("bt"), F.col("seq").alias("next_seq"))
    return A.asof_join(t.filter("sign = 1").select("k", "seq", "ts"), sells, ["k"], "ts", "bt", ["next_seq"], "forward", False, CHUNK)


@query("D5_lateral_top1", "ticker:i as_of prev_date prev_close:f4",
       """SELECT s.ticker, s.as_of, p.date AS prev_date, p.close AS prev_close FROM shr s LEFT JOIN LATERAL (
          SELECT date, close FROM daily d WHERE d.ticker = s.ticker AND d.date < s.as_of ORDER BY date DESC LIMIT 1) p ON TRUE""")
def lateral(spark, sf):
    d = M.daily(spark, sf).select("ticker", F.col("date").alias("t"), F.col("date").alias("prev_date"), F.col("close").alias("prev_close"))
    return A.asof_join(M.shares(spark, sf), d, ["ticker"], "as_of", "t", ["prev_date", "prev_close"], "backward", True)


@query("D6_trading_day_offset", "ticker:i date dnum:i exit_open:f4",
       """WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS dnum FROM (SELECT DISTINCT date FROM daily)),
          px AS (SELECT d.*, dnum FROM daily d JOIN cal USING (date))
          SELECT a.ticker, a.date, a.dnum, b.open AS exit_open FROM px a LEFT JOIN px b ON b.ticker = a.ticker AND b.dnum = a.dnum + 5""")
def offset(spark, sf):
    px = with_trading_day(M.daily(spark, sf))
    fwd = px.select("ticker", (F.col("dnum") - 5).alias("dnum"), F.col("open").alias("exit_open"))
    return px.join(fwd, ["ticker", "dnum"], "left")


@query("D7_semi_join", "ticker:i date", "SELECT ticker, date FROM daily d WHERE EXISTS (SELECT 1 FROM divs x WHERE x.ticker = d.ticker AND x.ex_dividend_date = d.date)")
def semi(spark, sf):
    x = M.dividends(spark, sf).select("ticker", F.col("ex_dividend_date").alias("date"))
    return M.daily(spark, sf).join(x, ["ticker", "date"], "left_semi")


@query("D8_values_grid", "threshold:f n:i mean_ret:f",
       """SELECT threshold, count(*) AS n, avg(ret) AS mean_ret FROM trips
          JOIN (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.4), (0.8)) g(threshold) ON pct_up >= threshold GROUP BY 1""")
def grid(spark, sf):
    """Rows against a constant grid: a row is exploded to the thresholds it meets, no join needed."""
    ts = [0.05, 0.1, 0.2, 0.4, 0.8]
    met = F.filter(F.array(*[F.lit(x) for x in ts]), lambda g: F.col("pct_up") >= g)
    t = M.trips(spark, sf).select("ret", F.explode(met).alias("threshold"))
    return t.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))


LOOK = 5 * DAY


# day bars in whole cents, and per trade those that begin in [ts - LOOK, ts)
WINDOW_SQL = f"""WITH bars AS (
        SELECT ticker, ts // {DAY} AS i, sum(size)::BIGINT AS v, sum(c * size)::BIGINT AS pv, sum(CASE WHEN sign > 0 THEN c * size ELSE 0 END)::BIGINT AS b,
          sum(CASE WHEN sign < 0 THEN c * size ELSE 0 END)::BIGINT AS s, sum(c * c * size)::HUGEINT AS ppv
        FROM (SELECT *, CAST(round(price * 100) AS BIGINT) AS c FROM tape) GROUP BY 1, 2),
      asked AS (SELECT seq, ticker, unnest(range((ts - {LOOK} + {DAY - 1}) // {DAY}, (ts + {DAY - 1}) // {DAY})) AS i FROM tape)
      SELECT seq, coalesce(sum(v), 0)::BIGINT AS v, sum(pv)::BIGINT AS pv, coalesce(sum(b), 0)::BIGINT AS b, coalesce(sum(s), 0)::BIGINT AS s, sum(ppv)::HUGEINT AS ppv
      FROM asked LEFT JOIN bars USING (ticker, i) GROUP BY seq"""


def day_window(spark, sf, cols):
    """Each trade with exact sums over the day bars that begin in the LOOK before it."""
    t = M.tape(spark, sf).withColumn("c", F.round(F.col("price") * 100).cast("long"))
    c, q, wide = F.col("c"), F.col("size"), "decimal(38,0)"
    side = lambda k: F.when(F.col("sign") == k, c * q).otherwise(0)
    sums = {"v": F.sum(q), "pv": F.sum(c * q), "b": F.sum(side(1)), "s": F.sum(side(-1)), "ppv": F.sum((c * c * q).cast("decimal(28,0)")).cast(wide)}
    bars = t.groupBy("ticker", F.expr(f"ts div {DAY}").alias("i")).agg(*[sums[k].alias(k) for k in cols])
    asked = t.select("seq", "ticker", F.expr(f"(ts - {LOOK} + {DAY - 1}) div {DAY}").alias("lo"), F.expr(f"(ts + {DAY - 1}) div {DAY}").alias("hi"))
    return grid_sums(bars, asked, ["ticker"], "i", cols, "lo", "hi", LOOK // DAY + 1)


@query("D9_windowed_sums_from_prefix", "seq:i volume:f imbalance:f",
       f"SELECT seq, v AS volume, (b - s)::DOUBLE / nullif(b + s, 0) AS imbalance FROM ({WINDOW_SQL})")
def windowed_sums(spark, sf):
    x = day_window(spark, sf, ["v", "b", "s"])
    b, s = (F.coalesce(F.col(k), F.lit(0)) for k in "bs")
    return x.withColumns({"volume": F.coalesce(F.col("v"), F.lit(0)), "imbalance": div(b - s, b + s)})


@query("F25_vwma_and_z_reference", "seq:i ref_price:f4 ref_var:f2",
       f"""SELECT seq, CASE WHEN v > 0 THEN pv::DOUBLE / (v * 100.0::DOUBLE) END AS ref_price,
           CASE WHEN v > 1 THEN (v * ppv - pv::HUGEINT * pv)::DOUBLE / (v * (v - 1) * 10000.0::DOUBLE) END AS ref_var FROM ({WINDOW_SQL})""")
def vwma_reference(spark, sf):
    """Volume-weighted mean and variance of the price in the window; the moments are whole numbers, so nothing cancels."""
    x = day_window(spark, sf, ["v", "pv", "ppv"])
    n, pv = F.col("v"), F.col("pv")
    spread = n.cast("decimal(18,0)") * F.col("ppv").cast("decimal(20,0)") - pv.cast("decimal(19,0)") * pv.cast("decimal(19,0)")
    return x.withColumns({"ref_price": F.when(n > 0, pv / (n * 100.0)),
                          "ref_var": F.when(n > 1, spread.cast("double") / (n * (n - 1) * 10000.0))})


@query("D10_index_context_dense_grid", "seq:i hour:i idx_price:f",
       """WITH ix AS (SELECT ts // 3600000000 AS hour, arg_max(price, ROW(ts, seq)) AS price FROM tape GROUP BY 1),
          g AS (SELECT unnest(range((SELECT min(hour) FROM ix), (SELECT max(hour) + 1 FROM ix))) AS hour),
          ff AS (SELECT g.hour, last_value(price IGNORE NULLS) OVER (ORDER BY g.hour) AS price FROM g LEFT JOIN ix ON ix.hour = g.hour)
          SELECT seq, t.ts // 3600000000 AS hour, ff.price AS idx_price FROM tape t LEFT JOIN ff ON ff.hour = t.ts // 3600000000""")
def index_context(spark, sf):
    """An index proxy on an hourly grid, forward-filled, joined to every trade by hour. The grid is one row per hour of
    the calendar, so it is joined as it is and the join strategy is left to the planner."""
    t = M.tape(spark, sf).withColumn("hour", F.floor(F.col("ts") / 3_600_000_000))
    ix = t.groupBy("hour").agg(F.max_by("price", F.struct("ts", "seq")).alias("idx_price"))
    g = A.forward_fill_on_grid(ix.withColumn("k", F.lit(1)), ["k"], "hour", ["idx_price"], 1)
    return t.join(g.select("hour", "idx_price"), "hour", "left")


@query("D11_funding_forward_fill", "ticker:i hour:i rate:f",
       """WITH f AS (SELECT ticker, ts // 3600000000 AS hour, arg_max(price, ROW(ts, seq)) / 1e4 AS rate FROM tape GROUP BY 1, 2),
          b AS (SELECT ticker, min(hour) AS a, max(hour) AS z FROM f GROUP BY 1),
          g AS (SELECT ticker, unnest(range(a, z + 1)) AS hour FROM b)
          SELECT g.ticker, g.hour, f.rate FROM g ASOF LEFT JOIN f ON f.ticker = g.ticker AND g.hour >= f.hour""")
def funding(spark, sf):
    t = M.tape(spark, sf).withColumn("hour", F.floor(F.col("ts") / 3_600_000_000))
    f = t.groupBy("ticker", "hour").agg((F.max_by("price", F.struct("ts", "seq")) / 1e4).alias("rate"))
    return A.forward_fill_on_grid(f, ["ticker"], "hour", ["rate"], 1)


BREADTH_SQL = """SELECT date, count(*) AS n, avg(CASE WHEN close > ma THEN 1.0 ELSE 0.0 END) AS pct_above FROM (
    SELECT *, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING) AS ma,
      avg(close * volume) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS adv,
      row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM daily) WHERE rn >= 20 AND adv >= 700 GROUP BY 1"""


@query("D12_lagged_market_series", "trip_id:i lag1:f ret:f",
       f"""SELECT trip_id, lag1, ret FROM trips LEFT JOIN (SELECT date, lag(pct_above) OVER (ORDER BY date) AS lag1
           FROM ({BREADTH_SQL})) b ON b.date = entry_date""")
def lagged(spark, sf):
    b = lagged_breadth(breadth(M.daily(spark, sf), 700.0)).select(F.col("date").alias("entry_date"), "lag1")
    return M.trips(spark, sf).join(b, "entry_date", "left")


@query("D13_delete_using", "ticker:i n:i",
       "SELECT ticker, count(*) AS n FROM daily WHERE ticker NOT IN (SELECT ticker FROM refs WHERE type = 'ETF') GROUP BY 1")
def delete_using(spark, sf):
    etf = M.reference(spark, sf).filter("type = 'ETF'")
    d = M.daily(spark, sf).join(etf, "ticker", "left_anti")
    return d.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
