"""Order book."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barspark.operators import book as K
from barspark.operators.prefix import time_chunk
from barspark.plans import market as M
from barspark.plans.registry import query

DEPTH = 5
DAY = M.DAY_US


def snapshots(spark, sf):
    """Five levels a side around each trade; every tenth size is missing, every 97th book is crossed."""
    t = M.tape(spark, sf).select("ticker", "ts", "seq", "price")
    cols = {}
    for i in range(DEPTH):
        q = lambda k: F.when((F.col("seq") + k) % 10 != 0, ((F.col("seq") * 7 + k * 13) % 97).cast("double"))
        shift = F.when(F.col("seq") % 97 == 0, -0.05).otherwise(0.0)
        cols |= {f"bid_{i}_price": F.col("price") - 0.01 * (i + 1), f"bid_{i}_size": q(i),
                 f"ask_{i}_price": F.col("price") + 0.01 * (i + 1) + shift, f"ask_{i}_size": q(i + 5)}
    return t.withColumns(cols)


def _size(k: int) -> str:
    return f"coalesce(CASE WHEN (seq + {k}) % 10 <> 0 THEN (seq * 7 + {k * 13}) % 97 END, 0)"


def _side(k0: int, lam: float) -> str:
    return " + ".join(f"{_size(k0 + i)} * exp(-{lam} * {i})" for i in range(DEPTH))


def _obi(lam: float) -> str:
    b, a = _side(0, lam), _side(5, lam)
    return f"CASE WHEN ({b}) + ({a}) > 0 THEN (({b}) - ({a})) / (({b}) + ({a})) ELSE 0 END"


@query("J1_snapshot_imbalance", "seq:i obi:f", f"SELECT seq, {_obi(0.5)} AS obi FROM tape")
def snapshot_imbalance(spark, sf):
    return K.snapshot_imbalance(snapshots(spark, sf), DEPTH, 0.5)


CAD = DAY // 8
DEL = """SELECT ticker % 5 AS symbol, ts, seq, seq % 2 = 0 AS is_bid, CASE WHEN seq % 2 = 0 THEN floor(price) % 20 ELSE 20 + floor(price) % 20 END AS px,
    CASE WHEN size < 20 THEN 0 ELSE size END AS sz FROM tape"""


def _points_sql(first: str, seeds: str) -> str:
    """Every point of the cadence: of each level the last size before it, then levels ranked by price."""
    return f"""WITH d0 AS ({DEL}), z AS ({first}), d AS (SELECT d0.*, t0 FROM d0 JOIN z USING (symbol) WHERE ts >= t0),
           s AS (SELECT symbol, t0 + unnest(range(1, kmax + 1)) * {CAD} AS sample FROM (SELECT symbol, any_value(t0) AS t0, max((ts - t0) // {CAD} + 1) AS kmax FROM d GROUP BY 1)),
           u AS (SELECT symbol, is_bid, px, sz, ts, CAST(seq AS BIGINT) AS o FROM d {seeds}),
           g AS (SELECT s.symbol, s.sample, l.is_bid, l.px FROM s JOIN (SELECT DISTINCT symbol, is_bid, px FROM u) l USING (symbol)),
           st AS (SELECT g.*, arg_max(u.sz, ROW(u.ts, u.o)) AS sz FROM g JOIN u ON u.symbol = g.symbol AND u.is_bid = g.is_bid AND u.px = g.px AND u.ts < g.sample GROUP BY ALL),
           r AS (SELECT *, row_number() OVER (PARTITION BY symbol, sample, is_bid ORDER BY CASE WHEN is_bid THEN -px ELSE px END) - 1 AS k FROM st WHERE sz > 0),
           w AS (SELECT symbol, sample, coalesce(sum(sz * exp(-0.3 * k)) FILTER (is_bid AND k < 4), 0) AS b, coalesce(sum(sz * exp(-0.3 * k)) FILTER (NOT is_bid AND k < 4), 0) AS a,
             count(*) FILTER (is_bid) AS bid_levels, count(*) FILTER (NOT is_bid) AS ask_levels FROM r GROUP BY 1, 2)
           SELECT s.symbol, s.sample, CASE WHEN b + a > 0 THEN (b - a) / (b + a) ELSE 0 END AS obi, coalesce(bid_levels, 0) AS bid_levels,
             coalesce(ask_levels, 0) AS ask_levels FROM s LEFT JOIN w USING (symbol, sample)"""


def book_deltas(spark, sf):
    bid = F.col("seq") % 2 == 0
    p = F.floor("price") % 20
    return M.tape(spark, sf).select(
        (F.col("ticker") % 5).alias("symbol"), "ts", "seq", bid.alias("side_is_bid"), F.when(bid, p).otherwise(p + 20).cast("double").alias("price"),
        F.when(F.col("size") < 20, 0).otherwise(F.col("size")).alias("size"))


J2 = "symbol:i sample:i obi:f bid_levels:i ask_levels:i"


@query("J2_imbalance_from_deltas", J2, _points_sql(f"SELECT symbol, min(ts) // {CAD} * {CAD} AS t0 FROM d0 GROUP BY 1", ""))
def delta_imbalance(spark, sf):
    return K.delta_imbalance(book_deltas(spark, sf), ["symbol"], CAD, 4, 0.3)


@query("J2_imbalance_from_a_seed_snapshot", J2, _points_sql(
    "SELECT ticker AS symbol, ts AS t0 FROM tape WHERE ticker < 5 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) = 2",
    f"""UNION ALL SELECT q.ticker, b.is_bid, CASE WHEN b.is_bid THEN q.price - 0.01 * (b.i + 1) ELSE q.price + 0.01 * (b.i + 1) + CASE WHEN seq % 97 = 0 THEN -0.05 ELSE 0 END END,
        CASE WHEN (q.seq + b.i + CASE WHEN b.is_bid THEN 0 ELSE 5 END) % 10 <> 0 THEN (q.seq * 7 + (b.i + CASE WHEN b.is_bid THEN 0 ELSE 5 END) * 13) % 97 ELSE 0 END, q.ts, CAST(-1 AS BIGINT)
        FROM (SELECT * FROM tape WHERE ticker < 5 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) = 2) q, (SELECT unnest(range({DEPTH})) AS i, unnest([true, true, true, true, true]) AS is_bid
        UNION ALL SELECT unnest(range({DEPTH})), false) b"""))
def seeded_imbalance(spark, sf):
    """A symbol's book starts from the snapshot at the second trade of the ticker of the same number."""
    w = Window.partitionBy("ticker").orderBy("ts", "seq")
    first = snapshots(spark, sf).filter("ticker < 5").withColumn("k", F.row_number().over(w)).filter("k = 2").withColumnRenamed("ticker", "symbol")
    return K.delta_imbalance(book_deltas(spark, sf), ["symbol"], CAD, 4, 0.3, K.seed_levels(first, ["symbol"], DEPTH), starts=first.select("symbol", "ts"))


ACT = """CASE WHEN event_id % 11 < 4 THEN 'A' WHEN event_id % 11 < 6 THEN 'C' WHEN event_id % 11 < 8 THEN 'M' WHEN event_id % 11 = 8 THEN 'F'
    WHEN event_id % 11 = 9 THEN 'T' WHEN event_id % 110 = 10 THEN 'R' ELSE 'F' END"""
SIDE = "CASE WHEN event_id % 13 = 0 THEN 'N' WHEN (event_id // 11) % 2 = 0 THEN 'B' ELSE 'A' END"
MBO = f"""SELECT user_id % 3 AS venue, user_id AS order_id, epoch_us(ts) AS ts, event_id AS seq, {ACT} AS action, {SIDE} AS side,
    CAST(floor(value) AS BIGINT) % 50 AS price, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS size FROM events"""


CHUNK = 5 * DAY


def order_events(spark, sf):
    e = M.tape(spark, sf)
    m = F.col("seq") % 11
    act = (F.when(m < 4, "A").when(m < 6, "C").when(m < 8, "M").when(m == 8, "F").when(m == 9, "T")
           .when(F.col("seq") % 110 == 10, "R").otherwise("F"))
    side = F.when(F.col("seq") % 13 == 0, "N").when(F.floor(F.col("seq") / 11) % 2 == 0, "B").otherwise("A")
    return e.select((F.col("ticker") % 3).alias("venue"), F.col("ticker").alias("order_id"), "ts", "seq", act.alias("action"),
                    side.alias("side"), (F.floor("price") % 50).alias("price"), "size")


# the per-order replay as a recursive CTE; a venue's clears are events of all of its orders
REPLAY = f"""RECURSIVE m AS ({MBO}),
  ev AS (SELECT *, row_number() OVER (PARTITION BY venue, order_id ORDER BY ts, seq) AS i FROM (
      SELECT venue, order_id, ts, seq, action, side, price, size FROM m WHERE action IN ('A', 'C', 'M', 'F')
      UNION ALL SELECT r.venue, o.order_id, r.ts, r.seq, 'R', 'N', 0, 0 FROM m r JOIN (SELECT DISTINCT venue, order_id FROM m) o ON o.venue = r.venue WHERE r.action = 'R')),
  st AS (SELECT venue, order_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS sd, CAST(NULL AS BIGINT) AS px, CAST(NULL AS BIGINT) AS sz,
      CAST(NULL AS BIGINT) AS d1, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS BIGINT) AS p1, CAST(NULL AS BIGINT) AS d2, CAST(NULL AS VARCHAR) AS s2,
      CAST(NULL AS BIGINT) AS p2, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS BIGINT) AS seq FROM (SELECT DISTINCT venue, order_id FROM ev)
    UNION ALL
    SELECT e.venue, e.order_id, e.i,
      CASE WHEN set_ THEN e.side WHEN gone THEN NULL ELSE sd END, CASE WHEN set_ THEN e.price WHEN gone THEN NULL ELSE px END,
      CASE WHEN set_ THEN e.size WHEN gone THEN NULL WHEN cut THEN sz - e.size ELSE sz END,
      CASE WHEN gone AND sz IS NOT NULL THEN -sz WHEN cut THEN -e.size END, sd, px, CASE WHEN set_ THEN e.size END, e.side, e.price, e.ts, e.seq
    FROM (SELECT e.*, st.sd, st.px, st.sz, e.action IN ('A', 'M') AND e.side IN ('B', 'A') AS set_,
        e.action IN ('M', 'R') OR (e.action IN ('C', 'F') AND st.sz IS NOT NULL AND (e.size >= st.sz OR (e.action = 'C' AND e.size = 0))) AS gone,
        e.action IN ('C', 'F') AND st.sz IS NOT NULL AND NOT (e.size >= st.sz OR (e.action = 'C' AND e.size = 0)) AS cut
      FROM st JOIN ev e ON e.venue = st.venue AND e.order_id = st.order_id AND e.i = st.i + 1) e),
  moves AS (SELECT venue, ts, seq, s1 AS side, p1 AS price, d1 AS delta FROM st WHERE d1 IS NOT NULL
    UNION ALL SELECT venue, ts, seq, s2, p2, d2 FROM st WHERE d2 IS NOT NULL)"""


@query("J3_order_events_to_level_deltas", "venue:i ts:i seq:i side price:i delta:i", f"SELECT * FROM (WITH {REPLAY} SELECT * FROM moves)")
def level_deltas(spark, sf):
    e = order_events(spark, sf)
    return K.order_events_to_deltas(e, ["venue"], CHUNK)


@query("J3_trade_prints_with_aggressor", "seq:i aggressor price:i size:i",
       f"""SELECT * FROM (WITH {REPLAY} SELECT m.seq, CASE coalesce(s1, m.side) WHEN 'B' THEN 'A' WHEN 'A' THEN 'B' END AS aggressor, coalesce(p1, m.price) AS price, m.size
           FROM m LEFT JOIN st ON m.action = 'F' AND st.venue = m.venue AND st.order_id = m.order_id AND st.ts = m.ts AND st.seq = m.seq WHERE m.action IN ('T', 'F'))""")
def prints(spark, sf):
    e = order_events(spark, sf)
    return K.trade_prints(e, ["venue"], CHUNK)


@query("J4_consolidated_levels", "bucket:i side price:i size:i",
       f"""SELECT * FROM (WITH {REPLAY}, b AS (SELECT ts // {DAY} * {DAY} AS bucket, side, price, sum(delta) AS d FROM moves GROUP BY 1, 2, 3)
           SELECT bucket, side, price, sum(d) OVER (PARTITION BY side, price ORDER BY bucket) AS size FROM b WHERE d <> 0)""")
def consolidated(spark, sf):
    e = order_events(spark, sf)
    d = K.order_events_to_deltas(e, ["venue"], CHUNK)
    return K.consolidated_levels(d, [], DAY, time_chunk(F.col("bucket"), 10 * DAY))


def _sum_sql(k0: int, d: int) -> str:
    return " + ".join(_size(k0 + i) for i in range(d))


OBI_D = (1, 5)
J5_OUT = [f"obi{d}_{p}" for d in OBI_D for p in ("p05", "p50", "p95")]
P_SQL = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("J5_book_quality_checks", "ticker:i n:i crossed:i locked:i misordered:i spread_p50:f spread_p95:f cadence_p50:f cadence_p95:f cadence_p99:f cadence_max:f "
       + " ".join(f"{c}:f" for c in [*J5_OUT, *(f"{s}{d}_mean" for d in OBI_D for s in ("bid", "ask"))]),
       f"""WITH y AS (SELECT ticker, ts, seq, (price + 0.01 + CASE WHEN seq % 97 = 0 THEN -0.05 ELSE 0 END) - (price - 0.01) AS spread,
             ts - lag(ts) OVER (PARTITION BY ticker, ts // {DAY} ORDER BY ts) AS cadence, {", ".join(f"{_sum_sql(0, d)} AS b{d}, {_sum_sql(5, d)} AS a{d}" for d in OBI_D)} FROM tape),
           x AS (SELECT *, {", ".join(f"(b{d} - a{d}) / nullif(b{d} + a{d}, 0) AS obi{d}" for d in OBI_D)} FROM y)
           SELECT ticker, count(*) AS n, count(*) FILTER (spread < 0) AS crossed, count(*) FILTER (spread = 0) AS locked, 0 AS misordered, max(cadence) AS cadence_max,
             quantile_cont(spread, 0.5) AS spread_p50, quantile_cont(spread, 0.95) AS spread_p95, quantile_cont(cadence, 0.5) AS cadence_p50,
             quantile_cont(cadence, 0.95) AS cadence_p95, quantile_cont(cadence, 0.99) AS cadence_p99,
             {", ".join(f"quantile_cont(obi{d}, {P_SQL[p]}) AS obi{d}_{p}" for d in OBI_D for p in ("p05", "p50", "p95"))},
             {", ".join(f"avg({s[0]}{d}) FILTER (b{d} + a{d} > 0) AS {s}{d}_mean" for d in OBI_D for s in ("bid", "ask"))} FROM x GROUP BY 1""")
def quality(spark, sf):
    return K.book_checks(snapshots(spark, sf), ["ticker"], DEPTH)
