"""The driver tables in market roles: tape, daily bars, sessions, corporate actions, reference, trips.

Only here are table names of the test data known; the operators take DataFrames.

* tape: ``events`` - ticker = user, price = value, size = props.k, condition codes by event type.
* daily bars: ``lineitem`` by supplier and ship date.
* sessions: a supplier's year; the "minute" is 570 + day of year - 1, so a session has up to 366 bars from 09:30 on.
* splits, dividends, floats, shares: ``orders`` of customers whose key is a supplier's, by priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.functions.features import daily_features
from barspark.functions.indicators import Series
from barspark.functions.scalars import rnd
from barspark.operators.detect import Breakout
from barspark.operators.trips import pnl, time_exit
from barspark.operators.universe import with_episodes
from barspark.sources.warehouse import kept

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tape(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    codes = lambda *c: F.array(*[F.lit(x) for x in c]).cast("array<int>")
    t = F.col("event_type")
    cond = (F.when(t == "click", codes(12)).when(t == "error", codes(32)).when(t == "purchase", codes(8, 32))
            .when(t == "signup", codes(17)))
    us = F.unix_micros(F.col("ts").cast("timestamp"))  # zone-less times are UTC (session zone UTC)
    delay = F.when(F.col("event_id") % 50 == 0, -us).otherwise((F.col("event_id") % 100) * 1000)
    return e.select(
        F.col("user_id").alias("ticker"), us.alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"),
        k.alias("size"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("sign"), cond.alias("conditions"),
        F.when(F.col("event_id") % 7 == 0, 201).otherwise(0).cast("long").alias("trf_id"),
        us.alias("participant_ts"), (us + delay).alias("sip_ts"), F.to_date("ts").alias("date"),
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    p = F.lit(20.0) + F.col("l_extendedprice") / F.col("l_quantity") / F.lit(1000.0)
    hi, lo = F.lit(1.0) + F.col("l_tax") / F.lit(2.0), F.lit(1.0) - F.col("l_discount") / F.lit(2.0)
    up = F.col("l_linestatus") == "F"
    # one long orders the lines of a bar (a primitive key keeps min_by in hash aggregation)
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2_097_152 + F.col("l_partkey") % 2_097_152
    return li.select(
        F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), key.alias("k"), "l_quantity",
        rnd(F.when(up, p * lo).otherwise(p * hi), 4).alias("o"), rnd(F.when(up, p * hi).otherwise(p * lo), 4).alias("c"),
        rnd(p * (F.lit(1.0) + F.col("l_tax")), 4).alias("h"), rnd(p * (F.lit(1.0) - F.col("l_discount")), 4).alias("l"),
    )


def _bars(lines: DataFrame, *by: str) -> DataFrame:
    return lines.groupBy(*by).agg(
        F.min_by("o", "k").alias("open"), F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("c", "k").alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"), F.count(F.lit(1)).alias("transactions"),
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return _bars(_lines(spark, sf), "ticker", "date")


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return with_episodes(daily(spark, sf))


#: Lines whose bars a partition of sessions is to hold: with all features a bar has some sixty columns in each sort and window.
SESSION_ROWS = 250_000


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of the lines dealt by session to as many partitions as the table asks for (its footers are read for that): a task
    gathers and sorts a bounded number of bars however large the table is, whatever sizes of shuffled bytes are merged. The
    lines are dealt as they are: a line is nearly a bar, so that combining them before would hold a whole split's bars for nothing."""
    parts = max(-(-table(spark, sf, "lineitem").count() // SESSION_ROWS), spark.sparkContext.defaultParallelism)
    dealt = _lines(spark, sf).withColumn("session", F.year("date").cast("long")).repartition(parts, "ticker", "session")
    d = _bars(dealt, "ticker", "session", "date").withColumn("minute", (F.lit(569) + F.dayofyear("date")).cast("long"))
    return d.select("ticker", "date", "open", "high", "low", "close", "volume", "transactions", "session", "minute")


def session_context(s: DataFrame) -> DataFrame:
    """Last close of the previous session and of three sessions back, and the previous session's volume per bar."""
    per = s.groupBy("ticker", "session").agg(F.max_by("close", "minute").alias("c"), F.avg("volume").alias("v"))
    w = Window.partitionBy("ticker").orderBy("session")
    ctx = per.select("ticker", "session", F.lag("c").over(w).alias("close_1d"), F.lag("c", 3).over(w).alias("close_3d"),
                     F.lag("v").over(w).alias("permin"))
    return s.join(ctx, ["ticker", "session"])


def _actions(spark: SparkSession, sf: str, priority: str) -> DataFrame:
    """Orders of one priority as (ticker, date, key, amount), one per ticker and date."""
    o = table(spark, sf, "orders").filter(F.col("o_orderpriority") == priority)
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    return o.join(s, "o_custkey", "left_semi").groupBy(
        F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date")
    ).agg(F.max("o_orderkey").alias("key"), F.max_by("o_totalprice", "o_orderkey").alias("amount"))


def splits(spark: SparkSession, sf: str) -> DataFrame:
    a = _actions(spark, sf, "1-URGENT")
    ratio = F.when(F.col("key") % 4 == 0, F.lit(1.0) / F.lit(3.0)).otherwise((F.col("key") % 3 * 2 + 3).cast("double"))
    return a.select("ticker", F.col("date").alias("execution_date"), ratio.alias("split_ratio"))


def dividends(spark: SparkSession, sf: str) -> DataFrame:
    a = _actions(spark, sf, "2-HIGH")
    return a.select("ticker", F.col("date").alias("ex_dividend_date"), (F.col("amount") / F.lit(1e6)).alias("cash_amount"))


def floats(spark: SparkSession, sf: str) -> DataFrame:
    a = _actions(spark, sf, "3-MEDIUM")
    return a.select("ticker", F.date_add("date", 40).alias("known_date"), F.col("date").alias("period_end"),
                    (F.col("amount") * 1000.0).alias("value"))


def shares(spark: SparkSession, sf: str) -> DataFrame:
    a = _actions(spark, sf, "5-LOW")
    return a.select("ticker", F.col("date").alias("as_of"), (F.col("key") + 1000).cast("double").alias("shares"))


def reference(spark: SparkSession, sf: str) -> DataFrame:
    """Instrument types by region; region 1 has two rows per ticker."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    kinds = [["CS"], ["CS", "ADRC"], ["ADRC"], ["ETF"], ["WARRANT"]]  # by region key
    types = F.array(*[F.array(*[F.lit(t) for t in k]) for k in kinds])
    return s.join(n, "s_nationkey").select(
        F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.explode(F.get(types, F.col("n_regionkey"))).alias("type"))


# A looser rule than the production defaults: the test prices jump between unrelated parts.
LOOSE = Breakout(up=0.05, up_max=3.0, rvol_min=0.8, prior_bars=21, min_dollar=100.0, near_high=0.1, min_price=1.0,
                 max_tight=50.0, max_atr=5.0, min_intraday=-0.2, min_max_atr=0.01)
HOLD = 5


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """Loose daily breakouts held for five bars: the population of the stratification queries, which share one table of them."""
    return kept(spark, ("trips", sf), lambda: _trips(spark, sf), ["ticker"], ["entry_date"])


def _trips(spark: SparkSession, sf: str) -> DataFrame:
    s = Series(("ticker", "episode"), ("date",))
    x = daily_features(episodes(spark, sf)).withColumns(time_exit(s, HOLD))
    x = x.filter(LOOSE.fires())
    x = x.withColumns({
        "trip_id": F.col("ticker") * 100_000 + F.unix_date("date"), "entry_date": F.col("date"),
        "entry_price": F.col("close"),
    })
    keep = ["trip_id", "ticker", "entry_date", "entry_price", "exit_date", "exit_price", "exit_reason", "open_trip", "rvol",
            "pct_up", "atr_log", "tight_log", "max_atr", "d52_close", "intraday_ret", "avg_dol", "ret", "qty", "net_pnl"]
    return pnl(x).select(*keep)
