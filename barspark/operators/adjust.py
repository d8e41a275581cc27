"""Corporate-action adjustment of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.asof import asof_join

MIN_DIVIDEND_FACTOR = 1e-6


def _product_from_here(by: str, date: str, c: Column) -> Column:
    """Product of c over this and all later rows of the key (one row per corporate action)."""
    w = Window.partitionBy(by).orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    return F.exp(F.sum(F.ln(c)).over(w))


def split_factors(splits: DataFrame) -> DataFrame:
    """ticker, execution_date, factor of this and every later split."""
    f = _product_from_here("ticker", "execution_date", F.col("split_ratio"))
    return splits.select("ticker", "execution_date", f.alias("cum_split_factor"))


def _with_split_factor(df: DataFrame, factors: DataFrame, date: str, out: str) -> DataFrame:
    """Factor of the splits strictly after ``date``; 1 when there is none."""
    r = factors.select("ticker", F.col("execution_date").alias("__xd"), F.col("cum_split_factor").alias(out))
    j = asof_join(df, r, ["ticker"], date, "__xd", [out], "forward", strict=True)
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(1.0)))


def adjusted_dividends(dividends: DataFrame, factors: DataFrame) -> DataFrame:
    """Cash amounts in today's shares."""
    d = _with_split_factor(dividends, factors, "ex_dividend_date", "split_adj_factor")
    return d.withColumn("adj_cash_amount", F.col("cash_amount") / F.col("split_adj_factor"))


def dividend_factors(dividends: DataFrame, prices: DataFrame, factors: DataFrame) -> DataFrame:
    """1 - amount / close on the ex-date, floored; 1 without a price. With the product over this and later dates."""
    d = adjusted_dividends(dividends, factors)
    px = prices.select("ticker", F.col("date").alias("ex_dividend_date"), F.col("close").alias("__close"))
    j = d.join(px, ["ticker", "ex_dividend_date"], "left")
    adj_close = F.col("__close") / F.col("split_adj_factor")
    yield_ = F.col("adj_cash_amount") / F.nullif(adj_close, F.lit(0.0))
    factor = F.when(F.col("__close").isNull(), F.lit(1.0)).otherwise(
        F.greatest(F.lit(1.0) - yield_, F.lit(MIN_DIVIDEND_FACTOR))
    )
    j = j.withColumn("div_factor", factor)
    cum = _product_from_here("ticker", "ex_dividend_date", F.col("div_factor"))
    return j.select("ticker", "ex_dividend_date", "adj_cash_amount", "div_factor", cum.alias("cum_div_factor"))


def adjust_prices(prices: DataFrame, splits: DataFrame, dividends: DataFrame) -> DataFrame:
    """Total-return back-adjusted OHLC, split-adjusted volume and the raw volume."""
    factors = split_factors(splits)
    divs = dividend_factors(dividends, prices, factors)
    p = _with_split_factor(prices, factors, "date", "split_adj_factor")
    r = divs.select("ticker", F.col("ex_dividend_date").alias("__xd"), "cum_div_factor")
    p = asof_join(p, r, ["ticker"], "date", "__xd", ["cum_div_factor"], "forward", strict=True)
    scale = F.coalesce(F.col("cum_div_factor"), F.lit(1.0))
    adj = [(F.col(c) / F.col("split_adj_factor") * scale).alias(f"adj_{c}") for c in ("open", "high", "low", "close")]
    vol = F.round(F.col("volume") * F.col("split_adj_factor")).cast("long").alias("adj_volume")
    return p.select("ticker", "date", *adj, vol, F.col("volume").alias("raw_volume"))
