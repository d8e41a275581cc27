"""File readers: vendor CSV, JSON and day-partitioned parquet to the base tables' shapes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.scalars import ns_to_date
from barspark.sources import schemas
from barspark.sources.files import Files

DAY_IN_NAME = r"([0-9]{4}-[0-9]{2}-[0-9]{2})\.[a-z]+(?:\.[a-z]+)?$"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("quote", '"').option("escape", '"').option(
        "nanValue", "nan").csv(path)


def _date(c: str) -> Column:
    """ISO text to DATE; empty text is NULL."""
    return F.to_date(F.nullif(F.col(c), F.lit("")))


def daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily aggregates (gzip CSV glob); the epoch-nanosecond window start becomes the date."""
    d = _csv(spark, path, schemas.DAILY_CSV)
    return d.select("ticker", ns_to_date(F.col("window_start")).alias("date"), "open", "high", "low", "close", "volume",
                    "transactions")


def splits_csv(spark: SparkSession, path: str) -> DataFrame:
    d = _csv(spark, path, schemas.SPLITS_CSV)
    return d.select("ticker", _date("execution_date").alias("execution_date"), "split_from", "split_to",
                    (F.col("split_to") / F.col("split_from")).alias("split_ratio"))


def dividends_csv(spark: SparkSession, path: str) -> DataFrame:
    d = _csv(spark, path, schemas.DIVIDENDS_CSV)
    dates = {c: _date(c) for c in ("ex_dividend_date", "declaration_date", "pay_date")}
    return d.withColumns(dates).filter(F.col("ex_dividend_date").isNotNull())


def tickers_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.TICKERS_CSV)


def intraday_json(spark: SparkSession, path: str) -> DataFrame:
    """Bars nested in ``results``; entries without a time are dropped."""
    return flatten_intraday(spark.read.schema(schemas.INTRADAY_JSON).option("multiLine", "true").json(path))


def flatten_intraday(d: DataFrame) -> DataFrame:
    r = d.select("ticker", F.explode("results").alias("r")).filter(F.col("r.t").isNotNull())
    return r.select("ticker", F.timestamp_millis("r.t").alias("timestamp"), F.col("r.o").alias("open"),
                    F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"),
                    F.col("r.v").alias("volume"), F.col("r.vw").alias("vwap"), F.col("r.n").alias("transactions"))


def ticker_events_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One file per ticker; the file name (with ``_`` for ``.``) is the queried ticker. ``lines``: the documents of many tickers
    a line each, which splits; a document has the name of its file as ``file_name``."""
    if lines:
        return flatten_ticker_events(spark.read.schema(f"file_name string, {schemas.TICKER_EVENTS_JSON}").json(path))
    d = spark.read.schema(schemas.TICKER_EVENTS_JSON).option("multiLine", "true").json(path)
    return flatten_ticker_events(d.withColumn("file_name", F.col("_metadata.file_name")))


def flatten_ticker_events(d: DataFrame) -> DataFrame:
    stem = F.regexp_extract(F.col("file_name"), r"^(.*)\.json", 1)
    e = d.select(F.replace(stem, F.lit("_"), F.lit(".")).alias("query_ticker"), "results.composite_figi", "results.name",
                 "results.cik", F.explode("results.events").alias("e"))
    return e.select("query_ticker", F.col("composite_figi").alias("figi"), "name", "cik",
                    F.to_date("e.date").alias("event_date"), F.col("e.type").alias("event_type"),
                    F.col("e.ticker_change.ticker").alias("event_ticker"))


def parse_conditions(c: Column) -> Column:
    """Comma-separated codes to an int array; empty or missing is an empty array."""
    codes = F.transform(F.split(F.trim(c), ","), lambda x: F.trim(x).cast("int"))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<int>")).otherwise(codes)


def trades_csv(spark: SparkSession, path: str) -> DataFrame:
    d = _csv(spark, path, schemas.TRADES_CSV)
    return d.withColumn("conditions", parse_conditions(F.col("conditions")))


def minutes_csv(spark: SparkSession, path: str) -> DataFrame:
    cols = "ticker string, volume bigint, open double, close double, high double, low double, window_start bigint, transactions bigint"
    return _csv(spark, path, cols).select("ticker", "window_start", "open", "high", "low", "close", "volume", "transactions")


def day_files(spark: SparkSession, path: str, schema: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parquet files named by day (``2024-05-01.parquet``); the day becomes a ``date`` column.

    With ``start`` or ``end`` (days, both included) the folder's names are listed and only files of those days are opened, not a
    footer more. Without a schema that of the files read counts; no file in the range gives no rows and needs a schema.
    """
    r = spark.read if schema is None else spark.read.schema(schema)
    if start is None and end is None:
        d = r.parquet(path)
    else:
        day = re.compile(DAY_IN_NAME)
        dated = [(m[1], n) for n in Files(spark, path).names(path) for m in [day.search(n)] if m]
        chosen = [f"{path}/{n}" for d, n in sorted(dated) if (start is None or d >= start) and (end is None or d <= end)]
        if not chosen and schema is None:
            raise FileNotFoundError(f"{path} has no day from {start} to {end}")
        if not chosen:
            return spark.createDataFrame([], schema).withColumn("date", F.lit(None).cast("date"))
        d = r.parquet(*chosen)
    return d.withColumn("date", F.to_date(F.regexp_extract(F.col("_metadata.file_name"), DAY_IN_NAME, 1)))


def quotes_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``lines``: a document a line, which splits; else a document a file."""
    return flatten_quotes(spark.read.schema(schemas.QUOTES_JSON).option("multiLine", str(not lines).lower()).json(path))


def flatten_quotes(d: DataFrame) -> DataFrame:
    return d.select("ticker", F.explode("results").alias("q")).select("ticker", "q.*")


def news_json(spark: SparkSession, path: str, per_ticker: bool = False, lines: bool = False) -> DataFrame:
    """Articles with nested publisher and insights; ``per_ticker`` gives one row per mentioned ticker."""
    return flatten_news(spark.read.schema(schemas.NEWS_JSON).option("multiLine", str(not lines).lower()).json(path), per_ticker)


def flatten_news(d: DataFrame, per_ticker: bool = False) -> DataFrame:
    n = d.select(F.explode("results").alias("n")).select("n.*")
    n = n.withColumn("published_utc", F.to_timestamp("published_utc"))
    return n.withColumn("ticker", F.explode("tickers")) if per_ticker else n
