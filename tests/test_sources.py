"""Readers and writers on files made here."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from barspark.sources import readers, schemas, sinks
from barspark.streaming import bars as stream


def test_daily_csv_gz(spark, tmp_path):
    ns = int(dt.datetime(2024, 5, 1, 4, tzinfo=dt.timezone.utc).timestamp()) * 10**9
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("ticker,volume,open,close,high,low,window_start,transactions\n" f"ABC,10,1.5,nan,2,1,{ns},3\n")
    r = readers.daily_csv(spark, str(tmp_path / "*.csv.gz")).first()
    assert (r["ticker"], r["date"], r["volume"]) == ("ABC", dt.date(2024, 5, 1), 10)
    assert spark.createDataFrame([r]).select(F.isnan("close").alias("x")).first()["x"]


def test_splits_quotes_and_empty_dates(spark, tmp_path):
    (tmp_path / "d.csv").write_text('ticker,ex_dividend_date,cash_amount,declaration_date,pay_date,frequency,dividend_type\n'
                                    '"A,B",2024-01-02,0.5,"",2024-02-01,4,CD\nX,,1.0,,,1,CD\n')
    (r,) = readers.dividends_csv(spark, str(tmp_path / "d.csv")).collect()
    assert (r["ticker"], r["declaration_date"], r["pay_date"]) == ("A,B", None, dt.date(2024, 2, 1))


def test_ticker_events_take_the_name_from_the_file(spark, tmp_path):
    body = {"results": {"composite_figi": "F", "name": "N", "cik": "1", "events": [
        {"date": "2020-01-02", "type": "ticker_change", "ticker_change": {"ticker": "NEW"}}]}}
    (tmp_path / "BRK_B.json").write_text(json.dumps(body, indent=1))
    r = readers.ticker_events_json(spark, str(tmp_path)).first()
    assert (r["query_ticker"], r["event_ticker"], r["event_date"]) == ("BRK.B", "NEW", dt.date(2020, 1, 2))


def test_ticker_events_of_many_tickers_share_files(spark, tmp_path):
    """lines with the names of their files give what a file of each ticker gives."""
    event = '{"date": "2020-01-02", "type": "ticker_change", "ticker_change": {"ticker": "NEW"}}'
    docs = [(f"S_{k}", f'"results": {{"composite_figi": "F{k}", "cik": "{k}", "events": [{", ".join([event] * (k % 3))}]}}') for k in range(7)]
    sinks.write_json_texts(spark.createDataFrame([(n, f"{{{b}}}") for n, b in docs], "stem string, body string"), f"file://{tmp_path}/files")
    lines = [(f'{{"file_name": "{n}.json", {b}}}',) for n, b in docs]
    spark.createDataFrame(lines, "body string").coalesce(1).write.text(f"{tmp_path}/lines")
    got = sorted(map(str, readers.ticker_events_json(spark, f"{tmp_path}/lines", lines=True).collect()))
    assert len(got) == 6 and got == sorted(map(str, readers.ticker_events_json(spark, f"{tmp_path}/files").collect()))


def test_ticker_events_query_writes_no_file_of_each_ticker(spark):
    """the files that the query makes and lists don't grow with the customers."""
    got = entry.queries()["A5_ticker_events_flatten"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and len(got.inputFiles()) <= 16


def test_intraday_json_drops_missing_time(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ticker": "A", "results": [{"t": 1000, "o": 1, "h": 1, "l": 1, "c": 1, "v": 2}, {"o": 1}]}))
    assert readers.intraday_json(spark, str(tmp_path)).count() == 1


def test_conditions_and_day_files(spark, tmp_path):
    df = spark.createDataFrame([("1,2",), ("",), (None,), (" 37 ",)], "c string")
    got = [list(r["x"]) for r in df.select(readers.parse_conditions(F.col("c")).alias("x")).collect()]
    assert got == [[1, 2], [], [], [37]]
    p = tmp_path / "x"
    spark.createDataFrame([("A", 1)], "ticker string, v int").coalesce(1).write.parquet(str(p))
    src = next(p.glob("part-*.parquet"))
    day = tmp_path / "days"
    day.mkdir()
    src.rename(day / "2024-05-06.parquet")
    assert readers.day_files(spark, str(day)).first()["date"] == dt.date(2024, 5, 6)


def test_a_date_range_opens_only_its_day_files(spark, tmp_path):
    """Files of other days aren't read at all: here they are no parquet."""
    schema = "ticker string, v int"
    for d in range(1, 10):
        (tmp_path / f"2024-05-0{d}.parquet").write_bytes(b"no parquet")
    part = tmp_path / "x"
    spark.createDataFrame([("A", 1)], schema).coalesce(1).write.parquet(str(part))
    body = next(part.glob("part-*.parquet")).read_bytes()
    for d in (3, 4):
        (tmp_path / f"2024-05-0{d}.parquet").write_bytes(body)
    for kind in (None, schema):
        got = readers.day_files(spark, str(tmp_path), kind, "2024-05-03", "2024-05-04")
        assert len(got.inputFiles()) == 2 and [r.date.day for r in got.orderBy("date").collect()] == [3, 4]
    assert len(readers.day_files(spark, str(tmp_path), schema, start="2024-05-08").inputFiles()) == 2
    assert readers.day_files(spark, str(tmp_path), schema, end="2023-01-01").collect() == []


def test_news_per_ticker(spark, tmp_path):
    n = {"id": "1", "tickers": ["A", "B"], "published_utc": "2024-01-01T00:00:00Z", "publisher": {"name": "P"}, "insights": None}
    (tmp_path / "n.json").write_text(json.dumps({"results": [n]}))
    assert {r["ticker"] for r in readers.news_json(spark, str(tmp_path), True).collect()} == {"A", "B"}


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    got = {r["k"]: r["v"] for r in sinks.upsert(old, new.select("k", "v", "n").drop("n"), ["k"]).collect()}
    assert got[1] == "a" and got[2] in ("x", "y") and got[3] == "z"
    both = sinks.upsert(old.withColumn("n", F.lit(0)), new, ["k"], F.col("n"))
    assert {r["k"]: r["v"] for r in both.collect()} == {1: "a", 2: "y", 3: "z"}
    stage = spark.createDataFrame([(2, "q"), (2, "r")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.replace_keys(old, stage, ["k"]).collect()) == [(1, "a"), (2, "q"), (2, "r")]


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, v int")
    sinks.write_partitions(a, p, ["date"])
    sinks.write_partitions(spark.createDataFrame([("d2", 9)], "date string, v int"), p, ["date"])
    assert sorted((r["date"], r["v"]) for r in spark.read.parquet(p).collect()) == [("d1", 1), ("d2", 9)]
    todo = sinks.missing_days(spark, spark.createDataFrame([("d2", 1), ("d3", 1)], "date string, v int"), p)
    assert [r["date"] for r in todo.collect()] == ["d3"]
    assert sinks.missing_days(spark, a, str(tmp_path / "none")).count() == 2


def test_schema_table():
    assert schemas.primary_key("daily_prices") == ["ticker", "date"] and "close double" in schemas.columns("daily_prices")


def test_available_now_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("s", "o", "c"))
    df = spark.createDataFrame([(1,), (2,)], "v int")
    df.write.parquet(src)
    for _ in range(2):
        stream.run_available(spark.readStream.schema(df.schema).parquet(src), out, ck)
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(3,)], "v int").write.mode("append").parquet(src)
    stream.run_available(spark.readStream.schema(df.schema).parquet(src), out, ck)
    assert spark.read.parquet(out).count() == 3
