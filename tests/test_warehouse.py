"""Bucketed tables: no exchange by their key, one bucket for a key, sorted files; tables that queries share."""

import glob
import re
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barspark.functions.features import daily_features
from barspark.operators.universe import with_episodes
from barspark.plans import market as M
from barspark.session import kept_tables, scratch_path
from barspark.sources import warehouse as W

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def daily(spark):
    path = scratch_path(spark)
    yield W.write_bucketed(M.daily(spark, SF), "bucketed_daily", ["ticker"], ["date"], 4, path), path
    spark.sql("DROP TABLE bucketed_daily")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_and_joins_by_the_key_need_no_exchange(spark, daily):
    table, _ = daily
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        features = plan(daily_features(with_episodes(table)))
        assert "Window" in features and "Exchange" not in features
        per = W.write_bucketed(table.groupBy("ticker").agg(F.max("close").alias("top")), "bucketed_top", ["ticker"], [], 4)
        joined = table.join(per, "ticker").groupBy("ticker").agg(F.max(F.col("close") / F.col("top")).alias("x"))
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        assert {r.x for r in joined.collect()} == {1.0}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE IF EXISTS bucketed_top")


def test_a_key_reads_one_bucket_of_sorted_files(spark, daily):
    table, path = daily
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # off: the plan then names the buckets it reads
    spark.conf.set(auto, "false")
    try:
        assert re.search("SelectedBucketsCount: 1 out of 4", plan(table.where("ticker = 3")))
    finally:
        spark.conf.set(auto, "true")
    files = glob.glob(f"{path}/*.parquet")
    assert 0 < len(files) <= 4
    seen = []
    for f in files:
        t = pq.read_table(f, columns=["ticker", "date"]).to_pylist()
        keys = [(r["ticker"], r["date"]) for r in t]
        assert keys == sorted(keys)
        seen += sorted({k for k, _ in keys})
    assert len(seen) == len(set(seen)) == table.select("ticker").distinct().count()
    assert table.exceptAll(M.daily(spark, SF)).isEmpty() and table.count() == M.daily(spark, SF).count()


def test_row_groups_without_the_key_are_skipped(spark):
    """A sorted bucket of many small row groups: their ranges of the key hardly overlap."""
    path = scratch_path(spark)
    spark.range(200_000).select((F.col("id") % 50).alias("k"), F.col("id").alias("t"), F.xxhash64("id").alias("v")).createOrReplaceTempView("many_rows")
    spark.conf.set("parquet.block.size", "65536")
    try:
        W.write_bucketed(spark.table("many_rows"), "small_groups", ["k"], ["t"], 1, path)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.sql("DROP TABLE IF EXISTS small_groups")
    meta = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata
    ranges = [(s.min, s.max) for g in range(meta.num_row_groups) for s in [meta.row_group(g).column(0).statistics]]
    assert len(ranges) > 10 and sum(a <= 17 <= b for a, b in ranges) <= len(ranges) / 5


def test_a_shared_table_is_worked_out_once(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10).select((F.col("id") % 3).alias("k"), "id")

    for _ in range(3):
        assert W.kept(spark, ("numbers", "here"), build, ["k"], ["id"]).count() == 10
    assert len(calls) == 1
    shutil.rmtree(kept_tables(spark)["numbers", "here"][1])
    assert W.kept(spark, ("numbers", "here"), build, ["k"], ["id"]).count() == 10 and len(calls) == 2
    with pytest.raises(ZeroDivisionError):
        W.kept(spark, ("broken",), lambda: 1 / 0, ["k"], [])
    assert ("broken",) not in kept_tables(spark)
