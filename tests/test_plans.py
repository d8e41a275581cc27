"""Plans that must stay as they are: pruned scans, few shuffles, no cross joins."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
QUERIES = entry.queries()


def plan(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def exchanges(p):
    return len(re.findall(r"Exchange hashpartitioning", p))


def test_ticker_filter_and_columns_reach_the_scan(spark):
    p = plan(spark, "B5_ticker_date_range")
    assert "EqualTo(l_suppkey,11)" in p
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "l_returnflag" not in schema and "l_suppkey" in schema


def test_time_bars_combine_before_their_only_shuffle(spark):
    p = plan(spark, "C5_time_bars")
    assert exchanges(p) == 1 and "SortAggregate" not in p and "partial_" in p


@pytest.mark.parametrize("name,most", [
    ("F12_F14_F16_tightness_channels", 2),  # bars, then one partitioning for every window
    ("F20_runs_below_vwap", 2), ("G6_vwap_reclaim", 2), ("H4_stop_atr_ratchet", 3), ("H7_frozen_level_stop", 2),
    ("D2_asof_forward_strict", 6), ("C10_volume_bars", 5), ("C12_imbalance_bars", 9), ("D9_windowed_sums_from_prefix", 4),
    ("J4_consolidated_levels", 14), ("J5_book_quality_checks", 10)])
def test_window_stacks_share_a_shuffle(spark, name, most):
    assert exchanges(plan(spark, name)) <= most


@pytest.mark.parametrize("name", ["C10_volume_bars", "C12_imbalance_bars", "D4_asof_backward_strict_hot_key", "E13_dollar_float_at_entry",
                                  "G13_armed_breakout_rolling_rearm", "H8_geometry_stop_and_volume_exits", "I18_monthly_mark_to_market"])
def test_no_cross_joins(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_moments_take_one_scan_and_one_exchange(spark):
    p = plan(spark, "C9_two_pass_bars")
    assert exchanges(p) == 1 and p.count("Scan parquet") == 1 and "SortAggregate" not in p and "partial_" in p


@pytest.mark.parametrize("name,most", [("G9_dip_run_modes", 2), ("G6_vwap_reclaim", 2), ("H7_frozen_level_stop", 2), ("G13_armed_breakout_rolling_rearm", 8)])
def test_sessions_are_dealt_to_partitions_of_bounded_size(spark, monkeypatch, name, most):
    """F11 to F28: merged shuffle partitions had any number of bars; the windows of a query take the dealt ones as they are."""
    from barspark.plans import market as M

    monkeypatch.setattr(M, "SESSION_ROWS", 1000)
    lines = M.table(spark, SF, "lineitem").count()
    assert lines // 1000 > 8
    assert M.sessions(spark, SF).rdd.getNumPartitions() == -(-lines // 1000)
    p = plan(spark, name)
    assert "hashpartitioning(ticker" in p and f", {-(-lines // 1000)})" in p and exchanges(p) <= most


@pytest.mark.parametrize("name", ["H7_frozen_level_stop", "G5_pop_fade_reentries", "G6_vwap_reclaim", "G11_momentum_with_shadow_slots",
                                  "G15_opening_drive_limit_entry", "G13_armed_breakout_session_rearm", "H8_pct_stop_and_target"])
def test_lines_are_dealt_before_they_are_bars(spark, monkeypatch, name):
    """F12 to F27: a task that scans held the bars of its whole split, and few partitions left the rest to the merging of bytes."""
    from barspark.plans import market as M

    monkeypatch.setattr(M, "SESSION_ROWS", 5000)
    parts = -(-M.table(spark, SF, "lineitem").count() // 5000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        p = plan(spark, name).splitlines()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    scans = [k for k, row in enumerate(p) if "Scan parquet" in row]
    assert parts < 100 and scans
    for k in scans:
        dealt = next(j for j in range(k, -1, -1) if "Exchange" in p[j])
        assert f", {parts})" in p[dealt] and not any("Aggregate" in row for row in p[dealt:k])
