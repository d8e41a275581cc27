"""Structured Streaming versions of the bar and session operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators.bars import lit_trades
from barspark.streaming.compaction import write_parts


def trade_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streaming_bars(trades: DataFrame, width: str = "1 minute", lateness: str = "10 minutes",
                   filtered: bool = False) -> DataFrame:
    """Time bars per ticker, emitted once when the watermark passes the bar. ``ts`` is a timestamp column."""
    src = lit_trades(trades) if filtered else trades
    p, q = F.col("price"), F.col("size")
    key = F.struct("ts", "seq")
    return (
        src.withWatermark("ts", lateness)
        .groupBy("ticker", F.window("ts", width).alias("w"))
        .agg(F.min_by(p, key).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, key).alias("close"),
             F.sum(q).alias("volume"), F.sum(p * q).alias("dollar_volume"), F.count(F.lit(1)).alias("trade_count"))
        .select("ticker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close",
                "volume", "dollar_volume", "trade_count")
    )


SESSION_OUT = ("ts timestamp, close double, ema double, vwap double, sess_high double, "
               "sess_low double, run_below int, reclaim boolean")
#: What is kept of a session: pv, v, ema, high, low (NaN: none yet), the run, the bars so far and when it is dropped (ms).
SESSION_STATE = ["pv", "v", "ema", "hi", "lo", "run", "n", "drop"]
BAR = ["ts", "high", "low", "close", "volume"]
#: Groups of sessions that share a state row. A group's bars of one micro-batch are in a Python worker's memory together.
SHARDS = 256


def session_steps(bars: pd.DataFrame, of: np.ndarray, state: pd.DataFrame, alpha: float, min_run: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(columns of SESSION_OUT of the bars, state afterwards) of bars in time order; ``of`` is the row of ``state`` that is a bar's session.

    Exponential average, VWAP, extremes, bars in a row with the average below VWAP, and the reclaim. Bars are taken rank by rank:
    the first of all sessions, then the second of all, so that a step is a few operations on arrays over sessions.
    """
    order = np.argsort(of, kind="stable")
    many = np.bincount(of, minlength=len(state))
    longest = np.argsort(-many, kind="stable")
    first = (np.cumsum(many) - many)[longest]
    pv, v, ema, hi, lo = (state[x].to_numpy(float)[longest] for x in ("pv", "v", "ema", "hi", "lo"))
    run, n = (state[x].to_numpy(np.int64)[longest] for x in ("run", "n"))
    high, low, close, volume = (bars[x].to_numpy(float)[order] for x in BAR[1:])
    res = {x: np.empty(len(bars)) for x in ("ema", "vwap", "sess_high", "sess_low")}
    runs, crossed = np.empty(len(bars), np.int32), np.empty(len(bars), bool)
    sizes = many[longest]
    ratio = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=b > 0)
    for k in range(int(many.max(initial=0))):
        m = int(np.searchsorted(-sizes, -k, side="left"))  # sessions with more than k bars
        at = first[:m] + k
        h, l, c, q = high[at], low[at], close[at], volume[at]
        ema_p, vwap_p, was, new = ema[:m].copy(), ratio(pv[:m], v[:m]), run[:m].copy(), n[:m] == 0
        # a bar without a past leaves the count as it is
        known = ~(np.isnan(ema_p) | np.isnan(vwap_p))
        run[:m] = np.where(known, np.where(ema_p < vwap_p, was + 1, 0), was)
        pv[:m] += (h + l + c) / 3.0 * q
        v[:m] += q
        ema[:m] = np.where(np.isnan(ema_p), c, np.where(np.isnan(c), ema_p, ema_p + alpha * (c - ema_p)))
        hi[:m] = np.where(new, h, np.maximum(hi[:m], h))
        lo[:m] = np.where(new, l, np.minimum(lo[:m], l))
        n[:m] += 1
        vwap = ratio(pv[:m], v[:m])
        for x, y in (("ema", ema), ("vwap", vwap), ("sess_high", hi), ("sess_low", lo)):
            res[x][at] = y[:m]
        runs[at] = run[:m]
        crossed[at] = known & ~np.isnan(vwap) & (ema_p <= vwap_p) & (ema[:m] > vwap) & (was >= min_run)
    out = pd.DataFrame({"ts": bars["ts"].to_numpy()[order], "close": close, **res, "run_below": runs, "reclaim": crossed})
    back = np.argsort(order, kind="stable")
    after = state.copy()
    for x, y in (("pv", pv), ("v", v), ("ema", ema), ("hi", hi), ("lo", lo), ("run", run), ("n", n)):
        after[x] = y[np.argsort(longest, kind="stable")]
    return out.iloc[back].reset_index(drop=True), after


def _pack(t: pd.DataFrame) -> bytes:
    import pyarrow as pa

    table = pa.Table.from_pandas(t, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(b: bytes) -> pd.DataFrame:
    import pyarrow as pa

    with pa.ipc.open_stream(pa.py_buffer(b)) as r:
        return r.read_pandas()


class _SessionProcessor:
    """Session state of a group of sessions over bars that may come in any order within the lateness.

    Bars wait in the state, the reorder buffer, until the watermark has passed them: no earlier bar can come then, so they
    are released in time order and go into the running state of their session. A timer at the first waiting bar releases it when no
    further bar comes. State is one small row of each live session and the waiting bars, both as Arrow tables: it is read and
    written once a group and micro-batch, not once a session. ``ttl_hours`` after its first bar a session without waiting
    bars is dropped.
    """

    def __init__(self, keys: list[str], period: int, min_run: int, ttl_hours: int):
        self.keys = keys
        self.alpha = 2.0 / (period + 1)
        self.min_run = min_run
        self.ttl = ttl_hours * 3_600_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", "sessions binary, waiting binary, timer long")

    def _step(self, new: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        known = _unpack(held[0]) if held else None
        parts = [*([_unpack(held[1])] if held else []), *new]
        bars = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        bars = bars.sort_values("ts", kind="stable", ignore_index=True)
        ms = bars["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        # number the sessions: those of the state first, then those that begin
        both = bars[self.keys] if known is None else pd.concat([known[self.keys], bars[self.keys]], ignore_index=True)
        of = both.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        begun = 0 if known is None else len(known)
        of_bars = of[begun:]
        fresh = both[begun:][of_bars >= begun].drop_duplicates(self.keys)
        fresh = fresh.assign(pv=0.0, v=0.0, ema=np.nan, hi=np.nan, lo=np.nan, run=0, n=0, drop=ms[fresh.index.to_numpy() - begun] + self.ttl)
        state = fresh.reset_index(drop=True) if known is None else pd.concat([known, fresh], ignore_index=True)
        # event times are finer than the watermark's milliseconds: a bar in its very millisecond waits
        due = ms < watermark
        if due.any():
            out, state = session_steps(bars[due], of_bars[due], state, self.alpha, self.min_run)
            for i, k in enumerate(self.keys):
                out.insert(i, k, bars.loc[due, k].to_numpy())
            yield out
        live = state["drop"].to_numpy() > watermark
        live[of_bars[~due]] = True
        state, rest = state[live], bars[~due]
        if held:
            self.handle.deleteTimer(held[2])
        if not len(state):
            if held:
                self.state.clear()
            return
        waits = int(ms[~due][0]) + 1 if len(rest) else None
        ends = state["drop"].to_numpy()
        ends = int(ends[ends > watermark].min()) if (ends > watermark).any() else None
        timer = min(t for t in (waits, ends) if t is not None)
        self.state.update((_pack(state), _pack(rest), timer))
        self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step([r[[*self.keys, *BAR]] for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self._step([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def session_stream(bars: DataFrame, keys: list[str], period: int = 9, min_run: int = 11, ttl_hours: int = 24,
                   lateness: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """Session state and reclaim events per bar of a streaming bar source with columns ``keys`` (for example ticker and
    session), ts, high, low, close, volume.

    Bars may come in any order, across micro-batches too, if none is later than ``lateness``: each is given out once the
    watermark has passed it, with the state that bars in time order give. Needs the RocksDB state store. Sessions are dealt to
    ``shards`` groups by a hash of their keys, which share a state row; the number is fixed once a stream has a checkpoint.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    cls = type("SessionProcessor", (_SessionProcessor, StatefulProcessor), {})
    types = dict(bars.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + SESSION_OUT
    dealt = bars.withColumn("__shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    return dealt.withWatermark("ts", lateness).groupBy("__shard").transformWithStateInPandas(
        statefulProcessor=cls(keys, period, min_run, ttl_hours), outputStructType=schema, outputMode="Append",
        timeMode="EventTime")


def run_available(df: DataFrame, path: str, checkpoint: str, by: list[str] | None = None) -> None:
    """Process what has arrived since the last run and stop: incremental builds with exactly-once file output."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if by:
        w = w.partitionBy(*by)
    w.trigger(availableNow=True).start().awaitTermination()


def run_available_days(df: DataFrame, path: str, checkpoint: str, build, day: str = "date") -> None:
    """Incremental day builds. ``build`` reduces a micro-batch to mergeable partial rows (counts, sums, extremes) with a
    ``day`` column; they become the parts (day, batch), which ``compaction`` reads, merges and clears away. A day that arrives in parts has a
    partial row set for each, and a replayed batch overwrites its own parts only."""
    def write(batch: DataFrame, number: int) -> None:
        write_parts(build(batch), path, number, day)

    df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
