"""Helpers the operators of this subpackage share: row keys, joins that survive hot keys, splits of long batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.session import ship, stored

HELD_OUT_FOLDS = 5
#: So many of the most frequent keys are joined by broadcast; any other key then holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 256
HOT_LEAST = 64
#: The name of the row key, reserved: a column of the input that is called so is replaced.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a missing id counts as held out, so nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_FOLDS == 0, F.lit(True))


def keyed(docs: DataFrame, key: str = "doc_id", row: str | None = None) -> DataFrame:
    """The rows with a unique column ``__row``: the column ``row`` if given; else the id itself where it is unique and
    never null, else a number per row. Numbers are given once and written to the shared folder, so that
    several passes and recomputed tasks agree on them.
    """
    ship(docs.sparkSession)
    if row is not None:
        return docs if row == ROW else docs.drop(ROW).withColumnRenamed(row, ROW)
    docs = docs.drop(ROW)
    if dict(docs.dtypes)[key] == "bigint":
        per_id = docs.groupBy(key).count().agg(F.max("count"), F.max(F.col(key).isNull().cast("int"))).first()
        if per_id[0] in (None, 1) and not per_id[1]:
            return docs.withColumn(ROW, F.col(key))
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def hot_keys(rows: DataFrame, keys: list[str], weight: Column | None = None) -> list[int]:
    """Hashes of at most HOT_KEYS keys with the most rows: a bounded list, whatever the table's size."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    top = rows.groupBy(F.xxhash64(*keys).alias("h")).agg(n.alias("n")).where(F.col("n") >= HOT_LEAST)
    return [r.h for r in top.orderBy(F.desc("n"), "h").limit(HOT_KEYS).collect()]


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], hot: list[int]) -> DataFrame:
    """Inner join with a right side that has one row per key. Rows of the hot keys are joined where they lie, by a
    broadcast of at most HOT_KEYS rows of ``right``; the others by a shuffle in which no key is large."""
    if not hot:
        return left.join(right, keys)
    is_hot = F.xxhash64(*keys).isin(hot)
    cold = left.where(~is_hot).join(right.where(~is_hot), keys)
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), keys).select(cold.columns).unionAll(cold)


def without(docs: DataFrame, dropped: DataFrame, key: str = ROW, limit: int = 1_000_000) -> DataFrame:
    """The rows whose key isn't in ``dropped``: by broadcast up to ``limit`` keys (8 MB), beyond that by a shuffle."""
    dropped = stored(dropped.select(key).distinct())
    small = dropped.limit(limit + 1).count() <= limit
    return docs.join(F.broadcast(dropped) if small else dropped, key, "left_anti")


def chunks(texts: pd.Series, most: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about ``most`` characters, at least one text each; null is empty."""
    first, run, n = 0, [], 0
    for i, t in enumerate(texts.tolist()):
        t = t if isinstance(t, str) else ""
        if run and n + len(t) > most:
            yield first, run
            first, run, n = i, [], 0
        run.append(t)
        n += len(t)
    if run:
        yield first, run


def arrow_chunks(texts: pa.Array, most: int) -> Iterator[list[str]]:
    """Texts in runs of about ``most`` bytes, at least one text each; null is empty. Only a run at a time becomes Python
    strings, so a worker's memory is bounded by the Arrow batch and one run."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        begun = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begun + most, side="right")))
        yield [t or "" for t in texts.slice(at, stop - at).to_pylist()]
        at = stop


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each run, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
