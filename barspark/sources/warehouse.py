"""Tables that later jobs share: bucketed by key and sorted, so that they need no shuffle by that key again."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barspark import session
from barspark.sources.files import Files

_one_at_a_time = threading.Lock()


def write_bucketed(df: DataFrame, name: str, by: list[str], order: list[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as the table ``name``, one sorted file a bucket, and return the table.

    Windows and aggregates whose keys begin with ``by``, and joins of two tables with as many buckets by their keys, read it without an
    exchange; a filter on a key reads one bucket, and in it only the row groups whose range has the key. A key's rows lie in one
    bucket, so ``by`` is for series bounded by the calendar, not for tapes. ``path`` is a shared folder of its own (by default in the
    checkpoint folder); ``buckets`` are as many as the session shuffles into unless given.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *by).sortWithinPartitions(*by, *order)
    dealt.write.mode("overwrite").option("path", path or session.scratch_path(spark)).bucketBy(n, *by).sortBy(*by, *order).saveAsTable(name)
    return spark.table(name)


def kept(spark: SparkSession, what: tuple[str, ...], build: Callable[[], DataFrame], by: list[str], order: list[str]) -> DataFrame:
    """The table that ``build`` gives, worked out when an application first asks for ``what`` and read from then on.

    ``what`` must name everything the table depends on, its input folder included. A table whose files are gone is worked out
    again; ``session.cleanup`` drops them all."""
    tables = session.kept_tables(spark)
    with _one_at_a_time:
        name, path = tables.get(what, (None, None))
        if name is None or "_SUCCESS" not in Files(spark, path).names(path):
            name, path = f"kept_{uuid.uuid4().hex}", session.scratch_path(spark)
            write_bucketed(build(), name, by, order, path=path)
            tables[what] = (name, path)
    return spark.table(name)
