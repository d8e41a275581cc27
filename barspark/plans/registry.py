"""Registry of the queries over the driver tables, each with its SQL counterpart.

A query's output columns are declared once, as a spec string such as ``"ticker:i date px:f"``: ``i`` is a 64-bit
integer, ``f`` a double rounded to six places, ``f4`` to four, no mark passes through. Both sides are finished by it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.scalars import rnd
from barspark.plans.ctes import CTES
from barspark.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple((f + ":").split(":")[:2]) for f in spec.split()]


def finish(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _fields(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind.startswith("f"):
            c = rnd(c.cast("double"), int(kind[1:] or 6))
        cols.append(c.alias(name))
    return df.select(*cols)


def _once(sql: str) -> str:
    """Named subqueries are worked out once, whatever the engine's rule for inlining them; recursive ones are left as they are."""
    return sql if "RECURSIVE" in sql else re.sub(r"\b(\w+) AS \((?=\s*(?:SELECT|WITH)\b)", r"\1 AS MATERIALIZED (", sql)


#: Shared subqueries of some sixty columns.
WIDE = ("feat", "sfeat", "tfeat")


def with_ctes(sql: str, also: list[str]) -> str:
    """Prefix the shared CTEs a statement names, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(sql)
    # a wide subquery keeps only the columns that the output or some text after it names
    head, words = [], set(re.findall(r"\w+", sql)) | set(also)
    for n in reversed(order):
        body = _once(CTES[n])
        if n in WIDE:
            body = f"SELECT COLUMNS('^({'|'.join(sorted(words))})$') FROM ({body})"
        head.append(f"{n} AS MATERIALIZED ({body})")
        words |= set(re.findall(r"\w+", CTES[n]))
    return f"WITH {', '.join(reversed(head))}\n" if head else ""


def finish_sql(sql: str, spec: str) -> str:
    cols = []
    for name, kind in _fields(spec):
        e = f'"{name}"'
        if kind == "i":
            e = f"CAST({e} AS BIGINT)"
        elif kind.startswith("f"):
            s = f"1e{int(kind[1:] or 6)}"
            e = f"floor(CAST({e} AS DOUBLE)*{s}+0.5)/{s}"
        cols.append(f'{e} AS "{name}"')
    return f"{with_ctes(sql, [name for name, _ in _fields(spec)])}SELECT {', '.join(cols)} FROM ({_once(sql)}) AS result"


def query(name: str, spec: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name`` with its output spec and oracle SQL."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables' zone-less times are UTC
            return finish(fn(spark, sf), spec)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = finish_sql(sql, spec)
        return fn

    return wrap
