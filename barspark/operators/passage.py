"""First passages in a sorted series by index: where, after a given bar, a value first crosses a level.

A series (one session or episode, one row) gets tables of extremes: level k at position i holds the least (or greatest) of the
2^k values from i on. The first position at which a monotone test holds is found by binary descent: a block whose extreme
fails the test is skipped whole, else the search goes on inside it. An entry so costs log n look-ups in a series of n, and a series
n log n once, instead of every entry walking all later bars.

Spark puts an expression back wherever a lambda names it, so a table must be finished before it is used: ``once`` does that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _two_to(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k.cast("int"))


def extremes(values: Column, kind: str) -> Column:
    """array<array>: for each level the extremes ("min" or "max") of aligned-by-start blocks; NULLs are passed over."""
    pick = {"min": F.least, "max": F.greatest}[kind]
    top = F.floor(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")

    def longer(acc: Column, k: Column) -> Column:
        row = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.transform(row, lambda x, i: pick(x, F.get(row, i + _two_to(k))))))

    steps = F.when(top > 0, F.sequence(F.lit(0), top - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(values), longer)


def first_index(table: Column, start: Column, test: Callable[[Column], Column]) -> Column:
    """The first position (from 0) at or after ``start`` whose value meets ``test``, or NULL. The test must hold for a block's
    extreme whenever it holds for one of its values."""
    def skip(at: Column, k: Column) -> Column:
        here = F.coalesce(test(F.get(F.get(table, k), at)), F.lit(False))
        return F.when(here, at).otherwise(at + _two_to(k))

    at = F.aggregate(F.sequence(F.size(table) - 1, F.lit(0)), start.cast("int"), skip)
    return F.when(at < F.size(F.get(table, F.lit(0))), at)


def least_between(table: Column, start: Column, end: Column) -> Column:
    """The least value from ``start`` to ``end`` - 1 by a "min" table: two blocks that overlap cover any range."""
    k = F.floor(F.log2(F.greatest(end - start, F.lit(1)).cast("double"))).cast("int")
    row = F.get(table, k)
    return F.when(end > start, F.least(F.get(row, start.cast("int")), F.get(row, (end - _two_to(k)).cast("int"))))


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once a row, whatever names them afterwards."""
    if not cols:
        return df
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))).alias("__once")
    return df.select("*", one).select("*", *[F.col(f"__once.{n}").alias(n) for n in cols]).drop("__once")


@dataclass(frozen=True)
class Rule:
    """An exit on the first later bar whose ``value`` meets ``test(entry, value)``; fills at ``fill(entry, bar)``.

    ``kind`` says which extreme of several values meets the test if any does: "min" for below, "max" for above. A condition
    on the bar alone goes into the value: NULL where it fails.
    """

    name: str
    value: Callable[[Column], Column]
    kind: str
    test: Callable[[Column, Column], Column]
    fill: Callable[[Column, Column], Column]


def below(name: str, value, level, fill, strict: bool = True) -> Rule:
    return Rule(name, value, "min", (lambda e, x: x < level(e)) if strict else (lambda e, x: x <= level(e)), fill)


def above(name: str, value, level, fill, strict: bool = False) -> Rule:
    return Rule(name, value, "max", (lambda e, x: x > level(e)) if strict else (lambda e, x: x >= level(e)), fill)


def whenever(name: str, cond, fill) -> Rule:
    """A rule on the bar alone."""
    return Rule(name, lambda b: F.when(cond(b), 1), "max", lambda e, x: x >= 1, fill)


def first_passage(series: DataFrame, by: list[str], order: str, ent: list[str], rules: list[Rule], final: str = "moc") -> DataFrame:
    """Trips that end at the first later bar on which a rule holds; of several rules the first in the list counts.

    ``series`` has a row per series: by, ``bars`` (sorted array of struct i, order, close and what the rules read; i counts from 1)
    and ``entries`` (array of struct i, order and ``ent``). Without a hit the trip ends at the last bar's close with reason
    ``final``. Output: by, entry_i, order, ent, exit_i, exit_at, exit_price, exit_reason.
    """
    tables = {f"__x{r}": extremes(F.transform("bars", rule.value), rule.kind) for r, rule in enumerate(rules)}
    g = once(series, tables)

    def trip(e: Column) -> Column:
        hits = [first_index(F.col(f"__x{r}"), e["i"], lambda x, rule=rule: rule.test(e, x)).alias(f"h{r}") for r, rule in enumerate(rules)]
        return F.struct(e.alias("e"), F.struct(*hits).alias("h"))

    t = g.select(*by, "bars", F.explode(F.transform("entries", trip)).alias("t"))
    hits = [F.col(f"t.h.h{r}") for r in range(len(rules))]
    at = F.least(*hits) if len(hits) > 1 else hits[0]
    e, last = F.col("t.e"), F.element_at("bars", -1)
    t = t.select(*by, e.alias("e"), F.struct(*hits).alias("h"), at.alias("at"), F.get("bars", at).alias("b"), last.alias("last"))
    e, b, last = F.col("e"), F.col("b"), F.col("last")
    reason, px = F.lit(final), last["close"]
    for r, rule in reversed(list(enumerate(rules))):
        mine = F.col("h")[f"h{r}" if len(hits) > 1 else "h0"] == F.col("at")
        reason, px = F.when(mine, rule.name).otherwise(reason), F.when(mine, rule.fill(e, b)).otherwise(px)
    got = F.col("at").isNotNull()
    return t.select(
        *by, e["i"].alias("entry_i"), *[e[c].alias(c) for c in dict.fromkeys([order, *ent])],
        F.when(got, b["i"]).otherwise(last["i"]).alias("exit_i"), F.when(got, b[order]).otherwise(last[order]).alias("exit_at"),
        F.when(got, px).otherwise(last["close"]).alias("exit_price"), F.when(got, reason).otherwise(F.lit(final)).alias("exit_reason"))
