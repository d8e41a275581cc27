"""Column helpers shared by all operators: guarded ratios, rounding, calendar parts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def rnd(c: Column, digits: int = 6) -> Column:
    """Half-up rounding of the binary value (floor(x * 10^d + 0.5) / 10^d); infinities and NaN stay."""
    scale = F.lit(float(10**digits))
    y = c * scale + F.lit(0.5)
    # floor gives a long: beyond 2^53 a double is whole anyway
    return F.when(F.abs(y) < F.lit(float(2**53)), F.floor(y)).otherwise(y) / scale


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def ratio_if_positive(a: Column, b: Column) -> Column:
    """a / b where b > 0, else NULL."""
    return F.when(b > 0, a / b)


def pct(a: Column, b: Column) -> Column:
    """Relative change a / b - 1 where b > 0, else NULL."""
    return F.when(b > 0, a / b - F.lit(1.0))


def gate(cond: Column) -> Column:
    """A gate on a missing metric fails."""
    return F.coalesce(cond, F.lit(False))


def all_of(conds: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & gate(c)
    return out


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ns_to_timestamp(ns: Column) -> Column:
    """Epoch nanoseconds to a microsecond timestamp."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000)).cast("long"))


def ns_to_date(ns: Column) -> Column:
    return F.to_date(ns_to_timestamp(ns))


def eastern_minute(ns: Column) -> Column:
    """Minute of day in US Eastern time of an epoch-nanosecond column."""
    t = F.from_utc_timestamp(ns_to_timestamp(ns), EASTERN)
    return F.hour(t) * 60 + F.minute(t)


def session_anchor_ns(date: Column, hour: int = 4, minute: int = 0) -> Column:
    """UTC epoch nanoseconds of a wall-clock Eastern time on ``date`` (daylight saving included)."""
    wall = F.make_timestamp_ntz(
        F.year(date), F.month(date), F.day(date), F.lit(hour), F.lit(minute), F.lit(0)
    ).cast("timestamp")
    return F.unix_micros(F.to_utc_timestamp(wall, EASTERN)) * F.lit(1000)


def floor_bucket(t: Column, width: int) -> Column:
    """Integer bucket number of an integer time; works for negative offsets too."""
    return F.floor(t / F.lit(width)).cast("long") if width == 1 else (
        (t - F.pmod(t, F.lit(width))) / F.lit(width)
    ).cast("long")
