"""Aggregate expressions over trips. All of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barspark.functions.scalars import div

CLIP = 0.5  # a winner counts for at most +50 %


def profit_factor(ret: Column, where: Column | None = None, clip: float | None = None) -> Column:
    """Gross wins over gross losses; NULL when there is no loss. ``clip`` caps each winner."""
    win = F.least(ret, F.lit(clip)) if clip is not None else ret
    up, down = ret > 0, ret < 0
    if where is not None:
        up, down = up & where, down & where
    return div(F.sum(F.when(up, win)), -F.sum(F.when(down, ret)))


def clipped_profit_factor(ret: Column, where: Column | None = None) -> Column:
    return profit_factor(ret, where, CLIP)


def win_rate(ret: Column, where: Column | None = None) -> Column:
    hit = F.when(ret > 0, 1.0).otherwise(0.0)
    return F.avg(hit if where is None else F.when(where, hit))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def share_if(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))
