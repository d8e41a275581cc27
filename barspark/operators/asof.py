"""As-of joins: for each left row the nearest right row before or after it, in one shuffle and without row blow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.prefix import spread, with_chunks

UNB = Window.unboundedPreceding


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
              values: list[str], direction: str = "backward", strict: bool = False,
              chunk: int | None = None, clock: str | None = None) -> DataFrame:
    """Left join with the latest right row at or before (``backward``) or the first at or after (``forward``) the
    left time; ``strict`` excludes equal times. ``right`` is unique by (by, right_time).

    Both sides are tagged and unioned; the match is the last (first) right row of the ordered union. Right values
    travel in one struct, so a matched row with NULL fields stays a match. With ``chunk`` (a length of time) a key's series
    is cut into chunks no longer than that and of bounded size (see ``prefix.with_chunks``): each is windowed alone and the
    nearest match outside it comes from a small per-chunk table, so a hot key is spread over tasks. Times that are
    structs name the field that is a whole number in ``clock``.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    back = direction == "backward"
    lcols = left.columns
    clash = set(values) & set(lcols)
    if clash:
        raise ValueError(f"rename {sorted(clash)} before the join")
    # ties: a right row at the left row's own time must sort to the side the frame looks at only when not strict
    right_first = back != strict
    lrank, rrank = (1, 0) if right_first else (0, 1)
    lkeep = [c for c in lcols if c not in by]
    r = right.select(
        *by, F.col(right_time).alias("__t"), F.lit(rrank).alias("__side"),
        F.struct(*[F.col(v) for v in values]).alias("__r"),
    )
    lft = left.select(
        *by, F.col(left_time).alias("__t"), F.lit(lrank).alias("__side"),
        F.struct(*[F.col(c) for c in lkeep]).alias("__l"),
    )
    u = lft.unionByName(r, allowMissingColumns=True)
    # a frame that runs to the end is worked out anew for every row; the same rows in descending order are a running frame
    way = F.asc if back else F.desc
    latest = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(UNB, -1))
    if chunk is None:
        m = u.withColumn("__m", latest("__r", Window.partitionBy(*by).orderBy(way("__t"), way("__side"))))
    else:
        u = with_chunks(u, by, ["__t", "__side"], chunk, name="__chunk", time=F.col(f"__t.{clock}") if clock else None)
        keys = [*by, "__chunk"]
        w = Window.partitionBy(*keys).orderBy(way("__t"), way("__side"))
        edge = F.max_by if back else F.min_by
        per = u.groupBy(*keys).agg(edge("__r", F.when(F.col("__r").isNotNull(), F.col("__t"))).alias("__edge"))
        carry = per.select(*keys, latest("__edge", Window.partitionBy(*by).orderBy(way("__chunk"))).alias("__carry"))
        m = (
            u.withColumn("__local", latest("__r", w))
            .filter(F.col("__l").isNotNull())
            .join(carry, keys, "left")
            .withColumn("__m", F.coalesce("__local", "__carry"))
        )
    out = m.filter(F.col("__l").isNotNull())
    cols = [F.col(c) if c in by else F.col(f"__l.{c}").alias(c) for c in lcols]
    return out.select(*cols, *[F.col(f"__m.{v}").alias(v) for v in values])


def forward_fill_on_grid(series: DataFrame, by: list[str], t: str, values: list[str], step: int) -> DataFrame:
    """One row per ``step`` from a key's first to its last time, each carrying the latest known values.

    Times are whole numbers (minutes, hours). The grid is made in blocks of a bounded number of steps.
    """
    span = series.groupBy(*by).agg(F.min(t).alias("__a"), F.max(t).alias("__z"))
    steps = F.floor((F.col("__z") - F.col("__a")) / step).cast("long")
    grid = spread(span, F.lit(0).cast("long"), steps, "__k").select(*by, (F.col("__a") + F.col("__k") * step).alias(t))
    src = series.select(*by, F.col(t).alias("__src_t"), *values)
    return asof_join(grid, src, by, t, "__src_t", values)
