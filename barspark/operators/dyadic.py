"""Windowed sums from aligned blocks, never from differences of running totals.

A series on a grid of buckets is summed into blocks of 1, 2, 4, ... buckets, each aligned to its size. Any window of buckets is
the disjoint union of at most two blocks of each size, so a windowed sum adds a few block sums: what lies outside the window,
however long the history, has no part in it. Windows are worked out once per distinct (key, first, end), not per row that asks
for them, and meet the blocks by an equi-join whose keys have one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.asof import asof_join
from barspark.operators.prefix import running, with_chunks
from barspark.session import stored


def block_tree(buckets: DataFrame, by: list[str], index: str, sums: list[str], longest: int) -> DataFrame:
    """(by, level, block, sums): block ``b`` of level ``k`` is buckets b * 2^k to (b + 1) * 2^k - 1. Levels go as far as windows of
    ``longest`` buckets can use them. Blocks combine before the shuffle."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(longest.bit_length() - 1))).alias("__k")
    rows = buckets.select(*by, F.col(index).alias("__i"), *sums, levels)
    return rows.groupBy(*by, "__k", F.expr("shiftright(__i, __k)").alias("__b")).agg(*[F.sum(s).alias(s) for s in sums])


def window_blocks(first: Column, end: Column, longest: int) -> Column:
    """array<struct<__k, __b>>: the blocks whose union is the buckets first to end - 1 (at most ``longest``).

    At level k what is left runs from ceil(first / 2^k) to floor(end / 2^k); an odd bound at either side is a block of that level.
    """
    picks = []
    for k in range(longest.bit_length()):
        lo, hi = F.floor((first + ((1 << k) - 1)) / (1 << k)), F.floor(end / (1 << k))
        block = lambda b, k=k: F.struct(F.lit(k).alias("__k"), b.cast("long").alias("__b"))
        left = (F.pmod(lo, F.lit(2)) == 1) & (lo < hi)
        right = (F.pmod(hi, F.lit(2)) == 1) & (hi - 1 >= lo) & ~(left & (hi - 1 == lo))
        picks += [F.when(left, block(lo)), F.when(right, block(hi - 1))]
    return F.array_compact(F.array(*picks))


def grid_sums(buckets: DataFrame, windows: DataFrame, by: list[str], index: str, sums: list[str], first: str, end: str, longest: int) -> DataFrame:
    """``windows`` with the sums over their buckets ``first`` to ``end`` - 1, at most ``longest`` (NULL where there is no bucket).

    ``buckets`` has whole-number columns by, index and the columns to add up; decimals and whole numbers stay exact, doubles err
    by the window's own size alone. Rows of one window are reduced to one before they meet the blocks.
    """
    tree = block_tree(buckets, by, index, sums, longest)
    asked = windows.groupBy(*by, first, end).count().drop("count").where(F.col(first) < F.col(end))
    parts = asked.withColumn("__p", F.explode(window_blocks(F.col(first), F.col(end), longest))).select(*by, first, end, "__p.__k", "__p.__b")
    total = parts.join(tree, [*by, "__k", "__b"]).groupBy(*by, first, end).agg(*[F.sum(s).alias(s) for s in sums])
    return windows.join(total, [*by, first, end], "left")


def trailing_sums(rows: DataFrame, by: list[str], t: str, sums: list[str], width: int, cells: int = 64) -> DataFrame:
    """``rows`` (unique by key and whole-number time) with each of ``sums`` replaced by its sum over the last ``width`` time units.

    The window is cut at the edges of a grid of about ``cells`` cells a window: whole cells come from blocks; of the cell that the
    row lies in the rows up to it, of the cell that the window begins in those from its beginning on, as totals within the cell.
    """
    step = max(1, width // cells)
    d = with_chunks(rows.withColumn("__cell", F.floor(F.col(t) / step).cast("long")), by, [t], step)
    key = [*by, "__cell"]
    up = running(d, key, [t], "__ck", {f"__u_{s}": ("sum", F.col(s)) for s in sums})
    back = running(up.withColumns({"__rt": -F.col(t), "__rc": -F.col("__ck")}), key, ["__rt"], "__rc", {f"__d_{s}": ("sum", F.col(s)) for s in sums})
    back = stored(back.drop("__rt", "__rc", "__ck"))  # read as the rows, as the points and as what they look up
    start = F.col(t) - (width - 1)
    points = back.withColumns({"__at": start, "__own": F.col("__cell"), "__cell": F.floor(start / step).cast("long")}).drop(*[f"__d_{s}" for s in sums])
    head = back.select(*key, F.col(t).alias("__ht"), *[f"__d_{s}" for s in sums])
    points = asof_join(points, head, key, "__at", "__ht", [f"__d_{s}" for s in sums], "forward", chunk=step)
    # a window within one cell (a step of one time unit) has no other part than the row's own prefix
    points = points.withColumns({"__first": F.col("__cell") + 1, "__end": F.col("__own")})
    cells_of = rows.groupBy(*by, F.floor(F.col(t) / step).cast("long").alias("__cell")).agg(*[F.sum(s).alias(f"__g_{s}") for s in sums])
    out = grid_sums(cells_of, points, by, "__cell", [f"__g_{s}" for s in sums], "__first", "__end", width // step + 2)
    zero = F.lit(0)
    apart = F.col("__first") <= F.col("__end")
    total = {s: F.col(f"__u_{s}") + F.when(apart, F.coalesce(F.col(f"__d_{s}"), zero)).otherwise(zero) + F.coalesce(F.col(f"__g_{s}"), zero) for s in sums}
    return out.withColumns(total).select(*rows.columns)
