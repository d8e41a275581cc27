"""Running aggregates, row frames, ranks and quantiles that survive a hot key.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here an ordered series is cut into chunks by a pure
function of the row (a time bucket, or a value range), each chunk is windowed on its own, and the few chunk totals are
combined and joined back. Chunk ids depend on nothing but the row, so a lost executor recomputes the same answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding
CH = "__chunk"


def time_chunk(t: Column, width: int) -> Column:
    """Chunk id of an integer time column."""
    return F.floor(t / F.lit(width)).cast("long")


#: Rows of one key that a chunk is to hold, where its stretch of time has more.
CHUNK_ROWS = 1_000_000
#: Rows looked at per chunk when its edges are chosen: a chunk's size is within about an eighth of the aim.
SAMPLES = 64
FINE = 64


def with_chunks(df: DataFrame, by: list[str], order: list[str], widest: int, rows: int | None = None, name: str = "__ck",
                time: Column | None = None) -> DataFrame:
    """Adds a chunk id that does not decrease in ``order``; its first column, or ``time`` in its stead, is a whole-number time.

    A key's series is cut into stretches of ``widest`` time units, and a stretch with more than about ``rows`` rows further at
    quantiles of its order, so that a burst within a moment, or at one time, is spread like any other. The quantiles are those of a
    sample that a hash of the row's key and order chooses: whatever task works them out again, the edges are the same, and no job runs
    while the query is built. What is broadcast are the edges alone: one for CHUNK_ROWS rows, 24 bytes for a million.
    """
    rate = max(1, (rows or CHUNK_ROWS) // SAMPLES)
    at = F.struct(*[F.col(c) for c in order])
    d = df.withColumn("__st", F.floor((F.col(order[0]) if time is None else time) / F.lit(widest)).cast("long"))
    sample = d.select(*by, "__st", *order).where(F.pmod(F.xxhash64(*by, *order), F.lit(rate)) == 0)
    full = sample.groupBy(*by, "__st").agg(F.sort_array(F.collect_list(at)).alias("__e")).where(F.size("__e") >= 2 * SAMPLES)
    edge = F.transform(F.sequence(F.lit(1), F.floor(F.size("__e") / SAMPLES).cast("int") - 1), lambda k: F.element_at("__e", k * SAMPLES))
    full = full.select(*by, "__st", edge.alias("__e"))
    # coarse edges first, then those between two of them
    coarse = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size("__e") / FINE).cast("int"))), lambda k: F.element_at("__e", F.least(k * FINE, F.size("__e"))))
    full = full.withColumn("__big", F.when(F.size("__e") >= FINE, coarse).otherwise(F.slice("__e", 1, 0)))
    out = d.join(F.broadcast(full), [*by, "__st"], "left")
    block = F.size(F.filter("__big", lambda e: e < at))
    inside = F.size(F.filter(F.slice("__e", F.col("__blk") * FINE + 1, F.lit(FINE)), lambda e: e < at))
    out = out.withColumn("__blk", F.when(F.col("__big").isNotNull(), block).otherwise(0))
    sub = F.when(F.col("__e").isNotNull(), F.col("__blk") * FINE + inside).otherwise(0)
    return out.withColumn(name, F.col("__st") * (1 << 20) + sub).select(*df.columns, name)


_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(df: DataFrame, by: list[str], order: list[str], chunk: Column | str,
            aggs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Running aggregates per ``by`` in ``order`` (which must order the rows of a key uniquely).

    ``aggs`` maps an output name to (kind, column); kinds are sum, count, max, min, last (latest non-NULL) and last_before (latest
    non-NULL of the rows before, whatever ``inclusive`` says). ``chunk``
    must be non-decreasing in ``order``; given as the name of an existing column it is kept, so that several passes share
    one shuffle. Sum and count start from 0, the others from NULL.
    """
    ch = chunk if isinstance(chunk, str) else CH
    keys = [*by, ch]
    d = df if isinstance(chunk, str) else df.withColumn(CH, chunk)
    spec = Window.partitionBy(*keys).orderBy(*order)
    w = spec.rowsBetween(UNB, 0 if inclusive else -1)
    local, totals, carried, final = {}, [], [], {}
    wc = Window.partitionBy(*by).orderBy(ch).rowsBetween(UNB, -1)
    for name, (kind, col) in aggs.items():
        lo, to, ca = f"__l_{name}", f"__t_{name}", f"__c_{name}"
        if kind in ("last", "last_before"):
            local[lo] = F.last(col, ignorenulls=True).over(w if kind == "last" else spec.rowsBetween(UNB, -1))
            ordkey = F.struct(*[F.col(o) for o in order])
            totals.append(F.max_by(col, F.when(col.isNotNull(), ordkey)).alias(to))
            carried.append(F.last(to, ignorenulls=True).over(wc).alias(ca))
            final[name] = F.coalesce(F.col(lo), F.col(ca))
            continue
        agg = _AGG[kind]
        local[lo] = agg(col).over(w)
        totals.append(agg(col).alias(to))
        carry = F.sum(to).over(wc) if kind in ("sum", "count") else agg(to).over(wc)
        carried.append(carry.alias(ca))
        if kind in ("sum", "count"):
            zero = F.lit(0)
            final[name] = F.coalesce(F.col(lo), zero) + F.coalesce(F.col(ca), zero)
        else:
            pick = F.greatest if kind == "max" else F.least
            final[name] = pick(F.col(lo), F.col(ca))
    carry = d.groupBy(*keys).agg(*totals).select(*keys, *carried)
    out = d.withColumns(local).join(carry, keys, "left").withColumns(final)
    return out.drop(CH, *local, *[f"__c_{n}" for n in aggs])


def framed(df: DataFrame, by: list[str], order: list[str], chunk: Column, before: int,
           aggs: dict[str, Column], block: int, include_current: bool = True) -> DataFrame:
    """Aggregates over the last ``before`` rows of an unbounded series.

    Rows get their exact position, are grouped into blocks of ``block`` rows, and the last ``before`` rows of a block
    are also sent to the next one, so every frame is complete inside a block. ``aggs`` are aggregate columns.
    """
    if block < before:
        raise ValueError("block must be at least as long as the frame")
    pos = running(df.withColumn("__one", F.lit(1)), by, order, chunk, {"__pos": ("count", F.col("__one"))})
    home = F.floor((F.col("__pos") - 1) / block)
    inner = (F.col("__pos") - 1) % block
    both = F.when(inner >= block - before, F.array(home, home + 1)).otherwise(F.array(home))
    rows = pos.withColumn("__home", home).withColumn("__blk", F.explode(both))
    end = 0 if include_current else -1
    w = Window.partitionBy(*by, "__blk").orderBy("__pos").rowsBetween(end - before + 1, end)
    out = rows.withColumns({n: a.over(w) for n, a in aggs.items()})
    return out.filter(F.col("__blk") == F.col("__home")).drop("__pos", "__home", "__blk", "__one")


SPREAD = 4096


def spread(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """A row for each number from low to high, blocks first and then their members, so that no array is longer than SPREAD."""
    blocks = F.sequence(F.floor(low / SPREAD).cast("long"), F.floor(high / SPREAD).cast("long"))
    b = F.col("__block") * SPREAD
    inside = F.sequence(F.greatest(low, b), F.least(high, b + (SPREAD - 1)))
    return df.withColumn("__block", F.explode(blocks)).withColumn(name, F.explode(inside)).drop("__block")


#: A value range is to hold so many rows; there are at least FEWEST and at most MOST ranges.
RANGE_ROWS = 1_000_000
FEWEST_RANGES, MOST_RANGES = 32, 4096
FAN = 64


def value_cuts(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Approximate equal-count cut points of a numeric column, as many as its rows ask for: at most MOST_RANGES numbers on the
    driver. A range, and so any group's part of it, then holds about RANGE_ROWS rows."""
    grid = buckets or MOST_RANGES
    qs = [k / grid for k in range(1, grid)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), qs, max(1000, 4 * grid)).alias("q"), F.count(value).alias("n")).first()
    q = sorted(row["q"] or [])
    ranges = grid if buckets else min(grid, max(FEWEST_RANGES, -(-row["n"] // RANGE_ROWS)))
    return [q[k * grid // ranges - 1] for k in range(1, ranges)] if q else []


def value_bucket(value: Column, cuts: list[float]) -> Column:
    """2 * (cuts below the value), plus 1 where the value IS a cut: a heavy value gets a bucket of its own."""
    uniq = sorted(set(cuts))
    if not uniq:
        return F.lit(0)
    if len(uniq) <= FAN:
        below = reduce(lambda a, b: a + b, [F.when(value > c, 2).otherwise(0) for c in uniq])
        return below + F.when(value.isin(uniq), 1).otherwise(0)
    # in two steps: a run of cuts, then the place in it
    step = max(FAN, -(-len(uniq) // FAN))
    runs = [uniq[i:i + step] for i in range(0, len(uniq), step)]
    run = reduce(lambda a, b: a + b, [F.when(value > r[-1], 1).otherwise(0) for r in runs[:-1]])
    own = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in runs]), run + 1)
    return 2 * (run * step + F.size(F.filter(own, lambda c: c < value))) + F.when(F.array_contains(own, value), 1).otherwise(0)


def _with_buckets(df: DataFrame, value: str, tie: str, buckets: int | None) -> DataFrame:
    """__b by value; __s splits a heavy single-value bucket further by the numeric tie column."""
    cuts = value_cuts(df, value, buckets)
    v = F.col(value).cast("double")
    heavy = sorted({c for c in cuts if cuts.count(c) > 1})
    sub = F.lit(0)
    if heavy:
        tie_cuts = value_cuts(df.filter(v.isin(heavy)), tie, buckets)
        sub = F.when(v.isin(heavy), value_bucket(F.col(tie).cast("double"), tie_cuts)).otherwise(0)
    return df.withColumn("__b", value_bucket(v, cuts)).withColumn("__s", sub)


def ranked(df: DataFrame, by: list[str], value: str, tie: str, buckets: int | None = None) -> DataFrame:
    """Exact ``rn`` (row number by value, tie), ``rk`` (rank by value) and ``n`` (rows) per ``by``.

    ``value`` and ``tie`` are numeric and not NULL, ``tie`` makes rows unique. ``by`` may be empty: the global order is
    found without a single-task sort.
    """
    d = _with_buckets(df, value, tie, buckets)
    keys = [*by, "__b", "__s"]
    w = Window.partitionBy(*keys).orderBy(value, tie)
    wr = Window.partitionBy(*keys).orderBy(value)
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = part.orderBy("__b", "__s").rowsBetween(UNB, -1)
    offs = counts.select(
        *keys,
        F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__off"),
        F.sum("__k").over(part).alias("n"),
    )
    wb = (Window.partitionBy(*by, "__b") if by else Window.partitionBy("__b"))
    offs = offs.withColumn("__boff", F.min("__off").over(wb))
    heavy = F.col("__s") > 0
    return (
        d.withColumn("__rn", F.row_number().over(w).cast("long"))
        .withColumn("__rk", F.rank().over(wr).cast("long"))
        .join(offs, keys)
        .withColumn("rn", F.col("__off") + F.col("__rn"))
        .withColumn("rk", F.when(heavy | (F.col("__boff") != F.col("__off")), F.col("__boff") + 1)
                    .otherwise(F.col("__off") + F.col("__rk")))
        .drop("__b", "__s", "__rn", "__rk", "__off", "__boff")
    )


def ntile_of(rn: Column, n: Column, tiles: int) -> Column:
    """The NTILE(tiles) number of row ``rn`` out of ``n``."""
    q = F.floor(n / tiles)
    r = n % tiles
    wide = r * (q + 1)
    return F.when(rn <= wide, F.floor((rn - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((rn - 1 - wide) / F.greatest(q, F.lit(1))) + 1
    ).cast("long")


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float],
                    buckets: int | None = None) -> DataFrame:
    """Continuous quantiles per ``by`` with linear interpolation, one row per group.

    Only order statistics are kept: rows equal in value are counted first, so a heavy value costs one row, and a group
    is never gathered in one task. ``qs`` maps output names to probabilities.
    """
    v = F.col(value).cast("double")
    distinct = df.filter(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    cuts = value_cuts(df.filter(v.isNotNull()), value, buckets)
    d = distinct.withColumn("__b", value_bucket(F.col("__v"), cuts))
    keys = [*by, "__b"]
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    tot = d.groupBy(*keys).agg(F.sum("__c").alias("__k"))
    tot = tot.select(
        *keys, "__k",
        F.coalesce(F.sum("__k").over(part.orderBy("__b").rowsBetween(UNB, -1)), F.lit(0)).alias("__off"),
        F.sum("__k").over(part).alias("__n"),
    )
    # the two neighbouring order statistics of every probability
    wanted = {}
    for name, q in qs.items():
        p = (F.col("__n") - 1) * F.lit(float(q))
        wanted[name] = (F.floor(p), F.ceil(p), p - F.floor(p))
    hit = F.lit(False)
    for lo, hi, _ in wanted.values():
        for x in (lo, hi):
            hit = hit | ((x >= F.col("__off")) & (x < F.col("__off") + F.col("__k")))
    target = tot.filter(hit).select(*keys, "__off", "__n")
    wb = Window.partitionBy(*keys).orderBy("__v").rowsBetween(UNB, 0)
    pos = (
        d.join(target, keys)
        .withColumn("__end", F.col("__off") + F.sum("__c").over(wb))
        .withColumn("__beg", F.col("__end") - F.col("__c"))
    )
    outs, parts = [], []
    for name, (lo, hi, frac) in wanted.items():
        at = lambda x: F.max(F.when((x >= F.col("__beg")) & (x < F.col("__end")), F.col("__v")))
        parts += [at(lo).alias(f"__lo_{name}"), at(hi).alias(f"__hi_{name}"), F.max(frac).alias(f"__f_{name}")]
        a, b, f = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__f_{name}")
        outs.append((a + (b - a) * f).alias(name))
    return pos.groupBy(*by).agg(*parts).select(*by, *outs)
