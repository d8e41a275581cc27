"""Rolling, cumulative and session indicators as window columns.

Every function takes the ordered series as a ``Series`` (partition and order columns). A series is one key's *bars*:
at most one row per key and calendar bucket, so its length is set by the calendar and not by how many trades the key
has. For series of raw trades use ``barspark.operators.prefix``, which splits a hot key over time chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barspark.functions.scalars import pct

UNB = Window.unboundedPreceding
FOL = Window.unboundedFollowing


@dataclass(frozen=True)
class Series:
    by: tuple[str, ...]
    order: tuple[str, ...]

    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, n: int, inclusive: bool = False) -> WindowSpec:
        """The last n rows, ending at the current row or (no lookahead) at the row before it."""
        end = 0 if inclusive else -1
        return self.spec().rowsBetween(end - n + 1, end)

    def sofar(self, inclusive: bool = True) -> WindowSpec:
        return self.spec().rowsBetween(UNB, 0 if inclusive else -1)

    def ahead(self, n: int | None = None) -> WindowSpec:
        return self.spec().rowsBetween(1, FOL if n is None else n)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    def sub(self, *extra: str) -> Series:
        return Series((*self.by, *extra), self.order)


def rolling_sum(s: Series, c: Column, n: int, inclusive: bool = False) -> Column:
    return F.sum(c).over(s.last(n, inclusive))


def rolling_mean(s: Series, c: Column, n: int, inclusive: bool = False) -> Column:
    return F.avg(c).over(s.last(n, inclusive))


def rolling_max(s: Series, c: Column, n: int, inclusive: bool = False) -> Column:
    return F.max(c).over(s.last(n, inclusive))


def rolling_min(s: Series, c: Column, n: int, inclusive: bool = False) -> Column:
    return F.min(c).over(s.last(n, inclusive))


BASE_FRAME = 16


def with_extremes(df: DataFrame, s: Series, specs: dict[str, tuple[str, Column, int, bool]]) -> DataFrame:
    """Rolling max/min columns: name -> (``max`` | ``min``, column, rows, inclusive).

    Spark re-evaluates a sliding frame for every row, so a long one costs O(rows * n). Here a short frame is widened by
    doubling: the extreme of 2w rows is that of the last w and of the w before them, which is a lag. A frame of 252 rows
    takes four lags over the same sort order.
    """
    agg, best = {"max": F.max, "min": F.min}, {"max": F.greatest, "min": F.least}
    width = {k: min(v[2], BASE_FRAME) for k, v in specs.items()}
    out = df.withColumns({k: agg[kind](c).over(s.last(width[k], inc)) for k, (kind, c, n, inc) in specs.items()})
    while True:
        grow = {k: min(width[k], n - width[k]) for k, (_, _, n, _) in specs.items() if width[k] < n}
        if not grow:
            return out
        out = out.withColumns({
            k: best[specs[k][0]](F.col(k), F.lag(k, step).over(s.spec())) for k, step in grow.items()
        })
        width = {k: w + grow.get(k, 0) for k, w in width.items()}


def running_max(s: Series, c: Column, inclusive: bool = True) -> Column:
    return F.max(c).over(s.sofar(inclusive))


def running_min(s: Series, c: Column, inclusive: bool = True) -> Column:
    return F.min(c).over(s.sofar(inclusive))


def running_ratio(s: Series, num: Column, den: Column, inclusive: bool = True) -> Column:
    """Cumulative num over cumulative den, NULL until the denominator is positive (session VWAP)."""
    w = s.sofar(inclusive)
    d = F.sum(den).over(w)
    return F.when(d > 0, F.sum(num).over(w) / d)


def lag(s: Series, c: Column, n: int = 1) -> Column:
    return F.lag(c, n).over(s.spec())


def lead(s: Series, c: Column, n: int = 1) -> Column:
    return F.lead(c, n).over(s.spec())


def pct_change(s: Series, c: Column, n: int = 1) -> Column:
    return pct(c, lag(s, c, n))


def calendar_mean(by: tuple[str, ...], date: str, c: Column, days: int = 28) -> Column:
    """Mean over the rows dated ``days`` to 1 calendar days before the row's date."""
    day = F.unix_date(F.col(date))
    return F.avg(c).over(Window.partitionBy(*by).orderBy(day).rangeBetween(-days, -1))


def bar_index(s: Series) -> Column:
    """0-based position in the series."""
    return F.row_number().over(s.spec()) - 1


#: Bars that a fold of an exponential mean appends to one array.
FOLD = 16


def _folded(xs: Column, alpha: float) -> Column:
    """e + alpha * (x - e) along an array of doubles, block by block so that no array grows bar by bar beyond FOLD."""
    def last(a: Column) -> Column:
        return F.get(a, F.size(a) - 1)

    def block(done: Column, at: Column) -> Column:
        seed = F.array(last(last(done)))
        step = lambda acc, x: F.concat(acc, F.array(F.coalesce(last(acc) + F.lit(alpha) * (x - last(acc)), x, last(acc))))
        return F.concat(done, F.array(F.slice(F.aggregate(F.slice(xs, at, F.lit(FOLD)), seed, step), F.lit(2), F.lit(FOLD))))

    starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(FOLD))
    return F.flatten(F.aggregate(starts, F.array().cast("array<array<double>>"), block))


def with_emas(df: DataFrame, s: Series, specs: dict[str, tuple[Column, int]]) -> DataFrame:
    """Exponential means: name -> (column, period); alpha = 2 / (period + 1), seeded with the first value that is not null.

    They are the recursion itself, rounded as it rounds: a mean of equal prices is that price, so comparisons with prices and
    with earlier means see ties. A series' bars are gathered once for all of them (the order must be unique in it). A null leaves the mean.
    """
    keep = [c for c in df.columns if c not in s.by and c not in s.order]
    xs = {f"__x_{k}": c.cast("double") for k, (c, _) in specs.items()}
    bar = F.struct(*s.order, *keep, *[c.alias(k) for k, c in xs.items()])
    g = df.groupBy(*s.by).agg(F.array_sort(F.collect_list(bar)).alias("__bars"))
    means = [_folded(F.col(f"__bars.__x_{k}"), 2.0 / (period + 1)).alias(k) for k, (_, period) in specs.items()]
    x = g.select(*s.by, "__bars", *means).select(*s.by, F.explode_outer(F.arrays_zip("__bars", *specs)).alias("__z"))
    of = {c: F.col(f"__z.__bars.{c}") for c in (*s.order, *keep)}
    return x.select(*[(F.col(c) if c in s.by else of[c]).alias(c) for c in df.columns], *[F.col(f"__z.{k}").alias(k) for k in specs])


def with_ema(df: DataFrame, s: Series, c: Column, period: int, out: str) -> DataFrame:
    """One of ``with_emas``."""
    return with_emas(df, s, {out: (c, period)})


def with_true_range(df: DataFrame, s: Series) -> DataFrame:
    """prev_close, tr_lin, tr_log; NULL on the first bar and where a price is not positive."""
    pc, h, lo = F.col("prev_close"), F.col("high"), F.col("low")
    ok = (h > 0) & (lo > 0) & (pc > 0)
    top, bottom = F.greatest(h, pc), F.least(lo, pc)
    return df.withColumn("prev_close", lag(s, F.col("close"))).withColumns(
        {"tr_lin": F.when(ok, top - bottom), "tr_log": F.when(ok, F.ln(top / bottom))}
    )


def ols_slope(s: Series, y: Column, x: Column, n: int, inclusive: bool = True) -> Column:
    """Least-squares slope of y on the bar index over the last n bars (NULL below two points)."""
    return F.regr_slope(y, x).over(s.last(n, inclusive))


def rolling_ols(df: DataFrame, s: Series, y: Column, x: Column, n: int, slope: str = "slope", r2: str = "r2") -> DataFrame:
    """Adds the least-squares slope and r2 of y on x over the last n bars, at a cost per bar that does not grow with n.

    A series is cut into blocks of n bars. A window is the end of one block and the beginning of the next, so it merges two sets
    of moments: those of the block up to the bar, and those of the block before from the window's first bar on. Both are running
    aggregates about their own means, so nothing is taken away again and large x or y cost no precision.
    """
    ok = y.isNotNull() & x.isNotNull()
    d = df.withColumns({"__at": F.row_number().over(s.spec()) - 1, "__y": F.when(ok, y.cast("double")), "__x": F.when(ok, x.cast("double"))})
    d = d.withColumn("__block", F.floor(F.col("__at") / n))
    own = Window.partitionBy(*s.by, "__block")
    zero = F.lit(0.0)

    def moments(w) -> Column:
        k = F.count("__y").over(w)
        spread = lambda c: F.coalesce(c.over(w), zero) * k
        return F.struct(k.cast("double").alias("k"), F.coalesce(F.avg("__x").over(w), zero).alias("mx"), F.coalesce(F.avg("__y").over(w), zero).alias("my"),
                        spread(F.var_pop("__x")).alias("xx"), spread(F.var_pop("__y")).alias("yy"), spread(F.covar_pop("__x", "__y")).alias("xy"))

    d = d.withColumns({"__pre": moments(own.orderBy("__at").rowsBetween(UNB, 0)), "__suf": moments(own.orderBy(F.desc("__at")).rowsBetween(UNB, 0))})
    whole = (F.col("__at") + 1) % n == 0  # the window is the block itself
    before = F.when(~whole, F.lag("__suf", n - 1).over(s.spec())) if n > 1 else F.lit(None).cast(d.schema["__suf"].dataType)
    d = d.withColumn("__b", before)
    a, b = (lambda f: F.col(f"__pre.{f}")), (lambda f: F.coalesce(F.col(f"__b.{f}"), zero))
    k = a("k") + b("k")
    both = a("k") * b("k") / F.nullif(k, zero)
    dx, dy = a("mx") - b("mx"), a("my") - b("my")
    sxx, syy, sxy = (a(f) + b(f) + F.coalesce(both * u * v, zero) for f, u, v in (("xx", dx, dx), ("yy", dy, dy), ("xy", dx, dy)))
    d = d.withColumns({"__sxx": sxx, "__syy": syy, "__sxy": sxy})
    some = F.col("__sxx") > 0
    fit = F.when(F.col("__syy") > 0, F.col("__sxy") * F.col("__sxy") / (F.col("__sxx") * F.col("__syy"))).otherwise(1.0)
    return d.withColumns({slope: F.when(some, F.col("__sxy") / F.col("__sxx")), r2: F.when(some, fit)}).select(*df.columns, slope, r2)


def bars_since(s: Series, event: Column, idx: Column) -> Column:
    """Bars since the latest event, 0 on the event bar, -1 before any event."""
    at = F.last(F.when(event, idx), ignorenulls=True).over(s.sofar())
    return F.coalesce(idx - at, F.lit(-1))


def latch(s: Series, event: Column, idx: Column) -> Column:
    """Bars since the FIRST event of the (sub-)series, -1 before it."""
    at = F.first(F.when(event, idx), ignorenulls=True).over(s.sofar())
    return F.coalesce(idx - at, F.lit(-1))


def islands(df: DataFrame, s: Series, cond: Column, out: str) -> DataFrame:
    """Number the maximal runs of equal ``cond`` inside a series."""
    flag = "__flag"
    t = df.withColumn(flag, F.coalesce(cond, F.lit(False)))
    change = F.when(F.col(flag) != F.lag(flag).over(s.spec()), 1).otherwise(0)
    return (
        t.withColumn("__chg", change)
        .withColumn(out, F.sum("__chg").over(s.sofar()))
        .drop(flag, "__chg")
    )


def run_length(df: DataFrame, s: Series, cond: Column, out: str) -> DataFrame:
    """Length of the run of true ``cond`` that ends at each bar; 0 where it is false."""
    flag, at = "__rl", "__at"
    t = df.withColumns({flag: F.coalesce(cond, F.lit(False)), at: F.row_number().over(s.spec())})
    ended = F.coalesce(F.last(F.when(~F.col(flag), F.col(at)), ignorenulls=True).over(s.sofar()), F.lit(0))
    return t.withColumn(out, (F.col(at) - ended).cast("long")).drop(flag, at)


def trailing_imbalance(by: tuple[str, ...], t: str, buy: Column, sell: Column, width: int) -> Column:
    """(buy - sell) / (buy + sell) over the last ``width`` time units, ending at the row."""
    w = Window.partitionBy(*by).orderBy(t).rangeBetween(-width + 1, 0)
    b, x = F.sum(buy).over(w), F.sum(sell).over(w)
    return F.when(b + x > 0, (b - x) / (b + x))


def window_arrays(df: DataFrame, s: Series, fields: list[str], before: int, after: int, out: str) -> DataFrame:
    """Fixed-length arrays of the rows around each bar, zero-padded, with a 1/0 mask.

    Adds ``{out}_{field}`` (before + 1 + after values, oldest first) and ``{out}_mask``.
    """
    w = s.spec().rowsBetween(-before, after)
    pos = "__pos"
    t = df.withColumn(pos, bar_index(s)).withColumn("__n", F.count(F.lit(1)).over(s.whole()))
    lead_pad = F.greatest(F.lit(before) - F.col(pos), F.lit(0)).cast("int")
    tail_pad = F.greatest(F.lit(after) - (F.col("__n") - 1 - F.col(pos)), F.lit(0)).cast("int")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    cols = {}
    for f in fields:
        vals = F.collect_list(F.col(f).cast("double")).over(w)
        cols[f"{out}_{f}"] = F.concat(zeros(lead_pad), vals, zeros(tail_pad))
    ones = F.array_repeat(F.lit(1.0), (F.lit(before + 1 + after) - lead_pad - tail_pad).cast("int"))
    cols[f"{out}_mask"] = F.concat(zeros(lead_pad), ones, zeros(tail_pad))
    return t.withColumns(cols).drop(pos, "__n")


def strided_picks(df: DataFrame, s: Series, field: str, strides: dict[str, tuple[int, int]]) -> DataFrame:
    """Multi-resolution history: for each name (stride, count) the values stride, 2*stride, ... bars back,
    oldest first, ending with the current bar; missing history is 0."""
    cols = {}
    for name, (stride, count) in strides.items():
        back = [F.coalesce(F.lag(field, stride * k).over(s.spec()), F.lit(0.0)) for k in range(count, 0, -1)]
        cols[name] = F.array(*back, F.col(field))
    return df.withColumns(cols)
