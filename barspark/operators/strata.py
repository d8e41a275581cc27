"""Aggregation and stratification of trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.aggregates import clipped_profit_factor, count_if, profit_factor, win_rate
from barspark.functions.scalars import div
from barspark.operators.prefix import exact_quantiles, ntile_of, ranked, running, value_bucket, value_cuts
from barspark.session import stored

RET = "ret"


def summary(ret: Column | None = None) -> list[Column]:
    ret = F.col(RET) if ret is None else ret
    return [F.count(F.lit(1)).alias("n"), profit_factor(ret).alias("pf"), clipped_profit_factor(ret).alias("pf_clip"),
            win_rate(ret).alias("win"), F.avg(ret).alias("mean_ret")]


def distribution(trips: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """Count, win rate, mean, exact median, total, extremes per group."""
    r = F.col(ret)
    a = trips.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), win_rate(r).alias("win"), F.avg(r).alias("mean_ret"),
                               F.sum(r).alias("total_ret"), F.min(r).alias("min_ret"), F.max(r).alias("max_ret"))
    return a.join(exact_quantiles(trips, by, ret, {"median_ret": 0.5}), by)


def era_metrics(trips: DataFrame, by: list[str], split: Column) -> DataFrame:
    """Metrics of the rows before and after a split, side by side."""
    return trips.groupBy(*by).agg(
        count_if(~split).alias("n_pre"), profit_factor(F.col(RET), ~split).alias("pf_pre"),
        count_if(split).alias("n_post"), profit_factor(F.col(RET), split).alias("pf_post"))


def bands(value: Column, edges: list[float]) -> Column:
    """Label of the half-open band [e_k, e_k+1) that holds the value, open-ended on both sides; NULL stays NULL."""
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(value < edges[k], F.lit(k)).otherwise(out)
    return F.when(value.isNotNull(), out)


def tiles(trips: DataFrame, value: str, tie: str, n: int, out: str = "tile", by: list[str] | None = None) -> DataFrame:
    """Equal-count buckets over the whole population, exact, without a single-task sort."""
    r = ranked(trips, by or [], value, tie)
    return r.withColumn(out, ntile_of(F.col("rn"), F.col("n"), n)).drop("rn", "rk", "n")


def quantile_bins(trips: DataFrame, value: str, probs: list[float], out: str) -> DataFrame:
    """Buckets by exact quantile cut values, upper edge inclusive and the lowest edge in the first bucket. The cuts
    are one small row that is broadcast to all tasks."""
    q = exact_quantiles(trips, [], value, {f"__q{i}": p for i, p in enumerate(probs)})
    x = trips.join(F.broadcast(q))
    v, b = F.col(value), F.lit(len(probs))
    for i in range(len(probs) - 1, -1, -1):
        b = F.when(v <= F.col(f"__q{i}"), F.lit(i)).otherwise(b)
    return x.withColumn(out, b).drop(*[f"__q{i}" for i in range(len(probs))])


def threshold_sweep(trips: DataFrame, value: str, grid: list[float], direction: str = "floor") -> DataFrame:
    """Metrics of the rows at or above (floor) / below (ceiling) each threshold.

    A row is not paired with every threshold: rows are pre-aggregated by the band between two neighbouring thresholds,
    and the few band totals are accumulated.
    """
    g = sorted(grid)
    band = bands(F.col(value), g)
    x = trips.withColumn("__band", band).filter(F.col("__band").isNotNull())
    clip = F.least(F.col(RET), F.lit(0.5))
    per = x.groupBy("__band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(RET) > 0, F.col(RET))).alias("up"), F.sum(F.when(F.col(RET) < 0, -F.col(RET))).alias("dn"),
        F.sum(F.when(F.col(RET) > 0, clip)).alias("upc"), F.sum(F.when(F.col(RET) > 0, 1)).alias("w"), F.sum(F.col(RET)).alias("s"))
    # from here on there are at most len(grid) + 1 rows: a band counts for every threshold below (above) it
    last, k = len(g) - 1, F.col("__band")
    if direction == "floor":
        hits = per.filter(k > 0).withColumn("__k", F.explode(F.sequence(F.lit(0), k - 1)))
    else:
        hits = per.filter(k <= last).withColumn("__k", F.explode(F.sequence(k, F.lit(last))))
    tot = hits.groupBy("__k").agg(*[F.sum(c).alias(c) for c in ("n", "up", "dn", "upc", "w", "s")])
    grid_rows = trips.sparkSession.createDataFrame(list(enumerate(float(v) for v in g)), "__k int, threshold double")
    a = grid_rows.join(tot, "__k", "left")
    return a.select("threshold", F.coalesce("n", F.lit(0)).alias("n"), div(F.col("up"), F.col("dn")).alias("pf"),
                    div(F.col("upc"), F.col("dn")).alias("pf_clip"), div(F.coalesce("w", F.lit(0)), F.col("n")).alias("win"),
                    div(F.col("s"), F.col("n")).alias("mean_ret"))


def grid_2d(trips: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Profit factor and count per cell, one output row per row bucket."""
    g = trips.groupBy(rows).pivot(cols, values).agg(profit_factor(F.col(RET)).alias("pf"), F.count(F.lit(1)).alias("n"))
    return g


def concentration(trips: DataFrame, by: list[str], tie: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Profit factor without the k best trips and the k best trips' share of gross wins, per group.

    The best rank is exact; a hot group is split over value ranges.
    """
    neg = trips.withColumn("__neg", -F.col("ret"))
    r = ranked(neg, by, "__neg", tie)
    win = F.sum(F.when(F.col(RET) > 0, F.col(RET)))
    aggs = [F.count(F.lit(1)).alias("n_trips"), profit_factor(F.col(RET)).alias("pf_all")]
    for k in ks:
        aggs.append(profit_factor(F.col(RET), F.col("rn") > k).alias(f"pf_ex{k}"))
        aggs.append(div(F.sum(F.when((F.col("rn") <= k) & (F.col(RET) > 0), F.col(RET))), win).alias(f"top{k}_share"))
    return r.groupBy(*by).agg(*aggs)


def ablation(trips: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """The population under all gates and with each gate removed, in one pass: a row is counted for the variants that
    keep it, through conditional aggregates instead of a union of scans."""
    names = list(gates)
    flags = {f"__g{i}": F.coalesce(gates[n], F.lit(False)) for i, n in enumerate(names)}
    x = trips.withColumns(flags)
    fails = sum((F.when(F.col(f), 0).otherwise(1) for f in flags), F.lit(0))
    x = x.withColumn("__fails", fails)
    variants = [("all", F.col("__fails") == 0)]
    variants += [(f"no_{n}", (F.col("__fails") == 0) | ((F.col("__fails") == 1) & ~F.col(f"__g{i}")))
                 for i, n in enumerate(names)]
    aggs = []
    for name, keep in variants:
        aggs += [F.sum(F.when(keep, 1).otherwise(0)).alias(f"n__{name}"), profit_factor(F.col(RET), keep).alias(f"pf__{name}"),
                 F.avg(F.when(keep, F.col(RET))).alias(f"mean__{name}")]
    one = x.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"n__{v}").alias("n"), F.col(f"pf__{v}").alias("pf"),
                              F.col(f"mean__{v}").alias("mean_ret")) for v, _ in variants])
    return one.select(F.inline(rows))


def worst(trips: DataFrame, symbol: str, date: str) -> DataFrame:
    """Worst trip, worst symbol-day and worst day by net P&L."""
    sd = trips.groupBy(symbol, date).agg(F.sum("net_pnl").alias("p"), F.min("net_pnl").alias("t"))
    d = sd.groupBy(date).agg(F.sum("p").alias("dp"), F.min("p").alias("sp"), F.min("t").alias("tp"))
    return d.agg(F.min("tp").alias("worst_trip"), F.min("sp").alias("worst_symbol_day"), F.min("dp").alias("worst_day"))


def calendar_pnl(trips: DataFrame, parts: dict[str, Column]) -> DataFrame:
    return trips.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("net_pnl").alias("pnl"), win_rate(F.col(RET)).alias("win"))


def equity_curve(trips: DataFrame, date: str) -> DataFrame:
    """Daily P&L, cumulative equity and drawdown; the ordered part is one row per day."""
    d = trips.groupBy(F.col(date).alias("day")).agg(F.sum("net_pnl").alias("pnl"))
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    e = d.withColumn("equity", F.sum("pnl").over(w))
    return e.withColumn("drawdown", F.max("equity").over(w) - F.col("equity"))


def monthly_mark_to_market(trips: DataFrame, anchors: DataFrame, side: int = 1) -> DataFrame:
    """P&L of each trip by calendar month: price moves between month anchors, fees half at either end, funding by days.

    ``trips``: trip_id, symbol, entry_date, exit_date, entry_price, exit_price, qty, fees, funding. ``anchors``: symbol,
    month, anchor_close (the price at the month's start). Months of a trip sum to its net P&L.
    """
    em, xm = F.trunc("entry_date", "month"), F.trunc("exit_date", "month")
    t = trips.withColumns({"em": em, "xm": xm, "days": F.datediff("exit_date", "entry_date") + 1})
    e = t.withColumn("month", F.explode(F.sequence("em", "xm", F.expr("interval 1 month"))))
    e = e.withColumn("next_month", F.add_months("month", 1))
    a0 = anchors.select("symbol", "month", F.col("anchor_close").alias("a0"))
    a1 = anchors.select("symbol", F.col("month").alias("next_month"), F.col("anchor_close").alias("a1"))
    j = e.join(a0, ["symbol", "month"], "left").join(a1, ["symbol", "next_month"], "left")
    first, last = F.col("month") == F.col("em"), F.col("month") == F.col("xm")
    p0 = F.when(first, F.col("entry_price")).otherwise(F.col("a0"))
    p1 = F.when(last, F.col("exit_price")).otherwise(F.col("a1"))
    fee = F.when(first & last, F.col("fees")).when(first | last, F.col("fees") / 2.0).otherwise(0.0)
    d0 = F.when(first, F.col("entry_date")).otherwise(F.col("month"))
    d1 = F.when(last, F.col("exit_date")).otherwise(F.date_sub("next_month", 1))
    share = (F.datediff(d1, d0) + 1) / F.col("days")
    pnl = (p1 - p0) * F.col("qty") * side - fee + F.col("funding") * share
    return j.select("trip_id", "symbol", "month", pnl.alias("month_pnl"))


def daily_level(trips: DataFrame, by: list[str], entry: str, exit_: str, notional: str) -> DataFrame:
    """Notional open on each calendar day per ``by``, trips being held over [entry, exit).

    Trips are reduced to the net change per day before the ordered part, which is one row per day; days without
    events carry the level.
    """
    d = trips.select(*by, F.explode(F.array(
        F.struct(F.col(entry).alias("day"), F.col(notional).alias("dn")),
        F.struct(F.col(exit_).alias("day"), (-F.col(notional)).alias("dn")),
    )).alias("e")).groupBy(*by, F.col("e.day").alias("day")).agg(F.sum("e.dn").alias("dn"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = part.orderBy("day")
    nxt = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day"))
    lev = d.withColumn("level", F.sum("dn").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__to", nxt)
    before = F.coalesce(F.lag("level").over(w), F.lit(0.0))
    lev = lev.withColumn("carried", before)
    days = lev.withColumn("__d", F.explode(F.sequence("day", "__to", F.expr("interval 1 day"))))
    return days.select(*by, F.col("__d").alias("day"), "level",
                       F.when(F.col("__d") == F.col("day"), F.col("carried")).otherwise(F.col("level")).alias("carried"))


def concurrent_exposure(trips: DataFrame, entry: str, exit_: str, notional: str) -> DataFrame:
    """Peak notional per calendar day: the level carried into the day or the level after its releases and entries."""
    x = daily_level(trips, [], entry, exit_, notional)
    return x.select("day", F.greatest("carried", "level").alias("max_notional"), "level")


def return_on_capital(daily: DataFrame, total_pnl: DataFrame, years: float) -> DataFrame:
    """Annual return on the peak, p99, p95 and mean of the daily exposure (one row per day)."""
    q = exact_quantiles(daily, [], "max_notional", {"p99": 0.99, "p95": 0.95})
    b = daily.agg(F.max("max_notional").alias("peak"), F.avg("max_notional").alias("mean"))
    x = b.join(F.broadcast(q)).join(F.broadcast(total_pnl))
    return x.select("total_pnl", *[F.col(c).alias(f"base_{c}") for c in ("peak", "p99", "p95", "mean")],
                    *[div(F.col("total_pnl"), F.col(c) * years).alias(f"roc_{c}") for c in ("peak", "p99", "p95", "mean")])


def min_bucket(a: Column, a_cuts: tuple[float, float], b: Column, b_cuts: tuple[float, float]) -> Column:
    """The lower of two tercile numbers (1..3)."""
    t = lambda v, c: F.when(v < c[0], 1).when(v < c[1], 2).otherwise(3)
    return F.least(t(a, a_cuts), t(b, b_cuts))


def symbol_profile(trips: DataFrame, symbol: str, top: int | None = None) -> DataFrame:
    """Per symbol trips, P&L, share of total and rank. Ranking happens on one row per symbol."""
    s = trips.groupBy(symbol).agg(F.count(F.lit(1)).alias("n"), F.sum("net_pnl").alias("pnl"))
    tot = trips.agg(F.sum("net_pnl").alias("__tot"))
    x = s.join(F.broadcast(tot)).withColumn("share", div(F.col("pnl"), F.col("__tot"))).drop("__tot")
    return x.orderBy(F.desc("pnl"), symbol).limit(top) if top else x


def excursion(trips_bars: DataFrame, edges: list[float]) -> DataFrame:
    """Trips by band of maximum favourable (mfe) and adverse (mae) excursion."""
    x = trips_bars.withColumns({"mfe_band": bands(F.col("mfe"), edges), "mae_band": bands(F.col("mae"), edges)})
    return x.groupBy("mfe_band", "mae_band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(RET)).alias("mean_ret"))


def size_cdf(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles of a size distribution, and the mean sizes under and from the median on.

    Equal sizes combine before the shuffle, so a group costs one row per distinct size; a quantile is the least size up to
    which at least that share of the rows lies.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__k"))
    hist = stored(hist.withColumn("__v", F.col(value).cast("double")))
    # running counts in value ranges, so that a group of many distinct sizes is not one task
    c = running(hist, by, ["__v"], value_bucket(F.col("__v"), value_cuts(hist, "__v")), {"__c": ("sum", F.col("__k"))})
    n = hist.groupBy(*by).agg(F.sum("__k").alias("__n"))
    c = stored(c.join(n, by))
    at = lambda p: F.min(F.when(F.col("__c") >= F.ceil(F.col("__n") * float(p)), F.col(value)))
    q = stored(c.groupBy(*by).agg(F.max("__n").alias("n"), F.array(*map(at, probs)).alias("q"), at(0.5).alias("__mid")))
    under = F.col(value) < F.col("__mid")
    half = lambda w: div(F.sum(F.when(w, F.col(value) * F.col("__k"))), F.sum(F.when(w, F.col("__k"))))
    means = c.join(q.select(*by, "__mid"), by).groupBy(*by).agg(half(under).alias("mean_under"), half(~under).alias("mean_from"))
    return q.drop("__mid").join(means, by)


#: Entries a level of a sketch keeps; a quantile's rank errs by RANK_ERROR of the rows at most (99 % of the time per quantile).
SKETCH_K = 800
RANK_ERROR = 0.0055


def size_sketches(df: DataFrame, by: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """One bounded sketch of the values per group (``sketch``, some kilobytes, whatever the rows): for a column of a day's table,
    merged upward later. NULLs are left out."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str], probs: dict[str, float], k: int = SKETCH_K) -> DataFrame:
    """Per coarser group: ``n`` values and the quantiles named in ``probs``, each within RANK_ERROR in rank, in whatever order and
    however often sketches have been merged before."""
    one = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return one.select(*by, "sketch", F.kll_sketch_get_n_double("sketch").alias("n"), *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(c) for c, p in probs.items()])


def feature_breakdown(trips: DataFrame, feature: str, tie: str, nb: int = 5, edges: list[float] | None = None,
                      by: list[str] | None = None) -> DataFrame:
    """Per feature bucket: count, win rate, dollar profit factors raw and with the return capped at +50 %, nets.

    Without ``edges`` the cut k is the sorted value at int(n*k/nb).
    """
    x = trips.filter(F.col(feature).isNotNull())
    if edges is None:
        r = ranked(x, [], feature, tie)
        at = {f"__e{k}": F.max(F.when(F.col("rn") - 1 == F.floor(F.col("n") * k / nb), F.col(feature))) for k in range(1, nb)}
        cuts = r.agg(*[c.alias(n) for n, c in at.items()])
        x = x.join(F.broadcast(cuts))
        b = sum((F.when(F.col(feature) >= F.col(n), 1).otherwise(0) for n in at), F.lit(0))
    else:
        b = sum((F.when(F.col(feature) >= e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    clip = F.col("qty") * F.col("entry_price") * F.least(F.col(RET), F.lit(0.5))
    net = F.col("net_pnl")
    x = x.withColumn("bucket", b).withColumn("__clip", clip)
    pf = lambda c: div(F.sum(F.when(c > 0, c)), F.sum(F.when(c < 0, -c)))
    return x.groupBy(*(by or []), "bucket").agg(
        F.count(F.lit(1)).alias("n"), win_rate(F.col(RET)).alias("win"), pf(net).alias("pf_raw"), pf(F.col("__clip")).alias("pf_clip"),
        F.sum(net).alias("net_raw"), F.sum("__clip").alias("net_clip"))


def labelled(books: dict[str, DataFrame]) -> DataFrame:
    """Union of trip sets under their labels."""
    out = None
    for name, df in books.items():
        d = df.withColumn("label", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def yearly_table(trips: DataFrame, label: str, year: Column) -> DataFrame:
    """Per label and year, and per label over all years (year null): count, net, win rate, profit factor raw and clipped."""
    x = trips.withColumn("yr", F.explode(F.array(year.cast("int"), F.lit(None).cast("int"))))
    return x.groupBy(label, "yr").agg(*summary(), F.sum("net_pnl").alias("pnl"))


def run_summary(trips: DataFrame) -> DataFrame:
    net = F.col("net_pnl")
    return trips.agg(F.count(F.lit(1)).alias("trips"), win_rate(net).alias("win"), F.sum(net).alias("net"),
                     div(F.sum(F.when(net > 0, net)), F.sum(F.when(net < 0, -net))).alias("pf"))
