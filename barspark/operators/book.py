"""Order-book reconstruction and imbalance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.operators.asof import asof_join
from barspark.operators.prefix import exact_quantiles, running, spread, with_chunks
from barspark.session import stored


#: Points of one frame; a level that lives long costs a row a frame.
FRAME = 64


def _weights(depth: int, decay: float) -> list[float]:
    """Weight of a level is exp(-decay * level index)."""
    return [math.exp(-decay * i) for i in range(depth)]


def _ratio(b: Column, a: Column) -> Column:
    return F.when(b + a > 0, (b - a) / (b + a)).otherwise(0.0)


def snapshot_imbalance(book: DataFrame, depth: int, decay: float, out: str = "obi") -> DataFrame:
    """Weighted (bid - ask) / (bid + ask) over the first ``depth`` levels; a missing size is 0, an empty book gives 0."""
    w = _weights(depth, decay)
    side = lambda s: sum((F.coalesce(F.col(f"{s}_{i}_size"), F.lit(0.0)) * w[i] for i in range(depth)), F.lit(0.0))
    return book.withColumn(out, _ratio(side("bid"), side("ask")))


def seed_levels(book: DataFrame, by: list[str], depth: int, t: str = "ts") -> DataFrame:
    """The levels of snapshot rows as (by, ts, side_is_bid, price, size); empty levels are left out."""
    level = lambda s, i: F.struct(F.lit(s == "bid").alias("side_is_bid"), F.col(f"{s}_{i}_price").cast("double").alias("price"),
                                  F.col(f"{s}_{i}_size").cast("double").alias("size"))
    all_ = F.array(*[level(s, i) for s in ("bid", "ask") for i in range(depth)])
    out = book.select(*by, F.col(t).alias("ts"), F.explode(all_).alias("l")).select(*by, "ts", "l.*")
    return out.filter(F.col("price").isNotNull() & (F.col("size") > 0))


def delta_imbalance(deltas: DataFrame, by: list[str], cadence: int, depth: int, decay: float, seeds: DataFrame | None = None,
                    t: str = "ts", seq: str = "seq", starts: DataFrame | None = None) -> DataFrame:
    """Imbalance of the live book at every ``cadence`` point, quiet ones too (size 0 removes a level).

    ``seeds`` (of ``seed_levels``) are the levels a key starts from and ``starts`` (by, ts) the times of the snapshots, which
    an empty one has too (by default those of the levels); a key's points count from its snapshot's time and earlier updates
    are left out. A key without a snapshot starts empty, at the multiple of the cadence before its first update. A point
    sees the updates strictly before it; the last one follows the last update, and a key without updates has no points.

    Updates are reduced to the last size per (side, price, interval) on the map side. A size holds until the level's next
    one, so a level is live on a range of points. Points are cut into frames of FRAME: a frame has the book at its start and
    its own changes, as two arrays by price, and each of its points takes the first ``depth`` levels of them that are live. Rows
    are levels per frame and points, never levels per point.
    """
    lvl = [*by, "side_is_bid", "price"]
    start = deltas.groupBy(*by).agg((F.floor(F.min(t) / cadence) * cadence).cast("long").alias("__t0"))
    starts = seeds if starts is None else starts
    if starts is not None:
        given = starts.groupBy(*by).agg(F.min("ts").cast("long").alias("__given"))
        start = start.join(given, by, "left").select(*by, F.coalesce("__given", "__t0").alias("__t0"))
    d = deltas.join(start, by).filter(F.col(t) >= F.col("__t0"))
    d = d.withColumn("k", (F.floor((F.col(t) - F.col("__t0")) / cadence) + 1).cast("long"))
    last = d.groupBy(*lvl, "k").agg(F.max_by("size", F.struct(F.col(t), F.col(seq))).cast("double").alias("size"))
    ends = d.groupBy(*by).agg(F.max("k").alias("__end"), F.first("__t0").alias("__t0"))
    if seeds is not None:
        last = last.unionByName(seeds.select(*lvl, F.lit(0).cast("long").alias("k"), F.col("size").cast("double").alias("size")))
    until = F.lead("k").over(Window.partitionBy(*lvl).orderBy("k"))
    held = last.withColumn("__to", until).join(ends, by).filter(F.col("size") > 0)
    held = held.withColumns({"__lo": F.greatest(F.col("k"), F.lit(1).cast("long")), "__hi": F.coalesce(F.col("__to") - 1, F.col("__end"))})
    # a level is on every frame that it is live in: the book at a frame's start and the frame's own changes
    held = held.filter(F.col("__lo") <= F.col("__hi"))
    framed = spread(held, F.floor(F.col("__lo") / FRAME).cast("long"), F.floor(F.col("__hi") / FRAME).cast("long"), "__f")
    near = F.when(F.col("side_is_bid"), -F.col("price")).otherwise(F.col("price"))
    level = F.struct(near.alias("near"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), F.col("size").alias("size"))
    book = lambda s: F.sort_array(F.collect_list(F.when(F.col("side_is_bid") == s, level)))
    frames = framed.groupBy(*by, "__f").agg(book(True).alias("__bids"), book(False).alias("__asks"))
    weights = F.array(*map(F.lit, _weights(depth, decay)))

    def point(k: Column) -> Column:
        """The point's book needs no row a level: its levels are those of the frame that cover it, best first."""
        live = lambda c: F.filter(c, lambda x: (x["lo"] <= k) & (x["hi"] >= k))
        best = lambda c: F.aggregate(F.zip_with(F.slice(live(c), 1, depth), weights, lambda x, w: F.coalesce(x["size"] * w, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        return F.struct(k.alias("__k"), best("__bids").alias("b"), best("__asks").alias("a"), F.size(live("__bids")).alias("nb"), F.size(live("__asks")).alias("na"))

    per = frames.select(*by, F.explode(F.transform(F.sequence(F.col("__f") * FRAME, F.col("__f") * FRAME + (FRAME - 1)), point)).alias("p"))
    per = per.select(*by, "p.__k", _ratio(F.col("p.b"), F.col("p.a")).alias("obi"), F.col("p.nb").alias("bid_levels"), F.col("p.na").alias("ask_levels"))
    grid = spread(ends, F.lit(1).cast("long"), F.col("__end"), "__k").select(*by, "__k", (F.col("__t0") + F.col("__k") * cadence).alias("sample"))
    out = grid.join(per, [*by, "__k"], "left").drop("__k")
    return out.select(*by, "sample", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("obi", "bid_levels", "ask_levels")))


def _segments(events: DataFrame, by: list[str], chunk: int, t: str, seq: str):
    """The replay that deltas and prints share: order messages with what was taken before them in their segment, one row per
    segment that rests something, those not used up, the clears, and which messages start a segment or take from one."""
    clears = events.filter(F.col("action") == "R").select(*by, F.col(t).alias("__rt"), F.col(seq).alias("__rs"))
    w = Window.partitionBy(*by).orderBy("__rt", "__rs")
    clears = clears.withColumn("epoch", F.row_number().over(w))  # a handful per venue and day
    key = lambda x, y: F.struct(F.col(x).alias("t"), F.col(y).alias("s"))
    ev = events.filter(F.col("action").isin("A", "C", "M", "F")).withColumn("__k", key(t, seq))
    ev = asof_join(ev, clears.withColumn("__rk", key("__rt", "__rs")), by, "__k", "__rk", ["epoch"],
                   chunk=chunk, clock="t")
    ev = with_chunks(ev.withColumn("epoch", F.coalesce("epoch", F.lit(0))), by, [t, seq], chunk)
    act, size, sided = F.col("action"), F.col("size").cast("double"), F.col("side").isin("B", "A")
    starts = (act == "M") | ((act == "A") & sided)
    takes = act.isin("C", "F")
    cut = F.when(takes, F.when((act == "C") & (size == 0), F.lit(float("inf"))).otherwise(size))
    own = [*by, "epoch", "order_id"]
    ev = running(ev.withColumn("__st", starts.cast("int")), own, [t, seq], "__ck", {"seg": ("sum", F.col("__st"))})
    ev = running(ev.withColumn("__cut", cut), [*own, "seg"], [t, seq], "__ck",
                 {"__before": ("sum", F.col("__cut")), "__n": ("count", F.col("__cut"))}, inclusive=False)
    ev = stored(ev.select(*own, "seg", t, seq, "action", "side", "price", "size", "__cut", "__before", "__n"))
    # one row per segment: what it rests, and how much was taken from it
    head = F.struct(F.col("side"), F.col("price"), size.alias("size"))
    segs = ev.groupBy(*own, "seg").agg(
        F.max(F.when(starts & sided, head)).alias("h"), F.coalesce(F.sum("__cut"), F.lit(0.0)).alias("__all"),
        F.count("__cut").alias("__cuts"),
    ).filter(F.col("h").isNotNull())
    left = F.col("h.size") - F.col("__all")
    alive = (F.col("__cuts") == 0) | (left > 0)
    rest = segs.filter(alive).select(*own, "seg", "h.side", "h.price", left.alias("left"))
    return ev, segs, rest, clears, starts, takes


def _cuts(ev: DataFrame, segs: DataFrame, own: list[str], takes: Column) -> DataFrame:
    """Messages that take from a live order, with the order's side and price and what it has left (``has``)."""
    hold = segs.select(*own, "seg", F.col("h.side").alias("__hs"), F.col("h.price").alias("__hp"), F.col("h.size").alias("__h0"))
    x = ev.filter(takes).join(hold, [*own, "seg"]).withColumn("has", F.col("__h0") - F.col("__before"))
    return x.filter((F.col("__n") == 0) | (F.col("has") > 0))


def order_events_to_deltas(events: DataFrame, by: list[str], chunk: int, t: str = "ts",
                           seq: str = "seq") -> DataFrame:
    """Signed level changes of an order-by-order feed: by, ts, seq, side, price, delta.

    Actions: A adds an order, C cancels part or all of it (size 0: all), M replaces it, F fills part or all of it, R clears
    the book, T is a print without book effect. A side other than B or A rests nothing.

    No replay is needed: every A or M starts a segment of its order, inside which C and F only take away, so what is
    left follows from the segment's size and a running sum of reductions. ``chunk`` (a length of time) splits the running sums,
    so neither a busy venue nor a busy order id meets one task. Clears cut an order's events into epochs.
    """
    own = [*by, "epoch", "order_id"]
    ev, segs, rest, clears, starts, takes = _segments(events, by, chunk, t, seq)
    act, size, sided = F.col("action"), F.col("size").cast("double"), F.col("side").isin("B", "A")
    out = [t, seq, "side", "price", "delta"]
    adds = ev.filter(starts & sided).withColumn("delta", size).select(*by, *out)
    cuts = _cuts(ev, segs, own, takes)
    cuts = cuts.withColumns({"delta": -F.least("has", "__cut"), "side": F.col("__hs"), "price": F.col("__hp")}).select(*by, *out)
    swap = ev.filter(act == "M").select(*own, (F.col("seg") - 1).alias("seg"), F.col(t), F.col(seq)).join(rest, [*own, "seg"])
    gone = swap.withColumn("delta", -F.col("left")).select(*by, *out)
    # the last segment of an order alive at the clear that ends its epoch
    final = rest.join(ev.groupBy(*own).agg(F.max("seg").alias("seg")), [*own, "seg"])
    ends = clears.select(*by, (F.col("epoch") - 1).alias("epoch"), F.col("__rt").alias(t), F.col("__rs").alias(seq))
    wiped = final.join(ends, [*by, "epoch"]).withColumn("delta", -F.col("left")).select(*by, *out)
    all_ = adds.unionByName(cuts).unionByName(gone).unionByName(wiped)
    return all_.withColumn("delta", F.col("delta").cast("long"))


def trade_prints(events: DataFrame, by: list[str], chunk: int, t: str = "ts", seq: str = "seq") -> DataFrame:
    """Prints with their aggressor side, the opposite of the resting side: by, ts, seq, aggressor, price, size.

    Prints are trades (T) and fills (F). A fill of a live order has that order's side and price, any other its own."""
    own = [*by, "epoch", "order_id"]
    ev, segs, _, _, _, takes = _segments(events, by, chunk, t, seq)
    hits = _cuts(ev, segs, own, takes).filter(F.col("action") == "F").select(*by, t, seq, F.col("__hs").alias("__s"), F.col("__hp").alias("__p"))
    x = events.filter(F.col("action").isin("T", "F")).join(hits, [*by, t, seq], "left")
    x = x.withColumns({"price": F.coalesce("__p", "price"), "__s": F.coalesce("__s", "side")})
    agg = F.when(F.col("__s") == "B", "A").when(F.col("__s") == "A", "B")
    return x.select(*by, t, seq, agg.alias("aggressor"), "price", "size")


def consolidated_levels(deltas: DataFrame, by: list[str], width: int, chunk: Column, t: str = "ts") -> DataFrame:
    """Consolidated size per (bucket, side, price) over all venues, only where it changed, 0 when a level empties.

    Changes are summed per bucket on the map side; the running size of one price level is an ordered scan split over
    time chunks.
    """
    d = deltas.withColumn("bucket", F.floor(F.col(t) / width) * width)
    per = d.groupBy(*by, "side", "price", "bucket").agg(F.sum("delta").alias("delta")).filter(F.col("delta") != 0)
    out = running(per, [*by, "side", "price"], ["bucket"], chunk, {"size": ("sum", F.col("delta"))})
    return out.select(*by, "bucket", "side", "price", "size")


def book_checks(book: DataFrame, by: list[str], depth: int, t: str = "ts", depths: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Quality figures per key: rows; crossed, locked and misordered books; quantiles of spread, of the time since the last row
    (of the day) and of the imbalance at several depths, with the mean sizes there. An empty book counts in none of the last.

    All quantiles come from one pass over (key, metric, value) rows."""
    bad = F.lit(False)
    for i in range(depth - 1):
        for side, worse in (("bid", F.col(f"bid_{i}_price") <= F.col(f"bid_{i + 1}_price")), ("ask", F.col(f"ask_{i}_price") >= F.col(f"ask_{i + 1}_price"))):
            bad = bad | F.coalesce(worse, F.lit(False))
    depths = tuple(d for d in depths if d <= depth)
    total = lambda s, d: sum((F.coalesce(F.col(f"{s}_{i}_size"), F.lit(0.0)) for i in range(d)), F.lit(0.0))
    day = Window.partitionBy(*by, F.expr(f"floor({t} / 86400000000)")).orderBy(t)
    x = book.withColumns({"bad": bad, "spread": F.col("ask_0_price") - F.col("bid_0_price"), "cadence": (F.col(t) - F.lag(t).over(day)).cast("double"),
                          **{f"{s[0]}{d}": total(s, d) for s in ("bid", "ask") for d in depths}})
    full = lambda d: F.col(f"b{d}") + F.col(f"a{d}") > 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), count(F.col("spread") < 0).alias("crossed"), count(F.col("spread") == 0).alias("locked"), count(F.col("bad")).alias("misordered"),
        F.max("cadence").alias("cadence_max"), *(F.avg(F.when(full(d), F.col(f"{s[0]}{d}"))).alias(f"{s}{d}_mean") for d in depths for s in ("bid", "ask")))
    values = {"spread": F.col("spread"), "cadence": F.col("cadence"), **{f"obi{d}": F.when(full(d), (F.col(f"b{d}") - F.col(f"a{d}")) / (F.col(f"b{d}") + F.col(f"a{d}"))) for d in depths}}
    long = x.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in values.items()])).alias("m")).select(*by, "m.*")
    points = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    q = exact_quantiles(long.filter("v is not null"), [*by, "metric"], "v", points)
    wide = q.groupBy(*by).agg(*(F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in values for p in points))
    return n.join(wide, by, "left")
