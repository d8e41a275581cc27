"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Targets: sources, in the order of their names, have weights; they share the words of the corpus by weight, but none gets more
than MOST_REPEATS times its own, and what is over is shared again among the others.

Quotas: the mix is made of blocks of equally many words. Sources at their bound give all they have that often. The blocks of the
others go to the highest quotients target / (2k + 1), k being the blocks a source has so far. A source's blocks then go to its
shards in the same way, by their words. Nearly all of a party's seats follow from one division by the mean price of a seat;
only the seats that this leaves over (or gives too many) are ranked by quotient, a few candidates a party, without a task that
holds all of them.

Selection: a shard is a share of its source's documents, dealt by a seeded hash, of SHARD_WORDS words or so. Its documents
stand in a seeded order, as one stream that begins again at its end; the quota is that many consecutive blocks of the stream
from a seeded block on. A document's words in the mix are those of its place in the stream that the blocks cover: whole rounds
of the stream plus the overlap with one stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import ROW, hot_keys, keyed, unique_join
from barspark.operators.prefix import ranked
from barspark.session import stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 17
SEED = "mix-1"
#: The words of a text: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column | str) -> Column:
    """32 hexadecimal digits that depend on the seed and these values alone."""
    return F.md5(F.concat_ws(":", F.lit(SEED), *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("null")) for p in parts)))


def number(digest: Column) -> Column:
    """The first eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``sid``: 0, 1, 2, ... in the order of source names by code point, null last. Sources are sorted by range partitions;
    a partition's numbers begin where those before it end, so only a row per partition meets in one task."""
    order = [F.col("source").asc_nulls_last()]
    placed = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("__p", F.shiftright("__i", 33)).withColumn("__i", F.col("__i").bitwiseAND((1 << 33) - 1)))
    per = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = per.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return placed.join(before, "__p").withColumn("sid", F.col("__i") + F.col("__b")).drop("__p", "__i", "__b")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """Adds ``weight``, ``capped`` and ``target`` to (sid, source_size). Every round bounds the sources whose share is above ``repeats``
    times their size and shares the rest by weight; the price of a unit of weight only rises, so rounds end. The driver gets
    two sums a round."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("long"))
    most = F.col("source_size") * repeats
    left, units, bounded = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.lit(0)).first()
    total, all_units = left, units
    while units:
        above = F.col("weight") * (F.lit(left) / F.lit(units)) > most
        gone = s.where(above).agg(F.count(F.lit(1)), F.coalesce(F.sum(most), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if gone[0] == bounded:
            break
        bounded, left, units = gone[0], total - gone[1], all_units - gone[2]
    price = F.lit(left) / F.lit(units) if units else F.lit(0.0)
    capped = F.col("weight") * price > most if units else F.lit(True)
    return s.withColumn("capped", capped).withColumn("target", F.when(capped, most.cast("double")).otherwise(F.col("weight") * price))


def apportioned(parties: DataFrame, by: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group ``by`` (a column, alike in a group) dealt to the highest quotients
    votes / (2k + 1); of equal quotients the party with the lower number comes first. No votes, no seats.

    Votes over their mean number a seat, rounded, is the quota but for a difference of at most half the parties, which the
    highest quotients (or, if it is too many, the lowest that have a seat) make up. One party's part in that is less than
    1 + (difference + parties) * votes / all votes, so that many quotients are its candidates.
    """
    if by:
        per = stored(parties.groupBy(*by).agg(F.sum(votes).alias("__v"), F.count(F.lit(1)).alias("__m")))
        p = unique_join(parties, per, by, hot_keys(per, by, F.col("__m")))
    else:
        v, m = parties.agg(F.coalesce(F.sum(votes), F.lit(0)), F.count(F.lit(1))).first()
        p = parties.withColumn("__v", F.lit(v)).withColumn("__m", F.lit(m))
    share = F.coalesce(F.try_divide(F.col(votes).cast("double"), F.col("__v").cast("double")), F.lit(0.0))
    p = stored(p.withColumn("__q", F.floor(F.col(seats) * share + 0.5)))
    if by:
        over = stored(p.groupBy(*by).agg(F.sum("__q").alias("__d")))
        p = unique_join(p, over, by, hot_keys(per, by, F.col("__m")))
    else:
        p = p.withColumn("__d", F.lit(p.agg(F.coalesce(F.sum("__q"), F.lit(0))).first()[0]))
    p = stored(p.withColumn("__d", F.when(F.col("__v") > 0, F.col(seats) - F.col("__d")).otherwise(0)))
    most = F.ceil((F.abs("__d") + F.col("__m")) * share) + 1
    adds = F.col("__d") > 0
    place = F.when(adds, F.sequence(F.col("__q"), F.col("__q") + most)).otherwise(
        F.sequence(F.greatest(F.col("__q") - 1 - most, F.lit(0)), F.col("__q") - 1))
    open_seats = p.where((F.col("__d") != 0) & (F.col(votes) > 0) & (adds | (F.col("__q") > 0)))
    open_seats = open_seats.select(*by, party, "__d", F.explode(place).alias("__k"), F.col(votes).cast("double").alias("__w"))
    quotient = F.col("__w") / (2 * F.col("__k") + 1)
    # the seats to give come highest first, the seats to take lowest first; the tie goes the same way
    sign = F.signum("__d").cast("long")
    tie = F.when(adds, F.col(party) * 1.0).otherwise(-F.col(party) * 1.0)
    open_seats = stored(open_seats.select(*by, party, "__d", (-sign * quotient).alias("__x"), tie.alias("__t"), sign.alias("__step")))
    moved = ranked(open_seats, by, "__x", "__t").where(F.col("rn") <= F.abs("__d"))
    moved = moved.groupBy(*by, party).agg(F.sum("__step").alias("__c"))
    out = p.join(moved, [*by, party], "left")
    return out.withColumn("quota", F.col("__q") + F.coalesce("__c", F.lit(0))).drop("__v", "__m", "__q", "__d", "__c")


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
          repeats: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, row: str | None = None) -> DataFrame:
    """One row per input row: ``__row``, doc_id, source, size, source_size, target, shard, quota (blocks of the shard), at (the
    document's place in the shard's stream) and taken (its words in the mix, repeats counted).

    A null text has no words, a null source is a source of its own, after all others. Documents without words take none;
    a corpus without words has targets of 0. Repeated rows count each for itself. No rows give no rows. Other columns are not
    read, whatever their names. The same rows give the same mix, whatever their order; only of repeated ids in one source, which
    row stands first in the stream depends on the row key.
    """
    rows = keyed(docs, doc_id, row).select(ROW, F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    rows = stored(rows)  # the one pass over the texts
    key = ["__z", "__n"]
    rows = rows.withColumn("__z", F.col("source").isNull()).withColumn("__n", F.coalesce("source", F.lit("")))
    sizes = stored(rows.groupBy(*key).agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    sources = stored(with_targets(numbered_sources(sizes), weights, repeats))

    # blocks to sources: those at their bound give all, the others share what is left of the corpus
    words, bound = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("capped"), F.col("target")).otherwise(0.0)), F.lit(0.0))).first()
    free = sources.where("not capped").withColumn("seats", F.lit((2 * (words - int(bound)) + block_words) // (2 * block_words)))
    quotas = apportioned(free, [], "sid", "target", "seats").select("sid", F.col("quota").alias("blocks"))
    sources = stored(sources.join(quotas, "sid", "left").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")))

    info = sources.select(*key, "sid", "source_size", "target", "capped", "blocks", "shards")
    digest = seeded(F.col("doc_id").cast("string"))
    dealt = unique_join(rows, info, key, hot_keys(sizes, key, F.col("docs"))).withColumn("hash", digest)
    # of the hash, the first digits choose the shard and all of them the order in it
    dealt = stored(dealt.withColumn("shard", number(F.col("hash")) % F.col("shards")).drop(*key, "shards"))
    shards = dealt.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("capped").alias("capped"), F.first("blocks").alias("blocks"))
    shards = stored(shards)
    quota = apportioned(shards.where("not capped"), ["sid"], "shard", "words", "blocks").select("sid", "shard", "quota")
    shards = shards.join(quota, ["sid", "shard"], "left")
    # words to take: whole rounds of the stream, then a stretch from a seeded block on
    taken = F.when(F.col("capped"), F.col("words") * repeats).otherwise(F.least(F.col("quota") * block_words, F.col("words") * repeats))
    first = number(seeded(F.col("sid").cast("string"), F.col("shard").cast("string"))) % F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)) * block_words
    long = F.greatest("words", F.lit(1))
    shards = shards.select("sid", "shard", "words", "quota", F.floor(taken / long).alias("rounds"), (taken % long).alias("rest"), first.alias("first"))

    stream = Window.partitionBy("sid", "shard").orderBy("hash", "doc_id", ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("at", F.sum("size").over(stream) - F.col("size")).join(shards, ["sid", "shard"])

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), high) - F.greatest("at", low))

    last = F.col("first") + F.col("rest")
    part = overlap(F.col("first"), F.least(last, F.col("words"))) + overlap(F.lit(0), last - F.col("words"))
    return placed.select(ROW, "doc_id", "source", "size", "source_size", "target", "shard", "quota", "at",
                         (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"))
