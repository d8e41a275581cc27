"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

The records are windows of ten consecutive words of a benchmark item (an item of fewer words is one window); the tokens
are word shingles (five words, fewer for a shorter item). All shingles of the benchmark are ordered by rarity, that is
by the number of times they occur in the whole corpus. Containment is to be complete, so of a window's shingles only the
rarest, its prefix, has to be joined; a window whose rarest shingle occurs nowhere is dropped. A document position whose
shingle is some window's prefix gives one alignment: the position less the shingle's place in the window. It survives
if the window fits between the document's first and last word, and then the words are compared one by one.

The corpus is only scanned: twice, once to count and once to join. What is shuffled are the hits.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import ROW, hot_keys, keyed, unique_join
from barspark.session import stored

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
#: Windows broadcast at once (their words, about 200 bytes each). A larger benchmark is taken in blocks, each with a scan of its own.
BLOCK_WINDOWS = 100_000
#: Items of a set that go into a join by one key.
PIECE = 4096
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z only, then takes runs of letters, digits and everything beyond ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def shingle(words: Column, start: Column, width: int) -> Column:
    return F.xxhash64(*(F.get(words, start + j) for j in range(width)))


def item_windows(benchmark: DataFrame, item_id: str, text: str, window_words: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows: ``wid`` (a number), ``win`` (its words), ``n`` (their number); and a row (wid, item) for each item, as a
    string, that a window stands in. No list of items is made: a passage may be in very many."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window_words))
    cut = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, F.lit(window_words)).alias("win"))
    cut = stored(cut.distinct())
    wins = stored(cut.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("n", F.size("win")))
    named = unique_join(cut.where("item is not null"), wins.select("win", "wid"), ["win"], hot_keys(cut, ["win"]))
    return wins, stored(named.select("wid", "item"))


def _mark(salt: int) -> Column:
    return F.sum(F.xxhash64("item", F.lit(salt)).cast("decimal(38,0)"))


def item_sets(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, set) and (set, item, members): windows that stand in the same items share a set, so the 41 windows of a passage of 50
    words name its items once.

    A set is found by its size and two sums of hashes, then verified: windows of c items each have the same ones exactly if
    together they have c. Should hashes collide, the windows concerned keep a set of their own.
    """
    marks = stored(named.groupBy("wid").agg(F.count(F.lit(1)).alias("members"), _mark(1).alias("h1"), _mark(2).alias("h2")))
    mark = ["members", "h1", "h2"]
    first = stored(marks.groupBy(*mark).agg(F.min("wid").alias("set")))
    of = stored(unique_join(marks, first, mark, hot_keys(marks, mark)).select("wid", "set", "members"))
    own = stored(unique_join(named, of, ["wid"], hot_keys(named, ["wid"])).groupBy("set", "item").agg(F.max("members").alias("members")))
    wrong = own.groupBy("set").agg(F.count(F.lit(1)).alias("k"), F.max("members").alias("m")).where("k <> m").select("set")
    if wrong.isEmpty():
        return of.select("wid", "set"), own
    apart = of.join(wrong, "set", "left_semi").select("wid", F.col("wid").alias("set"), "members")
    # a window's own number is no other set's: sets are named by one of their windows
    again = named.join(apart, "wid").select("set", "item", "members")
    return of.join(wrong, "set", "left_anti").unionByName(apart).select("wid", "set"), own.join(wrong, "set", "left_anti").unionByName(again)


def named_items(met: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``__row``, group) and (group, items): the items of each document of ``met`` (``__row``, wid).

    Documents that meet the same sets are one group, worked out once. A set is dealt in pieces of PIECE items, so a large one that
    many groups meet is spread over tasks.
    """
    of, members = item_sets(named)
    each = unique_join(met, of, ["wid"], hot_keys(met, ["wid"])).groupBy(ROW).agg(F.array_sort(F.collect_set("set")).alias("sets"))
    each = stored(each)
    groups = stored(each.select("sets").distinct().withColumn("group", F.monotonically_increasing_id()))
    pieces = lambda c: F.ceil(F.col(c) / PIECE)
    sizes = members.groupBy("set").agg(F.max("members").alias("members"))
    asked = groups.select("group", F.explode("sets").alias("set"))
    asked = unique_join(asked, stored(sizes), ["set"], hot_keys(asked, ["set"])).select("group", "set", F.explode(F.sequence(F.lit(0).cast("long"), pieces("members") - 1)).alias("piece"))
    dealt = members.withColumn("piece", F.pmod(F.xxhash64("item"), pieces("members"))).select("set", "piece", "item")
    items = asked.join(dealt, ["set", "piece"]).groupBy("group").agg(F.array_sort(F.collect_set("item")).alias("items"))
    mine = unique_join(each, groups, ["sets"], hot_keys(each, ["sets"])).select(ROW, "group")
    return stored(mine), stored(items)


def _positions(rows: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each word position of each text and shingle width, and one more at the end of each text, without a key."""
    base = rows.select(ROW, "id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    at = base.select(ROW, "id", "w", "n_words", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("p"))
    key = lambda k: F.when(F.col("p") + k <= F.col("n_words"), shingle(F.col("w"), F.col("p"), k))
    if len(widths) == 1:
        return at.withColumn("key", key(widths[0]))
    return at.select("*", F.explode(F.array(*map(key, widths))).alias("key")).where((F.col("p") < F.col("n_words")) | F.col("key").isNull())


def _blocks(df: DataFrame, by: str, count: int, size: int) -> list[DataFrame]:
    k = max(1, -(-count // size))
    return [df] if k == 1 else [df.where(F.pmod(F.xxhash64(by), F.lit(k)) == i) for i in range(k)]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
                  item_text: str = "text", window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS,
                  block_windows: int = BLOCK_WINDOWS, row: str | None = None, with_items: bool = False) -> DataFrame:
    """One row per input row: ``__row``, doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, ``with_items``, the items'
    ids as an array.

    A null or wordless text has no words and is clean; a null or wordless item has no window. An item with a null id
    hits words but isn't counted or named. Repeated rows are judged one by one, repeated items once. With an empty
    benchmark every document is clean; no documents give no rows. Other columns are not read.
    """
    rows = keyed(docs, doc_id, row).select(ROW, F.col(doc_id).alias("id"), F.col(text).alias("text"))
    wins, named = item_windows(benchmark, item_id, item_text, window_words)
    n_wins = wins.count()
    widths = sorted(r.k for r in wins.select(F.least(F.lit(shingle_words), F.col("n")).alias("k")).distinct().collect())
    inside = reduce(DataFrame.unionAll, [
        wins.where(F.least(F.lit(shingle_words), F.col("n")) == k)
        .select("wid", "win", "n", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("off"))
        .withColumn("key", shingle(F.col("win"), F.col("off"), k))
        for k in widths
    ]) if widths else None
    if inside is None:
        hits = rows.select(ROW, "id", F.size(words(F.col("text"))).alias("n_words"), F.lit(None).cast("int").alias("s"),
                           F.lit(None).cast("int").alias("e"), F.lit(None).cast("long").alias("wid"))
    else:
        keys = stored(inside.select("key").distinct())
        at = _positions(rows, widths)
        counts = [at.select("key").join(F.broadcast(b), "key").groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
                  for b in _blocks(keys, "key", keys.count(), block_windows * 20)]
        seen = stored(reduce(DataFrame.unionAll, counts))
        rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("key"), F.col("off"))).alias("r")
        prefix = inside.join(seen, "key", "left").groupBy("wid").agg(rarest, F.first("win").alias("win"), F.first("n").alias("n"))
        prefix = stored(prefix.where("r.seen > 0").select(F.col("r.key").alias("key"), F.col("r.off").alias("off"), "n", "win", "wid"))
        fits = lambda b: (
            (F.col("at.key") == F.col("b.key")) & (F.col("p") >= F.col("off")) & (F.col("p") - F.col("off") + F.col("b.n") <= F.col("n_words"))
            & (F.slice("w", F.col("p") - F.col("off") + 1, F.col("b.n")) == F.col("win")))
        found = []
        for i, b in enumerate(_blocks(prefix, "wid", n_wins, block_windows)):
            joined = at.alias("at").join(F.broadcast(b).alias("b"), fits(b), "left")
            ends = (F.col("p") == F.col("n_words")) & (F.lit(i == 0))
            start = F.col("p") - F.col("off")
            found.append(joined.where(F.col("win").isNotNull() | ends).select(
                ROW, "id", "n_words", start.alias("s"), (start + F.col("b.n")).alias("e"), "wid"))
        hits = reduce(DataFrame.unionAll, found)
    hits = stored(hits)
    before = Window.partitionBy(ROW).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.lit(0))))
    out = hits.withColumn("fresh", fresh).groupBy(ROW).agg(
        F.first("id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"))
    mine, items = named_items(hits.where("wid is not null").select(ROW, "wid").distinct(), named)
    # a count and a digest a group travel to its documents; the lists only where they are asked for, and never by broadcast
    facts = stored(items.select("group", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")))
    out = out.join(unique_join(mine, facts, ["group"], hot_keys(mine, ["group"])), ROW, "left")
    none = {"n_items": F.coalesce("n_items", F.lit(0).cast("long")), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256))}
    cols = [ROW, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")]
    if with_items:
        out = out.join(items.hint("shuffle_merge"), "group", "left")
        cols.append(F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumns(none).select(*cols)
