"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered: a block's
name is an integer, and equal names mean equal blocks. Then adjacent names are paired, the distinct pairs sorted and
numbered again, and so on until one name is left of each document. (level, name) is the document's identity; two
documents share it exactly when their normalised texts are equal, whatever any hash does.

Only one shuffle carries text: the one that finds the distinct blocks. A 64-bit hash takes the names back to the
documents, and only for hashes that a single distinct block has; blocks that share a hash are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ROW, hot_keys, keyed, unique_join
from barspark.session import stored

#: The characters deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLOCK_BYTES = 16384


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """A unique integer for each row. Rows are sorted within a partition that a hash of them chose, so a recomputed
    partition numbers them alike."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES,
                 hash_bits: int = 64, row: str | None = None) -> DataFrame:
    """One row per input row: ``__row``, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest doc_id (a null id
    comes last), then the first of repeated rows: exactly one row of a group has ``kept``. Null texts are empty, and
    all empty or blank texts are one group. An empty table gives an empty result. Other columns are not read, whatever
    their names. ``hash_bits`` below 64 is for tests of blocks that share a hash.
    """
    rows = keyed(docs, doc_id, row).select(ROW, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    norm = rows.withColumn("norm", normalised(F.col("text")))
    raw = F.encode("norm", "utf-8")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(block_bytes))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1),
                      lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = norm.select(
        ROW, "doc_id", n_blocks.alias("n_blocks"), raw.alias("raw"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"),
        F.sha2("raw", 256).alias("sha"),
    ).select(ROW, "doc_id", "n_blocks", "points", "sha", F.posexplode(cut).alias("pos", "block"))
    h = F.xxhash64("block") if hash_bits >= 64 else F.xxhash64("block").bitwiseAND(F.lit((1 << hash_bits) - 1))
    blocks = blocks.withColumn("h", h)

    first = F.col("pos") == 0
    seen = stored(blocks.select(ROW, "n_blocks", "pos", "h", *(F.when(first, F.col(c)).alias(c) for c in ("doc_id", "points", "sha"))))
    names = stored(numbered(blocks.select("h", "block").distinct(), ["h", "block"]).select("h", "name"))
    per_hash = names.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    level = unique_join(seen.select(ROW, "n_blocks", "pos", "h"), per_hash.where("n = 1").select("h", "name"), ["h"], hot_keys(seen, ["h"]))
    level = level.select(ROW, "n_blocks", "pos", "name")
    shared = per_hash.where("n > 1").select("h")
    if not shared.isEmpty():
        texts = stored(blocks.join(shared, "h", "left_semi").select(ROW, "n_blocks", "pos", "block"))
        own = numbered(texts.select("block").distinct(), ["block"]).withColumn("name", -1 - F.col("name"))
        level = level.unionAll(unique_join(texts, stored(own), ["block"], hot_keys(texts, ["block"])).select(level.columns))

    level, depth, done = stored(level.withColumnRenamed("n_blocks", "left_over")), 0, []
    while True:
        done.append(level.where("left_over = 1").select(ROW, F.lit(depth).alias("level"), "name"))
        more = level.where("left_over > 1")
        if more.isEmpty():
            break
        half = F.floor(F.col("pos") / 2).cast("int")
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        # an odd last block has no right neighbour: its pair is (name, no name), which no pair of two blocks equals
        pairs = stored(more.groupBy(ROW, half.alias("pos")).agg(
            F.ceil(F.max("left_over") / 2).cast("int").alias("left_over"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1 << 62)).alias("b")))
        own = stored(numbered(pairs.select("a", "b").distinct(), ["a", "b"]))
        level = stored(unique_join(pairs, own, ["a", "b"], hot_keys(pairs, ["a", "b"])).select(ROW, "left_over", "pos", "name"))
        depth += 1

    identity = done[0]
    for part in done[1:]:
        identity = identity.unionAll(part)
    ids = stored(identity.join(seen.where(first).select(ROW, "doc_id", "points", "sha"), ROW))
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col(ROW).alias("r")))
    groups = stored(ids.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")))
    whole = unique_join(ids, groups, ["level", "name"], hot_keys(groups, ["level", "name"], F.col("group_size")))
    return whole.select(ROW, "doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col(ROW) == F.col("best.r")).alias("kept"), F.col("sha").alias("text_sha256"))
