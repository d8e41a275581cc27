"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: per text, 64 majority bits over the XXH64 (seed 42) of its word shingles, repeats included.

Candidates: every bit position gets a non-zero code of radius+1 bits, in turn; for each of the 2^(radius+1) - 1 non-zero
vectors v, table v keeps the bits whose code has an odd product with v. At most ``radius`` differing bits have codes that
span a space of dimension at most ``radius``, so some v is orthogonal to all of them: in that table the two fingerprints
agree on all bits kept. Every pair within the radius therefore shares a bucket in some table; there is no recall to lose.

Links within a bucket: pairs of distinct fingerprints are compared where the bucket is small. In a larger one no pairs are
made: each fingerprint names, for every choice of ``radius`` bits that its table doesn't keep, itself without those bits.
Fingerprints of the same name differ in those bits only, so all of them link to the least; and any two within the radius
share a name. That is exact, and linear in the size of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ROW, arrow_chunks, hot_keys, keyed, offsets, unique_join
from barspark.llm.components import components
from barspark.session import stored

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Buckets up to this size are compared in pairs.
SMALL_BUCKET = 32
CHARS_AT_ONCE = 1 << 19
SHINGLES_AT_ONCE = 1 << 15
#: A byte is of a word unless it is a space or one of \t \n \v \f \r.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fingerprints(texts: list[str], width: int = SHINGLE_WORDS) -> np.ndarray:
    """uint64 per text (one at least); no words: 0; fewer words than ``width``: one shingle of all of them."""
    encoded = [t.encode() for t in texts]
    ends = offsets(np.fromiter((len(t) + 1 for t in encoded), np.int64, len(texts)))
    b = LOWER[np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)]
    word = IN_WORD[b]
    first = word & ~np.concatenate([[False], word[:-1]])
    # one space before each word, so that the bytes from a word's start to another's end are a shingle
    n_words = int(first.sum())
    shift = np.cumsum(first)
    joined = np.full(int(word.sum()) + n_words, 0x20, np.uint8)
    keep = np.flatnonzero(word)
    place = np.arange(len(keep)) + shift[keep]
    joined[place] = b[keep]
    starts = place[first[keep]]
    stops = np.concatenate([starts[1:] - 1, [len(joined)]]) if n_words else starts
    per_text = offsets(np.add.reduceat(first, ends[:-1], dtype=np.int64))
    buf, h = joined.tobytes(), xxhash.xxh64_intdigest
    # the words that begin a shingle of each text: all but its last width-1, at least its first
    n = np.diff(per_text)
    counts = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    total = int(counts.sum())
    owner = np.repeat(np.arange(len(texts)), counts)
    begins = np.arange(total) - np.repeat(offsets(counts)[:-1], counts) + per_text[owner]
    last = np.minimum(begins + width - 1, per_text[owner + 1] - 1)
    s, e = starts[begins].tolist(), stops[last].tolist()
    set_bits = np.zeros((len(texts), BITS), np.int64)
    for i in range(0, total, SHINGLES_AT_ONCE):
        j = min(total, i + SHINGLES_AT_ONCE)
        hs = np.fromiter((h(buf[x:y], SEED) for x, y in zip(s[i:j], e[i:j])), np.uint64, j - i)
        bits = np.unpackbits(hs.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = owner[i:j]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        set_bits[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(2 * set_bits > counts[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", width: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the fingerprint as a long (its 64 bits, signed); a null text is empty."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [fingerprints(run, width).view(np.int64) for run in arrow_chunks(texts, CHARS_AT_ONCE)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return docs.withColumn(name, fp(F.col(text).cast("string")))


def masks(radius: int = RADIUS) -> list[int]:
    """The bits each table keeps, as signed longs."""
    n = 1 << (radius + 1)
    code = [1 + i % (n - 1) for i in range(BITS)]
    kept = [sum(1 << i for i in range(BITS) if bin(code[i] & v).count("1") % 2) for v in range(1, n)]
    return [_signed(m) for m in kept]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def links(fps: DataFrame, radius: int = RADIUS, small: int = SMALL_BUCKET) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp``: a differs from b in at most ``radius`` bits. Every linked pair is
    connected by links, and within a bucket of at most ``small`` each pair is a link."""
    kept = masks(radius)
    slots = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(kept))))
    inside = fps.select("fp", slots.alias("x")).select("fp", "x.t", "x.key")
    sizes = stored(inside.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    inside = stored(unique_join(inside, sizes, ["t", "key"], hot_keys(sizes, ["t", "key"], F.col("n"))))
    few = inside.where(F.col("n") <= small).drop("n")
    pair = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["t", "key"])
    pair = pair.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    many = inside.where(F.col("n") > small)
    free = [[i for i in range(BITS) if not (m >> i) & 1] for m in kept]
    drop = [[_signed(sum(1 << i for i in c) ^ ((1 << BITS) - 1)) for c in combinations(f, radius)] for f in free]
    named = many.select("fp", "t", F.posexplode(F.element_at(F.array(*(F.array(*map(F.lit, d)) for d in drop)), F.col("t") + 1)).alias("c", "mask"))
    name = ["t", "c", "rest"]
    named = named.select("fp", "t", "c", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    least = named.groupBy(*name).agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    near = named.join(least, name).where("fp > a").select("a", F.col("fp").alias("b"))
    return pair.unionAll(near).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = SHINGLE_WORDS,
                    small: int = SMALL_BUCKET, row: str | None = None) -> DataFrame:
    """One row per input row: ``__row``, doc_id, fp (long), fingerprint (hex), component_id, kept (one row of each component).

    component_id is the least doc_id among the rows reachable over links of fingerprints, the row itself included; null
    ids are passed over, and a component without any has null. Null, empty and blank texts have fingerprint zero and link
    like any other. Repeated rows share a component. No rows give no rows. Other columns are not read.
    """
    rows = keyed(docs, doc_id, row).select(ROW, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(with_fingerprint(rows, "text", "fp", width).select(ROW, "doc_id", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col(ROW).alias("r")))
    fps = stored(rows.groupBy("fp").agg(first.alias("least"), F.count(F.lit(1)).alias("n")))
    roots = stored(components(links(fps.select("fp"), radius, small)))
    fps = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    fps = stored(fps)
    groups = stored(fps.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("m")))
    named = stored(unique_join(fps, groups, ["root"], hot_keys(groups, ["root"], F.col("m"))).select("fp", "n", "first"))
    whole = unique_join(rows, named, ["fp"], hot_keys(named, ["fp"], F.col("n")))
    return whole.select(ROW, "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"),
                        (F.col(ROW) == F.col("first.r")).alias("kept"))
