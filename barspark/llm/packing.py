"""Packing token sequences into windows by minimum bin slack.

Every document ends with a terminator id. Its whole windows of 1024 ids are sequences of their own; what is left, 1 to 1023
ids, is to be combined. How many remainders there are of each length is a table of at most 1023 counts, whatever the
corpus, so the plan is made on that: the longest length left opens a window, and a subset-sum dynamic programme over bits
finds the multiset of other lengths left, with their counts, that fills it closest to capacity. Backtracking through the
bits gives how many of each length; the pattern is repeated as often as the counts allow. Patterns with no slack are kept.
When no multiset fills the window of the longest length, its remainders go to the tail, where they are laid end to end
and cut at multiples of the window; the last stretch is cut into powers of two, which need no padding. So nothing is
padded, and only remainders in the tail are cut.

Documents get their places by rank among the remainders of their length. Ranks are numbered within salted buckets of
bounded size and shifted by the counts of the buckets before, so a length that a third of the corpus has is no single task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import ROW, arrow_chunks, keyed
from barspark.session import stored

CAPACITY = 1024
TERMINATOR = 0
VOCABULARY = "byte_bpe_50k"
#: Rows that one bucket of the ranking holds on average.
BUCKET_ROWS = 16_384
BROADCAST_ROWS = 1_000_000
CHARS_AT_ONCE = 1 << 20


@lru_cache(maxsize=2)
def _fast(vocabulary: str):
    """(encoding by the vocabulary's merge ranks, strings of its special tokens)."""
    import base64
    import json

    import public_tokenizers as P
    import tiktoken

    with open(P.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(P.path(f"{vocabulary}.json")) as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


@lru_cache(maxsize=2)
def _plain(vocabulary: str):
    """The tokenizer that defines the ids; it is large, and loaded only where it is needed."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(f"{vocabulary}.json"))


def token_ids(texts: list[str], vocabulary: str = VOCABULARY) -> list[np.ndarray]:
    """Ids of each text and the terminator. The merge ranks give the ids of ``tokenizers`` at a quarter of the time; a
    text with a special token's string in it goes to ``tokenizers`` itself."""
    fast, special = _fast(vocabulary)
    out = []
    for t in texts:
        ids = _plain(vocabulary).encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t)
        out.append(np.array([*ids, TERMINATOR], np.uint32))
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def measured(rows: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """``__row``, doc_id, n (ids), crcs (of each whole window, then of the remainder, if any)."""

    @F.arrow_udf("n long, crcs array<long>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n, crcs = [], []
            for run in arrow_chunks(texts, CHARS_AT_ONCE):
                for ids in token_ids(run, vocabulary):
                    n.append(len(ids))
                    crcs.append([_crc(ids[i:i + capacity]) for i in range(0, len(ids), capacity)])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["n", "crcs"])

    return rows.withColumn("m", measure("text")).select(ROW, "doc_id", "m.n", "m.crcs")


def fill(counts: dict[int, int], need: int) -> dict[int, int]:
    """The multiset of lengths, no more of each than counted, whose sum is the largest up to ``need``; longer lengths first."""
    reach, steps = 1, []
    mask = (1 << (need + 1)) - 1
    for size in sorted(counts, reverse=True):
        left, k = min(counts[size], need // size), 1
        while left > 0:  # as 1, 2, 4, ... copies at once, so that a count costs its logarithm
            take = min(k, left)
            grown = (reach | reach << take * size) & mask
            if grown != reach:
                steps.append((size, take, reach))
                reach = grown
            left, k = left - take, 2 * k
        if reach >> need & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            out[size] = out.get(size, 0) + take
            at -= take * size
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(patterns with their repeats, counts left for the tail); every pattern's sum is the capacity."""
    left = {k: n for k, n in counts.items() if n > 0}
    patterns, tail = [], {}
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        chosen = fill({k: n for k, n in others.items() if n}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        if sum(k * n for k, n in chosen.items()) < capacity:
            tail[longest] = left.pop(longest)
            continue
        times = min(left[k] // n for k, n in chosen.items())
        patterns.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return patterns, tail


def _ranked(rows: DataFrame, total: int, by: str) -> DataFrame:
    """Adds ``rank``, from 0, among the rows of the same ``by``."""
    salt = F.pmod(F.xxhash64(ROW), F.lit(max(1, -(-total // BUCKET_ROWS)))).cast("int")
    rows = rows.withColumn("salt", salt)
    per = rows.groupBy(by, "salt").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(by, "salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(by, "salt").orderBy(ROW)) - 1)
    return rows.join(per, [by, "salt"]).withColumn("rank", F.col("base") + F.col("i")).drop("salt", "i", "base")


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, copies a window, offset of the first copy), by rank."""
    out, first, used = {}, 0, {}
    for chosen, times in patterns:
        at = 0
        for size in sorted(chosen, reverse=True):
            out.setdefault(size, []).append((used.get(size, 0), first, chosen[size], at))
            used[size] = used.get(size, 0) + chosen[size] * times
            at += size * chosen[size]
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def cuts(start: int, end: int, total: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """Pieces (from, length, sequence, offset) of the stretch [start, end) of a stream of ``total`` ids: sequences are of
    the capacity, then of the powers of two that make up the rest, the larger first."""
    out, whole = [], total // capacity * capacity
    edges, seq, at = [], total // capacity, whole
    for bit in reversed(range(capacity.bit_length())):
        if (total - whole) >> bit & 1:
            edges.append((at, at + (1 << bit), seq))
            at, seq = at + (1 << bit), seq + 1
    at = start
    while at < min(end, whole):
        stop = min(end, (at // capacity + 1) * capacity)
        out.append((at - start, stop - at, at // capacity, at % capacity))
        at = stop
    for lo, hi, s in edges:
        if max(at, lo) < min(end, hi):
            out.append((max(at, lo) - start, min(end, hi) - max(at, lo), s, max(at, lo) - lo))
    return out


PIECE = "start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, row: str | None = None) -> DataFrame:
    """One row per piece: ``__row``, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the terminator alone. Repeated rows, and rows without an id, are packed each for itself.
    Sequences are numbered from 0: those of the patterns, those of the tail, then whole windows. Without documents there are
    no pieces. Other columns are not read. The vocabulary is found by ``public_tokenizers.path``.
    """
    rows = keyed(docs, doc_id, row).select(ROW, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs_n = stored(measured(rows, vocabulary, capacity))
    rest = F.col("n") % capacity
    hist = docs_n.groupBy(rest.alias("rest")).agg(F.count(F.lit(1)).alias("k")).collect()  # at most ``capacity`` rows
    counts = {r.rest: r.k for r in hist if r.rest}
    patterns, tail = plan(counts, capacity)
    slots, n_mixed = _slots(patterns), sum(t for _, t in patterns)
    planned = {k: counts[k] - tail.get(k, 0) for k in counts}
    bases, at = {}, 0
    for k in sorted(tail):
        bases[k] = at
        at += k * tail[k]
    n_tail = at // capacity + bin(at % capacity).count("1")
    ends = docs_n.withColumn("rest", rest).where("rest > 0").select(ROW, "doc_id", "n", "rest", F.element_at("crcs", -1).alias("crc"))
    ranked = stored(_ranked(ends, sum(counts.values()), "rest"))

    @F.pandas_udf("sequence_id long, offset long")
    def seat(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = lengths.to_numpy(), ranks.to_numpy()
        seq, off = np.full(len(size), -1, np.int64), np.zeros(len(size), np.int64)
        for k in np.unique(size):
            here = np.flatnonzero((size == k) & (rank < planned.get(int(k), 0)))
            if len(here):
                t = slots[int(k)][np.searchsorted(slots[int(k)][:, 0], rank[here], side="right") - 1]
                i = rank[here] - t[:, 0]
                seq[here], off[here] = t[:, 1] + i // t[:, 2], t[:, 3] + i % t[:, 2] * k
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = ranked.withColumn("at", seat("rest", "rank")).select("*", "at.sequence_id", "at.offset").drop("at")
    ranked = stored(ranked)
    start = (F.col("n") - F.col("rest")).alias("start")
    out = ranked.where("sequence_id >= 0").select(ROW, "doc_id", start, F.col("rest").alias("length"), F.col("crc").alias("ids_crc32"),
                                                  F.col("n").alias("doc_tokens"), "sequence_id", "offset")

    full = docs_n.where(F.col("n") >= capacity).withColumn("whole", F.floor(F.col("n") / capacity))
    full = full.withColumn("bucket", F.pmod(F.xxhash64(ROW), F.lit(max(1, -(-sum(r.k for r in hist) // BUCKET_ROWS)))).cast("int"))
    per = full.groupBy("bucket").agg(F.sum("whole").alias("k"))  # one row per BUCKET_ROWS documents
    per = per.select("bucket", F.coalesce(F.sum("k").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.sum("whole").over(Window.partitionBy("bucket").orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1))
    full = full.withColumn("own", F.coalesce(own, F.lit(0))).join(per, "bucket")
    windows = full.select(ROW, "doc_id", "n", "own", "base", F.posexplode(F.slice("crcs", F.lit(1), F.col("whole").cast("int"))).alias("i", "crc"))
    out = out.unionAll(windows.select(ROW, "doc_id", (F.col("i").cast("long") * capacity), F.lit(capacity).cast("long"), "crc", "n",
                                      F.col("base") + F.col("own") + F.col("i") + (n_mixed + n_tail), F.lit(0).cast("long")))
    if not tail:
        return out

    total = at

    @F.pandas_udf(f"array<struct<{PIECE.replace(' long', ':long')}>>")
    def cut(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, size, rank in batches:
            made = []
            for t, k, r in zip(texts, size, rank):
                ids = token_ids([t], vocabulary)[0]
                n, ids = len(ids) - k, ids[-k:]
                begin = bases[k] + (r - planned[k]) * k
                made.append([{"start": n + a, "length": m, "ids_crc32": _crc(ids[a:a + m]), "sequence_id": n_mixed + q, "offset": o}
                             for a, m, q, o in cuts(begin, begin + k, total, capacity)])
            yield pd.Series(made, dtype=object)

    loose = stored(ranked.where("sequence_id < 0").select(ROW, "doc_id", "n", "rest", "rank"))
    if sum(tail.values()) <= BROADCAST_ROWS:  # 40 bytes each; more are joined by a shuffle of the texts
        loose = F.broadcast(loose)
    loose = rows.select(ROW, "text").join(loose, ROW).withColumn("p", F.explode(cut("text", "rest", "rank")))
    return out.unionAll(loose.select(ROW, "doc_id", "p.start", "p.length", "p.ids_crc32", "n", "p.sequence_id", "p.offset"))
