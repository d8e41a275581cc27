"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q, at least three periods and LEAST words long, that neither neighbouring
word extends. At each dyadic scale B a text is cut into aligned blocks of B words. A run of a period in [B, 2B) holds one of
them together with its copy a period later, so each block is sought in the words that follow at the distances of its scale
(the smallest scale has all the lower ones, too): the squared differences of block and window, summed at every distance,
are zero exactly where no word differs. The sums come from number-theoretic transforms modulo 65537, whose stages
are small matrix products; words have numbers so small that no sum reaches the modulus, so they are exact integers.

Small numbers are shared by several words, so a zero only seeds: from the block the equal stretch at that distance is
extended to both sides, by prefix hashes of the full words and doubling steps, and what is long enough is compared word
by word. A hash can take different words for equal but never the reverse, so nothing is lost before that comparison; if
it fails, the texts at hand are extended word by word instead.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import arrow_chunks, offsets
from barspark.session import ship

LEAST = 24
PERIODS = 3
SMALLEST_BLOCK = 8
#: Prime modulus with roots of unity of every order up to 65536.
P = 65537
GENERATOR = 3
#: A longer block is sought by its first words: a transform is at most twice as long as these.
BLOCK_WORDS = (P - 1) // 2
DIRECT = 256
BYTES_AT_ONCE = 1 << 20
NUMBERS_AT_ONCE = 1 << 17
MIX = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
SCHEMA = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod P for whole doubles of 0 to 2^48: there a correctly rounded quotient never reaches the next integer."""
    return x - P * np.floor(x / P)


@lru_cache(maxsize=64)
def _powers(m: int, rows: int, cols: int, inverse: bool) -> np.ndarray:
    """w^(i*j) for the m-th root of unity w (or its inverse)."""
    w = pow(GENERATOR, (P - 1) // m, P)
    w = pow(w, -1, P) if inverse else w
    table = np.array([pow(w, i, P) for i in range(m)], np.float64)
    return table[np.outer(np.arange(rows), np.arange(cols)) % m]


def transform(x: np.ndarray, m: int, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (zeros follow up to m), without the factor 1/m: one matrix product up to DIRECT
    numbers, beyond that two smaller ones with twiddle factors between them."""
    if m <= DIRECT:
        return _mod(x @ _powers(m, m, m, inverse)[: x.shape[1]])
    m1 = 1 << (m.bit_length() - 1) // 2
    m2 = m // m1
    y = np.zeros((len(x), m))
    y[:, : x.shape[1]] = x
    y = _mod(_powers(m1, m1, m1, inverse) @ y.reshape(-1, m1, m2))
    y = _mod(_mod(y * _powers(m, m1, m2, inverse)) @ _powers(m2, m2, m2, inverse))
    return y.transpose(0, 2, 1).reshape(-1, m)


def products(blocks: np.ndarray, windows: np.ndarray, m: int) -> np.ndarray:
    """sum over x of block[x] * window[x + lag], for each lag at which the block lies inside the window."""
    lags = windows.shape[1] - blocks.shape[1] + 1
    spectrum = _mod(transform(blocks, m, True) * transform(windows, m))
    return _mod(transform(spectrum, m, True)[:, :lags] * float(pow(m, -1, P)))


def _prefix_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    power = np.ones(n + 1, np.uint64)
    power[1:] = BASE
    power = np.multiply.accumulate(power)
    x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(x * power[:-1], out=h[1:])
    return h, power


def _extent(at: np.ndarray, dist: np.ndarray, most: np.ndarray, side: int, words: np.ndarray, hashes) -> np.ndarray:
    """How many words from ``at`` on (side 1), or before it (side -1), equal those ``dist`` later, at most ``most``. By hashes
    it may be too many, never too few; without them it is exact."""
    got = np.zeros(len(at), np.int64)
    if not len(at):
        return got
    if hashes is None:
        going = np.flatnonzero(most > 0)
        while len(going):
            x = at[going] + (got[going] if side > 0 else -1 - got[going])
            going = going[words[x] == words[x + dist[going]]]
            got[going] += 1
            going = going[got[going] < most[going]]
        return got
    h, power = hashes
    step = 1 << int(most.max()).bit_length()
    shift = power[dist]
    while step:
        far = got + step
        ok = np.flatnonzero(far <= most)
        a, d = at[ok], dist[ok]
        b = a + side * far[ok]
        got[ok] += step * ((h[b] - h[a]) * shift[ok] == h[b + d] - h[a + d])
        step >>= 1
    return got


def _merged(doc, start, end, period):
    """One row per (doc, start, end), of the least period."""
    order = np.lexsort((period, end, start, doc))
    doc, start, end, period = doc[order], start[order], end[order], period[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return doc[first], start[first], end[first], period[first]


def _search(words: np.ndarray, ends: np.ndarray, hashes, least: int, periods: int):
    """(doc, start, end, period) of the runs of all texts; text t is words[ends[t]:ends[t + 1]]."""
    size = np.diff(ends)
    found, scale = [], SMALLEST_BLOCK
    while True:
        low = scale if scale > SMALLEST_BLOCK else 1
        width = min(scale, BLOCK_WORDS)
        docs = np.flatnonzero(size >= max(least, periods * low))
        if not len(docs):
            break
        # aligned blocks that have room for a copy at the scale's lowest distance
        per = (size[docs] - width - low) // scale + 1
        owner = np.repeat(docs, per)
        starts = ends[owner] + scale * (np.arange(len(owner)) - np.repeat(offsets(per)[:-1], per))
        top = isqrt((P - 1) // width) + 1  # width * (top - 1)^2 < P
        lags = width if scale > SMALLEST_BLOCK else 2 * scale - 1
        long = width + lags - 1
        m = 1 << (long - 1).bit_length()
        small = np.zeros(len(words) + 2 * scale + long)
        small[: len(words)] = words % top
        squares = np.zeros(len(small) + 1)
        np.cumsum(small * small, out=squares[1:])
        at_block = np.lib.stride_tricks.sliding_window_view(small, width)
        at_window = np.lib.stride_tricks.sliding_window_view(small, long)
        at_square = np.lib.stride_tricks.sliding_window_view(squares, lags)
        rows = max(1, NUMBERS_AT_ONCE // m)
        for piece in range(low, 2 * scale, lags):
            for r in range(0, len(starts), rows):
                s, t = starts[r:r + rows], owner[r:r + rows]
                w = s + piece
                ok = w + width <= ends[t + 1]
                s, t, w = s[ok], t[ok], w[ok]
                block = at_block[s]
                own = np.einsum("ij,ij->i", block, block)
                apart = own[:, None] + at_square[w + width] - at_square[w] - 2 * products(block, at_window[w], m)
                i, lag = np.nonzero(apart == 0)
                s, t, dist = s[i], t[i], lag + piece
                ok = s + dist + width <= ends[t + 1]
                s, t, dist = s[ok], t[ok], dist[ok]
                right = _extent(s, dist, ends[t + 1] - s - dist, 1, words, hashes)
                ok = right >= width
                s, t, dist, right = s[ok], t[ok], dist[ok], right[ok]
                left = _extent(s, dist, s - ends[t], -1, words, hashes)
                length = left + dist + right
                ok = length >= np.maximum(least, periods * dist)
                if ok.any():
                    found.append(_merged(t[ok], (s - left)[ok], (s - left + length)[ok], dist[ok]))
        scale *= 2
    none = np.zeros(0, np.int64)
    return _merged(*map(np.concatenate, zip(*found))) if found else (none, none, none, none)


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST, periods: int = PERIODS):
    """(doc, start, length, period) of every run, by doc, start and length; starts are counted within the text.

    ``words`` are whole numbers that stand for words, ``ends`` the bounds of the texts. ``least`` must be 24 or more and
    ``periods`` 3 or more: shorter runs need not hold a block and its copy.
    """
    if least < 3 * SMALLEST_BLOCK or periods < 3:
        raise ValueError("runs have at least 24 words and 3 periods")
    doc, start, end, period = _search(words, ends, _prefix_hashes(words), least, periods)
    if not all(np.array_equal(words[s:e - q], words[s + q:e]) for s, e, q in zip(start, end, period)):
        doc, start, end, period = _search(words, ends, None, least, periods)
    return doc, start - ends[doc], end - start, period


def _best(runs: list[dict]) -> dict:
    """The run of the greatest length / period; of equal ones that of the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]))


def examined(texts: list[str], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, list[dict], dict | None, str]]:
    """(words, runs, best run, collapsed text) of each text: words in a run after its first period are dropped."""
    split = [t.encode().split() for t in texts]  # of bytes: at space, \t, \n, \v, \f and \r
    number = defaultdict(count().__next__)
    ends = offsets(np.fromiter(map(len, split), np.int64, len(split)))
    words = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(ends[-1]))
    doc, start, length, period = find_runs(words, ends, least, periods)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for t, ws in enumerate(split):
        a, b = bounds[t], bounds[t + 1]
        runs, best = [], None
        if a < b:
            order = a + np.lexsort((period[a:b], start[a:b]))
            s, n, q = start[order], length[order], period[order]
            runs = [dict(zip(("start", "length", "period"), r)) for r in zip(s.tolist(), n.tolist(), q.tolist())]
            best = _best(runs)
            cover = np.zeros(len(ws) + 1, np.int64)
            np.add.at(cover, s + q, 1)
            np.add.at(cover, s + n, -1)
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
        out.append((int(ends[t + 1] - ends[t]), runs, best, b" ".join(ws).decode()))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of struct start, length, period, by start, then period), best
    (the run with the greatest length / period, or null) and collapsed (the words kept, joined by one space).

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Repeated rows are examined each for
    itself, ids may be null or repeated; no rows give no rows. Other columns are not read, whatever their names. Texts are
    read whole; memory grows with the longest one, not with the batch.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in arrow_chunks(batch.column(1), BYTES_AT_ONCE):
                n, runs, best, collapsed = zip(*examined(texts, least, periods))
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(runs, pa.list_(SCHEMA)), pa.array(best, SCHEMA), pa.array(collapsed, pa.string())],
                    names=["doc_id", "n_words", "runs", "best", "collapsed"])

    kind = "struct<start:long,length:long,period:long>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{kind}>, best {kind}, collapsed string")


def with_planted_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The texts of a tenth of the documents, chosen by crc32 of the id, made periodic from some word on; the others, texts
    without a word and documents without an id stay as they are."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("__w")
    parts = docs.withColumn("__w", F.when(h % 10 == 0, words))
    parts = parts.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", 1 + F.floor((n - F.col("__a")) / (3 + g % 8)))
    place: Column = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(
        "__w", (1 + F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))).cast("int")))
    return parts.withColumn(text, F.when((h % 10 == 0) & (n > 0), F.array_join(place, " ")).otherwise(F.col(text))).drop("__w", "__a", "__p")
