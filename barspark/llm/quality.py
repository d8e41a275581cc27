"""A quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. One lookup table per feature, and one per chosen pair of features, add up to
the log-odds of quality. The tables are learned by cyclic boosting: again and again, feature by feature, a tree of two
splits is fitted to the current gradients by Newton steps and a small share of it added to that feature's table. When the
single features are done, the pairs with the largest gain of a coarse two-way split on what is left get tables too, by
trees that split one of the two and then each side on the other. A score is the sum of a text's table entries: all bins of
a batch are found and added at once.

Features are made in one pass over the texts and stored; training takes a bounded sample of labelled rows from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ROW, chunks, held_out, keyed, offsets
from barspark.session import stored

#: The documented bound of the labelled sample.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
BINS = 32
COARSE = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.1
RIDGE = 2.0
CHARS_AT_ONCE = 1 << 19
FEATURES = ("log_bytes", "upper", "symbols", "digits", "blanks", "stops", "word_length", "bare_words", "word_variety", "word_echo", "line_variety", "line_length")

# classes of bytes: 0 other symbols, 1 lower and beyond ASCII, 2 upper, 3 digits, 4 blanks, 5 line feeds, 6 stops within sentences
KIND = np.zeros(256, np.uint8)
KIND[97:123] = KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
KIND[0x0A] = 5
KIND[[ord(c) for c in ".,;:?'-"]] = 6


def features(texts: list[str]) -> np.ndarray:
    """One row per text (one at least); ratios of nothing are 0."""
    encoded = [t.encode() for t in texts]
    cut = offsets(np.fromiter((len(t) + 1 for t in encoded), np.int64, len(texts)))
    kind = KIND[np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)]
    n = np.stack([np.add.reduceat(kind == k, cut[:-1], dtype=np.int64) for k in range(7)], axis=1).astype(float)
    n[:, 5] -= 1
    size = n.sum(axis=1)
    letters = n[:, 1] + n[:, 2]
    blank = (kind == 4) | (kind == 5)
    first = ~blank & np.concatenate([[True], blank[:-1]])
    words = np.add.reduceat(first, cut[:-1], dtype=np.int64).astype(float)
    # words without a letter or digit: runs whose bytes are all symbols or stops
    where = np.flatnonzero(first)
    some = np.maximum.reduceat((kind >= 1) & (kind <= 3), where) if len(where) else np.zeros(0, bool)
    bare = np.bincount(np.searchsorted(cut, where[~some], side="right") - 1, minlength=len(texts))[: len(texts)]
    variety, echo, lines, line_variety = np.zeros((4, len(texts)))
    for i, t in enumerate(texts):
        w, rows = t.split(), t.split("\n")
        variety[i] = len(set(w)) / np.sqrt(len(w)) if w else 0
        echo[i] = sum(map(eq, w, w[1:])) / len(w) if w else 0
        lines[i], line_variety[i] = len(rows), len(set(rows)) / len(rows)
    per = lambda a, b: np.divide(a, b, out=np.zeros(len(texts)), where=b > 0)
    return np.stack([np.log2(1 + size), per(n[:, 2], letters), per(n[:, 0], size), per(n[:, 3], size), per(n[:, 4] + n[:, 5], size), per(n[:, 6], size),
                     per(size - n[:, 4] - n[:, 5], words), per(bare, words), variety, echo, line_variety, per(size, lines)], axis=1)


def with_features(rows: DataFrame, text: str) -> DataFrame:
    kind = ", ".join(f"{f} double" for f in FEATURES)

    @F.pandas_udf(kind)
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [features(run) for _, run in chunks(texts, CHARS_AT_ONCE)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(FEATURES))), columns=list(FEATURES))

    return rows.withColumn("f", make(text)).select(ROW, "doc_id", "f.*")


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.single):
            out += t[bins[:, j]]
        for (a, b), t in self.pairs.items():
            out += t[bins[:, a], bins[:, b]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30))) if len(x) else np.zeros(0)


def _best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of a row of bins; 0 if there is none."""
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(lg):
        return 0.0, 0
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The Newton step of each bin by a tree of up to three leaves over one feature."""
    cuts = [0, len(g)]
    for _ in range(2):
        found = [(*_best_split(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:])]
        gain, k, a = max(found)
        if gain <= 1e-9:
            break
        cuts = sorted({*cuts, a + k})
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps) of the better of the two trees that split one axis and then each side on the other."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        G, H = (g.T, h.T) if turn else (g, h)
        whole = G.sum() ** 2 / (H.sum() + RIDGE)
        for k in range(1, len(G)):
            out, gain = np.zeros_like(G), -whole
            for a, b in ((0, k), (k, len(G))):
                gg, hh = G[a:b].sum(axis=0), H[a:b].sum(axis=0)
                _, c = _best_split(gg, hh)
                for lo, hi in ((0, c), (c, len(gg))):
                    if lo < hi:
                        out[a:b, lo:hi] = gg[lo:hi].sum() / (hh[lo:hi].sum() + RIDGE)
                        gain += gg[lo:hi].sum() ** 2 / (hh[lo:hi].sum() + RIDGE)
            if gain > best[0]:
                best = (gain, out.T if turn else out)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits the tables. Without rows, or with one label only, the model is that label's smoothed share."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = Model(edges, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [np.zeros(len(e) + 1) for e in edges])
    if not len(x) or y.min() == y.max():
        return model
    bins = model.bins(x)
    at = np.full(len(y), model.base)

    def sums(index, n):
        p = 1 / (1 + np.exp(-at))
        return np.bincount(index, y - p, n), np.bincount(index, p * (1 - p), n)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.single):
            step = RATE * _tree(*sums(bins[:, j], len(t)))
            t += step
            at += step[bins[:, j]]
    # pairs are chosen and grown on coarse bins, then spread over the fine ones
    fold = [np.arange(len(t)) * min(COARSE, len(t)) // len(t) for t in model.single]
    wide = [int(f[-1]) + 1 for f in fold]
    coarse = np.stack([f[bins[:, j]] for j, f in enumerate(fold)], axis=1)
    cell = lambda a, b: coarse[:, a] * wide[b] + coarse[:, b]
    grid = lambda a, b: [s.reshape(wide[a], wide[b]) for s in sums(cell(a, b), wide[a] * wide[b])]
    gains = sorted(((_pair_tree(*grid(a, b))[0], a, b) for a, b in combinations(range(len(FEATURES)), 2)), reverse=True)
    chosen = [(a, b) for g, a, b in gains[:PAIRS] if g > 0]
    small = {k: np.zeros((wide[k[0]], wide[k[1]])) for k in chosen}
    for _ in range(PAIR_ROUNDS):
        for a, b in chosen:
            step = RATE * _pair_tree(*grid(a, b))[1]
            small[a, b] += step
            at += step.ravel()[cell(a, b)]
    model.pairs = {(a, b): t[np.ix_(fold[a], fold[b])] for (a, b), t in small.items()}
    return model


def fit(made: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on labelled rows that aren't held out: all, or the ``sample_rows`` whose ids have the least hashes. A row
    labelled more than once counts once, with its highest label; null labels and ids are passed over."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = made.join(F.broadcast(some), "doc_id")  # at most sample_rows ids
    rows = rows.dropDuplicates(["doc_id"]).select("doc_id", *FEATURES, "y").toPandas().sort_values("doc_id")
    return train(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), (rows["y"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per input row: ``__row``, doc_id, score (0 to 1), predicted (1 if score >= 0.3).

    Only the text decides. Null texts are empty; empty texts are scored like any other. Repeated rows get the same score.
    Without labels every score is a half. No rows give no rows. Other columns are not read.
    """
    rows = keyed(docs, doc_id, row).select(ROW, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = stored(with_features(rows, "text"))
    model = fit(made, labels)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    out = made.select(ROW, "doc_id", score(*FEATURES).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
