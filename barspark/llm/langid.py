"""Language identification by cross-parsing entropy.

Of each language a bounded sample of labelled text becomes a reference, and the reference a suffix automaton. A text is
parsed greedily against each automaton into the longest phrases that occur in the reference; few long phrases mean that
the text looks like the reference. With c phrases over n symbols and a reference of N symbols the cross-parsing entropy is
c * log2(N) / n bits a symbol, and the language with the least wins.

Texts are reduced to symbols first: letters without case, and one blank for any run of other characters. Whole texts are
parsed, in blocks of 1024 symbols: a phrase ends with its block, alike for all languages, so that all blocks of a batch
advance together, one symbol a step, by a lookup in the automata's transitions. Each letter of the references has a symbol
of its own, however many there are: transitions by the most frequent ones are in a table, those by others in a hash table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import arrow_chunks, held_out, offsets
from barspark.session import ship

#: The documented bounds of the labelled sample: so many documents of each language, so many characters of each.
SAMPLE_DOCS = 96
SAMPLE_CHARS = 300
BLOCK = 1024
CHARS_AT_ONCE = 1 << 20
#: Symbols with a column in the transition table; further ones are looked up by hash, with the same result.
COLUMNS = 64
UNKNOWN = "und"
#: A text of at least MIN_SYMBOLS whose phrases have fewer symbols than this on average is of no known language: hardly any
#: two of its letters stand together in a reference. A language of so many letters that its own sample has phrases nearly as
#: short (see ``_least``) gets a lower bound.
MIN_PHRASE = 1.5
MIN_SYMBOLS = 32


@dataclass(frozen=True)
class Model:
    """Reference text of each language; everything else follows from it, in whatever process needs it."""

    languages: tuple[str, ...]
    references: tuple[str, ...]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Each code point without case; a letter whose lower case is not one letter stands for itself."""
    out = np.arange(0x110000, dtype=np.int32)
    for i in np.flatnonzero(_letters()).tolist():
        x = chr(i).lower()
        if len(x) == 1 and x.isalpha():
            out[i] = ord(x)
    return out


def _alphabet(texts: list[str]) -> np.ndarray:
    """Symbol of each code point: 0 for the blank, 1 for letters that are in none of the texts, then by falling frequency."""
    folded, letters = _folded(), _letters()
    seen = Counter(int(folded[ord(c)]) for t in texts for c in t if letters[ord(c)])
    out = letters.astype(np.min_scalar_type(len(seen) + 1))
    out[sorted(seen, key=lambda x: (-seen[x], x))] = np.arange(2, len(seen) + 2)
    return out[folded]


def _symbols(texts: list[str], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, the offsets of each, and whether it has a letter."""
    cut = offsets(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = lut[code]
    keep = s != 0
    keep[1:] |= s[:-1] != 0  # the first blank after a letter stays
    return s[keep], offsets(np.add.reduceat(keep, cut[:-1], dtype=np.int64)), np.maximum.reduceat(s, cut[:-1]) > 0


def _automaton(s: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 first."""
    to: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in s:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
        last = new
    return to


def _least(s: list[int]) -> float:
    """MIN_PHRASE, or halfway from 1 to the mean phrase of the second half of a reference in the first, if that is less."""
    first, second = s[: len(s) // 2], s[len(s) // 2:]
    to = _automaton(first)
    phrases, p = 0, -1
    for c in second:
        p = to[p].get(c, -1) if p >= 0 else -1
        if p < 0:
            phrases, p = phrases + 1, to[0].get(c, -1)
    return min(MIN_PHRASE, (1 + len(second) / max(1, phrases)) / 2)


class Sparse:
    """Values of int64 keys, -1 for others: open addressing, all keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of keys that meet in a slot one stays
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            at, left = (at[~placed] + 1) & self.mask, left[~placed]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        found, out = self.keys[at], self.values[at]
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found[left], out[left] = self.keys[at[left]], self.values[at[left]]
            left = left[(found[left] != keys[left]) & (found[left] >= 0)]
        return out


@dataclass(frozen=True)
class Tables:
    lut: np.ndarray  #: symbol of each code point
    near: np.ndarray  #: next states by state and symbol, for the first ``width`` symbols
    far: Sparse | None  #: by state * symbols + symbol, for the others
    fresh: np.ndarray  #: state in which a new phrase starts, by language and symbol
    starts: np.ndarray  #: first state of each language
    logs: np.ndarray  #: log2 of each reference
    least: np.ndarray  #: mean phrase under which a text isn't of a language
    width: int
    symbols: int


@lru_cache(maxsize=2)
def _tables(model: Model) -> Tables:
    """States are numbered by ``width``, so that state + c is an entry of ``near``.

    The entry is the next state; where no phrase goes on it is ~ of the state that a new phrase starts with. A symbol that
    a reference lacks leads to a dead state, which nothing leaves but by a new phrase.
    """
    lut = _alphabet(list(model.references))
    symbols = int(lut.max()) + 1
    width = min(symbols, COLUMNS)
    parts, starts, logs, least, fresh, keys, values, base = [], [], [], [], [], [], [], 0
    for text in model.references:
        s, _, _ = _symbols([text], lut)
        to = _automaton(s.tolist())
        n = len(to)
        root = np.full(symbols, n, np.int32)
        for c, q in to[0].items():
            root[c] = q
        root = (root + base) * width
        t = np.tile(~root[:width], (n + 1, 1))
        for p, row in enumerate(to):
            for c, q in row.items():
                if c < width:
                    t[p, c] = (q + base) * width
                else:
                    keys.append((p + base) * width * symbols + c)
                    values.append((q + base) * width)
        parts.append(t)
        fresh.append(root)
        starts.append(base * width)
        logs.append(np.log2(max(2, len(s))))
        least.append(_least(s.tolist()))
        base += n + 1
    far = Sparse(np.array(keys, np.int64), np.array(values, np.int32)) if keys else None
    return Tables(lut, np.concatenate(parts).ravel(), far, np.array(fresh), np.array(starts, np.int32), np.array(logs), np.array(least), width, symbols)


def entropies(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits a symbol by text and language, whether the text has a letter, its symbols)."""
    t = _tables(model)
    starts, logs, lut = t.starts, t.logs, t.lut
    s, cut, lettered = _symbols(texts, lut)
    n = np.diff(cut)
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    begin = (np.arange(len(owner)) - np.repeat(offsets(blocks)[:-1], blocks)) * BLOCK + cut[owner]
    size = np.minimum(BLOCK, cut[owner + 1] - begin)
    order = np.argsort(-size, kind="stable")
    owner, begin, size = owner[order], begin[order], size[order]
    state = np.repeat(starts[:, None], len(owner), axis=1)
    phrases = np.ones(state.shape, np.int32)
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
    for step, k in enumerate(live):
        c = s[begin[:k] + step]
        if t.far is None:
            v = t.near[state[:, :k] + c]
        else:
            v = t.near[state[:, :k] + np.minimum(c, t.width - 1)]
            rare = np.flatnonzero(c >= t.width)
            if len(rare):
                x = c[rare].astype(np.int64)
                u = t.far.get(state[:, rare].astype(np.int64).ravel() * t.symbols + np.tile(x, len(starts))).reshape(len(starts), -1)
                v[:, rare] = np.where(u >= 0, u, ~t.fresh[:, x])
        sign = v >> 31
        phrases[:, :k] -= sign
        state[:, :k] = v ^ sign
    total = np.zeros((len(starts), len(texts)))
    for j in range(len(starts)):
        total[j] = np.bincount(owner, phrases[j], len(texts))
    return (total * logs[:, None] / np.maximum(n, 1)).T, lettered, n


def fit(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """References from labelled rows with a letter that aren't held out: of each language the ``docs_per_language`` documents
    whose ids have the least hashes, ``chars`` characters of each from a hashed place of the text, or from its first letter
    if there is none there. The sample is all that the driver receives."""
    known = F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    letter = "\\p{L}"
    lettered = F.col("text").rlike(letter)
    # the number of distinct ids only sets how much is moved, so that a count within a few hundredths will do
    counts = {r["lang"]: r["n"] for r in docs.where(known & lettered).groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not counts:
        return Model((), ())
    unit = lambda *x: F.pmod(F.xxhash64("doc_id", *x), F.lit(1 << 40)) / float(1 << 40)
    place = unit()
    # about four times the sample passes the first cut, so that few texts are moved
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * docs_per_language / max(1, n))))), F.col("lang"))
    begin = F.floor(unit(F.lit("piece")) * (F.greatest(F.length("text") - chars, F.lit(0)) + 1)).cast("int") + 1
    piece = F.col("text").substr(begin, F.lit(chars))
    piece = F.when(piece.rlike(letter), piece).otherwise(F.regexp_extract("text", f"(?s){letter}.{{0,{chars - 1}}}", 0))
    some = docs.where(known & (place < share) & lettered).select("lang", place.alias("place"), "doc_id", piece.alias("piece"))
    some = some.groupBy("lang", "place", "doc_id").agg(F.min("piece").alias("piece"))  # repeated ids count once
    rows = some.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "piece"))).alias("x"))
    found = {r.lang: "\n".join(x.piece for x in r.x) for r in rows.select("lang", F.slice("x", 1, docs_per_language).alias("x")).collect()}
    return Model(tuple(sorted(found)), tuple(found[k] for k in sorted(found)))


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """Adds ``lang_pred``, ``lang_score``, ``lang_bits`` and ``lang_rejected``; columns of those names are replaced.

    A null text or one without a letter is ``und``, score 0, no bits, rejected; so is any text if nothing was learned.
    The score is 1 - e1 / e2 for the least and second least entropy (1 if only one language is known); of equal entropies the first language by name wins, with score 0. ``rejected`` also marks texts whose letters
    hardly ever stand together in any reference. Only the text is looked at, whole. No rows give no rows.
    """
    ship(docs.sparkSession)
    kind = "pred string, score double, bits double, rejected boolean"
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [judge(run) for run in arrow_chunks(batch, CHARS_AT_ONCE)] or [judge([])]
            whole = pd.concat(parts, ignore_index=True)
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(whole[c], t, from_pandas=True) for c, t in zip(whole, types)], names=list(whole))

    def judge(texts: list[str]) -> pd.DataFrame:
        if not model.languages or not texts:
            return pd.DataFrame({"pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "bits": [None] * len(texts), "rejected": [True] * len(texts)}).astype({"bits": float})
        bits, lettered, n = entropies(texts, model)
        best = np.argmin(bits, axis=1)
        low = np.partition(bits, min(1, bits.shape[1] - 1), axis=1)
        e1, e2 = low[:, 0], low[:, min(1, bits.shape[1] - 1)]
        score = np.ones(len(texts)) if bits.shape[1] == 1 else np.where(e2 > 0, 1 - e1 / np.maximum(e2, 1e-12), 0)
        t = _tables(model)
        return pd.DataFrame({
            "pred": names[np.where(lettered, best, len(names) - 1)], "score": np.where(lettered, np.clip(score, 0, 1), 0.0),
            "bits": np.where(lettered, e1, np.nan), "rejected": ~lettered | ((n >= MIN_SYMBOLS) & (e1 * t.least[best] > t.logs[best])),
        })

    fields = ("pred", "score", "bits", "rejected")
    kept = docs.drop(*(prefix + c for c in fields))
    own = "_lid"
    while own in {c.lower() for c in kept.columns}:
        own = "_" + own
    out = kept.withColumn(own, predict(F.col(text).cast("string")))
    return out.select(*(F.col(f"`{c}`") for c in kept.columns), *(F.col(f"{own}.{c}").alias(prefix + c) for c in fields))

