"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The tagger is trained in numpy from labelled spans: pieces of the corpus around a digit or an at sign, labelled by the base
patterns, and variants of them whose labels follow from how they are made (a phone number without its country code, a
card number in groups), so that it learns the look of each kind and not the pattern.

A text is tagged in windows of 96 characters, one every 48. Each character takes its tag from the window in which it
stands farthest from an edge, so that the tags of a text are one sequence, and spans are read from that. Every kind has a
digit or an at sign; windows that have none, and whose neighbours have none, are untagged. Spans that the tagger adds must
have their kind's necessary parts (digits, an at sign) and touch no base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm import tagger
from barspark.llm.common import ROW, keyed

KINDS = ("email", "ip", "card", "phone")
#: The documented bound of the sample that the tagger is trained on: pieces of at most 100 characters.
SAMPLE_PIECES = 1000
EPOCHS = 10
WINDOW, STRIDE = 96, 48
#: Tags: 0 outside, then first and further characters of each kind.
TAGS = 1 + 2 * len(KINDS)
ALLOWED = np.zeros((TAGS, TAGS), np.float32)
for _a in range(TAGS):
    for _k in range(len(KINDS)):
        if _a not in (1 + 2 * _k, 2 + 2 * _k):
            ALLOWED[_a, 2 + 2 * _k] = tagger.FORBIDDEN
# symbols: 0 padding, 1 any other, 2 lower, 3 upper, 4 digits, 5 beyond ASCII, then these one by one
SINGLES = "@.-+()_%,:;/ \n\"'=#"
SYMBOL = np.ones(128, np.uint8)
SYMBOL[97:123] = 2
SYMBOL[65:91] = 3
SYMBOL[48:58] = 4
for _i, _c in enumerate(SINGLES):
    SYMBOL[ord(_c)] = 6 + _i
SYMBOLS = 6 + len(SINGLES)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match never begins within digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
SEED = re.compile(r"[0-9@]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_card(s: str) -> bool:
    d = NOT_DIGIT.sub("", s)
    return 12 <= len(d) <= 19 and luhn(d)


def is_ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def base_spans(t: str) -> list[Span]:
    """(start, kind, end) of the base patterns, sorted. Every pattern is searched in time linear in the text."""
    out, end, at = [], 0, t.find("@")
    while at >= 0:  # a match needs an at sign; to its left it takes all characters allowed after the match before
        start = at
        while start > end and t[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(t, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            end = m.end()
        at = t.find("@", max(at + 1, end))
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if is_ip(m.group())]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if is_card(m.group())]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def symbols(t: str) -> np.ndarray:
    code = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return np.where(code < 128, SYMBOL[np.minimum(code, 127)], 5).astype(np.uint8)


def tags(t: str, spans: list[Span]) -> np.ndarray:
    out = np.zeros(len(t), np.int64)
    for s, k, e in spans:
        if not out[s:e].any():  # where kinds overlap, the earlier span has the characters
            out[s] = 1 + 2 * k
            out[s + 1:e] = 2 + 2 * k
    return out


def variants(t: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """Pieces made from a labelled one, with their labels."""
    out = []
    for s, k, e in spans:
        v = t[s:e]
        if k == 3:
            new = re.sub(r"^\+[0-9]+[\x20.-]*", "", v)
        elif k == 2:
            d = NOT_DIGIT.sub("", v)
            new = ".".join(d[i:i + 4] for i in range(0, len(d), 4))
        else:
            continue
        if new != v:
            out.append((t[:s] + new + t[e:], [(s, k, s + len(new))]))
    return out


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pieces: int = SAMPLE_PIECES, epochs: int = EPOCHS) -> tagger.Params | None:
    """The tagger, from the ``pieces`` pieces with the least hashes; None if no text has a digit or an at sign."""
    some = docs.where(F.col(text).cast("string").rlike("[0-9@]"))
    found = some.select(F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(r"[^\n]{0,40}[0-9@][^\n]{0,59}"), F.lit(0))).alias("piece"))
    rows = [r.piece for r in found.distinct().orderBy(F.xxhash64("piece"), "piece").limit(pieces).collect()]
    if not rows:
        return None
    cases = []
    for t in rows:
        spans = base_spans(t)
        for u, s in [(t, spans), *variants(t, spans)]:
            labels = sorted([*s, *(b for b in base_spans(u) if not any(a[0] < b[2] and b[0] < a[2] for a in s))])
            cases.append((u[:WINDOW], tags(u, labels)[:WINDOW]))
    x, y = np.zeros((len(cases), WINDOW), np.int64), np.zeros((len(cases), WINDOW), np.int64)
    for i, (t, tag) in enumerate(cases):
        x[i, :len(t)], y[i, :len(t)] = symbols(t), tag
    return tagger.train(tagger.init(SYMBOLS, TAGS), ALLOWED, x, y, epochs)


def necessary(kind: int, s: str) -> bool:
    digits = len(NOT_DIGIT.sub("", s))
    if kind == 0:
        name, _, host = s.partition("@")
        return bool(name and HOST.fullmatch(host)) and not re.search(r"\s", s)
    return (True, is_ip(s), is_card(s), 9 <= digits <= 15 and not re.search(r"[A-Za-z]", s))[kind]


def windows(t: str) -> list[int]:
    """The numbers of the windows to tag: those with a digit or an at sign, and their neighbours."""
    last = max(0, -(-(len(t) - WINDOW) // STRIDE))
    near = set()
    for m in SEED.finditer(t):
        k = m.start() // STRIDE
        near.update((k - 2, k - 1, k, k + 1))
    return sorted(k for k in near if 0 <= k <= last)


def added_spans(texts: list[str], base: list[list[Span]], model: tagger.Params) -> list[list[Span]]:
    """What the tagger adds to each text."""
    picked = [windows(t) for t in texts]
    x = np.zeros((sum(map(len, picked)), WINDOW), np.uint8)
    i = 0
    for t, ks in zip(texts, picked):
        s = symbols(t) if ks else None
        for k in ks:
            piece = s[k * STRIDE:k * STRIDE + WINDOW]
            x[i, :len(piece)] = piece
            i += 1
    y, out, i = tagger.decode(model, ALLOWED, x), [], 0
    margin = (WINDOW - STRIDE) // 2
    for t, ks, known in zip(texts, picked, base):
        tag = np.zeros(len(t), np.int8)
        last = max(0, -(-(len(t) - WINDOW) // STRIDE))
        for k in ks:
            lo = 0 if k == 0 else k * STRIDE + margin
            hi = len(t) if k == last else min(len(t), k * STRIDE + margin + STRIDE)
            tag[lo:hi] = y[i, lo - k * STRIDE:hi - k * STRIDE]
            i += 1
        spans, at = [], 0
        for p in np.flatnonzero(tag):
            if p < at or not tag[p]:
                continue
            k, e = (tag[p] - 1) // 2, p + 1
            while e < len(t) and tag[e] == 2 + 2 * k:
                e += 1
            at = e
            s = int(p)
            while s < e and t[s].isspace():
                s += 1
            while e > s and t[e - 1].isspace():
                e -= 1
            if s > 0 and t[s - 1] == "(" and ")" in t[s:e]:  # a bracket that the span closes is its own
                s -= 1
            if s < e and necessary(k, t[s:e]) and not any(a < e and s < b for a, _, b in known):
                spans.append((s, int(k), int(e)))
        out.append(spans)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def detect(docs: DataFrame, model: tagger.Params | None, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row per input row: ``__row``, doc_id, n_email, n_ip, n_card, n_phone, base, spans (kind:start:end, comma-joined).

    The counts and ``base`` are of the base patterns, ``spans`` has the tagger's too. Null and empty texts have none; they,
    and all texts without a digit or an at sign, don't go to Python. Repeated rows are scanned each for itself. Without a
    model (no text of the sample had a digit or an at sign) only the patterns count. Other columns are not read.
    """
    rows = keyed(docs, doc_id, row).select(ROW, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    @F.pandas_udf(", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            base = [base_spans(t) if t else [] for t in texts]
            more = [[] for _ in texts]
            where = [i for i, t in enumerate(texts) if t]
            for a in range(0, len(where), 256):
                part = where[a:a + 256]
                if model is not None:
                    for i, spans in zip(part, added_spans([texts[i] for i in part], [base[i] for i in part], model)):
                        more[i] = spans
            yield pd.DataFrame({
                **{f"n_{k}": pd.Series([sum(s[1] == j for s in b) for b in base], dtype="int64") for j, k in enumerate(KINDS)},
                "base": pd.Series(map(joined, base), dtype=object), "spans": pd.Series([joined(b + m) for b, m in zip(base, more)], dtype=object)})

    found = rows.withColumn("x", scan(F.when(F.col("text").rlike("[0-9@]"), F.col("text"))))
    return found.select(ROW, "doc_id", "x.*")
