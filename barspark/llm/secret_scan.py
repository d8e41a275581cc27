"""Secret scans by two character Markov models, with DataFrame functions only.

Base patterns find assignments, access keys and hexadecimal strings. The models add what has no pattern: one is a chain of
characters as random strings have them, the other as ordinary identifiers and words have them. A token of at least
sixteen characters is a secret if the log-likelihood ratio of the two is positive enough per character.

Both are trained from labelled samples in the corpus: random are the values that the base patterns find, ordinary the long
tokens of letters only or digits only that no base span touches. Spark counts their character pairs over all documents; the driver gets
one row per pair of symbols, 69 x 69 at most. The log ratios go into the scoring expression as an array.

Spark's regular expressions give no positions. Those of a pattern's matches follow from the pieces between them: the text
split by a pattern and the matches taken in turn add up to the text.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ROW, keyed
from barspark.operators.passage import extremes, first_index, once
from barspark.session import stored

KINDS = ("assign", "access", "hex", "random")
# fixed values: the base patterns; lookahead-free, so that matches and pieces alternate
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of [0-9a-f]+ don't touch, so those of 24 and more are the matches that pass
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
VALUE_LEAST, ACCESS_LEAST = 6, 20
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
OTHER = len(ALPHABET)
SYMBOLS = OTHER + 1
#: Ordinary by label: long words, and numbers (of cards, of accounts, times).
ORDINARY = "^([A-Za-z]+|[0-9]+)$"
BLOCK = 512
#: Mean log-likelihood ratio per character, in nats, from which a token counts as random.
THRESHOLD = 0.35
SMOOTHING = 0.5


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def spans(text: Column, pattern: str, kind: str, passes=None, rare: bool = True) -> Column:
    """array<struct<s, k, e, v>> of the matches of a pattern: start, place of the kind, end (code points), the match.

    Positions are running totals. An array that grows by a match is copied each time, so matches are taken in blocks of
    BLOCK, and only whole blocks are appended to each other: linear in the text up to millions of matches.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    pairs = F.zip_with(between, found, lambda piece, v: F.struct(F.char_length(piece).alias("p"), F.char_length(v).alias("n"), v.alias("v")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        span = F.struct(start.alias("s"), F.lit(KINDS.index(kind)).alias("k"), (start + x["n"]).alias("e"), x["v"].alias("v"))
        return F.struct((start + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def moved(m: Column, by: Column) -> Column:
        return F.struct((m["s"] + by).alias("s"), m["k"].alias("k"), (m["e"] + by).alias("e"), m["v"].alias("v"))

    def append(acc: Column, block: Column) -> Column:
        own = F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)
        return F.aggregate(F.array(own), acc, lambda a, x: F.struct(
            (a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda m: moved(m, a["at"])))).alias("out")))

    # the piece after the last match has no partner
    cut = F.transform(F.array(F.filter(pairs, lambda x: x["v"].isNotNull())), lambda all_: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, BLOCK)))
    none = F.array().cast("array<array<struct<s:int,k:int,e:int,v:string>>>")
    taken = F.aggregate(F.flatten(cut), F.struct(F.lit(0).alias("at"), none.alias("out")), append, lambda acc: F.flatten(acc["out"]))
    if rare:
        taken = F.when(text.rlike(pattern), taken).otherwise(empty)
    return F.filter(taken, passes) if passes else taken


def base_spans(text: Column) -> Column:
    value = lambda m: F.char_length(F.regexp_extract(m["v"], ASSIGN, 2)) >= VALUE_LEAST
    return F.concat(spans(text, ASSIGN, "assign", value), spans(text, ACCESS, "access", lambda m: F.char_length(m["v"]) >= ACCESS_LEAST), spans(text, HEX, "hex"))


def _code(c: Column) -> Column:
    """Symbol of a character: its place in the alphabet, else OTHER."""
    place = F.instr(F.lit(ALPHABET), c)
    return F.when(place > 0, place - 1).otherwise(F.lit(OTHER))


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(a, b, n): how often symbol b follows a in the column ``t``."""
    chars = tokens.select("t", F.explode(F.sequence(F.lit(1), F.char_length("t") - 1)).alias("i"))
    pairs = chars.select(_code(F.expr("substring(t, i, 1)")).alias("a"), _code(F.expr("substring(t, i + 1, 1)")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def train(found: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of symbols, from rows of spans ``base`` and ``tokens`` (free of base spans)."""
    value = lambda m: F.when(m["k"] == 0, F.regexp_extract(m["v"], ASSIGN, 2)).otherwise(m["v"])
    secret = found.select(F.explode("base").alias("m")).select(value(F.col("m")).alias("t"))
    plain = found.select(F.explode(F.filter("tokens", lambda m: m["v"].rlike(ORDINARY))).alias("m")).select(F.col("m.v").alias("t"))
    logs = []
    for tokens in (secret, plain):
        rows = pair_counts(tokens.where(F.char_length("t") > 1)).collect()  # at most SYMBOLS squared rows
        n = [[SMOOTHING] * SYMBOLS for _ in range(SYMBOLS)]
        for r in rows:
            n[r.a][r.b] += r.n
        # a row of the table leans on the symbols' overall shares, so that a rare first symbol says little
        total = sum(map(sum, n))
        share = [sum(row[b] for row in n) / total for b in range(SYMBOLS)]
        logs.append([math.log((x + SYMBOLS * share[b]) / (sum(row) + SYMBOLS)) for row in n for b, x in enumerate(row)])
    return [r - o for r, o in zip(*logs)]


def _untouched(found: DataFrame) -> DataFrame:
    """``tokens`` without those that touch a base span. Spans of one pattern are disjoint and in order: the first that ends after
    a token's start is found by index and is the only one to look at."""
    kinds = range(3)
    own = found.withColumns({f"b{k}": F.filter("base", lambda m: m["k"] == k) for k in kinds})
    own = once(own, {f"e{k}": extremes(F.transform(f"b{k}", lambda m: m["e"]), "max") for k in kinds})

    def touched(m: Column, k: int) -> Column:
        at = first_index(F.col(f"e{k}"), F.lit(0), lambda e: e > m["s"])
        return F.coalesce(F.get(f"b{k}", at)["s"] < m["e"], F.lit(False))

    free = F.filter("tokens", lambda m: ~(touched(m, 0) | touched(m, 1) | touched(m, 2)))
    return own.withColumn("tokens", free).select(*found.columns)


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), _code)
    lookup = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folded into one constant
    total = F.aggregate(
        codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.element_at(lookup, acc["last"] * SYMBOLS + c + 1)).otherwise(0.0)).alias("sum")),
        lambda acc: acc["sum"])
    return total / (F.char_length(token) - 1)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, row: str | None = None) -> DataFrame:
    """One row per input row: ``__row``, doc_id, base and found (arrays of struct s, k, e, v: start, index into KINDS, end, match).

    ``found`` has the base spans and, added by the models, tokens that touch none of them; both are sorted by start, then
    kind. Null and empty texts have no spans. Repeated rows are scanned each for itself. No rows give no rows; without any
    base span in the corpus the random model is uniform over the symbols. Other columns are not read.
    """
    rows = keyed(docs, doc_id, row).select(ROW, F.col(doc_id).alias("doc_id"), _text(F.col(text)).alias("text"))
    found = rows.select(ROW, "doc_id", F.array_sort(base_spans(F.col("text"))).alias("base"), spans(F.col("text"), TOKEN, "random", rare=False).alias("tokens"))
    found = stored(_untouched(found))  # the one pass over the texts; what is left is some spans a document
    table = train(found)
    own = F.filter("tokens", lambda m: ratio(m["v"], table) >= threshold)
    return found.select(ROW, "doc_id", "base", F.array_sort(F.concat("base", own)).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["k"] + 1), m["s"], m["e"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda m: m["k"] == KINDS.index(kind))).cast("long")
