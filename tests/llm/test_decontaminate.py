import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barspark.llm import decontaminate
from barspark.llm.decontaminate import contamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, size=10):
    wins = {}
    for i, t, *_ in bench:
        w = words(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + size]), set()).add(i)
    out = []
    for d, t, *_ in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[s:s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    items |= {str(i) for i in found if i is not None}
        ids = ",".join(sorted(items))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def check(spark, docs, bench, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = contamination(d, b, **how).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs, bench)
    return got


LONG = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, None, "x"), (2, "", "x"), (3, "... !!", ""), (4, LONG, None), (5, "One, TWO-three four/five six seven eight nine tex " + LONG.upper(), ""), (None, LONG, ""),
        (6, "pad " * 30000 + LONG + " pad" * 3 + " " + LONG, ""), (7, "two three four five six seven eight nine ten", ""), (8, "Ünï Ödd a1 b2", ""), (8, "Ünï Ödd a1 b2", ""),
        (9, "solo", ""), (10, "É é", ""), (11, "repeat " * 25, ""), (12, "one\x80two", "")]
BENCH = [(10, LONG), (9, LONG), (None, LONG), (100, "solo"), (3, "Ünï Ödd A1"), (4, None), (5, "?!"), (6, "repeat " * 11), (6, "repeat " * 11), (7, "é"), (2, "two three four five six seven eight nine ten")]


def test_edge_cases(spark):
    got = check(spark, DOCS, BENCH)
    assert sum(r.contaminated for r in got) == 10
    check(spark, DOCS, BENCH, block_windows=1)  # a scan per block of one window
    check(spark, DOCS, BENCH[:1])
    d = spark.createDataFrame(DOCS, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(BENCH, "item_id long, text string")
    assert contamination(d.limit(0), b).count() == 0
    assert {(r.n_hit, r.contaminated) for r in contamination(d, b.limit(0)).collect()} == {(0, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_of_few_words(spark, seed):
    """Six different words only, so windows overlap, repeat and share every shingle."""
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abcdef"[: r.randrange(2, 7)]) for _ in range(n))
    bench = [(i, text(r.randrange(1, 14))) for i in range(12)]
    docs = [(i, text(r.randrange(0, 60)) + " " + r.choice(bench)[1] + " " + text(5), None) for i in range(60)]
    check(spark, docs, bench)


def test_a_passage_in_ten_thousand_items(spark, monkeypatch):
    """All windows of a passage of fifty words share one set of items, which is dealt in pieces; no list is broadcast."""
    monkeypatch.setattr(decontaminate, "PIECE", 500)
    passage = " ".join(f"w{i}" for i in range(50))
    bench = [(i, f"x{i} y{i} {passage} z{i % 7}" if i % 3 else passage) for i in range(10_000)]
    docs = [(k, f"{'pad ' * k}{passage} {'tail ' * k}", None) for k in range(40)] + [(90, bench[1][1], None), (91, "clean text of other words", None)]
    check(spark, docs, bench)
    wins, named = decontaminate.item_windows(spark.createDataFrame(bench, "item_id long, text string"), "item_id", "text", 10)
    of, members = decontaminate.item_sets(named)
    assert wins.count() > 13_000 and members.groupBy("set").count().agg(F.max("count")).first()[0] == 10_000
    assert of.groupBy("set").count().agg(F.max("count")).first()[0] == 41
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string, n_words string"), spark.createDataFrame(bench, "item_id long, text string"), with_items=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("items#" in line for line in plan.splitlines() if "BroadcastExchange" in line)
    assert {len(r["items"]) for r in got.collect()} == {0, 10_000}


def test_sets_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_mark", lambda salt: F.lit(salt))
    texts = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota", "one two three"]
    bench = [(i, texts[i % 4]) for i in range(8)] + [(i, texts[0]) for i in range(20, 23)]
    check(spark, [(k, f"a {texts[k % 4]} b {texts[(k + 1) % 4]}", None) for k in range(8)], bench)
