import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm import periodic
from barspark.llm.common import offsets
from barspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=24, periods=3):
    """Every maximal stretch of each period; of one stretch the least period counts."""
    best = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                best.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def found(texts, **kw):
    ends = offsets(np.array([len(t) for t in texts], np.int64))
    words = np.array([w for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for d, s, n, q in zip(*(x.tolist() for x in periodic.find_runs(words, ends, **kw))):
        out[d].append((s, n, q))
    return [sorted(r) for r in out]


def test_transform_is_the_sum_of_powers():
    rng = np.random.default_rng(1)
    for m in (16, 256, 512, 2048):
        x = rng.integers(0, periodic.P, (3, m)).astype(float)
        w = pow(3, (periodic.P - 1) // m, periodic.P)
        for k in (0, 1, m // 2 + 3, m - 1):
            want = [sum(int(v) * pow(w, j * k, periodic.P) for j, v in enumerate(row)) % periodic.P for row in x]
            assert periodic.transform(x, m)[:, k].tolist() == want


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for b, lags, m in ((8, 15, 32), (64, 64, 128), (512, 512, 1024)):
        top = int(((periodic.P - 1) // b) ** 0.5) + 1
        blocks, windows = rng.integers(0, top, (5, b)).astype(float), rng.integers(0, top, (5, b + lags - 1)).astype(float)
        want = [[sum(int(x) * int(y) for x, y in zip(u, v[i:])) for i in range(lags)] for u, v in zip(blocks, windows)]
        assert periodic.products(blocks, windows, m).tolist() == want


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 12)), max_size=4)


@settings(max_examples=150, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=3))
def test_runs_are_brute_force(texts):
    texts = [[w for part, k in t for w in part * k] for t in texts]
    assert found(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("text", [
    [0] * 500, [0] * 200 + [1] + [0] * 200, [0, 1] * 100 + [0] + [0, 1] * 100, list(range(23)) * 9, list(range(170)) * 3 + [7],
    [bin(i).count("1") % 2 for i in range(2048)], list(range(100)) * 2, [0] * 23, [0] * 24,
    [w for k in range(30) for w in [k] + [9, 8] * k]])
def test_hard_texts(text):
    assert found([text, text[::-1]]) == [brute(text), brute(text[::-1])]


def test_colliding_hashes_are_noticed(monkeypatch):
    """With hashes that take everything for equal the word-by-word way gives the same runs."""
    text = [1, 2, 3] * 20 + list(range(50)) + [4, 4, 5] * 15
    want = found([text])
    monkeypatch.setattr(periodic, "MIX", 0)
    assert found([text]) == want == [brute(text)]


def test_longest_blocks_are_sought_by_their_first_words(monkeypatch):
    """Scales beyond the longest transform: here of 16 words instead of 32,768."""
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 16)
    rng = np.random.default_rng(4)
    for n in (40, 64, 100, 150):
        text = rng.integers(0, 50, 13).tolist() + rng.integers(0, 50, n).tolist() * 4
        assert found([text]) == [brute(text)] and any(q == n for _, _, q in brute(text))


def test_one_very_long_text():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(0, 1000, 50_000), np.tile(rng.integers(0, 1000, 70_000), 3), np.zeros(40_000, int)])
    assert (50_000, 210_000, 70_000) in found([text])[0] and (260_000, 40_000, 1) in found([text])[0]


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_row(r.doc_id, r.text) for r in docs.collect())


def test_odd_rows(spark, tmp_path):
    again = " ".join(["a b c d e f g h i"] * 5)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, again), (4, again), (4, again), (10, "x"), (24, "é y z w\x1cq " * 30), (33, "a " * 3000)]
    rows += [(i, again) for i in range(100, 160)]
    spark.createDataFrame([(*r, "u", "v", 7) for r in rows], "doc_id long, text string, runs string, __w string, best int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 160))
    assert QUERIES["op11_periodic_runs"](spark, str(tmp_path)).schema["n_runs"].dataType.simpleString() == "bigint"


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(periodic.with_planted_runs(empty)).collect() == []
