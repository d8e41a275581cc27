import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm import pii, tagger
from barspark.llm.common import table

SF = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(d(m.group())) <= 19 and luhn(d(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(d(m.group())) <= 15]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(alphabet="a.@b-1 +é", max_size=40), st.text(alphabet="0123456789. -+()", max_size=50)))
def test_base_is_brute_force(t):
    assert pii.base_spans(t) == brute(t)


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in tagger.init(5, 5, 3, 4).items()}
    x, y, none = rng.integers(0, 5, (3, 6)), rng.integers(0, 5, (3, 6)), np.zeros((5, 5))
    g = tagger.gradients(p, none, x, y)[1]
    for k in p:
        i = tuple(rng.integers(0, s) for s in p[k].shape)
        ends = []
        for e in (1e-3, -1e-3):
            q = {**p, k: p[k].copy()}
            q[k][i] += e
            ends.append(tagger.gradients(q, none, x, y)[0])
        assert np.isclose(g[k][i], (ends[0] - ends[1]) / 2e-3, rtol=0.02, atol=1e-5)


def test_viterbi_is_brute_force():
    from itertools import product

    rng = np.random.default_rng(1)
    s, trans = rng.normal(size=(4, 5, 3)), rng.normal(size=(3, 3))
    for row, got in zip(s, tagger.viterbi(s, trans)):
        score = lambda y: sum(row[i, a] for i, a in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        assert tuple(got) == max(product(range(3), repeat=5), key=score)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(table(spark, SF, "documents"))


def test_tagger_finds_labelled_spans_and_more(spark, model):
    texts = [r.text for r in table(spark, SF, "documents").where("text rlike '[0-9@]'").collect()]
    base = [brute(t) for t in texts]
    again = pii.added_spans(texts, [[] for _ in texts], model)
    whole = sum(map(len, base))
    assert sum(s in z for b, z in zip(base, again) for s in b) > 0.6 * whole
    clean = ["Licensed under the Apache License, Version 2.0.", "in 1998 about 12,345 of them", "", "no digits at all " * 50]
    assert pii.added_spans(clean, [[]] * 4, model) == [[]] * 4
    # at the seams of windows, and in the middle of a very long text
    for pad in (0, 30, 47, 48, 70, 95, 5000):
        t = "x " * pad + "call me at (415) 555-2671 please " + "y " * 5000
        assert [t[s:e] for s, k, e in pii.added_spans([t], [[]], model)[0]] == ["(415) 555-2671"], pad


def test_edge_cases(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.cd", "x"), (3, "4111 1111 1111 1111 or 10.0.0.1", None), (3, "4111 1111 1111 1111 or 10.0.0.1", None),
            (4, "a" * 2000 + "1" * 1500, ""), (5, "+1 (415) 555-2671@x.yz", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for m in (model, None):
        got = sorted(pii.detect(df, m).collect(), key=lambda r: str(r.doc_id))
        assert [r.base for r in got] == [pii.joined(brute(t or "")) for _, t, _ in sorted(rows, key=lambda r: str(r[0]))]
        assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in got)
    assert pii.base_spans("a" * 2_000_000 + "1" * 1_000_000 + "@") == []  # in linear time
    assert pii.detect(df.limit(0), model).count() == 0 and pii.fit(df.where("doc_id < 3")) is None


def test_query(spark):
    from barspark.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op5_pii"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
