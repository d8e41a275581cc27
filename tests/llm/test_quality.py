import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm import quality
from barspark.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(t):
    raw = t.encode()
    n = [0] * 7
    for b in raw:
        n[quality.KIND[b]] += 1
    size, letters, blanks = len(raw), n[1] + n[2], n[4] + n[5]
    words = re.findall(rb"[^ \t-\r]+", raw)
    w, rows = t.split(), t.split("\n")
    per = lambda a, b: a / b if b else 0
    bare = sum(all(quality.KIND[b] in (0, 6) for b in x) for x in words)
    return [np.log2(1 + size), per(n[2], letters), per(n[0], size), per(n[3], size), per(blanks, size), per(n[6], size), per(size - blanks, len(words)),
            per(bare, len(words)), len(set(w)) / np.sqrt(len(w)) if w else 0, sum(a == b for a, b in zip(w, w[1:])) / len(w) if w else 0,
            len(set(rows)) / len(rows), per(size, len(rows))]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aaB é9 !|.\n\t", max_size=40), min_size=1, max_size=5))
def test_features_are_brute_force(texts):
    assert np.allclose(quality.features(texts), [brute(t) for t in texts])


def test_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_without_labels():
    none, one = quality.train(np.zeros((0, 12)), np.zeros(0)), quality.train(np.ones((8, 12)), np.ones(8))
    assert none.scores(np.ones((2, 12))).tolist() == [0.5, 0.5] and (one.scores(np.ones((1, 12))) > 0.85).all()


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "y"), (3, "A!! " * 50000, None), (4, "a", ""), (4, "a", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = quality.scored(df, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in quality.scored(df, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(df.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    from barspark.llm.queries import QUERIES

    got = QUERIES["op10_quality"](spark, SF)
    assert got.count() == table(spark, SF, "documents").count()
    rows = got.where("held_out").join(table(spark, SF, "labels"), "doc_id").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
