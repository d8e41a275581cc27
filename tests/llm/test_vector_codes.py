import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm import vector_codes as V
from barspark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, z string"


def brute_nearest(x, book):
    ds = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)) for e in book]
    return ds.index(min(ds)), min(ds)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 4), st.data())
def test_trie_is_brute_force(depth, data):
    number = st.integers(-3, 3) if data.draw(st.booleans()) else st.integers(-(1 << 62), 1 << 62)
    row = st.lists(number, min_size=depth, max_size=depth)
    parts = sorted(data.draw(st.lists(row, min_size=1, max_size=30)))
    book = data.draw(st.lists(row, min_size=1, max_size=16))
    x, b = np.array(parts, object).reshape(len(parts), depth), np.array(book, object).reshape(len(book), depth)
    # stretches of few leaves: the path from one to the next is carried over
    index, dist = V.nearest(x, b, data.draw(st.sampled_from([1, 40, 1 << 20])))
    assert [(int(i), int(d)) for i, d in zip(index, dist)] == [brute_nearest(p, book) for p in parts]


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**51 for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (size * parts - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * size:(p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            near = [brute_nearest(cut(v, p), book)[0] for _, v, _ in kept]
            for e in set(near):
                mine = [cut(v, p) for (_, v, _), n in zip(kept, near) if n == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine)]
    coded = [(i, label, [brute_nearest(cut(v, p), books[p]) for p in range(parts)]) for i, v, label in kept]
    total = {}
    for _, label, near in coded:
        total[label] = total.get(label, 0) + sum(d for _, d in near)
    long = lambda x: x if x < 2**63 else None
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e, _ in near), long(sum(d for _, d in near)), long(total[label]), sha) for i, label, near in coded]


def query(spark, path, rows):
    spark.createDataFrame([(*r, "c", 5, None) for r in rows], SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    out = QUERIES["op12_vector_codes"](spark, str(path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_query_is_brute_force(spark, tmp_path):
    """Nulls, non-finite components, ties, repeats, null labels and ids, few distinct values, names that clash."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.001 if i % 3 else 0.3, 24)], None if i % 7 == 0 else i % 4) for i in range(150)]
    rows += [(i + 1000, [0.25] * 24, 9) for i in range(120)] + rows[5:9] + [(None, [0.5] * 24, 1), (None, [0.125] * 24, None)]
    rows += [(200, None, 1), (201, [0.1] * 23 + [None], 1), (202, [float("nan")] * 24, 2), (203, [float("-inf")] + [0.0] * 23, 2)]
    assert query(spark, tmp_path, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("rows", [
    [(3, [0.5] * 16, 1), (1, [-0.25] * 16, None)],  # fewer vectors than entries
    [(1, [0.5, 1.0, 2.0], 1), (2, [0.5] * 10, 1), (4, [], 2)],  # lengths that differ and that eight doesn't divide
    [(1, [], 1), (2, [], None)],
    [(i, [float(np.float32(x * 10.0**(i % 14)))for x in (1, -1, 0.3, 0.7) * 4], i % 2) for i in range(40)],  # beyond 64 bits
    [], [(1, None, 1)]])
def test_odd_tables(spark, tmp_path, rows):
    assert query(spark, tmp_path, rows) == sorted(brute(rows), key=repr)
