import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbZé \n\x0b .", max_size=40), min_size=1, max_size=6))
def test_fingerprints_are_brute_force(texts):
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


def test_masks_cover_every_pair():
    kept = [m & (2**64 - 1) for m in simhash.masks(2)]
    for i in range(64):
        for j in range(i, 64):
            assert any(not m & (1 << i | 1 << j) for m in kept)


def test_links_of_small_and_large_buckets_agree(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    fps = {base} | {base ^ 1 << i for i in range(20)} | {base ^ 1 << i ^ 1 << j ^ 1 << 60 for i in range(8) for j in range(i)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 50)} | {0, 3, 15}
    rows = [(simhash._signed(x), i) for i, x in enumerate(sorted(fps))]
    want = brute_components([i for _, i in rows], [x & (2**64 - 1) for x, _ in rows])
    df = spark.createDataFrame(rows, "fp long, i long")
    for small in (1, 4, 1000):
        roots = dict(simhash.components(simhash.links(df.select("fp"), small=small)).collect())
        groups = {}
        for (fp, i), w in zip(rows, want):
            groups.setdefault(roots.get(fp, fp), set()).add(w)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_edge_cases(spark):
    rows = [(3, "a b c d", "x"), (1, "A  b\nc d", None), (None, "a b c d", "x"), (5, None, "x"), (4, "", None), (9, "one two", "q"), (9, "one two", "q"),
            (7, "w " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = sorted(((d, c, f"{f:016x}") for (d, _, _), c, f in zip(rows, brute_components([d for d, _, _ in rows], fps), fps)), key=str)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_is_brute_force(spark):
    from barspark.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    want = {d.doc_id: (f"{f:016x}", c) for d, f, c in zip(docs, fps, brute_components([d.doc_id for d in docs], fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("n", [2, 9, 40])
def test_components_of_chains(spark, n):
    from barspark.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 101)], "a long, b long")
    assert dict(components(links).collect()) == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}
