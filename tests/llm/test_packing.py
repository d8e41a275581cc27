import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barspark.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def whole(pieces, texts, capacity):
    """All ids once, in order, with right checksums; sequences without gaps, full or a power of two."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ids, at = ids_of(texts[d]), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    assert sorted(by_seq) == list(range(len(by_seq)))


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(1, 20))
def test_fill_is_brute_force(counts, need):
    got = packing.fill(counts, need)
    assert all(0 < n <= counts[k] for k, n in got.items())
    sums = {sum(k * n for k, n in zip(counts, c)) for c in product(*(range(n + 1) for n in counts.values()))}
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= need)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 300), max_size=12))
def test_plan_uses_every_remainder(counts):
    patterns, tail = packing.plan(counts, 32)
    used = dict(tail)
    for chosen, times in patterns:
        assert sum(k * n for k, n in chosen.items()) == 32 and times > 0
        for k, n in chosen.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.data())
def test_cuts(total, data):
    edges = sorted({0, total, *data.draw(st.lists(st.integers(0, total), max_size=6))})
    seqs = defaultdict(list)
    for a, b in zip(edges, edges[1:]):
        at = 0
        for start, n, s, o in packing.cuts(a, b, total, 16):
            assert start == at
            at += n
            seqs[s].append((o, n))
        assert at == b - a
    assert sorted(seqs) == list(range(total // 16 + bin(total % 16).count("1")))
    assert all(sum(n for _, n in v) in (1, 2, 4, 8, 16) for v in seqs.values())


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="a 'sdé\n\t1,<|endoftext>世", max_size=60)))
def test_ids_are_those_of_tokenizers(text):
    assert packing.token_ids([text])[0].tolist() == ids_of(text)
    assert packing.token_ids([text + "<|endoftext|>" + text])[0].tolist() == ids_of(text + "<|endoftext|>" + text)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_edge_cases(spark, capacity):
    texts = {1: None, 2: "", 3: "one two three", 4: "x y " * 9000, 5: "word " * 15, 6: "a b c d e f g", 7: "a b c d e f g", 8: "<|endoftext|> z"}
    df = spark.createDataFrame([(k, v, 1.0) for k, v in texts.items()], "doc_id long, text string, length double")
    whole(packing.pack(df, capacity=capacity).collect(), texts, capacity)
    assert packing.pack(df.limit(0), capacity=capacity).count() == 0
    twice = packing.pack(df.where("doc_id = 3").unionAll(df.where("doc_id = 3")).unionAll(df.selectExpr("cast(null as long)", "text", "length").where("length = 1 and text = 'one two three'")), capacity=capacity)
    assert sum(r.length for r in twice.collect()) == 3 * len(ids_of(texts[3]))


def test_query(spark):
    from barspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    whole(QUERIES["op3_packing"](spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, 1024)
