import hashlib
import random
import re

import pytest

from barspark.llm.exact_dedup import exact_groups

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Per row (in order): keep_id, group_size, text_sha256; and which row of each group stays."""
    norm = [re.sub("[ \t-\r]", "", t or "") for _, t, *_ in rows]
    groups = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    best = {n: min(g, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0)) for n, g in groups.items()}
    return [(rows[best[n]][0], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for n in norm], {rows[i][0] for i in best.values()}


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = exact_groups(df, **how).collect()
    want, stay = brute(rows)
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(str((d, *w)) for (d, *_), w in zip(rows, want))
    assert sum(r.kept for r in got) == len({w[2] for w in want}) and {r.doc_id for r in got if r.kept} == stay


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n\x0b\f\r", "a"), (4, "a b", "x"), (5, "ab", "x"), (6, "a  b", "x"), (None, "a    b", None), (7, "a b", ""),
            (8, "a b", ""), (9, "é" * 40000, ""), (10, "é" * 39999 + " é", ""), (11, "é" * 39999, ""), (12, "dup", "r"), (12, "dup", "r"), (12, "dup", "r")]
    check(spark, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert exact_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 2])
def test_texts_of_many_blocks(spark, bits):
    """Texts that differ in one block, or in length only; with few hash bits many blocks share a hash."""
    r = random.Random(3)
    parts = ["".join(r.choice("abcdef") for _ in range(16)) for _ in range(6)]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 9))) + "x" * r.randrange(0, 3) for _ in range(300)]
    check(spark, [(i, t, None) for i, t in enumerate(texts)], block_bytes=16, hash_bits=bits)


def test_a_hot_group(spark):
    check(spark, [(i, "same text" if i % 3 else f"own {i}", None) for i in range(600)], block_bytes=4)


def test_query_is_brute_force(spark):
    from barspark.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, stay = brute(rows)
    got = {r.doc_id: r for r in QUERIES["op4_exact_dedup"](spark, SF).collect()}
    assert len(got) == len(rows) and {d for d, r in got.items() if r.kept} == stay
    assert all((got[d].keep_id, got[d].group_size, got[d].text_sha256) == w for (d, _), w in zip(rows, want))
