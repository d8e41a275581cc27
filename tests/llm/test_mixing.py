import hashlib
import heapq
import re

import pytest

from barspark.llm import mixing
from barspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def deal(votes, seats):
    """Seats one by one, each to the highest votes / (2k + 1); of equal ones to the first."""
    got = [0] * len(votes)
    heap = [(-float(v), i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    while heap and seats:
        _, i = heapq.heappop(heap)
        got[i] += 1
        seats -= 1
        heapq.heappush(heap, (-(float(votes[i]) / (2 * got[i] + 1)), i))
    return got


def digest(*parts):
    return hashlib.md5(":".join([mixing.SEED, *("null" if p is None else str(p) for p in parts)]).encode()).hexdigest()


def brute(rows, weights=(5, 2, 1), repeats=3, block=16, shard_words=1 << 17):
    """Sorted (doc_id, size, source_size, target, taken) of rows (doc_id, text, source)."""
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for n, r in zip(size, rows) if r[2] == s) for s in names]
    w = [weights[i % len(weights)] for i in range(len(names))]
    over = set()
    while True:
        free = [i for i in range(len(names)) if i not in over]
        price = (sum(size) - sum(repeats * sizes[i] for i in over)) / sum(w[i] for i in free) if free else 0
        above = {i for i in free if w[i] * price > repeats * sizes[i]}
        if not above:
            break
        over |= above
    target = [repeats * sizes[i] * 1.0 if i in over else w[i] * price for i in range(len(names))]
    seats = (2 * (sum(size) - sum(repeats * sizes[i] for i in over)) + block) // (2 * block)
    blocks = deal([0 if i in over else t for i, t in enumerate(target)], seats)
    out = []
    for i, s in enumerate(names):
        mine = [(digest(r[0]), r[0], n) for r, n in zip(rows, size) if r[2] == s]
        shards = max(1, -(-sizes[i] // shard_words))
        dealt = [sorted((x for x in mine if int(x[0][:8], 16) % shards == k), key=str) for k in range(shards)]
        quota = deal([sum(n for *_, n in d) for d in dealt], blocks[i])
        for k, d in enumerate(dealt):
            stream = [(j, p) for j, (_, _, n) in enumerate(d) for p in range(n)]
            taken = [0] * len(d)
            if stream:
                first = int(digest(i, k)[:8], 16) % -(-len(stream) // block) * block
                n = repeats * len(stream) if i in over else min(quota[k] * block, repeats * len(stream))
                for p in range(n):
                    taken[stream[(first + p) % len(stream)][0]] += 1
            out += [(doc, n, sizes[i], round(target[i], 6), t) for (_, doc, n), t in zip(d, taken)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block,shard", [(5, 60), (400, 30)])
def test_mix_is_brute_force(spark, block, shard):
    """Sources of very different sizes, a hot one, one without words, ties of votes, null texts and sources."""
    texts = [("a " * (7 + i * i % 90)).strip() for i in range(120)]
    rows = [(i, t, None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 8}") for i, t in enumerate(texts)]
    rows += [(200 + i, None if i else "", "none") for i in range(4)] + [(300, "x y\tz\x0bw é", "é"), (301, "x" * 5, "tiny"), (302, "b " * 60, "t1"), (303, "b " * 60, "t2")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, sid int, quota string")
    assert result(mixing.mixed(docs, block_words=block, shard_words=shard)) == brute(rows, block=block, shard_words=shard)


def test_apportionment_is_one_seat_at_a_time(spark):
    """Many equal and tiny parties, so that rounding gives far too many seats or too few; several groups; no votes; no seats."""
    groups = {0: ([5] * 40 + [1000], 77), 1: ([3] * 60 + [10**6, 4], 30), 2: ([1] * 50, 25), 3: ([0, 0], 9), 4: ([7, 0, 9], 0),
              5: ([600, 200, 120, 30, 10, 10], 24), 6: ([10**9] + [26] * 200, 4000)}
    rows = [(g, i, v, n) for g, (vs, n) in groups.items() for i, v in enumerate(vs)]
    p = spark.createDataFrame(rows, "g long, i long, v long, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportioned(p, ["g"], "i", "v", "seats").collect()}
    assert got == {(g, i): q for g, (vs, n) in groups.items() for i, q in enumerate(deal(vs, n))}
    for g in (0, 1, 6):
        one = {r.i: r.quota for r in mixing.apportioned(p.where(f"g = {g}").drop("g"), [], "i", "v", "seats").collect()}
        assert one == dict(enumerate(deal(*groups[g])))


def test_query_keeps_the_contract(spark):
    out = QUERIES["op13_mixing"](spark, SF)
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    rows = out.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert result(out) == brute([(d.doc_id, d.text, d.source) for d in docs])
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    source = {d.doc_id: d.source for d in docs}
    for s in set(source.values()):
        mine = [r for r in rows if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= mixing.BLOCK_WORDS
    assert sorted(map(tuple, QUERIES["op13_mixing"](spark, SF).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("rows", [[], [(1, "", "a"), (2, None, "b"), (3, None, None)],
                                  [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x"), (None, "d e", None)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert result(mixing.mixed(docs)) == brute(rows)


def test_one_very_long_text(spark):
    rows = [(1, "w " * 400_000, "long"), (2, "v " * 100, "short"), (3, "u " * 70_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert result(mixing.mixed(docs)) == brute(rows)
