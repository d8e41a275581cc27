"""Vector code compression: vectors cut into parts, each replaced by its nearest entry in a small codebook.

Components become whole numbers, so that sums and squared distances are exact and no order of additions matters.

Nearest entries are found in a trie over the distinct parts in lexicographic order. It is walked depth first, a stretch of
parts at a time: a node holds the distances from its prefix to every entry's prefix, accumulated over the components so
far; it is worked out once for all parts that share the prefix, and the path to the last part of a stretch is kept for the
next one. At a leaf stands the whole distance to each entry; the least wins, the lower index if several have it.

Codebooks are learned over the distinct parts of the whole table with their counts: Spark groups and sorts them once into
a stored table; each round adds up, per task, the weighted sums of the parts of every entry, and the driver gets one row per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import hot_keys, unique_join
from barspark.session import ship, stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Whole numbers up to here have squared distances, summed over 8,192 components at least, that fit 64 bits; larger ones
#: are counted in Python's own integers.
NARROW = 1 << 23
#: A component of 2^51 or more would not fit 64 bits when scaled; it counts as not finite.
LARGEST = float(1 << 51)
NUMBERS_AT_ONCE = 1 << 20
EXACT = Context(prec=38)

Codebooks = list[list[list[int]]]


def whole(vector: Column) -> Column:
    """Each component times SCALE, rounded down."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * SCALE))


def usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    return F.coalesce(vector.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)), F.lit(False))


def _exact(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    largest = max([int(np.abs(x).max()) for x in (parts, book) if x.size], default=0)
    kind = np.int64 if largest <= NARROW and parts.shape[1] <= 8192 else object
    return parts.astype(kind), book.astype(kind)


def nearest(parts: np.ndarray, book: np.ndarray, at_once: int = NUMBERS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for each of ``parts``, which are in lexicographic order."""
    parts, book = _exact(parts, book)
    n, depth = parts.shape
    index, dist = np.zeros(n, np.int64), np.zeros(n, parts.dtype)
    path = [np.zeros((1, len(book)), parts.dtype)] * (depth + 1)  # a node's distances at each depth, down to the last leaf
    stretch = max(1, at_once // max(1, len(book)))
    for a in range(0, n, stretch):
        seg = parts[a:a + stretch]
        before = parts[a - 1:a - 1 + len(seg)] if a else np.concatenate([seg[:1], seg[:-1]])
        shared = np.logical_and.accumulate(seg == before, axis=1).sum(axis=1)  # components in common with the part before
        if not a:
            shared[0] = 0
        acc, node = path[0], np.zeros(len(seg), np.int64)
        for d in range(depth):
            # rows that open a new child; the first row's node may be on the path of the stretch before
            opens = shared <= d
            rows = np.flatnonzero(opens)
            step = seg[rows, d][:, None] - book[None, :, d]
            child = acc[node[rows]] + step * step
            if not opens[0]:
                child = np.concatenate([path[d + 1], child])
            node = np.cumsum(opens) - (1 if opens[0] else 0)
            path[d + 1] = child[-1:]
            acc = child
        best = np.argmin(acc, axis=1)
        index[a:a + len(seg)] = best[node]
        dist[a:a + len(seg)] = acc[np.arange(len(acc)), best][node]
    return index, dist


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def distinct_parts(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(pos, part, n), written in lexicographic order: each distinct part of each position and how many vectors have it."""
    size = F.floor(F.size("v") / parts).cast("int")
    cut = F.array(*(F.slice("v", F.lit(i) * size + 1, size) for i in range(parts)))
    rows = vectors.select(F.posexplode(cut).alias("pos", "part"))
    counted = rows.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n"))
    return stored(counted.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"))


def _sums(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(pos, entry, n, sums): over the parts nearest to each entry, how many and their component sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            pos, count = (batch.column(i).to_numpy() for i in (0, 2))
            parts = _matrix(batch.column(1))
            for p in np.unique(pos):  # the rows of a position are together, in order
                here = np.flatnonzero(pos == p)
                book = np.array(books[p], object).reshape(len(books[p]), -1)
                x = parts[here]
                entry, _ = nearest(x, book)
                kind = np.int64 if len(x) and np.abs(x).max() <= NARROW and count[here].sum() < 1 << 39 else object
                weight = count[here].astype(kind)[:, None] * x.astype(kind)
                for e in np.unique(entry):
                    mine = entry == e
                    seen = total.setdefault((int(p), int(e)), [0, np.zeros(x.shape[1], object)])
                    seen[0] += int(count[here][mine].sum())
                    seen[1] = seen[1] + weight[mine].sum(axis=0).astype(object)
        keys = sorted(total)
        sums = [[EXACT.create_decimal(Decimal(int(s))) for s in total[k][1]] for k in keys]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([total[k][0] for k in keys], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))],
            names=["pos", "entry", "n", "sums"])

    each = distinct.mapInArrow(run, "pos int, entry int, n long, sums array<decimal(38,0)>")
    spread = each.select("pos", "entry", "n", F.posexplode_outer("sums").alias("i", "s"))
    per = spread.groupBy("pos", "entry", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return per.groupBy("pos", "entry").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("sums"))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks by position of ``vectors`` (vec_id, v: whole numbers, all of one length that ``parts`` divides).

    They begin as the parts of the ``entries`` smallest vec_ids; rows that repeat an id follow each other by their
    components, null ids come last. Fewer vectors give fewer entries, none gives empty books. In each round every entry becomes the
    mean, rounded down, of the parts nearest to it; an entry that is nearest to none stays.
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    size = len(first[0].v) // parts if first else 0
    books = [[list(r.v[p * size:(p + 1) * size]) for r in first] for p in range(parts)]
    if not first or not size:
        return books
    distinct = distinct_parts(vectors, parts)
    for _ in range(rounds):
        for r in _sums(distinct, books).collect():  # a row per entry
            books[r.pos][r.entry] = [int(s.s) // r.n for s in r.sums]
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vectors with ``code`` (two hex digits a part) and ``error`` (squared distances summed over the parts; null beyond a
    long), each batch by tries over its own distinct parts."""
    ship(vectors.sparkSession)
    names = [c for c in vectors.columns if c != "v"]

    def coded(v: np.ndarray) -> tuple[list[str], list[int]]:
        n, size = len(v), v.shape[1] // len(books) if len(v) else 0
        index, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, object)
        for p, book in enumerate(books):
            x = v[:, p * size:(p + 1) * size]
            order = np.lexsort(x.T[::-1]) if size else np.arange(n)
            i, d = nearest(x[order], np.array(book, object).reshape(len(book), size))
            index[order, p] = i
            error[order] += d.astype(object)
        digits, width = index.tobytes().hex(), 2 * len(books)
        return [digits[i:i + width] for i in range(0, n * width, width)], error.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, column = 0, batch.column(len(names))
            while at < len(batch):
                width = len(column[at])
                k = min(len(batch) - at, max(1, NUMBERS_AT_ONCE // max(1, width)))
                part = column.slice(at, k)
                code, error = coded(_matrix(part) if width else np.zeros((k, 0), np.int64))
                fits = [e if abs(e) < 1 << 63 else None for e in error]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, k) for i in range(len(names))), pa.array(code, pa.string()), pa.array(fits, pa.int64())],
                    names=[*names, "code", "error"])
                at += k

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.select(*names, "v").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", code string, error long")


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components in order, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def prepared(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v): usable vectors as whole numbers, written. A vector that is null or has a null or non-finite component is
    dropped. All get the length of the longest, rounded up to a multiple of ``parts``; shorter ones are filled with zeros."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("x")).where(usable(F.col("x")))
    rows = stored(rows.select("vec_id", "label", whole(F.col("x")).alias("v")))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    full = -(-longest // parts) * parts
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(full) - F.size("v")))
    return rows.withColumn("v", F.when(F.size("v") < full, filled).otherwise(F.col("v")))


def compressed(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
               entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(rows, codebooks); rows have vec_id, label, code, error and label_error, the error summed over equal labels (nulls are
    one label; null beyond a long). One row per usable vector, repeated ones each for themselves; no vectors give no rows and
    empty books. Other columns are not read.
    """
    ship(table.sparkSession)
    vectors = prepared(table, vec_id, vector, label, parts)
    books = fit(vectors, parts, entries, rounds)
    if not books[0]:
        return encode(vectors.limit(0), books).withColumn("label_error", F.lit(None).cast("long")), books
    # a null label is a key of its own
    rows = stored(encode(vectors, books).withColumn("z", F.col("label").isNull()))
    key = ["z", "k"]
    rows = rows.withColumn("k", F.coalesce(F.col("label").cast("string"), F.lit("")))
    per = stored(rows.groupBy(*key).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("m")))
    out = unique_join(rows, per, key, hot_keys(per, key, F.col("m")))
    fits = F.abs("sum") < F.lit(Decimal(1 << 63))
    return out.select("vec_id", "label", "code", "error", F.when(fits, F.col("sum").cast("long")).alias("label_error")), books
