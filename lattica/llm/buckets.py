"""Pairs of rows that share a bucket key, without a join.

Rows (k, a, words...) are hash-partitioned and sorted by k, so that each bucket is a run of neighbours; numpy compares the words, binary codes of 64 bits each,
within a run and keeps the pairs (a, b) within a Hamming distance. Buckets above CAP rows are not dropped: a run above it streams through its task without being held, and its
rows, those of all waves together, are keyed anew by the caller (refine), so that they part into smaller buckets. What is still above CAP then is compared block
against block, each pair of blocks a unit of its own; such rows share two keys, and nearly all their pairs are results.

New keys cost a row as much as some 50,000 comparisons, so CAP is where a bucket's comparisons would make a task long, not where they begin to cost. Buckets above SMALL rows are
compared a tile of rows against columns at a time, whose pairs are passed on before the next.

The number of partitions follows the number of rows (ROWS), so a task doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import cut, discard

#: Rows of a bucket up to which it is compared in one task; rows of a block of a bucket that stays larger; rows of a partition.
CAP, BLOCK, ROWS = 16_384, 16_384, 2_000_000
#: Rows of a bucket up to which it is compared beside its neighbours; pairs and columns of a tile of larger ones; words that are compared before most pairs are left out.
SMALL, TILE, WIDE, HEAD = 100, 1 << 16, 4096, 3


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Sorted batches again, cut only between keys (the first column): (False, columns of whole runs), or (True, rows of a run above most)."""
    held: list[np.ndarray] | None = None
    over: int | None = None
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cols = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
        held = None
        k = cols[0]
        if not len(k):
            continue
        if over is not None:
            z = int(np.searchsorted(k != over, True)) if k[0] == over else 0
            z = len(k) if k[0] == over and (k == over).all() else z
            if z:
                yield True, [c[:z] for c in cols]
                cols = [c[z:] for c in cols]
                k = cols[0]
            if not len(k):
                continue
            over = None
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(start, len(k)))
        last = int(start[-1])
        if len(k) - last > most:  # the open run is already too large
            over = k[last]
        else:
            held = [c[last:] for c in cols]
        big = (size > most)[:-1]
        if big.any() or over is not None:
            long = np.repeat(size > most, size)
            long[last:] = over is not None
            yield True, [c[long] for c in cols]
            keep = ~long
            keep[last:] = False
            yield False, [c[keep] for c in cols]
        else:
            yield False, [c[:last] for c in cols]
    if held is not None:
        yield False, held


#: How many of the words are codes, and which pairs of the others, left and right, to keep.
Keep = tuple[int, Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]]


def near(words: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: int, keep: Keep | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of row numbers whose codes differ in at most `most` bits; each word alone already rules most others out."""
    u = [w.view(np.uint64) for w in words]
    codes = keep[0] if keep else len(u)
    far = np.zeros(len(i), np.int64)
    for w in u[:codes]:
        far = far + np.bitwise_count(w[i] ^ w[j])
        ok = np.flatnonzero(far <= most)
        i, j, far = i[ok], j[ok], far[ok]
    if keep:
        ok = keep[1]([w[i] for w in u[codes:]], [w[j] for w in u[codes:]])
        i, j = i[ok], j[ok]
    return i, j


def distance(words: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bits in which the words of each pair differ; at most HEAD words, so that a byte holds the sum."""
    far = np.bitwise_count(np.bitwise_xor(*words[0]))
    for x, y in words[1:]:
        far += np.bitwise_count(np.bitwise_xor(x, y))
    return far


def beside(k: np.ndarray, a: np.ndarray, words: list[np.ndarray], most: int, keep: Keep | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a, smaller first, each once, of equal k whose codes differ in at most `most` bits: the rows against themselves shifted by one, two and so on, without those whose run is through."""
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))[: len(k)]
    n = np.diff(np.append(start, len(k)))
    size, run = np.repeat(n, n), np.repeat(np.arange(len(n)), n)
    x, y, d, u = [], [], 1, [w.view(np.uint64) for w in words]
    codes = min(HEAD, keep[0] if keep else HEAD)
    while True:
        stay = size > d
        if np.count_nonzero(stay) < 0.8 * len(stay):
            size, run, a, u = size[stay], run[stay], a[stay], [w[stay] for w in u]
        if len(a) <= d or not stay.any():
            break
        ok = np.flatnonzero((distance([(w[:-d], w[d:]) for w in u[:codes]]) <= most) & (run[:-d] == run[d:]))
        p, q = near(u, ok, ok + d, most, keep)
        x.append(a[p])
        y.append(a[q])
        d += 1
    return unique(np.concatenate(x) if x else a[:0], np.concatenate(y) if y else a[:0])


def tiles(a: np.ndarray, words: list[np.ndarray], most: int, keep: Keep | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one run, as beside() has them, a few rows at a time."""
    u = [w.view(np.uint64) for w in words]
    codes = min(HEAD, keep[0] if keep else HEAD)
    tall = max(1, min(128, TILE // min(len(a), WIDE)))
    for i in range(0, len(a), tall):
        x, y = [], []
        for j in range(i, len(a), WIDE):
            far = distance([(w[i : i + tall, None], w[None, j : j + WIDE]) for w in u[:codes]])
            p, q = np.divmod(np.flatnonzero(far <= most), far.shape[1])
            p, q = p + i, q + j
            p, q = near(u, *(z[p < q] for z in (p, q)), most, keep)
            x.append(a[p])
            y.append(a[q])
        yield unique(np.concatenate(x), np.concatenate(y))


def within(k: np.ndarray, a: np.ndarray, words: list[np.ndarray], most: int, keep: Keep | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a, smaller first, of equal k whose codes differ in at most `most` bits. k is sorted."""
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))[: len(k)]
    size = np.diff(np.append(start, len(k)))
    few = np.repeat(size <= SMALL, size)
    yield beside(k[few], a[few], [w[few] for w in words], most, keep)
    for i, n in zip(start[size > SMALL], size[size > SMALL]):
        yield from tiles(a[i : i + n], [w[i : i + n] for w in words], most, keep)


def unique(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = x != y
    both = np.stack([np.minimum(x[ok], y[ok]), np.maximum(x[ok], y[ok])], 1)
    both = np.unique(both, axis=0) if len(both) else both
    return both[:, 0], both[:, 1]


def _batch(x: np.ndarray, y: np.ndarray, over: bool, words: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    code = [pa.array(w, pa.int64()) for w in words] or [pa.nulls(len(x), pa.int64())] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(np.full(len(x), over)), *code], ["a", "b", "over", *names])


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash-partitioned by the keys into as many parts as a shuffle has, or as `rows` rows need, a number AQE leaves alone."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *keys)


def bucket_pairs(rows: DataFrame | list[DataFrame], most: int, refine: Callable[[DataFrame], DataFrame | list[DataFrame]] | None = None, n: int = 0, each: int = 1, keep: Keep | None = None) -> DataFrame:
    """rows: (k long, a long, words long ...), a at most once a bucket, about n of them. Pairs (a, b), a < b, each once. refine, if given, takes the rows
    (k, a, words ...) of buckets above CAP and gives them new keys, about `each` a row; else blocks() compares them. Rows, given or refined, may come as a list of
    tables that share no bucket: one is shuffled after the other, so that only one lies on disk at a time, and refine is asked once for all of them. keep: what else a pair has to pass, by words that are no codes."""
    waves = rows if isinstance(rows, list) else [rows]
    words = [c for c in waves[0].columns if c not in ("k", "a")]
    found = [_wave(x.select("k", "a", *words), most, words, -(-n // len(waves)), keep) for x in waves]
    pairs = [cut(f.filter("not over").select("a", "b").distinct(), "pairs") for f in found]
    rest = reduce(DataFrame.unionByName, found).filter("over").select(F.col("a").alias("k"), F.col("b").alias("a"), *words)
    if over := rest.count():
        pairs.append(cut(bucket_pairs(refine(rest), most, None, over * each, keep=keep) if refine else blocks(rest, most, keep), "pairs"))
    for f in found:
        discard(f)
    return reduce(DataFrame.unionByName, pairs).distinct()


def _wave(rows: DataFrame, most: int, words: list[str], n: int, keep: Keep | None) -> DataFrame:
    """(a, b, over, words): pairs, and with over the keys and rows of buckets above CAP."""
    top, code = CAP, ", ".join(f"{w} long" for w in words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big, (k, a, *w) in runs(batches, top):
            if big:
                yield _batch(k, a, True, w, words)
            else:
                for x, y in within(k, a, w, most, keep):
                    yield _batch(x, y, False, [], words)

    return cut(spread(rows, "k", rows=n).sortWithinPartitions("k").mapInArrow(run, f"a long, b long, over boolean, {code}"), "found")


def block_units(rows: DataFrame, size: int = 0) -> DataFrame:
    """Rows of large buckets, each once for every pair of blocks that its block is in: k2 (the unit), side (0 or 1), same."""
    sizes = rows.groupBy("k").agg(F.ceil(F.count("*") / (size or BLOCK)).cast("int").alias("n"))
    rows = rows.join(sizes, "k").withColumn("c", F.pmod(F.xxhash64("a", F.lit(7)), F.col("n")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    lo, hi = F.least("c", "o"), F.greatest("c", "o")
    return rows.withColumn("k2", F.xxhash64("k", lo, hi)).withColumn("side", (F.col("c") == hi).cast("int")).withColumn("same", F.col("c") == F.col("o"))


def blocks(rows: DataFrame, most: int, keep: Keep | None = None) -> DataFrame:
    words = [c for c in rows.columns if c not in ("k", "a")]
    units = block_units(rows).select("k2", "side", "same", "a", *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (k, side, same, a, *w) in runs(batches, 1 << 60):
            at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else []
            for i, j in zip(at, np.append(at[1:], len(k))):
                u, names = [x[i:j] for x in w], a[i:j]
                left, right = (np.arange(j - i),) * 2 if same[i] else (np.flatnonzero(side[i:j] == 0), np.flatnonzero(side[i:j] == 1))
                for p in range(0, len(left), 64):
                    some = left[p : p + 64]
                    x, y = near(u, np.repeat(some, len(right)), np.tile(right, len(some)), most, keep)
                    x, y = unique(names[x], names[y])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return spread(units, "k2").sortWithinPartitions("k2").mapInArrow(run, "a long, b long")
