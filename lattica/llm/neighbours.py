"""The k most similar vectors of every vector, by multi-index hashing.

Rotations learned on a bounded sample (ITQ: alternate between the signs and the rotation that fits them best) turn each vector into a binary
code. The code is split into substrings of about log2(N) bits, each indexed in a table of its own, so buckets don't grow with the collection.
Each substring probes all buckets within PROBE bits of its own. By pigeonhole every code within (PROBE + 1) x tables - 1 bits is met
for certain; as vectors of cosine c differ in each bit with chance acos(c) / pi, `plan` gives as many tables as it takes to meet a pair at the
floor in at least one of them but for MISS. What is retrieved and lies within the Hamming radius of the floor is reranked by float cosine.

A task holds one table, or above ROWS rows one table's codes of one prefix. A prefix has to agree, only the rest of a substring is probed: each row is sent once a
table, and `plan` gives as many more tables as that takes (the bound by pigeonhole is then tables - 1). AT_ONCE tables are shuffled at a time, so that no more lie on disk.

Two kinds of vector are left over and are compared exactly with whole cells instead (`scan`): those that probe more than MOST rows or meet
more than NEAR within the radius (a hot region; its all-pairs list is never made), and, where no floor is given, those with fewer than k
neighbours above CLOSE. Cells are the nearest of at most CELLS centres learned on the same sample; a vector scans the SCANNED share of cells whose
centres are most similar to it. Query blocks of one cell are units, each streams its cell once and keeps the k best.

Equal vectors are one entry with its members, so copies, however many, cost one code. Every row is indexed; only rotations and centres are learned
on a sample (SAMPLE rows of least hash).

Defined results: rows without id, or whose embedding is null, of another length, all zero or with null, NaN or infinite elements, take no part; an id of
several rows counts each of its embeddings (they agree in clean data); ties in cosine go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut, discard, table

#: CLOSE: cosine down to which hashing finds neighbours where the caller names no floor.
DIM, K, LEAST, CLOSE = 128, 10, 0.85, 0.85
#: Bits a probed bucket may differ in; bits of the code the radius is measured on; chance to miss a pair at the floor; deviations the radius allows.
PROBE, CODE, MISS, DEVIATIONS = 2, 256, 0.02, 4
WORDS = tuple(f"w{i}" for i in range(CODE // 64))
#: Rows a task holds of one table; tables that are shuffled at a time; candidates compared at once; rows a vector may probe in a table; of these within the radius.
ROWS, AT_ONCE, STRIDE, MOST, NEAR = 1_000_000, 6, 1 << 18, 16_384, 256
#: Rows the rotations and centres are learned on, at most about; rounds of learning.
SAMPLE, ROUNDS = 8_000, 15
#: Candidates a scan keeps beyond k, as single precision may order two of them otherwise.
SPARE = 2
#: Vectors a cell has on average, cells at most, share of the cells that is scanned; queries of a unit, rows compared at once.
CELL_ROWS, CELLS, SCANNED, UNIT, STRIP = 8_192, 64, 1 / 16, 8_192, 1_024


def waves(tables: int) -> list[range]:
    """The tables, AT_ONCE at most at a time."""
    n = -(-tables // AT_ONCE)
    return [range(tables * i // n, tables * (i + 1) // n) for i in range(n)]


class Plan(NamedTuple):
    bits: int
    tables: int
    radii: tuple[int, ...]
    prefix: int
    cells: int
    probes: int
    most: int
    near: int


def plan(n: int, floor: float) -> Plan:
    """Bits of a substring, number of tables, radius over the first word of the code, the first two and so on, prefix bits, cells and cells scanned, for n distinct vectors."""
    p = math.acos(min(1.0, max(0.0, floor))) / math.pi
    bits = min(40, max(8, round(math.log2(max(n, 2)))))
    prefix = max(0, math.ceil(math.log2(max(1, n) / ROWS)))
    local = max(1, bits - prefix)
    met = (1 - p) ** prefix * sum(math.comb(local, i) * p**i * (1 - p) ** max(0, local - i) for i in range(PROBE + 1))
    tables = max(2, math.ceil(math.log(MISS) / math.log(max(1e-12, 1 - met)))) if met < 1 else 2
    reach = lambda b: math.ceil(b * p + DEVIATIONS * math.sqrt(b * p * (1 - p)))
    cells = min(CELLS, max(1, n // CELL_ROWS))
    return Plan(bits, tables, tuple(reach(64 * (i + 1)) for i in range(len(WORDS))), prefix, cells, min(cells, max(2, math.ceil(cells * SCANNED))), MOST, NEAR)


def learn(x: np.ndarray, bits: int, dim: int = DIM, seed: int = 0) -> np.ndarray:
    """Projection dim x bits from unit vectors: as many rotations as the bits need, each fitted from its own random start. The
    vectors aren't centred: angles at the origin are what the cosine measures, also where most vectors crowd in one place."""
    rng, parts = np.random.default_rng(seed), []
    for _ in range(-(-bits // dim)):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(ROUNDS if len(x) > dim else 0):
            u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        parts.append(r)
    return np.concatenate(parts, 1)[:, :bits].astype(np.float32)


def centres(x: np.ndarray, n: int, dim: int = DIM, seed: int = 0) -> np.ndarray:
    """At most n unit vectors that the sample x gathers around."""
    rng = np.random.default_rng(seed)
    if not len(x):
        return np.eye(1, dim, dtype=np.float32)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-30)[:, None], c)
    return c.astype(np.float32)


def unit(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be used, their unit vectors) of a list column."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], (x[good] / norm[good, None]).astype(np.float32)


def usable(nodes: DataFrame, dim: int = DIM) -> DataFrame:
    """id, v (hash of the vector), embedding of the rows of the right length."""
    return nodes.filter((F.size("embedding") == dim) & F.col("id").isNotNull()).select("id", F.xxhash64("embedding").alias("v"), "embedding")


def _ints(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64), pa.int64()) for c in columns], names)


def codes(nodes: DataFrame, how: Plan, n: int, dim: int = DIM) -> DataFrame:
    """id, v, t0, t1, ... (one substring a table, those of a wave together), WORDS (the code the radius is measured on), cells (nearest first)."""
    spark = nodes.sparkSession
    share = F.pmod(F.xxhash64("id", F.lit("itq")), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)) + 1
    sample = usable(nodes, dim).filter(share).select("embedding").toArrow().column(0).combine_chunks()
    _, x = unit(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, dim)
    x = np.unique(x, axis=0)
    kind, some = ("int", np.int32) if how.bits < 32 else ("long", np.int64), waves(how.tables)
    sent = spark.sparkContext.broadcast((learn(x.astype(np.float64), max(CODE, how.tables * how.bits), dim), centres(x, how.cells, dim)))

    names = [f"t{i}" for i in range(len(some))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proj, middle = sent.value
        power = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for b in batches:
            at, u = unit(b.column("embedding"), dim)
            sign = (u @ proj >= 0).astype(np.uint64)
            subs = [np.stack([sign[:, i * how.bits : (i + 1) * how.bits] @ power[: how.bits] for i in wave], 1) for wave in some]
            words = [sign[:, i : i + 64] @ power for i in range(0, CODE, 64)]
            top = np.argsort(-(u @ middle.T), 1, kind="stable")[:, : how.probes]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel().astype(x))) for z, x in (*((z, kind[1]) for z in subs), (top, np.int64))]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("v").take(take), *lists[:-1], *(pa.array(w.view(np.int64)) for w in words), lists[-1]], ["id", "v", *names, *WORDS, "cells"])

    return usable(nodes, dim).mapInArrow(run, "id string, v long, " + "".join(f"{t} array<{kind[0]}>, " for t in names) + "".join(f"{w} long, " for w in WORDS) + "cells array<long>")


def masks(bits: int, most: int = PROBE) -> list[int]:
    """All masks of at most `most` set bits, by number of bits."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def probed(key: np.ndarray, words: list[np.ndarray], own: np.ndarray, reach: np.ndarray, how: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one table and prefix; own rows are indexed, others only probe, each within `reach` bits. (i, j, hot): pairs of row
    numbers within the radius, j always an own row; numbers of rows that are left to the scan."""
    local = max(1, how.bits - how.prefix)
    low = (key & ((1 << local) - 1)).astype(np.int64)
    number = np.argsort(low, kind="stable")  # in order of their keys, so that what is looked up lies near
    low, own, reach, words = low[number], own[number], reach[number], [w[number] for w in words]
    order, plain = np.flatnonzero(own), bool(own.all() and (reach >= PROBE).all())
    start = np.zeros((1 << local) + 1, np.int32)
    np.cumsum(np.bincount(low[order], minlength=1 << local), out=start[1:])
    deltas = masks(local)
    weight = np.array([d.bit_count() for d in deltas])
    total = np.zeros(len(key), np.int64)
    for d, w in zip(deltas, weight):
        x = low ^ d
        total += np.where(reach >= w, start[x + 1] - start[x], 0)
    hot = total > how.most
    fast = plain and not hot.any()
    out_i, out_j = [], []
    for d, w in zip(deltas, weight):
        top = 1 << (d.bit_length() - 1) if d else 0
        ask = np.flatnonzero((low & top) == 0 if fast else ~hot & (reach >= w))
        x = low[ask] ^ d
        lo, n = start[x].astype(np.int64), (start[x + 1] - start[x]).astype(np.int64)
        ask, lo, n = ask[n > 0], lo[n > 0], n[n > 0]
        if not len(ask):
            continue
        stop = np.cumsum(n)
        for a in range(0, int(stop[-1]), STRIDE):  # a strip of candidates at a time
            p, q = np.searchsorted(stop, [a, a + STRIDE], "right")
            q = min(q + 1, len(ask))
            first, many = stop[p:q] - n[p:q], n[p:q]
            skip, end = np.maximum(a - first, 0), np.minimum(stop[p:q], a + STRIDE) - first
            m = np.maximum(end - skip, 0)
            i = np.repeat(ask[p:q], m)
            at = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[p:q] + skip, m)
            j = at if plain else order[at]
            if not (fast and d):  # both ends would bring the pair: the end without the mask's top bit does, unless the other can't
                both = own[i] & ~hot[j]
                once = (low[i] & top) == 0 if d else i < j
                ok = np.flatnonzero((once | ~both) & (i != j))
                i, j = i[ok], j[ok]
            far = np.zeros(len(i), np.int64)
            for word, radius in zip(words, how.radii):
                far = far + np.bitwise_count(word[i] ^ word[j])
                ok = np.flatnonzero(far <= radius)
                i, j, far = i[ok], j[ok], far[ok]
            out_i.append(i)
            out_j.append(j)
    none = np.zeros(0, np.int64)
    i, j = np.concatenate(out_i or [none]), np.concatenate(out_j or [none])
    hot |= np.bincount(np.concatenate([i, j]), minlength=len(key)) > how.near
    ok = ~(hot[i] & hot[j])
    return number[i[ok]], number[j[ok]], number[np.flatnonzero(hot)]


def probes(reps: DataFrame, how: Plan) -> DataFrame:
    """reps: (v, t0, t1, ..., WORDS). Rows (a, b): a pair within the radius, a < b; or (a, null): a is left to the scan."""
    found = [cut(_probes(reps, how, i, len(wave)), "probes") for i, wave in enumerate(waves(how.tables))]
    met = cut(reduce(DataFrame.unionByName, found).distinct(), "met")
    for x in found:
        discard(x)
    return met


def _probes(reps: DataFrame, how: Plan, wave: int, tables: int) -> DataFrame:
    local = max(1, how.bits - how.prefix)
    rows = reps.select("v", *WORDS, F.posexplode(f"t{wave}").alias("table", "key"))
    rows = rows.select((F.col("table") * (1 << how.prefix) + F.shiftright("key", local)).cast("int").alias("part"), "v", "key", *WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        part, v, key, *words = (np.concatenate(c) for c in zip(*held))
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            ids = v[at]
            i, j, hot = probed(key[at], [w[at].view(np.uint64) for w in words], np.ones(len(at), bool), np.full(len(at), PROBE), how)
            pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            if len(pairs):
                yield _ints([pairs[:, 0], pairs[:, 1]], ["a", "b"])
            if len(hot):
                left = np.unique(ids[hot])
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.nulls(len(left), pa.int64())], ["a", "b"])

    return rows.repartitionById(tables << how.prefix, F.col("part")).mapInArrow(run, "a long, b long")


def scan(rest: DataFrame, reps: DataFrame, vectors: DataFrame, k: int, dim: int = DIM) -> DataFrame:
    """rest: (v), vectors to compare with their cells; reps: (v, cells); vectors: (v, embedding). (a, b): the k best others of each a, by cosine."""
    asks = rest.join(reps, "v").select("v", F.explode("cells").alias("cell"))
    units = cut(asks.groupBy("cell").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units")), "units")
    spread = lambda r, n: F.pmod(F.xxhash64("v", F.lit(r)), n).cast("int")
    asks = asks.join(F.broadcast(units), "cell").select("v", "cell", spread(3, F.col("units")).alias("u"), F.lit(0).alias("side"))
    held = reps.select("v", F.col("cells")[0].alias("cell")).join(F.broadcast(units), "cell")
    held = held.select("v", "cell", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("u"), F.lit(1).alias("side"))
    rows = asks.unionByName(held).join(vectors, "v").select(F.xxhash64("cell", "u").alias("unit"), "side", "v", "embedding")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, u, ids, cos = None, None, None, None, None

        def done() -> pa.RecordBatch:
            r, c = np.nonzero(cos > -2)
            return _ints([q[r], ids[r, c]], ["a", "b"])

        for b in batches:
            unit_, side, v = (b.column(c).to_numpy() for c in ("unit", "side", "v"))
            at, x = unit(b.column("embedding"), dim)
            unit_, side, v = unit_[at], side[at], v[at]
            cuts = [0, *(np.flatnonzero((unit_[1:] != unit_[:-1]) | (side[1:] != side[:-1])) + 1), len(v)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if now != unit_[i]:
                    if now is not None:
                        yield done()
                    now, q, u = unit_[i], np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
                    ids, cos = np.zeros((0, k), np.int64), np.zeros((0, k), np.float32)
                if side[i] == 0:
                    q, u = np.concatenate([q, v[i:j]]), np.concatenate([u, x[i:j]])
                    ids, cos = np.concatenate([ids, np.zeros((j - i, k), np.int64)]), np.concatenate([cos, np.full((j - i, k), -2, np.float32)])
                    continue
                for z in range(i, j, STRIP):
                    w = u @ x[z : min(z + STRIP, j)].T
                    w[q[:, None] == v[None, z : min(z + STRIP, j)]] = -2
                    go = np.flatnonzero(w.max(1) > cos[:, -1])
                    if not len(go):
                        continue
                    both = np.concatenate([cos[go], w[go]], 1)
                    top = np.argpartition(-both, k - 1, 1)[:, :k]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), 1, kind="stable"), 1)
                    ids[go] = np.where(top < k, np.take_along_axis(ids[go], np.minimum(top, k - 1), 1), v[z + np.maximum(top - k, 0)])
                    cos[go] = np.take_along_axis(both, top, 1)
        if now is not None:
            yield done()

    n = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, int(units.agg(F.sum("units")).first()[0] or 0))
    return rows.repartition(n, "unit").sortWithinPartitions("unit", "side").mapInArrow(best, "a long, b long").distinct()


def cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.least(F.lit(1.0), dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b))))


def nearest(nodes: DataFrame, k: int = K, least: float | None = LEAST, dim: int = DIM) -> DataFrame:
    """(id, other, cosine): for every usable node its k most similar other nodes, those with a cosine of at least `least` where it is given."""
    n, floor = nodes.count(), CLOSE if least is None else least
    how = plan(n, floor)
    coded = cut(codes(nodes, how, n, dim), "codes")
    reps = cut(coded.groupBy("v").agg(*(F.first(c).alias(c) for c in coded.columns[2:])), "reps")
    members = cut(coded.select("v", "id").distinct(), "members")
    discard(coded)
    met = probes(reps, how)
    vectors = usable(nodes, dim).select("v", "embedding")

    def rerank(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        some = vectors.join(ends, "v", "left_semi").dropDuplicates(["v"])
        both = pairs.join(some.select(F.col("v").alias("a"), F.col("embedding").alias("ea")), "a").join(some.select(F.col("v").alias("b"), F.col("embedding").alias("eb")), "b")
        return cut(both.select("a", "b", cosine("ea", "eb").alias("cos")).filter(F.col("cos") >= (-1.0 if least is None else least)), "scored")

    scored = rerank(met.filter("b is not null"))
    links = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    rest = met.filter("b is null").select(F.col("a").alias("v")).distinct()
    if least is None:  # whoever has fewer than k neighbours (members of equal vectors counted) above the floor of the hashing
        sizes = members.groupBy("v").agg(F.least(F.count("id"), F.lit(k + 1)).alias("n"))
        near = links.filter(F.col("cos") >= floor).join(sizes.select(F.col("v").alias("b"), "n"), "b").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("near"))
        short = sizes.join(near, "v", "left").filter(F.col("n") - 1 + F.coalesce("near", F.lit(0)) < k).select("v")
        rest = rest.unionByName(short).distinct()
    rest = cut(rest, "rest")
    discard(met)
    if not rest.isEmpty():
        found = cut(scan(rest, reps.select("v", "cells"), vectors.dropDuplicates(["v"]), k + SPARE, dim), "found")
        more = rerank(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links = links.unionByName(more).unionByName(more.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).dropDuplicates(["a", "b"])

    discard(reps)

    # Each vector's list: other vectors' members (the k + 1 of least id stand for all, since no one needs more), then its own.
    head = members.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    shared = head.filter("r = 2").select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("cos"))
    listed = links.unionByName(shared).join(head.select(F.col("v").alias("b"), F.col("id").alias("other")), "b")
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "other"))).filter(F.col("r") <= k + 1)
    full = listed.join(members.select(F.col("v").alias("a"), "id"), "a").filter("id != other")
    full = full.groupBy("id", "other").agg(F.max("cos").alias("cosine"))
    return full.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).filter(F.col("r") <= k).select("id", "other", "cosine")


def p3_found(spark, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "nodes").select("id", "embedding"))
    return found.select(F.least("id", "other").alias("node_a"), F.greatest("id", "other").alias("node_b")).distinct()


def p3_neighbours(spark, sf_dir: str) -> DataFrame:
    """The list of every usable node, whatever the cosine, rounded to 4 places."""
    found = nearest(table(spark, sf_dir, "nodes").select("id", "embedding"), least=None)
    return found.select("id", "other", F.round("cosine", 4).alias("cosine"))
