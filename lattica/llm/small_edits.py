"""Near-duplicate labels with small edits, by Golay-code fuzzy hashing.

A label's fingerprint has SEGMENTS segments of 23 bits, each bit the lowest bit of a minhash over its character trigrams, so that
labels of similarity J differ in each bit with chance (1 - J) / 2. A segment is decoded with the perfect Golay code [23, 12, 7]: its
nearest codeword, and where that lies three bits off also the five at distance four, give one or six codeword indices. Two segments
that differ in at most two bits always share an index, in three or four bits more often than not; by pigeonhole some
segment of a pair has few errors. A segment's keys are its indices joined to a minhash of the label's character GRAM-grams, as 4,096 indices
alone would make buckets that grow with the collection. Pairs of a bucket whose whole fingerprints lie within the radius of the floor (DEVIATIONS above the
bits expected to differ, which leaves out 2 of 10,000 pairs at the floor and fewer above) are verified by exact similarity. Unlike labels of a bucket that pass the radius
are more than the similar ones and grow with the square of the collection, so a pair's trigram sets, as bits beside the fingerprint, bound its similarity before it leaves the bucket: no pair of the floor is lost.

Labels are fingerprinted once. Keys are made and shuffled WAVE segments at a time, with the whole fingerprint beside each, so that no more of them lie on disk at once.

Recall of the keys, measured on edited labels: 0.94 for similarities of 0.60 to 0.65, 0.99 to 0.70, above 0.997 from there on.

Buckets above the cap are keyed anew by all segments joined to the old key (see buckets).

Copies (labels equal after normalisation) are one class: only classes are fingerprinted and paired.

Defined results: null labels and those below 20 characters after normalisation take no part, nor do rows without id; an id of several rows counts
once, with its greatest label. A label of any length is read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import buckets
from lattica.session import cut, discard, table

SEGMENTS, BITS, GRAM, LEAST, SHORTEST = 11, 23, 4, 0.6, 20
#: Words of 64 bits that hold a fingerprint; keys a label has on average; standard deviations by which a pair's differing bits may exceed their mean.
WORDS, KEYS, DEVIATIONS = -(-SEGMENTS * BITS // 64), 59, 3.5
#: Bits of a label's trigram set, each trigram in one of them; they and the number of trigrams, below 1 << 16, fill WORDS words.
SLOTS = WORDS * 64 - 16
CODES, SETS, ANCHORS = (tuple(f"{c}{i}" for i in range(n)) for c, n in (("w", WORDS), ("g", WORDS), ("s", SEGMENTS)))
NAMES = CODES + SETS
#: Segments whose keys are on disk at once.
WAVE = 2
#: Fixed value: generator polynomial of the [23, 12, 7] Golay code.
GENERATOR = 0xAE3
TYPES = ("claim", "evidence")


def radius(least: float) -> int:
    n, p = SEGMENTS * BITS, (1 - least) / 2
    return math.floor(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


class Golay:
    """Syndromes of all words of 23 bits, and what to flip for each syndrome."""

    def __init__(self) -> None:
        self.syndrome = np.zeros(1 << BITS, np.uint16)
        for b in range(BITS):
            v = 1 << b
            while v.bit_length() >= 12:
                v ^= GENERATOR << (v.bit_length() - 12)
            self.syndrome[1 << b : 2 << b] = self.syndrome[: 1 << b] ^ np.uint16(v)
        self.flip = np.full((2048, 6), -1, np.int64)
        count = np.zeros(2048, int)
        for k in range(5):
            for c in combinations(range(BITS), k):
                e = sum(1 << i for i in c)
                s = self.syndrome[e]
                if k < 4 or self.flip[s, 0].item().bit_count() == 3:
                    self.flip[s, count[s]] = e
                    count[s] += 1

    def indices(self, words: np.ndarray) -> np.ndarray:
        """The codeword indices of each word, six columns, -1 where there are none."""
        flip = self.flip[self.syndrome[words]]
        return np.where(flip >= 0, (words[..., None] ^ flip) >> 11, -1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def golay() -> Golay:
    return Golay()


SEED = mix(np.arange(1, SEGMENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Printer:
    """Fingerprints of normalised labels."""

    def __init__(self) -> None:
        # one 16-bit hash a trigram (37 symbols) and bit
        self.hash = np.random.default_rng(5).integers(0, 1 << 16, (37**3, SEGMENTS * BITS), np.uint16)
        self.slot = np.random.default_rng(6).integers(0, SLOTS, 37**3)
        self.code = np.zeros(128, np.int64)
        self.code[48:58] = np.arange(1, 11)
        self.code[97:123] = np.arange(11, 37)

    def trigrams(self, label: str) -> np.ndarray:
        c = self.code[np.frombuffer(label.encode("ascii"), np.uint8)]
        return c[:-2] * 1369 + c[1:-1] * 37 + c[2:]

    def prints(self, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, anchors): the fingerprint, WORDS columns, and one 64-bit minhash a segment, for each label."""
        low = np.zeros((len(labels), WORDS * 64), np.uint16)
        anchors = np.empty((len(labels), SEGMENTS), np.uint64)
        for i, x in enumerate(labels):
            c = self.code[np.frombuffer(x.encode("ascii"), np.uint8)]
            n = len(c) - GRAM + 1
            grams = sum(c[k : n + k] * 37 ** (GRAM - 1 - k) for k in range(GRAM)).astype(np.uint64)
            t = self.trigrams(x)
            if len(t) > 4096:
                t, grams = np.unique(t), np.unique(grams)
            low[i, : SEGMENTS * BITS] = self.hash[t].min(0)
            anchors[i] = mix(grams[:, None] ^ SEED[None]).min(0)
        bits = (low & 1).astype(np.uint64).reshape(len(labels), WORDS, 64)
        return bits @ (np.uint64(1) << np.arange(64, dtype=np.uint64)), anchors

    def sets(self, labels: list[str]) -> np.ndarray:
        """The trigram set of each label as bits, its size in the last 16."""
        bits, sizes = np.zeros((len(labels), WORDS * 64), np.uint64), np.zeros(len(labels), np.uint64)
        for i, x in enumerate(labels):
            t = np.unique(self.trigrams(x))
            bits[i, self.slot[t]] = 1
            sizes[i] = len(t)
        words = bits.reshape(len(labels), WORDS, 64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))
        words[:, -1] |= sizes << np.uint64(48)
        return words


def bounded(left: list[np.ndarray], right: list[np.ndarray], least: float) -> np.ndarray:
    """The pairs of sets, as Printer.sets() has them, that may have a similarity of at least `least`: a bit that only one of them has stands for one trigram at least that the other lacks."""
    bits = np.uint64((1 << 48) - 1)
    m, n = ((x[-1] >> np.uint64(48)).astype(np.int64) for x in (left, right))
    own = lambda x, y: sum(np.bitwise_count(u & ~v).astype(np.int64) for u, v in zip([*x[:-1], x[-1] & bits], y))
    both = np.minimum(m - own(left, right), n - own(right, left))
    return np.flatnonzero(both >= least * (m + n - both) - 1e-6)


@cache
def printer() -> Printer:
    return Printer()


def segment(words: list[np.ndarray], s: int) -> np.ndarray:
    """The BITS bits of segment s of fingerprints."""
    w, o = divmod(s * BITS, 64)
    x = words[w] >> np.uint64(o)
    if o + BITS > 64:
        x = x | words[w + 1] << np.uint64(64 - o)
    return (x & np.uint64((1 << BITS) - 1)).astype(np.int64)


def keys(words: list[np.ndarray], anchors: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of segment s, of fingerprints and the segment's minhashes."""
    idx = golay().indices(segment(words, s))
    key = mix(mix(anchors + SEED[s])[:, None] + idx.astype(np.uint64))
    row, col = np.nonzero(idx >= 0)
    return row, key[row, col]


def normalised(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def similarity(a: str, b: str) -> float:
    x, y = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    return len(x & y) / len(x | y) if x or y else 0.0


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Similarity of each pair of normalised labels, all at once: trigrams as numbers below 37 ** 3, with the pair's number before them."""
    code = np.zeros(128, np.int64)
    code[48:58], code[97:123] = np.arange(1, 11), np.arange(11, 37)

    def grams(col: pa.Array) -> np.ndarray:
        n = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        c = code[np.frombuffer("".join(col.to_pylist()).encode("ascii"), np.uint8)]
        if len(c) < 3:
            return np.zeros(0, np.int64)
        row, end = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n)
        at = np.flatnonzero(np.arange(len(c)) + 2 < end)
        return row[at] * 37**3 + c[at] * 1369 + c[at + 1] * 37 + c[at + 2]

    # sorted with the side as the lowest bit, a trigram that both have is two neighbours, and its repeats are left out before
    x = np.sort(np.concatenate([grams(left) * 2, grams(right) * 2 + 1]))
    x = x[np.append(True, x[1:] != x[:-1])] if len(x) else x
    both = np.bincount((x[1:][(x[1:] >> 1) == (x[:-1] >> 1)] >> 1) // 37**3, minlength=len(left))
    return both / np.maximum(1, np.bincount((x >> 1) // 37**3, minlength=len(left)) - both)


def printed(classes: DataFrame) -> DataFrame:
    """classes: (c long, label). (c, NAMES, ANCHORS): the fingerprint and the trigram set of each class, and a minhash a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column("label").to_pylist()
            for i in range(0, len(labels), 1000):
                words, anchors = printer().prints(labels[i : i + 1000])
                words = np.concatenate([words, printer().sets(labels[i : i + 1000])], 1)
                yield pa.RecordBatch.from_arrays([b.column("c").slice(i, 1000), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*words.T, *anchors.T))], ["c", *NAMES, *ANCHORS])

    return classes.select("c", "label").mapInArrow(run, ", ".join(f"{x} long" for x in ("c", *NAMES, *ANCHORS)))


def keyed(prints: DataFrame, segments: range, before: bool = False) -> DataFrame:
    """prints: (c, NAMES, ANCHORS). Rows (k, a, words): each key of the segments of each class. before: prints have a column k, which each key is joined to."""
    some = list(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 8000):
                ids, *cols = (x.slice(i, 8000).to_numpy() for x in b.columns)
                words, anchors = [x.view(np.uint64) for x in cols[: len(NAMES)]], cols[len(NAMES) : len(NAMES) + len(some)]
                for s, anchor in zip(some, anchors):
                    row, key = keys(words, anchor.view(np.uint64), s)
                    if before:
                        key = mix(key ^ mix(cols[-1].view(np.uint64)[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, ids[row], *(w[row] for w in words))], ["k", "a", *NAMES])

    return prints.select("c", *NAMES, *(ANCHORS[s] for s in some), *(["k"] if before else [])).mapInArrow(run, "k long, a long, " + ", ".join(f"{w} long" for w in NAMES))


def waves() -> list[range]:
    return [range(s, min(s + WAVE, SEGMENTS)) for s in range(0, SEGMENTS, WAVE)]


def verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose labels have a similarity of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarities(b.column("la").slice(i, 500), b.column("lb").slice(i, 500)) >= least for i in range(0, b.num_rows, 500)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(np.concatenate(ok) if ok else [], pa.bool_()))

    named = pairs.join(classes.select(F.col("c").alias("a"), F.col("label").alias("la")), "a").join(classes.select(F.col("c").alias("b"), F.col("label").alias("lb")), "b")
    return named.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def near_classes(nodes: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """nodes: (id, label). (members: id, c; pairs of classes a < b with similar labels). A class is the nodes of one normalised label."""
    norm = nodes.filter("id is not null and label is not null").select("id", normalised("label").alias("label")).filter(F.length("label") >= SHORTEST)
    named = cut(norm.groupBy("id").agg(F.max("label").alias("label")).withColumn("c", F.xxhash64("label")), "members")
    classes = cut(named.groupBy("c").agg(F.min("label").alias("label")), "classes")
    members = cut(named.select("id", "c"), "members")
    discard(named)
    prints = cut(printed(buckets.spread(classes)), "prints")

    def refine(rows: DataFrame) -> list[DataFrame]:
        some = cut(rows.select("k", F.col("a").alias("c")).join(prints, "c"), "anew")
        return [keyed(some, s, before=True) for s in waves()]

    pairs = cut(buckets.bucket_pairs([keyed(prints, s) for s in waves()], radius(least), refine, classes.count() * KEYS, KEYS, (WORDS, lambda x, y: bounded(x, y, least))), "met")
    discard(prints)
    near = cut(verified(pairs, classes, least), "near")
    discard(pairs)
    return members, near


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id, n_links): group_id is the least id of the node's connected group, n_links the number of other classes linked to its class.
    Nodes without a copy or a link are a group of their own."""
    least = members.groupBy("c").agg(F.min("id").alias("g"))
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = cut(least, "groups")
    while True:
        seen = edges.join(state.select(F.col("c").alias("b"), F.col("g").alias("h")), "b").groupBy(F.col("a").alias("c")).agg(F.min("h").alias("h"))
        new = state.join(seen, "c", "left").select("c", F.least(F.col("g"), F.coalesce(F.col("h"), F.col("g"))).alias("g"), F.col("g").alias("was"))
        # a group id names a node whose own class may meanwhile have a smaller group: jump there
        own = members.join(new.select("c", F.col("g").alias("jump")), "c").select(F.col("id").alias("g"), "jump")
        new = cut(new.join(own, "g", "left").select("c", F.least("g", F.coalesce("jump", "g")).alias("g"), "was"), "groups")
        done = new.filter("g != was").isEmpty()
        discard(state)
        state = cut(new.select("c", "g"), "groups")
        discard(new)
        if done:
            break
    links = edges.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("n"))
    return members.join(state, "c").join(links, "c", "left").select("id", F.col("g").alias("group_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def _labels(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes").filter(F.col("node_type").isin(*TYPES)).select("id", "label")


def p5_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of ids: of similar classes, and of copies."""
    members, pairs = near_classes(_labels(spark, sf_dir))
    left, right = members.select(F.col("c").alias("a"), F.col("id").alias("x")), members.select(F.col("c").alias("b"), F.col("id").alias("y"))
    across = pairs.join(left, "a").join(right, "b").select("x", "y")
    copies = left.join(right, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b"))


def p5_groups(spark, sf_dir: str) -> DataFrame:
    return groups(*near_classes(_labels(spark, sf_dir)))
