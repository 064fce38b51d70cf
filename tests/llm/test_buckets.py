import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import buckets as B


def rows(seed, n, keys, hot=0):
    rng = np.random.default_rng(seed)
    k = np.append(rng.integers(0, keys, n), np.full(hot, -5))
    s = np.repeat(rng.integers(0, 2**62, 40), 50)[: n + hot] ^ (1 << rng.integers(0, 60, n + hot))
    return k.astype(np.int64), np.arange(n + hot, dtype=np.int64), s.astype(np.int64)


def brute(k, a, s, most):
    out = set()
    for i in range(len(k)):
        for j in range(i):
            if k[i] == k[j] and a[i] != a[j] and int(s[i] ^ s[j]).bit_count() <= most:
                out.add((min(a[i], a[j]), max(a[i], a[j])))
    return out


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_runs_keep_whole_keys(size):
    k = np.sort(np.random.default_rng(2).integers(0, 30, 500))
    k[100:300] = k[100]
    k = np.sort(k)
    v = np.arange(500)
    got = [[], []]
    seen = set()
    for big, (x, y) in B.runs((pa.RecordBatch.from_arrays([pa.array(k[i : i + size]), pa.array(v[i : i + size])], ["k", "v"]) for i in range(0, 500, size)), 50):
        got[big] += y.tolist()
        if not big:
            assert not seen & set(x.tolist())
            seen |= set(x.tolist())
    counts = dict(zip(*np.unique(k, return_counts=True)))
    assert sorted(got[0]) == [i for i in range(500) if counts[k[i]] <= 50] and sorted(got[1]) == [i for i in range(500) if counts[k[i]] > 50]


@pytest.mark.parametrize("cap", [2000, 30])
def test_pairs_against_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(B, "CAP", cap)
    monkeypatch.setattr(B, "BLOCK", cap)
    k, a, s = rows(3, 300, 6, hot=120)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(k, a, s)], "k long, a long, s long")
    got = [tuple(r) for r in B.bucket_pairs(df, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(k, a, s, 4)


def test_large_buckets_are_keyed_anew(spark, monkeypatch):
    monkeypatch.setattr(B, "CAP", 30)
    k, a, s = rows(5, 100, 3, hot=90)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(k, a, s)], "k long, a long, s long")
    asked = []

    def refine(over):
        asked.extend(r.a for r in over.collect())
        return over

    assert {tuple(r) for r in B.bucket_pairs(df, 4, refine).collect()} == brute(k, a, s, 4)
    assert set(asked) == {x for q, x in zip(k, a) if (k == q).sum() > 30}


def test_empty(spark):
    assert B.bucket_pairs(spark.createDataFrame([], "k long, a long, s long"), 4).count() == 0


def test_waves_are_keyed_anew_together(spark, monkeypatch):
    monkeypatch.setattr(B, "CAP", 30)
    k, a, s = rows(5, 100, 3, hot=90)
    waves = [spark.createDataFrame([(int(x) + 100 * w, int(y), int(z)) for x, y, z in zip(k, a, s)], "k long, a long, s long") for w in range(3)]
    asked = []

    def refine(over):
        asked.append(over.count())
        return over

    assert {tuple(r) for r in B.bucket_pairs(waves, 4, refine).collect()} == brute(k, a, s, 4)
    assert asked == [3 * sum((k == q).sum() for q in set(k.tolist()) if (k == q).sum() > 30)]


@pytest.mark.parametrize("small, tile, wide", [(100, 1 << 16, 4096), (3, 64, 16), (0, 7, 5)])
def test_tiles_of_any_shape_find_the_same_pairs(monkeypatch, small, tile, wide):
    for name, v in (("SMALL", small), ("TILE", tile), ("WIDE", wide)):
        monkeypatch.setattr(B, name, v)
    k, a, s = (x[np.argsort(rows(3, 300, 6, hot=120)[0], kind="stable")] for x in rows(3, 300, 6, hot=120))
    found = [p for x, y in B.within(k, a, [s], 4) for p in zip(x.tolist(), y.tolist())]
    assert len(found) == len(set(found)) and set(found) == brute(k, a, s, 4)
    odd = (1, lambda x, y: np.flatnonzero((x[0] ^ y[0]) & np.uint64(1)))
    assert {p for x, y in B.within(k, a, [s, a], 4, odd) for p in zip(x.tolist(), y.tolist())} == {(x, y) for x, y in set(found) if (x ^ y) & 1}
