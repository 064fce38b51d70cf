import numpy as np
import pytest

from lattica.llm import neighbours as N


def data(seed, groups=40, dim=N.DIM):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rng.standard_normal(dim)
        for i in range(int(rng.integers(1, 5))):
            x = c + rng.standard_normal(dim) * 0.25
            out.append((f"n{g:03}-{i}", (x / np.linalg.norm(x) * rng.choice([1, 1, 3])).astype(float).tolist()))
    return out


def brute(rows, k=N.K, least=N.LEAST):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k] if s[i, j] >= least}


DIRTY = [("null", None), ("short", [1.0] * 127), ("long", [1.0] * 129), ("zero", [0.0] * 128), ("nan", [float("nan")] * 128), ("hole", [None] + [1.0] * 127), (None, [1.0] * 128)]


def test_recall_against_brute_force(spark):
    rows = data(1)
    df = spark.createDataFrame(rows + rows[:5] + DIRTY, "id string, embedding array<float>")
    want, got = brute(rows), {(r.id, r.other) for r in N.nearest(df).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_copies_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "NEAR", 8)
    rng = np.random.default_rng(4)
    c = rng.standard_normal(N.DIM)
    rows = [(f"c{i:02}", c.tolist()) for i in range(30)] + [(f"d{i:02}", (c + rng.standard_normal(N.DIM) * 0.05).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    got = {(r.id, r.other) for r in N.nearest(df).collect()}
    want = brute([(i, np.float32(x).astype(float).tolist()) for i, x in rows])
    assert len(got & want) >= 0.98 * len(want) and {p for p in got if p[0][0] == "c"} == {p for p in want if p[0][0] == "c"}


def test_hot_regions_are_scanned_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST", 4)
    monkeypatch.setattr(N, "UNIT", 16)
    rng = np.random.default_rng(8)
    c = rng.standard_normal(N.DIM)
    rows = [(f"d{i:02}", (c + rng.standard_normal(N.DIM) * 0.05).tolist()) for i in range(60)] + data(3)
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    want, got = brute([(i, np.float32(x).astype(float).tolist()) for i, x in rows]), {(r.id, r.other) for r in N.nearest(df).collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_every_vector_gets_its_list_where_no_floor_is_given(spark):
    rows = data(5)
    df = spark.createDataFrame(rows + rows[:5] + DIRTY, "id string, embedding array<float>")
    want, got = brute(rows, least=-1), [(r.id, r.other) for r in N.nearest(df, least=None).collect()]
    assert len(got) == len(want) == N.K * len(rows) and len(set(got) & want) >= 0.98 * len(want)


def test_probing_meets_every_code_within_the_radius():
    rng = np.random.default_rng(6)
    n, how = 3000, N.plan(3000, 0.85)._replace(bits=12, radii=(64,), most=1 << 40, near=1 << 40)
    key = rng.integers(0, 1 << 12, n)
    w, none = np.zeros(n, np.uint64), np.full(n, N.PROBE)
    i, j, hot = N.probed(key, [w], np.ones(n, bool), none, how)
    far = np.bitwise_count((key[:, None] ^ key[None]).astype(np.uint64))
    a, b = np.nonzero(np.triu(far <= N.PROBE, 1))
    assert not len(hot) and set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist())) == set(zip(a.tolist(), b.tolist())) and len(i) == len(a)


def test_prefixes_meet_the_same_pairs(spark, monkeypatch):
    df = spark.createDataFrame(data(7, 200), "id string, embedding array<float>")
    whole = {tuple(r) for r in N.nearest(df).select("id", "other").collect()}
    monkeypatch.setattr(N, "ROWS", 60)
    assert N.plan(500, 0.85).prefix == 4 and {tuple(r) for r in N.nearest(df).select("id", "other").collect()} == whole


def test_empty(spark):
    assert N.nearest(spark.createDataFrame(DIRTY[:3], "id string, embedding array<float>")).count() == 0


def test_learned_rotation_is_orthogonal():
    x = np.random.default_rng(2).standard_normal((300, 16))
    p = N.learn(x, 40, 16)
    assert p.shape == (16, 40) and p[:, :16].T @ p[:, :16] == pytest.approx(np.eye(16), abs=1e-4)


def test_every_vector_is_sent_once_to_each_table(spark, monkeypatch):
    df, sizes = spark.createDataFrame(data(9, 200), "id string, embedding array<float>"), []
    spread = type(df).repartitionById

    def counted(rows, *by):
        sizes.append(rows.count())
        return spread(rows, *by)

    monkeypatch.setattr(type(df), "repartitionById", counted)
    monkeypatch.setattr(N, "ROWS", 60)
    N.nearest(df)
    how, n = N.plan(df.count(), N.LEAST), df.count()
    assert how.prefix >= 3 and sum(sizes) == how.tables * n and max(sizes) <= 6 * n


@pytest.mark.parametrize("n", [30_000, 1_000_000, 30_000_000, 1_000_000_000])
def test_pairs_at_the_floor_are_met(n):
    how, rng = N.plan(n, 0.85), np.random.default_rng(3)
    miss = np.ones(20_000, bool)
    for _ in range(how.tables):
        far = rng.random((20_000, how.bits)) < np.arccos(0.85) / np.pi
        miss &= far[:, : how.prefix].any(1) | (far[:, how.prefix :].sum(1) > N.PROBE)
    assert miss.mean() <= N.MISS + 0.005
