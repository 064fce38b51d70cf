import random

import numpy as np
import pytest

from lattica.llm import small_edits as E

WORDS = "amber basin cipher ditch ember funnel girder hangar inlet jetty kettle lattice mantle nozzle orbit paddle quarry ratchet saddle tablet uplink vessel warrant yoke zenith".split()


def labels(seed, n=40):
    rnd = random.Random(seed)
    out = []
    for g in range(n):
        base = [rnd.choice(WORDS) + rnd.choice("abcdefgh") for _ in range(13)]
        for i in range(rnd.choice([1, 1, 2, 3])):
            w = list(base)
            for _ in range(i):
                k = rnd.randrange(len(w))
                w[k] = rnd.choice([w[k] + "x", w[k][1:], "Update"])
            out.append((f"n{g:02}-{i}", " ".join(w).capitalize() + "."))
    return out


def test_golay_keys_guarantee_two_errors():
    g, rnd = E.Golay(), random.Random(1)
    assert (g.flip[:, 0] >= 0).all() and sorted(np.unique((g.flip >= 0).sum(1))) == [1, 6]
    for _ in range(400):
        v = rnd.getrandbits(23)
        u = v ^ sum(1 << b for b in rnd.sample(range(23), rnd.randint(0, 2)))
        a, b = (set(g.indices(np.array([x]))[0].tolist()) - {-1} for x in (v, u))
        assert a & b


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rows = labels(seed)
    rows += [("copy", rows[3][1].upper() + "!"), ("short", "tiny"), ("null", None), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows, "id string, label string")
    members, pairs = E.near_classes(df)
    by = {r.c: r.id for r in members.collect()}
    norm = {r.id: r.c for r in members.collect()}
    assert set(norm) == {i for i, x in rows if i and x and len(x) >= 20} and norm["copy"] == norm[rows[3][0]]
    text = {norm[i]: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split()) for i, x in rows if i in norm}
    cs = sorted(by)
    want = {(a, b) for a in cs for b in cs if a < b and E.similarity(text[a], text[b]) >= E.LEAST}
    got = {tuple(r) for r in pairs.collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    found = {r.id: (r.group_id, r.n_links) for r in E.groups(members, pairs).collect()}
    assert set(found) == set(norm) and found["copy"] == found[rows[3][0]]
    for a, b in got:
        assert found[by[a]][0] == found[by[b]][0]


def test_groups_of_a_chain(spark):
    members = spark.createDataFrame([(f"x{9 - i}", i) for i in range(8)] + [("alone", 50)], "id string, c long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    got = {r.id: (r.group_id, r.n_links) for r in E.groups(members, pairs).collect()}
    assert {g for i, (g, _) in got.items() if i != "alone"} == {"x2"} and got["alone"] == ("alone", 0) and got["x9"][1] == 1


def test_empty_and_very_long(spark):
    none = spark.createDataFrame([], "id string, label string")
    assert E.near_classes(none)[1].count() == 0
    long = " ".join(random.Random(3).choices(WORDS, k=20_000))
    df = spark.createDataFrame([("a", long), ("b", long + " end of it")], "id string, label string")
    assert E.near_classes(df)[1].count() == 1


def test_similarities_at_once():
    rows = [x for _, x in labels(4, 30)]
    norm = [" ".join(x.lower().strip(".").split()) for x in rows] + ["abc", "ab", ""]
    left, right = norm, norm[1:] + norm[:1]
    got = E.similarities(E.pa.array(left), E.pa.array(right))
    assert got == pytest.approx([E.similarity(a, b) for a, b in zip(left, right)])


def test_hot_buckets_lose_no_pair(spark, monkeypatch):
    rows = [(f"n{i}", f"batch {i} of the amber basin verified beside the quiet orbit of the northern quarry") for i in range(60)] + labels(6, 10)
    df = spark.createDataFrame(rows, "id string, label string")
    whole = {tuple(r) for r in E.near_classes(df)[1].collect()}
    monkeypatch.setattr(E.buckets, "CAP", 10)
    assert {tuple(r) for r in E.near_classes(df)[1].collect()} == whole and len(whole) > 1700


def test_keys_are_shuffled_a_few_segments_at_a_time(spark, monkeypatch):
    sizes, spread = [], E.buckets.spread

    def counted(df, *by, rows=0):
        if by:
            sizes.append(df.count())
        return spread(df, *by, rows=rows)

    monkeypatch.setattr(E.buckets, "spread", counted)
    rows = labels(8, 20)
    E.near_classes(spark.createDataFrame(rows, "id string, label string"))
    assert sum(sizes) > 40 * len(rows) and max(sizes) < sum(sizes) / 3


def test_sets_lose_no_pair_and_leave_most_unlike_ones_out():
    rng = np.random.default_rng(3)
    chars = np.array(list("abcdefghij klmnop"))
    left = ["".join(rng.choice(chars, 110)) for _ in range(3000)]
    right = ["".join(np.where(rng.random(110) < rng.random() * 0.3, rng.choice(chars, 110), list(x))) for x in left]
    left, right = (["abc" * 40, "x" * 5000, "ab", *v] for v in (left, right))
    sim = E.similarities(E.pa.array(left), E.pa.array(right))
    kept = np.isin(np.arange(len(left)), E.bounded(*(list(E.printer().sets(v).T) for v in (left, right)), E.LEAST))
    assert kept[sim >= E.LEAST].all() and (sim >= E.LEAST).sum() > 200
    assert (sim < 0.35).sum() > 200 and kept[sim < 0.35].mean() < 0.05
