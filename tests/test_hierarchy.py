import random

import pytest

from lattica.operators import hierarchy as H


def brute_forest(par):
    out = {}
    for x in par:
        path, y = [x], x
        while (par[y] if par[y] in par else None) is not None and len(path) <= len(par):
            y = par[y]
            path.append(y)
        out[x] = ("cycle", -1, None) if len(path) > len(par) else (y, len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 60
    par = {f"k{i}": (None if rnd.random() < 0.1 else f"k{max(0, i - rnd.randint(1, 4))}" if rnd.random() < 0.9 else f"k{rnd.randrange(n + 5)}") for i in range(n)}
    par["self"] = "self"
    got = {r.key: r for r in H.forest(spark.createDataFrame(list(par.items()), "key string, parent string")).collect()}
    nested = spark.createDataFrame(list(got.values()), "key string, parent string, root string, depth long, size long, pre long")
    path = {r.key: r.path for r in H.paths(nested).collect()}
    want = brute_forest(par)
    assert {k: (r.root, r.depth, path[k]) for k, r in got.items()} == want
    good = {k: w[2] for k, w in want.items() if w[1] >= 0}
    for k, r in got.items():
        if k in good:
            below = {x for x, p in good.items() if k in p}
            assert r.size == len(below)
            assert {x for x, s in got.items() if s.root == r.root and s.pre is not None and r.pre <= s.pre < r.pre + r.size} == below
    spans = {}
    for r in got.values():
        spans.setdefault(r.root, []).append(r.pre)
    assert all(sorted(v) == list(range(len(v))) for k, v in spans.items() if k != "cycle")
    desc = {(r.key, r.descendant, r.steps) for r in H.descendants(nested, nested).collect()}
    assert desc == {(a, x, len(p) - 1 - p.index(a)) for x, p in good.items() for a in p[:-1]}


def test_sweep_over_blocks_of_places(spark, monkeypatch):
    monkeypatch.setattr(H, "PLACES", 4)
    par = {f"k{i:02}": None if i % 13 == 0 else f"k{i - 1 - i % 3 * (i % 13 > 3):02}" for i in range(60)}
    got = {r.key: (r.root, r.depth) for r in H.forest(spark.createDataFrame(list(par.items()), "key string, parent string")).collect()}
    assert got == {k: w[:2] for k, w in brute_forest(par).items()}


@pytest.mark.parametrize("group", [1, 1000])
def test_deep_ladders_and_cycles_between_heads(spark, monkeypatch, group):
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H, "GROWTH", 10)
    needs = {f"t{i:03}": {f"t{i - 1:03}", f"t{max(0, i - 2):03}"} if i else set() for i in range(60)}
    needs |= {"a": {"b", "t005"}, "b": {"a", "t001"}, "c": {"a", "t002"}, "d": {"c"}, "e": {"d", "t003"}}
    keys = spark.createDataFrame([(k,) for k in needs], "key string")
    pairs = spark.createDataFrame([(k, p) for k, v in needs.items() for p in v], "key string, parent string")
    want = {(f"t{i:03}", "t000", (i + 1) // 2) for i in range(60)} | {(x, "cycle", -1) for x in "abcde"}
    assert {tuple(r) for r in H.reached_roots(keys, pairs).collect()} == want


def test_sibling_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "SIBLINGS", 3)
    rows = [("r", None)] + [(f"c{i}", "r") for i in range(20)]
    got = H.forest(spark.createDataFrame(rows, "key string, parent string")).collect()
    assert sorted(r.pre for r in got) == list(range(21))


def test_forest_empty(spark):
    assert H.forest(spark.createDataFrame([], "key string, parent string")).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_reached_roots(spark, seed, monkeypatch):
    monkeypatch.setattr(H, "GROUP", 1 if seed == 3 else 1000)
    rnd = random.Random(seed)
    n = 50
    needs = {f"t{i}": {f"t{rnd.randrange(max(0, i - 3), i)}" for _ in range(rnd.choice([0, 1, 1, 1, 2]))} if i else set() for i in range(n)}
    needs["t10"] |= {"t12"}
    needs["t12"] |= {"t10"}
    for i in range(60, 80):
        needs[f"t{i}"] = {f"t{i - 1}"} if i > 60 else set()
    want = set()
    for x in needs:
        dist, todo, loop = {x: 0}, [x], False
        for y in todo:
            for z in needs[y]:
                if z not in dist:
                    dist[z] = dist[y] + 1
                    todo.append(z)
        for y in dist:  # on a cycle if y is among what its parents reach
            seen, q = set(), list(needs[y])
            while q:
                z = q.pop()
                if z not in seen:
                    seen.add(z)
                    q += needs[z]
            loop |= y in seen
        want |= {(x, "cycle", -1)} if loop else {(x, y, d) for y, d in dist.items() if not needs[y]}
    keys = spark.createDataFrame([(k,) for k in needs], "key string")
    pairs = spark.createDataFrame([(k, p) for k, v in needs.items() for p in v], "key string, parent string")
    assert {tuple(r) for r in H.reached_roots(keys, pairs).collect()} == want


def test_decision_links_last_loaded_and_spelling(spark):
    rows = [("D1", None, 1), ("d2", " D1\n", 1), ("d2", "", 0), ("d3", "nobody", 1), (None, "d1", 1), ("d4", "D4", 2)]
    log = spark.createDataFrame(rows, "decision_id string, supersedes string, loaded_at long")
    links = H.decision_links(log)
    got = {r.key: (r.root, r.depth) for r in H.forest(links).collect()}
    assert got == {"d1": ("d1", 0), "d2": ("d1", 1), "d3": ("d3", 0), "d4": ("cycle", -1)}


def test_task_needs_dirty(spark):
    rows = [("p", "A ", None, 1, 1), ("p", "b", ["a", None, "", "x", "A", "a"], 1, 1), ("q", "b", ["a"], 1, 1), ("p", "b", [], 0, 0), ("p", "c", [], 1, 1)]
    tasks = spark.createDataFrame(rows, "plan string, task_name string, needs array<string>, attempt int, loaded_at long")
    keys, needs = H.task_needs(tasks)
    assert {tuple(r) for r in needs.select("key", "parent").collect()} == {("p/b", "p/a")}
    assert {r.node_id for r in keys.collect()} == {"p/A ", "p/b", "q/b", "p/c"}


@pytest.mark.parametrize("seed", [5, 6])
def test_task_paths_and_descendants(spark, seed):
    rnd = random.Random(seed)
    needs = {f"t{i:02}": {f"t{rnd.randrange(max(0, i - 3), i):02}" for _ in range(rnd.choice([0, 1, 2, 2]))} if i else set() for i in range(40)}
    needs["t20"] |= {"t22"}
    needs["t22"] |= {"t20"}
    needs |= {f"u{i:02}": {f"u{i - 1:02}"} if i else set() for i in range(40)}  # longer than two strides
    up = {}
    for x in needs:
        up[x], todo = {x: 0}, [x]
        for y in todo:
            for z in sorted(needs[y]):
                if z not in up[x]:
                    up[x][z] = up[x][y] + 1
                    todo.append(z)
    pairs = spark.createDataFrame([(k, p) for k, v in needs.items() for p in v], "key string, parent string")
    got = [tuple(r) for r in H.needs_descendants(pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == {(y, x, d) for x in up for y, d in up[x].items() if y != x}
    keys = spark.createDataFrame([(k,) for k in needs], "key string")
    looped = {x for x in needs if any(y in up[z] for y in up[x] for z in needs[y])}
    want = {(x, "cycle", -1, None) for x in looped}
    for x in set(needs) - looped:
        for root in (y for y in up[x] if not needs[y]):
            path = [x]
            while path[-1] != root:
                path.append(min(p for p in needs[path[-1]] if up[p].get(root) == up[path[-1]][root] - 1))
            want.add((x, root, up[x][root], tuple(path[::-1])))
    found = H.reached_roots(keys, pairs)
    assert {(r.key, r.root, r.depth, r.path and tuple(r.path)) for r in H.shortest_paths(found, pairs).collect()} == want


def test_task_queries_are_registered():
    from lattica import catalogue

    assert {"p4_task_paths", "p4_task_descendants"} <= set(catalogue.QUERIES)


@pytest.mark.parametrize("group", [1, 1000])
def test_layers_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(H, "GROUP", group)
    rnd = random.Random(8)
    needs = {f"t{i:02}": {f"t{rnd.randrange(max(0, i - 4), i):02}" for _ in range(rnd.choice([0, 1, 1, 2, 3]))} if i else set() for i in range(50)}
    needs |= {"a": {"b", "t05"}, "b": {"a"}, "c": {"a", "t02"}, "d": {"c"}, "self": {"self"}}
    layer = {}
    for _ in needs:
        layer |= {x: max((layer[p] + 1 for p in ps), default=0) for x, ps in needs.items() if all(p in layer for p in ps)}
    keys = spark.createDataFrame([(k,) for k in needs], "key string")
    pairs = spark.createDataFrame([(k, p) for k, v in needs.items() for p in v], "key string, parent string")
    assert {tuple(r) for r in H.layers(keys, pairs).collect()} == {(x, layer.get(x, -1)) for x in needs}
