import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import build, closure, telemetry, temporal, typed, walk

N = "id string, ord long, node_type string, label string, attrs string, rationale string, retrieved_at string, source_id string, build long, walks long, pruned boolean, invalidated boolean, live boolean"
E = "id string, ord long, src string, dst string, edge_type string, assumption_id string, weight double, build long, traversals long, live boolean"


def nodes(spark, rows):
    """rows: (id, type, day or source, live)"""
    return spark.createDataFrame([(i, k, t, i, "{}", None, x if t == "source" else None, x if t != "source" else None, 1, 0, False, not live, live) for k, (i, t, x, live) in enumerate(rows)], N)


def edges(spark, rows):
    return spark.createDataFrame([(f"e{k}", k, s, d, t, None, 1.0, 1, 0, True) for k, (s, t, d) in enumerate(rows)], E)


def scenario(spark):
    n = nodes(spark, [("s1", "source", "2026-06-10", True), ("s2", "source", "later", True), ("c1", "claim", "s1", True), ("c2", "claim", "s2", True), ("x", "entity", None, True), ("a", "assumption", None, True), ("d1", "decision", "s1", True), ("d2", "decision", None, True), ("gone", "claim", None, False)])
    e = edges(spark, [("d1", "cites", "s1"), ("c1", "supports", "d1"), ("d1", "depends_on", "a"), ("d1", "produces", "x"), ("d2", "cites", "s2"), ("gone", "depends_on", "a"), ("c2", "mentions", "x")])
    return n, e


def test_blast_radius_scenario(spark):
    n, e = scenario(spark)
    got = {(r.node, r.depth, tuple(r.chain)) for r in closure.blast_radius(spark.createDataFrame([("a",)], "root string"), e, n).collect()}
    assert got == {("d1", 1, ("a", "<-depends_on-", "d1")), ("x", 2, ("a", "<-depends_on-", "d1", "-produces->", "x"))}


def test_blast_radius_ends_on_a_ring_and_goes_deep(spark):
    ring = [(f"d{i}", "decision", None, True) for i in range(12)]
    n = nodes(spark, [("a", "assumption", None, True), *ring])
    e = edges(spark, [("d0", "depends_on", "a"), *[(f"d{(i + 1) % 12}", "depends_on", f"d{i}") for i in range(12)]])
    got = {r.node: r.depth for r in closure.blast_radius(spark.createDataFrame([("a",)], "root string"), e, n).collect()}
    assert got == {f"d{i}": i + 1 for i in range(12)}


def test_walk_back_and_layers(spark):
    n, e = scenario(spark)
    got = {(r.root, r.node, r.hops) for r in closure.walk_back(spark.createDataFrame([("d1",)], "root string"), e, n).collect()}
    assert got == {("d1", "s1", 1), ("d1", "a", 1)}
    keys = spark.createDataFrame([(x,) for x in "abcdz"], "key string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "z"), ("z", "d")], "key string, parent string")
    assert {tuple(r) for r in closure.layers(keys, needs).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", -1), ("z", -1)}


def test_anchors_and_as_of(spark):
    n, e = scenario(spark)
    got = {r.id: (r.source_id, r.via, str(r.day)) for r in temporal.anchors(n, e).collect()}
    assert got["s1"] == ("s1", "self", "2026-06-10") and got["c1"] == ("s1", "provenance", "2026-06-10") and got["c2"] == ("s2", "provenance", "None")
    assert got["d2"] == ("s2", "cites", "None") and got["x"] == ("s1", "produces", "2026-06-10") and got["a"] == (None, "none", "None")
    kept = {(r.id, r.kept_by) for r in temporal.as_of_nodes(n, e, "2026-07-01").collect()}
    assert kept == {("s1", "date"), ("c1", "date"), ("d1", "date"), ("x", "date"), ("a", "ground")}
    assert temporal.as_of_nodes(n, e, "2026-01-01").count() == 0


def test_typed_checks(spark):
    n, e = scenario(spark)
    bad = e.unionByName(edges(spark, [("c1", "produces", "x"), ("c1", "cites", "nobody"), ("x", "resolves_to", "x")]))
    ends = typed.with_ends(bad, n)
    assert {r.edge_type for r in ends.filter("dt is not null").filter(~typed.legal("edge_type", "st", "dt")).collect()} == {"produces"}
    assert ends.filter("dt is null").count() == 1 and typed.degrees(e).filter("id = 'd1'").first().degree == 4
    idx = typed.dense_index(spark.range(100).select((F.col("id") * 7 % 101).alias("v")).repartition(7), "v").collect()
    assert sorted((r.v, r.idx) for r in idx) == [(v, i) for i, v in enumerate(sorted(r.v for r in idx))]


def heap_walk(start, steps, budget, most):
    frontier, count, seen, out = [], 0, set(), []
    for pos, s in enumerate(start):
        heapq.heappush(frontier, (0.0, count, s, [s]))
        count += 1
    while frontier and len(out) < most:
        cost, _, v, path = heapq.heappop(frontier)
        if v in seen:
            continue
        seen.add(v)
        out.append((v, path))
        if len(path) - 1 >= budget:
            continue
        for nxt, c in steps.get(v, []):
            if nxt not in seen:
                heapq.heappush(frontier, (cost + c, count, nxt, [*path, nxt]))
                count += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_settle_equals_a_queue(spark, seed):
    rnd = random.Random(seed)
    vs, rows, start, want = [f"v{i}" for i in range(14)], [], [], {}
    for w in range(4):
        steps = {}
        for v in vs:
            for k in range(rnd.randint(0, 3)):
                nxt, c = rnd.choice(vs), rnd.choice([0.5, 0.5, 1.0])
                if nxt != v and nxt not in [x for x, _ in steps.get(v, [])]:
                    steps.setdefault(v, []).append((nxt, c))
        seeds = rnd.sample(vs, rnd.randint(1, 2))
        want[w] = [(v, [f"{w}{x}" for x in p]) for v, p in heap_walk(seeds, steps, 4, 10)]
        rows += [(f"{w}{v}", f"{w}{nxt}", "mentions", False, c, (0, k), f"e{k}") for v, out in steps.items() for k, (nxt, c) in enumerate(out)]
        start += [(w, f"{w}{s}", i) for i, s in enumerate(seeds)]
    st = spark.createDataFrame(rows, "node string, nxt string, edge_type string, reverse boolean, cost double, exp struct<side: int, ord: bigint>, edge_id string")
    got = walk.settle(spark.createDataFrame(start, "walk_id long, node string, pos int"), st, 4, 10).orderBy("walk_id", "rank").collect()
    for w in want:
        assert [(r.node[1:], r.path) for r in got if r.walk_id == w] == want[w]


def test_ask(spark):
    n, e = scenario(spark)
    canonical = spark.createDataFrame([("x", 0, "Partitioned Rebuild", ["rebuild plan"])], "entity_id string, ord long, label string, aliases array<string>")
    n = n.withColumn("label", F.when(F.col("id") == "x", "Partitioned Rebuild").when(F.col("id") == "d1", "Partitioned rebuild chosen for shards").otherwise(F.col("label")))
    q = spark.createDataFrame([(0, "What about Partitioned Rebuild and shards?"), (1, "Who ate lunch?")], "walk_id long, question string")
    walks, visits = walk.ask(q, n, e, canonical)
    by = {r.walk_id: r for r in walks.collect()}
    assert by[0].candidate_id == "d1" and by[0].dead_end is None and by[0].path[:2] == ["x", "d1"] and by[0].answer_id == "c1"
    assert by[1].dead_end == "entity_unresolved" and visits.filter("walk_id = 1").count() == 0
    assert by[0].tokens_flat == sum(math.floor(len(x.split()) * 1.3) + 8 + 160 for x in ["c1", "c2"])
    labels = {r.id: (r.node_type, r.label) for r in n.collect()}
    lines = by[0].rendered.split("\n")
    assert lines[0] == "(entity) Partitioned Rebuild" and lines[1] == "  <-[produces]- (decision) Partitioned rebuild chosen for shards" and len(lines) == by[0].hops + 1
    assert lines[2] == "    <-[supports]- (%s) %s" % labels[by[0].path[2]]
    n2, e2 = walk.credited(n, e, walks, visits)
    crossed = {r.edge_id: r.n for r in walk.crossings(walks, e).collect()}
    assert len(crossed) == by[0].hops and {r.id: r.traversals for r in e2.collect()} == {r.id: r.traversals + crossed.get(r.id, 0) for r in e.collect()}
    seen = {r.node for r in visits.collect()}
    assert {r.id for r in n2.collect() if r.walks} == {r.id for r in n.collect() if r.walks} | seen


def test_near_misses_keep_their_path_and_long_labels_are_cut(spark):
    n = nodes(spark, [("x", "entity", None, True), ("c", "claim", None, True)]).withColumn("label", F.when(F.col("id") == "c", F.repeat(F.lit("é"), 80)).otherwise(F.col("id")))
    canonical = spark.createDataFrame([("x", 0, "Xanthic Quarry", None)], "entity_id string, ord long, label string, aliases array<string>")
    q = spark.createDataFrame([(0, "What about Xanthic Quarry?")], "walk_id long, question string")
    got = walk.ask(q, n, edges(spark, [("c", "mentions", "x")]), canonical)[0].first()
    assert got.dead_end == "wrong_node_type" and got.path == ["x", "c"] and got.hops == 1 and got.candidate_id is None
    assert got.rendered == "(entity) x\n  <-[mentions]- (claim) " + "é" * 73 + "…"


def test_resolver_ties_and_aliases(spark):
    canonical = spark.createDataFrame([("e2", 0, "alpha beta one", None), ("e1", 1, "alpha beta two", ["AB"]), ("e3", 2, "gamma", ["AB"])], "entity_id string, ord long, label string, aliases array<string>")
    reg = build.Registry(canonical)
    got = {r.norm: (r.entity_id, r.reason) for r in reg.resolve(spark.createDataFrame([("alpha beta",), ("ab",), ("",), ("zzz",)], "norm string")).collect()}
    assert got == {"alpha beta": ("e1", "scored match"), "ab": ("e3", "alias table"), "": (None, "empty after normalisation"), "zzz": (None, "no candidate")}


def test_upper_median(spark):
    for values, want in (([], 0), ([5], 5), ([1, 2, 3, 4], 3), ([2, 2, 9], 2)):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
        assert telemetry.upper_median(df, "v").first()[0] == want


def test_hints_become_links(spark):
    said = ["Alpha Engine requires a daily rebuild of shards.", "Nothing shows that the rebuild of shards is slow.", "The Omega Store shows stale rows every day."]
    schema = "key string, doc_id long, text string, entities array<string>, relations array<struct<subject: string, relation: string, object: string>>"
    rel = [("nothing shows", "contradicts", "alpha engine requires"), ("source:1", "mentions", "e1"), ("omega", " Supports ", "nobody at all"), ("omega store", "cites", "stale ROWS"), ("Omega St.", "cites", "nothing shows"), ("e1", "likes", "e2"), ("rebuild of shards", "supersedes", "Omega St."), (None, "cites", "e1"), ("source:1", "cites", "e1")]
    docs = spark.createDataFrame([("source:1", 1, " ".join(said[:2]), [], rel[:4] + rel[5:]), ("source:2", 2, said[2] + " We showed that shards require a rebuild of shards.", [], [rel[4], rel[6]])], schema)
    canonical = spark.createDataFrame([("e1", 0, "Alpha Engine", None), ("e2", 1, "Omega Store", ["Omega St."]), ("e3", 2, "Lonely Thing", None)], "entity_id string, ord long, label string, aliases array<string>")
    got = build.build(docs, canonical)
    ids = {r.sentence: r.claim_id for r in got["claims"].collect()}
    alpha, nothing, omega = (ids[x] for x in said)
    shards = ids["We showed that shards require a rebuild of shards."]
    rows = {(r.key, r.nth): (r.src, r.relation, r.dst, r.legal, r.known) for r in got["hints"].collect()}
    assert rows[("source:1", 0)] == (nothing, "contradicts", alpha, True, True)  # by fragments
    assert rows[("source:1", 1)] == ("source:1", "mentions", "e1", True, True)  # by ids
    assert rows[("source:1", 2)] == (omega, "supports", None, False, True)
    assert rows[("source:1", 3)] == (omega, "cites", omega, False, True)  # to itself
    assert rows[("source:2", 0)] == (omega, "cites", nothing, True, True)  # by the document's claim that mentions the entity
    assert rows[("source:1", 4)] == ("e1", "likes", "e2", False, False)
    assert rows[("source:2", 1)] == (shards, "supersedes", omega, True, True)  # a fragment in the same document first
    assert rows[("source:1", 5)] == (alpha, "supersedes", "e2", False, True)  # no claim of the document mentions it: the entity, an illegal pair
    assert rows[("source:1", 6)][0] is None and not rows[("source:1", 6)][3] and rows[("source:1", 7)] == ("source:1", "cites", "e1", False, True) and len(rows) == 10
    links = {(r.src, r.edge_type, r.dst) for r in got["links"].collect()}
    assert {(nothing, "contradicts", alpha), (omega, "cites", nothing), (shards, "supersedes", omega)} <= links
    report = {r.stage: (r.admitted, r.dropped) for r in got["report"].collect()}
    assert report["EMBED"] == (9, 0) and report["PRUNE"] == (8, 1)  # two sources, four claims, three entities, one of them alone
    plain = {r.stage: (r.admitted, r.dropped) for r in build.build(docs.withColumn("relations", F.slice("relations", 1, 0)), canonical)["report"].collect()}
    assert (report["LINK"][0] - plain["LINK"][0], report["LINK"][1] - plain["LINK"][1]) == (4, 6)


def test_walks_cut_off_by_pruned_nodes(spark):
    n = nodes(spark, [("x", "entity", None, True), ("y", "entity", None, True), ("z", "entity", None, True), ("w", "entity", None, True), ("c", "claim", None, True), ("c2", "claim", None, True), ("s", "source", None, False), ("gone", "claim", None, False)])
    e = edges(spark, [("x", "derived_from", "s"), ("c", "mentions", "y"), ("c", "derived_from", "s"), ("gone", "mentions", "z"), ("c2", "mentions", "w")])
    canonical = spark.createDataFrame([("x", 0, "Xanthic Quarry", None), ("y", 1, "Yonder Quill", None), ("z", 2, "Zephyr Lamp", None), ("w", 3, "Willow Forge", None)], "entity_id string, ord long, label string, aliases array<string>")
    q = spark.createDataFrame(list(enumerate(("What about Xanthic Quarry?", "What about Yonder Quill?", "What about Zephyr Lamp?", "What about Willow Forge?"))), "walk_id long, question string")
    # x has no way on but to a dead source; c has none but to y, from which it came, when its source is dead it still has that one; z is only pointed at
    got = {r.walk_id: r.dead_end for r in walk.ask(q, n, e, canonical)[0].collect()}
    assert got == {0: "pruned_too_early", 1: "wrong_node_type", 2: "no_typed_edge", 3: "wrong_node_type"}
    back = e.filter("edge_type != 'mentions' or src != 'c'").unionByName(edges(spark, [("y", "cites", "c")]))  # an illegal pair, but a way in without a way back
    assert {r.walk_id: r.dead_end for r in walk.ask(q, n, back, canonical)[0].collect()}[1] == "pruned_too_early"


def test_decision_histories_have_what_came_afterwards(spark):
    n, e = scenario(spark)
    n = n.unionByName(nodes(spark, [("s3", "source", "2026-09-01", True), ("ev", "evidence", "s3", True), ("ev0", "evidence", None, True), ("d3", "decision", "s1", True)]))
    e = e.unionByName(edges(spark, [("ev", "contradicts", "a"), ("ev0", "contradicts", "a"), ("d3", "supersedes", "d1"), ("a", "contradicts", "d1")]))
    got = {(r.root, r.node, r.hops, r.relation, r.through, r.side) for r in temporal.decision_histories(spark.createDataFrame([("d1",), ("d2",)], "root string"), n, e).collect()}
    assert got == {
        ("d1", "s1", 1, "cites", "d1", "stood_on"), ("d1", "a", 1, "depends_on", "d1", "undated"), ("d1", "ev", 2, "contradicts", "a", "later"), ("d1", "ev0", 2, "contradicts", "a", "undated"),
        ("d1", "d3", 1, "supersedes", "d1", "later"), ("d2", "s2", 1, "cites", "d2", "undated"),
    }


def test_whole_export_and_edge_lists(spark, tmp_path, monkeypatch):
    import json

    from lattica import api

    n, e = scenario(spark)
    got = {(r.id, r.side, r.edge_type, r.other) for r in typed.edge_lists(n, e).collect()}
    assert {("d1", "out", "cites", "s1"), ("d1", "in", "supports", "c1"), ("a", "in", "depends_on", "gone")} <= got and len(got) == 14
    assert {(r.id, r.side, r.other) for r in typed.evidence_lists(n, e).collect()} == {("d1", 0, "s1"), ("d1", 1, "c1"), ("d2", 0, "s2")}
    shown = spark.range(12_000).select(F.col("id").alias("idx"), F.concat(F.lit("k"), F.col("id")).alias("id"), F.lit("<b>").alias("label"))
    mesh = api.Mesh.__new__(api.Mesh)
    mesh.spark, mesh.folder, mesh.edges = spark, "", edges(spark, [("k11000", "cites", "k3"), ("k3", "cites", "hidden")]).withColumn("weight", F.lit(1.239))
    monkeypatch.setattr(typed, "display_projection", lambda *_: shown)
    assert mesh.export(f"{tmp_path}/out") == {"folder": f"{tmp_path}/out", "nodes": 12_000, "edges": 1}
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/nodes").collect()]
    assert len(lines) == 12_000 and "<" not in lines[0] and json.loads(lines[0])["label"] == "<b>"
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/edges").collect()] == [{"src": 11000, "edge_type": "cites", "dst": 3, "weight": 1.24}]


def test_explained_as_of_a_date(spark):
    from lattica.operators import hindsight

    n = nodes(spark, [
        ("s1", "source", "2026-06-10", True), ("s2", "source", "2026-08-01", True), ("s3", "source", "some day", True), ("d1", "decision", "s1", True), ("c1", "claim", "s1", True), ("a", "assumption", None, True), ("x", "entity", None, True),
        ("c2", "claim", "s2", True), ("ev", "evidence", "s2", True), ("ev0", "evidence", "s3", True), ("ev1", "evidence", "s1", True), ("b", "assumption", None, True), ("new", "entity", None, True), ("d2", "decision", "s2", True)])
    n = n.withColumn("label", F.when(F.col("id") == "x", "Partitioned Rebuild").when(F.col("id") == "d1", "Partitioned rebuild chosen for shards").otherwise(F.col("label")))
    e = edges(spark, [
        ("d1", "cites", "s1"), ("c1", "supports", "d1"), ("c1", "derived_from", "s1"), ("d1", "produces", "x"), ("d1", "depends_on", "a"), ("d1", "depends_on", "b"), ("c2", "contradicts", "c1"), ("ev", "contradicts", "a"), ("ev0", "supports", "c1"), ("ev1", "contradicts", "b"),
        ("d2", "supersedes", "d1"), ("d2", "produces", "new")])
    a = spark.createDataFrame([(i, k, i, "active", 1, None) for k, i in enumerate("ab")], "id string, ord long, statement string, status string, version_no long, superseded_by string")
    canonical = spark.createDataFrame([("x", 0, "Partitioned Rebuild", None), ("new", 1, "Tenant Mixer", None)], "entity_id string, ord long, label string, aliases array<string>")
    q = spark.createDataFrame([(0, "What about Partitioned Rebuild and Tenant Mixer for shards?")], "walk_id long, question string")
    got = {}
    walks, placed = hindsight.explain(q, n.withColumn("live", F.lit(True)), e, a, canonical, "2026-07-01")
    for r in placed.collect():
        got.setdefault(r.bucket, set()).add(r.node)
    # b was rejected by evidence of then, so the decision that stood on it had fallen and no walk passes it
    assert got == {"not_yet_known": {"new"}} and walks.first().candidate_id is None
    got = {}
    for r in hindsight.explain(q, n, e.filter("src != 'ev1'").unionByName(edges(spark, [("c2", "supports", "d1")]).withColumn("id", F.lit("e99"))), a, canonical, "2026-07-01")[1].collect():
        got.setdefault(r.bucket, set()).add(r.node)
    assert got == {"then": {"x", "c1", "s1"}, "decision": {"d1", "a", "b"}, "later": {"c2", "ev", "d2"}, "undated": {"ev0"}, "not_yet_known": {"new"}}
