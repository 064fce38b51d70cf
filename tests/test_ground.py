import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import agreement, ground as G
from lattica.operators import mutations as M
from lattica.sources.store import Session, Store, StoreError
from test_graph import edges, nodes
from test_mutations import A


def graph(spark):
    n = nodes(spark, [("s1", "source", "2026-01-01", True), ("c1", "claim", "s1", True), ("ev", "evidence", "s1", True), ("d1", "decision", "s1", True), ("lone", "claim", "s1", True), ("a0", "assumption", None, True)])
    a = spark.createDataFrame([("a0", 0, "a0", "active", 1, "p", 1, None, None, None, None)], A)
    return G.Graph(n, edges(spark, [("d1", "depends_on", "a0"), ("d1", "cites", "s1"), ("c1", "derived_from", "s1")]), a, 5)


def test_assumptions_come_with_node_and_edges(spark):
    g = graph(spark)
    g1, new = G.assume(g, "Tenants stay small", "planner", ("ev",))
    assert G.assume(g1, "Tenants stay small")[0] is g1
    node = g1.nodes.filter(F.col("id") == new).first()
    assert node.node_type == "assumption" and node.label == "Tenants stay small" and json.loads(node.attrs) == {"status": "active", "version": 1}
    assert g1.edges.filter(F.col("src") == new).select("edge_type", "dst").collect() == [("justified_by", "ev")]
    with pytest.raises(M.Refused):
        G.assume(g, "Bad ground", evidence_ids=("nobody",))
    g2, newer = G.supersede(g1, new, "Tenants stay small")
    rows = {r.id: r for r in g2.assumptions.collect()}
    assert newer != new and rows[new].superseded_by == newer and rows[newer].supersedes == new and rows[newer].version_no == 2
    attrs = {r.id: json.loads(r.attrs) for r in g2.nodes.filter("node_type = 'assumption' and id != 'a0'").collect()}
    assert attrs == {new: {"status": "superseded", "version": 1}, newer: {"status": "active", "version": 2}}
    assert g2.edges.filter("edge_type = 'supersedes'").select("src", "dst").collect() == [(newer, new)]


def test_rejection_with_replacement(spark):
    g, radius, new = G.reject(graph(spark), "a0", "ev", "Something better")
    assert {r.node for r in radius.collect()} == {"d1"} and {r.id for r in g.nodes.filter("invalidated").collect()} == {"a0", "d1"}
    rows = {r.id: r for r in g.assumptions.collect()}
    assert rows["a0"].status == "rejected" and rows["a0"].superseded_by == new and rows[new].version_no == 2 and rows[new].supersedes == "a0"
    assert json.loads(g.nodes.filter(F.col("id") == new).first().attrs)["version"] == 2
    assert {(r.src, r.edge_type, r.dst) for r in g.edges.filter("dst = 'a0' and src != 'd1'").collect()} == {("ev", "contradicts", "a0"), (new, "supersedes", "a0")}


def test_submitted_evidence(spark):
    g = graph(spark)
    rows = [("it broke", "s1", "CVE-1", '{"package": "p", "n": [1, 2]}'), ("it broke", "s1", "CVE-1", '{"n": [1, 2], "package": "p"}'), ("two", "s1", "CVE-2", None), ("other", "s1", "CVE-2", None), ("  ", "s1", None, None), ("x", "nowhere", None, None), ("y", "s1", None, "[1]"), (None, None, None, "{")]
    g1, out = G.submit_evidence(g, spark.createDataFrame(rows, G.EVIDENCE))
    said = sorted((r.external_id or "", r.outcome, r.why or "") for r in out.collect())
    assert [s[:2] for s in said] == [("", "refused")] * 4 + [("CVE-1", "added"), ("CVE-2", "refused"), ("CVE-2", "refused")]
    new = g1.nodes.filter("label = 'it broke'").first()
    assert new.node_type == "evidence" and json.loads(new.attrs) == {"kind": "submitted", "external_id": "CVE-1", "metadata": {"package": "p", "n": [1, 2]}} and g1.nodes.count() == g.nodes.count() + 1
    g2, out = G.submit_evidence(g1, spark.createDataFrame([rows[0], ("changed", "s1", "CVE-1", None)], G.EVIDENCE))
    assert sorted((r.outcome, r.why or "") for r in out.collect()) == [("refused", "the external id stands for another payload"), ("same", "")] and g2.nodes.count() == g1.nodes.count()


def test_prune_waits_for_two_walks(spark):
    g = graph(spark)
    assert G.prune_walked(g, 1) is g
    assert {r.id for r in G.prune_walked(g, 2).nodes.filter("pruned").collect()} == {"lone", "c1"}


def test_faults_between_tables(spark):
    ledger = spark.createDataFrame([("p", 1, 1, "t", "s1", None), ("p", 2, 3, "t", "gone", "a0"), ("p", 3, 1, "other", None, "zz"), ("q", 1, 1, "t", None, None)], "chain string, seq long, round long, task string, node_id string, assumption_id string")
    tasks, rounds = spark.createDataFrame([("p", "t")], "plan string, task_name string"), spark.createDataFrame([("p", 2)], "plan string, reached long")
    g = graph(spark)
    got = {tuple(r) for r in agreement.ledger_faults(ledger, tasks, g.nodes, g.assumptions, rounds).collect()}
    assert got == {("p", 2, "node"), ("p", 2, "round"), ("p", 3, "assumption"), ("p", 3, "task"), ("q", 1, "task"), ("q", 1, "round")}
    names = spark.createDataFrame([("s1", "s1"), ("none", "x"), (None, "y"), ("e", "called"), ("e2", "e2")], "entity_id string, label string")
    n = g.nodes.unionByName(nodes(spark, [("e", "entity", None, True), ("e2", "entity", None, True)]))
    assert {tuple(r) for r in agreement.name_faults(names, n).collect()} == {("s1", "no entity"), ("none", "no node"), ("e", "label")}


def test_sessions_stage_commit_and_recover(spark, tmp_path, monkeypatch):
    store = Store(str(tmp_path / "home"))
    s = Session(spark, store)
    one = spark.createDataFrame([(1, "a")], "id long, x string")
    assert s.mutate(lambda t: {"things": one}) == 1 and s.commits == 1 and s.tables["things"].count() == 1
    with pytest.raises(ZeroDivisionError):
        s.mutate(lambda t: 1 / 0)
    assert s.version == store.latest() == 1 and s.pending == 0
    put = store._put
    def half(*a):
        put(*a)
        raise OSError("the folder can't be synced")
    monkeypatch.setattr(store, "_put", half)
    assert s.mutate(lambda t: {"things": t["things"].unionByName(one)}) == 2 and s.tables["things"].count() == 2
    def never(*a):
        raise OSError("no space")
    monkeypatch.setattr(store, "_put", never)
    with pytest.raises(OSError):
        s.mutate(lambda t: {"things": one})
    assert s.version == 2 and store.latest() == 2
    monkeypatch.undo()
    other = Session(spark, store, "on-exit")
    other.mutate(lambda t: {"more": one})
    assert store.latest() == 2 and other.pending == 1
    with store.lock():
        assert not other.checkpoint() and other.contended == 1
    assert other.close() and store.latest() == 3 and other.commits == 1
    with pytest.raises(StoreError):
        s.mutate(lambda t: {"things": one})
    never = Session(spark, store, "never")
    never.mutate(lambda t: {"more": one})
    assert not never.close() and store.latest() == 3
    part = next((tmp_path / "home" / "v-000003" / "things").glob("*.parquet"))
    store.read(spark, 3, check=True)
    one.coalesce(1).write.mode("append").parquet(str(part.parent))
    with pytest.raises(StoreError, match="committed"):
        store.read(spark, 3, check=True)
