import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import mutations as M
from lattica.sources import snapshot
from test_graph import E, scenario

A = "id string, ord long, statement string, status string, version_no long, created_by string, created_at_build long, supersedes string, superseded_by string, rejected_at_build long, evidence_ids array<string>"


def test_upserts(spark):
    n, e = scenario(spark)
    new = spark.createDataFrame([("c1", "claim", "c1", '{"k": "2"}', "why", None, "s9", 3), ("c9", "claim", "new", "{}", None, None, "s1", 3)], "id string, node_type string, label string, attrs string, rationale string, retrieved_at string, source_id string, build long")
    got = {r.id: r for r in M.upsert_nodes(n, new).collect()}
    assert len(got) == n.count() + 1 and got["c1"].attrs == '{"k":"2"}' and got["c1"].rationale == "why" and got["c1"].source_id == "s1" and got["c9"].ord == 9
    with pytest.raises(M.Refused):
        M.upsert_nodes(n, new.withColumn("label", F.lit("other")))
    obs = lambda *r: spark.createDataFrame(list(r), "src string, edge_type string, dst string, weight double")
    out = {(r.src, r.edge_type, r.dst): (r.weight, r.ord) for r in M.upsert_edges(e, obs(("c2", "mentions", "x", 1.0), ("c2", "mentions", "x", 1.0), ("c1", "mentions", "x", 1.0)), n, 2).collect()}
    assert out[("c2", "mentions", "x")] == (3.0, 6) and out[("c1", "mentions", "x")] == (1.0, 7) and len(out) == 8
    for bad in (("c1", "produces", "x", 1.0), ("c1", "cites", "nobody", 1.0), ("c1", "cites", "c1", 1.0)):
        with pytest.raises(M.Refused):
            M.upsert_edges(e, obs(bad), n, 2)


def test_attrs_keep_nested_values_and_rows_of_one_id_merge(spark):
    n, _ = scenario(spark)
    schema = "id string, node_type string, label string, attrs string, rationale string, retrieved_at string, source_id string, build long"
    rows = [("c1", "claim", "c1", '{"aliases": ["x", "y"], "n": 3, "o": {"p": 1.5}}', None, None, "s1", 2), ("c1", "claim", "c1", '{"n": 4, "q\\"": null}', "why", None, None, 3), ("c1", "claim", "c1", "no json", "later", None, None, 4)]
    for order in (rows, rows[::-1]):
        got = {r.id: r for r in M.upsert_nodes(n, spark.createDataFrame(order, schema)).collect()}["c1"]
        attrs = json.loads(got.attrs)
        assert attrs["aliases"] == ["x", "y"] and attrs["n"] == 4 and attrs["o"] == {"p": 1.5} and attrs['q"'] is None and got.rationale == "why" and got.source_id == "s1"


def test_evidence_of_a_relationship_is_united(spark):
    n, e = scenario(spark)
    e = e.withColumn("evidence_ids", F.array(F.lit("ev1")))
    obs = spark.createDataFrame([("c2", "mentions", "x", 1.0, ["ev2", "ev1"]), ("c2", "mentions", "x", 1.0, None), ("c1", "mentions", "x", 1.0, ["b", "a", "a"])], "src string, edge_type string, dst string, weight double, evidence_ids array<string>")
    out = {(r.src, r.dst): r.evidence_ids for r in M.upsert_edges(e, obs, n, 2).filter("edge_type = 'mentions'").collect()}
    assert out[("c2", "x")] == ["ev1", "ev2"] and out[("c1", "x")] == ["a", "b"]


def test_assumption_life(spark):
    n, e = scenario(spark)
    ev = n.filter("id = 'c1'").withColumn("id", F.lit("ev")).withColumn("node_type", F.lit("evidence")).withColumn("ord", F.lit(50).cast("long"))
    n = n.unionByName(ev)
    a = spark.createDataFrame([("a", 0, "holds", "active", 1, "p", 1, None, None, None, None)], A)
    same, i = M.assume(a, "holds", 2)
    assert i == "a" and same is a
    b, new = M.supersede(a, "a", "holds better", 2)
    rows = {r.id: r for r in b.collect()}
    assert rows["a"].status == "superseded" and rows["a"].superseded_by == new and rows[new].supersedes == "a" and rows[new].version_no == 2
    with pytest.raises(M.Refused):
        M.supersede(b, "a", "again", 3)
    bound = M.bind(e, a, "e6", "a")
    n2, e2, a2, radius = M.reject(n, bound, a, "a", "ev", 5)
    assert {r.node for r in radius.collect()} == {"d1", "x"}
    assert {r.id for r in n2.filter("invalidated").collect()} == {"d1", "x", "a", "gone"}
    assert {r.id for r in e2.filter("not live").collect()} == {"e3", "e6"} and e2.filter("edge_type = 'contradicts' and src = 'ev'").count() == 1
    assert a2.first().status == "rejected" and a2.first().rejected_at_build == 5 and a2.first().evidence_ids == ["ev"]
    for args in ((a2, "a", "ev"), (a, "a", "c1"), (a, "nobody", "ev")):
        with pytest.raises(M.Refused):
            M.reject(n, e, args[0], args[1], args[2], 6)


def test_fingerprint():
    one = M.fingerprint("t", "é", None, cites=["b", "a", "a"])
    assert one == M.fingerprint("t", "é", None, cites=["a", "b"]) != M.fingerprint("t", "e", None, cites=["a", "b"]) and len(one) == 64


def test_snapshot_round_trip_and_faults(spark, tmp_path):
    n, e = scenario(spark)
    a = spark.createDataFrame([("a", 0, "a", "active", 1, "p", 1, None, None, None, None)], A)
    e = e.withColumn("invalidated", ~F.col("live"))
    snapshot.write({"nodes": n, "edges": e, "assumptions": a}, str(tmp_path / "ok"))
    got = snapshot.read(spark, str(tmp_path / "ok"))
    assert got["nodes"].count() == 9 and {r.id for r in got["edges"].collect()} == {f"e{i}" for i in range(7)} and got["assumptions"].first().statement == "a"
    dangling = spark.createDataFrame([("z", 9, "c1", "nobody", "cites", None, 1.0, 1, 0, True)], E)
    cases = {"dangles": (n, e.unionByName(dangling.withColumn("invalidated", F.lit(False)))), "repeated": (n.unionByName(n.limit(1)), e), "unknown": (n.withColumn("node_type", F.lit("thing")), e), "illegal": (n, e.withColumn("edge_type", F.lit("resolves_to")))}
    for why, (n2, e2) in cases.items():
        snapshot.write({"nodes": n2, "edges": e2, "assumptions": a}, str(tmp_path / why))
        with pytest.raises(snapshot.SnapshotError, match=why):
            snapshot.read(spark, str(tmp_path / why))
    (tmp_path / "ok" / "edges" / "part-x.json").write_text('{"id": 5, "ord": "no"}\n')
    with pytest.raises(Exception):  # noqa: B017  a malformed row fails the read
        snapshot.read(spark, str(tmp_path / "ok"))
