import json

import pytest
from pyspark.sql import functions as F

from lattica.operators import decisions as D
from lattica.operators import mutations as M
from test_graph import edges, nodes


def graph(spark):
    n = nodes(spark, [("s1", "source", "2026-01-01", True), ("s2", "source", "2026-01-02", True), ("c1", "claim", "s1", True), ("a1", "assumption", None, True), ("x", "entity", None, True), ("ev", "evidence", None, True)])
    return n, edges(spark, [("c1", "mentions", "x")])


def ask(spark, *rows):
    full = [(i, *(r + (None,) * (9 - len(r)))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, D.REQUEST)


FULL = ("d1", "Shard by tenant", "It is \u00e9asy", "s1", ["c1"], ["s2", "s1"], ["a1"], ["x"])


def test_decisions_are_recorded_with_their_edges_and_idempotent(spark):
    n, e = graph(spark)
    n1, e1, out = D.decide(n, e, ask(spark, FULL, FULL, (None, "Shard by tenant", "", "s1"), (None, "Shard by tenant", "", "s1")), 7)
    said = {r.request: (r.id, r.outcome) for r in out.collect()}
    assert said[0] == ("d1", "recorded") and said[1] == ("d1", "same") and said[2][1] == said[3][1] == "recorded" and said[2][0] != said[3][0] and said[2][0].startswith("decision:auto:shard-by-tenant-1-")
    rows = {r.id: r for r in n1.collect()}
    assert len(rows) == 9 and rows["d1"].node_type == "decision" and rows["d1"].rationale == "It is \u00e9asy" and rows["d1"].source_id == "s1" and rows["d1"].build == 7
    want = M.fingerprint("Shard by tenant", "It is \u00e9asy", "s1", ["s2"], ["c1"], ["a1"], ["x"])
    assert json.loads(rows["d1"].attrs) == {"decision_identity": "explicit", "decision_payload_digest": want}
    links = {(r.src, r.edge_type, r.dst) for r in e1.filter("src = 'd1' or dst = 'd1'").collect()}
    assert links == {("d1", "cites", "s1"), ("d1", "cites", "s2"), ("c1", "supports", "d1"), ("d1", "derived_from", "c1"), ("d1", "depends_on", "a1"), ("d1", "produces", "x")}
    assert {r.id: r.fingerprint for r in D.fingerprinted(D.structures(n1, e1)).collect()}["d1"] == want
    # said again: nothing changes; a third of the same title goes on counting; what is superseded knows by whom
    again = ("d1", "Shard by tenant", "It is \u00e9asy", "s1", ["c1", "c1"], ["s2"], ["a1"], ["x"])
    n2, e2, out = D.decide(n1, e1, ask(spark, again, (None, "Shard by tenant", "", "s1"), ("d2", "Better", "", "s2", None, None, None, None, "d1")), 8)
    said = {r.request: (r.id, r.outcome) for r in out.collect()}
    assert said[0] == ("d1", "same") and said[1][0].startswith("decision:auto:shard-by-tenant-3-") and said[2] == ("d2", "recorded") and n2.count() == 11
    assert json.loads(n2.filter("id = 'd1'").first().attrs)["superseded_by"] == "d2" and e2.filter("edge_type = 'supersedes' and src = 'd2' and dst = 'd1'").count() == 1
    assert {r.weight for r in e2.filter("src = 'd1'").collect()} == {1.0}


@pytest.mark.parametrize("why, rows", {
    "other content": [("d1", "Shard by tenant", "changed", "s1", ["c1"], ["s2"], ["a1"], ["x"])], "namespace": [("decision:auto:mine", "t", "r", "s1")], "isn't a decision": [("c1", "t", "r", "s1")], "two contents": [("d9", "t", "r", "s1"), ("d9", "t", "q", "s1")],
    "not a legal edge": [("d9", "t", "r", "c1")], "title and a source": [("d9", None, "r", "s1")],
}.items())
def test_refusals(spark, why, rows):
    n, e = graph(spark)
    n, e, _ = D.decide(n, e, ask(spark, FULL), 7)
    with pytest.raises(M.Refused, match=why):
        D.decide(n, e, ask(spark, *rows), 8)


def test_minted_ids_are_no_explicit_ids(spark):
    n, e = graph(spark)
    n, e, out = D.decide(n, e, ask(spark, (None, "t", "r", "s1")), 7)
    forged = n.withColumn("attrs", F.when(F.col("node_type") == "decision", F.lit('{"decision_identity": "explicit"}')).otherwise(F.col("attrs")))
    with pytest.raises(M.Refused, match="namespace"):
        D.decide(forged, e, ask(spark, (out.first().id, "t", "r", "s1")), 8)
    assert D.decide(n, e, ask(spark).limit(0), 8)[2].count() == 0
