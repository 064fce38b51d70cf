from pyspark.sql import functions as F

from lattica.api import Mesh

D = "/root/testdata/sf0.001"


def test_writes_come_back_as_data_and_change_what_is_held(spark):
    m = Mesh(spark, D)
    source = m.nodes.filter("node_type = 'source' and live").orderBy("id").first().id
    said = m.submit_evidence({"text": "The rollout broke two tenants.", "source_id": source, "external_id": "INC-7", "metadata": '{"tenants": 2}'}, {"text": " ", "source_id": source})["outcomes"]
    assert sorted(x["outcome"] for x in said) == ["added", "refused"]
    evidence = next(x["evidence_id"] for x in said if x["outcome"] == "added")
    ground = m.assume("No tenant ever outgrows one shard", "test")["assumption"]
    got = m.decide({"id": "decision:shard-by-tenant", "title": "Shard by tenant", "rationale": "simple", "source_id": source, "assumptions": [ground]})
    assert got["decisions"][0]["outcome"] == "recorded"
    assert "error" in m.decide({"id": "decision:shard-by-tenant", "title": "Shard by date", "source_id": source}) and "error" in m.reject(ground, "nobody")
    assert m.get_node("decision:shard-by-tenant")["n_out"] == 2
    out = m.reject(ground, evidence, "Some tenants outgrow a shard")
    assert out["radius"] == 1 and out["fallen"][0]["node"] == "decision:shard-by-tenant" and out["replacement"]
    assert m.nodes.filter((F.col("id") == "decision:shard-by-tenant") & F.col("invalidated")).count() == 1
    assert "error" in m.bind("no edge", out["replacement"])
