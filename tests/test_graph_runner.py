import pytest
from pyspark.sql import functions as F

from lattica.operators import ground as G
from lattica.plans.graph_runner import GraphRunner, slug
from lattica.plans.runner import PlanError, Registry, Task, Verdict
from test_graph import edges, nodes
from test_mutations import A


def test_rounds_are_written_to_the_graph(spark):
    n = nodes(spark, [("s1", "source", "2026-01-01", True), ("argon", "assumption", None, True), ("ev1", "evidence", "s1", True), ("gone", "evidence", "s1", False)])
    a = spark.createDataFrame([("argon", 0, "argon", "active", 1, "p", 1, None, None, None, None)], A)
    g = G.Graph(n, edges(spark, [("ev1", "supports", "x")]).limit(0), a, 3)
    outside, reg = set(), Registry()
    reg.add("worker", "work", lambda c: {"attempt": c.attempt})
    reg.add("auditor", "cve", lambda c, out: Verdict("disproved", "CVE", next(iter(outside))) if outside and c.task.ground == "argon" else Verdict("ok", "nothing known"))
    tasks = [Task("base", worker="work"), Task("hashing", ("base",), "argon", "work", "cve"), Task("routes", ("hashing",), None, "work")]
    with pytest.raises(PlanError):
        GraphRunner(g, "auth", "s1", [Task("x", ground="nobody", worker="work")], reg)
    r = GraphRunner(g, "auth", "s1", tasks, reg, {"hashing": ("Hash Column",)})
    r.run()
    ids = {t.name: slug(f"auth|{t.name}|v1", "decision") for t in tasks}
    assert r.nodes == ids
    column = slug("Hash Column", "entity")
    links = {(x.src, x.edge_type, x.dst) for x in r.graph.edges.collect()}
    audit = slug("audit of hashing: nothing known", "evidence")
    assert links == {*((i, "cites", "s1") for i in ids.values()), (ids["hashing"], "depends_on", "argon"), (ids["hashing"], "depends_on", ids["base"]), (ids["routes"], "depends_on", ids["hashing"]), (ids["hashing"], "produces", column), (ids["hashing"], "justified_by", audit)}
    outside.add("gone")
    assert r.recheck({"gone"}) == []  # what it cites doesn't stand
    outside.clear()
    outside.add("ev1")
    assert r.recheck({"ev1"}) == ["hashing"]
    down = {x.id for x in r.graph.nodes.filter("invalidated").collect()}
    assert {"argon", ids["hashing"], ids["routes"], column} <= down and ids["base"] not in down and {x.node for x in r.radius["argon"].collect()} == {ids["hashing"], ids["routes"], column}
    assert r.graph.assumptions.first().status == "rejected" and r.graph.edges.filter("edge_type = 'contradicts'").select("src", "dst").collect() == [("ev1", "argon")]
    with pytest.raises(PlanError):
        r.repair("hashing", "argon")
    r.repair("hashing", "Use bcrypt")
    third = r.run()
    assert third.executed == ["hashing", "routes"] and third.cached == ["base"]
    again = slug("auth|hashing|v2", "decision")
    rows = {x.id: x for x in r.graph.nodes.collect()}
    assert rows[column].live and not rows[column].invalidated and rows[again].live and not rows[ids["hashing"]].live
    assert r.graph.edges.filter((F.col("src") == again) & (F.col("edge_type") == "supersedes")).first().dst == ids["hashing"]
