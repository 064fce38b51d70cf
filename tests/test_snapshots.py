import pytest
from pyspark.sql import functions as F

from lattica.operators import mutations as M
from lattica.plans import ledger as L
from lattica.sources import snapshot as S
from test_graph import scenario
from test_mutations import A
from test_plans import chain


def test_faults_of_a_graph(spark, tmp_path):
    n, e = scenario(spark)
    a = spark.createDataFrame([("a", 0, "a", "active", 1, "p", 1, None, None, None, None)], A)
    e = e.withColumn("invalidated", ~F.col("live")).withColumn("evidence_ids", F.lit(None).cast("array<string>"))
    cases = {
        "missing": (e.withColumn("evidence_ids", F.array(F.lit("nobody"))), a), "bound to no": (e.withColumn("assumption_id", F.lit("zz")), a), "rejected": (e.withColumn("assumption_id", F.lit("a")), a.withColumn("status", F.lit("rejected"))),
        "status": (e, a.withColumn("status", F.lit("maybe"))), "one side": (e, a.withColumn("superseded_by", F.lit("b"))), "something else": (e, a.withColumn("statement", F.lit("b"))),
    }
    for k, (why, (e2, a2)) in enumerate(cases.items()):
        S.write({"nodes": n, "edges": e2, "assumptions": a2}, str(tmp_path / str(k)))
        with pytest.raises(S.SnapshotError, match=why):
            S.read(spark, str(tmp_path / str(k)))
    S.write({"nodes": n, "edges": e, "assumptions": a}, str(tmp_path / "ok"))
    with pytest.raises(S.SnapshotError, match="another's id"):
        S.read(spark, str(tmp_path / "ok"), derived_ids=True)
    S.write({"nodes": n, "edges": e.withColumn("id", M.edge_id("src", "edge_type", "dst")), "assumptions": a}, str(tmp_path / "named"))
    assert S.read(spark, str(tmp_path / "named"), derived_ids=True)["edges"].count() == 7
    (tmp_path / "ok" / "assumptions" / "part-x.json").write_text('{"id": "q", "extra": 1}\n')
    with pytest.raises(S.SnapshotError, match="unknown: .*extra"):
        S.read(spark, str(tmp_path / "ok"))


def test_ledgers_are_read_as_written_and_pinned(spark, tmp_path):
    rows = chain(spark)
    S.write_ledger(rows, str(tmp_path / "run"))
    head = L.heads(rows).select("chain", "head")
    assert S.read_ledger(spark, str(tmp_path / "run"), head).count() == rows.count()
    longer = L.chained(rows.drop("digest").unionByName(rows.drop("digest").filter("seq = 6").withColumn("seq", F.col("seq") + 1)))
    S.write_ledger(longer.filter("seq < 7"), str(tmp_path / "cut"))  # resealed: its own head fits, the pinned one doesn't
    with pytest.raises(S.SnapshotError, match="expected"):
        S.read_ledger(spark, str(tmp_path / "cut"), L.heads(longer).select("chain", "head"))
    S.write_ledger(rows.withColumn("detail", F.when(F.col("seq") == 3, "changed").otherwise(F.col("detail"))), str(tmp_path / "edited"))
    with pytest.raises(S.SnapshotError, match="broken"):
        S.read_ledger(spark, str(tmp_path / "edited"))
    S.write_ledger(L.chained(rows.drop("digest").withColumn("event", F.lit("dreamt"))), str(tmp_path / "event"))
    with pytest.raises(S.SnapshotError, match="event"):
        S.read_ledger(spark, str(tmp_path / "event"))


def test_plans_are_closed(spark, tmp_path):
    schema = "plan string, ord long, task_name string, state string, needs array<string>, worker_key string, assumes string, node_id string"
    good = [("p", 0, "a", "done", None, "w", "a", "d1"), ("p", 1, "b", "pending", ["a"], None, None, None), ("q", 0, "a", "stale", [], None, None, None)]
    n, _ = scenario(spark)
    a = spark.createDataFrame([("a", 0, "a", "active", 1, "p", 1, None, None, None, None)], A)
    cases = {"repeated": good[0], "state": ("p", 5, "c", "odd", None, None, None, None), "names no task": ("q", 5, "c", "done", ["b"], None, None, None), "itself": ("p", 5, "c", "done", ["c"], None, None, None), "no name": ("p", 5, None, "done", None, None, None, None),
             "node": ("p", 5, "c", "done", None, None, None, "nobody"), "assumption": ("p", 5, "c", "done", None, None, "none", None), "worker": ("p", 5, "c", "done", None, "x", None, None)}
    for k, (why, row) in enumerate({"": None, **cases}.items()):
        S.write_plan(spark.createDataFrame(good + ([row] if row else []), schema), str(tmp_path / str(k)))
        if row is None:
            assert S.read_plan(spark, str(tmp_path / str(k)), n, a, {"w"}, set()).count() == 3
        else:
            with pytest.raises(S.SnapshotError, match=why):
                S.read_plan(spark, str(tmp_path / str(k)), n, a, {"w"}, set())


def test_names_agree_with_the_graph(spark, tmp_path):
    n, _ = scenario(spark)
    rows = lambda *r: spark.createDataFrame(list(r), "entity_id string, ord long, label string, aliases array<string>")
    S.write_names(rows(("x", 0, "x", ["y"])), str(tmp_path / "ok"))
    assert S.read_names(spark, str(tmp_path / "ok"), n).count() == 1
    for why, row in {"agree": ("c1", 0, "c1", None), "alias": ("x", 0, "x", [" "]), "label": ("x", 0, None, None)}.items():
        S.write_names(rows(row), str(tmp_path / why))
        with pytest.raises(S.SnapshotError, match=why):
            S.read_names(spark, str(tmp_path / why), n)
