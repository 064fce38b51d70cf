import pytest

from lattica.plans import evidence as V
from lattica.plans import ledger as L
from lattica.plans.runner import PlanError, Registry, Runner, Task, Verdict
from lattica.sources import ontology
from lattica.sources.store import Store, StoreError
from lattica.streaming import intake


def chain(spark, n=6):
    rows = [(c, i, "executed", f"t{i}", None if i == 2 else "d") for c in "xy" for i in range(1, n + 1)]
    return L.chained(spark.createDataFrame(rows, "chain string, seq long, event string, task string, detail string"))


def test_ledger_chain_and_tampering(spark):
    rows = [tuple(r) for r in chain(spark).collect()]
    schema = "chain string, seq long, round long, event string, task string, detail string, node_id string, assumption_id string, data string, digest string"
    broken = lambda r: {(x.chain, x.seq, x.why) for x in L.verify(spark.createDataFrame(r, schema)).collect()}
    last = L.GENESIS
    for r in sorted(r for r in rows if r[0] == "x"):
        last = L.digest(last, *r[1:9])
        assert r[9] == last
    assert broken(rows) == set()
    edited = [r if (r[0], r[1]) != ("x", 3) else (*r[:5], "changed", *r[6:]) for r in rows]
    assert broken(edited) == {("x", 3, "digest")}
    assert broken([r for r in rows if (r[0], r[1]) != ("y", 4)]) == {("y", 5, "gap")}
    assert {w for _, _, w in broken([r for r in rows if r[1] != 1])} == {"starts late"}
    assert ("x", 2, "repeated") in broken([*rows, next(r for r in rows if r[:2] == ("x", 2))])


def test_ledger_bytes_are_unambiguous_and_cover_all_fields(spark):
    assert L.digest("p", "a|b", "c") != L.digest("p", "a", "b|c") and L.digest("p", None) != L.digest("p", "") and L.digest("p", "1:a;") != L.digest("p", "a", "")
    one = spark.createDataFrame([("x", 1, "executed", "t", "d", "n", "a", "{}", 1)], "chain string, seq long, event string, task string, detail string, node_id string, assumption_id string, data string, round long")
    sealed = L.chained(one)
    assert L.verify(sealed).count() == 0
    for field, value in (("node_id", "m"), ("assumption_id", None), ("data", "[]"), ("round", 2), ("detail", "e")):
        assert [r.why for r in L.verify(sealed.withColumn(field, L.F.lit(value).cast(sealed.schema[field].dataType))).collect()] == ["digest"]


def test_a_pinned_head_tells_a_cut_tail(spark):
    rows = chain(spark)
    head = L.heads(rows)
    assert L.verify(rows, head).count() == 0 and L.verify(rows.filter("seq < 6")).count() == 0
    assert {tuple(r) for r in L.verify(rows.filter("seq < 6 or chain = 'y'"), head).collect()} == {("x", 5, "head")}
    assert {tuple(r) for r in L.verify(rows.filter("chain = 'y'"), head).collect()} == {("x", 0, "head")}


def test_runner_scenario():
    reg, outside = Registry(), set()
    reg.add("worker", "work", lambda c: {"attempt": c.attempt, "inputs": sorted(c.inputs)})
    reg.add("auditor", "cve", lambda c, out: Verdict("disproved", "CVE", "ev1") if "argon" in outside and c.task.ground == "argon" else True)
    with pytest.raises(PlanError):
        reg.add("worker", "work", print)
    tasks = [Task("base", worker="work"), Task("hashing", ("base",), "argon", "work", "cve"), Task("routes", ("hashing",), None, "work"), Task("tokens", ("base",), None, "work"), Task("docs", ("routes", "tokens"), None, "work")]
    r = Runner(tasks, reg)
    first = r.run()
    assert len(first.executed) == 5 and first.layers[0] == ["base"] and not first.cached
    outside.add("argon")
    assert r.recheck(require_evidence=set()) == [] and r.recheck(require_evidence={"ev1"}) == ["hashing"]
    assert {t.name for t in tasks if t.state == "stale"} == {"hashing", "routes", "docs"}
    second = r.run()
    assert set(second.blocked) == {"hashing", "routes", "docs"} and set(second.cached) == {"base", "tokens"}
    with pytest.raises(PlanError):
        r.repair("hashing", "argon")
    r.repair("hashing", "bcrypt")
    third = r.run()
    assert third.executed == ["hashing", "routes", "docs"] and set(third.cached) == {"base", "tokens"}
    last = L.GENESIS
    for e in r.ledger:
        last = L.digest(last, *(e.get(f) for f in L.FIELDS))
        assert e["digest"] == last
    for bad in ([Task("a", ("b",))], [Task("a", ("b",)), Task("b", ("a",))], [Task("a"), Task("a")]):
        with pytest.raises(PlanError):
            Runner(bad, reg)


def test_runner_failures():
    reg = Registry()
    reg.add("worker", "boom", lambda c: 1 / 0)
    reg.add("worker", "ok", lambda c: {})
    reg.add("auditor", "no", lambda c, o: False)
    r = Runner([Task("a", worker="boom"), Task("b", ("a",), worker="ok"), Task("c", worker="ok", auditor="no")], reg)
    out = r.run()
    assert out.failed == ["a", "c"] and set(out.blocked) == {"b"}


def test_evidence_validation(spark):
    assert V.payload("t", "s", None, {"b": 1, "a": "é"}) == '{"external_id":null,"metadata":{"a":"é","b":1},"source_id":"s","text":"t"}'
    deep = {}
    for _ in range(10):
        deep = {"k": deep}
    for bad in ({"x": float("nan")}, {1: 2}, deep, {"k": [0] * 1001}, {"k": object()}):
        with pytest.raises(V.EvidenceError):
            V.payload("t", "s", None, bad)
    for text, ext in (("", None), ("t", " "), ("t", "x" * 600), ("t", "a\nb")):
        with pytest.raises(V.EvidenceError):
            V.payload(text, "s", ext)
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}'):
        with pytest.raises(V.EvidenceError):
            V.strict_json(bad)
    ev = spark.createDataFrame([(1, 7, "view", "{}"), (2, 7, "view", "{}"), (3, 7, "view", '{"k": 1}')], "event_id long, user_id long, event_type string, props string")
    s = V.submissions(ev)
    assert {(r.first_event, r.deliveries) for r in V.intake(s).collect()} == {(1, 2), (3, 1)}
    assert V.intake(s, s.limit(1)).count() == 1


def test_store(spark, tmp_path):
    store = Store(str(tmp_path / "home"))
    t = {"nodes": spark.range(3).toDF("n"), "edges": spark.range(0).toDF("n")}
    assert store.commit(t, 0) == 1 and store.commit({"nodes": spark.range(5).toDF("n")}, 1) == 2
    with pytest.raises(StoreError):
        store.commit(t, 1)
    assert store.read(spark)["nodes"].count() == 5 and store.read(spark, 1)["edges"].count() == 0
    with store.lock(), pytest.raises(StoreError), store.lock():
        pass
    assert store.sweep(1) == [1] and store.versions() == [2]
    (tmp_path / "home" / "manifest-000009.json").symlink_to("/etc/hostname")
    assert store.latest() == 2
    (tmp_path / "home" / "manifest-000003.json").write_text('{"version": 3, "version": 3}')
    with pytest.raises(ValueError):
        store.read(spark)


def test_ontology():
    text = "| node | must carry |\n|---|---|\n| a | k |\n| b | |\n\n| edge | pairs | invalidation |\n|---|---|---|\n| uses | a->b, b->b | backward |\n"
    o = ontology.parse(text)
    assert o.allows("uses", "a", "b") and not o.allows("uses", "b", "a") and o.backward == ("uses",) and o.must_attrs == {"a": ("k",), "b": ()}
    for bad in (text.replace("backward", "sideways"), text.replace("a->b", "a->z"), "", text.replace("| a | k |\n| b | |\n", "")):
        with pytest.raises(ontology.OntologyError):
            ontology.parse(bad)


def test_stream_intake_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "store")
    rows = [(1, None, 7, "view", 1.0, "{}"), (2, None, 7, "view", 1.0, "{}")]
    for k in range(2):
        spark.createDataFrame(rows if not k else [*rows, (3, None, 8, "click", 2.0, "{}")], intake.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        intake.accept(spark, spark.readStream.schema(intake.EVENT_SCHEMA).parquet(src), out)
    got = spark.read.parquet(out).collect()
    assert len(got) == len({r.evidence_id for r in got}) == 2
