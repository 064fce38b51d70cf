"""Snapshots as JSON lines of the graph, of plans, ledgers and the list of names: written in order, read against a closed schema, and checked before use.

Every check is a query for violations; a snapshot with any is refused as a whole. Fields that a schema doesn't have are faults too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import typed
from lattica.operators.hierarchy import CYCLE, reached_roots
from lattica.operators.mutations import edge_id
from lattica.plans import ledger as L
from lattica.schema import ASSUMPTION_SCHEMA, EDGE_SCHEMA, EVENTS, NODE_SCHEMA, NODE_TYPES, STATUSES

PLAN_SCHEMA = "plan string, ord bigint, task_name string, title string, rationale string, state string, attempt bigint, assumes string, needs array<string>, produces array<string>, worker_key string, auditor_key string, node_id string, output_json string"
RUN_SCHEMA = "chain string, " + ", ".join(f"{f} {'bigint' if f in ('seq', 'round') else 'string'}" for f in (*L.FIELDS, "digest"))
NAMES_SCHEMA = "entity_id string, ord bigint, label string, aliases array<string>"
STATES = ("pending", "done", "failed", "stale")
SCHEMAS = {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA, "assumptions": ASSUMPTION_SCHEMA}


class SnapshotError(ValueError):
    pass


def _write(df: DataFrame, schema: str, path: str, *order: str) -> None:
    cols = [f.strip().split(" ", 1) for f in _fields(schema)]
    df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in cols))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.option("ignoreNullFields", "false").json(path)


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The rows; malformed ones, and ones with fields that the schema lacks, fail."""
    known = [f.strip().split(" ", 1)[0] for f in _fields(schema)]
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("k")).filter(~F.col("k").isin(*known))
    _refuse({"a field is unknown": keys})
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _refuse(checks: dict[str, DataFrame]) -> None:
    for why, bad in checks.items():
        if rows := bad.limit(3).collect():
            raise SnapshotError(f"{why}: {[r[0] for r in rows]}")


def write(tables: dict[str, DataFrame], folder: str) -> None:
    """The columns of each table's schema, range-sorted by ord; null fields are written out."""
    for name, schema in SCHEMAS.items():
        _write(tables[name], schema, f"{folder}/{name}", "ord")


def _fields(schema: str) -> list[str]:
    """Top-level fields of a schema text."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def read(spark: SparkSession, folder: str, derived_ids: bool = False) -> dict[str, DataFrame]:
    """The tables. Refused: unknown types, repeated ids, dangling or illegal edges, null keys; assumptions without a node, with another label or an unknown status; supersessions that only one side
    knows; edges bound to no assumption, or live ones to a rejected one; evidence that isn't there. derived_ids: edge ids have to be those of their ends and type, as this library names them."""
    out = {n: _read(spark, s, f"{folder}/{n}") for n, s in SCHEMAS.items()}
    nodes, edges, a = out["nodes"], out["edges"], out["assumptions"]
    live = nodes.withColumn("live", ~(F.coalesce("pruned", F.lit(False)) | F.coalesce("invalidated", F.lit(False))))
    ends = typed.with_ends(edges, live)
    ids = nodes.select(F.col("id").alias("x"))
    older, newer = a.filter("supersedes is not null").select("id", F.col("supersedes").alias("other")), a.filter("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.col("id").alias("other"))
    bound = edges.filter("assumption_id is not null").join(a.select(F.col("id").alias("assumption_id"), "status"), "assumption_id", "left")
    cited = edges.select("id", F.explode("evidence_ids").alias("x")).unionByName(a.select("id", F.explode("evidence_ids").alias("x")))
    _refuse({
        "an id is missing": nodes.filter("id is null or node_type is null or label is null").select("id").unionByName(edges.filter("id is null or src is null or dst is null or edge_type is null").select("id")),
        "a node type is unknown": nodes.filter(~F.col("node_type").isin(*NODE_TYPES)).select("id"),
        "an id is repeated": nodes.groupBy("id").count().filter("count > 1").select("id").unionByName(edges.groupBy("id").count().filter("count > 1").select("id")).unionByName(a.groupBy("id").count().filter("count > 1").select("id")),
        "an edge dangles": ends.filter("st is null or dt is null").select("id"),
        "an edge is illegal": ends.filter("st is not null and dt is not null").filter(~typed.legal("edge_type", "st", "dt")).select("id"),
        "an edge has another's id": edges.filter(F.col("id") != edge_id("src", "edge_type", "dst")).select("id") if derived_ids else edges.limit(0).select("id"),
        "an assumption has no node": a.select("id").join(nodes.filter("node_type = 'assumption'").select("id"), "id", "left_anti"),
        "an assumption's node says something else": a.join(nodes.select("id", "label"), "id").filter(~F.col("label").eqNullSafe(F.col("statement"))).select("id"),
        "an assumption's status is unknown": a.filter(F.col("status").isNull() | ~F.col("status").isin(*STATUSES)).select("id"),
        "a supersession is known to one side only": older.join(newer, ["id", "other"], "left_anti").unionByName(newer.join(older, ["id", "other"], "left_anti")).select("id"),
        "an edge is bound to no assumption": bound.filter("status is null").select("id"),
        "a live edge is bound to a rejected assumption": bound.filter("status = 'rejected' and not coalesce(invalidated, false)").select("id"),
        "evidence is missing": cited.filter("x is not null").join(ids, "x", "left_anti").select("id"),
    })
    return out


def write_ledger(ledger: DataFrame, folder: str) -> None:
    """Entries as they are, and the head of each chain beside them."""
    _write(L.whole(ledger), RUN_SCHEMA, f"{folder}/ledger", "chain", "seq")
    L.heads(ledger).write.json(f"{folder}/heads")


def read_ledger(spark: SparkSession, folder: str, expect: DataFrame | None = None) -> DataFrame:
    """The entries as written. Refused where a chain doesn't follow, doesn't end with its head, or not with the one expected: (chain, head), kept elsewhere."""
    out = _read(spark, RUN_SCHEMA, f"{folder}/ledger")
    kept = _read(spark, "chain string, entries bigint, head string", f"{folder}/heads").select("chain", "head")
    where = lambda bad: bad.select(F.concat_ws(" ", "chain", "seq", "why"))
    _refuse({
        "an entry lacks its place": out.filter("chain is null or seq is null or digest is null").select(F.coalesce("chain", F.lit("?"))),
        "an event is unknown": out.filter(F.col("event").isNotNull() & ~F.col("event").isin(*EVENTS)).select("event"),
        "a chain has no head": out.select("chain").distinct().join(kept, "chain", "left_anti"),
        "a chain is broken": where(L.verify(out, kept)),
        "a chain isn't the one expected": where(L.verify(out, expect)) if expect is not None else out.limit(0).select("chain"),
    })
    return out


def write_plan(tasks: DataFrame, folder: str) -> None:
    _write(tasks, PLAN_SCHEMA, f"{folder}/plan", "plan", "ord")


def read_plan(spark: SparkSession, folder: str, nodes: DataFrame | None = None, assumptions: DataFrame | None = None, workers: set[str] | None = None, auditors: set[str] | None = None) -> DataFrame:
    """The tasks. Refused: missing or repeated names, unknown states, needs that name no task of the plan, cycles; where they are given, nodes, assumptions, workers and auditors that aren't there."""
    out = _read(spark, PLAN_SCHEMA, f"{folder}/plan")
    key = lambda c: F.concat("plan", F.lit("/"), c)
    keys = out.select(key("task_name").alias("key"))
    needs = out.select(key("task_name").alias("key"), F.explode("needs").alias("need"), "plan").select("key", key("need").alias("parent")).distinct()
    none = out.limit(0).select("task_name")
    _refuse({
        "a task has no name": out.filter("plan is null or task_name is null").select(F.coalesce("plan", F.lit("?"))),
        "a task is repeated": keys.groupBy("key").count().filter("count > 1").select("key"),
        "a state is unknown": out.filter(F.col("state").isNull() | ~F.col("state").isin(*STATES)).select("task_name"),
        "a need names no task": needs.join(keys.select(F.col("key").alias("parent")), "parent", "left_anti").select("key"),
        "a node is missing": out.filter("node_id is not null").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("task_name") if nodes is not None else none,
        "an assumption is missing": out.filter("assumes is not null").join(assumptions.select(F.col("id").alias("assumes")), "assumes", "left_anti").select("task_name") if assumptions is not None else none,
        "a worker is unknown": out.filter(F.col("worker_key").isNotNull() & ~F.col("worker_key").isin(*(workers or {""}))).select("task_name") if workers is not None else none,
        "an auditor is unknown": out.filter(F.col("auditor_key").isNotNull() & ~F.col("auditor_key").isin(*(auditors or {""}))).select("task_name") if auditors is not None else none,
    })
    _refuse({"a task needs itself": reached_roots(keys, needs).filter(F.col("root") == CYCLE).select("key")})
    return out


def write_names(names: DataFrame, folder: str) -> None:
    _write(names, NAMES_SCHEMA, f"{folder}/names", "ord")


def read_names(spark: SparkSession, folder: str, nodes: DataFrame | None = None) -> DataFrame:
    """The list of names. Refused: missing or repeated ids, missing labels, empty aliases; where nodes are given, entries that are no entity of that label."""
    from lattica.operators.agreement import name_faults

    out = _read(spark, NAMES_SCHEMA, f"{folder}/names")
    _refuse({
        "an entry has no id or label": out.filter("entity_id is null or label is null").select(F.coalesce("entity_id", "label", F.lit("?"))),
        "an id is repeated": out.groupBy("entity_id").count().filter("count > 1").select("entity_id"),
        "an alias is empty": out.filter(F.exists("aliases", lambda x: x.isNull() | (F.trim(x) == ""))).select("entity_id"),
        "the graph doesn't agree": name_faults(out, nodes) if nodes is not None else out.limit(0).select("entity_id"),
    })
    return out
