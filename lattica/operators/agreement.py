"""Facts that hold between tables, and so belong to none of them: the ledger with the plan, the graph and the assumptions; the list of names with the graph.

Every check gives its violations as rows; nothing is collected to find them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.operators.hierarchy import folded
from lattica.plans import ledger as L
from lattica.session import cut, table
from lattica.sources.graph import assumption_rows, latest, node_rows


def ledger_faults(ledger: DataFrame, tasks: DataFrame, nodes: DataFrame, assumptions: DataFrame, rounds: DataFrame) -> DataFrame:
    """(chain, seq, why): entries that name a node, an assumption or a task that isn't there, or a round that the plan never reached. ledger: chain, seq, round, task, node_id, assumption_id; tasks: plan,
    task_name; rounds: plan, reached. Task names are compared as they are said."""

    def missing(column: str, there: DataFrame, why: str) -> DataFrame:
        return ledger.filter(F.col(column).isNotNull()).join(there, column, "left_anti").select("chain", "seq", F.lit(why).alias("why"))

    named = tasks.select(F.col("plan").alias("chain"), F.col("task_name").alias("task")).distinct()
    stray = ledger.join(named, ["chain", "task"], "left_anti").select("chain", "seq", F.lit("task").alias("why"))
    ahead = ledger.join(rounds.select(F.col("plan").alias("chain"), "reached"), "chain", "left").filter(F.col("round") > F.coalesce("reached", F.lit(0))).select("chain", "seq", F.lit("round").alias("why"))
    return missing("node_id", nodes.select(F.col("id").alias("node_id")), "node").unionByName(missing("assumption_id", assumptions.select(F.col("id").alias("assumption_id")), "assumption")).unionByName(stray).unionByName(ahead)


def ledger_agreement(spark, d):
    """Violations by plan and kind, of the ledgers made from the tasks."""
    tasks = table(spark, d, "tasks").filter("plan is not null and task_name is not null")
    entries = cut(L.whole(L.task_entries(spark, d)), "entries")
    rounds = tasks.groupBy("plan").agg(F.max("attempt").alias("reached"))
    return ledger_faults(entries, tasks, node_rows(spark, d), assumption_rows(spark, d), rounds).groupBy("chain", "why").agg(F.count("*").alias("n"))


def name_faults(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names: (entity_id, label). (entity_id, why): entries that are no node, no entity, or called otherwise in the graph."""
    met = names.filter("entity_id is not null").join(nodes.select(F.col("id").alias("entity_id"), "node_type", F.col("label").alias("called")), "entity_id", "left")
    why = F.when(F.col("node_type").isNull(), "no node").when(F.col("node_type") != "entity", "no entity").when(~F.col("called").eqNullSafe(F.col("label")), "label")
    return met.select("entity_id", why.alias("why")).filter("why is not null")


def resolver_agreement(spark, d):
    """The names that entities of the delivered nodes go by, held against the list, and the list against the nodes that edges name."""
    listed = table(spark, d, "canonical").select("entity_id", "label")
    return name_faults(listed, table(spark, d, "nodes").filter("id is not null").select("id", "node_type", "label").distinct())


def edge_evidence(spark, d):
    """(src, edge_type, dst, evidence): the evidence of a relationship is that of all its edges, each once."""
    raw = table(spark, d, "edges").filter("id is not null and src is not null and dst is not null").withColumn("edge_type", folded("edge_type"))
    one = latest(raw, "id", ["loaded_at", "weight", "traversals"], ["src", "dst", "edge_type", "evidence_ids"])
    return one.select("src", "edge_type", "dst", F.explode("evidence_ids").alias("evidence")).filter("evidence is not null").distinct()


def ledger_receipts(spark, d):
    """The receipt of each task in its ledger: how often it was entered, and what was said last."""
    e = L.task_entries(spark, d)
    return e.groupBy("chain", "task").agg(F.count("*").alias("entries"), F.max_by("event", "seq").alias("last_event"), F.max("seq").alias("last_seq"))


_T = L._T
QUERIES = {f.__name__: f for f in (ledger_agreement, resolver_agreement, edge_evidence, ledger_receipts)}
SQL = {
    "ledger_agreement": O.with_(O.NODES, O.ASSUMPTIONS, _T, L._ROWS, "r AS (SELECT plan, max(attempt) AS reached FROM tasks WHERE plan IS NOT NULL AND task_name IS NOT NULL GROUP BY plan)", """f AS (
 SELECT chain, 'node' AS why FROM le WHERE node_id IS NOT NULL AND node_id NOT IN (SELECT id FROM n)
 UNION ALL SELECT chain, 'assumption' FROM le WHERE assumption_id IS NOT NULL AND assumption_id NOT IN (SELECT id FROM a)
 UNION ALL SELECT chain, 'task' FROM le WHERE NOT EXISTS (SELECT 1 FROM tasks WHERE plan = chain AND task_name = task)
 UNION ALL SELECT chain, 'round' FROM le LEFT JOIN r ON r.plan = chain WHERE round > coalesce(reached, 0))""") + "SELECT chain, why, count(*) AS n FROM f GROUP BY ALL",
    "resolver_agreement": "SELECT entity_id, CASE WHEN n.id IS NULL THEN 'no node' WHEN node_type IS DISTINCT FROM 'entity' THEN 'no entity' ELSE 'label' END AS why FROM canonical c LEFT JOIN (SELECT DISTINCT id, node_type, label FROM nodes WHERE id IS NOT NULL) n ON n.id = entity_id "
    "WHERE entity_id IS NOT NULL AND (n.id IS NULL OR node_type IS DISTINCT FROM 'entity' OR n.label IS DISTINCT FROM c.label)",
    "edge_evidence": O.with_(O.EDGES) + "SELECT DISTINCT src, et AS edge_type, dst, x AS evidence FROM (SELECT src, et, dst, unnest(evidence_ids) AS x FROM e0 WHERE rn = 1) WHERE x IS NOT NULL",
    "ledger_receipts": O.with_(_T, L._ROWS) + "SELECT chain, task, count(*) AS entries, arg_max(event, seq) AS last_event, max(seq) AS last_seq FROM le GROUP BY ALL",
}
