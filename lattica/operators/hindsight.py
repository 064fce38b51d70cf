"""Questions answered from the graph as it stood on a date, with what is known since kept apart.

The walk runs over the projection, so its path, cost and dead end are those of then. What bears on it and came later is gathered from the whole graph and
filed by horizon: nothing of it enters the answer, nothing of it is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import temporal, walk
from lattica.operators.build import Registry
from lattica.session import cut, table
from lattica.sources.graph import assumption_rows, edge_rows, node_rows

#: Edges by which a later node bears on an earlier one.
BEARING = ("contradicts", "supersedes", "supports")


def explain(questions: DataFrame, nodes: DataFrame, edges: DataFrame, assumptions: DataFrame, canonical: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """questions: (walk_id, question). (walks over the projection; placed: walk_id, bucket, node, node_type, label, side, day, via, source_id, status, version_no).

    Buckets: then (walked nodes), decision (walked decisions and assumptions, and the ground that walked decisions depend on, also where the walk didn't reach it), later and undated (what contradicts,
    supersedes or supports any of these; and what contradicts those of the assumptions that were rejected then, whenever it came), not_yet_known (entities the question names that the projection lacks).
    A node is in one bucket of a walk, the first of these."""
    n, e, a = temporal.as_of_graph(nodes, edges, assumptions, as_of)
    n, e = cut(n, "past"), cut(e, "paste")
    walks, _ = walk.ask(questions, n, e, canonical)
    day = cut(temporal.anchors(nodes, edges), "anchors").withColumn("side", temporal.horizon(F.col("day"), as_of))
    kinds = nodes.select(F.col("id").alias("node"), "node_type", "label")
    status = a.select(F.col("id").alias("node"), "status", "version_no")

    said = questions.select("walk_id", F.explode(T.question_mentions("question")).alias("mention")).withColumn("norm", T.normalise("mention"))
    named = said.join(Registry(canonical).resolve(said.select("norm").distinct()).filter("entity_id is not null"), "norm").select("walk_id", F.col("entity_id").alias("node")).distinct()
    unknown = named.join(kinds.select("node"), "node", "left_semi").join(n.select(F.col("id").alias("node")), "node", "left_anti").withColumn("bucket", F.lit("not_yet_known"))

    walked = walks.filter("path is not null").select("walk_id", F.explode("path").alias("node")).distinct().join(kinds.select("node", "node_type"), "node")
    walked = cut(walked.withColumn("bucket", F.when(F.col("node_type").isin("decision", "assumption"), "decision").otherwise("then")), "walked")
    ground = walked.filter("bucket = 'decision'").select("walk_id", F.col("node").alias("src")).join(edges.filter("edge_type = 'depends_on'").select("src", F.col("dst").alias("node")), "src")
    ground = ground.join(n.select(F.col("id").alias("node")), "node", "left_semi").select("walk_id", "node").distinct().join(walked, ["walk_id", "node"], "left_anti")
    seen = cut(walked.select("walk_id", "node", "bucket").unionByName(ground.withColumn("bucket", F.lit("decision"))), "seen")

    into = edges.filter(F.col("edge_type").isin(*BEARING)).select(F.col("src").alias("other"), F.col("dst").alias("node"), "edge_type")
    sides = day.select(F.col("id").alias("other"), "side")
    bears = seen.join(into, "node").join(sides, "other").withColumn("witness", F.col("edge_type") == "contradicts")
    fallen = seen.filter("bucket = 'decision'").join(status.filter("status = 'rejected'"), "node", "left_semi").select("walk_id", "node", F.lit(True).alias("down"))
    bears = bears.join(fallen, ["walk_id", "node"], "left").filter((F.col("side") != "then") | (F.col("witness") & F.coalesce("down", F.lit(False))))
    bears = bears.select("walk_id", F.col("other").alias("node"), F.when(F.col("side") == "undated", "undated").otherwise("later").alias("bucket")).distinct().join(seen, ["walk_id", "node"], "left_anti")
    rows = seen.unionByName(bears)
    rows = rows.unionByName(unknown.join(rows, ["walk_id", "node"], "left_anti").select("walk_id", "node", "bucket"))
    placed = rows.join(kinds, "node").join(day.select(F.col("id").alias("node"), "side", "day", "via", "source_id"), "node", "left").join(status, "node", "left")
    return walks, placed.select("walk_id", "bucket", "node", "node_type", "label", "side", "day", "via", "source_id", "status", "version_no")


def explain_as_of(spark, d):
    """What was known then of every canonical entity, what was decided on it, and what came afterwards."""
    placed = explain(walk.entity_questions(spark, d), node_rows(spark, d), edge_rows(spark, d), assumption_rows(spark, d), table(spark, d, "canonical"), temporal.AS_OF)[1]
    return placed.select("walk_id", "bucket", "node", "node_type", "side", F.col("day").cast("string").alias("day"), "via", "status")


QUERIES = {"explain_as_of": explain_as_of}
SQL: dict[str, str] = {}
