"""The graph's tables, cleaned: one row per id, spellings folded, canonical entities as nodes.

An id delivered several times is its row loaded last. Edges of one (src, type, dst) are one relationship; its weight is the sum
over its distinct ids. Only columns that are selected later are read from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import iso_date
from lattica.operators.hierarchy import folded
from lattica.session import table

#: Canonical entities come after the nodes in insertion order.
CANONICAL_ORD = 1_000_000_000_000


def latest(rows: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the greatest by the order columns."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")


def node_rows(spark, sf_dir: str) -> DataFrame:
    """id, ord, node_type, label, attrs, rationale, retrieved_at, source_id, build, walks, live, pruned, invalidated."""
    raw = table(spark, sf_dir, "nodes").filter("id is not null").withColumn("source_id", F.col("prov.source_id"))
    keep = ["ord", "node_type", "label", "attrs", "rationale", "retrieved_at", "source_id", "build", "walks", "pruned", "invalidated"]
    own = latest(raw, "id", ["loaded_at", "walks", "build"], keep)
    null = lambda kind: F.lit(None).cast(kind)
    canonical = table(spark, sf_dir, "canonical").select(
        F.col("entity_id").alias("id"), (F.col("ord") + CANONICAL_ORD).alias("ord"), F.lit("entity").alias("node_type"), "label",
        F.to_json(F.struct(F.col("label").alias("canonical"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))).alias("attrs"), null("string").alias("rationale"),
        null("string").alias("retrieved_at"), null("string").alias("source_id"), F.lit(0).cast("long").alias("build"), F.lit(0).cast("long").alias("walks"), F.lit(False).alias("pruned"), F.lit(False).alias("invalidated"),
    )
    return own.unionByName(canonical).withColumn("live", ~F.coalesce("pruned", F.lit(False)) & ~F.coalesce("invalidated", F.lit(False)))


def edge_rows(spark, sf_dir: str) -> DataFrame:
    """id, ord, src, dst, edge_type, assumption_id, weight, build, traversals, live: one row per (src, edge_type, dst)."""
    raw = table(spark, sf_dir, "edges").filter("id is not null and src is not null and dst is not null").withColumn("edge_type", folded("edge_type"))
    one = latest(raw, "id", ["loaded_at", "weight", "traversals"], ["ord", "src", "dst", "edge_type", "assumption_id", "weight", "build", "traversals", "invalidated"])
    first = lambda c: F.min_by(c, "ord").alias(c)
    same = one.groupBy("src", "edge_type", "dst").agg(
        first("id"), F.min("ord").alias("ord"), first("assumption_id"), F.sum("weight").alias("weight"), F.min("build").alias("build"), F.sum("traversals").alias("traversals"), F.min("invalidated").alias("invalidated"))
    return same.select("id", "ord", "src", "dst", "edge_type", "assumption_id", "weight", "build", "traversals", (~F.coalesce("invalidated", F.lit(False))).alias("live"))


def assumption_rows(spark, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "assumptions").filter("id is not null")
    return latest(raw, "id", ["loaded_at", "ord"], ["ord", "statement", "status", "version_no", "created_by", "created_at_build", "supersedes", "superseded_by", "rejected_at_build", "evidence_ids"])


def dated_sources(nodes: DataFrame) -> DataFrame:
    return nodes.filter("node_type = 'source'").select(F.col("id").alias("source_id"), iso_date("retrieved_at").alias("day"))


def document_rows(spark, sf_dir: str) -> DataFrame:
    """Documents, one per source_key: a document taken in twice is its first doc_id."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    return latest(docs.withColumn("key", F.coalesce("source_key", F.concat(F.lit("source:doc-"), F.col("doc_id").cast("string")))).withColumn("nd", -F.col("doc_id")), "key", ["nd"], ["doc_id", "title", "origin", "text", "retrieved_at", "entities", "relations"])
