"""Assumptions, their mirrored nodes and evidence as writes to a whole graph: each takes the graph and returns a new one, or refuses before anything changes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import mutations as M
from lattica.operators import typed
from lattica.plans.evidence import EvidenceError, payload, strict_json
from lattica.session import cut

#: A prune by walks waits for so many walks.
LEAST_WALKS = 2
EVIDENCE = "text string, source_id string, external_id string, metadata string"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    assumptions: DataFrame
    build: int


def _one(g: Graph, schema: str, *row) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([row], schema)


def mirrored(g: Graph, ids: list[str]) -> Graph:
    """The nodes of these assumptions as their records say: label, status and version."""
    rows = g.assumptions.filter(F.col("id").isin(ids))
    attrs = F.to_json(F.struct("status", F.col("version_no").alias("version")))
    none = F.lit(None).cast("string")
    new = rows.select("id", F.lit("assumption").alias("node_type"), F.col("statement").alias("label"), attrs.alias("attrs"), none.alias("rationale"), none.alias("retrieved_at"), none.alias("source_id"), F.lit(g.build).cast("long").alias("build"))
    return replace(g, nodes=cut(M.upsert_nodes(g.nodes, new), "nodes"))


def _linked(g: Graph, *rows: tuple[str, str, str]) -> Graph:
    new = g.nodes.sparkSession.createDataFrame([(*r, 1.0) for r in rows], "src string, edge_type string, dst string, weight double")
    return replace(g, edges=M.upsert_edges(g.edges, new, g.nodes, g.build)) if rows else g


def assume(g: Graph, statement: str, by: str = "agent", evidence_ids: tuple[str, ...] = ()) -> tuple[Graph, str]:
    """A new active assumption with its node and its justified_by edges; the statement of a known one changes nothing, whatever its state."""
    after, new = M.assume(g.assumptions, statement, g.build, by)
    if after is g.assumptions:
        return g, new
    cited = F.when(F.col("id") == new, F.lit(list(evidence_ids)).cast("array<string>")).otherwise(F.col("evidence_ids"))
    return _linked(mirrored(replace(g, assumptions=cut(after.withColumn("evidence_ids", cited), "assumptions")), [new]), *((new, "justified_by", e) for e in evidence_ids)), new


def supersede(g: Graph, old: str, statement: str) -> tuple[Graph, str]:
    """A successor with its own record, node and supersedes edge; the old one stays, superseded."""
    after, new = M.supersede(g.assumptions, old, statement, g.build)
    return _linked(mirrored(replace(g, assumptions=cut(after, "assumptions")), [old, new]), (new, "supersedes", old)), new


def reject(g: Graph, assumption_id: str, evidence_id: str, replacement: str | None = None) -> tuple[Graph, DataFrame, str | None]:
    """(graph, radius, id of the replacement): the radius is taken first, then it falls; a replacement is a new assumption of the next version that supersedes the rejected one."""
    n, e, a, radius = M.reject(g.nodes, g.edges, g.assumptions, assumption_id, evidence_id, g.build)
    out = mirrored(Graph(cut(n, "nodes"), cut(e, "edges"), cut(a, "assumptions"), g.build), [assumption_id])
    if replacement is None:
        return out, radius, None
    old = out.assumptions.filter(F.col("id") == assumption_id).first()
    out, new = assume(out, replacement, old.created_by)
    is_new, is_old = F.col("id") == new, F.col("id") == assumption_id
    a = out.assumptions.withColumn("version_no", F.when(is_new, old.version_no + 1).otherwise(F.col("version_no"))).withColumn("supersedes", F.when(is_new, assumption_id).otherwise(F.col("supersedes")))
    a = cut(a.withColumn("superseded_by", F.when(is_old, new).otherwise(F.col("superseded_by"))), "assumptions")
    return _linked(mirrored(replace(out, assumptions=a), [new]), (new, "supersedes", assumption_id)), radius, new


def submit_evidence(g: Graph, submissions: DataFrame) -> tuple[Graph, DataFrame]:
    """submissions: EVIDENCE, metadata as a JSON object. (graph, outcomes: evidence_id, external_id, outcome, why). Each valid payload is a detached evidence node named by its digest: 'added', or 'same' where it is
    there. Outcome 'refused', with the reason: no valid payload; an external id that already stands for another payload, or for two of this batch; a source the graph lacks."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, why = [], []
            for text, source, external, meta in zip(*(b.column(c).to_pylist() for c in ("text", "source_id", "external_id", "metadata"))):
                try:
                    value = strict_json(meta) if meta is not None else {}
                    if not isinstance(value, dict):
                        raise EvidenceError("metadata is no object")
                    ids.append("evidence:" + hashlib.sha256(payload(text or "", source or "", external, value).encode()).hexdigest())
                    why.append(None)
                except ValueError as e:
                    ids.append(None)
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.string()), pa.array(why, pa.string())], [*b.schema.names, "evidence_id", "why"])

    rows = cut(submissions.select("text", "source_id", "external_id", "metadata").mapInArrow(digest, EVIDENCE + ", evidence_id string, why string"), "submitted")
    bad = rows.filter("evidence_id is null").select("evidence_id", "external_id", F.lit("refused").alias("outcome"), "why")
    once = rows.filter("evidence_id is not null").dropDuplicates(["evidence_id"])
    held = g.nodes.filter("node_type = 'evidence'").select(F.col("id").alias("held"), F.get_json_object("attrs", "$.external_id").alias("external_id")).filter("external_id is not null")
    twice = once.filter("external_id is not null").groupBy("external_id").agg(F.count("*").alias("versions"))
    other = held.join(once.select("external_id", "evidence_id"), "external_id").filter("held != evidence_id").select("evidence_id").distinct().withColumn("taken", F.lit(True))
    known = g.nodes.select(F.col("id").alias("evidence_id"), F.lit(True).alias("there"))
    sources = g.nodes.filter("node_type = 'source'").select(F.col("id").alias("source_id"), F.lit(True).alias("sourced"))
    full = once.join(twice, "external_id", "left").join(other, "evidence_id", "left").join(known, "evidence_id", "left").join(sources, "source_id", "left")
    clash = F.when(F.col("taken"), "the external id stands for another payload").when(F.coalesce("versions", F.lit(1)) > 1, "the external id came with two payloads").when(F.col("sourced").isNull(), "no such source")
    full = cut(full.withColumn("why", F.when(F.col("there").isNull(), clash)), "judged")
    outcome = F.when(F.col("there"), "same").when(F.col("why").isNotNull(), "refused").otherwise("added")
    said = full.select("evidence_id", "external_id", outcome.alias("outcome"), "why")
    attrs = F.to_json(F.struct(F.lit("submitted").alias("kind"), "external_id", F.expr("parse_json(coalesce(metadata, '{}'))").alias("metadata")))
    none = F.lit(None).cast("string")
    new = full.filter("there is null and why is null").select(F.col("evidence_id").alias("id"), F.lit("evidence").alias("node_type"), F.col("text").alias("label"), attrs.alias("attrs"), none.alias("rationale"), none.alias("retrieved_at"), "source_id", F.lit(g.build).cast("long").alias("build"))
    return replace(g, nodes=cut(M.upsert_nodes(g.nodes, new), "nodes")), said.unionByName(bad)


def prune_walked(g: Graph, walks: int, min_walks: int = 1) -> Graph:
    """After `walks` walks: live nodes walked less than min_walks times, with at most one edge, are pruned; sources, assumptions and evidence stay. Nothing happens before LEAST_WALKS walks,
    since one question that misses a node says nothing of it."""
    if walks < LEAST_WALKS:
        return g
    rows = g.nodes.join(typed.degrees(g.edges), "id", "left")
    drop = F.col("live") & (F.col("walks") < min_walks) & ~F.col("node_type").isin("source", "assumption", "evidence") & (F.coalesce("degree", F.lit(0)) <= 1)
    return replace(g, nodes=cut(rows.withColumn("pruned", F.col("pruned") | drop).withColumn("live", F.col("live") & ~drop).select(*g.nodes.columns), "nodes"))
