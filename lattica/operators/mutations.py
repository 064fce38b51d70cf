"""Writes as new tables: every operation takes the current tables and returns the changed ones; nothing is edited in place.

A batch of observations is merged at once by key, so its cost is one shuffle of the batch and the rows it meets. Violations are found by
queries and refused before anything is returned.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.functions import text as T
from lattica.operators import closure, typed
from lattica.session import cut, table
from lattica.sources.graph import edge_rows, node_rows


class Refused(ValueError):
    pass


def _none(df: DataFrame, why: str) -> None:
    bad = df.limit(3).collect()
    if bad:
        raise Refused(f"{why}: {[r.asDict() for r in bad]}")


def edge_id(src, edge_type, dst):
    return T.slug(F.concat_ws("|", src, edge_type, dst), "edge")


def merged_attrs(old: Column | str, new: Column | str) -> Column:
    """JSON objects merged key by key, the new value first; values keep their kind, nested ones too. What is no object counts as empty."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    return F.to_json(F.map_concat(F.map_filter(as_map(old), lambda k, _: ~F.array_contains(F.map_keys(as_map(new)), k)), as_map(new)))


def once_each(new: DataFrame) -> DataFrame:
    """The batch with one row an id. Its rows count in the order of build, date, attrs and rationale: the first rationale, date and source there are, the earliest build, and of
    each key of attrs the last value."""
    order = F.struct(*(F.coalesce(F.col(c).cast("string" if c != "build" else "long"), F.lit("") if c != "build" else F.lit(0)).alias(c) for c in ("build", "retrieved_at", "attrs", "rationale")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    rows = new.groupBy("id").agg(F.min("node_type").alias("node_type"), F.min("label").alias("label"), first("rationale"), first("retrieved_at"), first("source_id"), F.min("build").alias("build"), F.count_distinct("node_type", "label").alias("k"))
    keys = new.select("id", order.alias("o"), F.explode(F.from_json("attrs", "map<string,variant>")).alias("key", "value")).groupBy("id", "key").agg(F.max_by(F.to_json("value"), "o").alias("value"))
    pair = F.concat(F.to_json(F.struct("key")).substr(F.lit(8), F.length(F.to_json(F.struct("key"))) - 8), F.lit(":"), "value")
    attrs = keys.groupBy("id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("attrs"))
    return rows.join(attrs, "id", "left").withColumn("attrs", F.coalesce("attrs", F.lit("{}")))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """new: (id, node_type, label, attrs, rationale, retrieved_at, source_id, build). A known id keeps its label and order, fills what it lacks and takes the new
    keys of attrs; an id that comes with another type or label is refused, not merged."""
    once = cut(once_each(new), "new")
    _none(once.filter("k > 1").select("id"), "an id stands for two things")
    met = nodes.select("id", F.col("node_type").alias("t0"), F.col("label").alias("l0"))
    _none(once.join(met, "id").filter("node_type != t0 or label != l0").select("id"), "the id belongs to another node")
    top = nodes.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top")).first().top
    fresh = typed.dense_index(once.join(met, "id", "left_anti"), "id").withColumn("ord", F.col("idx") + F.lit(top + 1))
    fresh = fresh.select("id", "ord", "node_type", "label", "attrs", "rationale", "retrieved_at", "source_id", "build", F.lit(0).cast("long").alias("walks"), F.lit(False).alias("pruned"), F.lit(False).alias("invalidated"), F.lit(True).alias("live"))
    add = once.select("id", F.col("attrs").alias("a1"), F.col("rationale").alias("r1"), F.col("source_id").alias("s1"))
    kept = nodes.join(add, "id", "left").withColumn("attrs", F.when(F.col("a1").isNull(), F.col("attrs")).otherwise(merged_attrs("attrs", "a1")))
    kept = kept.withColumn("rationale", F.coalesce("rationale", "r1")).withColumn("source_id", F.coalesce("source_id", "s1"))
    return kept.select(*fresh.columns).unionByName(fresh)


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, build: int) -> DataFrame:
    """new: (src, edge_type, dst, weight and, where there is any, evidence_ids) observations. Illegal, dangling and self edges are refused, and an edge whose id already names another
    relationship; a known relationship gains the weight and the evidence it didn't have."""
    ids = F.array().cast("array<string>")
    new = new if "evidence_ids" in new.columns else new.withColumn("evidence_ids", ids)
    seen = cut(new.groupBy("src", "edge_type", "dst").agg(F.sum("weight").alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence_ids", ids))))).alias("ev")), "new")
    ends = typed.with_ends(seen.drop("ev"), nodes)
    _none(ends.filter("src = dst").select("src", "edge_type"), "an edge to itself")
    _none(ends.filter(F.col("st").isNull() | F.col("dt").isNull() | ~typed.legal("edge_type", "st", "dt")).select("src", "edge_type", "dst"), "not a legal edge")
    top = edges.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top")).first().top
    key, have = ["src", "edge_type", "dst"], "evidence_ids" in edges.columns
    kept = edges.join(seen, key, "left").withColumn("weight", F.col("weight") + F.coalesce("w", F.lit(0.0)))
    if have:
        kept = kept.withColumn("evidence_ids", F.when(F.col("ev").isNull(), F.col("evidence_ids")).otherwise(F.array_union(F.coalesce("evidence_ids", ids), "ev")))
    fresh = typed.dense_index(seen.join(edges.select(*key), key, "left_anti"), *key).select(
        edge_id("src", "edge_type", "dst").alias("id"), (F.col("idx") + F.lit(top + 1)).alias("ord"), *key, F.lit(None).cast("string").alias("assumption_id"), F.col("w").alias("weight"), F.lit(build).cast("long").alias("build"), F.lit(0).cast("long").alias("traversals"), F.lit(True).alias("live"), F.col("ev").alias("evidence_ids"))
    _none(fresh.join(edges.select("id"), "id", "left_semi").select("id"), "the edge id names another relationship")
    for c in set(edges.columns) - set(fresh.columns):
        fresh = fresh.withColumn(c, F.lit(None).cast(edges.schema[c].dataType))
    return kept.select(*edges.columns).unionByName(fresh.select(*edges.columns))


def assume(assumptions: DataFrame, statement: str, build: int, by: str = "planner") -> tuple[DataFrame, str]:
    """A new active assumption; the statement of a known one changes nothing, whatever its state."""
    spark = assumptions.sparkSession
    known = assumptions.filter(F.col("statement") == statement).select("id").first()
    if known:
        return assumptions, known.id
    new_id = spark.range(1).select(T.slug(F.lit(statement), "assumption").alias("id")).first().id
    if not assumptions.filter(F.col("id") == new_id).isEmpty():
        raise Refused(f"{new_id} is another statement's")
    return _added(assumptions, new_id, statement, build, by), new_id


def _added(assumptions: DataFrame, new_id: str, statement: str, build: int, by: str) -> DataFrame:
    top = assumptions.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top")).first().top
    new = assumptions.sparkSession.createDataFrame([(new_id, top + 1, statement, "active", 1, by, build)], "id string, ord long, statement string, status string, version_no long, created_by string, created_at_build long")
    for c in set(assumptions.columns) - set(new.columns):
        new = new.withColumn(c, F.lit(None).cast(assumptions.schema[c].dataType))
    return assumptions.unionByName(cut(new.select(*assumptions.columns), "assume"))


def supersede(assumptions: DataFrame, old_id: str, statement: str, build: int) -> tuple[DataFrame, str]:
    """A successor, named by its statement and version; both records name each other."""
    old = assumptions.filter(F.col("id") == old_id).first()
    if old is None or old.status != "active":
        raise Refused(f"{old_id} isn't an active assumption")
    spark, version = assumptions.sparkSession, old.version_no + 1
    new_id = spark.range(1).select(T.slug(F.lit(f"{statement}|v{version}"), "assumption").alias("id")).first().id
    if not assumptions.filter(F.col("id") == new_id).isEmpty():
        raise Refused(f"{new_id} is there already")
    out = _added(assumptions, new_id, statement, build, old.created_by)
    is_old, is_new = F.col("id") == old_id, F.col("id") == new_id
    out = out.withColumn("status", F.when(is_old, "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.when(is_old, new_id).otherwise(F.col("superseded_by")))
    return out.withColumn("supersedes", F.when(is_new, old_id).otherwise(F.col("supersedes"))).withColumn("version_no", F.when(is_new, old.version_no + 1).otherwise(F.col("version_no"))), new_id


def bind(edges: DataFrame, assumptions: DataFrame, edge: str, assumption_id: str) -> DataFrame:
    """Let a live edge stand on an active assumption. The same binding again changes nothing; another one is refused."""
    a, e = assumptions.filter(F.col("id") == assumption_id).first(), edges.filter(F.col("id") == edge).first()
    if a is None or a.status != "active" or e is None or not e.live:
        raise Refused("the assumption isn't active or the edge not live")
    if e.assumption_id not in (None, assumption_id):
        raise Refused("the edge stands on another assumption")
    return edges.withColumn("assumption_id", F.when(F.col("id") == edge, assumption_id).otherwise(F.col("assumption_id")))


def reject(nodes: DataFrame, edges: DataFrame, assumptions: DataFrame, assumption_id: str, evidence_id: str, build: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, assumptions, radius). The closure is taken before any flag changes; then the assumption, its radius, edges bound to it and edges within
    the radius fall, and the evidence contradicts it."""
    a, ev = assumptions.filter(F.col("id") == assumption_id).first(), nodes.filter(F.col("id") == evidence_id).first()
    if a is None or a.status != "active":
        raise Refused(f"{assumption_id} isn't an active assumption")
    if ev is None or ev.node_type != "evidence" or ev.invalidated:
        raise Refused(f"{evidence_id} isn't standing evidence")
    radius = cut(closure.blast_radius(nodes.sparkSession.createDataFrame([(assumption_id,)], "root string"), edges, nodes), "radius")
    fallen = radius.select(F.col("node").alias("id")).unionByName(nodes.sparkSession.createDataFrame([(assumption_id,)], "id string")).withColumn("down", F.lit(True))
    n = nodes.join(fallen, "id", "left").withColumn("invalidated", F.col("invalidated") | F.coalesce("down", F.lit(False))).withColumn("live", F.col("live") & ~F.coalesce("down", F.lit(False))).select(*nodes.columns)
    r = radius.select(F.col("node").alias("x"))
    e = edges.join(r.select(F.col("x").alias("src"), F.lit(True).alias("ds")), "src", "left").join(r.select(F.col("x").alias("dst"), F.lit(True).alias("dd")), "dst", "left")
    falls = F.coalesce(F.col("assumption_id") == assumption_id, F.lit(False)) | (F.coalesce("ds", F.lit(False)) & F.coalesce("dd", F.lit(False)))
    e = cut(e.withColumn("live", F.col("live") & ~falls).select(*edges.columns), "edges")
    contra = nodes.sparkSession.createDataFrame([(evidence_id, "contradicts", assumption_id, 1.0)], "src string, edge_type string, dst string, weight double")
    e = upsert_edges(e, contra, nodes, build)
    is_a = F.col("id") == assumption_id
    out = assumptions.withColumn("status", F.when(is_a, "rejected").otherwise(F.col("status"))).withColumn("rejected_at_build", F.when(is_a, F.lit(build).cast("long")).otherwise(F.col("rejected_at_build")))
    return n, e, out.withColumn("evidence_ids", F.when(is_a, F.array_union(F.coalesce("evidence_ids", F.array().cast("array<string>")), F.array(F.lit(evidence_id)))).otherwise(F.col("evidence_ids"))), radius


def fingerprint(title: str, rationale: str, source_id: str | None, cites=(), derived_from=(), depends_on=(), produces=(), supersedes: str | None = None) -> str:
    """SHA-256 of a decision's content: sorted keys, lists sorted and each value once, ASCII-escaped JSON."""
    body = {"title": title, "rationale": rationale, "source_id": source_id, "cites": sorted(set(cites)), "derived_from": sorted(set(derived_from)), "depends_on": sorted(set(depends_on)), "produces": sorted(set(produces)), "supersedes": supersedes}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def busiest_claims(spark, d):
    """The three claims with most edges that mention each canonical entity, busiest first."""
    from pyspark.sql import Window

    n, e = node_rows(spark, d), edge_rows(spark, d)
    hits = e.filter("live and edge_type = 'mentions'").join(n.filter("live and node_type = 'claim'").select(F.col("id").alias("src")), "src", "left_semi").join(table(spark, d, "canonical").select(F.col("entity_id").alias("dst")), "dst", "left_semi")
    rows = hits.join(typed.degrees(e).select(F.col("id").alias("src"), "degree"), "src")
    w = Window.partitionBy("dst").orderBy(F.desc("degree"), "src")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select(F.col("dst").alias("entity_id"), "place", F.col("src").alias("claim_id"), "degree")


QUERIES = {"busiest_claims": busiest_claims}
SQL = {
    "busiest_claims": O.with_(O.NODES, O.EDGES, O.DEGREE, "h AS (SELECT dst, src, degree, row_number() OVER (PARTITION BY dst ORDER BY degree DESC, src) AS place FROM e JOIN deg ON deg.id = e.src WHERE live AND edge_type = 'mentions' AND src IN (SELECT id FROM n WHERE live AND node_type = 'claim') AND dst IN (SELECT entity_id FROM canonical))")
    + "SELECT dst AS entity_id, place, src AS claim_id, degree FROM h WHERE place <= 3",
}
