"""Time: anchors of nodes on the source calendar, horizons, and the graph as of a date.

Two clocks are kept apart: the source date (a DATE, from retrieved_at) and the logical build number. An undated node is never guessed into a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.operators import closure
from lattica.session import cut
from lattica.sources.graph import assumption_rows, dated_sources, edge_rows, node_rows

#: Horizon of the registered queries.
AS_OF = "2026-01-01"


def anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, source_id, via, day): a source itself, else the source of its provenance, else its first derived_from or cites edge to a source;
    an entity that stays undated takes its earliest dated producer. One pass over the edges per rule, no look-ups row by row."""
    src = dated_sources(nodes)
    base = nodes.select("id", "node_type", F.when(F.col("node_type") == "source", F.col("id")).otherwise(F.col("source_id")).alias("source_id"))
    own = base.join(src, "source_id", "left_semi").join(src, "source_id").select("id", "source_id", F.when(F.col("node_type") == "source", "self").otherwise("provenance").alias("via"), "day")
    rest = base.join(own, "id", "left_anti").select("id", "node_type")
    rank = F.when(F.col("edge_type") == "derived_from", 0).otherwise(1)
    first = edges.filter(F.col("edge_type").isin("derived_from", "cites")).join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(src, F.col("dst") == F.col("source_id"))
    first = first.groupBy(F.col("src").alias("id")).agg(F.min(F.struct(rank.alias("k"), "ord", "edge_type", "source_id", "day")).alias("m")).select("id", "m.source_id", F.col("m.edge_type").alias("via"), "m.day")
    none = rest.join(first, "id", "left_anti").select("id", F.lit(None).cast("string").alias("source_id"), F.lit("none").alias("via"), F.lit(None).cast("date").alias("day"))
    found = cut(own.unionByName(first).unionByName(none), "anchors")
    undated = found.filter("day is null").join(nodes.filter("node_type = 'entity'").select("id"), "id", "left_semi").select("id")
    made = edges.filter("edge_type = 'produces'").join(undated.withColumnRenamed("id", "dst"), "dst", "left_semi").join(found.filter("day is not null").select(F.col("id").alias("src"), "source_id", "day"), "src")
    made = made.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("day", "ord", "source_id")).alias("m")).select("id", "m.source_id", F.lit("produces").alias("via"), "m.day")
    return found.join(made, "id", "left_anti").unionByName(made)


def horizon(day, as_of: str):
    at = F.lit(as_of).cast("date")
    return F.when(day.isNull(), "undated").when(day <= at, "then").otherwise("later")


def fallen_assumptions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, day): the first source date of evidence that contradicts an assumption; null if none of it is dated."""
    ev = nodes.filter("node_type = 'evidence'").select(F.col("id").alias("src"))
    day = anchors(nodes, edges).select(F.col("id").alias("src"), "day")
    hits = edges.filter("edge_type = 'contradicts'").join(nodes.filter("node_type = 'assumption'").select(F.col("id").alias("dst")), "dst", "left_semi").join(ev, "src", "left_semi")
    return hits.join(day, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.min("day").alias("day"))


def as_of_nodes(nodes: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """(id, node_type, kept_by): nodes dated up to the horizon, and the assumptions those depend on that were no later build."""
    then = anchors(nodes, edges).filter(horizon(F.col("day"), as_of) == "then").select("id")
    kept = nodes.join(then, "id", "left_semi")
    ground = edges.filter("edge_type = 'depends_on'").join(kept.select(F.col("id").alias("src"), F.col("build").alias("b")), "src").groupBy(F.col("dst").alias("id")).agg(F.max("b").alias("b"))
    ground = nodes.filter("node_type = 'assumption'").join(ground, "id").filter("build <= b").join(kept.select("id"), "id", "left_anti")
    return kept.select("id", "node_type", F.lit("date").alias("kept_by")).unionByName(ground.select("id", "node_type", F.lit("ground").alias("kept_by")))


def as_of_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def as_of_graph(nodes: DataFrame, edges: DataFrame, assumptions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, assumptions) as they stood at a date: the projection, assumption states rewound to it, and invalidation replayed within it.
    A superseded assumption stays superseded where its successor is in the projection; evidence outside it is dropped from the lists; an assumption rejected
    by undated evidence alone counts as standing."""
    kept = cut(as_of_nodes(nodes, edges, as_of), "asof")
    n = nodes.join(kept.select("id"), "id", "left_semi").withColumn("pruned", F.lit(False)).withColumn("invalidated", F.lit(False)).withColumn("live", F.lit(True))
    e = as_of_edges(edges, kept).withColumn("live", F.lit(True))
    fell = fallen_assumptions(nodes, edges).filter(F.col("day") <= F.lit(as_of).cast("date"))
    a = assumptions.join(kept.select("id"), "id", "left_semi").join(fell, "id", "left").join(kept.select(F.col("id").alias("superseded_by"), F.lit(True).alias("next")), "superseded_by", "left")
    status = F.when(F.col("day").isNotNull(), "rejected").when(F.coalesce("next", F.lit(False)), "superseded").otherwise("active")
    a = cut(a.select("id", "ord", "statement", status.alias("status"), "version_no", "day"), "asofa")
    down = closure.blast_radius(a.filter("status = 'rejected'").select(F.col("id").alias("root")), e, n).select(F.col("node").alias("id")).unionByName(a.filter("status = 'rejected'").select("id")).distinct()
    down = cut(down.withColumn("down", F.lit(True)), "down")
    n = n.join(down, "id", "left").withColumn("invalidated", F.coalesce("down", F.lit(False))).withColumn("live", ~F.col("invalidated")).drop("down")
    both = e.join(down.select(F.col("id").alias("src"), F.lit(True).alias("ds")), "src", "left").join(down.select(F.col("id").alias("dst"), F.lit(True).alias("dd")), "dst", "left")
    bound = both.join(a.filter("status = 'rejected'").select(F.col("id").alias("assumption_id"), F.lit(True).alias("db")), "assumption_id", "left")
    e = bound.withColumn("live", ~(F.coalesce("db", F.lit(False)) | (F.coalesce("ds", F.lit(False)) & F.coalesce("dd", F.lit(False))))).drop("ds", "dd", "db")
    return n, e, a


def _g(spark, d):
    return node_rows(spark, d), edge_rows(spark, d)


def q_anchors(spark, d):
    return anchors(*_g(spark, d)).select("id", "source_id", "via", F.col("day").cast("string").alias("day"))


def q_horizon(spark, d):
    n, e = _g(spark, d)
    return anchors(n, e).join(n.select("id", "node_type"), "id").groupBy("node_type", horizon(F.col("day"), AS_OF).alias("side")).agg(F.count("*").alias("n"))


def dated_span(spark, d):
    return dated_sources(node_rows(spark, d)).agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count("day").alias("n_dated"))


def earliest_fall(spark, d):
    return fallen_assumptions(*_g(spark, d)).select("id", F.col("day").cast("string").alias("day"))


def q_as_of_nodes(spark, d):
    return as_of_nodes(*_g(spark, d), AS_OF)


def q_as_of_edges(spark, d):
    n, e = _g(spark, d)
    return as_of_edges(e, cut(as_of_nodes(n, e, AS_OF), "asof")).select("id", "src", "edge_type", "dst")


def q_as_of_assumptions(spark, d):
    n, e = _g(spark, d)
    return as_of_graph(n, e, assumption_rows(spark, d), AS_OF)[2].select("id", "status", F.col("day").cast("string").alias("fell"))


def as_of_invalidated(spark, d):
    """Nodes down within the projection."""
    n, e = _g(spark, d)
    return as_of_graph(n, e, assumption_rows(spark, d), AS_OF)[0].filter("invalidated").select("id", "node_type")


def hindsight(spark, d):
    """Nodes of the projection that later or undated nodes contradict, supersede or support, by side."""
    n, e = _g(spark, d)
    an = cut(anchors(n, e), "anchors").withColumn("side", horizon(F.col("day"), AS_OF))
    then = an.filter("side = 'then'").select(F.col("id").alias("dst"))
    hits = e.filter(F.col("edge_type").isin("contradicts", "supersedes", "supports")).join(then, "dst", "left_semi").join(an.select(F.col("id").alias("src"), "side"), "src")
    return hits.filter("side != 'then'").groupBy(F.col("dst").alias("id"), "edge_type", "side").agg(F.count("*").alias("n"))


def reconstruct_decisions(spark, d):
    """What each decision stood on, by its own date: nodes within three hops dated up to it, later, or undated; an undated decision stood on nothing datable."""
    n, e = _g(spark, d)
    an = cut(anchors(n, e), "anchors").select("id", "day")
    back = closure.walk_back(n.filter("node_type = 'decision'").select(F.col("id").alias("root")), e, n)
    rows = back.join(an.select(F.col("id").alias("root"), F.col("day").alias("rday")), "root").join(an.select(F.col("id").alias("node"), "day"), "node")
    side = F.when(F.col("day").isNull(), "undated").when(F.col("rday").isNull(), "unplaced").when(F.col("day") <= F.col("rday"), "stood_on").otherwise("later")
    return rows.groupBy("root", side.alias("side")).agg(F.count("*").alias("n"))


def decision_histories(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """starts: (root), decisions. (root, node, hops, relation, through, day, side): what each decision stood on, and what supersedes or contradicts it or anything it
    reached. Ground is filed by the decision's own date as stood_on, later or undated (nothing dated precedes an undated decision); what came for it is later or undated."""
    day = cut(anchors(nodes, edges).select(F.col("id").alias("node"), "day"), "anchors")
    back = cut(closure.walk_back(starts, edges, nodes, depth), "back")
    reached = starts.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("hops")).unionByName(back)
    kinds = nodes.select(F.col("id").alias("through"), (F.col("node_type") == "decision").alias("decides"))
    via = edges.filter(F.col("edge_type").isin(*closure.BACK[True])).select(F.col("src").alias("through"), F.col("dst").alias("node"), "edge_type", "ord").join(kinds, "through").filter(F.col("decides") | F.col("edge_type").isin(*closure.BACK[False]))
    ways = reached.select("root", F.col("node").alias("through"), (F.col("hops") + 1).alias("hops")).join(via, "through")
    first = lambda df: df.groupBy("root", "node").agg(F.min(F.struct("hops", "ord", F.col("edge_type").alias("relation"), "through")).alias("m")).select("root", "node", "m.hops", "m.relation", "m.through")
    ground = first(back.join(ways, ["root", "node", "hops"])).withColumn("after", F.lit(False))
    came = edges.filter(F.col("edge_type").isin("supersedes", "contradicts")).select(F.col("src").alias("node"), F.col("dst").alias("through"), "edge_type", "ord").join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    came = reached.select("root", F.col("node").alias("through"), (F.col("hops") + 1).alias("hops")).join(came, "through").join(reached.select("root", "node"), ["root", "node"], "left_anti")
    rows = ground.unionByName(first(came).withColumn("after", F.lit(True))).join(day, "node").join(day.select(F.col("node").alias("root"), F.col("day").alias("made")), "root")
    side = F.when(F.col("day").isNull(), "undated").when(~F.col("after") & (F.col("day") <= F.col("made")), "stood_on").otherwise("later")
    return rows.select("root", "node", "hops", "relation", "through", "day", side.alias("side"))


def decision_history_rows(spark, d):
    n, e = _g(spark, d)
    return decision_histories(n.filter("node_type = 'decision'").select(F.col("id").alias("root")), n, e).withColumn("day", F.col("day").cast("string"))


N, E, A = O.NODES, O.EDGES, O.ASSUMPTIONS
ANCH = f"""sd AS (SELECT id AS sid, {O.day('retrieved_at')} AS day FROM n WHERE node_type = 'source'),
o AS (SELECT n.id, sd.sid AS source_id, CASE WHEN node_type = 'source' THEN 'self' ELSE 'provenance' END AS via, day FROM n JOIN sd ON sd.sid = CASE WHEN node_type = 'source' THEN n.id ELSE n.source_id END),
f AS (SELECT src AS id, sid AS source_id, edge_type AS via, day, row_number() OVER (PARTITION BY src ORDER BY CASE edge_type WHEN 'derived_from' THEN 0 ELSE 1 END, ord) AS rn FROM e JOIN sd ON sd.sid = e.dst WHERE edge_type IN ('derived_from', 'cites') AND src IN (SELECT id FROM n) AND src NOT IN (SELECT id FROM o)),
b AS (SELECT * FROM o UNION ALL SELECT id, source_id, via, day FROM f WHERE rn = 1 UNION ALL SELECT id, NULL, 'none', NULL FROM n WHERE id NOT IN (SELECT id FROM o) AND id NOT IN (SELECT id FROM f)),
m AS (SELECT dst AS id, b.source_id, 'produces' AS via, b.day, row_number() OVER (PARTITION BY dst ORDER BY b.day, ord) AS rn FROM e JOIN b ON b.id = e.src WHERE edge_type = 'produces' AND b.day IS NOT NULL AND dst IN (SELECT b2.id FROM b b2 JOIN n USING (id) WHERE b2.day IS NULL AND n.node_type = 'entity')),
an AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT id, source_id, via, day FROM m WHERE rn = 1)"""
SIDE = f"CASE WHEN day IS NULL THEN 'undated' WHEN day <= DATE '{AS_OF}' THEN 'then' ELSE 'later' END"
KEPT = f"""kd AS (SELECT id, node_type, build FROM n WHERE id IN (SELECT id FROM an WHERE {SIDE} = 'then')),
kept AS (SELECT id, node_type, 'date' AS kept_by FROM kd UNION ALL SELECT n.id, n.node_type, 'ground' FROM n JOIN (SELECT dst, max(kd.build) AS b FROM e JOIN kd ON kd.id = e.src WHERE edge_type = 'depends_on' GROUP BY dst) g ON g.dst = n.id
  WHERE n.node_type = 'assumption' AND n.build <= g.b AND n.id NOT IN (SELECT id FROM kd))"""
FELL = "fell AS (SELECT dst AS id, min(an.day) AS day FROM e LEFT JOIN an ON an.id = e.src WHERE edge_type = 'contradicts' AND dst IN (SELECT id FROM n WHERE node_type = 'assumption') AND src IN (SELECT id FROM n WHERE node_type = 'evidence') GROUP BY dst)"
ASOFA = f"aa AS (SELECT a.id, CASE WHEN f.day IS NOT NULL THEN 'rejected' WHEN a.superseded_by IN (SELECT id FROM kept) THEN 'superseded' ELSE 'active' END AS status, f.day FROM a LEFT JOIN (SELECT * FROM fell WHERE day <= DATE '{AS_OF}') f ON f.id = a.id WHERE a.id IN (SELECT id FROM kept))"

QUERIES = {
    "anchors": q_anchors, "horizon": q_horizon, "dated_span": dated_span, "earliest_fall": earliest_fall, "as_of_nodes": q_as_of_nodes, "as_of_edges": q_as_of_edges, "as_of_assumptions": q_as_of_assumptions,
    "as_of_invalidated": as_of_invalidated, "hindsight": hindsight, "reconstruct_decisions": reconstruct_decisions, "decision_history_rows": decision_history_rows,
}
SQL = {
    "anchors": O.with_(N, E, ANCH) + "SELECT id, source_id, via, day::VARCHAR AS day FROM an",
    "horizon": O.with_(N, E, ANCH) + f"SELECT node_type, {SIDE} AS side, count(*) AS n FROM an JOIN n USING (id) GROUP BY ALL",
    "dated_span": O.with_(N, E, ANCH) + "SELECT min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(day) AS n_dated FROM sd",
    "earliest_fall": O.with_(N, E, ANCH, FELL) + "SELECT id, day::VARCHAR AS day FROM fell",
    "as_of_nodes": O.with_(N, E, ANCH, KEPT) + "SELECT * FROM kept",
    "as_of_edges": O.with_(N, E, ANCH, KEPT) + "SELECT id, src, edge_type, dst FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)",
    "as_of_assumptions": O.with_(N, E, A, ANCH, KEPT, FELL, ASOFA) + "SELECT id, status, day::VARCHAR AS fell FROM aa",
    "as_of_invalidated": O.with_(N, E, A, ANCH, KEPT, FELL, ASOFA, "p AS (SELECT dst AS node, src AS nxt, false AS fw FROM e JOIN n s ON s.id = e.src WHERE s.node_type <> 'assumption' AND edge_type IN ('derived_from', 'depends_on') AND src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) UNION SELECT src, dst, true FROM e WHERE edge_type = 'produces' AND src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept))",
        "r(root, node) AS (SELECT id, id FROM aa WHERE status = 'rejected' UNION SELECT root, nxt FROM r JOIN p ON p.node = r.node WHERE NOT (fw AND r.node = root))", recursive=True) + "SELECT id, node_type FROM n WHERE id IN (SELECT node FROM r)",
    "hindsight": O.with_(N, E, ANCH, f"s AS (SELECT id, {SIDE} AS side FROM an)") + "SELECT e.dst AS id, edge_type, b.side, count(*) AS n FROM e JOIN s a ON a.id = e.dst JOIN s b ON b.id = e.src WHERE edge_type IN ('contradicts', 'supersedes', 'supports') AND a.side = 'then' AND b.side <> 'then' GROUP BY ALL",
    "decision_history_rows": O.with_(N, E, ANCH, f"bk AS (SELECT src AS node, dst, edge_type, e.ord AS ord FROM e JOIN n ON n.id = e.src WHERE dst IN (SELECT id FROM n) AND edge_type IN {closure.BACK[True]} AND (node_type = 'decision' OR edge_type IN {closure.BACK[False]}))",
        "w(root, node, hops) AS (SELECT id, id, 0 FROM n WHERE node_type = 'decision' UNION SELECT w.root, bk.dst, hops + 1 FROM w JOIN bk ON bk.node = w.node WHERE hops < 3)", "wb AS (SELECT root, node, min(hops) AS hops FROM w GROUP BY root, node)",
        "g AS (SELECT b.root, b.node, b.hops, edge_type AS relation, t.node AS through, row_number() OVER (PARTITION BY b.root, b.node ORDER BY ord, edge_type, t.node) AS r FROM wb b JOIN wb t ON t.root = b.root AND t.hops = b.hops - 1 JOIN bk ON bk.node = t.node AND bk.dst = b.node)",
        "c AS (SELECT t.root, e.src AS node, t.hops + 1 AS hops, edge_type AS relation, t.node AS through, row_number() OVER (PARTITION BY t.root, e.src ORDER BY t.hops, ord, edge_type, t.node) AS r FROM wb t JOIN e ON e.dst = t.node WHERE edge_type IN ('supersedes', 'contradicts') AND e.src IN (SELECT id FROM n) AND NOT EXISTS (SELECT 1 FROM wb x WHERE x.root = t.root AND x.node = e.src))",
        "a2 AS (SELECT *, false AS came FROM g WHERE r = 1 UNION ALL SELECT *, true FROM c WHERE r = 1)", recursive=True)
    + "SELECT root, a2.node, hops::BIGINT AS hops, relation, through, x.day::VARCHAR AS day, CASE WHEN x.day IS NULL THEN 'undated' WHEN NOT came AND coalesce(x.day <= o.day, false) THEN 'stood_on' ELSE 'later' END AS side FROM a2 JOIN an x ON x.id = a2.node JOIN an o ON o.id = root",
    "reconstruct_decisions": O.with_(N, E, ANCH, f"bk AS (SELECT DISTINCT src AS node, dst FROM e JOIN n ON n.id = e.src WHERE dst IN (SELECT id FROM n) AND edge_type IN {closure.BACK[True]} AND (node_type = 'decision' OR edge_type IN {closure.BACK[False]}))",
        "w(root, node, hops) AS (SELECT id, id, 0 FROM n WHERE node_type = 'decision' UNION SELECT w.root, bk.dst, hops + 1 FROM w JOIN bk ON bk.node = w.node WHERE hops < 3)", "wb AS (SELECT root, node FROM w GROUP BY root, node HAVING min(hops) > 0)", recursive=True)
    + "SELECT root, CASE WHEN x.day IS NULL THEN 'undated' WHEN r.day IS NULL THEN 'unplaced' WHEN x.day <= r.day THEN 'stood_on' ELSE 'later' END AS side, count(*) AS n FROM wb JOIN an r ON r.id = wb.root JOIN an x ON x.id = wb.node GROUP BY ALL",
}
