"""Invalidation closures, lineage, walk-back and task scheduling over the graph.

The blast radius of assumptions is a level loop: the frontier of all roots together is joined with the propagation edges, nodes already reached are
taken out by an anti-join, and the level is written to the shared folder. Rounds equal the depth of the deepest closure, whatever the number of roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.operators import typed
from lattica.operators.hierarchy import decision_links, forest, layers, task_key, task_needs
from lattica.schema import BACKWARD, FORWARD
from lattica.session import cut, table
from lattica.sources.graph import assumption_rows, edge_rows, node_rows


def propagation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, nxt, via): who falls with a node. Against backward edges to anyone but assumptions, along forward edges; live edges and live far ends only."""
    e = typed.with_ends(edges.filter("live"), nodes)
    back = e.filter(F.col("edge_type").isin(*BACKWARD) & F.col("slive") & (F.col("st") != "assumption")).select(F.col("dst").alias("node"), F.col("src").alias("nxt"), F.concat(F.lit("<-"), "edge_type", F.lit("-")).alias("via"), F.lit(False).alias("forward"), "ord")
    ahead = e.filter(F.col("edge_type").isin(*FORWARD) & F.col("dlive")).select(F.col("src").alias("node"), F.col("dst").alias("nxt"), F.concat(F.lit("-"), "edge_type", F.lit("->")).alias("via"), F.lit(True).alias("forward"), "ord")
    return back.unionByName(ahead)


def blast_radius(roots: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """roots: (root). (root, node, depth, chain): every node that falls with a root, at its fewest steps; chain is one shortest chain of ids and edges,
    the least by (edge order, id) where several are as short."""
    steps = cut(propagation(edges, nodes), "steps")
    seen = front = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth"), F.array("root").alias("chain")), "front")
    while True:
        new = front.join(steps, "node").filter(~(F.col("forward") & (F.col("node") == F.col("root")))).filter("nxt != root")
        new = new.groupBy("root", "nxt").agg(F.min(F.struct("ord", F.concat("chain", F.array("via", "nxt")).alias("chain"))).alias("m"), F.min("depth").alias("depth"))
        new = new.select("root", F.col("nxt").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("m.chain").alias("chain"))
        front = cut(new.join(seen.select("root", "node"), ["root", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def _standing(spark, d) -> DataFrame:
    """Live assumption nodes, as roots."""
    return node_rows(spark, d).filter("node_type = 'assumption' and live").select(F.col("id").alias("root"))


def blast_radius_all(spark, d):
    r = blast_radius(_standing(spark, d), edge_rows(spark, d), node_rows(spark, d))
    return r.select("root", "node", "depth", F.size("chain").alias("chain_length").cast("long"))


def blast_radius_size(spark, d):
    """How much falls with each assumption, and how much of the live graph is preserved."""
    n = node_rows(spark, d)
    live = n.filter("live").count()
    r = blast_radius(_standing(spark, d), edge_rows(spark, d), n).groupBy("root").agg(F.count("*").alias("radius"), F.max("depth").alias("depth"))
    zero = F.lit(0).cast("long")
    return _standing(spark, d).join(r, "root", "left").select("root", F.coalesce("radius", zero).alias("radius"), F.coalesce("depth", zero).alias("depth"), (F.lit(live) - 1 - F.coalesce("radius", zero)).alias("preserved"))


def _widest(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(root, radius rows, edges) of the live assumption with the most depends_on edges."""
    n, e = node_rows(spark, d), edge_rows(spark, d)
    top = e.filter("live and edge_type = 'depends_on'").join(_standing(spark, d).withColumnRenamed("root", "dst"), "dst", "left_semi").groupBy("dst").count().orderBy(F.desc("count"), "dst").limit(1).select(F.col("dst").alias("root"))
    top = cut(top, "root")
    return top, blast_radius(top, e, n), e


def preserved(spark, d):
    top, r, _ = _widest(spark, d)
    n = node_rows(spark, d).filter("live").select("id", "node_type")
    fallen = r.select(F.col("node").alias("id")).unionByName(top.select(F.col("root").alias("id")))
    return n.join(fallen, "id", "left_anti")


def invalidated_edges(spark, d):
    """Edges that fall with the widest assumption: bound to it, or with both ends fallen."""
    top, r, e = _widest(spark, d)
    fallen = r.select(F.col("node").alias("x"))
    inside = e.filter("live").join(fallen.withColumnRenamed("x", "src"), "src", "left_semi").join(fallen.withColumnRenamed("x", "dst"), "dst", "left_semi")
    bound = e.filter("live").join(top.withColumnRenamed("root", "assumption_id"), "assumption_id", "left_semi")
    cols = ["id", "src", "edge_type", "dst"]
    return inside.select(*cols).unionByName(bound.select(*cols)).dropDuplicates(["id"])


def assumption_lineage(spark, d):
    """root and position of each assumption in its chain of supersessions, oldest first."""
    a = assumption_rows(spark, d)
    r = forest(cut(a.select(F.col("id").alias("key"), F.col("supersedes").alias("parent")), "links"))
    return r.select(F.col("key").alias("id"), F.col("root").alias("oldest"), F.col("depth").alias("position"))


def current_decisions(spark, d):
    """Decisions that no other decision supersedes."""
    links = cut(decision_links(table(spark, d, "decision_log")), "links")
    return links.join(links.select(F.col("parent").alias("key")).filter("key is not null"), "key", "left_anti").select("node_id")


def decision_history(spark, d):
    """How many decisions each decision's history has, itself included, and the oldest of them; null where it runs into a cycle."""
    links = cut(decision_links(table(spark, d, "decision_log")), "links")
    r = forest(links)
    return r.select("key", F.when(F.col("depth") >= 0, F.col("depth") + 1).alias("n"), F.when(F.col("depth") >= 0, F.col("root")).alias("oldest"))


def task_layers(spark, d):
    keys, needs = task_needs(table(spark, d, "tasks"))
    return layers(keys, needs, keys.select("key", F.col("plan").alias("g"))).join(keys, "key").select("node_id", "layer")


def ready_tasks(spark, d):
    """Pending or stale tasks whose ground stands and whose needs are all done."""
    t = table(spark, d, "tasks").filter("plan is not null and task_name is not null")
    rows = t.groupBy(task_key("plan", F.col("task_name")).alias("key")).agg(F.max(F.struct("loaded_at", "attempt", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"), "plan", "task_name", "state", "assumes")).alias("r")).select("key", "r.*")
    _, needs = task_needs(table(spark, d, "tasks"))
    open_ = needs.join(rows.filter("state != 'done'").select(F.col("key").alias("parent")), "parent", "left_semi").select("key")
    fallen = assumption_rows(spark, d).filter("status != 'active'").select(F.col("id").alias("assumes"))
    ready = rows.filter("state in ('pending', 'stale')").join(open_, "key", "left_anti").join(fallen, "assumes", "left_anti")
    return ready.select(F.concat("plan", F.lit("/"), "task_name").alias("node_id"), "state")


BACK = {True: ("depends_on", "derived_from", "cites", "justified_by"), False: ("derived_from", "cites", "justified_by")}


def walk_back(starts: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 3) -> DataFrame:
    """starts: (root), decisions. (root, node, hops): everything a decision stood on within depth hops; decisions are followed through
    more kinds of edges than other nodes. Liveness doesn't matter: it is about the past."""
    e = edges.filter(F.col("edge_type").isin(*BACK[True])).join(nodes.select(F.col("id").alias("src"), F.col("node_type").alias("st")), "src")
    e = e.filter((F.col("st") == "decision") | F.col("edge_type").isin(*BACK[False])).select(F.col("src").alias("node"), "dst").distinct()
    e = cut(e.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), "back")
    seen = front = starts.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("hops"))
    for hop in range(1, depth + 1):
        new = front.join(e, "node").select("root", F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long")), "back")
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def decision_walk_back(spark, d):
    n = node_rows(spark, d)
    return walk_back(n.filter("node_type = 'decision'").select(F.col("id").alias("root")), edge_rows(spark, d), n)


N, E, A = O.NODES, O.EDGES, O.ASSUMPTIONS
_F = O.FOLD.format
PROP = f"""prop AS (SELECT dst AS node, src AS nxt, false AS forward FROM x WHERE live AND edge_type IN {BACKWARD} AND slive AND st <> 'assumption'
  UNION SELECT src, dst, true FROM x WHERE live AND edge_type IN ('{FORWARD[0]}') AND dlive)"""
ROOTS = "roots AS (SELECT id AS root FROM n WHERE node_type = 'assumption' AND live)"
RAD = """r(root, node, depth) AS (SELECT root, root, 0 FROM roots UNION SELECT r.root, p.nxt, r.depth + 1 FROM r JOIN prop p ON p.node = r.node WHERE NOT (p.forward AND r.node = r.root) AND p.nxt <> r.root AND r.depth < 40),
rad AS (SELECT root, node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY root, node)"""
TOP = "roots AS (SELECT dst AS root FROM e WHERE live AND edge_type = 'depends_on' AND dst IN (SELECT id FROM n WHERE node_type = 'assumption' AND live) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
DLINKS = f"""d0 AS (SELECT {_F('decision_id')} AS key, decision_id AS node_id, nullif({_F("coalesce(supersedes, '')")}, '') AS sup, row_number() OVER (PARTITION BY {_F('decision_id')} ORDER BY loaded_at DESC, coalesce(supersedes, '') DESC, decision_id DESC) AS rn FROM decision_log WHERE decision_id IS NOT NULL),
d1 AS (SELECT * FROM d0 WHERE rn = 1), dl AS (SELECT d1.key, d1.node_id, p.key AS parent FROM d1 LEFT JOIN d1 p ON p.key = d1.sup)"""
DWALK = "dw(key, anc, depth) AS (SELECT key, key, 0 FROM dl UNION ALL SELECT dw.key, dl.parent, depth + 1 FROM dw JOIN dl ON dl.key = dw.anc WHERE dl.parent IS NOT NULL AND depth < 300), dm AS (SELECT key, max(depth) AS depth, arg_max(anc, depth) AS root FROM dw GROUP BY key)"
TASKS = f"""t0 AS (SELECT *, plan || '/' || {_F('task_name')} AS key, row_number() OVER (PARTITION BY plan || '/' || {_F('task_name')} ORDER BY loaded_at DESC, attempt DESC) AS rn FROM tasks WHERE plan IS NOT NULL AND task_name IS NOT NULL),
t AS (SELECT key, plan || '/' || task_name AS node_id, plan, needs, state, assumes FROM t0 WHERE rn = 1),
needs AS (SELECT DISTINCT u.key, u.plan || '/' || {_F('need')} AS parent FROM (SELECT key, plan, unnest(needs) AS need FROM t) u WHERE need IS NOT NULL AND u.plan || '/' || {_F('need')} IN (SELECT key FROM t))"""
FOREST_LOOP = "depth >= 300"

QUERIES = {f.__name__: f for f in (blast_radius_all, blast_radius_size, preserved, invalidated_edges, assumption_lineage, current_decisions, decision_history, task_layers, ready_tasks, decision_walk_back)}
SQL = {
    "blast_radius_all": O.with_(N, E, typed.ENDS, PROP, ROOTS, RAD, recursive=True) + "SELECT root, node, depth::BIGINT AS depth, (2 * depth + 1)::BIGINT AS chain_length FROM rad",
    "blast_radius_size": O.with_(N, E, typed.ENDS, PROP, ROOTS, RAD, recursive=True) + "SELECT roots.root, count(node) AS radius, coalesce(max(depth), 0)::BIGINT AS depth, (SELECT count(*) FROM n WHERE live) - 1 - count(node) AS preserved FROM roots LEFT JOIN rad ON rad.root = roots.root GROUP BY roots.root",
    "preserved": O.with_(N, E, typed.ENDS, PROP, TOP, RAD, recursive=True) + "SELECT id, node_type FROM n WHERE live AND id NOT IN (SELECT node FROM rad) AND id NOT IN (SELECT root FROM roots)",
    "invalidated_edges": O.with_(N, E, typed.ENDS, PROP, TOP, RAD, recursive=True) + "SELECT id, src, edge_type, dst FROM e WHERE live AND (assumption_id IN (SELECT root FROM roots) OR (src IN (SELECT node FROM rad) AND dst IN (SELECT node FROM rad)))",
    "assumption_lineage": O.with_(A, "w(id, anc, depth) AS (SELECT id, id, 0 FROM a UNION ALL SELECT w.id, a.supersedes, depth + 1 FROM w JOIN a ON a.id = w.anc WHERE a.supersedes IN (SELECT id FROM a) AND depth < 300)", "m AS (SELECT id, max(depth) AS depth, arg_max(anc, depth) AS oldest FROM w GROUP BY id)", recursive=True)
    + "SELECT id, CASE WHEN depth >= 300 THEN 'cycle' ELSE oldest END AS oldest, CASE WHEN depth >= 300 THEN -1 ELSE depth END::BIGINT AS position FROM m",
    "current_decisions": O.with_(DLINKS) + "SELECT node_id FROM dl WHERE key NOT IN (SELECT parent FROM dl WHERE parent IS NOT NULL)",
    "decision_history": O.with_(DLINKS, DWALK, recursive=True) + "SELECT key, CASE WHEN depth < 300 THEN depth + 1 END::BIGINT AS n, CASE WHEN depth < 300 THEN root END AS oldest FROM dm",
    "task_layers": O.with_(TASKS, "lw(key, anc, depth) AS (SELECT key, key, 0 FROM t UNION SELECT lw.key, needs.parent, depth + 1 FROM lw JOIN needs ON needs.key = lw.anc WHERE depth < 300)", recursive=True) + "SELECT node_id, CASE WHEN max(depth) >= 300 THEN -1 ELSE max(depth) END::BIGINT AS layer FROM lw JOIN t USING (key) GROUP BY node_id",
    "ready_tasks": O.with_(A, TASKS) + "SELECT node_id, state FROM t WHERE state IN ('pending', 'stale') AND key NOT IN (SELECT needs.key FROM needs JOIN t p ON p.key = needs.parent WHERE p.state <> 'done') AND (assumes IS NULL OR assumes NOT IN (SELECT id FROM a WHERE status <> 'active'))",
    "decision_walk_back": O.with_(N, E, f"b AS (SELECT DISTINCT src AS node, dst FROM e JOIN n ON n.id = e.src WHERE dst IN (SELECT id FROM n) AND edge_type IN {BACK[True]} AND (node_type = 'decision' OR edge_type IN {BACK[False]}))",
        "w(root, node, hops) AS (SELECT id, id, 0 FROM n WHERE node_type = 'decision' UNION SELECT w.root, b.dst, hops + 1 FROM w JOIN b ON b.node = w.node WHERE hops < 3)", recursive=True) + "SELECT root, node, min(hops)::BIGINT AS hops FROM w GROUP BY root, node HAVING min(hops) > 0",
    "p4_found": O.with_(DLINKS, DWALK, TASKS, "lw(key, anc, depth) AS (SELECT key, key, 0 FROM t UNION SELECT lw.key, needs.parent, depth + 1 FROM lw JOIN needs ON needs.key = lw.anc WHERE depth < 300)", "lm AS (SELECT key, max(depth) AS m FROM lw GROUP BY key)",
        "br AS (SELECT key, anc, min(depth) AS depth FROM lw WHERE key IN (SELECT key FROM lm WHERE m < 300) AND anc NOT IN (SELECT key FROM needs) GROUP BY key, anc)", recursive=True)
    + """SELECT 'decision' AS hierarchy, dl.node_id, CASE WHEN dm.depth >= 300 THEN 'cycle' ELSE r.node_id END AS root_id, CASE WHEN dm.depth >= 300 THEN -1 ELSE dm.depth END::BIGINT AS depth FROM dl JOIN dm USING (key) LEFT JOIN dl r ON r.key = dm.root
UNION ALL SELECT 'task', t.node_id, r.node_id, br.depth::BIGINT FROM br JOIN t ON t.key = br.key JOIN t r ON r.key = br.anc UNION ALL SELECT 'task', t.node_id, 'cycle', -1 FROM lm JOIN t USING (key) WHERE m >= 300""",
    "p4_nested": O.with_(DLINKS, DWALK, "up AS (SELECT dw.key, string_agg(anc, ' > ' ORDER BY dw.depth DESC) AS path FROM dw JOIN dm USING (key) WHERE dm.depth < 300 GROUP BY dw.key)", "below AS (SELECT anc AS key, count(*) - 1 AS n FROM dw JOIN dm USING (key) WHERE dm.depth < 300 GROUP BY anc)", recursive=True)
    + "SELECT node_id, CASE WHEN dm.depth >= 300 THEN 'cycle' ELSE dm.root END AS root, CASE WHEN dm.depth >= 300 THEN -1 ELSE dm.depth END::BIGINT AS depth, path, below.n AS n_descendants FROM dl JOIN dm USING (key) LEFT JOIN up USING (key) LEFT JOIN below USING (key)",
    "p4_descendants": O.with_(DLINKS, DWALK, recursive=True) + "SELECT dl.node_id, dw.key AS descendant, dw.depth::BIGINT AS steps FROM dw JOIN dm USING (key) JOIN dl ON dl.key = dw.anc WHERE dm.depth < 300 AND dw.depth > 0",
    "p4_task_paths": O.with_(TASKS, "lw(key, anc, depth) AS (SELECT key, key, 0 FROM t UNION SELECT lw.key, needs.parent, depth + 1 FROM lw JOIN needs ON needs.key = lw.anc WHERE depth < 300)", "lm AS (SELECT key, max(depth) AS m FROM lw GROUP BY key)",
        "br AS (SELECT key, anc AS root, min(depth) AS depth FROM lw WHERE key IN (SELECT key FROM lm WHERE m < 300) AND anc NOT IN (SELECT key FROM needs) GROUP BY key, anc)",
        "nx AS (SELECT br.key, br.root, min(p.key) AS parent FROM br JOIN needs ON needs.key = br.key JOIN br p ON p.key = needs.parent AND p.root = br.root AND p.depth = br.depth - 1 GROUP BY br.key, br.root)",
        "pw(key, root, cur, path) AS (SELECT key, root, key, key FROM br UNION ALL SELECT pw.key, pw.root, nx.parent, nx.parent || ' > ' || path FROM pw JOIN nx ON nx.key = pw.cur AND nx.root = pw.root)", recursive=True)
    + "SELECT node_id, br.root, br.depth::BIGINT AS depth, path FROM br JOIN t USING (key) JOIN pw ON pw.key = br.key AND pw.root = br.root AND pw.cur = br.root UNION ALL SELECT node_id, 'cycle', -1, NULL FROM lm JOIN t USING (key) WHERE m >= 300",
    "p4_task_descendants": O.with_(TASKS, "lw(key, anc, depth) AS (SELECT key, key, 0 FROM t UNION SELECT lw.key, needs.parent, depth + 1 FROM lw JOIN needs ON needs.key = lw.anc WHERE depth < 300)", recursive=True) + "SELECT node_id, lw.key AS descendant, min(depth)::BIGINT AS steps FROM lw JOIN t ON t.key = lw.anc WHERE lw.key <> lw.anc GROUP BY ALL",
}
