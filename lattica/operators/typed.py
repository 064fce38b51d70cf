"""The typed graph: scans, liveness, legality, adjacency, degrees, counts and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.schema import ASSERTING, COST, EDGE_TYPES, FOLLOWED, LEGAL, MUST_ATTRS, NODE_TYPES, REVERSED, STATUSES
from lattica.sources.graph import assumption_rows, edge_rows, node_rows
from lattica.session import table


def legal(edge_type: str | Column, st: str | Column, dt: str | Column) -> Column:
    """Whether the ontology allows an edge of this type between nodes of these types; a literal test, so no join."""
    pairs = [f"{t}|{s}|{d}" for t, p in LEGAL.items() for s, d in p]
    return F.concat_ws("|", edge_type, st, dt).isin(*pairs)


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the types and liveness of both ends (null where there is no such node)."""
    s = nodes.select(F.col("id").alias("src"), F.col("node_type").alias("st"), F.col("live").alias("slive"))
    d = nodes.select(F.col("id").alias("dst"), F.col("node_type").alias("dt"), F.col("live").alias("dlive"))
    return edges.join(s, "src", "left").join(d, "dst", "left")


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out edges of each id, dead ones too."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def zero_filled(spark, counts: DataFrame, key: str, types: tuple[str, ...], *values: str) -> DataFrame:
    every = spark.createDataFrame([(t,) for t in types], f"{key} string")
    return every.join(counts, key, "left").select(key, *(F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in values))


def nodes_by_type(spark, d):
    n = node_rows(spark, d).groupBy("node_type").agg(F.count("*").alias("total"), F.count_if("live").alias("live_nodes"))
    return zero_filled(spark, n, "node_type", NODE_TYPES, "total", "live_nodes")


def edges_by_type(spark, d):
    return zero_filled(spark, edge_rows(spark, d).filter("live").groupBy("edge_type").agg(F.count("*").alias("n")), "edge_type", EDGE_TYPES, "n")


def untyped_edges(spark, d):
    return edge_rows(spark, d).agg(F.count_if(~F.col("edge_type").isin(*EDGE_TYPES)).alias("n"))


def edge_observations(spark, d):
    """Every delivered row as an observation: how often a relationship was seen, and its weight summed over them."""
    from lattica.operators.hierarchy import folded

    raw = table(spark, d, "edges").filter("src is not null and dst is not null")
    return raw.groupBy("src", folded("edge_type").alias("edge_type"), "dst").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


def illegal_edges(spark, d):
    e = with_ends(edge_rows(spark, d), node_rows(spark, d))
    return e.filter(F.col("st").isNull() | F.col("dt").isNull() | ~legal("edge_type", "st", "dt")).select("id", "src", "edge_type", "dst", F.when(F.col("st").isNull() | F.col("dt").isNull(), "dangling").otherwise("illegal").alias("why"))


def self_edges(spark, d):
    return edge_rows(spark, d).filter("src = dst").select("id", "src")


def must_carry_violations(spark, d):
    """Nodes that lack what their type must carry: keys of attrs by presence, columns by not being null."""
    raw = table(spark, d, "nodes").select("id", F.col("prov").isNotNull().alias("has_prov")).groupBy("id").agg(F.max("has_prov").alias("has_prov"))
    n = node_rows(spark, d).join(raw, "id", "left")
    keys = F.json_object_keys("attrs")
    missing = [F.when((F.col("node_type") == t) & ~F.coalesce(F.array_contains(keys, k), F.lit(False)), k) for t, ks in MUST_ATTRS.items() for k in ks]
    missing += [F.when((F.col("node_type") == "source") & F.col("retrieved_at").isNull(), "retrieved_at"), F.when((F.col("node_type") == "decision") & F.col("rationale").isNull(), "rationale"), F.when(F.col("node_type").isin("claim", "decision") & ~F.coalesce("has_prov", F.lit(False)), "provenance")]
    return n.select("id", "node_type", F.explode(F.array_compact(F.array(*missing))).alias("lacks"))


def live_out_edges(spark, d):
    e = with_ends(edge_rows(spark, d), node_rows(spark, d))
    return e.filter("live and dlive").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("edge_type").alias("n_types"))


def live_in_edges(spark, d):
    e = with_ends(edge_rows(spark, d), node_rows(spark, d))
    return e.filter("live and slive").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("edge_type").alias("n_types"))


def node_inspect(spark, d):
    """Every node with its degree and the counts of its edges both ways, dead ones too; node_edges has the edges."""
    n, e = node_rows(spark, d), edge_rows(spark, d)
    deg = degrees(e)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.min("ord").alias("first_out"))
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"), F.min("ord").alias("first_in"))
    zero = F.lit(0).cast("long")
    return n.select("id", "node_type", "label", "live").join(deg, "id", "left").join(out, "id", "left").join(into, "id", "left").select(
        "id", "node_type", "label", "live", F.coalesce("degree", zero).alias("degree"), F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"), "first_out", "first_in")


def edge_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, side, ord, edge, edge_type, other, other_label, live): every node's edges both ways, dead ones too, one row each; ord orders a side."""
    row = lambda own, other, side: edges.select(F.col(own).alias("id"), F.lit(side).alias("side"), "ord", F.col("id").alias("edge"), "edge_type", F.col(other).alias("other"), "live")
    rows = row("src", "dst", "out").unionByName(row("dst", "src", "in")).join(nodes.select("id"), "id", "left_semi")
    return rows.join(nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other", "left").select("id", "side", "ord", "edge", "edge_type", "other", "other_label", "live")


def node_edges(spark, d):
    return edge_lists(node_rows(spark, d), edge_rows(spark, d))


def evidence_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, side, ord, edge, other): what justifies each node; live targets of derived_from, cites, justified_by (side 0), then live sources of supports (side 1), by ord."""
    e = with_ends(edges.filter("live"), nodes)
    out = e.filter(F.col("edge_type").isin("derived_from", "cites", "justified_by") & F.col("dlive")).select(F.col("src").alias("id"), F.lit(0).alias("side"), "ord", F.col("id").alias("edge"), F.col("dst").alias("other"))
    into = e.filter((F.col("edge_type") == "supports") & F.col("slive")).select(F.col("dst").alias("id"), F.lit(1).alias("side"), "ord", F.col("id").alias("edge"), F.col("src").alias("other"))
    return out.unionByName(into)


def evidence_rows(spark, d):
    return evidence_lists(node_rows(spark, d), edge_rows(spark, d))


def shown_edges(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """shown: (idx, id). (src, edge_type, dst, weight): live edges between displayed nodes, ends by their numbers, weight to two places."""
    end = lambda c: shown.select(F.col("id").alias(c), F.col("idx").alias(f"{c}_idx"))
    e = edges.filter("live").join(end("src"), "src").join(end("dst"), "dst")
    return e.select(F.col("src_idx").alias("src"), "edge_type", F.col("dst_idx").alias("dst"), F.round("weight", 2).alias("weight"))


def displayed_edges(spark, d):
    return shown_edges(display_projection(spark, d).select("idx", "id"), edge_rows(spark, d))


def degree(spark, d):
    return degrees(edge_rows(spark, d))


def orphans(spark, d):
    return node_rows(spark, d).filter("live").join(degrees(edge_rows(spark, d)), "id", "left_anti").select("id", "node_type")


def prune_build(spark, d):
    """What the build-time prune drops: nodes without an edge that are no sources."""
    return node_rows(spark, d).filter("node_type != 'source'").join(degrees(edge_rows(spark, d)), "id", "left_anti").select("id")


def prune_walked(spark, d):
    """What the walk-driven prune drops: live nodes never walked with at most one edge; sources, assumptions and evidence stay."""
    n = node_rows(spark, d).filter("live and walks < 1").filter(~F.col("node_type").isin("source", "assumption", "evidence"))
    return n.join(degrees(edge_rows(spark, d)), "id", "left").filter(F.coalesce("degree", F.lit(0)) <= 1).select("id", "node_type")


def step_costs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The steps a walk may take, (node, nxt, edge_type, reverse, cost, exp): live edges forward over FOLLOWED, then against
    REVERSED into nodes that assert something. exp orders a node's steps: forward by insertion, then backward by insertion."""
    e = with_ends(edges.filter("live"), nodes)
    base = F.create_map(*[F.lit(x) for kv in COST.items() for x in kv])
    fwd = e.filter(F.col("edge_type").isin(*FOLLOWED) & F.col("dlive")).select(F.col("src").alias("node"), F.col("dst").alias("nxt"), "edge_type", F.lit(False).alias("reverse"), "weight", F.struct(F.lit(0).alias("side"), F.col("ord")).alias("exp"), F.col("id").alias("edge_id"))
    bwd = e.filter(F.col("edge_type").isin(*REVERSED) & F.col("st").isin(*ASSERTING) & F.col("slive")).select(F.col("dst").alias("node"), F.col("src").alias("nxt"), "edge_type", F.lit(True).alias("reverse"), "weight", F.struct(F.lit(1).alias("side"), F.col("ord")).alias("exp"), F.col("id").alias("edge_id"))
    steps = fwd.unionByName(bwd).join(degrees(edges).select(F.col("id").alias("nxt"), "degree"), "nxt", "left")
    cost = F.coalesce(base[F.col("edge_type")], F.lit(1.0)) * (1 + F.log2(1.0 + F.coalesce("degree", F.lit(0))) / 6.0) / F.pow(F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1.0)), F.lit(0.25))
    return steps.select("node", "nxt", "edge_type", "reverse", cost.alias("cost"), "exp", "edge_id")


def expand(spark, d):
    s = step_costs(edge_rows(spark, d), node_rows(spark, d))
    return s.groupBy("node", "reverse").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


def step_cost(spark, d):
    s = step_costs(edge_rows(spark, d), node_rows(spark, d))
    return s.select("node", "nxt", "edge_type", "reverse", F.round("cost", 6).alias("cost"))


def evidence_list(spark, d):
    """How many nodes justify each node: live targets of derived_from, cites, justified_by and live sources of supports."""
    e = with_ends(edge_rows(spark, d).filter("live"), node_rows(spark, d))
    out = e.filter(F.col("edge_type").isin("derived_from", "cites", "justified_by") & F.col("dlive")).select(F.col("src").alias("id"), F.col("dst").alias("x"))
    into = e.filter((F.col("edge_type") == "supports") & F.col("slive")).select(F.col("dst").alias("id"), F.col("src").alias("x"))
    return out.unionByName(into).groupBy("id").agg(F.count("*").alias("n"), F.min("x").alias("first_id"), F.max("x").alias("last_id"))


def display_projection(spark, d):
    """The nodes a display shows, densely numbered, with label and displayed degree. The number is assigned by a range-partitioned
    sort: positions within a partition plus the counts of those before it, so no task sees all rows."""
    n = node_rows(spark, d).filter("live").filter(F.col("node_type").isin("entity", "claim", "source", "decision"))
    idx = dense_index(n.select("id", "ord", "node_type", "label"), "ord", "id")
    e = edge_rows(spark, d).filter("live")
    keep = n.select("id")
    shown = e.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return idx.join(degrees(shown), "id", "left").select("idx", "id", "node_type", F.substring("label", 1, 90).alias("label"), F.coalesce("degree", F.lit(0).cast("long")).alias("shown_degree"))


def dense_index(rows: DataFrame, *order: str) -> DataFrame:
    """Adds idx, 0-based, in the given order, without a global window."""
    from pyspark.sql import Window

    from lattica.session import cut

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_p").orderBy(*order)
    return parts.join(before.select("_p", "_b"), "_p").withColumn("idx", F.row_number().over(w) - 1 + F.col("_b")).drop("_p", "_b")


# ── integrity: each check gives its violations ────────────────────────────


def snapshot_checks(spark, d):
    """All integrity checks of a stored graph over the delivered rows, violations counted by check."""
    raw_n, raw_e, raw_a = (table(spark, d, t) for t in ("nodes", "edges", "assumptions"))
    n, e, a = node_rows(spark, d), edge_rows(spark, d), assumption_rows(spark, d)
    ends = with_ends(e, n)
    node_ids = n.select("id", "node_type")
    older = a.filter("supersedes is not null").select(F.col("id"), F.col("supersedes").alias("other"))
    newer = a.filter("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.col("id").alias("other"))
    cited = raw_e.select("id", F.explode("evidence_ids").alias("x")).filter("x is not null").distinct()
    bound = e.filter("assumption_id is not null and live").join(a.select(F.col("id").alias("assumption_id"), "status"), "assumption_id", "left")

    def n_of(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")

    checks = [
        n_of("duplicate_node_id", raw_n.groupBy("id").count().filter("count > 1")),
        n_of("duplicate_edge_id", raw_e.groupBy("id").count().filter("count > 1")),
        n_of("duplicate_assumption_id", raw_a.groupBy("id").count().filter("count > 1")),
        n_of("edge_without_source", ends.filter("st is null")),
        n_of("edge_without_target", ends.filter("dt is null")),
        n_of("edge_illegal", ends.filter(F.col("st").isNotNull() & F.col("dt").isNotNull() & ~legal("edge_type", "st", "dt"))),
        n_of("edge_to_itself", e.filter("src = dst")),
        n_of("node_type_unknown", n.filter(~F.col("node_type").isin(*NODE_TYPES))),
        n_of("assumption_without_node", a.join(node_ids.filter("node_type = 'assumption'"), "id", "left_anti")),
        n_of("assumption_label_differs", a.join(n.select("id", "label"), "id").filter(~F.col("label").eqNullSafe(F.col("statement")))),
        n_of("assumption_status_unknown", a.filter(~F.col("status").isin(*STATUSES))),
        n_of("supersession_dangling", older.join(a.select(F.col("id").alias("other")), "other", "left_anti")),
        n_of("supersession_one_sided", older.join(newer, ["id", "other"], "left_anti").unionByName(newer.join(older, ["id", "other"], "left_anti"))),
        n_of("evidence_dangling", cited.join(node_ids.select(F.col("id").alias("x")), "x", "left_anti")),
        n_of("binding_dangling", bound.filter("status is null")),
        n_of("binding_rejected_but_live", bound.filter("status = 'rejected'")),
    ]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out


N, E, A = O.NODES, O.EDGES, O.ASSUMPTIONS
ENDS = "x AS (SELECT e.*, s.node_type AS st, s.live AS slive, d.node_type AS dt, d.live AS dlive FROM e LEFT JOIN n s ON s.id = e.src LEFT JOIN n d ON d.id = e.dst)"
_COSTS = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in COST.items()) + " ELSE 1.0 END"
STEPS = f"""
st0 AS (SELECT src AS node, dst AS nxt, edge_type, false AS reverse, weight, 0 AS side, ord FROM x WHERE live AND dlive AND edge_type IN {FOLLOWED}
        UNION ALL SELECT dst, src, edge_type, true, weight, 1, ord FROM x WHERE live AND slive AND st IN {ASSERTING} AND edge_type IN {REVERSED}),
steps AS (SELECT node, nxt, edge_type, reverse, side, ord, {_COSTS} * (1 + log2(1.0 + coalesce(degree, 0)) / 6.0) / pow(greatest(coalesce(weight, 1.0), 1.0), 0.25) AS cost FROM st0 LEFT JOIN deg ON deg.id = st0.nxt)"""
_KEY = "list_contains(json_keys(n.attrs), '{1}')"

QUERIES = {f.__name__: f for f in (
    nodes_by_type, edges_by_type, untyped_edges, edge_observations, illegal_edges, self_edges, must_carry_violations, live_out_edges, live_in_edges, node_inspect, degree, orphans, prune_build, prune_walked,
    step_cost, expand, evidence_list, display_projection, snapshot_checks, node_edges, evidence_rows, displayed_edges,
)}
SQL = {
    "nodes_by_type": O.with_(N) + f"SELECT t AS node_type, count(n.id) AS total, count(n.id) FILTER (WHERE live) AS live_nodes FROM {O.NODE_TYPE_ROWS} LEFT JOIN n ON n.node_type = t GROUP BY t",
    "edges_by_type": O.with_(E) + f"SELECT t AS edge_type, count(e.id) AS n FROM {O.EDGE_TYPE_ROWS} LEFT JOIN e ON e.edge_type = t AND e.live GROUP BY t",
    "untyped_edges": O.with_(E) + f"SELECT count(*) FILTER (WHERE edge_type NOT IN {EDGE_TYPES}) AS n FROM e",
    "edge_observations": f"SELECT src, {O.FOLD.format('edge_type')} AS edge_type, dst, count(*) AS n, round(sum(weight), 6) AS weight FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL",
    "illegal_edges": O.with_(N, E, ENDS) + f"SELECT id, src, x.edge_type, dst, CASE WHEN x.st IS NULL OR x.dt IS NULL THEN 'dangling' ELSE 'illegal' END AS why FROM x LEFT JOIN {O.LEGAL_ROWS} ON v.edge_type = x.edge_type AND v.st = x.st AND v.dt = x.dt WHERE v.st IS NULL",
    "self_edges": O.with_(E) + "SELECT id, src FROM e WHERE src = dst",
    "must_carry_violations": O.with_(N, "p AS (SELECT id, bool_or(prov IS NOT NULL) AS has FROM nodes GROUP BY id)") + "SELECT n.id, node_type, unnest(list_filter(["
    + ", ".join(f"CASE WHEN node_type = '{t}' AND NOT coalesce({_KEY.format('', k)}, false) THEN '{k}' END" for t, ks in MUST_ATTRS.items() for k in ks)
    + ", CASE WHEN node_type = 'source' AND retrieved_at IS NULL THEN 'retrieved_at' END, CASE WHEN node_type = 'decision' AND rationale IS NULL THEN 'rationale' END, CASE WHEN node_type IN ('claim', 'decision') AND NOT coalesce(has, false) THEN 'provenance' END], lambda z: z IS NOT NULL)) AS lacks FROM n LEFT JOIN p ON p.id = n.id",
    "live_out_edges": O.with_(N, E, ENDS) + "SELECT src AS id, count(*) AS n, count(DISTINCT edge_type) AS n_types FROM x WHERE live AND dlive GROUP BY src",
    "live_in_edges": O.with_(N, E, ENDS) + "SELECT dst AS id, count(*) AS n, count(DISTINCT edge_type) AS n_types FROM x WHERE live AND slive GROUP BY dst",
    "node_inspect": O.with_(N, E, O.DEGREE) + "SELECT n.id, node_type, label, live, coalesce(degree, 0) AS degree, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, o.f AS first_out, i.f AS first_in FROM n LEFT JOIN deg ON deg.id = n.id LEFT JOIN (SELECT src, count(*) AS n, min(ord) AS f FROM e GROUP BY src) o ON o.src = n.id LEFT JOIN (SELECT dst, count(*) AS n, min(ord) AS f FROM e GROUP BY dst) i ON i.dst = n.id",
    "node_edges": O.with_(N, E, "r AS (SELECT src AS id, 'out' AS side, ord, id AS edge, edge_type, dst AS other, live FROM e UNION ALL SELECT dst, 'in', ord, id, edge_type, src, live FROM e)") + "SELECT r.id, side, r.ord, edge, edge_type, other, o.label AS other_label, r.live FROM r JOIN n ON n.id = r.id LEFT JOIN n o ON o.id = r.other",
    "evidence_rows": O.with_(N, E, ENDS) + "SELECT src AS id, 0 AS side, ord, id AS edge, dst AS other FROM x WHERE live AND dlive AND edge_type IN ('derived_from', 'cites', 'justified_by') UNION ALL SELECT dst, 1, ord, id, src FROM x WHERE live AND slive AND edge_type = 'supports'",
    "displayed_edges": O.with_(N, E, "k AS (SELECT *, row_number() OVER (ORDER BY ord, id) - 1 AS idx FROM n WHERE live AND node_type IN ('entity', 'claim', 'source', 'decision'))") + "SELECT a.idx AS src, edge_type, b.idx AS dst, round(weight, 2) AS weight FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst WHERE e.live",
    "degree": O.with_(E, O.DEGREE) + "SELECT id, degree FROM deg",
    "orphans": O.with_(N, E, O.DEGREE) + "SELECT id, node_type FROM n WHERE live AND id NOT IN (SELECT id FROM deg)",
    "prune_build": O.with_(N, E, O.DEGREE) + "SELECT id FROM n WHERE node_type <> 'source' AND id NOT IN (SELECT id FROM deg)",
    "prune_walked": O.with_(N, E, O.DEGREE) + "SELECT n.id, node_type FROM n LEFT JOIN deg ON deg.id = n.id WHERE live AND walks < 1 AND node_type NOT IN ('source', 'assumption', 'evidence') AND coalesce(degree, 0) <= 1",
    "step_cost": O.with_(N, E, O.DEGREE, ENDS, STEPS) + "SELECT node, nxt, edge_type, reverse, round(cost, 6) AS cost FROM steps",
    "expand": O.with_(N, E, O.DEGREE, ENDS, STEPS) + "SELECT node, reverse, count(*) AS n, round(sum(cost), 4) AS cost FROM steps GROUP BY node, reverse",
    "evidence_list": O.with_(N, E, ENDS) + "SELECT id, count(*) AS n, min(x) AS first_id, max(x) AS last_id FROM (SELECT src AS id, dst AS x FROM x WHERE live AND dlive AND edge_type IN ('derived_from', 'cites', 'justified_by') UNION ALL SELECT dst, src FROM x WHERE live AND slive AND edge_type = 'supports') GROUP BY id",
    "display_projection": O.with_(N, E, "k AS (SELECT *, row_number() OVER (ORDER BY ord, id) - 1 AS idx FROM n WHERE live AND node_type IN ('entity', 'claim', 'source', 'decision'))", "s AS (SELECT unnest([src, dst]) AS id FROM e WHERE live AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))", "sd AS (SELECT id, count(*) AS c FROM s GROUP BY id)")
    + "SELECT idx, k.id, node_type, substring(label, 1, 90) AS label, coalesce(c, 0) AS shown_degree FROM k LEFT JOIN sd ON sd.id = k.id",
    "snapshot_checks": O.with_(N, E, A, ENDS, "older AS (SELECT id, supersedes AS other FROM a WHERE supersedes IS NOT NULL)", "newer AS (SELECT superseded_by AS id, id AS other FROM a WHERE superseded_by IS NOT NULL)",
        "cited AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(evidence_ids) AS x FROM edges) WHERE x IS NOT NULL)", "bound AS (SELECT e.id, a.status FROM e LEFT JOIN a ON a.id = e.assumption_id WHERE e.assumption_id IS NOT NULL AND e.live)")
    + "\nUNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) AS n FROM ({q})" for k, q in {
        "duplicate_node_id": "SELECT id FROM nodes GROUP BY id HAVING count(*) > 1", "duplicate_edge_id": "SELECT id FROM edges GROUP BY id HAVING count(*) > 1", "duplicate_assumption_id": "SELECT id FROM assumptions GROUP BY id HAVING count(*) > 1",
        "edge_without_source": "SELECT 1 FROM x WHERE st IS NULL", "edge_without_target": "SELECT 1 FROM x WHERE dt IS NULL", "edge_illegal": f"SELECT 1 FROM x LEFT JOIN {O.LEGAL_ROWS} ON v.edge_type = x.edge_type AND v.st = x.st AND v.dt = x.dt WHERE v.st IS NULL AND x.st IS NOT NULL AND x.dt IS NOT NULL",
        "edge_to_itself": "SELECT 1 FROM e WHERE src = dst", "node_type_unknown": f"SELECT 1 FROM n WHERE node_type NOT IN {NODE_TYPES}", "assumption_without_node": "SELECT 1 FROM a WHERE id NOT IN (SELECT id FROM n WHERE node_type = 'assumption')",
        "assumption_label_differs": "SELECT 1 FROM a JOIN n ON n.id = a.id WHERE label IS DISTINCT FROM statement", "assumption_status_unknown": f"SELECT 1 FROM a WHERE status NOT IN {STATUSES}",
        "supersession_dangling": "SELECT 1 FROM older WHERE other NOT IN (SELECT id FROM a)", "supersession_one_sided": "(SELECT * FROM older EXCEPT SELECT * FROM newer) UNION ALL (SELECT * FROM newer EXCEPT SELECT * FROM older)",
        "evidence_dangling": "SELECT 1 FROM cited WHERE x NOT IN (SELECT id FROM n)", "binding_dangling": "SELECT 1 FROM bound WHERE status IS NULL", "binding_rejected_but_live": "SELECT 1 FROM bound WHERE status = 'rejected'"}.items()),
}
