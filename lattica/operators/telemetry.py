"""Health signals and telemetry aggregates. Medians come from value histograms and last-N series from ordered limits: no list of all rows is ever built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.operators import build, typed
from lattica.schema import DEAD_ENDS, EDGE_TYPES
from lattica.session import table
from lattica.sources.graph import assumption_rows, edge_rows, node_rows

STALE_AFTER = 25
LEDGER_TYPES = ("depends_on", "justified_by", "derived_from", "supersedes")


def walk_log(events: DataFrame) -> DataFrame:
    """Events read as a log of walks: errors are dead ends, the rest resolved; hops, visits and tokens come from the columns."""
    bad = F.col("event_type") == "error"
    reason = F.element_at(F.array(*map(F.lit, DEAD_ENDS)), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("walk_id"), F.when(bad, reason).alias("dead_end"), F.when(~bad, F.pmod(F.floor("value"), F.lit(9)) + 1).alias("hops"),
        (F.pmod("user_id", F.lit(60)) + 1).alias("visited"), F.when(bad, 0).otherwise(40 + F.pmod("event_id", F.lit(50))).alias("tokens_walked"), (7000 + F.pmod("event_id", F.lit(601))).alias("tokens_flat"))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """One row: the upper median of a whole-number column, 0 of none. The running count is over distinct values only."""
    h = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    run = h.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return run.filter(F.col("upto") >= F.floor(F.col("all") / 2) + 1).agg(F.coalesce(F.min("v"), F.lit(0)).cast("long").alias("median"))


def _log(spark, d):
    return walk_log(table(spark, d, "events"))


def hop_histogram(spark, d):
    """Resolved walks by hops, over the bins 1 to 9 (a budget of six and three hops of justification)."""
    bins = spark.range(1, 10).select(F.col("id").alias("hops"))
    return bins.join(_log(spark, d).filter("dead_end is null").groupBy("hops").agg(F.count("*").alias("n")), "hops", "left").select("hops", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def median_hops(spark, d):
    log = _log(spark, d)
    parts = [upper_median(log.filter("dead_end is null"), c).select(F.lit(c).alias("measure"), "median") for c in ("hops", "tokens_walked")] + [upper_median(log, c).select(F.lit(c).alias("measure"), "median") for c in ("visited", "tokens_flat")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def dead_end_ledger(spark, d):
    return typed.zero_filled(spark, _log(spark, d).filter("dead_end is not null").groupBy("dead_end").agg(F.count("*").alias("n")), "dead_end", DEAD_ENDS, "n")


def resolved_rate(spark, d):
    ok = F.col("dead_end").isNull()
    saving = 1 - F.sum(F.when(ok, F.col("tokens_walked"))) / F.nullif(F.sum(F.when(ok, F.col("tokens_flat"))), F.lit(0))
    return _log(spark, d).agg(F.count("*").alias("walks"), F.round(F.avg(ok.cast("double")), 6).alias("resolved"), F.round(F.coalesce(saving, F.lit(0.0)), 6).alias("saving"), F.max("tokens_flat").alias("flat_peak"))


def last_walks(spark, d):
    """The 60 latest walks' tokens, oldest first: an ordered limit, merged from each partition's own 60."""
    return _log(spark, d).orderBy(F.desc("walk_id")).limit(60).select("walk_id", "tokens_walked", "visited")


def last_grid(spark, d):
    """A cell for each of the 1,008 latest walks: 1 resolved, 0 a dead end."""
    return _log(spark, d).orderBy(F.desc("walk_id")).limit(1008).select("walk_id", F.col("dead_end").isNull().cast("int").alias("cell"))


def last_visits(spark, d):
    """Nodes visited by each of the 40 latest walks."""
    return _log(spark, d).orderBy(F.desc("walk_id")).limit(40).select("walk_id", "visited")


def walk_examples(spark, d):
    """The first four answered walks and the first four dead ends: two ordered limits."""
    log = _log(spark, d)
    return log.filter("dead_end is null").orderBy("walk_id").limit(4).unionByName(log.filter("dead_end is not null").orderBy("walk_id").limit(4)).select("walk_id", "dead_end", "hops", "visited", "tokens_walked", "tokens_flat")


def flat_costs_seen(spark, d):
    """What flat retrieval would have cost: the peak, the typical walk and all of them; and what the walks did."""
    log = _log(spark, d)
    total = log.agg(F.max("tokens_flat").alias("flat_peak"), F.sum("tokens_flat").alias("flat_total"), F.sum("tokens_walked").alias("walk_total"))
    typical = lambda c, rows: upper_median(rows, c).select(F.col("median").alias(f"{c}_typical"))
    return total.crossJoin(F.broadcast(typical("tokens_flat", log))).crossJoin(F.broadcast(typical("tokens_walked", log.filter("dead_end is null"))))


def visit_counts(spark, d):
    return node_rows(spark, d).groupBy("node_type").agg(F.sum("walks").alias("walks"), F.max("walks").alias("most"))


def traversal_ledger(spark, d):
    return typed.zero_filled(spark, edge_rows(spark, d).filter(F.col("edge_type").isin(*LEDGER_TYPES)).groupBy("edge_type").agg(F.sum("traversals").alias("n")), "edge_type", LEDGER_TYPES, "n")


def proxy_rates(spark, d):
    """Display proxies derived from counts; they aren't timings: edges by build, the number of walks, and the typical visits times 1.6. One row each is joined."""
    e = edge_rows(spark, d).agg(F.count("*").alias("edges"), F.greatest(F.max("build"), F.lit(1)).alias("build"))
    log = _log(spark, d)
    w = log.agg(F.count("*").alias("walks_per_min")).crossJoin(F.broadcast(upper_median(log, "visited")))
    both = e.crossJoin(F.broadcast(w))
    return both.select(F.greatest(F.lit(1).cast("long"), F.expr("edges div build div 8")).alias("edges_per_tick"), "edges", "build", "walks_per_min", F.greatest(F.lit(1).cast("long"), F.floor(F.col("median") * 1.6)).alias("traversal_ms"))


def health_signals(spark, d):
    """signal, severity, count: the nine signals over the stored graph, zero where there is nothing to report."""
    n, e, a = node_rows(spark, d), edge_rows(spark, d), assumption_rows(spark, d)
    ends = typed.with_ends(e, n)
    names, reg, norms = build._names(spark, d)
    sourced = ends.filter("live and dlive and dt = 'source' and edge_type in ('derived_from', 'cites')").select(F.col("src").alias("id"))
    proven = n.join(n.filter("live and node_type = 'source'").select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id")
    gaps = n.filter("live and node_type in ('claim', 'decision')").select("id").join(sourced, "id", "left_anti").join(proven, "id", "left_anti")
    told = ends.filter("live and slive and edge_type = 'mentions' and st = 'claim'").select(F.col("dst").alias("id"))
    now = n.agg(F.max("build").alias("now"))
    stale = a.filter("status = 'active'").join(F.broadcast(now)).filter(F.col("now") - F.col("created_at_build") > STALE_AFTER)
    signals = [
        ("untyped_edges", "error", e.filter(~F.col("edge_type").isin(*EDGE_TYPES))), ("orphans", "warn", n.filter("live").join(typed.degrees(e), "id", "left_anti")), ("provenance_gap", "error", gaps),
        ("unresolved_entities", "warn", reg.resolve(norms).filter(F.col("entity_id").isNull() & (F.col("score") >= build.BORDERLINE))), ("missing_relationships", "warn", n.filter("live and node_type = 'entity'").join(told, "id", "left_anti")),
        ("stale_assumptions", "warn", stale), ("open_contradictions", "warn", e.filter("live and edge_type = 'contradicts'").select("src").distinct()), ("dead_ends", "warn", _log(spark, d).filter("dead_end is not null")),
        ("invalidated_nodes", "warn", n.filter("invalidated")),
    ]
    out = None
    for kind, severity, rows in signals:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.when(F.col("n") > 0, severity).otherwise("info").alias("severity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def health_status(spark, d):
    rank = F.when((F.col("severity") == "error") & (F.col("n") > 0), 2).when((F.col("severity") == "warn") & (F.col("n") > 0), 1).otherwise(0)
    worst = health_signals(spark, d).agg(F.max(rank).alias("r"), F.count_if(F.col("n") > 0).alias("signals"))
    return worst.select(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("error")), (F.col("r") + 1).cast("int")).alias("status"), "signals")


LOG = f"""lg AS (SELECT event_id AS walk_id, CASE WHEN event_type = 'error' THEN (['{"', '".join(DEAD_ENDS)}'])[user_id % 4 + 1] END AS dead_end, CASE WHEN event_type <> 'error' THEN floor(value)::BIGINT % 9 + 1 END AS hops,
 user_id % 60 + 1 AS visited, CASE WHEN event_type = 'error' THEN 0 ELSE 40 + event_id % 50 END AS tokens_walked, 7000 + event_id % 601 AS tokens_flat FROM events)"""


def _med(c: str, cond: str = "true") -> str:
    return f"SELECT '{c}' AS measure, coalesce((list_sort(list({c})))[len(list({c})) // 2 + 1], 0)::BIGINT AS median FROM lg WHERE {c} IS NOT NULL AND {cond}"


HEALTH = O.with_(O.NODES, O.EDGES, O.ASSUMPTIONS, typed.ENDS, O.DEGREE, build.DOCS, build.NAMES, LOG, f"""hs AS (
 SELECT 'untyped_edges' AS kind, 'error' AS sev, count(*) AS n FROM e WHERE edge_type NOT IN {EDGE_TYPES}
 UNION ALL SELECT 'orphans', 'warn', count(*) FROM n WHERE live AND id NOT IN (SELECT id FROM deg)
 UNION ALL SELECT 'provenance_gap', 'error', count(*) FROM n WHERE live AND node_type IN ('claim', 'decision') AND id NOT IN (SELECT src FROM x WHERE live AND dlive AND dt = 'source' AND edge_type IN ('derived_from', 'cites')) AND (source_id IS NULL OR source_id NOT IN (SELECT id FROM n WHERE live AND node_type = 'source'))
 UNION ALL SELECT 'unresolved_entities', 'warn', count(*) FROM rs WHERE entity_id IS NULL AND score >= {build.BORDERLINE}
 UNION ALL SELECT 'missing_relationships', 'warn', count(*) FROM n WHERE live AND node_type = 'entity' AND id NOT IN (SELECT dst FROM x WHERE live AND slive AND edge_type = 'mentions' AND st = 'claim')
 UNION ALL SELECT 'stale_assumptions', 'warn', count(*) FROM a WHERE status = 'active' AND (SELECT max(build) FROM n) - created_at_build > {STALE_AFTER}
 UNION ALL SELECT 'open_contradictions', 'warn', count(DISTINCT src) FROM e WHERE live AND edge_type = 'contradicts'
 UNION ALL SELECT 'dead_ends', 'warn', count(*) FROM lg WHERE dead_end IS NOT NULL
 UNION ALL SELECT 'invalidated_nodes', 'warn', count(*) FROM n WHERE invalidated)""")  # fmt: skip
QUERIES = {f.__name__: f for f in (hop_histogram, median_hops, dead_end_ledger, resolved_rate, last_walks, last_grid, last_visits, walk_examples, flat_costs_seen, visit_counts, traversal_ledger, proxy_rates, health_signals, health_status)}
SQL = {
    "hop_histogram": O.with_(LOG) + "SELECT b.h AS hops, count(lg.walk_id) AS n FROM (SELECT unnest(range(1, 10)) AS h) b LEFT JOIN lg ON lg.hops = b.h AND dead_end IS NULL GROUP BY b.h",
    "median_hops": O.with_(LOG) + " UNION ALL ".join([_med("hops", "dead_end IS NULL"), _med("tokens_walked", "dead_end IS NULL"), _med("visited"), _med("tokens_flat")]),
    "dead_end_ledger": O.with_(LOG) + f"SELECT t AS dead_end, count(lg.walk_id) AS n FROM {O.rows(DEAD_ENDS, 't')} LEFT JOIN lg ON lg.dead_end = t GROUP BY t",
    "resolved_rate": O.with_(LOG) + "SELECT count(*) AS walks, round(avg(CASE WHEN dead_end IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS resolved, round(coalesce(1 - (sum(tokens_walked) FILTER (WHERE dead_end IS NULL))::DOUBLE / nullif(sum(tokens_flat) FILTER (WHERE dead_end IS NULL), 0), 0.0), 6) AS saving, max(tokens_flat) AS flat_peak FROM lg",
    "last_walks": O.with_(LOG) + "SELECT walk_id, tokens_walked, visited FROM lg ORDER BY walk_id DESC LIMIT 60",
    "visit_counts": O.with_(O.NODES) + "SELECT node_type, sum(walks)::BIGINT AS walks, max(walks) AS most FROM n GROUP BY node_type",
    "traversal_ledger": O.with_(O.EDGES) + f"SELECT t AS edge_type, coalesce(sum(traversals), 0)::BIGINT AS n FROM {O.rows(LEDGER_TYPES, 't')} LEFT JOIN e ON e.edge_type = t GROUP BY t",
    "proxy_rates": O.with_(O.EDGES, LOG, "md AS (" + _med("visited") + ")") + "SELECT greatest(1, count(*) // greatest(max(build), 1) // 8) AS edges_per_tick, count(*) AS edges, greatest(max(build), 1) AS build, (SELECT count(*) FROM lg) AS walks_per_min, greatest(1, floor((SELECT median FROM md) * 1.6))::BIGINT AS traversal_ms FROM e",
    "last_grid": O.with_(LOG) + "SELECT walk_id, (dead_end IS NULL)::INT AS cell FROM lg ORDER BY walk_id DESC LIMIT 1008",
    "last_visits": O.with_(LOG) + "SELECT walk_id, visited FROM lg ORDER BY walk_id DESC LIMIT 40",
    "walk_examples": O.with_(LOG) + "SELECT walk_id, dead_end, hops, visited, tokens_walked, tokens_flat FROM (SELECT *, row_number() OVER (PARTITION BY dead_end IS NULL ORDER BY walk_id) AS r FROM lg) WHERE r <= 4",
    "flat_costs_seen": O.with_(LOG, "mf AS (" + _med("tokens_flat") + ")", "mw AS (" + _med("tokens_walked", "dead_end IS NULL") + ")") + "SELECT max(tokens_flat) AS flat_peak, sum(tokens_flat)::BIGINT AS flat_total, sum(tokens_walked)::BIGINT AS walk_total, (SELECT median FROM mf) AS tokens_flat_typical, (SELECT median FROM mw) AS tokens_walked_typical FROM lg",
    "health_signals": HEALTH + "SELECT kind, CASE WHEN n > 0 THEN sev ELSE 'info' END AS severity, n FROM hs",
    "health_status": HEALTH + "SELECT CASE WHEN bool_or(n > 0 AND sev = 'error') THEN 'error' WHEN bool_or(n > 0) THEN 'warn' ELSE 'ok' END AS status, count(*) FILTER (WHERE n > 0) AS signals FROM hs",
}
