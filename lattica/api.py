"""One object over a folder of tables: questions, inspection, closures, the past, health. Errors of the caller come back as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import html_safe, iso_date
from lattica.operators import closure, decisions, ground, hindsight, mutations, telemetry, temporal, typed, walk
from lattica.operators.mutations import Refused
from lattica.session import cut, table
from lattica.sources.graph import assumption_rows, edge_rows, node_rows

LIMIT = 200


def _rows(df: DataFrame, limit: int = LIMIT) -> list[dict]:
    """At most `limit` rows for display; whoever shows them gives the total beside them. node_edges and blast_radius_all have all rows as tables."""
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


class Mesh:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.nodes, self.edges, self.assumptions = node_rows(spark, folder), edge_rows(spark, folder), assumption_rows(spark, folder)

    def ask(self, *questions: str) -> list[dict]:
        q = self.spark.createDataFrame(list(enumerate(questions)), "walk_id bigint, question string")
        walks, _ = walk.ask(q, self.nodes, self.edges, table(self.spark, self.folder, "canonical"))
        return _rows(walks.orderBy("walk_id"), len(questions))

    def get_node(self, node_id: str) -> dict:
        found = _rows(self.nodes.filter(F.col("id") == node_id).drop("source_id"), 1)
        if not found:
            return {"error": f"no node {node_id!r}"}
        deg = typed.degrees(self.edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))).filter(F.col("id") == node_id).collect()
        out, into = (self.edges.filter(F.col(c) == node_id).orderBy("ord") for c in ("src", "dst"))
        return found[0] | {"degree": deg[0].degree if deg else 0, "n_out": out.count(), "n_in": into.count(), "out": _rows(out), "in": _rows(into)}

    def blast_radius(self, assumption_id: str) -> dict:
        a = _rows(self.assumptions.filter(F.col("id") == assumption_id), 1)
        if not a:
            return {"error": f"no assumption {assumption_id!r}"}
        r = closure.blast_radius(self.spark.createDataFrame([(assumption_id,)], "root string"), self.edges, self.nodes)
        n = r.count()
        note = "" if a[0]["status"] == "active" else f"already {a[0]['status']}"
        return {"assumption": assumption_id, "radius": n, "preserved": self.nodes.filter("live").count() - n - 1, "note": note, "fallen": _rows(r.orderBy("depth", "node"))}

    def lineage(self, assumption_id: str) -> list[dict]:
        line = closure.assumption_lineage(self.spark, self.folder)
        root = line.filter(F.col("id") == assumption_id).select("oldest")
        return _rows(line.join(root, "oldest").orderBy("position"), line.count())

    def explain_as_of(self, question: str, day: str) -> dict:
        if not self.spark.range(1).select(iso_date(F.lit(day)).isNotNull()).first()[0]:
            return {"error": f"{day!r} is no date"}
        q = self.spark.createDataFrame([(0, question)], "walk_id bigint, question string")
        walks, placed = hindsight.explain(q, self.nodes, self.edges, self.assumptions, table(self.spark, self.folder, "canonical"), day)
        out = {"question": question, "as_of": day, "walk": walks.first().asDict(), "then": [], "decision": [], "later": [], "undated": [], "not_yet_known": []}
        for r in placed.drop("walk_id").withColumn("day", F.col("day").cast("string")).orderBy("bucket", "node").collect():
            out[r.bucket].append(r.asDict())
        return out

    def reconstruct_decision(self, decision_id: str, depth: int = 3) -> dict:
        if self.nodes.filter((F.col("id") == decision_id) & (F.col("node_type") == "decision")).isEmpty():
            return {"error": f"no decision {decision_id!r}"}
        own = temporal.anchors(self.nodes, self.edges).filter(F.col("id") == decision_id).first().day
        rows = temporal.decision_histories(self.spark.createDataFrame([(decision_id,)], "root string"), self.nodes, self.edges, depth)
        return {"decision": decision_id, "day": str(own) if own else None, "nodes": [r.asDict() for r in rows.drop("root", "day").orderBy("hops", "node").collect()]}

    # Writes change what this object holds, never the folder; sources.store keeps versions.

    def _graph(self) -> ground.Graph:
        build = self.nodes.agg(F.coalesce(F.max("build"), F.lit(0))).first()[0]
        return ground.Graph(cut(self.nodes, "nodes"), cut(self.edges, "edges"), cut(self.assumptions, "assumptions"), build + 1)

    def _take(self, g: ground.Graph) -> None:
        self.nodes, self.edges, self.assumptions = g.nodes, g.edges, g.assumptions

    def _tried(self, change) -> dict:
        """change: graph to (graph, what to say); a refusal changes nothing and comes back as data."""
        try:
            g, said = change(self._graph())
        except Refused as e:
            return {"error": str(e)}
        self._take(g)
        return said

    def assume(self, statement: str, by: str = "agent", evidence_ids: tuple[str, ...] = ()) -> dict:
        return self._tried(lambda g: (lambda out: (out[0], {"assumption": out[1]}))(ground.assume(g, statement, by, evidence_ids)))

    def supersede(self, assumption_id: str, statement: str) -> dict:
        return self._tried(lambda g: (lambda out: (out[0], {"assumption": out[1], "supersedes": assumption_id}))(ground.supersede(g, assumption_id, statement)))

    def reject(self, assumption_id: str, evidence_id: str, replacement: str | None = None) -> dict:
        def change(g):
            after, radius, new = ground.reject(g, assumption_id, evidence_id, replacement)
            return after, {"assumption": assumption_id, "radius": radius.count(), "fallen": _rows(radius.orderBy("depth", "node")), "replacement": new}

        return self._tried(change)

    def bind(self, edge_id: str, assumption_id: str) -> dict:
        return self._tried(lambda g: (ground.Graph(g.nodes, cut(mutations.bind(g.edges, g.assumptions, edge_id, assumption_id), "edges"), g.assumptions, g.build), {"edge": edge_id, "assumption": assumption_id}))

    def submit_evidence(self, *submissions: dict) -> dict:
        """submissions: text, source_id and, where there are any, external_id and metadata (a JSON object as text)."""
        def change(g):
            rows = [tuple(x.get(k) for k in ("text", "source_id", "external_id", "metadata")) for x in submissions]
            after, out = ground.submit_evidence(g, self.spark.createDataFrame(rows, ground.EVIDENCE))
            return after, {"outcomes": _rows(out, len(rows))}

        return self._tried(change)

    def decide(self, *requests: dict) -> dict:
        """requests: title, source_id and, where there are any, id, rationale, supported_by, cites, assumptions, produces, supersedes."""
        def change(g):
            names = ("id", "title", "rationale", "source_id", "supported_by", "cites", "assumptions", "produces", "supersedes")
            n, e, out = decisions.decide(g.nodes, g.edges, self.spark.createDataFrame([(k, *(r.get(c) for c in names)) for k, r in enumerate(requests)], decisions.REQUEST), g.build)
            return ground.Graph(cut(n, "nodes"), cut(e, "edges"), g.assumptions, g.build), {"decisions": _rows(out.orderBy("request"), len(requests))}

        return self._tried(change)

    def health(self) -> list[dict]:
        return _rows(telemetry.health_signals(self.spark, self.folder))

    def export(self, folder: str) -> dict:
        """Writes the whole display projection below folder, nodes and edges as JSON lines that are safe inside HTML, and gives the totals."""
        shown = cut(typed.display_projection(self.spark, self.folder), "shown")
        edges = cut(typed.shown_edges(shown.select("idx", "id"), self.edges), "shown")
        for name, rows in (("nodes", shown), ("edges", edges)):
            rows.select(html_safe(F.to_json(F.struct("*"))).alias("value")).write.text(f"{folder}/{name}")
        return {"folder": folder, "nodes": shown.count(), "edges": edges.count()}
