"""A plan run against a graph: what a round executed, cleared or disproved is written to it, a round at a time.

An executed task becomes a decision with an explicit id (plan, task, attempt), so that writing a round again changes nothing; its products are entities, its audit an evidence node that justifies it. A disproof
becomes evidence that contradicts the ground, which is rejected with everything that stands on it.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import decisions as D
from lattica.operators import ground as G
from lattica.operators import mutations as M
from lattica.plans.runner import PlanError, Registry, Round, Runner, Task, Verdict
from lattica.session import cut

NODE = "id string, node_type string, label string, attrs string, rationale string, retrieved_at string, source_id string, build long"


def slug(text: str, prefix: str) -> str:
    """functions.text.slug of one text."""
    body = re.sub("[^a-z0-9]+", "-", text.lower()).strip("-")[:40]
    return f"{prefix}:" + "-".join(x for x in (body, hashlib.sha1(text.encode()).hexdigest()[:6]) if x)


class GraphRunner(Runner):
    """products: task name to the labels of what it makes; grounds are ids of assumptions of the graph."""

    def __init__(self, graph: G.Graph, plan: str, source_id: str, tasks: list[Task], registry: Registry, products: dict[str, tuple[str, ...]] | None = None):
        known = {r.id: r.status for r in graph.assumptions.filter(F.col("id").isin([t.ground for t in tasks if t.ground])).select("id", "status").collect()}
        if unknown := {t.ground for t in tasks if t.ground} - set(known):
            raise PlanError(f"no assumptions {sorted(unknown)}")
        super().__init__(tasks, registry, {i: "active" if s == "active" else "rejected" for i, s in known.items()})
        self.graph, self.plan, self.source_id, self.products = graph, plan, source_id, products or {}
        self.nodes: dict[str, str] = {}
        self.radius: dict[str, DataFrame] = {}
        self._reasons: dict[str, str] = {}

    def _judge(self, t: Task, output: dict) -> Verdict:
        verdict = super()._judge(t, output)
        self._reasons[t.name] = verdict.reason or verdict.state
        return verdict

    def run(self) -> Round:
        out = super().run()
        if out.executed:
            self._write([self.tasks[n] for n in out.executed if self.tasks[n].state == "done"])
        return out

    def _frame(self, rows: list[tuple]) -> DataFrame:
        return self.graph.nodes.sparkSession.createDataFrame(rows, NODE)

    def _write(self, done: list[Task]) -> None:
        """All decisions of a round in one batch."""
        g, build = self.graph, self.graph.build
        before, ids = dict(self.nodes), {t.name: slug(f"{self.plan}|{t.name}|v{t.attempt}", "decision") for t in done}
        self.nodes |= ids
        made = {x: slug(x, "entity") for t in done for x in self.products.get(t.name, ())}
        audits = {t.name: slug(f"audit of {t.name}: {self._reasons[t.name]}", "evidence") for t in done if t.auditor}
        rows = [(i, "entity", x, '{"aliases":[]}', None, None, None, build) for x, i in made.items()]
        rows += [(i, "evidence", f"audit of {n}: {self._reasons[n]}", '{"kind":"audit"}', None, None, None, build) for n, i in audits.items()]
        nodes = M.upsert_nodes(g.nodes, self._frame(rows).dropDuplicates(["id"])) if rows else g.nodes
        # what was made again exists again
        back = F.col("id").isin(list(made.values())) & F.col("invalidated")
        nodes = cut(nodes.withColumn("live", F.col("live") | (back & ~F.col("pruned"))).withColumn("invalidated", F.col("invalidated") & ~back), "nodes")
        why = lambda t: (f"Executed under {t.ground}" if t.ground else "Executed") + (f", attempt {t.attempt}: the ground before did not survive its audit" if t.attempt > 1 else "")
        asked = [(k, ids[t.name], t.name, why(t), self.source_id, None, None, [x for x in (t.ground, *(self.nodes.get(n) for n in t.needs)) if x], [made[x] for x in self.products.get(t.name, ())], before.get(t.name)) for k, t in enumerate(done)]
        n, e, _ = D.decide(nodes, g.edges, nodes.sparkSession.createDataFrame(asked, D.REQUEST), build)
        links = [(ids[name], "justified_by", i, 1.0) for name, i in audits.items()]
        if links:
            e = M.upsert_edges(e, n.sparkSession.createDataFrame(links, "src string, edge_type string, dst string, weight double"), n, build)
        self.graph = G.Graph(cut(n, "nodes"), cut(e, "edges"), g.assumptions, build)

    def _disprove(self, t: Task, verdict: Verdict) -> None:
        if t.ground is not None and self.grounds.get(t.ground) == "active":
            evidence, g = verdict.evidence_id, self.graph
            if evidence is None:
                evidence = slug(f"disproof of {t.ground}: {verdict.reason}", "evidence")
                nodes = M.upsert_nodes(g.nodes, self._frame([(evidence, "evidence", f"disproof of {t.ground}: {verdict.reason}", '{"kind":"audit"}', None, None, None, g.build)]))
                g = G.Graph(cut(nodes, "nodes"), g.edges, g.assumptions, g.build)
            self.graph, self.radius[t.ground], _ = G.reject(g, t.ground, evidence)
        super()._disprove(t, verdict)

    def recheck(self, require_evidence: set[str] | None = None) -> list[str]:
        """As Runner.recheck; the evidence required has to be evidence of the graph that stands."""
        if require_evidence is not None:
            live = self.graph.nodes.filter(F.col("id").isin(list(require_evidence)) & (F.col("node_type") == "evidence") & F.col("live"))
            require_evidence = {r.id for r in live.select("id").collect()}
        return super().recheck(require_evidence)

    def repair(self, name: str, ground: str, worker: str | None = None) -> None:
        """As Runner.repair; a ground that the graph lacks is assumed there, one that it rejected is refused."""
        found = self.graph.assumptions.filter(F.col("id") == ground).select("status").first()
        if found is not None and found.status != "active":
            raise PlanError(f"{ground!r} is {found.status}")
        if found is None:
            self.graph, ground = G.assume(self.graph, ground, "repair")
        super().repair(name, ground, worker)
