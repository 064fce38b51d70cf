"""The typed graph's vocabulary and the explicit table schemas.

The values in this module are fixed: they define which edges are legal, what each costs and how invalidation runs along it.
"""

from __future__ import annotations

NODE_TYPES = ("entity", "claim", "source", "decision", "assumption", "evidence")
EDGE_TYPES = ("mentions", "derived_from", "cites", "contradicts", "supports", "depends_on", "produces", "supersedes", "justified_by", "resolves_to")

# Legal (source type, target type) pairs of each edge type.
LEGAL = {
    "mentions": (("source", "entity"), ("claim", "entity")),
    "derived_from": (("claim", "source"), ("decision", "claim"), ("entity", "source")),
    "cites": (("decision", "source"), ("claim", "claim")),
    "contradicts": (("claim", "claim"), ("evidence", "claim"), ("evidence", "assumption")),
    "supports": (("evidence", "claim"), ("claim", "decision"), ("evidence", "decision")),
    "depends_on": (("decision", "assumption"), ("decision", "decision"), ("claim", "assumption")),
    "produces": (("decision", "entity"), ("decision", "source")),
    "supersedes": (("decision", "decision"), ("assumption", "assumption"), ("claim", "claim")),
    "justified_by": (("decision", "evidence"), ("claim", "evidence"), ("assumption", "evidence")),
    "resolves_to": (("entity", "entity"),),
}
# What it costs a walk to cross an edge.
COST = {
    "derived_from": 0.6, "supports": 0.7, "cites": 0.8, "justified_by": 0.8, "contradicts": 0.9, "mentions": 1.0, "depends_on": 1.0, "produces": 1.1, "supersedes": 1.2, "resolves_to": 0.3,
}
BACKWARD, FORWARD = ("derived_from", "depends_on"), ("produces",)
#: Followed by a walk along their direction, and against it (into nodes that assert something).
FOLLOWED = tuple(t for t in EDGE_TYPES if t != "resolves_to")
REVERSED = ("mentions", "supports", "derived_from", "produces")
ASSERTING, ANSWERING = ("claim", "decision", "evidence"), ("claim", "decision")
# Keys of attrs that a node of a type must have.
MUST_ATTRS = {"entity": ("canonical", "aliases"), "source": ("origin",), "assumption": ("status", "version"), "evidence": ("kind",)}
STATUSES = ("active", "superseded", "rejected")
DEAD_ENDS = ("no_typed_edge", "entity_unresolved", "pruned_too_early", "wrong_node_type")
EVENTS = ("executed", "audited", "disproved", "invalidated", "repaired", "cached", "blocked", "failed")

NODE_SCHEMA = (
    "id string, ord bigint, node_type string, label string, attrs string, rationale string, retrieved_at string, "
    "prov struct<source_id: string, span_start: bigint, span_end: bigint, extractor: string, checks: array<string>, recorded_at_build: bigint>, "
    "embedding array<float>, build bigint, walks bigint, pruned boolean, invalidated boolean"
)
EDGE_SCHEMA = "id string, ord bigint, src string, dst string, edge_type string, assumption_id string, evidence_ids array<string>, weight double, build bigint, traversals bigint, invalidated boolean"
ASSUMPTION_SCHEMA = "id string, ord bigint, statement string, status string, version_no bigint, created_by string, created_at_build bigint, supersedes string, superseded_by string, rejected_at_build bigint, evidence_ids array<string>"
LEDGER_SCHEMA = "seq bigint, round bigint, event string, task string, detail string, node_id string, assumption_id string, data string, digest string"
