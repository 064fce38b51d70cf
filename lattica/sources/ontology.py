"""The ontology as a table of text: loaded from markdown, checked, and turned into legal pairs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lattica.schema import BACKWARD, EDGE_TYPES, FORWARD, LEGAL, MUST_ATTRS, NODE_TYPES


class OntologyError(ValueError):
    pass


@dataclass(frozen=True)
class Ontology:
    node_types: tuple[str, ...] = NODE_TYPES
    edge_types: tuple[str, ...] = EDGE_TYPES
    legal: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=lambda: dict(LEGAL))
    backward: tuple[str, ...] = BACKWARD
    forward: tuple[str, ...] = FORWARD
    must_attrs: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(MUST_ATTRS))

    def allows(self, edge_type: str, src_type: str, dst_type: str) -> bool:
        return (src_type, dst_type) in self.legal.get(edge_type, ())


def _table(text: str, first: str) -> list[dict[str, str]]:
    """Rows of the markdown table whose first heading is `first`."""
    lines = [x.strip() for x in text.splitlines()]
    for i, line in enumerate(lines):
        head = [h.strip() for h in line.strip("|").split("|")]
        if line.startswith("|") and head[0] == first and i + 1 < len(lines) and re.fullmatch(r"[|\s:-]+", lines[i + 1]):
            out = []
            for row in lines[i + 2 :]:
                if not row.startswith("|"):
                    break
                out.append(dict(zip(head, (x.strip().strip("`") for x in row.strip("|").split("|")))))
            return out
    raise OntologyError(f"no table with heading {first!r}")


def parse(text: str) -> Ontology:
    """Markdown with a table `node | must carry` and a table `edge | pairs | invalidation`, pairs written a->b, separated by commas."""
    nodes = _table(text, "node")
    edges = _table(text, "edge")
    types = tuple(r["node"] for r in nodes)
    if not types or len(set(types)) != len(types) or not edges:
        raise OntologyError("node types are missing or repeated, or there are no edges")
    legal: dict[str, tuple[tuple[str, str], ...]] = {}
    ways: dict[str, list[str]] = {"backward": [], "forward": [], "none": []}
    for r in edges:
        pairs = tuple(tuple(x.strip() for x in p.split("->")) for p in r["pairs"].split(","))
        if r["edge"] in legal or any(len(p) != 2 or not set(p) <= set(types) for p in pairs):
            raise OntologyError(f"edge {r['edge']!r} is repeated or names an undeclared type")
        if r["invalidation"] not in ways:
            raise OntologyError(f"{r['invalidation']!r} is no direction")
        legal[r["edge"]] = pairs
        ways[r["invalidation"]].append(r["edge"])
    must = {r["node"]: tuple(k.strip() for k in r["must carry"].split(",") if k.strip()) for r in nodes}
    return Ontology(types, tuple(legal), legal, tuple(ways["backward"]), tuple(ways["forward"]), must)
