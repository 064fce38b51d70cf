"""All registered queries of the core, and the SQL each is compared with."""

from __future__ import annotations

from lattica.operators import agreement, build, closure, decisions, hierarchy, hindsight, mutations, telemetry, temporal, typed, walk
from lattica.plans import evidence, ledger
from lattica.streaming import intake

QUERIES = {
    "p4_found": hierarchy.p4_found,
    "p4_nested": hierarchy.p4_nested,
    "p4_descendants": hierarchy.p4_descendants,
    "p4_task_paths": hierarchy.p4_task_paths,
    "p4_task_descendants": hierarchy.p4_task_descendants,
}
SQL: dict[str, str] = {}
for _m in (typed, closure, temporal, build, walk, hindsight, mutations, decisions, telemetry, ledger, agreement, evidence, intake):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
