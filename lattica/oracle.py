"""SQL views that the comparison queries start from; they state the cleaning of sources/graph.py independently."""

from lattica.functions import text as T
from lattica.schema import EDGE_TYPES, LEGAL, NODE_TYPES


def rows(values, *names) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in (v if isinstance(v, tuple) else (v,))) + ")" for v in values) + f") AS v({', '.join(names)})"


FOLD = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
WS = T.WS.replace("\\t", "\\x{09}").replace("\\r", "\\x{0d}")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def day(x: str) -> str:
    return f"CASE WHEN regexp_matches({strip(x)}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast({strip(x)} AS DATE) END"


NODES = """
n0 AS (SELECT *, prov.source_id AS psid, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, walks DESC, build DESC) AS rn FROM nodes WHERE id IS NOT NULL),
n AS (SELECT id, ord, node_type, label, attrs, rationale, retrieved_at, psid AS source_id, build, walks, coalesce(pruned, false) AS pruned, coalesce(invalidated, false) AS invalidated,
        NOT coalesce(pruned, false) AND NOT coalesce(invalidated, false) AS live FROM n0 WHERE rn = 1
      UNION ALL SELECT entity_id, ord + 1000000000000, 'entity', label, '{"canonical":1,"aliases":1}', NULL, NULL, NULL, 0, 0, false, false, true FROM canonical)"""
EDGES = f"""
e0 AS (SELECT *, {FOLD.format('edge_type')} AS et, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, weight DESC, traversals DESC) AS rn FROM edges WHERE id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL),
e AS (SELECT arg_min(id, ord) AS id, min(ord) AS ord, src, dst, et AS edge_type, arg_min_null(assumption_id, ord) AS assumption_id, sum(weight) AS weight, min(build) AS build, sum(traversals)::BIGINT AS traversals,
        NOT coalesce(bool_and(invalidated), false) AS live FROM e0 WHERE rn = 1 GROUP BY src, et, dst)"""
ASSUMPTIONS = """
a AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, ord DESC) AS rn FROM assumptions WHERE id IS NOT NULL) WHERE rn = 1)"""
DEGREE = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)"
LEGAL_ROWS = rows([(t, s, d) for t, p in LEGAL.items() for s, d in p], "edge_type", "st", "dt")
NODE_TYPE_ROWS, EDGE_TYPE_ROWS = rows(NODE_TYPES, "t"), rows(EDGE_TYPES, "t")


def words(values) -> str:
    return "[" + ", ".join(f"'{w}'" for w in values) + "]"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n"
