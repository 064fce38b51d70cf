"""All queries of this package, and the SQL each is compared with."""

from __future__ import annotations

from lattica.llm import canonical_map, mix, neighbours, pieces, small_edits, subjects, tokenize

QUERIES = {
    "p1_found": canonical_map.p1_found,
    "p1_unmatched": canonical_map.p1_unmatched,
    "p2_found": pieces.p2_found,
    "p2_pieces": pieces.p2_pieces,
    "p3_found": neighbours.p3_found,
    "p3_neighbours": neighbours.p3_neighbours,
    "p5_found": small_edits.p5_found,
    "p5_groups": small_edits.p5_groups,
    "p6_ids": tokenize.p6_ids,
    "p6_decoded": tokenize.p6_decoded,
    "p7_selection": mix.p7_selection,
    "p7_shares": mix.p7_shares,
    "p8_found": subjects.p8_found,
    "p8_composition": subjects.p8_composition,
}



def _fits(level: int) -> str:
    """Whether the stretches between all boundaries of the level and the coarser ones are short enough. Stops stay with the stretch before them: each is put before a mark to split at."""
    x = r"regexp_replace(text, '(\n[ \t\r\n]*\n)', chr(1), 'g')"
    if level > 0:
        x = rf"regexp_replace({x}, '\n', chr(1), 'g')"
    if level > 1:
        x = rf"regexp_replace(regexp_replace({x}, '([.!?])[ \t\r\n]', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g')"
    if level > 2:
        x = rf"regexp_replace({x}, '[ \t\r\n]', chr(1), 'g')"
    return rf"list_max(list_transform(string_split({x}, chr(1)), lambda s: length(regexp_replace(s, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')))) <= room"


_TRIM = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_COSINES = (
    "WITH v AS (SELECT DISTINCT id, embedding::DOUBLE[128] AS e FROM (SELECT id, embedding FROM nodes WHERE id IS NOT NULL AND len(embedding) = 128) WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0), "
    "s AS (SELECT a.id AS x, b.id AS y, array_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id) "
)
#: l: the labels that take part; near: pairs of different ones that are similar.
_SIMILAR = (
    "l AS (SELECT * FROM (SELECT id, max(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))) AS s FROM nodes WHERE node_type IN ('claim', 'evidence') AND id IS NOT NULL AND label IS NOT NULL GROUP BY id) WHERE length(s) >= 20), "
    "g AS (SELECT DISTINCT s, substr(s, i, 3) AS g FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM (SELECT DISTINCT s FROM l))), n AS (SELECT s, count(*) AS n FROM g GROUP BY s), "
    "p AS (SELECT x.s AS a, y.s AS b, count(*) AS n FROM g x JOIN g y ON x.g = y.g AND x.s < y.s GROUP BY 1, 2), near AS (SELECT a, b FROM p JOIN n x ON x.s = a JOIN n y ON y.s = b WHERE p.n / (x.n + y.n - p.n) >= 0.6) "
)
SQL: dict[str, str] = {
    "p2_found": "WITH l AS (SELECT " + _TRIM.format("source") + " AS s, min(max_chars) AS m, arg_min(overlap_chars, max_chars) AS o FROM piece_limits GROUP BY 1), "
    "d AS (SELECT doc_id, text, coalesce(a.m, b.m) AS m, coalesce(a.m, b.m) - coalesce(a.o, b.o) AS room FROM documents LEFT JOIN l a ON a.s = " + _TRIM.format("source") + " AND a.s <> '*' LEFT JOIN l b ON b.s = '*') "
    "SELECT doc_id, CASE " + " ".join(f"WHEN {_fits(i)} THEN '{x}'" for i, x in enumerate(("paragraph", "line", "sentence", "word"))) + " ELSE 'none' END AS cut_level FROM d WHERE length(text) > m",
    "p3_found": _COSINES + "SELECT DISTINCT least(x, y) AS node_a, greatest(x, y) AS node_b FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY round(c, 9) DESC, y) AS r FROM s WHERE c >= 0.85) WHERE r <= 10",
    "p3_neighbours": _COSINES + "SELECT x AS id, y AS other, round(c, 4) AS cosine FROM (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY round(c, 9) DESC, y) AS r FROM s) WHERE r <= 10",
    "p5_found": "WITH RECURSIVE " + _SIMILAR + "SELECT least(x.id, y.id) AS node_a, greatest(x.id, y.id) AS node_b FROM near JOIN l x ON x.s = a JOIN l y ON y.s = b UNION ALL SELECT x.id, y.id FROM l x JOIN l y ON x.s = y.s AND x.id < y.id",
    "p5_groups": "WITH RECURSIVE " + _SIMILAR + ", r(c, d) AS (SELECT DISTINCT s, s FROM l UNION SELECT c, e.b FROM r JOIN (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) e ON e.a = d) "
    "SELECT l.id, g.g AS group_id, coalesce(k.n, 0) AS n_links FROM l JOIN (SELECT c, min(id) AS g FROM r JOIN l ON l.s = d GROUP BY c) g ON g.c = l.s LEFT JOIN (SELECT x, count(*) AS n FROM (SELECT a AS x FROM near UNION ALL SELECT b FROM near) GROUP BY x) k ON k.x = l.s",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
