"""The text build: sentences, claims, names resolved to canonical entities, links, report.

Resolution is set-parallel. The registry (labels and aliases of the canonical list) is fixed while documents are read, so each distinct normalised
mention is resolved once, by three equi-joins: alias table, block keys, labels; nothing is compared pairwise. A declared name that resolves to nothing founds an
entity of its own, shared by all names of the same normal form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.functions import text as T
from lattica.functions import vectors
from lattica.operators import typed
from lattica.schema import EDGE_TYPES
from lattica.session import cut, table
from lattica.sources.graph import document_rows, node_rows

THRESHOLD, BORDERLINE = 0.62, 0.25


def spans(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos, start, end_, sentence): sentences of each text with their offsets in the stripped text."""
    piece = F.posexplode(F.regexp_extract_all(T.strip("text"), F.lit(T.SENTENCE), F.lit(0))).alias("pos", "piece")
    rows = docs.filter(F.length(T.strip("text")) > 0).select("key", "doc_id", piece)
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)).cast("long")
    rows = rows.withColumn("start", start).withColumn("sentence", F.regexp_replace("piece", rf"{T.WS}+\z", ""))
    return rows.select("key", "doc_id", F.col("pos").cast("long").alias("pos"), "start", (F.col("start") + F.length("sentence")).alias("end_"), "sentence")


def claims(s: DataFrame) -> DataFrame:
    return s.filter(T.assertive("sentence")).withColumn("claim_id", T.slug("sentence", "claim"))


class Registry:
    """labels (entity_id, label, norm), aliases (norm, entity_id) with the last registration winning, blocks (k, entity_id)."""

    def __init__(self, canonical: DataFrame):
        names = canonical.select("entity_id", "ord", "label", F.posexplode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("nth", "name")).filter("name is not null")
        names = cut(names.withColumn("norm", T.normalise("name")).filter("norm != ''"), "names")
        self.labels = canonical.select("entity_id", "label", T.normalise("label").alias("label_norm"))
        self.aliases = names.groupBy("norm").agg(F.max_by("entity_id", F.struct("ord", "nth")).alias("entity_id"))
        self.blocks = names.select("entity_id", F.explode(T.block_keys("norm")).alias("k")).distinct()

    def candidates(self, norms: DataFrame) -> DataFrame:
        """(norm, entity_id, score) of every entity in one of a name's blocks, among names that are no alias."""
        rest = norms.filter("norm != ''").join(self.aliases, "norm", "left_anti")
        pairs = rest.select("norm", F.explode(T.block_keys("norm")).alias("k")).join(self.blocks, "k").select("norm", "entity_id").distinct()
        return pairs.join(self.labels, "entity_id").select("norm", "entity_id", T.similarity("norm", "label_norm").alias("score"))

    def resolve(self, norms: DataFrame) -> DataFrame:
        """norms: (norm), distinct. (norm, entity_id, score, reason): entity_id null where nothing clears the threshold; ties go to the least id."""
        hit = norms.join(self.aliases, "norm").select("norm", "entity_id", F.lit(1.0).alias("score"), F.lit("alias table").alias("reason"))
        best = self.candidates(norms).filter("score > 0").groupBy("norm").agg(F.min(F.struct((-F.col("score")).alias("neg"), "entity_id")).alias("b")).select("norm", "b.entity_id", (-F.col("b.neg")).alias("score"))
        rest = norms.join(self.aliases, "norm", "left_anti").join(best, "norm", "left")
        ok = F.col("score") >= THRESHOLD
        reason = F.when(F.col("norm") == "", "empty after normalisation").when(F.col("score").isNull(), "no candidate").when(ok, "scored match").otherwise("below threshold")
        return hit.unionByName(rest.select("norm", F.when(ok, F.col("entity_id")).alias("entity_id"), F.coalesce("score", F.lit(0.0)).alias("score"), reason.alias("reason")))


def declared(docs: DataFrame) -> DataFrame:
    """(key, doc_id, pos, name, norm): declared names of documents."""
    rows = docs.select("key", "doc_id", F.posexplode("entities").alias("pos", "name")).filter("name is not null")
    return rows.withColumn("norm", T.normalise("name"))


def build(docs: DataFrame, canonical: DataFrame) -> dict[str, DataFrame]:
    """All stages: spans, claims, names, mentions (of claims, resolved), hints (declared relations), links (observed edges), report."""
    reg = Registry(canonical)
    s = cut(spans(docs), "spans")
    c = cut(claims(s), "claims")
    names = cut(declared(docs), "declared")
    said = cut(c.select("key", "claim_id", "pos", F.explode(T.mentions("sentence")).alias("mention")).withColumn("norm", T.normalise("mention")), "said")
    wanted = cut(hint_rows(docs), "hints")
    hint_norms = wanted.select(F.explode(F.array("subject", "object")).alias("hint")).filter("hint is not null").select(T.normalise("hint").alias("norm"))
    all_norms = names.select("norm").unionByName(said.select("norm")).unionByName(hint_norms).distinct()
    found = cut(reg.resolve(all_norms), "resolved")
    own = names.join(found, "norm")
    fresh = own.filter("entity_id is null and norm != ''").groupBy("norm").agg(F.min(F.struct("doc_id", "pos", "name")).alias("f")).select("norm", T.slug("f.name", "entity").alias("fresh"))
    known = found.join(fresh, "norm", "left").select("norm", F.coalesce("entity_id", "fresh").alias("entity_id"), "score", "reason")
    known = cut(known, "known")
    name_hits, said_hits = names.join(known, "norm"), said.join(known, "norm")
    edge = lambda df, a, t, b: df.select(F.col(a).alias("src"), F.lit(t).alias("edge_type"), F.col(b).alias("dst"))
    nh, sh = name_hits.filter("entity_id is not null"), said_hits.filter("entity_id is not null")
    links = edge(nh, "key", "mentions", "entity_id").unionByName(edge(nh, "entity_id", "derived_from", "key")).unionByName(edge(c, "claim_id", "derived_from", "key"))
    links = links.unionByName(edge(sh, "claim_id", "mentions", "entity_id")).unionByName(edge(sh, "key", "mentions", "entity_id")).unionByName(edge(sh, "entity_id", "derived_from", "key"))
    claim_nodes = c.groupBy("claim_id").agg(F.min(F.struct("doc_id", "pos", F.col("key").alias("home"), F.col("sentence").alias("label"))).alias("f")).select("claim_id", "f.*")
    claim_nodes = cut(claim_nodes, "claims")
    entities = canonical.select("entity_id").unionByName(fresh.select(F.col("fresh").alias("entity_id"))).filter("entity_id is not null").distinct()
    kinds = ((docs, "key", "source"), (claim_nodes, "claim_id", "claim"), (entities, "entity_id", "entity"))
    ids = [df.select(F.col(k).alias("id"), F.lit(t).alias("node_type")) for df, k, t in kinds]
    ids = cut(ids[0].unionByName(ids[1]).unionByName(ids[2]).groupBy("id").agg(F.max("node_type").alias("node_type")), "ids")
    related = cut(hints(wanted, ids, claim_nodes, said_hits, known), "hints")
    links = links.unionByName(related.filter("legal").select("src", F.col("relation").alias("edge_type"), "dst"))
    links = cut(links.groupBy("src", "edge_type", "dst").agg(F.count("*").alias("weight")), "links")
    lone = ids.filter("node_type != 'source'").join(links.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")
    both = name_hits.select("entity_id").unionByName(said_hits.select("entity_id"))
    tally = lambda df, stage, kind, sign=1, n=F.count("*"): df.agg((sign * F.coalesce(n, F.lit(0))).alias("n")).select(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), "n")
    parts = [
        tally(docs, "CHUNK", "admitted"), tally(c, "EXTRACT", "admitted"), tally(s, "EXTRACT", "dropped"), tally(c, "EXTRACT", "dropped", -1),
        tally(both.filter("entity_id is not null"), "RESOLVE", "admitted"), tally(both.filter("entity_id is null"), "RESOLVE", "dropped"),
        tally(links, "LINK", "admitted", n=F.sum("weight")), tally(both.filter("entity_id is null"), "LINK", "dropped"), tally(related.filter("not legal"), "LINK", "dropped"),
        tally(ids, "EMBED", "admitted"), tally(ids, "PRUNE", "admitted"), tally(lone, "PRUNE", "admitted", -1), tally(lone, "PRUNE", "dropped"),
    ]
    tallies = parts[0]
    for p in parts[1:]:
        tallies = tallies.unionByName(p)
    report = tallies.groupBy("stage").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("admitted", "dropped")))
    return {"spans": s, "claims": c, "names": name_hits, "mentions": said_hits, "hints": related, "links": links, "report": report}


def hint_rows(docs: DataFrame) -> DataFrame:
    """(key, nth, subject, relation, object): declared relations of documents."""
    r = docs.select("key", F.posexplode("relations").alias("nth", "r")).filter("r is not null")
    return r.select("key", "nth", "r.subject", F.lower(F.trim("r.relation")).alias("relation"), "r.object")


def fragment_hits(needles: DataFrame, claim_nodes: DataFrame) -> DataFrame:
    """needles: (needle), distinct. (needle, claim_id, home, doc_id, pos) of every claim that contains the needle, letter case aside. A needle is
    looked up by the rarest of its three-character pieces (one of up to three characters by itself) and compared in full only there."""
    low = claim_nodes.select("claim_id", "home", "doc_id", "pos", F.lower("label").alias("low"))
    cut_at = lambda x, k: F.when(F.length(x) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - k + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    pieces = F.when(F.length("needle") <= 3, F.array("needle")).otherwise(cut_at(F.col("needle"), 3))
    own = cut(needles.select("needle", F.explode(F.array_distinct(pieces)).alias("gram")), "needles")
    every = F.array_distinct(F.concat(F.array(F.lit("")), *(cut_at(F.col("low"), k) for k in (1, 2, 3))))
    grams = cut(low.select("claim_id", F.explode(every).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi"), "grams")
    rarest = own.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    near = rarest.filter("m.n > 0").select("needle", F.col("m.gram").alias("gram")).join(grams, "gram")
    return near.join(low, "claim_id").filter(F.contains("low", "needle")).select("needle", "claim_id", "home", "doc_id", "pos")


def hints(rows: DataFrame, ids: DataFrame, claim_nodes: DataFrame, said: DataFrame, known: DataFrame) -> DataFrame:
    """rows: hint_rows; ids: (id, node_type) of all nodes; claim_nodes: (claim_id, doc_id, pos, home, label); said: resolved mentions of claims; known: (norm,
    entity_id), the hints' norms among them. Every hint as (key, nth, src, relation, dst, legal, known). An end is the node of that id, else the first claim
    that contains it (of the same document if one does), else the document's first claim that mentions the entity of that name, else that entity; null if none."""
    ends = rows.select("key", F.explode(F.array("subject", "object")).alias("hint")).filter("hint is not null").distinct()
    ends = cut(ends.select("key", "hint", F.lower("hint").alias("needle"), T.normalise("hint").alias("norm")), "ends")
    hits = cut(fragment_hits(ends.select("needle").distinct(), claim_nodes), "fragments")
    first = hits.groupBy("needle").agg(F.min(F.struct("doc_id", "pos", "claim_id")).alias("f")).select("needle", F.col("f.claim_id").alias("quoted"))
    same = hits.groupBy("needle", F.col("home").alias("key")).agg(F.min(F.struct("pos", "claim_id")).alias("f")).select("needle", "key", F.col("f.claim_id").alias("quoted_here"))
    here = said.filter("entity_id is not null").join(claim_nodes.select("claim_id", F.col("home").alias("key")), ["claim_id", "key"])
    here = here.groupBy("key", "entity_id").agg(F.min(F.struct("pos", "claim_id")).alias("f")).select("key", "entity_id", F.col("f.claim_id").alias("mentioning"))
    out = ends.join(ids.select(F.col("id").alias("hint"), F.col("id").alias("own")), "hint", "left")
    out = out.join(same, ["needle", "key"], "left").join(first, "needle", "left").join(known.filter("entity_id is not null").select("norm", "entity_id"), "norm", "left").join(here, ["key", "entity_id"], "left")
    out = out.select("key", "hint", F.coalesce("own", "quoted_here", "quoted", "mentioning", "entity_id").alias("id")).join(ids, "id", "left")
    out = cut(out, "ends")
    end = lambda hint, to, kind: out.select("key", F.col("hint").alias(hint), F.col("id").alias(to), F.col("node_type").alias(kind))
    both = rows.join(end("subject", "src", "st"), ["key", "subject"], "left").join(end("object", "dst", "dt"), ["key", "object"], "left")
    legal = F.coalesce(typed.legal("relation", "st", "dt") & (F.col("src") != F.col("dst")), F.lit(False))
    return both.select("key", "nth", "src", "relation", "dst", legal.alias("legal"), F.coalesce(F.col("relation").isin(*EDGE_TYPES), F.lit(False)).alias("known"))


def _docs(spark, d):
    return document_rows(spark, d)


def chunk_spans(spark, d):
    return spans(_docs(spark, d)).select("key", "pos", "start", "end_", F.sha1("sentence").alias("digest"))


def assertive_spans(spark, d):
    return claims(spans(_docs(spark, d))).select("key", "pos", "claim_id")


def token_counts(spark, d):
    return _docs(spark, d).filter("text is not null").select("key", F.size(T.tokens("text")).cast("long").alias("n"), F.size(F.array_distinct(T.tokens("text"))).cast("long").alias("n_distinct"), T.text_tokens("text").alias("cost"))


def normalise_names(spark, d):
    n = declared(_docs(spark, d)).select("name", "norm").distinct()
    return n.select("name", "norm", T.acronym("norm").alias("acronym"), F.array_join(F.array_sort(T.block_keys("norm")), ",").alias("block_keys"))


def _names(spark, d):
    names = cut(declared(_docs(spark, d)), "declared")
    return names, Registry(table(spark, d, "canonical")), names.select("norm").distinct()


def block_candidates(spark, d):
    names, reg, norms = _names(spark, d)
    return reg.candidates(norms).select("norm", "entity_id", F.round("score", 6).alias("score"))


def resolve_names(spark, d):
    names, reg, norms = _names(spark, d)
    return reg.resolve(norms).select("norm", "entity_id", F.round("score", 6).alias("score"), "reason")


def unresolved_names(spark, d):
    """Distinct unresolved names with their first attempt, and whether they came close."""
    names, reg, norms = _names(spark, d)
    first = names.groupBy("norm").agg(F.min(F.struct("doc_id", "pos", "name")).alias("f"), F.count("*").alias("attempts"))
    bad = reg.resolve(norms).filter("entity_id is null")
    return first.join(bad, "norm").select("norm", F.col("f.name").alias("first_name"), "attempts", (F.col("score") >= BORDERLINE).alias("borderline"))


def collapsed_forms(spark, d):
    """Distinct surface forms that fold into each entity."""
    names, reg, norms = _names(spark, d)
    hit = names.join(reg.resolve(norms).filter("entity_id is not null"), "norm")
    return hit.groupBy("entity_id").agg(F.countDistinct("name").alias("forms"), (F.countDistinct("name") - 1).alias("folded"), F.count("*").alias("resolved"))


def collapsed_names(spark, d):
    """The surface forms that fold into each entity, one row each, with how often each was said."""
    names, reg, norms = _names(spark, d)
    hit = names.join(reg.resolve(norms).filter("entity_id is not null"), "norm")
    return hit.groupBy("entity_id", "name").agg(F.count("*").alias("said"))


def feature_buckets(spark, d):
    """Sparse unit vectors of assumption labels."""
    n = node_rows(spark, d).filter("node_type = 'assumption'").select("id", "label")
    return vectors.embed(n, "id", "label").select("id", "bucket", F.round("w", 6).alias("w"))


def cosine_pairs(spark, d):
    """Cosines of canonical labels (a fixed list) with assumption labels, where above 0.2."""
    a = vectors.embed(table(spark, d, "canonical").select("entity_id", "label"), "entity_id", "label")
    b = vectors.embed(node_rows(spark, d).filter("node_type = 'assumption'").select("id", "label"), "id", "label")
    return vectors.cosines(a, b, "entity_id", "id").filter("cosine > 0.2").select("entity_id", "id", F.round("cosine", 5).alias("cosine"))


def text_build_links(spark, d):
    return build(_docs(spark, d), table(spark, d, "canonical"))["links"]


def stage_report(spark, d):
    return build(_docs(spark, d), table(spark, d, "canonical"))["report"]


def relation_hints(spark, d):
    return build(_docs(spark, d), table(spark, d, "canonical"))["hints"]


_CL = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
DOCS = "dd AS (SELECT * FROM (SELECT *, coalesce(source_key, 'source:doc-' || doc_id) AS key, row_number() OVER (PARTITION BY coalesce(source_key, 'source:doc-' || doc_id) ORDER BY doc_id) AS rn FROM documents WHERE doc_id IS NOT NULL) WHERE rn = 1)"
_SENT = T.SENTENCE.replace(T.WS, O.WS).replace(r"\z", "$")
SPANS = f"""sp0 AS (SELECT key, doc_id, unnest(regexp_extract_all({O.strip('text')}, '{_SENT}')) AS piece, generate_subscripts(regexp_extract_all({O.strip('text')}, '{_SENT}'), 1) - 1 AS pos FROM dd WHERE length({O.strip('text')}) > 0),
sp AS (SELECT key, pos::BIGINT AS pos, coalesce(sum(length(piece)) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, regexp_replace(piece, '{O.WS}+$', '') AS sentence FROM sp0)"""


def _norm(x: str) -> str:
    low = f"regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g')"
    return f"array_to_string(list_filter(string_split_regex(regexp_replace({low}, '\\b({'|'.join(T.LEGAL_FORMS)})\\b', ' ', 'g'), ' +'), lambda w: w <> '' AND NOT list_contains({O.words(T.ARTICLES)}, w)), ' ')"


_W = "list_filter(string_split({0}, ' '), lambda w: w <> '')".format
_ACR = "CASE WHEN len({1}) > 1 THEN array_to_string(list_transform({1}, lambda t: t[1]), '') ELSE '' END"


def _acr(x: str) -> str:
    return _ACR.format(x, _W(x))


def _keys(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE list_distinct(list_filter([substring({_W(x)}[1], 1, 4), substring({_W(x)}[-1], 1, 4), substring({_acr(x)}, 1, 4), CASE WHEN length({x}) >= 4 THEN substring(replace({x}, ' ', ''), 1, 4) ELSE '' END], lambda k: k <> '')) END"


def _sim(a: str, b: str) -> str:
    wa, wb = f"list_distinct({_W(a)})", f"list_distinct({_W(b)})"
    both = f"len(list_intersect({wa}, {wb}))"
    small = f"CASE WHEN len({wa}) <= len({wb}) THEN {wa} ELSE {wb} END"
    dist = f"(length(({small})[1]) >= 7 AND NOT list_contains({O.words(T.GENERIC)}, ({small})[1]))"
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN replace({a}, ' ', '') = replace({b}, ' ', '') THEN 0.95 ELSE greatest({both}::DOUBLE / len(list_distinct(list_concat({wa}, {wb}))),
 CASE WHEN {both} = least(len({wa}), len({wb})) AND (len({small}) >= 2 OR {dist}) THEN 0.85 ELSE 0.0 END, CASE WHEN {a} = {_acr(b)} OR {b} = {_acr(a)} THEN 0.9 ELSE 0.0 END) END"""


NAMES = f"""nm0 AS (SELECT key, doc_id, unnest(entities) AS name, generate_subscripts(entities, 1) - 1 AS pos FROM dd),
nm AS (SELECT *, {_norm('name')} AS norm FROM nm0 WHERE name IS NOT NULL),
cn0 AS (SELECT entity_id, ord, label, unnest(list_concat([label], coalesce(aliases, []))) AS name, generate_subscripts(list_concat([label], coalesce(aliases, [])), 1) AS nth FROM canonical),
cn AS (SELECT *, {_norm('name')} AS norm FROM cn0 WHERE name IS NOT NULL AND {_norm('name')} <> ''),
al AS (SELECT norm, arg_max(entity_id, ord * 1000 + nth) AS entity_id FROM cn GROUP BY norm),
bl AS (SELECT DISTINCT entity_id, unnest({_keys('norm')}) AS k FROM cn),
lb AS (SELECT entity_id, {_norm('label')} AS ln FROM canonical),
q AS (SELECT DISTINCT norm FROM nm),
ca0 AS (SELECT DISTINCT qq.norm, bl.entity_id FROM (SELECT norm, unnest({_keys('norm')}) AS k FROM q WHERE norm <> '' AND norm NOT IN (SELECT norm FROM al)) qq JOIN bl ON bl.k = qq.k),
ca AS (SELECT norm, entity_id, {_sim('norm', 'ln')} AS score FROM ca0 JOIN lb USING (entity_id)),
be AS (SELECT norm, entity_id, score FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, entity_id) AS rn FROM ca WHERE score > 0) WHERE rn = 1),
rs AS (SELECT norm, entity_id, 1.0::DOUBLE AS score, 'alias table' AS reason FROM q JOIN al USING (norm) UNION ALL
  SELECT q.norm, CASE WHEN score >= {THRESHOLD} THEN entity_id END, coalesce(score, 0.0), CASE WHEN q.norm = '' THEN 'empty after normalisation' WHEN score IS NULL THEN 'no candidate' WHEN score >= {THRESHOLD} THEN 'scored match' ELSE 'below threshold' END
  FROM q LEFT JOIN be USING (norm) WHERE q.norm NOT IN (SELECT norm FROM al))"""


def _embed(rows: str, key: str, out: str) -> str:
    toks = f"list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda t: NOT list_contains({_CL}, t))"
    return f"""{out}w AS (SELECT {key} AS key, unnest({toks}) AS t FROM {rows}),
{out}f AS (SELECT key, 'w:' || t AS f, 1.0::DOUBLE AS w FROM {out}w UNION ALL SELECT key, 't:' || unnest(list_transform(range(1, length(t) + 1), lambda i: substring('^' || t || '$', i, 3))), 0.25 FROM {out}w),
{out}s AS (SELECT key, ('0x' || substring(md5(f), 1, 8))::BIGINT % 512 AS bucket, sum(w) AS w FROM {out}f GROUP BY ALL),
{out} AS (SELECT key, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM {out}s)"""


QUERIES = {f.__name__: f for f in (chunk_spans, assertive_spans, token_counts, normalise_names, block_candidates, resolve_names, unresolved_names, collapsed_forms, collapsed_names, feature_buckets, cosine_pairs, text_build_links, stage_report, relation_hints)}
_SLUG = "CASE WHEN b = '' THEN 'claim:' || d ELSE 'claim:' || b || '-' || d END"
SQL = {
    "chunk_spans": O.with_(DOCS, SPANS) + "SELECT key, pos, start, start + length(sentence) AS end_, sha1(sentence) AS digest FROM sp",
    "assertive_spans": O.with_(DOCS, SPANS) + f"""SELECT key, pos, {_SLUG} AS claim_id FROM (SELECT key, pos, substring(sha1(sentence), 1, 6) AS d, substring(regexp_replace(regexp_replace(lower(sentence), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS b FROM sp
 WHERE regexp_matches(lower(sentence), '{T.ASSERTIVE}') AND len(list_filter(string_split_regex(sentence, '{O.WS}+'), lambda w: w <> '')) >= {T.MIN_WORDS})""",
    "token_counts": O.with_(DOCS) + f"SELECT key, len(t) AS n, len(list_distinct(t)) AS n_distinct, (floor(len(list_filter(string_split_regex(text, '{O.WS}+'), lambda w: w <> '')) * 1.3) + 8)::BIGINT AS cost FROM (SELECT key, text, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains({_CL}, t)) AS t FROM dd WHERE text IS NOT NULL)",
    "normalise_names": O.with_(DOCS, NAMES) + f"SELECT DISTINCT name, norm, {_acr('norm')} AS acronym, array_to_string(list_sort({_keys('norm')}), ',') AS block_keys FROM nm",
    "block_candidates": O.with_(DOCS, NAMES) + "SELECT norm, entity_id, round(score, 6) AS score FROM ca",
    "resolve_names": O.with_(DOCS, NAMES) + "SELECT norm, entity_id, round(score, 6) AS score, reason FROM rs",
    "unresolved_names": O.with_(DOCS, NAMES) + f"SELECT norm, arg_min(name, doc_id * 100000 + pos) AS first_name, count(*) AS attempts, any_value(score) >= {BORDERLINE} AS borderline FROM nm JOIN rs USING (norm) WHERE entity_id IS NULL GROUP BY norm",
    "collapsed_names": O.with_(DOCS, NAMES) + "SELECT entity_id, name, count(*) AS said FROM nm JOIN rs USING (norm) WHERE entity_id IS NOT NULL GROUP BY ALL",
    "collapsed_forms": O.with_(DOCS, NAMES) + "SELECT entity_id, count(DISTINCT name) AS forms, count(DISTINCT name) - 1 AS folded, count(*) AS resolved FROM nm JOIN rs USING (norm) WHERE entity_id IS NOT NULL GROUP BY entity_id",
    "feature_buckets": O.with_(O.NODES, "l AS (SELECT id, label FROM n WHERE node_type = 'assumption')", _embed("l", "id", "v")) + "SELECT key AS id, bucket, round(w, 6) AS w FROM v",
    "cosine_pairs": O.with_(O.NODES, "l AS (SELECT id, label FROM n WHERE node_type = 'assumption')", _embed("l", "id", "v"), _embed("canonical", "entity_id", "u")) + "SELECT u.key AS entity_id, v.key AS id, round(sum(u.w * v.w), 5) AS cosine FROM u JOIN v USING (bucket) GROUP BY ALL HAVING sum(u.w * v.w) > 0.2",
}
