"""Questions answered by cost-ordered walks, a batch at a time.

Walks on a frozen graph don't influence each other, so a batch of questions is one job keyed by walk_id. The cost order of a priority queue, ties included, is
kept by a comparable label per (walk, node): cost, then the costs and the expansion order from the node back to its seed. Each round joins the labels with the
steps and keeps the least label of each node; the fixpoint, sorted by label, is the order in which a queue would settle the nodes. Labels below rank
2 * MAX_EXPAND can't settle within MAX_EXPAND and are dropped from the frontier between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.functions import vectors
from lattica.functions.numbers import round_exact
from lattica.operators import typed
from lattica.operators.build import Registry
from lattica.schema import ANSWERING, FOLLOWED
from lattica.session import cut, discard, table
from lattica.sources.graph import edge_rows, node_rows

BUDGET, MAX_EXPAND, ANSWER_FLOOR, VECTOR_FLOOR, FLAT_K, TAIL = 6, 260, 0.18, 0.45, 40, 3


def seeds(questions: DataFrame, nodes: DataFrame, reg: Registry) -> tuple[DataFrame, DataFrame]:
    """questions: (walk_id, question). (seeds: walk_id, node, pos; failures: walk_id, dead_end). Entities named in the question come first; where none
    resolves, the live node with most shared words (two at least, first in node order), then the nearest vector that shares a word."""
    said = questions.select("walk_id", F.posexplode(T.question_mentions("question")).alias("pos", "mention")).withColumn("norm", T.normalise("mention"))
    said = cut(said, "asked")
    hit = said.join(reg.resolve(said.select("norm").distinct()).filter("entity_id is not null"), "norm").join(nodes.select(F.col("id").alias("entity_id"), "live"), "entity_id")
    hit = cut(hit.groupBy("walk_id", F.col("entity_id").alias("node")).agg(F.min("pos").alias("pos"), F.first("live").alias("live")), "hit")
    named = hit.filter("live")
    pruned = hit.join(named.select("walk_id"), "walk_id", "left_anti").select("walk_id").distinct()
    rest = questions.join(hit.select("walk_id"), "walk_id", "left_anti")
    words = rest.select("walk_id", F.explode(F.array_distinct(T.tokens("question"))).alias("t"))
    label_words = nodes.filter("live and node_type != 'assumption'").select("id", "ord", "node_type", F.explode(F.array_distinct(T.tokens("label"))).alias("t"))
    shared = cut(words.join(label_words, "t").groupBy("walk_id", "id", "ord", "node_type").agg(F.count("*").alias("n")), "shared")
    lexical = shared.filter("n >= 2").groupBy("walk_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "ord", "id")).alias("m")).select("walk_id", F.col("m.id").alias("node"), F.lit(0).alias("pos"))
    near = shared.filter("node_type in ('entity', 'claim', 'decision')").join(lexical, "walk_id", "left_anti").select("walk_id", "id")
    qv = vectors.embed(rest, "walk_id", "question")
    nv = vectors.embed(nodes.join(near.select("id").distinct(), "id", "left_semi").select("id", "ord", F.concat_ws(" ", "label", F.coalesce("rationale", F.lit(""))).alias("text")), "id", "text")
    score = near.join(qv, "walk_id").join(nv.withColumnRenamed("w", "wn"), ["id", "bucket"]).groupBy("walk_id", "id").agg(F.sum(F.col("w") * F.col("wn")).alias("score")).filter(F.col("score") >= VECTOR_FLOOR)
    vector = score.groupBy("walk_id").agg(F.min(F.struct((-F.col("score")).alias("k"), "id")).alias("m")).select("walk_id", F.col("m.id").alias("node"), F.lit(0).alias("pos"))
    got = cut(named.select("walk_id", "node", "pos").unionByName(lexical).unionByName(vector), "seeds")
    lost = questions.select("walk_id").join(got.select("walk_id"), "walk_id", "left_anti").join(pruned, "walk_id", "left_anti").select("walk_id", F.lit("entity_unresolved").alias("dead_end"))
    return got, lost.unionByName(pruned.select("walk_id", F.lit("pruned_too_early").alias("dead_end")))


def settle(start: DataFrame, steps: DataFrame, budget: int = BUDGET, most: int = MAX_EXPAND) -> DataFrame:
    """start: (walk_id, node, pos). (walk_id, node, rank, cost, hops, path, types, sides): nodes in the order a queue settles them, at most `most`; sides has 1 where a step of the path goes
    against its edge. Rounds end when the labels' checksum stays; if it never does the walk fails."""
    base = start.select("walk_id", "node", F.struct(F.lit(0.0).alias("cost"), F.array(F.lit(0.0)).alias("costs"), F.array(F.struct(F.lit(0).alias("side"), F.col("pos").cast("long").alias("ord"))).alias("trail"), F.array("node").alias("path"), F.array().cast("array<string>").alias("types")).alias("label"))
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("walk_id", "node", "label.path"))).first()
    base = cut(base.withColumn("bound", F.lit(float("inf"))), "base")
    order, whole = Window.partitionBy("walk_id").orderBy("label"), Window.partitionBy("walk_id")
    state, was = base, None
    for _ in range(4 * budget):
        # a step that costs more than the last label kept can't bring a better one
        go = state.filter(F.size("label.path") <= budget).join(steps, "node").filter(F.col("label.cost") + F.col("cost") <= F.col("bound"))
        far = go.filter(~F.array_contains("label.path", F.col("nxt"))).select("walk_id", F.col("nxt").alias("node"), F.struct(
            (F.col("label.cost") + F.col("cost")).alias("cost"), F.concat(F.array(F.col("label.cost") + F.col("cost")), "label.costs").alias("costs"), F.concat("label.trail", F.array("exp")).alias("trail"),
            F.concat("label.path", F.array("nxt")).alias("path"), F.concat("label.types", F.array("edge_type")).alias("types")).alias("label"))
        new = base.drop("bound").unionByName(far).groupBy("walk_id", "node").agg(F.min("label").alias("label"))
        new = new.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * most)
        new = new.withColumn("bound", F.when(F.max("r").over(whole) == 2 * most, F.max("label.cost").over(whole)).otherwise(float("inf"))).drop("r")
        new = cut(new, "state")
        if state is not base:
            discard(state)
        state, now = new, mark(new)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"labels still change after {4 * budget} rounds")
    out = state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return out.select("walk_id", "node", "rank", F.col("label.cost").alias("cost"), (F.size("label.path") - 1).alias("hops"), F.col("label.path").alias("path"), F.col("label.types").alias("types"), F.transform(F.slice("label.trail", F.lit(2), F.size("label.trail")), lambda x: x["side"]).alias("sides"))


def relevance(settled: DataFrame, questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds score to the answering nodes: 0.45 cosine, 0.55 share of the question's words in the label, a little for decisions."""
    cand = settled.filter("hops >= 1").join(nodes.filter(F.col("node_type").isin(*ANSWERING)).select(F.col("id").alias("node"), "node_type", "label", F.concat_ws(" ", "label", F.coalesce("rationale", F.lit(""))).alias("text")), "node")
    cand = cut(cand, "cand")
    nv = vectors.embed(cand.select("node", "text").distinct(), "node", "text").withColumnRenamed("w", "wn")
    qv = vectors.embed(questions, "walk_id", "question")
    cos = cand.select("walk_id", "node").join(qv, "walk_id").join(nv, ["node", "bucket"]).groupBy("walk_id", "node").agg(F.sum(F.col("w") * F.col("wn")).alias("cosine"))
    q = questions.select("walk_id", F.array_distinct(T.tokens("question")).alias("qt"))
    lexical = F.when(F.size("qt") > 0, F.size(F.array_intersect("qt", T.tokens("label"))) / F.size("qt")).otherwise(0.0)
    full = cand.join(cos, ["walk_id", "node"], "left").join(q, "walk_id")
    return full.select("walk_id", "node", "rank", "cost", "hops", "path", "types", "sides", (0.45 * F.coalesce("cosine", F.lit(0.0)) + 0.55 * lexical + F.when(F.col("node_type") == "decision", 0.05).otherwise(0.0)).alias("score"))


def justify(chosen: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Up to three more hops from the answer to what justifies it: a decision's supporting claim, else its ground, else the first source of it."""
    e = typed.with_ends(edges.filter("live"), nodes)
    sup = e.filter("edge_type = 'supports' and slive and dt = 'decision'").select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0).alias("k"), "ord", "edge_type", F.col("st").alias("to_type"))
    dep = e.filter("edge_type = 'depends_on' and dlive and st = 'decision'").select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(1).alias("k"), "ord", "edge_type", F.col("dt").alias("to_type"))
    prov = e.filter("edge_type in ('derived_from', 'cites') and dlive").select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(2).alias("k"), "ord", "edge_type", F.col("dt").alias("to_type"))
    moves = cut(sup.unionByName(dep).unionByName(prov), "moves")
    state = chosen.withColumn("at", F.element_at("path", -1)).withColumn("done", F.lit(False))
    cols = ["walk_id", "node", "score", "cost", "path", "types", "sides", "at", "done"]
    state = state.select(*cols)
    for _ in range(TAIL):
        nxt = state.filter("not done").join(moves, "at").filter(~F.array_contains("path", F.col("to"))).groupBy("walk_id").agg(F.min(F.struct("k", "ord", "to", "edge_type", "to_type")).alias("m"))
        state = state.join(nxt, "walk_id", "left").select(
            "walk_id", "node", "score", "cost", F.when(F.col("m").isNull(), F.col("path")).otherwise(F.concat("path", F.array("m.to"))).alias("path"), F.when(F.col("m").isNull(), F.col("types")).otherwise(F.concat("types", F.array("m.edge_type"))).alias("types"),
            F.when(F.col("m").isNull(), F.col("sides")).otherwise(F.concat("sides", F.array((F.col("m.k") == 0).cast("int")))).alias("sides"),
            F.coalesce("m.to", "at").alias("at"), (F.col("m").isNull() | (F.col("m.to_type") == "source")).alias("done"))
        state = cut(state, "tail")
    return state


def cut_off(settled: DataFrame, steps: DataFrame, edges: DataFrame, nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(walk_id) of walks that settled, within the budget, a node from which no step leads on though a followed edge, dead or live, leads to a dead node."""
    dead = edges.filter(F.col("edge_type").isin(*FOLLOWED)).join(nodes.filter("not live").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return settled.filter(F.col("hops") < budget).join(dead.join(steps, "node", "left_anti"), "node", "left_semi").select("walk_id").distinct()


def rendered(paths: DataFrame, nodes: DataFrame, width: int = 74) -> DataFrame:
    """paths: (walk_id, path, types, sides). (walk_id, rendered): a line a step, each further in than the one before, with the edge and its direction, the node's type and its label, cut to the width."""
    steps = paths.select("walk_id", F.posexplode("path").alias("i", "id"), F.concat(F.array(F.lit(None).cast("string")), "types").alias("types"), F.concat(F.array(F.lit(0)), "sides").alias("sides"))
    steps = steps.select("walk_id", "i", "id", F.col("types")[F.col("i")].alias("t"), F.col("sides")[F.col("i")].alias("against")).join(nodes.select("id", "node_type", "label"), "id")
    arrow = F.when(F.col("t").isNull(), "").when(F.col("against") == 1, F.concat(F.lit("<-["), "t", F.lit("]- "))).otherwise(F.concat(F.lit("-["), "t", F.lit("]-> ")))
    label = F.coalesce("label", F.lit(""))
    label = F.when(F.length(label) > width, F.concat(F.substring(label, 1, width - 1), F.lit("…"))).otherwise(label)
    line = F.concat(F.repeat(F.lit("  "), F.col("i")), arrow, F.lit("("), "node_type", F.lit(") "), label)
    return steps.groupBy("walk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("rendered"))


def crossings(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, n): how often the answered walks crossed each edge, both ways counted."""
    steps = walks.filter("candidate_id is not null").select(F.explode(F.transform(F.sequence(F.lit(0), F.size("types") - 1), lambda i: F.struct(
        F.when(F.get("sides", i) == 1, F.get("path", i + 1)).otherwise(F.get("path", i)).alias("src"), F.get("types", i).alias("edge_type"), F.when(F.get("sides", i) == 1, F.get("path", i)).otherwise(F.get("path", i + 1)).alias("dst")))).alias("s")).select("s.*")
    return steps.join(edges.filter("live").select(F.col("id").alias("edge_id"), "src", "edge_type", "dst"), ["src", "edge_type", "dst"]).groupBy("edge_id").agg(F.count("*").alias("n"))


def credited(nodes: DataFrame, edges: DataFrame, walks: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a batch: walks of every node settled go up, failed walks included, and traversals of every edge that an answer's path crossed."""
    seen, crossed = visits.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("more")), crossings(walks, edges).select(F.col("edge_id").alias("id"), F.col("n").alias("more"))
    up = lambda df, by, c: df.join(by, "id", "left").withColumn(c, F.coalesce(c, F.lit(0)) + F.coalesce("more", F.lit(0))).select(*df.columns)
    return up(nodes, seen, "walks"), up(edges, crossed, "traversals")


def ask(questions: DataFrame, nodes: DataFrame, edges: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(walks: walk_id, question, answer_id, candidate_id, score, cost, hops, visited, dead_end, path, types, sides, rendered, tokens_walked, tokens_flat; visits: walk_id, node, rank).
    A walk that met only nodes which don't answer has the path to the first of them."""
    questions = cut(questions, "questions")
    nodes, edges = cut(nodes, "nodes"), cut(edges, "edges")
    steps = cut(typed.step_costs(edges, nodes), "steps")
    start, failed = seeds(questions, nodes, Registry(canonical))
    settled = cut(settle(start, steps), "settled")
    scored = cut(relevance(settled, questions, nodes), "scored")
    good = scored.filter(F.col("score") >= ANSWER_FLOOR)
    pick = good.withColumn("s", round_exact("score", 2)).groupBy("walk_id").agg(F.max(F.struct(F.col("s"), F.size(F.array_distinct("types")).alias("n"), (-F.col("cost")).alias("c"), (-F.col("rank")).alias("r"), "node", "score", "cost", "path", "types", "sides")).alias("m")).select("walk_id", "m.node", "m.score", "m.cost", "m.path", "m.types", "m.sides")
    full = cut(justify(pick, edges, nodes), "full")
    kinds = full.select("walk_id", F.posexplode("path").alias("i", "id")).join(nodes.select("id", "node_type", "label"), "id")
    answer = kinds.groupBy("walk_id").agg(F.max(F.when(F.col("node_type").isin(*ANSWERING), F.struct("i", "id"))).alias("a"), F.sum(T.text_tokens("label")).alias("tokens_walked"))
    visited = settled.groupBy("walk_id").agg(F.count("*").alias("visited"))
    pruned = cut_off(settled, steps, edges, nodes).withColumn("saw_pruned", F.lit(True))
    miss = scored.join(good.select("walk_id"), "walk_id", "left_anti").groupBy("walk_id").agg(F.min_by(F.struct("path", "types", "sides"), "rank").alias("near"))
    out = questions.join(visited, "walk_id", "left").join(pruned, "walk_id", "left").join(full.select("walk_id", F.col("node").alias("candidate_id"), "score", "cost", "path", "types", "sides"), "walk_id", "left")
    out = out.join(answer, "walk_id", "left").join(failed.withColumnRenamed("dead_end", "early"), "walk_id", "left").join(miss, "walk_id", "left").join(flat_costs(questions, nodes), "walk_id", "left")
    dead = F.when(F.col("candidate_id").isNotNull(), None).when(F.col("early").isNotNull(), F.col("early")).when(F.coalesce("saw_pruned", F.lit(False)), "pruned_too_early").when(F.col("near").isNotNull(), "wrong_node_type").otherwise("no_typed_edge")
    out = out.withColumn("dead_end", dead)
    shown = lambda c: F.when(F.col("candidate_id").isNotNull(), F.col(c)).when(F.col("dead_end") == "wrong_node_type", F.col(f"near.{c}")).alias(c)
    out = out.select("*", *(shown(c).alias(f"{c}_") for c in ("path", "types", "sides"))).drop("path", "types", "sides").withColumnsRenamed({f"{c}_": c for c in ("path", "types", "sides")})
    out = cut(out, "out")
    out = out.join(rendered(out.filter("path is not null"), nodes), "walk_id", "left")
    zero = F.lit(0).cast("long")
    walks = out.select(
        "walk_id", "question", F.col("a.id").alias("answer_id"), "candidate_id", "score", "cost", (F.size("path") - 1).cast("long").alias("hops"), F.coalesce("visited", zero).alias("visited"), "dead_end",
        "path", "types", "sides", "rendered", F.coalesce("tokens_walked", zero).alias("tokens_walked"), F.coalesce("tokens_flat", zero).alias("tokens_flat"))
    return cut(walks, "walks"), settled.select("walk_id", "node", "rank")


def flat_costs(questions: DataFrame, nodes: DataFrame, k: int = FLAT_K) -> DataFrame:
    """(walk_id, tokens_flat): what flat retrieval of k passages would cost, k consecutive live claims from an offset given by the question's hash.
    Prefix sums over the densely numbered claims turn each window into two look-ups."""
    live = cut(typed.dense_index(nodes.filter("live and node_type = 'claim'").select("id", "ord", (T.text_tokens("label") + 160).alias("t")), "ord", "id"), "claims")
    n = live.count()
    if not n:
        return questions.select("walk_id", F.lit(0).cast("long").alias("tokens_flat"))
    offset = F.conv(F.substring(F.md5("question"), 1, 8), 16, 10).cast("long") % n
    want = questions.select("walk_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(k, n) - 1)), lambda i: (offset + i) % n)).alias("idx"))
    return want.join(live, "idx").groupBy("walk_id").agg(F.sum("t").alias("tokens_flat"))


def entity_questions(spark, d) -> DataFrame:
    """The stated question set: one question for each entry of the canonical list, which is fixed in size."""
    return table(spark, d, "canonical").select(F.col("ord").alias("walk_id"), F.concat(F.lit("What is known about "), "label", F.lit("?")).alias("question"))


def _walks(spark, d):
    return ask(entity_questions(spark, d), node_rows(spark, d), edge_rows(spark, d), table(spark, d, "canonical"))


def batch_walk(spark, d):
    w = _walks(spark, d)[0]
    return w.select("walk_id", "answer_id", "candidate_id", F.round("score", 3).alias("score"), F.round("cost", 3).alias("cost"), "hops", "visited", "dead_end", F.array_join("path", " > ").alias("path"), "tokens_walked", "tokens_flat")


def walk_visits(spark, d):
    """How often each node was settled, failed walks included."""
    return _walks(spark, d)[1].groupBy("node").agg(F.count("*").alias("n"))


def walk_paths(spark, d):
    """The path of each walk as it is read: answers with what justifies them, near misses up to the node that didn't answer."""
    return _walks(spark, d)[0].filter("path is not null").select("walk_id", "dead_end", "hops", "rendered")


def walk_credit(spark, d):
    """How often the answers' paths crossed each edge."""
    return crossings(_walks(spark, d)[0], edge_rows(spark, d))


def question_seeds(spark, d):
    s, failed = seeds(cut(entity_questions(spark, d), "q"), node_rows(spark, d), Registry(table(spark, d, "canonical")))
    return s.select("walk_id", F.col("node").alias("seed"), F.lit(None).cast("string").alias("dead_end")).unionByName(failed.select("walk_id", F.lit(None).cast("string").alias("seed"), "dead_end"))


def flat_cost(spark, d):
    return flat_costs(entity_questions(spark, d), node_rows(spark, d))


from lattica import oracle as O  # noqa: E402

_N, _E = O.NODES, O.EDGES
_LEN = f"(floor(len(list_filter(string_split_regex(label, '{O.WS}+'), lambda w: w <> '')) * 1.3) + 8 + 160)::BIGINT"
QUERIES = {"question_seeds": question_seeds, "batch_walk": batch_walk, "walk_visits": walk_visits, "walk_paths": walk_paths, "walk_credit": walk_credit, "flat_cost": flat_cost}
SQL = {
    "flat_cost": O.with_(_N, f"c AS (SELECT row_number() OVER (ORDER BY ord, id) - 1 AS idx, {_LEN} AS t FROM n WHERE live AND node_type = 'claim')", "k AS (SELECT count(*) AS n FROM c)",
        "q AS (SELECT ord AS walk_id, ('0x' || substring(md5('What is known about ' || label || '?'), 1, 8))::BIGINT AS h FROM canonical)", "w AS (SELECT walk_id, (h % n + unnest(range(least(40, n)))) % n AS idx FROM q, k)")
    + "SELECT walk_id, sum(t)::BIGINT AS tokens_flat FROM w JOIN c USING (idx) GROUP BY walk_id",
}
