"""Parent-child links to full hierarchies.

Forests (at most one parent a node) become nested sets: subtree sizes are summed upward, every node is given a preorder range below its parent by
prefix sums over its siblings, and the ranges answer all else: a node's depth is the number of ranges open at its place, its root the last one to open
whose range is nobody's child, its descendants the places within its range, its path the ranges around its place. Both passes double their stride (a
node looks 1, 2, 4 ... steps up), so a tree of depth d takes about log2(d) rounds. Nodes that no round finishes lie on a cycle or hang below one.

Graphs with several parents a node (task needs) are made of trees too: nodes with one parent hang below the first ancestor that has none or several, their head.
The trees are nested as above; what is left are the heads with several parents, joined by weighted edges (steps up a tree to the next head). On them the
fewest steps to each root are found, and heads from which an endless walk upward is possible: a group of heads that is known to be apart from the
others and has at most GROUP edges in one pass within a task, all others in rounds over tables, whose strides double.

No step collects rows; all state between rounds is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut, discard, table

CYCLE = "cycle"
#: Siblings are put into blocks of about this many, so that no parent's children meet in one task; places of a block of the preorder.
SIBLINGS, PLACES = 50_000, 65_536
#: Doublings of the hop relation of a graph with several parents; a round then covers 2 ** STRIDE hops.
STRIDE = 4
#: Edges between heads that are solved within a task; edges, as a multiple of the first, up to which they are joined with themselves.
GROUP, GROWTH = 100_000, 8


def folded(c: Column | str) -> Column:
    """The form in which ids and names are compared: blanks and line ends around and case don't count."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", ""))


def _sizes(base: DataFrame) -> DataFrame:
    """(key, anc, n): n nodes in the subtree of key; anc is null but for nodes on or below a cycle."""

    def lift(state: DataFrame) -> DataFrame:
        # n counts the descendants fewer than 2**k steps below, anc is 2**k steps above; a finished node has no anc
        busy, done = state.filter(F.col("anc").isNotNull()), state.filter(F.col("anc").isNull())
        below = busy.groupBy(F.col("anc").alias("key")).agg(F.sum("n").alias("more"))
        above = state.select(F.col("key").alias("anc"), F.col("anc").alias("next"))
        new = busy.join(above, "anc").select("key", F.col("next").alias("anc"), "n").unionByName(done)
        return new.join(below, "key", "left").select("key", "anc", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))

    state = base.select("key", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("n"))
    left = state.filter(F.col("anc").isNotNull()).count()
    while left:
        new = cut(lift(lift(state)), "up")
        discard(state)
        state, before = new, left
        left = state.filter(F.col("anc").isNotNull()).count()
        if left == before:  # only cycles are left
            break
    return state


def _offsets(tree: DataFrame) -> DataFrame:
    """tree: (key, parent, n). (key, anc, pre): pre is the place below the parent's, or in all for roots; prefix sums within a block of siblings, plus those of the blocks before."""
    kids = tree.select("key", F.col("parent").alias("anc"), "n", F.coalesce("parent", F.lit("")).alias("p"), F.col("parent").isNull().alias("top"))
    fan = kids.groupBy("p", "top").agg(F.ceil(F.count("*") / SIBLINGS).alias("blocks"))
    kids = kids.join(fan, ["p", "top"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    blocks = kids.groupBy("p", "top", "block").agg(F.sum("n").alias("bn"))
    w = Window.partitionBy("p", "top").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("p", "top", "block", F.coalesce(F.sum("bn").over(w), F.lit(0)).alias("skip"))
    w = Window.partitionBy("p", "top", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    kids = kids.withColumn("off", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return kids.join(blocks, ["p", "top", "block"]).select("key", "anc", (F.col("off") + F.col("skip") + F.when(F.col("top"), 0).otherwise(1)).alias("pre"))


def _places(tree: DataFrame) -> DataFrame:
    """(key, pre): places in the preorder of all trees, offsets summed over strides that double until each has ended at a root."""
    place = cut(_offsets(tree), "down")
    while not place.filter(F.col("anc").isNotNull()).isEmpty():
        new = place
        for _ in range(2):
            busy, done = new.filter(F.col("anc").isNotNull()), new.filter(F.col("anc").isNull())
            above = new.select(F.col("key").alias("anc"), F.col("anc").alias("next"), F.col("pre").alias("more"))
            new = busy.join(above, "anc").select("key", F.col("next").alias("anc"), (F.col("pre") + F.col("more")).alias("pre")).unionByName(done)
        new = cut(new, "down")
        discard(place)
        place = new
    return place.select("key", "pre")


def _swept(ranges: DataFrame) -> DataFrame:
    """ranges: (key, parent, n, pre). Adds depth and top, the place of the root: a sweep over the places in blocks, where a range adds one at its start and takes it off past its end. What
    a block begins with comes from the sums of the blocks before, one row a block."""
    starts = ranges.select(F.col("pre").alias("q"), F.lit(1).cast("long").alias("d"), F.when(F.col("parent").isNull(), F.col("pre")).alias("t"), "key", "parent", "n")
    ends = ranges.groupBy((F.col("pre") + F.col("n")).alias("q")).agg((-F.count("*")).alias("d"))
    rows = starts.unionByName(ends, allowMissingColumns=True).withColumn("b", F.floor(F.col("q") / PLACES))
    by, upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("b").orderBy("q").rangeBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("b").agg(F.sum("d").alias("bd"), F.max("t").alias("bt")).select("b", F.coalesce(F.sum("bd").over(by), F.lit(0)).alias("d0"), F.max("bt").over(by).alias("t0"))
    rows = rows.withColumn("run", F.sum("d").over(upto)).withColumn("last", F.max("t").over(upto)).filter(F.col("key").isNotNull())
    return rows.join(blocks, "b").select("key", "parent", "n", F.col("q").alias("pre"), (F.col("run") + F.col("d0") - 1).alias("depth"), F.coalesce("last", "t0").alias("top"))


def forest(links: DataFrame) -> DataFrame:
    """links: (key string, parent string), key unique and not null, parent null for roots or naming a key.

    Returns one row per key: key, parent, root, depth, size (of its subtree, itself included), pre (its
    preorder number within its root's tree; siblings follow each other by block and key). Keys on a cycle, or below one, have root 'cycle', depth -1 and null
    size and pre. An empty table gives an empty table. A parent that names no key counts as none.
    """
    known = links.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    base = links.select("key", "parent").join(known, "parent", "left").select("key", F.when(F.col("known"), F.col("parent")).alias("parent"))
    base = cut(base, "forest")
    sizes = _sizes(base)
    sized = cut(base.join(sizes, "key").select("key", "parent", "n", F.col("anc").isNotNull().alias("looped")), "sized")
    discard(sizes)
    tree = sized.filter(~F.col("looped"))
    swept = cut(_swept(tree.join(_places(tree), "key")), "swept")
    names = swept.filter(F.col("parent").isNull()).select(F.col("pre").alias("top"), F.col("key").alias("root"))
    done = swept.join(names, "top").select("key", "parent", "root", "depth", F.col("n").alias("size"), (F.col("pre") - F.col("top")).alias("pre"))
    null = F.lit(None).cast("long")
    looped = sized.filter("looped").select("key", "parent", F.lit(CYCLE).alias("root"), F.lit(-1).cast("long").alias("depth"), null.alias("size"), null.alias("pre"))
    return done.unionByName(looped)


def descendants(nested: DataFrame, of: DataFrame) -> DataFrame:
    """of: (key). Rows (key, descendant, steps) from the nested-set ranges: same root, pre within the key's range.
    A range is looked up in blocks of its own order of size, a power of four, so that it is compared with few places outside it; the longest are looked up in several blocks."""
    most = 8
    level = F.least(F.lit(most), F.ceil(F.log2(F.col("size").cast("double")) / 2).cast("int"))
    top = nested.join(of.select("key").distinct(), "key").filter(F.col("size") > 1).select("root", F.col("key").alias("k"), (F.col("pre") + 1).alias("lo"), (F.col("pre") + F.col("size") - 1).alias("hi"), F.col("depth").alias("d0"), level.alias("z"))
    block = lambda c, z: F.floor(F.col(c) / F.pow(F.lit(4.0), z)).cast("long")
    top = top.withColumn("b", F.explode(F.sequence(block("lo", F.col("z")), block("hi", F.col("z")))))
    low = nested.filter(F.col("pre").isNotNull()).select("root", F.col("key").alias("descendant"), "pre", "depth", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("z")).withColumn("b", block("pre", F.col("z")))
    hit = top.join(low, ["root", "z", "b"]).filter(F.col("pre").between(F.col("lo"), F.col("hi")))
    return hit.select(F.col("k").alias("key"), "descendant", (F.col("depth") - F.col("d0")).alias("steps"))


def paths(nested: DataFrame) -> DataFrame:
    """(key, path): the keys from the root down to the key, whose ranges hold its place; null for keys on or below a cycle. A path is as long as the key is deep."""
    above = descendants(nested, nested).select(F.col("descendant").alias("key"), F.struct((-F.col("steps")).alias("at"), F.col("key").alias("k")).alias("a"))
    above = above.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["k"]).alias("up"))
    full = F.concat(F.coalesce("up", F.array().cast("array<string>")), F.array("key"))
    return nested.join(above, "key", "left").select("key", F.when(F.col("depth") >= 0, full).alias("path"))


def several(needs: DataFrame) -> DataFrame:
    """(key, n, parent) of needs: how many parents a key has, and the least of them."""
    return needs.groupBy("key").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))


def head_links(keys: DataFrame, parents: DataFrame) -> DataFrame:
    """(key, parent) of the forest below the heads: keys with none or several parents are its roots."""
    return keys.select("key").join(parents, "key", "left").select("key", F.when(F.col("n") == 1, F.col("parent")).alias("parent"))


def _solve(edges: list[tuple[str, str, int]], inner: set[str]) -> list[tuple[str, str, int]]:
    """(key, head, w) edges of one group; inner are the heads with several parents. (key, root, fewest steps) rows, and (key, 'cycle', -1) for heads that can reach a cycle."""
    up: dict[str, list[tuple[str, int]]] = {}
    down: dict[str, list[str]] = {}
    for key, head, w in edges:
        up.setdefault(key, []).append((head, w))
        if head in inner:
            down.setdefault(head, []).append(key)
    open_ = {key: sum(h in inner or h == CYCLE for h, _ in ups) for key, ups in up.items()}
    ready, best = [key for key, n in open_.items() if not n], {}
    for key in ready:  # grows as heads above are done
        got: dict[str, int] = {}
        for head, w in up[key]:
            for root, d in best[head].items() if head in inner else ((head, 0),):
                got[root] = min(got.get(root, w + d), w + d)
        best[key] = got
        for below in down.get(key, ()):
            open_[below] -= 1
            if not open_[below]:
                ready.append(below)
    rows = [(key, root, d) for key, got in best.items() for root, d in got.items()]
    return rows + [(key, CYCLE, -1) for key in up if key not in best]


def _longest(edges: list[tuple[str, str, int]], inner: set[str]) -> list[tuple[str, str | None, int]]:
    """(key, null, layer) of the heads of one group, -1 where a cycle can be reached: the most steps to any root, w being the most from a head to the next."""
    up: dict[str, list[tuple[str, int]]] = {}
    down: dict[str, list[str]] = {}
    for key, head, w in edges:
        up.setdefault(key, []).append((head, w))
        if head in inner:
            down.setdefault(head, []).append(key)
    open_ = {key: sum(h in inner or h == CYCLE for h, _ in ups) for key, ups in up.items()}
    ready, layer = [key for key, n in open_.items() if not n], {}
    for key in ready:  # grows as heads above are done
        layer[key] = max(layer.get(h, 0) + w for h, w in up[key])
        for below in down.get(key, ()):
            open_[below] -= 1
            if not open_[below]:
                ready.append(below)
    return [(key, None, layer.get(key, -1)) for key in up]


def _solved(edges: DataFrame, solve=_solve) -> DataFrame:
    """edges: (g, key, head, w, inner) of groups that fit a task. Rows of solve; the groups of a batch are solved together, the last one with the next batch."""

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else held._append(batch, ignore_index=True)
            last = held["g"].iloc[-1] if len(held) else None
            whole = held["g"] != last
            yield rows(held[whole])
            held = held[~whole]
        if held is not None:
            yield rows(held)

    def rows(part):
        return type(part)(solve(list(zip(part["key"], part["head"], part["w"].tolist())), set(part["head"][part["inner"]])), columns=["key", "root", "depth"])

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.withColumn("g", F.coalesce("g", F.lit(""))).repartition(n, "g").sortWithinPartitions("g").mapInPandas(run, "key string, root string, depth long")


def _relaxed(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """The same for edges (key, head, w) of any number, in rounds over all of them: fewest steps are relaxed until nothing changes, and of the heads
    those stay alive that have an edge to one alive or to a cycle. Strides double each round while the edges don't grow beyond GROWTH times."""
    other = heads.select(F.col("key").alias("head"))
    best = edges.filter(F.col("head") != CYCLE).join(other, "head", "left_anti").select("key", F.col("head").alias("root"), F.col("w").alias("depth"))
    inner = edges.join(other, "head", "left_semi")
    alive, walk = heads, edges.select("key", "head").join(other.union(other.sparkSession.createDataFrame([(CYCLE,)], "head string")), "head", "left_semi")
    state, was, size, most = None, None, 0, GROWTH * edges.count()
    while True:
        for _ in range(3):
            far = inner.join(best.select(F.col("key").alias("head"), "root", "depth"), "head").select("key", "root", (F.col("w") + F.col("depth")).alias("depth"))
            best = best.unionByName(far).groupBy("key", "root").agg(F.min("depth").alias("depth"))
            alive = walk.join(alive.select(F.col("key").alias("head")), "head", "left_semi").unionByName(walk.filter(F.col("head") == CYCLE)).select("key").distinct()
        new = cut(best.unionByName(alive.select("key", F.lit(CYCLE).alias("root"), F.lit(-1).cast("long").alias("depth"))), "round")
        if state is not None:
            discard(state)
        state = new
        best, alive = state.filter(F.col("depth") >= 0), state.filter(F.col("depth") < 0).select("key")
        now = state.agg(F.count("*"), F.sum("depth"), F.count_if(F.col("depth") < 0)).first()
        if now == was:
            break
        was = now
        if size <= most:
            # edges of up to twice as many steps, walks of exactly twice as many; a walk stays on a cycle once there
            step = inner.select(F.col("key").alias("head"), F.col("head").alias("to"), F.col("w").alias("w2"))
            longer = inner.join(step, "head").select("key", F.col("to").alias("head"), (F.col("w") + F.col("w2")).alias("w"))
            inner = cut(inner.unionByName(longer).groupBy("key", "head").agg(F.min("w").alias("w")), "inner")
            twice = walk.join(walk.select(F.col("key").alias("head"), F.col("head").alias("to")), "head").select("key", F.col("to").alias("head"))
            walk = cut(twice.unionByName(walk.filter(F.col("head") == CYCLE)).distinct(), "walk")
            size = inner.count()
    return best.join(alive, "key", "left_anti").unionByName(state.filter(F.col("depth") < 0))


def _head_edges(trees: DataFrame, parents: DataFrame, needs: DataFrame, groups: DataFrame | None, steps: Column) -> tuple[DataFrame, DataFrame]:
    """(edges: g, key, head, w, inner; g of the groups too large for a task): from each head with several parents to the next heads up, w being the steps by the aggregate given."""
    heads = parents.filter("n > 1").select("key")
    at = trees.select(F.col("key").alias("parent"), F.col("root").alias("head"), (F.col("depth") + 1).alias("w"))
    edges = needs.join(heads, "key", "left_semi").join(at, "parent").groupBy("key", "head").agg(steps.alias("w"))
    edges = edges.join(groups.select("key", "g"), "key", "left") if groups is not None else edges.withColumn("g", F.lit(""))
    edges = cut(edges.join(heads.select(F.col("key").alias("head"), F.lit(True).alias("inner")), "head", "left").select("g", "key", "head", "w", F.coalesce("inner", F.lit(False)).alias("inner")), "edges")
    return edges, edges.groupBy("g").count().filter(F.col("count") > GROUP).select("g")


def _layered(edges: DataFrame) -> DataFrame:
    """_longest for edges (key, head, w, inner) of any number: a round does the heads all of whose heads above are done."""
    left, done = edges, None
    while True:
        free = left.groupBy("key").agg(F.max("w").alias("depth"), F.count_if(F.col("inner") | (F.col("head") == CYCLE)).alias("open")).filter("open = 0").select("key", F.lit(None).cast("string").alias("root"), "depth")
        free = cut(free, "layer")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        above = free.select(F.col("key").alias("head"), F.col("depth").alias("more"))
        left = left.join(free.select("key"), "key", "left_anti").join(above, "head", "left")
        left = cut(left.select("key", "head", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("inner") & F.col("more").isNull()).alias("inner")), "left")
    rest = left.select("key").distinct().select("key", F.lit(None).cast("string").alias("root"), F.lit(-1).cast("long").alias("depth"))
    return rest if done is None else done.unionByName(rest)


def layers(keys: DataFrame, needs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """keys, needs and groups as in reached_roots. (key, layer): a key's layer is one above the highest of its needs; keys on a cycle, or needing one, have layer -1. Chains of single needs take
    no rounds of their own."""
    needs = cut(needs.select("key", "parent").distinct(), "needs")
    parents = cut(several(needs), "parents")
    trees = cut(forest(head_links(keys, parents)).select("key", "root", "depth"), "trees")
    edges, large = _head_edges(trees, parents, needs, groups, F.max("w"))
    solved = _solved(edges.join(large, "g", "left_anti"), _longest)
    if not large.isEmpty():
        solved = solved.unionByName(_layered(cut(edges.join(large, "g", "left_semi").select("key", "head", "w", "inner"), "rest")))
    up = cut(solved, "solved").select(F.col("key").alias("root"), F.col("depth").alias("more"))
    layer = F.when((F.col("root") == CYCLE) | (F.col("more") < 0), -1).otherwise(F.col("depth") + F.coalesce("more", F.lit(0)))
    return trees.join(up, "root", "left").select("key", layer.cast("long").alias("layer"))


def reached_from(trees: DataFrame, parents: DataFrame, needs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """reached_roots, given parents (of several) and trees (key, root, depth: the forest of head_links)."""
    edges, large = _head_edges(trees, parents, needs, groups, F.min("w"))
    solved = _solved(edges.join(large, "g", "left_anti"))
    if not large.isEmpty():
        rest = cut(edges.join(large, "g", "left_semi").select("key", "head", "w"), "rest")
        solved = solved.unionByName(_relaxed(rest, rest.select("key").distinct()))
    solved = cut(solved, "solved")
    up = solved.select(F.col("key").alias("head"), F.col("root").alias("far"), F.col("depth").alias("more"))
    own = trees.filter(F.col("root") != CYCLE).select("key", F.col("root").alias("head"), "depth").join(up, "head", "left")
    far, depth = F.coalesce("far", "head"), F.when(F.col("more") < 0, -1).otherwise(F.col("depth") + F.coalesce("more", F.lit(0)))
    return own.select("key", far.alias("root"), depth.cast("long").alias("depth")).unionByName(trees.filter(F.col("root") == CYCLE).select("key", "root", "depth"))


def reached_roots(keys: DataFrame, needs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """keys: (key) unique; needs: (key, parent) distinct pairs, parents among the keys, several a key; groups: (key, g), where the graph is known to fall
    into groups without needs between them.

    Rows (key, root, depth): for each root that key reaches, the fewest steps to it; a key without
    parents is its own root at depth 0. Keys on a cycle or able to reach one: a single row 'cycle', -1.
    """
    needs = cut(needs.select("key", "parent").distinct(), "needs")
    parents = cut(several(needs), "parents")
    trees = cut(forest(head_links(keys, parents)).select("key", "root", "depth"), "trees")
    return reached_from(trees, parents, needs, groups)


def shortest_paths(found: DataFrame, needs: DataFrame) -> DataFrame:
    """found: rows of reached_roots. Adds path (array of keys from the root down to the key): one with the fewest steps; at each step up the
    least of the parents that lie on such a path. Rows on a cycle have no path. Strides double, so depth d takes about log2(d) rounds."""
    free = cut(found.filter(F.col("depth") >= 0), "free")
    above = free.select(F.col("key").alias("parent"), "root", (F.col("depth") + 1).alias("depth"))
    up = free.join(needs.select("key", "parent").distinct(), "key").join(above, ["parent", "root", "depth"])
    up = up.groupBy("key", "root").agg(F.min("parent").alias("anc"))
    place = cut(free.join(up, ["key", "root"], "left").select("key", "root", "depth", "anc", F.array("key").alias("path")), "paths")
    while not place.filter(F.col("anc").isNotNull()).isEmpty():
        busy, done = place.filter(F.col("anc").isNotNull()), place.filter(F.col("anc").isNull())
        above = place.select(F.col("key").alias("anc"), "root", F.col("anc").alias("next"), F.col("path").alias("path2"))
        new = busy.join(above, ["anc", "root"]).select("key", "root", "depth", F.col("next").alias("anc"), F.concat("path2", "path").alias("path"))
        new = cut(new.unionByName(done), "paths")
        discard(place)
        place = new
    looped = found.filter(F.col("depth") < 0).select("key", "root", "depth", F.lit(None).cast("array<string>").alias("path"))
    return place.select("key", "root", "depth", "path").unionByName(looped)


def needs_descendants(needs: DataFrame) -> DataFrame:
    """(key, descendant, steps): whatever reaches key by following needs, with the fewest steps; keys on a cycle have theirs too, but
    none is its own. After the first rounds of doubling, each round goes on from the pairs farthest apart and covers 2 ** STRIDE more steps."""
    hops = cut(needs.select("key", "parent", F.lit(1).cast("long").alias("d")).distinct(), "hops")
    for _ in range(STRIDE):
        far = hops.join(hops.select(F.col("key").alias("parent"), F.col("parent").alias("top"), F.col("d").alias("d2")), "parent")
        far = far.select("key", F.col("top").alias("parent"), (F.col("d") + F.col("d2")).alias("d"))
        new = cut(hops.unionByName(far).groupBy("key", "parent").agg(F.min("d").alias("d")), "hops")
        discard(hops)
        hops = new
    reach, seen, front = 2**STRIDE, hops, hops.filter(F.col("d") == 2**STRIDE)
    while True:
        far = hops.join(front.select(F.col("key").alias("parent"), F.col("parent").alias("top"), F.col("d").alias("d2")), "parent")
        far = far.groupBy("key", F.col("top").alias("parent")).agg(F.min(F.col("d") + F.col("d2")).alias("d"))
        new = cut(far.join(seen.select("key", "parent"), ["key", "parent"], "left_anti"), "hops")
        if new.isEmpty():
            break
        reach += 2**STRIDE
        seen, front = seen.unionByName(new), new.filter(F.col("d") == reach)
    return seen.filter(F.col("key") != F.col("parent")).select(F.col("parent").alias("key"), F.col("key").alias("descendant"), F.col("d").alias("steps"))


def decision_links(log: DataFrame) -> DataFrame:
    """(key, parent, node_id) of decision_log: of several rows of one id the one loaded last counts (a tie goes to the
    greater supersedes); null ids are left out, blank supersedes or one naming no decision is no parent."""
    rows = log.filter(F.col("decision_id").isNotNull()).groupBy(folded("decision_id").alias("key")).agg(
        F.max(F.struct("loaded_at", F.coalesce("supersedes", F.lit("")).alias("s"), F.col("decision_id").alias("node_id"))).alias("r"))
    return rows.select("key", F.nullif(folded("r.s"), F.lit("")).alias("parent"), "r.node_id")


def task_key(plan: str, name: Column) -> Column:
    return F.concat(F.col(plan), F.lit("/"), folded(name))


def task_needs(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys with node_id and plan, needs pairs) of tasks. A repeated task's needs are those of the row loaded last (a tie goes to the
    higher attempt); null and empty elements and names of no task of the plan don't count."""
    rows = tasks.filter(F.col("plan").isNotNull() & F.col("task_name").isNotNull()).groupBy(task_key("plan", F.col("task_name")).alias("key")).agg(
        F.max(F.struct("loaded_at", "attempt", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"), "plan", "task_name")).alias("r"))
    rows = cut(rows, "tasks")
    keys = rows.select("key", F.concat("r.plan", F.lit("/"), "r.task_name").alias("node_id"), F.col("r.plan").alias("plan"))
    named = rows.select("key", F.col("r.plan").alias("plan"), F.explode("r.needs").alias("need")).filter(F.col("need").isNotNull())
    needs = named.select("key", task_key("plan", F.col("need")).alias("parent")).distinct()
    return keys, needs.join(keys.select(F.col("key").alias("parent")), "parent", "left_semi")


def _named(found: DataFrame, keys: DataFrame, hierarchy: str) -> DataFrame:
    names = keys.select(F.col("key").alias("root"), F.col("node_id").alias("root_id"))
    out = found.join(keys.select("key", "node_id"), "key").join(names, "root", "left")
    root = F.when(F.col("depth") < 0, F.lit(CYCLE)).otherwise(F.col("root_id"))
    return out.select(F.lit(hierarchy).alias("hierarchy"), "node_id", root.alias("root_id"), F.col("depth").cast("long").alias("depth"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    """hierarchy, node_id, root_id, depth of every decision and task. Both forests, of decisions and of tasks below their heads, are nested together."""
    links = cut(decision_links(table(spark, sf_dir, "decision_log")), "links")
    keys, needs = task_needs(table(spark, sf_dir, "tasks"))
    needs = cut(needs, "needs")
    parents = cut(several(needs), "parents")
    mark = lambda df, m: df.select(F.concat(F.lit(m), "key").alias("key"), F.concat(F.lit(m), "parent").alias("parent"))
    both = cut(forest(mark(links, "d").unionByName(mark(head_links(keys, parents), "t"))).select("key", "root", "depth"), "both")

    def part(m: str) -> DataFrame:
        own = both.filter(F.col("key").startswith(m))
        return own.select(F.expr("substring(key, 2)").alias("key"), F.when(F.col("depth") < 0, F.lit(CYCLE)).otherwise(F.expr("substring(root, 2)")).alias("root"), "depth")

    return _named(part("d"), links, "decision").unionByName(_named(reached_from(part("t"), parents, needs, keys.select("key", F.col("plan").alias("g"))), keys, "task"))


def p4_nested(spark, sf_dir: str) -> DataFrame:
    """Every decision with its full path and its nested-set range: descendants are the rows of the same root whose pre
    lies in [pre + 1, pre + size - 1]."""
    links = cut(decision_links(table(spark, sf_dir, "decision_log")), "links")
    nested = cut(forest(links), "nested")
    out = nested.join(links.select("key", "node_id"), "key").join(paths(nested), "key")
    return out.select("node_id", "root", "depth", F.array_join("path", " > ").alias("path"), (F.col("size") - 1).alias("n_descendants"))


def p4_descendants(spark, sf_dir: str) -> DataFrame:
    """(node_id, descendant, steps) of every decision, from the ranges."""
    links = cut(decision_links(table(spark, sf_dir, "decision_log")), "links")
    nested = cut(forest(links), "nested")
    return descendants(nested, links).select(F.col("key").alias("node_id"), "descendant", "steps")


def p4_task_paths(spark, sf_dir: str) -> DataFrame:
    """(node_id, root, depth, path) of every task and root it reaches: the keys of one path with the fewest steps, from the root down."""
    keys, needs = task_needs(table(spark, sf_dir, "tasks"))
    needs = cut(needs, "needs")
    out = shortest_paths(cut(reached_roots(keys, needs, keys.select("key", F.col("plan").alias("g"))), "roots"), needs).join(keys.select("key", "node_id"), "key")
    return out.select("node_id", "root", "depth", F.array_join("path", " > ").alias("path"))


def p4_task_descendants(spark, sf_dir: str) -> DataFrame:
    """(node_id, descendant, steps) of every task: all that need it, directly or not, with the fewest steps."""
    keys, needs = task_needs(table(spark, sf_dir, "tasks"))
    return needs_descendants(needs).join(keys.select("key", "node_id"), "key").select("node_id", "descendant", "steps")
