"""Free-entered values mapped to a canonical list.

Distinct values are normalised (accents, look-alike letters, case, joined words, word order, decorations), candidates come
from an inverted index of weighted character n-grams over the list's names and aliases, the weighted cosine scores
them, and the best is taken if it lies above a threshold, keeps a margin to the next entry and stands up to a
check of words: every word of the name has its counterpart within few edits, none is left over, and the numbers agree. All names above the
threshold are checked; the margin is kept between entries, however many names each has.

A list of up to MAX_LIST entries (checked by a count) is broadcast and indexed once a worker. A longer one stays a table: `joined` joins the values' n-grams with
the list's postings and gives the same answers. Only a value's rarest n-grams, those whose weight could by itself reach the threshold, are joined, and the cosine
is computed over all. The values may be any number. Each distinct value is scored once.

Defined results: a null element has no row; an empty value, or one of decorations alone, is unmatched; repeated
elements get a row each; of two entries that tie, none is taken. Nulls in names, ids or aliases of the list are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut, table

UNMATCHED = "(unmatched)"
MAX_LIST = 50_000
THRESHOLD, MARGIN = 0.42, 0.04
#: What an edit costs of the score; length below which a form that isn't an entry's first has to be met exactly.
PER_EDIT, SHORT = 0.1, 6
ARTICLES = frozenset("the a an our their its".split())
LEGAL = frozenset("inc incorporated llc ltd limited corp corporation co company gmbh plc".split())
#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = str.maketrans("асеорхуіјѕԁһкмтвнАСЕОРХУІЈЅКМТВНαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijsdhkmtbhACEOPXYIJSKMTBHaopvikABEZHIKMNOPTYX")
_BRACKET = re.compile(r"(?<=\S)\s*[(\[][^)\]]*[)\]]\s*$")
_REPLY = re.compile(r"^\s*(?:re|fw|fwd|aw)\s*:\s*", re.IGNORECASE)
_VERSION = re.compile(r"\b(?:version|ver|v)[\s.\-_]*(?=\d)")


def words(value: str) -> list[str]:
    """The normalised words of a value, without articles and decorations."""
    s = unicodedata.normalize("NFKD", value)
    s = "".join(c for c in s if not unicodedata.combining(c)).translate(LOOKALIKES)
    s = _BRACKET.sub("", _REPLY.sub("", s))
    s = _VERSION.sub(" v", s.lower().replace("_", " "))
    found = re.findall(r"[^\W_]+", s)
    while len(found) > 1 and found[0] in ARTICLES:
        found = found[1:]
    return found


def grams(found: list[str]) -> set[str]:
    """Trigrams of each word with its ends marked, and of all words run together without ends."""
    core = [w for w in found if w not in LEGAL] or found
    run = "".join(core)
    return {f"{p[i : i + 3]}" for w in core for p in [f"^{w}$"] for i in range(len(p) - 2)} | {f"~{run[i : i + 4]}" for i in range(max(1, len(run) - 3))}


def numbers(found: list[str]) -> tuple[str, ...]:
    return tuple(sorted(n.lstrip("0") for w in found for n in re.findall(r"\d+", w)))


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def abbreviates(short: str, long: str) -> bool:
    if not 2 <= len(short) < len(long) - 1 or short[0] != long[0] or not short.isalpha():
        return False
    it = iter(long)
    return all(c in it for c in short)


def allowed(n: int) -> int:
    return 0 if n < 2 else 1 if n < 6 else 2 if n < 10 else 3


def agrees(value: list[str], name: list[str]) -> int | None:
    """Cost of reading the value as the name, or None if it can't be."""
    if numbers(value) != numbers(name):
        return None
    v, n = [w for w in value if w not in LEGAL] or value, [w for w in name if w not in LEGAL] or name
    if sorted(v) == sorted(n):
        return 0
    joined = edits("".join(value), "".join(name), 3)
    if joined <= min(3, len("".join(name)) // 5):
        return joined
    joined = edits("".join(v), "".join(n), 3)
    if joined <= min(3, len("".join(n)) // 5):
        return joined
    left, cost = list(v), 0
    for w in sorted(n, key=len, reverse=True):
        most = allowed(len(w))
        best = min(((0 if x == w else edits(x, w, most), x) for x in left), default=(99, ""))
        if best[0] > most:
            short = [x for x in left if abbreviates(x, w)]
            if not short:
                return None
            best = (1, short[0])
        left.remove(best[1])
        cost += best[0]
    # what is left over must be a mistyped legal form or article
    for x in left:
        if not (len(x) <= 8 and any(edits(x, w, 1) <= 1 for w in LEGAL if len(w) > 2 or x == w) and any(w in LEGAL for w in name)):
            return None
    return cost if cost <= 4 else None


def forms(label: str | None, aliases: Iterable[str | None] | None) -> Iterator[tuple[list[str], bool]]:
    """(words, short) of the names of an entry; short forms, acronyms mostly, have to be met exactly."""
    for k, form in enumerate([label, *(aliases if aliases is not None else [])]):
        if form and (found := words(form)):
            yield found, bool(k) and len("".join(found)) < SHORT


def choose(scores: dict[str, float]) -> str:
    """The entry with the best score, if it keeps the margin to the next."""
    order = sorted(scores.items(), key=lambda x: -x[1])
    return order[0][0] if order and (len(order) == 1 or order[0][1] - order[1][1] >= MARGIN) else UNMATCHED


class Index:
    """Inverted index over the names and aliases of (entity_id, label, aliases) entries."""

    def __init__(self, entries: Iterable[tuple[str, str | None, Iterable[str | None] | None]]):
        self.forms: list[tuple[str, list[str]]] = []
        self.short: dict[str, set[str]] = defaultdict(set)
        for entity, label, aliases in entries:
            for found, short in forms(label, aliases) if entity is not None else ():
                if short:
                    self.short["".join(found)].add(entity)
                else:
                    self.forms.append((entity, found))
        sets = [grams(found) for _, found in self.forms]
        df: dict[str, int] = defaultdict(int)
        for s in sets:
            for g in s:
                df[g] += 1
        self.default = unseen(len(sets))
        self.weight = {g: float(np.log(1 + len(sets) / n)) for g, n in df.items()}
        norm = [sum(self.weight[g] ** 2 for g in s) ** 0.5 for s in sets]
        posts: dict[str, list[int]] = defaultdict(list)
        for i, s in enumerate(sets):
            for g in s:
                posts[g].append(i)
        self.posts = {g: (np.array(p), np.array([self.weight[g] ** 2 / norm[i] for i in p])) for g, p in posts.items()}

    def scores(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the forms that share an n-gram, and their cosines."""
        s = grams(found)
        hit = [self.posts[g] for g in s if g in self.posts]
        if not hit:
            return np.zeros(0, np.int64), np.zeros(0)
        own = sum(self.weight.get(g, self.default) ** 2 for g in s) ** 0.5
        at, back = np.unique(np.concatenate([p for p, _ in hit]), return_inverse=True)
        return at, np.bincount(back, np.concatenate([w for _, w in hit])) / own

    def find(self, value: str) -> str:
        found = words(value)
        run = "".join(found)
        if not run:
            return UNMATCHED
        if len(run) < SHORT and run in self.short:
            return next(iter(self.short[run])) if len(self.short[run]) == 1 else UNMATCHED
        best: dict[str, float] = {}
        for i, score in zip(*self.scores(found)):
            if score >= THRESHOLD and (cost := agrees(found, self.forms[i][1])) is not None:
                entity = self.forms[i][0]
                best[entity] = max(best.get(entity, -9.0), score - PER_EDIT * cost)
        return choose(best)


def unseen(n: int) -> float:
    """Weight of an n-gram that none of n forms has."""
    return 0.5 * float(np.log(1 + n / 0.5)) if n else 0.5


_built: dict[str, Index] = {}


def indexed(values: DataFrame, canonical: DataFrame) -> DataFrame:
    """map_values for a list that can be broadcast."""
    entries = [(r.entity_id, r.label, r.aliases) for r in canonical.select("entity_id", "label", "aliases").orderBy("entity_id").collect()]
    sent, name = values.sparkSession.sparkContext.broadcast(entries), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:  # workers are reused from task to task
            _built.clear()
            _built[name] = Index(sent.value)
        index = _built[name]
        for b in batches:
            col = b.column(0)
            yield pa.RecordBatch.from_arrays([col, pa.array([index.find(v.as_py()) for v in col], pa.string())], ["value", "entity_id"])

    # scoring is costly and the values are short: spread them over as many tasks as a shuffle has
    spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return values.select("value").repartition(spread).mapInArrow(run, "value string, entity_id string")


def joined(values: DataFrame, canonical: DataFrame) -> DataFrame:
    """map_values for a list of any length: the index is a table of postings."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(e, f, "".join(f), s, sorted(grams(f))) for e, x, y in zip(*(b.column(c).to_pylist() for c in ("entity_id", "label", "aliases"))) for f, s in forms(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], ["entity_id", "name", "run", "short", "grams"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(v) for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kinds[1]), pa.array(["".join(f) for f in found]), pa.array([sorted(grams(f)) if f else [] for f in found], kinds[1])], ["value", "said", "run", "grams"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost = [agrees(x, y) for x, y in zip(b.column("said").to_pylist(), b.column("name").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("value"), b.column("entity_id"), b.column("score"), pa.array(cost, pa.int64())], ["value", "entity_id", "score", "cost"])

    kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.list_(pa.string())]
    entries = canonical.filter("entity_id is not null").select("entity_id", "label", "aliases")
    every = cut(entries.mapInArrow(named, "entity_id string, name array<string>, run string, short boolean, grams array<string>"), "forms")
    said = cut(values.select("value").mapInArrow(read, "value string, said array<string>, run string, grams array<string>"), "said")

    short = every.filter("short").groupBy("run").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("one"))
    exact = said.filter(F.length("run") < SHORT).join(short, "run").select("value", F.when(F.col("n") == 1, F.col("one")).otherwise(UNMATCHED).alias("entity_id"))
    exact = cut(exact, "exact")

    long = every.filter("not short").withColumn("form", F.xxhash64("entity_id", F.array_join("name", " ")))
    n = long.count()
    posts = long.select("form", F.explode("grams").alias("g"))
    weight = cut(posts.groupBy("g").agg(F.log(1 + F.lit(float(n)) / F.count("*")).alias("w")), "weights")
    posts = posts.join(weight, "g")
    norm = posts.groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("fn"))
    own = said.join(exact.select("value"), "value", "left_anti").select("value", "said", F.explode("grams").alias("g")).join(weight, "g", "left")
    own = own.withColumn("w2", F.pow(F.coalesce("w", F.lit(unseen(n))), 2.0))
    by = Window.partitionBy("value")
    own = own.withColumn("all", F.sum("w2").over(by)).withColumn("below", F.sum("w2").over(by.orderBy("w2", "g")))
    # a name that shares only the commonest n-grams, up to here, can't reach the threshold
    rare = own.filter(F.col("w").isNotNull() & (F.col("below") >= THRESHOLD**2 * F.col("all") * (1 - 1e-9)))
    pairs = rare.join(posts, "g").select("value", "form").distinct()
    whole = own.groupBy("value").agg(F.first("said").alias("said"), F.sqrt(F.first("all")).alias("vn"), F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("g", "w2")))).alias("m"))
    full = pairs.join(whole, "value").join(long.join(norm, "form"), "form")
    dot = F.aggregate(F.transform("grams", lambda g: F.coalesce(F.element_at("m", g), F.lit(0.0))), F.lit(0.0), lambda x, y: x + y)
    full = full.select("value", "said", "entity_id", "name", (dot / F.col("vn") / F.col("fn")).alias("score")).filter(F.col("score") >= THRESHOLD)
    costs = full.mapInArrow(checked, "value string, entity_id string, score double, cost long").filter("cost is not null")
    best = costs.groupBy("value", "entity_id").agg(F.max(F.col("score") - PER_EDIT * F.col("cost")).alias("s"))
    order = Window.partitionBy("value").orderBy(F.desc("s"))
    best = best.withColumn("next", F.lead("s").over(order)).withColumn("r", F.row_number().over(order)).filter("r = 1")
    taken = best.filter(F.col("next").isNull() | (F.col("s") - F.col("next") >= MARGIN)).select("value", "entity_id")
    return values.select("value").join(exact.unionByName(taken), "value", "left").select("value", F.coalesce("entity_id", F.lit(UNMATCHED)).alias("entity_id"))


def map_values(values: DataFrame, canonical: DataFrame) -> DataFrame:
    """values: (value string), each once; canonical: entity_id, label, aliases. Adds entity_id."""
    return indexed(values, canonical) if canonical.count() <= MAX_LIST else joined(values, canonical)


def map_entities(documents: DataFrame, canonical: DataFrame) -> DataFrame:
    """doc_id, pos, entity_id for each non-null element of documents.entities."""
    rows = documents.select("doc_id", F.posexplode("entities").alias("pos", "value")).filter(F.col("value").isNotNull())
    found = map_values(rows.select("value").distinct(), canonical)
    return rows.join(found, "value").select("doc_id", F.col("pos").cast("long").alias("pos"), "entity_id")


def p1_found(spark, sf_dir: str) -> DataFrame:
    return map_entities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "canonical"))


def p1_unmatched(spark, sf_dir: str) -> DataFrame:
    """The report of unmatched values: how often each occurs, in how many documents."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.explode("entities").alias("value")).filter(F.col("value").isNotNull())
    counts = rows.groupBy("value").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    found = map_values(counts.select("value"), table(spark, sf_dir, "canonical"))
    return counts.join(found.filter(F.col("entity_id") == UNMATCHED), "value").select("value", "n", "n_docs")
