"""Subject areas of documents.

One automaton finds all curated terms (subject_terms, or the caller's) of the subjects that the `subjects` table lists in each sentence, longest
first. A sentence's score for a subject sums, over its terms, the term's rarity in the corpus divided by the number of subjects that share the term; the sentence is
about the best one if that reaches the subject's floor, and a tie between subjects that share a term goes to the one with more of the document's own
sentences. A document gets every subject that at least SHARE of its subject-bearing sentences are about, so its length doesn't matter.

Floors are calibrated subject by subject on labelled documents: the least of FLOORS whose F1 isn't below the best by more than its standard error.

The first pass keeps only term numbers by sentence, in the shared folder; rarities come from it over the whole corpus (one
row a term, so their size is that of the term list).

Sentences end at stops and blank lines. A text whose sentences are run together by another mark, one that it has oftener than stops, is split at that mark too.

Defined results: null, empty texts and texts without any term have no row; rows without doc_id have none; a doc_id of several rows
gets the subjects of each of its rows, once. Texts are read whole. A subject of the table without curated terms is looked for by the words of its title and
description; curated subjects that the table lacks are left out; null and repeated rows of the table don't count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.subject_terms import NEUTRAL, TERMS
from lattica.session import cut, table

SHARE = 0.25
#: Floors that calibrate() chooses from: scores below a subject's floor don't make a sentence about it.
FLOORS = (0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0)
#: calibrate() uses at most this many labelled documents; the subjects table may have at most so many rows.
MAX_LABELLED, MAX_SUBJECTS = 20_000, 10_000
_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n\s*\n|(?<=[.!?:\"”»)])\s*\n|\n(?=\s*(?:[-*>#•=]|\d+[.)]))")
_STOP = re.compile(r"[.!?](?=\s|$)|[。！？]")
_CAPITAL = r"(?=[^\W\d_a-zß-öø-ÿ][^\W\d_A-ZÀ-ÖØ-Þ])"
#: Marks that some texts put between sentences instead of stops, and how many of them there must be to a stop; a comma before a word in capitals is common within sentences.
_MARKS = tuple((signs, re.compile(p), n) for signs, p, n in (
    (";", r"\s*;\s+", 1), ("|", r"\s*\|\s+", 1), ("/", r"\s+/{1,2}\s+", 1), ("–—", r"\s+[–—]\s+", 1), ("·•", r"\s+[·•]\s+", 1), (">→", r"\s+(?:->|=>|→)\s+", 1), ("\r\n", r"[\r\n]+", 1),
    (",", rf",\s+(?:and\s+|und\s+|et\s+|y\s+)?{_CAPITAL}", 1), (",", r",\s+and\s+(?=[^\x00-\u2fff])", 1), (",", r",\s+(?=[^\W\d_a-zß-öø-ÿ]{2})", 4)))
_UNSEEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")


def vocabulary(subjects: Iterable[tuple[str, str | None, str | None]] | None = None, terms: dict[str, dict[str, str]] = TERMS) -> list[tuple[str, tuple[str, ...]]]:
    """(term, subjects) in a fixed order, for (subject, title, description) rows, or all curated subjects; neutral phrases have no subject."""
    own: dict[str, list[str]] = {}
    for subject, title, description in sorted({s[0]: s for s in (subjects if subjects is not None else [(s, None, None) for s in terms]) if s[0]}.values(), key=lambda s: s[0]):
        lines = list(terms.get(subject.strip().lower(), {}).values())
        if not lines:
            lines = ["; ".join(w for w in re.findall(r"[^\W\d_]{4,}", f"{title or subject} {description or ''}".lower()) if w not in ("them", "that", "with", "their", "from"))]
        for line in lines:
            for term in line.split(";"):
                if (t := term.strip().lower()) and subject not in own.setdefault(t, []):
                    own[t].append(subject)
    for term in NEUTRAL.split(";"):
        own.setdefault(term.strip(), [])
    return [(t, tuple(s)) for t, s in own.items()]


def sentences(text: str) -> list[str]:
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    stops = len(_STOP.findall(text))
    out = _END.split(text)
    for signs, mark, least in _MARKS:
        if sum(map(text.count, signs)) > least * stops and len(mark.findall(text)) > least * stops:
            out = [x for s in out for x in mark.split(s)]
    return [" ".join(s.split()) for s in out]


class Finder:
    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t, (i, len(t), t[0] < "　"))
        self.automaton.make_automaton()

    def terms(self, sentence: str) -> list[int]:
        """Numbers of the terms in a sentence, no two overlapping, the longest first."""
        s = sentence.lower()
        hits = []
        for end, (i, n, latin) in self.automaton.iter(s):
            a, z = end + 1 - n, end + 1
            if latin:
                if a and (s[a - 1].isalnum() or s[a - 1] == "_"):
                    continue
                tail = re.match(r"\w*", s[z : z + 4])[0]
                if tail not in ("", "s", "es", "n", "en", "e"):
                    continue
            hits.append((-n, a, z, i))
        if len(hits) < 2:
            return [h[3] for h in hits]
        hits.sort()
        taken: list[tuple[int, int]] = []
        out = []
        for _, a, z, i in hits:
            if all(z <= x or a >= y for x, y in taken):
                taken.append((a, z))
                out.append(i)
        return out


def found_terms(documents: DataFrame, vocab: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, hits: the term numbers of each sentence that has any."""
    terms = [t for t, _ in vocab or vocabulary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(terms)
        for b in batches:
            out = [[h for s in sentences(t.as_py()) if (h := finder.terms(s))] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["doc_id", "hits"])

    rows = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, hits array<array<int>>")


def rarities(found: DataFrame, size: int) -> list[float]:
    """log(1 + N / df) of each of size terms, df and N counted over all documents with any term."""
    n = found.filter(F.size("hits") > 0).count()
    rows = found.select(F.explode(F.array_distinct(F.flatten("hits"))).alias("i")).groupBy("i").count().collect()
    df = {r.i: r["count"] for r in rows}
    return [math.log(1 + n / (df.get(i, 0) + 1)) for i in range(size)]


def scores(hits: list[list[int]], weights: list[float], subjects: list[tuple[str, ...]]) -> list[dict[str, float]]:
    """Each sentence's score for its subjects."""
    out = []
    for sentence in hits:
        score: dict[str, float] = {}
        for i in sentence:
            for s in subjects[i]:
                score[s] = score.get(s, 0.0) + weights[i] / len(subjects[i])
        if score:
            out.append(score)
    return out


def parts(scored: list[dict[str, float]], floors: dict[str, float] | None = None) -> dict[str, float]:
    """The share of the subject-bearing sentences about each subject."""
    best, floors = [], floors or {}
    for score in scored:
        if floors:
            score = {s: x for s, x in score.items() if x >= floors.get(s, 0.0)}
        if score:
            top = max(score.values()) * (1 - 1e-9)
            best.append([s for s, x in score.items() if x >= top])
    sure = Counter(c[0] for c in best if len(c) == 1)
    about = Counter(c[0] if len(c) == 1 else max(c, key=lambda s: (sure[s], -c.index(s))) for c in best)
    return {s: n / len(best) for s, n in about.items()}


def shares(hits: list[list[int]], weights: list[float], subjects: list[tuple[str, ...]], floors: dict[str, float] | None = None) -> dict[str, float]:
    return parts(scores(hits, weights, subjects), floors)


def assign(found: DataFrame, weights: list[float], vocab: list[tuple[str, tuple[str, ...]]] | None = None, floors: dict[str, float] | None = None) -> DataFrame:
    subjects = [s for _, s in vocab or vocabulary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for d, hits in zip(b.column("doc_id"), b.column("hits")):
                for s, x in sorted(shares(hits.as_py(), weights, subjects, floors).items()):
                    if x >= SHARE:
                        ids.append(d.as_py())
                        out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "subject"])

    return found.mapInArrow(run, "doc_id long, subject string").dropDuplicates()


def labelled(found: DataFrame, labels: DataFrame) -> list[tuple[list[list[int]], Counter]]:
    """Hits and label counts (by folded subject, repeated by annotators) of the labelled documents, at most MAX_LABELLED: those with the least hash."""
    known = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_list(F.lower(F.trim("subject"))).alias("labels"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return [(r.hits, Counter(r.labels)) for r in found.join(known, "doc_id").select("hits", "labels").collect()]


def calibrate(rows: list[tuple[list[list[int]], Counter]], weights: list[float], vocab: list[tuple[str, tuple[str, ...]]] | None = None, floors: tuple[float, ...] = FLOORS) -> tuple[dict[str, float], dict[str, float]]:
    """rows: of labelled(). Each subject's floor, and its F1 with it. Subjects without a label keep the least floor. All floors are tried one at a
    time for all subjects together."""
    subjects = [s for _, s in vocab or vocabulary()]
    names = sorted({s for x in subjects for s in x})
    f1: dict[str, list[tuple[float, float]]] = {s: [] for s in names}
    rows = [(scores(hits, weights, subjects), want) for hits, want in rows]
    for floor in floors:
        hit, said, true = Counter(), Counter(), Counter()
        same = dict.fromkeys(names, floor)
        for scored, want in rows:
            got = {s for s, x in parts(scored, same).items() if x >= SHARE}
            said.update(got)
            hit.update(s for s in got if s.strip().lower() in want)
            true.update(want.keys())
        for s in names:
            both = said[s] + true[s.strip().lower()]
            f1[s].append((2 * hit[s] / both if both else 0.0, both / 2))
    best = {}
    for s in names:
        top, n = max(f1[s])
        slack = math.sqrt(top * (1 - top) / n) if n else 1.0
        best[s] = next(z for z, (x, _) in zip(floors, f1[s]) if x >= top - slack)
    return best, {s: f1[s][floors.index(best[s])][0] for s in names}


def listed(subjects: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """The rows of the subjects table; it is small by contract."""
    if (n := subjects.count()) > MAX_SUBJECTS:
        raise ValueError(f"{n} subjects; there may be {MAX_SUBJECTS}")
    return [tuple(r) for r in subjects.filter("subject is not null").select("subject", "title", "description").orderBy("subject", "title", "description").collect()]


def subject_rows(documents: DataFrame, subjects: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject). Without a subjects table all curated subjects are looked for; without labels no sentence falls below a floor."""
    vocab = vocabulary(None if subjects is None else listed(subjects))
    found = cut(found_terms(documents, vocab), "terms")
    weights = rarities(found, len(vocab))
    floors = calibrate(labelled(found, labels), weights, vocab)[0] if labels is not None else None
    return assign(found, weights, vocab, floors)


def _rows(spark, sf_dir: str) -> DataFrame:
    return subject_rows(*(table(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")))


def p8_found(spark, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir)


def p8_composition(spark, sf_dir: str) -> DataFrame:
    """Documents and characters by subject; a document of several subjects counts for each."""
    docs = table(spark, sf_dir, "documents")
    rows = _rows(spark, sf_dir).join(docs.select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")
    return rows.groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"))
