"""Splitting oversized texts at natural boundaries, by content-defined chunking.

A gear hash rolls over the code points; where it is greatest between the least and the greatest size of a piece is a
landmark, and the landmark snaps to the nearest natural boundary, coarse kinds first. Landmark and kind are chosen within that window
and depend on nearby text alone, so an edit alters the pieces around it and the cuts fall into step again behind it. The cut level of the whole text is
reported from the same boundaries.

Every text is worked on whole. Lengths are counted in code points.

Defined results: null, empty and short texts (not above the limit) have no row; a source is compared without case and surrounding
blanks, null or unlisted ones take the limits of `*`, and without a `*` row such texts are not split; a source listed twice takes its
smallest limit; an overlap not below the limit counts as limit - 1. Texts without a boundary are cut at landmarks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.hierarchy import folded
from lattica.session import table

LEVELS = ("paragraph", "line", "sentence", "word")
WS = " \t\r\n"
_RUN = re.compile(r"[ \t\r\n]+|(?<=[。！？])(?![ \t\r\n])")
MAX_LIMITS = 10_000


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds (index into LEVELS) of all boundaries: whole runs of whitespace, and the places of no width
    after full-width stops. Runs at either end of the text count for every level, as they are taken off anyway."""
    spans = [m.span() for m in _RUN.finditer(text)]
    kinds = []
    for a, b in spans:
        lines = text.count("\n", a, b)
        before = text[a - 1] if a else ""
        kinds.append(0 if lines > 1 or not a or b == len(text) else 1 if lines else 2 if before in ".!?。！？" else 3)
    at = np.array(spans, np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1], np.array(kinds, np.int64)


def cut_level(n: int, a: np.ndarray, b: np.ndarray, kinds: np.ndarray, room: int) -> int:
    """The coarsest level whose boundaries leave no stretch above room; 4 if none does."""
    for k in range(len(LEVELS)):
        use = kinds <= k
        if np.all(np.append(a[use], n) - np.append(0, b[use]) <= room):
            return k
    return len(LEVELS)


def gear(text: str) -> np.ndarray:
    """h[i]: hash of the 32 code points that end before position i (h[0] is of none)."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (u + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    for k in (1, 2, 4, 8, 16):
        far = np.zeros_like(h)
        far[k:] = h[:-k] if k < len(h) else 0
        h = (h + (far << np.uint64(k))) & np.uint64(0xFFFFFFFF)
    return np.concatenate([np.zeros(1, np.uint64), h])


def split(text: str, max_chars: int, overlap: int) -> tuple[str, list[tuple[int, int, int]]]:
    """cut_level of the text, and its pieces (start, body, end): text[body:end] is new, text[start:body] repeats the piece before."""
    overlap = max(0, min(overlap, max_chars - 1))
    room = max_chars - overlap
    a, b, kinds = boundaries(text)
    level = cut_level(len(text), a, b, kinds, room)
    h = gear(text)
    ends = [(a[kinds <= k], b[kinds <= k]) for k in range(len(LEVELS))]
    pieces, p, prev = [], 0, 0
    while p < len(text):
        hi = p + room
        if len(text) <= hi:
            q = len(text)
        else:
            lo = min(p + max(1, room // 2), hi)
            mark = lo + int(np.argmax(h[lo : hi + 1]))
            q = _snap(ends, p, lo, hi, mark)
        s = p
        if p and overlap:
            s = max(prev, p - overlap)
            if s and not (text[s - 1] in WS or text[s - 1] in "。！？"):
                k = int(np.searchsorted(b, s))
                if k < len(b) and b[k] < p:
                    s = int(b[k])
        pieces.append((s, p, q))
        prev, p = s, q
    return (*LEVELS, "none")[level], pieces


def _snap(ends: list[tuple[np.ndarray, np.ndarray]], p: int, lo: int, hi: int, mark: int) -> int:
    """The boundary nearest to the landmark, from the coarsest level that has one between lo and hi; else the last
    one after p; else the landmark itself."""
    late = 0
    for a, b in ends:
        i, j = int(np.searchsorted(b, p, "right")), int(np.searchsorted(a, hi, "right"))
        at = np.minimum(b[i:j], hi)  # a long run of blanks may be cut anywhere
        at = at[at > p]
        good = at[at >= lo]
        if len(good):
            return int(good[np.argmin(np.abs(good - mark))])
        if len(at):
            late = max(late, int(at[-1]))
    return late or mark


def limits(piece_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """The limits by folded source; the list is small by contract."""
    if (n := piece_limits.count()) > MAX_LIMITS:
        raise ValueError(f"{n} limits; there may be {MAX_LIMITS}")
    rows = piece_limits.filter("source is not null and max_chars is not null").select(folded("source").alias("s"), "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("o")).collect()
    return {r.s: (r.max_chars, r.o) for r in sorted(rows, key=lambda r: (r.max_chars, r.o), reverse=True)}


def oversized(documents: DataFrame, piece_limits: DataFrame) -> DataFrame:
    """doc_id, text, max_chars, overlap of the texts above the limit of their source."""
    by = limits(piece_limits)
    star = by.pop("*", None)

    def pick(k: int) -> Column:
        own = F.lit(None).cast("long")
        if by:
            own = F.create_map(*[F.lit(x) for s, v in sorted(by.items()) for x in (s, v[k])])[F.coalesce(folded("source"), F.lit("*"))]
        return F.coalesce(own.cast("long"), F.lit(star[k] if star else None).cast("long"))

    rows = documents.select("doc_id", "text", pick(0).alias("max_chars"), pick(1).alias("overlap"))
    return rows.filter((F.length("text") > F.col("max_chars")) & (F.col("max_chars") > 0))


def split_documents(documents: DataFrame, piece_limits: DataFrame, texts: bool = True) -> DataFrame:
    """One row per oversized document: doc_id, cut_level, pieces (piece, start, body, end_, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("body", pa.int64()), ("end_", pa.int64()), ("text", pa.string())]))
        for b in batches:
            ids, levels, out = b.column("doc_id"), [], []
            for t, m, o in zip(b.column("text"), b.column("max_chars").to_pylist(), b.column("overlap").to_pylist()):
                t = t.as_py()
                level, pieces = split(t, m, o)
                levels.append(level)
                out.append([{"start": s, "body": p, "end_": q, "text": t[s:q] if texts else None} for s, p, q in pieces])
            yield pa.RecordBatch.from_arrays([ids, pa.array(levels, pa.string()), pa.array(out, kind)], ["doc_id", "cut_level", "pieces"])

    schema = "doc_id long, cut_level string, pieces array<struct<start: long, body: long, end_: long, text: string>>"
    return oversized(documents, piece_limits).mapInArrow(run, schema)


def p2_found(spark, sf_dir: str) -> DataFrame:
    done = split_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "piece_limits"), texts=False)
    return done.select("doc_id", "cut_level")


def p2_pieces(spark, sf_dir: str) -> DataFrame:
    done = split_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "piece_limits"))
    rows = done.select("doc_id", F.posexplode("pieces").alias("piece", "p"))
    return rows.select("doc_id", F.col("piece").cast("long").alias("piece"), "p.start", "p.body", "p.end_", "p.text")
