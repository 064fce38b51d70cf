"""Encoding of a corpus with a public byte-level BPE vocabulary, by recursive DuckDB queries in each partition.

A text is split into words by the vocabulary's pattern. The distinct words of a partition become token-position rows; a
recursive query joins neighbours with the merge table and contracts, in each word, the leftmost pair of least rank until no
pair merges; in long words its further occurrences that don't overlap go at once. An ordered aggregation over the word positions
of each text gives its ids. Words once encoded are kept for the rest of the partition. Decoding joins ids with the bytes of the vocabulary's tokens and
aggregates them in order.

The vocabulary file is read on the driver from a path given as a parameter and sent as its merge table, whose size the
vocabulary fixes (50,000 merges, 1 MB).

Defined results: null and empty texts have an empty list; text that looks like a special token is plain text; each row of a
repeated doc_id is encoded; extra columns don't matter. Texts of any length are encoded whole. Null and empty lists decode to an empty text, ids that the
vocabulary doesn't have to nothing, bytes that aren't UTF-8 to U+FFFD.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how the byte_bpe_50k vocabulary splits a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII letters only, which a simpler engine splits faster.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Characters encoded by one query, words kept, and bytes from which a word is contracted round by round.
CHUNK, KEPT, LONG = 1_000_000, 200_000, 300

#: One contraction of each word's leftmost pair of least rank, from the rows t (word, pos, tok, it).
_STEP = """
  SELECT word, pos, CASE WHEN pos = best & 4294967295 THEN o ELSE tok END, it + 1 FROM (
    SELECT p.word, p.pos, p.tok, p.it, p.before, m.o, min((m.rank::BIGINT << 32) | p.pos) OVER (PARTITION BY p.word) AS best
    FROM (SELECT *, lead(tok) OVER w AS nxt, lag(pos) OVER w AS before FROM t WINDOW w AS (PARTITION BY word ORDER BY pos)) p
    LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
  ) WHERE best IS NOT NULL AND before IS DISTINCT FROM (best & 4294967295)
"""
#: The same for long words, with all occurrences of that pair that don't overlap at once.
_ROUND = """
  SELECT word, pos, CASE WHEN chosen THEN o ELSE tok END AS tok, it + 1 AS it FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY word, hit, seq - nth ORDER BY pos) % 2 = 1 AS chosen FROM (
        SELECT *, row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS nth FROM (
          SELECT p.word, p.pos, p.tok, p.it, p.seq, m.o, min(m.rank) OVER (PARTITION BY p.word) AS best, coalesce(m.rank = min(m.rank) OVER (PARTITION BY p.word), false) AS hit
          FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY word ORDER BY pos) AS seq FROM {t}) p
          LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
        ) WHERE best IS NOT NULL
      )
    )
  ) WHERE NOT gone
"""
_ENCODE = f"""
WITH RECURSIVE t(word, pos, tok, it) AS (SELECT word, pos, tok, 0 FROM fresh UNION ALL {_STEP})
INSERT INTO known SELECT word, list(tok ORDER BY pos) FROM (SELECT *, max(it) OVER (PARTITION BY word) AS last FROM t) WHERE it = last GROUP BY word
"""


def vocabulary(path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the 256 bytes, merges as rows left, right, result in order of rank) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return np.array([ids[letter[b]] for b in range(256)], np.int32), np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)


class Encoder:
    """Encodes lists of texts; one lives as long as its partition."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        import duckdb
        import regex

        self.byte_ids, self.pattern, self.ascii = byte_ids, regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.con.register("given", pa.table({"l": merges[:, 0], "r": merges[:, 1], "rank": np.arange(len(merges), dtype=np.int32), "o": merges[:, 2]}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.con.execute("CREATE OR REPLACE TABLE known(word INTEGER, ids INTEGER[])")

    def _learn(self, fresh: list[tuple[int, bytes]]) -> None:
        """Encode words that aren't known yet."""
        if not fresh:
            return
        sizes = np.array([len(w) for _, w in fresh])
        word = np.repeat(np.array([k for k, _ in fresh], np.int32), sizes)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(w for _, w in fresh), np.uint8)]
        self.con.register("fresh", pa.table({"word": word, "pos": pos, "tok": tok}))
        if sizes[0] <= LONG:
            self.con.execute(_ENCODE)
        else:  # a long word has many rounds, of which only the last is kept
            self.con.execute("CREATE OR REPLACE TEMP TABLE cur AS SELECT word, pos, tok, 0 AS it FROM fresh")
            while True:
                self.con.execute(f"CREATE OR REPLACE TEMP TABLE nxt AS {_ROUND.format(t='cur')}")
                if not self.con.execute("SELECT count(*) FROM nxt").fetchone()[0]:
                    break
                self.con.execute("DROP TABLE cur; ALTER TABLE nxt RENAME TO cur")
            self.con.execute("INSERT INTO known SELECT word, list(tok ORDER BY pos) FROM cur GROUP BY word")
        self.con.unregister("fresh")

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words of all texts in order, how many each text has); new words are encoded."""
        if len(self.words) > KEPT:
            self.forget()
        words, fresh, long = self.words, [], []
        occurs, counts = array("i"), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            pattern = self.ascii if text.isascii() else self.pattern
            before = len(occurs)
            for found in [pattern.findall(text)] if len(text) < CHUNK else _slices(pattern, text):
                numbers = list(map(words.get, found))
                if None in numbers:
                    for w in set(found):
                        if w not in words:
                            k = words[w] = len(words)
                            b = w.encode("utf-8", "surrogatepass")
                            (fresh if len(b) <= LONG else long).append((k, b))
                    numbers = list(map(words.get, found))
                occurs.fromlist(numbers)
            counts[i] = len(occurs) - before
        self._learn(fresh)
        for one in long:
            self._learn([one])
        return np.frombuffer(occurs, np.int32) if len(occurs) else np.zeros(0, np.int32), counts

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text."""
        word, counts = self._words(texts)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        self.con.register("occurs", pa.table({"i": row, "pos": pos, "word": word}))
        got = self.con.sql("SELECT i, flatten(list(ids ORDER BY pos)) AS ids FROM occurs JOIN known USING (word) GROUP BY i ORDER BY i").to_arrow_table().combine_chunks()
        self.con.unregister("occurs")
        sizes = np.zeros(len(texts), np.int64)
        ids = got.column("ids").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        if got.num_rows:
            sizes[got.column("i").to_numpy()] = ids.value_lengths().to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), ids.flatten().cast(pa.int32()))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        word, counts = self._words(texts)
        if (old := len(self.sizes)) < len(self.words):
            size = np.zeros(len(self.words), np.int64)
            size[:old] = self.sizes
            new = self.con.sql(f"SELECT word, len(ids) AS n FROM known WHERE word >= {old}").to_arrow_table()
            size[new.column("word").to_numpy()] = new.column("n").to_numpy()
            self.sizes = size
        upto = np.append(0, np.cumsum(self.sizes[word]))
        end = np.cumsum(counts)
        return upto[end] - upto[end - counts]


def _slices(pattern, text: str, most: int = 100_000) -> Iterator[list[str]]:
    """The words of a very long text, some at a time."""
    found = []
    for m in pattern.finditer(text):
        found.append(m.group())
        if len(found) == most:
            yield found
            found = []
    yield found


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and size + n > CHUNK:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def encode_documents(documents: DataFrame, carry: list[str], counts_only: bool = False, path: str = VOCABULARY) -> DataFrame:
    """The columns named in carry, with ids array<int>, or with n_tokens long."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*sent.value)
        for b in batches:
            texts = b.column(len(carry)).to_pylist()
            for a, z in _chunks(texts):
                out = pa.array(encoder.count(texts[a:z])) if counts_only else encoder.encode(texts[a:z])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), out], [*carry, "n_tokens" if counts_only else "ids"])

    rows = documents.select(*carry, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, " + ("n_tokens long" if counts_only else "ids array<int>"))


class Decoder:
    """Decodes lists of ids; one lives as long as its partition."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        import duckdb

        found = {int(t): bytes([b]) for b, t in enumerate(byte_ids)}
        for left, right, out in merges.tolist():
            found.setdefault(out, found[left] + found[right])
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.con.register("given", pa.table({"tok": pa.array(list(found), pa.int32()), "hex": [b.hex() for b in found.values()]}))
        self.con.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.con.unregister("given")

    def decode(self, ids: pa.Array) -> list[str]:
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        pos = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.con.register("said", pa.table({"i": row, "pos": pos, "tok": ids.flatten().cast(pa.int32())}))
        got = self.con.sql("SELECT i, string_agg(hex, '' ORDER BY pos) AS hex FROM said JOIN tokens USING (tok) GROUP BY i").fetchall()
        self.con.unregister("said")
        out = [""] * len(ids)
        for i, h in got:
            out[i] = bytes.fromhex(h).decode("utf-8", "replace")
        return out


def decode_documents(encoded: DataFrame, carry: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns named in carry, with the text of ids array<int>."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(*sent.value)
        for b in batches:
            ids = b.column(len(carry))
            cum = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            a = 0
            while a < len(ids):
                z = max(a + 1, int(np.searchsorted(cum, cum[a] + CHUNK, "right")) - 1)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), pa.array(decoder.decode(ids.slice(a, z - a)), pa.string())], [*carry, "text"])
                a = z

    rows = encoded.select(*carry, "ids")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, text string")


def p6_ids(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), ["doc_id"])


def p6_decoded(spark, sf_dir: str) -> DataFrame:
    """Every text again, from its ids."""
    return decode_documents(p6_ids(spark, sf_dir), ["doc_id"])
