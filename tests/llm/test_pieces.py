import random
import re

import pytest

from lattica.llm import pieces as P


def brute_level(text, room):
    """By TESTDATA's words: mark every boundary character position, cut there, strip."""
    for k, level in enumerate(P.LEVELS):
        pats = [r"\n[ \t\r\n]*\n", r"\n", r"(?<=[.!?])[ \t\r\n]|(?<=[。！？])", r"[ \t\r\n]|(?<=[。！？])"][: k + 1]
        parts = [text]
        for p in pats:
            parts = [y for x in parts for y in re.split(p, x)] if level != "sentence" or p is not pats[-1] else parts
        if level == "sentence":
            parts = [y for x in parts for y in re.split(pats[-1], x)]
        if all(len(x.strip(P.WS)) <= room for x in parts):
            return level
    return "none"


def make(rnd, n):
    return "".join(rnd.choice(["ab", "c", ". ", "! ", "\n", "\n\n", " ", "\r\n", "。", "  \t", "wörter", "x" * rnd.randint(1, 25), "\n \n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_level_and_pieces(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        text, m = make(rnd, rnd.randint(20, 120)), rnd.choice([20, 30, 60])
        o = rnd.choice([0, 5, 9])
        level, out = P.split(text, m, o)
        assert level == brute_level(text, m - o)
        assert "".join(text[p:q] for _, p, q in out) == text
        for i, (s, p, q) in enumerate(out):
            assert q - s <= m and q > p and p - s <= o
            if i:
                assert s >= out[i - 1][0]
            if level != "none" and q < len(text):
                before, after = text[q - 1], text[q]
                assert before in P.WS + "。！？" or after in P.WS


def test_edit_alters_only_neighbours():
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) + rnd.choice(["", "", "."]) for _ in range(6000))
    a = [text[p:q] for _, p, q in P.split(text, 800, 50)[1]]
    b = [t[p:q] for t in [text[:9000] + "inserted words " + text[9000:]] for _, p, q in P.split(t, 800, 50)[1]]
    assert len(set(a) - set(b)) <= 4


def test_very_long_texts():
    for text in ("x" * 300_000, " " * 50_000 + "y", "。" * 40_000):
        level, out = P.split(text, 1000, 100)
        assert "".join(text[p:q] for _, p, q in out) == text and max(q - s for s, _, q in out) <= 1000
        assert level == ("none" if text[0] == "x" else "paragraph" if text[0] == " " else "sentence")


def test_documents(spark):
    rows = [(1, "a b " * 20, " TICKET\n", 0), (2, None, "ticket", 0), (3, "", None, 0), (4, "word " * 30, None, 0), (5, "short", "ticket", 0), (1, "a b " * 20, "ticket", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, max_chars int")
    lim = spark.createDataFrame([("*", 100, 10), ("ticket", 50, 5), ("ticket", 60, 5)], "source string, max_chars long, overlap_chars long")
    got = sorted((r.doc_id, r.cut_level, len(r.pieces)) for r in P.split_documents(docs, lim).collect())
    assert [g[0] for g in got] == [1, 1, 4] and {g[1] for g in got} == {"word"}
    assert P.split_documents(docs.limit(0), lim).count() == 0
    assert P.split_documents(docs, lim.filter("source = 'none'")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_edits_of_paragraph_texts_stay_local(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9)))
    para = lambda: " ".join(" ".join(word() for _ in range(rnd.randint(3, 14))) + "." for _ in range(rnd.randint(1, 5)))
    paras = [para() for _ in range(200)]
    pieces = lambda ps: [t[b:e].strip() for t in ["\n\n".join(ps)] for _, b, e in P.split(t, 400, 60)[1]]
    before = pieces(paras)
    long = " ".join(word() for _ in range(120))  # has no sentence end, so the level of the whole text changes
    for edited in (paras + [long], paras[:90] + [long] + paras[90:], paras[:90] + paras[91:], [long] + paras):
        after = pieces(edited)
        same = 0
        while same < min(len(before), len(after)) and before[same] == after[same]:
            same += 1
        tail = 0
        while tail < min(len(before), len(after)) - same and before[-1 - tail] == after[-1 - tail]:
            tail += 1
        assert len(before) - same - tail <= 8 and len(after) - same - tail <= 12
