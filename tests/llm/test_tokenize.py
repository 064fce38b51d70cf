import os
import random

import pytest

from lattica.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file here")
TEXTS = [
    None, "", " ", "Hello world, it's 12,345 o'clock", "<|endoftext|> stays text", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語のテキスト。\r\n\t  mixed", "\x00\x07 ctrl ​", "x" * 5001, "🙂" * 700,
    "".join(random.Random(3).choices("abcdefgh", k=6000)), "  trailing   ", "don't we'll I'D", "éàü ñandú", "Hello world", "a\x1cb\x0b c\x85d\u2028 e\x1f\x1f  f", "tab\t\tend \x1c ",
]


@pytest.fixture(scope="module")
def truth():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_against_library(truth):
    enc = T.Encoder(*T.vocabulary())
    assert enc.encode(TEXTS).to_pylist() == [truth(x) for x in TEXTS]
    assert enc.count(TEXTS).tolist() == [len(truth(x)) for x in TEXTS]
    assert enc.encode([]).to_pylist() == [] and enc.encode([None, ""]).to_pylist() == [[], []]


def test_words_forgotten(truth, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 3)
    enc = T.Encoder(*T.vocabulary())
    for x in TEXTS[3:8]:
        assert enc.encode([x, x]).to_pylist() == [truth(x)] * 2


def test_round_trip(truth):
    from tokenizers import Tokenizer

    enc, back = T.Encoder(*T.vocabulary()), Tokenizer.from_file(T.VOCABULARY)
    for x in TEXTS[3:]:
        assert back.decode(enc.encode([x]).to_pylist()[0], skip_special_tokens=False) == x


def test_documents(spark, truth, monkeypatch):
    rows = [(i, x, "other") for i, x in enumerate(TEXTS)] + [(0, "again", "other"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = T.encode_documents(docs, ["doc_id"]).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.ids) for r in got) == sorted(((i is None, i or 0), truth(x)) for i, x, _ in rows)
    assert T.encode_documents(docs.limit(0), ["doc_id"]).count() == 0
    counts = T.encode_documents(docs.filter("doc_id = 3"), ["doc_id"], counts_only=True).collect()
    assert [r.n_tokens for r in counts] == [len(truth(TEXTS[3]))]


def test_decoding(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)]
    ids = T.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    assert sorted((r.doc_id, r.text) for r in T.decode_documents(ids, ["doc_id"]).collect()) == [(i, x or "") for i, x in rows]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [-5, 10**9])], "doc_id long, ids array<int>")
    assert {r.text for r in T.decode_documents(odd, ["doc_id"]).collect()} == {""}


def test_words_of_any_length_across_the_limit(truth):
    rnd, enc = random.Random(11), T.Encoder(*T.vocabulary())
    for n in (T.LONG - 1, T.LONG, T.LONG + 1, 2 * T.LONG, 997):
        texts = ["".join(rnd.choices(a, k=n)) for a in ("abcdefghijklmnopqrstuvwxyz", "ab", "etaoin", "éàüñß", "日本語文字") for _ in range(4)]
        assert enc.encode(texts).to_pylist() == [truth(x) for x in texts]
