import random
import string

import pytest

from lattica.llm import canonical_map as M

LIST = [
    ("e1", "Kelrankal Index", None), ("e2", "Vahulhulin Gateway v2", None), ("e3", "Vahulhulin Gateway v3", ["Korlanan-945"]),
    ("e4", "Jaballoril Works Ltd", ["JWL"]), ("e5", "Yanimhulil on Sea", ["YoS", None, ""]), ("e6", "Quozelwal", None), ("e7", "Torsimgor", ["DUP"]),
    ("e8", "Bralo Team", ["DUP"]), (None, "Nothing", None), ("e9", None, None),
]
CASES = {
    "kelrankal  INDEX": "e1", "Kelrankal_Index": "e1", "Index, Kelrankal": "e1", "KelrankalIndex": "e1", "our Kelrаnkal Index (prod)": "e1", "Kelranakl Indx": "e1", "Re: Kelrankál Index": "e1",
    "Vahulhulin Gateway v2": "e2", "VahulhulinGatewayv3": "e3", "Vahulhulin Gtw ver. 3": "e3", "Vahulhulin Gateway v7": M.UNMATCHED, "Vahulhulin Gateway": M.UNMATCHED, "korlanan 945": "e3",
    "jaballoril works plc": "e4", "J.W.L.": "e4", "yos ": "e5", "Yanimhulil ön Sea": "e5", "Quoezlwal": "e6", "DUP": M.UNMATCHED, "misc": M.UNMATCHED, "": M.UNMATCHED, " ? ": M.UNMATCHED, "Dotunhul Works Ltd": M.UNMATCHED, "the": M.UNMATCHED,
}


@pytest.mark.parametrize("value", CASES)
def test_cases(value):
    assert M.Index(LIST).find(value) == CASES[value]


def test_edits_against_plain_recursion():
    rnd = random.Random(7)

    def plain(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(300):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 7))) for _ in range(2))
        assert M.edits(a, b, 3) == min(plain(a, b), 4)


def test_scores_are_cosines():
    index = M.Index([(f"e{i}", "".join(random.Random(i).choices(string.ascii_lowercase, k=9)), None) for i in range(30)])
    for entity, found in index.forms:
        at, s = index.scores(found)
        assert s.max() == pytest.approx(1) and index.forms[int(at[s.argmax()])][0] == entity


def test_documents(spark):
    docs = spark.createDataFrame([(1, ["Quozelwal", None, "", "Quozelwal"], 5), (2, None, 5), (3, [], 5)], "doc_id long, entities array<string>, value long")
    canonical = spark.createDataFrame(LIST, "entity_id string, label string, aliases array<string>")
    got = sorted(tuple(r) for r in M.map_entities(docs, canonical).collect())
    assert got == [(1, 0, "e6"), (1, 2, M.UNMATCHED), (1, 3, "e6")]
    assert M.map_entities(docs.limit(0), canonical).count() == 0
    assert {r.entity_id for r in M.map_entities(docs, canonical.limit(0)).collect()} == {M.UNMATCHED}


def test_a_list_too_long_to_broadcast_gives_the_same_answers(spark, monkeypatch):
    rnd = random.Random(9)
    parts = "amber basin cipher ditch ember funnel girder hangar inlet jetty".split()
    entries = [(f"e{i:03}", f"{rnd.choice(parts)} {rnd.choice(parts)} {rnd.choice(['', 'v' + str(i % 9)])}".strip(), [f"{rnd.choice(parts)} unit {i}", None, f"q{i}"] if i % 3 else None) for i in range(80)] + [(None, "x", None), ("gap", None, None)]
    values = [x for _, x, _ in entries if x] + [f"The {x.upper()}!" for _, x, _ in entries if x] + ["q7", "q8", "", "!!", "ambr basn", "nothing like it", "hangar unit 31", "inlet  jety"]
    v = spark.createDataFrame([(x,) for x in dict.fromkeys(values)], "value string")
    c = spark.createDataFrame(entries, "entity_id string, label string, aliases array<string>")
    near = {tuple(r) for r in M.map_values(v, c).collect()}
    monkeypatch.setattr(M, "MAX_LIST", 10)
    assert {tuple(r) for r in M.map_values(v, c).collect()} == near and len({e for _, e in near}) > 20
    assert {tuple(r) for r in M.map_values(v.limit(3), c.limit(0).union(c.filter("entity_id = 'gap'"))).collect()} == {(x, M.UNMATCHED) for x in list(dict.fromkeys(values))[:3]}


def test_many_names_of_one_entry_hide_no_other(spark):
    index = M.Index([("a", "amber girder hall", [f"amber girder hall {x}" for x in "qwertyuiop"]), ("b", "amber girder hale", None)])
    assert index.find("amber girder hall") == "a" and index.find("amber girder hale") == "b"
