import random

import pytest

from lattica.llm import subjects as S

VOC = S.vocabulary()
SUBJ = [s for _, s in VOC]
ONES = [1.0] * len(VOC)


def about(text):
    f = S.Finder([t for t, _ in VOC])
    return S.shares([h for s in S.sentences(text) if (h := f.terms(s))], ONES, SUBJ)


def test_longest_term_and_words():
    f = S.Finder([t for t, _ in VOC])
    names = lambda x: sorted(VOC[i][0] for i in f.terms(x))
    assert names("The FIELD TRIP and two field surveys") == ["field survey", "field trip"]
    assert names("matchbox rematch") == [] and names("L'élève; 風力発電所は") == ["élève", "風力発電所"]
    assert names("The field office met") == ["field office"]


def test_finder_against_scan():
    f = S.Finder([t for t, _ in VOC])
    rnd = random.Random(1)
    terms = [t for t, s in VOC if s and t[0] < "　"]
    for _ in range(100):
        pick = rnd.sample(terms, 3)
        text = " xx ".join(pick)
        want = {t for t in pick}
        assert want <= {VOC[i][0] for i in f.terms(text)} | {t for t in pick if any(t != o and t in o for o in terms)}


def test_shares_and_ties():
    assert about("The field was wet. The harvest was late. The barn burnt. The goalkeeper left. The open points follow.") == pytest.approx({"farming": 0.75, "sport": 0.25})
    assert about("Nothing else was decided.") == {} and about("") == {}
    assert set(about("The goalkeeper left. The field was wet.")) == {"sport"}


def test_separators():
    run = "; ".join(["The goalkeeper left the match", "The harvest was late"] * 9)
    assert about(run) == {"sport": 0.5, "farming": 0.5}
    assert len(S.sentences("A prefers a smaller barn; B would rather move the harvest. C.")) == 2


def test_documents(spark):
    rows = [(1, "The goalkeeper left. The harvest was late.", "a"), (2, None, "a"), (3, "", "a"), (4, "plain", "a"), (None, "harvest", "a"), (1, "The harvest was late.", "a"), (5, "The tractor " * 5000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    got = {tuple(r) for r in S.subject_rows(docs).collect()}
    assert got == {(1, "sport"), (1, "farming"), (5, "farming")}
    assert S.subject_rows(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, " Sport", "x"), (5, "farming", "y"), (None, "law", "z")], "doc_id long, subject string, annotator string")
    floors, f1 = S.calibrate(S.labelled(S.found_terms(docs), labels), ONES)
    assert f1["sport"] == pytest.approx(2 / 3) and 0 < f1["farming"] <= 1 and set(floors.values()) <= set(S.FLOORS)


def test_subjects_come_from_the_table(spark):
    docs = spark.createDataFrame([(1, "The goalkeeper left. The harvest was late."), (2, "A telescope shows comets.")], "doc_id long, text string")
    listed = spark.createDataFrame([("Farming", "Farming", None), ("astronomy", "Astronomy", "Telescope work and comets."), (None, "x", "y"), ("Farming", "Farming", None)], "subject string, title string, description string")
    assert {tuple(r) for r in S.subject_rows(docs, listed).collect()} == {(1, "Farming"), (2, "astronomy")}
    assert S.subject_rows(docs, listed.limit(0)).count() == 0


def test_a_floor_silences_weak_sentences():
    own = {s: [i for i, (_, x) in enumerate(VOC) if x == (s,)] for s in ("sport", "law")}
    hits = [[own["sport"][0]]] * 3 + [[own["law"][0]]]
    assert S.shares(hits, ONES, SUBJ) == {"sport": 0.75, "law": 0.25}
    assert S.shares(hits, ONES, SUBJ, {"law": 1.5}) == {"sport": 1.0}


def test_calibration_prefers_a_floor_that_labels_ask_for():
    law, sport = (next(i for i, (_, x) in enumerate(VOC) if x == (s,)) for s in ("law", "sport"))
    rows = [([[sport], [sport], [law]], {"sport": 1})] * 200 + [([[law, law, law]], {"law": 1})] * 200
    floors, _ = S.calibrate([(h, S.Counter(w)) for h, w in rows], ONES)
    assert 1.0 < floors["law"] <= 3.0 and floors["sport"] == 0.0
