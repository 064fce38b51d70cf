import os
import random

import pytest

from lattica.llm import mix as M
from lattica.llm.tokenize import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")


@pytest.mark.parametrize("seed", [1, 2])
def test_thresholds_against_sorting(spark, seed):
    rnd = random.Random(seed)
    docs = [(i, rnd.choice(["a", "a", "a", "b"]), rnd.randint(1, 50), rnd.getrandbits(M.BITS)) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, h long")
    wanted = [{"source": s, "rest": float(r)} for s in "ab" for r in (0, 10, 300, 900)]
    M.thresholds(frame, wanted)
    for w in wanted:
        total, best = 0, 0
        for _, _, n, _ in sorted((d for d in docs if d[1] == w["source"]), key=lambda d: d[3]):
            if total + n > w["rest"]:
                best = total + n if total + n - w["rest"] < w["rest"] - total else total
                break
            total += n
        assert sum(d[2] for d in docs if d[1] == w["source"] and d[3] < w["below"]) == best


def test_mix(spark):
    rows = [(i, "word " * (i % 7 + 1), [" A", "a", "B", "c\n", None][i % 5]) for i in range(300)] + [(0, "word", "a"), (None, "none", "a"), (900, None, "a"), (901, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "A", 0.5, 2), ("m", "b ", 0.3, 1), ("m", "zz", 0.2, 9), ("n", "b", 0.1, None), (None, "a", 1.0, 1)], "mix string, source string, target_share double, max_repeats long")
    picked, plan, total = M.select_mix(docs, targets)
    rows = picked.collect()
    assert all(r.copies <= {"a": 2, "b": 1}[r.source] for r in rows) and {r.mix for r in rows} == {"m"}
    assert len({(r.mix, r.doc_id) for r in rows}) == len(rows) and not {900, 901} & {r.doc_id for r in rows}
    got = sum(r.copies * r.n_tokens for r in rows if r.source == "a")
    assert abs(got - 0.5 * total) <= 9
    assert M.select_mix(docs.limit(0), targets)[0].count() == 0
    assert M.select_mix(docs, targets.limit(0))[0].count() == 0
