import pytest
from pyspark.sql import functions as F

from lattica.functions.numbers import round_exact
from lattica.plans import schemas as S

GOOD = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 5}, "tags": {"type": ["array", "null"], "items": {"type": "string", "minLength": 2}, "maxItems": 2}, "kind": {"type": "string", "enum": ["a", "b"]}}, "required": ["kind", "n", "tags"], "additionalProperties": False}


@pytest.mark.parametrize("bad", [
    5, {}, {"type": "thing"}, {"type": []}, {"type": ["string", "string"]}, {"type": "string", "pattern": "x"}, {"type": "object"}, {"type": "object", "additionalProperties": True}, {"type": "object", "properties": {"a": {"type": "null"}}, "additionalProperties": False},
    {"type": "object", "properties": {}, "required": ["a"], "additionalProperties": False}, {"type": "array"}, {"type": "string", "items": {"type": "null"}}, {"type": "string", "minimum": 1}, {"type": "integer", "minimum": float("inf")}, {"type": "string", "maxLength": -1},
    {"type": "string", "maxLength": True}, {"type": "string", "enum": []}, {"type": "string", "required": []}, {"type": "array", "items": {"type": "nope"}},
])
def test_definitions_outside_the_subset(bad):
    with pytest.raises(S.SchemaError):
        S.compiled(bad)


@pytest.mark.parametrize("value, fault", [
    ({"n": 1, "tags": ["xx", "yy"], "kind": "a"}, None), ({"n": 5, "tags": None, "kind": "b"}, None), ({"n": 0, "tags": [], "kind": "a"}, "$.n"), ({"n": 6, "tags": [], "kind": "a"}, "$.n"), ({"n": True, "tags": [], "kind": "a"}, "$.n"), ({"n": 1.0, "tags": [], "kind": "a"}, "$.n"),
    ({"n": 1, "tags": ["x"], "kind": "a"}, "$.tags[0]"), ({"n": 1, "tags": ["xx"] * 3, "kind": "a"}, "$.tags"), ({"n": 1, "tags": [], "kind": "c"}, "$.kind"), ({"n": 1, "tags": []}, "lacks"), ({"n": 1, "tags": [], "kind": "a", "z": 1}, "nobody"), ([], "$"), (None, "$"),
])
def test_values(value, fault):
    got = S.compiled(GOOD)(value, "$")
    assert got is None if fault is None else fault in got
    assert S.compiled({"type": "integer", "enum": [1]})(True, "$") and not S.compiled({"type": ["integer", "boolean"], "enum": [True]})(True, "$")


def test_columns(spark):
    df = spark.createDataFrame([(1, '{"n": 1, "tags": null, "kind": "a"}'), (2, '{"n": 1, "n": 2}'), (3, None), (4, "[]"), (5, "NaN")], "id long, body string")
    got = {r.id: r.fault for r in S.conforms(df, "body", GOOD).collect()}
    assert got[1] is None and "twice" in got[2] and got[3] == "no JSON" and got[4].startswith("$ is no") and "NaN" in got[5]


def test_exact_rounding(spark):
    values = [2.675, 0.125, 0.375, -2.675, 1.005, 0.5, None, 1e300]
    got = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_exact("v", 2).alias("r")).collect()]
    assert got == [None if v is None else round(v, 2) for v in values] and got[0] == 2.67
    assert spark.range(1).select(round_exact(F.lit(None).cast("double"), 2)).first()[0] is None
