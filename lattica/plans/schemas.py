"""A strict subset of JSON Schema, for what workers hand over: objects are closed and all their fields required.

A definition is compiled once into a checker, which names the first fault of a value and where it lies; `conforms` applies it to a column of JSON texts in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from lattica.plans.evidence import strict_json

Checker = Callable[[object, str], "str | None"]
# The keywords a definition may use, and the types there are.
KEYWORDS = ("type", "properties", "required", "additionalProperties", "items", "enum", "description", "title", "minLength", "maxLength", "minItems", "maxItems", "minimum", "maximum")
TYPES = {
    "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "string": lambda v: isinstance(v, str), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict),
}
#: Bounds: the types they go with, what is measured, and what is said.
BOUNDS = {
    "minLength": (("string",), len, False), "maxLength": (("string",), len, True), "minItems": (("array",), len, False), "maxItems": (("array",), len, True),
    "minimum": (("number", "integer"), lambda v: v, False), "maximum": (("number", "integer"), lambda v: v, True),
}


class SchemaError(ValueError):
    pass


def compiled(schema: object, at: str = "$") -> Checker:
    """The checker of a definition; a definition outside the subset is refused."""
    if not isinstance(schema, dict) or (odd := sorted(set(schema) - set(KEYWORDS))):
        raise SchemaError(f"{at}: no object, or unknown keywords {odd if isinstance(schema, dict) else ''}")
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if not isinstance(kinds, list) or not kinds or len(set(map(str, kinds))) < len(kinds) or not all(isinstance(k, str) and k in TYPES for k in kinds):
        raise SchemaError(f"{at}: type has to name one or more of {', '.join(TYPES)}")
    checks: list[Checker] = [lambda v, p: None if any(TYPES[k](v) for k in kinds) else f"{p} is no {' or '.join(kinds)}", lambda v, p: f"{p} isn't finite" if isinstance(v, float) and not math.isfinite(v) else None]
    checks += _bounds(schema, kinds, at)
    if "enum" in schema:
        checks.append(_enum(schema["enum"], at))
    for kind, words, make in (("object", ("properties", "required", "additionalProperties"), _object), ("array", ("items",), _array)):
        if kind in kinds:
            checks.append(make(schema, at))
        elif used := [w for w in words if w in schema]:
            raise SchemaError(f"{at}: {', '.join(used)} without type {kind}")
    return lambda v, p: next((bad for c in checks if (bad := c(v, p))), None)


def _bounds(schema: dict, kinds: list[str], at: str) -> list[Checker]:
    out: list[Checker] = []
    for word, (goes_with, size, upper) in BOUNDS.items():
        if word not in schema:
            continue
        limit = schema[word]
        whole = size is len
        if isinstance(limit, bool) or not isinstance(limit, int if whole else (int, float)) or (whole and limit < 0) or not math.isfinite(limit):
            raise SchemaError(f"{at}: {word} has to be a {'count' if whole else 'finite number'}")
        if not set(goes_with) & set(kinds):
            raise SchemaError(f"{at}: {word} without type {' or '.join(goes_with)}")
        out.append(lambda v, p, g=goes_with, s=size, n=limit, u=upper, w=word: f"{p} breaks {w} {n}" if any(TYPES[k](v) for k in g) and (s(v) > n if u else s(v) < n) else None)
    return out


def _enum(values: object, at: str) -> Checker:
    if not isinstance(values, list) or not values:
        raise SchemaError(f"{at}: enum has to list something")
    return lambda v, p: None if any(type(v) is type(x) and v == x for x in values) else f"{p} is none of the values listed"


def _object(schema: dict, at: str) -> Checker:
    fields, required = schema.get("properties", {}), schema.get("required", [])
    if not isinstance(fields, dict) or not all(isinstance(k, str) for k in fields):
        raise SchemaError(f"{at}: properties has to be an object")
    if not isinstance(required, list) or len(required) != len(set(map(str, required))) or set(map(str, required)) != set(fields):
        raise SchemaError(f"{at}: required has to name every property once, and no other")
    if schema.get("additionalProperties") is not False:
        raise SchemaError(f"{at}: additionalProperties has to be false")
    inner = {k: compiled(s, f"{at}.{k}") for k, s in fields.items()}

    def check(v: object, p: str) -> str | None:
        if not isinstance(v, dict):
            return None
        if set(v) != set(inner):
            return f"{p} lacks {sorted(set(inner) - set(v))}" if set(inner) - set(v) else f"{p} has {sorted(set(v) - set(inner))}, which nobody asked for"
        return next((bad for k, c in inner.items() if (bad := c(v[k], f"{p}.{k}"))), None)

    return check


def _array(schema: dict, at: str) -> Checker:
    if "items" not in schema:
        raise SchemaError(f"{at}: an array needs items")
    inner = compiled(schema["items"], f"{at}[]")
    return lambda v, p: next((bad for i, x in enumerate(v) if (bad := inner(x, f"{p}[{i}]"))), None) if isinstance(v, list) else None


def conforms(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """Adds fault: what is wrong with the JSON text of the column, null where it conforms; a null text doesn't."""
    compiled(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = compiled(schema)
        for b in batches:
            out = []
            for text in b.column(column).to_pylist():
                try:
                    out.append("no JSON" if text is None else check(strict_json(text), "$"))
                except ValueError as e:
                    out.append(f"no JSON: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "fault"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fault", StringType())]))
