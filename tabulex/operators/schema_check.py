"""JSON Schema on input and output nodes, as one boolean Column."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.typed import Val, both, member, open_up, solid

_KINDS = {"string": "string", "number": "number", "integer": "number", "boolean": "boolean", "array": "array", "object": "object"}


def read_schema(text: object, dictionaries: dict[str, list[str]] | None = None) -> dict | None:
    """The schema of a node; None where there is none or it can't be read."""
    if isinstance(text, str):
        try:
            text = json.loads(text)
        except ValueError:
            return None
    if not isinstance(text, dict):
        return None

    def named(x: object) -> object:
        if isinstance(x, dict):
            if (name := x.get("$dictionary")) is not None:
                return {"type": "string", "enum": (dictionaries or {}).get(name, [])}
            return {k: named(v) for k, v in x.items()}
        return [named(v) for v in x] if isinstance(x, list) else x

    return named(text)


def conforms(v: Val, schema: dict) -> Column | None:
    """Where a value fits; None if everywhere. Null passes only where null is allowed."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if v.nothing:
        return None if not kinds or "null" in kinds else F.lit(False)
    own = "number" if v.number else "string" if v.string or v.date else "boolean" if v.boolean else "array" if v.array else "object"
    tests: list[Column | None] = []
    if kinds and own not in [_KINDS.get(k) for k in kinds]:
        tests.append(F.lit(False))
    elif kinds == ["integer"] and not isinstance(v.type, (T.LongType, T.IntegerType)):
        tests.append(v.col == F.floor(v.col))
    if "enum" in schema:
        allowed = [x for x in schema["enum"] if isinstance(x, str if v.string else bool if v.boolean else (int, float))]
        tests.append(v.col.isin(*allowed) if allowed else F.lit(False))
    if "const" in schema:
        tests.append(v.col == F.lit(schema["const"]))
    for key, test in (("minimum", lambda c, x: c >= x), ("maximum", lambda c, x: c <= x), ("exclusiveMinimum", lambda c, x: c > x), ("exclusiveMaximum", lambda c, x: c < x)):
        if key in schema and v.number:
            tests.append(test(v.col, F.lit(schema[key])))
    if v.string:
        tests += [F.length(v.col) >= schema["minLength"]] if "minLength" in schema else []
        tests += [F.length(v.col) <= schema["maxLength"]] if "maxLength" in schema else []
        tests += [F.rlike(v.col, F.lit(schema["pattern"]))] if "pattern" in schema else []
    if v.array:
        tests += [F.size(v.col) >= schema["minItems"]] if "minItems" in schema else []
        tests += [F.size(v.col) <= schema["maxItems"]] if "maxItems" in schema else []
        if isinstance(schema.get("items"), dict):
            kind = v.type.elementType
            if conforms(Val(F.lit(None).cast(kind) if not isinstance(kind, T.NullType) else F.lit(None), kind), schema["items"]) is not None:
                tests.append(F.forall(v.col, lambda x: F.coalesce(conforms(Val(x, kind), schema["items"]), F.lit(True))))
    if own == "object":
        o = open_up(v)
        for name in schema.get("required") or []:
            x = member(o, name) if o.fields is not None else member(v, name)
            tests.append(F.lit(False) if x.nothing else None if x.fields is not None or x.sure else solid(x).col.isNotNull())
        for name, sub in (schema.get("properties") or {}).items():
            x = member(o, name)
            if not x.nothing and (c := conforms(x, sub)) is not None:
                there = None if x.fields is not None or x.sure else x.col.isNull()
                tests.append(c if there is None else there | c)
    return both(*(None if t is None else F.coalesce(t, F.lit(False)) for t in tests))
