"""The function table: strings, numbers, conversions, arrays and objects."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Scope, array_of, typed_like
from ..plans.syntax import RuleError
from ..plans.typed import EXACT, MISSING, Val, both, convert, failed, given, literal, member, merged, null, open_up, solid, unify

STRING, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
#: Unicode white space, which Spark's own trim leaves.
SPACES = r"[\s\u0085   -     　]+"


def call(name: str, args: list[Val], s: Scope) -> Val:
    from . import dates

    f = FUNCTIONS.get(name) or dates.FUNCTIONS.get(name)
    if f is None:
        if name in s.udfs:
            return s.udfs[name](*args)
        raise RuleError(f"no function {name!r}")
    return f(args, s)


def strings(n: int, make: Callable[..., Column], kind: T.DataType = STRING) -> Callable:
    """A function of n strings that never fails on strings."""

    def f(args: list[Val], s: Scope) -> Val:
        args = [typed_like(a, STRING) for a in args]
        if len(args) != n or not all(a.string for a in args):
            return failed()
        return Val(make(*(a.col for a in args)), kind, ok=both(*(a.ok for a in args), *(given(a) for a in args)), sure=all(a.sure for a in args))

    return f


def numbers(make: Callable[[Column, Val], Column], kind: T.DataType | None = None) -> Callable:
    """A function of one number."""

    def f(args: list[Val], s: Scope) -> Val:
        a = typed_like(args[0], DOUBLE)
        if len(args) != 1 or not a.number:
            return failed()
        v = Val(make(a.col, a), kind or a.type, ok=both(a.ok, given(a)), sure=a.sure)
        return replace(v, col=v.col.cast(EXACT), type=EXACT) if s.exact else v

    return f


def whole(rounded: Callable[[Column], Column]) -> Callable[[Column, Val], Column]:
    """Rounding keeps a double a double and an integer as it is."""

    def make(c: Column, a: Val) -> Column:
        if isinstance(a.type, (T.DoubleType, T.FloatType)):
            return rounded(c).cast("double")
        return rounded(c).cast(a.type)

    return make


def _round(args: list[Val], s: Scope) -> Val:
    a, digits = args[0], args[1] if len(args) > 1 else literal(0)
    if not (a.number and digits.number):
        return failed()
    ok = both(a.ok, digits.ok, given(a), given(digits), None if isinstance(digits.const, int) and digits.const >= 0 else digits.col >= 0)
    if isinstance(a.type, (T.LongType, T.IntegerType)):
        return replace(a, ok=ok, const=MISSING)
    if isinstance(digits.const, int):
        return Val(F.round(a.col, digits.const).cast(a.type), a.type, ok=ok, sure=a.sure)
    scale = F.pow(F.lit(10.0), digits.col)
    x = a.col.cast("double") * scale
    return Val((F.signum(x) * F.floor(F.abs(x) + 0.5) / scale).cast(a.type), a.type, ok=ok, sure=a.sure)


def _trunc(args: list[Val], s: Scope) -> Val:
    a, digits = args[0], args[1] if len(args) > 1 else literal(0)
    if not (a.number and digits.number):
        return failed()
    ok = both(a.ok, digits.ok, given(a), given(digits))
    if isinstance(a.type, (T.LongType, T.IntegerType)):
        return replace(a, ok=ok, const=MISSING)
    if isinstance(a.type, T.DecimalType):
        scale = F.pow(F.lit(10.0), digits.col).cast("decimal(18,0)")
        x = F.abs(a.col) * scale
        cut = F.floor(x).cast("decimal(28,0)") / scale
        return Val((F.when(a.col < 0, -cut).otherwise(cut)).cast(a.type), a.type, ok=ok, sure=a.sure)
    if isinstance(digits.const, int) and digits.const == 0:
        return Val(F.when(a.col < 0, F.ceil(a.col)).otherwise(F.floor(a.col)).cast("double"), a.type, ok=ok, sure=a.sure)
    # through a decimal, or 1.15 * 100 would be cut to 114
    scale = F.pow(F.lit(10.0), digits.col)
    x = F.abs(a.col).cast("decimal(38,15)") * scale.cast("decimal(18,0)")
    return Val((F.signum(a.col) * F.floor(x).cast("double") / scale).cast(a.type), a.type, ok=ok, sure=a.sure)


def _rand(args: list[Val], s: Scope) -> Val:
    a = args[0]
    if not a.number:
        return failed()
    return Val(F.floor(F.rand() * (a.col + 1)).cast("long"), LONG, ok=both(a.ok, given(a)), sure=a.sure)


def shown(c: Column, kind: T.DataType) -> Column:
    """A number as text, without trailing zeros."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = F.when(F.abs(c) < 1e15, c.cast("decimal(38,15)").cast("string")).otherwise(c.cast("string"))
        return F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(kind, T.DecimalType) and kind.scale > 0:
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return c.cast("string")


def to_string(v: Val) -> Val:
    if v.nothing:
        return replace(literal("null"), ok=v.ok)
    if v.string:
        c = v.col
    elif v.number:
        c = shown(v.col, v.type)
    elif v.boolean:
        c = v.col.cast("string")
    elif v.variant:
        c = F.try_variant_get(v.col, "$", "string")
    else:
        return failed()
    if isinstance(v.const, str):
        return v
    return Val(c if v.sure else F.coalesce(c, F.lit("null")), STRING, ok=v.ok, sure=True)


def _number(args: list[Val], s: Scope) -> Val:
    v = args[0]
    kind = EXACT if s.exact else DOUBLE
    if v.number:
        return replace(v, ok=both(v.ok, given(v)))
    if v.boolean:
        return Val(v.col.cast("int").cast(kind if s.exact else LONG), kind if s.exact else LONG, ok=both(v.ok, given(v)), sure=v.sure)
    if v.string or v.variant:
        text = F.try_variant_get(v.col, "$", "string") if v.variant else v.col
        c = F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text)).try_cast(kind)
        return Val(c, kind, ok=both(v.ok, c.isNotNull()))
    return failed()


def _bool(args: list[Val], s: Scope) -> Val:
    v = args[0]
    if v.nothing:
        return replace(literal(False), ok=v.ok)
    if v.boolean:
        return Val(v.col if v.sure else F.coalesce(v.col, F.lit(False)), BOOL, ok=v.ok, sure=True)
    if v.number:
        return Val(F.coalesce(v.col != 0, F.lit(False)), BOOL, ok=v.ok, sure=True)
    if v.string:
        t = F.trim(v.col)
        return Val(F.coalesce(F.when(t == "true", True).when(t == "false", False).otherwise(v.col == ""), F.lit(False)), BOOL, ok=v.ok, sure=True)
    if v.fields is not None:
        return replace(literal(True), ok=v.ok)
    return Val(v.col.isNotNull(), BOOL, ok=v.ok, sure=True)


def _is_numeric(args: list[Val], s: Scope) -> Val:
    v = args[0]
    if v.number:
        return Val(F.lit(True) if v.sure else v.col.isNotNull(), BOOL, ok=v.ok, sure=True)
    if v.string:
        return Val(F.coalesce(F.trim(v.col).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False)), BOOL, ok=v.ok, sure=True)
    return replace(literal(False), ok=v.ok)


def _type(args: list[Val], s: Scope) -> Val:
    v = args[0]
    name = "null" if v.nothing else "interval" if v.bounds else "number" if v.number else "string" if v.string else "bool" if v.boolean else "date" if v.date else "array" if v.array else "object"
    if v.variant:
        k = F.schema_of_variant(v.col)
        c = F.when(k.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(k == "STRING", "string").when(k == "BOOLEAN", "bool").when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").otherwise("null")
        return Val(F.coalesce(c, F.lit("null")), STRING, ok=v.ok, sure=True)
    if v.sure or v.fields is not None or v.nothing:
        return replace(literal(name), ok=v.ok)
    return Val(F.when(v.col.isNull(), "null").otherwise(name), STRING, ok=v.ok, sure=True)


def _len(args: list[Val], s: Scope) -> Val:
    v = solid(args[0])
    if v.string:
        return Val(F.octet_length(v.col).cast("long"), LONG, ok=both(v.ok, given(v)), sure=v.sure)
    if v.array:
        return Val(F.size(v.col).cast("long"), LONG, ok=both(v.ok, given(v)), sure=v.sure)
    return failed()


def _contains(args: list[Val], s: Scope) -> Val:
    a, b = args
    if a.array:
        item = Val(a.col, a.type.elementType)
        b = typed_like(b, item.type)
        ok = both(a.ok, b.ok, given(a))
        if b.nothing:
            return Val(F.exists(a.col, lambda x: x.isNull()), BOOL, ok=ok, sure=a.sure)
        if not (item.number and b.number or item.string and b.string or item.boolean and b.boolean):
            return Val(F.lit(False), BOOL, ok=ok, sure=True)
        if b.sure and not a.type.containsNull:
            return Val(F.array_contains(a.col, b.col), BOOL, ok=ok, sure=a.sure)
        return Val(F.exists(a.col, lambda x: x.eqNullSafe(b.col)), BOOL, ok=ok, sure=a.sure)
    return strings(2, lambda x, y: F.contains(x, y), BOOL)([a, b], s)


def _matches(args: list[Val], s: Scope) -> Val:
    if isinstance(args[1].const, str):
        try:
            re.compile(args[1].const)
        except re.error:
            return failed()
    return strings(2, lambda x, y: F.rlike(x, y), BOOL)(args, s)


def _extract(args: list[Val], s: Scope) -> Val:
    a, p = args
    if not (a.string and isinstance(p.const, str)):
        if not isinstance(p.const, str) and p.string:
            raise RuleError("extract needs a literal pattern")
        return failed()
    groups = re.compile(p.const).groups
    hit = F.rlike(a.col, p.col)
    found = F.array(*[F.regexp_extract(a.col, p.const, i) for i in range(groups + 1)])
    parts = F.concat(F.slice(found, 1, 1), F.filter(F.slice(found, 2, groups), lambda x: x != "")) if groups else found
    return Val(F.when(hit, parts).otherwise(F.array().cast("array<string>")), T.ArrayType(STRING, False), ok=both(a.ok, given(a)), sure=a.sure)


def _split(args: list[Val], s: Scope) -> Val:
    a, sep = args
    if not (a.string and sep.string):
        return failed()
    ok = both(a.ok, sep.ok, given(a), given(sep))
    if isinstance(sep.const, str):
        if not sep.const:
            return Val(F.concat(F.array(F.lit("")), F.split(a.col, ""), F.array(F.lit(""))), T.ArrayType(STRING, False), ok=ok, sure=a.sure)
        return Val(F.split(a.col, "\\Q" + sep.const.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), T.ArrayType(STRING, False), ok=ok, sure=a.sure)
    return Val(F.split(a.col, F.concat(F.lit("\\Q"), sep.col, F.lit("\\E"))), T.ArrayType(STRING, False), ok=ok)


def fuzzy_udf(many: bool) -> Callable:
    """Arrow-batched: each different pair once, pairs of equal lengths together. All that it needs is made here, so that workers needn't import this package."""
    import pandas as pd

    def distances(pairs: list[tuple[str, str]]):
        """Unrestricted Damerau-Levenshtein distances of pairs with the same two lengths, none of them 0."""
        import numpy as np

        n, la, lb = len(pairs), len(pairs[0][0]), len(pairs[0][1])
        a, b = (np.frombuffer("".join(p[k] for p in pairs).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, -1) for k in (0, 1))
        rows, big = np.arange(n), la + lb
        d = np.full((la + 2, lb + 2, n), big, np.int32)
        d[1:, 1] = np.arange(la + 1)[:, None]
        d[1, 1:] = np.arange(lb + 1)[:, None]
        last = np.zeros((lb + 1, n), np.int64)  # where in a the character of b was seen last
        for i in range(1, la + 1):
            at = np.zeros(n, np.int64)
            for j in range(1, lb + 1):
                same = a[:, i - 1] == b[:, j - 1]
                swapped = d[last[j], at, rows] + (i - last[j] - 1) + 1 + (j - at - 1)
                d[i + 1, j + 1] = np.minimum(np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1), swapped)
                at[same] = j
                last[j, same] = i
        return d[la + 1, lb + 1]

    def similarities(pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
        """1 less the distance over the longer length."""
        out: dict[tuple[str, str], float] = {}
        sizes: dict[tuple[int, int], list[tuple[str, str]]] = {}
        for p in set(pairs):
            if p[0] == p[1] or not p[0] or not p[1]:
                out[p] = float(p[0] == p[1])
            else:
                sizes.setdefault((len(p[0]), len(p[1])), []).append(p)
        for (la, lb), own in sizes.items():
            step = max(1, 4_000_000 // ((la + 2) * (lb + 2)))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                out |= {p: 1 - x / max(la, lb) for p, x in zip(part, distances(part).tolist(), strict=True)}
        return out

    if many:

        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            pairs = [None if x is None or y is None else [None if z is None else (z, y) for z in x] for x, y in zip(a, b, strict=True)]
            known = similarities([p for row in pairs if row for p in row if p])
            return pd.Series([None if row is None else [None if p is None else known[p] for p in row] for row in pairs])

        run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, T.ArrayType(DOUBLE))

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [None if x is None or y is None else (x, y) for x, y in zip(a, b, strict=True)]
        known = similarities([p for p in pairs if p])
        return pd.Series([None if p is None else known[p] for p in pairs], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DOUBLE)


def _fuzzy(args: list[Val], s: Scope) -> Val:
    a, b = args
    many = a.array and isinstance(a.type.elementType, T.StringType)
    if not (b.string and (a.string or many)):
        return failed()
    return Val(fuzzy_udf(many)(a.col, b.col), T.ArrayType(DOUBLE) if many else DOUBLE, ok=both(a.ok, b.ok, given(a), given(b)), sure=a.sure and b.sure)


# -- arrays


def numbers_of(args: list[Val], s: Scope) -> Val | None:
    """The argument, if it is an array of numbers (an empty array is)."""
    a = solid(args[0])
    if a.array and isinstance(a.type.elementType, T.NullType):
        return replace(a, col=a.col.cast("array<bigint>"), type=T.ArrayType(LONG))
    if a.array and isinstance(a.type.elementType, T.IntegerType):
        return replace(a, col=a.col.cast("array<bigint>"), type=T.ArrayType(LONG, a.type.containsNull))
    return a if a.array and Val(a.col, a.type.elementType).number else None


def no_nulls(a: Val) -> Column | None:
    return None if not a.type.containsNull else ~F.exists(a.col, lambda x: x.isNull())


def total(a: Val) -> tuple[Column, T.DataType]:
    kind = a.type.elementType
    if isinstance(kind, T.DecimalType):
        kind = T.DecimalType(38, kind.scale)
    zero = F.lit(0).cast(kind)
    add = (lambda x, y: x + y) if isinstance(kind, (T.DoubleType, T.FloatType)) else (lambda x, y: F.try_add(x, y).cast(kind))
    return F.aggregate(a.col, zero, add), kind


def _sum(args: list[Val], s: Scope) -> Val:
    a = numbers_of(args, s)
    if a is None:
        return failed()
    c, kind = total(a)
    v = Val(c, kind, ok=both(a.ok, given(a), no_nulls(a), None if isinstance(kind, T.DoubleType) else c.isNotNull()), sure=a.sure and isinstance(kind, T.DoubleType))
    return replace(v, col=v.col.cast(EXACT), type=EXACT) if s.exact else v


def _avg(args: list[Val], s: Scope) -> Val:
    a = numbers_of(args, s)
    if a is None:
        return failed()
    c, kind = total(a)
    out = F.try_divide(c if isinstance(kind, T.DecimalType) else c.cast("double"), F.size(a.col))
    kind = EXACT if s.exact else kind if isinstance(kind, T.DecimalType) else DOUBLE
    return Val(out.cast(kind), kind, ok=both(a.ok, given(a), no_nulls(a), F.size(a.col) > 0))


def extreme(make: Callable) -> Callable:
    def f(args: list[Val], s: Scope) -> Val:
        a = solid(args[0])
        if not (a.array and (Val(a.col, a.type.elementType).number or Val(a.col, a.type.elementType).date)):
            return failed()
        return Val(make(a.col), a.type.elementType, ok=both(a.ok, given(a), no_nulls(a), F.size(a.col) > 0))

    return f


def _median(args: list[Val], s: Scope) -> Val:
    a = numbers_of(args, s)
    if a is None:
        return failed()
    kind = DOUBLE if not isinstance(a.type.elementType, T.DecimalType) else a.type.elementType
    n, x = F.size(a.col), F.array_sort(a.col)
    mid = F.when(n % 2 == 1, F.get(x, F.floor(n / 2).cast("int")).cast(kind)).otherwise(((F.get(x, F.floor(n / 2).cast("int") - 1) + F.get(x, F.floor(n / 2).cast("int"))) / 2).cast(kind))
    return Val(mid, kind, ok=both(a.ok, given(a), no_nulls(a), n > 0))


def _mode(args: list[Val], s: Scope) -> Val:
    """The commonest number; of several, the largest."""
    a = numbers_of(args, s)
    if a is None:
        return failed()
    counted = F.transform(F.array_distinct(a.col), lambda x: F.struct(F.size(F.filter(a.col, lambda y: y == x)).alias("n"), x.alias("x")))
    return Val(F.array_max(counted).getField("x"), a.type.elementType, ok=both(a.ok, given(a), no_nulls(a), F.size(a.col) > 0))


def _flatten(args: list[Val], s: Scope) -> Val:
    a = solid(args[0])
    if not a.array:
        return failed()
    if isinstance(a.type.elementType, T.ArrayType):
        return Val(F.flatten(F.filter(a.col, lambda x: x.isNotNull())), a.type.elementType, ok=both(a.ok, given(a)), sure=a.sure)
    return replace(a, ok=both(a.ok, given(a)))


def _merge(args: list[Val], s: Scope) -> Val:
    a = solid(args[0])
    if a.array and isinstance(a.type.elementType, T.ArrayType):
        return _flatten([a], s)
    if a.array and isinstance(a.type.elementType, T.MapType):
        pairs = F.flatten(F.transform(F.filter(a.col, lambda x: x.isNotNull()), lambda m: F.map_entries(m)))
        empty = F.create_map().cast(a.type.elementType.simpleString())
        keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
        out = F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)))
        return Val(F.when(F.size(pairs) > 0, out).otherwise(empty), a.type.elementType, ok=both(a.ok, given(a)))
    if a.array and isinstance(a.type.elementType, T.StructType):
        # all elements have all keys here: the last that isn't null wins
        last = F.element_at(F.filter(a.col, lambda x: x.isNotNull()), -1)
        return Val(F.when(F.size(F.filter(a.col, lambda x: x.isNotNull())) > 0, last), a.type.elementType, ok=both(a.ok, given(a)))
    if a.array and isinstance(a.type.elementType, T.NullType):
        return Val(F.lit(None), T.NullType(), ok=a.ok, fields={}, sure=True)
    return failed()


def merge_items(items: list[Val], deep: bool) -> Val:
    """merge and mergeDeep over the elements of an array literal."""
    items = [i for i in items if not i.nothing]
    if items and all(i.array for i in items):
        if deep:
            return failed()
        made = array_of(items)
        return Val(F.flatten(F.filter(made.col, lambda x: x.isNotNull())), made.type.elementType, ok=made.ok, sure=made.sure)
    if not all(i.object for i in items):
        return failed()
    if any(isinstance(i.type, T.MapType) and i.fields is None for i in items):
        return failed()
    out: dict[str, Val] = {}
    for i in items:
        fields = open_up(i).fields or {}
        for k, v in fields.items():
            old = out.get(k)
            if deep and old is not None and old.object and v.object:
                out[k] = merge_items([old, v], True)
            elif deep and old is not None and old.array and v.array:
                kind = unify([old.type, v.type])
                out[k] = Val(F.concat(convert(old.col, old.type, kind), convert(v.col, v.type, kind)), kind, ok=both(old.ok, v.ok))
            else:
                out[k] = v
    return Val(F.lit(None), T.NullType(), ok=both(*(i.ok for i in items)), fields=out, sure=True)


def _keys(args: list[Val], s: Scope) -> Val:
    a = args[0]
    if a.array:
        n = F.size(a.col)
        return Val(F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"))).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG, False), ok=both(a.ok, given(a)), sure=a.sure)
    if not a.object:
        return failed()
    a = open_up(a)
    if a.fields is None:
        return Val(F.map_keys(a.col), T.ArrayType(STRING, False), ok=both(a.ok, given(a)), sure=a.sure)
    return replace(array_of([literal(k) for k in a.fields]), ok=a.ok)


def _values(args: list[Val], s: Scope) -> Val:
    a = args[0]
    if not a.object:
        return failed()
    a = open_up(a)
    if a.fields is None:
        return Val(F.map_values(a.col), T.ArrayType(a.type.valueType), ok=both(a.ok, given(a)), sure=a.sure)
    return array_of([member(a, k) for k in a.fields])


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^" + SPACES, ""), SPACES + "$", "")


FUNCTIONS: dict[str, Callable[[list[Val], Scope], Val]] = {
    "upper": strings(1, F.upper),
    "lower": strings(1, F.lower),
    "trim": strings(1, _trim),
    "startsWith": strings(2, F.startswith, BOOL),
    "endsWith": strings(2, F.endswith, BOOL),
    "contains": _contains,
    "matches": _matches,
    "extract": _extract,
    "split": _split,
    "fuzzyMatch": _fuzzy,
    "abs": numbers(lambda c, a: F.abs(c)),
    "floor": numbers(whole(F.floor)),
    "ceil": numbers(whole(F.ceil)),
    "round": _round,
    "trunc": _trunc,
    "rand": _rand,
    "string": lambda args, s: to_string(args[0]),
    "number": _number,
    "bool": _bool,
    "isNumeric": _is_numeric,
    "type": _type,
    "len": _len,
    "sum": _sum,
    "avg": _avg,
    "min": extreme(F.array_min),
    "max": extreme(F.array_max),
    "median": _median,
    "mode": _mode,
    "flatten": _flatten,
    "merge": _merge,
    "mergeDeep": _merge,
    "keys": _keys,
    "values": _values,
}
