"""Typed columns: what a compiled expression is."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .syntax import RuleError

NUMBERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)
EXACT = T.DecimalType(28, 10)
MISSING = object()


@dataclass(frozen=True)
class Val:
    """A Column with its type and what is known of it at compile time.

    ok: where the value exists; elsewhere its evaluation is an error (None: everywhere).
    present: where the key exists in its object (None: everywhere).
    sure: never null. const: the value itself, if a literal. fields: of an
    object put together at compile time. bounds: of an interval. zone: of a date.
    """

    col: Column
    type: T.DataType
    ok: Column | None = None
    sure: bool = False
    const: object = MISSING
    fields: dict[str, Val] | None = None
    bounds: tuple | None = None
    zone: str = "UTC"
    present: Column | None = field(default=None)

    @property
    def number(self) -> bool:
        return isinstance(self.type, NUMBERS)

    @property
    def string(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def boolean(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def date(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.DateType, T.TimestampNTZType))

    @property
    def array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def object(self) -> bool:
        return self.fields is not None or isinstance(self.type, (T.StructType, T.MapType))

    @property
    def nothing(self) -> bool:
        return isinstance(self.type, T.NullType) and self.fields is None

    @property
    def variant(self) -> bool:
        return isinstance(self.type, T.VariantType)


def both(*conditions: Column | None) -> Column | None:
    """The conjunction; None is true."""
    known = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, known) if known else None


def null() -> Val:
    return Val(F.lit(None), T.NullType(), const=None)


def failed() -> Val:
    return Val(F.lit(None), T.NullType(), ok=F.lit(False))


def literal(x: object) -> Val:
    if x is None:
        return null()
    kind = T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType()
    col = F.lit(x) if not isinstance(x, int) or isinstance(x, bool) else F.lit(x).cast("long")
    return Val(col, kind, sure=True, const=x)


def given(v: Val) -> Column | None:
    """Where a value is not null; None if that is everywhere."""
    return None if v.sure else v.col.isNotNull()


def kind_name(t: T.DataType) -> str:
    return "number" if isinstance(t, NUMBERS) else "date" if isinstance(t, (T.TimestampType, T.DateType)) else t.simpleString()


def unify(types: list[T.DataType]) -> T.DataType:
    """The least type that holds all; RuleError where there is none."""
    types = [t for t in types if not isinstance(t, T.NullType)]
    if not types:
        return T.NullType()
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(isinstance(t, NUMBERS) for t in types):
        if any(isinstance(t, (T.DoubleType, T.FloatType)) for t in types):
            return T.DoubleType()
        if decimals := [t for t in types if isinstance(t, T.DecimalType)]:
            scale = max(t.scale for t in decimals)
            return T.DecimalType(min(38, max([19, *(t.precision - t.scale for t in decimals)]) + scale), scale)
        return T.LongType()
    if all(isinstance(t, T.ArrayType) for t in types):
        return T.ArrayType(unify([t.elementType for t in types]))
    if all(isinstance(t, T.StructType) for t in types):
        names = dict.fromkeys(f.name for t in types for f in t.fields)
        return T.StructType([T.StructField(n, unify([f.dataType for t in types for f in t.fields if f.name == n])) for n in names])
    if all(isinstance(t, (T.TimestampType, T.DateType)) for t in types):
        return T.TimestampType()
    if all(isinstance(t, T.StringType) for t in types):
        return T.StringType()
    raise RuleError(f"no common type of {', '.join(sorted({kind_name(t) for t in types}))}")


def convert(col: Column, have: T.DataType, want: T.DataType) -> Column:
    """``col`` as ``want``; fields that it lacks are null."""
    if have == want:
        return col
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name: f.dataType for f in have.fields}
        made = F.struct(*[(convert(col.getField(f.name), own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])
        return F.when(col.isNotNull(), made)
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType) and not isinstance(have.elementType, T.NullType):
        return F.transform(col, lambda x: convert(x, have.elementType, want.elementType))
    if isinstance(want, T.NullType):
        return col
    if isinstance(want, T.VariantType) and isinstance(have, (T.StructType, T.MapType)):
        return F.to_variant_object(col)
    return col.cast(want)


def solid(v: Val) -> Val:
    """A value with one Column; compile-time objects become structs."""
    if v.fields is None:
        return v
    parts = {k: solid(x) for k, x in v.fields.items()}
    shown = {k: x for k, x in parts.items()}
    if not shown:
        return replace(v, col=F.create_map().cast("map<string,string>"), type=T.MapType(T.StringType(), T.StringType()), fields=None)
    col = F.struct(*[(F.when(x.present, x.col) if x.present is not None else x.col).alias(k) for k, x in shown.items()])
    kind = T.StructType([T.StructField(k, x.type) for k, x in shown.items()])
    return Val(col, kind, ok=both(v.ok, *(x.ok for x in shown.values())), sure=True, present=v.present)


def open_up(v: Val) -> Val:
    """A struct Column as a compile-time object."""
    if v.fields is not None or not isinstance(v.type, T.StructType):
        return v
    here = None if v.sure else v.col.isNotNull()
    fields = {f.name: Val(v.col.getField(f.name), f.dataType, ok=v.ok, sure=v.sure and not f.nullable, present=here) for f in v.type.fields}
    return Val(v.col, T.NullType(), ok=v.ok, fields=fields, present=v.present)


def member(v: Val, name: str) -> Val:
    """A field; null where the key or the object is missing."""
    if v.fields is not None:
        x = v.fields.get(name)
        if x is None:
            return replace(null(), ok=v.ok)
        if x.present is not None and x.fields is None:
            return replace(x, col=F.when(x.present, x.col), sure=False, present=None, const=MISSING)
        return x
    if isinstance(v.type, T.StructType):
        f = next((f for f in v.type.fields if f.name == name), None)
        if f is None:
            return replace(null(), ok=v.ok)
        return Val(v.col.getField(name), f.dataType, ok=v.ok, sure=v.sure and not f.nullable)
    if isinstance(v.type, T.MapType):
        return Val(F.try_element_at(v.col, F.lit(name)), v.type.valueType, ok=v.ok)
    if v.variant:
        return Val(F.try_variant_get(v.col, f"$['{name}']", "variant"), T.VariantType(), ok=v.ok)
    return replace(null(), ok=v.ok)


def merged(base: Val, patch: Val) -> Val:
    """JSON merge patch: objects merge, a present null deletes its key, anything else replaces."""
    base, patch = open_up(base), open_up(patch)
    if patch.fields is None:
        return base
    if base.fields is None:
        base = Val(patch.col, T.NullType(), fields={})
    out = dict(base.fields)
    for k, p in patch.fields.items():
        b = out.get(k)
        if p.object and (p.fields is not None or isinstance(p.type, T.StructType)) and b is not None and b.object and not isinstance(b.type, T.MapType):
            inner = merged(replace(b, present=None), replace(p, present=None))
            if p.present is not None:  # where the patch is missing its parts are
                inner = merged(replace(b, present=None), guarded(replace(p, present=None), p.present))
            there = None if b.present is None or p.present is None else b.present | p.present
            out[k] = replace(inner, present=there)
            continue
        if b is None:
            out[k] = without_null(p)
        elif p.present is None:
            out[k] = without_null(p)
        else:
            pv, bv = solid(p), solid(b)
            try:
                kind = unify([pv.type, bv.type])
                pc, bc = convert(pv.col, pv.type, kind), convert(bv.col, bv.type, kind)
            except RuleError:
                kind = T.VariantType()
                pc, bc = (F.to_variant_object(x.col) if x.object or x.array else x.col.cast(kind) for x in (pv, bv))
            there = F.when(p.present, pc.isNotNull()).otherwise(b.present if b.present is not None else F.lit(True))
            out[k] = Val(F.when(p.present, pc).otherwise(bc), kind, ok=both(p.ok, b.ok), present=there, zone=p.zone)
    return Val(base.col, T.NullType(), ok=both(base.ok, patch.ok), fields=out, present=base.present)


def without_null(v: Val) -> Val:
    """A patch's value: where it is null, its key goes."""
    if v.fields is not None or v.sure:
        return v
    if v.nothing:
        return replace(v, present=F.lit(False))
    return replace(v, present=both(v.present, v.col.isNotNull()))


def guarded(v: Val, where: Column | None) -> Val:
    """The object, with its keys present only ``where``."""
    v = open_up(v)
    if where is None or v.fields is None:
        return v
    return replace(v, fields={k: replace(x, present=both(where, x.present)) for k, x in v.fields.items()}, ok=None if v.ok is None else ~where | v.ok)


def placed(path: list[str], v: Val, into: Val | None = None) -> Val:
    """``v`` at a dotted path of an object, made on the way; nothing happens where the way is no object."""
    base = open_up(into) if into is not None else Val(F.lit(None), T.NullType(), fields={})
    if base.fields is None:
        return base
    fields = dict(base.fields)
    if len(path) == 1:
        fields[path[0]] = v
    else:
        below = fields.get(path[0])
        fields[path[0]] = placed(path[1:], v, below)
    return replace(base, fields=fields)


def settled_type(types: list[T.DataType]) -> T.DataType:
    """The least common type; VARIANT where there is no other."""
    try:
        return unify(types)
    except RuleError:
        return T.VariantType()
