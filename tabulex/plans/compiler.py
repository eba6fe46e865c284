"""Syntax trees to typed Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .syntax import Node, RuleError, parse, parse_cell
from .typed import EXACT, MISSING, Val, both, convert, failed, given, literal, member, null, open_up, placed, solid, unify


@dataclass(frozen=True)
class Scope:
    """What names mean: the context object, ``$``, closure elements and locals."""

    base: Val
    dollar: Val | None = None
    element: Val | None = None
    names: dict[str, Val] = field(default_factory=dict)
    exact: bool = False
    now: str | None = None
    udfs: dict[str, Callable] = field(default_factory=dict)

    def bind(self, **names: Val) -> Scope:
        return replace(self, names={**self.names, **names})

    def name(self, n: str) -> Val:
        if n == "$":
            return self.dollar if self.dollar is not None else self.base
        if n == "#":
            if self.element is None:
                raise RuleError("# stands outside of a closure")
            return self.element
        if n == "$root":
            return self.base
        if n in self.names:
            return self.names[n]
        return member(self.base, n)


def scope_of(schema: T.StructType, prefix: str = "", exact: bool = False, **options) -> Scope:
    """The scope whose context is a row with this schema."""
    fields = {}
    for f in schema.fields:
        fields[f.name] = Val(F.col(f"{prefix}`{f.name.replace('`', '``')}`"), f.dataType, sure=not f.nullable)
    return Scope(Val(F.lit(None), T.NullType(), fields=fields), exact=exact, **options)


def compile_text(text: str, scope: Scope) -> Val:
    return compile_node(parse(text), scope)


def compile_cell(text: str, scope: Scope) -> Val:
    return compile_node(parse_cell(text), scope)


def truth(v: Val) -> Column:
    """True where the value is true; false where it is false, null or an error."""
    if v.const is True:
        return F.lit(True) if v.ok is None else F.coalesce(v.ok, F.lit(False))
    if not v.boolean:
        return F.lit(False)
    c = v.col if v.sure else F.coalesce(v.col, F.lit(False))
    return c if v.ok is None else F.coalesce(v.ok, F.lit(False)) & c


def settled(v: Val, on_error: str = "raise", what: str = "") -> Val:
    """The value where it exists; elsewhere an error is raised or the value is null."""
    v = solid(v)
    if v.ok is None:
        return v
    bad = ~F.coalesce(v.ok, F.lit(False))
    if on_error == "raise":
        message = F.raise_error(F.lit(f"evaluation failed: {what}"))
        kind = v.type if not v.nothing else T.StringType()
        col = F.when(bad, message.cast(kind) if not isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.from_json(message.cast("string"), kind)).otherwise(v.col)
    else:
        col = F.when(~bad, v.col)
    return replace(v, col=col, ok=None, sure=False, const=MISSING)


def numeric(v: Val, scope: Scope) -> Val:
    if scope.exact and v.number and v.type != EXACT:
        return replace(v, col=v.col.cast(EXACT), type=EXACT)
    return v


def compile_node(n: Node, s: Scope) -> Val:
    return _BUILD[n.kind](n, s)


def _number(n: Node, s: Scope) -> Val:
    text = str(n.value)
    if s.exact:
        return Val(F.lit(text).cast(EXACT), EXACT, sure=True, const=float(text) if re.search("[.eE]", text) else int(text))
    if re.search("[.eE]", text):
        return literal(float(text))
    return literal(int(text))


def _name(n: Node, s: Scope) -> Val:
    return numeric(s.name(n.value), s)


def _member(n: Node, s: Scope) -> Val:
    return numeric(member(compile_node(n.args[0], s), n.value), s)


def _index(n: Node, s: Scope) -> Val:
    a, i = (compile_node(x, s) for x in n.args)
    if a.object:
        if i.string and isinstance(i.const, str):
            return numeric(member(a, i.const), s)
        if not i.string:
            return failed()
        a = open_up(a)
        if a.fields is None:
            return Val(F.try_element_at(a.col, i.col), a.type.valueType, ok=both(a.ok, i.ok))
        own = {k: solid(member(a, k)) for k in a.fields}
        kind = unify([v.type for v in own.values()])
        out = F.lit(None).cast(kind)
        for k, v in own.items():
            out = F.when(i.col == k, convert(v.col, v.type, kind)).otherwise(out)
        return Val(out, kind, ok=both(a.ok, i.ok))
    if a.nothing:
        return replace(null(), ok=both(a.ok, i.ok))
    if not i.number:
        return failed()
    at = i.col.cast("int")
    ok = both(a.ok, i.ok, given(i), None if isinstance(i.const, int) and i.const >= 0 else at >= 0)
    if a.array:
        return numeric(Val(F.get(a.col, F.greatest(at, F.lit(0)) if ok is not None else at), a.type.elementType, ok=ok), s)
    if a.string:
        c = F.substring(a.col, at + 1, F.lit(1))
        return Val(F.when(c != "", c), T.StringType(), ok=ok)
    return replace(null(), ok=ok)


def _slice(n: Node, s: Scope) -> Val:
    a = compile_node(n.args[0], s)
    rest = [compile_node(x, s) for x in n.args[1:]]
    if not (a.array or a.string):
        return failed()
    size = F.size(a.col) if a.array else F.length(a.col)
    has_low, has_high = n.value
    low = rest[0].col.cast("int") if has_low else F.lit(0)
    high = rest[-1].col.cast("int") if has_high else size - 1
    inside = (low >= 0) & (high < size) & (low <= high)
    ok = both(a.ok, given(a), *(r.ok for r in rest), inside)
    if a.array:
        return Val(F.when(inside, F.slice(a.col, low + 1, high - low + 1)), a.type, ok=ok)
    return Val(F.when(inside, F.substring(a.col, low + 1, high - low + 1)), T.StringType(), ok=ok)


def array_of(items: list[Val]) -> Val:
    items = [solid(x) for x in items]
    kind = unify([x.type for x in items])
    sure = bool(items) and all(x.sure for x in items)
    col = F.array(*[convert(x.col, x.type, kind) for x in items]) if items else F.array()
    consts = [x.const for x in items]
    return Val(col, T.ArrayType(kind, not sure), ok=both(*(x.ok for x in items)), sure=True, const=consts if all(c is not MISSING for c in consts) else MISSING)


def _array(n: Node, s: Scope) -> Val:
    return array_of([compile_node(x, s) for x in n.args])


def _object(n: Node, s: Scope) -> Val:
    keys = [compile_node(x, s) for x in n.args[: n.value]]
    values = [compile_node(x, s) for x in n.args[n.value :]]
    if all(isinstance(k.const, (str, int, float)) for k in keys):
        fields = {str(k.const): v for k, v in zip(keys, values, strict=True)}
        return Val(F.lit(None), T.NullType(), ok=both(*(v.ok for v in values)), sure=True, fields=fields)
    from ..functions.library import to_string

    made = array_of(values)
    names = [to_string(k) for k in keys]
    return Val(F.map_from_arrays(F.array(*[k.col for k in names]), made.col), T.MapType(T.StringType(), made.type.elementType), ok=both(made.ok, *(k.ok for k in names)), sure=True)


def _template(n: Node, s: Scope) -> Val:
    from ..functions.library import to_string

    parts = [to_string(compile_node(x, s)) for x in n.args]
    if not parts:
        return literal("")
    return Val(F.concat(*[p.col for p in parts]), T.StringType(), ok=both(*(p.ok for p in parts)), sure=True)


def _not(n: Node, s: Scope) -> Val:
    v = typed_like(compile_node(n.args[0], s), T.BooleanType())
    if not v.boolean:
        return failed()
    return Val(~v.col, v.type, ok=both(v.ok, given(v)), sure=v.sure)


def _sign(n: Node, s: Scope) -> Val:
    v = compile_node(n.args[0], s)
    if not v.number:
        return failed()
    if n.kind == "pos":
        return replace(v, ok=both(v.ok, given(v)))
    const = -v.const if isinstance(v.const, (int, float)) else MISSING
    return Val(-v.col, v.type, ok=both(v.ok, given(v)), sure=v.sure, const=const)


def _if(n: Node, s: Scope) -> Val:
    c, yes, no = (compile_node(x, s) for x in n.args)
    c = typed_like(c, T.BooleanType())
    if not c.boolean:
        return failed()
    return choose([(c, yes)], no, both(c.ok, given(c)))


def choose(arms: list[tuple[Val, Val]], rest: Val, ok: Column | None) -> Val:
    """The value of the first arm whose test is true, else ``rest``."""
    values = [solid(v) for _, v in arms] + [solid(rest)]
    kind = unify([v.type for v in values])
    col, good = convert(values[-1].col, values[-1].type, kind), values[-1].ok
    for (test, _), v in zip(reversed(arms), reversed(values[:-1]), strict=True):
        t = truth(test)
        col = F.when(t, convert(v.col, v.type, kind)).otherwise(col)
        if good is not None or v.ok is not None:
            good = F.when(t, v.ok if v.ok is not None else F.lit(True)).otherwise(good if good is not None else F.lit(True))
    return Val(col, kind, ok=both(ok, good), sure=all(v.sure for v in values), zone=values[0].zone)


def typed_like(v: Val, kind: T.DataType) -> Val:
    """A variant read as a type; other values as they are."""
    if v.variant and not isinstance(kind, (T.NullType, T.VariantType)):
        return Val(F.try_variant_get(v.col, "$", kind.simpleString()), kind, ok=v.ok)
    return v


def equal(a: Val, b: Val) -> Val:
    """Never null; false across types, and for arrays and objects."""
    a, b = typed_like(a, b.type), typed_like(b, a.type)
    ok = both(a.ok, b.ok)
    if a.variant and b.variant:
        a, b = (replace(x, col=F.to_json(x.col), type=T.StringType()) for x in (a, b))
    same = a.number and b.number or a.string and b.string or a.boolean and b.boolean or a.date and b.date
    if same:
        col = a.col == b.col if a.sure and b.sure else a.col.eqNullSafe(b.col)
    else:
        none = [F.lit(x.nothing) if x.nothing or x.sure or x.fields is not None else x.col.isNull() for x in (a, b)]
        col = none[0] & none[1]
    return Val(col, T.BooleanType(), ok=ok, sure=True)


def within(a: Val, b: Val) -> Val:
    """a in b."""
    bool_ = T.BooleanType()
    if b.bounds:
        left, right, low, high = b.bounds
        a = typed_like(a, low.type)
        if not (a.number and low.number and high.number or a.date and low.date and high.date):
            return failed()
        above = a.col >= low.col if left == "[" else a.col > low.col
        below = a.col <= high.col if right == "]" else a.col < high.col
        if left in "])":  # reversed: outside
            above = a.col < low.col if left == ")" else a.col <= low.col
            below = a.col > high.col if right == "(" else a.col >= high.col
            return Val(above | below, bool_, ok=both(a.ok, b.ok, given(a)), sure=a.sure)
        return Val(above & below, bool_, ok=both(a.ok, b.ok, given(a)), sure=a.sure)
    if b.array:
        a = typed_like(a, b.type.elementType)
        ok = both(a.ok, b.ok, given(b))
        if isinstance(b.const, list) and not isinstance(b.type.elementType, T.DecimalType):
            items = [literal(x) for x in b.const]
            fit = [x for x in items if not x.nothing and (x.number and a.number or x.string and a.string or x.boolean and a.boolean)]
            col = a.col.isin(*[x.const for x in fit]) if fit else F.lit(False)
            if not a.sure:
                col = F.coalesce(col, F.lit(False))
                if any(x.nothing for x in items):
                    col = col | a.col.isNull()
            return Val(col, bool_, ok=ok, sure=True)
        item = Val(b.col, b.type.elementType)
        if a.nothing:
            return Val(F.exists(b.col, lambda x: x.isNull()), bool_, ok=ok, sure=True)
        if not (a.number and item.number or a.string and item.string or a.boolean and item.boolean or a.date and item.date):
            return Val(F.lit(False), bool_, ok=ok, sure=True)
        return Val(F.exists(b.col, lambda x: x.eqNullSafe(a.col)), bool_, ok=ok, sure=True)
    if b.object:
        if not a.string:
            return failed()
        b = open_up(b)
        if b.fields is not None:
            col = a.col.isin(*b.fields) if b.fields else F.lit(False)
        else:
            col = F.map_contains_key(b.col, a.col)
        return Val(F.coalesce(col, F.lit(False)), bool_, ok=both(a.ok, b.ok), sure=True)
    return failed()


_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _binary(n: Node, s: Scope) -> Val:
    op = n.value
    a, b = (compile_node(x, s) for x in n.args)
    if op in ("==", "!="):
        v = equal(a, b)
        return v if op == "==" else replace(v, col=~v.col)
    if op in ("in", "not in"):
        v = within(a, b)
        return v if op == "in" or not v.boolean else replace(v, col=~v.col)
    if op in ("and", "or"):
        a, b = typed_like(a, T.BooleanType()), typed_like(b, T.BooleanType())
        if not a.boolean:
            return failed()
        stop = F.lit(op == "or")
        b_ok = both(b.ok, given(b)) if b.boolean else F.lit(False)
        first = both(a.ok, given(a))
        if first is None and b_ok is None:
            return Val(a.col & b.col if op == "and" else a.col | b.col, T.BooleanType(), sure=True)
        passed = ~a.col if op == "and" else a.col
        col = F.when(passed, stop).otherwise(b.col if b.boolean else F.lit(None).cast("boolean"))
        return Val(col, T.BooleanType(), ok=both(first, None if b_ok is None else F.coalesce(passed, F.lit(False)) | b_ok), sure=False)
    if op == "??":
        if a.nothing and a.ok is None:
            return b
        a, b = solid(a), solid(b)
        if a.sure:
            return a
        kind = unify([a.type, b.type])
        ok = both(a.ok, None if b.ok is None else a.col.isNotNull() | b.ok)
        return Val(F.coalesce(convert(a.col, a.type, kind), convert(b.col, b.type, kind)), kind, ok=ok, sure=b.sure, zone=a.zone)
    if op in _COMPARE:
        a, b = typed_like(a, b.type), typed_like(b, a.type)
        if not (a.number and b.number or a.date and b.date):
            return failed()
        return Val(_COMPARE[op](a.col, b.col), T.BooleanType(), ok=both(a.ok, b.ok, given(a), given(b)), sure=a.sure and b.sure)
    a, b = typed_like(a, b.type), typed_like(b, a.type)
    if op == "+" and a.string and b.string:
        return Val(F.concat(a.col, b.col), T.StringType(), ok=both(a.ok, b.ok, given(a), given(b)), sure=a.sure and b.sure)
    if not (a.number and b.number):
        return failed()
    return arithmetic(op, a, b, s)


def arithmetic(op: str, a: Val, b: Val, s: Scope) -> Val:
    kind = unify([a.type, b.type])
    ok = both(a.ok, b.ok, given(a), given(b))
    if op == "^":
        col, kind, sure = F.pow(a.col.cast("double"), b.col.cast("double")), T.DoubleType(), a.sure and b.sure
    elif op == "/":
        whole = not isinstance(kind, T.DecimalType)
        x, y = (c.cast("double") if whole else c for c in (a.col, b.col))
        if isinstance(b.const, (int, float)) and b.const:
            col, sure = x / y, a.sure
        else:
            col, sure = F.try_divide(x, y), False
        kind = T.DoubleType() if whole else kind
    elif op == "%":
        col, sure = F.try_mod(a.col, b.col), False
    elif isinstance(kind, T.DoubleType):
        x, y = a.col, b.col
        col, sure = x + y if op == "+" else x - y if op == "-" else x * y, a.sure and b.sure
    else:
        x, y = a.col.cast(kind), b.col.cast(kind)
        col = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        sure, ok = False, both(a.ok, b.ok, col.isNotNull())
    if s.exact:
        col, kind = col.try_cast(EXACT), EXACT
    elif isinstance(kind, T.DecimalType):
        col = col.try_cast(kind)
    return Val(col, kind, ok=ok, sure=sure)


def _interval(n: Node, s: Scope) -> Val:
    low, high = (compile_node(x, s) for x in n.args)
    if not (low.number and high.number or low.date and high.date):
        return failed()
    left, right = n.value
    bounds = (left, right, low, high)
    ok = both(low.ok, high.ok, given(low), given(high))
    if not low.number:
        return Val(F.lit(None), T.NullType(), ok=ok, bounds=bounds)
    first = low.col.cast("long") + F.lit(0 if left == "[" else 1)
    last = high.col.cast("long") - F.lit(0 if right == "]" else 1)
    return Val(F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>")), T.ArrayType(T.LongType(), False), ok=ok, sure=True, bounds=bounds)


def _closure(n: Node, s: Scope) -> Val:
    how, alias = n.value
    over = solid(compile_node(n.args[0], s))
    if not over.array:
        return failed()
    if isinstance(over.type.elementType, T.NullType):
        over = replace(over, col=over.col.cast("array<string>"), type=T.ArrayType(T.StringType()))
    kind = over.type.elementType
    got: list[Val] = []

    def body(x: Column) -> Val:
        e = numeric(Val(x, kind, sure=not over.type.containsNull), s)
        inner = replace(s, element=e)
        if alias:
            inner = inner.bind(**{alias: e})
        return compile_node(n.args[1], inner)

    def column(x: Column) -> Column:
        v = solid(body(x))
        got.append(v)
        return v.col

    if how in ("map", "flatMap"):
        col = F.transform(over.col, column)
    else:
        def test(x: Column) -> Column:
            v = typed_like(body(x), T.BooleanType())
            got.append(v)
            return truth(v)

        hits = F.filter(over.col, test)
        col = {"filter": lambda: hits, "count": lambda: F.size(hits).cast("long"), "one": lambda: F.size(hits) == 1}.get(how, lambda: F.exists(over.col, test) if how != "all" else F.forall(over.col, test))()
        if how == "none":
            col = ~col
    v = got[-1]
    bad = v.ok is not None or how not in ("map", "flatMap") and not v.sure
    each = F.forall(over.col, lambda x: _fine(body(x), how in ("map", "flatMap"))) if bad else None
    if how not in ("map", "flatMap") and not v.boolean:
        each = F.size(over.col) == 0
    ok = both(over.ok, given(over), each)
    if how == "map":
        return Val(col, T.ArrayType(v.type, not v.sure), ok=ok, sure=over.sure)
    if how == "flatMap":
        if v.array:
            return Val(F.flatten(F.filter(col, lambda x: x.isNotNull())), v.type, ok=ok, sure=over.sure)
        return Val(col, T.ArrayType(v.type), ok=ok, sure=over.sure)
    if how == "filter":
        return Val(col, over.type, ok=ok, sure=over.sure)
    return Val(col, T.LongType() if how == "count" else T.BooleanType(), ok=ok, sure=over.sure)


def _fine(v: Val, any_value: bool) -> Column:
    ok = v.ok if any_value else both(v.ok, given(typed_like(v, T.BooleanType())))
    return F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))


def _let(n: Node, s: Scope) -> Val:
    made = Val(F.lit(None), T.NullType(), fields={}, sure=True)
    for path, e in zip(n.value, n.args, strict=False):
        v = compile_node(e, s)
        made = placed(list(path), v, made)
        s = s.bind(**{path[0]: made.fields[path[0]]})
    if len(n.args) > len(n.value):
        return compile_node(n.args[-1], s)
    return made


def _call(n: Node, s: Scope) -> Val:
    from ..functions.library import call, merge_items

    if n.value in ("merge", "mergeDeep") and len(n.args) == 1 and n.args[0].kind == "array":
        # objects of different shapes: their fields are put together here
        return merge_items([compile_node(a, s) for a in n.args[0].args], n.value == "mergeDeep")
    return call(n.value, [compile_node(a, s) for a in n.args], s)


def _method(n: Node, s: Scope) -> Val:
    from ..functions.dates import method

    return method(n.value, compile_node(n.args[0], s), [compile_node(a, s) for a in n.args[1:]], s)


_BUILD: dict[str, Callable[[Node, Scope], Val]] = {
    "num": _number,
    "str": lambda n, s: literal(n.value),
    "bool": lambda n, s: literal(n.value),
    "null": lambda n, s: null(),
    "group": lambda n, s: compile_node(n.args[0], s),
    "template": _template,
    "name": _name,
    "member": _member,
    "index": _index,
    "slice": _slice,
    "array": _array,
    "object": _object,
    "not": _not,
    "neg": _sign,
    "pos": _sign,
    "if": _if,
    "bin": _binary,
    "interval": _interval,
    "closure": _closure,
    "let": _let,
    "call": _call,
    "method": _method,
}
