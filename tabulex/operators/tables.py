"""Decision tables: first hit, collect, and columns that collect."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal, localcontext
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Scope, compile_cell, compile_text, truth
from ..plans.syntax import Node, RuleError, parse, parse_cell
from ..plans.typed import EXACT, Val, both, convert, null, placed, settled_type, solid, unify
from .stage import Inline, Stage

#: From so many rows on, a table of plain tests becomes a broadcast join on one of its columns.
JOIN_ROWS = 40


@dataclass
class Row:
    test: Column | None  # None: always true
    outputs: dict[str, Val]


def cell(rule: dict, column: dict) -> str:
    return str(rule.get(column["id"]) or "").strip()


def field_values(inputs: list[dict], scope: Scope, stage: Stage | Inline) -> dict[str, Val]:
    """The tested value of each input column that names one."""
    out = {}
    for c in inputs:
        if field := str(c.get("field") or "").strip():
            v = solid(compile_text(field, scope))
            node = parse(field)
            out[c["id"]] = v if node.kind in ("name", "member") else stage.hold(v)
    return out


def row_test(rule: dict, inputs: list[dict], fields: dict[str, Val], scope: Scope) -> Column | None:
    tests = []
    for c in inputs:
        text = cell(rule, c)
        if not text:
            continue
        if c["id"] in fields:
            tests.append(truth(compile_cell(text, replace(scope, dollar=fields[c["id"]]))))
        else:
            tests.append(truth(compile_text(text, scope)))
    return reduce(lambda a, b: a & b, tests) if tests else None


def rows_of(content: dict, scope: Scope, stage: Stage | Inline) -> list[Row]:
    inputs, outputs = content.get("inputs") or [], content.get("outputs") or []
    fields = field_values(inputs, scope, stage)
    rows = []
    for rule in content.get("rules") or []:
        test = row_test(rule, inputs, fields, scope)
        made = {c["field"]: solid(compile_text(text, scope)) for c in outputs if (text := cell(rule, c))}
        # an output that can't be evaluated lets the next row try
        ok = both(*(F.coalesce(v.ok, F.lit(False)) for v in made.values() if v.ok is not None))
        rows.append(Row(both(test, ok), made))
    return rows


def first_index(rows: list[Row], stage: Stage | Inline) -> Column:
    chain = F.lit(None).cast("int")
    for i in range(len(rows) - 1, -1, -1):
        chain = F.lit(i) if rows[i].test is None else F.when(rows[i].test, F.lit(i)).otherwise(chain)
    return stage.column(chain)


def picked(values: dict[int, Val], hit: Column) -> Val:
    """The value of the row that was hit, present where that row has one."""
    kind = settled_type([v.type for v in values.values()])
    same: dict[object, list[int]] = {}
    for i, v in values.items():  # rows that share a literal share a branch
        same.setdefault(("c", repr(v.const)) if isinstance(v.const, (str, int, float, bool)) else ("r", i), []).append(i)
    chain = F.lit(None).cast(kind)
    for at in reversed(list(same.values())):
        v = values[at[0]]
        chain = F.when(hit.isin(*at) if len(at) > 1 else hit == at[0], convert(v.col, v.type, kind)).otherwise(chain)
    return Val(chain, kind, present=F.coalesce(hit.isin(*values), F.lit(False)), zone=next(iter(values.values())).zone)


def collected(rows: list[Row], field: str) -> Val:
    """An array of a column's values over all matching rows."""
    values = [(r.test, r.outputs[field]) for r in rows if field in r.outputs]
    if not values:
        return Val(F.array().cast("array<string>"), T.ArrayType(T.StringType()), sure=True)
    kind = settled_type([v.type for _, v in values])
    cells = [F.struct(F.coalesce(test, F.lit(False)).alias("hit") if test is not None else F.lit(True).alias("hit"), convert(v.col, v.type, kind).alias("v")) for test, v in values]
    col = F.transform(F.filter(F.array(*cells), lambda x: x["hit"]), lambda x: x["v"])
    return Val(col, T.ArrayType(kind), sure=True)


def compile_table(content: dict, scope: Scope, stage: Stage | Inline, note: dict[str, Column] | None = None) -> Val:
    """The output of a graph's table: an object, or an array of objects where it collects.

    ``note`` gets the rows that were hit, counted from 0: ``index``, or ``indices`` where the table collects.
    """
    outputs = content.get("outputs") or []
    if content.get("hitPolicy", "first") == "first" and isinstance(stage, Stage) and len(content.get("rules") or []) >= JOIN_ROWS:
        joined = compile_join(content, scope, stage, note)
        if joined is not None:
            return joined
    rows = rows_of(content, scope, stage)
    if content.get("hitPolicy", "first") == "collect":
        if note is not None:
            hits = [F.lit(i) if r.test is None else F.when(r.test, F.lit(i)) for i, r in enumerate(rows)]
            note["indices"] = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<int>")
        return collect_rows(rows, outputs)
    hit = first_index(rows, stage)
    if note is not None:
        note["index"] = hit
    out = Val(F.lit(None), T.NullType(), fields={})
    any_hit = hit.isNotNull()
    for c in outputs:
        field = c["field"]
        if field.endswith("[]"):
            v = replace(collected(rows, field), present=any_hit)
            field = field[:-2]
        else:
            values = {i: r.outputs[field] for i, r in enumerate(rows) if field in r.outputs}
            if not values:
                continue
            v = picked(values, hit)
        out = placed(field.split("."), v, out)
    return out


def collect_rows(rows: list[Row], outputs: list[dict]) -> Val:
    fields = [c["field"] for c in outputs if any(c["field"] in r.outputs for r in rows)]
    if not rows or not fields:
        return Val(F.array().cast("array<string>"), T.ArrayType(T.StringType()), sure=True)
    kinds = {f: settled_type([r.outputs[f].type for r in rows if f in r.outputs]) for f in fields}
    structs, kind = [], None
    for r in rows:
        o = Val(F.lit(None), T.NullType(), fields={})
        for f in fields:
            v = r.outputs.get(f)
            col = convert(v.col, v.type, kinds[f]) if v is not None else F.lit(None).cast(kinds[f])
            o = placed(f.split("."), Val(col, kinds[f]), o)
        s = solid(o)
        kind = s.type
        structs.append(F.when(r.test, s.col) if r.test is not None else s.col)
    return Val(F.filter(F.array(*structs), lambda x: x.isNotNull()), T.ArrayType(kind), sure=True)


# -- large tables as joins


@dataclass
class Plain:
    """A cell that a join can test: one of some literals, or a range of numbers. Numbers are as exact as they were written."""

    values: list | None = None
    low: Decimal | None = None
    high: Decimal | None = None
    low_in: bool = False
    high_in: bool = False


def constant(n: Node) -> object:
    """The value of a literal node, numbers as written; None for anything else."""
    if n.kind in ("str", "bool"):
        return n.value
    if n.kind == "num":
        x = Decimal(n.value)
        return x.quantize(Decimal("1.0")) if "e" in n.value.lower() and not x.as_tuple().exponent else x
    if n.kind == "neg" and n.args[0].kind == "num":
        return -constant(n.args[0])
    return None


def plain(node: Node) -> Plain | None:
    """The test of a parsed cell, if it is plain."""

    def const(n: Node) -> str | Decimal | None:
        c = constant(n)
        return None if isinstance(c, bool) else c

    if node.kind != "bin":
        return None
    if node.value == "or":
        parts = [plain(a) for a in node.args]
        if all(p is not None and p.values for p in parts):
            return Plain(parts[0].values + parts[1].values)
        return None
    left, right = node.args
    if left != Node("name", "$"):
        return None
    c = const(right)
    if node.value == "==" and c is not None:
        return Plain([c])
    if isinstance(c, Decimal) and node.value in ("<", "<=", ">", ">="):
        closed = node.value.endswith("=")
        return Plain(high=c, high_in=closed) if node.value[0] == "<" else Plain(low=c, low_in=closed)
    if node.value == "in" and right.kind == "array" and right.args and all(const(a) is not None for a in right.args):
        return Plain([const(a) for a in right.args])
    if node.value == "in" and right.kind == "interval" and right.value[0] in "[(" and right.value[1] in "])":
        low, high = (const(a) for a in right.args)
        if isinstance(low, Decimal) and isinstance(high, Decimal):
            return Plain(low=low, high=high, low_in=right.value[0] == "[", high_in=right.value[1] == "]")
    return None


def numbers_of(tests: list[Plain]) -> list[Decimal]:
    return [x for p in tests for x in [*(p.values or []), p.low, p.high] if isinstance(x, Decimal)]


def fraction(x: Decimal) -> bool:
    """Whether a number was written as one with a point or an exponent, which makes it a double."""
    return x.as_tuple().exponent != 0


LONGS, WHOLE = (-(2**63), 2**63 - 1), 2**53


def as_exact(x: Decimal) -> Decimal | None:
    """As the engine's exact type; None where it doesn't fit."""
    with localcontext(prec=100):
        y = x.quantize(Decimal(1).scaleb(-EXACT.scale), rounding=ROUND_HALF_UP)
    return y if len(y.as_tuple().digits) <= EXACT.precision else None


def key_type(kind: T.DataType, tests: list[Plain], exact: bool) -> T.DataType | None:
    """The type in which a column is compared with its cells; None where one type can't do what the cells' own would.

    Integers compare with integers exactly and with fractions by exact bounds;
    doubles as doubles; decimals with integers as decimals and with fractions as
    doubles.
    """
    numbers = numbers_of(tests)
    if isinstance(kind, T.StringType):
        return kind if not numbers else None
    if any(isinstance(x, str) for p in tests for x in p.values or []):
        return None
    if exact:
        return kind if kind == EXACT and all(as_exact(x) is not None for x in numbers) else None
    mixed = {fraction(x) for x in numbers}
    if not all(LONGS[0] < x <= LONGS[1] for x in numbers if not fraction(x)):
        return None
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return T.LongType() if True not in mixed or all(abs(x) <= WHOLE for x in numbers) else None
    if isinstance(kind, T.DoubleType):
        return kind
    if isinstance(kind, T.DecimalType):
        if True not in mixed:
            wide = unify([kind, T.LongType()])
            return wide if wide.precision - wide.scale >= 19 else None
        return T.DoubleType() if mixed == {True} else None
    return None


def typed_test(p: Plain, kind: T.DataType, exact: bool) -> Plain:
    """A cell with its numbers in the column's type; ranges of integers become closed, values that no integer has go."""
    if isinstance(kind, T.StringType):
        return p
    if isinstance(kind, T.LongType):
        values = None if p.values is None else [int(x) for x in p.values if x == int(x)]
        low = None if p.low is None else math.ceil(p.low) if p.low_in else math.floor(p.low) + 1
        high = None if p.high is None else math.floor(p.high) if p.high_in else math.ceil(p.high) - 1
        return Plain(values, low, high, True, True)
    to = float if isinstance(kind, T.DoubleType) else as_exact if exact else Decimal
    return Plain(None if p.values is None else [to(x) for x in p.values], None if p.low is None else to(p.low), None if p.high is None else to(p.high), p.low_in, p.high_in)


def stored(text: str, v: Val) -> object:
    """A literal output as a value of its own type; None if it isn't one or doesn't fit."""
    c = constant(parse(text))
    if not isinstance(c, Decimal):
        return c
    if v.type == EXACT:
        return as_exact(c)
    if isinstance(v.type, T.DoubleType):
        return float(c)
    return int(c) if LONGS[0] < c <= LONGS[1] else None


def compile_join(content: dict, scope: Scope, stage: Stage, note: dict[str, Column] | None = None) -> Val | None:
    """A first-hit table as a broadcast join; None if its cells aren't plain or no single type compares them as they are.

    The rules are grouped by the values of the most telling column. If one
    other column is tested, and it is of numbers, a value has a row for each
    stretch of numbers with one first hit, and the join's condition finds it;
    else a value is one row with an array of its rules in order, of which the
    rest of the tests picks the first. Either way the join never multiplies rows,
    nothing shuffles, and the answers are those of the chain of conditions.
    """
    inputs, outputs, rules = content.get("inputs") or [], content.get("outputs") or [], content.get("rules") or []
    if not inputs or any(not str(c.get("field") or "").strip() for c in inputs) or any(c["field"].endswith("[]") for c in outputs):
        return None
    written: list[dict[str, Plain]] = []
    made: list[dict[str, tuple[object, T.DataType]]] = []
    for rule in rules:
        row = {}
        for c in inputs:
            if text := cell(rule, c):
                p = plain(parse_cell(text))
                if p is None:
                    return None
                row[c["id"]] = p
        written.append(row)
        out = {}
        for c in outputs:
            if text := cell(rule, c):
                if constant(parse(text)) is None:
                    return None
                v = solid(compile_text(text, scope))
                x = stored(text, v)
                if x is None:
                    return None
                out[c["field"]] = (x, v.type)
        made.append(out)
    try:
        kinds = {c["field"]: unify([o[c["field"]][1] for o in made if c["field"] in o]) for c in outputs if any(c["field"] in o for o in made)}
    except RuleError:  # of types without a common one
        return None
    fields = field_values(inputs, scope, stage)
    compared: dict[str, T.DataType] = {}
    for c in inputs:
        kind = key_type(fields[c["id"]].type, [t[c["id"]] for t in written if c["id"] in t], scope.exact)
        if kind is None:
            return None
        compared[c["id"]] = kind
    tests = [{i: typed_test(p, compared[i], scope.exact) for i, p in t.items()} for t in written]

    def spread(c: dict) -> float:
        """The most rules that share a value of the column, with those that don't test it."""
        n: dict[object, int] = {}
        free = 0
        for t in tests:
            p = t.get(c["id"])
            if p is None or p.values is None:
                free += 1
            else:
                for x in set(p.values):
                    n[x] = n.get(x, 0) + 1
        return free + max(n.values(), default=len(tests))

    key = min(inputs, key=spread)
    if spread(key) > len(rules) / 2:
        return None

    def tested(c: dict) -> Column:
        """A column's value in the type of its tests; null where it can't be evaluated, so that no test passes."""
        v = fields[c["id"]]
        x = v.col.cast(compared[c["id"]])
        return x if v.ok is None else F.when(v.ok, x)

    groups: dict[object, list[int]] = {}
    free: list[int] = []
    for at, t in enumerate(tests):
        p = t.get(key["id"])
        if p is None or p.values is None:
            free.append(at)
        else:
            for x in dict.fromkeys(p.values):
                groups.setdefault(x, []).append(at)
    names = {f: f"o{i}" for i, f in enumerate(kinds)}
    out_type = [T.StructField(names[f], k) for f, k in kinds.items()] + [T.StructField(f"p{n}", T.BooleanType()) for n in names.values()] + [T.StructField("at", T.IntegerType())]

    def outputs_of(at: int) -> tuple:
        row = []
        for f, k in kinds.items():
            x = made[at][f][0] if f in made[at] else None
            row.append(float(x) if isinstance(k, T.DoubleType) and x is not None else x)
        return (*row, *(f in made[at] for f in kinds), at)

    # what a rule's record holds of each column; its key's values are the group's
    parts: list[tuple[str, str, T.DataType]] = []
    for i, c in enumerate(inputs):
        used = [t[c["id"]] for t in tests if c["id"] in t]
        if c is not key and any(p.values is not None for p in used):
            parts.append((c["id"], f"e{i}", T.ArrayType(compared[c["id"]])))
        for bound, closed in (("low", "low_in"), ("high", "high_in")):
            if some := [p for p in used if getattr(p, bound) is not None]:
                parts.append((c["id"], f"{bound}{i}", compared[c["id"]]))
                if len({getattr(p, closed) for p in some}) > 1:
                    parts.append((c["id"], f"{closed}{i}", T.BooleanType()))
    kind_of = {n: k for _, n, k in parts}
    array = T.ArrayType(T.StructType([T.StructField(n, k) for _, n, k in parts] + out_type))

    def record(at: int) -> tuple:
        row: list[object] = []
        for column, n, _ in parts:
            p = tests[at].get(column) or Plain()
            row.append(getattr(p, "values" if n[0] == "e" else n.rstrip("0123456789")))
        return (*row, *outputs_of(at))

    def passes(r: Column) -> Column:
        out = F.lit(True)
        for i, c in enumerate(inputs):
            x = tested(c)
            used = [t[c["id"]] for t in tests if c["id"] in t]
            if f"e{i}" in kind_of:
                out = out & (r[f"e{i}"].isNull() | F.coalesce(F.array_contains(r[f"e{i}"], x), F.lit(False)))
            for bound, closed, strict, loose in (("low", "low_in", Column.__gt__, Column.__ge__), ("high", "high_in", Column.__lt__, Column.__le__)):
                n = f"{bound}{i}"
                if n not in kind_of:
                    continue
                some = {getattr(p, closed) for p in used if getattr(p, bound) is not None}
                inside = strict(x, r[n]) | (r[f"{closed}{i}"] & (x == r[n])) if len(some) > 1 else (loose if True in some else strict)(x, r[n])
                out = out & (r[n].isNull() | F.coalesce(inside, F.lit(False)))
        return out

    spark = stage.df.sparkSession
    tag = f"{Stage.PREFIX}rules{stage.n}"
    stage.n += 1
    key_field = T.StructField(f"{tag}_key", compared[key["id"]])
    others = [c for c in inputs if c is not key and any(c["id"] in t for t in tests)]
    lines = len(others) < 2 and all(not isinstance(compared[c["id"]], T.StringType) for c in others)
    if lines:
        # with one other column, of numbers, each group is a line of numbers, cut where the first hit changes
        other = others[0]["id"] if others else None
        kind = compared[other] if other else T.LongType()
        rows = []
        for x, own in groups.items():
            able = sorted(own + [i for i in free if takes(tests[i].get(key["id"]), x)])
            rows += [(x, *piece, outputs_of(i)) for piece, i in pieces([(i, tests[i].get(other)) for i in able], isinstance(kind, T.LongType))]
        edges = [T.StructField(f"{tag}_{n}", k) for n, k in (("null", T.BooleanType()), ("low", kind), ("low_in", T.BooleanType()), ("high", kind), ("high_in", T.BooleanType()))]
        table = spark.createDataFrame(rows, T.StructType([key_field, *edges, T.StructField(tag, T.StructType(out_type))]))
        on = tested(key) == F.col(f"{tag}_key")
        if other:
            nothing, low, low_in, high, high_in = (F.col(e.name) for e in edges)
            x = tested(others[0])
            above, below = low.isNull() | (x > low) | (low_in & (x == low)), high.isNull() | (x < high) | (high_in & (x == high))
            on = on & F.when(x.isNull(), nothing).otherwise(~nothing & above & below)
        stage.join(F.broadcast(table), on)  # as large as the document; a row has one piece at most
        hit = F.col(tag)
    else:
        table = spark.createDataFrame([(x, [record(i) for i in sorted(at + free)]) for x, at in groups.items()], T.StructType([key_field, T.StructField(tag, array)]))
        stage.join(F.broadcast(table), tested(key) == F.col(f"{tag}_key"))  # as large as the document
        hit = F.get(F.filter(F.col(tag), passes), F.lit(0))
    if free:
        rest = spark.createDataFrame([([record(i) for i in free],)], T.StructType([T.StructField(f"{tag}_free", array)]))
        stage.df = stage.df.crossJoin(F.broadcast(rest))  # one row
        alone = F.get(F.filter(F.col(f"{tag}_free"), passes), F.lit(0))
        if lines:
            alone = F.when(alone.isNotNull(), F.struct(*[alone[f.name].alias(f.name) for f in out_type]))
        hit = F.when(F.col(tag).isNull(), alone).otherwise(hit)
    hit = stage.column(hit)
    if note is not None:
        note["index"] = hit["at"]
    out = Val(F.lit(None), T.NullType(), fields={})
    for f, k in kinds.items():
        out = placed(f.split("."), Val(hit[names[f]], k, present=F.coalesce(hit[f"p{names[f]}"], F.lit(False))), out)
    return out


def takes(p: Plain | None, x: object) -> bool:
    """Whether a typed test passes for a known value."""
    if p is None:
        return True
    if p.values is not None:
        return x in p.values
    return (p.low is None or x > p.low or p.low_in and x == p.low) and (p.high is None or x < p.high or p.high_in and x == p.high)


def pieces(rules: list[tuple[int, Plain | None]], whole: bool) -> list[tuple[tuple, int]]:
    """The line of numbers in pieces ((null, low, low_in, high, high_in), first rule that hits there); what no rule takes is left out."""
    cuts = sorted({x for _, p in rules if p for x in [*(p.values or []), p.low, p.high] if x is not None})
    found: list[list] = []  # low, low_in, high, high_in, rule

    def put(low: object, high: object, closed: bool) -> None:
        if closed:
            rule = next((i for i, p in rules if takes(p, low)), None)
        else:  # between two cuts
            rule = next((i for i, p in rules if p is None or p.values is None and (p.low is None or low is not None and p.low <= low) and (p.high is None or high is not None and p.high >= high)), None)
        if found and found[-1][4] == rule:
            found[-1][2:4] = high, closed
        else:
            found.append([low, closed, high, closed, rule])

    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        if not whole or low is None or high is None or low + 1 < high:
            put(low, high, False)
        if high is not None:
            put(high, high, True)
    out = [((False, *x[:4]), x[4]) for x in found if x[4] is not None]
    null = next((i for i, p in rules if p is None), None)
    return out + ([((True, None, False, None, False), null)] if null is not None else [])


# -- policies' tables


def compile_columns(content: dict, scope: Scope, stage: Stage | Inline, types: dict[str, T.DataType]) -> dict[str, Val]:
    """A policy's table: each output column has its own first hit among rows with a cell.

    ``[]`` columns, and all columns under ``collect``, gather every match.
    Without a hit a scalar is null and an array empty. An evaluation error stays one.
    """
    inputs, outputs = content.get("inputs"), content.get("outputs")
    if content.get("columns"):
        if inputs or outputs:
            raise RuleError("a table has columns, or inputs and outputs")
        inputs = [c for c in content["columns"] if c.get("kind") == "input"]
        outputs = [c for c in content["columns"] if c.get("kind") == "output"]
    rules = content.get("rules") or []
    fields = field_values(inputs or [], scope, stage)
    tests = [row_test(r, inputs or [], fields, scope) for r in rules]
    tests = [None if t is None else stage.column(t) for t in tests]
    out = {}
    for c in outputs or []:
        field = c["field"]
        many = field.endswith("[]") or content.get("hitPolicy") == "collect"
        field = field.removesuffix("[]")
        values = [(t, solid(compile_text(text, scope))) for t, r in zip(tests, rules, strict=True) if (text := cell(r, c))]
        if many:
            out[field] = collected([Row(t, {field: v}) for t, v in values], field)
            continue
        if not values:
            out[field] = null()
            continue
        kind = settled_type([v.type for _, v in values])
        chain, ok = F.lit(None).cast(kind), None
        for t, v in reversed(values):
            own = convert(v.col, v.type, kind)
            chain = own if t is None else F.when(t, own).otherwise(chain)
            if ok is not None or v.ok is not None:
                mine = v.ok if v.ok is not None else F.lit(True)
                ok = mine if t is None else F.when(t, mine).otherwise(ok if ok is not None else F.lit(True))
        out[field] = Val(chain, kind, ok=ok, zone=values[0][1].zone)
    return out
