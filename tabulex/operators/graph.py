"""Decision graphs: nodes, edges and switches, compiled once into Columns."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Scope, compile_cell, compile_text, settled, truth
from ..plans.syntax import RuleError
from ..plans.typed import Val, both, guarded, merged, open_up, placed, solid
from .schema_check import conforms, read_schema
from .stage import Inline, Stage
from .tables import compile_table
from .template import render

MAX_DEPTH = 10
#: Of parents that disagree on a key, the one whose edge is declared first wins.
EARLIEST_EDGE_WINS = True


@dataclass
class Options:
    """How documents are compiled."""

    load: Callable[[str], dict]
    on_error: str = "raise"
    exact: bool = False
    now: str | None = None
    functions: dict[str, tuple[Callable, str]] = field(default_factory=dict)
    adapters: dict[str, Callable] = field(default_factory=dict)
    dictionaries: dict[str, list[str]] = field(default_factory=dict)
    trace: bool = False
    pools: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Ran:
    """A node's output, and where it ran (None: everywhere)."""

    out: Val
    where: Column | None
    given: Val | None = None
    note: dict[str, Column] = field(default_factory=dict)


def validate_graph(doc: dict) -> list[dict]:
    """The nodes in an order in which every node follows its parents; RuleError for graphs that can't run."""
    nodes = {n["id"]: n for n in doc.get("nodes") or []}
    edges = doc.get("edges") or []
    for e in edges:
        for side in ("sourceId", "targetId"):
            if e.get(side) not in nodes:
                raise RuleError(f"an edge names the unknown node {e.get(side)!r}")
    starts = [n for n in nodes.values() if n["type"] == "inputNode"]
    if len(starts) != 1:
        raise RuleError(f"a graph has one input node, not {len(starts)}")
    waits = {i: 0 for i in nodes}
    for e in edges:
        waits[e["targetId"]] += 1
    ready, out = [i for i in nodes if not waits[i]], []
    while ready:
        i = ready.pop(0)
        out.append(nodes[i])
        for e in edges:
            if e["sourceId"] == i:
                waits[e["targetId"]] -= 1
                if not waits[e["targetId"]]:
                    ready.append(e["targetId"])
    if len(out) < len(nodes):
        raise RuleError("the graph has a cycle")
    reached = {starts[0]["id"]}
    for n in out:
        if n["id"] in reached:
            reached |= {e["targetId"] for e in edges if e["sourceId"] == n["id"]}
    return [n for n in out if n["id"] in reached]


def either(*conditions: Column | None) -> Column | None:
    if any(c is None for c in conditions):
        return None
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def compile_graph(doc: dict, given: Val, stage: Stage | Inline, o: Options, depth: int = 0) -> tuple[Val, Val]:
    """(result, trace) of a graph for an input object."""
    if depth > MAX_DEPTH:
        raise RuleError("sub-decisions are nested too deep")
    order = validate_graph(doc)
    edges = doc.get("edges") or []
    ran: dict[str, Ran] = {}
    guard: dict[int, Column | None] = {}
    outputs: list[Ran] = []
    names = {n["id"]: n.get("name") or n["id"] for n in order}
    for n in order:
        into = [e for e in edges if e["targetId"] == n["id"] and e["sourceId"] in ran]
        if n["type"] == "inputNode":
            where, taken = None, given
        else:
            if not into:
                continue
            # a parent whose edge a switch doesn't take gives nothing
            ways = [both(ran[e["sourceId"]].where, guard.get(id(e))) for e in into]
            where = either(*ways)
            if where is not None:
                where = stage.column(F.coalesce(where, F.lit(False)))
            taken = None
            for e, way in reversed(list(zip(into, ways, strict=True))) if EARLIEST_EDGE_WINS else zip(into, ways, strict=True):
                # where the node runs at all and has one way in, that way was taken
                part = ran[e["sourceId"]].out
                part = part if len(into) == 1 else guarded(part, way)
                taken = part if taken is None else merged(taken, part)
        seen = Val(F.lit(None), T.NullType(), fields={names[i]: r.out for i, r in ran.items()})
        if n["type"] == "switchNode":
            switch(n, taken, seen, edges, guard, stage, o)
            ran[n["id"]] = Ran(taken, where)
            continue
        note: dict[str, Column] = {}
        out = run_node(n, taken, seen, stage, o, depth, where, note)
        out = stage.hold(out)
        ran[n["id"]] = Ran(out, where, None if n["type"] == "inputNode" else taken, note)
        if n["type"] == "outputNode":
            outputs.append(ran[n["id"]])
    if any(n["type"] == "outputNode" for n in order):
        result: Val | None = None
        earlier: Column | None = F.lit(False)
        for r in outputs:
            mine = r.where if r.where is not None else F.lit(True)
            part = guarded(r.out, None if r.where is None and result is None else mine & ~earlier)
            result = part if result is None else merged(result, part)
            earlier = earlier | mine
        result = result if result is not None else Val(F.lit(None), T.NullType(), fields={})
    else:
        result = Val(F.lit(None), T.NullType(), fields={})
        sources = {e["sourceId"] for e in edges}
        for n in doc["nodes"]:
            if n["id"] in ran and n["id"] not in sources and n["type"] != "switchNode":
                r = ran[n["id"]]
                part = open_up(r.out)
                result = part if part.fields is None and not result.fields else merged(result, guarded(part, r.where))
    trace = Val(F.lit(None), T.NullType(), fields={i: open_trace(names[i], k, r) for k, (i, r) in enumerate(ran.items())})
    return result, trace


def open_trace(name: str, order: int, r: Ran) -> Val:
    from ..plans.typed import literal

    ran = r.where if r.where is not None else F.lit(True)
    fields = {"name": literal(name), "order": literal(order), "ran": Val(ran, T.BooleanType(), sure=True), "output": r.out}
    if r.given is not None:
        fields["input"] = r.given
    if r.note:  # the rows of a table that were hit, counted from 0
        kinds = {"index": T.IntegerType(), "indices": T.ArrayType(T.IntegerType())}
        fields["traceData"] = Val(F.lit(None), T.NullType(), fields={k: Val(F.when(ran, c), kinds[k]) for k, c in r.note.items()})
    return Val(F.lit(None), T.NullType(), fields=fields)


def scope_for(v: Val, seen: Val, o: Options, dollar: Val | None = None) -> Scope:
    base = open_up(v)
    return Scope(base, dollar=dollar, names={"$nodes": seen}, exact=o.exact, now=o.now)


def switch(n: dict, taken: Val, seen: Val, edges: list[dict], guard: dict[int, Column | None], stage: Stage | Inline, o: Options) -> None:
    """A condition for each edge out of the node."""
    content = n.get("content") or {}
    first = (content.get("hitPolicy") or "first") == "first"
    before: Column | None = None
    tests: dict[str, Column | None] = {}
    for st in content.get("statements") or []:
        text = str(st.get("condition") or "").strip()
        own = truth(compile_text(text, scope_for(taken, seen, o))) if text else F.lit(True)
        own = stage.column(own)
        tests[st["id"]] = own if before is None or not first else own & ~before
        before = own if before is None else before | own
    for e in edges:
        if e["sourceId"] == n["id"]:
            guard[id(e)] = tests.get(e.get("sourceHandle"), F.lit(False))


def run_node(n: dict, taken: Val, seen: Val, stage: Stage | Inline, o: Options, depth: int, where: Column | None, note: dict[str, Column] | None = None) -> Val:
    """A node's output with its transform attributes applied."""
    kind, content = n["type"], n.get("content")
    if kind in ("inputNode", "outputNode"):
        schema = read_schema((content or {}).get("schema") if isinstance(content, dict) else None, o.dictionaries)
        if schema and (ok := conforms(taken, schema)) is not None:
            return checked(taken, ok, f"schema of node {n.get('name') or n['id']}", o, where)
        return taken
    attributes = content if isinstance(content, dict) else {}
    given = taken
    if field_ := str(attributes.get("inputField") or "").strip():
        given = compile_text(field_, scope_for(taken, seen, o))
    passing = bool(attributes.get("passThrough"))
    if attributes.get("executionMode") == "loop":
        arr = solid(given)
        if not arr.array:
            raise RuleError(f"node {n.get('name') or n['id']} loops over something that is no array")
        made: list[Val] = []

        def one(x: Column) -> Column:
            e = Val(x, arr.type.elementType)
            out = handle(n, e, seen, Inline(), o, depth, where)
            if passing:
                out = merged(e, out)
            out = solid(out)
            made.append(out)
            return out.col

        col = F.transform(arr.col, one)
        out = Val(col, T.ArrayType(made[-1].type), ok=arr.ok, sure=arr.sure)
    else:
        out = handle(n, given, seen, stage, o, depth, where, note)
    if path := str(attributes.get("outputPath") or "").strip():
        out = placed(path.split("."), solid(out) if out.fields is None else out)
    if passing:
        out = merged(taken, out)
    return out


def checked(v: Val, ok: Column, what: str, o: Options, where: Column | None) -> Val:
    """The object, in which every value depends on the check."""
    good = F.coalesce(ok, F.lit(False)) if where is None else ~where | F.coalesce(ok, F.lit(False))
    v = open_up(v)
    fields = {k: settled(replace(solid(x), ok=good), o.on_error, what) for k, x in (v.fields or {}).items()}
    return replace(v, fields={k: replace(x, present=(v.fields or {})[k].present) for k, x in fields.items()})


def handle(n: dict, given: Val, seen: Val, stage: Stage | Inline, o: Options, depth: int, where: Column | None, note: dict[str, Column] | None = None) -> Val:
    kind, content = n["type"], n.get("content") or {}
    what = f"node {n.get('name') or n['id']}"
    if kind == "expressionNode":
        return expressions(content, given, seen, stage, o, what, where)
    if kind == "decisionTableNode":
        return compile_table(content, scope_for(given, seen, o), stage, note if o.trace else None)
    if kind == "decisionNode":
        sub = o.load(content["key"])
        if "blocks" in sub:
            raise RuleError(f"{what}: {content['key']!r} is a policy, not a graph")
        return compile_graph(sub, open_up(given), stage, o, depth + 1)[0]
    if kind == "functionNode":
        f = o.functions.get(n["id"]) or o.functions.get(n.get("name") or "")
        if f is None:
            raise RuleError(f"{what}: no Python function is registered for it")
        if getattr(f, "columnar", False):
            made = f(Rules(scope_for(given, seen, o), stage, o, depth))
            return Val(F.lit(None), T.NullType(), fields=dict(made), sure=True)
        return function(f, given, seen)
    if kind == "customNode":
        f = o.adapters.get(content.get("kind"))
        if f is None:
            raise RuleError(f"{what}: no adapter for {content.get('kind')!r}")
        scope = scope_for(given, seen, o)
        out = f(scope, {k: render(v, scope) if isinstance(v, str) and "{{" in v else v for k, v in (content.get("config") or {}).items()})
        if isinstance(out, dict):
            fields = {k: v if isinstance(v, Val) else Val(v[0], T._parse_datatype_string(v[1])) for k, v in out.items()}
            return Val(F.lit(None), T.NullType(), fields=fields)
        return out if isinstance(out, Val) else Val(out[0], T._parse_datatype_string(out[1]))
    raise RuleError(f"{what}: no node type {kind!r}")


def expressions(content: dict, given: Val, seen: Val, stage: Stage | Inline, o: Options, what: str, where: Column | None) -> Val:
    """Keys in order; earlier ones are ``$.key``."""
    out = Val(F.lit(None), T.NullType(), fields={}, sure=True)
    for e in content.get("expressions") or []:
        key, text = str(e.get("key") or "").strip(), str(e.get("value") or "").strip()
        if not key or not text:
            continue
        v = compile_text(text, scope_for(given, seen, o, dollar=out))
        ok = v.ok if v.fields is None else solid(v).ok
        if ok is not None:
            v = solid(v)
            v = settled(replace(v, ok=ok if where is None else ~where | ok), o.on_error, f"{what}, {key}")
        elif v.nothing and v.fields is None:
            v = replace(v, ok=None)
        v = stage.hold(v)
        out = placed(key.split("."), v, out)
    return out


@dataclass
class Rules:
    """What a function that makes Columns can ask for: expressions, cells and other documents, compiled like any node's."""

    scope: Scope
    stage: Stage | Inline
    options: Options
    depth: int

    def evaluate(self, text: str) -> Val:
        """An expression over the node's input; ``$nodes`` has the outputs of earlier nodes."""
        return compile_text(text, self.scope)

    def test(self, text: str, on: str) -> Val:
        """A table cell's test of an expression; false where either fails."""
        return Val(truth(compile_cell(text, replace(self.scope, dollar=compile_text(on, self.scope)))), T.BooleanType(), sure=True)

    def decide(self, key: str, **given: Val) -> Val:
        """Another graph's result for the node's input, or for the values given."""
        base = Val(F.lit(None), T.NullType(), fields=given, sure=True) if given else self.scope.base
        return compile_graph(self.options.load(key), base, self.stage, self.options, self.depth + 1)[0]


def function(f: tuple[Callable, str], given: Val, seen: Val) -> Val:
    """A registered Python function from an input to an output object, in Arrow batches.

    It takes one object as a dict, and the outputs of earlier nodes by name if
    it has a parameter ``nodes``. One marked with ``batched`` takes a pandas
    DataFrame of many and returns another, without a way through JSON.
    """
    import pandas as pd

    call, ddl = f
    v = solid(given)
    kind = T._parse_datatype_string(ddl)
    if getattr(call, "batched", False):
        names = [x.name for x in kind.fields] if isinstance(kind, T.StructType) else None
        if names is None or not isinstance(v.type, T.StructType):
            raise RuleError("a batched function takes and returns objects")

        def many(rows: pd.DataFrame) -> pd.DataFrame:
            return call(rows)[names]

        many.__annotations__ = {"rows": pd.DataFrame, "return": pd.DataFrame}
        return Val(F.pandas_udf(many, kind)(v.col), kind)
    wants = "nodes" in inspect.signature(call).parameters

    def run(texts: pd.Series) -> pd.Series:
        def one(text: str) -> object:
            x = json.loads(text)
            return call(x["input"], nodes=x["nodes"]) if wants else call(x)

        return pd.Series([None if t is None else json.dumps(one(t), default=str) for t in texts])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    whole = v.col if v.object else F.struct(v.col)
    if wants:
        whole = F.struct(whole.alias("input"), solid(seen).col.alias("nodes"))
    return Val(F.from_json(F.pandas_udf(run, "string")(F.to_json(whole, {"ignoreNullFields": "false"})), kind), kind)


def batched(f: Callable) -> Callable:
    """Mark a function node's function as one from DataFrame to DataFrame."""
    f.batched = True
    return f


def columnar(f: Callable) -> Callable:
    """Mark a function node's function as one that makes Columns: it takes ``Rules`` and returns values by key, and no Python runs on rows."""
    f.columnar = True
    return f
