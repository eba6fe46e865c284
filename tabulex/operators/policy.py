"""Policies: typed models, and blocks ordered by what they read and write."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Scope, choose, compile_text, settled, truth
from ..plans.syntax import RuleError, parse, parse_cell, reads
from ..plans.typed import Val, both, literal, member, null, open_up, placed, solid
from .graph import Options
from .stage import Inline, Stage
from .tables import compile_columns


@dataclass
class Prop:
    name: str
    kind: str
    target: str | None = None
    enum: object = None
    array: bool = False
    optional: bool = False


@dataclass
class Model:
    name: str
    scope: str
    props: dict[str, Prop]


@dataclass
class Block:
    id: str
    kind: str
    data: dict
    writes: list[tuple[str, ...]]
    reads: set[tuple[str, ...]] = field(default_factory=set)

    @property
    def entity(self) -> str:
        return self.writes[0][0]


@dataclass
class Policy:
    models: dict[str, Model]
    dictionaries: dict[str, list[dict]]
    blocks: list[Block]

    def enum_of(self, p: Prop) -> list[str] | None:
        if isinstance(p.enum, list):
            return [str(x.get("value", x) if isinstance(x, dict) else x) for x in p.enum]
        if isinstance(p.enum, str) and p.enum in self.dictionaries:
            return [e["value"] for e in self.dictionaries[p.enum]]
        return None

    def owner(self, entity: str) -> tuple[str, Prop] | None:
        """The model and array property through which an entity is iterated."""
        for m in self.models.values():
            for p in m.props.values():
                if p.target == entity and p.array:
                    return m.name, p
        return None


def load_policy(doc: dict, options: Options) -> Policy:
    """A document with all that it imports, in one policy."""
    docs, todo, seen = [doc], list(doc.get("imports") or []), set()
    while todo:
        key = todo.pop(0)
        if key in seen:
            continue
        seen.add(key)
        other = options.load(key)
        if "blocks" not in other:
            raise RuleError(f"{key!r} is no policy")
        if other in docs:  # a cycle of imports leads back here
            continue
        docs.append(other)
        todo += other.get("imports") or []
    models: dict[str, Model] = {}
    dictionaries: dict[str, list[dict]] = {}
    blocks: list[Block] = []
    for d in docs:
        for b in d.get("blocks") or []:
            data = (b.get("props") or {}).get("data") or {}
            if b["type"] == "dataModel":
                props = {p["name"]: Prop(p["name"], p["type"], p.get("target"), p.get("enum"), bool(p.get("array")), bool(p.get("optional"))) for p in data.get("properties") or []}
                if len(props) < len(data.get("properties") or []):
                    raise RuleError(f"DuplicateProperty in model {data['name']}")
                old = models.get(data["name"])
                for q in props.values():
                    if old and q.name in old.props and old.props[q.name] != q:
                        raise RuleError(f"DataModelCollision: {data['name']}.{q.name} is defined in two ways")
                models[data["name"]] = Model(data["name"], data.get("scope", "entity"), {**(old.props if old else {}), **props})
            elif b["type"] == "dictionary":
                if data["name"] in dictionaries:
                    raise RuleError(f"DataModelCollision: dictionary {data['name']} is defined twice")
                dictionaries[data["name"]] = data.get("entries") or []
            elif b["type"] in ("expression", "match", "decisionTable", "assertion"):
                if block := block_of(b, data):
                    blocks.append(block)
    for name in dictionaries:
        if name in models and models[name].scope != "global":
            raise RuleError(f"DataModelCollision: {name} is a dictionary and an entity")
    for m in models.values():
        for p in m.props.values():
            if m.scope == "global" and (p.name in dictionaries or p.name in models and models[p.name].scope != "global"):
                raise RuleError(f"DataModelCollision: global property {p.name} has the name of an entity or a dictionary")
            if p.target and p.target not in models and not (p.target in dictionaries and p.kind.lower() == "relationship"):
                raise RuleError(f"UnknownDataModelTarget: {m.name}.{p.name} names {p.target!r}")
    out = Policy(models, dictionaries, blocks)
    out.blocks = ordered(out)
    return out


def block_of(b: dict, data: dict) -> Block | None:
    """A block with its reads and writes; None if it is empty."""

    def of(text: object) -> set[tuple[str, ...]]:
        text = str(text or "").strip()
        return reads(parse(text)) if text else set()

    kind = b["type"]
    if kind == "expression":
        if not str(data.get("key") or "").strip() or not str(data.get("value") or "").strip():
            return None
        writes, needs = [data["key"]], of(data["value"])
    elif kind == "match":
        writes = [data["key"]]
        needs = set().union(*(of(a.get("condition")) | of(a.get("value")) for a in data.get("arms") or [])) if data.get("arms") else set()
    elif kind == "assertion":
        writes = [data["output"]]
        needs = set().union(*(of(c.get("expression")) for c in data.get("conditions") or [])) if data.get("conditions") else set()
    else:
        columns = data.get("columns") or [{**c, "kind": "input"} for c in data.get("inputs") or []] + [{**c, "kind": "output"} for c in data.get("outputs") or []]
        writes = [c["field"].removesuffix("[]") for c in columns if c["kind"] == "output"]
        needs = set()
        for c in columns:
            if c["kind"] == "input":
                needs |= of(c.get("field"))
            for r in data.get("rules") or []:
                text = str(r.get(c["id"]) or "").strip()
                if text:
                    needs |= reads(parse_cell(text)) if c["kind"] == "input" and c.get("field") else of(text)
    paths = [tuple(w.split(".")) for w in writes if w]
    if not paths:
        return None
    if len({p[0] for p in paths}) > 1:
        raise RuleError(f"MixedScope: block {b.get('id')} writes to several entities")
    return Block(str(b.get("id")), kind, data, paths, needs)


def ordered(p: Policy) -> list[Block]:
    """Blocks after those whose properties they read; ties stay in document order."""
    writers: dict[tuple[str, ...], Block] = {}
    for b in p.blocks:
        for w in b.writes:
            if w in writers:
                raise RuleError(f"DuplicateWriter of {'.'.join(w)}")
            writers[w] = b
            model = p.models.get(w[0])
            if model and len(w) > 1 and w[1] in model.props:
                raise RuleError(f"InputOverride: {'.'.join(w)} is an input")

    def needed(b: Block) -> list[Block]:
        out = []
        for r in b.reads:
            for w, other in writers.items():
                through = any(p.owner(w[0]) and (p.owner(w[0])[0], p.owner(w[0])[1].name) == r[:2] for _ in (0,)) if len(r) > 1 else False
                if (r[: len(w)] == w or w[: len(r)] == r and len(r) > 1 or through) and other not in out:
                    if other is b:
                        if r[: len(w)] == w:
                            raise RuleError(f"SelfReferencingWrite of {'.'.join(w)}")
                        continue
                    out.append(other)
        return out

    done: list[Block] = []
    state: dict[int, int] = {}

    def visit(b: Block) -> None:
        if state.get(id(b)) == 2:
            return
        if state.get(id(b)) == 1:
            raise RuleError(f"CyclicDependency at block {b.id}")
        state[id(b)] = 1
        for other in needed(b):
            visit(other)
        state[id(b)] = 2
        done.append(b)

    for b in p.blocks:
        visit(b)
    return done


def needed_for(p: Policy, goals: list[str]) -> list[Block]:
    """The blocks that the goals depend on, in order."""
    want = {tuple(g.split(".")) for g in goals}
    keep: list[Block] = []
    for b in reversed(p.blocks):
        hit = any(w[: len(g)] == g or g[: len(w)] == w for w in b.writes for g in want)
        through = (o := p.owner(b.entity)) is not None and any(g[:2] == (o[0], o[1].name) for g in want)
        if hit or through:
            keep.append(b)
            want |= b.reads
    return keep[::-1]


def missing_inputs(p: Policy, blocks: list[Block], given: Val) -> list[str]:
    """Paths that blocks read and neither the input nor a block has."""
    written = {w for b in p.blocks for w in b.writes}
    out = []
    for b in blocks:
        for r in sorted(b.reads):
            model = p.models.get(r[0])
            if model is None or len(r) < 2 or r[:2] in written:
                continue
            prop = model.props.get(r[1])
            if prop is None or prop.optional or p.owner(r[0]):
                continue
            if member(member(given, r[0]), r[1]).nothing and ".".join(r[:2]) not in out:
                out.append(".".join(r[:2]))
    return out


def evaluate(b: Block, scope: Scope, stage: Stage | Inline) -> dict[tuple[str, ...], Val]:
    """What a block writes."""
    d = b.data
    if b.kind == "expression":
        return {b.writes[0]: compile_text(d["value"], scope)}
    if b.kind == "match":
        arms, rest = [], null()
        for a in d.get("arms") or []:
            value = compile_text(str(a["value"]), scope) if str(a.get("value") or "").strip() else null()
            text = str(a.get("condition") or "").strip()
            if not text:
                rest = value
                break
            arms.append((compile_text(text, scope), value))
        # an arm's condition that fails is an error, unless an earlier arm was taken
        ok: Column | None = None
        for test, _ in reversed(arms):
            own = both(test.ok, None if test.sure else test.col.isNotNull()) if test.boolean else F.lit(False)
            if ok is not None or own is not None:
                later = ok if ok is not None else F.lit(True)
                ok = (own if own is not None else F.lit(True)) & (truth(test) | later)
        return {b.writes[0]: choose(arms, rest, ok)}
    if b.kind == "assertion":
        return {b.writes[0]: assertion(d.get("conditions") or [], scope)}
    made = compile_columns(d, scope, stage, {})
    return {tuple(k.split(".")): v for k, v in made.items()}


def assertion(conditions: list[dict], scope: Scope) -> Val:
    """An and/or tree by depth; each condition's operator joins it to what follows on its level."""
    if not conditions:
        return literal(True)
    level = min(int(c.get("depth") or 0) for c in conditions)
    parts: list[tuple[str, Val]] = []
    i = 0
    while i < len(conditions):
        c = conditions[i]
        if int(c.get("depth") or 0) > level:
            j = i
            while j < len(conditions) and int(conditions[j].get("depth") or 0) > level:
                j += 1
            v, op = assertion(conditions[i:j], scope), conditions[j - 1].get("operator") or "and"
            i = j
        else:
            v, op = compile_text(c["expression"], scope), c.get("operator") or "and"
            i += 1
        parts.append((op, v))
    op, out = parts[0]
    col, ok = truth(replace(out, ok=None)), out.ok
    for next_op, v in parts[1:]:
        own = truth(replace(v, ok=None))
        col = col | own if op == "or" else col & own
        ok, op = both(ok, v.ok), next_op
    return Val(col, T.BooleanType(), ok=ok, sure=True)


#: A pool of so many rows at most is broadcast; larger ones are joined by a shuffle.
POOL_ROWS = 200_000


def pooled(p: Policy, given: Val, stage: Stage, pools: dict[str, DataFrame]) -> Val:
    """References replaced by the rows that they name in pools given as tables (``id`` and the object's fields).

    An id that a pool lacks becomes null; of rows with one id the least counts.
    """
    out = given
    for m in p.models.values():
        for prop in m.props.values():
            if prop.kind.lower() != "reference" or prop.target not in pools or member(out, m.name).nothing:
                continue
            ref = member(member(out, m.name), prop.name)
            if ref.nothing:
                continue
            if prop.array or ref.array:
                raise RuleError(f"{m.name}.{prop.name}: a list of ids needs its pool in the row")
            pool = pools[prop.target]
            key, value = f"{Stage.PREFIX}id{stage.n}", f"{Stage.PREFIX}pool{stage.n}"
            stage.n += 1
            rows = pool.select(F.col("id").cast("string").alias(key), F.struct(*[F.col(f"`{c}`") for c in pool.columns]).alias(value)).where(F.col(key).isNotNull())
            rows = rows.groupBy(key).agg(F.min(value).alias(value))
            small = rows.limit(POOL_ROWS + 1).count() <= POOL_ROWS
            stage.join(F.broadcast(rows) if small else rows, ref.col.cast("string") == F.col(key))
            out = placed([m.name, prop.name], Val(F.col(value), rows.schema[value].dataType), out)
    return out


def hydrated(p: Policy, given: Val) -> Val:
    """References replaced by the objects that they name in the input's own pools; unknown ids become null."""
    out = given
    for m in p.models.values():
        for prop in m.props.values():
            if prop.kind.lower() != "reference" or prop.target is None:
                continue
            pool = member(given, prop.target)
            owner = member(out, m.name)
            if not pool.array or owner.nothing or owner.array:
                continue
            ref = member(owner, prop.name)
            if ref.nothing:
                continue
            kind = pool.type.elementType
            by_id = F.map_from_entries(F.transform(F.filter(pool.col, lambda x: x.isNotNull() & x["id"].isNotNull()), lambda x: F.struct(x["id"].cast("string"), x)))
            if ref.array:
                col = F.transform(ref.col, lambda r: F.try_element_at(by_id, r.cast("string")))
                v = Val(col, T.ArrayType(kind))
            else:
                v = Val(F.try_element_at(by_id, ref.col.cast("string")), kind)
            out = placed([m.name, prop.name], v, out)
    return out


def compile_policy(doc: dict, given: Val, stage: Stage | Inline, o: Options, goals: list[str] | None = None) -> Val:
    """The input with what the policy computes."""
    p = load_policy(doc, o)
    blocks = p.blocks if goals is None else needed_for(p, goals)
    if lost := missing_inputs(p, blocks, given):
        raise RuleError(f"missing inputs: {', '.join(lost)}")
    given = open_up(given)
    if o.pools:
        given = pooled(p, given, stage, o.pools)
    tree = stage.hold(hydrated(p, given))
    i = 0
    while i < len(blocks):
        b = blocks[i]
        place = p.owner(b.entity)
        over = member(member(tree, place[0]), place[1].name) if place else null()
        if place and solid(over).array:
            run = [b]
            while i + len(run) < len(blocks) and blocks[i + len(run)].entity == b.entity:
                run.append(blocks[i + len(run)])
            tree = placed([place[0], place[1].name], stage.hold(iterated(run, solid(over), tree, o)), tree)
            i += len(run)
            continue
        scope = Scope(tree, exact=o.exact, now=o.now)
        for path, v in evaluate(b, scope, stage).items():
            v = settled(v, o.on_error, f"block {b.id}, {'.'.join(path)}")
            tree = placed(list(path), stage.hold(v), tree)
        i += 1
    return tree


def iterated(blocks: list[Block], arr: Val, tree: Val, o: Options) -> Val:
    """The array of an entity with what blocks write for each element; the owner is visible by name."""
    made: list[Val] = []

    def one(x: Column) -> Column:
        e = open_up(Val(x, arr.type.elementType, sure=True))
        for b in blocks:
            scope = Scope(tree, names={b.entity: e}, exact=o.exact, now=o.now)
            for path, v in evaluate(b, scope, Inline()).items():
                e = placed(list(path[1:]), settled(v, o.on_error, f"block {b.id}, {'.'.join(path)}"), e)
        out = solid(replace(e, present=None))
        made.append(out)
        return out.col

    col = F.transform(arr.col, one)
    return Val(col, T.ArrayType(made[-1].type), ok=arr.ok, sure=arr.sure)


def violations(p: Policy, given: Val) -> Column:
    """array<struct<path, expected, got>> of what doesn't fit the models; nulls and unknown keys are accepted."""
    found: list[Column] = []

    def problem(path: str, expected: str, got: Column, bad: Column) -> None:
        found.append(F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(expected).alias("expected"), got.cast("string").alias("got"))))

    for m in p.models.values():
        top = member(given, m.name)
        if top.nothing or top.array:
            continue
        for prop in m.props.values():
            v = member(top, prop.name)
            if v.nothing:
                continue
            path, kind = f"{m.name}.{prop.name}", prop.kind.lower()
            item = Val(v.col, v.type.elementType) if prop.array and v.array else v
            fits = {"string": item.string, "number": item.number, "boolean": item.boolean, "date": item.date or item.string, "relationship": item.object, "reference": item.string or item.number or item.object}.get(kind, True)
            if prop.array != v.array or not fits:
                problem(path, kind + "[]" * prop.array, F.lit(v.type.simpleString()), solid(v).col.isNotNull())
            elif kind == "string" and (allowed := p.enum_of(prop)):
                if prop.array:
                    problem(path, "|".join(allowed), F.to_json(v.col), F.coalesce(F.exists(v.col, lambda x: ~x.isin(*allowed)), F.lit(False)))
                else:
                    problem(path, "|".join(allowed), v.col, v.col.isNotNull() & ~v.col.isin(*allowed))
            elif kind == "reference" and (pool := member(given, prop.target or "")).array:
                ids = F.transform(pool.col, lambda x: x["id"].cast("string"))
                if prop.array:
                    problem(path, f"id of {prop.target}", F.to_json(v.col), F.coalesce(F.exists(v.col, lambda x: ~F.array_contains(ids, x.cast("string"))), F.lit(False)))
                else:
                    problem(path, f"id of {prop.target}", solid(v).col, v.col.isNotNull() & ~F.coalesce(F.array_contains(ids, v.col.cast("string")), F.lit(False)))
    if not found:
        return F.array().cast("array<struct<path:string,expected:string,got:string>>")
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def dictionary_frame(spark, p: Policy, name: str):
    """A dictionary's entries, for joins that show labels."""
    return spark.createDataFrame([(e["value"], e.get("label")) for e in p.dictionaries[name]], "value string, label string")
