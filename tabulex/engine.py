"""The public interface: rule documents applied to DataFrames, in batch and on streams alike."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.graph import Options, compile_graph, validate_graph
from .operators.policy import compile_policy, load_policy, violations
from .operators.stage import Stage
from .operators.template import render
from .plans.compiler import Scope, compile_cell, compile_text, scope_of, settled, truth
from .plans.syntax import RuleError, parse, parse_cell
from .plans.typed import Val, literal, solid
from .sources.loaders import MemorySource, NoSource, RuleSource, is_policy, read_document


#: Names of session zones in which a timestamp's parts are UTC's.
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00", "UTC+00:00", "UCT", "Etc/UCT", "Zulu", "Etc/Zulu", "Universal", "Etc/Universal")


class Decision:
    """A loaded document."""

    def __init__(self, engine: Engine, document: dict):
        self.engine, self.document = engine, document

    def apply(self, df: DataFrame, **options) -> DataFrame:
        return self.engine.apply_document(df, self.document, **options)

    def validate(self) -> None:
        if not is_policy(self.document):
            validate_graph(self.document)
        else:
            load_policy(self.document, self.engine.options())


class Engine:
    """Applies documents of a source to DataFrames whose rows are the inputs.

    on_error: ``raise`` stops the query at an evaluation error, ``null`` gives
    null instead. exact: numbers are DECIMAL(28, 10) throughout; otherwise they
    keep their columns' types. now: the instant that ``d()`` and ``isToday``
    mean, for results that can be repeated. functions: {node id or name:
    (function, result schema)} for function nodes, or a ``columnar`` function. adapters: {kind: f(scope,
    config)} for custom nodes.
    """

    def __init__(self, source: RuleSource | None = None, *, on_error: str = "raise", exact: bool = False, now: str | None = None, functions: dict[str, tuple[Callable, str]] | None = None, adapters: dict[str, Callable] | None = None):
        if on_error not in ("raise", "null"):
            raise ValueError("on_error is raise or null")
        self.source = source or NoSource()
        self.settings = {"on_error": on_error, "exact": exact, "now": now, "functions": functions or {}, "adapters": adapters or {}}
        self.failures: dict[str, str] = {}

    def options(self, **more) -> Options:
        return Options(load=self.source.load, **{**self.settings, **more})

    def get_decision(self, key: str) -> Decision:
        return Decision(self, self.source.load(key))

    def create_decision(self, document: dict | str) -> Decision:
        return Decision(self, read_document(document))

    def compile(self, keys: list[str] | None = None) -> dict[str, str]:
        """Load and validate documents; returns the failures by key."""
        self.failures = {}
        for key in keys if keys is not None else getattr(self.source, "keys", list)():
            try:
                self.get_decision(key).validate()
            except (RuleError, KeyError, ValueError) as e:
                self.failures[key] = str(e)
        return self.failures

    def apply(self, df: DataFrame, key: str, **options) -> DataFrame:
        """``df`` with a document's results; see ``apply_document``."""
        return self.apply_document(df, self.source.load(key), **options)

    def apply_document(self, df: DataFrame, document: dict | str, *, into: str | None = None, keep: bool = True, goals: list[str] | None = None, trace: bool = False, validate: bool = False, pools: dict[str, DataFrame] | None = None) -> DataFrame:
        """Add a document's results to ``df`` in one narrow projection.

        Results become columns by their top-level keys, in place of columns with
        their names (which stay where a result lacks the key); with ``into`` they become one struct column. ``keep=False``
        leaves only results. ``trace`` adds a struct with each node's input,
        output, whether it ran and which rows of a table were hit. ``validate``
        adds ``violations`` of a policy's models. ``pools`` has the objects that
        a policy's references name as tables, by entity; those are joined.
        A missing result is null. Sessions run in UTC.
        """
        document = read_document(document)
        if df.sparkSession.conf.get("spark.sql.session.timeZone") not in UTC_NAMES:
            raise RuleError("dates are compiled for sessions in UTC: set spark.sql.session.timeZone")
        given = scope_of(df.schema).base
        if self.settings["exact"]:
            given = replace(given, fields={k: Val(v.col.cast(t := exact_type(v.type)), t, sure=v.sure) if exact_type(v.type) != v.type else v for k, v in given.fields.items()})
        stage = Stage(df)
        o = self.options(trace=trace, pools=pools or {})
        traced: Val | None = None
        if is_policy(document):
            result = compile_policy(document, given, stage, o, goals)
        else:
            result, traced = compile_graph(document, given, stage, o)
        more = []
        if validate:
            more.append((violations(load_policy(document, o), given) if is_policy(document) else F.array()).alias("violations"))
        if trace and traced is not None:
            more.append(solid(traced).col.alias("trace"))
        if into is not None:
            column = settled(solid(result), o.on_error, "the result").col
            return stage.df.select(*([f"`{c}`" for c in df.columns if c != into] if keep else []), column.alias(into), *more)
        if result.fields is None:
            s = solid(result)
            return stage.df.select(*([f"`{c}`" for c in df.columns if c != "result"] if keep else []), settled(s, o.on_error, "the result").col.alias("result"), *more)
        made = {}
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for k, v in result.fields.items():
            s = settled(solid(v), o.on_error, k)
            col = s.col
            if v.present is not None:
                col = F.when(v.present, s.col)
                if keep and kinds.get(k) == s.type:
                    col = col.otherwise(F.col(f"`{k}`"))
            made[k] = col.alias(k)
        own = [made.pop(c) if c in made else F.col(f"`{c}`") for c in df.columns] if keep else []
        return stage.df.select(*own, *made.values(), *more)


def exact_type(t: T.DataType) -> T.DataType:
    """A type with every number in it DECIMAL(28, 10)."""
    from .plans.typed import EXACT, NUMBERS

    if isinstance(t, NUMBERS):
        return EXACT
    if isinstance(t, T.ArrayType):
        return T.ArrayType(exact_type(t.elementType), t.containsNull)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, exact_type(f.dataType), f.nullable) for f in t.fields])
    return t


def expr(text: str, df: DataFrame, *, on_error: str = "raise", exact: bool = False, now: str | None = None, udfs: dict[str, Callable] | None = None) -> Column:
    """An expression over a DataFrame's columns as a Column."""
    scope = scope_of(df.schema, exact=exact, now=now, udfs=udfs or {})
    return settled(compile_text(text, scope), on_error, text).col


def cell(text: str, on: str, df: DataFrame, *, now: str | None = None) -> Column:
    """A table cell's test of ``on`` (an expression) as a boolean Column; an error is false."""
    scope = scope_of(df.schema, now=now)
    return truth(compile_cell(text, replace(scope, dollar=compile_text(on, scope))))


def template(text: str, df: DataFrame, *, on_error: str = "raise") -> Column:
    """A ``{{ }}`` template over a DataFrame's columns as a Column."""
    return settled(render(text, scope_of(df.schema)), on_error, text).col


def validate_expression(text: str) -> str | None:
    """What is wrong with an expression's syntax, or None."""
    return _problem(parse, text)


def validate_cell(text: str) -> str | None:
    return _problem(parse_cell, text)


def _problem(f: Callable, text: str) -> str | None:
    try:
        f(text)
    except RuleError as e:
        return str(e)
    return None


def evaluate(text: str, context: dict, spark, **options) -> object:
    """One expression on one JSON-like context; for tests and consoles."""
    df = spark.createDataFrame([(json.dumps(context),)], "j string")
    schema = df.select(F.schema_of_json(F.lit(json.dumps(context)))).first()[0] if context else "struct<>"
    row = df.select(F.from_json("j", schema).alias("c")).select("c.*") if context else df.select()
    out = row.select(expr(text, row, **options).alias("v")).first()
    return out[0]


def document_hash(document: dict) -> str:
    """The key under which a compiled document may be kept."""
    return hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest()


__all__ = ["Decision", "Engine", "MemorySource", "RuleError", "Scope", "cell", "evaluate", "expr", "literal", "template", "validate_cell", "validate_expression"]
