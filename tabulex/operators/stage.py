"""Holding computed values in columns, so that later expressions stay shallow."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.typed import MISSING, Val, solid


class Stage:
    """Adds hidden columns to a DataFrame as a document is compiled; Catalyst merges the projections it can."""

    PREFIX = "__tabulex_"

    def __init__(self, df: DataFrame):
        self.df = df
        self.n = 0

    def column(self, c: Column) -> Column:
        name = f"{self.PREFIX}{self.n}"
        self.n += 1
        self.df = self.df.withColumn(name, c)
        return F.col(name)

    def hold(self, v: Val) -> Val:
        """The value with its parts in columns of their own."""
        made: dict[str, Column] = {}

        def put(c: Column) -> Column:
            name = f"{self.PREFIX}{self.n}"
            self.n += 1
            made[name] = c
            return F.col(name)

        def walk(x: Val) -> Val:
            present = None if x.present is None else put(x.present)
            ok = None if x.ok is None else put(F.coalesce(x.ok, F.lit(False)))
            if x.fields is not None:
                return replace(x, fields={k: walk(y) for k, y in x.fields.items()}, present=present, ok=ok)
            if x.const is not MISSING or x.bounds:
                return replace(x, present=present, ok=ok)
            return replace(x, col=put(x.col), present=present, ok=ok)

        out = walk(v)
        if made:
            self.df = self.df.withColumns(made)
        return out

    def join(self, other: DataFrame, on: Column) -> None:
        self.df = self.df.join(other, on, "left")


class Inline:
    """No columns to hold anything in, as inside a lambda: values stay expressions."""

    df = None

    def column(self, c: Column) -> Column:
        return c

    def hold(self, v: Val) -> Val:
        return v


def shut(v: Val) -> Val:
    return solid(v)
