"""``{{ expression }}`` templates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Scope, compile_text
from ..plans.syntax import RuleError
from ..plans.typed import Val, both, literal


def pieces(text: str) -> list[tuple[bool, str]]:
    """(is an expression, its text) in order."""
    out, i = [], 0
    while i < len(text):
        at = text.find("{{", i)
        close = text.find("}}", i)
        if at < 0:
            if close >= 0:
                raise RuleError("a template closes what it didn't open")
            out.append((False, text[i:]))
            break
        if 0 <= close < at:
            raise RuleError("a template closes what it didn't open")
        if at > i:
            out.append((False, text[i:at]))
        if close < 0:
            raise RuleError("a template isn't closed")
        out.append((True, text[at + 2 : close].strip()))
        i = close + 2
    return out


def render(text: str, scope: Scope) -> Val:
    """A lone expression keeps its type; mixed with text it becomes text."""
    from ..functions.library import to_string

    parts = pieces(text)
    if not parts:
        return literal("")
    if len(parts) == 1 and parts[0][0]:
        return compile_text(parts[0][1], scope)
    made = [to_string(compile_text(t, scope)) if e else literal(t) for e, t in parts]
    return Val(F.concat(*[m.col for m in made]), T.StringType(), ok=both(*(m.ok for m in made)), sure=True)
