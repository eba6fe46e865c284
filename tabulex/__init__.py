"""Business rules over whole tables: documents compiled into Spark Columns."""

from .engine import Decision, Engine, cell, evaluate, expr, template, validate_cell, validate_expression
from .operators.graph import batched, columnar
from .plans.syntax import RuleError
from .sources.loaders import CachedSource, CallableSource, DirectorySource, MemorySource, StoreSource, ZipSource

__all__ = ["CachedSource", "CallableSource", "Decision", "DirectorySource", "Engine", "MemorySource", "RuleError", "StoreSource", "ZipSource", "batched", "cell", "columnar", "evaluate", "expr", "template", "validate_cell", "validate_expression"]
