"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .context_tree import op3_context_tree
from .external_shuffle import op6_sharding
from .language_id import op5_language_id
from .learned_partitions import op4_learned_partitions
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import op1_mixing
from .near_dedup import op7_near_dedup
from .packing import op10_packing
from .quality_rules import OP9_SQL, op9_quality_rules
from .secret_scan import op8_secret_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_context_tree": op3_context_tree,
    "op4_learned_partitions": op4_learned_partitions,
    "op5_language_id": op5_language_id,
    "op6_sharding": op6_sharding,
    "op7_near_dedup": op7_near_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op9_quality_rules": OP9_SQL,
}
