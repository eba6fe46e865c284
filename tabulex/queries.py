"""The registered queries of the rule engine, each with its DuckDB equivalent."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tooling
from .engine import Engine, cell, expr, template, validate_cell, validate_expression
from .operators.graph import batched, columnar
from .plans.syntax import RuleError
from .sources.json_io import contexts, results
from .sources.loaders import CachedSource, CallableSource, DirectorySource, MemorySource, ZipSource, source_from

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2024-03-15 12:00:00"


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def table_doc(inputs: list[str], outputs: list[str], rules: list[tuple], hit: str = "first", **attributes) -> dict:
    """A graph of one table; a rule is a tuple of its input cells and output cells."""
    return graph({"t": ("decisionTableNode", table_content(inputs, outputs, rules, hit, **attributes))})


def table_content(inputs: list[str], outputs: list[str], rules: list[tuple], hit: str = "first", **attributes) -> dict:
    n = len(inputs)
    return {
        "hitPolicy": hit,
        "inputs": [{"id": f"i{k}", "name": x, "field": x} for k, x in enumerate(inputs)],
        "outputs": [{"id": f"o{k}", "name": x, "field": x} for k, x in enumerate(outputs)],
        "rules": [{f"i{k}": c for k, c in enumerate(r[:n])} | {f"o{k}": c for k, c in enumerate(r[n:])} for r in rules],
        **attributes,
    }


def expressions(*pairs: tuple[str, str], **attributes) -> tuple[str, dict]:
    return "expressionNode", {"expressions": [{"id": str(i), "key": k, "value": v} for i, (k, v) in enumerate(pairs)], **attributes}


def graph(nodes: dict[str, tuple[str, dict]], edges: list[tuple] | None = None, output: bool = False) -> dict:
    """Nodes after an input node ``in``; without edges they follow each other."""
    names = ["in", *nodes]
    if edges is None:
        edges = list(zip(names, names[1:], strict=False))
        if output:
            edges.append((names[-1], "out"))
    made = [{"id": "in", "name": "in", "type": "inputNode", "content": {}}] + [{"id": k, "name": k, "type": t, "content": c} for k, (t, c) in nodes.items()]
    if output:
        made.append({"id": "out", "name": "out", "type": "outputNode", "content": {}})
    return {"nodes": made, "edges": [{"id": str(i), "sourceId": e[0], "targetId": e[1], **({"sourceHandle": e[2]} if len(e) > 2 else {})} for i, e in enumerate(edges)]}


def switch(*conditions: str, hit: str = "first") -> tuple[str, dict]:
    return "switchNode", {"hitPolicy": hit, "statements": [{"id": f"s{i}", "condition": c} for i, c in enumerate(conditions)]}


def policy(*blocks: tuple[str, dict]) -> dict:
    return {"blocks": [{"id": f"b{i}", "type": t, "props": {"data": d}} for i, (t, d) in enumerate(blocks)]}


def model(name: str, *props: str) -> tuple[str, dict]:
    """Properties as ``name:type``, ``name:relationship[]:target``, with ``?`` for optional."""
    made = []
    for p in props:
        n, kind, *target = p.split(":")
        made.append({"id": n, "name": n, "type": kind.strip("[]?"), "array": "[]" in kind, "optional": "?" in kind, **({"target": target[0]} if target else {})})
    return "dataModel", {"name": name, "scope": "entity", "properties": made}


def apply(df: DataFrame, doc: dict, **options) -> DataFrame:
    engine = {k: options.pop(k) for k in ("on_error", "exact", "now", "functions", "adapters") if k in options}
    return Engine(**engine).create_decision(doc).apply(df, **options)


def computed(df: DataFrame, keys: list[str], now: str | None = None, on_error: str = "raise", **texts: str) -> DataFrame:
    return df.select(*keys, *[expr(t, df, now=now, on_error=on_error).alias(n) for n, t in texts.items()])


def joined(name: str):
    return F.array_join(name, ",").alias(name)


# -- tables

SHIPPING = table_doc(
    ["l_quantity", "l_returnflag"],
    ["tier", "fee"],
    [("> 45", "'R'", "'bulk-return'", "l_quantity * 0.5"), ("> 45", "", "'bulk'", "10.0"), ("[20..45]", "'A','N'", "'standard'", "5.0"), ("< 5", "", "'parcel'", "2.5"), ("", "", "'other'", "4.0")],
)
SHIPPING_CASE = """CASE WHEN l_quantity > 45 AND l_returnflag = 'R' THEN {0} WHEN l_quantity > 45 THEN {1}
  WHEN l_quantity BETWEEN 20 AND 45 AND l_returnflag IN ('A','N') THEN {2} WHEN l_quantity < 5 THEN {3} ELSE {4} END"""


@query("table_first_hit", f"""
SELECT tier, count(*)::BIGINT AS lines, round(sum(fee), 2) AS fees FROM (
  SELECT {SHIPPING_CASE.format("'bulk-return'", "'bulk'", "'standard'", "'parcel'", "'other'")} AS tier,
         {SHIPPING_CASE.format("l_quantity * 0.5", "10.0", "5.0", "2.5", "4.0")}::DOUBLE AS fee FROM lineitem) GROUP BY tier""")
def table_first_hit(spark: SparkSession, d: str) -> DataFrame:
    scored = apply(read(spark, d, "lineitem"), SHIPPING)
    return scored.groupBy("tier").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("fee"), 2).alias("fees"))


@query("table_first_fallthrough_null", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice < 50000 THEN 'small' END AS band FROM orders""")
def table_null(spark: SparkSession, d: str) -> DataFrame:
    doc = table_doc(["o_totalprice"], ["band"], [("> 300000", "'large'"), ("< 50000", "'small'")])
    return apply(read(spark, d, "orders"), doc).select("o_orderkey", "band")


@query("table_collect", """
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 100000 THEN 'big' END, CASE WHEN o_orderstatus = 'F' THEN 'final' END,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'fast' END], lambda x: x IS NOT NULL), ',') AS tags FROM orders""")
def table_collect(spark: SparkSession, d: str) -> DataFrame:
    doc = table_doc(["o_totalprice", "o_orderstatus", "o_orderpriority"], ["tag"], [("> 100000", "", "", "'big'"), ("", "'F'", "", "'final'"), ("", "", "'1-URGENT','2-HIGH'", "'fast'")], hit="collect")
    return apply(read(spark, d, "orders"), doc).select("o_orderkey", F.array_join("result.tag", ",").alias("tags"))


@query("table_column_collect", """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'gold' WHEN c_acctbal > 0 THEN 'silver' WHEN c_mktsegment = 'BUILDING' THEN 'watch' END AS tier,
  CASE WHEN c_acctbal > 0 OR c_mktsegment = 'BUILDING' THEN array_to_string(list_filter([CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_acctbal > 0 THEN 'solvent' END,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'builder' END], lambda x: x IS NOT NULL), ',') END AS tags FROM customer""")
def table_column_collect(spark: SparkSession, d: str) -> DataFrame:
    doc = table_doc(["c_acctbal", "c_mktsegment"], ["tier", "tags[]"], [("> 5000", "", "'gold'", "'rich'"), ("> 0", "", "'silver'", "'solvent'"), ("", "'BUILDING'", "'watch'", "'builder'")])
    return apply(read(spark, d, "customer"), doc).select("c_custkey", "tier", joined("tags"))


@query("table_interval_cells", """
SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size < 10 THEN 'a' WHEN p_size > 10 AND p_size <= 20 THEN 'b' WHEN p_size <= 25 OR p_size >= 45 THEN 'c' ELSE 'd' END AS band FROM part""")
def table_interval(spark: SparkSession, d: str) -> DataFrame:
    doc = table_doc(["p_size"], ["band"], [("[1..10)", "'a'"), ("(10..20]", "'b'"), ("]25..45[", "'c'"), ("", "'d'")])
    return apply(read(spark, d, "part"), doc).select("p_partkey", "band")


@query("table_comma_cells", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 WHEN o_totalprice < 1000 OR o_totalprice > 400000 THEN 2 ELSE 3 END::BIGINT AS lane FROM orders""")
def table_comma(spark: SparkSession, d: str) -> DataFrame:
    doc = table_doc(["o_orderpriority", "o_totalprice"], ["lane"], [("'1-URGENT', '2-HIGH'", "", "1"), ("", "< 1000, > 400000", "2"), ("", "", "3")])
    return apply(read(spark, d, "orders"), doc).select("o_orderkey", "lane")


@query("table_and_or_cells", """
SELECT l_orderkey, l_linenumber, CASE WHEN ((l_quantity > 10 AND l_quantity < 20) OR l_quantity = 50) AND l_discount > 0.02 THEN 'hit' ELSE 'miss' END AS verdict FROM lineitem""")
def table_and_or(spark: SparkSession, d: str) -> DataFrame:
    # strictly from left to right: ((> 10 and < 20) or 50) and a test of another column
    doc = table_doc(["l_quantity"], ["verdict"], [("> 10 and < 20 or 50 and l_discount > 0.02", "'hit'"), ("", "'miss'")])
    return apply(read(spark, d, "lineitem"), doc).select("l_orderkey", "l_linenumber", "verdict")


def indexed_rules() -> list[tuple]:
    rules = []
    for i in range(240):
        brand = f"'Brand#{1 + i % 5}{1 + i // 5 % 5}'"
        size = ["", f"> {i % 40}", f"[{i % 20}..{i % 20 + 25}]", f"< {50 - i % 30}"][i // 25 % 4]
        rules.append((brand, size, f"'r{i}'", str(i)))
    rules.append(("", "> 48", "'any'", "900"))
    return [*rules, ("", "", "'none'", "-1")]


def indexed_sql() -> str:
    def test(brand: str, size: str) -> str:
        parts = [f"p_brand = {brand}"] if brand else []
        if size.startswith("["):
            low, high = size[1:-1].split("..")
            parts.append(f"p_size BETWEEN {low} AND {high}")
        elif size:
            parts.append(f"p_size {size}")
        return " AND ".join(parts) or "true"

    rules = indexed_rules()
    code = "CASE " + " ".join(f"WHEN {test(b, s)} THEN {c}" for b, s, c, _ in rules) + " END"
    rate = "CASE " + " ".join(f"WHEN {test(b, s)} THEN {r}" for b, s, _, r in rules) + " END"
    return f"SELECT p_partkey, {code} AS code, ({rate})::BIGINT AS rate FROM part"


@query("table_indexed_join", indexed_sql())
def table_indexed(spark: SparkSession, d: str) -> DataFrame:
    doc = table_doc(["p_brand", "p_size"], ["code", "rate"], indexed_rules())
    return apply(read(spark, d, "part"), doc).select("p_partkey", "code", F.col("rate").cast("long").alias("rate"))


FAR = 9007199254740992  # 2^53: beyond it doubles skip integers


def exact_rules() -> list[tuple]:
    """A rule for each of 250 far integers, some held to prices; then ranges of prices for all."""
    rules = [(str(FAR + i), ["", "> 1500.25", "[1100.1..1800.9)"][i % 3], str(FAR + 3 * i), f"{i}.1") for i in range(250)]
    return [*rules, (f"> {FAR + 100}", "< 1200.5", str(FAR - 1), "0.3"), ("", "", "-1", "0.7")]


def exact_sql() -> str:
    def test(k: str, price: str) -> str:
        parts = [] if not k else [f"k {k}"] if k[0] == ">" else [f"k = {k}"]
        if price.startswith("["):
            parts.append("p >= 1100.1 AND p < 1800.9")
        elif price:
            parts.append(f"p {price}")
        return " AND ".join(parts) or "true"

    rules = exact_rules()
    code = "CASE " + " ".join(f"WHEN {test(k, p)} THEN {c}" for k, p, c, _ in rules) + " END"
    rate = "CASE " + " ".join(f"WHEN {test(k, p)} THEN CAST('{r}' AS DECIMAL(28, 10))" for k, p, _, r in rules) + " END"
    return f"""
SELECT p_partkey, ({code})::BIGINT AS code, ({code})::VARCHAR || '.0000000000' AS exact_code, ({rate})::VARCHAR AS exact_rate
FROM (SELECT p_partkey, {FAR}::BIGINT + (p_partkey % 260)::BIGINT AS k, CAST(p_retailprice AS DECIMAL(18, 2)) AS p FROM part)"""


@query("table_indexed_exact", exact_sql())
def table_indexed_exact(spark: SparkSession, d: str) -> DataFrame:
    """A table joined on integers that doubles can't tell apart, in native and in exact numbers."""
    doc = table_doc(["k", "p"], ["code", "rate"], exact_rules())
    part = read(spark, d, "part").select("p_partkey", (F.lit(FAR) + F.col("p_partkey") % 260).cast("long").alias("k"), F.col("p_retailprice").cast("decimal(18, 2)").alias("p"))
    native = apply(part, doc).select("p_partkey", "k", "p", "code")
    both = apply(native, doc, exact=True, into="e")
    return both.select("p_partkey", "code", F.col("e.code").cast("string").alias("exact_code"), F.col("e.rate").cast("string").alias("exact_rate"))


@query("table_error_skips_row", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND regexp_full_match(substr(c_name, 10), '\\d+') THEN CAST(substr(c_name, 10) AS DOUBLE) ELSE -1.0 END AS n FROM customer""")
def table_error(spark: SparkSession, d: str) -> DataFrame:
    doc = table_doc(["c_mktsegment"], ["n"], [("'BUILDING'", "number(c_name[9:17])"), ("'BUILDING'", "number(c_name)"), ("", "-1.0")])
    return apply(read(spark, d, "customer"), doc).select("c_custkey", "n")


# -- expressions


@query("expr_arithmetic", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, (l_linenumber * 3 - 1)::BIGINT AS k, -l_quantity AS neg FROM lineitem""")
def expr_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], charge="round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)", k="l_linenumber * 3 - 1", neg="-l_quantity")


@query("expr_div_zero", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_linenumber - 1, 0), 4) AS a, l_linenumber % nullif(l_linenumber - 2, 0) AS b FROM lineitem""")
def expr_div_zero(spark: SparkSession, d: str) -> DataFrame:
    df = computed(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], a="l_extendedprice / (l_linenumber - 1)", b="l_linenumber % (l_linenumber - 2)")
    return df.select("l_orderkey", "l_linenumber", F.round("a", 4).alias("a"), F.col("b").cast("long").alias("b"))


@query("expr_mod_pow", "SELECT p_partkey, (p_size % 7)::BIGINT AS m, round(pow(p_size, 2), 4) AS sq, round(pow(2, pow(2, 3)), 4) AS right_first FROM part")
def expr_mod_pow(spark: SparkSession, d: str) -> DataFrame:
    df = computed(read(spark, d, "part"), ["p_partkey"], m="p_size % 7", sq="p_size ^ 2", right_first="2 ^ 2 ^ 3")
    return df.select("p_partkey", F.col("m").cast("long").alias("m"), F.round("sq", 4).alias("sq"), F.round("right_first", 4).alias("right_first"))


def thinned(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose negative balances and some segments are null."""
    c = read(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"))


THINNED = "(SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg FROM customer)"


@query("expr_equality_null_safe", f"""
SELECT c_custkey, seg IS NOT DISTINCT FROM 'BUILDING' AS a, seg IS DISTINCT FROM 'BUILDING' AS b, bal IS NULL AS c, false AS cross_type FROM {THINNED}""")
def expr_equality(spark: SparkSession, d: str) -> DataFrame:
    df = computed(thinned(spark, d).where("true"), ["c_custkey"], a="seg == 'BUILDING'", b="seg != 'BUILDING'", c="bal == null", cross_type="c_custkey == 'x'")
    return df


@query("expr_nullish", f"SELECT c_custkey, coalesce(bal, -1.0) AS bal, coalesce(seg, 'none') AS seg FROM {THINNED}")
def expr_nullish(spark: SparkSession, d: str) -> DataFrame:
    return computed(thinned(spark, d), ["c_custkey"], bal="bal ?? -1.0", seg="seg ?? 'none'")


@query("expr_ternary", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'b' ELSE 'p' END ELSE 'n' END AS t FROM customer")
def expr_ternary(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "customer"), ["c_custkey"], t="c_acctbal > 0 ? (c_mktsegment == 'BUILDING' ? 'b' : 'p') : 'n'")


@query("expr_template", "SELECT o_orderkey, 'order ' || o_orderkey || ' of ' || o_custkey || ': ' || upper(o_orderstatus) AS t FROM orders")
def expr_template(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "orders"), ["o_orderkey"], t="`order ${o_orderkey} of ${o_custkey}: ${upper(o_orderstatus)}`")


@query("expr_assignments", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_extendedprice * (1 - l_discount) * l_tax, 6) AS v FROM lineitem")
def expr_assignments(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], v="net = l_extendedprice * (1 - l_discount); tax = net * l_tax; round(net + tax, 6)")


@query("expr_logic", """
SELECT l_orderkey, l_linenumber, (l_quantity > 10 OR l_discount > 0.05 AND l_tax < 0.04) AS a, NOT (l_returnflag = 'R') AS b, l_linenumber IN (1, 3, 5) AS c,
  l_returnflag NOT IN ('A', 'N') AS e, (l_quantity > 5 AND l_quantity <= 15) AS f FROM lineitem""")
def expr_logic(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], a="l_quantity > 10 or l_discount > 0.05 and l_tax < 0.04", b="not (l_returnflag == 'R')", c="l_linenumber in [1, 3, 5]", e="l_returnflag not in ['A', 'N']", f="l_quantity in (5..15]")


@query("expr_slices", "SELECT p_partkey, substr(p_brand, 1, 5) AS a, substr(p_brand, 7) AS b, substr(p_brand, 1, 1) AS c FROM part")
def expr_slices(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "part"), ["p_partkey"], a="p_brand[0:4]", b="p_brand[6:]", c="p_brand[0]")


@query("expr_on_error_null", f"SELECT c_custkey, CASE WHEN bal IS NULL THEN NULL ELSE round(bal * 2, 4) END AS x FROM {THINNED}")
def expr_on_error(spark: SparkSession, d: str) -> DataFrame:
    return computed(thinned(spark, d), ["c_custkey"], on_error="null", x="round(bal * 2, 4)")


@query("cell_predicates", """
SELECT p_partkey, p_size BETWEEN 5 AND 15 AS a, (p_size > 40 OR p_size < 3) AS b, contains(p_name, 'a') AS c, p_brand IN ('Brand#11','Brand#23') AS e FROM part""")
def cells(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select("p_partkey", cell("[5..15]", "p_size", p).alias("a"), cell("> 40, < 3", "p_size", p).alias("b"), cell("contains($, 'a')", "p_name", p).alias("c"), cell("'Brand#11','Brand#23'", "p_brand", p).alias("e"))


# -- functions


@query("fn_string_case", "SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, trim('  ' || p_type || '  ') AS c FROM part")
def fn_case(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "part"), ["p_partkey"], a="upper(p_name)", b="lower(p_brand)", c="trim('  ' + p_type + '  ')")


@query("fn_string_tests", """
SELECT p_partkey, starts_with(p_brand, 'Brand#1') AS a, ends_with(p_brand, '3') AS b, contains(p_type, 'E') AS c, regexp_matches(p_name, '[aeiou]{2}') AS e FROM part""")
def fn_tests(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "part"), ["p_partkey"], a="startsWith(p_brand, 'Brand#1')", b="endsWith(p_brand, '3')", c="contains(p_type, 'E')", e="matches(p_name, '[aeiou]{2}')")


@query("fn_string_split", """
SELECT p_partkey, array_to_string(string_split(p_brand, '#'), '|') AS a, regexp_extract(p_brand, '([A-Za-z]+)#(\\d)', 1) AS b, regexp_extract(p_brand, '([A-Za-z]+)#(\\d)', 2) AS c FROM part""")
def fn_split(spark: SparkSession, d: str) -> DataFrame:
    df = computed(read(spark, d, "part"), ["p_partkey"], a="split(p_brand, '#')", x=r"extract(p_brand, '([A-Za-z]+)#(\d)')")
    return df.select("p_partkey", F.array_join("a", "|").alias("a"), F.coalesce(F.get("x", F.lit(1)), F.lit("")).alias("b"), F.coalesce(F.get("x", F.lit(2)), F.lit("")).alias("c"))


@query("fn_string_len", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n, contains(text, 'the') AS has FROM documents")
def fn_len(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "documents"), ["doc_id"], n="len(text)", has="contains(text, 'the')")


@query("fn_fuzzy", "SELECT n_nationkey, round(1 - damerau_levenshtein(n_name, r_name)::DOUBLE / greatest(length(n_name), length(r_name)), 6) AS f FROM nation JOIN region ON n_regionkey = r_regionkey")
def fn_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return computed(df, ["n_nationkey"], f="round(fuzzyMatch(n_name, r_name), 6)")


@query("fn_math_round", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 1) AS a, floor(l_extendedprice) AS b, ceil(l_extendedprice) AS c, trunc(-l_extendedprice) AS e, abs(-l_tax) AS f FROM lineitem""")
def fn_round(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], a="round(l_extendedprice, 1)", b="floor(l_extendedprice)", c="ceil(l_extendedprice)", e="trunc(-l_extendedprice)", f="abs(-l_tax)")


@query("fn_math_trunc_digits", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice::DECIMAL(20,6) * 10)::DOUBLE / 10 AS a FROM lineitem")
def fn_trunc(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], a="trunc(l_extendedprice, 1)")


@query("fn_math_rand_range", "SELECT p_partkey, true AS ok FROM part")
def fn_rand(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "part"), ["p_partkey"], ok="rand(10) in [0..10]")


@query("fn_convert_number", "SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), -1) AS a, 1::BIGINT AS b, event_id::DOUBLE + 0.5 AS c FROM events")
def fn_number(spark: SparkSession, d: str) -> DataFrame:
    df = computed(read(spark, d, "events"), ["event_id"], on_error="null", a="number(event_type)", b="number(true)", c="number(string(event_id) + '.5')")
    return df.select("event_id", F.coalesce("a", F.lit(-1.0)).alias("a"), "b", "c")


@query("fn_convert_string", "SELECT event_id, event_id::VARCHAR AS a, (value > 50)::VARCHAR AS b, 'null' AS c, '2.5' AS e FROM events")
def fn_string(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").where("value is not null or value is null")
    return computed(df, ["event_id"], a="string(event_id)", b="string(value > 50)", c="string(null)", e="string(2.50)")


@query("fn_convert_bool", "SELECT p_partkey, (p_size - 1) <> 0 AS a, false AS b, true AS c, true AS e, false AS f FROM part")
def fn_bool(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "part"), ["p_partkey"], a="bool(p_size - 1)", b="bool(p_name)", c="bool('')", e="bool(' true ')", f="bool(null)")


@query("fn_convert_type", f"""
SELECT c_custkey, 'number' AS a, CASE WHEN seg IS NULL THEN 'null' ELSE 'string' END AS b, TRY_CAST(substr(seg, 1, 2) AS DOUBLE) IS NOT NULL AS c, 'array' AS e FROM {THINNED}""")
def fn_type(spark: SparkSession, d: str) -> DataFrame:
    return computed(thinned(spark, d), ["c_custkey"], a="type(1)", b="type(seg)", c="isNumeric(seg)", e="type([1])")


# -- arrays: each order's lines


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("x"), F.col("l_returnflag").alias("f"))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def quantities(spark: SparkSession, d: str) -> DataFrame:
    return order_lines(spark, d).select("l_orderkey", F.col("lines.q").alias("q"), "lines")


@query("agg_array_sum_avg", "SELECT l_orderkey, round(sum(l_quantity), 4) AS s, round(avg(l_quantity), 4) AS a, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey")
def agg_sum(spark: SparkSession, d: str) -> DataFrame:
    df = computed(quantities(spark, d), ["l_orderkey"], s="sum(q)", a="avg(q)", n="len(q)")
    return df.select("l_orderkey", F.round("s", 4).alias("s"), F.round("a", 4).alias("a"), "n")


@query("agg_array_min_max", "SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_orderkey")
def agg_min(spark: SparkSession, d: str) -> DataFrame:
    return computed(quantities(spark, d), ["l_orderkey"], lo="min(q)", hi="max(q)")


@query("agg_array_median", "SELECT l_orderkey, median(l_quantity) AS m FROM lineitem GROUP BY l_orderkey")
def agg_median(spark: SparkSession, d: str) -> DataFrame:
    return computed(quantities(spark, d), ["l_orderkey"], m="median(q)")


@query("agg_array_mode", """
SELECT o_custkey AS k, max(n) AS m FROM (SELECT o_custkey, n, c, max(c) OVER (PARTITION BY o_custkey) AS top FROM (
  SELECT o_custkey, (o_orderkey % 4)::BIGINT AS n, count(*) AS c FROM orders GROUP BY ALL)) WHERE c = top GROUP BY o_custkey""")
def agg_mode(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.col("o_orderkey") % 4).alias("v"))
    return computed(df, ["k"], m="mode(v)")


@query("closure_map_filter", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(coalesce(sum(l_quantity) FILTER (WHERE l_discount > 0.04), 0), 2) AS reduced FROM lineitem GROUP BY l_orderkey""")
def closure_map(spark: SparkSession, d: str) -> DataFrame:
    return computed(quantities(spark, d), ["l_orderkey"], revenue="round(sum(map(lines as l, l.p * (1 - l.x))), 4)", reduced="round(sum(map(filter(lines, #.x > 0.04), #.q)), 2)")


@query("closure_predicates", """
SELECT l_orderkey, bool_or(l_quantity > 40) AS a, bool_and(l_quantity > 5) AS b, NOT bool_or(l_returnflag = 'R') AS c, count(*) FILTER (WHERE l_quantity > 25) = 1 AS e,
  count(*) FILTER (WHERE l_discount > 0.05)::BIGINT AS n FROM lineitem GROUP BY l_orderkey""")
def closure_tests(spark: SparkSession, d: str) -> DataFrame:
    return computed(quantities(spark, d), ["l_orderkey"], a="some(q, # > 40)", b="all(q, # > 5)", c="none(lines, #.f == 'R')", e="one(q, # > 25)", n="count(lines, #.x > 0.05)")


@query("closure_flat_map", "SELECT l_orderkey, sum(l_linenumber + 10 * l_linenumber)::BIGINT AS s, (2 * count(*))::BIGINT AS n, sum(CASE WHEN l_linenumber <= 3 THEN l_linenumber ELSE 0 END)::BIGINT AS nested FROM lineitem GROUP BY l_orderkey")
def closure_flat(spark: SparkSession, d: str) -> DataFrame:
    return computed(quantities(spark, d), ["l_orderkey"], s="sum(flatMap(lines, [#.n, #.n * 10]))", n="len(flatMap(lines as a, map([1, 2], a.n)))", nested="sum(map(filter(lines as l, some([1..3], # == l.n)), #.n))")


@query("fn_array_flatten_merge", "SELECT l_orderkey, (2 * count(*))::BIGINT AS n, (count(*) + 1)::BIGINT AS m FROM lineitem GROUP BY l_orderkey")
def fn_flatten(spark: SparkSession, d: str) -> DataFrame:
    return computed(quantities(spark, d), ["l_orderkey"], n="len(flatten([q, q]))", m="len(merge([q, [1.5]]))")


@query("fn_array_contains", "SELECT l_orderkey, bool_or(l_linenumber = 3) AS a, count(*) >= 2 AS b, min_by(l_quantity, l_linenumber * 1000 + l_quantity) AS first FROM lineitem GROUP BY l_orderkey")
def fn_contains(spark: SparkSession, d: str) -> DataFrame:
    df = quantities(spark, d).withColumn("n", F.col("lines.n"))
    return computed(df, ["l_orderkey"], a="contains(n, 3)", b="1 in keys(q)", first="q[0]")


@query("obj_keys_values", "SELECT n_nationkey, 'k,n' AS k, n_nationkey || ',' || n_regionkey AS v, n_name IN ('k', 'n') AS e FROM nation")
def obj_keys(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "nation").withColumn("o", F.struct(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("n")))
    out = computed(df, ["n_nationkey"], k="keys(o)", v="values(o)", e="n_name in o")
    return out.select("n_nationkey", joined("k"), F.array_join(F.col("v").cast("array<string>"), ",").alias("v"), "e")


@query("obj_merge", "SELECT n_nationkey, n_nationkey AS a, n_name AS b, n_regionkey + 1 AS c FROM nation")
def obj_merge(spark: SparkSession, d: str) -> DataFrame:
    out = computed(read(spark, d, "nation"), ["n_nationkey"], m="merge([{a: n_nationkey, b: 'x'}, {b: n_name, c: n_regionkey + 1}])")
    return out.select("n_nationkey", "m.a", "m.b", F.col("m.c").cast("int").alias("c"))


@query("obj_merge_deep", "SELECT n_nationkey, n_regionkey AS x, n_name AS y, '1,2,' || n_nationkey AS l FROM nation")
def obj_deep(spark: SparkSession, d: str) -> DataFrame:
    out = computed(read(spark, d, "nation"), ["n_nationkey"], m="mergeDeep([{o: {x: n_regionkey}, l: [1, 2]}, {o: {y: n_name}, l: [n_nationkey]}])")
    return out.select("n_nationkey", "m.o.x", "m.o.y", F.array_join(F.col("m.l").cast("array<string>"), ",").alias("l"))


# -- dates


@query("date_add_sub", """
SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%d') AS b, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS c FROM orders""")
def date_add(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "orders"), ["o_orderkey"], a="d(o_orderdate).add('10d').format('%Y-%m-%d')", b="d(o_orderdate).sub(1, 'month').format('%Y-%m-%d')", c="d(o_orderdate).add('1h 30m').format('%Y-%m-%d %H:%M')")


@query("date_start_end", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS a, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS b,
  strftime(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS c FROM orders""")
def date_start(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "orders"), ["o_orderkey"], a="o_orderdate.startOf('month').format('%Y-%m-%d')", b="o_orderdate.startOf('week').format('%Y-%m-%d')", c="o_orderdate.endOf('quarter').format('%Y-%m-%d %H:%M:%S')")


@query("date_diff", """
SELECT o_orderkey, trunc(epoch(TIMESTAMP '1998-01-01' - o_orderdate) / 86400)::BIGINT AS days, trunc(epoch(o_orderdate - TIMESTAMP '1995-06-17') / 604800)::BIGINT AS weeks,
  trunc(epoch(o_orderdate - TIMESTAMP '1995-06-17') / 3600)::BIGINT AS hours, (epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-06-17'))::BIGINT AS ms FROM orders""")
def date_diff(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "orders"), ["o_orderkey"], days="d('1998-01-01').diff(o_orderdate, 'day')", weeks="o_orderdate.diff(d('1995-06-17'), 'week')", hours="o_orderdate.diff(d('1995-06-17'), 'hour')", ms="o_orderdate.diff(d('1995-06-17'))")


@query("date_getters", """
SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS dd, isodow(o_orderdate)::BIGINT AS w, weekofyear(o_orderdate)::BIGINT AS wk,
  quarter(o_orderdate)::BIGINT AS q, dayofyear(o_orderdate)::BIGINT AS dy, epoch_ms(o_orderdate)::BIGINT AS ts, hour(o_orderdate)::BIGINT AS h FROM orders""")
def date_getters(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "orders"), ["o_orderkey"], y="o_orderdate.year()", m="o_orderdate.month()", dd="o_orderdate.day()", w="o_orderdate.weekday()", wk="o_orderdate.week()", q="o_orderdate.quarter()", dy="o_orderdate.dayOfYear()", ts="o_orderdate.timestamp()", h="o_orderdate.hour()")


@query("date_compare", """
SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-01-01' AS a, date_trunc('year', o_orderdate) = TIMESTAMP '1996-01-01' AS b, date_trunc('month', o_orderdate) > TIMESTAMP '1996-05-01' AS c,
  o_orderdate <= TIMESTAMP '1997-01-01' AS e, o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' AS f, year(o_orderdate) % 4 = 0 AS leap FROM orders""")
def date_compare(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "orders"), ["o_orderkey"], a="o_orderdate.isBefore(d('1996-01-01'))", b="o_orderdate.isSame(d('1996-05-05'), 'year')", c="o_orderdate.isAfter(d('1996-05-05'), 'month')", e="o_orderdate.isSameOrBefore(d('1997-01-01'))", f="o_orderdate in [d('1995-01-01')..d('1995-12-31')]", leap="o_orderdate.isLeapYear()")


@query("date_set_format", """
SELECT o_orderkey, strftime(make_timestamp(year(o_orderdate), month(o_orderdate), 1, 0, 0, 0), '%d/%m/%Y') AS a, strftime(o_orderdate, '%A %d %B %Y') AS b, strftime(o_orderdate, '%y%m%d-%H%M%S') AS c, strftime(o_orderdate, '%j') AS j FROM orders""")
def date_set(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "orders"), ["o_orderkey"], a="o_orderdate.set('day', 1).format('%d/%m/%Y')", b="o_orderdate.format('%A %d %B %Y')", c="o_orderdate.format('%y%m%d-%H%M%S')", j="o_orderdate.format('%j')")


@query("date_zone", """
SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS a, hour(ts + INTERVAL 2 HOUR)::BIGINT AS h, 'Etc/GMT-2' AS z, strftime(date_trunc('day', ts + INTERVAL 2 HOUR) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS s FROM events""")
def date_zone(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "events"), ["event_id"], a="ts.tz('Etc/GMT-2').format('%Y-%m-%d %H:%M')", h="ts.tz('Etc/GMT-2').hour()", z="ts.tz('Etc/GMT-2').offsetName()", s="ts.tz('Etc/GMT-2').startOf('day').tz('UTC').format('%Y-%m-%d %H:%M')")


@query("date_relative", f"""
SELECT o_orderkey, false AS today, true AS a, true AS b, true AS c, false AS valid, strftime(TIMESTAMP '{NOW}', '%Y-%m-%d') AS n FROM orders""")
def date_relative(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "orders"), ["o_orderkey"], now=NOW, today="o_orderdate.isToday()", a="d().isToday()", b="d().sub('1d').isYesterday()", c="d().add('1d').isTomorrow()", valid="d('no date').isValid()", n="d().format('%Y-%m-%d')")


@query("date_legacy", """
SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS e, year(o_orderdate)::BIGINT AS y, isodow(o_orderdate)::BIGINT AS w, day(o_orderdate)::BIGINT AS dm, dayofyear(o_orderdate)::BIGINT AS dy, weekofyear(o_orderdate)::BIGINT AS wk,
  month(o_orderdate)::BIGINT AS m, strftime(o_orderdate, '%b') AS ms, strftime(o_orderdate, '%a') AS ws, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ds,
  epoch(date_trunc('month', o_orderdate))::BIGINT AS s, (epoch(date_trunc('day', o_orderdate)) + 86399)::BIGINT AS f, 37800::BIGINT AS t, 93600::BIGINT AS u FROM orders""")
def date_legacy(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").withColumn("x", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return computed(df, ["o_orderkey"], e="date(dateString(x))", y="year(x)", w="dayOfWeek(x)", dm="dayOfMonth(x)", dy="dayOfYear(x)", wk="weekOfYear(x)", m="monthOfYear(x)", ms="monthString(x)", ws="weekdayString(x)", ds="dateString(x)", s="startOf(x, 'month')", f="endOf(x, 'day')", t="time('10:30')", u="duration('1d 2h')")


# -- graphs


@query("graph_expression_chain", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * l_tax, 6) AS tax,
  round(l_extendedprice * (1 - l_discount) + l_extendedprice * (1 - l_discount) * l_tax, 6) AS gross FROM lineitem""")
def graph_chain(spark: SparkSession, d: str) -> DataFrame:
    doc = graph({"e": expressions(("net", "l_extendedprice * (1 - l_discount)"), ("tax", "$.net * l_tax"), ("gross", "$.net + $.tax"))}, output=True)
    return apply(read(spark, d, "lineitem"), doc).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("net", "tax", "gross")])


def branches(hit: str, *conditions: str) -> dict:
    return graph(
        {"s": switch(*conditions, hit=hit), "a": expressions(("lane", "'a'"), ("x", "o_totalprice")), "b": expressions(("lane", "'b'"), ("y", "o_custkey"))},
        [("in", "s"), ("s", "a", "s0"), ("s", "b", "s1")],
    )


@query("graph_switch_first", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_totalprice > 100000 THEN 'b' END AS lane, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS x,
  CASE WHEN o_totalprice <= 200000 AND o_totalprice > 100000 THEN o_custkey END AS y FROM orders""")
def graph_switch_first(spark: SparkSession, d: str) -> DataFrame:
    return apply(read(spark, d, "orders"), branches("first", "o_totalprice > 200000", "o_totalprice > 100000")).select("o_orderkey", "lane", "x", "y")


@query("graph_switch_collect", """
SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'b' WHEN o_totalprice > 200000 THEN 'a' END AS lane, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS x,
  CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS y FROM orders""")
def graph_switch_collect(spark: SparkSession, d: str) -> DataFrame:
    return apply(read(spark, d, "orders"), branches("collect", "o_totalprice > 200000", "o_custkey % 2 == 0")).select("o_orderkey", "lane", "x", "y")


@query("graph_switch_nomatch", "SELECT o_orderkey, NULL::VARCHAR AS lane, 'kept' AS side FROM orders")
def graph_switch_none(spark: SparkSession, d: str) -> DataFrame:
    doc = graph({"s": switch("o_totalprice < 0"), "a": expressions(("lane", "'a'")), "b": expressions(("side", "'kept'"))}, [("in", "s"), ("s", "a", "s0"), ("in", "b")])
    return apply(read(spark, d, "orders"), doc).select("o_orderkey", "lane", "side")


@query("graph_merge_conflict", "SELECT n_nationkey, 'first' AS winner, n_name AS a, n_regionkey::BIGINT AS b FROM nation")
def graph_conflict(spark: SparkSession, d: str) -> DataFrame:
    doc = graph({"p": expressions(("winner", "'first'"), ("a", "n_name")), "q": expressions(("winner", "'second'"), ("b", "n_regionkey"))}, [("in", "p"), ("in", "q"), ("p", "out"), ("q", "out")], output=True)
    return apply(read(spark, d, "nation"), doc).select("n_nationkey", "winner", "a", F.col("b").cast("long").alias("b"))


@query("graph_loop", """
SELECT l_orderkey, count(*)::BIGINT AS n, round(sum(CASE WHEN l_quantity > 30 THEN l_extendedprice * 0.9 ELSE l_extendedprice END), 3) AS total,
  sum(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END)::BIGINT AS reduced FROM lineitem GROUP BY l_orderkey""")
def graph_loop(spark: SparkSession, d: str) -> DataFrame:
    table = table_content(["q"], ["kind", "pay"], [("> 30", "'reduced'", "p * 0.9"), ("", "'full'", "p")], inputField="lines", outputPath="priced", executionMode="loop", passThrough=True)
    doc = graph({"t": ("decisionTableNode", table), "e": expressions(("n", "len(priced)"), ("total", "sum(map(priced, #.pay))"), ("reduced", "count(priced, #.kind == 'reduced')"))})
    return apply(order_lines(spark, d), doc).select("l_orderkey", "n", F.round("total", 3).alias("total"), "reduced")


@query("graph_passthrough", "SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE c_mktsegment END AS c_mktsegment, c_acctbal * 2 AS twice FROM customer")
def graph_passthrough(spark: SparkSession, d: str) -> DataFrame:
    doc = graph({"t": ("decisionTableNode", table_content(["c_acctbal"], ["c_mktsegment"], [("> 0", "'plus'")], passThrough=True)), "e": expressions(("twice", "c_acctbal * 2"), passThrough=True)}, output=True)
    return apply(read(spark, d, "customer"), doc, keep=False).select("c_custkey", "c_name", "c_mktsegment", "twice")


@query("graph_output_path", "SELECT c_custkey, upper(c_name) AS a, c_acctbal AS b FROM customer")
def graph_path(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "customer").select("c_custkey", F.struct("c_name", "c_acctbal").alias("c"))
    doc = graph({"e": expressions(("name", "upper(c_name)"), ("money.amount", "c_acctbal"), inputField="c", outputPath="out.person")})
    return apply(df, doc).select("c_custkey", F.col("out.person.name").alias("a"), F.col("out.person.money.amount").alias("b"))


@query("graph_subdecision", """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'a' WHEN c_acctbal > 0 THEN 'b' ELSE 'c' END AS grade, CASE WHEN c_acctbal > 5000 THEN 'a' WHEN c_acctbal > 0 THEN 'b' ELSE 'c' END || '-' || c_mktsegment AS label FROM customer""")
def graph_sub(spark: SparkSession, d: str) -> DataFrame:
    child = table_doc(["c_acctbal"], ["grade"], [("> 5000", "'a'"), ("> 0", "'b'"), ("", "'c'")])
    parent = graph({"sub": ("decisionNode", {"key": "child", "passThrough": True}), "e": expressions(("label", "grade + '-' + c_mktsegment"), ("grade", "$nodes.sub.grade"))})
    engine = Engine(MemorySource({"child": child, "parent": json.dumps(parent)}))
    return engine.apply(read(spark, d, "customer"), "parent").select("c_custkey", "grade", "label")


@query("graph_custom_node", "SELECT p_partkey, p_name || '/' || p_brand AS label, p_size * 2.0 AS twice FROM part")
def graph_custom(spark: SparkSession, d: str) -> DataFrame:
    def adapter(scope, config):
        return {"label": config["text"], "twice": (scope.name(config["of"]).col * F.lit(2.0), "double")}

    doc = graph({"c": ("customNode", {"kind": "label", "config": {"text": "{{ p_name }}/{{ p_brand }}", "of": "p_size"}})})
    return apply(read(spark, d, "part"), doc, adapters={"label": adapter}).select("p_partkey", "label", "twice")


@query("graph_function_node", "SELECT n_nationkey, length(n_name)::BIGINT AS size, reverse(n_name) AS back FROM nation")
def graph_function(spark: SparkSession, d: str) -> DataFrame:
    def handler(x: dict) -> dict:
        return {"size": len(x["n_name"]), "back": x["n_name"][::-1]}

    doc = graph({"f": ("functionNode", {"source": "export const handler = async (input) => ({})"})})
    return apply(read(spark, d, "nation"), doc, functions={"f": (handler, "size long, back string")}).select("n_nationkey", "size", "back")


@query("graph_input_schema", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS ok FROM orders")
def graph_schema(spark: SparkSession, d: str) -> DataFrame:
    doc = graph({"e": expressions(("ok", "o_orderstatus != null"))}, output=True)
    doc["nodes"][0]["content"] = {"schema": json.dumps({"type": "object", "required": ["o_orderstatus"], "properties": {"o_orderstatus": {"type": "string", "enum": ["F", "O"]}}})}
    return apply(read(spark, d, "orders"), doc, on_error="null").select("o_orderkey", F.coalesce("ok", F.lit(False)).alias("ok"))


@query("graph_trace", "SELECT o_orderkey, o_totalprice > 100000 AS a, NOT o_totalprice > 100000 AS b FROM orders")
def graph_trace(spark: SparkSession, d: str) -> DataFrame:
    out = apply(read(spark, d, "orders"), branches("first", "o_totalprice > 100000", ""), trace=True)
    return out.select("o_orderkey", F.col("trace.a.ran").alias("a"), F.col("trace.b.ran").alias("b"))


# -- policies


@query("policy_expression_order", "SELECT c_custkey, c_acctbal * 2 AS twice, c_acctbal * 2 + 1 AS more, (c_acctbal * 2 + 1) > 100 AS rich FROM customer")
def policy_order(spark: SparkSession, d: str) -> DataFrame:
    doc = policy(model("customer", "balance:number"), ("expression", {"key": "customer.rich", "value": "customer.more > 100"}), ("expression", {"key": "customer.more", "value": "customer.twice + 1"}), ("expression", {"key": "customer.twice", "value": "customer.balance * 2"}))
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance")).alias("customer"))
    return apply(df, doc).select("c_custkey", "customer.twice", "customer.more", "customer.rich")


@query("policy_match", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' END AS band, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END::BIGINT AS flag FROM customer")
def policy_match(spark: SparkSession, d: str) -> DataFrame:
    doc = policy(
        model("customer", "balance:number", "segment:string"),
        ("match", {"key": "customer.band", "arms": [{"id": "1", "condition": "customer.balance > 5000", "value": "'high'"}, {"id": "2", "condition": "customer.balance > 0", "value": "'low'"}]}),
        ("match", {"key": "customer.flag", "arms": [{"id": "1", "condition": "customer.segment == 'BUILDING'", "value": "1"}, {"id": "2", "condition": "", "value": "0"}]}),
    )
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("customer"))
    return apply(df, doc).select("c_custkey", "customer.band", "customer.flag")


@query("policy_table_fallthrough", """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'vip' WHEN c_mktsegment = 'BUILDING' THEN 'site' END AS label, CASE WHEN c_acctbal > 0 THEN 1 ELSE 2 END::BIGINT AS lane,
  array_to_string(list_filter([CASE WHEN c_acctbal > 5000 THEN 't1' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 't3' END], lambda x: x IS NOT NULL), ',') AS tags FROM customer""")
def policy_table(spark: SparkSession, d: str) -> DataFrame:
    table = table_content(["customer.balance", "customer.segment"], ["customer.label", "customer.lane", "customer.tags[]"], [("> 5000", "", "'vip'", "", "'t1'"), ("> 0", "", "", "1", ""), ("", "'BUILDING'", "'site'", "", "'t3'"), ("", "", "", "2", "")])
    doc = policy(model("customer", "balance:number", "segment:string"), ("decisionTable", table))
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("customer"))
    return apply(df, doc).select("c_custkey", "customer.label", "customer.lane", F.array_join("customer.tags", ",").alias("tags"))


@query("policy_assertion", "SELECT c_custkey, (c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY')) AS ok FROM customer")
def policy_assertion(spark: SparkSession, d: str) -> DataFrame:
    conditions = [{"id": "1", "expression": "customer.balance > 0", "operator": "and", "depth": 0}, {"id": "2", "expression": "customer.segment == 'BUILDING'", "operator": "or", "depth": 1}, {"id": "3", "expression": "customer.segment == 'MACHINERY'", "operator": "and", "depth": 1}]
    doc = policy(model("customer", "balance:number", "segment:string"), ("assertion", {"output": "customer.ok", "conditions": conditions}))
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("customer"))
    return apply(df, doc).select("c_custkey", "customer.ok")


@query("policy_iterate_entity", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS heavy, max(l_orderkey + l_linenumber)::BIGINT AS top FROM lineitem GROUP BY l_orderkey""")
def policy_iterate(spark: SparkSession, d: str) -> DataFrame:
    doc = policy(
        model("order", "key:number", "lines:relationship[]:line"),
        model("line", "n:number", "q:number", "p:number", "x:number"),
        ("expression", {"key": "order.net", "value": "sum(map(order.lines as l, l.net))"}),
        ("expression", {"key": "order.heavy", "value": "count(order.lines, #.size == 'heavy')"}),
        ("expression", {"key": "order.top", "value": "max(map(order.lines, #.id))"}),
        ("expression", {"key": "line.net", "value": "line.p * (1 - line.x)"}),
        ("expression", {"key": "line.id", "value": "order.key + line.n"}),
        ("match", {"key": "line.size", "arms": [{"id": "1", "condition": "line.q > 25", "value": "'heavy'"}, {"id": "2", "condition": "", "value": "'light'"}]}),
    )
    df = order_lines(spark, d).select("l_orderkey", F.struct(F.col("l_orderkey").alias("key"), "lines").alias("order"))
    return apply(df, doc).select("l_orderkey", F.round("order.net", 4).alias("net"), "order.heavy", F.col("order.top").alias("top"))


@query("policy_reference", "SELECT n_nationkey, r_name AS region, upper(n_name || ' in ' || r_name) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def policy_reference(spark: SparkSession, d: str) -> DataFrame:
    doc = policy(model("nation", "name:string", "region:reference:region"), model("region", "id:string", "name:string"), ("expression", {"key": "nation.label", "value": "upper(nation.name + ' in ' + nation.region.name)"}))
    pool = read(spark, d, "region").agg(F.collect_list(F.struct(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))).alias("region"))
    df = read(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("region")).alias("nation")).crossJoin(F.broadcast(pool))  # one row
    return apply(df, doc).select("n_nationkey", F.col("nation.region.name").alias("region"), F.col("nation.label").alias("label"))


@query("policy_goals_violations", """
SELECT c_custkey, c_acctbal + 1 AS a, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END::BIGINT AS problems FROM customer""")
def policy_goals(spark: SparkSession, d: str) -> DataFrame:
    segment = model("customer", "balance:number", "segment:string")
    segment[1]["properties"][1]["enum"] = "segments"
    doc = policy(
        segment,
        ("dictionary", {"name": "segments", "entries": [{"id": "1", "value": "BUILDING", "label": "Building"}, {"id": "2", "value": "MACHINERY", "label": "Machines"}]}),
        ("expression", {"key": "customer.a", "value": "customer.balance + 1"}),
        ("expression", {"key": "customer.b", "value": "customer.unknown.deep + 1"}),
    )
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("customer"))
    return apply(df, doc, goals=["customer.a"], validate=True).select("c_custkey", "customer.a", F.size("violations").cast("long").alias("problems"))


# -- templates, streams, exact numbers


@query("template_render", "SELECT c_custkey, 'Dear ' || c_name || ' (' || c_mktsegment || '): ' || (c_custkey * 2) AS letter, c_custkey + 1 AS typed FROM customer")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select("c_custkey", template("Dear {{ c_name }} ({{ c_mktsegment }}): {{ c_custkey * 2 }}", c).alias("letter"), template("{{ c_custkey + 1 }}", c).alias("typed"))


@query("exact_numbers", "SELECT p_partkey, CAST(p_size * 0.1 + 0.2 AS DECIMAL(28, 10))::VARCHAR AS a, true AS b FROM part")
def exact_numbers(spark: SparkSession, d: str) -> DataFrame:
    doc = graph({"e": expressions(("a", "p_size * 0.1 + 0.2"), ("b", "0.1 + 0.2 == 0.3"))})
    df = read(spark, d, "part").select("p_partkey", "p_size")
    return apply(df, doc, exact=True).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("a").cast("string").alias("a"), "b")


# -- sources, JSON in and out

EXAMPLES = Path(__file__).parent / "examples"
BAND_CASE = "CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice BETWEEN 50000 AND 200000 THEN 'middle' ELSE 'low' END"


@query("source_kinds", f"SELECT o_orderkey, {', '.join(f'{BAND_CASE} AS s{i}' for i in range(7))}, 'failed' AS nothing FROM orders")
def source_kinds(spark: SparkSession, d: str) -> DataFrame:
    """One document by way of every kind of source; the default source has none."""
    text = (EXAMPLES / "orders/band.json").read_text()
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("orders/band.json", text)
    sources = [
        DirectorySource(EXAMPLES),
        MemorySource({"orders/band.json": text}),
        ZipSource(archive.getvalue()),
        CallableSource(lambda key: (EXAMPLES / key).read_text()),
        CachedSource(DirectorySource(EXAMPLES)),
        source_from({"type": "static", "content": {"orders/band.json": text}}),
        source_from({"type": "fs", "path": str(EXAMPLES)}),
    ]
    out = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for i, source in enumerate(sources):
        out = Engine(source).apply(out, "orders/band.json").withColumnRenamed("band", f"s{i}")
    try:
        Engine().apply(out, "orders/band.json")
        nothing = "found"
    except RuleError:
        nothing = "failed"
    return out.drop("o_totalprice").withColumn("nothing", F.lit(nothing))


@query("json_in_out", """
SELECT o_orderkey, o_totalprice > 100000 AS big, 'order ' || o_orderkey AS label, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS due, NULL::VARCHAR AS gone FROM orders""")
def json_in_out(spark: SparkSession, d: str) -> DataFrame:
    """Contexts from JSON texts, results back as JSON texts, read again here with Spark's own functions."""
    given = read(spark, d, "orders").select(F.to_json(F.struct("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))).alias("j"))
    doc = graph({"e": expressions(("key", "o_orderkey"), ("big", "o_totalprice > 100000"), ("label", "'order ' + string(o_orderkey)"), ("due", "d(at).add(1, 'day')"), ("gone", "missing"))})
    out = results(apply(contexts(given, "j", "o_orderkey bigint, o_totalprice double, at string"), doc, keep=False))
    return out.select(F.get_json_object("json", "$.key").cast("long").alias("o_orderkey"), F.get_json_object("json", "$.big").cast("boolean").alias("big"), *[F.get_json_object("json", f"$.{x}").alias(x) for x in ("label", "due", "gone")])


@query("json_variant", "SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderstatus = 'O' AS open FROM orders")
def json_variant(spark: SparkSession, d: str) -> DataFrame:
    """JSON contexts without a schema."""
    given = read(spark, d, "orders").select(F.to_json(F.struct("o_orderkey", "o_totalprice", "o_orderstatus")).alias("j"))
    doc = graph({"e": expressions(("o_orderkey", "number(context.o_orderkey)"), ("twice", "number(context.o_totalprice) * 2"), ("open", "context.o_orderstatus == 'O'"))})
    out = apply(contexts(given, "j"), doc, keep=False)
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "twice", "open")


# -- cells, traces, dates by column


@query("cell_forms", """
SELECT l_orderkey, l_linenumber, CASE WHEN -l_quantity <= -45 THEN 'a' WHEN l_discount = (CASE WHEN l_tax > 0.04 THEN 0.1 ELSE 0.05 END) THEN 'b' WHEN l_quantity IN (1, 2) OR l_quantity > 40 THEN 'c' WHEN l_quantity + l_linenumber > 40 THEN 'd' ELSE 'e' END AS kind FROM lineitem""")
def cell_forms(spark: SparkSession, d: str) -> DataFrame:
    """Cells with unary minus, a ternary and parentheses, and a column without a field."""
    doc = table_doc(["-l_quantity", "l_discount", "l_quantity", "free"], ["kind"], [("<= -45", "", "", "", "'a'"), ("", "l_tax > 0.04 ? 0.1 : 0.05", "", "", "'b'"), ("", "", "(1), 2 or > 40", "", "'c'"), ("", "", "", "l_quantity + l_linenumber > 40", "'d'"), ("", "", "", "", "'e'")])
    doc["nodes"][1]["content"]["inputs"][3]["field"] = ""
    return apply(read(spark, d, "lineitem"), doc).select("l_orderkey", "l_linenumber", "kind")


@query("graph_trace_rows", """
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 0 WHEN o_totalprice > 50000 THEN 1 ELSE -1 END::INTEGER AS first_row, array_to_string(list_filter([CASE WHEN o_totalprice > 100000 THEN 0 END, CASE WHEN o_totalprice > 50000 THEN 1 END], lambda x: x IS NOT NULL), ',') AS all_rows, o_totalprice AS given, CASE WHEN o_totalprice > 100000 THEN 'a' WHEN o_totalprice > 50000 THEN 'b' END AS made FROM orders""")
def graph_trace_rows(spark: SparkSession, d: str) -> DataFrame:
    """The trace of tables: what they were given, which rows were hit, what came out."""
    rules = [("> 100000", "'a'"), ("> 50000", "'b'")]
    doc = graph({"f": ("decisionTableNode", table_content(["o_totalprice"], ["x"], rules, passThrough=True)), "c": ("decisionTableNode", table_content(["o_totalprice"], ["x"], rules, hit="collect"))})
    out = apply(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), doc, trace=True, into="r")
    return out.select("o_orderkey", F.coalesce("trace.f.traceData.index", F.lit(-1)).alias("first_row"), F.array_join("trace.c.traceData.indices", ",").alias("all_rows"), F.col("trace.f.input.o_totalprice").alias("given"), F.col("trace.f.output.x").alias("made"))


@query("date_seconds", """
SELECT event_id, second(ts)::BIGINT AS s, minute(ts)::BIGINT AS m, epoch_ms(ts) >= epoch_ms(TIMESTAMP '2024-01-10 06:00:00') AS late, date_trunc('hour', ts) >= TIMESTAMP '2024-01-10 06:00:00' AS late_hour FROM events""")
def date_seconds(spark: SparkSession, d: str) -> DataFrame:
    return computed(read(spark, d, "events"), ["event_id"], s="d(ts).second()", m="d(ts).minute()", late="d(ts).isSameOrAfter(d('2024-01-10 06:00:00'))", late_hour="d(ts).isSameOrAfter(d('2024-01-10 06:00:00'), 'hour')")


@query("date_units_by_column", """
SELECT o_orderkey, CASE WHEN u = 'fortnight' THEN NULL ELSE date_trunc(u, o_orderdate) END AS start,
  CASE u WHEN 'day' THEN o_orderdate + INTERVAL 3 DAY WHEN 'month' THEN o_orderdate + INTERVAL 3 MONTH WHEN 'hour' THEN o_orderdate + INTERVAL 3 HOUR END AS later,
  CASE u WHEN 'day' THEN 31 WHEN 'month' THEN 1 WHEN 'hour' THEN 744 ELSE -1 END::BIGINT AS span,
  CASE u WHEN 'hour' THEN o_orderdate + INTERVAL 2 DAY + INTERVAL 5 HOUR WHEN 'day' THEN o_orderdate + INTERVAL 1 MONTH WHEN 'month' THEN o_orderdate - INTERVAL 7 DAY END AS moved
FROM (SELECT o_orderkey, o_orderdate, ['day', 'month', 'hour', 'fortnight'][1 + o_orderkey % 4] AS u FROM orders)""")
def date_units_by_column(spark: SparkSession, d: str) -> DataFrame:
    """Units and durations that are columns; a unit that is none is an evaluation error."""
    names = F.array(*[F.lit(x) for x in ("day", "month", "hour", "fortnight")])
    spans = F.array(*[F.lit(x) for x in ("1 month", "-1w", "2d 5h", "soon")])
    o = read(spark, d, "orders").select("o_orderkey", "o_orderdate", F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("u"), F.get(spans, (F.col("o_orderkey") % 4).cast("int")).alias("p"))
    out = computed(o, ["o_orderkey"], on_error="null", start="d(o_orderdate).startOf(u)", later="d(o_orderdate).add(3, u)", span="d('2024-02-01').diff(d('2024-01-01'), u)", moved="d(o_orderdate).add(p)")
    return out.select("o_orderkey", *[F.col(x).cast("timestamp_ntz").alias(x) for x in ("start", "later")], F.coalesce("span", F.lit(-1)).alias("span"), F.col("moved").cast("timestamp_ntz").alias("moved"))


# -- policies: imports, goals, errors, pools


@query("policy_imports", "SELECT c_custkey, c_acctbal * 1.1 AS raised, CASE WHEN c_acctbal * 1.1 > 5000 THEN 'vip' ELSE 'std' END AS band FROM customer")
def policy_imports(spark: SparkSession, d: str) -> DataFrame:
    """A policy over models and blocks that two imports bring, one by way of the other."""
    source = MemorySource({
        "models": policy(model("customer", "balance:number")),
        "raise": {"imports": ["models"], **policy(("expression", {"key": "customer.raised", "value": "customer.balance * 1.1"}))},
        "band": {"imports": ["raise", "models"], **policy(("match", {"key": "customer.band", "arms": [{"id": "1", "condition": "customer.raised > 5000", "value": "'vip'"}, {"id": "2", "condition": "", "value": "'std'"}]}))},
    })
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance")).alias("customer"))
    return Engine(source).apply(df, "band").select("c_custkey", "customer.raised", "customer.band")


@query("policy_error_null", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal + 1 END AS a, c_acctbal + 2 AS b FROM customer")
def policy_error_null(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation error of one block is null there and leaves the others alone."""
    doc = policy(model("customer", "balance:number", "segment:string"), ("expression", {"key": "customer.a", "value": "customer.segment == 'BUILDING' ? number('x') : customer.balance + 1"}), ("expression", {"key": "customer.b", "value": "customer.balance + 2"}))
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("customer"))
    return apply(df, doc, on_error="null").select("c_custkey", "customer.a", "customer.b")


@query("policy_pool_table", "SELECT c_custkey, upper(n_name) AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey <> 3")
def policy_pool_table(spark: SparkSession, d: str) -> DataFrame:
    """References that name rows of a table; an id without its row is null."""
    doc = policy(model("customer", "nation:reference:nation"), model("nation", "id:string", "name:string"), ("expression", {"key": "customer.label", "value": "customer.nation.name == null ? null : upper(customer.nation.name)"}))
    pool = read(spark, d, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    df = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation")).alias("customer"))
    return apply(df, doc, pools={"nation": pool}).select("c_custkey", F.col("customer.label").alias("nation"))


@query("graph_function_batched", "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderstatus) || '!' AS status FROM orders")
def graph_function_batched(spark: SparkSession, d: str) -> DataFrame:
    """A function node over many rows at once."""

    def handler(rows):
        return rows.assign(twice=rows.o_totalprice * 2, status=rows.o_orderstatus.str.upper() + "!")

    doc = graph({"f": ("functionNode", {"source": "registered in Python"})})
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return apply(df, doc, functions={"f": (batched(handler), "twice double, status string")}).select("o_orderkey", "twice", "status")


@query("graph_function_columns", f"""
SELECT o_orderkey, o_totalprice * 1.5 AS raised, o_totalprice > 200000 AND o_orderstatus = 'O' AS hot, {BAND_CASE} AS band, 'n' || o_orderkey AS tag FROM orders""")
def graph_function_columns(spark: SparkSession, d: str) -> DataFrame:
    """A function node that evaluates expressions, a cell and another document, all as Columns, and one that sees earlier nodes."""

    def handler(rules):
        hot = rules.evaluate("rate > 1 and o_orderstatus == 'O'")
        big = rules.test("> 200000", "o_totalprice")
        return {"raised": rules.evaluate("o_totalprice * $nodes.e.rate"), "hot": replace(hot, col=big.col & hot.col), "band": rules.decide("orders/band.json", o_totalprice=rules.evaluate("o_totalprice")).fields["band"]}

    doc = graph({"e": expressions(("rate", "1.5"), passThrough=True), "f": ("functionNode", {"source": "registered in Python"}), "g": ("functionNode", "registered in Python too")})
    df = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    engine = Engine(DirectorySource(EXAMPLES), functions={"f": columnar(handler), "g": (lambda x, nodes: {**x, "tag": "n" + str(nodes["in"]["o_orderkey"])}, "raised double, hot boolean, band string, tag string")})
    return engine.create_decision(doc).apply(df).select("o_orderkey", "raised", "hot", "band", "tag")


# -- tooling, as small tables


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(rows: list[tuple], names: str) -> str:
    cells = ", ".join("(" + ", ".join("NULL" if x is None else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {cells}) AS t({names})"


BROKEN: list[tuple[str, dict, str]] = [
    ("circular", {"imports": ["loop"], **policy()}, "CircularImport"),
    ("missing import", {"imports": ["nowhere"], **policy()}, "ImportNotFound"),
    ("two shapes", policy(model("c", "x:number"), model("c", "x:string")), "DataModelCollision"),
    ("enum", policy(("dictionary", {"name": "e", "entries": [{"id": "1", "value": "a"}, {"id": "2", "value": "a"}]})), "DuplicateEnumValue"),
    ("name", policy(model("1st", "x:number")), "InvalidName"),
    ("path", policy(("expression", {"key": "a..b", "value": "1"})), "InvalidWritePath"),
    ("empty", policy(("assertion", {"output": "a.ok", "conditions": []})), "EmptyBlock"),
    ("deep", policy(("assertion", {"output": "a.ok", "conditions": [{"id": "1", "expression": "true", "depth": 40}]})), "MaxDepthExceeded"),
    ("twice", policy(("expression", {"key": "c.x", "value": "1"}), ("expression", {"key": "c.x", "value": "2"})), "DuplicateWriter"),
    ("whole and part", policy(("expression", {"key": "c.o", "value": "{a: 1}"}), ("expression", {"key": "c.o.b", "value": "2"})), "PartialObjectWrite"),
    ("iterated read", policy(model("o", "ls:relationship[]:l"), model("l", "q:number"), ("expression", {"key": "o.n", "value": "l.q + 1"})), "UnreachableEntityRead"),
    ("nested", policy(model("o", "ls:relationship[]:l"), model("l", "ps:relationship[]:p"), model("p", "q:number"), ("expression", {"key": "p.n", "value": "p.q + 1"})), "UnsupportedNestedIteration"),
    ("cycle", policy(("expression", {"key": "c.x", "value": "c.y"}), ("expression", {"key": "c.y", "value": "c.x"})), "CyclicDependency"),
    ("self", policy(("expression", {"key": "c.x", "value": "c.x + 1"})), "SelfReferencingWrite"),
    ("input", policy(model("c", "x:number"), ("expression", {"key": "c.x", "value": "1"})), "InputOverride"),
    ("target", policy(model("c", "x:reference:d")), "UnknownDataModelTarget"),
    ("types", policy(model("c", "n:number"), ("expression", {"key": "c.m", "value": "c.n + 'a'"})), "TypeMismatch"),
    ("types of a computed value", policy(model("c", "n:number"), ("expression", {"key": "c.m", "value": "c.n > 1"}), ("expression", {"key": "c.k", "value": "c.m * 2"})), "TypeMismatch"),
    ("no such name", policy(model("c", "n:number"), ("expression", {"key": "c.m", "value": "c.gone"})), "UndefinedVariable"),
    ("no such function", policy(model("c", "n:number"), ("expression", {"key": "c.m", "value": "c.n + foo(1)"})), "InvalidExpression"),
    ("graph", {"nodes": [], "edges": []}, "InvalidGraphStructure"),
    ("syntax", graph({"e": expressions(("x", "1 +"))}), "ParseError"),
    ("graph types", graph({"e": expressions(("x", "o_orderkey > 1")), "f": expressions(("y", "x + 1"))}), "TypeMismatch"),
    ("right", graph({"e": expressions(("x", "o_orderkey + 1")), "f": expressions(("y", "x > 2 and o_orderstatus == 'O'"))}), ""),
]


@query("tool_diagnostics", values_sql([(name, code) for name, _, code in BROKEN], "document, errors"))
def tool_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Error codes of documents that have one thing wrong each."""
    source, schema = MemorySource({"loop": {"imports": ["loop"], "blocks": []}}), read(spark, d, "orders").schema
    return listed(spark, [(name, ",".join(sorted({f.code for f in tooling.diagnostics(doc, source, schema) if f.error}))) for name, doc, _ in BROKEN], "document string, errors string")


LINTED = graph({"e": expressions(("x", "(a + b * 2)"), ("y", "a > 1 ? 1 : a > 0 ? 2 : 3")), "f": expressions(("z", "a * b + c")), "g": expressions(("w", "a * b + c")), "t": ("decisionTableNode", table_content(["n", "k"], ["q"], [("> 5", "'a'", "1"), ("[6..9]", "'a'", "2"), ("", "'a'", "3")]))})


@query("tool_lint", values_sql([("PreferMatch", "e"), ("RedundantParentheses", "e"), ("RepeatedDerivation", "g"), ("NonDiscriminatingColumn", "t"), ("RedundantTableRow", "t")], "code, place"))
def tool_lint(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, [(f.code, f.where) for f in tooling.lint(LINTED)], "code string, place string")


@query("tool_types", values_sql([("o_orderkey + 1", "bigint"), ("o_totalprice / 2", "double"), ("o_totalprice > 1 ? o_orderstatus : 'x'", "string"), ("o_orderkey in [1, 2]", "boolean"), ("[o_orderkey]", "array<bigint>"), ("d(o_orderdate)", "timestamp"), ("gone", "void")], "text, type"))
def tool_types(spark: SparkSession, d: str) -> DataFrame:
    schema = read(spark, d, "orders").schema
    return listed(spark, [(t, tooling.type_of(t, schema).simpleString()) for t in ("o_orderkey + 1", "o_totalprice / 2", "o_totalprice > 1 ? o_orderstatus : 'x'", "o_orderkey in [1, 2]", "[o_orderkey]", "d(o_orderdate)", "gone")], "text string, type string")


@query("tool_dependencies", values_sql([("t", "a.b,c,d"), ("e", "x"), ("inputs", "a.b,c,d"), ("outputs", "x,y")], "part, paths"))
def tool_dependencies(spark: SparkSession, d: str) -> DataFrame:
    doc = graph({"t": ("decisionTableNode", table_content(["a.b"], ["x"], [("> c", "d + 1")])), "e": expressions(("y", "x * 2"))})
    rows = [(k, ",".join(v)) for k, v in tooling.dependencies(doc).items() if v]
    return listed(spark, [*rows, ("inputs", ",".join(tooling.inputs(doc))), ("outputs", ",".join(tooling.outputs(doc)))], "part string, paths string")


PRICED = policy(
    model("order", "kind:string", "weight:number", "zone:string", "value:number", "name:string"),
    ("expression", {"key": "order.insured", "value": "order.value * 0.01"}),
    ("match", {"key": "order.fee", "arms": [{"id": "1", "condition": "order.kind == 'parcel'", "value": "order.weight * 2"}, {"id": "2", "condition": "order.kind == 'safe'", "value": "order.insured + 5"}, {"id": "3", "condition": "", "value": "1"}]}),
    ("expression", {"key": "order.label", "value": "order.name + ' ' + string(order.fee)"}),
    ("match", {"key": "order.route", "arms": [{"id": "1", "condition": "order.fee > 10", "value": "order.zone"}]}),
)


@query("tool_conditional_inputs", values_sql([("", "", "order.kind,order.name,order.value"), ("order.fee", "order.kind == 'parcel'", "order.weight"), ("order.fee", "order.kind == 'safe'", ""), ("order.fee", "", ""), ("order.route", "order.fee > 10", "order.zone")], "path, condition, inputs"))
def tool_conditional_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What a policy needs always, and what each arm of its matches needs besides."""
    return listed(spark, [(path, condition, ",".join(found)) for path, condition, found in tooling.conditional_inputs(PRICED)], "path string, condition string, inputs string")


GAPS = [("> 5|<= 5", ""), ("> 5|< 5", "[5..5]"), ("[0..10)|[10..20]", "(-..0), (20..)"), ("1|2|> 2", "(-..1), (1..2)"), ("", ""), ("< 3|> 7|[4..6]", "[3..4), (6..7]"), ("'a'", None)]


@query("tool_numeric_gaps", values_sql(GAPS, "cells, gaps"))
def tool_numeric_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Which numbers a column's cells leave out."""
    found = [(cells, tooling.numeric_gaps(cells.split("|"))) for cells, _ in GAPS]
    return listed(spark, [(cells, None if gaps is None else ", ".join(gaps)) for cells, gaps in found], "cells string, gaps string")


@query("tool_validate", values_sql([("expression", "a + 1", "true"), ("expression", "a +", "false"), ("cell", "> 5, [1..2]", "true"), ("cell", "> ", "false"), ("document", "good", "true"), ("document", "bad", "false"), ("inputs", "customer.balance", "false")], "kind, text, valid"))
def tool_validate(spark: SparkSession, d: str) -> DataFrame:
    """Syntax checks, compiling a source's documents, and a policy whose input lacks what it reads."""
    rows = [("expression", t, validate_expression(t) is None) for t in ("a + 1", "a +")] + [("cell", t, validate_cell(t) is None) for t in ("> 5, [1..2]", "> ")]
    engine = Engine(MemorySource({"good": graph({"e": expressions(("x", "1"))}), "bad": {"nodes": [], "edges": []}}))
    failed = engine.compile()
    rows += [("document", k, k not in failed) for k in ("good", "bad")]
    doc = policy(model("customer", "balance:number", "name:string"), ("expression", {"key": "customer.x", "value": "customer.balance + 1"}))
    df = read(spark, d, "customer").select(F.struct(F.col("c_name").alias("name")).alias("customer"))
    try:
        apply(df, doc)
    except RuleError as e:
        rows.append(("inputs", str(e).removeprefix("missing inputs: "), False))
    return listed(spark, [(a, b, str(c).lower()) for a, b, c in rows], "kind string, text string, valid string")


STREAM_DOC = table_doc(["event_type", "value"], ["lane"], [("'purchase'", "> 50", "'big'"), ("'purchase'", "", "'small'"), ("", "", "'none'")])


@query("stream_scored", """
SELECT CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big' WHEN event_type = 'purchase' THEN 'small' ELSE 'none' END AS lane, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def stream_scored(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from .streaming import shared_dir, write_scored

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = read(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    write_scored(Engine(MemorySource({"lanes": STREAM_DOC})), events, "lanes", f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["ORACLE_SQL", "QUERIES"]
