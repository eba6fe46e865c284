"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A sample tells what each rule costs (time a row of its own expressions) and which
rows it rejects. Rules run in order of rejection per cost, each only on rows that
those before it let pass: a value that a rule reads from the text is made for
these rows alone. The verdict doesn't depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find, numbered, pick, spread

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``reject`` makes a boolean of columns and of the values in ``needs``; null counts as passing."""

    name: str
    reject: Callable[[dict[str, Column]], Column]
    needs: tuple[str, ...] = ()


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the statistics of each whole text; see ``STATISTICS``.

    A null text counts as empty: all statistics are 0. Windows are compared by
    64-bit hashes of their words' 64-bit hashes. Each step names an array once,
    so that it isn't computed again where the next step reads it twice.
    """
    names = docs.columns
    n = numbered(docs)
    plain = [F.col(x) for x in n.columns]
    t = F.coalesce(F.col(f"c{find(docs, text)}"), F.lit(""))
    n = n.select(*plain, t.alias("t"), words_of(t).alias("w"))
    n = n.select(
        *plain,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = F.when(F.col("n_words") >= 9, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 7), lambda i: F.xxhash64(F.slice("h", i, 8))))
    n = n.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("n_lines", F.size("lines").cast("long")).withColumn("x", windows).drop("h", "lines")
    # few texts repeat a window: only theirs are sorted
    paired = F.when(F.size(F.array_distinct("x")) < F.size("x"), F.sort_array(F.transform("x", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    n = n.withColumn("s", paired).drop("x")
    twice = F.filter("s", lambda x, i: ((i > 0) & (F.get("s", F.greatest(i - 1, F.lit(0)))["x"] == x["x"])) | F.coalesce(F.get("s", i + 1)["x"] == x["x"], F.lit(False)))
    n = n.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(0).alias("c"), F.lit(-8).alias("last")), lambda a, i: F.struct((a["c"] + F.least(F.lit(8), i - a["last"])).alias("c"), i.alias("last")), lambda a: a["c"])
    n = n.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")
    return n.toDF(*names, *n.columns[len(names) :]).select(*[F.col(f"`{x}`") for x in names], *STATISTICS) if len({x.lower() for x in [*names, *STATISTICS]}) == len(names) + len(STATISTICS) else numbered_back(n, names)


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def numbered_back(n: DataFrame, names: list[str]) -> DataFrame:
    """Names that clash with a statistic stay on the given columns; the statistics come after them."""
    return n.select(*[F.col(f"c{i}") for i in range(len(names))], *STATISTICS).toDF(*names, *STATISTICS)


#: What rules read from the text itself; made only where a rule gets that far.
VALUES: dict[str, Callable[[Column], Column]] = {
    "n_letters": lambda t: F.length(F.regexp_replace(t, r"\P{L}+", "")),
    "n_upper": lambda t: F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
}
#: Texts of few words or of repeated passages.
BASE_RULES = (
    Rule("few_words", lambda c: c["n_words"] < 20),
    Rule("repeated_passages", lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
)
RULES = BASE_RULES + (
    Rule("symbols", lambda c: 4 * c["n_symbols"] > c["n_words"]),
    Rule("repeated_lines", lambda c: (c["n_lines"] >= 4) & (100 * c["n_dup_lines"] > 40 * c["n_lines"])),
    Rule("shouting", lambda c: (c["n_letters"] >= 40) & (100 * c["n_upper"] > 60 * c["n_letters"]), ("n_letters", "n_upper")),
    Rule("few_letters", lambda c: 100 * c["n_letters"] < 50 * c["word_chars"], ("n_letters",)),
    Rule("long_words", lambda c: c["word_chars"] > 15 * c["n_words"]),
    Rule("short_words", lambda c: c["word_chars"] < 2 * c["n_words"]),
)


def sampled(docs: DataFrame, rows: int = 2000, seed: int = 5) -> DataFrame:
    """A seeded sample of about ``rows`` rows; take it before costly columns are added."""
    return docs.sample(min(1.0, rows / max(1, docs.count())), seed)


def made(text: str, values: dict[str, Callable[[Column], Column]]) -> dict[str, Column]:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return {k: f(t) for k, f in values.items()}


def seconds(sample: DataFrame, column: Column, turns: int) -> float:
    """Time of ``turns`` evaluations on every row of a sample."""
    began = time.perf_counter()
    sample.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.lit(turns)))).agg(F.count(F.when(column.isNotNull(), 1))).collect()
    return time.perf_counter() - began


def costs(sample: DataFrame, expressions: dict[str, Column], turns: int = 20) -> dict[str, float]:
    """Seconds a row of each expression: many evaluations in one job, less the time of a job with none, the least of two runs."""
    rows = max(1, sample.count())
    nothing = min(seconds(sample, F.col("__turn"), turns) for _ in range(3))
    return {k: max(1e-9, (min(seconds(sample, c, turns) for _ in range(2)) - nothing) / (rows * turns)) for k, c in expressions.items()}


def arranged(rejected: dict[int, int], rules: tuple[Rule, ...], cost: dict[str, float]) -> list[tuple[Rule, int, float]]:
    """Rules by rejection per cost: each time the rule that rejects most of the rows still left for the cost of what it needs and isn't made yet.

    ``rejected`` counts rows by the set of rules that reject them (bit i: rule i).
    Returns each rule with the rows that it rejects in its place, and its cost there.
    """
    left, out, have = set(range(len(rules))), [], set()
    while left:

        def price(i: int) -> float:
            return cost[rules[i].name] + sum(cost[v] for v in rules[i].needs if v not in have)

        def hits(i: int) -> int:
            return sum(n for bits, n in rejected.items() if bits >> i & 1)

        at = min(left, key=lambda i: (-hits(i) / price(i), price(i), i))
        out.append((rules[at], hits(at), price(at)))
        rejected = {bits: n for bits, n in rejected.items() if not bits >> at & 1}
        have |= set(rules[at].needs)
        left.remove(at)
    return out


def ordered(sample: DataFrame, rules: tuple[Rule, ...], text: str = "text", values: dict[str, Callable[[Column], Column]] = VALUES) -> list[tuple[Rule, int, float]]:
    """The order that a sample gives; it decides what is evaluated when, never a verdict."""
    sample = sample.cache()
    try:
        own = made(text, values)
        cols = {x: F.col(f"`{x}`") for x in sample.columns} | own
        bits = sum((F.when(F.coalesce(r.reject(cols), F.lit(False)), 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
        rejected = {r["bits"]: r["n"] for r in sample.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row for each of the sample
        needed = {v: own[v] for r in rules for v in r.needs}
        # a rule's own share is what it does with columns and values that are there
        there = {x: F.col(f"`{x}`") for x in sample.columns} | {v: F.col("__turn") for v in own}
        cost = costs(sample, needed, 4) | costs(sample, {r.name: r.reject(there) for r in rules})
    finally:
        sample.unpersist()
    return arranged(rejected, rules, cost)


def cascade(docs: DataFrame, rules: tuple[Rule, ...], sample: DataFrame, text: str = "text", values: dict[str, Callable[[Column], Column]] = VALUES) -> DataFrame:
    """``docs`` (with the text and the columns that the rules name) with ``kept`` appended.

    ``sample`` has the same columns. A row is kept if no rule rejects it; a rule
    that yields null passes it; a null text is empty. An empty table or sample is
    no error; extra columns stay as they are, one called ``kept`` is replaced;
    rows that repeat have equal verdicts.
    """
    names = docs.columns
    own = made(text, values)
    cols = {x: F.col(f"`{x}`") for x in names}
    out, alive, hidden = docs, F.lit(True), 0
    for r, _, _ in ordered(sample, rules, text, values):
        if new := [v for v in r.needs if v not in cols]:
            # the rows that are still alive get a column, and the values are made for these alone
            flag = f"__alive{hidden}"
            hidden += 1
            out = out.withColumn(flag, alive)
            out = out.withColumns({f"__value_{v}": F.when(F.col(flag), own[v]) for v in new})
            cols |= {v: F.col(f"__value_{v}") for v in new}
            alive = F.col(flag)
        alive = alive & ~F.coalesce(r.reject(cols), F.lit(False))
    return out.select(*[F.col(f"`{x}`") for x in names if x.lower() != "kept"], alive.alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the verdict for all documents, one row for each row of the table.

    A null text has no words and fails; repeated rows have equal results; a null
    doc_id stays null; other columns are left out; an empty table gives no rows.
    """
    docs = pick(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), doc_id="doc_id", text="text")
    stats = with_statistics(docs)
    cols = {x: F.col(x) for x in STATISTICS}
    failed = F.lit(False)
    for r in BASE_RULES:
        failed = failed | r.reject(cols)
    sample = with_statistics(sampled(docs))
    return cascade(stats, RULES, sample).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


OP9_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT r, i, k FROM (
  SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k
  FROM (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w)) WHERE len(k) = 8),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k) WHERE c > 1),
covered AS (SELECT r, sum(least(8, coalesce(i - before, 8))) AS n FROM (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM twice) GROUP BY r),
s AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '\P{L}+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c ON w.r = c.r),
f AS (SELECT *, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines) OR (n_letters >= 40 AND 100 * n_upper > 60 * n_letters)
    OR 100 * n_letters < 50 * word_chars OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept FROM f
"""
