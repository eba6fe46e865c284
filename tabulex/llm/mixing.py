"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that have them).
A pattern's words flow to the quotas of its sources; each further copy of the
same words costs more (convex costs), so repetition is spread before anything
is repeated again. The flow says how many words each pattern gives; every
document of a pattern is taken the same whole number of times, and a seeded
subset once more.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import find, keep, n_words, numbered, pick, spread

#: Patterns and sources are settings of a mix, not data; their sums go to the driver. More than this is an error.
MAX_PATTERNS = 200_000


def quotas(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float) -> dict[str | None, float]:
    """``total`` shared by weight; what a source can't take (``most`` times its size) is shared anew by weight among the rest."""
    out: dict[str | None, float] = {}
    open_ = {s for s in sizes}
    left = total
    while open_:
        all_weights = math.fsum(weights[s] for s in open_)
        share = {s: left * weights[s] / all_weights for s in open_}
        full = {s for s in open_ if share[s] >= most * sizes[s]}
        if not full:
            return out | share
        out |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
        left = total - math.fsum(out.values())
    return out


def min_cost_flow(patterns: list[tuple[int, list[int]]], caps: list[int], copies: int) -> list[list[int]]:
    """Words that each pattern gives to each of its sources.

    ``patterns``: (words, source numbers); ``caps``: the sources' quotas. The
    k-th copy of a pattern's words costs k - 1 a word. Successive shortest
    paths with potentials; few costs exist, so paths carry much flow each.
    """
    start, end = 0, 1 + len(patterns) + len(caps)
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(u: int, v: int, c: int, w: int) -> int:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)
        return len(to) - 2

    given: list[list[int]] = []
    for p, (words, members) in enumerate(patterns):
        for k in range(copies):
            arc(start, 1 + p, words, k)
        given.append([arc(1 + p, 1 + len(patterns) + s, words * copies, 0) for s in members])
    for s, c in enumerate(caps):
        arc(1 + len(patterns) + s, end, c, 0)
    height = [0] * (end + 1)
    while True:
        dist: list[float] = [math.inf] * (end + 1)
        dist[start], via, heap = 0, [-1] * (end + 1), [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in out[u]:
                if cap[e] and (new := d + cost[e] + height[u] - height[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if dist[end] == math.inf:
            break
        far = dist[end]
        height = [h + int(min(d, far)) for h, d in zip(height, dist, strict=True)]
        # block along every path of this cost before the next search
        while True:
            path, u = [], end
            seen = {start: -1}
            stack = [start]
            while stack and end not in seen:
                x = stack.pop()
                for e in out[x]:
                    if cap[e] and to[e] not in seen and cost[e] + height[x] - height[to[e]] == 0:
                        seen[to[e]] = e
                        stack.append(to[e])
            if end not in seen:
                break
            while u != start:
                path.append(seen[u])
                u = to[seen[u] ^ 1]
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow
    return [[cap[e ^ 1] for e in g] for g in given]


def take(rows: DataFrame, want: dict[str, int], sizes: dict[str, int], seed: int) -> DataFrame:
    """``rows`` (pattern, size, ...) with ``copies``: near ``want`` words of each pattern, in whole documents.

    Documents are ordered by a seeded 63-bit hash. Sums over its first twelve
    bits, then over the next twelve where the target falls, leave a 2^-24 part
    of a pattern to be ordered exactly; one document may then be exchanged for
    the one whose size fits the gap best.
    """
    spark = rows.sparkSession
    base = {p: (want[p] // sizes[p] if sizes[p] else 0) for p in want}
    rest = {p: want[p] - base[p] * sizes[p] for p in want}
    h = F.col("h")
    level = [F.shiftright(h, 51), F.shiftright(h, 39).bitwiseAND(4095)]
    more = {p: r for p, r in rest.items() if r}

    def local(values: dict[str, tuple], kinds: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(p, *v) for p, v in values.items()], f"pattern string, {kinds}"))  # MAX_PATTERNS rows at most

    def crossing(df: DataFrame, by: Column, left: dict[str, int]) -> dict[str, tuple[int, int]]:
        """For each pattern, the group in which the target falls and the words before it: at most 4096 sums a pattern are put in order."""
        from pyspark.sql import Window

        sums = df.groupBy("pattern", by.alias("g")).agg(F.sum("size").alias("w"))
        before = F.coalesce(F.sum("w").over(Window.partitionBy("pattern").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        there = sums.select("pattern", "g", "w", before.alias("b")).join(local({p: (r,) for p, r in left.items()}, "r long"), "pattern")
        return {x["pattern"]: (x["g"], x["b"]) for x in there.where((F.col("b") <= F.col("r")) & (F.col("b") + F.col("w") > F.col("r"))).collect()}

    one = crossing(rows, level[0], more)
    inside = rows.join(local({p: (g,) for p, (g, _) in one.items()}, "g1 long"), "pattern").where(level[0] == F.col("g1"))
    left = {p: more[p] - b for p, (_, b) in one.items()}
    two = crossing(inside, level[1], left)
    cut = {p: (one[p][0] * 4096 + two[p][0]) for p in two}
    left = {p: left[p] - two[p][1] for p in two}
    from pyspark.sql import Window

    last = rows.join(local({p: (c, left[p]) for p, c in cut.items()}, "c long, r long"), "pattern").where(F.shiftright(h, 39) == F.col("c"))
    run = F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, 0))
    final = last.withColumn("run", run).where(F.col("run") <= F.col("r")).groupBy("pattern").agg(F.max(F.struct("h", "rid")).alias("x"), F.max("run").alias("run"))
    reached = {x["pattern"]: (x["x"]["h"], x["x"]["rid"], x["run"]) for x in final.collect()}
    # documents up to (lim, rid) get one copy more; without a document in the last group, all before the group
    limits: dict[str, tuple[int, int, int]] = {}
    for p in want:
        if not rest[p]:
            limits[p] = (-1, -1, 0)
        elif p in reached:
            limits[p] = (reached[p][0], reached[p][1], left[p] - reached[p][2])
        elif p in cut:
            limits[p] = ((cut[p] << 39) - 1, 1 << 62, left[p])
        else:
            limits[p] = (1 << 62, 1 << 62, 0)
    bound = local({p: (base[p], *v) for p, v in limits.items()}, "base long, lim long, lim_rid long, gap long")
    chosen = rows.join(bound, "pattern", "left")
    extra = (h < F.col("lim")) | ((h == F.col("lim")) & (F.col("rid") <= F.col("lim_rid")))
    off = F.abs(F.col("size") - F.col("gap"))
    fit = chosen.where(~extra & (F.col("gap") > 0) & (off < F.col("gap"))).groupBy("pattern").agg(F.min(F.struct(off.alias("o"), "h", "rid")).alias("x"))
    fits = {x["pattern"]: (x["x"]["rid"],) for x in fit.collect()}
    out = chosen.join(local(fits, "fit long"), "pattern", "left")
    return out.withColumn("copies", (F.col("base") + (extra | (F.col("rid") == F.coalesce("fit", F.lit(-1)))).cast("long")).cast("long")).drop("base", "lim", "lim_rid", "gap", "fit")


def mix_sources(docs: DataFrame, members: Column | str, size: Column | str, weights: dict[str | None, float] | None = None, total_share: float = 1.5, max_copies: int = 2, seed: int = 11) -> DataFrame:
    """How often each document is taken into a mix of sources.

    ``members`` is an array of the sources that have the document (null is a
    source like any other; an empty array gives no copies) and ``size`` its
    words; both are names or expressions over ``docs``. The mix has
    ``total_share`` times all words, shared by ``weights`` (by default 5, 2, 1,
    repeating over the sources in code point order, null last), a source giving
    at most ``max_copies`` times what it has; a document of several sources
    counts in each one's size.

    Returns the columns of ``docs`` with ``copies`` long, ``source_size`` and
    ``target`` (lists, in the members' order) appended. Repeated rows are
    documents of their own. Empty texts are taken like their neighbours, at no
    words. An empty table gives an empty result. The choice depends on the
    rows' contents and the seed.
    """
    spark = docs.sparkSession
    names = docs.columns
    members = F.col(members) if isinstance(members, str) else members
    size = F.col(size) if isinstance(size, str) else size
    n = numbered(docs.withColumns({"__members": F.sort_array(F.array_distinct(members)), "__size": F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")}))
    m, w = F.col(f"c{len(names)}"), F.col(f"c{len(names) + 1}")
    plain = [F.col(f"c{i}") for i in range(len(names))]
    rows = n.select(*plain, F.to_json(m).alias("pattern"), w.alias("size"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), *plain), 1).alias("h"), F.monotonically_increasing_id().alias("rid"))
    rows = keep(rows, "sizes")
    import json

    sums = rows.groupBy("pattern").agg(F.sum("size").alias("w")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted((r["pattern"], r["w"]) for r in sums)
    lists = [json.loads(p) for p, _ in patterns]
    sources = sorted({s for x in lists for s in x if s is not None}) + [None] * any(None in x for x in lists)
    sizes = {s: sum(w for (_, w), x in zip(patterns, lists, strict=True) if s in x) for s in sources}
    if weights is None:
        weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    targets = quotas(sizes, weights, total_share * sum(w for _, w in patterns), max_copies)
    at = {s: i for i, s in enumerate(sources)}
    flow = min_cost_flow([(w, [at[s] for s in x]) for (_, w), x in zip(patterns, lists, strict=True)], [round(targets[s]) for s in sources], max_copies)
    want = {p: sum(f) for (p, _), f in zip(patterns, flow, strict=True)}
    taken = take(rows, want, dict(patterns), seed)
    facts = spark.createDataFrame([(p, [sizes[s] for s in x], [targets[s] for s in x]) for (p, _), x in zip(patterns, lists, strict=True)], T.StructType([T.StructField("pattern", T.StringType()), T.StructField("source_size", T.ArrayType(T.LongType())), T.StructField("target", T.ArrayType(T.DoubleType()))]))
    out = taken.join(F.broadcast(facts), "pattern", "left")  # MAX_PATTERNS rows at most
    return out.select(*[F.col(f"c{i}") for i in range(len(names))], F.coalesce("copies", F.lit(0)).alias("copies"), "source_size", "target").toDF(*names, "copies", "source_size", "target")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of their words; each has one source."""
    docs = pick(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), doc_id="doc_id", text="text", source="source")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix_sources(sized, F.array("source"), "size")
    return out.select("doc_id", "size", F.element_at("source_size", 1).alias("source_size"), F.element_at("target", 1).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))
