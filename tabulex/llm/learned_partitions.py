"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of equal size; a small
softmax classifier learns the parts from the vectors. Every vector is indexed
under its most probable part, and a query is reranked exactly in the several
parts that are most probable for it. Equal vectors are one entry with their
smallest ids, and large parts are searched in blocks, so no task grows with a
part or with a group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import finished, keep, pick, spread, tidy

SAMPLE = 16384  # vectors that the graph and the classifier are fitted on, at most
RECALL, TRIALS = 0.95, 256  # recall that the number of visited parts is chosen for, on so many queries that the fit doesn't see
LEAST_PARTS, IN_PART, FITTED = 8, 32, 16  # parts if each has vectors enough; so many; sampled ones that a part is learned from
BLOCK = 16384  # vectors of a part that are searched together, and queries


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """Each vector's k nearest by inner product, itself left out."""
    out = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for lo in range(0, len(x), 256):
        s = -(x[lo : lo + 256] @ x.T)
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = np.inf
        out[lo : lo + 256] = np.argpartition(s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def bisect(x: np.ndarray, near: np.ndarray, members: np.ndarray, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few edges between: from a split along the main axis, moved to where neighbours are."""
    own = x[members] - x[members].mean(axis=0)
    v = own[np.argmax((own * own).sum(axis=1))].copy()
    for _ in range(20):
        v = own.T @ (own @ v)
        norm = np.linalg.norm(v)
        if not norm:
            break
        v /= norm
    side = np.zeros(len(members))
    side[np.argsort(own @ v, kind="stable")[len(members) // 2 :]] = 1
    place = np.full(len(x), -1)
    place[members] = np.arange(len(members))
    edges = place[near[members]]
    inside = edges >= 0
    source = np.repeat(np.arange(len(members)), edges.shape[1])[inside.ravel()]
    target = edges.ravel()[inside.ravel()]
    for _ in range(turns):
        pull = np.bincount(source, 2 * side[target] - 1, len(members)) + np.bincount(target, 2 * side[source] - 1, len(members)) + 0.5 * (2 * side - 1)
        new = np.zeros(len(members))
        new[np.argsort(pull, kind="stable")[len(members) // 2 :]] = 1
        if (new == side).all():
            break
        side = new
    return members[side == 0], members[side == 1]


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """A part for each vector: recursive bisection of the neighbour graph."""
    out = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        members, first, n = todo.pop()
        if n <= 1 or len(members) < 2:
            out[members] = first
            continue
        a, b = bisect(x, near, members)
        todo += [(a, first, n // 2), (b, first + n // 2, n - n // 2)]
    return out


class Router:
    """Multinomial logistic regression from a vector to its part and its neighbours' parts, half each."""

    def __init__(self, x: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int, epochs: int = 40, seed: int = 7):
        target = 0.5 * np.eye(parts)[part]
        np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
        self.scale = float(np.sqrt((x * x).sum(axis=1).mean())) or 1.0
        f = self.features(x)
        w, m, v = (np.zeros((f.shape[1], parts)) for _ in range(3))
        rng, t = np.random.default_rng(seed), 0
        for _ in range(epochs):
            order = rng.permutation(len(f))
            for lo in range(0, len(f), 256):
                i = order[lo : lo + 256]
                p = f[i] @ w
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p -= target[i]
                g = f[i].T @ p / len(i) + 1e-5 * w
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x / self.scale * math.sqrt(x.shape[1]) / 4, np.ones((len(x), 1))])

    def visits(self, x: np.ndarray, near: list[list[int]]) -> tuple[int, float]:
        """The fewest parts in which queries find RECALL of their nearest, whose parts are ``near``; and the share found there."""
        order = self.best(x, self.w.shape[1])
        rank = np.argsort(order, axis=1)
        found = np.concatenate([rank[i, parts] for i, parts in enumerate(near)])
        share = np.cumsum(np.bincount(found, minlength=order.shape[1])) / max(1, len(found))
        m = int(np.argmax(share >= RECALL))
        return m + 1, float(share[m])

    def best(self, x: np.ndarray, k: int) -> np.ndarray:
        s = self.features(x) @ self.w
        k = min(k, s.shape[1])
        return np.argsort(-s, axis=1, kind="stable")[:, :k]


def usable(vectors: DataFrame) -> DataFrame:
    """id, v, key: vectors that take part (not null, not zero, every component finite), as double arrays."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    t = vectors.select("id", v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    # -0.0 equals 0.0
    return t.where(F.coalesce(ok, F.lit(False))).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def smallest(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The k first rows of each key: first within salted shares of a key, then of what these leave."""
    part = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != "v"]), F.lit(64)))
    w = Window.partitionBy(key, "__salt").orderBy(*order)
    part = part.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r", "__salt")
    return part.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def parts_for(n: int, fitted: int) -> int:
    """Parts for n vectors: a quarter of n's root, so that their number and their size grow alike, as far as the sample allows; one for a handful."""
    return max(LEAST_PARTS, min(round(math.sqrt(n) / 4), fitted // FITTED)) if n >= LEAST_PARTS * IN_PART else 1


def neighbours_parts(indexed: DataFrame, trials: dict[str, np.ndarray], k: int) -> list[list[int]]:
    """The parts of each trial query's k nearest in the whole index."""
    keys, x = list(trials), np.array(list(trials.values()))
    at = {key: i for i, key in enumerate(keys)}
    known = indexed.sparkSession.sparkContext.broadcast((at, x))  # TRIALS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = known.value
        top = np.full((len(x), k), -np.inf)
        parts = np.zeros((len(x), k), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            s = x @ np.array(b.column(1).to_pylist()).reshape(b.num_rows, -1).T
            for j, key in enumerate(b.column(0).to_pylist()):
                if key in at:
                    s[at[key], j] = -np.inf
            s, p = np.hstack([top, s]), np.hstack([parts, np.broadcast_to(np.array(b.column(2).to_pylist(), np.int32), s.shape)])
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            top, parts = np.take_along_axis(s, best, 1), np.take_along_axis(p, best, 1)
        i, j = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(top[i, j]), pa.array(parts[i, j], pa.int32())], names=["i", "s", "part"])

    each = indexed.select("key", "v", "part").mapInArrow(tidy(run), "i long, s double, part int")
    near = each.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s")))).where(F.col("r") <= k)
    out: list[list[int]] = [[] for _ in keys]
    for r in near.select("i", "part").collect():  # TRIALS * k rows
        out[r["i"]].append(r["part"])
    return out


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", probes: int | None = None, seed: int = 13, report: dict | None = None) -> DataFrame:
    """The k largest inner products for every query, by the learned index.

    ``is_query`` makes a boolean Column of the id's Column. Candidates are all
    usable rows but the query's own id; null, zero and non-finite vectors take
    no part. Vectors of a length other than the commonest have no product with
    the others and are left out too, as candidates and as queries. Returns query_id, rank (from 1), vec_id, score (double, on the original
    vectors), nearest first, ties to the smaller id. Fewer than k candidates
    are all found. Null ids take no part; rows that repeat an id and vector
    are one candidate. An empty table gives an empty result.

    The graph and the classifier are fitted on at most ``SAMPLE`` vectors; all
    vectors are indexed. A query visits ``probes`` parts, by default as many as
    ``TRIALS`` queries, which the fit hasn't seen, need to find ``RECALL`` of
    their nearest in the whole table. ``report`` gets the number of parts, of
    visited ones, and the recall of the trial queries.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(pick(vectors, id=vec_id, embedding=embedding)).where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "v")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return empty
    rows = keep(rows.where(F.size("v") == sizes[0]["d"]).withColumn("key", F.md5(F.to_json("v"))), "vectors")
    # copies: k + 1 ids of a vector are all that any query can need
    entries = keep(smallest(rows.dropDuplicates(["id", "key"]), "key", [F.col("id")], k + 1).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")), "entries")
    n = entries.count()
    share = min(1.0, 1.1 * (SAMPLE + TRIALS) / n)
    picked = entries.withColumn("h", F.xxhash64(F.lit(seed), "key")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("h", "key", "v").orderBy("h").limit(SAMPLE + TRIALS).toArrow()
    held = min(TRIALS, len(picked) // 5)
    keys, all_picked = picked["key"].to_pylist()[:held], picked["v"].combine_chunks().flatten().to_numpy().reshape(len(picked), -1)
    trials, x = dict(zip(keys, all_picked, strict=False)), all_picked[held:]
    del picked
    parts = parts_for(n, len(x))
    router, visits = None, 1
    if parts > 1:
        # directions make better parts than lengths; the rerank has the true measure
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = neighbour_graph(unit)
        router = Router(x, balanced_parts(unit, near, parts), near, parts)
    known = spark.sparkContext.broadcast(router)  # vector length times SAMPLE / FITTED at most

    def routed(df: DataFrame, most: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = known.value
            for b in batches:
                v = np.array(b.column(2).to_pylist()).reshape(b.num_rows, -1)
                best = r.best(v, most).tolist() if r and b.num_rows else [[0]] * b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.list_(pa.int32()))], names=["key", "ids", "v", "parts"])

        return df.select("key", "ids", "v").mapInArrow(tidy(run), "key string, ids array<long>, v array<double>, parts array<int>")

    indexed = keep(routed(entries, 1).select("key", "ids", "v", F.element_at("parts", 1).alias("part")), "index")
    sizes = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    recall = 1.0
    if router is not None:
        visits, recall = (probes, math.nan) if probes else router.visits(np.array(list(trials.values())), neighbours_parts(indexed, trials, k))
        # whichever parts a query visits, they hold k others if the table does
        smallest_first = np.cumsum(sorted(sizes.get(p, 0) for p in range(parts)))
        visits = min(parts, max(visits, int(np.searchsorted(smallest_first, min(k + 1, n))) + 1))
    if report is not None:
        report |= {"vectors": n, "parts": parts, "visits": visits, "recall": recall}
    ask = rows.where(is_query(F.col("id"))).select("key").distinct()
    asked = keep(routed(entries.join(ask, "key", "left_semi"), visits).select("key", "v", F.posexplode("parts").alias("turn", "part")), "asked")
    # parts by blocks, on both sides: a block pair is one bounded task
    most = {p: (math.ceil(size / BLOCK), 0) for p, size in sizes.items()}
    for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["part"] in most:
            most[r["part"]] = (most[r["part"]][0], math.ceil(r["n"] / BLOCK))
    table = F.broadcast(spark.createDataFrame([(p, a, q) for p, (a, q) in sorted(most.items())], "part int, blocks int, q_blocks int"))  # a row for each part
    h = F.xxhash64(F.lit(seed + 1), "key")
    left = indexed.join(table, "part").where("q_blocks > 0").withColumn("b", F.pmod(h, F.col("blocks")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))

    def frame(keys: list, ids: list, scores: list) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), "ids": pd.Series(ids, dtype=object), "score": pd.Series(scores, dtype=float)})

    def rank(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(queries):
            return frame([], [], [])
        a, q = np.array(own["v"].tolist()), np.array(queries["v"].tolist())
        least = queries["least"].tolist()
        keys, ids, scores = [], [], []
        all_ids = own["ids"].tolist()
        first = np.array([i[0] for i in all_ids])
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            for query, row, key, bound in zip(part, part @ a.T, queries["key"].tolist()[lo : lo + 256], least[lo : lo + 256], strict=True):
                if bound is not None and bound == bound and row.max() < bound - 1e-9 * max(1.0, abs(bound)):
                    continue
                at = np.arange(len(row))
                if len(row) > k + 1:
                    edge = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    at = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
                # one order of additions for every pair, so that equal products are equal
                exact = np.cumsum(a[at] * query, axis=1)[:, -1]
                best = np.lexsort((first[at], -exact))[: k + 1]
                if bound is not None and bound == bound:
                    best = best[exact[best] >= bound]
                keys += [key] * len(best)
                ids += [all_ids[i] for i in at[best]]
                scores += exact[best].tolist()
        return frame(keys, ids, scores)

    def reranked(queries: DataFrame) -> DataFrame:
        right = queries.join(table, "part").withColumn("q", F.pmod(h, F.col("q_blocks")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sides = left.select("part", "b", "q", "ids", "v").groupBy("part", "b", "q").cogroup(right.select("part", "b", "q", "key", "v", "least").groupBy("part", "b", "q"))
        return sides.applyInPandas(rank, "key string, ids array<long>, score double")

    # the likeliest part gives each query a score that the others' entries must reach to matter
    near = keep(reranked(asked.where("turn = 0").withColumn("least", F.lit(None).cast("double"))), "nearest")
    bounds = near.groupBy("key").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("least"))
    found = near.union(reranked(asked.where("turn > 0").join(bounds, "key", "left")))
    # a query leaves itself out, so k + 1 candidates of its vector are enough
    single = found.select("key", "score", F.explode("ids").alias("vec_id"))
    best = single.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list"))
    asking = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "key").distinct()
    others = asking.join(best, "key").select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return others.select("query_id", F.posexplode("list").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20.

    Null, zero and non-finite vectors take no part, nor do null ids; ties go to
    the smaller id; rows that repeat an id and vector are one candidate; an
    empty table gives no rows.
    """
    return finished(spark, lambda: search(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), lambda i: i % 20 == 0, k=20), "result")
