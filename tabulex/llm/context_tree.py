"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions, each made in the contexts of the last 0 to
``depth`` bytes. A context's decision node holds a Krichevsky-Trofimov estimate;
the tree mixes, at every node, stopping there against going one byte deeper,
with weights that the training counts give. Counts are those of the corpus's
byte grams, which grow with it and are never on one machine: grams are dealt by
their two nearest context bytes, or by more of them where a pair has many grams,
so that whole subtrees lie in one partition. Only the nodes above these subtrees
meet on the driver; their number has a bound that no corpus moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, keep, pick, slices, spread, tidy
from .language_id import remainder
from .near_dedup import lowered
from .shingles import words_by_text
from .tallies import Lookup, Tally, frequent, word_keys

DEPTH = 5
#: At most so many of the most frequent grams and words are broadcast (16 and 24 bytes each); the rest are joined.
FREQUENT_GRAMS, FREQUENT_WORDS = 1 << 19, 1 << 18
#: A context of two bytes or more that has over 1 / SHARE of the grams is split by its next byte. So SHARE contexts of a depth are split at most, of 255 nodes each.
SHARE = 512
END = 0xFF  # never part of UTF-8
STREAM = 1 << 18


def streams(texts: list[bytes], depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, grams, bounds): the grams of every byte and end of some texts, in order.

    A gram has its context's bytes, the nearest highest, above the byte itself.
    """
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= STREAM:
            size += len(texts[to])
            to += 1
        pad = bytes([END]) * depth
        buf = np.frombuffer(pad + pad.join(texts[at:to]) + pad, np.uint8).astype(np.int64)
        g = buf[depth:].copy()
        for k in range(1, depth + 1):
            g |= buf[depth - k : len(buf) - k] << np.int64(8 * (depth + 1 - k))
        lengths = np.array([len(t) for t in texts[at:to]])
        start = np.cumsum(np.concatenate(([0], lengths[:-1] + depth)))
        bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
        yield at, to, g[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], lengths + 1)], bounds
        at = to


def counts(docs: DataFrame, depth: int) -> DataFrame:
    """kind (0: words by hash, 1: grams), key, train, every; summed within each task's share already."""

    def rows(kind: int, tally: Tally) -> Iterator[pa.RecordBatch]:
        key, train, every = tally.take()
        for lo in range(0, len(key), 100_000):
            part = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), kind, np.int8)), *(pa.array(x[part].astype(np.int64)) for x in (key, train, every))], names=["kind", "key", "train", "every"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Tally(), Tally()
        for b in slices(batches):
            texts, held = lowered(b.column(0)), np.array(b.column(1).to_pylist(), bool)
            for at, to, g, bounds in streams(texts, depth):
                grams.add(g, np.repeat(~held[at:to], np.diff(bounds)))
                own = list(words_by_text(texts[at:to]))
                words.add(word_keys(own), np.repeat(~held[at:to], [len(w) for w in own]))
                for kind, tally in ((0, words), (1, grams)):
                    if tally.full():  # more different keys than are worth holding
                        yield from rows(kind, tally)
        yield from rows(0, words)
        yield from rows(1, grams)

    return docs.select("text", "held_out").mapInArrow(tidy(run), "kind byte, key long, train long, every long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive x: Stirling's series from x + 8 on, brought back by the recurrence."""
    y = x + 8
    p = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7) if np.max(x, initial=0) < 1e30 else None
    i = 1 / (y * y)
    s = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y
    return s - np.log(p)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov block probability of n0 zeros and n1 ones, natural log."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """The decision nodes of one depth for some grams (context << 8 | byte), and each gram's eight nodes."""

    def __init__(self, grams: np.ndarray, train: np.ndarray):
        byte = grams & 255
        keys = np.concatenate([(grams & ~np.int64(255)) | (1 << j) | (byte >> (8 - j)) for j in range(8)])
        self.bit = np.concatenate([(byte >> (7 - j)) & 1 for j in range(8)]).astype(np.int8).reshape(8, -1)
        self.keys, inverse = np.unique(keys, return_inverse=True)
        inverse = inverse.astype(np.int32)
        self.node = inverse.reshape(8, -1)
        n = np.tile(train, 8).astype(float)
        one = self.bit.reshape(-1) == 1
        self.n1 = np.bincount(inverse[one], n[one], len(self.keys))
        self.n0 = np.bincount(inverse[~one], n[~one], len(self.keys))

    def weigh(self, below: np.ndarray | None) -> None:
        """below: sums of the children's log weighted probabilities; None at the deepest level."""
        own = log_kt(self.n0, self.n1)
        self.log_w = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones(len(own)) if below is None else np.exp(own - np.log(2) - self.log_w)

    def estimate(self) -> np.ndarray:
        """KT's probability of each gram's own bits."""
        n0, n1 = self.n0[self.node], self.n1[self.node]
        return (np.where(self.bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)


def subtree(grams: np.ndarray, train: np.ndarray, depth: int, top: int = 2) -> tuple[list[Level], list[np.ndarray]]:
    """Weighted levels from ``depth`` up to ``top``, and each gram's place among the level's own grams."""
    levels: list[Level] = []
    places: list[np.ndarray] = []
    place, own, n = np.arange(len(grams)), grams, train
    for d in range(depth, top - 1, -1):
        if d < depth:
            shorter = ((own >> 16) << 8) | (own & 255)
            own, inverse = np.unique(shorter, return_inverse=True)
            n = np.bincount(inverse, n, len(own))
            place = inverse[place]
        level = Level(own, n)
        if levels:
            child = levels[-1]
            parent = ((child.keys >> 16) << 8) | (child.keys & 255)
            level.weigh(np.bincount(np.searchsorted(level.keys, parent), child.log_w, len(level.keys)))
        else:
            level.weigh(None)
        levels.append(level)
        places.append(place)
    return levels, places


def context(grams, of: int, depth: int):
    """The ``of`` nearest context bytes of grams (arrays, or a Column by shiftright)."""
    return grams >> np.int64(8 * (depth + 1 - of))


def split_contexts(grams: DataFrame, depth: int) -> list[np.ndarray]:
    """For each depth from 0 on, the sorted contexts that are split; depths 0 and 1 are split whole."""
    n = grams.count()
    out: list[np.ndarray] = []
    for d in range(2, depth):
        mine = F.shiftright("key", 8 * (depth + 1 - d))
        given = grams if d == 2 else grams.where(F.shiftright(mine, 8).isin(out[-1].tolist()))
        rows = given.groupBy(mine.alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > n / SHARE).select("c").collect()  # fewer than SHARE
        if not rows:
            break
        out.append(np.sort(np.array([r["c"] for r in rows], np.int64)))
    return out


def own_depths(g: np.ndarray, split: list[np.ndarray], depth: int) -> np.ndarray:
    """The depth of each gram's subtree: that of its first context which isn't split."""
    out = np.full(len(g), 2)
    for d, contexts in enumerate(split, 2):
        out[np.isin(context(g, d, depth), contexts)] = d + 1
    return out


def blocks(batches: Iterator[pa.RecordBatch], depth: int, split: list[np.ndarray], size: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Sorted grams (key, train, every) in whole subtrees, about ``size`` together, and the depth of these subtrees."""
    held: list[list[np.ndarray]] = []
    n = 0

    def by_depth(g: np.ndarray, t: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        own = own_depths(g, split, depth)
        for d in np.unique(own).tolist():
            at = own == d
            yield g[at], t[at], e[at], d

    for b in batches:
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        n += b.num_rows
        if n >= size:
            g, t, e = (np.concatenate([h[i] for h in held]) for i in range(3))
            shift = np.int64(8 * (depth + 1 - int(own_depths(g[-1:], split, depth)[0])))
            cut = int(np.searchsorted(g >> shift, g[-1] >> shift))
            if cut:
                yield from by_depth(g[:cut], t[:cut], e[:cut])
            held, n = [[g[cut:], t[cut:], e[cut:]]], len(g) - cut
    if n:
        yield from by_depth(*(np.concatenate([h[i] for h in held]) for i in range(3)))


def upper_nodes(rows: list, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, n0, n1, stop) of the nodes above the subtrees, for each depth from 0 on; ``rows`` sums their subtrees."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    up = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0))
    for d in range(depth - 1, -1, -1):
        own = [r for r in rows if r["depth"] == d]
        key = np.concatenate([np.array([r["node"] for r in own], np.int64), up[0]])
        key, inverse = np.unique(key, return_inverse=True)
        n0, n1, below = (np.bincount(inverse, np.concatenate([np.array([r[x] for r in own], float), up[i]]), len(key)) for i, x in enumerate(("n0", "n1", "below"), 1))
        kt = log_kt(n0, n1)
        log_w = np.logaddexp(kt, below) - np.log(2)
        out.append((key, n0, n1, np.exp(kt - np.log(2) - log_w)))
        up = (((key >> 16) << 8) | (key & 255), n0, n1, log_w)
    return out[::-1]


def gram_costs(grams: DataFrame, depth: int) -> DataFrame:
    """key, lp (log10 probability of the gram's byte after its context), every: for each gram (key, train, every)."""
    spark = grams.sparkSession
    n = spark.conf.get("spark.sql.shuffle.partitions")
    split = split_contexts(grams, depth)
    near = F.shiftright("key", 8 * (depth - 1 - len(split)))
    for d, contexts in reversed(list(enumerate(split, 2))):
        mine = F.shiftright("key", 8 * (depth + 1 - d))
        near = F.when(mine.isin(contexts.tolist()), near).otherwise(mine)
    dealt = grams.withColumn("near", near).repartition(int(n), "near").sortWithinPartitions("key").select("key", "train", "every")

    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, t, _, d in blocks(batches, depth, split):
            top = subtree(g, t, depth, d)[0][-1]
            parent = ((top.keys >> 16) << 8) | (top.keys & 255)
            keys, inverse = np.unique(parent, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), d - 1, np.int32)), pa.array(keys), *(pa.array(np.bincount(inverse, x, len(keys))) for x in (top.n0, top.n1, top.log_w))], names=["depth", "node", "n0", "n1", "below"])

    # 257 contexts of depths 0 and 1, SHARE of each other depth, of 255 nodes each
    rows = dealt.mapInArrow(tidy(upward), "depth int, node long, n0 double, n1 double, below double").groupBy("depth", "node").agg(*[F.sum(x).alias(x) for x in ("n0", "n1", "below")]).collect()
    known = spark.sparkContext.broadcast(upper_nodes(rows, depth))

    def downward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, t, e, own in blocks(batches, depth, split):
            levels, places = subtree(g, t, depth, own)
            p = levels[0].estimate()
            for level, place in zip(levels[1:], places[1:], strict=True):
                stop, kt = level.stop[level.node][:, place], level.estimate()[:, place]
                p = stop * kt + (1 - stop) * p
            byte = g & 255
            for d in range(own - 1, -1, -1):
                keys, m0, m1, stop_at = known.value[d]
                for j in range(8):
                    i = np.searchsorted(keys, (context(g, d, depth) << 8) | (1 << j) | (byte >> (8 - j)))
                    bit = (byte >> (7 - j)) & 1
                    kt = (np.where(bit == 1, m1[i], m0[i]) + 0.5) / (m0[i] + m1[i] + 1)
                    p[j] = stop_at[i] * kt + (1 - stop_at[i]) * p[j]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.log10(p).sum(axis=0)), pa.array(e)], names=["key", "lp", "every"])

    return dealt.mapInArrow(tidy(downward), "key long, lp double, every long")


def scored(docs: DataFrame, depth: int, words: Broadcast, grams: Broadcast, end_cost: float) -> DataFrame:
    """Each document's sums over frequent words and grams, and its other words and grams with their counts."""

    def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0.0], np.cumsum(values)))[bounds])

    def others(keys: np.ndarray, found: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        rest = np.flatnonzero(~found)
        edge = np.searchsorted(rest, bounds)
        out = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            k, n = np.unique(keys[rest[lo:hi]], return_counts=True) if hi > lo else (rest[:0], rest[:0])
            out.append((k, n))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_at, gram_at = Lookup(*words.value[:2]), Lookup(*grams.value)
        is_known = Lookup(words.value[0], words.value[2])
        for b in slices(batches):
            texts = lowered(b.column(0))
            got: list[list] = [[] for _ in range(9)]
            for at, to, g, bounds in streams(texts, depth):
                lp, found = gram_at.find(g)
                own = list(words_by_text(texts[at:to]))
                w = word_keys(own)
                edge = np.concatenate(([0], np.cumsum([len(x) for x in own])))
                cost, there = word_at.find(w)
                seen, _ = is_known.find(w)
                for i, x in enumerate((np.diff(edge) + 1, np.diff(bounds) - 1, sums(seen, edge), sums(cost, edge) + end_cost, sums(lp, bounds))):
                    got[i] += x.tolist()
                for i, pairs in ((5, others(w, there, edge)), (7, others(g, found, bounds))):
                    got[i] += [k for k, _ in pairs]
                    got[i + 1] += [n for _, n in pairs]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array(x, kind) for x, kind in zip(got, kinds, strict=True))], names=["doc_id", "held_out", *OUT])

    return docs.select("text", "doc_id", "held_out").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_bytes long, known double, base double, lp double, word array<long>, word_n array<long>, gram array<long>, gram_n array<long>")


OUT = ("n_tokens", "n_bytes", "known", "base", "lp", "word", "word_n", "gram", "gram_n")


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 5, held: int = 1, depth: int = DEPTH) -> DataFrame:
    """Score every text under a model of the documents that aren't held out.

    A document is held out if the crc32 of its id as text leaves ``held`` when
    divided by ``modulus`` (a null id counts as the empty text). Returns one row
    for each row: doc_id, held_out, n_tokens (words and one end), n_known, of
    them seen in training, train_tokens, base_score (log10, unigrams with half a
    count added), score (log10 probability of the lower-cased text's bytes and
    end under the context tree) and bits_per_byte (the code length; the end
    counts as a byte). A null text is empty. Without training documents every
    estimate is the uniform one. Words are told apart by 63-bit hashes.
    Repeated rows are scored each; other columns are left out; an empty table
    gives an empty result.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    table = pick(docs, text=text, doc_id=doc_id).withColumn("held_out", remainder(F.col("doc_id"), modulus) == held)
    counted = keep(counts(table, depth).groupBy("kind", "key").agg(F.sum("train").alias("train"), F.sum("every").alias("every")), "counts")
    words, grams = counted.where("kind = 0").drop("kind"), counted.where("kind = 1").drop("kind")
    train_docs = table.where(~F.col("held_out")).count()
    x = words.agg(F.sum("train").alias("n"), F.count(F.when(F.col("train") > 0, 1)).alias("v")).first()
    n, v = (x["n"] or 0) + train_docs, x["v"] + (train_docs > 0)
    below = np.log10(n + 0.5 * (v + 1))
    often = frequent(words, FREQUENT_WORDS)
    c = often["train"].to_numpy().astype(float)
    word_values = spark.sparkContext.broadcast((often["key"].to_numpy(), np.log10(c + 0.5) - below, (c > 0).astype(float)))
    costs = keep(gram_costs(grams, depth), "costs")
    top = frequent(costs, FREQUENT_GRAMS)
    gram_values = spark.sparkContext.broadcast((top["key"].to_numpy(), top["lp"].to_numpy()))
    end_cost = float(np.log10(train_docs + 0.5) - below)
    parts = scored(table, depth, word_values, gram_values, end_cost).withColumn("rid", F.monotonically_increasing_id())
    parts = keep(parts, "scores")  # from here on rid names a row for good

    def rest(keys: str, counts_: str) -> DataFrame:
        pair = F.explode(F.arrays_zip(F.col(keys).alias("k"), F.col(counts_).alias("n"))).alias("x")
        return parts.where(F.size(keys) > 0).select("rid", pair).select("rid", F.col("x.k").alias("key"), F.col("x.n").alias("times"))

    rare = words.select("key", (F.log10(F.col("train") + 0.5) - float(below)).alias("base"), (F.col("train") > 0).cast("double").alias("known"))
    more = rest("word", "word_n").join(rare, "key").select("rid", (F.col("times") * F.col("base")).alias("base"), (F.col("times") * F.col("known")).alias("known"), F.lit(0.0).alias("lp"))
    deep = rest("gram", "gram_n").join(costs.select("key", "lp"), "key").select("rid", F.lit(0.0).alias("base"), F.lit(0.0).alias("known"), (F.col("times") * F.col("lp")).alias("lp"))
    added = more.union(deep).groupBy("rid").agg(*[F.sum(y).alias(f"more_{y}") for y in ("base", "known", "lp")])
    out = parts.select("rid", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "lp").join(added, "rid", "left")

    def whole(y: str):
        return F.col(y) + F.coalesce(f"more_{y}", F.lit(0.0))

    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.round(whole("known")).cast("long") + (1 if train_docs else 0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        whole("base").alias("base_score"),
        whole("lp").alias("score"),
        (-whole("lp") / float(np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of four fifths of them.

    A null text is empty; a null doc_id counts as the empty text for the split;
    repeated rows are scored each; other columns are left out; an empty table
    gives no rows.
    """
    return finished(spark, lambda: score(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))), "result")
