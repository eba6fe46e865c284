"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles: the damped count of a
shingle times its mean word idf. Two documents' samples agree with a
probability that is their weighted Jaccard similarity; samples are banded, and
every document of a band's bucket is held against the bucket's representative
on whole shingle sets. In buckets that hold several components after that, all
pairs between components are settled: by bounds on weights and on common
shingles, and the rest on whole sets. Large buckets are dealt to blocks for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find, finished, keep, numbered, parallelism, pick, slices, spread, tidy
from .line_dedup import bytes_of
from .shingles import mix, shingles, words_by_text
from .tallies import Lookup, Tally, frequent, word_keys

#: The most frequent words, whose counts are broadcast (16 bytes each); all others count as the rarest of these.
FREQUENT_WORDS = 1 << 18
BANDS, ROWS = 12, 3
#: Buckets of more than twice this many texts, or shingles, are dealt to cells of about so many; a block has two cells at most.
CELL, CELL_SHINGLES = 500, 1_400_000
#: The largest shingle weight from idf is 1 + IDF_SPAN times the smallest.
IDF_SPAN = 1.0


def lowered(column: pa.Array) -> list[bytes]:
    return [(t or b"").lower() for t in bytes_of(column)]


def document_frequencies(docs: DataFrame) -> tuple[int, pa.Table, int]:
    """The number of documents, the most frequent words (key, every: documents that have it), and a count that no other word passes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def rows() -> Iterator[pa.RecordBatch]:
            key, _, every = tally.take()
            for lo in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000].astype(np.int64)) for x in (key, every)], names=["key", "every"])

        for b in slices(batches):
            texts = lowered(b.column(0))
            for lo in range(0, len(texts), 256):
                own = [np.unique(w) for w in words_by_text(texts[lo : lo + 256])]
                keys = word_keys(own) if own else np.zeros(0, np.int64)
                tally.add(keys, np.zeros(len(keys), bool))
                if tally.full():  # more different words than are worth holding
                    yield from rows()
        yield from rows()

    counted = keep(docs.select("text").mapInArrow(tidy(count), "key long, every long").groupBy("key").agg(F.sum("every").alias("every")), "words")
    often = frequent(counted, FREQUENT_WORDS)
    rest = counted.count() > len(often)
    least = int(pc.min(often["every"]).as_py() or 1) if len(often) else 1
    return docs.count(), often, least if rest else 1


class WordValues:
    """From 1 for words that all documents have to 1 + IDF_SPAN for words of one."""

    def __init__(self, n: int, keys: np.ndarray, every: np.ndarray, least: int):
        def value(x: np.ndarray) -> np.ndarray:
            return 1 + IDF_SPAN * np.log((n + 1) / (np.minimum(x, n) + 1)) / np.log(n + 2)

        self.lookup, self.rest = Lookup(keys, value(every.astype(float))), float(value(np.array([float(least)]))[0])

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(0)
        values, found = self.lookup.find(word_keys([words]))
        return np.where(found, values, self.rest)


def weighted(words: np.ndarray, values: WordValues) -> tuple[np.ndarray, np.ndarray]:
    """A document's shingles, sorted, and their weights."""
    h, count, value = shingles(words, values.of(words))
    order = np.argsort(h)
    return h[order], ((1 + np.log(count)) * value)[order]


class Sampler:
    """Improved consistent weighted sampling (Ioffe, 2010) with tabulated gamma variables."""

    def __init__(self, samples: int, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(0, 1 << 63, samples, dtype=np.uint64)[:, None]
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        # quantiles of Gamma(2, 1): the root of 1 - (1 + x) exp(-x) = u
        x = -np.log1p(-u) + 1.0
        for _ in range(60):
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
        self.gamma, self.log_gamma = x.astype(np.float32), np.log(x).astype(np.float32)

    def sample(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One 64-bit value a sample: the chosen shingle and its level."""
        best = np.full(len(self.seeds), np.inf, np.float32)
        out = np.zeros(len(self.seeds), np.uint64)
        log_w = np.log(weight).astype(np.float32)
        every = np.arange(len(self.seeds))
        for lo in range(0, len(h), 1024):
            part = h[lo : lo + 1024]
            z = part[None, :] ^ self.seeds
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(29)
            z *= np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(32)
            halves = z.view(np.uint16).reshape(*z.shape, 4)
            r = self.gamma[halves[..., 3]]
            beta = z.view(np.uint32).reshape(*z.shape, 2)[..., 0].astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(log_w[None, lo : lo + 1024] / r + beta)
            a = self.log_gamma[halves[..., 2]] - r * (t - beta + 1)
            i = a.argmin(axis=1)
            low = a[every, i]
            better = low < best
            if better.any():
                best[better] = low[better]
                level = t[every, i].astype(np.int64).astype(np.uint64)
                out[better] = mix(part[i] ^ (level * np.uint64(0x9E3779B97F4A7C15)))[better]
        return out


def signatures(docs: DataFrame, values: Broadcast, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest of the text and one key a band; texts without words have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, known = Sampler(bands * rows), WordValues(*values.value)
        factor = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(rows)], np.uint64)
        for b in slices(batches):
            texts, keys = lowered(b.column(0)), []
            for lo in range(0, len(texts), 256):
                for words in words_by_text(texts[lo : lo + 256]):
                    h, w = weighted(words, known)
                    keys.append(mix((sampler.sample(h, w).reshape(bands, rows) * factor).sum(axis=1, dtype=np.uint64)).view(np.int64) if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "keys"])

    given = docs.select("text", "doc_id", digest_of("text"))
    return given.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, keys array<long>")


def digest_of(text: str):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest")


def features(docs: DataFrame, wanted: DataFrame, values: Broadcast) -> DataFrame:
    """The weighted shingles of each wanted text, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordValues(*values.value)
        for b in slices(batches):
            sets = [weighted(w, known) for w in words_by_text(lowered(b.column(1)))]
            stored = [pa.array([x[k].astype(kind).tobytes() for x in sets], pa.large_binary()).cast(pa.binary()) for k, kind in ((0, np.uint64), (1, np.float32))]
            whole = [float(x[1].astype(np.float32).astype(float).sum()) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *stored, pa.array([len(x[0]) for x in sets], pa.int64()), pa.array(whole, pa.float64())], names=["digest", "h", "w", "size", "whole"])

    # copies are one text before they shuffle: a large group of them is no task's own
    one = docs.select(digest_of("text"), "text").groupBy("digest").agg(F.min("text").alias("text")).join(wanted, "digest", "left_semi")
    return one.mapInArrow(tidy(run), "digest binary, h binary, w binary, size long, whole double")


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    """Whether two sets (sorted shingles, weights) have a weighted or a plain Jaccard similarity of ``threshold``."""
    (xa, fa), (xb, fb) = a, b
    at = np.searchsorted(xb, xa)
    at[at == len(xb)] = 0
    same = xb[at] == xa if len(xb) else np.zeros(len(xa), bool)
    n = int(same.sum())
    if n and n >= threshold * (len(xa) + len(xb) - n) - 1e-9:
        return True
    both = np.minimum(fa[same], fb[at[same]]).sum()
    whole = fa.sum() + fb.sum() - both
    return bool(whole > 0 and both >= threshold * whole - 1e-9)


def read_set(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32).astype(float)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = []
            for ha, wa, hb, wb in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                ok.append(alike(read_set(ha, wa), read_set(hb, wb), threshold))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    one = pairs.join(sets.select(F.col("digest").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa")), "a")
    two = one.join(sets.select(F.col("digest").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb")), "b")
    return two.select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(tidy(run), "a binary, b binary")


def common_prefixes(sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> np.ndarray:
    """n x n: which pairs may reach ``threshold``; the others can't, as they share no shingle of their prefixes.

    Shingles are ordered, the rarest of the block first. A set's prefix ends where
    the shingles behind it weigh less than ``threshold`` of the set.
    """
    n = len(sets)
    if n <= 8:
        return np.ones((n, n), bool)
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    _, which, count = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    order = np.lexsort((which, count[which], owner))
    owner, which = owner[order], which[order]
    sums = np.cumsum(np.concatenate([w for _, w in sets])[order])
    ends = sums[np.flatnonzero(np.r_[owner[1:] != owner[:-1], True])]
    weight = np.diff(np.r_[0.0, ends])
    behind = ends[owner] - np.r_[0.0, sums[:-1]]
    mine = (behind >= threshold * weight[owner] - 1e-6) & (count[which] > 1)
    owner, which = owner[mine], which[mine]
    by = np.argsort(which, kind="stable")
    owner, which = owner[by], which[by]
    out = np.zeros((n, n), bool)
    if not len(which):
        return out
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(which)], strict=True):
        if hi - lo > 1:
            out[np.ix_(owner[lo:hi], owner[lo:hi])] = True
    return out


def block_links(rows: list[tuple], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links that join all components of a block which any eligible pair of it joins.

    A row is (side, band, digest, label, keys, h, w, whole). Pairs are eligible
    between different components, of different sides (side 2: any), and in the
    first band whose bucket they share.
    """
    side, band, digest, label, keys, h, w, whole = zip(*rows, strict=True)
    names = {x: i for i, x in enumerate(dict.fromkeys(label))}
    own = np.array([names[x] for x in label])
    sides, bands, k, weight = np.array(side), np.array(band), np.array(keys, np.int64), np.array(whole)
    may = np.triu(own[:, None] != own, 1) & ((sides[:, None] != sides) | (sides == 2)) & (bands[:, None] == bands)
    size = np.array([len(x) // 8 for x in h], float)

    def near(x: np.ndarray) -> np.ndarray:
        return np.minimum(x[:, None], x) >= threshold * np.maximum(x[:, None], x) - 1e-6

    by_weight, by_size = near(weight), near(size)
    may &= by_weight | by_size
    first = np.full(may.shape, -1, np.int16)
    for i in reversed(range(k.shape[1])):
        first[k[:, i][:, None] == k[:, i]] = i
    may &= first == bands
    if not may.any():
        return []
    sets = [read_set(a, b) for a, b in zip(h, w, strict=True)]
    may &= by_weight & common_prefixes(sets, threshold) | by_size & common_prefixes([(x, np.ones(len(x))) for x, _ in sets], threshold)
    top = list(range(len(names)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(may)), strict=True):
        a, b = root(own[i]), root(own[j])
        if a != b and alike(sets[i], sets[j], threshold):
            top[a] = b
            out.append((digest[i], digest[j]))
    return out


def links_between(members: DataFrame, sets: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all components which pairs of a bucket join: no pair of a bucket is left out.

    Buckets with several components go to blocks, small ones whole. The texts of
    a large one are dealt to cells by weight and hash; texts whose weights are
    two classes apart can't be similar, and all other pairs of cells are a block.
    """
    width = 1.001 * max(-math.log(max(threshold, 1e-9)), 0.01)
    sized = sets.select("digest", "size", "whole", F.floor(F.log("whole") / width).cast("int").alias("c"))
    own = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest")).join(sized, "digest")
    most = F.greatest(F.count(F.lit(1)) / F.lit(CELL), F.sum("size") / F.lit(CELL_SHINGLES))
    mixed = own.groupBy("band", "key").agg((F.min("label") != F.max("label")).alias("mixed"), F.when(most <= 2, 0).otherwise(F.ceil(most)).cast("int").alias("g")).where("mixed").drop("mixed")
    s = F.pmod(F.xxhash64(F.lit(31), "digest"), F.col("g")).cast("int")

    def cells(c1, s1, c2, s2, side):
        return F.struct(F.xxhash64("band", "key", c1, s1, c2, s2).alias("block"), side.cast("int").alias("side"))

    c, others = F.col("c"), F.sequence(F.lit(0), F.col("g") - 1)
    within = F.transform(others, lambda t: cells(c, F.least(s, t), c, F.greatest(s, t), F.when(s == t, 2).when(s < t, 0).otherwise(1)))
    above = F.transform(others, lambda t: cells(c, s, c + 1, t, F.lit(0)))
    below = F.transform(others, lambda t: cells(c - 1, t, c, s, F.lit(1)))
    one = F.array(F.struct(F.xxhash64("band", "key").alias("block"), F.lit(2).alias("side")))
    dealt = own.join(mixed, ["band", "key"]).withColumn("x", F.explode(F.when(F.col("g") == 0, one).otherwise(F.concat(within, above, below))))
    dealt = keep(dealt.select("x.block", "x.side", "band", "digest", "label", "keys"), "dealt")
    used = dealt.groupBy("block").agg((F.min("label") != F.max("label")).alias("mixed"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("mixed and (hi = 2 or lo <> hi)").select("block")
    full = dealt.join(used, "block").join(sets.select("digest", "h", "w", "whole"), "digest")
    full = full.select("block", "side", "band", "digest", "label", "keys", "h", "w", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], None

        def links() -> pa.RecordBatch:
            found = block_links(rows, threshold) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.binary()), pa.array([max(x) for x in found], pa.binary())], names=["a", "b"])

        for b in slices(batches):
            for block, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != at:
                    yield links()
                    rows, at = [], block
                rows.append(tuple(row))
        yield links()

    parts = 8 * parallelism(members.sparkSession)
    return full.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tidy(run), "a binary, b binary").distinct()


def components(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, label of every node of the edges: the smallest node that it is linked to.

    Contraction: each component hooks to its smallest neighbour, chains are
    halved, and edges between different components remain for the next turn.
    ``labels`` holds what earlier edges gave.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    if labels is None:
        labels = nodes.withColumn("label", F.col("node"))
    else:
        labels = labels.union(nodes.join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    labels = keep(labels, "labels")

    def relabel(e: DataFrame, names: DataFrame) -> DataFrame:
        one = e.join(names.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        two = one.join(names.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        return two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    left = keep(relabel(edges, labels), "links")
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
        for _ in range(2):
            up = keep(up, "hooks")
            up = up.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        up = keep(up, "hooks")
        labels = keep(labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        left = keep(relabel(left, up), "links")
    return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """The group of near duplicates of every document.

    Returns one row for each row of ``docs``: doc_id, digest (of the text),
    cluster_id (the smallest doc_id of the group), cluster_size and keep (true
    for one doc_id of the group: the smallest; rows that repeat it with the same
    text are all marked). Groups are components of links: equal texts, and texts
    whose weighted or plain Jaccard similarity over five-word shingles is
    ``threshold`` or more. Words are compared with A-Z in lower case. Texts under five words
    have one shingle; null and empty texts are equal texts, and texts without
    words are linked to equal ones only. A null doc_id sorts first. An empty
    table gives an empty result. Other columns are left out.

    At a weighted similarity of 0.8 a pair shares a bucket with probability
    0.9998. Of the pairs that share one, none between different groups is left
    untested; a pair that is similar by plain sets alone, in a bucket of over a
    thousand texts, is tested if its weights are no two classes apart.
    """
    spark = docs.sparkSession
    table = pick(docs, text=text, doc_id=doc_id)
    n, often, least = document_frequencies(table)
    values = spark.sparkContext.broadcast((max(1, n), often["key"].to_numpy(), often["every"].to_numpy(), least))  # 4 MB
    signed = keep(signatures(table, values), "signatures")
    texts = signed.groupBy("digest").agg(F.first("keys").alias("keys"))
    banded = texts.select("digest", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = keep(banded.join(buckets, ["band", "key"]).select("band", "key", "digest").join(texts, "digest").select("band", "key", "digest", "keys"), "members")
    sets = keep(features(table, members.select("digest").distinct(), values), "shingles")
    labels: DataFrame | None = None
    chosen = members.groupBy("band", "key").agg(F.min("digest").alias("rep"))
    pairs = members.join(chosen, ["band", "key"]).where(F.col("digest") != F.col("rep"))
    pairs = keep(pairs.select(F.col("rep").alias("a"), F.col("digest").alias("b")).distinct(), "pairs")
    if not pairs.isEmpty():
        labels = components(keep(verified(pairs, sets, threshold), "edges"), None)
        more = keep(links_between(members, sets, labels, threshold), "edges")
        if not more.isEmpty():
            labels = components(more, labels)
    # copies first, then the texts of a group in salted shares: a large group is no task's own
    texts = signed.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("d"), F.count(F.lit(1)).alias("n")).select("digest", F.col("d.doc_id").alias("doc_id"), "n")
    if labels is None:
        texts = texts.withColumn("label", F.col("digest"))
    else:
        texts = texts.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    texts = keep(texts, "texts")
    shares = texts.groupBy("label", F.pmod(F.xxhash64("digest"), F.lit(64)).alias("share")).agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.sum("n").alias("n"))
    groups = keep(shares.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("cluster_size")).where("cluster_size > 1"), "groups")
    found = keep(texts.join(groups, "label").select("digest", "first", "cluster_size"), "found")
    out = signed.select("doc_id", "digest").join(found, "digest", "left")
    alone = F.col("cluster_size").isNull()
    return out.select(
        "doc_id",
        "digest",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("cluster_id"),
        F.coalesce("cluster_size", F.lit(1)).cast("long").alias("cluster_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))).alias("keep"),
    )


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates; see ``near_duplicates``.

    Rows that repeat the doc_id and text of the one that stays go too.
    """
    found = finished(docs.sparkSession, lambda: near_duplicates(docs, text, doc_id, threshold), "groups")
    n = numbered(docs)
    i, t = F.col(f"c{find(docs, doc_id)}"), f"c{find(docs, text)}"
    again = found.where("keep").groupBy(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest")).agg(F.count(F.lit(1)).alias("k_n"))
    repeated = not again.where("k_n > 1").isEmpty()
    gone = found.where("not keep").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest")).distinct()
    out = n.withColumn("k", digest_of(t)).join(gone, (F.col("k") == F.col("k_digest")) & i.eqNullSafe(F.col("k_id")), "left_anti")
    if repeated:
        out = out.withColumn("k_id", i).dropDuplicates(["k_id", "k"])
    return out.select(*n.columns).toDF(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, one row for each row of the table.

    Null, empty and equal texts are copies; texts without words have no other
    links; rows that repeat a doc_id are documents of their own; a null doc_id
    sorts first; other columns are left out; an empty table gives no rows.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return finished(spark, lambda: near_duplicates(docs).select("doc_id", "cluster_id", "cluster_size", "keep"), "result")
