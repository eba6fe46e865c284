"""Mixing, near-dedup, context trees, nearest neighbours, packing and the pipeline: against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulex.llm import context_tree, learned_partitions, mixing, near_dedup, packing, shingles
from tabulex.llm.common import keep

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA).repartition(3)


AWKWARD = [None, "", " ", "a", "a", "x " * 30000, "é" * 10, "A b\x0bc\r\nD", None]


# -- mixing


def test_quotas_reach_the_total_and_no_cap_is_passed():
    sizes = {"a": 10, "b": 1000, "c": 500, None: 5}
    weights = {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}
    t = mixing.quotas(sizes, weights, 1.5 * sum(sizes.values()), 2)
    assert math.isclose(sum(t.values()), 1.5 * sum(sizes.values())) and all(t[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert t["a"] == 20 and t[None] == 10 and math.isclose(t["b"] / t["c"], 2.0, rel_tol=0.2) is (t["c"] < 1000)


def test_flow_is_cheapest_and_fullest():
    r = random.Random(2)
    for _ in range(30):
        patterns = [(r.randrange(1, 4), sorted(r.sample(range(3), r.randrange(1, 4)))) for _ in range(3)]
        caps = [r.randrange(0, 5) for _ in range(3)]
        flow = mixing.min_cost_flow(patterns, caps, 2)
        got = [sum(f) for f in flow]
        for s in range(3):
            assert sum(f[m.index(s)] for f, (_, m) in zip(flow, patterns, strict=True) if s in m) <= caps[s]
        best = None
        for a in range(2 * patterns[0][0] + 1):
            for b in range(2 * patterns[1][0] + 1):
                for c in range(2 * patterns[2][0] + 1):
                    give = (a, b, c)
                    # Hall's condition: every set of patterns fits into its sources
                    if all(sum(give[i] for i in range(3) if k >> i & 1) <= sum(caps[s] for s in {s for i in range(3) if k >> i & 1 for s in patterns[i][1]}) for k in range(8)):
                        key = (-sum(give), sum(max(0, g - w) for g, (w, _) in zip(give, patterns, strict=True)))
                        best = key if best is None or key < best else best
        assert (-sum(got), sum(max(0, g - w) for g, (w, _) in zip(got, patterns, strict=True))) == best


def test_mix(spark):
    r = random.Random(1)
    texts = ["w " * r.randrange(1, 40) for _ in range(900)]
    sources = [r.choice(["a", "b", "c", "d", None]) if r.random() < 0.6 else "hot" for _ in texts]
    docs = table(spark, texts + ["", None], sources=[*sources, "a", "b"]).withColumn("copies", F.lit("mine"))
    out = mixing.mix_sources(docs, F.array("source"), mixing.n_words(F.col("text")))
    assert out.columns == [*docs.columns, "copies", "source_size", "target"]
    rows = [tuple(x) for x in out.collect()]
    taken, target = Counter(), {}
    for x in rows:
        words = len((x[1] or "").split())
        assert x[-3] in (0, 1, 2)
        taken[x[3]] += words * x[-3]
        target[x[3]] = x[-1][0]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2 + 0.002 * t
    again = mixing.mix_sources(docs, F.array("source"), mixing.n_words(F.col("text")))
    assert sorted(map(repr, rows)) == sorted(repr(tuple(x)) for x in again.collect())
    assert mixing.mix_sources(docs.limit(0), F.array("source"), mixing.n_words(F.col("text"))).count() == 0


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"], 10) for i in range(300)], "id long, m array<string>, n long")
    out = mixing.mix_sources(docs, "m", "n", weights={"a": 1.0, "b": 1.0}, total_share=1.0)
    assert abs(out.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] - 3000) <= 10
    assert out.where("copies > 1").count() == 0  # nothing is repeated while there are fresh words


# -- near duplicates


def jaccard(a, b):
    keys = set(a) | set(b)
    whole = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / whole if whole else 0.0


def brute_groups(texts):
    """Components of equal texts and of weighted or plain Jaccard of 0.8 or more."""
    low = [(t or "").encode().lower() for t in texts]
    words = [shingles.word_hashes(t) for t in low]
    n = len(texts)
    df = Counter(x for w in words for x in set(w.tolist()))
    sets = []
    for t, w in zip(low, words, strict=True):
        value = {x: 1 + math.log((n + 1) / (df[x] + 1)) / math.log(n + 2) for x in w.tolist()}
        assert len(WORD.findall(t)) == len(w)
        own = w.tolist()
        grams = [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else []
        count = Counter(grams)
        sets.append({g: (1 + math.log(c)) * np.mean([value[x] for x in g]) for g, c in count.items()})
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or max(jaccard(sets[i], sets[j]), jaccard(dict.fromkeys(sets[i], 1), dict.fromkeys(sets[j], 1))) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(set)
    for i in range(n):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("size", [-1, 0, 1])
def test_a_long_word_has_one_hash(size):
    word = b"q" * (shingles.BLOCK + size)
    alone = shingles.word_hashes(word)
    for text in (word + b" x", b"ab " + word, b"ab " + word + b"\n" + word, b" " + word + b" "):
        got = shingles.word_hashes(text)
        assert got[np.isin(got, alone)].size == text.split().count(word)
        assert [x.tolist() for x in shingles.words_by_text([b"a", text, b"b"])][1] == got.tolist()


def test_words_are_counted_exactly(spark, monkeypatch):
    r = random.Random(14)
    texts = [" ".join(f"w{r.randrange(3000) if r.random() < 0.7 else r.randrange(40)}" for _ in range(50)) for _ in range(120)] + [None, ""]
    df = Counter(w for t in texts for w in set((t or "").split()))
    for most in (1 << 18, 30):
        monkeypatch.setattr(near_dedup, "FREQUENT_WORDS", most)
        n, often, least = near_dedup.document_frequencies(table(spark, texts))
        assert n == len(texts) and len(often) <= most and (least == 1) == (most > 30)
        values = near_dedup.WordValues(n, often["key"].to_numpy(), often["every"].to_numpy(), least)
        for w, k in df.items():
            got = values.of(shingles.word_hashes(w.encode()))[0]
            assert math.isclose(got, 1 + math.log((n + 1) / (max(k, least) + 1)) / math.log(n + 2))
        assert values.of(shingles.word_hashes(b"never"))[0] == values.rest


def test_rare_words_do_not_hide_a_near_copy(spark):
    """Few rare words in a text of common ones weigh much: by weights the copies differ more than by plain sets."""
    r = random.Random(17)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(r.choice(common) for _ in range(200)) for _ in range(60)]
    pairs = []
    for k in range(20):
        words = texts[k].split()
        words[30 + k], words[120 + k] = f"rare{k}", f"odd{k}"
        words += [f"tail{k}x{j}" for j in range(16)]
        texts.append(" ".join(words))
        pairs.append((k, 60 + k))
    cluster = {x["doc_id"]: x["cluster_id"] for x in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert all(cluster[a] == cluster[b] for a, b in pairs) and len({cluster[a] for a, _ in pairs}) == 20


def near_texts(r, n=60):
    texts = []
    for _ in range(n):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(3, 90))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 3, 8])):
                copy[r.randrange(len(copy))] = f"e{r.randrange(999)}"
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates(spark):
    texts = near_texts(random.Random(3)) + AWKWARD
    rows = near_dedup.near_duplicates(table(spark, texts)).collect()
    groups = defaultdict(set)
    for x in rows:
        groups[x["cluster_id"]].add(x["doc_id"])
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts)
    for k, g in groups.items():
        own = [x for x in rows if x["cluster_id"] == k]
        assert k == min(g) and [x["doc_id"] for x in own if x["keep"]] == [k] and {x["cluster_size"] for x in own} == {len(g)}


@pytest.mark.parametrize("cell", [500, 5])
def test_no_pair_of_a_crowded_bucket_is_lost(spark, monkeypatch, cell):
    texts = near_texts(random.Random(12), 80)
    real = near_dedup.signatures

    def crowded(*args):
        return real(*args).withColumn("keys", F.when(F.size("keys") > 0, F.array(*[F.lit(i).cast("long") for i in range(near_dedup.BANDS)])).otherwise(F.col("keys")))

    monkeypatch.setattr(near_dedup, "signatures", crowded)
    monkeypatch.setattr(near_dedup, "CELL", cell, raising=False)
    groups = defaultdict(set)
    for x in near_dedup.near_duplicates(table(spark, texts)).collect():
        groups[x["cluster_id"]].add(x["doc_id"])
    assert {frozenset(g) for g in groups.values()} == brute_groups(texts)


def test_prefixes_lose_no_similar_pair():
    r = np.random.default_rng(5)
    sets = [(np.arange(i * 10, i * 10 + 10, dtype=np.uint64), np.ones(10)) for i in range(12)]
    assert not near_dedup.common_prefixes(sets, 0.8).any()
    for _ in range(20):
        base = np.sort(r.choice(300, 40, replace=False)).astype(np.uint64)
        crowd = [(np.unique(np.r_[base[: r.integers(30, 41)], r.choice(300, r.integers(0, 12)).astype(np.uint64)]), None) for _ in range(20)]
        crowd = [(h, r.uniform(1, 2) + (h % np.uint64(7)).astype(float) / 20) for h, _ in crowd]
        plainly = [(h, np.ones(len(h))) for h, _ in crowd]
        for sets in (crowd, plainly):  # each measure has its own prefixes
            may, weights = near_dedup.common_prefixes(sets, 0.8), [dict(zip(h.tolist(), w.tolist(), strict=True)) for h, w in sets]
            assert all(may[i, j] for i in range(20) for j in range(i) if jaccard(weights[i], weights[j]) >= 0.8)
        either = may | near_dedup.common_prefixes(crowd, 0.8)
        assert all(either[i, j] for i in range(20) for j in range(i) if near_dedup.alike(crowd[i], crowd[j], 0.8))


def test_near_dedup_keeps_one(spark):
    texts = near_texts(random.Random(9), 20)
    docs = table(spark, texts + texts[:5] + ["same"] * 3, ids=[*range(len(texts) + 5), None, None, None]).withColumn("keep", F.lit(1)).withColumn("TEXT2", F.lit("x"))
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    assert out.count() == len(brute_groups(texts + ["same"]))
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_sets_overlap():
    r = np.random.default_rng(5)
    h = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    w = r.uniform(0.5, 3, 60)
    v = w.copy()
    v[:15] *= 0.3
    s = near_dedup.Sampler(4000)
    a, b = s.sample(h[5:], w[5:]), s.sample(h[:50], v[:50])
    x, y = dict(zip(h[5:].tolist(), w[5:], strict=True)), dict(zip(h[:50].tolist(), v[:50], strict=True))
    assert abs((a == b).mean() - jaccard(x, y)) < 0.03


@pytest.mark.parametrize("size", [1, 7, 64])
def test_word_hashes_in_blocks(size, monkeypatch):
    r = random.Random(size)
    text = "".join(r.choice("ab \n\tc") for _ in range(300)).encode() + b" " + b"z" * 90
    whole = shingles.word_hashes(text)
    assert len(whole) == len(WORD.findall(text))
    byword = dict(zip(WORD.findall(text), whole.tolist(), strict=True))
    assert len(set(byword.values())) == len(byword)
    monkeypatch.setattr(shingles, "BLOCK", 64)
    monkeypatch.setattr(shingles, "_POWERS", [])
    small = shingles.word_hashes(text)
    short = [i for i, w in enumerate(WORD.findall(text)) if len(w) < 64]
    assert len(small) == len(whole) and (small[short] == whole[short]).all()
    monkeypatch.setattr(shingles, "_POWERS", [])


# -- context trees


class Tree:
    """Context-tree weighting by its definition, on counts of training bytes."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            for context, node, bit in self.steps(t):
                for d in range(depth + 1):
                    self.n[context[depth - d :], node][bit] += 1
        self.known = {}

    def steps(self, t):
        seq = bytes([255]) * self.depth + t + bytes([255])
        for i in range(self.depth, len(seq)):
            for j in range(8):
                yield seq[i - self.depth : i], (1 << j) | (seq[i] >> (8 - j)), (seq[i] >> (7 - j)) & 1

    def kt(self, a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, context, node):
        if (context, node) in self.known:
            return self.known[context, node]
        a, b = self.n[context, node] if (context, node) in self.n else (0, 0)
        own = self.kt(a, b)
        if len(context) < self.depth and a + b:
            below = sum(self.weighted(bytes([c]) + context, node) for c in range(256) if (bytes([c]) + context, node) in self.n)
            own = np.logaddexp(own, below) - math.log(2)
        self.known[context, node] = own
        return own

    def chance(self, context, node, bit, d=0):
        s = context[self.depth - d :]
        a, b = self.n[s, node] if (s, node) in self.n else (0, 0)
        kt = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return kt
        stop = math.exp(self.kt(a, b) - math.log(2) - self.weighted(s, node)) if a + b else 0.5
        return stop * kt + (1 - stop) * self.chance(context, node, bit, d + 1)

    def score(self, t):
        return sum(math.log10(self.chance(c, n, b)) for c, n, b in self.steps(t))


@pytest.mark.parametrize(("rare", "share", "depth"), [(False, 512, 3), (True, 1 << 40, 3), (False, 12, 4), (False, 1 << 40, 4)])
def test_context_tree(spark, rare, share, depth, monkeypatch):
    """``share``: the usual one, all contexts split, and a mixture."""
    monkeypatch.setattr(context_tree, "SHARE", share)
    if rare:  # nothing is broadcast: all goes by the joins
        monkeypatch.setattr(context_tree, "FREQUENT_GRAMS", 3)
        monkeypatch.setattr(context_tree, "FREQUENT_WORDS", 1)
    r = random.Random(7)
    texts = [" ".join(r.choice(["ab", "abc", "B", "dé", "x1"]) for _ in range(r.randrange(0, 12))) for _ in range(40)] + [None, "", "Zz", "ab\n\tab"]
    ids = list(range(len(texts) - 1)) + [None]
    train = [(t or "").encode().lower() for i, t in zip(ids, texts, strict=True) if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    tree = Tree(train, depth)
    words = Counter(w for t in train for w in WORD.findall(t))
    n, v = sum(words.values()) + len(train), len(words) + 1
    rows = context_tree.score(table(spark, texts, ids).withColumn("Score", F.lit("mine")), depth=depth).collect()
    assert len(rows) == len(texts)
    by_id = {x["doc_id"]: x for x in rows}
    for i, t in zip(ids, texts, strict=True):
        low, x = (t or "").encode().lower(), by_id[i]
        w = WORD.findall(low)
        base = sum(math.log10((words[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(w) + 1, sum(words[k] > 0 for k in w) + 1, n)
        assert math.isclose(x["base_score"], base, rel_tol=1e-9)
        assert math.isclose(x["score"], tree.score(low), rel_tol=1e-7), t


def test_split_contexts_hold_most_grams(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "SHARE", 4)
    keys = [(1 << 24) | (2 << 16) | (c << 8) | b for c in range(40) for b in range(5)] + [(3 << 24) | (c << 16) for c in range(60)]
    grams = spark.createDataFrame([(k, 1, 1) for k in keys], "key long, train long, every long")
    split = context_tree.split_contexts(grams, 3)
    assert [x.tolist() for x in split] == [[(1 << 8) | 2]]
    assert context_tree.own_depths(np.array(keys), split, 3).tolist() == [3] * 200 + [2] * 60


def test_context_tree_is_a_distribution():
    tree = Tree([b"abab", b"ba"], 2)
    for context in (b"\xff\xff", b"ab", b"zz"):
        total = 0.0
        for byte in range(256):
            p = 1.0
            for j in range(8):
                p *= tree.chance(context, (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1)
            total += p
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_context_tree_awkward(spark):
    assert context_tree.score(table(spark, [])).count() == 0
    same = context_tree.score(table(spark, ["a b"] * 5 + ["x " * 40000], ids=[0] * 6))
    assert same.count() == 6 and same.select("score").distinct().count() == 2
    x = np.array([0.5, 1.0, 7.3, 1e3, 1e7])
    assert np.allclose(context_tree.log_gamma(x), [math.lgamma(y) for y in x], rtol=1e-12)


# -- nearest neighbours


def nearest(vectors, queries, k):
    out = {}
    for q in queries:
        v = vectors[q]
        scored = sorted(((-float(sum(np.float64(a) * np.float64(b) for a, b in zip(v, w, strict=True))), i) for i, w in vectors.items() if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_search_is_exact_on_a_small_table(spark):
    r = np.random.default_rng(2)
    vectors = {i: r.normal(size=6).astype(np.float32) for i in range(180)}
    for i in range(40, 90):
        vectors[i] = vectors[40]
    bad = [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] + [1.0] * 5), (1003, [1.0, None] + [1.0] * 4), (1004, [float("inf")] * 6), (None, [1.0] * 6), (1005, [1.0] * 5)]
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()] + [(7, [float(x) for x in vectors[7]])] + bad
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("mine")).repartition(3)
    got = learned_partitions.search(df, lambda i: i % 20 == 0, k=20).collect()
    want = nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    own = defaultdict(list)
    for x in sorted(got, key=lambda x: x["rank"]):
        own[x["query_id"]].append(x["vec_id"])
    assert dict(own) == want
    assert learned_partitions.search(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = learned_partitions.search(df.where("vec_id < 4"), lambda i: i % 2 == 0, k=20)
    assert few.count() == 6


def clustered(r, n, centres=12, spread=0.4):
    c = r.normal(size=(centres, 16))
    return {i: (c[i % centres] + spread * r.normal(size=16)).astype(np.float32) for i in range(n)}


@pytest.mark.parametrize("n", [500, 3000])
def test_search_by_parts_recalls(spark, n):
    """Several parts even at 500 vectors; where the vectors have structure few of them are visited and recall holds."""
    vectors = clustered(np.random.default_rng(4), n)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got, report = defaultdict(set), {}
    for x in learned_partitions.search(df, lambda i: i % 20 == 0, k=10, report=report).collect():
        got[x["query_id"]].add(x["vec_id"])
    want = nearest(vectors, [i for i in vectors if i % 20 == 0], 10)
    assert np.mean([len(got[q] & set(w)) / 10 for q, w in want.items()]) >= 0.9
    assert report["parts"] >= 8 and report["visits"] <= report["parts"] / 2 and report["recall"] >= 0.95


def test_blocks_of_parts(spark, monkeypatch):
    """Parts searched in many blocks, all of them visited: brute force's result."""
    monkeypatch.setattr(learned_partitions, "BLOCK", 20)
    vectors = clustered(np.random.default_rng(5), 300)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in sorted(learned_partitions.search(df, lambda i: i % 20 == 0, k=10, probes=10**6).collect(), key=lambda x: x["rank"]):
        got[x["query_id"]].append(x["vec_id"])
    assert dict(got) == nearest(vectors, [i for i in vectors if i % 20 == 0], 10)


def test_few_parts_still_hold_enough(spark):
    """k others are found even where the visited parts alone would hold fewer."""
    vectors = clustered(np.random.default_rng(6), 260, centres=3, spread=0.05)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = learned_partitions.search(df, lambda i: i % 20 == 0, k=120, probes=1).groupBy("query_id").count().collect()
    assert len(got) == 13 and {r["count"] for r in got} == {120}


def test_parts_are_balanced():
    r = np.random.default_rng(1)
    x = r.normal(size=(512, 8))
    part = learned_partitions.balanced_parts(x, learned_partitions.neighbour_graph(x), 8)
    assert np.bincount(part).tolist() == [64] * 8


# -- packing


@pytest.mark.parametrize("small", [True, False])
def test_packing_round_trip(spark, small, monkeypatch):
    from tokenizers import Tokenizer

    if not small:
        monkeypatch.setattr(packing, "SMALL_IDS", 100)

    r = random.Random(12)
    texts = [" ".join(r.choice(["hello", "World,", "don't", "naïve", "42", "a.b", "…", "ＡＢＣ", "x" * 70]) for _ in range(r.choice([0, 1, 5, 300, 3000]))) for _ in range(60)] + AWKWARD + ["<|endoftext|> İΣΑΣ it's 's y"]
    docs = table(spark, texts).withColumn("sequence_id", F.lit("mine"))
    out = packing.pack(docs, TOKENIZER, with_ids=True)
    assert out.schema["ids"].dataType.simpleString() == "array<int>"
    rows = out.collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    parts, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        parts[x["doc_id"]].append(x)
        sequences[x["sequence_id"]].append(x)
        assert x["length"] == len(x["ids"]) and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
    for i, t in enumerate(texts):
        own = sorted(parts[i], key=lambda x: x["start"])
        ids = [y for x in own for y in x["ids"]]
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x["start"] for x in own] == list(np.cumsum([0] + [x["length"] for x in own[:-1]])) and {x["doc_tokens"] for x in own} == {len(ids)}
    used = 0
    for s in sequences.values():
        s.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in s] == list(np.cumsum([0] + [x["length"] for x in s[:-1]]))
        used += sum(x["length"] for x in s)
        assert sum(x["length"] for x in s) <= 2048
    assert used / (2048 * len(sequences)) > 0.9


def test_special_tokens_keep_their_case(spark):
    """The tokenizer knows its special tokens in lower case only, before it lowers a text."""
    from tokenizers import Tokenizer

    r = random.Random(5)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "word", "Word,", ".", " ", "\n", "É", "x<|endoftext|>Y"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(300)] + ["a long Text <|EndOfText|> " * 20000]
    tokenizer, own = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    for lo in (0, 0, 150):  # known chunks too
        for t, ids in zip(texts[lo:], own.encode(texts[lo:]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:80]


def test_chunks_are_forgotten_and_found_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    tokenizer, own = Tokenizer.from_file(TOKENIZER), packing.WordIds(TOKENIZER)
    for turn in range(40):
        texts = [" ".join(f"w{(turn // k) % 9}a. B{k} " + "z" * 90 for k in range(1, 6))]
        assert np.frombuffer(own.encode(texts)[0], "<u4").tolist() == tokenizer.encode(texts[0], add_special_tokens=False).ids
        assert len(own.known) < 60


def test_packing_awkward(spark):
    assert packing.pack(table(spark, []), TOKENIZER).count() == 0
    out = packing.pack(table(spark, ["same"] * 9, ids=[None] * 9), TOKENIZER).collect()
    assert len(out) == 9 and {x["doc_id"] for x in out} == {None} and len({x["sequence_id"] for x in out}) == 1


def test_cuts_are_harmonic():
    for rest in range(2048):
        pieces = packing.cut(rest, 2048)
        assert sum(n for n, _ in pieces) == rest
        assert all(2048 // (k + 1) < n <= 2048 // k for n, k in pieces)


# -- the pipeline


def test_pipeline(spark):
    r = random.Random(15)

    def prose(kind, n):
        return "\n".join(" ".join(r.choice(kind) + r.choice(["a", "e", "o"]) for _ in range(r.randrange(6, 15))) for _ in range(n))

    first, second = [f"wor{c}" for c in "bcdfghjklmnpqrst"], [f"ßü{c}" for c in "bcdfghjklmnpqrst"]
    texts = [prose(first if i % 2 else second, r.randrange(2, 8)) for i in range(80)]
    texts[40] = texts[3] + " extra"
    texts[41] = texts[5]
    rows = [(i, t, "aa" if i % 2 else "bb", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(500 + i, t, None, None, None) for i, t in enumerate([None, "", "123", "x " * 3000])]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, "unused"), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == names
    ids = {n: {x["doc_id"] for x in d.select("doc_id").collect()} for n, d in kept.items()}
    assert {500, 501, 502}.isdisjoint(ids["language_id"]) and set(range(80)) <= ids["language_id"]
    assert len(ids["near_dedup"] & {3, 40}) == 1 and len(ids["near_dedup"] & {5, 41}) == 1
    assert kept["mixing"].groupBy("doc_id").count().where("count > 2").count() == 0
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    empty = kept["language_id"].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "unused").count() == 0
