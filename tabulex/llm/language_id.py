"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three characters of the
lower-cased text, everything but letters read as a space), weighted by their
share of the text times their idf over all training documents. The weights are
learned with follow-the-regularised-leader under an elastic-net penalty, and a
temperature fitted on documents that were not trained on calibrates the scores.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find, numbered, parallelism, pick, slices, spread, tidy

BITS = 16
DIM = 1 << BITS
SEGMENT = 1 << 18  # characters that are read together
CARRY = 2  # characters that a long text's next segment begins with again, for the n-grams across the seam
MAX_LANGUAGES = 200
TOTAL = 10_000  # documents that the weights are fitted on, at most about, whatever the languages
SCALE = 20.0

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


@dataclass
class Segment:
    """Pieces of texts that are read together: the number of each one's text, how many characters it repeats from the piece before, whether it is its text's last."""

    numbers: list[int]
    parts: list[str]
    carried: list[int]
    last: list[bool]


def segments(texts: list[str | None]) -> Iterator[Segment]:
    """Lower-cased texts, about SEGMENT characters together; a longer text is cut, and each of its later pieces begins with the CARRY characters before it."""
    held, size = Segment([], [], [], []), 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for lo in range(0, max(1, len(t)), SEGMENT):
            part = t[max(0, lo - CARRY) : lo + SEGMENT]
            if size + len(part) > SEGMENT and held.parts:
                yield held
                held, size = Segment([], [], [], []), 0
            held.numbers.append(i)
            held.parts.append(part)
            held.carried.append(min(CARRY, lo))
            held.last.append(lo + SEGMENT >= len(t))
            size += len(part) + 2
    if held.parts:
        yield held


def grams(s: Segment) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For n of 1, 2, 3: the features in order, where each part's features begin, and where they end."""
    code = np.frombuffer(("  " + "  ".join(s.parts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    c = np.where(letter, code, 32).astype(np.uint64)
    # a part owns what ends in it, and a text's last one what ends in the two spaces after it; no n-gram has letters of two texts
    at = np.cumsum([2] + [len(p) + 2 for p in s.parts])
    begin = at[:-1] + np.array(s.carried)
    end = at[1:] - 2 + 2 * np.array(s.last)
    h = c * np.uint64(0x9E3779B97F4A7C15)
    one, before, out, begins, ends = h, letter, [], [], []
    for n in range(3):
        if n:
            h = (np.concatenate((np.zeros(1, np.uint64), h[:-1])) * np.uint64(0xD1342543DE82EF95)) ^ one
            before = before | np.concatenate((np.zeros(1, bool), before[:-1]))
        z = h ^ np.uint64(n * 0x632BE59BD9B4E019)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append((z >> np.uint64(64 - BITS))[before].astype(np.uint16))
        run = np.concatenate(([0], np.cumsum(before)))
        begins.append(run[begin])
        ends.append(run[end])
    return out, begins, ends


def document_counts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many each feature is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        seen = np.zeros(DIM, bool)
        for b in slices(batches):
            texts = b.column(0).to_pylist()
            n += len(texts)
            last = -1
            for segment in segments(texts):
                out, begins, ends = grams(segment)
                for k, i in enumerate(segment.numbers):
                    if i != last:
                        total += seen
                        seen[:] = False
                        last = i
                    for f, lo, hi in zip(out, begins, ends, strict=True):
                        seen[f[lo[k] : hi[k]]] = True
            total += seen
            seen[:] = False
        at = [-1, *range(0, DIM, 4096)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([np.array([n]).tobytes(), *(total[i : i + 4096].tobytes() for i in at[1:])], pa.binary())], names=["at", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["at", "part"])

    n = 16 * parallelism(docs.sparkSession)  # tasks of some half a megabyte each
    parts = docs.select("text").coalesce(n).mapInArrow(tidy(count), "at int, part binary")
    merged = {r["at"]: np.frombuffer(r["part"], np.int64) for r in parts.repartition(n, "at").mapInArrow(tidy(add), "at int, part binary").collect()}
    if -1 not in merged:
        return 0, np.zeros(DIM, np.int64)
    return int(merged[-1][0]), np.concatenate([merged[i] for i in range(0, DIM, 4096)])


def counted(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, features, counts) of each document; for a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            sums = [np.zeros(0, np.int64)] * len(texts)
            for segment in segments(texts):
                out, begins, ends = grams(segment)
                for k, i in enumerate(segment.numbers):
                    own = np.concatenate([f[lo[k] : hi[k]] for f, lo, hi in zip(out, begins, ends, strict=True)])
                    more = np.bincount(own, minlength=DIM)
                    sums[i] = more + sums[i] if len(sums[i]) else more
            found = [np.flatnonzero(s) for s in sums]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.uint16).tobytes() for x in found], pa.binary()), pa.array([s[x].astype(np.uint32).tobytes() for s, x in zip(sums, found, strict=True)], pa.binary()), b.column(2)], names=["lang", "f", "n", "h"])

    rows = docs.mapInArrow(tidy(run), "lang string, f binary, n binary, h long").collect()
    # by hash, so that the order of training doesn't depend on partitions
    return [(r["lang"], np.frombuffer(r["f"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.uint32)) for r in sorted(rows, key=lambda r: (r["h"], r["lang"], bytes(r["f"])))]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (DIM, languages), idf and temperature included
    bias: np.ndarray


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3, seed: int = 3) -> Model:
    """FTRL-proximal with an elastic net on four of five rows; the temperature on the fifth."""
    languages = sorted({r[0] for r in rows})
    at = {x: i for i, x in enumerate(languages)}
    data = [(at[lang], f, SCALE * n * idf[f] / max(1, n.sum())) for lang, f, n in rows if len(f)]
    z, n2 = np.zeros((DIM + 1, len(languages))), np.zeros((DIM + 1, len(languages)))

    def current(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        return np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(n2[f])) / alpha + l2))

    held = [d for i, d in enumerate(data) if i % 5 == 4]
    own = [d for i, d in enumerate(data) if i % 5 != 4]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            y, f, x = own[i]
            f, x = np.append(f, DIM), np.append(x, 1.0)
            w = current(f)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g[None, :]
            old = n2[f]
            z[f] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
            n2[f] = old + g * g
    w = current(np.arange(DIM + 1))
    temperature = 1.0
    if held:
        logits = np.array([x @ w[f] + w[DIM] for _, f, x in held])
        truth = np.array([y for y, _, _ in held])

        def loss(t: float) -> float:
            return -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-300)).mean()

        lo, hi = np.log(0.05), np.log(20.0)
        for _ in range(50):
            a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
            lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
        temperature = float(np.exp((lo + hi) / 2))
    return Model(languages, (SCALE * idf[:, None] * w[:DIM] / temperature).astype(np.float32), w[DIM] / temperature)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text; of a null id, that of the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by).cast("int")


def fit(labelled: DataFrame, per_language: int = 1000) -> Model | None:
    """A model from ``lang``, ``text`` (both not null); None without any row.

    idf covers all rows. The weights are fitted on a sample of about
    ``per_language`` different texts of each language, TOTAL in all (the
    documented bounds), chosen by a hash of the text; copies are one text.
    """
    h = F.xxhash64(F.lit(41), "text")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n, df = document_counts(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    each = min(per_language, TOTAL // len(counts))
    part = F.element_at(F.create_map(*[F.lit(x) for lang, k in sorted(counts.items()) for x in (lang, float(min(1.0, each / max(1, k))))]), F.col("lang"))
    chosen = labelled.where(F.pmod(h, F.lit(1 << 30)) < part * (1 << 30)).groupBy("lang", h.alias("h")).agg(F.first("text").alias("text"))
    return train(counted(chosen.select("lang", "text", "h")), idf)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended.

    A null text or one without letters is ``und`` with score 0, and so is every
    text without a model. Whole texts are read. Extra columns stay; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    n = numbered(docs)
    at = find(docs, text)
    known = spark.sparkContext.broadcast(model)  # DIM * MAX_LANGUAGES * 4 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            k = len(m.languages) if m else 1
            sums, total = np.zeros((len(texts), k)), np.zeros(len(texts))
            has_letter = np.zeros(len(texts), bool)
            for segment in segments(texts) if m else ():
                out, begins, ends = grams(segment)
                for order, (f, lo, hi) in enumerate(zip(out, begins, ends, strict=True)):
                    run_sum = np.concatenate((np.zeros((1, k)), np.cumsum(m.weights[f], axis=0, dtype=np.float64)))
                    np.add.at(sums, segment.numbers, run_sum[hi] - run_sum[lo])
                    np.add.at(total, segment.numbers, hi - lo)
                    if not order:
                        np.logical_or.at(has_letter, segment.numbers, hi > lo)
            p = softmax(sums / np.maximum(total, 1)[:, None] + (m.bias if m else 0.0))
            best = p.argmax(axis=1)
            lang = [m.languages[j] if ok else "und" for j, ok in zip(best, has_letter, strict=True)] if m else ["und"] * len(texts)
            score = np.where(has_letter, np.clip(p[np.arange(len(texts)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "score"])

    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in n.schema.fields)
    return n.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double").toDF(*docs.columns, "lang_pred", "score")


def learn(docs: DataFrame, modulus: int = 4, held: int = 2, per_language: int = 1000) -> Model | None:
    """Fit on the documents (``doc_id``, ``text``, ``lang``) that aren't held out and have a text and a language."""
    table = pick(docs, doc_id="doc_id", text="text", lang="lang")
    own = table.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    return fit(own.select("lang", "text"), per_language)


def language_filter(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the documents whose language can't be told: ``und``, or a score under ``least``.

    Where no row has a language and a text there is nothing to learn from, and
    every text with a letter stays. Nulls, empty tables and extra columns are as
    in ``predict``.
    """
    model = learn(docs)
    if model is None:
        n = numbered(docs)
        return n.where(F.col(f"c{find(docs, 'text')}").rlike(r"\p{L}")).toDF(*docs.columns)
    found = predict(docs, model)
    named = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
    width = len(docs.columns)
    kept = named.where((F.col(f"c{width}") != "und") & (F.col(f"c{width + 1}") >= least))
    return kept.select(*[f"c{i}" for i in range(width)]).toDF(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them.

    A null text, or one without a letter, is ``und`` with score 0; a null doc_id
    counts as the empty text for the split; repeated rows have equal results;
    other columns are left out; an empty table gives no rows.
    """
    docs = pick(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), doc_id="doc_id", text="text", lang="lang")
    out = predict(docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), learn(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
