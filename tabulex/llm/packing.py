"""Harmonic packing of tokenized documents into fixed-length sequences.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity/(k+1), capacity/k], and every bin of class k takes exactly k pieces.
Workers number their pieces of a class independently; adding the counts of the
workers before them turns these numbers into bins, so no piece ever waits for
another and only the last bin of a class can be short. Documents may be cut:
a remainder that would waste much of its class's room gives up a piece of the
next class's full length first.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHES, finished, keep, pick, slices, spread, tidy

#: Words after which a worker starts a new memory of ids (it keeps the last one beside it), and the longest such word.
CACHE_WORDS, CACHE_CHARS = 340_000, 64
MARKS = frozenset(".,;:!?")
#: Code points beyond these have letters that compose with others or whose lower case depends on what follows.
BEYOND = re.compile("[^\\0-\u012f]")
#: A remainder is cut only while whole pieces of its length would waste more than this share of a sequence.
WASTE, SMALL = 0.015, 128
#: Offsets of (worker, class) are broadcast up to so many rows, else joined by a shuffle.
BROADCAST_ROWS = 500_000


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer normalises white space away and never joins characters across
    it, so a text's ids are those of its chunks between spaces and line ends.
    Chunks repeat, so their ids are remembered; memory stays bounded. A chunk of
    Latin letters is one word whose last token alone has the end-of-word mark:
    new ones are encoded together, in lower case and without normalisation or a
    memory of the model's own, and told apart by that mark. A mark of
    punctuation after letters is a word of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.letters = Tokenizer(models.BPE(vocab=model["vocab"], merges=pairs, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for w, i in model["vocab"].items() if w.endswith(model["end_of_word_suffix"])]] = True

    def learn(self, new: set[str]) -> list[str]:
        """Add chunks to the known ones; returns those too long to be remembered."""
        known, marked, hard, cores = self.known, [], [], set()
        for w in new:
            core, mark = w, ""
            if not w.isalpha():
                core, mark = w[:-1], w[-1]
                if mark not in MARKS or not core.isalpha():
                    hard.append(w)
                    continue
            if not core.isascii() and BEYOND.search(core):
                hard.append(w)
                continue
            core = core.lower()
            if core not in known:
                cores.add(core)
            if mark or core != w:
                marked.append((w, core, mark))
                if mark not in known:
                    hard.append(mark)
        if cores:
            together = list(cores)
            ids = np.array(self.letters.encode_batch_fast([" ".join(together)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(together):
                raw, at = ids.tobytes(), 0
                for w, end in zip(together, (4 * ends).tolist(), strict=True):
                    known[w] = raw[at:end]
                    at = end
            else:
                hard += together
        if hard:
            for w, e in zip(hard, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w, core, mark in marked:
            known[w] = known[core] + known[mark]
        return [w for w in (*new, *cores) if len(w) > CACHE_CHARS]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {"": b""}, self.known
        known, old = self.known, self.old
        # lower case makes fewer different chunks; special tokens are matched before it, so their look-alikes stay as they are
        chunked = [(t if BEYOND.search(t) or "<|" in t else t.lower()).replace("\n", " ").split(" ") for t in texts]
        new = set().union(*chunked).difference(known)
        if old and new:
            again = [w for w in new if w in old]
            known.update(zip(again, map(old.__getitem__, again), strict=True))
            new.difference_update(again)
        long = self.learn(new) if new else []
        out = [b"".join(map(known.__getitem__, c)) for c in chunked]
        for w in long:
            known.pop(w, None)
        return out

    def forget(self) -> None:
        """Give the memory of chunks back; a new one fills fast."""
        self.known, self.old = {"": b""}, {}


_TOKENIZERS: dict[str, WordIds] = {}
CACHES.append({"name": "packing", "held": _TOKENIZERS})


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


@lru_cache(maxsize=None)
def cut(rest: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """(length, class) of each piece of a remainder shorter than the capacity."""
    pieces = []
    while rest:
        k = capacity // rest
        if rest < SMALL or capacity - k * rest <= WASTE * capacity:
            pieces.append((rest, k))
            break
        part = capacity // (k + 1)
        pieces.append((part, k + 1))
        rest -= part
    return tuple(pieces)


#: A vocabulary of up to so many ids travels as 16-bit numbers, less this offset.
SMALL_IDS, OFFSET = 1 << 16, 1 << 15
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker int, at long"


def has_small_ids(tokenizer: str, end_id: int) -> bool:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= SMALL_IDS


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, small: bool = False, batch: int = 64) -> DataFrame:
    """Tokenize and cut; each piece gets its class and its number ``at`` among this worker's pieces of the class.

    Ids are 16-bit numbers less OFFSET if they are ``small``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, worker = word_ids(tokenizer).encode, TaskContext.get().partitionId()
        counts: dict[int, int] = {}
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in slices(batches):
            doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows: list[tuple] = []
            parts: list[bytes] = []
            for lo in range(0, len(texts), batch):
                for doc, ids in zip(doc_ids[lo : lo + batch], ids_of([t or "" for t in texts[lo : lo + batch]]), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length, k in ((capacity, 1),) * (n // capacity) + cut(n % capacity, capacity):
                        part = ids[4 * start : 4 * (start + length)]
                        at = counts.get(k, 0)
                        counts[k] = at + 1
                        rows.append((doc, start, length, zlib.crc32(part), n, k, worker, at))
                        if with_ids:
                            parts.append(part)
                        start += length
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
            arrays = [pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in parts)])
                flat = np.frombuffer(b"".join(parts), "<i4")
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((flat - OFFSET).astype(np.int16) if small else flat)))
            yield pa.RecordBatch.from_arrays(arrays, names=[x.strip().split()[0] for x in PIECES.split(",")] + ["ids"] * with_ids)
        word_ids(tokenizer).forget()  # idle workers hold it beside the next stage's

    return pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, "packing"), PIECES + f", ids array<{'smallint' if small else 'int'}>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack all documents (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, class,
    sequence_id, offset and, if asked for, ids. A null text is empty and yields
    its end id alone; texts of any length are cut; repeated rows are packed
    each; an empty table gives an empty result; other columns are left out.
    A null doc_id stays null.
    """
    spark = docs.sparkSession
    narrow = with_ids and has_small_ids(tokenizer, end_id)
    cut_up = keep(pieces(docs, tokenizer, capacity, end_id, with_ids, narrow), "pieces")
    counts = cut_up.groupBy("worker", "class").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep(counts.select(F.col("worker").alias("w"), F.col("class").alias("k"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    small = offsets.count() <= BROADCAST_ROWS
    # one row a class, of which there are at most 2 * sqrt(capacity)
    totals = {r["k"]: r["n"] for r in offsets.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    first, full = {}, 0
    for k, n in sorted(totals.items()):
        first[k] = full
        full += n // k
    joined = cut_up.join(F.broadcast(offsets) if small else offsets, (F.col("worker") == F.col("w")) & (F.col("class") == F.col("k")))
    table = F.create_map(*[F.lit(x) for k in sorted(totals) for x in (k, first[k])]) if totals else F.create_map(F.lit(0), F.lit(0))
    size = F.create_map(*[F.lit(x) for k in sorted(totals) for x in (k, totals[k] // k * k)]) if totals else F.create_map(F.lit(0), F.lit(0))
    number = F.col("before") + F.col("at")
    placed = joined.select(*cut_up.drop("worker", "at").columns, number.alias("number"), (number >= F.element_at(size, F.col("class"))).alias("left"))
    # the short last bins of the classes go together as far as they fit
    short = {r["class"]: r["t"] for r in placed.where("left").groupBy("class").agg(F.sum("length").alias("t")).collect()}
    bins: list[int] = []
    where = {}
    for k, t in sorted(short.items(), key=lambda x: (-x[1], x[0])):
        b = next((i for i, used in enumerate(bins) if used + t <= capacity), len(bins))
        bins += [0] * (b == len(bins))
        bins[b] += t
        where[k] = full + b
    rest = F.create_map(*[F.lit(x) for k in sorted(where) for x in (k, where[k])]) if where else F.create_map(F.lit(0), F.lit(0))
    k = F.col("class")
    sequence = F.when(F.col("left"), F.element_at(rest, k)).otherwise(F.element_at(table, k) + F.floor(F.col("number") / k)).cast("long")
    inside = Window.partitionBy("sequence_id").orderBy("class", "number").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("sequence_id", sequence).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("number", "left")
    return out.withColumn("ids", F.transform("ids", lambda x: x.cast("int") + OFFSET)) if narrow else out


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences of 2048, a row for each piece.

    A null or empty text is its end id alone; rows that repeat are packed each;
    a null doc_id stays null; other columns are left out; an empty table gives no
    rows.
    """
    import public_tokenizers

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class")
    return finished(spark, lambda: pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(*columns), "result")
