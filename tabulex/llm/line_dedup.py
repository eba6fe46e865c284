"""Line deduplication with two Bloom filters.

Each worker keeps a filter of hashes seen once and one of hashes seen twice.
Merged, the second filter passes every line that two documents share (a pair of
workers that each saw a line once shows in the AND of their first filters) and
few others. Only those suspects shuffle, as 128-bit keys, for exact counts and
the first occurrence; lines seen once never leave their worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, find, keep, numbered, parallelism, pick, slices, spread, tidy

CHUNK = 8192  # bytes of a filter that travel together
HASHES = 3


class Filters:
    """A pair of Bloom filters over 64-bit hashes; ``bits`` is a power of two."""

    def __init__(self, bits: int, once: bytes | None = None):
        self.bits = bits
        self.once = np.frombuffer(once, np.uint8) if once is not None else np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8 if once is None else 0, np.uint8)

    def places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            at = (h + np.uint64(i) * step) & np.uint64(self.bits - 1)
            yield at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def has(self, which: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for byte, bit in self.places(h):
            out &= (which[byte] & bit) != 0
        return out

    def put(self, which: np.ndarray, h: np.ndarray) -> None:
        for byte, bit in self.places(h):
            np.bitwise_or.at(which, byte, bit)

    def see(self, h: np.ndarray) -> None:
        """Hashes of lines, one for each document that has the line."""
        h, n = np.unique(h, return_counts=True)
        again = self.has(self.once, h)
        self.put(self.twice, h[again | (n > 1)])
        self.put(self.once, h[~again])


def keys_of(text: bytes | None) -> list[bytes]:
    """Each line's key: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip(SPACES) for x in (text or b"").lower().split(b"\n")]


def bytes_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def hashes_of(texts: list[bytes | None]) -> np.ndarray:
    """64-bit hashes of each document's different non-empty keys."""
    h64 = xxhash.xxh3_64_intdigest
    return np.fromiter((h64(k) for t in texts for k in set(keys_of(t)) if k), np.uint64)


def twice_seen(docs: DataFrame, bits: int) -> bytes:
    """The merged filter of hashes that at least two documents have."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(bits)
        for b in slices(batches):
            f.see(hashes_of(bytes_of(b.column(0))))
        at = np.flatnonzero(f.once.reshape(-1, CHUNK).any(axis=1))
        for lo in range(0, len(at), 64):
            part = at[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array([x[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in part], pa.binary()) for x in (f.once, f.twice))], names=["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for c, once, twice in zip(*(x.to_pylist() for x in b.columns), strict=True):
                o, t = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                if c in held:
                    have = held[c]
                    have[1] = have[1] | t | (have[0] & o)
                    have[0] = have[0] | o
                else:
                    held[c] = [o, t]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x[1].tobytes() for x in held.values()], pa.binary())], names=["chunk", "twice"])

    spark = docs.sparkSession
    n = parallelism(spark)
    parts = docs.select("text").coalesce(2 * n).mapInArrow(tidy(build), "chunk int, once binary, twice binary")
    merged = parts.repartition(min(2 * n, bits // 8 // CHUNK), "chunk").mapInArrow(tidy(merge), "chunk int, twice binary")
    out = bytearray(bits // 8)
    for r in merged.collect():  # bits / 8 bytes at most
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = r["twice"]
    return bytes(out)


def line_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id", min_docs: int = 2, keep_first: bool = True, bits_per_line: int = 8, max_filter_bytes: int = 64 << 20, broadcast_keys: int = 400_000) -> DataFrame:
    """Drop lines whose key is in at least ``min_docs`` (two or more) documents.

    Returns the rows and columns of ``docs``, ``text`` rewritten, with ``n_lines``
    and ``n_dropped`` appended. With ``keep_first`` a repeated key keeps its first
    line in the document first by ``order`` (rows that tie there by value all
    keep it); otherwise every such line goes. A row is a document, so repeated
    rows count each; null and empty texts are one empty line, and empty keys
    never go; a null text comes back empty. An empty table gives an empty result.

    The filters have ``bits_per_line`` bits a line, up to ``max_filter_bytes``;
    beyond that more lines are suspected, and the result is the same. Keys to
    drop are broadcast up to ``broadcast_keys`` of them; beyond that each text's
    suspects join them by a shuffle.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more: the filters tell lines seen twice")
    spark = docs.sparkSession
    at, order_at = find(docs, text), find(docs, order)
    table = pick(docs, text=text, order=order)
    lines = table.agg(F.sum(F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))), F.lit(0)) + 1)).first()[0] or 1
    bits = 1 << max(CHUNK.bit_length() + 2, min((lines * bits_per_line - 1).bit_length(), (8 * max_filter_bytes).bit_length() - 1))
    twice = spark.sparkContext.broadcast(twice_seen(table, bits))
    suspects = suspected(table, bits, twice, keep_first)
    counted = suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *([F.min(F.struct("order", "digest")).alias("first")] if keep_first else []))
    repeated = keep(counted.where(F.col("n") >= min_docs).drop("n"), "lines")
    first = "string" if not keep_first else "struct<order: %s, digest: binary>" % table.schema["order"].dataType.simpleString()
    named = numbered(docs)
    width = len(docs.columns)
    if repeated.limit(broadcast_keys + 1).count() <= broadcast_keys:
        table_of = {r["key"]: ((r["first"]["order"], bytes(r["first"]["digest"])) if keep_first else None) for r in repeated.toLocalIterator()}
        drop = spark.sparkContext.broadcast({bytes(k): v for k, v in table_of.items()})
        out = rewritten(named, at, order_at, drop, None)
    else:
        drops = suspects.join(repeated, "key").groupBy("digest").agg(F.collect_set(F.struct("key", *([F.col("first")] if keep_first else [F.lit(None).cast(first).alias("first")]))).alias("drops"))
        digest = F.unhex(F.md5(F.coalesce(F.col(f"c{at}"), F.lit("")).cast("binary")))
        out = rewritten(named.withColumn("digest", digest).join(drops, "digest", "left").select(*named.columns, "drops"), at, order_at, None, width)
    return out.toDF(*docs.columns, "n_lines", "n_dropped")


def suspected(table: DataFrame, bits: int, twice: Broadcast, with_order: bool) -> DataFrame:
    """The 128-bit keys of each document that pass the twice-seen filter, with the document's digest (and order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(bits, twice.value)
        for b in slices(batches):
            texts = bytes_of(b.column(0))
            own = [[k for k in set(keys_of(t)) if k] for t in texts]
            flat = [k for ks in own for k in ks]
            doc = np.repeat(np.arange(len(own)), [len(ks) for ks in own])
            at = np.flatnonzero(f.has(f.once, np.fromiter((xxhash.xxh3_64_intdigest(k) for k in flat), np.uint64, len(flat))))
            rows = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(flat[i]) for i in at], pa.binary()), *(b.column(j).take(rows) for j in range(1, b.num_columns))], names=["key", *b.schema.names[1:]])

    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest")
    given = table.select("text", digest, *(["order"] if with_order else []))
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in given.schema.fields[1:])
    return given.mapInArrow(tidy(run), f"key binary, {kinds}")


def rewritten(df: DataFrame, at: int, order_at: int, drop: Broadcast | None, drops_at: int | None) -> DataFrame:
    """Texts without the lines to drop; what to drop is in ``drop`` for all rows or in each row's last column."""
    from hashlib import md5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest_of = xxhash.xxh3_128_digest
        for b in slices(batches):
            texts, orders = bytes_of(b.column(at)), b.column(order_at).to_pylist()
            each = b.column(drops_at).to_pylist() if drops_at is not None else None
            out, lines, dropped = [], [], []
            for i, t in enumerate(texts):
                t = t or b""
                if each is None:
                    gone = drop.value
                else:
                    gone = {x["key"]: x["first"] and (x["first"]["order"], x["first"]["digest"]) for x in each[i] or ()}
                keys, parts = keys_of(t), t.split(b"\n")
                seen: set[bytes] = set()
                kept, me = [], None
                for k, line in zip(keys, parts, strict=True):
                    if k:
                        d = digest_of(k)
                        if d in gone:
                            if (first := gone[d]) is None or d in seen:
                                continue
                            if me is None:
                                me = (orders[i], md5(t).digest())
                            if first != me:
                                continue
                            seen.add(d)
                    kept.append(line)
                out.append(b"\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            columns = list(b.columns[: drops_at if drops_at is not None else b.num_columns])
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            names = b.schema.names[: len(columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    width = drops_at if drops_at is not None else len(df.columns)
    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in df.schema.fields[:width])
    return df.mapInArrow(tidy(run), f"{kinds}, n_lines long, n_dropped long")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least 10 of them have.

    A document is a row: rows that repeat a doc_id count each, and keep a row
    each. A null or empty text is one empty line; empty keys never go; a null
    doc_id stays null; other columns are left out; an empty table gives no rows.
    """
    docs = pick(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), doc_id="doc_id", text="text")
    out = line_dedup(docs, min_docs=10, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs)),
gone AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(g.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.k = g.k GROUP BY r, doc_id
"""
