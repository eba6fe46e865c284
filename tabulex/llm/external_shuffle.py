"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records into memory-sized buckets by a seeded hash of their
contents. Pass two shuffles each bucket by Fisher-Yates (Spark's ``shuffle``
function, seeded) and writes it. A record's place in the whole permutation is
its bucket's offset plus its place there; places are dealt round-robin to the
shards, so that shard sizes differ by one row at most (law ``rows``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import find, finished, keep, numbered, pick, spread


def record_bytes(df: DataFrame):
    """About the bytes of a record: strings and binaries by length, 8 for other plain columns, 64 for nested ones."""
    size = F.lit(16).cast("long")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        else:
            size = size + F.lit(64 if isinstance(field.dataType, (T.ArrayType, T.StructType)) else 8)
    return size


def bucket_size(spark: SparkSession) -> int:
    """Bytes of a bucket that a task's memory holds many times over: a 28th of an executor's share for a core, from 32 MB to 1 GB."""
    text = spark.conf.get("spark.executor.memory", "1g").strip().lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    memory = int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
    cores = int(spark.conf.get("spark.executor.cores", "2"))
    return min(max(memory // cores // 28, 32 << 20), 1 << 30)


def external_shuffle(df: DataFrame, shards: int = 8, bytes_column: str | None = None, seed: int = 17, bucket_bytes: int | None = None, min_buckets: int = 16) -> DataFrame:
    """Deal all rows of ``df`` to ``shards`` shards in a seeded random order.

    Returns the columns of ``df`` with ``shard`` int and ``slot`` long appended;
    columns of ``df`` that have these names are kept before them. Slots of a
    shard run from 0 without gaps, and shards differ by one row at most. The
    permutation depends on the rows' contents, the seed and the bucket count,
    not on their order or partitions; equal rows are interchangeable.

    ``bytes_column`` holds the size of a record (without it, ``record_bytes``);
    there are as many buckets as keep a bucket near ``bucket_bytes`` (by default
    what ``bucket_size`` finds for the executors), and ``min_buckets`` at least. A bucket is one array of a task for a while, so it
    must fit a task's memory several times. Equal rows that would fill an eighth
    of a bucket or more are dealt one by one to all buckets. Null columns hash
    like any value. An empty table gives an empty result. Columns must be
    orderable (no maps).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    bucket_bytes = bucket_bytes or bucket_size(df.sparkSession)
    names = df.columns
    n = numbered(df)
    size = F.coalesce(F.col(f"c{find(df, bytes_column)}"), F.lit(0)) if bytes_column else record_bytes(n)
    payload = [F.col(f"c{i}") for i in range(len(names))]
    h = F.xxhash64(F.lit(seed), *payload)
    total = n.agg(F.sum(size)).first()[0] or 0
    buckets = max(min_buckets, math.ceil(total / bucket_bytes))
    record = F.struct(h.alias("h"), F.struct(*payload).alias("row")).alias("r")
    scattered = n.select(F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), record)
    # fewer than 8 * total / bucket_bytes hashes: small enough to broadcast
    heavy = keep(n.select(h.alias("heavy"), size.alias("b")).groupBy("heavy").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("b") >= bucket_bytes / 8)).select("heavy"), "heavy")
    if not heavy.isEmpty():
        heavy = F.broadcast(heavy)
        rest = scattered.join(heavy, F.col("r.h") == F.col("heavy"), "left_anti")
        copies = scattered.join(heavy, F.col("r.h") == F.col("heavy"), "left_semi").groupBy("r").agg(F.count(F.lit(1)).alias("n"))
        some = F.lit(10000).cast("long")  # so many at a time: no long array
        tens = copies.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / some))))
        each = tens.withColumn("k", F.explode(F.sequence(F.col("j") * some + 1, F.least((F.col("j") + 1) * some, "n"))))
        scattered = rest.unionByName(each.select(F.pmod(F.xxhash64(F.lit(seed), "r.h", "k"), F.lit(buckets)).cast("int").alias("bucket"), "r"))
    # one bucket to a partition, numbered alike: the seed of Fisher-Yates then depends on the bucket alone
    filled = scattered.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    shuffled = filled.select("bucket", F.shuffle("rows", seed).alias("rows"))
    # rows again before they are written: no file holds a bucket as one value
    flat = shuffled.select("bucket", F.posexplode("rows").alias("pos", "r")).select("bucket", "pos", *[F.col(f"r.row.c{i}").alias(f"c{i}") for i in range(len(names))])
    written = keep(flat, "buckets")
    starts, at = [], 0
    for bucket, count in sorted(written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((bucket, at))
        at += count
    schema = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("start", T.LongType())])
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, schema))  # one row of 12 bytes a bucket: a megabyte for 3 TB
    place = F.col("start") + F.col("pos")
    dealt = written.join(offsets, F.col("bucket") == F.col("b"))
    out = dealt.select(*[F.col(f"c{i}") for i in range(len(names))], (place % shards).cast("int").alias("s"), F.floor(place / shards).cast("long").alias("t"))
    return out.toDF(*names, "shard", "slot")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shuffle ``df`` and write it as ``path/shard=k/`` Parquet, rows of each file in slot order."""
    dealt = external_shuffle(df, **options)
    dealt.repartition(options.get("shards", 8), "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 8 shards under the law ``rows``, a row for each row of the table.

    A null text has no bytes and the checksum 0, like an empty one; rows that
    repeat take a slot each; a null doc_id stays null; other columns are left
    out; an empty table gives no rows.
    """
    docs = pick(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), doc_id="doc_id", text="text")
    digest = (
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return finished(spark, lambda: external_shuffle(docs, shards=8).select(*digest), "result")
