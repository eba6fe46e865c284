"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word by the rule that all operators here share: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset and all runs on one machine, as in tests, a temporary one
    takes its place; on a cluster that would lose what executors write, so there
    it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tabulex-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, the path in it)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that is gone is no error."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: lost executors never repeat what stands above, and
    ids that depend on the order of rows are fixed from here on. The table goes
    when the driver's JVM ends, or with ``finished``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulex-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    if kept := getattr(WITHIN, "kept", None):
        kept[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: For each thread, a list of the tables kept within each ``finished`` that it is in, the innermost last.
WITHIN = threading.local()


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``keep(make(), name)``, after which the tables that ``make`` kept on its way are deleted."""
    if not hasattr(WITHIN, "kept"):
        WITHIN.kept = []
    WITHIN.kept.append([])
    try:
        out = make()
    finally:
        mine = WITHIN.kept.pop()  # after an error they stay until the JVM ends
    result = keep(out, name)  # one of the tables of the ``finished`` around this one
    for path in mine:
        forget(spark, path)
    return result


def find(df: DataFrame, name: str) -> int:
    """The position of a column: an exact name first, else one that differs in case only."""
    names = df.columns
    hits = [i for i, x in enumerate(names) if x == name] or [i for i, x in enumerate(names) if x.lower() == name.lower()]
    if not hits:
        raise ValueError(f"no column {name!r} among {names}")
    return hits[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ...: names that clash or repeat no longer matter."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (with ``--py-files`` they can anyway)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, as ``new=old``; others, even with clashing names, are left out."""
    reach(df.sparkSession)
    at = {new: find(df, old) for new, old in names.items()}
    n = numbered(df)
    return n.select(*[n[f"c{i}"].alias(new) for new, i in at.items()])


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


#: Tables up to so many bytes on disk are dealt anew where their files are fewer than the cores.
SMALL_TABLE = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows; those of a small table in few files, which a few tasks would read alone, dealt to all cores."""
    n = parallelism(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * n) if size <= SMALL_TABLE and len(df.inputFiles()) < n else df


#: What operators remember in a worker between tasks; a task of another operator drops it.
CACHES: list[dict] = []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are held in several forms at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run: Callable, own: str | None = None) -> Callable:
    """``run`` for ``mapInArrow``, leaving little behind: workers live on between tasks and stages.

    Caches of other operators go before it starts (``own`` names its own), freed
    memory goes back to the system when it ends.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in CACHES:
            if c["name"] != own:
                c["held"].clear()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
