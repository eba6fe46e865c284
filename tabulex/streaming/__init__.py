"""Documents over Structured Streaming: the same stateless projection as in batch."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def score_stream(engine: Engine, stream: DataFrame, key: str, **options) -> DataFrame:
    """A stream with a document's results."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return engine.apply(stream, key, **options)


def write_scored(engine: Engine, stream: DataFrame, key: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Score what is there and write it as Parquet; exactly once, by the checkpoint."""
    scored = score_stream(engine, stream, key, **options)
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where all runs on one machine and none is named, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (path or tempfile.mkdtemp(prefix="tabulex-stream-")).rstrip("/")
