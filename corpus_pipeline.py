"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``tabulex.llm`` on all that the stage before it
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulex.llm.common import find, finished, n_words, numbered
from tabulex.llm.language_id import language_filter
from tabulex.llm.line_dedup import line_dedup
from tabulex.llm.mixing import mix_sources
from tabulex.llm.near_dedup import near_dedup
from tabulex.llm.packing import pack


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of a half or more; texts without letters go."""
    return language_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents have stay in the first of these only; a document that this leaves without a word goes.

    The first occurrence stays, or a text with ten copies would vanish whole.
    """
    out = line_dedup(docs, min_docs=10, keep_first=True)
    n = numbered(out)
    width = len(docs.columns)
    left = n_words(F.col(f"c{find(docs, 'text')}"))
    kept = n.where((F.col(f"c{width + 1}") == 0) | (left > 0))
    return kept.select(*n.columns[:width]).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, repeated rows among them; null and empty texts are copies of one another."""
    return near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is one of the sources, the last; a null text has no words."""
    n = numbered(docs)
    taken = mix_sources(n, F.array(F.col(f"c{find(docs, 'source')}")), n_words(F.col(f"c{find(docs, 'text')}")))
    again = taken.where("copies > 0").withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*n.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens at most, with their token ids; a null text yields its end id alone, repeated rows are packed each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has no logistic regression, sampling or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        given = docs
        docs = finished(spark, lambda: stage(spark, given, sf_dir), name)  # noqa: B023
    return docs
