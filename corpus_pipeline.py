"""A training-corpus pipeline of the package's operators: each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from difflake.llm import line_dedup, ngram_join, packing, quality, source_mix
from difflake.llm.common import discard, stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of three lines or more that occur earlier; n_chars follows the text."""
    names = docs.columns
    done = line_dedup.line_dedup(docs)
    flat = done.toDF(*(f"c{i}" for i in range(len(done.columns))))  # by position: names may differ in case only
    length = F.length(f"c{names.index('text')}").cast("long")
    return flat.select(*((length if n == "n_chars" else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity 0.8 or more."""
    return ngram_join.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.packed_digest(docs)


STAGES = [("quality", classify), ("line_dedup", drop_lines), ("ngram_join", drop_near), ("source_mix", mix), ("packing", pack)]
#: The classifier is trained, the mix is drawn and pieces are tokens: not SQL. tests/llm holds the stages against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what goes between them is written, as between jobs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            done = stored(done)
            if i:
                discard(docs)
        docs = done
    return docs
