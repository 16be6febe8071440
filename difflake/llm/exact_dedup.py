"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, take

#: A chunk ends at the first sentence end or line end after its first 256 characters; one without is cut at 2048.
CHUNK = r"(?s).{256,2047}?[.!?\n]|.{1,2048}"


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_sha256, recipe (identifiers of its chunks, in order).

    A chunk's identifier is its hash and a rank. Every distinct (hash, chunk) pair is moved once and compared by
    content; chunks that differ but share a hash get ranks, all others have rank 0. So two recipes are equal exactly
    when the lower-cased texts are.
    """
    norm = ascii_lower(F.coalesce(text_col, F.lit("")))
    chunks = take(docs, id_col, text_col).select(F.col(id_col).alias("id_"), F.sha2(norm, 256).alias("text_sha256"), F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0)).alias("chunks"))
    distinct = chunks.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = cut(distinct.select("h").groupBy("h").count().where("count > 1").select("h"))
    hashed = chunks.select("id_", "text_sha256", F.transform("chunks", chunk_hash).alias("recipe"))
    if shared.isEmpty():
        return cut(hashed.select("id_", "text_sha256", F.transform("recipe", lambda h: F.struct(h.alias("h"), F.lit(0).alias("rank"))).alias("recipe")))
    rank = distinct.join(shared, "h", "left_semi").select("h", "chunk", F.row_number().over(_by_content()).alias("rank"))
    parts = chunks.select(F.monotonically_increasing_id().alias("n"), "*").select("n", "id_", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk"))
    parts = parts.select("n", "id_", "text_sha256", "pos", chunk_hash(F.col("chunk")).alias("h"), "chunk").join(rank, ["h", "chunk"], "left")
    part = F.struct("pos", F.struct("h", F.coalesce("rank", F.lit(0)).alias("rank")).alias("c"))
    lists = parts.groupBy("n", "id_", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), part))).alias("parts"))
    return cut(lists.select("id_", "text_sha256", F.transform("parts", lambda p: p["c"]).alias("recipe")))


def _by_content():
    from pyspark.sql import Window

    return Window.partitionBy("h").orderBy("chunk")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; a null text counts as empty, and empty texts are
    equal to each other. Of equal texts the row with the largest id stays. A null id loses to any other; a group of
    null ids only has keep_id null and keeps them all. Rows that repeat id and text come out as often as they came
    in, all with the same flags, and count in group_size. An empty table gives an empty result; other columns do not matter.
    """
    recipes = chunk_recipes(docs, id_col, text_col)
    groups = cut(recipes.groupBy("recipe").agg(F.max("id_").alias("keep_id"), F.count("*").alias("group_size")))
    joined = recipes.join(groups, "recipe")
    return joined.select(F.col("id_").alias(id_col), "keep_id", "group_size", F.col("id_").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
