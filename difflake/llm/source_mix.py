"""Mixing sources to target weights by pivotal dependent rounding of copy probabilities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, take, unpack_row, with_row

#: Documents of a bucket of the first round on average, and buckets that meet in each later round.
BUCKET, FAN_IN = 2048, 16
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds target: a share of all sizes by weight.

    Weights repeat over the sources in code point order, null last. A target stops at cap times its source's size and
    the excess is shared again by weight: the shared level is the one at which capped and open targets add up.
    Sources are few beside documents; only their sums come here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", pick.cast("double")).withColumn("top", cap * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    total, open_w = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (open_w - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    shared = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return s.withColumn("shared", shared).select("source", "source_size", F.least("top", F.coalesce(F.col("shared") * F.col("weight"), F.col("top"))).alias("target"))


def pivotal(size: np.ndarray, prob: np.ndarray, draw: Callable[[int, int], float]) -> tuple[np.ndarray, int]:
    """Rounds probabilities in pairs; returns them with all but one at 0 or 1, and that one's index (-1: none).

    Each step takes the open unit and the next: mass (size x probability) goes from one to the other, in a direction
    drawn so that both keep their expectation, until one of the two is 0 or 1. The mass of the pair does not change.
    """
    prob = prob.copy()
    held = -1
    for j in range(len(size)):
        if not EPS < prob[j] < 1 - EPS:
            prob[j] = round(prob[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - prob[i]) * size[i], prob[j] * size[j])  # to i from j
        down = min(prob[i] * size[i], (1 - prob[j]) * size[j])
        move = up if draw(i, j) * (up + down) < down else -down
        prob[i] += move / size[i]
        prob[j] -= move / size[j]
        open_ = [x for x in (i, j) if EPS < prob[x] < 1 - EPS]
        for x in (i, j):
            if x not in open_:
                prob[x] = round(prob[x])
        held = open_[0] if open_ else -1
    return prob, held


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source and size (words) of every row."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return take(docs, id_col, text_col, source_col).select(F.col(id_col).alias("id"), size.alias("size"), F.col(source_col).alias("source"))


def unit_copies(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """rows: (id, size, source). One row per unit of them (see mix_copies): id, size, source, m (rows of the unit), source_size, target, copies.

    A document's expected copies are its source's target over its source's size. Whole copies are certain; the
    fractions are settled by pivotal rounding, weighted by size so that each step keeps the words of its pair: in
    buckets of documents of one source, longest first, then in rounds in which the one open document of each of 16
    buckets meet, until one per source is left, which is rounded at random. So a source's words differ from its
    target by less than its last open document. Draws are hashes of ids and sizes: reruns and other partitionings agree.
    A null or blank text has size 0 and no copies to settle (the whole ones only); a null source is a source of its own, the last one.
    """
    units = cut(rows.groupBy("id", "source", "size").agg(F.count("*").alias("m")))
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    targets = cut(source_targets(per_source, weights, cap).join(per_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    units = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + EPS)
    units = units.select("id", "source", "size", "m", "source_size", "target", whole.alias("whole"), F.greatest(ratio - whole, F.lit(0.0)).alias("prob"), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / BUCKET))).cast("int").alias("bits"))
    key = F.xxhash64("id", "source", "size", F.lit(seed))
    units = units.withColumn("key", key).withColumn("bucket", F.col("key").bitwiseAND((F.pow(F.lit(2.0), "bits") - 1).cast("long")))
    settled_already = (F.col("size") == 0) | (F.col("prob") <= EPS)
    plain = units.where(settled_already).select("id", "source", "size", "m", "source_size", "target", F.col("whole").alias("copies"))
    left = cut(units.where(~settled_already))
    top = left.agg(F.max("bits")).first()[0]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        keys = pdf["key"].to_numpy()
        draw = lambda i, j: xxhash.xxh3_64_intdigest(b"%d,%d,%d" % (keys[i], keys[j], seed)) / 2.0**64
        prob, held = pivotal((pdf["size"] * pdf["m"]).to_numpy(np.float64), pdf["prob"].to_numpy(), draw)
        return pdf.assign(prob=prob, open=np.arange(len(pdf)) == held)

    done, level = [plain], 0
    schema = ", ".join(f"{n} {t}" for n, t in left.dtypes)
    out = ["id", "source", "size", "m", "source_size", "target"]
    while top is not None:
        held = cut(left.groupBy("source", "bucket").applyInPandas(settle, f"{schema}, open boolean"))
        last = level >= top
        final = held if last else held.where("not open")
        luck = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
        done.append(final.select(*out, (F.col("whole") + F.when(F.col("open"), (luck < F.col("prob")).cast("long")).otherwise(F.round("prob").cast("long"))).alias("copies")))
        if last:
            break
        level += int(np.log2(FAN_IN))
        left = held.where("open").drop("open").withColumn("bucket", F.shiftright("bucket", int(np.log2(FAN_IN))))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select("id", "size", "source", "m", "source_size", "target", F.col("copies").cast("long").alias("copies"))


def _with_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows, which have id_, size_ and source_, with their units' other columns. A unit of very many rows is a skewed join key: its rows are split."""
    same = F.col("id_").eqNullSafe(F.col("id")) & F.col("source_").eqNullSafe(F.col("source")) & (F.col("size_") == F.col("size"))
    return rows.join(units, same)


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies (0 to cap).

    Options are those of unit_copies: weights, cap and seed. Rows that agree in id, source and size are one unit: they
    get the same copies. Null ids are such an id. An empty table gives an empty result.
    """
    rows = cut(_sized(docs, id_col, text_col, source_col))
    joined = _with_units(rows.toDF("id_", "size_", "source_"), cut(unit_copies(rows, **options)))
    return joined.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as many times as mix_copies says; the same columns."""
    names = docs.columns
    size = F.coalesce(F.regexp_count("text_", F.lit(WORD)), F.lit(0)).cast("long")
    rows = with_row(docs, id_=id_col, text_=text_col, source_=source_col).select("row_", "id_", "source_", size.alias("size_"))
    copies = cut(unit_copies(_sized(docs, id_col, text_col, source_col), **options).select("id", "source", "size", "copies").where("copies > 0"))
    joined = _with_units(rows, copies)
    return unpack_row(joined.select("row_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), names)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
