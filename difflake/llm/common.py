"""What the operators of this package share: input columns, words, lineage cuts and components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(r"[^ \t-\r]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name and position, so that other columns that differ in case only do not clash."""
    flat = df.toDF(*(f"c{i}_" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"c{df.columns.index(n)}_").alias(n) for n in names))


def with_row(df: DataFrame, **columns: str) -> DataFrame:
    """The whole row as the struct row_, beside the named columns (new name = old name)."""
    flat = df.toDF(*(f"c{i}_" for i in range(len(df.columns))))
    return flat.select(F.struct(*flat.columns).alias("row_"), *(F.col(f"c{df.columns.index(old)}_").alias(new) for new, old in columns.items()))


def unpack_row(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns that row_ was made of, some of them replaced."""
    return df.select(*((replaced[n] if n in replaced else F.col(f"row_.c{i}_")).alias(n) for i, n in enumerate(names)))


#: A written table needs none of the shuffles that led to it: Spark deletes their files as soon as it is written.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shared_folder(df: DataFrame) -> Iterator[tuple[DataFrame, str]]:
    """df, so planned that its shuffles go when it is written, and the checkpoint folder that the cluster names; a temporary one only where none is set in a local session, as in tests."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield df.select("*"), sc.getCheckpointDir()
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


_OWNER: list = [None, lambda: None]


def working(owner: str, clear: Callable[[], object] = lambda: None) -> None:
    """Says in a worker process which operator's task it runs now. What the one before remembered is dropped, and free memory goes back to the system: workers outlive stages."""
    if _OWNER[0] == owner:
        return
    _OWNER[1]()
    _OWNER[:] = [owner, clear]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder."""
    with _shared_folder(df) as (fresh, _):
        return fresh.checkpoint(eager=True)


def first_by_hash(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by the named columns, of which the first is a 64-bit hash. Only rows whose hash is small enough for about 2 n to be left are sorted, so what one task merges does not grow with df."""
    total = df.count()
    if total > 4 * n:
        some = df.where(F.col(order[0]) < (1 << 65) * n // total - (1 << 63))
        if some.count() >= n:
            df = some
    return df.orderBy(*order).limit(n)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lower_words(text: str | None) -> list[str]:
    return WORDS.findall(text.translate(_ASCII_LOWER)) if text else []


def lower_word_bytes(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased: bytes methods know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words, in order; of the whole sequence, if it has fewer words; none, if it has none."""
    k = min(n, len(hashes))
    if not k:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out + hashes[i : len(hashes) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every node of the edges with the smallest node that it reaches: (node, root).

    Labels move along edges and then jump to their label's label, so stars and chains settle in few rounds. Each
    round is joins and partially aggregated minima; nothing is gathered, and hot nodes are split as skewed join keys.
    """
    spark: SparkSession = edges.sparkSession
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.union(both.select("y", "x").toDF("x", "y")).where("x <> y").distinct())
    label = cut(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("l")))
    while True:
        near = both.join(label.toDF("y", "ly"), "y").groupBy("x").agg(F.min("ly").alias("m"))
        down = cut(label.join(near, "x").select("x", "l", F.least("l", "m").alias("m")))
        jump = down.select(F.col("x").alias("m"), F.col("m").alias("j"))
        after = cut(down.join(jump, "m", "left").select("x", (F.col("l") != F.least(F.coalesce("j", "m"), "m")).alias("moved"), F.least(F.coalesce("j", "m"), "m").alias("l")))
        label = after.select("x", "l")
        if after.where("moved").isEmpty():
            return label.toDF("node", "root")


def stored(df: DataFrame) -> DataFrame:
    """df, written as a compressed columnar table to the checkpoint folder: for wide rows that are read more than once."""
    with _shared_folder(df) as (fresh, folder):
        path = f"{folder}/{uuid.uuid4().hex}.parquet"
        fresh.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored() tables that nothing reads any more; what was cut or stored from them stays."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
