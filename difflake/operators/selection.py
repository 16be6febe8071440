"""Selecting and sampling instances."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranges import numbered

#: Limits of patterns and ids.
MAX_PATTERN, MAX_ID, MAX_SAMPLE = 1000, 200, 10_000
#: Shapes of patterns that may take exponential time.
COSTLY = (
    r"\(\?\=.*\)\+",
    r"\(\?\!.*\)\+",
    r".*\*.*\*",
    r"\(.*\)\+.*\(.*\)\+",
    r"\[.*\]\*.*\[.*\]\*",
    r"\(.*\+.*\)\+",
    r"\(.*\*.*\)\*",
    r".{500,}",
    r"[a-zA-Z0-9_]\{[0-9]{3,},\}",
)


def select_by_ids(instances: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in ids; repeated ids do not repeat rows. The engine broadcasts the list only if it is small."""
    return instances.join(ids.select("instance_id").distinct(), "instance_id", "left_semi")


def glob_to_regex(pattern: str) -> str:
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^(?:" + "".join(out) + r")\z"


def select_by_glob(instances: DataFrame, pattern: str) -> DataFrame:
    return instances.where(F.col("instance_id").rlike(glob_to_regex(pattern)))


def select_by_regex(instances: DataFrame, pattern: str) -> DataFrame:
    """Anchored at the start only. Empty, over-long, costly or broken patterns are refused."""
    if not pattern or len(pattern) > MAX_PATTERN or any(re.search(shape, pattern) for shape in COSTLY):
        raise ValueError("the pattern is empty, too long or too costly")
    re.compile(pattern)
    return instances.where(F.col("instance_id").rlike(f"^(?:{pattern})"))


def sample_count(instances: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by a hash of seed and id: the same for any partitioning; a top-n, not a full sort."""
    if not 1 <= n <= MAX_SAMPLE:
        raise ValueError(f"n must be in 1..{MAX_SAMPLE}")
    return instances.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "instance_id")), "instance_id").limit(n)


def sample_percent(instances: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """int(rows * percent / 100) rows, one at least."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in (0, 100]")
    n = max(1, int(instances.count() * percent / 100))
    hashed = instances.withColumn("h_", F.md5(F.concat(F.lit(f"{seed}:"), "instance_id")))
    # rows are not sorted: counts by the first digits of the hash tell where the n-th lies; only that range is ranked
    counts = hashed.groupBy(F.substring("h_", 1, 3).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # 4096 rows at most
    before = 0
    for r in counts:
        if before + r["n"] >= n:
            break
        before += r["n"]
    else:
        return instances
    rest = hashed.where(F.substring("h_", 1, 3) == r["p"]).orderBy("h_", "instance_id").limit(n - before)
    return hashed.where(F.substring("h_", 1, 3) < r["p"]).unionByName(rest).drop("h_")


def validate_instance_ids(instances: DataFrame) -> DataFrame:
    i = F.col("instance_id")
    reason = F.when(i.isNull() | (i == ""), "empty").when(F.length(i) > MAX_ID, "too_long").when(~i.rlike(r"^[A-Za-z0-9_.-]+\z"), "bad_characters").when(~i.rlike("^[A-Za-z]"), "bad_start")
    return instances.select("instance_id", reason.alias("reason"))


def batch_instances(instances: DataFrame, size: int = 100) -> DataFrame:
    """Consecutive batches by id. Rows are numbered in range partitions; only the partitions' sizes are summed."""
    parts = cut(instances.select("instance_id").repartitionByRange("instance_id").select(F.spark_partition_id().alias("part"), "instance_id"))  # ranges are drawn once
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = parts.join(before, "part").withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("instance_id")) - 1 + F.col("before"))
    return rows.select("instance_id", F.floor(F.col("nth") / size).alias("batch"))


def dataset_info(instances: DataFrame) -> DataFrame:
    return instances.groupBy("repo").agg(F.count("*").alias("n"), F.sum(F.octet_length("problem_statement")).alias("bytes"), (F.count("*") * 1536).alias("memory_bytes"))


def interleave_by_repo(instances: DataFrame) -> DataFrame:
    """Turns: the first instance of each repository, the second of each, ...; repositories in first-seen order.

    A repository of any size is numbered over ranges of its ids; null is a repository too.
    """
    rows = numbered(instances.select("instance_id", "repo", "doc_id"), "nth", ["repo"], "doc_id")
    first = rows.where("nth = 0").select(F.col("repo").alias("of"), F.col("doc_id").alias("repo_first"))
    joined = rows.join(first, F.col("repo").eqNullSafe(F.col("of")))
    return joined.select("instance_id", "repo", (F.col("nth") + 1).cast("int").alias("turn"), "repo_first")
