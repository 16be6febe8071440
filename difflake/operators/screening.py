"""Screening of predictions before they are evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of binary files; the default limit in bytes; markers of conflicts.
BINARY_NAMES = r"\.png|\.jpg|\.jpeg|\.gif|\.bmp|\.ico|\.tiff|\.pdf|\.doc|\.docx|\.xls|\.xlsx|\.ppt|\.pptx|\.zip|\.tar|\.gz|\.bz2|\.7z|\.rar|\.exe|\.dll|\.so|\.dylib|\.a|\.o|\.mp3|\.mp4|\.avi|\.mov|\.wmv|\.flv|\.db|\.sqlite|\.dat|\.bin"
MAX_MB = 5
CONFLICTS = ("invalid hunk", "@@@", "<<<<<<<", ">>>>>>>")


def first_failure(max_bytes: int = MAX_MB * 1024 * 1024) -> Column:
    """The first rule that a prediction fails, null if none."""
    patch = F.col("patch")
    binary = F.exists(F.split(patch, "\n", -1), lambda x: x.startswith("GIT binary patch") | (x.contains("Binary files") & x.contains("differ")) | ((x.startswith("+++") | x.startswith("---")) & F.lower(x).rlike(BINARY_NAMES)))
    return (
        F.when(F.col("instance_id").isNull() | (F.col("instance_id") == ""), "empty_id").when(patch.isNull() | (patch == ""), "empty_patch").when(~F.col("instance_id").rlike(r"^[a-zA-Z0-9_\-\.]+$"), "bad_id")
        .when(~patch.rlike(r"(?U)^\s*(diff --git|--- |\+\+\+ )"), "not_a_diff").when(F.octet_length(patch) > max_bytes, "too_large").when(binary, "binary")
    )


def validate_predictions(predictions: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    return predictions.select("patch_id", first_failure(max_mb * 1024 * 1024).alias("reason"))


def screen_predictions(predictions: DataFrame, max_mb: int = MAX_MB, note_kb: int = 500) -> DataFrame:
    patch, low = F.col("patch"), F.lower("patch")
    conflict = low.contains(CONFLICTS[0])
    for mark in CONFLICTS[1:]:
        conflict = conflict | low.contains(mark)
    reason = F.when(F.octet_length(patch) > max_mb * 1024 * 1024, "PATCH_TOO_LARGE").when(low.contains("binary files differ"), "binary").when(conflict, "conflict")
    return predictions.where("patch is not null").select("patch_id", reason.alias("reason"), (F.octet_length(patch) > note_kb * 1024).alias("large"))


def suspicious(lines: DataFrame, max_deletions: int = 1000) -> DataFrame:
    line = F.col("line")
    return lines.groupBy("patch_id").agg(
        (F.count_if(line.startswith("-") & ~line.startswith("---")) > max_deletions).alias("many_deletions"), (F.count_if(line.startswith("old mode ") | line.startswith("new mode ")) > 0).alias("mode_change"),
        (F.count_if(line.startswith("GIT binary patch") | (line.contains("Binary files") & line.contains("differ"))) > 0).alias("binary"))


def unknown_predictions(predictions: DataFrame, instances: DataFrame) -> DataFrame:
    return predictions.join(instances, "instance_id", "left_anti").select("patch_id", "instance_id")


def missing_predictions(predictions: DataFrame, instances: DataFrame) -> DataFrame:
    return instances.join(predictions.where("patch <> ''"), "instance_id", "left_anti").select("instance_id", F.lit(False).alias("passed"), F.lit("missing_patch").alias("status"))


def infer_test_set(instances: DataFrame) -> DataFrame:
    name = F.lower(F.concat("repo", "lang", "version"))
    kind = F.when(name.contains("verified"), "verified").when(name.contains("lite"), "lite").when(name.contains("full"), "full").otherwise("custom")
    return instances.groupBy(F.concat("repo", F.lit("/"), "lang", F.lit("_"), "version").alias("name"), kind.alias("test_set")).agg(F.count("*").alias("n"))
