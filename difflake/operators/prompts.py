"""Prompts and token estimates of instances, and projections for evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The estimate's weights, in fortieths of a token.
PER_CHAR, PER_MARK = 11, 20


def estimate_tokens(instances: DataFrame) -> DataFrame:
    """length/4, half a token for each line feed, dot and comma, and a tenth of length/4: in fortieths, to stay whole."""
    t = F.col("problem_statement")
    marks = F.length(t) - F.length(F.translate(t, "\n.,", ""))
    return instances.select("instance_id", F.floor((F.length(t) * PER_CHAR + marks * PER_MARK) / 40).alias("tokens"), F.greatest(F.lit(1), F.floor(F.length(t) / 4)).alias("simple"))


def estimate_tokens_simple(rows: DataFrame, text: str, system: str) -> DataFrame:
    """A quarter of the characters of text and system prompt, one at least."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return rows.select("instance_id", F.greatest(F.lit(1), F.floor((n(text) + n(system)) / 4)).cast("long").alias("tokens"))


def estimate_instance_tokens(instances: DataFrame) -> DataFrame:
    words = lambda c: F.size(F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return instances.select("instance_id", (F.floor(words("problem_statement") * 13 / 10) + F.floor(words("test_patch") * 13 / 10) + 200).alias("tokens"))


def build_prompts(instances: DataFrame) -> DataFrame:
    """Detailed, concise and minimal prompts; sections that are absent are left out."""
    p, lead = F.col("problem_statement"), F.concat(F.lit("Repository: "), "repo")
    part = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(title + "\n"), c))
    detailed = F.array_join(F.array_compact(F.array(lead, F.concat(F.lit("Problem:\n"), p), part("Hints:", "hints_text"), part("Tests:", "test_patch"))), "\n\n")
    concise = F.concat(lead, F.lit("\n"), F.when(F.length(p) > 500, F.concat(F.substring(p, 1, 500), F.lit("..."))).otherwise(p))
    return instances.select("instance_id", F.md5(detailed).alias("detailed"), F.length(detailed).alias("detailed_length"), F.md5(concise).alias("concise"), F.concat(F.substring(p, 1, 200), F.lit("...")).alias("minimal"))


def harness_predictions(predictions: DataFrame, default_model: str = "unknown") -> DataFrame:
    return predictions.select("instance_id", F.coalesce("model", F.lit(default_model)).alias("model_name_or_path"), F.col("patch").alias("model_patch"))


def format_for_evaluation(predictions: DataFrame) -> DataFrame:
    return predictions.where("instance_id <> '' and patch <> ''").select("instance_id", "patch", "model")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines of instance_id and patch."""
    predictions.select("instance_id", "patch").write.mode("errorifexists").json(path)
