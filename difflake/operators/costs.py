"""Limits, prices and costs of model calls. Money is summed as decimals, so that sums do not depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import ranged

#: Fixed value: the limit of a model that no rule knows.
DEFAULT_LIMIT = 4096


def matched(names: DataFrame, models: DataFrame, wanted: str | None = None) -> DataFrame:
    """For each distinct model name its catalogue row: equal name, else the first in catalogue order of which one name holds the other."""
    catalogue = models if wanted is None else models.where(f"{wanted} is not null")
    m = catalogue.withColumnRenamed("model", "known")
    either = F.col("model").contains(F.col("known")) | F.col("known").contains(F.col("model"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy((F.col("model") != F.col("known")).cast("int"), "pos"))
    return names.select("model").distinct().join(F.broadcast(m), either, "left").withColumn("rank", rank).where("rank = 1").drop("rank")  # the catalogue is a fixed table


def model_limits(usage: DataFrame, models: DataFrame) -> DataFrame:
    return matched(usage, models).select("model", F.coalesce("context_limit", F.lit(DEFAULT_LIMIT)).cast("long").alias("context_limit"))


def usage_cost(usage: DataFrame, models: DataFrame) -> DataFrame:
    """Cost in millionths: exact whole numbers of price (thousandths) times tokens."""
    prices = matched(usage, models, "input_per_m").select("model", (F.col("input_per_m") * 100).cast("long").alias("i"), (F.col("output_per_m") * 100).cast("long").alias("o"))
    return usage.join(prices, "model").select("call_id", "run_id", "provider", "model", "ts", "prompt_tokens", "completion_tokens", "latency_ms", (F.col("prompt_tokens") * F.col("i") + F.col("completion_tokens") * F.col("o")).alias("cost_e8"))


def cost_rollup(usage: DataFrame, models: DataFrame) -> DataFrame:
    c = usage_cost(usage, models).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return c.rollup("provider", "model", "day").agg(F.sum("cost_e8").alias("cost_e8"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("latency_ms").alias("latency_ms"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def budget_cutoff(usage: DataFrame, models: DataFrame, budget_e8: int) -> DataFrame:
    """Calls of each run, in time order, while the cost so far is within the budget. A call without a cost adds none, but before a run's first cost there is no sum. Calls of one time and id come by cost, unknown last.

    A run is cut into ranges of time; sums of the ranges before are added, so a large run is many tasks' work.
    """
    order = [F.asc_nulls_last(c) for c in ("ts", "call_id", "cost_e8")]
    parts = ranged(usage_cost(usage, models).select("run_id", "ts", "call_id", "cost_e8"), "run_id", *order)
    sums = parts.groupBy("run_id", "part").agg(F.sum("cost_e8").alias("sum"), F.sum(F.least("cost_e8", F.lit(0))).alias("low"))
    earlier = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("run_id").alias("run_of"), F.col("part").alias("part_of"), F.sum("sum").over(earlier).alias("offset"), "low")  # a row for each run and partition
    offsets = offsets.where(F.coalesce("offset", F.lit(0)) + F.col("low") <= budget_e8)  # in the others no sum is as low
    so_far = F.sum("cost_e8").over(Window.partitionBy("run_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.join(offsets, (F.col("part") == F.col("part_of")) & F.col("run_id").eqNullSafe(F.col("run_of"))).withColumn("so_far", so_far)
    spent = F.coalesce(F.col("so_far") + F.col("offset"), "so_far", "offset")
    return rows.withColumn("spent_e8", spent).where(F.col("spent_e8") <= budget_e8).select("run_id", "call_id", "spent_e8")


def cost_warnings(usage: DataFrame, models: DataFrame) -> DataFrame:
    dollars = 100_000_000
    cost, tokens = F.col("cost_e8"), F.col("prompt_tokens") + F.col("completion_tokens")
    c = usage_cost(usage, models).join(F.broadcast(models.select("model", "context_limit")), "model", "left")
    share = F.col("prompt_tokens") * 100
    dear = F.col("model").contains("gpt-4") | F.col("model").contains("claude-3-opus")
    w = [
        F.when(cost > 10 * dollars, "cost>10").when(cost > 5 * dollars, "cost>5").when(cost > dollars, "cost>1"),
        F.when(tokens > 100_000, "tokens>100k").when(tokens > 50_000, "tokens>50k"),
        F.when(share > F.col("context_limit") * 90, "context>90").when(share > F.col("context_limit") * 75, "context>75"),
        F.when(dear & (tokens > 10_000), "expensive"),
    ]
    return c.select("call_id", F.array_join(F.array_compact(F.array(*w)), ",").alias("warnings"))


def suggest_models(instances: DataFrame, models: DataFrame, spare: int = 2000) -> DataFrame:
    """For each prompt the smallest model that holds it and the spare: a range join with the fixed catalogue."""
    need = instances.select("instance_id", (F.floor(F.length("problem_statement") / 4) + spare).alias("need"))
    fits = need.join(F.broadcast(models), F.col("context_limit") >= F.col("need"), "left")
    return fits.groupBy("instance_id", "need").agg(F.min_by("model", F.struct("context_limit", "pos")).alias("model"))


def context_usage(instances: DataFrame, models: DataFrame, model: str = "gpt-4") -> DataFrame:
    limit = models.where(F.col("model") == model).select("context_limit")
    return instances.select("instance_id", F.floor(F.length("problem_statement") / 4).alias("tokens")).join(F.broadcast(limit)).select("instance_id", (F.col("tokens") / F.col("context_limit")).alias("share"))
