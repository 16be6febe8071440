"""Model catalogues of providers: prices, recency, and the cheapest model that fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prompts import estimate_instance_tokens

#: Dollars per million tokens in and out by provider and model; the default of each provider; words of code models.
PRICES = [
    ("openai", "gpt-4o", 5.0, 20.0),
    ("openai", "gpt-4o-mini", 0.15, 0.6),
    ("openai", "gpt-4-turbo", 10.0, 30.0),
    ("openai", "gpt-4", 30.0, 60.0),
    ("openai", "gpt-4-32k", 60.0, 120.0),
    ("openai", "gpt-3.5-turbo", 1.5, 2.0),
    ("openai", "gpt-3.5-turbo-16k", 3.0, 4.0),
    ("anthropic", "claude-3-opus-20240229", 15.0, 75.0),
    ("anthropic", "claude-3-sonnet-20240229", 3.0, 15.0),
    ("anthropic", "claude-3-haiku-20240307", 0.25, 1.25),
]
DEFAULTS = {"openai": (5.0, 20.0), "anthropic": (3.0, 15.0), "ollama": (0.0, 0.0), "openrouter": (1.0, 2.0)}
CODE_WORDS = ["code", "instruct", "chat", "gpt", "claude", "gemini", "mixtral", "llama", "deepseek", "phind", "nous"]
RAW = "id string, context_length long, created string, pricing struct<prompt:string,completion:string>"


def provider_cost(usage: DataFrame) -> DataFrame:
    """Cost of each call at its provider's own prices, in 1e-8 dollars; models that the provider does not list cost its default."""
    prices = usage.sparkSession.createDataFrame([(p, m, round(i * 100), round(o * 100)) for p, m, i, o in PRICES], "provider string, model string, i long, o long")
    default = lambda k: F.create_map(*[x for p, v in DEFAULTS.items() for x in (F.lit(p), F.lit(round(v[k] * 100)))])[F.col("provider")]
    u = usage.join(F.broadcast(prices), ["provider", "model"], "left")  # the price list is a fixed table
    cost = F.col("prompt_tokens") * F.coalesce("i", default(0)) + F.col("completion_tokens") * F.coalesce("o", default(1))
    return u.select("call_id", "provider", "model", cost.cast("long").alias("cost_e8"))


def estimate_batch_cost(instances: DataFrame, models: DataFrame, model: str = "gpt-4o", tokens: int = 1000) -> DataFrame:
    """Least and most that a batch of each repository costs: so many tokens in and out an instance, and twice that."""
    price = models.where(F.col("model") == model).select(((F.col("input_per_m") + F.col("output_per_m")) * 100).cast("long").alias("p"))
    n = instances.groupBy("repo").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(price)).select("repo", "n", (F.col("n") * tokens * F.col("p")).alias("least_e8"), (F.col("n") * tokens * F.col("p") * 2).alias("most_e8"))  # one row of the fixed catalogue


def estimate_batch_cost_by_row(instances: DataFrame, models: DataFrame, model: str = "gpt-4o", max_tokens: int = 1000) -> DataFrame:
    """Number, tokens and cost of all instances: each one's own token estimate in, max_tokens out."""
    prices = models.where(F.col("model") == model).select((F.col("input_per_m") * 100).cast("long").alias("i"), (F.col("output_per_m") * 100).cast("long").alias("o"))
    t = estimate_instance_tokens(instances).agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))
    return t.join(F.broadcast(prices)).select("n", "tokens", (F.col("tokens") * F.col("i") + F.col("n") * max_tokens * F.col("o")).alias("cost_e8"))  # one row each


def estimate_batch_time(instances: DataFrame, seconds: int = 30, concurrency: int = 5) -> DataFrame:
    return instances.groupBy("repo").agg((F.count("*") * seconds / concurrency).alias("seconds"))


def parsed(listing: DataFrame) -> DataFrame:
    """Models of a listing: JSON objects to columns; those without id or pricing are left out."""
    j = listing.select("pos", F.from_json("raw", RAW).alias("j")).select("pos", "j.*")
    return j.where("id is not null and pricing is not null")


def gateway_prices(listing: DataFrame) -> DataFrame:
    """Dollars per thousand tokens."""
    per_k = lambda c: F.col(f"pricing.{c}").try_cast("double") * 1000
    return parsed(listing).select("pos", "id", per_k("prompt").alias("input_per_k"), per_k("completion").alias("output_per_k"))


def code_models(listing: DataFrame) -> DataFrame:
    return parsed(listing).where(F.lower("id").rlike("|".join(CODE_WORDS))).select("pos", "id", "context_length", "pricing")


def cheapest_model(listing: DataFrame, least_context: int, default: str) -> DataFrame:
    """The code model of enough context with the lowest price of a token in and one out (unknown: 1 each); the first on ties."""
    price = lambda c: F.coalesce(F.col(f"pricing.{c}").try_cast("double"), F.lit(1.0))
    fit = code_models(listing).where(F.col("context_length") >= least_context)
    return fit.agg(F.coalesce(F.min_by("id", F.struct((price("prompt") + price("completion")).alias("c"), "pos")), F.lit(default)).alias("id"))


def rank_models_by_recency(listing: DataFrame) -> DataFrame:
    """Days since 1970 of a model's creation, else of the date in its id; sorted by that, newest first, unknown last, then by id."""
    j = parsed(listing)
    day = F.coalesce(F.floor(F.col("created").try_cast("long") / 86400), F.unix_date(F.expr("try_to_date(created)")).cast("long"), F.unix_date(F.expr(r"try_to_date(nullif(regexp_extract(id, '(?:^|-)(\\d{4}-\\d{2}-\\d{2})(?:-|$)', 1), ''))")).cast("long"))
    return j.select("pos", "id", day.alias("day")).orderBy(F.desc_nulls_last("day"), "id", "pos")
