"""Logs of calls and attempts: classes of errors, retries, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Finish reasons by provider.
FINISH = {("openai", "stop"): "stop", ("openai", "length"): "length", ("openai", "tool_calls"): "tool_calls", ("openai", "content_filter"): "content_filter", ("anthropic", "end_turn"): "stop", ("anthropic", "max_tokens"): "length", ("anthropic", "tool_use"): "tool_calls", ("ollama", "stop"): "stop", ("ollama", "length"): "length"}
#: Words of harness errors.
NETWORK = "network|connection|unreachable|registry|pull|resolve|dns"


def error_class() -> F.Column:
    m, s = F.lower("message"), F.col("status")
    bad = F.when(m.contains("context length"), "context_length").when(m.contains("content policy") | m.contains("violates"), "content_filter").when(m.contains("invalid") & m.contains("parameter"), "bad_parameter").otherwise("bad_request")
    denied = F.when(m.contains("billing") | m.contains("quota"), "billing").when(m.contains("organization"), "organization").otherwise("permission")
    return F.when(s == 401, "auth").when(s == 403, denied).when(s == 404, "model_not_found").when(s == 400, bad).when(s == 429, F.when(m.contains("token"), "rate_limit_tokens").otherwise("rate_limit_requests")).when((s >= 500) & (s <= 599), "server").when(s >= 400, "http")


def classify_api_errors(log: DataFrame) -> DataFrame:
    name = F.regexp_extract("message", r"Model\s+'([^']+)'", 1)
    return log.where("status >= 400").select("call_id", error_class().alias("error_class"), F.when((F.col("status") == 404) & (name != ""), name).alias("model"))


def context_overrun(log: DataFrame) -> DataFrame:
    asked = F.regexp_extract("message", r"requested (\d+) tokens", 1).try_cast("long")
    limit = F.regexp_extract("message", r"maximum.*?(\d+)", 1).try_cast("long")
    rows = log.where(F.lower("message").contains("context length")).select("call_id", asked.alias("requested"), limit.alias("maximum"))
    return rows.withColumn("suggested", F.when((F.col("requested") > 0) & (F.col("maximum") > 0), F.greatest(F.lit(100), F.col("maximum") - F.col("requested") - 100)))


def retry_plan(log: DataFrame, base: float = 1.0, tries: int = 6) -> DataFrame:
    """Delays of so many tries by class, without the random part: what a rate limit asks for, else a power of two or three with a limit by class.

    The second provider has one rule for all that it retries, and a limit on what a rate limit asks for.
    """
    rows = log.where("status >= 400").select("call_id", "api", "retry_after", error_class().alias("c"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))
    c, second, asked = F.col("c"), F.col("api") == "anthropic", F.col("retry_after")
    power = lambda x, most: F.least(F.lit(most), base * F.pow(F.lit(x), F.col("attempt")))
    limited, given = c.startswith("rate_limit"), asked > 0
    retryable = F.when(second, ~c.isin("auth", "billing", "organization", "permission", "context_length")).otherwise(limited | c.isin("server", "http"))
    one = F.when(limited & given, F.least(asked, F.lit(60.0))).otherwise(power(2.0, 60.0))
    other = F.when(limited, F.when(given, asked).otherwise(power(3.0, 60.0))).when(c == "server", power(2.0, 30.0)).otherwise(power(2.0, 16.0))
    return rows.select("call_id", "attempt", c.alias("error_class"), retryable.alias("retryable"), F.when(retryable, F.when(second, one).otherwise(other)).alias("delay"))


def normalize_finish_reason(responses: DataFrame) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for (p, r), v in FINISH.items() for x in (f"{p}/{r}", v)])
    return responses.select("response_id", F.coalesce(mapping[F.concat_ws("/", "provider", "reason")], F.lit("stop")).alias("finish_reason"))


def classify_harness_errors(results: DataFrame) -> DataFrame:
    e = F.lower("error")
    code = F.when(e.rlike(NETWORK), 3).when(e.rlike("timeout|timed out"), 1).when(e.contains("docker") & e.rlike("not found|not running|daemon"), 2).when(e.rlike("disk|space|memory|ram"), 4).otherwise(1)
    return results.where("error is not null").select("seq", code.alias("exit_code"))


def classify_run_stderr(results: DataFrame) -> DataFrame:
    e = F.lower("error")
    kind = F.when(e.rlike(NETWORK + "|timeout|timed out"), "network").when(e.rlike("oom|out of memory"), "oom").when(e.rlike("no space left on device|disk full"), "disk_full").when(e.contains("limit"), "container_limit").otherwise("other")
    return results.where("error is not null").select("seq", kind.alias("kind"))


def calls_per_minute(log: DataFrame, requests: int = 1000, tokens: int = 40_000) -> DataFrame:
    """Requests and tokens of each provider in 60 s windows; the same on a stream with a watermark."""
    w = log.groupBy("provider", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return w.select("provider", F.col("w.start").alias("start"), "requests", "tokens", (F.col("requests") / requests).alias("request_share"), (F.col("tokens") / tokens).alias("token_share"))


def resolve_attempts(attempts: DataFrame, tries: int = 3) -> DataFrame:
    """The final attempt of each (run, instance): the first success or unexpected error, else the last of so many tries."""
    nth = F.row_number().over(Window.partitionBy("run_id", "instance_id").orderBy("ts", "seq"))
    a = attempts.withColumn("attempt", nth).where(F.col("attempt") <= tries)
    stop = F.min(F.when(F.col("outcome").isin("ok", "unexpected"), F.col("attempt"))).over(Window.partitionBy("run_id", "instance_id"))
    a = a.withColumn("stop", stop).where("stop is null or attempt <= stop")
    by = F.col("attempt")
    return a.groupBy("run_id", "instance_id").agg(F.max_by("outcome", by).alias("outcome"), F.max_by("error", by).alias("error"), F.max("attempt").alias("attempts"), F.sum("micro_usd").alias("micro_usd"), (F.min(F.when(F.col("outcome") == "token_limit", by)) < F.max("attempt")).alias("truncated"), F.least(F.lit(10), F.count_if(F.col("outcome") == "parse_failure")).alias("warmer"))


def resolve_fallback(attempts: DataFrame) -> DataFrame:
    """The first provider in order of preference that succeeded, else the last one's error."""
    order = F.when(F.col("provider") == "openai", 0).when(F.col("provider") == "anthropic", 1).when(F.col("provider") == "openrouter", 2).otherwise(3)
    rank = F.struct(order.alias("o"), "ts", "seq")
    ok = F.col("outcome") == "ok"
    return attempts.groupBy("run_id", "instance_id").agg(F.min_by(F.when(ok, F.col("provider")), F.when(ok, rank)).alias("provider"), F.max_by(F.when(~ok, F.col("error")), F.when(~ok, rank)).alias("last_error"))


def batch_stats(attempts: DataFrame) -> DataFrame:
    """Completed, failed and skipped attempts of each run, cost and time, and means over the completed ones."""
    o = F.col("outcome")
    us = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    s = attempts.groupBy("run_id").agg(F.count_if(o == "ok").alias("completed"), F.count_if(~o.isin("ok", "skipped")).alias("failed"), F.count_if(o == "skipped").alias("skipped"), F.sum("micro_usd").alias("micro_usd"), F.floor(us / 1_000_000).alias("seconds"))
    one = lambda c: F.greatest(F.lit(1), c)
    done = F.col("completed")
    return s.select("*", (done / one(done + F.col("failed"))).alias("success_rate"), (F.col("micro_usd") / one(done)).alias("mean_micro_usd"), (F.col("seconds") / one(done)).alias("mean_seconds"))


def classify_generation_errors(attempts: DataFrame) -> DataFrame:
    e = F.lower("error")
    kind = F.when(e.contains("rate limit"), "rate_limit").when(e.contains("token limit"), "token_limit").when(F.col("outcome") == "unexpected", "unexpected_error").otherwise("provider_error")
    return attempts.where("error is not null").groupBy("run_id", kind.alias("kind")).agg(F.count("*").alias("n"))


def top_failure_reasons(attempts: DataFrame, k: int = 5) -> DataFrame:
    c = attempts.where("error is not null").groupBy("run_id", "error").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "error"))).where(F.col("rank") <= k)


def failed_sample(attempts: DataFrame, k: int = 10) -> DataFrame:
    """The first k failures of each run and how many more there are. Ranks are cut to k before the shuffle; counts are sums."""
    f = attempts.where("outcome not in ('ok', 'skipped')")
    first = f.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "seq"))).where(F.col("rank") <= k)
    return first.join(f.groupBy("run_id").agg(F.count("*").alias("total")), "run_id").select("run_id", "rank", "instance_id", F.substring("error", 1, 100).alias("error"), F.greatest(F.lit(0), F.col("total") - k).alias("more"))


def progress_eta(attempts: DataFrame) -> DataFrame:
    s = attempts.groupBy("run_id").agg(F.count_if(F.col("outcome") == "ok").alias("completed"), F.count("*").alias("total"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return s.select("run_id", "completed", "total", F.when(F.col("completed") > 0, F.floor((F.col("total") - F.col("completed")) * (F.col("us") / 1000000) / F.col("completed"))).alias("eta_seconds"))
