"""Accounts over time: rates, concurrency, streaks and shares of limits, with any account spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import before, ranged


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def rolling_rate(log: DataFrame, limit: int = 1000, seconds: int = 60, spans: int = 16) -> DataFrame:
    """Calls of the account in the time before each call, whether one more exceeds the limit, and the wait until it does not.

    An account is cut into ranges of so many spans of time. Calls of a range's last span are also dealt to the next
    range, as its halo, where they are counted but have no row. So a task holds no more than a range of an account.
    """
    span = seconds * 1_000_000
    width = span * spans
    at = F.col("at")
    own = F.floor(at / F.lit(width)).cast("long")  # microseconds are whole numbers below 2^53
    late = F.pmod(at, F.lit(width)) >= width - span
    places = F.array_compact(F.array(F.struct(own.alias("range"), F.lit(False).alias("halo")), F.when(late, F.struct((own + 1).alias("range"), F.lit(True).alias("halo")))))
    dealt = log.select("call_id", "account", micros("ts").alias("at")).select("*", F.inline(places))
    w = Window.partitionBy("account", "range").orderBy("at").rangeBetween(-span, -1)
    rows = dealt.withColumns({"before": F.count("*").over(w), "oldest": F.min("at").over(w)}).where(~F.col("halo"))
    exceeds = F.col("before") >= limit
    return rows.select("call_id", "before", exceeds.alias("exceeds"), F.when(exceeds, span - (at - F.col("oldest"))).alias("wait_us"))


def peak_concurrency(log: DataFrame, limit: int = 3) -> DataFrame:
    """Most calls of an account at once, and whether they were over the limit: a call lasts value minutes, and ends before others start at the same time.

    Starts and ends are dealt to ranges of (account, time). A range is summed up as (change, highest prefix); the peak
    is the highest sum of the changes of the ranges before and a range's own prefix.
    """
    start = micros("ts")
    events = log.select("account", start.alias("at"), F.lit(1).alias("step")).union(log.select("account", start + (F.col("value") * 60_000_000).cast("long"), F.lit(-1)))
    parts = ranged(events, "account", "at", "step")
    so_far = F.sum("step").over(Window.partitionBy("account", "part").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    sums = parts.withColumn("so_far", so_far).groupBy("account", "part").agg(F.sum("step").alias("change"), F.max("so_far").alias("highest"))
    peaks = sums.select("account", (before(sums, ["account"], F.col("change")) + F.col("highest")).alias("active"))
    return peaks.groupBy("account").agg(F.max("active").alias("peak"), (F.max("active") > limit).alias("over"))


def failure_streaks(log: DataFrame) -> DataFrame:
    """Longest run of failures of each account that has any, by time and call.

    Calls are dealt to ranges of (account, time, call). A range is summed up as the failures before its first success,
    after its last one, and the longest run between two; a range without a success is one run. Runs that meet at the
    ends of ranges are added up: those between the same two ranges with successes.
    """
    parts = ranged(log.select("account", "ts", "call_id", "failed"), "account", "ts", "call_id")
    w = Window.partitionBy("account", "part").orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = parts.withColumn("run", F.count_if(~F.col("failed")).over(w)).groupBy("account", "part", "run").agg(F.count_if("failed").alias("n"))
    first, last = F.col("run") == 0, F.col("run") == F.col("last")
    runs = runs.withColumn("last", F.max("run").over(Window.partitionBy("account", "part")))
    sums = runs.groupBy("account", "part").agg(F.max("last").alias("successes"), F.sum(F.when(first, F.col("n")).otherwise(0)).alias("lead"), F.sum(F.when(last, F.col("n")).otherwise(0)).alias("trail"), F.max("n").alias("longest"))
    broken = F.col("successes") > 0
    gap = before(sums, ["account"], broken.cast("long"))  # so many ranges with a success are before
    sums = sums.withColumn("gap", gap)
    ends = F.array(F.struct(F.col("gap").alias("gap"), F.col("lead").alias("n")), F.struct(F.when(broken, F.col("gap") + 1).alias("gap"), F.col("trail").alias("n")))
    joined = sums.select("account", F.inline(ends)).where("gap is not null").groupBy("account", "gap").agg(F.sum("n").alias("n"))
    best = joined.select("account", "n").union(sums.select("account", "longest"))
    return best.groupBy("account").agg(F.max("n").alias("longest")).where("longest > 0")


def limit_usage(headers: DataFrame) -> DataFrame:
    """Of each provider, day and kind of limit: mean_used (share of the limit in use, weighted by how long it stood so), lowest_left (least share left, in millionths), lowest_call and lowest_at (when that was first seen), readings.

    headers: provider, call_id, ts and <kind>_limit and <kind>_remaining for requests and tokens, as rate_limit_headers
    gives them. A reading stands until the next one, over midnight too; readings without a limit or a rest say nothing.
    Each day is cut off by itself: it starts with the last reading of the days before it, which come as one row a day.
    """
    day_us = 86_400_000_000
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_limit").alias("most"), F.col(f"{k}_remaining").alias("rest")) for k in ("requests", "tokens")))
    rows = headers.select("provider", "call_id", micros("ts").alias("at"), F.inline(kinds)).where("most > 0 and rest is not null")
    left = F.least(F.lit(1_000_000), F.greatest(F.lit(0), F.expr("rest * 1000000 div most")))
    rows = rows.select("provider", "kind", "call_id", "at", left.alias("left"), F.expr(f"at div {day_us}").alias("day"))
    key = ["provider", "kind"]
    ends = rows.groupBy(*key, "day").agg(F.max_by("left", F.struct("at", "call_id")).alias("last"))
    carried = ends.select(*key, "day", F.lag("last").over(Window.partitionBy(*key).orderBy("day")).alias("carried"))
    carried = carried.where("carried is not null").select(*key, F.lit(None).cast("long").alias("call_id"), (F.col("day") * day_us).alias("at"), F.col("carried").alias("left"), "day")
    w = Window.partitionBy(*key, "day").orderBy("at", F.col("call_id").asc_nulls_first())
    until = F.coalesce(F.lead("at").over(w), (F.col("day") + 1) * day_us)
    steps = rows.unionByName(carried).withColumn("stood", until - F.col("at"))
    seen = F.col("call_id").isNotNull()
    order = F.when(seen, F.struct("left", "at", "call_id"))
    out = steps.groupBy(*key, "day").agg(
        F.sum(F.col("stood") * (1_000_000 - F.col("left"))).alias("used"), F.sum("stood").alias("stood"), F.min(F.when(seen, F.col("left"))).alias("lowest_left"),
        F.min_by("call_id", order).alias("lowest_call"), F.min_by("at", order).alias("lowest_at"), F.count("call_id").alias("readings"))
    return out.select(*key, F.date_from_unix_date(F.col("day").cast("int")).alias("day"), F.when(F.col("stood") > 0, F.col("used") / F.col("stood") / 1_000_000).alias("mean_used"), "lowest_left", "lowest_call", F.timestamp_micros("lowest_at").cast("timestamp_ntz").alias("lowest_at"), "readings")
