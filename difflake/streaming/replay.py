"""Replays of call logs through limiters and breakers: each account's calls in time order, with the state carried along.

Rows are laid out by account and sorted; a task reads its partition batch by batch and holds the state of one account
only, so an account of any length takes bounded memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SlidingWindow:
    """So many admitted calls in the last seconds at most; refused calls do not count."""

    name = "window"

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds, self.calls = limit, seconds, deque()

    def take(self, now: float, tokens: float) -> float:
        """0 if admitted, else the seconds to wait."""
        while self.calls and now - self.calls[0] >= self.seconds:
            self.calls.popleft()
        if len(self.calls) >= self.limit:
            return self.seconds - (now - self.calls[0])
        self.calls.append(now)
        return 0.0


class TokenBucket:
    """Starts full and refills at a rate up to capacity and burst; a refused call waits for what is lacking."""

    name = "bucket"

    def __init__(self, capacity: float, rate: float, burst: float | None = None):
        self.most, self.rate, self.level, self.at = capacity + (capacity if burst is None else burst), rate, capacity, None

    def take(self, now: float, tokens: float) -> float:
        if self.at is not None:
            self.level = min(self.most, self.level + (now - self.at) * self.rate)
        self.at = now
        if tokens > self.level:
            return (tokens - self.level) / self.rate
        self.level -= tokens
        return 0.0


class Breaker:
    """Opens at the fifth failure since its last reset, lets one call try after a minute, closes on its success."""

    def __init__(self, failures: int = 5, seconds: float = 60.0):
        self.most, self.seconds, self.count, self.state, self.opened = failures, seconds, 0, "closed", 0.0

    def call(self, now: float, failed: bool) -> tuple[bool, str]:
        """Whether the call is rejected, and the state after it."""
        if self.state == "open":
            if now - self.opened < self.seconds:
                return True, "open"
            self.state = "half_open"
        if failed:
            self.count += 1
            if self.state == "half_open" or self.count >= self.most:
                self.state, self.opened = "open", now
        elif self.state == "half_open":
            self.state, self.count = "closed", 0
        return False, self.state


def _replay(log: DataFrame, start: Callable[[], object], step: Callable[[object, float, float, bool], tuple], columns: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = log.select("account", "call_id", seconds.alias("now"), F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens"), F.coalesce("failed", F.lit(False)).alias("failed"))
    names = ["account", "call_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, state = object(), None
        for pdf in batches:
            out = []
            for a, c, now, tokens, failed in zip(*(pdf[x].tolist() for x in ("account", "call_id", "now", "tokens", "failed")), strict=True):
                if a != account:
                    account, state = a, start()
                out.append((a, c, *step(state, now, tokens, failed)))
            yield pd.DataFrame(out, columns=names)

    laid_out = rows.where("account is not null and now is not null").repartition("account").sortWithinPartitions("account", "now", "call_id")
    return laid_out.mapInPandas(run, f"account long, call_id long, {columns}")


def admit(log: DataFrame, *limiters: Callable[[], object]) -> DataFrame:
    """Every call with the wait and the name of the limiter that refused it, if one did.

    Limiters are asked in order; what an earlier one took for a call that a later one refuses stays taken.
    Rows without an account or a time take no part.
    """

    def step(state: list, now: float, tokens: float, failed: bool) -> tuple:
        for limiter in state:
            wait = limiter.take(now, tokens)
            if wait:
                return False, wait, limiter.name
        return True, 0.0, None

    return _replay(log, lambda: [x() for x in limiters], step, "acquired boolean, wait double, limited_by string")


def admit_sliding_window(log: DataFrame, limit: int = 3, seconds: float = 3600.0) -> DataFrame:
    return admit(log, lambda: SlidingWindow(limit, seconds))


def admit_token_bucket(log: DataFrame, capacity: float = 20_000.0, rate: float = 2.0) -> DataFrame:
    return admit(log, lambda: TokenBucket(capacity, rate))


def admit_composite(log: DataFrame, limit: int = 3, seconds: float = 3600.0, capacity: float = 20_000.0, rate: float = 2.0) -> DataFrame:
    return admit(log, lambda: SlidingWindow(limit, seconds), lambda: TokenBucket(capacity, rate))


def breaker_states(log: DataFrame, failures: int = 5, seconds: float = 60.0) -> DataFrame:
    """Every call with whether the breaker of its account rejects it and the state after it."""
    return _replay(log, lambda: Breaker(failures, seconds), lambda b, now, tokens, failed: b.call(now, failed), "rejected boolean, state string")
