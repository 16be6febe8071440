"""Response chunks: parsing, assembly, and the same on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import screening

#: What events hold that matters: of all providers' shapes.
EVENT = "choices array<struct<delta:struct<content:string>,finish_reason:string>>, type string, delta struct<text:string>, response string, done string, finished string, content string, text string, message string, bad string"


def parse_chunks(chunks: DataFrame, *more: str) -> DataFrame:
    """stream_id, seq, provider, done, delta, and further columns of the chunks.

    Lines of event streams count when they begin with data: and ollama's lines as they are; blank lines, comments,
    lines that are not JSON and events that carry no text are left out. A stream is done at [DONE], at a finish reason
    (openai), at message_stop (anthropic), at done (ollama), and at done or finished for providers of no known shape,
    whose text is the first of content, text, message and response that there is.
    """
    raw, provider = F.col("raw"), F.col("provider")
    body = F.when(raw.startswith("data: "), F.substr(raw, F.lit(7))).when((provider == "ollama") & (raw != "") & ~raw.startswith(":"), raw)
    rows = chunks.select("stream_id", "seq", "provider", *more, body.alias("body")).where("body is not null")
    j = F.from_json("body", EVENT, {"columnNameOfCorruptRecord": "bad"})
    rows = rows.select("stream_id", "seq", "provider", *more, (F.col("body") == "[DONE]").alias("end"), j.alias("j"))  # each line is parsed once
    first, kind = F.get("j.choices", F.lit(0)), F.coalesce("j.type", F.lit(""))
    is_true = lambda c: F.coalesce(F.col(c) == "true", F.lit(False))
    told = F.col("j").isNotNull() & F.col("j.bad").isNull() & F.when(provider == "openai", first.isNotNull()).when(provider == "anthropic", kind.isin("content_block_delta", "message_stop")).otherwise(True)
    delta = F.when(provider == "openai", first["delta"]["content"]).when(provider == "anthropic", F.when(kind == "content_block_delta", F.col("j.delta.text"))).when(provider == "ollama", F.col("j.response")).otherwise(F.coalesce(*(f"j.{k}" for k in ("content", "text", "message", "response"))))
    done = F.when(provider == "openai", first["finish_reason"].isNotNull()).when(provider == "anthropic", kind == "message_stop").when(provider == "ollama", is_true("j.done")).otherwise(is_true("j.done") | (F.col("j.done").isNull() & is_true("j.finished")))
    return rows.where(F.col("end") | told).select("stream_id", "seq", "provider", *more, (F.col("end") | done).alias("done"), F.when(F.col("end"), "").otherwise(F.coalesce(delta, F.lit(""))).alias("delta"))


def assemble_streams(parsed: DataFrame) -> DataFrame:
    """Text of each stream up to its first done chunk; streams without one are not finished."""
    stop = F.min(F.when(F.col("done"), F.col("seq"))).over(Window.partitionBy("stream_id"))
    kept = parsed.withColumn("stop", stop).where("stop is null or seq <= stop")
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return kept.groupBy("stream_id").agg(F.array_join(parts["delta"], "").alias("content"), F.bool_or("done").alias("finished"), F.count("*").alias("chunks"))


#: The state store that keeps map states and timers.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Assembler(StatefulProcessor):
    """Keeps the chunks of one stream by seq until its time is up, then gives its text once and forgets it."""

    def __init__(self, idle_ms: int, grace_ms: int):
        self.idle, self.grace = idle_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "seq long", "delta string, done boolean")
        self.times = handle.getValueState("times", "newest long, done long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest, done, due = self.times.get() if self.times.exists() else (None, None, None)
        for batch in rows:
            for seq, delta, end, ms in zip(batch["seq"], batch["delta"], batch["done"], batch["ms"], strict=True):
                self.parts.updateValue((int(seq),), (delta, bool(end)))
                newest = int(ms) if newest is None else max(newest, int(ms))
                if end:
                    done = int(ms) if done is None else max(done, int(ms))
        after = done + self.grace if done is not None else newest + self.idle
        if after != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(after)
        self.times.update((newest, done, after))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        text, finished = [], False
        for (_,), (delta, end) in sorted(self.parts.iterator()):
            text.append(delta)
            if end:
                finished = True
                break
        self.parts.clear()
        self.times.clear()
        yield pd.DataFrame({"stream_id": [key[0]], "content": ["".join(text)], "finished": [finished], "chunks": [len(text)]})

    def close(self) -> None:
        pass


def stream_assembly(chunks: DataFrame, late: str = "1 minute", idle: int = 300, grace: int = 60) -> DataFrame:
    """A stream of chunks (stream_id, seq, provider, raw, ts) assembled while it runs: the rows of assemble_streams, each once.

    Chunks are kept in state by seq, so they may come in any order and more than once. A stream is given out when the
    watermark is so many seconds of grace past its done chunk, or idle past its newest chunk without one, as not
    finished. What comes later than the watermark is left out; what comes after a stream was given out begins it anew.
    State holds one stream's chunks by key and is spread by stream. Needs the state store STATE_STORE.
    """
    timed = chunks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    kind = chunks.schema["stream_id"].dataType.simpleString()
    rows = parse_chunks(timed, "at").select("stream_id", "seq", "delta", F.coalesce("done", F.lit(False)).alias("done"), F.unix_millis("at").alias("ms"), "at")
    return rows.groupBy("stream_id").transformWithStateInPandas(_Assembler(idle * 1000, grace * 1000), f"stream_id {kind}, content string, finished boolean, chunks long", "Append", "EventTime")


def stream_calls_per_minute(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests and tokens of each provider in 60 s windows of a stream of calls; later ones than the watermark are left out."""
    w = calls.withWatermark("ts", late).groupBy("provider", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return w.select("provider", F.col("w.start").alias("start"), "requests", "tokens")


def stream_rolling_rate(calls: DataFrame, limit: int = 1000, late: str = "10 minutes", seconds: int = 60, every: int = 10) -> DataFrame:
    """Calls of each account in windows of so many seconds that begin every so many, on a stream or a table, and whether one more exceeds the limit."""
    w = calls.withWatermark("ts", late).groupBy("account", F.window("ts", f"{seconds} seconds", f"{every} seconds").alias("w")).agg(F.count("*").alias("calls"))
    return w.select("account", F.col("w.start").alias("start"), "calls", (F.col("calls") >= limit).alias("exceeds"))


def validated_predictions(predictions: DataFrame, late: str = "1 hour", max_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """A stream of predictions with the reason why one is refused: every refused one, and each (run, instance) of the others once within the watermark.

    Repeats are dropped after validation, so a refused prediction never takes the place of a good one.
    """
    rows = predictions.withWatermark("ts", late).withColumn("reason", screening.first_failure(max_bytes))
    return rows.where("reason is null").dropDuplicatesWithinWatermark(["run_id", "instance_id"]).unionByName(rows.where("reason is not null"))


def stream_predictions(predictions: DataFrame, good: str, bad: str, checkpoint: str, late: str = "1 hour", max_bytes: int = 5 * 1024 * 1024):
    """Starts a stream that appends validated_predictions() as Parquet: good ones to good, refused ones to bad with their reason.

    A batch that is run again after a failure overwrites what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{good}/batch={number}")
        rows.where("reason is not null").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        rows.unpersist()

    return validated_predictions(predictions, late, max_bytes).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_progress(results: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Passed and failed results of each run in windows, on a stream or a table."""
    w = results.withWatermark("ts", late).groupBy("run_id", F.window("ts", every).alias("w")).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return w.select("run_id", F.col("w.start").alias("start"), "passed", "failed", (F.col("passed") * 100 / (F.col("passed") + F.col("failed"))).alias("share"))
