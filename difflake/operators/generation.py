"""Generation runs and harness output: checkpoints, joins with reports, logs, and headers of rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import before, ranged

#: Phases of a build with the words that begin them, in order of rank.
PHASES = [
    ("base", "building base image", "from --platform"),
    ("env", "building environment image", "conda activate"),
    ("repo", "git clone", "cloning"),
    ("deps", "pip install", "installing"),
    ("instance", "building instance", "setup_repo.sh"),
    ("complete", "successfully built", "successfully tagged"),
]
REPORT = "map<string,struct<resolved:boolean,error:string>>"


def resume_batch(instances: DataFrame, attempts: DataFrame, max_tries: int = 2) -> DataFrame:
    """Instances still to do: neither completed nor failed so often that they may not be tried again."""
    ended = attempts.groupBy("instance_id").agg(F.bool_or(F.col("outcome") == "ok").alias("ok"), F.count("*").alias("tries")).where(F.col("ok") | (F.col("tries") >= max_tries))
    return instances.join(ended, "instance_id", "left_anti").select("instance_id")


def update_checkpoint(old: DataFrame, new: DataFrame) -> DataFrame:
    """One state for each (run, instance): completed once it ever was, else the last failure; skipped attempts are none."""
    both = old.unionByName(new).where("outcome <> 'skipped'").withColumn("ok", F.col("outcome") == "ok")
    last = F.max_by(F.struct("error", "ts"), F.struct("ts", "seq"))
    s = both.groupBy("run_id", "instance_id").agg(F.bool_or("ok").alias("ok"), last.alias("last"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("done"))
    return s.select("run_id", "instance_id", F.when(F.col("ok"), "completed").otherwise("failed").alias("state"), F.when(~F.col("ok"), F.col("last.error")).alias("error"), F.when(F.col("ok"), F.col("done")).otherwise(F.col("last.ts")).alias("ts"))


def join_harness_results(predictions: DataFrame, reports: DataFrame) -> DataFrame:
    """Verdict of each prediction by the harness's reports, objects keyed by instance; one that they lack failed."""
    r = reports.select("run_id", F.explode(F.from_json("report", REPORT)).alias("instance_id", "r")).select("run_id", "instance_id", "r")
    passed = F.coalesce("r.resolved", F.lit(False))
    return predictions.join(r, ["run_id", "instance_id"], "left").select("patch_id", passed.alias("passed"), F.when(F.col("r").isNull(), "not found in results").when(~passed, F.col("r.error")).alias("error"))


def evaluation_progress(predictions: DataFrame, reports: DataFrame) -> DataFrame:
    """Evaluated, missing and selected instances of each run, and the share that is done with."""
    j = join_harness_results(predictions, reports).join(predictions.select("patch_id", "run_id", "patch"), "patch_id")
    gone = (F.col("patch").isNull()) | (F.col("patch") == "")
    found = ~gone & ~F.col("error").eqNullSafe(F.lit("not found in results"))
    out = j.groupBy("run_id").agg(F.count_if(found).alias("evaluated"), F.count_if(gone).alias("missing"), F.count("*").alias("selected"))
    return out.withColumn("share", (F.col("evaluated") + F.col("missing")) * 100 / F.col("selected"))


def load_log_lines(logs: DataFrame) -> DataFrame:
    return logs.select("path", "instance_id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).select("path", "instance_id", (F.col("pos") + 1).alias("line_no"), "line")


def log_tail(logs: DataFrame, n: int = 40) -> DataFrame:
    lines = F.split("content", "\n", -1)
    return logs.select("path", F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), n), "\n").alias("tail"))


def log_success(logs: DataFrame, n: int = 200) -> DataFrame:
    """Whether the end of the log says that all instances ran."""
    tail = F.lower("tail")
    return log_tail(logs, n).select("path", (tail.contains("ran successfully, 0 failed") | tail.contains("all instances run.")).alias("passed"))


def running_content(parsed: DataFrame) -> DataFrame:
    """Where the content of a stream ends at each chunk: stream_id, seq, content_end (characters so far); no text is copied.

    Chunks are dealt to ranges of (stream, seq) whose lengths are summed up, so a long stream is many tasks' work.
    """
    parts = ranged(parsed.select("stream_id", "seq", F.length("delta").cast("long").alias("n")), "stream_id", "seq")
    sums = parts.groupBy("stream_id", "part").agg(F.sum("n").alias("sum"))
    offsets = sums.select("stream_id", "part", before(sums, ["stream_id"], F.col("sum")).alias("offset"))
    so_far = F.sum("n").over(Window.partitionBy("stream_id", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(offsets, ["stream_id", "part"]).select("stream_id", "seq", (F.col("offset") + so_far).alias("content_end"))


def content_so_far(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """The text of each stream up to each of the given ends (stream_id, seq, content_end), from one row of text (stream_id, content) for each stream."""
    return ends.join(texts, "stream_id").select("stream_id", "seq", F.substr("content", F.lit(1), F.col("content_end").cast("int")).alias("content"))


def running_text(parsed: DataFrame) -> DataFrame:
    """The whole content of a stream so far at each chunk: stream_id, seq, content. Null is a stream too, a null seq comes last, chunks of one seq go by their text.

    Chunks are dealt to ranges of (stream, seq), so a long stream is many tasks' work. A stream's chunks of a range are
    one row, to which the text of the stream's ranges before it is joined (merged, as such texts can be too large to
    send whole); contents are made of the two at the very end, so only what is returned grows with the square of the
    chunks.
    """
    parts = ranged(parsed.select(F.struct("stream_id").alias("stream"), "seq", "delta"), "stream", F.col("seq").asc_nulls_last())
    chunks = F.array_sort(F.collect_list(F.struct(F.col("seq").isNull().alias("last"), "seq", "delta")))
    own = parts.groupBy("stream", "part").agg(chunks.alias("chunks")).select("stream", "part", F.col("chunks.seq").alias("seqs"), F.col("chunks.delta").alias("deltas"))
    wide = parts.groupBy("stream").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last").select("stream")
    so_far = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    text = own.join(F.broadcast(wide), "stream", "left_semi").select("stream", "part", F.array_join("deltas", "").alias("text"))  # fewer streams than ranges
    before = text.select("stream", "part", F.array_join(F.collect_list("text").over(so_far), "").alias("earlier"))
    rows = own.join(before.hint("merge"), ["stream", "part"], "left").select("stream", "deltas", F.coalesce("earlier", F.lit("")).alias("earlier"), F.posexplode("seqs").alias("pos", "seq"))
    return rows.select("stream.stream_id", "seq", F.concat("earlier", F.array_join(F.slice("deltas", 1, F.col("pos") + 1), "")).alias("content"))


def rate_limit_headers(calls: DataFrame, *more: str) -> DataFrame:
    """Limits, what is left of them and when they are full again, by either family of header names; numbers that are not whole are null. Further columns of the calls may be kept."""
    h = calls.select("call_id", "provider", *more, F.from_json("headers", "map<string,string>").alias("h"))

    def number(of: str, what: str) -> F.Column:
        return F.coalesce(F.try_element_at("h", F.lit(f"x-ratelimit-{what}-{of}")), F.try_element_at("h", F.lit(f"anthropic-ratelimit-{of}-{what}"))).try_cast("long")

    def reset(of: str) -> F.Column:
        return F.coalesce(F.try_element_at("h", F.lit(f"x-ratelimit-reset-{of}")), F.try_element_at("h", F.lit(f"anthropic-ratelimit-{of}-reset")))

    return h.select("call_id", "provider", *more, *(reset(of).alias(f"{of}_reset") for of in ("requests", "tokens")), *(number(of, what).alias(f"{of}_{what}") for of in ("requests", "tokens") for what in ("limit", "remaining")))


def validate_requests(requests: DataFrame, models: DataFrame) -> DataFrame:
    """First failing rule of each request: empty prompt, temperature, max_tokens, unknown model, over the limit."""
    known = models.select("model", "context_limit")
    r = requests.join(F.broadcast(known), "model", "left")  # the catalogue is a fixed table
    prompt, limit = F.col("prompt"), F.col("context_limit")
    reason = (
        F.when(prompt.isNull() | ~prompt.rlike(r"[^ \t-\r]"), "empty_prompt")
        .when((F.col("temperature") < 0) | (F.col("temperature") > 2), "temperature")
        .when(F.col("max_tokens") < 1, "max_tokens")
        .when(limit.isNull(), "unknown_model")
        .when(F.floor(F.length(prompt) / 4) + F.col("max_tokens") > limit, "over_limit")
    )
    return r.select("response_id", reason.alias("reason"))


def unify_responses(raw: DataFrame) -> DataFrame:
    """Three shapes of raw responses in one: content, finish reason, tokens, latency and model.

    Latency is never negative; a local provider's own duration in nanoseconds goes before what was measured. Rows of a
    gateway keep the model that the response names, by which they are priced.
    """
    at = lambda path: F.get_json_object("raw", path)
    pick = lambda first, second, third: F.when(F.col("provider") == "anthropic", at(second)).when(F.col("provider") == "ollama", at(third)).otherwise(at(first))
    number = lambda *p: F.coalesce(pick(*p).try_cast("long"), F.lit(0))
    own = F.floor(F.when(F.col("provider") == "ollama", at("$.total_duration").try_cast("long")) / 1_000_000)
    latency = F.when(own > 0, own).otherwise(F.greatest(F.lit(0), F.coalesce("latency_ms", F.lit(0))))
    model = F.when(F.col("provider") == "openrouter", F.coalesce(at("$.model"), "model")).otherwise(F.col("model"))
    r = raw.select(
        "response_id", "provider", model.alias("model"), latency.cast("long").alias("latency_ms"), F.coalesce(pick("$.choices[0].message.content", "$.content[0].text", "$.response"), F.lit("")).alias("content"), pick("$.choices[0].finish_reason", "$.stop_reason", "$.done_reason").alias("reason"),
        number("$.usage.prompt_tokens", "$.usage.input_tokens", "$.prompt_eval_count").alias("prompt_tokens"), number("$.usage.completion_tokens", "$.usage.output_tokens", "$.eval_count").alias("completion_tokens"))
    return r.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def load_predictions(lines: DataFrame, max_bytes: int = 5 * 1024 * 1024, *more: str) -> DataFrame:
    """JSON lines to predictions, with the reason why a line is not one: further columns, line_no, instance_id, patch, reason. Blank lines are left out."""
    j = F.from_json("value", "instance_id string, patch string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    r = lines.where(F.col("value").rlike(r"[^ \t-\r]")).select(*more, "line_no", j.alias("j")).select(*more, "line_no", "j.*")
    reason = F.when(F.col("_corrupt").isNotNull(), "bad_json").when(F.col("instance_id").isNull() | F.col("patch").isNull(), "missing_key").when(F.octet_length("patch") > max_bytes, "too_large")
    return r.select(*more, "line_no", "instance_id", "patch", reason.alias("reason"))


def build_phases(logs: DataFrame) -> DataFrame:
    """First line and number of lines of each phase of a log; a line without words of a phase belongs to the last one."""
    lines = logs.select("path", F.posexplode(F.transform(F.split("content", "\n", -1), F.lower)).alias("pos", "l"))
    begins = F.coalesce(*(F.when(F.col("l").contains(a) | F.col("l").contains(b), p) for p, a, b in PHASES))
    so_far = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("phase", F.last(begins, ignorenulls=True).over(so_far)).where("phase is not null").groupBy("path", "phase").agg((F.min("pos") + 1).alias("first_line"), F.count("*").alias("n_lines"))
