"""Chunks of every shape, and streams against batches."""

import json

from difflake.streaming import chunks

DIFF = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"


def test_chunk_shapes(spark):
    openai = lambda text, end=None: "data: " + json.dumps({"choices": [{"delta": {"content": text}, "finish_reason": end}]})
    claude = lambda kind, text="": "data: " + json.dumps({"type": kind, "delta": {"text": text}})
    other = lambda **x: "data: " + json.dumps(x)
    streams = {
        "openai": [": hi", "", "event: x", openai("a"), 'data: {"choices": []}', "data: {broken", openai("b", "stop"), openai("late")],
        "anthropic": [claude("message_start", "no"), claude("content_block_delta", "a"), claude("ping"), claude("content_block_delta", "b"), claude("message_stop"), claude("content_block_delta", "late")],
        "ollama": [json.dumps({"response": "a", "done": False}), "{broken", json.dumps({"response": "b", "done": True}), json.dumps({"response": "late", "done": False})],
        "other": [other(text="a", done=False), other(content="b", text="no"), other(message="c"), other(response="d", finished=True), other(text="late")],
        "done": [other(text="a"), "data: [DONE]", other(text="late")],
        "open": [other(text="a"), other(text="b", done=False, finished=True)],
    }
    rows = [(k, i, k if k in ("openai", "anthropic", "ollama") else "other", raw) for k, lines in streams.items() for i, raw in enumerate(lines)]
    parsed = chunks.parse_chunks(spark.createDataFrame(rows, "stream_id string, seq long, provider string, raw string"))
    got = {r["stream_id"]: (r["content"], r["finished"], r["chunks"]) for r in chunks.assemble_streams(parsed).collect()}
    assert got == {"openai": ("ab", True, 2), "anthropic": ("ab", True, 3), "ollama": ("ab", True, 2), "other": ("abcd", True, 4), "done": ("a", True, 2), "open": ("ab", False, 2)}


def test_stream_predictions_keep_one_of_repeats_and_set_bad_ones_apart(spark, tmp_path):
    schema = "run_id string, instance_id string, patch string, ts timestamp"
    source, good, bad, mark = (str(tmp_path / x) for x in ("in", "good", "bad", "mark"))

    def arrive(*rows):
        spark.createDataFrame([(*r, None) for r in rows], "run_id string, instance_id string, patch string, at string").selectExpr("run_id", "instance_id", "patch", "timestamp'2024-01-01 00:00:00' as ts").coalesce(1).write.mode("append").parquet(source)
        chunks.stream_predictions(spark.readStream.schema(schema).parquet(source), good, bad, mark).awaitTermination()
        read = lambda p: sorted((r["run_id"], r["instance_id"]) for r in spark.read.parquet(p).collect())
        return read(good), read(bad)

    assert arrive(("r", "a", DIFF), ("r", "a", DIFF), ("r", "b", "words"), ("r", "", DIFF), ("s", "a", DIFF)) == ([("r", "a"), ("s", "a")], [("r", ""), ("r", "b")])
    assert arrive(("r", "a", DIFF), ("r", "c", DIFF)) == ([("r", "a"), ("r", "c"), ("s", "a")], [("r", ""), ("r", "b")])
    assert {r["reason"] for r in spark.read.parquet(bad).collect()} == {"empty_id", "not_a_diff"}


def test_a_refused_prediction_does_not_hide_a_good_one(spark, tmp_path):
    schema = "run_id string, instance_id string, patch string, ts timestamp"
    source, good, bad, mark = (str(tmp_path / x) for x in ("in", "good", "bad", "mark"))
    for k, patch in enumerate(["rubbish", "rubbish", DIFF, "rubbish", DIFF]):
        spark.sql("select 'r' as run_id, 'a' as instance_id, :p as patch, timestamp_seconds(1700000000 + :k) as ts", args={"p": patch, "k": k}).write.mode("append").parquet(source)
        chunks.stream_predictions(spark.readStream.schema(schema).parquet(source), good, bad, mark).awaitTermination()
    assert spark.read.parquet(good).count() == 1 and spark.read.parquet(bad).count() == 3


def test_stream_assembly_equals_batch(spark, tmp_path):
    """Chunks late, repeated and out of order, over batches and a restart from the checkpoint."""
    source, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    schema = "stream_id string, seq long, provider string, raw string, ts timestamp"
    line = lambda text, **x: "data: " + json.dumps({"text": text, **x})
    before = spark.conf.get(chunks.STATE_STORE[0])
    spark.conf.set(*chunks.STATE_STORE)
    written = []

    def arrive(*rows):
        written.extend(rows)
        spark.createDataFrame([(s, q, "other", raw, t) for s, q, raw, t in rows], "stream_id string, seq long, provider string, raw string, t long").selectExpr("stream_id", "seq", "provider", "raw", "timestamp_seconds(1700000000 + t) as ts").coalesce(1).write.mode("append").parquet(source)
        rows_in = spark.readStream.schema(schema).parquet(source)
        chunks.stream_assembly(rows_in, "10 seconds", idle=60, grace=20).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {r["stream_id"]: (r["content"], r["finished"], r["chunks"]) for r in spark.read.schema("stream_id string, content string, finished boolean, chunks long").parquet(out).collect()}

    try:
        assert arrive(("a", 2, line("c", done=True), 3), ("a", 0, line("a"), 1), ("b", 0, line("x"), 1), ("b", 0, line("x"), 1)) == {}
        assert arrive(("a", 1, line("b"), 2), ("a", 2, line("c", done=True), 3), ("b", 5, line("z"), 9), ("a", 3, line("after"), 4)) == {}
        assert arrive(("b", 3, line("y"), 8), ("c", 0, ": comment", 30), ("c", 1, line("1"), 31)) == {}
        assert arrive(("d", 0, line("open"), 45)) == {"a": ("abc", True, 3)}  # the watermark is at 35, past 3 + 20
        whole = {"a": ("abc", True, 3), "b": ("xyz", False, 3), "c": ("1", False, 1), "d": ("open!", True, 2)}
        assert arrive(("z", 0, line("", done=True), 200), ("d", 1, line("!", done=True), 60)) == whole  # the watermark is at 190
        got = arrive(("b", 9, line("too late"), 70), ("z", 1, line("y"), 201))
        assert got == whole
    finally:
        spark.conf.set(chunks.STATE_STORE[0], before)
    batch = spark.createDataFrame([(s, q, "other", raw) for s, q, raw, _ in set(written) if raw != line("too late")], "stream_id string, seq long, provider string, raw string")
    want = {r["stream_id"]: (r["content"], r["finished"], r["chunks"]) for r in chunks.assemble_streams(chunks.parse_chunks(batch)).collect()}
    assert {k: v for k, v in want.items() if k != "z"} == got


def test_stream_rolling_rate_equals_batch(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 3 as account", "timestamp_seconds(1700000000 + id * 7 - (id % 5) * 11) as ts")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = chunks.stream_rolling_rate(stream, 3, "1 day").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows_of = lambda df: sorted(map(str, df.collect()))
    assert rows_of(spark.table("rates")) == rows_of(chunks.stream_rolling_rate(rows, 3))


def test_stream_progress_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("concat('r', id % 3) as run_id", "id % 4 = 0 as passed", "timestamp_seconds(1700000000 + id * 97) as ts")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = chunks.stream_progress(stream, "1 day").writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows_of = lambda df: sorted(map(str, df.collect()))
    assert rows_of(spark.table("progress")) == rows_of(chunks.stream_progress(rows))
