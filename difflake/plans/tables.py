"""The library's input tables as projections of the driver's tables.

Each is one SQL text that Spark and DuckDB both read: Spark through spark.sql with DataFrames as arguments, DuckDB as
common table expressions. So both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL, BACKSLASH, QUOTE = "chr(10)", "chr(92)", "chr(34)"

_DIFF = """
SELECT *, 'diff --git a/' || p || ' b/' || p || chr(10) || 'index 1a2b3c4..5d6e7f8 100644' || chr(10) AS git,
       '--- a/' || p || chr(10) || '+++ b/' || p || chr(10) AS head,
       '@@ -1,2 +1,' || CAST(n + 2 AS STRING) || ' @@' || chr(10) || ' def run():' || chr(10) AS hunk,
       '     return 0' || chr(10) AS tail
FROM (SELECT doc_id, source, text, 'src/' || source || '/m' || CAST(doc_id AS STRING) || '.py' AS p,
             '+' || replace(text, chr(10), chr(10) || '+') || chr(10) AS body,
             length(text) - length(replace(text, chr(10), '')) + 1 AS n
      FROM {documents})
"""
_ID = "source || '__' || source || '-' || CAST(doc_id AS STRING)"
_MODEL = "CASE {x} % 7 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4-0613' WHEN 2 THEN 'claude-3-opus' WHEN 3 THEN 'gpt-4o-mini' WHEN 4 THEN 'claude-3-haiku' WHEN 5 THEN 'gpt-3.5-turbo' ELSE 'local-7b' END"
_PROVIDER = "CASE {x} % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'ollama' ELSE 'openrouter' END"


def _model(x: str) -> str:
    return _MODEL.replace("{x}", x)


def _provider(x: str) -> str:
    return _PROVIDER.replace("{x}", x)




def _flat_files(n: int, modulus: int, name: str, contents: list[str]) -> str:
    """SQL of up to n files as one text: records end with chr(30), chr(31) stands between name and content."""
    return " || ".join(f"CASE WHEN doc_id % {modulus} > {i} THEN '{name.format(i=i)}' || chr(31) || {contents[i % len(contents)].format(i=i)} || chr(30) ELSE '' END" for i in range(n))


_LINE1 = "replace(substr(text, 1 + {i} * 7, 90), chr(10), ' ')"
_CODE = ["'import os' || chr(10) || 'class C{i}(Base):' || chr(10) || '    def run(self):' || chr(10) || '        return ' || chr(39) || " + _LINE1 + " || chr(39) || chr(10) || 'def a{i}(x):' || chr(10) || '    pass' || chr(10) || 'def b{i}(x):'", _LINE1 + " || chr(10) || 'x = {i}'", "''", "'# ' || " + _LINE1 + " || chr(10) || '  def only{i}(a, b):' || chr(10) || '    pass'"]
_TESTS = ["'def test_{i}():' || chr(10) || '    assert run() == ' || " + _LINE1, _LINE1 + " || chr(10) || 'ok'", "'Traceback' || chr(10) || '  AssertionError: ' || " + _LINE1 + " || chr(10) || '3 FAILED' || chr(10) || 'an exception'", "''"]
#: name -> (tables of the driver or of this module that it reads, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "diffs": (("documents",), _DIFF),
    "instances": (
        ("documents",),
        f"""SELECT {_ID} AS instance_id, doc_id, source AS repo, text AS problem_statement, md5(CAST(doc_id AS STRING)) AS base_commit,
        CASE WHEN doc_id % 3 = 0 THEN 'see ' || lang || ' docs' ELSE '' END AS hints_text, CAST(doc_id % 5 AS STRING) AS version,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'def test_' || lang || '():' || chr(10) || '    assert run() == 0' END AS test_patch,
        lang FROM {{documents}}""",
    ),
    "flat_instances": (
        ("instances",),
        f"""SELECT i.*, CASE WHEN doc_id % 5 > 1 THEN 'look at ' || lang || chr(30) ELSE '' END || CASE WHEN doc_id % 5 > 2 THEN 'see the log.' || chr(30) || 'and, the rest' || chr(30) ELSE '' END AS hints_flat,
        {_flat_files(7, 9, "tests/test_{i}.py", _TESTS)} AS tests_flat, {_flat_files(14, 15, "pkg/m{i}.py", _CODE)} AS code_flat FROM (SELECT *, problem_statement AS text FROM {{instances}}) i""",
    ),
    "outputs": (
        ("documents",),
        """SELECT CAST(doc_id AS STRING) AS text_id, CASE doc_id % 5 WHEN 0 THEN text
        WHEN 1 THEN text || chr(10) || '  Traceback (most recent call last):' || chr(10) || '    File "a.py", line 3, in f' || chr(10) || chr(10) || '    x = 1' || chr(10) || 'KeyError: x' || chr(10) || 'after'
        WHEN 2 THEN 'Traceback (most recent call last):' || chr(10) || '  File "b.py", line 12' || chr(10) || '    y' || chr(10) || text
        WHEN 3 THEN text || chr(10) || '>  E  assert 1' || chr(10) || 'Expected: 3' || chr(10) || 'Actual: 4' || chr(10) || '2 FAILED' ELSE '' END AS text FROM {documents}""",
    ),
    "failures": (
        ("responses",),
        "SELECT response_id, CASE doc_id % 3 WHEN 0 THEN 'parse_failure' WHEN 1 THEN 'no_changes' ELSE 'hunk ' || provider END AS reason, 'Fix ' || instance_id AS prompt, content FROM {responses}",
    ),
    "predictions": (
        ("diffs",),
        f"""SELECT 'run' || CAST(doc_id % 4 AS STRING) AS run_id, 'p' || CAST(doc_id AS STRING) AS patch_id, {_ID} AS instance_id, {_model("doc_id")} AS model,
        CASE doc_id % 16
        WHEN 0 THEN git || head || hunk || body || tail
        WHEN 1 THEN head || hunk || body || tail
        WHEN 2 THEN git || head || hunk || body || tail || 'diff --git a/README.md b/README.md' || chr(10) || '--- a/README.md' || chr(10) || '+++ b/README.md' || chr(10) || '@@ -3 +3 @@' || chr(10) || '-old title' || chr(10) || '+new title'
        WHEN 3 THEN head || hunk || body || tail || head || '@@ -9,1 +9,1 @@' || chr(10) || '-a' || chr(10) || '+b' || chr(10)
        WHEN 4 THEN git || head || '@@ -1,7 +1,9 @@' || chr(10) || ' def run():' || chr(10) || body || tail
        WHEN 5 THEN 'diff --git a/' || p || chr(10) || head || hunk || body || tail
        WHEN 6 THEN replace(git || head || hunk || body || tail, chr(10), chr(13) || chr(10))
        WHEN 7 THEN git || head || '@@ -1,2 +1,' || CAST(n + 40 AS STRING) || ' @@' || chr(10) || ' def run():' || chr(10) || '+' || replace(text, chr(10), chr(10) || '+')
        WHEN 8 THEN git || head || '@@ -1,1 +1,1 @@' || chr(10) || ' unchanged' || chr(10) || hunk || body || tail
        WHEN 9 THEN git || head || '@@ -1,' || CAST(n AS STRING) || ' +0,0 @@' || chr(10) || '-' || replace(text, chr(10), chr(10) || '-')
        WHEN 10 THEN git || head || hunk || '+# caf' || chr(233) || chr(10) || body || tail
        WHEN 11 THEN git || head || hunk || '+<<<<<<< HEAD' || chr(10) || body || '+>>>>>>> main' || chr(10) || tail
        WHEN 12 THEN hunk || body || tail
        WHEN 13 THEN git || 'index zz' || chr(10) || head || hunk || chr(92) || ' No newline at end of file' || chr(10) || chr(92) || ' No newline at end of file' || chr(10) || body || tail
        WHEN 14 THEN git || head || hunk || body || '*stray' || chr(10) || '@@ broken @@' || chr(10) || tail || '--- a/x' || chr(10) || 'nothing' || chr(10) || '--- a/last.bin'
        ELSE '' END AS patch, doc_id FROM {{diffs}}""",
    ),
    "responses": (
        ("diffs",),
        f"""SELECT 'r' || CAST(doc_id AS STRING) AS response_id, {_ID} AS instance_id, {_provider("doc_id")} AS provider, {_model("doc_id")} AS model,
        CASE doc_id % 8
        WHEN 0 THEN 'Here is the fix:' || chr(10) || '```diff' || chr(10) || head || hunk || body || tail || '```' || chr(10) || 'Done.'
        WHEN 1 THEN 'Fix' || chr(10) || '```patch' || chr(10) || git || head || hunk || body || tail || '```'
        WHEN 2 THEN 'Code' || chr(10) || '```' || chr(10) || head || hunk || body || tail || '```'
        WHEN 3 THEN 'I changed it.' || chr(10) || git || head || hunk || body || tail || 'That is all.'
        WHEN 4 THEN 'As asked' || chr(10) || head || hunk || body || tail || 'End of the patch'
        WHEN 5 THEN '<file>' || p || '</file>' || chr(10) || '<old>' || chr(10) || text || chr(10) || '</old>' || chr(10) || '<new>' || chr(10) || text || chr(10) || 'more' || chr(10) || '</new>'
        WHEN 6 THEN 'In ' || p || chr(10) || 'SEARCH:' || chr(10) || 'old line' || chr(10) || 'REPLACE:' || chr(10) || replace(text, chr(10), ' ') || chr(10) || chr(10) || 'SEARCH:' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'REPLACE:' || chr(10) || 'd'
        ELSE 'In file ' || p || ', change "return 0" to "return 1".' || chr(10) || text END AS content,
        length(text) AS prompt_tokens, CAST(floor(length(text) / 4) AS BIGINT) AS completion_tokens, CAST(doc_id % 5000 AS BIGINT) AS latency_ms, doc_id FROM {{diffs}}""",
    ),
    "usage": (
        ("lineitem",),
        f"""SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS call_id, 'run' || CAST(l_orderkey % 8 AS STRING) AS run_id, {_provider("l_partkey")} AS provider, {_model("l_suppkey")} AS model,
        CAST(l_quantity * 1000 AS BIGINT) AS prompt_tokens, CAST(floor(l_extendedprice / 10) AS BIGINT) AS completion_tokens, CAST(l_orderkey % 9000 AS BIGINT) AS latency_ms, l_shipdate AS ts FROM {{lineitem}}""",
    ),
    "results": (
        ("orders",),
        """SELECT o_orderpriority AS run_id, 'repo' || CAST(o_custkey % 20 AS STRING) || '__pkg-' || CAST(o_custkey AS STRING) AS instance_id, o_orderstatus = 'F' AS passed,
        CASE o_orderstatus WHEN 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'AssertionError: values differ' WHEN 1 THEN 'patch does not apply: context mismatch' WHEN 2 THEN 'ImportError: no module' ELSE 'timed out after 30 minutes' END WHEN 'P' THEN 'Docker daemon not running' END AS error,
        o_orderdate AS ts, o_orderkey AS seq, CAST(floor(o_totalprice / 100) AS BIGINT) AS seconds, 'model' || CAST(o_orderkey % 4 AS STRING) AS model FROM {orders}""",
    ),
    "attempts": (
        ("orders",),
        f"""SELECT o_orderpriority AS run_id, 'repo' || CAST(o_custkey % 20 AS STRING) || '__pkg-' || CAST(o_custkey AS STRING) AS instance_id, {_provider("o_orderkey")} AS provider, o_orderkey AS seq,
        CASE o_orderkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'skipped' ELSE 'ok' END WHEN 2 THEN 'parse_failure' WHEN 3 THEN 'token_limit' WHEN 4 THEN 'provider_error' ELSE 'unexpected' END AS outcome,
        CASE o_orderkey % 6 WHEN 2 THEN 'No patch found in response' WHEN 3 THEN 'Token limit exceeded' WHEN 4 THEN 'Rate limit reached, retry later' WHEN 5 THEN 'KeyError: ' || o_orderstatus END AS error,
        CAST(round(o_totalprice) AS BIGINT) AS micro_usd, o_orderdate AS ts FROM {{orders}}""",
    ),
    "call_log": (
        ("events",),
        """SELECT event_id AS call_id, event_type AS provider, user_id AS account, ts, value, event_type = 'error' OR event_id % 11 = 0 AS failed, CASE WHEN event_id % 4 = 0 THEN 'anthropic' ELSE 'openai' END AS api, CASE WHEN event_id % 18 = 5 THEN CAST(event_id % 90 AS DOUBLE) END AS retry_after,
        CAST(floor(value * 100) AS BIGINT) AS tokens, props,
        CASE event_id % 9 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 400 WHEN 4 THEN 400 WHEN 5 THEN 429 WHEN 6 THEN 503 WHEN 7 THEN 422 ELSE 200 END AS status,
        CASE event_id % 9 WHEN 1 THEN 'You exceeded your billing quota' WHEN 2 THEN 'Model ''m' || CAST(user_id AS STRING) || ''' not found' WHEN 3 THEN 'maximum context length is ' || CAST(4096 + user_id AS STRING) || ' but you requested ' || CAST(user_id * 7 AS STRING) || ' tokens'
        WHEN 4 THEN 'max_tokens is an invalid parameter' WHEN 5 THEN 'Rate limit reached for tokens per min' WHEN 6 THEN 'overloaded' ELSE 'other' END AS message FROM {events}""",
    ),
    "chunks": (
        ("conversations",),
        """SELECT conv_id AS stream_id, turn AS seq, provider, CASE WHEN turn % 5 = 4 AND conv_id % 3 = 0 THEN 'data: [DONE]' WHEN turn % 7 = 6 THEN ': keep-alive' WHEN (conv_id + turn) % 13 = 12 THEN 'data: {{"choices":[' WHEN (conv_id + turn) % 17 = 16 THEN '' WHEN (conv_id + turn) % 19 = 18 THEN 'event: x'
        WHEN provider = 'openai' THEN 'data: {{"choices":[' || CASE WHEN turn % 11 = 10 THEN '' ELSE '{{"delta":{{"content":"' || esc || '"}},"finish_reason":' || CASE WHEN turn % 6 = 4 THEN '"stop"' ELSE 'null' END || '}}' END || ']}}'
        WHEN provider = 'anthropic' THEN 'data: {{"type":"' || CASE (conv_id + turn) % 8 WHEN 0 THEN 'ping' WHEN 1 THEN 'message_stop' WHEN 2 THEN 'message_start' ELSE 'content_block_delta' END || '","delta":{{"text":"' || esc || '"}}}}'
        WHEN provider = 'ollama' THEN '{{"response":"' || esc || '","done":' || CASE WHEN turn % 2 = 0 THEN 'false' ELSE 'true' END || '}}'
        ELSE 'data: {{"' || CASE turn % 4 WHEN 0 THEN 'content' WHEN 1 THEN 'text' WHEN 2 THEN 'message' ELSE 'response' END || '":"' || esc || '"' || CASE WHEN turn % 6 = 5 THEN ',"finished":true' WHEN turn % 6 = 3 THEN ',"done":true' ELSE '' END || '}}' END AS raw
        FROM (SELECT *, CASE WHEN conv_id % 4 = 3 THEN 'other' WHEN role = 'user' THEN 'openai' WHEN role = 'assistant' THEN 'anthropic' ELSE 'ollama' END AS provider, replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n') AS esc FROM {conversations})""",
    ),
    "gateway_models": (
        ("part",),
        """SELECT p_partkey AS pos, '{{"id":"' || lower(replace(p_brand, '#', '-')) || CASE p_partkey % 5 WHEN 0 THEN '-code' WHEN 1 THEN '-chat' ELSE '' END || '-m' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '-2024-' || lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0') || '-1' || CAST(p_partkey % 10 AS STRING) ELSE '' END
        || '","context_length":' || CAST(p_size * 1000 AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ',"created":' || CAST(1700000000 + p_partkey % 500 * 86400 AS STRING) END || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE ',"pricing":{{"prompt":"0.0000' || CAST(10 + p_size AS STRING) || '","completion":"0.000' || CAST(10 + p_partkey % 90 AS STRING) || '"}}' END || '}}' AS raw FROM {part}""",
    ),
    "harness_reports": (
        ("predictions",),
        """SELECT run_id, '{{' || string_agg('"' || instance_id || '":{{"resolved":' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || CASE WHEN doc_id % 3 = 1 THEN ',"error":"tests failed"' ELSE '' END || '}}', ',') || '}}' AS report
        FROM {predictions} WHERE doc_id % 10 <> 0 GROUP BY run_id, CAST(floor(doc_id / 200) AS BIGINT)""",
    ),
    "logs": (
        ("documents",),
        f"""SELECT 'logs/' || source || '/' || CAST(doc_id AS STRING) || '.log' AS path, {_ID} AS instance_id, text || chr(10) || CASE doc_id % 3 WHEN 0 THEN '5 ran successfully, 0 failed' WHEN 1 THEN 'All instances run.' ELSE 'stopped' END || chr(10) || 'end' AS content FROM {{documents}}""",
    ),
    "build_logs": (
        ("documents",),
        """SELECT 'logs/' || source || '/' || CAST(doc_id AS STRING) || '.log' AS path, 'building base image' || chr(10) || text || chr(10) || 'Building environment image' || chr(10) || 'git clone x' || chr(10) || 'pip install y' || chr(10) || 'ok' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN 'error' ELSE 'Successfully built z' END AS content FROM {documents}""",
    ),
    "customers": (("customer",), "SELECT 'repo' || CAST(c_custkey % 20 AS STRING) || '__pkg-' || CAST(c_custkey AS STRING) AS instance_id FROM {customer}"),
    "limit_headers": (
        ("call_log",),
        """SELECT call_id, provider, ts, CASE call_id % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"anthropic-ratelimit-requests-remaining":"' || CAST(account AS STRING) || '","anthropic-ratelimit-tokens-limit":"50000","anthropic-ratelimit-tokens-remaining":"x","anthropic-ratelimit-tokens-reset":"2024-01-01T00:00:' || CAST(10 + account % 50 AS STRING) || 'Z"}}'
        ELSE '{{"x-ratelimit-limit-requests":"1000","x-ratelimit-remaining-requests":"' || CAST(account % 1000 AS STRING) || '","x-ratelimit-reset-requests":"' || CAST(account % 60 AS STRING) || 's","x-ratelimit-limit-tokens":"40000","x-ratelimit-remaining-tokens":"' || CAST(tokens AS STRING) || '"}}' END AS headers FROM {call_log}""",
    ),
    "limit_readings": (
        ("call_log",),
        """SELECT call_id, provider, ts, account, tokens, CASE WHEN call_id % 5 = 0 THEN '{{}}'
        WHEN call_id % 2 = 1 THEN '{{"anthropic-ratelimit-requests-limit":"2000","anthropic-ratelimit-requests-remaining":"' || CAST(account % 1000 AS STRING) || '","anthropic-ratelimit-tokens-limit":"40000","anthropic-ratelimit-tokens-remaining":"' || CAST(least(tokens, 50000) AS STRING) || '"}}'
        ELSE '{{"x-ratelimit-limit-requests":"1000","x-ratelimit-remaining-requests":"' || CAST(account % 1000 AS STRING) || '","x-ratelimit-limit-tokens":"40000","x-ratelimit-remaining-tokens":"' || CAST(least(tokens, 50000) AS STRING) || '"}}' END AS headers FROM {call_log}""",
    ),
    "requests": (("responses",), "SELECT response_id, model, CASE doc_id % 11 WHEN 0 THEN ' ' ELSE content END AS prompt, CAST(doc_id % 25 AS DOUBLE) / 10 AS temperature, doc_id % 4000 - 50 AS max_tokens FROM {responses}"),
    "full_requests": (
        ("responses",),
        "SELECT response_id, provider, CASE WHEN doc_id % 9 = 0 THEN 'gpt-5-mini' ELSE model END AS model, 'Mend ' || instance_id AS prompt, CASE WHEN doc_id % 2 = 0 THEN 'You mend code.' ELSE '' END AS system, CAST(doc_id % 25 AS DOUBLE) / 10 AS temperature, doc_id % 4000 - 50 AS max_tokens, false AS stream FROM {responses}",
    ),
    "harness_days": (("results",), "SELECT run_id, day, count(*) AS total, sum(CASE WHEN passed THEN 1 ELSE 0 END) AS done FROM (SELECT *, CAST(floor(seq / 100) AS BIGINT) AS day FROM {results}) GROUP BY run_id, day"),
    "raw_responses": (
        ("responses",),
        """SELECT response_id, provider, model, latency_ms - 7 AS latency_ms, CASE provider WHEN 'anthropic' THEN '{{"content":[{{"type":"text","text":"' || md5(content) || '"}}],"stop_reason":"end_turn","usage":{{"input_tokens":' || CAST(prompt_tokens AS STRING) || ',"output_tokens":' || CAST(completion_tokens AS STRING) || '}}}}'
        WHEN 'ollama' THEN '{{"response":"' || md5(content) || '","done_reason":"stop","prompt_eval_count":' || CAST(prompt_tokens AS STRING) || CASE WHEN doc_id % 8 = 2 THEN ',"total_duration":' || CAST(doc_id * 1000 AS STRING) || '999' ELSE '' END || '}}'
        ELSE '{{"choices":[{{"message":{{"content":"' || md5(content) || '"}},"finish_reason":"length"}}]' || CASE WHEN provider = 'openrouter' AND doc_id % 3 = 0 THEN ',"model":"vendor/m' || CAST(doc_id % 10 AS STRING) || '"' ELSE '' END || ',"usage":{{"prompt_tokens":' || CAST(prompt_tokens AS STRING) || ',"completion_tokens":' || CAST(completion_tokens AS STRING) || '}}}}' END AS raw, doc_id FROM {responses}""",
    ),
    "prediction_lines": (
        ("documents",),
        f"""SELECT doc_id AS line_no, CASE doc_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN '{{{{"instance_id":"' || {_ID} || '"' WHEN 2 THEN '{{{{"instance_id":"' || {_ID} || '"}}}}' ELSE '{{{{"instance_id":"' || {_ID} || '","patch":"' || md5(text) || chr(92) || 'n"}}}}' END AS value FROM {{documents}}""",
    ),
}
#: Catalogue of models (position, name, context limit, price per million tokens in and out; null: unknown).
MODELS = [
    (1, "gpt-4-turbo-preview", 128000, None, None),
    (2, "gpt-4-turbo", 128000, 10.0, 30.0),
    (3, "gpt-4", 8192, 30.0, 60.0),
    (4, "gpt-4-32k", 32768, None, None),
    (5, "gpt-3.5-turbo", 16385, 0.5, 1.5),
    (6, "gpt-3.5-turbo-16k", 16385, None, None),
    (7, "gpt-4o", 128000, 5.0, 15.0),
    (8, "gpt-4o-mini", 128000, 0.15, 0.6),
    (9, "anthropic/claude-3-opus", 200000, None, None),
    (10, "anthropic/claude-3-sonnet", 200000, None, None),
    (11, "anthropic/claude-3-haiku", 200000, None, None),
    (12, "anthropic/claude-2.1", 200000, None, None),
    (13, "anthropic/claude-2", 100000, None, None),
    (14, "claude-3-opus", 200000, 15.0, 75.0),
    (15, "claude-3-sonnet", 200000, 3.0, 15.0),
    (16, "claude-3-haiku", 200000, 0.25, 1.25),
    (17, "claude-2.1", 200000, None, None),
    (18, "claude-2", 100000, None, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or one made of them."""
    if name == "models":
        return spark.createDataFrame(MODELS, "pos int, model string, context_limit long, input_per_m double, output_per_m double")
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = TABLES[name]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in needs})


def ctes(*names: str, more: str = "") -> str:
    """WITH clause for DuckDB that defines the named tables and what they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name == "models":
            rows = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in MODELS)
            done.setdefault(name, f"models(pos, model, context_limit, input_per_m, output_per_m) AS (VALUES {rows})")
        elif name in TABLES and name not in done:
            needs, sql = TABLES[name]
            for n in needs:
                add(n)
            done[name] = f"{name} AS ({sql.format(**{n: n for n in needs})})"

    for n in names:
        add(n)
    parts = [*done.values(), *([more] if more else [])]
    return "WITH " + ",\n".join(parts) + "\n"
