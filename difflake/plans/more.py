"""Queries over responses, catalogues, checkpoints, reports, logs and replays."""

from __future__ import annotations

from ..operators import catalogue, extraction, generation, timelines
from ..streaming import chunks as ch
from ..streaming import replay
from .diffs import QUERIES
from .diffs import prediction_query as q
from .runs import _PARSED
from .tables import table

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOREIGN = r"regexp_matches(x, '[^ \t-\r]') AND NOT regexp_matches(x, '^(?:[ +\-@\\]|diff|index|new file|deleted)')"
_CUT = f"rtrim(array_to_string(l[1:coalesce(nullif(list_position(list_transform(l, lambda x: {{stop}}), true), 0), len(l) + 1) - 1], chr(10)), {_WS})"
_GIT_STOP = _FOREIGN + " AND NOT regexp_matches(x, '^(?:Author:|Date:|commit [a-f0-9]+)')"
_HEADERS = r"'(?m)^--- [^\n]*\n\+\+\+ '"
_COUNT = "(length(patch) - length(replace(patch, '{m}', ''))) // 3"
_CANDIDATES = rf"""git AS (SELECT response_id, 1 AS "order", 'git' AS format, patch, (95 - CASE WHEN contains(patch, '@@') THEN 0 ELSE 30 END) / 100 AS confidence FROM (SELECT response_id, {_CUT.replace("{stop}", _GIT_STOP)} AS patch FROM (SELECT response_id, string_split(substr(content, strpos(content, 'diff --git')), chr(10)) AS l FROM responses WHERE contains(content, 'diff --git')))),
unified AS (SELECT response_id, 3 AS "order", 'unified' AS format, patch, (90 - CASE WHEN contains(patch, '@@') THEN 0 ELSE 30 END - CASE WHEN {_COUNT.replace("{m}", "---")} <> {_COUNT.replace("{m}", "+++")} THEN 20 ELSE 0 END) / 100 AS confidence
  FROM (SELECT response_id, {_CUT.replace("{stop}", _FOREIGN)} AS patch FROM (SELECT response_id, string_split(substr(content, strpos(content, '--- ')), chr(10)) AS l FROM responses WHERE NOT contains(content, 'diff --git') AND NOT contains(content, '```diff') AND NOT contains(content, '```patch') AND regexp_matches(content, {_HEADERS})))),
fenced AS (SELECT response_id, 2 AS "order", 'fenced' AS format, patch, (base + CASE WHEN base = 60 THEN 0 WHEN regexp_matches(patch, {_HEADERS}) THEN 10 WHEN contains(patch, 'diff --git') THEN 15 ELSE 0 END) / 100 AS confidence FROM (
  SELECT response_id, CASE WHEN d THEN 80 WHEN p THEN 75 WHEN plain IS NOT NULL THEN 60 END AS base, trim(CASE WHEN d THEN regexp_extract(content, '(?s)```diff\n(.*?)```', 1) WHEN p THEN regexp_extract(content, '(?s)```patch\n(.*?)```', 1) ELSE plain END, {_WS}) AS patch
  FROM (SELECT *, regexp_matches(content, '(?s)```diff\n.*?```') AS d, regexp_matches(content, '(?s)```patch\n.*?```') AS p, list_filter(regexp_extract_all(content, '(?s)```\n(.*?)```', 1), lambda x: regexp_matches(x, {_HEADERS}) OR contains(x, 'diff --git'))[1] AS plain FROM responses)) WHERE base IS NOT NULL),
candidates AS (SELECT * FROM git UNION ALL SELECT * FROM fenced UNION ALL SELECT * FROM unified)"""


def f(name: str, sql: str):
    return q(name, sql, "responses", more=_CANDIDATES)


f("extract_git_diff", "SELECT * FROM git")(extraction.extract_git_diff)
f("extract_unified_diff", "SELECT * FROM unified")(extraction.extract_unified_diff)
f("extract_fenced", "SELECT * FROM fenced")(extraction.extract_fenced)
_KINDS = ", ".join(f"len(regexp_extract_all(content, $${p}$$))::INTEGER AS {k}" for k, p in extraction.INSTRUCTIONS.items())
f("detect_edit_instructions", f"SELECT * FROM (SELECT response_id, regexp_extract(content, $${extraction.EDITED}$$, 1) AS path, {_KINDS}, 0.3::DOUBLE AS confidence FROM responses) WHERE path <> '' AND changes + replacements + additions + deletions > 0")(extraction.detect_edit_instructions)
_SIDE = f"string_split(trim(x, {_WS}), chr(10))"
_LED = "array_to_string(list_transform({side}, lambda y: '{mark}' || y), chr(10))"
_O, _N = _SIDE.replace("(x,", "(old[i],"), _SIDE.replace("(x,", "(new[i],")
f(
    "extract_search_replace",
    f"""SELECT response_id, 5 AS "order", 'search_replace' AS format, array_to_string(list_transform(range(1, len(old) + 1), lambda i: '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,' || len({_O}) || ' +1,' || len({_N}) || ' @@' || chr(10) || {_LED.format(side=_O, mark="-")} || chr(10) || {_LED.format(side=_N, mark="+")}), chr(10)) AS patch, CASE WHEN path = 'unknown_file.py' THEN 0.4 ELSE 0.6 END::DOUBLE AS confidence
FROM (SELECT response_id, coalesce(nullif(regexp_extract(content, $${extraction.NAMED}$$, 1), ''), 'unknown_file.py') AS path, regexp_extract_all(content, $${extraction.PAIR}$$, 1) AS old, regexp_extract_all(content, $${extraction.PAIR}$$, 2) AS new FROM responses) WHERE len(old) > 0""",
)(extraction.extract_search_replace)
QUERIES["extract_file_blocks"] = lambda spark, sf_dir: extraction.extract_file_blocks(table(spark, sf_dir, "responses"))
f("candidate_formats", "SELECT model, format, count(*) AS n, sum(CAST(round(confidence * 100) AS BIGINT))::BIGINT AS hundredths FROM candidates JOIN responses USING (response_id) GROUP BY ALL")(extraction.candidate_formats)
_LINE = f"""list_transform(list_transform(string_split(patch, chr(10)), lambda x: rtrim(x, {_WS})), lambda x: CASE WHEN starts_with(x, '--- ') THEN '--- ' || CASE WHEN starts_with(regexp_replace(substr(x, 5), '^"|"$', '', 'g'), 'a/') THEN regexp_replace(substr(x, 5), '^"|"$', '', 'g') ELSE 'a/' || ltrim(regexp_replace(substr(x, 5), '^"|"$', '', 'g'), '/') END
WHEN starts_with(x, '+++ ') THEN '+++ ' || CASE WHEN starts_with(regexp_replace(substr(x, 5), '^"|"$', '', 'g'), 'b/') THEN regexp_replace(substr(x, 5), '^"|"$', '', 'g') ELSE 'b/' || ltrim(regexp_replace(substr(x, 5), '^"|"$', '', 'g'), '/') END ELSE x END)"""
q("normalize_patch", f"SELECT patch_id, rtrim(array_to_string({_LINE}, chr(10)), chr(10)) || chr(10) AS patch FROM predictions")(extraction.normalize_patches)
QUERIES["extract_patches"] = lambda spark, sf_dir: extraction.extract_patches(table(spark, sf_dir, "responses"))
QUERIES["extraction_report"] = lambda spark, sf_dir: extraction.extraction_report(extraction.extract_patches(table(spark, sf_dir, "responses")))
QUERIES["emit_valid_patches"] = lambda spark, sf_dir: extraction.emit_valid_patches(table(spark, sf_dir, "responses"))

_PRICES = ", ".join(f"('{p}', '{m}', {round(i * 100)}, {round(o * 100)})" for p, m, i, o in catalogue.PRICES)
_BASE = ", ".join(f"('{p}', {round(i * 100)}, {round(o * 100)})" for p, (i, o) in catalogue.DEFAULTS.items())
q("provider_cost", "SELECT call_id, provider, model, CAST(prompt_tokens * coalesce(p.i, b.i) + completion_tokens * coalesce(p.o, b.o) AS BIGINT) AS cost_e8 FROM usage LEFT JOIN prices p USING (provider, model) LEFT JOIN base b USING (provider)", "usage", more=f"prices(provider, model, i, o) AS (VALUES {_PRICES}), base(provider, i, o) AS (VALUES {_BASE})")(catalogue.provider_cost)
q("estimate_batch_cost", "SELECT repo, count(*) AS n, count(*) * 2000000 AS least_e8, count(*) * 4000000 AS most_e8 FROM instances GROUP BY 1", "instances", "models")(catalogue.estimate_batch_cost)
q("estimate_batch_cost_by_row", r"SELECT count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(t * 500 + 1000 * 1500) AS BIGINT) AS cost_e8 FROM (SELECT CAST(floor(len(regexp_extract_all(problem_statement, '[^\x20\x09-\x0D]+')) * 13 / 10) + floor(len(regexp_extract_all(test_patch, '[^\x20\x09-\x0D]+')) * 13 / 10) + 200 AS BIGINT) AS t FROM instances)", "instances", "models")(catalogue.estimate_batch_cost_by_row)
q("estimate_batch_time", "SELECT repo, count(*) * 30 / 5 AS seconds FROM instances GROUP BY 1", "instances")(catalogue.estimate_batch_time)

_LISTED = """listed AS (SELECT * FROM (SELECT pos, json_extract_string(raw, '$.id') AS id, CAST(json_extract(raw, '$.context_length') AS BIGINT) AS context_length, CAST(json_extract(raw, '$.created') AS BIGINT) AS created, TRY_CAST(json_extract_string(raw, '$.pricing.prompt') AS DOUBLE) AS i, TRY_CAST(json_extract_string(raw, '$.pricing.completion') AS DOUBLE) AS o FROM gateway_models) WHERE i IS NOT NULL),
code AS (SELECT * FROM listed WHERE regexp_matches(lower(id), 'code|instruct|chat|gpt|claude|gemini|mixtral|llama|deepseek|phind|nous'))"""


def g(name: str, sql: str):
    return q(name, sql, "gateway_models", more=_LISTED)


g("gateway_prices", "SELECT pos, id, i * 1000 AS input_per_k, o * 1000 AS output_per_k FROM listed")(catalogue.gateway_prices)
g("code_models", "SELECT pos, id, context_length FROM code")(lambda m: catalogue.code_models(m).drop("pricing"))
g("cheapest_model", "SELECT coalesce(arg_min(id, (i + o, pos)), 'none') AS id FROM code WHERE context_length >= 16000")(lambda m: catalogue.cheapest_model(m, 16_000, "none"))
g("rank_models_by_recency", r"SELECT pos, id, coalesce(created // 86400, epoch(TRY_CAST(nullif(regexp_extract(id, '(?:^|-)(\d{4}-\d{2}-\d{2})(?:-|$)', 1), '') AS DATE)) // 86400)::BIGINT AS day FROM listed")(catalogue.rank_models_by_recency)

q("resume_batch", "SELECT instance_id FROM customers WHERE instance_id NOT IN (SELECT instance_id FROM attempts GROUP BY 1 HAVING bool_or(outcome = 'ok') OR count(*) >= 2)", "customers", "attempts")(generation.resume_batch)
q("update_checkpoint", "SELECT run_id, instance_id, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS state, CASE WHEN NOT ok THEN error END AS error, CASE WHEN ok THEN done ELSE last END AS ts FROM (SELECT run_id, instance_id, bool_or(outcome = 'ok') AS ok, arg_max(error, (ts, seq)) AS error, max(ts) AS last, max(CASE WHEN outcome = 'ok' THEN ts END) AS done FROM attempts WHERE outcome <> 'skipped' GROUP BY ALL)", "attempts")(lambda a: generation.update_checkpoint(a.where("seq % 2 = 0"), a.where("seq % 2 = 1")))
_JUDGED = "judged AS (SELECT *, doc_id % 10 <> 0 AS found, doc_id % 10 <> 0 AND doc_id % 3 = 0 AS passed FROM predictions)"
q("join_harness_results", "SELECT patch_id, passed, CASE WHEN NOT found THEN 'not found in results' WHEN NOT passed AND doc_id % 3 = 1 THEN 'tests failed' END AS error FROM judged", "predictions", "harness_reports", more=_JUDGED)(generation.join_harness_results)
q("evaluation_progress", "SELECT *, (evaluated + missing) * 100 / selected AS share FROM (SELECT run_id, count_if(patch <> '' AND found)::BIGINT AS evaluated, count_if(patch = '')::BIGINT AS missing, count(*) AS selected FROM judged GROUP BY 1)", "predictions", "harness_reports", more=_JUDGED)(generation.evaluation_progress)
q("load_log_lines", "SELECT path, instance_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT path, instance_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT *, string_split(content, chr(10)) AS l FROM logs))", "logs")(generation.load_log_lines)
q("log_tail", "SELECT path, array_to_string(l[greatest(1, len(l) - 39):], chr(10)) AS tail FROM (SELECT *, string_split(content, chr(10)) AS l FROM logs)", "logs")(generation.log_tail)
_PHASE = "CASE " + " ".join(f"WHEN contains(l, '{a}') OR contains(l, '{b}') THEN '{p}'" for p, a, b in generation.PHASES) + " END"
q(
    "build_phases",
    f"""SELECT path, phase, CAST(min(line_no) AS INTEGER) AS first_line, count(*) AS n_lines FROM (SELECT path, line_no, last_value({_PHASE} IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS phase
FROM (SELECT path, unnest(range(1, len(x) + 1)) AS line_no, lower(unnest(x)) AS l FROM (SELECT path, string_split(content, chr(10)) AS x FROM build_logs))) WHERE phase IS NOT NULL GROUP BY ALL""",
    "build_logs",
)(generation.build_phases)
q("log_success", "SELECT path, contains(tail, 'ran successfully, 0 failed') OR contains(tail, 'all instances run.') AS passed FROM (SELECT path, lower(array_to_string(l[greatest(1, len(l) - 199):], chr(10))) AS tail FROM (SELECT *, string_split(content, chr(10)) AS l FROM logs))", "logs")(generation.log_success)
q("running_content", "SELECT stream_id, seq, string_agg(delta, '') OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS content FROM parsed", "chunks", more=_PARSED)(lambda x: generation.running_text(ch.parse_chunks(x)))
_HEAD = "TRY_CAST(coalesce(json_extract_string(headers, '$.\"x-ratelimit-{w}-{o}\"'), json_extract_string(headers, '$.\"anthropic-ratelimit-{o}-{w}\"')) AS BIGINT) AS {o}_{w}"
_RESET = "coalesce(json_extract_string(headers, '$.\"x-ratelimit-reset-{o}\"'), json_extract_string(headers, '$.\"anthropic-ratelimit-{o}-reset\"')) AS {o}_reset"
q("rate_limit_headers", "SELECT call_id, provider, " + ", ".join(_RESET.format(o=o) for o in ("requests", "tokens")) + ", " + ", ".join(_HEAD.format(o=o, w=w) for o in ("requests", "tokens") for w in ("limit", "remaining")) + " FROM limit_headers", "limit_headers")(generation.rate_limit_headers)
_STEPS = """steps AS (SELECT *, epoch_us(ts) // 86400000000 AS day, least(1000000, greatest(0, rest * 1000000 // most)) AS left_over FROM (
  SELECT provider, call_id, ts, 'requests' AS kind, 1000 * (1 + call_id % 2) AS most, account % 1000 AS rest FROM limit_readings WHERE call_id % 5 <> 0
  UNION ALL SELECT provider, call_id, ts, 'tokens', 40000, least(tokens, 50000) FROM limit_readings WHERE call_id % 5 <> 0)),
days AS (SELECT provider, kind, day, lag(arg_max(left_over, (ts, call_id))) OVER (PARTITION BY provider, kind ORDER BY day) AS carried FROM steps GROUP BY provider, kind, day),
held AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY provider, kind, day ORDER BY us, call_id NULLS FIRST), (day + 1) * 86400000000) - us AS stood FROM (
  SELECT provider, kind, day, call_id, ts, epoch_us(ts) AS us, left_over FROM steps UNION ALL SELECT provider, kind, day, NULL, NULL, day * 86400000000, carried FROM days WHERE carried IS NOT NULL))"""
q(
    "limit_usage",
    """SELECT provider, kind, DATE '1970-01-01' + day::INTEGER AS day, CASE WHEN sum(stood) > 0 THEN sum(stood * (1000000 - left_over))::BIGINT / sum(stood)::BIGINT / 1000000 END AS mean_used, min(CASE WHEN call_id IS NOT NULL THEN left_over END) AS lowest_left,
(min((left_over, us, call_id)) FILTER (call_id IS NOT NULL))[3] AS lowest_call, arg_min(ts, (left_over, us, call_id)) FILTER (call_id IS NOT NULL) AS lowest_at, count(call_id) AS readings FROM held GROUP BY ALL""",
    "limit_readings",
    more=_STEPS,
)(lambda x: timelines.limit_usage(generation.rate_limit_headers(x, "ts")))
q(
    "validate_requests",
    r"SELECT response_id, CASE WHEN NOT regexp_matches(prompt, '[^ \t-\r]') THEN 'empty_prompt' WHEN temperature < 0 OR temperature > 2 THEN 'temperature' WHEN max_tokens < 1 THEN 'max_tokens' WHEN context_limit IS NULL THEN 'unknown_model' WHEN floor(length(prompt) / 4) + max_tokens > context_limit THEN 'over_limit' END AS reason FROM requests LEFT JOIN models USING (model)",
    "requests",
    "models",
)(generation.validate_requests)
q("unify_responses", "SELECT *, prompt_tokens + completion_tokens AS total_tokens FROM (SELECT response_id, provider, CASE WHEN provider = 'openrouter' AND doc_id % 3 = 0 THEN 'vendor/m' || doc_id % 10 ELSE model END AS model, CASE WHEN provider = 'ollama' AND doc_id % 8 = 2 AND doc_id * 1000999 // 1000 // 1000 > 0 THEN (doc_id * 1000000 + 999) // 1000000 ELSE greatest(0, latency_ms - 7) END::BIGINT AS latency_ms, md5(content) AS content, CASE provider WHEN 'anthropic' THEN 'end_turn' WHEN 'ollama' THEN 'stop' ELSE 'length' END AS reason, prompt_tokens::BIGINT AS prompt_tokens, CASE WHEN provider = 'ollama' THEN 0 ELSE completion_tokens END::BIGINT AS completion_tokens FROM responses)", "responses", "raw_responses")(lambda _, raw: generation.unify_responses(raw))
q("load_predictions", "SELECT line_no, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.instance_id') END AS instance_id, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.patch') END AS patch, CASE WHEN NOT json_valid(value) THEN 'bad_json' WHEN line_no % 7 = 2 THEN 'missing_key' END AS reason FROM prediction_lines WHERE value <> ' '", "prediction_lines")(generation.load_predictions)

for _name in ("admit_sliding_window", "admit_token_bucket", "admit_composite", "breaker_states"):
    QUERIES[_name] = lambda spark, sf_dir, run=getattr(replay, _name): run(table(spark, sf_dir, "call_log"))
