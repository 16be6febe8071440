"""Queries over contexts of instances, prompts and token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import budgets, contexts, prompts
from .diffs import QUERIES, SQL
from .diffs import prediction_query as q
from .tables import ctes, table

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SPLIT = "list_transform(list_filter(string_split({c}, chr(30)), lambda x: x <> ''), lambda x: {{'name': string_split(x, chr(31))[1], 'content': string_split(x, chr(31))[2]}})"
_FULL = "list_filter({f}, lambda f: f.content <> '')"
_TOKENS = "(length({x}) * 11 + (length({x}) - length(replace(replace(replace({x}, chr(10), ''), '.', ''), ',', ''))) * 20) // 40"
_CTX = f"""raw AS (SELECT *, list_filter(string_split(hints_flat, chr(30)), lambda x: x <> '') AS hl, {_SPLIT.format(c="tests_flat")} AS tf, {_SPLIT.format(c="code_flat")} AS cf FROM flat_instances),
ctx AS (SELECT instance_id, repo, base_commit, 'You mend code.' AS system_prompt, '' AS user_prompt, problem_statement, CASE WHEN hints_text <> '' THEN [hints_text] || hl ELSE hl END AS hints,
  CASE WHEN test_patch <> '' THEN [{{'name': 'test_patch', 'content': test_patch}}] || ({_FULL.format(f="tf")})[1:4] ELSE ({_FULL.format(f="tf")})[1:5] END AS tests, ({_FULL.format(f="cf")})[1:10] AS code FROM raw)"""


def instances_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = lambda c: F.transform(F.filter(F.split(c, chr(30), -1), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(chr(31)), F.lit(1)).alias("name"), F.split_part(x, F.lit(chr(31)), F.lit(2)).alias("content")))
    flat = table(spark, sf_dir, "flat_instances")
    return flat.select("instance_id", "repo", "base_commit", "problem_statement", "hints_text", "test_patch", F.filter(F.split("hints_flat", chr(30), -1), lambda x: x != "").alias("hints"), files("tests_flat").alias("test_files"), files("code_flat").alias("code_files"))


def x(name: str, sql: str):
    """Registers a query over contexts, with its SQL over ctx."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(contexts.build_contexts(instances_with_files(spark, sf_dir), "You mend code."))
        if sql:
            SQL[name] = ctes("flat_instances", more=_CTX) + sql

    return register


def _flat(c: DataFrame) -> DataFrame:
    """Arrays of files as texts, to compare."""
    files = lambda name: F.array_join(F.transform(name, lambda f: F.concat(f["name"], F.lit("="), f["content"])), "|")
    return c.select("instance_id", "problem_statement", F.array_join("hints", "|").alias("hints"), files("code").alias("code"), files("tests").alias("tests"))


_FILES = "array_to_string(list_transform({f}, lambda f: f.name || '=' || f.content), '|')"
_FLAT = f"SELECT instance_id, problem_statement, array_to_string(hints, '|') AS hints, {_FILES.format(f='code')} AS code, {_FILES.format(f='tests')} AS tests FROM "
x("build_contexts", _FLAT + "ctx")(_flat)
_T = lambda e: _TOKENS.format(x=e)
_SUM = "coalesce(list_sum(list_transform({f}, lambda f: {e})), 0)::BIGINT"
_SECTION = f"{_T('system_prompt')} AS system_prompt, {_T('user_prompt')} AS user_prompt, {_T('problem_statement')} AS problem_statement, {_SUM.format(f='code', e=_T('f.content'))} AS code, {_SUM.format(f='tests', e=_T('f.content'))} AS tests, {_SUM.format(f='hints', e=_T('f'))} AS hints"
x("section_tokens", f"SELECT instance_id, {_SECTION} FROM ctx")(contexts.section_tokens)
x("context_length", f"SELECT instance_id, length(system_prompt) + length(user_prompt) + length(problem_statement) + {_SUM.format(f='code', e='length(f.content)')} + {_SUM.format(f='tests', e='length(f.content)')} + {_SUM.format(f='hints', e='length(f)')} AS length FROM ctx")(contexts.context_length)
_FENCED = "array_to_string(list_transform({f}, lambda f: '#### ' || f.name || chr(10) || '```python' || chr(10) || f.content || chr(10) || '```' || chr(10)), chr(10))"
x(
    "build_cot_prompts",
    f"""SELECT instance_id, concat_ws(chr(10), 'Step 1: the problem in ' || repo, problem_statement, '', CASE WHEN len(tests) > 0 THEN 'Step 2: the failing tests' || chr(10) || {_FENCED.format(f="tests")} || chr(10) || 'What do they expect?' || chr(10) END,
CASE WHEN len(code) > 0 THEN 'Step 3: the code' || chr(10) || {_FENCED.format(f="code")} || chr(10) || 'What makes them fail?' || chr(10) END, 'Step 4: plan the smallest change.', '', 'Step 5: write it as a unified diff.') AS prompt FROM ctx""",
)(contexts.build_cot_prompts)
_CODE_ORDER = "list_sort(list_transform(code, lambda f: {'o': NOT contains(lower(f.name), 'test'), 'n': length(f.content), 'name': f.name, 'content': f.content}))"
_TEST_ORDER = "list_sort(list_transform(tests, lambda f: {'n': length(f.content), 'name': f.name, 'content': f.content}))"
_PART = "greatest(1, CAST(floor(len({c}) * 0.7) AS BIGINT))"
x("reduce_contexts", _FLAT.replace("problem_statement,", "md5(problem_statement) AS problem_statement,") + f"(SELECT instance_id, problem_statement, hints[1:{_PART.format(c='hints')}] AS hints, ({_CODE_ORDER})[1:{_PART.format(c='code')}] AS code, ({_TEST_ORDER})[1:{_PART.format(c='tests')}] AS tests FROM ctx WHERE len(string_split(problem_statement, chr(10))) <= 1400)")(
    lambda c: _flat(contexts.reduce_contexts(c.where(F.size(contexts.lines_of(F.col("problem_statement"))) <= 1400))).withColumn("problem_statement", F.md5("problem_statement"))
)
_BAD = "list_filter(string_split(f.content, chr(10)), lambda l: regexp_matches(lower(l), 'error|fail|assert|exception'))"
x("summarize_tests", f"SELECT instance_id, array_to_string((list_transform(tests, lambda f: f.name || ': ' || CASE WHEN len({_BAD}) > 0 THEN trim(({_BAD})[1], {_STRIP}) || CASE WHEN len({_BAD}) > 1 THEN ' (+' || (len({_BAD}) - 1) || ' more)' ELSE '' END ELSE 'Test failures' END))[1:5], chr(10)) AS summary FROM ctx")(contexts.summarize_tests)
_NAMES = f"list_transform(list_filter(list_transform(string_split(f.content, chr(10)), lambda l: trim(l, {_STRIP})), lambda l: regexp_matches(l, '^(?:class |def )')), lambda l: string_split(l, '(')[1])"
x("summarize_code", f"SELECT instance_id, array_to_string(list_transform(code[1:3], lambda f: f.name || ': ' || CASE WHEN len({_NAMES}) > 0 THEN array_to_string(({_NAMES})[1:3], ', ') || CASE WHEN len({_NAMES}) > 3 THEN ' (+' || (len({_NAMES}) - 3) || ' more)' ELSE '' END ELSE len(string_split(f.content, chr(10))) || ' lines' END), chr(10)) AS summary FROM ctx")(contexts.summarize_code)
x("pack_files", "")(lambda c: contexts.context_length(c.drop("code").join(budgets.pack_files(c, 60), "instance_id")))
x("fit_contexts", "")(lambda c: budgets.fit_contexts(c, 1600).withColumn("removed", F.to_json("removed")))
_BASIC = """concat_ws(chr(10), 'Fix this issue in ' || coalesce(repo, 'the repository') || ':', '', 'Problem: ' || coalesce(problem_statement, ''), '', 'Instance ID: ' || instance_id, CASE WHEN hints_text <> '' THEN chr(10) || 'Additional Context:' || chr(10) || hints_text END,
CASE WHEN test_patch <> '' THEN chr(10) || 'The following test shows the issue:' || chr(10) || '```diff' || chr(10) || test_patch || chr(10) || '```' END, '', 'Answer with a unified diff only, as small as can be.')"""
q("build_basic_prompts", f"SELECT instance_id, {_BASIC} AS prompt FROM instances", "instances")(contexts.build_basic_prompts)
_BLANK = r"NOT regexp_matches(x, '[^ \t-\r]')"
_OPTIONAL = "regexp_matches(x, '^(?:Additional Context:|The following test)')"
q(
    "reduce_prompts",
    f"""SELECT instance_id, CASE WHEN length(problem) > 1000 THEN array_to_string(l[1:first] || [substr(problem, 1, CAST(floor(length(problem) * 0.8) AS BIGINT)) || chr(10) || '... (truncated)'] || l[stop:], chr(10)) ELSE rest END AS prompt
FROM (SELECT *, array_to_string(l[first + 1:stop - 1], chr(10)) AS problem FROM (SELECT *, coalesce((SELECT min(i) FROM (SELECT unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i) WHERE i > first AND ({_BLANK} OR regexp_matches(x, '^(?:Instance ID:|Additional Context:|The following test)'))), len(l) + 1) AS stop,
  (SELECT coalesce(string_agg(x, chr(10) ORDER BY i), '') FROM (SELECT x, i, _opt, coalesce(last_value(CASE WHEN _opt THEN true WHEN _blank THEN false END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS off FROM (SELECT x, i, {_OPTIONAL} AS _opt, {_BLANK} AS _blank FROM (SELECT unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i))) WHERE NOT off AND NOT _opt) AS rest
FROM (SELECT *, list_position(list_transform(l, lambda x: starts_with(x, 'Problem:')), true) AS first FROM (SELECT instance_id, string_split(prompt, chr(10)) AS l FROM p))))""",
    "instances",
    more=f"p AS (SELECT instance_id, {_BASIC} AS prompt FROM instances)",
)(lambda i: contexts.reduce_prompts(contexts.build_basic_prompts(i)))
q(
    "retry_prompts",
    """SELECT response_id, CASE WHEN reason = 'parse_failure' THEN 'The response could not be read as a unified diff.' || chr(10) || 'It was:' || chr(10) || '```' || chr(10) || substr(content, 1, 1000) || chr(10) || CASE WHEN length(content) > 1000 THEN '...' ELSE '' END || chr(10) || '```' || chr(10) || 'Answer with a unified diff only.'
WHEN reason = 'no_changes' THEN 'The patch changes nothing.' || chr(10) || 'Answer with lines that start with + or -.' ELSE 'The response was refused: ' || reason || chr(10) || 'Answer with a valid unified diff.' END || chr(10) || chr(10) || 'Task:' || chr(10) || prompt AS prompt FROM failures""",
    "failures",
)(contexts.retry_prompts)
_PATTERN = r"""AssertionError:|FAILED|ERROR|Traceback|File "[^\n]*", line \d+|Expected:|Actual:|\s+E\s+"""
q(
    "error_context",
    rf"""SELECT text_id, coalesce((SELECT string_agg(x, chr(10) ORDER BY i) FROM (SELECT x, i, tb OR regexp_matches(x, '{_PATTERN}') OR coalesce(last_value(CASE WHEN regexp_matches(x, '[^ \t-\r]') AND NOT starts_with(x, ' ') THEN false WHEN tb THEN true END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit
FROM (SELECT x, i, contains(x, 'Traceback') AS tb FROM (SELECT unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i))) WHERE hit), substr(text, 1, 500)) AS errors FROM (SELECT *, string_split(text, chr(10)) AS l FROM outputs)""",
    "outputs",
)(contexts.error_context)
q("truncate_lines", "SELECT text_id, CASE WHEN len(l) <= 4 THEN text ELSE array_to_string(l[1:2] || ['... (truncated)'] || l[len(l) - 1:], chr(10)) END AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM outputs)", "outputs")(lambda t: contexts.truncate_lines(t, 4))
q("truncate_text", f"SELECT text_id, CASE WHEN {_T('text')} <= 50 THEN text WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 180) || chr(10) || '[shortened]' END AS text FROM outputs", "outputs")(lambda t: budgets.truncate_text(t, 50, structure=False))
_ROWS = "s AS (SELECT instance_id AS id, 'problem' AS key, problem_statement AS text FROM instances UNION ALL SELECT instance_id, 'test_patch', test_patch FROM instances UNION ALL SELECT instance_id, 'hints', hints_text FROM instances), n AS (SELECT *, " + _T("text") + " AS n, contains(key, 'test') AS test FROM s), a AS (SELECT *, sum(n) OVER (PARTITION BY id) AS total, sum(CASE WHEN test THEN 0 ELSE n END) OVER (PARTITION BY id) AS others FROM n)"


def sections_of(i: DataFrame) -> DataFrame:
    return i.select(F.col("instance_id").alias("id"), F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("text")) for k, c in (("problem", "problem_statement"), ("test_patch", "test_patch"), ("hints", "hints_text"))))))


_CUT = "substr(text, 1, CAST(floor(length(text) * CAST({s} AS DOUBLE) * CAST(0.95 AS DOUBLE)) AS BIGINT))"
q("truncate_sections", f"SELECT id, key, CASE WHEN total <= 40 THEN text WHEN floor(n * (40 / total)) > 0 THEN {_CUT.format(s='(40 / total)')} ELSE '' END AS text FROM a", "instances", more=_ROWS)(lambda i: budgets.truncate_sections(sections_of(i), 40))
q("truncate_sections_keep_tests", f"SELECT id, key, CASE WHEN total <= 40 OR test THEN text ELSE {_CUT.format(s='((40 - (total - others)) / others)')} END AS text FROM a WHERE total <= 40 OR test OR (40 - (total - others) > 0 AND others > 0)", "instances", more=_ROWS)(lambda i: budgets.truncate_sections(sections_of(i), 40, keep_tests=True))
q(
    "fit_to_limit",
    f"""SELECT text_id, original_tokens, coalesce(t, original_tokens)::BIGINT AS final_tokens, t IS NOT NULL AS truncated FROM o LEFT JOIN (SELECT text_id, arg_max(t, round) AS t FROM r GROUP BY 1) USING (text_id)""",
    "outputs",
    more=f"""o AS (SELECT text_id, text, {_T("text")} AS original_tokens FROM outputs),
f AS (SELECT text_id, text, CAST(floor(length(text) * (CAST(60 AS DOUBLE) / original_tokens) * CAST(0.95 AS DOUBLE)) AS BIGINT) AS n FROM o WHERE original_tokens > 60),
r AS (SELECT text_id, text, n, 0 AS round, {_T("substr(text, 1, n)")} AS t FROM f UNION ALL SELECT text_id, text, m, round + 1, {_T("substr(text, 1, m)")} FROM (SELECT *, CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) AS m FROM r WHERE t > 60 AND n > 100))""",
)(lambda t: budgets.fit_to_limit(t, 100, 40))
SQL["fit_to_limit"] = SQL["fit_to_limit"].replace("WITH ", "WITH RECURSIVE ", 1)
q("estimate_tokens_simple", "SELECT instance_id, greatest(1, (length(problem_statement) + length(hints_text)) // 4)::BIGINT AS tokens FROM instances", "instances")(lambda i: prompts.estimate_tokens_simple(i, "problem_statement", "hints_text"))
