"""Queries over the repair of extracted patches, requests, and files that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import repair
from ..sources import files
from ..streaming import chunks as ch
from .diffs import QUERIES, SQL, lines_sql
from .diffs import prediction_query as q
from .tables import ctes, table

_HUNKS = r"""
, xs AS (SELECT *, lead(line) OVER (PARTITION BY patch_id ORDER BY line_no) AS nxt, lag(line) OVER (PARTITION BY patch_id ORDER BY line_no) AS prev, max(line_no) OVER (PARTITION BY patch_id) AS last_no,
  min(CASE WHEN hunk_no > 0 AND kind <> 'hunk' AND (starts_with(line, '---') OR starts_with(line, 'diff') OR starts_with(line, '+++') OR NOT regexp_matches(line, '^[+ \\\\-]')) THEN line_no END) OVER (PARTITION BY patch_id, hunk_no) AS stop2 FROM h),
xh AS (SELECT *, count_if(inside AND left(line, 1) IN ('-', ' ')) OVER p AS old_real, count_if(inside AND left(line, 1) IN ('+', ' ')) OVER p AS new_real FROM (SELECT *, hunk_no > 0 AND kind <> 'hunk' AND (stop2 IS NULL OR line_no < stop2) AS inside FROM xs) WINDOW p AS (PARTITION BY patch_id, hunk_no))
"""
_PATCHES = "(SELECT * FROM predictions WHERE patch <> '')"
_VALID = _HUNKS + r""", said AS (SELECT patch_id, string_agg(CASE WHEN starts_with(line, '--- ') AND NOT coalesce(starts_with(nxt, '+++ '), false) THEN 'no_new_header:' || line_no WHEN kind = 'hunk' AND NOT good_hunk THEN 'bad_hunk_header:' || line_no END, ',' ORDER BY line_no) AS i,
  string_agg(nullif(concat_ws(',', CASE WHEN good_hunk AND abs(old_real - old_count) > 1 THEN 'old_count:' || line_no END, CASE WHEN good_hunk AND abs(new_real - new_count) > 1 THEN 'new_count:' || line_no END), ''), ',' ORDER BY line_no) AS w,
  bool_or((starts_with(line, '--- ') AND coalesce(starts_with(nxt, '+++ '), false)) OR starts_with(line, 'diff --git')) AS f, bool_or(kind = 'hunk') AS hk, bool_or(added OR removed) AS ch,
  bool_or(line_no = last_no AND regexp_matches(line, '^\s*[+-]')) AND NOT bool_or(line_no > last_no - 3 AND starts_with(line, '\ No newline')) AS cut FROM xh GROUP BY 1),
told AS (SELECT patch_id, concat_ws(',', i, CASE WHEN NOT f THEN 'no_file_headers' END, CASE WHEN NOT hk THEN 'no_hunks' END, CASE WHEN NOT ch THEN 'no_changes' END) AS issues, concat_ws(',', w, CASE WHEN cut THEN 'cut_off' END) AS warnings FROM said)
SELECT patch_id, issues, warnings, CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END::INTEGER AS n_issues, CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END::INTEGER AS n_warnings, issues = '' AS is_valid
FROM (SELECT patch_id, coalesce(issues, 'empty') AS issues, coalesce(warnings, '') AS warnings FROM predictions LEFT JOIN told USING (patch_id))"""
_FIX = _HUNKS + r""", n AS (SELECT *, CASE WHEN good_hunk THEN '@@ -' || old_start || CASE WHEN old_real = 1 THEN '' ELSE ',' || old_real END || ' +' || new_start || CASE WHEN new_real = 1 THEN '' ELSE ',' || new_real END || ' @@ ' || trim(regexp_replace(line, '^@@.*?@@', ''), ' ' || chr(9) || chr(13)) ELSE line END AS t FROM xh),
g AS (SELECT patch_id, string_agg(CASE WHEN line_no = 1 AND kind = 'hunk' THEN '--- a/file' || chr(10) || '+++ b/file' || chr(10) ELSE '' END || t || CASE WHEN line_no = last_no AND line <> '' AND NOT starts_with(line, '\') AND left(prev, 1) IN ('+', '-', ' ') THEN chr(10) || '\ No newline at end of file' ELSE '' END, chr(10) ORDER BY line_no) AS fixed FROM n GROUP BY 1)
SELECT patch_id, coalesce(fixed, patch) AS patch FROM predictions LEFT JOIN g USING (patch_id)"""


def p(name: str, sql: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(table(spark, sf_dir, "predictions"))
        SQL[name] = ctes("predictions", more=lines_sql(_PATCHES)) + sql

    return register


p("validate_extracted", _VALID)(repair.validate_extracted)
p("fix_hunk_counts", _FIX)(repair.fix_hunk_counts)
_FORMAT = "CASE doc_id % 3 WHEN 0 THEN 'git' WHEN 1 THEN 'unified' ELSE 'search_replace' END"
p(
    "extraction_confidence",
    _VALID.replace("SELECT patch_id, issues, warnings, CASE", ", v AS (SELECT patch_id, CASE", 1).replace("FROM predictions LEFT JOIN told USING (patch_id))", "FROM predictions LEFT JOIN told USING (patch_id)))")
    + f"""
SELECT patch_id, CASE WHEN patch = '' THEN 0 ELSE d * CASE WHEN len(l) < 4 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN len(list_filter(l, lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR (starts_with(x, '-') AND NOT starts_with(x, '---')))) = 0 THEN 0.5::DOUBLE ELSE 1 END END AS confidence
FROM (SELECT *, CASE WHEN len(list_filter(l, lambda x: starts_with(x, '@@ '))) > 0 THEN least(1, c + 0.02::DOUBLE) ELSE c END AS d FROM (SELECT *, CASE WHEN len(list_filter(l, lambda x: starts_with(x, '--- a/'))) > 0 THEN least(1, b + 0.02::DOUBLE) ELSE b END AS c
FROM (SELECT *, CASE WHEN is_valid THEN least(1, base + 0.1::DOUBLE) ELSE base * greatest(0.3::DOUBLE, 1 - n_issues * 0.1::DOUBLE) END AS b FROM (SELECT predictions.*, n_issues, is_valid, string_split(patch, chr(10)) AS l, CASE {_FORMAT} WHEN 'git' THEN 0.95::DOUBLE WHEN 'unified' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS base FROM predictions JOIN v USING (patch_id)))))""",
)(lambda x: repair.extraction_confidence(x.withColumn("format", F.expr(_FORMAT))))

q(
    "provider_requests",
    "SELECT response_id, provider, json_extract_string(body, '$.model') AS model, CAST(json_extract(body, '$.max_tokens') AS BIGINT) AS max_tokens, CAST(json_extract(body, '$.temperature') AS DOUBLE) AS temperature, CAST(json_extract(body, '$.options.num_predict') AS BIGINT) AS num_predict, md5(coalesce(json_extract_string(body, '$.prompt'), json_extract_string(body, '$.messages[1].content'), json_extract_string(body, '$.messages[0].content'))) AS prompt, coalesce(json_extract_string(body, '$.system'), CASE WHEN json_extract_string(body, '$.messages[1].content') IS NOT NULL THEN json_extract_string(body, '$.messages[0].content') END) AS system FROM ("
    "SELECT response_id, provider, CASE provider WHEN 'anthropic' THEN to_json({'model': model, 'messages': [{'role': 'user', 'content': prompt}], 'max_tokens': CASE WHEN max_tokens > 0 THEN max_tokens ELSE 4000 END, 'temperature': temperature, 'system': nullif(system, '')}) WHEN 'ollama' THEN to_json({'model': model, 'prompt': prompt, 'options': {'temperature': temperature, 'num_predict': CASE WHEN max_tokens > 0 THEN max_tokens END}, 'system': nullif(system, '')}) "
    "ELSE to_json({'model': model, 'messages': CASE WHEN system <> '' THEN [{'role': 'system', 'content': system}, {'role': 'user', 'content': prompt}] ELSE [{'role': 'user', 'content': prompt}] END, 'temperature': CASE WHEN NOT starts_with(lower(model), 'gpt-5') THEN temperature END, 'max_tokens': CASE WHEN max_tokens > 0 THEN max_tokens END}) END AS body FROM full_requests)",
    "full_requests",
)(
    lambda r: files.provider_requests(r).select(
        "response_id", "provider", F.get_json_object("body", "$.model").alias("model"), F.get_json_object("body", "$.max_tokens").cast("long").alias("max_tokens"), F.get_json_object("body", "$.temperature").cast("double").alias("temperature"), F.get_json_object("body", "$.options.num_predict").cast("long").alias("num_predict"),
        F.md5(F.coalesce(F.get_json_object("body", "$.prompt"), F.get_json_object("body", "$.messages[1].content"), F.get_json_object("body", "$.messages[0].content"))).alias("prompt"), F.coalesce(F.get_json_object("body", "$.system"), F.when(F.get_json_object("body", "$.messages[1].content").isNotNull(), F.get_json_object("body", "$.messages[0].content"))).alias("system"))
)
q(
    "harness_report_summary",
    "SELECT folder, 'test.' || n || '.json' AS name, CASE WHEN n % 4 = 0 THEN 'A report without counters' ELSE 'Instances completed: ' || total || '; Instances resolved: ' || done END AS summary FROM (SELECT run_id AS folder, max(CAST(day AS BIGINT)) AS n, arg_max(total, CAST(day AS BIGINT)) AS total, arg_max(done, CAST(day AS BIGINT)) AS done FROM harness_days GROUP BY 1)",
    "harness_days",
)(lambda d: files.harness_report_summary(d.select(F.col("run_id").alias("folder"), F.format_string("test.%d.json", F.col("day").cast("long")).alias("name"), F.col("day").cast("long").alias("modified"), F.expr("CASE WHEN day % 4 = 0 THEN 'no json' ELSE concat('{\"instancesResolved\":', done, ',\"INSTANCES completed\":', total, ',\"other\":1}') END").alias("report"))))
q("load_instances", "SELECT instance_id, coalesce(CASE WHEN patch = '' THEN NULL ELSE patch END, '') AS patch, '' AS repo, '' AS base_commit, '' AS problem_statement FROM predictions")(lambda x: files.load_instances(x.select("instance_id", F.expr("nullif(patch, '')").alias("diff"))))
_RUN = "SELECT run_id, instance_id, passed, error FROM (SELECT *, row_number() OVER (PARTITION BY run_id, instance_id ORDER BY ts DESC, seq DESC) AS rn FROM results) WHERE rn = 1"
q(
    "write_run_report",
    f"""SELECT run_id, count(*) AS total, count_if(passed)::BIGINT AS resolved, count_if(NOT passed AND contains(lower(coalesce(error, '')), 'timed out'))::BIGINT AS timeout, count_if(flaky)::BIGINT AS flaky, sum(attempts)::BIGINT AS attempts, min(instance_id) AS first_id
FROM (SELECT r.*, attempts, passed AND failed AS flaky FROM ({_RUN}) r JOIN (SELECT run_id, instance_id, count(*) AS attempts, bool_or(NOT passed) AS failed FROM results GROUP BY ALL) USING (run_id, instance_id)) GROUP BY 1""",
    "results",
)(lambda r: _reports(r))


def _fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _reports(results: DataFrame) -> DataFrame:
    """Written in parts of 50 instances and read again: counts of the headers, sums over the parts."""
    spark, path = results.sparkSession, _fresh(results.sparkSession)
    files.write_run_report(results, path, 50)
    headers, parts = files.read_run_report(spark, path)
    i = F.col("instances")
    parts = parts.select("run_id", "first_id", F.size(F.filter(i, lambda x: x["flaky"])).cast("long").alias("flaky"), F.aggregate(i, F.lit(0).cast("long"), lambda acc, x: acc + x["attempts"]).alias("attempts"))
    sums = parts.groupBy("run_id").agg(F.sum("flaky").alias("flaky"), F.sum("attempts").alias("attempts"), F.min("first_id").alias("first_id"))
    return headers.join(sums, "run_id").select("run_id", "summary.total", "summary.resolved", "summary.timeout", "flaky", "attempts", "first_id")


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark)
    rows = table(spark, sf_dir, "predictions")
    n = files.write_predictions(rows, path)
    return spark.read.schema("instance_id string, patch string").json(path).withColumn("written", F.lit(n).cast("long"))


QUERIES["write_predictions"] = _written
SQL["write_predictions"] = ctes("predictions") + "SELECT instance_id, patch, (SELECT count(*) FROM predictions) AS written FROM predictions"


def _result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each month as an array of objects, written and read again."""
    path = _fresh(spark)
    r = table(spark, sf_dir, "results")
    r.groupBy(F.date_format("ts", "'results_custom_'yyyyMM_1200").alias("run")).agg(F.to_json(F.collect_list(F.struct("instance_id", "passed", "error"))).alias("value")).write.partitionBy("run").text(path)
    return files.load_results(spark, path)


QUERIES["load_results"] = _result_files
SQL["load_results"] = ctes("results") + "SELECT strftime(ts, '%Y%m_1200') AS run_id, 'custom' AS test_set, instance_id, passed, error FROM results"


def _batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation results of each run as one document, written and read again."""
    path = _fresh(spark)
    a, o = table(spark, sf_dir, "attempts"), F.col("outcome")
    good = F.collect_list(F.when(o == "ok", F.struct("instance_id", F.col("provider").alias("model"), F.lit(1).alias("attempts"), (F.col("micro_usd") / 1e6).alias("cost"), F.lit(True).alias("success"), F.lit(False).alias("truncated"), F.lit("x").alias("patch"))))
    a.groupBy("run_id").agg(good.alias("successful"), F.collect_list(F.when(~o.isin("ok", "skipped"), F.col("instance_id"))).alias("failed"), F.collect_list(F.when(o == "skipped", F.col("instance_id"))).alias("skipped")).write.partitionBy("run_id").json(path)
    return files.load_generation_results(spark, path).groupBy("state", "instance_id", "model").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))


QUERIES["load_generation_results"] = _batch_files
SQL["load_generation_results"] = ctes("attempts") + "SELECT state, instance_id, model, count(*) AS n, sum(cost) AS cost FROM (SELECT instance_id, CASE outcome WHEN 'ok' THEN 'successful' WHEN 'skipped' THEN 'skipped' ELSE 'failed' END AS state, CASE WHEN outcome = 'ok' THEN provider END AS model, CASE WHEN outcome = 'ok' THEN micro_usd / 1000000 END AS cost FROM attempts) GROUP BY ALL"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as a stream of files, validated; then what was kept and what was refused."""
    source, good, bad, mark = (_fresh(spark) for _ in range(4))
    rows = table(spark, sf_dir, "predictions").select("run_id", "patch_id", "instance_id", "patch", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    rows.write.parquet(source)
    ch.stream_predictions(spark.readStream.schema(rows.schema).parquet(source), good, bad, mark).awaitTermination()
    kept = spark.read.schema("patch_id string, batch int").parquet(good).select("patch_id", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(spark.read.schema("patch_id string, reason string, batch int").parquet(bad).select("patch_id", "reason"))


QUERIES["stream_predictions"] = _stream
SQL["stream_predictions"] = SQL["validate_predictions"]
q("stream_progress", "SELECT *, passed * 100 / (passed + failed) AS share FROM (SELECT run_id, time_bucket(INTERVAL '1 hour', ts) AS start, count_if(passed)::BIGINT AS passed, count_if(NOT passed)::BIGINT AS failed FROM results GROUP BY ALL)", "results")(ch.stream_progress)


def _in_blocks(spark: SparkSession, bytes_: int = 8192) -> SparkSession:
    """A session that cuts files into blocks of so many bytes."""
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_))
    small.conf.set("spark.sql.files.openCostInBytes", "1")
    return small


def _prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction lines in four files of many blocks, read by path."""
    path = _fresh(spark)
    lines = table(spark, sf_dir, "prediction_lines").select(F.expr("line_no % 4").alias("file"), "line_no", "value")
    lines.repartition("file").sortWithinPartitions("file", "line_no").drop("line_no").write.partitionBy("file").text(path)
    read = files.read_predictions(_in_blocks(spark), path)
    return read.select(F.regexp_extract("path", r"file=(\d+)/", 1).cast("int").alias("file"), "line_no", "instance_id", "patch", "reason")


QUERIES["read_predictions"] = _prediction_files
SQL["read_predictions"] = ctes("prediction_lines") + """, l AS (SELECT *, (line_no % 4)::INTEGER AS file, row_number() OVER (PARTITION BY line_no % 4 ORDER BY line_no) AS nr FROM prediction_lines)
SELECT file, nr AS line_no, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.instance_id') END AS instance_id, CASE WHEN json_valid(value) THEN json_extract_string(value, '$.patch') END AS patch, CASE WHEN NOT json_valid(value) THEN 'bad_json' WHEN line_no % 7 = 2 THEN 'missing_key' END AS reason FROM l WHERE value <> ' '"""


def _log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of each source in one file of many blocks, read by path."""
    path = _fresh(spark)
    logs = table(spark, sf_dir, "logs").select(F.split_part("instance_id", F.lit("__"), F.lit(1)).alias("source"), "instance_id", "content")
    logs.repartition("source").sortWithinPartitions("source", "instance_id").drop("instance_id").write.partitionBy("source").text(path)
    lines = files.read_log_lines(_in_blocks(spark, 65536), path, r"source=([^/]+)/")
    return lines.select(F.col("instance_id").alias("source"), "line_no", F.md5("line").alias("line"))


QUERIES["read_log_lines"] = _log_files
SQL["read_log_lines"] = ctes("logs") + """SELECT source, line_no, md5(line) AS line FROM (SELECT source, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (
SELECT split_part(instance_id, '__', 1) AS source, string_split(string_agg(content, chr(10) ORDER BY instance_id), chr(10)) AS l FROM logs GROUP BY 1))"""


def _patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each prediction's patch, read by path; empty patches have none."""
    path = _fresh(spark)
    files.write_patch_dir(table(spark, sf_dir, "predictions").where("patch <> ''"), path)
    read = files.load_patch_dir(_in_blocks(spark, 2 << 20), path)
    return read.select(files.patch_id(F.col("instance_id")).alias("instance_id"), F.md5(F.concat(F.regexp_replace("patch", r"\n+\z", ""), F.lit("\n"))).alias("patch"))


QUERIES["load_patch_dir"] = _patch_files
SQL["load_patch_dir"] = ctes("predictions") + "SELECT instance_id, md5(regexp_replace(patch, '\n+$', '') || chr(10)) AS patch FROM predictions WHERE patch <> ''"


def _summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of each run's results, read by path: failed ids, and how often each."""
    path = _fresh(spark)
    r = table(spark, sf_dir, "results")
    r.groupBy("run_id").agg(F.to_json(F.collect_list(F.struct("instance_id", "passed", "error"))).alias("value")).write.partitionBy("run_id").text(path)
    return files.load_run_summaries(spark, path, "*.txt").groupBy("instance_id").agg(F.count("*").alias("n"))


QUERIES["load_run_summaries"] = _summary_files
SQL["load_run_summaries"] = ctes("results") + "SELECT instance_id, count(*) AS n FROM results WHERE NOT passed GROUP BY 1"
