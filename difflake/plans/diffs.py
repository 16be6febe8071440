"""Queries over diffs: structure, checks, verdicts, and screening of predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import diff_checks, diff_structure, screening
from .tables import ctes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_LINES = r"""
pl AS (SELECT *, count_if(kind = 'old_header') OVER w AS file_no, count_if(kind = 'hunk') OVER w AS hunk_no, lag(line) OVER o AS before, lead(line) OVER o AS next FROM (
  SELECT *, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, 'diff --git') THEN 'git_header' WHEN starts_with(line, 'index ') THEN 'index' WHEN starts_with(line, '--- ') THEN 'old_header'
    WHEN starts_with(line, '+++ ') THEN 'new_header' WHEN starts_with(line, '@@') THEN 'hunk' WHEN starts_with(line, '\') THEN 'marker' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'del'
    WHEN starts_with(line, ' ') THEN 'context' ELSE 'other' END AS kind
  FROM (SELECT patch_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT patch_id, string_split(patch, chr(10)) AS l FROM {source})))
  WINDOW o AS (PARTITION BY patch_id ORDER BY line_no), w AS (PARTITION BY patch_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, count(git_from) OVER w AS gits, last_value(CASE WHEN starts_with(line, '--- a/') THEN path END IGNORE NULLS) OVER w AS file FROM (
  SELECT *, kind = 'hunk' AND regexp_matches(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@') AS good_hunk,
    CASE WHEN kind = 'git_header' AND regexp_matches(line, '^diff --git (\S+) (\S+)$') THEN regexp_extract(line, '^diff --git (\S+) (\S+)$', 1) END AS git_from,
    CASE WHEN kind = 'git_header' AND regexp_matches(line, '^diff --git (\S+) (\S+)$') THEN regexp_extract(line, '^diff --git (\S+) (\S+)$', 2) END AS git_to,
    CASE WHEN kind = 'old_header' AND regexp_matches(line, '^--- [^\t\n]+') THEN regexp_extract(line, '^--- ([^\t\n]+)', 1) END AS path,
    TRY_CAST(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 1) AS BIGINT) AS old_start, TRY_CAST(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 3) AS BIGINT) AS new_start,
    CASE WHEN kind = 'hunk' THEN coalesce(TRY_CAST(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 2) AS BIGINT), 1) END AS old_count,
    CASE WHEN kind = 'hunk' THEN coalesce(TRY_CAST(regexp_extract(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 4) AS BIGINT), 1) END AS new_count,
    starts_with(line, '+') AND NOT starts_with(line, '+++') AS added, starts_with(line, '-') AND NOT starts_with(line, '---') AS removed
  FROM pl) WINDOW w AS (PARTITION BY patch_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
changes AS (SELECT patch_id, file, count_if(added) AS added, count_if(removed) AS removed, count_if(kind = 'hunk') AS hunks FROM h WHERE file IS NOT NULL GROUP BY ALL),
hc AS (SELECT patch_id, hunk_no, min(line_no) FILTER (kind = 'hunk') AS line_no, max(old_count) AS old_count, max(new_count) AS new_count,
    count_if(inside AND kind IN ('context', 'blank', 'del')) AS old_found, count_if(inside AND kind IN ('context', 'blank', 'add')) AS new_found
  FROM (SELECT *, kind <> 'hunk' AND (stop IS NULL OR line_no < stop) AS inside FROM (SELECT *, min(CASE WHEN kind <> 'hunk' AND (starts_with(line, '---') OR starts_with(line, '+++') OR kind IN ('git_header', 'index', 'other'){blank}) THEN line_no END) OVER (PARTITION BY patch_id, hunk_no) AS stop FROM h WHERE hunk_no > 0))
  GROUP BY ALL HAVING bool_or(good_hunk))
"""


def lines_sql(source: str = "predictions", blank: str = "") -> str:
    return _LINES.replace("{source}", source).replace("{blank}", blank)


def diff_query(name: str, sql: str) -> Callable:
    """Registers a query over patch_lines(predictions), with its SQL over pl, h, changes and hc."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(diff_structure.patch_lines(table(spark, sf_dir, "predictions").select("patch_id", "patch")))
        SQL[name] = ctes("predictions", more=lines_sql()) + sql
        return f

    return register


def prediction_query(name: str, sql: str, *tables: str, more: str = "") -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable:
        names = tables or ("predictions",)
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in names))
        SQL[name] = ctes(*names, more=more) + sql
        return f

    return register


diff_query("patch_lines", "SELECT patch_id, CAST(line_no AS INTEGER) AS line_no, line, kind, CAST(file_no AS BIGINT) AS file_no, CAST(hunk_no AS BIGINT) AS hunk_no FROM pl")(lambda x: x)
diff_query(
    "patch_files",
    """, f AS (SELECT *, count_if(git_from IS NOT NULL OR path IS NOT NULL) OVER (PARTITION BY patch_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM h)
SELECT patch_id, coalesce(git_from, path) AS from_path, git_to AS to_path, CAST(line_no AS INTEGER) AS line_no FROM f WHERE git_from IS NOT NULL OR (path IS NOT NULL AND coalesce(known, 0) = 0)""",
)(diff_structure.patch_files)
diff_query(
    "patch_hunks",
    """, f AS (SELECT *, last_value(git_from IGNORE NULLS) OVER w AS g, first_value(path IGNORE NULLS) OVER w AS p FROM h WINDOW w AS (PARTITION BY patch_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT patch_id, CAST(line_no AS INTEGER) AS line_no, old_start, old_count, new_start, new_count, coalesce(g, p) AS file FROM f WHERE good_hunk""",
)(diff_structure.patch_hunks)
diff_query("file_changes", "SELECT patch_id, file, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed, CAST(hunks AS BIGINT) AS hunks FROM changes")(diff_structure.file_changes)
diff_query(
    "patch_summary",
    """, s AS (SELECT patch_id, count(*) AS files_changed, sum(added) AS lines_added, sum(removed) AS lines_removed, sum(hunks) AS hunks, string_agg(file, ',' ORDER BY file) AS files FROM changes GROUP BY 1)
SELECT f.patch_id, CAST(coalesce(files_changed, 0) AS BIGINT) AS files_changed, CAST(coalesce(lines_added, 0) AS BIGINT) AS lines_added, CAST(coalesce(lines_removed, 0) AS BIGINT) AS lines_removed, CAST(coalesce(hunks, 0) AS BIGINT) AS hunks, format, coalesce(files, '') AS files
FROM (SELECT patch_id, CASE WHEN bool_or(kind = 'git_header') THEN 'git' WHEN bool_or(kind = 'old_header') THEN 'unified' ELSE 'unknown' END AS format FROM pl GROUP BY 1) f LEFT JOIN s USING (patch_id)""",
)(diff_structure.patch_summary)
diff_query(
    "affected_files",
    """, s AS (SELECT patch_id, regexp_replace(CASE WHEN starts_with(line, '--- a/') THEN path WHEN git_from IS NOT NULL THEN git_from END, '^a/', '') AS p, min(line_no) AS n FROM h GROUP BY ALL)
SELECT patch_id, string_agg(p, ',' ORDER BY n, p) AS paths, count(*) AS n_files FROM s WHERE p <> '/dev/null' GROUP BY patch_id""",
)(diff_structure.affected_files)
diff_query("change_counts", "SELECT patch_id, CAST(count_if(added) AS BIGINT) AS added, CAST(count_if(removed) AS BIGINT) AS removed, count(DISTINCT CASE WHEN starts_with(line, '--- a/') THEN line END) AS files FROM h GROUP BY patch_id")(diff_structure.change_counts)
diff_query("hunk_counts", "SELECT patch_id, CAST(hunk_no AS BIGINT) AS hunk_no, CAST(line_no AS INTEGER) AS line_no, old_count, CAST(old_found AS BIGINT) AS old_found, new_count, CAST(new_found AS BIGINT) AS new_found FROM hc")(diff_structure.hunk_counts)

_ISSUE = "SELECT patch_id, '{check}' AS \"check\", '{level}' AS level, '{code}' AS code, CAST({line} AS INTEGER) AS line_number, {detail} AS detail FROM {source}"


def _issue(check: str, level: str, code: str, source: str, line: str = "line_no", detail: str = "''") -> str:
    return _ISSUE.format(check=check, level=level, code=code, line=line, detail=detail, source=source)


def _all(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


_HS = "(SELECT patch_id, max(CASE WHEN git_from IS NOT NULL THEN line_no END) AS git, max(CASE WHEN kind = 'old_header' AND starts_with(next, '+++ ') THEN line_no END) AS pair, count_if(kind = 'hunk') AS hunks, count_if(kind = 'old_header') AS olds FROM h GROUP BY 1)"
_CS = "(SELECT patch_id, sum(added) AS a, sum(removed) AS r, count(*) AS f FROM changes GROUP BY 1)"
_ENDS = "(SELECT patch_id, count_if(suffix(line, chr(13)) AND next IS NOT NULL) AS crlf, max(line_no) - 1 AS lf FROM pl GROUP BY 1)"
_SPANS = """(SELECT *, lead(start) OVER (PARTITION BY patch_id ORDER BY g) AS following FROM (SELECT patch_id, g, max(CASE WHEN good_hunk THEN greatest(old_count, new_count) END) AS want, count_if(regexp_matches(line, '^[-+ ]')) AS found, min(CASE WHEN good_hunk THEN line_no END) AS start
  FROM (SELECT *, count_if(good_hunk) OVER (PARTITION BY patch_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM h) WHERE g > 0 GROUP BY ALL))"""
_MIDDLE = """(SELECT *, coalesce(count_if(regexp_matches(line, '^[-+ ]')) OVER (PARTITION BY patch_id, g ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found, first_value(greatest(old_count, new_count)) OVER (PARTITION BY patch_id, g ORDER BY line_no) AS want
  FROM (SELECT *, count_if(good_hunk) OVER (PARTITION BY patch_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM h) WHERE g > 0)"""
_TAIL = "(SELECT patch_id, max(CASE WHEN n = 1 THEN trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END) AS last, count_if(starts_with(line, '\\ No newline')) AS marks FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY line_no DESC) AS n FROM pl) WHERE n <= 3 GROUP BY 1)"
_STATE = "(SELECT *, last_value(CASE WHEN kind = 'hunk' THEN 'in' WHEN regexp_matches(line, '^(---|diff)') THEN 'out' END IGNORE NULLS) OVER (PARTITION BY patch_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM pl)"
_EMPTY = """(SELECT patch_id, hunk_no, min(line_no) AS line_no FROM (SELECT *, min(CASE WHEN kind <> 'hunk' AND regexp_matches(line, '^(---|diff)') THEN line_no END) OVER (PARTITION BY patch_id, hunk_no) AS stop FROM h WHERE hunk_no > 0)
  GROUP BY ALL HAVING count_if(kind <> 'hunk' AND (added OR removed) AND (stop IS NULL OR line_no < stop)) = 0)"""
CHECK_SQL = {
    "check_headers": _all(
        _issue("headers", "error", "bad_git_header", "h WHERE kind = 'git_header' AND git_from IS NULL"),
        _issue("headers", "warning", "bad_index", r"h WHERE kind = 'index' AND gits > 0 AND NOT regexp_matches(line, '^index [a-f0-9]+\.\.[a-f0-9]+(?: \d+)?$')"),
        _issue("headers", "error", "no_new_header_at_end", "h WHERE kind = 'old_header' AND next IS NULL"),
        _issue("headers", "error", "no_new_header", "h WHERE kind = 'old_header' AND NOT starts_with(next, '+++ ')", "line_no + 1"),
        _issue("headers", "error", "no_file_headers_after_git", f"{_HS} WHERE git IS NOT NULL AND coalesce(pair, 0) < git", "NULL"),
        _issue("headers", "error", "no_hunks", f"{_HS} WHERE hunks = 0", "NULL"),
        _issue("headers", "error", "no_file_headers", f"{_HS} WHERE olds = 0 AND hunks > 0", "NULL"),
    ),
    "check_hunk_headers": _issue("hunk_headers", "error", "bad_hunk_header", "h WHERE kind = 'hunk' AND NOT good_hunk"),
    "check_hunk_counts": _all(*(_issue("hunk_counts", "warning", f"{s}_count", f"hc WHERE {s}_count <> {s}_found", detail=f"{s}_count || '/' || {s}_found") for s in ("old", "new"))),
    "check_line_prefix": _issue("line_prefix", "error", "bad_prefix", rf"{_STATE} WHERE line <> '' AND state = 'in' AND NOT regexp_matches(line, '^(@@|---|\+\+\+|diff|index)') AND NOT regexp_matches(line, '^[- +\\]')", detail="substr(line, 1, 1)"),
    "check_duplicate_files": _issue("duplicate_files", "error", "duplicate_file", "(SELECT *, row_number() OVER (PARTITION BY patch_id, path ORDER BY line_no) AS n FROM h WHERE starts_with(line, '--- a/') AND path IS NOT NULL) WHERE n > 1", detail="path"),
    "check_change_size": _all(_issue("change_size", "warning", "many_changes", "changes WHERE added + removed > 500", "NULL", "file"), _issue("change_size", "error", "too_many_changes", "changes WHERE added + removed > 2000", "NULL", "file")),
    "check_binary": _issue("binary", "error", "binary", r"(SELECT patch_id, min(line_no) AS line_no FROM pl WHERE regexp_matches(line, '[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{FF}]') GROUP BY 1), range(2)"),
    "check_empty_patch": _all(
        _issue("empty_patch", "error", "no_changes", "(SELECT patch_id FROM h GROUP BY 1 HAVING count_if(added OR removed) = 0)", "NULL"),
        _issue("empty_patch", "warning", "only_deletions", f"{_CS} WHERE r > 0 AND a = 0", "NULL"),
        _issue("empty_patch", "error", "too_many_files", f"{_CS} WHERE f > 50", "NULL"),
    ),
    "check_line_endings": _all(
        _issue("line_endings", "warning", "mixed_line_endings", f"{_ENDS} WHERE crlf > 0 AND lf > crlf", "NULL", "crlf || '/' || (lf - crlf)"), _issue("line_endings", "warning", "crlf", f"{_ENDS} WHERE crlf > 0 AND lf = crlf", "NULL", "CAST(crlf AS VARCHAR)")
    ),
    "check_truncation": _all(
        _issue("truncation", "warning", "ends_with_change", f"{_TAIL} WHERE marks = 0 AND regexp_matches(last, '^[-+]')", "NULL"),
        _issue("truncation", "error", "short_hunk", f"{_MIDDLE} WHERE kind = 'hunk' AND NOT good_hunk AND found < want", detail="want || '/' || found"),
        _issue("truncation", "error", "short_hunk", f"{_SPANS} WHERE found < want AND following IS NOT NULL", "following", "want || '/' || found"),
        _issue("truncation", "error", "short_last_hunk", f"{_SPANS} WHERE found < want AND following IS NULL", "NULL", "want || '/' || found"),
    ),
    "check_empty_hunks": _issue("empty_hunks", "warning", "empty_hunk", _EMPTY),
    "check_newline_marker": _issue("newline_marker", "warning", "misplaced_marker", r"pl WHERE line = '\ No newline at end of file' AND (before IS NULL OR NOT regexp_matches(before, '^[-+ ]'))"),
}
for _name, _check in diff_checks.CHECKS.items():
    diff_query(_name, CHECK_SQL[_name])(_check)

_OK = "ok AS (SELECT * FROM predictions WHERE patch <> '' AND length(patch) <= 100000),"
ISSUES_SQL = _OK + lines_sql("ok") + ", issues AS (" + _all(*CHECK_SQL.values()) + ")"
_VERDICT = """, sums AS (SELECT patch_id, count_if(level = 'error') AS errors, count_if(level = 'warning') AS warnings, count_if(level = 'error' AND "check" NOT IN ('line_endings', 'truncation', 'empty_hunks', 'newline_marker')) AS failed FROM issues GROUP BY 1),
v AS (SELECT p.patch_id, run_id, instance_id, p.patch IS NULL OR p.patch = '' OR length(p.patch) > 100000 AS refused, CASE WHEN p.patch IS NULL OR p.patch = '' OR length(p.patch) > 100000 THEN 1 ELSE coalesce(errors, 0) END AS errors, CASE WHEN p.patch IS NULL OR p.patch = '' OR length(p.patch) > 100000 THEN 0 ELSE coalesce(warnings, 0) END AS warnings, coalesce(failed, 0) AS failed
  FROM predictions p LEFT JOIN sums USING (patch_id)),
verdicts AS (SELECT patch_id, run_id, instance_id, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings,
  CASE WHEN refused THEN 0.0::DOUBLE WHEN failed > 0 THEN least(0.49, greatest(0.0, (100 - errors * 20 - warnings * 5) / 100.0))::DOUBLE ELSE greatest(0.0, least(1.0, (100 - errors * 20 - warnings * 5) / 100.0))::DOUBLE END AS score, errors = 0 AS is_valid FROM v)
"""
prediction_query("validate_patches", _VERDICT + "SELECT * FROM verdicts", more=ISSUES_SQL)(diff_checks.validate_patches)
prediction_query("issue_histogram", 'SELECT "check", code, level, count(*) AS n, count(DISTINCT patch_id) AS patches FROM issues GROUP BY ALL', more=ISSUES_SQL)(lambda p: diff_checks.issue_histogram(diff_checks.patch_issues(p)))
_ADVICE = ", ".join(f"('{k}', $${v}$$)" for k, v in diff_checks.ADVICE.items())
prediction_query(
    "suggest_fixes",
    f""", advice(code, advice) AS (VALUES {_ADVICE}), f AS (SELECT patch_id, advice, min(coalesce(line_number, 0)) AS n FROM issues JOIN advice USING (code) GROUP BY ALL)
SELECT patch_id, string_agg(advice, '; ' ORDER BY n, advice) AS advice FROM f GROUP BY 1""",
    more=ISSUES_SQL,
)(lambda p: diff_checks.suggest_fixes(diff_checks.patch_issues(p)))
_FIXED = r"""SELECT patch_id, string_agg(t, chr(10) ORDER BY line_no) AS patch FROM (SELECT h.patch_id, h.line_no,
  CASE WHEN good_hunk THEN '@@ -' || h.old_start || CASE WHEN old_found = 1 THEN '' ELSE ',' || old_found END || ' +' || h.new_start || CASE WHEN new_found = 1 THEN '' ELSE ',' || new_found END || ' @@' || regexp_replace(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', '')
  WHEN kind = 'old_header' AND NOT coalesce(starts_with(next, '+++ '), false) THEN line || chr(10) || '+++ ' || replace(substr(line, 5), 'a/', 'b/') ELSE line END AS t
  FROM h LEFT JOIN hc ON h.patch_id = hc.patch_id AND h.line_no = hc.line_no) GROUP BY 1"""
prediction_query("autofix_patches", _FIXED, more="unix AS (SELECT patch_id, replace(patch, chr(13) || chr(10), chr(10)) AS patch FROM predictions)," + lines_sql("unix"))(diff_checks.autofix_patches)

prediction_query("validate_predictions", r"""
SELECT patch_id, CASE WHEN instance_id IS NULL OR instance_id = '' THEN 'empty_id' WHEN patch IS NULL OR patch = '' THEN 'empty_patch' WHEN NOT regexp_matches(instance_id, '^[a-zA-Z0-9_\-\.]+$') THEN 'bad_id'
  WHEN NOT regexp_matches(patch, '^\s*(diff --git|--- |\+\+\+ )') THEN 'not_a_diff' WHEN octet_length(encode(patch)) > 5242880 THEN 'too_large'
  WHEN len(list_filter(string_split(patch, chr(10)), lambda l: starts_with(l, 'GIT binary patch') OR (contains(l, 'Binary files') AND contains(l, 'differ')) OR (regexp_matches(l, '^(\+\+\+|---)') AND regexp_matches(lower(l), '""" + screening.BINARY_NAMES + r"""')))) > 0 THEN 'binary' END AS reason FROM predictions""")(screening.validate_predictions)
prediction_query("screen_predictions", """
SELECT patch_id, CASE WHEN octet_length(encode(patch)) > 5242880 THEN 'PATCH_TOO_LARGE' WHEN contains(lower(patch), 'binary files differ') THEN 'binary' WHEN contains(lower(patch), 'invalid hunk') OR contains(patch, '@@@') OR contains(patch, '<<<<<<<') OR contains(patch, '>>>>>>>') THEN 'conflict' END AS reason,
  octet_length(encode(patch)) > 512000 AS large FROM predictions WHERE patch IS NOT NULL""")(screening.screen_predictions)
diff_query("suspicious_predictions", r"""SELECT patch_id, count_if(removed) > 1000 AS many_deletions, count_if(regexp_matches(line, '^(old|new) mode ')) > 0 AS mode_change, count_if(starts_with(line, 'GIT binary patch') OR (contains(line, 'Binary files') AND contains(line, 'differ'))) > 0 AS "binary" FROM h GROUP BY 1""")(screening.suspicious)
prediction_query("unknown_predictions", "SELECT patch_id, instance_id FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM instances i WHERE i.instance_id = p.instance_id AND i.version <> '3')", "predictions", "instances")(lambda p, i: screening.unknown_predictions(p, i.where("version <> '3'")))
prediction_query("missing_predictions", "SELECT instance_id, false AS passed, 'missing_patch' AS status FROM instances i WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.instance_id = i.instance_id AND p.patch <> '')", "predictions", "instances")(screening.missing_predictions)
prediction_query("infer_test_set", "SELECT repo || '/' || lang || '_' || version AS name, CASE WHEN contains(lower(repo || lang || version), 'verified') THEN 'verified' WHEN contains(lower(repo || lang || version), 'lite') THEN 'lite' WHEN contains(lower(repo || lang || version), 'full') THEN 'full' ELSE 'custom' END AS test_set, count(*) AS n FROM instances GROUP BY ALL", "instances")(screening.infer_test_set)
