"""Checks of diffs. Each returns issues: patch_id, check, level, code, line_number, detail; verdicts are aggregates of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import diff_structure as ds

#: Limits of the checks.
MAX_CHARS, MAX_FILES, MANY_CHANGES, TOO_MANY_CHANGES = 100_000, 50, 500, 2000
BINARY = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF]"
NO_NEWLINE = "\\ No newline at end of file"


def _issue(df: DataFrame, check: str, level, code, line="line_no", detail=None) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    number = F.lit(None) if line is None else F.col(line) if isinstance(line, str) else line
    return df.select("patch_id", F.lit(check).alias("check"), as_col(level).alias("level"), as_col(code).alias("code"), number.cast("int").alias("line_number"), as_col("" if detail is None else detail).alias("detail"))


def check_headers(lines: DataFrame) -> DataFrame:
    h = ds.with_headers(lines).withColumns({"next": F.lead("line").over(ds.in_order()), "gits": F.count("git_from").over(ds.so_far())})
    bad_git = _issue(h.where("kind = 'git_header' and git_from is null"), "headers", "error", "bad_git_header")
    bad_index = _issue(h.where("kind = 'index' and gits > 0").where(~F.col("line").rlike(ds.INDEX)), "headers", "warning", "bad_index")
    old = h.where("kind = 'old_header'")
    at_end = _issue(old.where("next is null"), "headers", "error", "no_new_header_at_end")
    wrong = _issue(old.where("next is not null").where(~F.col("next").startswith("+++ ")), "headers", "error", "no_new_header", F.col("line_no") + 1)
    sums = h.groupBy("patch_id").agg(
        F.max(F.when(F.col("git_from").isNotNull(), F.col("line_no"))).alias("git"), F.max(F.when((F.col("kind") == "old_header") & F.col("next").startswith("+++ "), F.col("line_no"))).alias("pair"),
        F.count_if(F.col("kind") == "hunk").alias("hunks"), F.count_if(F.col("kind") == "old_header").alias("olds"))
    lonely = _issue(sums.where("git is not null and coalesce(pair, 0) < git"), "headers", "error", "no_file_headers_after_git", None)
    no_hunk = _issue(sums.where("hunks = 0"), "headers", "error", "no_hunks", None)
    no_file = _issue(sums.where("olds = 0 and hunks > 0"), "headers", "error", "no_file_headers", None)
    return reduce(DataFrame.unionByName, [bad_git, bad_index, at_end, wrong, lonely, no_hunk, no_file])


def check_hunk_headers(lines: DataFrame) -> DataFrame:
    return _issue(ds.with_headers(lines).where("kind = 'hunk' and not good_hunk"), "hunk_headers", "error", "bad_hunk_header")


def check_hunk_counts(lines: DataFrame, strict: bool = False) -> DataFrame:
    c, level = ds.hunk_counts(lines), "error" if strict else "warning"
    part = lambda side: _issue(c.where(f"{side}_count <> {side}_found"), "hunk_counts", level, f"{side}_count", detail=F.concat_ws("/", f"{side}_count", f"{side}_found"))
    return part("old").unionByName(part("new"))


def check_line_prefix(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    marker = F.when(F.col("kind") == "hunk", "in").when(ds.starts(line, "---", "diff"), "out")
    w = lines.withColumn("state", F.last(marker, ignorenulls=True).over(ds.in_order().rowsBetween(Window.unboundedPreceding, -1)))
    odd = (line != "") & ~ds.starts(line, "@@", "---", "+++", "diff", "index") & ~ds.starts(line, " ", "+", "-", "\\")
    return _issue(w.where(odd & (F.col("state") == "in")), "line_prefix", "error", "bad_prefix", detail=F.substring("line", 1, 1))


def check_duplicate_files(lines: DataFrame) -> DataFrame:
    own = ds.with_headers(lines).where("path is not null").where(F.col("line").startswith("--- a/"))
    nth = F.row_number().over(Window.partitionBy("patch_id", "path").orderBy("line_no"))
    return _issue(own.withColumn("nth", nth).where("nth > 1"), "duplicate_files", "error", "duplicate_file", detail=F.col("path"))


def check_change_size(lines: DataFrame) -> DataFrame:
    c = ds.file_changes(lines).withColumn("n", F.col("added") + F.col("removed"))
    many = _issue(c.where(F.col("n") > MANY_CHANGES), "change_size", "warning", "many_changes", None, F.col("file"))
    return many.unionByName(_issue(c.where(F.col("n") > TOO_MANY_CHANGES), "change_size", "error", "too_many_changes", None, F.col("file")))


def check_binary(lines: DataFrame) -> DataFrame:
    """First line with a binary character, twice: two families of checks report it."""
    first = lines.where(F.col("line").rlike(BINARY)).groupBy("patch_id").agg(F.min("line_no").alias("line_no"))
    return _issue(first.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))), "binary", "error", "binary")


def check_empty_patch(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    changes = lines.groupBy("patch_id").agg(F.count_if((line.startswith("+") & ~line.startswith("+++")) | (line.startswith("-") & ~line.startswith("---"))).alias("n"))
    per = ds.file_changes(lines).groupBy("patch_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count("*").alias("files"))
    parts = [_issue(changes.where("n = 0"), "empty_patch", "error", "no_changes", None), _issue(per.where("removed > 0 and added = 0"), "empty_patch", "warning", "only_deletions", None), _issue(per.where(F.col("files") > MAX_FILES), "empty_patch", "error", "too_many_files", None)]
    return reduce(DataFrame.unionByName, parts)


def check_line_endings(lines: DataFrame) -> DataFrame:
    """Counts of line ends follow from the lines: all but the last end in a line feed."""
    last = F.max("line_no")
    ends = lines.withColumn("final", last.over(Window.partitionBy("patch_id"))).groupBy("patch_id").agg(F.count_if(F.col("line").endswith("\r") & (F.col("line_no") < F.col("final"))).alias("crlf"), (F.max("final") - 1).alias("all"))
    mixed = _issue(ends.where("crlf > 0 and all > crlf"), "line_endings", "warning", "mixed_line_endings", None, F.concat_ws("/", "crlf", F.col("all") - F.col("crlf")))
    return mixed.unionByName(_issue(ends.where("crlf > 0 and all = crlf"), "line_endings", "warning", "crlf", None, F.col("crlf").cast("string")))


def check_truncation(lines: DataFrame) -> DataFrame:
    tail = Window.partitionBy("patch_id").orderBy(F.desc("line_no"))
    ends = lines.withColumn("from_end", F.row_number().over(tail)).where("from_end <= 3").groupBy("patch_id").agg(
        F.max(F.when(F.col("from_end") == 1, F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))).alias("last"), F.count_if(F.col("line").startswith("\\ No newline")).alias("marks"))
    cut_off = _issue(ends.where((F.col("marks") == 0) & ds.starts(F.col("last"), "+", "-")), "truncation", "warning", "ends_with_change", None)
    h = ds.with_headers(lines)
    h = h.withColumn("good_no", F.count_if("good_hunk").over(ds.so_far())).where("good_no > 0")
    # a malformed header reports the count so far and does not start it again
    body = F.when(ds.starts(F.col("line"), "+", "-", " "), 1).otherwise(0)
    span = Window.partitionBy("patch_id", "good_no").orderBy("line_no")
    h = h.withColumns({"found": F.sum(body).over(span.rowsBetween(Window.unboundedPreceding, -1)), "want": F.first(F.greatest("old_count", "new_count")).over(span)})
    bad = h.where("kind = 'hunk' and not good_hunk and found < want")
    sums = h.groupBy("patch_id", "good_no").agg(F.max("want").alias("want"), F.sum(body).alias("found"), F.min(F.when(F.col("good_hunk"), F.col("line_no"))).alias("start"))
    following = F.lead("start").over(Window.partitionBy("patch_id").orderBy("good_no"))
    short = sums.withColumn("line_no", following).where("found < want")
    detail = F.concat_ws("/", "want", "found")
    parts = [cut_off, _issue(bad, "truncation", "error", "short_hunk", detail=detail), _issue(short.where("line_no is not null"), "truncation", "error", "short_hunk", detail=detail), _issue(short.where("line_no is null"), "truncation", "error", "short_last_hunk", None, detail)]
    return reduce(DataFrame.unionByName, parts)


def check_empty_hunks(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    stop = (F.col("kind") != "hunk") & ds.starts(line, "---", "diff")
    span = Window.partitionBy("patch_id", "hunk_no")
    h = lines.where("hunk_no > 0").withColumn("stop", F.min(F.when(stop, F.col("line_no"))).over(span))
    change = (F.col("kind") != "hunk") & ((line.startswith("+") & ~line.startswith("+++")) | (line.startswith("-") & ~line.startswith("---"))) & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
    sums = h.groupBy("patch_id", "hunk_no").agg(F.min("line_no").alias("line_no"), F.count_if(change).alias("n"))
    return _issue(sums.where("n = 0"), "empty_hunks", "warning", "empty_hunk")


def check_newline_marker(lines: DataFrame) -> DataFrame:
    before = F.lag("line").over(ds.in_order())
    odd = lines.withColumn("before", before).where(F.col("line") == NO_NEWLINE).where(F.col("before").isNull() | ~ds.starts(F.col("before"), "+", "-", " "))
    return _issue(odd, "newline_marker", "warning", "misplaced_marker")


CHECKS = {"check_headers": check_headers, "check_hunk_headers": check_hunk_headers, "check_hunk_counts": check_hunk_counts, "check_line_prefix": check_line_prefix, "check_duplicate_files": check_duplicate_files, "check_change_size": check_change_size, "check_binary": check_binary, "check_empty_patch": check_empty_patch, "check_line_endings": check_line_endings, "check_truncation": check_truncation, "check_empty_hunks": check_empty_hunks, "check_newline_marker": check_newline_marker}
_SYNTAX = ("headers", "hunk_headers", "hunk_counts", "line_prefix")
_COMMON = ("line_endings", "truncation", "empty_hunks", "newline_marker")


def _entry(when: Column, check: str, level: str, code: str, line: Column | None = None, detail: Column | str = "") -> Column:
    number = F.lit(None).cast("int") if line is None else line.cast("int")
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(level).alias("level"), F.lit(code).alias("code"), number.alias("line_number"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail")))


def patch_issues(predictions: DataFrame) -> DataFrame:
    """All issues of patches that are neither empty nor over-long; those are left out before their lines are made.

    The same as the union of all CHECKS, in one pass: lines are exploded and laid out by patch once, every check's
    columns are windows over that layout, and one aggregate per patch gathers what lines and the whole patch report.
    """
    lines = ds.patch_lines(predictions.where((F.col("patch") != "") & (F.length("patch") <= MAX_CHARS)).repartition("patch_id"))
    line, kind, no, patch = F.col("line"), F.col("kind"), F.col("line_no"), Window.partitionBy("patch_id")
    hunk, good = kind == "hunk", F.col("good_hunk")
    earlier, later = ds.in_order().rowsBetween(Window.unboundedPreceding, -1), ds.in_order().rowsBetween(1, Window.unboundedFollowing)
    change = F.col("added") | F.col("removed")
    h = ds.carried(lines).withColumns({
        "next": F.lead("line").over(ds.in_order()), "before": F.lag("line").over(ds.in_order()), "final": F.max("line_no").over(patch), "gits": F.count("git_from").over(ds.so_far()),
        "state": F.last(F.when(hunk, "in").when(ds.starts(line, "---", "diff"), "out"), ignorenulls=True).over(earlier), "good_no": F.count_if(good).over(ds.so_far()), "next_good": F.min(F.when(good, no)).over(later),
    })
    of_hunk, of_good = Window.partitionBy("patch_id", "hunk_no"), Window.partitionBy("patch_id", "good_no").orderBy("line_no")
    foreign = ds.starts(line, "---", "+++") | kind.isin("git_header", "other", "index")
    least = lambda when: F.min(F.when(~hunk & when, no)).over(of_hunk)
    h = h.withColumns({"stop": least(foreign), "stop_change": least(ds.starts(line, "---", "diff"))})
    within = lambda stop: ~hunk & (F.col(stop).isNull() | (no < F.col(stop)))
    body = F.when(ds.starts(line, "+", "-", " "), 1).otherwise(0)
    h = h.withColumns({
        "old_found": F.count_if(within("stop") & kind.isin("context", "blank", "del")).over(of_hunk), "new_found": F.count_if(within("stop") & kind.isin("context", "blank", "add")).over(of_hunk), "changes": F.count_if(within("stop_change") & change).over(of_hunk),
        "found": F.sum(body).over(of_good.rowsBetween(Window.unboundedPreceding, -1)), "all_found": F.sum(body).over(Window.partitionBy("patch_id", "good_no")), "want": F.first(F.greatest("old_count", "new_count")).over(of_good),
        "nth": F.row_number().over(Window.partitionBy("patch_id", "own").orderBy("line_no")), "nth_of_file": F.row_number().over(Window.partitionBy("patch_id", "file").orderBy("line_no")), "of_file": F.count_if(change).over(Window.partitionBy("patch_id", "file")),
    })
    old, paired = kind == "old_header", F.coalesce(F.col("next").startswith("+++ "), F.lit(False))
    odd = (line != "") & ~ds.starts(line, "@@", "---", "+++", "diff", "index") & ~ds.starts(line, " ", "+", "-", "\\")
    first_of_file = F.col("file").isNotNull() & (F.col("nth_of_file") == 1)
    short, share = F.col("want") > F.col("all_found"), lambda a, b: F.concat_ws("/", a, b)
    own = [
        _entry((kind == "git_header") & F.col("git_from").isNull(), "headers", "error", "bad_git_header", no),
        _entry((kind == "index") & (F.col("gits") > 0) & ~line.rlike(ds.INDEX), "headers", "warning", "bad_index", no),
        _entry(old & F.col("next").isNull(), "headers", "error", "no_new_header_at_end", no),
        _entry(old & F.col("next").isNotNull() & ~paired, "headers", "error", "no_new_header", no + 1),
        _entry(hunk & ~good, "hunk_headers", "error", "bad_hunk_header", no),
        *(_entry(good & (F.col(f"{x}_count") != F.col(f"{x}_found")), "hunk_counts", "warning", f"{x}_count", no, share(f"{x}_count", f"{x}_found")) for x in ("old", "new")),
        _entry(odd & (F.col("state") == "in"), "line_prefix", "error", "bad_prefix", no, F.substring("line", 1, 1)),
        _entry(F.col("own").isNotNull() & (F.col("nth") > 1), "duplicate_files", "error", "duplicate_file", no, F.col("path")),
        _entry(first_of_file & (F.col("of_file") > MANY_CHANGES), "change_size", "warning", "many_changes", None, F.col("file")),
        _entry(first_of_file & (F.col("of_file") > TOO_MANY_CHANGES), "change_size", "error", "too_many_changes", None, F.col("file")),
        _entry(hunk & ~good & (F.col("good_no") > 0) & (F.col("found") < F.col("want")), "truncation", "error", "short_hunk", no, share("want", "found")),
        _entry(good & short & F.col("next_good").isNotNull(), "truncation", "error", "short_hunk", F.col("next_good"), share("want", "all_found")),
        _entry(good & short & F.col("next_good").isNull(), "truncation", "error", "short_last_hunk", None, share("want", "all_found")),
        _entry(hunk & (F.col("changes") == 0), "empty_hunks", "warning", "empty_hunk", no),
        _entry((line == NO_NEWLINE) & (F.col("before").isNull() | ~ds.starts(F.col("before"), "+", "-", " ")), "newline_marker", "warning", "misplaced_marker", no),
    ]
    in_file = lambda c: F.count_if(F.col("file").isNotNull() & F.col(c))
    s = h.withColumn("own_issues", F.array_compact(F.array(*own))).groupBy("patch_id").agg(
        F.flatten(F.collect_list(F.when(F.size("own_issues") > 0, F.col("own_issues")))).alias("issues"), F.max("final").alias("final"),
        F.max(F.when(F.col("git_from").isNotNull(), no)).alias("git"), F.max(F.when(old & paired, no)).alias("pair"), F.count_if(hunk).alias("hunks"), F.count_if(old).alias("olds"),
        F.min(F.when(line.rlike(BINARY), no)).alias("binary"), F.count_if(change).alias("n"), in_file("added").alias("plus"), in_file("removed").alias("minus"), F.count_if(first_of_file).alias("files"),
        F.count_if(line.endswith("\r") & (no < F.col("final"))).alias("crlf"), F.max(F.when(no == F.col("final"), F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))).alias("last"), F.count_if((no > F.col("final") - 3) & line.startswith("\\ No newline")).alias("marks"),
    )
    c, ends = F.col, F.col("final") - 1
    whole = [
        _entry(c("git").isNotNull() & (F.coalesce("pair", F.lit(0)) < c("git")), "headers", "error", "no_file_headers_after_git"),
        _entry(c("hunks") == 0, "headers", "error", "no_hunks"),
        _entry((c("olds") == 0) & (c("hunks") > 0), "headers", "error", "no_file_headers"),
        *[_entry(c("binary").isNotNull(), "binary", "error", "binary", c("binary"))] * 2,
        _entry(c("n") == 0, "empty_patch", "error", "no_changes"),
        _entry((c("minus") > 0) & (c("plus") == 0), "empty_patch", "warning", "only_deletions"),
        _entry(c("files") > MAX_FILES, "empty_patch", "error", "too_many_files"),
        _entry((c("crlf") > 0) & (ends > c("crlf")), "line_endings", "warning", "mixed_line_endings", None, F.concat_ws("/", "crlf", ends - c("crlf"))),
        _entry((c("crlf") > 0) & (ends == c("crlf")), "line_endings", "warning", "crlf", None, c("crlf").cast("string")),
        _entry((c("marks") == 0) & ds.starts(c("last"), "+", "-"), "truncation", "warning", "ends_with_change"),
    ]
    return s.select("patch_id", F.inline(F.concat("issues", F.array_compact(F.array(*whole)))))


def validate_patches(predictions: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row per patch: errors, warnings, score in 0..1 (below 0.5 when syntax or meaning fail), is_valid."""
    issues = patch_issues(predictions) if issues is None else issues
    error = F.col("level") == "error"
    # of the two reports of binary content one counts as meaning
    failed = error & ~F.col("check").isin(*_COMMON)
    sums = issues.groupBy("patch_id").agg(F.count_if(error).alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), F.count_if(failed).alias("failed"))
    refused = F.col("patch").isNull() | (F.col("patch") == "") | (F.length("patch") > MAX_CHARS)
    joined = predictions.select("patch_id", "run_id", "instance_id", refused.alias("refused")).join(sums, "patch_id", "left")
    errors, warnings = (F.when(F.col("refused"), refused_n).otherwise(F.coalesce(c, F.lit(0))) for c, refused_n in (("errors", 1), ("warnings", 0)))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(100) - errors * 20 - warnings * 5) / 100.0))
    score = F.when(F.col("refused"), 0.0).when(F.coalesce("failed", F.lit(0)) > 0, F.least(raw, F.lit(0.49))).otherwise(raw)
    return joined.select("patch_id", "run_id", "instance_id", errors.cast("long").alias("errors"), warnings.cast("long").alias("warnings"), score.alias("score"), (errors == 0).alias("is_valid"))


def issue_histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("check", "code", "level").agg(F.count("*").alias("n"), F.count_distinct("patch_id").alias("patches"))


#: What to do about an issue, by its code.
ADVICE = {
    "bad_git_header": "Write the header as: diff --git a/file b/file",
    "no_new_header": "Put a +++ b/path line after the --- line",
    "no_new_header_at_end": "Put a +++ b/path line after the --- line",
    "no_file_headers": "Put --- a/path and +++ b/path lines first",
    "no_file_headers_after_git": "Put --- a/path and +++ b/path lines after the git header",
    "no_hunks": "Write hunk headers as: @@ -start,count +start,count @@",
    "bad_hunk_header": "Write hunk headers as: @@ -start,count +start,count @@",
    "old_count": "Recount the hunk's lines",
    "new_count": "Recount the hunk's lines",
    "bad_prefix": "Begin hunk lines with a space, +, - or a backslash",
    "duplicate_file": "Put all changes of a file into one part",
    "binary": "Take binary data out",
    "mixed_line_endings": "Use LF line ends throughout",
    "crlf": "Use LF line ends throughout",
    "empty_hunk": "Drop hunks without changes",
    "short_hunk": "Get the whole patch again",
    "short_last_hunk": "Get the whole patch again",
    "ends_with_change": "Get the whole patch again",
}


def suggest_fixes(issues: DataFrame) -> DataFrame:
    """Distinct advice for each patch, in order of the first line that asks for it."""
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    rows = issues.select("patch_id", F.coalesce("line_number", F.lit(0)).alias("line"), advice[F.col("code")].alias("advice")).where("advice is not null")
    first = rows.groupBy("patch_id", "advice").agg(F.min("line").alias("line"))
    return first.groupBy("patch_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "advice")))["advice"], "; ").alias("advice"))


def autofix_patches(predictions: DataFrame) -> DataFrame:
    """Patches with real counts in their hunk headers, LF line ends and a +++ line after each --- line."""
    unix = predictions.where("patch is not null").withColumn("patch", F.replace("patch", F.lit("\r\n"), F.lit("\n")))
    lines = ds.patch_lines(unix)
    counts = ds.hunk_counts(lines).select(F.col("patch_id").alias("hunk_patch"), F.col("line_no").alias("hunk_line"), "old_found", "new_found")
    h = ds.with_headers(lines).withColumn("next", F.lead("line").over(ds.in_order()))
    j = h.join(counts, (F.col("patch_id") == F.col("hunk_patch")) & (F.col("line_no") == F.col("hunk_line")), "left")
    number = lambda start, n: F.when(F.col(n) == 1, F.col(start).cast("string")).otherwise(F.concat_ws(",", start, n))
    header = F.concat(F.lit("@@ -"), number("old_start", "old_found"), F.lit(" +"), number("new_start", "new_found"), F.lit(" @@"), F.regexp_replace("line", ds.HUNK, ""))
    pair = F.concat(F.col("line"), F.lit("\n+++ "), F.replace(F.substr("line", F.lit(5)), F.lit("a/"), F.lit("b/")))
    fixed = F.when(F.col("good_hunk"), header).when((F.col("kind") == "old_header") & ~F.coalesce(F.col("next").startswith("+++ "), F.lit(False)), pair).otherwise(F.col("line"))
    return j.groupBy("patch_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", fixed.alias("t"))))["t"], "\n").alias("patch"))
