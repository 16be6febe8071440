"""Structure of diffs: one row per line, and what follows from it by windows and aggregates over (patch_id, line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Formats of diffs.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
GIT_HEADER = r"^diff --git (\S+) (\S+)\z"
FILE_HEADER = r"(?s)^--- ([^\t\n]+)(?:\t.*)?\z"
INDEX = r"^index [a-f0-9]+\.\.[a-f0-9]+(?: \d+)?\z"


def starts(line: Column, *prefixes: str) -> Column:
    found = line.startswith(prefixes[0])
    for p in prefixes[1:]:
        found = found | line.startswith(p)
    return found


def kind_of(line: Column) -> Column:
    rules = [("diff --git", "git_header"), ("index ", "index"), ("--- ", "old_header"), ("+++ ", "new_header"), ("@@", "hunk"), ("\\", "marker"), ("+", "add"), ("-", "del"), (" ", "context")]
    out = F.when(line == "", "blank")
    for prefix, kind in rules:
        out = out.when(line.startswith(prefix), kind)
    return out.otherwise("other")


def in_order() -> Window:
    return Window.partitionBy("patch_id").orderBy("line_no")


def so_far() -> Window:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def patch_lines(predictions: DataFrame) -> DataFrame:
    """patch_id, line_no from 1, line, kind, file_no, hunk_no (headers so far). A null patch has no lines.

    Lines are exploded once and laid out by patch; every check shares that layout.
    """
    lines = predictions.select("patch_id", F.posexplode(F.split("patch", "\n", -1)).alias("pos", "line"))
    lines = lines.select("patch_id", (F.col("pos") + 1).alias("line_no"), "line", kind_of(F.col("line")).alias("kind"))
    return lines.withColumns({"file_no": F.count_if(F.col("kind") == "old_header").over(so_far()), "hunk_no": F.count_if(F.col("kind") == "hunk").over(so_far())})


def with_headers(lines: DataFrame) -> DataFrame:
    """Adds what headers say: git_from, git_to, path (of a file header), and the numbers of a well-formed hunk header."""
    line = F.col("line")
    number = lambda g, absent=None: F.regexp_extract(line, HUNK, g) if absent is None else F.when(F.regexp_extract(line, HUNK, g) == "", absent).otherwise(F.regexp_extract(line, HUNK, g))
    good = (F.col("kind") == "hunk") & line.rlike(HUNK)
    git = (F.col("kind") == "git_header") & line.rlike(GIT_HEADER)
    old = (F.col("kind") == "old_header") & line.rlike(FILE_HEADER)
    return lines.withColumns(
        {
            "good_hunk": good,
            "git_from": F.when(git, F.regexp_extract(line, GIT_HEADER, 1)),
            "git_to": F.when(git, F.regexp_extract(line, GIT_HEADER, 2)),
            "path": F.when(old, F.regexp_extract(line, FILE_HEADER, 1)),
            "old_start": F.when(good, number(1).try_cast("long")),
            "old_count": F.when(good, number(2, "1").try_cast("long")),
            "new_start": F.when(good, number(3).try_cast("long")),
            "new_count": F.when(good, number(4, "1").try_cast("long")),
        }
    )


def patch_files(lines: DataFrame) -> DataFrame:
    """Files of a patch: each well-formed git header; a file header only while no file is known yet."""
    h = with_headers(lines)
    known = F.count_if(F.col("git_from").isNotNull() | F.col("path").isNotNull()).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    rows = h.where("git_from is not null or path is not null").withColumn("known", known)
    return rows.where("git_from is not null or known = 0").select("patch_id", F.coalesce("git_from", "path").alias("from_path"), F.col("git_to").alias("to_path"), "line_no")


def patch_hunks(lines: DataFrame) -> DataFrame:
    """Well-formed hunk headers with their file: the from path of the file that patch_files has by then."""
    h = with_headers(lines)
    first = F.first("path", ignorenulls=True).over(so_far())
    current = F.coalesce(F.last("git_from", ignorenulls=True).over(so_far()), first)
    return h.withColumn("file", current).where("good_hunk").select("patch_id", "line_no", "old_start", "old_count", "new_start", "new_count", "file")


def carried(lines: DataFrame) -> DataFrame:
    """Adds file: the path of the last file header that begins with a/, and added / removed flags."""
    h = with_headers(lines)
    own = F.when(F.col("line").startswith("--- a/"), F.col("path"))
    line = F.col("line")
    return h.withColumns({"own": own, "file": F.last(own, ignorenulls=True).over(so_far()), "added": line.startswith("+") & ~line.startswith("+++"), "removed": line.startswith("-") & ~line.startswith("---")})


def file_changes(lines: DataFrame) -> DataFrame:
    """Per file: added, removed, hunks. The file is its header's path with a/; lines before any header do not count."""
    c = carried(lines).where("file is not null")
    return c.groupBy("patch_id", "file").agg(F.count_if("added").alias("added"), F.count_if("removed").alias("removed"), F.count_if(F.col("kind") == "hunk").alias("hunks"))


def patch_summary(lines: DataFrame) -> DataFrame:
    changes = file_changes(lines).groupBy("patch_id").agg(F.count("*").alias("files_changed"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"), F.sum("hunks").alias("hunks"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))
    form = lines.groupBy("patch_id").agg(F.when(F.count_if(F.col("kind") == "git_header") > 0, "git").when(F.count_if(F.col("kind") == "old_header") > 0, "unified").otherwise("unknown").alias("format"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return form.join(changes, "patch_id", "left").select("patch_id", zero("files_changed"), zero("lines_added"), zero("lines_removed"), zero("hunks"), "format", F.coalesce("files", F.lit("")).alias("files"))


def affected_files(lines: DataFrame) -> DataFrame:
    """Distinct paths by first sight, from a/ file headers and git headers, without a/."""
    h = with_headers(lines)
    path = F.when(F.col("line").startswith("--- a/"), F.col("path")).when(F.col("git_from").isNotNull(), F.col("git_from"))
    seen = h.select("patch_id", "line_no", F.regexp_replace(path, "^a/", "").alias("path")).where("path is not null and path <> '/dev/null'")
    first = seen.groupBy("patch_id", "path").agg(F.min("line_no").alias("line_no"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "path")))
    return first.groupBy("patch_id").agg(F.array_join(ordered["path"], ",").alias("paths"), F.count("*").alias("n_files"))


def change_counts(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.groupBy("patch_id").agg(
        F.count_if(line.startswith("+") & ~line.startswith("+++")).alias("added"), F.count_if(line.startswith("-") & ~line.startswith("---")).alias("removed"), F.count_distinct(F.when(line.startswith("--- a/"), line)).alias("files")
    )


def hunk_counts(lines: DataFrame, blank_ends: bool = False) -> DataFrame:
    """Declared and found counts of each well-formed hunk. The scan stops at a header or a foreign line; an empty line is context, unless blank_ends."""
    line = F.col("line")
    stop = (line.startswith("---")) | (line.startswith("+++")) | F.col("kind").isin("git_header", "other", "index") | ((F.col("kind") == "blank") if blank_ends else F.lit(False))
    span = Window.partitionBy("patch_id", "hunk_no")
    h = with_headers(lines).where("hunk_no > 0").withColumn("stop", F.min(F.when((F.col("kind") != "hunk") & stop, F.col("line_no"))).over(span))
    inside = (F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))) & (F.col("kind") != "hunk")
    kept = F.col("kind").isin("context", "blank")
    out = h.groupBy("patch_id", "hunk_no").agg(
        F.min(F.when(F.col("kind") == "hunk", F.col("line_no"))).alias("line_no"), F.bool_or("good_hunk").alias("good"), F.max("old_count").alias("old_count"), F.max("new_count").alias("new_count"),
        F.count_if(inside & (kept | (F.col("kind") == "del"))).alias("old_found"), F.count_if(inside & (kept | (F.col("kind") == "add"))).alias("new_found"))
    return out.where("good").select("patch_id", "hunk_no", "line_no", "old_count", "old_found", "new_count", "new_found")
