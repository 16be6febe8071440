"""What is found wrong in extracted patches, and repairs: all over (patch_id, line_no), in one layout by patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import diff_structure as ds

#: Confidence of an extracted patch by its format.
BASE = {"unified": 0.9, "git": 0.95, "fenced_diff": 0.8, "fenced_patch": 0.75, "file_blocks": 0.7, "search_replace": 0.6, "edit_instructions": 0.5}
MARK = "\\ No newline at end of file"


def _changes(line: Column) -> Column:
    return (line.startswith("+") & ~line.startswith("+++")) | (line.startswith("-") & ~line.startswith("---"))


def hunk_lines(lines: DataFrame) -> DataFrame:
    """Lines with hunk headers, and what each hunk holds: old_found, new_found over its lines up to the first that is none (an empty line ends a hunk)."""
    line = F.col("line")
    h = ds.with_headers(lines).withColumn("is_hunk", line.startswith("@@"))
    ends = ~F.col("is_hunk") & (ds.starts(line, "---", "diff") | (line.startswith("+++")) | ~ds.starts(line, "+", "-", " ", "\\"))
    h = h.withColumn("no", F.count_if("is_hunk").over(ds.so_far()))
    span = Window.partitionBy("patch_id", "no")
    h = h.withColumn("stop", F.min(F.when((F.col("no") > 0) & ends, F.col("line_no"))).over(span))
    inside = (F.col("no") > 0) & ~F.col("is_hunk") & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
    count = lambda sign: F.count_if(inside & (line.startswith(sign) | line.startswith(" "))).over(span)
    return h.withColumns({"old_found": count("-"), "new_found": count("+")})


def _checked(lines: DataFrame, strict: bool = False, tolerance: int = 1) -> DataFrame:
    """Lines with what each of them says: i and w (issues and warnings), file, is_hunk, change, ending, marked; and t (the line as mended) and closed (a marker was put after it)."""
    line, no = F.col("line"), F.col("line_no").cast("string")
    h = hunk_lines(lines).withColumns({"next": F.lead("line").over(ds.in_order()), "before": F.lag("line").over(ds.in_order()), "last": F.max("line_no").over(Window.partitionBy("patch_id"))})
    paired = line.startswith("--- ") & F.coalesce(F.col("next").startswith("+++ "), F.lit(False))
    said = lambda code: F.concat(F.lit(code + ":"), no)
    off = lambda side: F.abs(F.col(f"{side}_found") - F.col(f"{side}_count"))
    counted = [F.when(F.col("good_hunk") & (off(s) > (0 if strict else tolerance)), said(s + "_count")) for s in ("old", "new")]
    issue = [F.when(line.startswith("--- ") & ~paired, said("no_new_header")), F.when(F.col("is_hunk") & ~F.col("good_hunk"), said("bad_hunk_header")), *(counted if strict else [])]
    is_last = F.col("line_no") == F.col("last")
    ending = is_last & F.regexp_replace(line, r"(?U)^\s+", "").rlike("^[+-]")
    marked = (F.col("line_no") > F.col("last") - 3) & line.startswith("\\ No newline")
    each = lambda x: F.array_compact(F.array(*x))
    number = lambda start, n: F.when(F.col(n) == 1, F.col(start).cast("string")).otherwise(F.concat_ws(",", start, n))
    rest = F.regexp_replace(F.regexp_replace(line, r"(?s)^@@.*?@@", ""), r"(?U)^\s+|\s+$", "")
    header = F.concat(F.lit("@@ -"), number("old_start", "old_found"), F.lit(" +"), number("new_start", "new_found"), F.lit(" @@ "), rest)
    bare = (F.col("line_no") == 1) & F.col("is_hunk")
    closed = is_last & (line != "") & ~line.startswith("\\") & F.coalesce(ds.starts(F.col("before"), "+", "-", " "), F.lit(False))
    text = F.concat(F.when(bare, "--- a/file\n+++ b/file\n").otherwise(""), F.when(F.col("good_hunk"), header).otherwise(line), F.when(closed, "\n" + MARK).otherwise(""))
    return h.withColumns({
        "i": each(issue), "w": each([] if strict else counted).cast("array<string>"), "file": paired | line.startswith("diff --git"), "change": _changes(line),
        "ending": ending, "marked": marked, "t": text, "closed": closed, "bare": bare,
    })


def _found(c: str) -> Column:
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct("line_no", c)))), lambda x: x[c]))


def _text(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.struct("line_no", c)))[c], "\n")


def _flags() -> tuple[Column, ...]:
    """Whether a patch has file headers, hunks, changes, and may be cut off."""
    return F.bool_or("file"), F.bool_or("is_hunk"), F.bool_or("change"), F.bool_or("ending") & ~F.bool_or("marked")


def _whole(file: Column | str) -> Column:
    return F.array_compact(F.array(F.when(~(F.col(file) if isinstance(file, str) else file), "no_file_headers"), F.when(~F.col("hunk"), "no_hunks"), F.when(~F.col("change"), "no_changes")))


def validate_extracted(predictions: DataFrame, strict: bool = False, tolerance: int = 1) -> DataFrame:
    """One row per patch: issues and warnings (codes with line numbers, comma-joined), n_issues, n_warnings, is_valid.

    A --- line needs a +++ line after it, hunk headers have to be well-formed and there have to be file headers, hunks
    and changes. Counts that differ by more than the tolerance are warnings, or, when strict, any that differ are
    issues. A patch that ends in a change may be cut off. A null or empty patch has the one issue empty.
    """
    h = _checked(ds.patch_lines(predictions.where("patch <> ''")), strict, tolerance)
    s = h.groupBy("patch_id").agg(_found("i").alias("i"), _found("w").alias("w"), *(c.alias(n) for n, c in zip(("file", "hunk", "change", "cut"), _flags(), strict=True)))
    s = s.select("patch_id", F.concat("i", _whole("file")).alias("i"), F.concat("w", F.array_compact(F.array(F.when(F.col("cut"), "cut_off")))).alias("w"))
    none = F.array().cast("array<string>")
    out = predictions.select("patch_id", "patch").join(s, "patch_id", "left")
    out = out.select("patch_id", F.coalesce("i", F.array(F.lit("empty"))).alias("i"), F.coalesce("w", none).alias("w"))
    return out.select("patch_id", F.array_join("i", ",").alias("issues"), F.array_join("w", ",").alias("warnings"), F.size("i").alias("n_issues"), F.size("w").alias("n_warnings"), (F.size("i") == 0).alias("is_valid"))


def fix_hunk_counts(predictions: DataFrame) -> DataFrame:
    """patch_id, patch: file headers before a first line that is a hunk header, real counts in hunk headers (one is left out), and a marker after a last line that follows a change or context."""
    fixed = _checked(ds.patch_lines(predictions.where("patch <> ''"))).groupBy("patch_id").agg(_text("t").alias("fixed"))
    return predictions.select("patch_id", "patch").join(fixed, "patch_id", "left").select("patch_id", F.coalesce("fixed", "patch").alias("patch"))


def mended(patches: DataFrame, *more: str) -> DataFrame:
    """patch_id, further columns, issues and warnings of patches that are not empty, tried (the patch, mended where anything was said), n_issues_after and n_warnings_after (what validate_extracted says of it).

    Repairs are local, so what a second check would say follows from the first layout: mended hunk headers hold real
    counts, a first hunk header has file headers before it, and a patch with a marker after it does not end in a
    change. Patch ids are to be distinct. Lines are laid out and gathered once.
    """
    lines = patches.select("patch_id", *more, F.posexplode(F.split("patch", "\n", -1)).alias("pos", "line"))
    lines = lines.select("patch_id", *more, (F.col("pos") + 1).alias("line_no"), "line", ds.kind_of(F.col("line")).alias("kind"))
    s = _checked(lines).groupBy("patch_id", *more).agg(
        _found("i").alias("i"), _found("w").alias("w"), *(c.alias(n) for n, c in zip(("file", "hunk", "change", "cut"), _flags(), strict=True)),
        F.bool_or("bare").alias("bare"), F.bool_or("closed").alias("closed"), _text("line").alias("patch"), _text("t").alias("fixed"))
    s = s.withColumns({"issues": F.concat("i", _whole("file")), "warnings": F.concat("w", F.array_compact(F.array(F.when(F.col("cut"), "cut_off"))))})
    odd = (F.size("issues") > 0) | (F.size("warnings") > 0)
    after = F.size("i") + F.size(_whole(F.col("file") | F.col("bare")))
    return s.select("patch_id", *more, F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"), F.when(odd, F.col("fixed")).otherwise(F.col("patch")).alias("tried"), F.when(odd, after).otherwise(0).alias("n_issues_after"), (F.col("cut") & ~F.col("closed")).cast("int").alias("n_warnings_after"))


def confidence(patch: Column, base: Column, valid: Column, n_issues: Column) -> Column:
    """Confidence in an extracted patch: its format's, more if it is valid, less by its issues; then by its headers, length and changes."""
    lines = F.split(patch, "\n", -1)
    has = lambda prefix: F.exists(lines, lambda x: x.startswith(prefix))
    c = F.when(valid, F.least(F.lit(1.0), base + 0.1)).otherwise(base * F.greatest(F.lit(0.3), F.lit(1.0) - n_issues * 0.1))
    for prefix in ("--- a/", "@@ "):
        c = F.when(has(prefix), F.least(F.lit(1.0), c + 0.02)).otherwise(c)
    c = F.when(F.size(lines) < 4, c * 0.8).otherwise(c)
    c = F.when(~F.exists(lines, _changes), c * 0.5).otherwise(c)
    return F.when(patch.isNull() | (patch == ""), 0.0).otherwise(c)


def extraction_confidence(candidates: DataFrame) -> DataFrame:
    """patch_id and confidence of patches (patch_id, patch, format)."""
    base = F.coalesce(F.create_map(*(F.lit(x) for kv in BASE.items() for x in kv))[F.col("format")], F.lit(0.5))
    j = candidates.join(validate_extracted(candidates).select("patch_id", "is_valid", "n_issues"), "patch_id")
    return j.select("patch_id", confidence(F.col("patch"), base, F.col("is_valid"), F.col("n_issues")).alias("confidence"))
