"""Diffs out of free-text responses: one frame of candidates for each format, then the best of them."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import diff_checks, repair

#: What a line of a diff may begin with, lines of commit messages, the shape of file headers, and the forms in which responses give files, pairs of texts, names of files and instructions.
ALLOWED = r"^(?:[ +\-@\\]|diff|index|new file|deleted)"
MESSAGE = r"^(?:Author:|Date:|commit [a-f0-9]+)"
HEADERS = r"(?m)^--- [^\n]*\n\+\+\+ "
FILE_BLOCK = r"(?s)<file>([^<]+)</file>.*?<old>(.*?)</old>.*?<new>(.*?)</new>"
PAIR = r"(?is)(?:SEARCH|<<<old>>>):\s*\n(.*?)\n(?:REPLACE|<<<new>>>):\s*\n(.*?)(?:\n\n|\z)"
OTHER_PAIR = r"(?s)<<<old>>>\s*\n(.*?)\n<<<new>>>\s*\n(.*?)(?:\n|\z)"
NAMED = r"(?:file|File|in|In)\s*[:\s]+([a-zA-Z0-9_/.-]+\.py)"
OWN_NAME = r"(?m)^#\s*([a-zA-Z0-9_/.-]+\.py)"
EDITED = r"(?:in|In|file|File)\s+([a-zA-Z0-9_/.-]+\.py)"
INSTRUCTIONS = {
    "changes": r'(?i)change\s+"([^"]+)"\s+to\s+"([^"]+)"',
    "replacements": r'(?i)replace\s+"([^"]+)"\s+with\s+"([^"]+)"',
    "additions": r'(?i)add\s+"([^"]+)"\s+after\s+line\s+(\d+)',
    "deletions": r"(?i)delete\s+lines?\s+(\d+)(?:\s*-\s*(\d+))?",
}
#: A candidate of this final confidence wins at once; below the other it is not looked at.
SURE, LEAST = 0.8, 0.3


def _stripped(text: Column, left: bool = False) -> Column:
    return F.regexp_replace(text, r"^[ \t-\r]+|[ \t-\r]+\z" if left else r"[ \t-\r]+\z", "")


def _until(text: Column, stop: Callable[[Column], Column]) -> Column:
    """The lines before the first one that stop holds for."""
    lines = F.split(text, "\n", -1)
    at = F.array_position(F.transform(lines, stop), True).cast("int")
    return _stripped(F.array_join(F.when(at == 0, lines).otherwise(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)))), "\n"))


def _foreign(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]") & ~line.rlike(ALLOWED)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _told(patch: Column, order: int, form: str, hundredths: Callable[[Column], Column]) -> Column:
    """A candidate as a struct."""
    return let(patch, lambda x: F.struct(F.lit(order).alias("order"), F.lit(form).alias("format"), x.alias("patch"), (hundredths(x) / 100).alias("confidence")))


def _frame(responses: DataFrame, candidate: Column) -> DataFrame:
    """Candidates of one format as rows."""
    return responses.select("response_id", candidate.alias("c")).where("c is not null").select("response_id", "c.order", "c.format", "c.patch", "c.confidence")


def _no_hunk(patch: Column) -> Column:
    return F.when(patch.contains("@@"), 0).otherwise(30)


def git_candidate() -> Column:
    """From the first git header to the first line that is neither diff nor commit message."""
    c = F.col("content")
    text = _until(F.substr(c, F.locate("diff --git", c)), lambda x: _foreign(x) & ~x.rlike(MESSAGE))
    return F.when(c.contains("diff --git"), _told(text, 1, "git", lambda x: 95 - _no_hunk(x)))


def unified_candidate() -> Column:
    """From the first file header, where there is no git header and no fence of a diff."""
    c = F.col("content")
    count = lambda x, mark: (F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))) / 3
    sure = lambda x: 90 - _no_hunk(x) - F.when(count(x, "---") != count(x, "+++"), 20).otherwise(0)
    return F.when(~c.contains("diff --git") & ~c.contains("```diff") & ~c.contains("```patch") & c.rlike(HEADERS), _told(_until(F.substr(c, F.locate("--- ", c)), _foreign), 3, "unified", sure))


def fenced_candidate() -> Column:
    """The first diff fence, else the first patch fence, else the first plain fence that looks like a diff."""
    c = F.col("content")
    inside = lambda kind: _stripped(F.regexp_extract(c, f"(?s)```{kind}\n(.*?)```", 1), left=True)
    has = lambda kind: c.rlike(f"(?s)```{kind}\n.*?```")
    like = lambda x: x.rlike(HEADERS) | x.contains("diff --git")
    more = lambda x: F.when(x.rlike(HEADERS), 10).when(x.contains("diff --git"), 15).otherwise(0)
    plain = F.get(F.filter(F.regexp_extract_all(c, F.lit("(?s)```\n(.*?)```"), 1), like), 0)
    made = F.when(has("diff"), _told(inside("diff"), 2, "fenced", lambda x: 80 + more(x))).when(has("patch"), _told(inside("patch"), 2, "fenced", lambda x: 75 + more(x)))
    other = let(plain, lambda x: F.when(x.isNotNull(), _told(_stripped(x, left=True), 2, "fenced", lambda _: F.lit(60))))
    return F.when(c.contains("```"), made.otherwise(other))


def extract_git_diff(responses: DataFrame) -> DataFrame:
    return _frame(responses, git_candidate())


def extract_unified_diff(responses: DataFrame) -> DataFrame:
    return _frame(responses, unified_candidate())


def extract_fenced(responses: DataFrame) -> DataFrame:
    return _frame(responses, fenced_candidate())


def detect_edit_instructions(responses: DataFrame) -> DataFrame:
    """Responses that only tell what to change: a Python file, and counts of each kind of instruction."""
    c = F.col("content")
    counts = {k: F.size(F.regexp_extract_all(c, F.lit(p), 0)) for k, p in INSTRUCTIONS.items()}
    rows = responses.select("response_id", F.regexp_extract(c, EDITED, 1).alias("path"), *(v.alias(k) for k, v in counts.items()), F.lit(0.3).alias("confidence"))
    return rows.where((F.col("path") != "") & (sum((F.col(k) for k in INSTRUCTIONS), F.lit(0)) > 0))


def search_replace_candidate() -> Column:
    """Each pair of a searched and a replacing text as a patch of one hunk at line 1, of the first Python file that is named."""
    c = F.col("content")
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all(c, F.lit(p), 1).alias("old"), F.regexp_extract_all(c, F.lit(p), 2).alias("new"))
    side = lambda x: F.split(_stripped(x, left=True), "\n", -1)
    led = lambda mark, lines: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(mark), x)), "\n")

    def hunk(path: Column, old: Column, new: Column) -> Column:
        at = F.concat(F.lit("@@ -1,"), F.size(old).cast("string"), F.lit(" +1,"), F.size(new).cast("string"), F.lit(" @@"))
        return F.concat_ws("\n", F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path), at, led("-", old), led("+", new))

    def whole(found: Column) -> Column:
        named, own = F.nullif(F.regexp_extract(c, NAMED, 1), F.lit("")), F.nullif(F.regexp_extract(F.get(found, 0)["old"], OWN_NAME, 1), F.lit(""))
        patch = lambda path: F.array_join(F.transform(found, lambda x: let(side(x["old"]), lambda old: let(side(x["new"]), lambda new: hunk(path, old, new)))), "\n")
        return F.when(F.size(found) > 0, let(F.coalesce(named, own), lambda known: _told(patch(F.coalesce(known, F.lit("unknown_file.py"))), 5, "search_replace", lambda _: F.when(known.isNotNull(), 60).otherwise(40))))

    return let(F.when(c.rlike(PAIR), pairs(PAIR)).otherwise(pairs(OTHER_PAIR)), whole)


def extract_search_replace(responses: DataFrame) -> DataFrame:
    return _frame(responses, search_replace_candidate())


def extract_file_blocks(responses: DataFrame) -> DataFrame:
    """Triples of a file, its old and its new text as unified diffs with three lines of context; equal texts add none."""

    @F.pandas_udf("string")
    def diff(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        def one(p: str, a: str, b: str) -> str:
            return "\n".join(line.rstrip("\n") for line in difflib.unified_diff(a.splitlines(), b.splitlines(), f"a/{p}", f"b/{p}", n=3, lineterm=""))

        return pd.Series([one(*x) for x in zip(path, old, new, strict=True)])

    part = lambda g: F.regexp_extract_all("content", F.lit(FILE_BLOCK), g)
    blocks = responses.where(F.col("content").contains("<file>")).select("response_id", F.posexplode(F.arrays_zip(part(1).alias("path"), part(2).alias("old"), part(3).alias("new"))).alias("pos", "b"))
    made = blocks.select("response_id", "pos", diff(F.trim("b.path"), _stripped(F.col("b.old"), True), _stripped(F.col("b.new"), True)).alias("diff")).where("diff <> ''")
    whole = made.groupBy("response_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "diff")))["diff"], "\n").alias("patch"))  # of one response
    return whole.select("response_id", F.lit(4).alias("order"), F.lit("file_blocks").alias("format"), "patch", F.lit(0.7).alias("confidence"))


def normal(patch: Column) -> Column:
    """No trailing white space, no quotes around paths, a/ and b/ before them, one line feed at the end."""

    def headed(x: Column, mark: str, side: str) -> Column:
        plain = F.regexp_replace(F.substr(x, F.lit(5)), '^"|"$', "")
        return let(plain, lambda path: F.concat(F.lit(f"{mark} "), F.when(path.startswith(side), path).otherwise(F.concat(F.lit(side), F.regexp_replace(path, "^/+", "")))))

    line = lambda x: F.when(x.startswith("--- "), headed(x, "---", "a/")).when(x.startswith("+++ "), headed(x, "+++", "b/")).otherwise(x)
    lines = F.transform(F.transform(F.split(patch, "\n", -1), lambda x: _stripped(x)), line)
    return F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"\n+\z", ""), F.lit("\n"))


def normalize_patches(predictions: DataFrame) -> DataFrame:
    return predictions.select("patch_id", normal(F.col("patch")).alias("patch"))


def candidates(responses: DataFrame) -> DataFrame:
    """Candidates of every format that yields a patch: all that the text itself holds in one pass over it."""
    found = F.array_compact(F.array(git_candidate(), fenced_candidate(), unified_candidate(), search_replace_candidate()))
    return responses.select("response_id", F.inline(found)).unionByName(extract_file_blocks(responses))


def _final(patch: Column, form: Column, base: Column, valid: Column, n_issues: Column, cut_off: Column) -> Column:
    """Confidence in a candidate that was looked at."""
    kind = F.when(form == "fenced", F.when(F.abs(base - 0.75) < 0.001, "fenced_patch").otherwise("fenced_diff")).otherwise(form)
    at_first = F.coalesce(F.create_map(*(F.lit(x) for kv in repair.BASE.items() for x in kv))[kind], F.lit(0.5))
    sure = repair.confidence(patch, at_first, valid, n_issues)
    sure = F.when(cut_off, F.least(sure, F.lit(0.95))).otherwise(sure)
    open_end = ~patch.endswith("\n") & F.element_at(F.split(patch, "\n", -1), -1).rlike("^[+ -]")
    return F.when(open_end, F.least(sure, F.lit(0.7))).otherwise(sure)


def extract_patches(responses: DataFrame) -> DataFrame:
    """The patch of each response: the first candidate that is valid and sure, else the one of highest confidence, the earlier on ties.

    A candidate with issues or warnings is mended once (see repair.mended) and looked at again; one that then
    still has warnings is out of the running. Valid ones are normalised. Confidence is repair.confidence, at most 0.95
    where anything said that the patch may be cut off, and at most 0.7 for one that ends in a change without a line
    feed. issues are those that the candidate had at first. A response without a candidate has a null patch.

    Lines of all candidates are laid out once; both checks and the repair come out of that layout, so there is one
    exchange by candidate and one by response.
    """
    some = candidates(responses).where((F.col("confidence") >= LEAST) & (F.col("patch") != "")).withColumn("patch_id", F.concat_ws("#", "response_id", "format"))
    c = repair.mended(some, "response_id", "order", "format", "confidence").where("n_warnings_after = 0")
    valid, cut_off = F.col("n_issues_after") == 0, F.col("warnings").contains("cut_off")
    judged = lambda p: F.struct(p.alias("patch"), _final(p, F.col("format"), F.col("confidence"), valid, F.col("n_issues_after"), cut_off).alias("final"))
    said = F.concat_ws(",", F.nullif("issues", F.lit("")), F.nullif("warnings", F.lit("")))
    c = c.select("response_id", "order", "format", valid.alias("is_valid"), said.alias("issues"), let(F.when(valid, normal(F.col("tried"))).otherwise(F.col("tried")), judged).alias("p"))
    sure = F.col("p.final")
    early = F.col("is_valid") & (sure >= SURE)
    rank = F.struct((~early).alias("late"), F.when(early, F.lit(0.0)).otherwise(-sure).alias("least"), "order")
    told = F.struct("format", "p.patch", sure.alias("final"), "is_valid", "issues")
    best = c.groupBy("response_id").agg(F.min_by(told, F.when(early | (sure >= LEAST), rank)).alias("b"))
    joined = responses.select("response_id", "instance_id", "model").join(best, "response_id", "left")
    return joined.select("response_id", "instance_id", "model", "b.format", "b.patch", F.col("b.final").alias("confidence"), F.coalesce("b.is_valid", F.lit(False)).alias("is_valid"), F.coalesce("b.issues", F.lit("no_patch")).alias("issues"))


def candidate_formats(responses: DataFrame) -> DataFrame:
    """Candidates of the formats that are cut out of the text, by model: how many, and the sum of their confidence."""
    found = F.array_compact(F.array(git_candidate(), fenced_candidate(), unified_candidate()))
    c = responses.select("model", F.inline(found))
    return c.groupBy("model", "format").agg(F.count("*").alias("n"), F.sum((F.col("confidence") * 100).cast("decimal(10,0)").cast("long")).alias("hundredths"))


def extraction_report(extracted: DataFrame) -> DataFrame:
    """What extract_patches() came to, by model and by format of the winners (null: no patch), with totals: n, share of the model's responses, valid, mean_confidence (in whole millionths) of those with a patch, and failed_share (no valid patch).

    level tells the rows apart: 0 model and format, 1 model, 3 all.
    """
    sure = F.round(F.col("confidence") * 1_000_000).cast("long")
    sums = extracted.rollup("model", "format").agg(
        F.count("*").alias("n"), F.count_if("is_valid").alias("valid"), F.sum(sure).alias("sure"), F.count("confidence").alias("found"), F.grouping_id().alias("level"))
    of_model = F.max(F.when(F.col("level") == 1, F.col("n"))).over(Window.partitionBy("model"))  # a row for each model and format
    share = F.when(F.col("level") == 3, 1.0).otherwise(F.col("n") / of_model)
    return sums.select("model", "format", "level", "n", share.alias("share"), "valid", F.expr("sure div found").alias("mean_confidence"), ((F.col("n") - F.col("valid")) / F.col("n")).alias("failed_share"))


def emit_valid_patches(responses: DataFrame) -> DataFrame:
    """instance_id, model, patch and reason of every response: the patch where extraction and the full validator find no error, else all that they say.

    Messages are check:code:line, comma-joined, in order of their lines; what was said at extraction comes first.
    """
    e = cut(extract_patches(responses))  # both sides of the join read it
    found = e.where("patch is not null").select(F.col("response_id").alias("patch_id"), "patch")
    errors = diff_checks.patch_issues(found).where("level = 'error'")
    message = F.struct(F.coalesce("line_number", F.lit(0)).alias("line"), F.concat_ws(":", "check", "code", F.col("line_number").cast("string")).alias("text"))
    long = e.where(F.length("patch") > diff_checks.MAX_CHARS).select("response_id", F.lit("patch:too_long").alias("errors"))  # these are not read line by line
    said = errors.groupBy(F.col("patch_id").alias("response_id")).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(message)), lambda m: m["text"])), ",").alias("errors"))
    j = e.join(said.unionByName(long), "response_id", "left")
    refused = F.concat_ws(",", F.when(~F.col("is_valid"), F.nullif("issues", F.lit(""))), "errors")
    good = F.col("is_valid") & F.col("errors").isNull()
    return j.select("instance_id", "model", F.when(good, F.col("patch")).alias("patch"), F.when(~good, refused).alias("reason"))
