"""Contexts of instances (problem, hints, tests, code) and texts made of them: prompts, summaries, reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of error lines, what lines of structure begin with, and patterns of test output that tells of an error.
ERROR_WORDS = ("error", "exception", "traceback", "fail", "assert")
SUMMARY_WORDS = ("error", "fail", "assert", "exception")
STRUCTURE = r"^[ \t-\r]*(?:import |from |class |def |@)|:[ \t-\r]*\z|^[ \t-\r]*\z"
OUTPUT = r"AssertionError:|FAILED|ERROR|Traceback|File \"[^\n]*\", line \d+|Expected:|Actual:|\s+E\s+"
CUT = "... (truncated)"
#: Files of a context at most, and lines of each.
TESTS, CODE, TEST_LINES, CODE_LINES = 5, 10, 200, 500


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has(line: Column, words: tuple[str, ...]) -> Column:
    return F.lower(line).rlike("|".join(words))


def head_and_tail(text: Column, n: int) -> Column:
    """At most n lines: two thirds from the beginning, the others from the end, and a line that tells of the cut."""
    lines, first = lines_of(text), n * 2 // 3
    short = F.concat(F.slice(lines, 1, first), F.array(F.lit(CUT)), F.slice(lines, -(n - first), n - first))
    return F.when(F.size(lines) <= n, text).otherwise(F.array_join(short, "\n"))


def with_errors(text: Column, n: int) -> Column:
    """At most n lines: error lines with two neighbours on each side, each text once, and some of the others."""
    lines = lines_of(text)
    at = F.filter(F.transform(lines, lambda x, i: F.when(_has(x, ERROR_WORDS), i + 1)), lambda i: i.isNotNull())
    around = F.array_distinct(F.flatten(F.transform(at, lambda i: F.slice(lines, F.greatest(F.lit(1), i - 2), i + 3 - F.greatest(F.lit(1), i - 2)))))
    other = F.filter(lines, lambda x: ~_has(x, ERROR_WORDS))
    left = F.greatest(F.lit(0), F.lit(n) - F.size(around))
    mixed = F.concat(F.slice(around, 1, n // 2), F.slice(other, F.lit(1), F.floor(left / 2).cast("int")), F.slice(around, F.lit(n // 2 + 1), F.greatest(F.lit(0), F.size(around) - n // 2)))
    kept = F.slice(F.when(left > 0, mixed).otherwise(around), 1, n)
    return F.when(F.size(lines) <= n, text).otherwise(F.concat(F.array_join(kept, "\n"), F.lit("\n" + CUT)))


def with_structure(text: Column, n: int) -> Column:
    """At most n lines: imports, definitions and blank lines first, up to half, then lines from the middle of the others."""
    lines = lines_of(text)
    frame, body = F.filter(lines, lambda x: x.rlike(STRUCTURE)), F.filter(lines, lambda x: ~x.rlike(STRUCTURE))
    of_frame = F.least(F.size(frame), F.lit(n // 2))
    room = F.lit(n) - of_frame
    begin = F.floor(F.size(body) / 2).cast("int") - F.floor(room / 2).cast("int")
    start = F.when(begin < 0, F.greatest(F.lit(0), F.size(body) + begin)).otherwise(begin)  # a beginning before the first line counts from the last one
    kept = F.concat(F.slice(frame, F.lit(1), of_frame), F.slice(body, start + 1, F.greatest(F.lit(0), begin + room - start)))
    return F.when(F.size(lines) <= n, text).otherwise(F.concat(F.array_join(kept, "\n"), F.lit("\n" + CUT)))


def truncate_lines(texts: DataFrame, n: int, mode: str = "plain") -> DataFrame:
    """text_id and the text cut to n lines: plain, errors or structure."""
    how = {"plain": head_and_tail, "errors": with_errors, "structure": with_structure}[mode]
    return texts.select("text_id", how(F.col("text"), n).alias("text"))


def build_contexts(instances: DataFrame, system_prompt: str = "") -> DataFrame:
    """One context for each instance: hints_text, then the hints; the test patch first, then test files, five in all; ten code files. Empty files are left out."""
    full = lambda files: F.filter(files, lambda f: f["content"] != "")
    cut = lambda files, how, n: F.transform(files, lambda f: F.struct(f["name"].alias("name"), how(f["content"], n).alias("content")))
    none = F.array().cast("array<struct<name:string,content:string>>")
    patch = F.when(F.col("test_patch") != "", F.array(F.struct(F.lit("test_patch").alias("name"), F.col("test_patch").alias("content")))).otherwise(none)
    hints = F.concat(F.when(F.col("hints_text") != "", F.array("hints_text")).otherwise(F.array().cast("array<string>")), F.coalesce("hints", F.array().cast("array<string>")))
    tests = F.concat(patch, F.slice(cut(full(F.coalesce("test_files", none)), with_errors, TEST_LINES), F.lit(1), F.lit(TESTS) - F.size(patch)))
    code = F.slice(cut(full(F.coalesce("code_files", none)), with_structure, CODE_LINES), 1, CODE)
    return instances.select("instance_id", "repo", "base_commit", F.lit(system_prompt).alias("system_prompt"), F.lit("").alias("user_prompt"), "problem_statement", hints.alias("hints"), code.alias("code"), tests.alias("tests"))


def tokens_of(text: Column) -> Column:
    """Estimated tokens, as in prompts.estimate_tokens."""
    return F.floor((F.length(text) * 11 + marks(text) * 20) / 40)


def marks(text: Column) -> Column:
    """Line feeds, points and commas."""
    without = lambda c: F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.length(text) * 3 - without("\n") - without(".") - without(",")


def total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + of(x))


SECTIONS = ("system_prompt", "user_prompt", "problem_statement", "code", "tests", "hints")


def section_token_columns() -> dict[str, Column]:
    plain = {s: tokens_of(F.col(s)) for s in SECTIONS[:3]}
    files = {s: total(F.col(s), lambda f: tokens_of(f["content"])) for s in ("code", "tests")}
    return plain | files | {"hints": total(F.col("hints"), tokens_of)}


def section_tokens(contexts: DataFrame) -> DataFrame:
    """Estimated tokens of each of the six sections."""
    return contexts.select("instance_id", *(c.cast("long").alias(s) for s, c in section_token_columns().items()))


def context_length(contexts: DataFrame) -> DataFrame:
    """Characters of all texts of a context."""
    files = lambda c: total(F.col(c), lambda f: F.length(f["content"]))
    return contexts.select("instance_id", (F.length("system_prompt") + F.length("user_prompt") + F.length("problem_statement") + files("code") + files("tests") + total(F.col("hints"), F.length)).cast("long").alias("length"))


def joined(*parts: Column | str) -> Column:
    """The parts that are there, a line each."""
    return F.array_join(F.array_compact(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))), "\n")


def _files(files: str, fence: str) -> Column:
    return F.array_join(F.transform(files, lambda f: F.concat(F.lit("#### "), f["name"], F.lit(f"\n```{fence}\n"), f["content"], F.lit("\n```\n"))), "\n")


def detailed_prompt() -> Column:
    return joined(
        F.concat(F.lit("## Fix in "), "repo"), F.concat(F.lit("Instance: "), "instance_id"), F.concat(F.lit("Commit: "), "base_commit"), "", "### Problem", F.col("problem_statement"),
        F.when(F.size("tests") > 0, F.concat(F.lit("\n### Failing tests\n"), _files("tests", "python"))),
        F.when(F.size("code") > 0, F.concat(F.lit("\n### Code\n"), _files("code", "python"))),
        F.when(F.size("hints") > 0, F.concat(F.lit("\n### Hints\n- "), F.array_join("hints", "\n- "))),
        "", "Answer with a unified diff only.",
    )


NEWLINE_WEIGHT = 31


def weight(text: Column | str) -> Column:
    """What tokens_of divides by 40: weights of texts add up to the weight of the joined text."""
    if isinstance(text, str):
        return F.lit(len(text) * 11 + sum(text.count(c) for c in "\n.,") * 20).cast("long")
    return (F.length(text) * 11 + marks(text) * 20).cast("long")


def section_weights() -> Column:
    """Weights of a context's texts as a struct: of each plain section, and of each file or hint of the others."""
    files = {s: F.transform(s, lambda f: weight(f["content"])) for s in ("code", "tests")}
    return F.struct(*(weight(F.col(s)).alias(s) for s in SECTIONS[:3]), *(f.alias(s) for s, f in files.items()), F.transform("hints", weight).alias("hints"))


def tokens_by_weight(weights: Column) -> dict[str, Column]:
    """section_token_columns() from weights."""
    tokens = lambda n: F.floor(n / 40)
    return {s: tokens(weights[s]) if s in SECTIONS[:3] else total(weights[s], tokens) for s in SECTIONS}


def detailed_weight(weights: Column | None = None) -> Column:
    """The weight of detailed_prompt(), summed over its parts: the prompt is not made."""
    w = section_weights() if weights is None else weights
    added = lambda s: total(w[s], lambda n: n)

    def files(name: str, title: str) -> Column:
        around = weight("#### ") + weight("\n```python\n") + weight("\n```\n")
        names = total(F.col(name), lambda f: weight(f["name"]) + around)
        return F.when(F.size(name) > 0, weight(title) + names + added(name) + (F.size(name) - 1) * NEWLINE_WEIGHT)

    hints = weight("\n### Hints\n- ") + added("hints") + (F.size("hints") - 1) * weight("\n- ")
    lines = [
        weight("## Fix in ") + weight(F.col("repo")), weight("Instance: ") + weight(F.col("instance_id")), weight("Commit: ") + weight(F.col("base_commit")), weight(""), weight("### Problem"), w["problem_statement"],
        files("tests", "\n### Failing tests\n"), files("code", "\n### Code\n"), F.when(F.size("hints") > 0, hints), weight(""), weight("Answer with a unified diff only."),
    ]
    return sum((F.coalesce(x + NEWLINE_WEIGHT, F.lit(0)) for x in lines), F.lit(-NEWLINE_WEIGHT).cast("long"))


def stepwise_prompt() -> Column:
    return joined(
        F.concat(F.lit("Step 1: the problem in "), "repo"), F.col("problem_statement"), "",
        F.when(F.size("tests") > 0, F.concat(F.lit("Step 2: the failing tests\n"), _files("tests", "python"), F.lit("\nWhat do they expect?\n"))),
        F.when(F.size("code") > 0, F.concat(F.lit("Step 3: the code\n"), _files("code", "python"), F.lit("\nWhat makes them fail?\n"))),
        "Step 4: plan the smallest change.", "", "Step 5: write it as a unified diff.",
    )


def build_cot_prompts(contexts: DataFrame) -> DataFrame:
    """Prompts that go step by step; steps without tests or code are left out."""
    return contexts.select("instance_id", stepwise_prompt().alias("prompt"))


def build_basic_prompts(instances: DataFrame) -> DataFrame:
    """The plain prompt: problem, id, and hints and test where there are any."""
    return instances.select(
        "instance_id",
        joined(
            F.concat(F.lit("Fix this issue in "), F.coalesce("repo", F.lit("the repository")), F.lit(":")), "", F.concat(F.lit("Problem: "), F.coalesce("problem_statement", F.lit(""))), "", F.concat(F.lit("Instance ID: "), "instance_id"),
            F.when(F.col("hints_text") != "", F.concat(F.lit("\nAdditional Context:\n"), "hints_text")),
            F.when(F.col("test_patch") != "", F.concat(F.lit("\nThe following test shows the issue:\n```diff\n"), "test_patch", F.lit("\n```"))),
            "", "Answer with a unified diff only, as small as can be.",
        ).alias("prompt"),
    )


def reduce_prompts(prompts: DataFrame, keep: float = 0.8) -> DataFrame:
    """Shorter prompts for another try: a long problem is cut, else the optional sections go.

    The problem is what follows the line Problem: up to a blank line or the next section; with more than 1000
    characters it is cut to their share keep. The optional sections end at the next blank line, which goes too.
    """
    lines = lines_of(F.col("prompt"))
    blank = lambda x: ~x.rlike(r"[^ \t-\r]")
    first = F.array_position(F.transform("l", lambda x: x.startswith("Problem:")), True).cast("int")
    stop = F.array_position(F.transform("l", lambda x, i: (i >= F.col("first")) & (blank(x) | x.rlike("^(?:Instance ID:|Additional Context:|The following test)"))), True).cast("int")
    stop = F.when(stop == 0, F.size("l") + 1).otherwise(stop)
    rows = prompts.withColumn("l", lines).withColumn("first", first).withColumn("stop", stop)
    problem = F.array_join(F.slice("l", F.col("first") + 1, F.greatest(F.lit(0), F.col("stop") - F.col("first") - 1)), "\n")
    rows = rows.withColumn("problem", F.when(F.col("first") > 0, problem))
    n = F.floor(F.length("problem") * keep).cast("int")
    shorter = F.array_join(F.concat(F.slice("l", F.lit(1), F.col("first")), F.array(F.concat(F.substr("problem", F.lit(1), n), F.lit("\n" + CUT))), F.slice("l", F.col("stop"), F.greatest(F.lit(0), F.size("l") - F.col("stop") + 1))), "\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("off"))

    def step(acc: Column, x: Column) -> Column:
        begins = x.rlike("^(?:Additional Context:|The following test)")
        off = F.when(begins, True).when(blank(x), False).otherwise(acc["off"])
        return F.struct(F.when(begins | acc["off"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"), off.alias("off"))

    without = F.array_join(F.aggregate("l", start, step, lambda acc: acc["kept"]), "\n")
    return rows.select("instance_id", F.when(F.length("problem") > 1000, shorter).otherwise(without).alias("prompt"))


def reduce_contexts(contexts: DataFrame, share: float = 0.7) -> DataFrame:
    """Contexts with that share of hints and files: code by (not a test, length, name), tests by (length, name); a problem of over 2000 characters is cut in lines."""
    part = lambda c: F.greatest(F.lit(1), F.floor(F.size(c) * share).cast("int"))
    code = F.array_sort(F.transform("code", lambda f: F.struct((~F.lower(f["name"]).contains("test")).alias("o"), F.length(f["content"]).alias("n"), f["name"].alias("name"), f["content"].alias("content"))))
    tests = F.array_sort(F.transform("tests", lambda f: F.struct(F.length(f["content"]).alias("n"), f["name"].alias("name"), f["content"].alias("content"))))
    cut = lambda files, c, how, n: F.transform(F.slice(files, F.lit(1), part(c)), lambda f: F.struct(f["name"].alias("name"), how(f["content"], int(n * share)).alias("content")))
    problem = F.when(F.length("problem_statement") > 2000, with_errors(F.col("problem_statement"), int(2000 * share))).otherwise(F.col("problem_statement"))
    return contexts.withColumns({"problem_statement": problem, "hints": F.slice("hints", F.lit(1), part("hints")), "code": cut(code, "code", with_structure, CODE_LINES), "tests": cut(tests, "tests", with_errors, TEST_LINES)})


def retry_prompts(failures: DataFrame) -> DataFrame:
    """What is asked after a failed response: response_id, reason, prompt, content."""
    reason, content = F.col("reason"), F.col("content")
    parse = joined("The response could not be read as a unified diff.", "It was:", "```", F.substring(content, 1, 1000), F.when(F.length(content) > 1000, "...").otherwise(""), "```", "Answer with a unified diff only.")
    empty = joined("The patch changes nothing.", "Answer with lines that start with + or -.")
    other = joined(F.concat(F.lit("The response was refused: "), reason), "Answer with a valid unified diff.")
    head = F.when(reason == "parse_failure", parse).when(reason == "no_changes", empty).otherwise(other)
    return failures.select("response_id", joined(head, "", "Task:", F.col("prompt")).alias("prompt"))


def summarize_tests(contexts: DataFrame, most: int = 5) -> DataFrame:
    """For each test file its first line that tells of an error and how many more there are; the first five files."""
    def line(f: Column) -> Column:
        bad = F.transform(F.filter(lines_of(f["content"]), lambda x: _has(x, SUMMARY_WORDS)), lambda x: F.regexp_replace(x, r"^[ \t-\r]+|[ \t-\r]+\z", ""))
        more = F.when(F.size(bad) > 1, F.concat(F.lit(" (+"), (F.size(bad) - 1).cast("string"), F.lit(" more)"))).otherwise("")
        return F.concat(f["name"], F.lit(": "), F.when(F.size(bad) > 0, F.concat(F.get(bad, 0), more)).otherwise("Test failures"))

    return contexts.select("instance_id", F.array_join(F.slice(F.transform("tests", line), 1, most), "\n").alias("summary"))


def summarize_code(contexts: DataFrame, most: int = 3) -> DataFrame:
    """For each of the first three code files its first three class and function names and how many more there are, or its number of lines."""
    def line(f: Column) -> Column:
        lines = lines_of(f["content"])
        stripped = F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t-\r]+|[ \t-\r]+\z", ""))
        names = F.transform(F.filter(stripped, lambda x: x.rlike("^(?:class |def )")), lambda x: F.substring_index(x, "(", 1))
        more = F.when(F.size(names) > 3, F.concat(F.lit(" (+"), (F.size(names) - 3).cast("string"), F.lit(" more)"))).otherwise("")
        return F.concat(f["name"], F.lit(": "), F.when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, 3), ", "), more)).otherwise(F.concat(F.size(lines).cast("string"), F.lit(" lines"))))

    return contexts.select("instance_id", F.array_join(F.transform(F.slice("code", 1, most), line), "\n").alias("summary"))


def error_context(outputs: DataFrame) -> DataFrame:
    """Lines of test output that match a pattern or lie in a traceback, else the first 500 characters.

    A traceback reaches from a line that names it to the first line that is not indented, that line included.
    """
    lines = outputs.select("text_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    ends = F.col("line").rlike(r"[^ \t-\r]") & ~F.col("line").startswith(" ")
    names = F.col("line").contains("Traceback")
    before = Window.partitionBy("text_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last(F.when(ends, False).when(names, True), ignorenulls=True).over(before), F.lit(False))
    hits = lines.withColumn("hit", names | inside | F.col("line").rlike(OUTPUT)).where("hit")
    told = hits.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("told"))
    return outputs.join(told, "text_id", "left").select("text_id", F.coalesce("told", F.substring("text", 1, 500)).alias("errors"))
