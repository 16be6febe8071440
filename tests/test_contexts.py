"""Contexts, truncation and budgets on hand-worked rows."""

from pyspark.sql import functions as F

from difflake.operators import budgets, contexts, extraction, repair, selection

import pytest


def one(spark, text, how, n):
    return spark.createDataFrame([("t", text)], "text_id string, text string").select(how(F.col("text"), n)).first()[0]


def test_line_modes(spark):
    text = "\n".join(f"l{i}" for i in range(12))
    assert one(spark, text, contexts.head_and_tail, 12) == text
    assert one(spark, text, contexts.head_and_tail, 6) == "l0\nl1\nl2\nl3\n... (truncated)\nl10\nl11"
    errors = "a\nb\nc\nError: x\nd\ne\nf\ng\nh"
    # around: b c Error d e; one place is left, half of it is none
    assert one(spark, errors, contexts.with_errors, 6) == "b\nc\nError: x\nd\ne\n... (truncated)"
    # room for two others, placed after the first half of what is around the error
    assert one(spark, errors, contexts.with_errors, 8) == "b\nc\nError: x\nd\na\ne\n... (truncated)"
    code = "import os\n\nclass A:\n  x1\n  x2\n  x3\n  x4\ndef f():\n  y1\n  y2\n  y3\n  y4"
    # half of six lines of structure; then three from the middle of the eight others
    assert one(spark, code, contexts.with_structure, 6) == "import os\n\nclass A:\n  x4\n  y1\n  y2\n... (truncated)"


def test_contexts_have_five_tests_and_ten_files(spark):
    files = [(f"f{i}", "" if i == 1 else f"x{i}") for i in range(14)]
    row = ("i", "r", "c", "p", "hint", "diff", ["more"], files, files)
    schema = "instance_id string, repo string, base_commit string, problem_statement string, hints_text string, test_patch string, hints array<string>, test_files array<struct<name:string,content:string>>, code_files array<struct<name:string,content:string>>"
    got = contexts.build_contexts(spark.createDataFrame([row], schema)).first()
    assert [f["name"] for f in got["tests"]] == ["test_patch", "f0", "f2", "f3", "f4"] and len(got["code"]) == 10 and got["hints"] == ["hint", "more"]
    bare = contexts.build_contexts(spark.createDataFrame([("i", "r", "c", "p", "", "", None, None, None)], schema)).first()
    assert (bare["tests"], bare["code"], bare["hints"]) == ([], [], [])


def plain_tokens(text):
    return (len(text) * 11 + sum(text.count(c) for c in "\n.,") * 20) // 40


def plain_cut(text, tokens, structure):
    """Fills one list of kept line numbers after the other; an independent way to what cut_text says."""
    room = tokens * 4
    if plain_tokens(text) <= tokens:
        return text
    if not structure:
        return text if len(text) <= room else text[: max(0, room - 20)] + budgets.NOTE
    lines = text.split("\n")
    blank = lambda x: not x.strip(" \t\n\x0b\x0c\r")
    bare = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    frame = [k for k, x in enumerate(lines) if x.lstrip(" \t\x0b\x0c\r").startswith(("import ", "from ", "class ", "def ", "@")) or bare[k].endswith(":") or (k < 10 and blank(x))]
    body = [k for k in range(len(lines)) if k not in set(frame)]
    cost = lambda ks: sum(len(lines[k]) + 1 for k in ks)
    longest = lambda ks, most: max((n for n in range(len(ks) + 1) if n == 0 or cost(ks[:n]) < most), default=0)
    top = frame if cost(frame) < room else frame[: longest(frame, room // 2)]
    left = room - cost(top)
    head = body[: longest(body, left // 2)] if left > 100 else []
    rest = left - cost(head)
    after = body[len(head) :]
    tail = after[len(after) - longest(after[::-1], rest) :] if left > 100 and rest > 100 else []
    gone = len(lines) - len(top) - len(head) - len(tail)
    return "\n".join([lines[k] for k in top + head] + ([f"[{gone} lines left out]"] if gone else []) + [lines[k] for k in tail])


def plain_pack(files, tokens, structure):
    out, free = [], tokens
    for f in sorted(files, key=lambda f: ("test" not in f[0].lower(), len(f[1]), f[0])):
        if plain_tokens(f[1]) > free and free * 5 <= tokens:
            break
        text = f[1] if plain_tokens(f[1]) <= free else plain_cut(f[1], free, structure)
        out.append((f[0], text))
        free -= plain_tokens(text)
    return out


CODE = "import a\n" + "\n".join(f"body line {i:03d}" for i in range(100)) + "\ndef f():"
TEXTS = ["", "abc", "x" * 400, CODE, "\n".join(f"def f{i}(): pass:" for i in range(200)), "\n\n\n" + "word, word. " * 60, "a:\n" + "long " * 200 + "\nb", "\n".join("class A: " + "y" * (i % 37) if i % 9 == 0 else "z" * (i % 53) for i in range(300)), "é:\t\n  @dec\nq" * 30]


@pytest.mark.parametrize("structure", [False, True])
@pytest.mark.parametrize("tokens", [0, 3, 20, 50, 100, 400])
def test_cut_text(spark, tokens, structure):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "text_id long, text string")
    got = {r["text_id"]: r["text"] for r in budgets.truncate_text(rows, tokens, structure).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k] == plain_cut(text, tokens, structure), (k, tokens)


@pytest.mark.parametrize("structure", [False, True])
@pytest.mark.parametrize("tokens", [0, 60, 165, 300, 900])
def test_pack_prefers_tests_and_small_files(spark, tokens, structure):
    some = [("b.py", "x" * 400), ("a_test.py", "y" * 200), ("c.py", "z" * 4000), ("d.py", "w" * 4100), ("e.py", CODE)]
    rows = [("some", some), ("none", []), ("same", [("t.py", "q"), ("t.py", "q")]), ("texts", [(f"m{k}", t) for k, t in enumerate(TEXTS)])]
    table = spark.createDataFrame(rows, "instance_id string, code array<struct<name:string,content:string>>")
    got = {r["instance_id"]: [(f["name"], f["content"]) for f in r["code"]] for r in budgets.pack_files(table, tokens, structure).collect()}
    assert got == {k: plain_pack(files, tokens, structure) for k, files in rows}
    if tokens == 165 and not structure:
        assert got["some"] == [some[1], some[0]]  # four fifths are used


def test_weights_add_up_to_the_prompt(spark):
    from difflake.plans.contexts import instances_with_files

    c = contexts.build_contexts(instances_with_files(spark, "/root/testdata/sf0.001"), "You mend code.")
    both = c.select(F.floor(contexts.detailed_weight() / 40).alias("sum"), contexts.tokens_of(contexts.detailed_prompt()).alias("text")).collect()
    assert len(both) > 100 and all(r["sum"] == r["text"] for r in both)


def test_no_python_in_budgets(spark):
    from difflake.plans.registry import QUERIES

    for name in ("pack_files", "fit_contexts", "truncate_text"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "InPandas" not in plan and (name != "fit_contexts" or "Exchange" not in plan)


@pytest.mark.parametrize("keep_tests", [False, True])
def test_fit_contexts(spark, keep_tests):
    code, tests = [("m.py", "def f():\n" + "x = 1\n" * 3000)], [("test_a.py", "assert f()\n" * 300)]
    schema = "instance_id string, repo string, base_commit string, system_prompt string, user_prompt string, problem_statement string, hints array<string>, code array<struct<name:string,content:string>>, tests array<struct<name:string,content:string>>"
    rows = [("big", "r", "c", "", "", "words " * 900, ["h"] * 4, code, tests), ("small", "r", "c", "", "", "p", [], [], [])]
    got = {r["instance_id"]: r for r in budgets.fit_contexts(spark.createDataFrame(rows, schema), 4000, 1000, keep_tests).collect()}
    small, big = got["small"], got["big"]
    assert not small["truncated"] and small["final_tokens"] == small["original_tokens"] and not small["removed"]
    assert big["truncated"] and big["final_tokens"] < big["original_tokens"] and big["removed"]["code"] > 0
    assert big["final_tokens"] < 0.6 * big["original_tokens"] and ("tests" in big["removed"]) == (not keep_tests)


def test_costly_patterns_are_refused(spark):
    ids = spark.createDataFrame([("abc",)], "instance_id string")
    for bad in ["", "(a+)+", "(a*)*", "a*b*", "(?=a)+", "(?!a)+", "(a)+(b)+", "[a]*[b]*", "a{1000,}", "a" * 501, "("]:
        with pytest.raises((ValueError, __import__("re").error)):
            selection.select_by_regex(ids, bad)
    assert selection.select_by_regex(ids, "a.c").count() == 1


def test_repair_of_extracted_patches(spark):
    bad = "@@ -1,9 +1,9 @@ def f\n a\n-b\n+c\n+d"
    rows = spark.createDataFrame([("p", bad), ("n", None), ("e", "")], "patch_id string, patch string")
    v = {r["patch_id"]: r for r in repair.validate_extracted(rows).collect()}
    assert v["p"]["issues"] == "no_file_headers" and v["p"]["warnings"] == "old_count:1,new_count:1,cut_off" and not v["p"]["is_valid"]
    assert v["n"]["issues"] == v["e"]["issues"] == "empty"
    assert {r["issues"] for r in repair.validate_extracted(rows.where("patch_id = 'p'"), strict=True).collect()} == {"old_count:1,new_count:1,no_file_headers"}
    fixed = {r["patch_id"]: r["patch"] for r in repair.fix_hunk_counts(rows).collect()}
    assert fixed["p"] == "--- a/file\n+++ b/file\n@@ -1,2 +1,3 @@ def f\n a\n-b\n+c\n+d\n\\ No newline at end of file" and fixed["n"] is None


def test_extraction_mends_wrong_counts(spark):
    good = "--- a/x.py\n+++ b/x.py\n@@ -1,9 +1,9 @@\n a\n-b\n+c\n"
    rows = [("r1", "i1", "m", f"Here:\n```diff\n{good}```\nEnd"), ("r2", "i2", "m", "nothing here"), ("r3", "i3", "m", "```diff\n--- a/x.py\n@@ nonsense\n```")]
    got = {r["response_id"]: r for r in extraction.extract_patches(spark.createDataFrame(rows, "response_id string, instance_id string, model string, content string")).collect()}
    assert got["r1"]["is_valid"] and got["r1"]["format"] == "fenced" and "@@ -1,2 +1,2 @@\n" in got["r1"]["patch"] and 0.9 < got["r1"]["confidence"] <= 0.95
    assert got["r1"]["patch"].endswith("\n") and "cut_off" in got["r1"]["issues"]
    assert got["r2"]["patch"] is None and got["r2"]["issues"] == "no_patch" and not got["r3"]["is_valid"]
