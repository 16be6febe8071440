"""Extraction in one layout against the same steps taken one by one, and the last gate of patches."""

from pyspark.sql import functions as F

from difflake.operators import diff_checks, extraction, repair
from difflake.plans.tables import table

SCHEMA = "response_id string, instance_id string, model string, content string"
HEAD = "--- a/x.py\n+++ b/x.py\n"
GOOD = HEAD + "@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
ODD = {
    "counts": f"```diff\n{HEAD}@@ -1,9 +1,9 @@\n a\n-b\n+c\n```",
    "bare hunk": "```diff\n@@ -1,7 +1,7 @@ def f\n a\n-b\n+c\n```",
    "cut": "diff --git a/x b/x\n" + HEAD + "@@ -1,2 +1,2 @@\n a\n-b\n+c",
    "ends in header": "```diff\n" + HEAD + "@@ -1 +1 @@\n-a\n+b\n@@ -9,2 +9,2 @@\n```",
    "blank before change": "```diff\n" + HEAD + "@@ -1,2 +1,2 @@\n a\n\n+c\n```",
    "stray": "```diff\n" + HEAD + "@@ nonsense\n-a\n```",
    "no new header": "```diff\n--- a/x\n@@ -1 +1 @@\n-a\n+b\n```",
    "empty fence": "```diff\n\n```",
    "no changes": "```diff\n" + HEAD + "@@ -1 +1 @@\n a\n```",
    "two formats": "diff --git a/x b/x\n" + GOOD + "\nwords\n```diff\n" + GOOD + "```",
    "search": "In a/b.py\nSEARCH:\nold\nREPLACE:\nnew\n\nSEARCH:\nx\ny\nREPLACE:\nz",
    "search unnamed": "<<<old>>>\n# pkg/m.py\nq\n<<<new>>>\nr\n",
    "blocks": "<file>a.py</file>\n<old>\nx = 1\n</old>\n<new>\nx = 2\n</new>",
    "quoted": '```patch\n--- "x.py"  \n+++ "/x.py"\n@@ -1 +1 @@\n-a\n+b \n```',
    "marker": "```diff\n" + GOOD + "\\ No newline at end of file\n```",
    "words": "nothing here",
    "empty": "",
}


def step_by_step(responses):
    c = extraction.candidates(responses).where("confidence >= 0.3").withColumn("patch_id", F.concat_ws("#", "response_id", "format"))
    first = {r["patch_id"]: r for r in repair.validate_extracted(c).collect()}
    fixed = {r["patch_id"]: r["patch"] for r in repair.fix_hunk_counts(c).collect()}
    rows = [r.asDict() for r in c.collect()]
    for r in rows:
        f = first[r["patch_id"]]
        r["first"] = f
        r["tried"] = fixed[r["patch_id"]] if not f["is_valid"] or f["n_warnings"] else r["patch"]
    tried = responses.sparkSession.createDataFrame([(r["patch_id"], r["tried"]) for r in rows], "patch_id string, patch string")
    second = {r["patch_id"]: r for r in repair.validate_extracted(tried).collect()}
    normal = {r["patch_id"]: r["patch"] for r in extraction.normalize_patches(tried).collect()}
    out = {}
    for r in rows:
        s, f = second[r["patch_id"]], r["first"]
        if s["n_warnings"]:
            continue
        text = normal[r["patch_id"]] if s["is_valid"] else r["tried"]
        kind = r["format"] if r["format"] != "fenced" else "fenced_patch" if abs(r["confidence"] - 0.75) < 1e-3 else "fenced_diff"
        lines, base = text.split("\n"), repair.BASE[kind]
        sure = min(1.0, base + 0.1) if s["is_valid"] else base * max(0.3, 1.0 - s["n_issues"] * 0.1)
        for mark in ("--- a/", "@@ "):
            sure = min(1.0, sure + 0.02) if any(x.startswith(mark) for x in lines) else sure
        sure *= 0.8 if len(lines) < 4 else 1
        changed = any((x.startswith("+") and not x.startswith("+++")) or (x.startswith("-") and not x.startswith("---")) for x in lines)
        sure *= 1 if changed else 0.5
        sure = 0.0 if text == "" else sure
        sure = min(sure, 0.95) if "cut_off" in f["warnings"] else sure
        sure = min(sure, 0.7) if not text.endswith("\n") and lines[-1][:1] in ("+", "-", " ") and lines[-1] else sure
        early = s["is_valid"] and sure >= 0.8
        if early or sure >= 0.3:
            key = (not early, 0.0 if early else -sure, r["order"])
            said = ",".join(x for x in (f["issues"], f["warnings"]) if x)
            out.setdefault(r["response_id"], []).append((key, (r["format"], text, round(sure, 9), s["is_valid"], said)))
    return {k: min(v)[1] for k, v in out.items()}


def test_one_layout_equals_steps(spark):
    odd = spark.createDataFrame([(f"odd {k}", k, "m", text) for k, text in ODD.items()], SCHEMA)
    responses = odd.unionByName(table(spark, "/root/testdata/sf0.001", "responses").select("response_id", "instance_id", "model", "content"))
    want = step_by_step(responses)
    rows = extraction.extract_patches(responses).collect()
    assert len(rows) == responses.count() and len(want) > 150
    for r in rows:
        if r["response_id"] in want:
            assert (r["format"], r["patch"], round(r["confidence"], 9), r["is_valid"], r["issues"]) == want[r["response_id"]], r["response_id"]
        else:
            assert r["patch"] is None and r["issues"] == "no_patch"
    got = {r["instance_id"]: r for r in rows if r["response_id"].startswith("odd")}
    assert got["bare hunk"]["patch"].startswith("--- a/file\n+++ b/file\n@@ -1,2 +1,2 @@ def f\n") and got["two formats"]["format"] == "git"
    assert got["search unnamed"]["format"] == "search_replace" and "--- a/pkg/m.py" in got["search unnamed"]["patch"]


def test_the_last_gate_is_the_full_validator(spark):
    accent = GOOD.replace("+c", "+café").replace(" a", " caf\n*x")
    rows = [("r1", "good", "m", f"```diff\n{GOOD}```"), ("r2", "bad", "m", "diff --git a/x b/x\n" + HEAD + "@@ -1,5 +1,5 @@\n a\n-b\n+c\n" + HEAD + "@@ -1 +1 @@\n-a\n+b\n"), ("r3", "none", "m", "words"), ("r4", "odd", "m", f"```diff\n{accent}```")]
    responses = spark.createDataFrame(rows, SCHEMA)
    got = {r["instance_id"]: (r["patch"], r["reason"]) for r in extraction.emit_valid_patches(responses).collect()}
    assert got["good"][0] is not None and got["good"][1] is None and got["none"] == (None, "no_patch")
    assert got["bad"][0] is None and "duplicate_files:duplicate_file" in got["bad"][1]
    extracted = extraction.extract_patches(responses).where("patch is not null").selectExpr("response_id as patch_id", "'r' as run_id", "instance_id", "patch", "is_valid as sound")
    told = {r["instance_id"]: r["is_valid"] for r in diff_checks.validate_patches(extracted).collect()}
    for name, (patch, _) in got.items():
        assert (patch is not None) == bool(told.get(name) and {r["instance_id"]: r["sound"] for r in extracted.collect()}[name])


def test_extraction_report(spark):
    rows = [("a", "git", True, 0.9), ("a", "git", True, 0.8), ("a", "fenced", False, 0.5), ("a", None, False, None), ("b", None, False, None)]
    table_ = spark.createDataFrame(rows, "model string, format string, is_valid boolean, confidence double")
    got = {(r["level"], r["model"], r["format"]): (r["n"], r["share"], r["valid"], r["mean_confidence"], r["failed_share"]) for r in extraction.extraction_report(table_).collect()}
    assert got == {
        (0, "a", "git"): (2, 0.5, 2, 850_000, 0.0), (0, "a", "fenced"): (1, 0.25, 0, 500_000, 1.0), (0, "a", None): (1, 0.25, 0, None, 1.0), (0, "b", None): (1, 1.0, 0, None, 1.0),
        (1, "a", None): (4, 1.0, 2, 733_333, 0.5), (1, "b", None): (1, 1.0, 0, None, 1.0), (3, None, None): (5, 1.0, 2, 733_333, 0.6),
    }
