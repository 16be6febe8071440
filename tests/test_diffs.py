"""Hand-worked diffs, and streams against batches."""

from difflake.operators import diff_checks, diff_structure, selection
from difflake.streaming import chunks

GOOD = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n a\n-b\n+c"


def issues(spark, patch):
    df = spark.createDataFrame([("p", "r", "i", patch)], "patch_id string, run_id string, instance_id string, patch string")
    return {(r["code"], r["line_number"]) for r in diff_checks.patch_issues(df).collect()}, diff_checks.validate_patches(df).first()


def test_good_patch_only_ends_with_a_change(spark):
    found, verdict = issues(spark, GOOD)
    assert found == {("ends_with_change", None)}
    assert verdict["is_valid"] and verdict["score"] == 0.95


def test_final_line_feed_adds_a_context_line(spark):
    found, _ = issues(spark, GOOD + "\n")
    assert found == {("old_count", 4), ("new_count", 4)}


def test_deleted_line_that_looks_like_a_header(spark):
    found, _ = issues(spark, "--- a/x\n+++ b/x\n@@ -1,2 +1,1 @@\n a\n--- b\n")
    assert ("no_new_header", 6) in found


def test_empty_and_over_long_patches_are_refused(spark):
    for patch in ("", None, "x" * 100_001):
        found, verdict = issues(spark, patch)
        assert not found and verdict["errors"] == 1 and verdict["score"] == 0


def test_one_pass_equals_the_union_of_checks(spark):
    from difflake.plans.tables import table

    rows = table(spark, "/root/testdata/sf0.001", "predictions").where("patch <> ''")
    lines = diff_structure.patch_lines(rows.where(f"length(patch) <= {diff_checks.MAX_CHARS}"))
    names = ["patch_id", "check", "level", "code", "line_number", "detail"]
    rows_of = lambda df: sorted(map(repr, df.select(*names).collect()))
    union = [r for check in diff_checks.CHECKS.values() for r in rows_of(check(lines))]
    assert rows_of(diff_checks.patch_issues(rows)) == sorted(union) and len(union) > 100


def test_fix_writes_real_counts(spark):
    df = spark.createDataFrame([("p", "--- a/x\n@@ -1,9 +1,9 @@ f\n a\n-b\n+c")], "patch_id string, patch string")
    assert diff_checks.autofix_patches(df).first()["patch"] == "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@ f\n a\n-b\n+c"


def test_repartitioning_changes_nothing(spark):
    df = spark.createDataFrame([(f"p{i}", GOOD) for i in range(20)], "patch_id string, patch string")
    once = sorted(map(str, diff_structure.hunk_counts(diff_structure.patch_lines(df)).collect()))
    assert once == sorted(map(str, diff_structure.hunk_counts(diff_structure.patch_lines(df.repartition(7))).collect()))


def test_globs():
    assert selection.glob_to_regex("a*[!b]?.") == r"(?s)^(?:a.*[^b].\.)\z"


def test_stream_equals_batch(spark, tmp_path):
    calls = spark.sql("SELECT 'p' || (id % 3) AS provider, timestamp_seconds(1700000000 + id * 7) AS ts, id AS tokens FROM range(200)")
    calls.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = chunks.stream_calls_per_minute(stream).writeStream.outputMode("complete").format("memory").queryName("minute").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    from difflake.operators.call_logs import calls_per_minute

    assert sorted(spark.table("minute").collect()) == sorted(calls_per_minute(calls).select("provider", "start", "requests", "tokens").collect())
