"""Replays against plain loops over the whole log, and the choice among candidates of a response."""

from collections import defaultdict

from difflake.operators import diff_checks, extraction
from difflake.plans import registry
from difflake.plans.tables import table
from difflake.streaming import replay

SF = "/root/testdata/sf0.001"


def log(spark, rows):
    return spark.createDataFrame(rows, "account long, call_id long, s long, tokens long, failed boolean").selectExpr("account", "call_id", "timestamp_seconds(s) AS ts", "tokens", "failed")


def test_window_counts_admitted_calls_only(spark):
    got = replay.admit_sliding_window(log(spark, [(1, i, t, 1, False) for i, t in enumerate([0, 1, 2, 9, 10, 11])]), 2, 10.0).orderBy("call_id").collect()
    assert [(r["acquired"], r["wait"]) for r in got] == [(True, 0), (True, 0), (False, 8), (False, 1), (True, 0), (True, 0)]


def test_bucket_refills_and_composite_keeps_what_was_taken(spark):
    rows = [(1, 0, 0, 8, False), (1, 1, 1, 8, False), (1, 2, 4, 8, False), (2, 3, 0, 11, None)]
    got = {r["call_id"]: (r["acquired"], r["wait"]) for r in replay.admit_token_bucket(log(spark, rows), 10.0, 2.0).collect()}
    assert got == {0: (True, 0), 1: (False, 2), 2: (True, 0), 3: (False, 0.5)}
    got = {r["call_id"]: r["limited_by"] for r in replay.admit_composite(log(spark, rows), 2, 100.0, 10.0, 2.0).collect()}
    assert got == {0: None, 1: "bucket", 2: "window", 3: "bucket"}


def test_breaker(spark):
    calls = [(0, True), (1, False), (2, True), (3, True), (4, True), (5, True), (6, False), (65, True), (66, False), (125, False), (126, True)]
    got = replay.breaker_states(log(spark, [(1, i, t, 1, f) for i, (t, f) in enumerate(calls)])).orderBy("call_id").collect()
    assert [(r["rejected"], r["state"]) for r in got] == [(False, "closed")] * 5 + [(False, "open"), (True, "open"), (False, "open"), (True, "open"), (False, "closed"), (False, "closed")]


def test_window_equals_loop(spark):
    calls = table(spark, SF, "call_log").collect()
    by = defaultdict(list)
    for r in sorted(calls, key=lambda r: (r["ts"], r["call_id"])):
        by[r["account"]].append(r)
    want = {}
    for rows in by.values():
        taken = []
        for r in rows:
            want[r["call_id"]] = sum((r["ts"] - t).total_seconds() < 3600 for t in taken) < 3
            if want[r["call_id"]]:
                taken.append(r["ts"])
    assert {r["call_id"]: r["acquired"] for r in registry.QUERIES["admit_sliding_window"](spark, SF).collect()} == want
    assert replay.breaker_states(log(spark, [])).count() == 0


def test_extract_patches_takes_one_of_each_response(spark):
    responses = table(spark, SF, "responses")
    got = extraction.extract_patches(responses).collect()
    assert len(got) == responses.count() == len({r["response_id"] for r in got})
    kinds = {(int(r["response_id"][1:]) % 8, r["format"]) for r in got}
    assert (0, "fenced") in kinds and (1, "git") in kinds and (4, "unified") in kinds and (5, "file_blocks") in kinds and (6, "search_replace") in kinds and (7, None) in kinds
    valid = extraction.emit_valid_patches(responses).where("reason is null and patch is not null").count()
    extracted = extraction.extract_patches(responses).where("is_valid").selectExpr("response_id as patch_id", "'r' as run_id", "instance_id", "patch")
    assert valid == diff_checks.validate_patches(extracted).where("is_valid").count() > 0  # the full validator has the last word
