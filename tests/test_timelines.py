"""Accounts over time against brute force, one account with half of the rows."""

from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from difflake.functions import ranges
from difflake.operators import costs, evaluation, generation, selection, timelines
from difflake.plans import registry, tables

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def small_ranges(spark):
    """Ranges as many as partitions, however few the rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def calls(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        account = 1 if i % 2 else int(rng.integers(2, 30))
        at = START + timedelta(microseconds=int(rng.integers(0, 400)) * 500_000)  # many ties
        rows.append((i, account, at, float(rng.integers(0, 40)) / 600, bool(rng.random() < (0.97 if account == 1 and i < 2600 else 0.5))))
    return rows, spark.createDataFrame(rows, "call_id long, account long, ts timestamp_ntz, value double, failed boolean").repartition(4).persist()


def by_account(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1]].append(r)
    return out


def test_a_hot_key_is_in_many_ranges(calls):
    rows, table = calls
    sizes = [r["count"] for r in ranges.ranged(table, "account", "ts", "call_id").where("account = 1").groupBy("part").count().collect()]
    assert sum(sizes) == 1500 and max(sizes) < 1200 and len(sizes) > 1


def test_numbers_within_keys(calls):
    rows, table = calls
    got = {r["call_id"]: r["nr"] for r in ranges.numbered(table, "nr", ["account"], "ts", "call_id").collect()}
    want = {r[0]: k for some in by_account(rows).values() for k, r in enumerate(sorted(some, key=lambda r: (r[2], r[0])))}
    assert got == want


@pytest.mark.parametrize("spans", [1, 3])
def test_rolling_rate(calls, spans):
    rows, table = calls
    second = timedelta(seconds=1)
    want = {}
    for some in by_account(rows).values():
        for r in some:
            times = [x[2] for x in some if r[2] - 10 * second <= x[2] < r[2]]
            over = len(times) >= 4
            want[r[0]] = (len(times), over, 10_000_000 - int((r[2] - min(times)) / timedelta(microseconds=1)) if over else None)
    got = {r["call_id"]: (r["before"], r["exceeds"], r["wait_us"]) for r in timelines.rolling_rate(table, 4, 10, spans).collect()}
    assert got == want


def test_peak_concurrency(calls):
    rows, table = calls
    for r in timelines.peak_concurrency(table, 5).collect():
        events = sorted([(x[2], 1) for x in rows if x[1] == r["account"]] + [(x[2] + timedelta(microseconds=int(x[3] * 60_000_000)), -1) for x in rows if x[1] == r["account"]])
        active = np.cumsum([d for _, d in events])
        assert (r["peak"], r["over"]) == (active.max(), active.max() > 5)


def test_failure_streaks(calls):
    rows, table = calls
    want = {}
    for account, some in by_account(rows).items():
        best = run = 0
        for r in sorted(some, key=lambda r: (r[2], r[0])):
            run = run + 1 if r[4] else 0
            best = max(best, run)
        if best:
            want[account] = best
    assert {r["account"]: r["longest"] for r in timelines.failure_streaks(table).collect()} == want
    all_failed = table.selectExpr("call_id", "account", "ts", "account = 1 as failed")
    assert [tuple(r) for r in timelines.failure_streaks(all_failed).collect()] == [(1, 1500)]  # over all ranges
    assert timelines.failure_streaks(table.limit(0)).count() == 0


def test_limit_usage(spark):
    hour = timedelta(hours=1)
    rows = [
        (1, "p", START + 6 * hour, '{"x-ratelimit-limit-requests":"100","x-ratelimit-remaining-requests":"50"}'),
        (2, "p", START + 12 * hour, '{"anthropic-ratelimit-requests-limit":"200","anthropic-ratelimit-requests-remaining":"20","anthropic-ratelimit-tokens-limit":"0","anthropic-ratelimit-tokens-remaining":"5"}'),
        (3, "p", START + 36 * hour, '{"x-ratelimit-limit-requests":"100","x-ratelimit-remaining-requests":"100"}'),
        (4, "p", START + 37 * hour, "{}"),
        (5, "q", START, '{"x-ratelimit-limit-tokens":"10","x-ratelimit-remaining-tokens":"15"}'),
    ]
    table = generation.rate_limit_headers(spark.createDataFrame(rows, "call_id long, provider string, ts timestamp_ntz, headers string"), "ts")
    got = {(r["provider"], r["kind"], r["day"].day): r for r in timelines.limit_usage(table).collect()}
    assert set(got) == {("p", "requests", 1), ("p", "requests", 2), ("q", "tokens", 1)}
    first, second = got["p", "requests", 1], got["p", "requests", 2]
    assert first["mean_used"] == pytest.approx((6 * 0.5 + 12 * 0.9) / 18) and (first["lowest_left"], first["lowest_call"], first["lowest_at"], first["readings"]) == (100_000, 2, START + 12 * hour, 2)
    assert second["mean_used"] == pytest.approx(12 * 0.9 / 24) and (second["lowest_left"], second["readings"]) == (1_000_000, 1)
    assert got["q", "tokens", 1]["mean_used"] == 0.0


def test_durations_in_sketches(spark):
    rng = np.random.default_rng(5)
    values = np.sort((rng.pareto(1.1, 60_000) * 100).astype(np.int64))
    rows = spark.createDataFrame([(f"d{i % 30}", int(v)) for i, v in enumerate(values)] + [("d0", None)], "day string, seconds long").selectExpr("'r' as run_id", "*")
    r = evaluation.duration_rollup(evaluation.duration_sketches(rows, "run_id", "day"), "run_id").first()
    assert r["n"] == 60_000 and r["longest"] == values[-1] and r["mean"] == pytest.approx(values.mean())
    for q, v in ((0.5, r["p50"]), (0.95, r["p95"])):
        low, high = np.searchsorted(values, v, "left") / len(values), np.searchsorted(values, v, "right") / len(values)
        assert low - 0.003 <= q <= high + 0.003
    small = evaluation.duration_rollup(evaluation.duration_sketches(rows.where("day = 'd3'"), "run_id", "day"), "run_id", "day").first()
    own = np.array([v for i, v in enumerate(values) if i % 30 == 3])
    assert (small["p50"], small["p95"]) == (own[int(np.ceil(0.5 * len(own))) - 1], own[int(np.ceil(0.95 * len(own))) - 1])  # as they are


def test_durations_roll_up_exactly(spark):
    """Quantiles of more distinct durations than a sketch keeps are those of the sorted list; null is a key too, and rows without a duration are only counted."""
    rng = np.random.default_rng(11)
    values = {"a": rng.integers(0, 10**9, 20_000), None: rng.integers(0, 9000, 30_001), "few": np.array([7])}
    rows = [(k, f"d{i % 9}", int(v)) for k, own in values.items() for i, v in enumerate(own)] + [("a", "d1", None), (None, "d2", None), ("none", "d3", None), ("none", "d4", None)]
    sketches = evaluation.duration_sketches(spark.createDataFrame(rows, "run_id string, day string, seconds long").repartition(5), "run_id", "day")
    got = {r["run_id"]: r for r in evaluation.duration_rollup(sketches, "run_id").collect()}
    assert set(got) == {*values, "none"}
    for k, own in values.items():
        own = np.sort(own)
        assert (got[k]["n"], got[k]["longest"], got[k]["missing"]) == (len(own), own[-1], {"few": 0}.get(k, 1)) and got[k]["mean"] == pytest.approx(own.mean())
        assert (got[k]["p50"], got[k]["p95"]) == (own[-(-len(own) // 2) - 1], own[-(-len(own) * 95 // 100) - 1])
    assert tuple(got["none"])[1:] == (0, None, None, None, None, 2)
    assert len(registry.QUERIES["duration_rollup"](spark, "/root/testdata/sf0.001").columns) == 7


def test_budget_over_ranges_without_costs(spark):
    """Running costs equal those of one sorted list: of ranges that begin with calls of unknown cost, with refunds, calls alike in time and id, a null run and null times."""
    rng = np.random.default_rng(3)
    rows = []
    for run, n in (("big", 5000), (None, 400), ("free", 30)):
        for i in range(n):
            model = "gpt-4o" if i % 7 == 3 and run != "free" else "local-7b"
            tokens = int(rng.integers(-40, 60)) if run == "big" else 2
            rows.append((f"c{i % 900 // 2}", run, "p", model, None if i % 50 == 7 else START + timedelta(hours=i % 300), tokens, 0, 1))
    usage = spark.createDataFrame(rows, "call_id string, run_id string, provider string, model string, ts timestamp_ntz, prompt_tokens long, completion_tokens long, latency_ms long").repartition(5)
    want = []
    for run in ("big", None, "free"):
        spent = None
        key = lambda r: (r[4] is None, r[4] or START, r[0], r[3] == "local-7b", r[5])
        for r in sorted((r for r in rows if r[1] == run), key=key):
            spent = spent if r[3] == "local-7b" else (spent or 0) + 500 * r[5]
            if spent is not None and spent <= 100_000:
                want.append((run, r[0], spent))
    models = tables.table(spark, "", "models")
    got = [tuple(r) for r in costs.budget_cutoff(usage, models, 100_000).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r[0] for r in got} == {"big", None}
    assert ranges.ranged(usage, "run_id", "ts").where("run_id = 'big'").select("part").distinct().count() > 1


def test_content_so_far(spark):
    rows = [("s", k, f"<{k}>") for k in range(50)] + [("t", 0, "é"), ("t", 4, ""), ("t", 2, "xy")]
    parsed = spark.createDataFrame(rows, "stream_id string, seq long, delta string").repartition(3)
    ends = generation.running_content(parsed)
    texts = spark.createDataFrame([("s", "".join(f"<{k}>" for k in range(50))), ("t", "éxy")], "stream_id string, content string")
    got = {(r["stream_id"], r["seq"]): r["content"] for r in generation.content_so_far(ends, texts).collect()}
    assert got == {("s", k): "".join(f"<{j}>" for j in range(k + 1)) for k in range(50)} | {("t", 0): "é", ("t", 2): "éxy", ("t", 4): "éxy"}


def test_running_text_of_streams_of_any_size(spark):
    """Each chunk has the whole text so far: of a stream with most rows, of null streams, with null and repeated seqs, whatever the order of the rows."""
    rows = [("big", k * 7919 % 600, f"<{k * 7919 % 600}>é😀"[: k % 9]) for k in range(600)] + [(None, 3, "c"), (None, 1, "ab"), (None, None, "zz"), ("s", 2, "y"), ("s", 2, "xxx"), ("s", 2, "y"), ("s", 1, ""), ("t", 5, "one")]
    parsed = spark.createDataFrame(rows, "stream_id string, seq long, delta string").repartition(3)
    want = []
    for name in {r[0] for r in rows}:
        text = ""
        for _, seq, delta in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            text += delta
            want.append((name, seq, text))
    got = generation.running_text(parsed)
    assert got.columns == ["stream_id", "seq", "content"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    parts = ranges.ranged(parsed, "stream_id", "seq")
    assert parts.where("stream_id = 'big'").select("part").distinct().count() > 1


def test_running_content_returns_texts(spark):
    """The query, and the SQL that it is checked against, give the text at each chunk and not where it ends."""
    sf = "/root/testdata/sf0.001"
    want, texts = {}, defaultdict(str)
    for r in sorted(registry.QUERIES["parse_chunks"](spark, sf).collect(), key=lambda r: (r["stream_id"], r["seq"])):
        texts[r["stream_id"]] += r["delta"]
        want[r["stream_id"], r["seq"]] = texts[r["stream_id"]]
    got = registry.QUERIES["running_content"](spark, sf)
    assert got.columns == ["stream_id", "seq", "content"]
    assert {(r["stream_id"], r["seq"]): r["content"] for r in got.collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert {(s, k): c for s, k, c in con.execute(registry.ORACLE_SQL["running_content"]).fetchall()} == want


def test_turns_of_a_repository_with_most_rows(spark):
    """Numbers over ranges equal those of one sorted list; no task holds the large repository, and null is one too."""
    repos = ["big" if i % 10 else (None, "a", "b")[i // 10 % 3] for i in range(6000)]
    rows = [(f"x{i}", r, (i * 7919) % 6000) for i, r in enumerate(repos)]
    got = selection.interleave_by_repo(spark.createDataFrame(rows, "instance_id string, repo string, doc_id long"))
    want = {}
    for name in set(repos):
        own = sorted((d, i) for i, r, d in rows if r == name)
        want |= {i: (name, n, own[0][0]) for n, (_, i) in enumerate(own, 1)}
    assert {r["instance_id"]: (r["repo"], r["turn"], r["repo_first"]) for r in got.collect()} == want
    parts = ranges.ranged(spark.createDataFrame(rows, "instance_id string, repo string, doc_id long"), "repo", "doc_id")
    assert parts.where("repo = 'big'").select("part").distinct().count() > 1
