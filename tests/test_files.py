"""Readers and writers over real files."""

import json
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from difflake.plans import registry
from difflake.sources import files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_load_patch_dir(spark, tmp_path):
    put(tmp_path / "b__x-2.patch", "diff --git a/x b/x\n+é\n")
    put(tmp_path / "a__x-1.patch", "")
    put(tmp_path / "note.txt", "no")
    got = {r["instance_id"]: r["patch"] for r in files.load_patch_dir(spark, str(tmp_path)).collect()}
    assert got == {"b__x-2": "diff --git a/x b/x\n+é\n"}


def test_write_patch_dir(spark, tmp_path):
    """Each row has its own file, with its bytes as they are: rows of one id, of null, and ids that are no file names."""
    rows = [("a__x-1", "one\r\n"), ("a__x-1", "two"), ("a__x-1", "two"), (None, "é\n\n"), ("__hidden", "h"), (".dot", "d"), ("up/../n: 50%+", "s"), ("%", "p"), ("", "e")]
    path = tmp_path / "patches"
    table = spark.createDataFrame(rows, "instance_id string, patch string").coalesce(1)
    assert files.write_patch_dir(table, str(path)) == len(rows) == len(list(path.rglob("*.patch")))
    read = files.load_patch_dir(spark, str(path))
    got = [(i, p) for i, p in read.select(files.patch_id(read["instance_id"]), "patch").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
    assert files.write_patch_dir(table.where("false"), str(tmp_path / "none")) == 0 and files.load_patch_dir(spark, str(tmp_path / "none")).count() == 0


def test_load_patch_dir_query_on_many_odd_rows(spark, tmp_path):
    """The query equals its SQL on null, empty and odd sources and repeated ids, and 2,500 files take seconds (half a minute and more with a folder for each)."""
    sources = ["src1", None, "", "a/b", ".x", "c: 1%"]
    n = 3200
    ids, texts = [i // 2 * 2 if i % 64 < 2 else i for i in range(n)], [None if i % 97 == 5 else f"line {i}\n\ncafé\n" for i in range(n)]
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * n, "source": ["src1" if i % 64 < 2 else sources[i % 6] for i in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    began = time.perf_counter()
    got = [tuple(r) for r in registry.QUERIES["load_patch_dir"](spark, str(tmp_path)).select("instance_id", "patch").collect()]
    took = time.perf_counter() - began
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(registry.ORACLE_SQL["load_patch_dir"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len(want) > 2500 and len({i for i, _ in want}) < len(want)
    assert took < 30


def test_load_instances(spark):
    rows = spark.createDataFrame([("i", None, "d", 3)], "instance_id string, repo string, diff string, more int")
    assert files.load_instances(rows).collect() == [("i", "d", "", "", "")]
    both = spark.createDataFrame([("i", None, "d")], "instance_id string, patch string, diff string")
    assert files.load_instances(both).first()["patch"] == ""  # the column is there, so diff is not read


def test_load_results(spark, tmp_path):
    put(tmp_path / "results_lite_20250814_135058.json", json.dumps([{"instance_id": "a", "passed": False, "error": "x"}, {"instance_id": "b", "passed": True}]))
    put(tmp_path / "stats_lite_20250814_135058.json", "{}")
    assert sorted(map(tuple, files.load_results(spark, str(tmp_path)).collect())) == [("20250814_135058", "lite", "a", False, "x"), ("20250814_135058", "lite", "b", True, None)]


def test_load_generation_results(spark, tmp_path):
    put(tmp_path / "one.json", json.dumps({"successful": [{"instance_id": "a", "model": "m", "attempts": 2, "cost": 0.5, "patch": "p", "success": True, "truncated": False, "error": None, "metadata": {}}], "failed": ["b"], "skipped": ["c", "d"], "stats": {"completed": 1}}, indent=2))
    got = {(r["state"], r["instance_id"], r["model"], r["cost"]) for r in files.load_generation_results(spark, str(tmp_path)).collect()}
    assert got == {("successful", "a", "m", 0.5), ("failed", "b", None, None), ("skipped", "c", None, None), ("skipped", "d", None, None)}


def test_load_run_summaries(spark, tmp_path):
    ids = lambda: sorted(r["instance_id"] for r in files.load_run_summaries(spark, str(tmp_path)).collect())
    put(tmp_path / "run" / "a" / "summary.json", json.dumps({"instance_id": "a", "passed": True}))
    put(tmp_path / "run" / "b" / "FAILED", "")
    assert ids() == ["b"]  # no summary names a failure
    put(tmp_path / "run" / "c" / "summary.json", json.dumps({"instance_id": "c", "passed": False, "error": "e"}, indent=2))
    put(tmp_path / "run" / "d" / "summary.json", "{broken")
    assert ids() == ["c"]


def test_write_predictions(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p\n", 1), ("b", "", 2)], "instance_id string, patch string, more int")
    assert files.write_predictions(rows, str(tmp_path / "out")) == 2
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).collect())) == [("a", "p\n"), ("b", "")]


def test_harness_report_summary(spark):
    rows = [("f", "test.1.json", 1, '{"Instances resolved": 9}'), ("f", "test.2.json", 5, '{"instancesresolved": 3, "INSTANCES COMPLETED": 4, "x": 1}'), ("g", "test.3.json", 1, "no json")]
    got = {r["folder"]: r["summary"] for r in files.harness_report_summary(spark.createDataFrame(rows, "folder string, name string, modified long, report string")).collect()}
    assert got == {"f": "Instances completed: 4; Instances resolved: 3", "g": "A report without counters"}


def test_lines_of_split_files_have_their_numbers(spark, tmp_path):
    """Files cut into blocks that end inside lines and on line ends; blank lines, long lines, no line end at the end, an empty file."""
    texts = {"a": "".join(f"{k} {'x' * (k % 90)}\n" for k in range(3000)), "b": "one\n\n\n" + "y" * 50_000 + "\nlast", "c": "", "d": "".join(f"{k:07d}\n" for k in range(2048))}
    for name, text in texts.items():
        put(tmp_path / f"{name}.txt", text)
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    small.conf.set("spark.sql.files.openCostInBytes", "1")
    lines = files.numbered_lines(small, str(tmp_path))
    assert lines.select("path").rdd.getNumPartitions() >= 1
    got = sorted((r["path"].rsplit("/", 1)[1][0], r["line_no"], r["value"]) for r in lines.collect())
    want = [(name, k, line) for name, text in texts.items() for k, line in enumerate(text.removesuffix("\n").split("\n") if text else [], 1)]
    assert got == want


def test_bad_lines_go_to_quarantine_with_their_numbers(spark, tmp_path):
    rows = ['{"instance_id": "a", "patch": "p"}', "", "{broken", '{"instance_id": "b"}', '{"instance_id": "c", "patch": "' + "z" * 50 + '"}', '{"instance_id": "d", "patch": ""}']
    put(tmp_path / "in" / "p.jsonl", "\n".join(rows))
    files.quarantine(files.read_predictions(spark, str(tmp_path / "in"), 40), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert sorted((r["line_no"], r["instance_id"]) for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [(1, "a"), (6, "d")]
    assert sorted((r["line_no"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [(3, "bad_json"), (4, "missing_key"), (5, "too_large")]


def test_run_reports_in_parts(spark, tmp_path):
    rows = [("r", f"i{k:04d}", k % 3 == 0, None if k % 3 == 0 else "timed out", k) for k in range(250)] + [("s", "one", True, None, 1), ("s", "one", False, "docker", 0)]
    results = spark.createDataFrame(rows, "run_id string, instance_id string, passed boolean, error string, seq long").selectExpr("*", "timestamp_seconds(seq) as ts")
    files.write_run_report(results, str(tmp_path / "out"), 100)
    headers, parts = files.read_run_report(spark, str(tmp_path / "out"))
    got = {r["run_id"]: (r["summary"]["total"], r["summary"]["resolved"], r["summary"]["timeout"], r["parts"]) for r in headers.collect()}
    assert got == {"r": (250, 84, 166, 3), "s": (1, 1, 0, 1)}
    of_r = sorted((r["part"], r["first_id"], r["last_id"], [i["instance_id"] for i in r["instances"]]) for r in parts.where("run_id = 'r'").collect())
    assert [p[:3] for p in of_r] == [(0, "i0000", "i0099"), (1, "i0100", "i0199"), (2, "i0200", "i0249")] and of_r[1][3] == [f"i{k:04d}" for k in range(100, 200)]
    only = parts.where("run_id = 's'").first()["instances"][0]
    assert (only["status"], only["attempts"], only["flaky"]) == ("resolved", 2, True)
