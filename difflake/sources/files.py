"""Readers and writers of patches, instances, results, summaries and reports. Schemas are declared, so no file is read to infer one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranges import numbered
from ..operators import generation

RESULT = "instance_id string, passed boolean, error string"
BATCH = "successful array<struct<instance_id:string,model:string,attempts:int,cost:double,success:boolean,truncated:boolean,patch:string,error:string>>, failed array<string>, skipped array<string>, stats struct<total_instances:bigint,completed:bigint,failed:bigint,skipped:bigint,total_cost:double>"


RESULT_NAME = r"results_([^/]*?)_([0-9_]+)(?:\.json|/[^/]+)\z"


def _file_name() -> F.Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 1) and value of every line of the text files at path, however many blocks a file is read in.

    Within a block lines come in order in one task; the lines of a file's earlier blocks are counted and added, one row
    for each block. So large files are split as usual, and no file is read as a whole by one task. Files are read twice.
    Compressed files cannot be split and are one block.
    """
    m = F.monotonically_increasing_id().alias("m")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), m)
    blocks = lines.groupBy("path", "block").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(blocks, ["path", "block"]).select("path", (F.col("m") + F.col("shift") + 1).alias("line_no"), "value")


def read_predictions(spark: SparkSession, path: str, max_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """generation.load_predictions() of JSON-lines files: path, line_no, instance_id, patch, and reason for a line that is no prediction."""
    return generation.load_predictions(numbered_lines(spark, path), max_bytes, "path")


def quarantine(predictions: DataFrame, good: str, bad: str) -> None:
    """Writes predictions without a reason to good as Parquet, and where the others stand, and why they are refused, to bad."""
    predictions.where("reason is null").drop("reason").write.mode("errorifexists").parquet(good)
    predictions.where("reason is not null").select("path", "line_no", "instance_id", "reason").write.mode("errorifexists").parquet(bad)


def read_log_lines(spark: SparkSession, path: str, id_from: str = r"([^/]+)/[^/]+\z") -> DataFrame:
    """path, instance_id (taken from the path: the folder's name), line_no and line of log files."""
    return numbered_lines(spark, path).select("path", F.regexp_extract("path", id_from, 1).alias("instance_id"), "line_no", F.col("value").alias("line"))


def load_patch_dir(spark: SparkSession, path: str, names: str = "*.patch", id_from: str = r"([^/]+)\.patch\z") -> DataFrame:
    """instance_id (the file's stem) and patch of every *.patch file that is not empty: Spark reads no empty files, and an empty patch counts as missing anyway. Other layouts have other names, and ids elsewhere in the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", id_from, 1).alias("instance_id"), F.decode("content", "utf-8").alias("patch"))


def _patch_name(instance_id: str | None) -> str:
    """A file's stem for an id: quoted, and never one that begins like a hidden file's; % stands for null, %% for an empty id."""
    name = "%" if instance_id is None else quote(instance_id, safe="") or "%%"
    return f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in ("_", ".") else name


def patch_id(stem: F.Column) -> F.Column:
    """The id of a file that write_patch_dir() wrote, from its stem."""
    return F.when(stem == "%%", "").when(stem != "%", F.url_decode(stem))


def write_patch_dir(patches: DataFrame, path: str) -> int:
    """Writes each row's patch, as it is, to a file of its own; returns their number. A file is <task>-<k>/<quoted id>.patch under path, k being how often the task has had the id before.

    Tasks write through pyarrow, so it has to reach path: Spark's writers take as long for one file as this for hundreds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(path)
        part, seen, made = TaskContext.get().partitionId(), Counter(), set()
        for batch in batches:
            for i, patch in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                folder = f"{top}/{part}-{seen[i]}"
                seen[i] += 1
                if folder not in made:
                    made.add(folder)
                    store.create_dir(folder)
                with store.open_output_stream(f"{folder}/{_patch_name(i)}.patch") as out:
                    out.write(patch)
            yield pa.record_batch({"n": [len(batch)]})

    store, top = pafs.FileSystem.from_uri(path)
    store.create_dir(top)  # it is there even without a patch
    return patches.select("instance_id", "patch").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load_instances(rows: DataFrame) -> DataFrame:
    """The five fields of an instance, empty where null or absent; patch is read from diff only where the table has no column patch."""
    from_ = {"patch": "diff"} if "patch" not in rows.columns and "diff" in rows.columns else {}
    names = ("instance_id", "patch", "repo", "base_commit", "problem_statement")
    return rows.select(*((F.coalesce(F.col(c), F.lit("")) if (c := from_.get(n, n)) in rows.columns else F.lit("")).alias(n) for n in names))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """run_id, test_set, instance_id, passed, error of files, or folders of files, named results_<set>_<time>, each file an array of results."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = rows.where(F.col("path").rlike(RESULT_NAME))
    part = lambda g: F.regexp_extract("path", RESULT_NAME, g)
    parsed = F.from_json("value", "array<struct<instance_id:string,passed:boolean,error:string>>")
    return rows.select(part(2).alias("run_id"), part(1).alias("test_set"), F.inline(parsed)).where("instance_id is not null")


def load_generation_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per instance of saved batches: file, state (successful, failed or skipped), instance_id and, of successful ones, model, attempts, cost and patch."""
    b = spark.read.schema(BATCH).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select("*", _file_name().alias("file"))
    good = b.select("file", F.lit("successful").alias("state"), F.explode("successful").alias("r")).select("file", "state", "r.instance_id", "r.model", "r.attempts", "r.cost", "r.patch")
    other = [b.select("file", F.lit(s).alias("state"), F.explode(s).alias("instance_id")) for s in ("failed", "skipped")]
    return good.unionByName(other[0], allowMissingColumns=True).unionByName(other[1], allowMissingColumns=True)


def load_run_summaries(spark: SparkSession, path: str, names: str = "summary.json") -> DataFrame:
    """Ids of failed instances: of all summary.json files under path; if these name none, the folders that hold a file FAILED. Files that are no JSON are passed over."""
    read = lambda name: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    told = read(names).schema(RESULT).option("multiLine", True).json(path).where("not passed and instance_id is not null").select("instance_id")
    # markers are empty, and Spark reads no empty files: their paths are in the file index, which the driver has of any read
    paths = [(p.rsplit("/", 2)[-2],) for p in read("FAILED").format("binaryFile").load(path).inputFiles()] if told.isEmpty() else []
    return told.unionByName(spark.createDataFrame(paths, "instance_id string"))


def write_predictions(predictions: DataFrame, path: str) -> int:
    """Writes JSON lines of instance_id and patch; returns their number, counted while they are written."""
    seen = Observation()
    predictions.select("instance_id", "patch").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(path)
    return seen.get["n"]


STATES = ("resolved", "failed", "patch_failed", "timeout", "error")
#: What a report is made of, as it is read again: a header for each run and its parts.
COUNTS = "total bigint, " + ", ".join(f"{s} bigint" for s in STATES)
HEADER = f"run_id string, summary struct<{COUNTS.replace(' ', ':').replace(',:', ', ')}>, parts bigint"
PART = "run_id string, part bigint, first_id string, last_id string, instances array<struct<instance_id:string,status:string,attempts:bigint,flaky:boolean,error_message:string>>"


def run_report(results: DataFrame, per_part: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(headers, parts) of the report of each run. A header has the summary counts and the number of parts; a part has the instances of a range of ids, so many at most, in order.

    Instances are numbered over ranges, so a run of any size is many tasks' work and no row grows with it.
    """
    by = F.struct("ts", "seq")
    last = results.groupBy("run_id", "instance_id").agg(F.max_by("passed", by).alias("passed"), F.max_by("error", by).alias("error_message"), F.count("*").alias("attempts"), F.bool_or(~F.col("passed")).alias("ever_failed"))
    e = F.lower("error_message")
    status = F.when(F.col("passed"), "resolved").when(e.contains("patch does not apply"), "patch_failed").when(e.contains("timed out"), "timeout").when(e.contains("docker"), "error").otherwise("failed")
    rows = last.select("run_id", "instance_id", status.alias("status"), "attempts", (F.col("passed") & F.col("ever_failed")).alias("flaky"), "error_message")
    rows = numbered(rows, "pos", ["run_id"], "instance_id").withColumn("part", F.expr(f"pos div {per_part}"))
    instances = F.array_sort(F.collect_list(F.struct("instance_id", "status", "attempts", "flaky", "error_message")))
    counts = [F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATES)]
    parts = cut(rows.groupBy("run_id", "part").agg(F.min("instance_id").alias("first_id"), F.max("instance_id").alias("last_id"), instances.alias("instances"), *counts))
    names = ("total", *STATES)
    headers = parts.groupBy("run_id").agg(F.struct(*(F.sum(n).alias(n) for n in names)).alias("summary"), F.count("*").alias("parts"))
    return headers, parts.drop(*names)


def write_run_report(results: DataFrame, path: str, per_part: int = 10_000) -> None:
    """run_report as JSON: headers and parts, each with a folder for each run."""
    for name, rows in zip(("headers", "parts"), run_report(results, per_part), strict=True):
        rows.write.mode("errorifexists").partitionBy("run_id").json(f"{path}/{name}")


def read_run_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, parts) as they were written."""
    return tuple(spark.read.schema(kind).json(f"{path}/{name}") for name, kind in (("headers", HEADER), ("parts", PART)))


#: Counters of a harness report.
COUNTERS = ("Instances completed", "Instances unresolved", "Instances with errors", "Instances incomplete", "Instances resolved")


def harness_report_summary(reports: DataFrame) -> DataFrame:
    """The counters in the newest report (name, modified, report) of each folder, whatever the case and blanks of their names."""
    newest = reports.groupBy("folder").agg(F.max_by(F.struct("name", "report"), F.struct("modified", "name")).alias("r"))
    plain = lambda k: F.lower(F.replace(k, F.lit(" "), F.lit("")))
    entries = F.transform(F.map_entries(F.from_json("r.report", "map<string,string>")), lambda x: F.struct(plain(x["key"]).alias("key"), x["value"].alias("value")))
    def named(counter: str) -> F.Column:
        values = F.transform(F.filter("e", lambda x: x["key"] == counter.lower().replace(" ", "")), lambda x: x["value"])
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{counter}: "), F.get(values, F.lit(0))))

    rows = newest.withColumn("e", F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")))
    text = F.array_join(F.array_compact(F.array(*map(named, COUNTERS))), "; ")
    return rows.select("folder", F.col("r.name").alias("name"), F.when(text == "", "A report without counters").otherwise(text).alias("summary"))


def provider_requests(requests: DataFrame) -> DataFrame:
    """Bodies for three providers' shapes as JSON; what is absent is left out. Models named gpt-5... get no temperature."""
    c = F.col
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    system, has = c("system"), F.col("system") != ""
    both = F.when(has, F.array(message("system", system), message("user", c("prompt")))).otherwise(F.array(message("user", c("prompt"))))
    temperature = F.when(~F.lower("model").startswith("gpt-5"), c("temperature"))
    limit = F.when(c("max_tokens") > 0, c("max_tokens"))
    first = F.struct(c("model").alias("model"), both.alias("messages"), c("stream").alias("stream"), temperature.alias("temperature"), limit.alias("max_tokens"))
    second = F.struct(c("model").alias("model"), F.array(message("user", c("prompt"))).alias("messages"), F.coalesce(limit, F.lit(4000)).alias("max_tokens"), c("temperature").alias("temperature"), c("stream").alias("stream"), F.when(has, system).alias("system"))
    options = F.struct(c("temperature").alias("temperature"), F.lit(4096).alias("num_ctx"), limit.alias("num_predict"))
    third = F.struct(c("model").alias("model"), c("prompt").alias("prompt"), c("stream").alias("stream"), options.alias("options"), F.when(has, system).alias("system"))
    body = F.when(c("provider") == "anthropic", F.to_json(second)).when(c("provider") == "ollama", F.to_json(third)).otherwise(F.to_json(first))
    return requests.select("response_id", "provider", body.alias("body"))
