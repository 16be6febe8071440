"""Line deduplication by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, with_row

WINDOW = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with repeated passages of three lines or more taken out of text_col, and n_lines, n_removed, removed.

    Lines are what stands between line feeds. Every run of three consecutive lines is hashed to 128 bits; of the
    windows with the same lines the first by (id, position) stays, and the lines that later ones cover are removed. A
    later window that overlaps the first in the same document gives up only the lines that the first does not hold.
    Windows of blank lines do not count. removed lists the removed line numbers from 0.
    A null text stays null, with no lines; an empty text is one line. A null id comes last. Rows that repeat id and
    text are one document and all get the same result. An empty table gives an empty result. The added columns are
    appended by position, so columns of docs may have any names.
    """
    names = docs.columns
    rows = with_row(docs, id_=id_col, text_=text_col).withColumns({"k1": F.xxhash64("id_", "text_"), "k2": F.xxhash64("text_", "id_", F.lit(1))})
    slim = rows.select("id_", "k1", "k2", F.split("text_", "\n", -1).alias("lines")).where(F.size("lines") >= WINDOW)

    def window(i):
        a, b, c = (F.get("lines", i + j) for j in range(WINDOW))
        blank = F.trim(F.concat(a, b, c), F.lit(" \t\r")) == ""
        return F.when(~blank, F.struct(F.xxhash64(a, b, c).alias("h1"), F.xxhash64(c, a, b, F.lit(2)).alias("h2")))

    at = slim.select("id_", "k1", "k2", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window)).alias("pos", "w")).where("w is not null")
    place = F.struct(F.col("id_").isNull().alias("last"), "id_", "k1", "k2", "pos")
    at = cut(at.select("k1", "k2", "pos", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"), place.alias("place")))
    first = cut(at.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("final")).where("first < final").drop("final"))
    later = at.join(first, ["h1", "h2"]).where("place > first")
    same = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    start = F.when(same, F.greatest("pos", F.col("first.pos") + WINDOW)).otherwise(F.col("pos"))
    lines = later.select("k1", "k2", F.explode(F.sequence(start, F.col("pos") + WINDOW - 1)).alias("line"))
    covered = cut(lines.distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list("line")).alias("removed")))
    out = rows.join(covered, ["k1", "k2"], "left").withColumn("lines", F.split("text_", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col("text_")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    out = out.select("row_", text.alias("clean"), F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    kept = out.select(*((F.col("clean") if i == names.index(text_col) else F.col(f"row_.c{i}_")).alias(f"c{i}_") for i in range(len(names))), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
    return kept.toDF(*names, "n_lines", "n_removed", "removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(lines) - 2)) AS pos, lines FROM docs WHERE len(lines) >= 3),
occ AS (SELECT doc_id, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c FROM win),
ranked AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(pos) OVER w AS fp, row_number() OVER w AS rn
           FROM occ WHERE trim(a || b || c, ' ' || chr(9) || chr(13)) <> '' WINDOW w AS (PARTITION BY a, b, c ORDER BY doc_id, pos)),
gone AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS line FROM ranked WHERE rn > 1),
lists AS (SELECT doc_id, list(line ORDER BY line) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
       coalesce(array_to_string(removed, ','), '') AS removed,
       sha256(CASE WHEN removed IS NULL THEN text ELSE array_to_string([lines[i + 1] FOR i IN range(0, len(lines)) IF NOT list_contains(removed, i)], chr(10)) END) AS text_sha256
FROM docs d LEFT JOIN lists USING (doc_id)
"""
