"""Parameters and limits: unusual sizes, units of very many rows, components out of range, scores on the border, whole runs on odd tables."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from difflake.llm import quality, source_mix, substring_dedup, topk_search

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def words(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))


def test_passages_of_other_lengths(spark):
    rng = np.random.default_rng(8)
    shared = words(rng, 22)
    texts = [f"{words(rng, 40)} {shared} {words(rng, 40)}" for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert substring_dedup.repeated_passages(docs).count() == 0
    rows = substring_dedup.repeated_passages(docs, min_run=10).collect()
    assert {(r["doc_id"], r["removed"]) for r in rows} == {(0, False), (1, True)}
    for r in rows:
        found = texts[r["doc_id"]][r["start"] : r["end"]]
        assert found in shared and r["n_words"] == len(found.split()) >= 10
    lines = ["one two three four five six", "seven eight nine ten eleven twelve"]
    docs = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join([*lines, "own words here and there too"]))], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(docs, min_words=5, min_run=12).collect()
    assert {(r["doc_id"], r["n_words"], r["removed"]) for r in rows} == {(0, 12, False), (1, 12, True)}
    for wrong in ({"min_words": 4}, {"min_run": 0}):
        with pytest.raises(ValueError):
            substring_dedup.repeated_passages(docs, **wrong)


def test_mix_of_a_unit_of_very_many_rows(spark):
    """Rows of one null id and size are one unit: all get the same copies, and none of them is lost."""
    many = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("x y z").alias("text"))
    few = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit("x y").alias("text"))
    docs = many.unionByName(few)
    copies = source_mix.mix_copies(docs)
    got = copies.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("copies").alias("ways"), F.sum("copies").alias("copies")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 30_000, "b": 200}
    assert {r["source"]: r["ways"] for r in got}["a"] == 1
    assert source_mix.mixed_documents(docs).count() == sum(r["copies"] for r in got)


@pytest.mark.parametrize("big", [-1e308, 1e308, -(2.0**63), 2.0**62, 1e17])
def test_components_out_of_range_are_refused(spark, big):
    with pytest.raises(ValueError, match="53 bits"):
        topk_search.top_k_search(spark.createDataFrame([(0, [big, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_quality_scores_of_a_known_model(spark):
    """Against the formula: the logistic of the score less each threshold; half counts as kept, and length is no limit."""
    model = quality.train_quality(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "id long, grade int"))
    assert not model.words.any() and (np.diff(model.thresholds) > 0).all()
    long = "word number and more. " * 60_000
    docs = spark.createDataFrame([(0, "plain words"), (1, long), (2, None), (3, "plain words")], "doc_id long, text string")
    model.words[:] = np.random.default_rng(1).normal(0, 0.1, len(model.words))
    rows = {r["id_"]: r for r in quality.score_quality(docs, model).collect()}
    for i, text in ((0, "plain words"), (1, long), (2, None)):
        hashed, shape = quality.text_features(text)
        score = model.score(hashed, shape)
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert math.isclose(rows[i]["score"], score, abs_tol=1e-9) and math.isclose(rows[i]["p_top"], tails[-1], abs_tol=1e-9)
        assert math.isclose(rows[i]["p_above"], tails[0], abs_tol=1e-9) and math.isclose(rows[i]["expected_grade"], sum(tails), abs_tol=1e-9)
    assert rows[0]["score"] == rows[3]["score"]
    model.words[:], model.shapes[:] = 0, 0
    model.thresholds[:] = [-1.0, 0.0]
    assert all(r["p_top"] == 0.5 and r["keep"] for r in quality.score_quality(docs, model).collect())


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, labels="/root/testdata/sf0.001/labels.parquet"):
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
        spark.read.parquet(labels).write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def test_pipeline_on_an_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_pipeline_on_nulls_and_repeats(spark, folder):
    """Every piece is of a document that was there, and no document is packed more often than the mix takes it."""
    good = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(i, "s" if i % 3 else None, None, None, t) for i, t in enumerate(good)]
    rows += [(None, None, None, None, None), (None, "s", "en", 3, ""), (40, "t", "en", 5, "a b c"), *rows[:3], (41, "t", "en", 9, good[0] * 30)]
    pieces = corpus_pipeline.run(spark, folder(rows)).collect()
    assert {r["doc_id"] for r in pieces} <= {r[0] for r in rows}
    filled = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert pieces and max(filled.values()) <= 1024
