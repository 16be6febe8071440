"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, first_by_hash, lower_word_bytes, take, unpack_row, with_row

#: Hashed text features; rated documents that the model is fitted on at most; documents that a word must be in to count; shapes' deviations at most.
BITS, SAMPLE, MIN_DF, FAR = 18, 12_000, 8, 6.0
#: Weights of the penalty that are tried on a fourth of the sample.
DECAYS = (1e-3, 5e-3, 2e-2)
_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:?'\"-()", b"!#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _CLASS[list(_set)] = _i
SHAPES = 8


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of the whole text, and its shape: shares of letters, capitals, digits, blanks, signs, repeats, word length."""
    words = lower_word_bytes(text)
    distinct = set(words)
    hashed = np.fromiter((xxhash.xxh32_intdigest(w) >> (32 - BITS) for w in distinct), np.int32, len(distinct))
    raw = (text or "").encode("utf-8", "surrogatepass")
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / max(1, len(raw))
    shape = np.array([share[1], share[2], share[3], share[4], share[5], share[6], len(distinct) / max(1, len(words)) if len(words) < 50 else (len(distinct) / len(words)) * (len(words) / 50) ** 0.3, min(20.0, len(raw) / max(1, len(words))) / 20], np.float32)
    return np.unique(hashed), shape


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(score - thresholds[k]): one score for all grades, rising thresholds."""

    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    thresholds: np.ndarray

    def score(self, hashed: np.ndarray, shape: np.ndarray) -> float:
        return float(self.words[hashed].sum() + np.clip((shape - self.mean) / self.scale, -FAR, FAR) @ self.shapes)

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, epochs: int = 40, rate: float = 0.05, decay: float = 5e-3) -> OrdinalModel:
    """Cumulative-link likelihood by Adam on mini-batches in a fixed order; thresholds stay ordered as sums of positive steps."""
    d = 1 << BITS
    model = OrdinalModel(np.zeros(d), np.zeros(SHAPES), np.zeros(SHAPES), np.ones(SHAPES), np.arange(n_grades - 1, dtype=np.float64))
    if not len(rows):
        return model
    shapes = np.stack([s for _, s in rows]).astype(np.float64)
    model.mean, model.scale = shapes.mean(0), shapes.std(0) + 1e-3
    shapes = np.clip((shapes - model.mean) / model.scale, -FAR, FAR)
    df = np.bincount(np.concatenate([h for h, _ in rows]), minlength=d)
    index, place = np.full(d, -1, np.int32), np.flatnonzero(df >= MIN_DF)
    index[place] = np.arange(len(place))
    kept = [index[h][index[h] >= 0] for h, _ in rows]
    flat, n = np.concatenate(kept), np.array([len(k) for k in kept])
    starts = np.concatenate([[0], np.cumsum(n)])
    counts = np.bincount(grades, minlength=n_grades) + 1.0
    above = 1 - np.cumsum(counts)[:-1] / counts.sum()
    cuts = -np.log(above / (1 - above))  # rising
    par = np.concatenate([np.zeros(len(place)), np.zeros(SHAPES), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, v, step = np.zeros_like(par), np.zeros_like(par), 0
    w_end = len(place)
    rng = np.random.default_rng(7)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 512)):
            words = np.concatenate([flat[starts[i] : starts[i + 1]] for i in batch]) if len(batch) else flat[:0]
            at = np.repeat(np.arange(len(batch)), n[batch])
            score = np.bincount(at, par[words], len(batch)) + shapes[batch] @ par[w_end : w_end + SHAPES]
            steps = np.exp(par[w_end + SHAPES + 1 :])
            t = np.concatenate([[-np.inf], par[w_end + SHAPES] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
            y = grades[batch]
            hi, lo = sig(score - t[y]), sig(score - t[y + 1])  # P(> y-1), P(> y)
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            g = -(d_hi - d_lo) / len(batch)
            grad = np.zeros_like(par)
            grad[:w_end] = np.bincount(words, g[at], w_end) + decay * par[:w_end]
            grad[w_end : w_end + SHAPES] = shapes[batch].T @ g + decay * par[w_end : w_end + SHAPES]
            dt = np.bincount(y, d_hi, n_grades + 1)[:n_grades] - np.concatenate([[0], np.bincount(y, d_lo, n_grades)[: n_grades - 1]])
            dt = dt[1:] / len(batch)  # by threshold
            grad[w_end + SHAPES] = dt.sum()
            grad[w_end + SHAPES + 1 :] = np.cumsum(dt[::-1])[::-1][1:] * steps
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            par -= rate * 0.93**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.words[place] = par[:w_end]
    model.shapes = par[w_end : w_end + SHAPES]
    model.thresholds = par[w_end + SHAPES] + np.concatenate([[0], np.cumsum(np.exp(par[w_end + SHAPES + 1 :]))])
    return model


def log_likelihood(model: OrdinalModel, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> float:
    """Mean log probability of the grades."""
    tails = model.tails(np.array([model.score(*r) for r in rows]))
    tails = np.hstack([np.ones((len(rows), 1)), tails, np.zeros((len(rows), 1))])
    at = np.arange(len(rows))
    return float(np.log(np.maximum(tails[at, grades] - tails[at, grades + 1], 1e-9)).mean())


def fit_validated(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """Fits on all rows, with the penalty under which a fit on three fourths gives the others the highest likelihood."""
    held = np.arange(len(rows)) % 4 == 3
    if len(rows) < 40:
        return fit_ordinal(rows, grades, n_grades)
    part = lambda of: [r for r, yes in zip(rows, of, strict=True) if yes]
    fits = [fit_ordinal(part(~held), grades[~held], n_grades, decay=d) for d in DECAYS]
    found = [log_likelihood(m, part(held), grades[held]) for m in fits]
    return fit_ordinal(rows, grades, n_grades, decay=DECAYS[int(np.argmax(found))])


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from ratings: 0 toxic, 1 poor, 2 good. A document rated more than once has its lowest grade; rows without id or ratings do not count."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).when(F.col("quality") >= 1, 2)
    return take(labels, id_col, "quality", "toxic").select(F.col(id_col).alias("id"), grade.alias("grade")).where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))


def train_quality(docs: DataFrame, grades: DataFrame, n_grades: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on at most sample graded documents, the first by a hash of their id; only their features come to the driver."""
    chosen = first_by_hash(cut(grades.withColumn("h", F.xxhash64("id", F.lit(3)))), sample, "h", "id").drop("h")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [text_features(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "grade": pdf["grade"], "hashed": [h.astype("<i4").tobytes() for h, _ in f], "shape": [s.astype("<f4").tobytes() for _, s in f]})

    texts = take(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").mapInPandas(features, "id long, grade int, hashed binary, shape binary").toPandas()  # the sample is bounded
    rows = rows.assign(order=[xxhash.xxh64_intdigest(str(i)) for i in rows["id"]]).sort_values(["order", "hashed"], kind="stable")
    parsed = [(np.frombuffer(h, "<i4"), np.frombuffer(s, "<f4")) for h, s in zip(rows["hashed"], rows["shape"], strict=True)]
    grade = rows["grade"].to_numpy(np.int64)
    del rows
    return fit_validated(parsed, grade, n_grades)


def score_quality(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All rows of docs as row_, with score, expected_grade, p_top (probability of the highest grade), p_above (of any but the lowest) and keep.

    keep: p_top is at least threshold. A null or empty text has no words and a shape of zeros, and is scored as such;
    shapes count six deviations at most, as in training;
    rows are scored one by one, so repeated rows get equal scores, null ids are kept, other columns pass unchanged
    and an empty table gives an empty result. Scored in place: nothing is shuffled; the model, of fixed size, is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, expected_grade double, p_top double, p_above double")
    def judge(text: pd.Series) -> pd.DataFrame:
        model = shared.value
        score = np.array([model.score(*text_features(t)) for t in text], np.float64)
        tails = model.tails(score)
        return pd.DataFrame({"score": score, "expected_grade": tails.sum(1), "p_top": tails[:, -1], "p_above": tails[:, 0]})

    rows = with_row(docs, id_=id_col, text_=text_col).withColumn("j", judge("text_"))
    return rows.select("row_", "id_", "j.*").withColumn("keep", F.col("p_top") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps; the same columns."""
    model = train_quality(docs, graded(labels), **options)
    return unpack_row(score_quality(docs, model).where("keep"), docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_quality(docs, model).select(F.col("id_").alias("doc_id"), "score", "expected_grade", "p_top", "p_above", "keep")
