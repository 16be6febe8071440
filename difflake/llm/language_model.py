"""Language-model scoring: a log-bilinear model over words and word classes, trained with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, stored, take

#: Words with a class of their own at most, and how often they must occur; classes of other words, by their last two bytes.
OWN, OWN_COUNT, OTHER = 1023, 50, 512
#: Words whose counts go to every task, and their length at most; the counts of all others are joined.
HEAD, HEAD_BYTES = 131_072, 64
#: Size of vectors, tokens of a batch, noise classes of a batch.
DIM, BATCH, NOISE = 24, 4096, 32
#: Rounds in which the training texts are dealt to tasks and the tasks' weights averaged; tokens of a task; batches of a task at least.
ROUNDS, TASK_TOKENS, LEAST = 2, 3_000_000, 200
#: Words that a task counts before it hands counts on.
COUNTED = 400_000


def word_class(word: bytes, end: int) -> int:
    return end + 1 + zlib.crc32(word[-2:]) % OTHER


@dataclass
class Bilinear:
    """P(class | two classes before) is softmax over classes of r . out + bias, where r is the sum of the context's vectors, each through its position's matrix."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @staticmethod
    def start(noise: np.ndarray, dim: int = DIM) -> Bilinear:
        rng = np.random.default_rng(11)
        draw = lambda: rng.normal(0, 0.1, (len(noise), dim)).astype(np.float32)
        return Bilinear(draw(), draw(), np.log(noise).astype(np.float32), np.eye(dim, dtype=np.float32) * 0.5, np.eye(dim, dtype=np.float32) * 0.5)

    def rows(self) -> np.ndarray:
        """All weights as rows of one width."""
        side = lambda x: np.hstack([x, np.zeros((len(x), 1), np.float32)])
        return np.vstack([side(self.vectors), np.hstack([self.out, self.bias[:, None]]), side(self.near), side(self.far)])

    @staticmethod
    def of_rows(rows: np.ndarray, classes: int) -> Bilinear:
        v, o, n, f = np.split(rows.astype(np.float32), [classes, 2 * classes, 2 * classes + rows.shape[1] - 1])
        return Bilinear(v[:, :-1].copy(), o[:, :-1].copy(), o[:, -1].copy(), n[:, :-1].copy(), f[:, :-1].copy())

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of (class before, class) with the bias, and of (class two before, class): a context's score is their sum."""
        return self.vectors @ self.near @ self.out.T + self.bias, self.vectors @ self.far @ self.out.T

    def log_norms(self, c2: int) -> np.ndarray:
        """log of the sum over classes of exp(score), for each class before, after c2."""
        one, two = self.vectors @ self.near, self.vectors @ self.far
        s = (one + two[c2]) @ self.out.T + self.bias
        top = s.max(1)
        return top + np.log(np.exp(s - top[:, None]).sum(1))


def triples(flat: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes two before, one before and at each place of texts that follow each other, each closed by its end: a text starts after two ends."""
    one = np.concatenate([[end], flat[:-1]])
    two = np.concatenate([[end, end], flat[:-2]])[: len(flat)]
    two[starts] = end
    return two, one, flat


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """to[at] += rows, where places may repeat."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # by digits, as classes are few
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[first]] += np.add.reduceat(rows[order], first)


def nce_gradients(model: Bilinear, c2: np.ndarray, c1: np.ndarray, w: np.ndarray, noise: np.ndarray, drawn: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean noise-contrastive loss of a batch, whose places share the drawn noise classes."""
    k, n = len(drawn), len(w)
    near, far = model.vectors @ model.near, model.vectors @ model.far
    r = near[c1] + far[c2]
    log_kn = np.log(k * noise)
    sig = lambda x: 1 / (1 + np.exp(-x))
    own = np.einsum("nd,nd->n", r, model.out[w]) + model.bias[w] - log_kn[w]
    g_own = (sig(own) - 1) / n
    g_noise = sig(r @ model.out[drawn].T + (model.bias - log_kn)[drawn]) / n
    gr = g_own[:, None] * model.out[w] + g_noise @ model.out[drawn]
    d_out, d_bias = np.zeros_like(model.out), np.bincount(w, g_own, len(noise))
    _add_rows(d_out, w, g_own[:, None] * r)
    np.add.at(d_out, drawn, g_noise.T @ r)
    d_bias += np.bincount(drawn, g_noise.sum(0), len(noise))
    d_near, d_far = np.zeros_like(near), np.zeros_like(far)
    _add_rows(d_near, c1, gr)
    _add_rows(d_far, c2, gr)
    return [d_near @ model.near.T + d_far @ model.far.T, d_out, d_bias.astype(np.float32), model.vectors.T @ d_near, model.vectors.T @ d_far]


def train_nce(model: Bilinear, chunks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], noise: np.ndarray, expected: int, rate: float, least: int = LEAST, seed: int = 5) -> int:
    """Trains the model in place on all triples of the chunks, in batches by Adam; returns their number.

    Fewer triples than least batches hold are gone through again. expected: triples to come, for the falling rate.
    """
    rng = np.random.default_rng(seed)
    noise = noise.astype(np.float32)
    ladder = np.cumsum(noise, dtype=np.float64)
    par = [model.vectors, model.out, model.bias, model.near, model.far]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    steps = max(least, -(-expected // BATCH))
    t = seen = 0

    def learn(chunk: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        nonlocal t
        order = rng.permutation(len(chunk[2]))
        for at in np.array_split(order, max(1, round(len(order) / BATCH))):
            drawn = np.minimum(np.searchsorted(ladder, rng.random(NOISE) * ladder[-1]), len(noise) - 1)
            t += 1
            now = rate * max(0.05, 1 - 0.95 * t / steps)
            for p, g, mp, vp in zip(par, nce_gradients(model, *(x[at] for x in chunk), noise, drawn), m, v, strict=True):
                mp += 0.1 * (g - mp)
                vp += 0.01 * (g * g - vp)
                p -= np.float32(now / (1 - 0.9**t)) * mp / (np.sqrt(vp / np.float32(1 - 0.99**t)) + np.float32(1e-8))

    kept = []
    for chunk in chunks:
        if not len(chunk[2]):
            continue
        seen += len(chunk[2])
        if seen <= least * BATCH:
            kept.append(chunk)
        learn(chunk)
    while seen and t < least:
        for chunk in kept:
            learn(chunk)
    return seen


@dataclass
class WordCounts:
    table: DataFrame  # w, c: every training word and its count, the end as an empty word
    total: int
    distinct: int
    ends: int
    head: dict[bytes, int]  # the most frequent words, numbered; the first own ones have their number as class
    counts: np.ndarray
    own: int
    class_mass: np.ndarray  # of each class: the count of its words; of classes of other words: the sum of count + 1, and 1 for words not seen
    class_count: np.ndarray


def _counted(texts: DataFrame) -> DataFrame:
    """w, c: words of texts and how often a task has met them; the end as an empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        handed = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "c"])
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(text.lower().split())
                if len(counts) > COUNTED:
                    yield handed()
                    counts.clear()
            counts[b""] += batch.num_rows
        yield handed()

    return texts.select("text").mapInArrow(run, "w binary, c long").where("c > 0")


def _most_frequent(table: DataFrame) -> DataFrame:
    """The HEAD most frequent words. Only those with counts from where about so many begin are sorted, so what one task merges does not grow with the words."""
    level = F.floor(F.log2("c") * 8)
    left, least = HEAD, None
    for r in table.groupBy(level.alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("l")).collect():  # 8 rows for each doubling of counts
        left, least = left - r["n"], r["l"]
        if left <= 0:
            break
    return (table if least is None else table.where(level >= least)).orderBy(F.desc("c"), "w").limit(HEAD)


def count_words(docs: DataFrame) -> WordCounts:
    """Counts over all training texts; the head, of fixed size, comes to the driver."""
    table = cut(_counted(docs.where("not held_out")).groupBy("w").agg(F.sum("c").alias("c")))
    word = F.octet_length("w") > 0
    total, distinct, ends = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(~word, F.col("c"))), F.lit(0))).first()
    most = _most_frequent(table.where(word & (F.octet_length("w") <= HEAD_BYTES))).toArrow()
    counts = most["c"].to_numpy()
    words = most["w"].to_pylist()
    own = int((counts[:OWN] >= OWN_COUNT).sum())
    classes = own + 1 + OTHER
    kind = F.crc32(F.substring("w", -2, 2)) % OTHER
    of_kind = table.where(word).groupBy(kind.alias("k")).agg(F.sum(F.col("c") + 1).alias("s"), F.sum("c").alias("c")).collect()  # OTHER rows at most
    mass, count = np.ones(classes), np.zeros(classes)
    count[:own], count[own] = counts[:own], ends
    for r in of_kind:
        mass[own + 1 + r["k"]] += r["s"]
        count[own + 1 + r["k"]] += r["c"]
    for w, c in zip(words[:own], counts[:own].tolist(), strict=True):
        mass[word_class(w, own)] -= c + 1
        count[word_class(w, own)] -= c
    return WordCounts(table, total, distinct, ends, {w: i for i, w in enumerate(words)}, counts, own, mass, count)


def _encoded(docs: DataFrame, known: WordCounts) -> DataFrame:
    """One row per text: its classes in order, sums over the words of the head, and its other words with their number."""
    shared = docs.sparkSession.sparkContext.broadcast((known.head, known.counts, known.own, known.class_mass))
    end_log, end_known = float(np.log10(known.ends + 1)), int(known.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, counts, own, mass = shared.value
        log_c = np.append(np.log10(counts + 1.0), 0.0)  # the last is for words that are not of the head
        of = np.arange(len(head) + 1)
        of[own:] = 0
        for w, i in head.items():
            if i >= own:
                of[i] = word_class(w, own)
        inner = log_c - np.log10(mass)[of]
        inner[:own] = 0
        log_mass = np.log10(mass)
        for batch in batches:
            sizes, n_rest, rest_words, rest_n, ids, sums = [], [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                words = text.as_py().lower().split()
                sizes.append(len(words) + 1)
                at = np.fromiter(map(head.get, words, repeat(-1)), np.int64, len(words))
                c, within = of[at], inner[at]
                missing = np.flatnonzero(at < 0)
                if len(missing):
                    others = [words[i] for i in missing]
                    c[missing] = kinds = [word_class(w, own) for w in others]
                    within[missing] = -log_mass[kinds]
                    rest = Counter(others)
                    n_rest.append(len(rest) + 1)
                    rest_words += rest.keys()
                    rest_n += rest.values()
                else:
                    n_rest.append(1)
                rest_words.append(None)
                rest_n.append(1)
                ids.append(np.append(c, own).astype(np.uint16).tobytes())
                sums.append((len(words) - len(missing) + end_known, log_c[at].sum() + end_log, within.sum()))
            known_, base, within = (np.array(x) for x in zip(*sums, strict=True)) if sums else (np.empty(0),) * 3
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_rest)]), pa.int32())
            rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()), pa.array(rest_n, pa.int64())], ["w", "tf"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(sizes, pa.int64()), pa.array(known_.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(within.astype(np.float64)), pa.array(ids, pa.binary()), rest], ["id", "held_out", "k1", "k2", "n_tokens", "n_known", "base", "within", "classes", "rest"])

    return docs.select("id", "held_out", "text", "k1", "k2").mapInArrow(run, "id long, held_out boolean, k1 long, k2 long, n_tokens long, n_known long, base double, within double, classes binary, rest array<struct<w:binary,tf:long>>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts of a batch, and where each text starts."""
    texts = column.to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(t) // 2 for t in texts])])[:-1].astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint16).astype(np.int64), starts


def train_model(encoded: DataFrame, known: WordCounts) -> Bilinear:
    """Trains in rounds over all training texts, each text in one round; every task starts from the round's weights, and those it ends with are averaged by its tokens.

    What is collected is the averaged weights, of fixed size.
    """
    spark: SparkSession = encoded.sparkSession
    noise = known.class_count + 0.5
    noise /= noise.sum()
    model, classes, end = Bilinear.start(noise), len(noise), known.own
    if not known.total:
        return model
    tasks = max(1, round(known.total / TASK_TOKENS))
    expected = known.total // (tasks * ROUNDS)
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast((model.rows(), noise))
        rate = 0.004 / (1 + number)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            rows, noise = shared.value
            own = Bilinear.of_rows(rows, classes)

            def chunks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for batch in batches:
                    yield triples(*_flat(batch.column(0)), end)

            n = train_nce(own, chunks(), noise, expected, rate)
            if n:
                got = own.rows().astype(np.float64) * n
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got))), pa.array(np.full(len(got), float(n))), *(pa.array(c) for c in got.T)], ["r", "n", *(f"p{i}" for i in range(DIM + 1))])

        some = encoded.where(~F.col("held_out") & (F.pmod("k1", F.lit(ROUNDS)) == number)).select("classes").coalesce(tasks)
        trained = some.mapInArrow(run, "r long, n double, " + ", ".join(f"p{i} double" for i in range(DIM + 1)))
        mean = trained.groupBy("r").agg(*((F.sum(f"p{i}") / F.sum("n")).alias(f"p{i}") for i in range(DIM + 1))).toPandas().sort_values("r")
        if len(mean):
            model = Bilinear.of_rows(mean.drop(columns="r").to_numpy(), classes)
    return model


def log_norms(spark: SparkSession, model: Bilinear) -> np.ndarray:
    """log of the normaliser of every context (class two before, class before), worked out in tasks."""
    shared = spark.sparkContext.broadcast(model)
    classes = len(model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.log_norms(c).astype("<f4").tobytes() for c in numbers], pa.binary())], ["id", "z"])

    rows = spark.range(classes, numPartitions=min(classes, 64)).mapInArrow(run, "id long, z binary").toArrow().sort_by("id")  # classes rows, at most OWN + 1 + OTHER
    return np.frombuffer(b"".join(rows["z"].to_pylist()), "<f4").reshape(classes, classes)


def log_probabilities(model: Bilinear, norms: np.ndarray, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 P(w | c2 c1): two tables' entries and the context's normaliser."""
    near, far = model.tables()
    return _looked_up(near.ravel(), far.ravel(), norms.ravel(), len(norms), c2, c1, w)


def _looked_up(near: np.ndarray, far: np.ndarray, norms: np.ndarray, classes: int, c2: np.ndarray, c1: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (near[c1 * classes + w].astype(np.float64) + far[c2 * classes + w] - norms[c2 * classes + c1]) / np.log(10)


def _scored(encoded: DataFrame, model: Bilinear, norms: np.ndarray, end: int) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast((*model.tables(), norms))
    classes = len(norms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, z = (x.ravel() for x in shared.value)
        for batch in batches:
            flat, starts = _flat(batch.column(8))
            logs = _looked_up(near, far, z, classes, *triples(flat, starts, end)) if len(flat) else flat
            sums = np.add.reduceat(logs, starts) if len(starts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), pa.array(sums + batch.column(7).to_numpy())], ["id", "held_out", "k1", "k2", "n_tokens", "n_known", "base", "score"])

    return encoded.select("id", "held_out", "k1", "k2", "n_tokens", "n_known", "base", "within", "classes").mapInArrow(run, "id long, held_out boolean, k1 long, k2 long, n_tokens long, n_known long, base double, score double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(id as text) mod folds is not fold are learnt from. Words seen 50 times or more, at most the 1,023
    most frequent, are classes of their own, as is the end; other words are of one of 512 classes, by their last two
    bytes. A word's log10 probability is that of its class after the two classes before it, by the model, plus, in
    classes of other words, that of the word in its class: (count + 1) over the class's sum of count + 1 and 1 for all
    words not seen. The base is add-one smoothing. Counts cover all training texts: those of the most frequent words
    go to every task, the others are joined by word. Every training text is learnt from, in tasks whose weights are averaged.
    A null or empty text has the end only. A null id, and an id that is no number, counts as null and is learnt from.
    How texts fall into tasks follows from how the table's files are split, so scores of tables that are laid out
    otherwise differ a little (reruns on the same files agree); where a table has fewer splits than tasks, later texts
    of a task are learnt at the lowest rate.
    Rows that repeat id and text get equal scores and count as often as they come. With no training rows counts are
    zero. An empty table gives an empty result. Texts of any length are one row's work.
    """
    slim = take(docs, id_col, text_col).select(F.col(id_col).try_cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    slim = slim.withColumn("held_out", F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == fold, F.lit(False)))
    known = count_words(slim)
    encoded = stored(_encoded(slim.withColumns({"k1": F.xxhash64("id", "text"), "k2": F.xxhash64("text", "id", F.lit(1))}), known))
    model = train_model(encoded, known)
    scored = cut(_scored(encoded, model, log_norms(docs.sparkSession, model), known.own))
    rest = encoded.select("k1", "k2", F.inline("rest"))
    own_row = F.col("w").isNull()  # each text has one such row; its key is one that no word has, and that no other text has
    rest = rest.select("k1", "k2", "tf", own_row.alias("own_row"), F.coalesce("w", F.concat(F.lit(b"\n"), F.col("k1").cast("string").cast("binary"))).alias("w"))
    n, log = F.when(~F.col("own_row") & F.col("c").isNotNull(), F.col("tf")).otherwise(0), F.when(~F.col("own_row"), F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)
    sums = rest.join(known.table, "w", "left").groupBy("k1", "k2").agg(F.sum(F.col("own_row").cast("long")).alias("m"), F.sum(n).alias("more"), F.sum(log).alias("log"))
    sums = cut(sums.select("k1", "k2", (F.col("more") / F.col("m")).cast("long").alias("more"), (F.col("log") / F.col("m")).alias("log")))  # equal rows have been summed together
    discard(encoded)
    out = scored.join(sums, ["k1", "k2"])
    smooth = float(np.log10(known.total + known.distinct + 1))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(int(known.total)).cast("long").alias("train_tokens"), (F.col("base") + F.col("log") - F.col("n_tokens") * smooth).alias("base_score"), (F.col("score") + F.col("log")).alias("score"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
