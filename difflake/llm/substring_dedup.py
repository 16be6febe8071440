"""Substring deduplication: exact runs of words by winnowing, and paragraph MinHash banding, exact Jaccard verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, discard, lower_word_bytes, mix, shingle_hashes, stored, take, word_hashes
from .merkle import numbered

#: 5 bands of 2 minima: paragraphs of similarity 0.8 collide with probability 0.994, of 0.9 with 0.9998.
BANDS, ROWS, SHINGLE = 5, 2, 5
#: Words of a paragraph, and of a run that is looked up and of a reported passage, at least, where no others are named.
MIN_WORDS, MIN_RUN = 10, 25
#: Of so many runs of words that follow each other, one at least is looked up.
WINDOW = 12
#: Members of a band whose pairs are joined as such, at most, and rows and columns of a tile of larger bands.
HOT, TILE = 64, 512
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Cut:
    """A text's words, by hash and place, and its paragraphs as ranges of words.

    A paragraph ends with a line, or with a sentence whose own hash is a multiple of three. So the ends depend on the
    words nearby only, and a passage is cut alike wherever it stands.
    """

    def __init__(self, text: str, min_words: int = MIN_WORDS):
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], (cp != 32) & ((cp < 9) | (cp > 13)), [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.hashes = word_hashes(lower_word_bytes(text))
        n = len(self.hashes)
        last = cp[self.ends - 1]
        line = np.zeros(n, bool)
        if n:
            line[np.searchsorted(self.starts, np.flatnonzero(cp == 10)) - 1] = True  # of a line end before the first word, this marks the last word, which ends a paragraph anyway
        stops = np.flatnonzero((last == 46) | (last == 33) | (last == 63) | line | (np.arange(n) == n - 1))
        if n:
            own = mix(np.add.reduceat(self.hashes, np.concatenate([[0], stops[:-1] + 1])))
            stops = stops[(own % np.uint64(3) == 0) | line[stops] | (stops == n - 1)]
        self.first, self.stop = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64)[: len(stops)], stops + 1
        long = self.stop - self.first >= min_words
        self.first, self.stop = self.first[long], self.stop[long]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of SHINGLE words inside paragraphs of words enough, and where each paragraph's begin."""
        sh, size = shingle_hashes(self.hashes, SHINGLE), self.stop - self.first - SHINGLE + 1
        at = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        return sh[np.repeat(self.first - at, size) + np.arange(size.sum())], at

    def nodes(self) -> np.ndarray:
        """A hash of each paragraph's words in order."""
        size = self.stop - self.first
        at = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        place = np.arange(size.sum()) - np.repeat(at, size)
        return np.add.reduceat(mix(self.hashes[np.repeat(self.first, size) + place] + place.astype(np.uint64) * _PAIR), at).view(np.int64)


def _sliding(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over all windows of n values, where op need not mind that its two parts overlap."""
    span = 1
    while span * 2 <= n:
        x, span = op(x[:-span], x[span:]), span * 2
    return op(x[: -(n - span)], x[n - span :]) if n > span else x


def winnow(hashes: np.ndarray, min_run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the chosen runs of min_run words: those that are the least of WINDOW neighbours.

    The choice depends on the words nearby only. So two texts with min_run + WINDOW - 1 words in common share a chosen
    run, and chosen runs cover the common words but for WINDOW - 1 at either end at most.
    """
    if len(hashes) < min_run:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = _sliding(hashes, min_run, lambda a, b: mix(a * _PAIR + b))
    n = min(WINDOW, len(runs))
    least, edge = _sliding(runs, n, np.minimum), np.zeros(n - 1, np.uint64)
    at = np.flatnonzero(runs == _sliding(np.concatenate([edge, least, edge]), n, np.maximum))
    return _thinned(at, runs[at], min_run)


def _thinned(at: np.ndarray, runs: np.ndarray, min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Without equal runs that overlap, as in a text of one word, where the others cover the same words."""
    if len(np.unique(runs)) == len(runs):
        return at, runs
    kept, last, waits = [], {}, {}
    for i, (p, x) in enumerate(zip(at.tolist(), runs.tolist(), strict=True)):
        if x in waits and p > last[x] + min_run:
            kept.append(waits.pop(x))
            last[x] = int(at[kept[-1]])
        if x in last and p <= last[x] + min_run:
            waits[x] = i
        else:
            kept.append(i)
            last[x] = p
    kept = np.sort(np.array([*kept, *waits.values()]))
    return at[kept], runs[kept]


def _paragraph_rows(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """id, k, pos, start, end, n_words, node, bands, of every paragraph and every chosen run of words.

    pos counts the words before it, node is a hash of its words. bands are hashes of minima (shingle hashes are mixed,
    so a product orders them anew), null for runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, spans, nodes, bands_ = [np.empty(0, np.int64)], [np.empty((0, 4), np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            run_doc, run_spans, run_nodes = [np.empty(0, np.int64)], [np.empty((0, 4), np.int64)], [np.empty(0, np.int64)]
            for n, text in enumerate(batch.column(2).to_pylist()):
                t = Cut(text, min_words)
                at, hashes = winnow(t.hashes, min_run)
                run_doc.append(np.full(len(at), n))
                run_spans.append(np.stack([at, t.starts[at], t.ends[at + min_run - 1], np.full(len(at), min_run)], 1))
                run_nodes.append(hashes.view(np.int64))
                if not len(t.first):
                    continue
                sh, at = t.shingles()
                minima = np.stack([np.minimum.reduceat(sh * s, at) for s in _SEEDS])
                bands = mix(minima[::ROWS] * np.uint64(3) + mix(minima[1::ROWS] + np.arange(BANDS, dtype=np.uint64)[:, None]))
                bands_.append(bands.T.ravel().view(np.int64))
                doc.append(np.full(len(at), n))
                spans.append(np.stack([t.first, t.starts[t.first], t.ends[t.stop - 1], t.stop - t.first], 1))
                nodes.append(t.nodes())
            n_parts = sum(map(len, doc))
            of = pa.array(np.concatenate([*doc, *run_doc]))
            at = np.concatenate([*spans, *run_spans])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n_parts + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands_)))
            bands = pa.concat_arrays([bands, pa.nulls(len(of) - n_parts, bands.type)])
            columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1]), pa.array(at[:, 2]), pa.array(at[:, 3].astype(np.int32)), pa.array(np.concatenate([*nodes, *run_nodes])), bands, pa.array(np.arange(len(of)) >= n_parts)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "k", "pos", "start", "end", "n_words", "node", "bands", "run"])

    return docs.select("id", "k", "text").mapInArrow(run, "id long, k long, pos int, start long, end long, n_words int, node long, bands array<long>, run boolean")


def _sets(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """node and its sorted distinct shingle hashes, of the paragraphs named by wanted: k and nodes, each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Cut(text, min_words)
                sh, at = t.shingles()
                stop, asked = [*at[1:].tolist(), len(sh)], set(asked)
                for i, node in enumerate(t.nodes().tolist()):
                    if node in asked:
                        asked.discard(node)
                        nodes.append(node)
                        sets.append(np.unique(sh[at[i] : stop[i]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return docs.select("k", "text").join(wanted, "k").select("text", "nodes").mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def _alike(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return threshold.denominator * both >= threshold.numerator * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), threshold) for p, q in zip(x, y, strict=True)], dtype=bool)

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").where(linked("x", "y")).select("a", "b").distinct()


def _crossing(kept: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the bands whose paragraphs are not all of one component yet: band, node, root, main (the root of most), cnt."""
    rooted = stored(kept.select("band", "node").join(label, "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = cut(sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("cnt")).where("roots > 1").select("band", "main", "cnt"))
    cross = stored(rooted.join(mixed, "band"))
    discard(rooted)
    return cross


def _pairs(cross: DataFrame) -> DataFrame:
    """Pairs of different components in small bands, each once however many bands it shares."""
    out = cross.where("root <> main").select("band", F.col("node").alias("x"), F.col("root").alias("rx"))
    met = out.join(cross.select("band", F.col("node").alias("y"), F.col("root").alias("ry")), "band").where("rx <> ry")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _tiles(cross: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The links between different components in large bands.

    Members outside a band's main component meet all its members. Both are dealt to tiles of bounded size, so a large
    band is many tasks' work, and only links are returned.
    """
    n_out = cross.where("root <> main").groupBy("band").agg(F.count("*").alias("outs"))
    cross = cut(cross.join(cut(n_out), "band"))
    rows, cols = F.ceil(F.col("outs") / TILE).cast("int"), F.ceil(F.col("cnt") / TILE).cast("int")
    asks = cross.where("root <> main").select("band", F.pmod(F.xxhash64("node"), rows).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), cols - 1)).alias("c"), "node", "root", F.lit(True).alias("asks"))
    has = cross.select("band", F.explode(F.sequence(F.lit(0), rows - 1)).alias("r"), F.pmod(F.xxhash64("node"), cols).cast("int").alias("c"), "node", "root", F.lit(False).alias("asks"))
    dealt = asks.unionByName(has).join(sets, "node")
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(tile: pd.DataFrame) -> pd.DataFrame:
            out = []
            if tile["asks"].any() and not tile["asks"].all():
                has_ = tile[~tile["asks"]]
                ids, root = has_["node"].to_numpy(), has_["root"].to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in has_["set"]]
                size = np.array([len(x) for x in sets])
                value, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                order = np.argsort(value)
                value, of = value[order], of[order]
                for x, rx, own in tile[tile["asks"]][["node", "root", "set"]].itertuples(index=False):
                    mine = np.frombuffer(own, np.uint64)
                    lo, hi = np.searchsorted(value, mine), np.searchsorted(value, mine, "right")
                    n = hi - lo
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    both = np.bincount(of[at], minlength=len(sets))
                    ok = (root != rx) & (q * both >= p * (len(mine) + size - both))
                    out += [(min(x, y), max(x, y)) for y in ids[ok].tolist()]
            return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

        held: list[pd.DataFrame] = []
        last = None
        for pdf in batches:
            for tile_id, tile in pdf.groupby(["band", "r", "c"], sort=False):
                if tile_id != last and held:
                    yield solve(pd.concat(held))
                    held = []
                last = tile_id
                held.append(tile)
        if held:
            yield solve(pd.concat(held))

    return dealt.repartition("band", "r", "c").sortWithinPartitions("band", "r", "c").mapInPandas(run, "a long, b long").distinct()


def _passages(hits: list[tuple], min_run: int) -> Iterator[tuple]:
    """start, end, n_words, clusters, first_ids, removed of a document's passages, of its hits (pos, stop, start, end, later, cluster, first_id).

    Hits that touch are one passage; what later hits cover is removed, the rest of it stays.
    """
    hits = sorted(hits, key=lambda h: h[:5])
    i = 0
    while i < len(hits):
        j, stop, end = i, hits[i][1], hits[i][3]
        while j < len(hits) and hits[j][0] <= stop:
            stop, end, j = max(stop, hits[j][1]), max(end, hits[j][3]), j + 1
        group, first = hits[i:j], hits[i]
        i = j
        if stop - first[0] < min_run:
            continue
        gone: list[list[int]] = []
        for pos, s, a, b, later, *_ in group:
            if later and gone and pos <= gone[-1][1]:
                gone[-1][1], gone[-1][3] = max(gone[-1][1], s), max(gone[-1][3], b)
            elif later:
                gone.append([pos, s, a, b])
        pieces, pos, at = [], first[0], first[2]
        for p, s, a, b in gone:
            if p > pos:
                pieces.append((pos, p, at, a, False))
            pieces.append((p, s, a, b, True))
            pos, at = s, b
        if stop > pos:
            pieces.append((pos, stop, at, end, False))
        low = 0
        for p, s, a, b, removed in pieces:
            while low < len(group) and group[low][1] <= p:
                low += 1
            of = []
            for h in group[low:]:
                if h[0] >= s:
                    break
                if h[1] > p and h[4] == removed:
                    of.append(h)
            yield a, b, s - p, [h[5] for h in of], list(dict.fromkeys(h[6] for h in of)), removed


def _passage_rows(hits: DataFrame, min_run: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1)
            offsets, fields = parts.offsets.to_numpy() - parts.offsets[0].as_py(), [c.to_pylist() for c in parts.flatten().flatten()]
            of, rows = [], []
            for n, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                found = list(_passages(list(zip(*(f[a:b] for f in fields), strict=True)), min_run))
                of += [n] * len(found)
                rows += found
            start, end, n_words, clusters, first_ids, removed = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n_words, pa.int64()), pa.array(clusters, pa.list_(pa.int64())), pa.array(first_ids, pa.list_(pa.int64())), pa.array(removed, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "end", "n_words", "clusters", "first_ids", "removed"])

    parts = hits.groupBy("id", "k").agg(F.collect_list(F.struct("pos", F.expr("pos + n_words").alias("stop"), "start", "end", "later", "cluster", "first_id")).alias("parts"))  # a document's own
    return parts.select("id", "parts").mapInArrow(run, "id long, start long, end long, n_words long, clusters array<long>, first_ids array<long>, removed boolean")


def paragraph_clusters(docs: DataFrame, rows: DataFrame, threshold: Fraction, min_words: int = MIN_WORDS) -> DataFrame:
    """node and root, the smallest node that it reaches over links, of the paragraphs among rows that link with others."""
    band = rows.select("node", F.explode("bands").alias("band"))
    shared = cut(band.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"))
    kept = stored(band.join(shared, "band").select("band", "node", "lo", "hi").distinct())
    pairs = kept.select(F.least("node", "lo").alias("a"), F.greatest("node", "lo").alias("b")).union(kept.select(F.least("node", "hi").alias("a"), F.greatest("node", "hi").alias("b")))
    pairs = cut(pairs.where("a < b").distinct())
    nodes = kept.select("node").distinct()
    wanted = rows.where("not run").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("k").alias("k")).groupBy("k").agg(F.collect_list("node").alias("nodes"))  # a document's own
    sets = stored(_sets(docs, wanted, min_words))
    links = cut(_verified(pairs, sets, threshold))
    label = components(links)
    cross = _crossing(kept, label)
    if not cross.isEmpty():
        few, many = cross.where(F.col("cnt") <= HOT), cross.where(F.col("cnt") > HOT)
        found = _verified(cut(_pairs(few).join(pairs, ["a", "b"], "left_anti")), sets, threshold)
        found = found if many.isEmpty() else found.union(_tiles(many, sets, threshold))
        label = components(cut(links.union(found).distinct()))
    discard(kept, sets, cross)
    return label


def repeated_passages(
    docs: DataFrame,
    threshold: Fraction = Fraction(4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_run: int = MIN_RUN,
) -> DataFrame:
    """One row per passage that repeats: id, start, end (code points), n_words, clusters, first_ids, removed.

    Runs of min_run words that winnow() chooses are looked up by their hash, so exact repeats of min_run + 11 words or
    more are found wherever they stand, but for 11 words at either end at most. For near copies, texts are cut into paragraphs of
    min_words words or more, which are 5 at least (see Cut). MinHash bands bring similar paragraphs together; each is first compared with the smallest and the largest of
    its band, exactly, by the Jaccard similarity of its 5-word shingles, which is to be threshold or more.
    Where a band's paragraphs are not of one component then, those outside the main one meet all: as distinct pairs in
    bands of at most 64, else in tiles. Components are clusters, and equal paragraphs are one node from the start. Of each
    cluster and each run that of the smallest (id, position) stays. Runs and paragraphs that repeat and touch are one
    passage, reported with min_run words or more in all, in one row for each part that stays or goes: removed is true for
    what later copies cover, other than a run that overlaps its own first copy. clusters lists the numbers of the
    part's runs and paragraphs and first_ids the documents of those that stay.
    A null or empty text has no paragraphs. A null id comes last; an id that is no number is an error in ANSI mode, else
    null. Rows that repeat id and text are one document. An
    empty table gives an empty result; other columns do not matter.
    """
    if min_words < SHINGLE or min_run < 1:
        raise ValueError(f"min_words has to be {SHINGLE} or more, min_run 1 or more")
    slim = take(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    slim = slim.withColumn("k", F.xxhash64("id", "text"))
    every = stored(_paragraph_rows(slim, min_words, min_run))
    plain, runs = every.where("not run").drop("bands"), every.where("run").drop("bands")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "k", "pos")
    label = paragraph_clusters(slim, every, threshold, min_words)
    rooted = plain.join(label, "node", "left").withColumn("cluster", F.coalesce("root", "node")).drop("root", "node")
    again = cut(runs.groupBy("node").count().where("count > 1").select("node"))
    rooted = stored(rooted.unionByName(runs.join(again, "node").withColumnRenamed("node", "cluster")))
    discard(every)
    first = cut(rooted.groupBy("cluster").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first < final").drop("final"))
    hits = rooted.join(first, "cluster").distinct()
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("k") == F.col("first.k")) & F.col("run") & (F.col("pos") < F.col("first.pos") + min_run)
    hits = hits.select("id", "k", "pos", "start", "end", "n_words", "cluster", ((place > F.col("first")) & ~own).alias("later"), F.col("first.id").alias("first_id"))
    return _passage_rows(hits, min_run).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id and text of every row, without the passages that repeat earlier ones.

    Rows that repeat an id with other texts are documents of their own: each loses its own passages only. Rows that
    repeat id and text are one document, and all come out alike. Null texts stay null. Ids are cast to long.
    """
    slim = take(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    slim = slim.withColumns({"last": F.col("id").isNull(), "k": F.xxhash64("id", F.coalesce("text", F.lit("")))})
    rows = cut(numbered(slim.dropDuplicates(["id", "k"]), "row", "last", "id", "k"))  # numbers stand for (id, text), in the order of ids
    gone = repeated_passages(rows.select(F.col("row").alias("id"), "text"), id_col="id", text_col="text", **options).where("removed")
    gone = gone.groupBy(F.col("id").alias("row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))  # a document's own
    gone = gone.join(rows.select("row", F.col("id").alias("of"), F.col("k").alias("own")), "row").drop("row")
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, g: F.struct(F.concat(acc["text"], piece(acc["at"], g["start"])).alias("text"), F.greatest(acc["at"], g["end"]).alias("at"))
    left = F.aggregate("gone", start, step, lambda acc: F.concat(acc["text"], piece(acc["at"], F.length("text").cast("long"))))
    joined = slim.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("k") == F.col("own")), "left")
    return joined.select(F.col("id").alias(id_col), F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias(text_col))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
