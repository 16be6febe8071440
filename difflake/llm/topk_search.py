"""Exact top-k inner-product search by no-random-access (NRA) aggregation of sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, take

#: Components of a block of candidates, its rows at most; queries of a block, and of a batch that reads the lists together.
BLOCK_COMPONENTS, BLOCK, QUERY_BLOCK, BATCH = 1 << 19, 8192, 8192, 256
#: The lists are read to an eighth; then, by the queries that cannot stop there, to the end.
DEPTHS = (8, 1)
#: Whole numbers up to here are exact in a double.
EXACT = 2.0**53


class Lists:
    """For each dimension the list of (component, row), in rising order of components."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.rows = np.argsort(vectors, axis=0, kind="stable")
        self.components = np.take_along_axis(vectors, self.rows, 0)

    def read(self, start: int, stop: int, high: bool) -> np.ndarray:
        """The entries start to stop of every list, from its high or its low end, as a table of components; 0 where nothing has been read."""
        n, d = self.rows.shape
        part = slice(n - stop, n - start) if high else slice(start, stop)
        out = np.zeros((n, d))
        out[self.rows[part], np.arange(d)] = self.components[part]
        return out


def nra(lists: Lists, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query its number, rows that hold every one of the k highest inner products, ties included, their scores, and the depth it has read to.

    A positive weight reads its list from the high end, a negative one from the low end, all queries of the batch to
    the same depth; rows are known only by what the lists have shown of them. A row that has been seen has the sum of
    its components read, and bounds: one not read lies between the last component read and the far end of its list. A
    row not seen has the sum of the last components read as its upper bound. A query stops when no row outside the k
    with the highest lower bounds, seen or not, can reach them, or few can: their other components are then looked up.
    Components are whole numbers, so sums are exact.
    """
    n = len(lists.rows)
    up, down = np.maximum(queries, 0).T, np.minimum(queries, 0).T
    known, seen_up, seen_down = np.zeros((n, len(queries))), np.zeros(lists.rows.shape), np.zeros(lists.rows.shape)
    reading, depth, at = np.arange(len(queries)), 0, lists.components
    for share in DEPTHS:
        before, depth = depth, max(depth, n // share)
        if depth == before:
            continue
        known += lists.read(before, depth, True) @ up[:, reading] + lists.read(before, depth, False) @ down[:, reading]
        if depth == n:
            kth = np.partition(known, n - k, axis=0)[n - k] if n > k else known.min(0)
            for i, q in enumerate(reading):
                rows = np.flatnonzero(known[:, i] >= kth[i])
                yield int(q), rows, known[rows, i], depth
            return
        cols = np.arange(lists.rows.shape[1])
        seen_up[lists.rows[n - depth : n - before], cols] = 1
        seen_down[lists.rows[before:depth], cols] = 1
        w, v = up[:, reading], down[:, reading]
        high, low = at[n - depth][:, None] * w, at[depth - 1][:, None] * v
        ceiling = known + high.sum(0) - seen_up @ high + low.sum(0) - seen_down @ low
        far_up, far_down = at[0][:, None] * w, at[-1][:, None] * v
        floor = known + far_up.sum(0) - seen_up @ far_up + far_down.sum(0) - seen_down @ far_down
        met = (seen_up + seen_down).any(1)
        floor[~met] = -np.inf
        kth = np.partition(floor, n - k, axis=0)[n - k] if n > k else np.full(len(reading), -np.inf)
        outsiders = (high.sum(0) + low.sum(0) >= kth) & (not met.all())
        alive = met[:, None] & (ceiling >= kth)
        stops = ~outsiders & (alive.sum(0) <= max(8 * k, 64))
        for i in np.flatnonzero(stops):
            rows = np.flatnonzero(alive[:, i])
            yield int(reading[i]), rows, lists.vectors[rows] @ queries[reading[i]], depth
        reading, known = reading[~stops], known[:, ~stops]
        if not len(reading):
            return


def _search_block(queries: tuple, rows: tuple, k: int) -> Iterator[tuple]:
    q_ids, q_vecs = queries
    ids, vecs = rows
    by_id = np.argsort(ids, kind="stable")
    ids, vecs = ids[by_id], vecs[by_id]
    classes, of = np.unique(vecs, axis=0, return_inverse=True)
    of = of.ravel()
    members = np.argsort(of, kind="stable")  # by class, then by id
    starts = np.searchsorted(of[members], np.arange(len(classes) + 1))
    first = ids[members[starts[:-1]]]
    more = k + int(np.unique(ids, return_counts=True)[1].max())  # a query's own rows are not among its k
    lists = Lists(classes)
    for at in range(0, len(q_ids), BATCH):
        for i, alive, scores, _ in nra(lists, q_vecs[at : at + BATCH], more):
            qid = q_ids[at + i]
            top = np.lexsort((first[alive], -scores))[:more]
            own = [(-int(scores[j]), int(ids[m])) for j in top for m in members[starts[alive[j]] : min(starts[alive[j]] + more, starts[alive[j] + 1])]]
            for s, c in sorted(x for x in own if x[1] != qid)[:k]:
                yield int(qid), c, -s


def top_k_search(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query, its k highest integer inner products among all other rows: query_id, rank, <id_col>, score.

    Components become floor(scale * x). Queries are the rows whose id is divisible by query_every; candidates are all
    rows with another id. Blocks of queries meet blocks of rows; each pair of blocks is solved by NRA, and the blocks'
    k best are ranked again. Ties go to the smaller id. Rows with a null id, a null or empty vector, or a null or
    non-finite component take no part; vectors of another length than the query's are padded with zeros. Rows that
    repeat an id are candidates for other queries once for each different vector, and a repeated query row is one
    query for each different vector. Scores must fit 53 bits, else it is an error, however large components are. An id that is no number is an error in
    ANSI mode, else null. An empty table gives an empty result.
    """
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = take(vectors, id_col, vec_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & ok)
    scaled = lambda x: F.greatest(F.lit(-EXACT), F.least(F.lit(EXACT), F.lit(float(scale)) * x.cast("double")))  # noqa: E731 (beyond that it is refused below)
    rows = cut(rows.select("id", F.transform("v", lambda x: F.floor(scaled(x))).alias("v")).distinct())
    queries = rows.where(F.col("id") % query_every == 0)
    n_rows, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if (width or 0) * (most or 0) ** 2 >= 1 << 53:
        raise ValueError("components are too large for exact scores of 53 bits")
    in_block = max(1, min(BLOCK, BLOCK_COMPONENTS // (width or 1)))
    blocks, query_blocks = max(1, -(-n_rows // in_block)), max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(query_blocks)).cast("int")
    cand = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "id", "v", F.lit(False).alias("asks"))
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), query_block.alias("qb"), "id", "v", F.lit(True).alias("asks"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        out = []
        if len(q) and len(c):
            d = max(map(len, pdf["v"]))
            dense = lambda s: np.stack([np.pad(np.asarray(x, np.float64), (0, d - len(x))) for x in s])
            q = q.sort_values("id", kind="stable")
            out = list(_search_block((q["id"].to_numpy(), dense(q["v"])), (c["id"].to_numpy(), dense(c["v"])), k))
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    found = cand.union(asks).groupBy("block", "qb").applyInPandas(solve, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
