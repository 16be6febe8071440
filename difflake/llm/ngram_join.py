"""N-gram Jaccard join by parity sketches: pigeonhole on segments per size band, Hamming bounds, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, discard, lower_word_bytes, shingle_hashes, stored, take, unpack_row, with_row, word_hashes, working

#: Sizes of a band grow by this factor. A segment value of more sets than HOT, and one of no shingles, is left out where the others suffice. Members on a side of a tile, and rows of a bucket of smaller values, in the last step.
GROWTH, HOT, TILE, BUCKET = 1.25, 64, 2048, 8192
#: Longs of the sketches that are compared at once.
LAID_OUT = 1 << 20


@dataclass(frozen=True)
class Band:
    """Pairs whose smaller set has between low and high elements: the other has high / t at most."""

    number: int
    low: int
    high: int
    segments: int
    spare: int  # a linked pair agrees in so many segments at least


@lru_cache(maxsize=4096)
def band(number: int, t: Fraction) -> Band:
    low, high = _edge(number), _edge(number + 1) - 1
    differ = int(high * (1 - t) / t)  # symmetric difference of a linked pair, at most
    spare = 1 + differ // 12 if differ else 1
    return Band(number, low, high, differ + spare, spare)


@lru_cache(maxsize=4096)
def _edge(number: int) -> int:
    edge = 1
    for _ in range(number):
        edge = max(edge + 1, int(edge * GROWTH))
    return edge


def bands_of(n: int, t: Fraction) -> list[Band]:
    """The band of a set's own size, and those below in which it can be the larger one."""
    k = 0
    while _edge(k + 1) <= n:
        k += 1
    out = []
    while k >= 0 and n * t <= band(k, t).high:
        out.append(band(k, t))
        k -= 1
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    return np.unique(shingle_hashes(word_hashes(lower_word_bytes(text)), words))


def segments_of(shingles: np.ndarray, segments: int) -> np.ndarray:
    """Each shingle is XORed into one segment; so the segments in which two sketches differ are at most the shingles in which the sets do."""
    out = np.zeros(segments, np.uint64)
    np.bitwise_xor.at(out, ((shingles >> np.uint64(8)) % np.uint64(segments)).astype(np.int64), shingles)
    return out.view(np.int64)


def sketch(shingles: np.ndarray, high: int) -> np.ndarray:
    """Each shingle flips one bit of two or more for each element of the band's largest set; so the bits in which two sketches differ are at most the shingles in which the sets do."""
    longs = 1 + 2 * high // 64
    at = ((shingles >> np.uint64(20)) % np.uint64(64 * longs)).astype(np.int64)
    bits = (np.bincount(at, minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8")


def _sketched(docs: DataFrame, words: int, t: Fraction) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("ngram_join")
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                s = shingle_set(text, words)
                own = s.view(np.uint64)
                f1 = int(np.bitwise_xor.reduce(own * np.uint64(0x9E3779B97F4A7C15), initial=np.uint64(len(s))).view(np.int64))
                f2 = int(np.add.reduce((own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), initial=np.uint64(0)).view(np.int64)) if len(s) else 0
                out.append((i, len(s), f1, f2, [{"band": b.number, "spare": b.spare, "keys": segments_of(s, b.segments), "bits": sketch(s, b.high)} for b in bands_of(len(s), t)] if len(s) else []))
            yield pd.DataFrame(out, columns=["id", "n", "f1", "f2", "sketches"])

    return docs.mapInPandas(run, "id long, n long, f1 long, f2 long, sketches array<struct<band:int,spare:int,keys:array<long>,bits:array<long>>>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id and the sorted shingle hashes of each text, eight bytes each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("ngram_join")
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "set": [shingle_set(text, words).tobytes() for text in pdf["text"]]})

    return docs.mapInPandas(run, "id long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of t or more."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(t.denominator * both >= t.numerator * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").where(linked("x", "y")).select("a", "b").distinct()


def _leaders(kept: DataFrame, leader) -> DataFrame:
    """Each member of a segment value with its leader: a, b, band, the follower and the number of values that they share."""
    lead = cut(kept.groupBy("key").agg(leader("id").alias("lead")))
    pairs = kept.join(lead, "key").where("lead <> id").groupBy("lead", "id", "band").agg(F.count("*").alias("shared"))
    return cut(pairs.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b"), "band", F.col("id").alias("follower"), "shared"))


def _best(leads: DataFrame) -> DataFrame:
    """Each follower with the one leader that it shares most values with: this connects most copies."""
    best = leads.groupBy("follower").agg(F.max_by(F.struct("a", "b", "band"), F.struct("shared", F.negate("a"), F.negate("b"), "band")).alias("p"))
    return best.select("p.*").distinct()


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs that the labels do not connect yet."""
    x = pairs.join(label.toDF("a", "ra"), "a", "left")
    return x.join(label.toDF("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "band")


def _close(pairs: DataFrame, bits: DataFrame, t: Fraction) -> DataFrame:
    """The pairs whose sketches differ in no more bits than linked sets of their sizes may."""
    far = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    left = pairs.join(bits.select(F.col("id").alias("a"), "band", F.col("bits").alias("x"), F.col("n").alias("nx")), ["a", "band"])
    both = left.join(bits.select(F.col("id").alias("b"), "band", F.col("bits").alias("y"), F.col("n").alias("ny")), ["b", "band"])
    p, q = t.numerator, t.denominator
    return both.where((far * (p + q) <= (F.col("nx") + F.col("ny")) * (q - p)) & (F.least("nx", "ny") * q >= F.greatest("nx", "ny") * p)).select("a", "b").distinct()


def _crossing(kept: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the segment values whose sets are not all of one component yet: key, id, band, root; main (that of the smallest id) and cnt of the value; of all values with that main, how many members and how many at most."""
    rooted = stored(kept.join(label.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    mixed = cut(rooted.groupBy("key").agg(F.min("root").alias("main"), F.max("root").alias("other"), F.count("*").alias("cnt")).where("main < other").select("key", "main", "cnt"))
    mixed = mixed.join(mixed.groupBy("main").agg(F.sum("cnt").alias("rows"), F.max("cnt").alias("most")), "main")
    cross = cut(rooted.join(mixed, "key"))
    discard(rooted)
    return cross


def _within(sk: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, t: Fraction) -> np.ndarray:
    """Which of the pairs (i, j) of rows have sketches and sizes that do not rule out a link. Sketches of long texts are long, so only some pairs are laid out at once."""
    p, q = t.numerator, t.denominator
    far = np.empty(len(i), np.int64)
    some = max(1, LAID_OUT // sk.shape[1])
    for lo in range(0, len(i), some):
        far[lo : lo + some] = np.bitwise_count(sk[i[lo : lo + some]] ^ sk[j[lo : lo + some]]).sum(1, dtype=np.int64)  # of unsigned numbers: of signed ones, bitwise_count takes the absolute value
    return (far * (p + q) <= (n[i] + n[j]) * (q - p)) & (np.minimum(n[i], n[j]) * q >= np.maximum(n[i], n[j]) * p)


def _near(cross: DataFrame, bits: DataFrame, t: Fraction) -> DataFrame:
    """Candidate pairs of different components that share a segment value of few sets, by Hamming distance.

    Values with one main component are dealt to few buckets, of bounded size as a component of many values is cut up
    by value. There each pair is compared once, however many values it shares, and a set's sketch comes once; only
    pairs that the sketches do not rule out are returned.
    """
    buckets = max(1, -(-cross.count() // BUCKET))
    dealt = cross.withColumn("bucket", F.pmod(F.xxhash64("main", F.pmod(F.xxhash64("key"), F.ceil(F.col("rows") / BUCKET))), F.lit(buckets)))
    dealt = cut(dealt.select("bucket", "key", "band", "id", "root", "main"))
    sketches = dealt.select("bucket", "id", "band").distinct().join(bits.select("id", "band", "n", "bits"), ["id", "band"])
    both = dealt.withColumns({"n": F.lit(0).cast("long"), "bits": F.lit(None).cast("array<long>")}).unionByName(sketches.withColumns({c: F.lit(0).cast("long") for c in ("key", "root", "main")}))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        working("ngram_join")
        has = pdf["bits"].notna()
        own, out = pdf[has], []
        for number, part in pdf[~has].groupby("band", sort=False):
            mine = own[own["band"] == number].sort_values("id")
            ids, n, sk = mine["id"].to_numpy(), mine["n"].to_numpy(), np.stack(mine["bits"].to_numpy()).view(np.uint64)
            part = part[["key", "id", "root", "main"]].merge(pd.DataFrame({"id": ids, "at": np.arange(len(ids))}), on="id").sort_values("key")  # an id may have several sets
            at, root, outside = part["at"].to_numpy(), part["root"].to_numpy(), (part["root"] != part["main"]).to_numpy()
            edges = np.flatnonzero(np.diff(part["key"].to_numpy()) != 0) + 1
            codes = []
            for lo, hi in zip([0, *edges], [*edges, len(part)], strict=True):
                x, y = np.triu_indices(hi - lo, 1)
                x, y = x + lo, y + lo
                ok = (root[x] != root[y]) & (outside[x] | outside[y])
                i, j = at[x[ok]], at[y[ok]]
                codes.append(np.minimum(i, j) * len(ids) + np.maximum(i, j))
            code = np.unique(np.concatenate(codes))
            i, j = code // len(ids), code % len(ids)
            ok = _within(sk, n, i, j, t)
            out.append(pd.DataFrame({"a": ids[i[ok]], "b": ids[j[ok]]}))
        return pd.concat(out).astype("int64") if out else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return both.groupBy("bucket").applyInPandas(solve, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tiles(cross: DataFrame, bits: DataFrame, t: Fraction) -> DataFrame:
    """Candidate pairs of different components that share a segment value, by Hamming distance.

    Members outside a value's main component meet all its members. Both are dealt to tiles of bounded size, by their
    own hashes, so a hot value is many tasks' work. Values with one main component share tiles, some at a time: there
    a sketch comes once and a pair is compared once, and only pairs that the sketches do not rule out are returned.
    """
    side = F.ceil(F.col("most") / TILE).cast("int")
    salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("rows") / (8 * TILE))).alias("salt")
    every = F.sequence(F.lit(0), side - 1)
    own = F.pmod(F.xxhash64("id"), side).cast("int")
    asks = cross.where("root <> main").select("main", salt, own.alias("r"), F.explode(every).alias("c"), "key", "band", "id", "root", F.lit(True).alias("asks"))
    has = cross.select("main", salt, F.explode(every).alias("r"), own.alias("c"), "key", "band", "id", "root", F.lit(False).alias("asks"))
    dealt = cut(asks.unionByName(has))
    place = ["main", "salt", "r", "c"]
    sketches = dealt.select(*place, "id", "band").distinct().join(bits.select("id", "band", "n", "bits"), ["band", "id"])
    both = dealt.withColumns({"n": F.lit(0).cast("long"), "bits": F.lit(None).cast("array<long>")}).unionByName(sketches.withColumns({"key": F.lit(0).cast("long"), "root": F.lit(0).cast("long"), "asks": F.lit(False)}))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        working("ngram_join")
        has = pdf["bits"].notna()
        out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
        for number, part in pdf[~has].groupby("band", sort=False):
            mine = pdf[has & (pdf["band"] == number)].sort_values("id")
            ids, n, sk = mine["id"].to_numpy(), mine["n"].to_numpy(), np.stack(mine["bits"].to_numpy()).view(np.uint64)
            part = part[["key", "id", "root", "asks"]].merge(pd.DataFrame({"id": ids, "at": np.arange(len(ids))}), on="id")  # an id may have several sets
            at, root = part["at"].to_numpy(), np.zeros(len(ids), np.int64)
            root[at] = part["root"].to_numpy()
            asked = part["asks"].to_numpy(bool)
            outs = np.unique(at[asked])
            keys = [(np.searchsorted(outs, at[i][asked[i]]), at[i][~asked[i]]) for i in part.groupby("key", sort=False).indices.values()]
            for lo in range(0, len(outs), 256):
                some = outs[lo : lo + 256]
                meet = np.zeros((len(some), len(ids)), bool)
                for x, y in keys:
                    meet[np.ix_(x[(x >= lo) & (x < lo + 256)] - lo, y)] = True
                i, j = np.nonzero(meet & (root[some][:, None] != root[None, :]))
                i = some[i]
                ok = _within(sk, n, i, j, t)
                out.append(pd.DataFrame({"a": np.minimum(ids[i[ok]], ids[j[ok]]), "b": np.maximum(ids[i[ok]], ids[j[ok]])}))
        return pd.concat(out).astype("int64").drop_duplicates()

    return both.groupBy(*place).applyInPandas(solve, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = 3, threshold: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, the smallest id that it reaches over links.

    Two documents link when the Jaccard similarity of their sets of distinct word shingles (A-Z lower-cased, 64-bit
    hashes) is threshold or more. Equal sets are one node. The symmetric difference of linked sets is bounded by
    their size, so in a band of sizes with one segment more than that bound, linked sets agree in a whole segment of
    their parity sketches: sets are joined on (band, segment, XOR of the segment's hashes), filtered by the Hamming
    distance of a sketch of one bit a shingle and verified on the sets. With some spare segments, values of more than
    64 sets and those of segments without a shingle are left out for sets that must agree elsewhere too; nothing is
    lost. Of the sets with one value, each is first compared with the smallest id, the leader, then with the largest;
    where more than one component is left, what is outside the main one meets all: each pair once in buckets for
    values of at most 64 sets, else in tiles. The leaders that share most values with a set come first; other pairs
    are compared only where their components still differ. So connected copies are not expanded into pairs.
    A null, empty or blank text has no shingles and is linked with nothing; one of fewer words is one shingle. A row
    without an id has component_id null and links nothing. Rows that repeat an id are one node with the links of all
    their texts. An empty table gives an empty result; other columns do not matter.
    """
    t = threshold
    slim = take(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = stored(_sketched(slim, words, t))
    info = cut(sketched.select("id", "n", "f1", "f2"))
    nodes = cut(info.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("node")))
    own = sketched.join(nodes.select("f1", "f2", "n", F.col("node").alias("id")), ["id", "f1", "f2", "n"], "left_semi").dropDuplicates(["id", "f1", "f2", "n"])
    bits = stored(own.select("id", "n", F.inline("sketches")))  # two narrow arrays; joins read the one that they need
    discard(sketched)
    value = bits.select("id", "band", "spare", F.posexplode("keys").alias("i", "v")).select(F.xxhash64("band", "i", "v").alias("key"), "id", "band", "spare", (F.col("v") == 0).alias("blank"))
    shared = stored(value.groupBy("key").count().where("count > 1"))
    members = stored(value.join(shared, "key"))
    often = F.col("blank") | (F.col("count") > HOT)
    hot = members.where(often)
    unsafe = cut(hot.groupBy("id", "band").agg(F.count("*").alias("left_out"), F.max("spare").alias("spare")).where("left_out >= spare").select("id", "band"))
    kept = members.where(~often).select("key", "id", "band").union(hot.join(unsafe, ["id", "band"], "left_semi").select("key", "id", "band"))
    kept = stored(kept)
    discard(shared, members)
    ids = kept.select("id").distinct()
    sets = stored(_sets(slim.join(ids, "id", "left_semi"), words))
    leads = _leaders(kept, F.min)
    tried = cut(_close(_best(leads), bits, t))
    links = cut(_verified(tried, sets, t))
    label = components(links)
    apart = _apart(leads.select("a", "b", "band").distinct(), label)
    close = cut(_close(apart, bits, t))
    if not close.isEmpty():
        tried = cut(tried.union(close))
        links = cut(links.union(_verified(close, sets, t)).distinct())
        label = components(links)
    cross = _crossing(kept, label)
    if not cross.isEmpty():
        more = _leaders(cross.where("root <> main").select("key", "id", "band"), F.max).select("a", "b", "band").distinct()
        close = cut(_close(more, bits, t))
        tried = cut(tried.union(close))
        links = cut(links.union(_verified(close, sets, t)).distinct())
        label = components(links)
        cross = _crossing(kept, label)
    if not cross.isEmpty():
        few, many = cross.where(F.col("cnt") <= HOT), cross.where(F.col("cnt") > HOT)
        found = _near(few, bits, t) if many.isEmpty() else _near(few, bits, t).union(_tiles(many, bits, t))
        found = cut(found.distinct().join(tried.distinct(), ["a", "b"], "left_anti"))
        links = cut(links.union(_verified(found, sets, t)).distinct())
        label = components(links)
    discard(kept, sets, bits)
    rooted = nodes.join(label, "node", "left").select("f1", "f2", "n", F.coalesce("root", "node").alias("component"))
    rooted = cut(rooted)
    every = info.where("id is not null").select("id", "n", "f1", "f2").join(rooted, ["f1", "f2", "n"], "left")
    out = every.select("id", "n", F.coalesce("component", "id").alias("component")).union(info.where("id is null").select("id", "n", F.lit(None).cast("long")))
    return out.toDF(id_col, "n_shingles", "component_id")


def keep_first(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which no linked document has a smaller id, so one of each component; the same columns.

    Rows without an id stay; rows that repeat the staying id all stay.
    """
    found = jaccard_components(docs, words, threshold, id_col, text_col)
    gone = cut(found.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("id_")).distinct())
    return unpack_row(with_row(docs, id_=id_col).join(gone, "id_", "left_anti"), docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM words),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.r = edge.a)
SELECT d.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(r) AS component_id FROM documents d JOIN reach USING (doc_id) LEFT JOIN size USING (doc_id) GROUP BY d.doc_id
"""
