"""Merkle manifests of datasets: leaf coordinates from bitmaps with popcount directories, levels reduced in slot arrays."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stored, take

#: Nodes of a run; levels that one slot array is reduced by.
ARITY, LEVELS = 3, 7
SLOTS = ARITY**LEVELS
#: Words of 64 ids are counted together by these numbers of bits of the id, one directory above the other.
_DIRECTORY = (10, 16, 16, 16)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def record_hash(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields, each as its UTF-8 byte count, a colon and its value, or `-` if null."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def tree_key(group: Column) -> Column:
    """A group's key that is never null and ordered as groups are: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its rows' numbers from 0 in the named order, counted within range partitions and summed over them."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m_", F.monotonically_increasing_id()))
    part = F.shiftright("m_", 33)
    before = ranged.groupBy(part.alias("p_")).agg(F.count("*").alias("n_"))  # a row per partition
    before = before.select("p_", F.coalesce(F.sum("n_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b_"))
    joined = ranged.withColumn("p_", part).join(F.broadcast(before), "p_")
    return joined.withColumn(name, F.col("b_") + F.col("m_").bitwiseAND(F.lit((1 << 33) - 1))).drop("p_", "b_", "m_")


def _before(counts: DataFrame, bits: tuple[int, ...] = _DIRECTORY) -> DataFrame:
    """Rows of the same tree under lesser keys: (tree, key, before). Keys are shifted level by level, so no window holds more than a block's keys."""
    up = F.shiftright("key", bits[0])
    last = len(bits) == 1
    window = Window.partitionBy("tree", *([] if last else ["up"])).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("up", up).select("tree", "key", "up", F.coalesce(F.sum("n").over(window), F.lit(0)).alias("inner"))
    if last:
        return inner.select("tree", "key", F.col("inner").alias("before"))
    blocks = counts.groupBy("tree", up.alias("key")).agg(F.sum("n").alias("n"))
    above = _before(blocks, bits[1:]).withColumnRenamed("key", "up")
    return inner.join(above, ["tree", "up"]).select("tree", "key", (F.col("inner") + F.col("before")).alias("before"))


def _steps(n: Column) -> Column:
    """Reductions until one of n nodes is left."""
    total = F.lit(0)
    for j in range(40):
        total = total + (n > F.lit(ARITY**j)).cast("int")
    return total


def coordinates(leaves: DataFrame) -> DataFrame:
    """leaves (tree, id, digest, ...) with pos (rank in the tree by id; null first, ties by digest) and steps.

    A tree's ids are bitmaps: 64-bit words by id / 64, merged by bitwise or before and after the shuffle. A word's
    directory entry is the count of rows under lesser words; a leaf's rank is that plus the popcount of the bits
    below its own, so nothing is sorted. Only rows of words in which an id occurs more than once (or null ids do)
    are numbered by sorting, in range partitions that split even equal rows.
    """
    null_word = -(1 << 57) - 1  # below the word of every id
    at = F.coalesce(F.shiftright("id", 6), F.lit(null_word))
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    leaves = leaves.withColumns({"key": at, "bit": bit})
    one = F.expr("shiftleft(1L, bit)")
    words = cut(leaves.groupBy("tree", "key").agg(F.bit_or(one).alias("bits"), F.count("*").alias("n")))
    index = words.join(_before(words.select("tree", "key", "n")), ["tree", "key"])
    sizes = words.groupBy("tree").agg(_steps(F.sum("n")).alias("steps"))
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)"))))
    rank = F.when(F.bit_count("bits") == F.col("n"), below)
    placed = cut(leaves.join(index, ["tree", "key"]).join(sizes, "tree").withColumn("rank", rank.cast("long")).drop("bits", "n"))
    ties = placed.where("rank is null")
    if not ties.isEmpty():
        order = ["tree", "key", "bit", "digest", "salt"]
        ties = cut(numbered(ties.withColumn("salt", F.monotonically_increasing_id()), "at", *order))
        first = ties.groupBy("tree", "key").agg(F.min("at").alias("first"))
        ties = ties.join(first, ["tree", "key"]).withColumn("rank", F.col("at") - F.col("first"))
        placed = placed.where("rank is not null").unionByName(ties.select(*placed.columns))
    return placed.withColumn("pos", F.col("before") + F.col("rank")).drop("key", "bit", "before", "rank")


def _levels(digests: list[str], steps: int) -> list[list[str]]:
    """A slot array and what it reduces to, level by level."""
    out = [digests]
    for _ in range(min(steps, LEVELS)):
        row = out[-1]
        out.append([sha256("".join(row[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(row), ARITY)])
    return out


def _slots(table: pa.Table) -> tuple[int, list[str], int, list[int]]:
    """Of a block's nodes: its number, their digests by slot, steps, and each row's slot."""
    pos = table.column("pos").to_pylist()
    block = pos[0] // SLOTS
    at = [p - block * SLOTS for p in pos]
    digests: list[str] = [""] * len(pos)
    for a, d in zip(at, table.column("digest").to_pylist(), strict=True):
        digests[a] = d
    return block, digests, table.column("steps")[0].as_py(), at


def _up(nodes: DataFrame) -> DataFrame:
    """The nodes that blocks of slots reduce to."""

    def reduce(table: pa.Table) -> pa.Table:
        block, digests, steps, _ = _slots(table)
        top = _levels(digests, steps)[-1][0]
        return pa.table({"tree": [table.column("tree")[0].as_py()], "pos": [block], "digest": [top], "steps": pa.array([max(0, steps - LEVELS)], pa.int32())})

    slim = nodes.select("tree", "pos", "digest", "steps", F.expr(f"pos div {SLOTS}").alias("block"))
    return slim.groupBy("tree", "block").applyInArrow(reduce, "tree string, pos long, digest string, steps int")


def _down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes with what stands before and after them in their runs up to the root; paths: the same of the blocks they are in, with further columns."""
    more = [f for f in paths.schema.fields if f.name not in ("tree", "pos", "before", "after")]
    names = [f.name for f in more]

    def extend(table: pa.Table, path: pa.Table) -> pa.Table:
        _, digests, steps, at = _slots(table)
        levels = _levels(digests, steps)
        upper = [path.column(n)[0].as_py() for n in ("before", "after")]
        before, after = [], []
        for a in at:
            low, high = [], []
            for row in levels[:-1]:
                run = a - a % ARITY
                low.append("".join(row[run:a]))
                high.append("".join(row[a + 1 : run + ARITY]))
                a //= ARITY
            before.append(low + upper[0])
            after.append(high + upper[1])
        out = table.drop_columns(["block"])
        for name, column in (("before", before), ("after", after)):
            out = out.append_column(name, pa.array(column, pa.list_(pa.string())))
        for name in names:
            out = out.append_column(name, pa.array([path.column(name)[0].as_py()] * len(at), path.schema.field(name).type))
        return out

    keyed = nodes.withColumn("block", F.expr(f"pos div {SLOTS}"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields] + ["before array<string>", "after array<string>"] + [f"`{f.name}` {f.dataType.simpleString()}" for f in more]
    above = paths.withColumnRenamed("pos", "block")
    return keyed.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(extend, ", ".join(kinds))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes, and what is left of them after each round; the last has a node for each tree."""
    most = nodes.agg(F.max("steps")).first()[0] or 0
    out = [nodes]
    for _ in range(max(1, -(-most // LEVELS))):
        out.append(cut(_up(out[-1])))
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (tree, id, digest and further columns) with pos, subroot, root, before and after.

    before and after hold, for every level from the leaf via its subroot to the root, the siblings on the left and on
    the right, joined: a digest folds to the root by d = H(before || d || after). Trees are ordered by key. A tree of
    one leaf is that leaf's digest. An empty table gives an empty result. Names of further columns must not be those
    made here.

    Every round moves a node once, to the task of its slot array, and leaves one node for 2187; the proofs come down
    the same way, with one path per array. No task holds more than an array, whatever the trees' sizes.
    """
    base = cut(coordinates(leaves))
    rounds = _rounds(base.select("tree", "pos", "digest", "steps"))
    tops = numbered(rounds[-1].select(F.col("tree").alias("name"), "digest"), "pos", "name")
    tops = cut(tops.crossJoin(F.broadcast(tops.agg(_steps(F.count("*")).alias("steps")))).withColumn("tree", F.lit("")))  # one row
    upper = _rounds(tops.select("tree", "pos", "digest", "steps"))
    nothing = F.array().cast("array<string>")
    paths = upper[-1].select("tree", "pos", nothing.alias("before"), nothing.alias("after"), F.col("digest").alias("root"))
    for nodes in [*upper[1:-1][::-1], tops]:
        paths = _down(nodes, paths).drop("steps") if nodes is tops else _down(nodes, paths).drop("steps", "digest")
    paths = cut(paths.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "before", "after", F.col("digest").alias("subroot"), "root"))
    for nodes in rounds[1:-1][::-1]:
        paths = cut(_down(nodes, paths).drop("steps", "digest"))
    return _down(base, paths).drop("steps", "tree")


def proof_hash(before: Column, after: Column) -> Column:
    """H of all siblings from the leaf to the root."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""), 256)


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a"))), leaf, lambda d, s: F.sha2(F.concat(s["b"], d, s["a"]), 256))


def dataset_manifest(docs: DataFrame, changed: Column | None = None, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """manifest() of a table: id, digest, changed, pos, subroot, root, before, after; one row per row.

    A leaf is the record_hash() of the fields; groups are the trees. `changed` is a text, made of the column text_,
    that the leaf is also made with (column changed; the same as digest without it). Ids are cast to long; null ids
    come first, rows that repeat an id are ordered by leaf, equal rows are leaves of their own. Nulls in any field
    are told from empty texts. Other columns do not matter. An empty table gives an empty result.
    """
    names = [*dict.fromkeys([id_col, group_col, text_col, *fields])]
    slim = take(docs, *names).toDF(*(f"f{i}_" for i in range(len(names))))
    place = {n: F.col(f"f{i}_") for i, n in enumerate(names)}
    slim = slim.withColumn("text_", place[text_col])
    other = changed if changed is not None else F.col("text_")
    digest = record_hash(*(place[f] for f in fields))
    altered = record_hash(*(other if f == text_col else place[f] for f in fields))
    leaves = slim.select(tree_key(place[group_col]).alias("tree"), place[id_col].cast("long").alias("id"), digest.alias("digest"), altered.alias("changed"))
    return manifest(stored(leaves)).withColumnRenamed("id", id_col)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = F.crc32(F.col("f0_").cast("string").cast("binary")) % 2
    text = F.when(odd == 0, F.regexp_replace("text_", "\n", "")).otherwise(F.col("text_"))
    made = dataset_manifest(docs, text)
    folded = made.withColumn("folded_root", fold(F.col("changed"), F.col("before"), F.col("after")))
    return folded.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_hash(F.col("before"), F.col("after")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_TOLD = " || ".join(_FIELD.format(f) for f in FIELDS[:-1])
SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) AS c
  FROM documents
), leaves AS (
  SELECT d.doc_id, coalesce('=' || source, '') AS tree, sha256({_TOLD} || {_FIELD.format("text")}) AS leaf,
    sha256({_TOLD} || {_FIELD.format("CASE WHEN (4294967295 - c) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS changed,
    row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM documents d JOIN crc USING (doc_id)
), nodes(part, level, tree, pos, d, n) AS (
  SELECT 0, 0, tree, pos, leaf, n FROM leaves
  UNION ALL
  SELECT 0, level + 1, tree, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 3, n
), subroots AS (
  SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(part, level, tree, pos, d, n) AS (
  SELECT 1, 0, '', pos, subroot, n FROM subroots
  UNION ALL
  SELECT 1, level + 1, tree, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, tree, pos // 3, n
), sides AS (
  SELECT a.part, a.level, a.tree, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM (SELECT * FROM nodes UNION ALL SELECT * FROM tops) a JOIN (SELECT * FROM nodes UNION ALL SELECT * FROM tops) b
    ON a.part = b.part AND a.level = b.level AND a.tree = b.tree AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY ALL
), steps AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, level) AS k, before, after
  FROM (
    SELECT doc_id, part, level, before, after FROM leaves l JOIN sides s ON s.part = 0 AND s.tree = l.tree AND s.pos = l.pos // (3 ** s.level)::BIGINT
    UNION ALL
    SELECT doc_id, part, level, before, after FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN sides s ON s.part = 1 AND s.pos = r.pos // (3 ** s.level)::BIGINT
  )
), folds(doc_id, k, d) AS (
  SELECT doc_id, 0, changed FROM leaves
  UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(before || f.d || after) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k + 1
), folded AS (
  SELECT doc_id, arg_max(d, k) AS folded_root FROM folds GROUP BY doc_id
), proofs AS (
  SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY doc_id
)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots USING (tree) JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id) CROSS JOIN (SELECT d AS root FROM tops WHERE n = 1)
"""
