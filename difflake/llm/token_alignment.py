"""Alignment of two tokenizers' tokens by interval coalescing, and how often their ids are linked over the corpus."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, take, working
from .packing import _Codes, _printable

#: Characters of texts that are aligned at a time; characters of chunks that a worker remembers, some 40 bytes for each.
_SLICE, _REMEMBER = 1_000_000, 5_000_000
#: Chunks of a text that starts with a space: white space and what follows up to the next.
_CHUNKS = re.compile(r"[ \t\n]+[^ \t\n]*")
#: Other white space, which may stand beside a chunk's own in one token, and the sign that B writes for a space.
_WHOLE = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")


class BytePieces:
    """Token ids of byte-level BPE, strings of special tokens taken as plain text, and the bytes of each id."""

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = t = tokenizers.Tokenizer.from_file(path)
        t.encode_special_tokens = True
        back = {c: b for b, c in _printable().items()}
        vocabulary = t.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.by_chunks = t.normalizer is None and type(t.pre_tokenizer).__name__ == "ByteLevel" and t.pre_tokenizer.use_regex and not t.pre_tokenizer.add_prefix_space

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class SentencePieces:
    """Token ids of a sentencepiece model, which puts a space in front of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_chunks = not any("▁" in p.lstrip("▁") or re.search(r"[\t\n]", p) for p in pieces) and m.encode("\n a")[:1] == [m.piece_to_id("▁")]

    def batch(self, texts: list[str]) -> list[list[int]]:
        """Of texts that start with white space; the space that the model puts in front is the first one's, or is taken away."""
        ids = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [x if t[0] == " " else x[1:] for t, x in zip(texts, ids, strict=True)]


class Pair:
    """Two tokenizers, and all pairs of ids that can be linked.

    Linked tokens end together, so the bytes of one are a suffix of the other's. There are thus no more pairs than
    the tokens of both vocabularies have bytes (some 500,000), whatever the corpus: they are numbered once.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = BytePieces(path_a), SentencePieces(path_b)
        self.len_a, self.len_b = (np.fromiter(map(len, x.bytes), np.int64) for x in (self.a, self.b))
        by_a, by_b = {}, {}
        for table, x in ((by_a, self.a), (by_b, self.b)):
            for i, token in enumerate(x.bytes):
                if token:
                    table.setdefault(token, []).append(i)
        pairs = [(i, j) for token, some in by_a.items() for k in range(len(token)) for j in by_b.get(token[k:], ()) for i in some]
        pairs += [(i, j) for token, some in by_b.items() for k in range(1, len(token)) for i in by_a.get(token[k:], ()) for j in some]
        self.keys = np.unique(np.fromiter((i << 32 | j for i, j in pairs), np.int64, len(pairs)))
        va, vb = len(self.a.bytes), len(self.b.bytes)
        self.labels = np.array([f"{i}{s}" for v, signs in ((va, ",|"), (vb, ",;")) for s in signs for i in range(v)], object)
        self.label_a, self.label_b = (0, va), (2 * va, 2 * va + vb)

        self.by_chunks = self.a.by_chunks and self.b.by_chunks
        self.clear()

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a << 32 | b)

    def clear(self) -> None:
        self.code, self.size, self.labels_of, self.uses = _Codes(), 0, [], np.zeros(0, np.int64)
        self.counts, self.links, self.stops = np.empty((0, 5), np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def forget(self) -> None:
        """Forgets the chunks that were not met again, or all if that leaves too many."""
        keep, chunks = np.flatnonzero(self.uses > 1), list(self.code)
        if sum(len(chunks[k]) for k in keep) > _REMEMBER // 2:
            keep = keep[:0]
        counts, labels, links = self.counts[keep], [self.labels_of[k] for k in keep], self.linked(keep)
        self.clear()
        for k in keep:
            self.code[chunks[k]] = len(self.code)
        self._add(counts, labels, links, sum(map(len, self.code)))

    def linked(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the linked pairs of the chunks with these numbers, in order."""
        n = self.counts[at, 3]
        return self.links[np.repeat(self.stops[at] - np.cumsum(n), n) + np.arange(n.sum())]

    def _add(self, counts: np.ndarray, labels: list[str], links: np.ndarray, chars: int) -> None:
        self.counts, self.links = np.concatenate([self.counts, counts]), np.concatenate([self.links, links])
        self.stops, self.uses = np.cumsum(self.counts[:, 3]), np.append(self.uses, np.zeros(len(counts), np.int64))
        self.labels_of += labels
        self.size += chars

    def learn(self) -> None:
        """Aligns the chunks that were met for the first time."""
        self._add(*_aligned(self, self.code.new), sum(map(len, self.code.new)))
        self.code.new.clear()


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """The worker process's pair, with what its encoders have learnt in earlier tasks."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B interval: by start, a group breaks where a start reaches the largest end so far."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(start_a)], group[len(start_a) :]


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B interval that share a byte, as indices; both sides tile the same range."""
    first, stop = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = stop - first
    i = np.repeat(np.arange(len(start_a)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _valid(pair: Pair, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[bool]:
    """Whether the joined bytes of both sides are those of each text."""
    bytes_a, bytes_b = pair.a.bytes, pair.b.bytes
    return [b"".join([bytes_a[i] for i in x]) == r == b"".join([bytes_b[i] for i in y]) for x, y, r in zip(a, b, raw, strict=True)]


def _aligned(pair: Pair, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of each text, which starts with a space or is a chunk: (n_a, n_b, n_groups, n_links, 1 if valid) as a matrix, its groups as text, and the numbers of all linked pairs in order."""
    a, b = pair.a.batch(texts), pair.b.batch(texts)
    valid = _valid(pair, [t.encode() for t in texts], a, b)
    a, b = ([x if v else [] for x, v in zip(side, valid, strict=True)] for side in (a, b))
    stop_a, stop_b = (np.cumsum([0, *map(len, side)]) for side in (a, b))
    a, b = (np.fromiter((i for x in side for i in x), np.int64) for side in (a, b))
    counts = np.zeros((len(texts), 5), np.int64)
    counts[:, 4] = valid
    if not len(a):
        return counts, [""] * len(texts), np.empty(0, np.int32)
    end_a, end_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])  # texts follow each other; their ends are ends on both sides
    start_a, start_b = end_a - pair.len_a[a], end_b - pair.len_b[b]
    group_a, group_b = coalesce(start_a, end_a, start_b, end_b)
    i, j = overlaps(start_a, end_a, start_b, end_b)
    together = end_a[i] == end_b[j]
    i, j = i[together], j[together]
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    for k, x in enumerate((stop_a, stop_b, np.append(0, np.cumsum(last_a))[stop_a], np.searchsorted(i, stop_a))):
        counts[:, k] = np.diff(x)

    size_a, size_b = (np.bincount(g) for g in (group_a, group_b))
    told = np.empty(len(a) + len(b), np.int64)  # A ids of a group, then its B ids
    told[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = a + np.where(last_a, pair.label_a[1], pair.label_a[0])
    told[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = b + np.where(last_b, pair.label_b[1], pair.label_b[0])
    words, stops = pair.labels[told].tolist(), (stop_a + stop_b).tolist()
    labels = ["".join(words[lo:hi]) for lo, hi in zip(stops, stops[1:], strict=False)]
    return counts, labels, pair.number(a[i], b[j]).astype(np.int32)


def _documents(pair: Pair, texts: list[str]) -> list[tuple[int, int, int, int, str, bytes]]:
    """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, numbers of its linked pairs (little-endian 32-bit).

    White space opens a token on both sides unless more of it comes before, so no token reaches from one chunk into
    the next: each distinct chunk is encoded and aligned once. Whole texts are, where that does not hold.
    """
    spaced = [" " + t for t in texts]
    if pair.size > _REMEMBER:
        pair.forget()
    number = pair.code.__getitem__
    codes = [list(map(number, _CHUNKS.findall(t))) if pair.by_chunks and not _WHOLE.search(t) else None for t in spaced]
    if pair.code.new:
        pair.learn()
    used = np.bincount(np.fromiter((k for c in codes if c for k in c), np.int64))
    pair.uses[: len(used)] += used
    out = []
    for text, c in zip(spaced, codes, strict=True):
        if c is not None:
            at = np.array(c)
            counts = pair.counts[at]
            n_a, n_b, groups, n_links = counts[:, :4].sum(0).tolist()
            if counts[:, 4].all():
                links = pair.linked(at)
                told = "".join([pair.labels_of[k] for k in c])
            else:
                c = None
        if c is None:
            counts, (told,), links = _aligned(pair, [text])
            n_a, n_b, groups, n_links, ok = counts[0].tolist()
            if not ok:
                out.append((0, 0, 0, 0, "", b""))
                continue
        out.append((n_a, n_b, groups, n_links, sha256(told[:-1].encode()).hexdigest(), links.astype("<i4").tobytes()))
    return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = chars = 0
    for k, t in enumerate(texts):
        if chars and chars + len(t) > _SLICE:
            yield lo, k
            lo, chars = k, 0
        chars += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256 and the numbers of its linked pairs.

    Both sides encode a space and the text. Token ends that both sides share cut the text into groups; a link is a
    pair of tokens that end together. A text that is null or empty, or that either side does not give back byte by
    byte, has no tokens: zeros and ''. Nothing is shuffled, and about a million characters are aligned at a time (a
    longer text alone). Null ids and repeated rows are documents like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("token_alignment", _PAIRS.clear)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        pair = pair_of(path_a, path_b)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _slices([t or "" for t in texts]):
                full = [k for k in range(lo, hi) if texts[k]]
                rows = [(0, 0, 0, 0, "", b"")] * (hi - lo)
                for k, row in zip(full, _documents(pair, [texts[k] for k in full]), strict=True):
                    rows[k - lo] = row
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *made], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    slim = take(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary").withColumnRenamed("id", id_col)


def link_counts(table: DataFrame) -> DataFrame:
    """How many links hold each pair over the whole table: (pair, n). Tasks count before they shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            some = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"))
            if len(some) > len(total):
                some, total = total, some
            total[: len(some)] += some
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(total[pairs], pa.int64())], ["pair", "n"])

    return table.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """aligned() with n_best (links whose count is the highest of their B id over the corpus, ties included) and count_sum (over links).

    Links are kept as numbers of pairs, four bytes each, so texts are encoded once. The counts of all pairs go to
    every task: their number is bounded by the two vocabularies (see Pair), not by the corpus. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    table = stored(aligned(docs, path_a, path_b, id_col, text_col))
    counted = link_counts(table).toArrow()
    keys = pair_of(path_a, path_b).keys
    count = np.zeros(len(keys), np.int64)
    count[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    most = np.zeros(int((keys & 0xFFFFFFFF).max()) + 1, np.int64)
    np.maximum.at(most, keys & 0xFFFFFFFF, count)
    known = spark.sparkContext.broadcast((count, count == most[keys & 0xFFFFFFFF]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = known.value
        for batch in batches:
            links = batch.column("links").to_pylist()
            stop = np.cumsum([0, *(len(x) // 4 for x in links)])
            numbers = np.frombuffer(b"".join(links), "<i4")
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[numbers], dtype=np.int64)])[stop]) for v in (best, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums[0]), pa.array(sums[1])], [*batch.schema.names[:-1], "n_best", "count_sum"])

    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    schema = f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return table.select(*names).mapInArrow(run, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
