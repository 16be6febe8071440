"""Packing token pieces into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import take, working

#: Tokens of a window; tokens of a piece of what is left of a document after its whole windows; pieces packed at a time.
WINDOW, GRAIN, CHUNK = 1024, 256, 8192
#: Characters of texts that are encoded at a time.
_SLICE = 2_000_000
#: Classes of bytes; the odd ones are no part of plain characters (tab, line ends, printable ASCII, U+00C0 to U+024F). Texts with other characters are left to the tokenizer itself.
_SPACE, _WHITE, _LETTER, _DIGIT, _SIGN, _ODD = range(6)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[[*b"\t\n\r"]] = _WHITE
_CLASS[0x20] = _SPACE
_CLASS[[*b"0123456789"]] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:0xC0] = _CLASS[0xC3:0xCA] = _LETTER
_ID = attrgetter("id")
#: Pieces that a worker remembers: some 200 bytes each, which it keeps between stages.
_CACHE = 400_000


def _printable() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character, of valid UTF-8."""
    kind = _CLASS[data]
    wide = np.flatnonzero(data >= 0xC0)
    lead, second = data[wide], data[wide + 1]
    signs = wide[(lead == 0xC3) & ((second == 0x97) | (second == 0xB7))]  # the signs of multiplication and division
    kind[signs] = kind[signs + 1] = _SIGN
    kind[wide[(lead == 0xC9) & (second >= 0x90)]] = _ODD
    return kind


def _starts(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE start in plain texts that each end with a zero byte; that is a piece of its own.

    As this pattern cuts: '(s|d|m|t|ll|ve|re), ` ?letters`, ` ?digits`, ` ?signs`, white space but for its last
    character if more follows, white space.
    """
    white, ends = kind <= _WHITE, kind == _ODD
    start = np.ones(len(data), bool)
    start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & ~(white[1:] & white[:-1]) | ends[1:]
    start[:-1] |= white[:-1] & ~(white[1:] | ends[1:])
    at = np.flatnonzero(data == 0x27)
    at = at[start[at]]
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    short, long = np.isin(one, [*b"sdmt"]), (one == 0x6C) & (two == 0x6C) | np.isin(one, [*b"vr"]) & (two == 0x65)
    start[at[short | long] + 1] = False
    start[at[short] + 2] = start[at[long] + 3] = True
    return start


class _Codes(dict):
    """Numbers for pieces; new ones are noted."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list = []

    def __missing__(self, piece) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


def slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of so many characters at most, or of one text."""
    lo = n = 0
    for k, t in enumerate(texts):
        if n and n + len(t) > chars:
            yield lo, k
            lo, n = k, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Encoder:
    """Token ids of whole texts.

    A byte-level BPE tokenizer that changes no text beforehand works on pieces of text one by one, so each piece is
    encoded once, and the different ones of some texts are looked up later. Texts that hold a token added to the vocabulary, and all texts of any other
    kind of tokenizer, are left to the tokenizer.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        self.by_pieces = told.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        self.marks = [t["content"] for t in told.get("added_tokens") or []]
        self.alphabet = _printable()
        self._clear()

    def _clear(self) -> None:
        self.code = _Codes({b"\0": 0})  # ends a text, and is no token
        self.flat = np.empty(0, np.uint32)
        self.ends, self.count, self.uses = np.zeros((3, 1), np.int64)

    def _forget(self) -> None:
        """Forgets the pieces that were not met again, or all if that leaves too many."""
        keep = np.flatnonzero(self.uses[1:] > 1) + 1
        if len(keep) > _CACHE // 2:
            keep = keep[:0]
        pieces, flat, count = list(self.code), self._ids(keep), self.count[keep]
        self._clear()
        self.code.update((pieces[k], n) for n, k in enumerate(keep.tolist(), 1))
        self._add(flat, count)

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        n = self.count[numbers]
        return self.flat[np.repeat(self.ends[numbers] - np.cumsum(n), n) + np.arange(n.sum())]

    def _add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, len(self.flat) + np.cumsum(count)])
        self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
        self.uses = np.concatenate([self.uses, np.zeros_like(count)])

    def _learn(self) -> None:
        bpe, alphabet = self.tokenizer.model, self.alphabet
        ids, count = array("I"), np.empty(len(self.code.new), np.int64)
        for k, p in enumerate(self.code.new):
            tokens = bpe.tokenize(p.decode("latin-1").translate(alphabet))
            ids.extend(map(_ID, tokens))
            count[k] = len(tokens)
        self.code.new.clear()
        self._add(np.asarray(ids, np.uint32), count)

    def _by_pieces(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each text; None for those with characters that are not plain."""
        if not texts:
            return []
        data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
        kind = _classes(data)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        odd = np.flatnonzero(kind == _ODD)
        if len(odd) > len(texts):
            left = set(np.searchsorted(ends, np.setdiff1d(odd, ends, assume_unique=True)).tolist())
            plain = iter(self._by_pieces([t for i, t in enumerate(texts) if i not in left]))
            return [None if i in left else next(plain) for i in range(len(texts))]
        at = np.flatnonzero(_starts(data, kind))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        _, stops, flat = pieces.dictionary.buffers()
        flat, stops = flat.to_pybytes(), np.frombuffer(stops, np.int64, len(pieces.dictionary) + 1).tolist()
        number = np.fromiter((self.code[flat[i:j]] for i, j in pairwise(stops)), np.int64, len(stops) - 1)
        if self.code.new:
            self._learn()
        self.uses[number] += 1
        c = number[pieces.indices.to_numpy()]
        return np.split(self._ids(c), np.cumsum(self.count[c])[np.searchsorted(at, ends)])[:-1]

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers."""
        if len(self.code) > _CACHE:
            self._forget()
        whole = [not self.by_pieces or any(m in t for m in self.marks) for t in texts]
        plain = iter(self._by_pieces([t.encode() for t, w in zip(texts, whole, strict=True) if not w]))
        for text, w in zip(texts, whole, strict=True):
            ids = None if w else next(plain)
            yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32) if ids is None else ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder, with what it has learnt in earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _difference(sizes: list[int], m: int) -> list[list[int]]:
    """Karmarkar-Karp over m parts: the two partial partitions with the largest spread are laid against each other, large sums on small ones, until one is left.

    A partial partition is the rising list of its (sum, serial, items); parts that it has no items for are empty.
    """
    serial = iter(range(1 << 60))
    heap = [(-s, i, [(s, next(serial), [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    spread = lambda p: p[-1][0] - (p[0][0] if len(p) == m else 0)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, tie, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        both = len(a) + len(b) - m  # so many parts of b meet one of a; the others take empty parts
        low, fresh = a[: max(0, both)], b[: min(len(b), len(b) - both)] if both > 0 else b
        high = b[len(fresh) :]
        a = a[max(0, both) :]
        met = [(x + y, next(serial), i + j) for (x, _, i), (y, _, j) in zip(low, reversed(high), strict=True)]
        for part in (*met, *fresh):
            insort(a, part)
        heapq.heappush(heap, (-spread(a), tie, a))
    return [items for _, _, items in heap[0][2]] if heap else []


def partition(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Items by window. The number of windows starts at the least possible and rises while one holds more than its capacity: by what the fullest is above the mean, within 0.2 and 1 %."""
    total = sum(sizes)
    m = max(1, -(-total // capacity))
    while True:
        windows = _difference(sizes, m)
        most = max((sum(sizes[i] for i in w) for w in windows), default=0)
        if most <= capacity:
            return windows
        m += max(1, m // 500, min(m // 100, int(total / max(1, capacity - most + total / m)) + 1 - m))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, grain: int = GRAIN, chunk: int = CHUNK, end_id: int = 0) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its token ids and end_id. Whole windows are cut off first and are sequences of their own; what is
    left is cut into pieces of at most grain tokens. Pieces of one input partition are packed by differencing, some
    thousand at a time, so memory is bounded and nothing is shuffled; sequence ids hold the partition's number.
    A null text is empty and has end_id alone. An id that is no number is an error in ANSI mode, else null. Null ids and repeated rows are documents like others. An empty table
    gives an empty result. The same partitions give the same sequences, so lost tasks can be run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("packing", _ENCODERS.clear)
        encode, part = encoder(tokenizer_path).batch, TaskContext.get().partitionId()
        sequence, rows, kept = part << 40, [], []
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names)
            rows.clear()
            return out

        def close() -> None:
            nonlocal sequence
            for w in partition([k[2] for k in kept], window):
                at = 0
                for i in sorted(w):
                    d, start, n, ids, total = kept[i]
                    rows.append((d, start, n, ids, total, sequence, at))
                    at += n
                sequence += 1
            kept.clear()

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in slices(texts, _SLICE):
                for d, tokens in zip(ids[lo:hi], encode(texts[lo:hi]), strict=True):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    total = len(tokens)
                    full = total - total % window
                    for start in range(0, full, window):
                        rows.append((d, start, window, tokens[start : start + window].tobytes(), total, sequence, 0))
                        sequence += 1
                    for start in range(full, total, grain):
                        x = tokens[start : start + grain]
                        kept.append((d, start, len(x), x.tobytes(), total))
                    if len(kept) >= chunk:
                        close()
                    if len(rows) >= 4096:
                        yield emit()
        if kept:
            close()
        yield emit()

    slim = take(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = slim.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed_digest(docs: DataFrame) -> DataFrame:
    return pack(docs, default_tokenizer()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
