"""Secret scans: base patterns, and a linear-chain conditional random field over tokens, decoded by Viterbi."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, cut, first_by_hash, take, working

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
#: Documents that the field is fitted on at most, windows of tokens that it is fitted on at most, and tokens on each side of a window's middle.
SAMPLE, WINDOWS, AROUND = 1200, 6000, 12
#: Characters of a span that the field adds, at least.
ADDED = 8
O, B, I = 0, 1, 2  # noqa: E741
_KEYWORD = re.compile(r"pass(?:word|wd)|secret|token|api_?key|credential|bearer|private_?key|auth", re.I | re.A)
_CORE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.=-]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and kind. A maximal hex run holds one of 24 or none."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


_CLASS = str.maketrans({c: k for some, k in (("0123456789", "d"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "u"), ("abcdefghijklmnopqrstuvwxyz", "l")) for c in some})
_DIGITS, _HEXA = re.compile("d+"), re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")


def token_type(token: str) -> tuple[int, ...]:
    """Shape of a token: character classes, length, digits, changes between digits and others, variety, hex (2: in groups), key word, closing sign, mixture; changes of case, dots, other separators, and whether it opens as a path or an address."""
    core = max(_CORE.findall(token), key=len, default="")
    kinds, n = core.translate(_CLASS), len(core)
    digits, upper, lower = kinds.count("d"), kinds.count("u"), kinds.count("l")
    size = sum(n >= x for x in (4, 8, 12, 16, 24, 32))
    classes = (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0)
    switches = 2 * len(_DIGITS.findall(kinds)) - (kinds[:1] == "d") - (kinds[-1:] == "d") if digits else 0
    letters = len(set(core))
    key = 1 if _KEYWORD.search(token) else 2 if core.startswith("AKIA") else 0
    cases = kinds.count("ul") + kinds.count("lu") if upper and lower else 0
    slash, joints = "/" in core, core.count("-") + core.count("_")
    hexa = 0 if not digits else 1 if _HEXA.match(core) else 2 if joints > 1 and _HEXA.match(core.replace("-", "")) else 0
    return (
        classes, size, min(3, digits // 3), min(3, switches // 2), (letters >= 6) + (letters >= 10) + (letters >= 14), hexa, key,
        int(token[-1:] in "=:") + 2 * int(not core), 2 * int(upper > 1 and digits > 1) + int(token != core),
        min(3, cases // 3), min(3, core.count(".")), 3 if slash else min(2, joints), int("://" in token or token[:1] in "/~\\" or token[:4] == "www."),
    )


#: Values of each part of a token's type, and where its features begin.
_CARD = (8, 7, 4, 4, 4, 3, 3, 4, 4, 4, 4, 4, 2)
_AT = np.concatenate([[0], np.cumsum(_CARD)])
N_TYPE = int(_AT[-1]) + 8 * 7 * 4 + 7 * 4 * 4 * 4  # and classes x size x digits together, and size x switches x cases x separators
N_FILE = 6


def type_features(t: tuple[int, ...]) -> np.ndarray:
    joint = (t[0] * 7 + t[1]) * 4 + t[2]
    other = ((t[1] * 4 + t[3]) * 4 + t[9]) * 4 + t[11]
    return np.append(_AT[:-1] + np.array(t), [_AT[-1] + joint, _AT[-1] + 8 * 7 * 4 + other])


#: Features of a token's type.
WIDTH = len(_CARD) + 2


def file_features(n_tokens: int, n_key: int, n_digit: int) -> np.ndarray:
    """Length of the file, key words in it, share of tokens with digits."""
    return np.array([0 if n_tokens < 100 else 1, 2 if n_key == 0 else 3, 4 if n_digit * 10 < n_tokens else 5])


class Field:
    """Weights: of a token's own type, of the types one and two to the left and one to the right, of the file, and between tags."""

    def __init__(self):
        self.unit = np.zeros((4, N_TYPE, 3))
        self.file = np.zeros((N_FILE, 3))
        self.step = np.zeros((3, 3))

    def emissions(self, feats: np.ndarray, file: np.ndarray) -> np.ndarray:
        """feats: features of each token's type, in order."""
        own, left, left2, right = (self.unit[k][feats].sum(1) for k in range(4))
        e = own + self.file[file].sum(0)
        e[1:] += left[:-1]
        e[2:] += left2[:-2]
        e[:-1] += right[1:]
        return e


def _log_z(e: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tags and of neighbouring pairs, for many sequences of one length at once; and log Z."""
    n, length, _ = e.shape
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    fwd[:, 0] = e[:, 0]
    for t in range(1, length):
        fwd[:, t] = lse(fwd[:, t - 1, :, None] + step[None], 1) + e[:, t]
    for t in range(length - 2, -1, -1):
        bwd[:, t] = lse(step[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
    z = lse(fwd[:, -1], 1)
    tag = np.exp(fwd + bwd - z[:, None, None])
    pair = np.exp(fwd[:, :-1, :, None] + step + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
    return tag, pair, z


def fit_field(feats: np.ndarray, files: np.ndarray, tags: np.ndarray, rounds: int = 90, rate: float = 0.2, decay: float = 3e-5, least: float = 1e-4) -> Field:
    """Conditional likelihood by Adam, until ten rounds lower the mean loss by less than least. feats: sequences x tokens x features, files: sequences x features, tags: sequences x tokens."""
    field = Field()
    if not len(feats):
        field.file[:, O] = 4
        return field
    n, length, width = feats.shape
    par = [field.unit, field.file, field.step]
    mom, var = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    gold = np.eye(3)[tags]
    gold_pair = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    losses: list[float] = []

    table, types = np.unique(feats.reshape(-1, width), axis=0, return_inverse=True)  # few types make up all tokens
    types = types.reshape(n, length)

    def back(delta: np.ndarray, some: np.ndarray) -> np.ndarray:
        by_type = np.stack([np.bincount(some.ravel(), delta[..., s].ravel(), len(table)) for s in range(3)], 1)
        g = np.zeros((N_TYPE, 3))
        np.add.at(g, table.ravel(), np.repeat(by_type, width, 0))
        return g

    for t in range(1, rounds + 1):
        parts = [field.unit[k][table].sum(1)[types] for k in range(4)]
        e = parts[0] + field.file[files].sum(1)[:, None]
        e[:, 1:] += parts[1][:, :-1]
        e[:, 2:] += parts[2][:, :-2]
        e[:, :-1] += parts[3][:, 1:]
        tag, pair, z = _log_z(e, field.step)
        losses.append(float(z.mean() - ((e * gold).sum() + (field.step * gold_pair).sum()) / n))
        if t > 30 and min(losses[:-10]) - min(losses[-10:]) < least:
            break
        delta = (tag - gold) / n
        unit = np.stack([back(delta, types), back(delta[:, 1:], types[:, :-1]), back(delta[:, 2:], types[:, :-2]), back(delta[:, :-1], types[:, 1:])])
        file = np.zeros_like(field.file)
        for k in range(files.shape[1]):
            np.add.at(file, files[:, k], delta.sum(1))
        grads = [unit, file, (pair.sum((0, 1)) - gold_pair) / n]
        for p, g, m, v in zip(par, grads, mom, var, strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * 0.98**t * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return field


def viterbi(e: np.ndarray, step: np.ndarray) -> list[int]:
    best, back = e[0], []
    for row in e[1:]:
        way = best[:, None] + step
        back.append(way.argmax(0))
        best = way.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def decode(e: np.ndarray, step: np.ndarray) -> dict[int, int]:
    """The best path's tags other than outside, by position.

    Where outside leads by more than any change of neighbours can make up, every best path is outside; only the
    stretches between such tokens are searched, each with an outside tag on either side.
    """
    swing = (step[:, 1:, None] + step[None, 1:, :] - step[:, :1, None] - step[None, :1, :]).max()
    open_ = np.flatnonzero(e[:, O] - e[:, 1:].max(1) <= max(0.0, swing, (step[1:, :] - step[:1, :]).max(), (step[:, 1:] - step[:, :1]).max()))
    tags: dict[int, int] = {}
    if not len(open_):
        return tags
    for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
        lo, hi = int(run[0]), int(run[-1]) + 1
        part = e[lo:hi].copy()
        if lo:
            part[0] += step[O]
        if hi < len(e):
            part[-1] += step[:, O]
        tags |= {lo + i: s for i, s in enumerate(viterbi(part, step)) if s != O}
    return tags


def _tags(values: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tags of the base matches' values: the first token of a value begins, later ones are inside."""
    tags = np.zeros(len(starts), np.int64)
    for lo, hi in values:
        i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi)
        tags[i:j] = I
        tags[i : min(i + 1, j)] = B
    return tags


class Typer:
    """Types of tokens, remembered by token."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.number: dict[tuple[int, ...], int] = {}
        self.feats: list[np.ndarray] = []
        self.key: list[bool] = []
        self.digit: list[bool] = []
        self.table = np.empty((0, WIDTH), np.int64)

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.of) > 700_000:
            self.of.clear()
        out = np.fromiter(map(self.of.get, tokens, repeat(-1)), np.int64, len(tokens))
        for i in np.flatnonzero(out < 0).tolist():
            t = tokens[i]
            if t not in self.of:
                kind = token_type(t.decode("utf-8", "surrogatepass"))
                if kind not in self.number:
                    self.number[kind] = len(self.feats)
                    self.feats.append(type_features(kind))
                    self.key.append(kind[6] > 0)
                    self.digit.append(kind[0] & 1 > 0)
                self.of[t] = self.number[kind]
            out[i] = self.of[t]
        if len(self.table) != len(self.feats):
            self.table = np.stack(self.feats)
        return out

    def file(self, types: np.ndarray) -> np.ndarray:
        return file_features(len(types), int(np.array(self.key)[types].sum()), int(np.array(self.digit)[types].sum()))


#: The worker process's types, with the tokens that it has met in earlier tasks.
_TYPER = Typer()


def worker_typer() -> Typer:
    """The one of this process: a task's function is sent with its variables, but looks functions up by name."""
    return _TYPER


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class Draws:
    """Values to train on, drawn anew for each text by a hash of it: secrets of many shapes, and what only looks like them."""

    def __init__(self, text: str):
        self.rng = np.random.default_rng(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))

    def some(self, letters: str, low: int, high: int) -> str:
        return "".join(letters[i] for i in self.rng.integers(0, len(letters), int(self.rng.integers(low, high + 1))))

    def around(self, value: str) -> bytes:
        """The value as a token: bare as a rule, else with signs around it."""
        k = int(self.rng.integers(0, 12))
        a, b = (('"', '"'), ("'", "',"), ("", ","), ("", "."), ("(", ")"), ("`", "`"))[k] if k < 6 else ("", "")
        return f"{a}{value}{b}".encode()

    def secret(self) -> bytes:
        """Letters and digits of 16 to 64 in one case or both, base64, a prefix and a key, three parts with dots."""
        k = int(self.rng.integers(0, 6))
        if k == 0:
            v = self.some(_ALNUM[26:] if self.rng.random() < 0.6 else _ALNUM[:26] + _ALNUM[52:], 16, 48)
        elif k < 3:
            v = self.some(_ALNUM, 16, 64)
        elif k == 3:
            v = base64.b64encode(self.rng.bytes(int(self.rng.choice([16, 24, 32, 48, 64])))).decode()
        elif k == 4:
            v = self.some(_ALNUM[26:52], 2, 4) + str(self.rng.choice(["-", "_", "."])) + self.some(_ALNUM, 22, 44)
        else:
            v = ".".join((self.some(_ALNUM, 12, 30), self.some(_ALNUM + "-_", 20, 70), self.some(_ALNUM + "-_", 16, 44)))
        return self.around(v)

    def look_alike(self) -> bytes:
        """Addresses, paths, UUIDs, numbers with dashes, versions, times, mail addresses, names in code, file names, long words."""
        r, low = self.rng, _ALNUM[26:52]
        word = lambda a=3, b=10: self.some(low, a, b)
        number = lambda a=1, b=5: self.some("0123456789", a, b)
        hexa = lambda n: self.some("0123456789abcdef", n, n)
        title = lambda: word().capitalize()
        k = int(r.integers(0, 17))
        v = (
            lambda: f"https://{word()}.{word(2, 3)}/" + "/".join(word() for _ in range(int(r.integers(1, 5)))),
            lambda: f"http://www.{word()}.com/{word()}/{number(2, 8)}/{title()}_{title()}?id={number(3, 7)}&{word(2, 4)}={word()}",
            lambda: "/" + "/".join(word() for _ in range(int(r.integers(2, 6)))) + f"/{word()}{number(1, 3)}.{word(2, 4)}",
            lambda: "/".join(word() for _ in range(int(r.integers(2, 5)))) + f"/{title()}{title()}{number(0, 2)}.py",
            lambda: "-".join(hexa(n) for n in (8, 4, 4, 4, 12)),
            lambda: "-".join(hexa(n) for n in (8, 4, 4, 4, 12)).upper(),
            lambda: "-".join(number(2, 5) for _ in range(int(r.integers(3, 6)))),
            lambda: f"{word()}-{number(1, 2)}.{number(1, 2)}.{number(1, 3)}-{word(2, 5)}{number(1, 2)}.tar.gz",
            lambda: f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}T{number(2, 2)}:{number(2, 2)}:{number(2, 2)}.{number(3, 6)}Z",
            lambda: f"{word()}.{word()}{number(0, 3)}@{word()}.{word(2, 3)}",
            lambda: word(2, 7) + "".join(title() for _ in range(int(r.integers(1, 5)))) + number(0, 2),
            lambda: "_".join(word() for _ in range(int(r.integers(3, 6)))) + str(r.choice(["", "_1", "_v2"])),
            lambda: "-".join(hexa(n) for n in (8, 4, 4, 4, 12)),
            lambda: "-".join(hexa(n) for n in (8, 4, 4, 4, 12)),
            lambda: f"{word()}{r.choice(['_', '-'])}{word()}-{number(1, 2)}.{number(1, 2)}.{number(1, 2)}-{word(2, 3)}{number(1, 2)}-{word(3, 6)}-{word(2, 4)}.{word(3, 3)}",
            lambda: f"{word()}-{number(1, 2)}.{number(1, 2)}.{number(1, 2)}.{word(2, 3)}",
            lambda: self.some(low, 12, 40) if r.random() < 0.5 else f"{title()}-{word(6, 14)}-{word(4, 12)}",
        )[k]()
        return self.around(v)


def training_windows(text: str, typer: Typer) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """Whether it holds a secret, features, file features and tags of windows: around every base match's value, and of two places elsewhere.

    A window around a value comes as it is and masked: key words become plain words and of a value's first token only
    the value stays. So the field also learns what secrets look like where no base pattern names them. A corpus tends
    to hold secrets of one shape, so windows also come with drawn values in the middle (see Draws): secrets, tagged as
    such, and look-alikes, tagged outside; those between plain words, at every place. Beyond the text's ends stand
    empty tokens.
    """
    spans = [m.span() for m in WORDS.finditer(text)]
    if not spans:
        return
    starts, ends = np.array(spans).T
    values = sorted([(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(a, b) for a, k, b in base_spans(text) if k])
    tags = _tags(values, starts, ends)
    tokens = [text[a:b].encode("utf-8", "surrogatepass") for a, b in spans]
    file = typer.file(typer(tokens))
    first = {int(np.searchsorted(ends, lo, "right")): (lo, hi) for lo, hi in reversed(values)}
    draws = Draws(text)

    def masked(i: int) -> bytes:
        if i in first:
            lo, hi = first[i]
            return text[max(lo, spans[i][0]) : min(hi, spans[i][1])].encode("utf-8", "surrogatepass")
        return b"word" if _KEYWORD.search(text, *spans[i]) else tokens[i]

    def window(c: int, way, middle: bytes | None = None, tag: int = O) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
        at = range(c - AROUND, c + AROUND + 1)
        y = np.array([tags[i] if 0 <= i < len(tokens) else O for i in at])
        some = [way(i) if 0 <= i < len(tokens) else b"" for i in at]
        if middle is not None:
            some[AROUND] = middle
            y[AROUND] = tag
        types = typer(some)  # may make the table longer
        return bool(y[AROUND] == B), typer.table[types], file, y

    outside = {len(tokens) // 3, 2 * len(tokens) // 3}
    for c in [*np.flatnonzero(tags == B).tolist(), *sorted(outside)]:
        yield window(c, lambda i: tokens[i])
        if tags[c] == B:
            yield window(c, masked)
        single = c + 1 >= len(tags) or tags[c + 1] != I
        if tags[c] != I and single:
            for _ in range(2):
                yield window(c, masked, draws.secret(), B)
                yield window(c, masked, draws.look_alike(), O)


def fit_secrets(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fits the field on windows of at most sample documents, three fourths of which hold a base match, first by a hash of the id.

    Texts are cut into windows where they are stored, whole and of any length; at most windows of them, half of
    them with a secret, first by a hash of what they hold, come to the driver.
    """
    texts = take(docs, id_col, text_col).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    some = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]|(?-i)AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    keyed = texts.withColumn("h", F.xxhash64("id", "text", F.lit(5)))
    first = lambda df, n: first_by_hash(cut(df.select("h")), n, "h")
    chosen = first(keyed.where(F.col("text").rlike(some)), sample - sample // 4).union(first(keyed, sample // 4)).distinct()
    kind = np.dtype("<i2")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typer = Typer()
        for batch in batches:
            rows = [(hit, *(x.astype(kind).tobytes() for x in arrays)) for text in batch.column(0).to_pylist() for hit, *arrays in training_windows(text, typer)]
            hashes = [xxhash.xxh64_intdigest(b"".join(r[1:])) - (1 << 63) for r in rows]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(columns[0], pa.bool_()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["h", "hit", "feats", "file", "tags"])

    cuts = keyed.join(F.broadcast(chosen), "h").select("text").mapInArrow(cut_up, "h long, hit boolean, feats binary, file binary, tags binary")  # sample rows at most
    cuts = cut(cuts)
    take_ = lambda hit, n: first_by_hash(cuts.where(F.col("hit") == hit), n, "h", "feats", "tags")
    rows = take_(True, windows - windows // 2).union(take_(False, windows // 2)).toArrow().sort_by([("h", "ascending"), ("feats", "ascending"), ("tags", "ascending")])  # bounded by windows
    array = lambda name: np.frombuffer(b"".join(rows[name].to_pylist()), kind).astype(np.int64).reshape(rows.num_rows, -1)
    length = 2 * AROUND + 1
    return fit_field(array("feats").reshape(rows.num_rows, length, WIDTH) if rows.num_rows else np.empty((0, length, WIDTH), np.int64), array("file"), array("tags"))


def scan_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, an array of (kind, start, end) by start and kind, in code points, end exclusive.

    kind is assign, access or hex for base matches of the whole text, and crf for what the field adds: the tokens
    that Viterbi tags, less those that touch a base match, without surrounding signs, where eight characters or
    more are left. An id that is no number is an error in ANSI mode, else null. A null text is empty; an empty one has no spans. Rows are scanned one by one, so nulls in other columns,
    repeated rows and very long texts need nothing else; an empty table gives an empty result. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        working("secrets", _TYPER.clear)
        field, typer = shared.value, worker_typer()
        units = np.empty((0, 4, 3))
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                text = text or ""
                base = base_spans(text)
                tokens = text.encode("utf-8", "surrogatepass").split()
                found = base
                if tokens:
                    types = typer(tokens)
                    if len(units) != len(typer.feats):
                        units = np.stack([[field.unit[k][f].sum(0) for k in range(4)] for f in typer.table])
                    e = units[types, 0] + field.file[typer.file(types)].sum(0)
                    e[1:] += units[types[:-1], 1]
                    e[2:] += units[types[:-2], 2]
                    e[:-1] += units[types[1:], 3]
                    if tags := decode(e, field.step):
                        found = sorted([*base, *added(text, tags, base)])
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
            yield pd.DataFrame({"id": pdf["id"], "spans": out})

    rows = take(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(scan, "id long, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


#: Signs around a secret that are not of it.
_AROUND_TOKEN = "\"'`()[]{}<>,;:!?."


def added(text: str, tags: dict[int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of runs of tagged tokens, without those tokens that touch a base match."""
    where, last = {}, max(tags)
    for n, m in enumerate(WORDS.finditer(text)):
        if n in tags:
            where[n] = m.span()
        if n == last:
            break
    taken = sorted((x, y) for x, _, y in base)
    reach = np.maximum.accumulate([y for _, y in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b,))  # of the matches that begin before b, one ends after a
        return not i or reach[i - 1] <= a

    runs: list[list[int]] = []
    for i, s in sorted(tags.items()):
        if free(*where[i]):
            if s == I and runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
    out = []
    for run in runs:
        a, b = where[run[0]][0], where[run[-1]][1]
        while a < b and text[a] in _AROUND_TOKEN:
            a += 1
        while a < b and text[b - 1] in _AROUND_TOKEN:
            b -= 1
        if b - a >= ADDED:
            out.append((a, 3, b))
    return out


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, fit_secrets(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.filter("spans", lambda s: s["kind"] != "crf"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("crf").alias("n_crf"))
