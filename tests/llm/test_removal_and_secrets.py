"""Removal of repeated passages from rows that share an id, and secrets of shapes that the field was not shown."""

import base64
import uuid

import numpy as np
import pytest

from difflake.llm import secrets, substring_dedup

SF = "/root/testdata/sf0.1"


def test_rows_that_share_an_id_lose_their_own_passages_only(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))
    passage = words(80)
    first, planted, clean, late = f"{words(60)}. {passage}. {words(20)}", f"{words(70)}. {passage}. {words(30)}", words(220), f"{passage}. {words(40)}"
    rows = [(1, first), (2, planted), (2, clean), (2, clean), (None, late), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, TEXT string, row string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in substring_dedup.without_repeats(docs).collect()))
    texts = [t for _, _, t in got]
    assert len(got) == 7 and texts.count(clean) == 2 and first in texts
    shorter = [t for none, i, t in got if (none or i == 2) and t != clean]
    assert len(shorter) == 2 and all(passage[100:-100] not in t for t in shorter)
    assert any(t.startswith(planted[:300]) and t.endswith(planted[-150:]) for t in shorter)
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def field(spark):
    return secrets.fit_secrets(spark.read.parquet(f"{SF}/documents.parquet"))


def test_the_field_finds_shapes_that_it_was_not_shown(spark, field):
    """Marks of issuers and headers are not among the drawn values; nor are the look-alikes' words and hosts."""
    rng = np.random.default_rng(99)
    alnum = secrets._ALNUM
    low, digits = alnum[26:52], alnum[52:]
    some = lambda letters, n: "".join(rng.choice(list(letters), n))
    url64 = lambda n: base64.urlsafe_b64encode(rng.bytes(n)).decode().rstrip("=")
    shapes = {
        "ghp": lambda: "ghp_" + some(alnum, 36), "aiza": lambda: "AIza" + some(alnum + "-_", 35), "xoxb": lambda: f"xoxb-{some(digits, 12)}-{some(digits, 12)}-{some(alnum, 24)}",
        "jwt": lambda: f"eyJhbGciOiJIUzI1NiJ9.{url64(60)}.{url64(32)}", "base64 of 30 bytes": lambda: base64.b64encode(rng.bytes(30)).decode(), "20 letters and digits": lambda: some(alnum, 20),
    }
    look_alikes = [
        lambda: f"https://docs.example.org/{some(low, 8)}/{some(low, 6)}-{some(digits, 4)}.html", lambda: str(uuid.UUID(bytes=rng.bytes(16))), lambda: f"/usr/lib/{some(low, 7)}/{some(low, 9)}.so.{some(digits, 1)}",
        lambda: "-".join(some(digits, 4) for _ in range(3)), lambda: f"getHttp{some(low, 6).capitalize()}Response2", lambda: f"978-{some(digits, 10)}", lambda: f"{some(low, 6)}.{some(low, 8)}@mail.example.com", lambda: "_".join(some(low, 6) for _ in range(4)), lambda: some(low, 24),
    ]
    clean = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 50 = 7 and length(text) between 200 and 5000").select("text").collect()]
    clean = [t for t in clean if not secrets.base_spans(t)]
    rows, want = [], {}

    def plant(kind, value, k):
        words = clean[k % len(clean)].split(" ")
        words.insert(len(words) // 2, value)
        want[len(rows)] = (kind, value)
        rows.append((len(rows), " ".join(words)))

    for kind, draw in shapes.items():
        for k in range(60):
            plant(kind, draw(), k)
    for k in range(540):
        plant("look-alike", look_alikes[k % len(look_alikes)](), k)
    for text in clean:
        want[len(rows)] = ("clean", "")
        rows.append((len(rows), text))
    texts = dict(rows)
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "crf"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    share = lambda kind, ok: np.mean([ok(found[i], v) for i, (k, v) in want.items() if k == kind])
    hits = {kind: share(kind, lambda got, v: v in got) for kind in shapes}
    assert min(hits.values()) >= 0.9, hits
    assert share("look-alike", lambda got, _: bool(got)) <= 0.02
    assert share("clean", lambda got, _: bool(got)) <= 0.02
