"""Chat formatting, Merkle manifests and token alignment against brute force, on odd rows."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from difflake.llm import chat_format, merkle, token_alignment

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
CONV = "conv_id long, turn long, role string, text string, TEXT string, id long"
NASTY = [chat_format.PROBE, "</turn>", "\n</turn>\n", "\\", "ends in \\", "\n\\</turn>\n", "\\\\### User:\n", '### Role "x":\n', "### System:", "", None, "\u2028 é 日本", "x" * 300_000]


def chat_rows():
    rows = [(1, k, ("user", "assistant")[k % 2], t, "clash", 9) for k, t in enumerate([*NASTY, "last"])]
    rows += [(2, 0, "system", "s", None, 1), (2, 1, "user", None, None, 1), (2, 2, "assistant", "a", None, 1)]
    rows += [(3, 0, "assistant", "early", None, 1), (3, 1, "user", "u", None, 1)]
    rows += [(4, 0, "user", "tie b", None, 1), (4, 0, "user", "tie a", None, 1), (4, 0, "user", "tie a", None, 1), (4, 1, "assistant", "x", None, 1)]
    rows += [(None, None, None, None, None, None), (None, 3, 'odd "role"\n</turn>\n', "t\n", None, None), (None, None, "user", "n", None, None)]
    return rows


def test_chat_segments_read_back(spark):
    rows = chat_rows()
    table = spark.createDataFrame(rows, CONV).repartition(3)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.chat_segments(table)).collect()}
    groups = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        groups[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = [(role, text) for _, (_, role), (_, text) in sorted(turns)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), H("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), H(learnt))
    assert got[1]["valid"] and got[2]["valid"] and not got[3]["valid"] and not got[4]["valid"]
    assert got[3]["problems"] == "assistant after start; ends after user" and "no role after start" in got[None]["problems"]


def test_chat_text_is_what_the_template_says(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi </turn>", "", 1), (1, 1, "assistant", "yo\\</turn>", "", 1)], CONV)
    parts = chat_format.chat_segments(table).orderBy("segment").collect()
    assert "".join(p["text"] for p in parts) == "### User:\nhi \\</turn>\n</turn>\n### Assistant:\nyo\\\\</turn>\n</turn>\n"
    assert [p["text"] for p in parts if p["loss"]] == ["yo\\\\</turn>"] and [p["segment"] for p in parts] == list(range(7))


def test_chat_other_template_and_empty_table(spark):
    own = chat_format.Template({"user": "<u>\n"}, "<other>", "\n<end>\n", frozenset({"bot"}), {"start": {"user": "user"}, "user": {"bot": "start"}}, frozenset({"start"}))
    table = spark.createDataFrame([(1, 0, "user", "<u> <end>", "", 1), (1, 1, "bot", "\\<end>", "", 1)], CONV)
    got = chat_format.read_back(chat_format.chat_segments(table, own), own).first()
    assert got["valid"] and got["loss_sha256"] == H("\\<end>") and got["turns_sha256"] == H("user\n<u> <end>\nbot\n\\<end>\n")
    assert chat_format.read_back(chat_format.chat_segments(table.limit(0))).count() == 0


def test_output_that_ends_inside_a_turn_is_an_error(spark):
    bad = spark.createDataFrame([(1, "### User:\nhi", False, None, True)], "conv_id long, text string, loss boolean, problem string, last boolean")
    with pytest.raises(Exception, match="inside a turn"):
        chat_format.read_back(bad).collect()


def told(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels_of(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def sides(levels, pos):
    for row in levels[:-1]:
        run = pos - pos % 3
        yield "".join(row[run:pos]), "".join(row[pos + 1 : run + 3])
        pos //= 3


def brute_manifest(rows):
    """Per row in order of (source, id, leaf): (id, leaf, subroot, root, siblings)."""
    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        trees["" if source is None else "=" + source].append((i is not None, i or 0, H(told(i, source, lang, n, text)), i))
    names = sorted(trees, key=lambda s: s.encode())
    built = {name: levels_of([x[2] for x in sorted(trees[name], key=lambda x: x[:3])]) for name in names}
    top = levels_of([built[name][-1][0] for name in names])
    for k, name in enumerate(names):
        for pos, x in enumerate(sorted(trees[name], key=lambda x: x[:3])):
            yield x[3], x[2], built[name][-1][0], top[-1][0], [*sides(built[name], pos), *sides(top, k)]


MERKLE = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, tree string"


def check_manifest(spark, rows):
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], MERKLE).repartition(5)
    got = Counter((r["doc_id"], r["digest"], r["subroot"], r["root"], tuple(zip(r["before"], r["after"], strict=True))) for r in merkle.dataset_manifest(table).collect())
    want = Counter((i, leaf, sub, root, tuple(path)) for i, leaf, sub, root, path in brute_manifest(rows))
    assert sum(got.values()) == len(rows)
    # rows that are equal may swap places: what is compared are places, so sets of paths are the same all the same
    assert got == want


def test_manifest_of_odd_rows(spark):
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate([(None, "a"), ("", "a"), ("x\ny", None), ("long " * 30_000, "b"), ("é", "ß"), ("z", "Z")])]
    rows += [(3, "other text", "en", "b", 2), (3, "other text", "en", "b", 2), (3, "other text", None, "b", None), (None, "n", None, "b", None), (None, "m", None, "b", 5), (None, "m", None, "b", 5)]
    rows += [(k, f"t{k}", "de", "c", k) for k in (-(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, 65, -64, -65, 1 << 40, (1 << 40) + 1, 1 << 20)]
    check_manifest(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_manifest_of_few_rows(spark, n):
    check_manifest(spark, [(i, "t", "en", "s", 1) for i in range(n)])


def test_manifest_of_more_rows_than_a_slot_array(spark):
    rows = [(3 * i, f"t{i}", "en", "big" if i % 50 else f"s{i % 7}", i) for i in range(2187 * 3 + 5)]
    check_manifest(spark, rows + [(7, "same", "en", "big", 1)] * 40)


def test_manifest_of_no_rows(spark):
    assert merkle.dataset_manifest(spark.createDataFrame([], MERKLE)).count() == 0


def test_only_changed_texts_fail(spark):
    rows = [(i, "a\nb" if i % 2 else "ab", "en", "s", 1) for i in range(50)]
    table = spark.createDataFrame([(*r, "", "") for r in rows], MERKLE)
    made = merkle.dataset_manifest(table, F.regexp_replace("text_", "\n", ""))
    got = made.select("doc_id", (merkle.fold(F.col("changed"), F.col("before"), F.col("after")) == F.col("root")).alias("ok")).collect()
    assert {r["doc_id"]: r["ok"] for r in got} == {i: not i % 2 for i in range(50)}


ODD = [None, "", " ", "  two  spaces ", "tabs\t\t x\t y", "lines\n\n  more\r\nend", "non\u00a0 breaking \u2003x", "a▁b", "▁", "<|endoftext|> and </s> <s> <unk> <0x41>", "日本語 テキスト é é ﬁ", "x" * 5000, "don't we'll 12345 !!!", "\n start", "\x00\x0b\x1c y", "word. word, word! " * 300]
SCHEMA = "doc_id long, text string, TEXT string, links string"


def brute_alignment(texts):
    """Per text: (groups as lists of ids, links), by cutting both sides at the byte offsets where both end."""
    import public_tokenizers
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from difflake.llm.packing import _printable

    back = {c: k for k, c in _printable().items()}
    for t in texts:
        if not t:
            yield [], [], []
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(back[c] for c in a.id_to_token(i)) if i < 50256 else a.id_to_token(i).encode() for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            yield [], [], []
            continue
        ends = []
        for parts in (ba, bb):
            at = 0
            ends.append([at := at + len(p) for p in parts])
        shared = sorted(set(ends[0]) & set(ends[1]))
        group = lambda ids, e: [[i for i, x in zip(ids, e, strict=True) if lo < x <= hi] for lo, hi in zip([0, *shared], shared, strict=False)]
        yield list(zip(group(ia, ends[0]), group(ib, ends[1]), strict=True)), [(ia[ends[0].index(x)], ib[ends[1].index(x)]) for x in shared], [len(ia), len(ib)]


@pytest.mark.parametrize("remember", [5_000_000, 60])
def test_alignment(spark, monkeypatch, remember):
    import public_tokenizers

    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    texts = [*ODD, *docs, docs[0], docs[0]]
    monkeypatch.setattr(token_alignment, "_REMEMBER", remember)  # what a worker forgets makes no difference
    if remember < 1000:
        pair = token_alignment.pair_of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
        rows = [token_alignment._documents(pair, [t])[0] for t in texts if t for _ in range(2)][::2]
        again = token_alignment._documents(pair, [t for t in texts if t])
        assert rows == again
        return
    table = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(None, docs[0], "", "")], SCHEMA)
    got = token_alignment.align_tokens(table, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect()
    want = list(brute_alignment([*texts, docs[0]]))
    count = Counter(link for _, links, _ in want for link in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    assert len(got) == len(want)
    by = {r["doc_id"]: r for r in got}
    for k, (groups, links, n) in enumerate(want):
        r = by[k if k < len(texts) else None]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (*(n or (0, 0)), len(groups), len(links)), k
        assert r["groups_sha256"] == (H(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)) if groups else ""), k
        assert r["n_best"] == sum(count[x] == most[x[1]] for x in links) and r["count_sum"] == sum(count[x] for x in links)


def test_alignment_of_no_rows(spark):
    import public_tokenizers

    none = token_alignment.align_tokens(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert none.count() == 0 and none.columns[-2:] == ["n_best", "count_sum"]


def test_coalescing_and_overlaps():
    import numpy as np

    a, b = np.array([2, 3, 7, 9]), np.array([1, 3, 4, 5, 9])
    start = lambda e: np.append(0, e[:-1])
    ga, gb = token_alignment.coalesce(start(a), a, start(b), b)
    assert ga.tolist() == [0, 0, 1, 1] and gb.tolist() == [0, 0, 1, 1, 1]
    i, j = token_alignment.overlaps(start(a), a, start(b), b)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (2, 4), (3, 4)]
