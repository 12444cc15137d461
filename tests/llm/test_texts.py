"""Tokenizer, leaks and truncation."""

import base64
import json
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofind.llm import endings, leaks, tokenize, truncation
from chronofind.llm.fmindex import FMIndex, suffix_array

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")
DOC = "doc_id bigint, text string, source string, ids string, item_id bigint"


# Tokens


@pytest.fixture(scope="module")
def reference_encode():
    tiktoken = pytest.importorskip("tiktoken")
    from chronofind.llm.bpe import PATTERN

    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@needs_vocabulary
def test_encoder_equals_the_public_library(reference_encode):
    from chronofind.llm.bpe import encoder

    e, rng = encoder(VOCABULARY), random.Random(5)
    alphabet = "abcdeinrst  \n\t\r\xa0The ing 0123.,'\"éüß日本語кот🙂​की<|>"
    texts = ["", " ", "\n\n", "<|endoftext|>", "don't I'll", "a" * 5000, " " * 3000, "ab" * 2000, "the" * 999, "=-" * 999, "\r\n" * 99, "x" + "́" * 50]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("abinthero") for _ in range(rng.randint(5, 40))) for _ in range(4000)]
    for text in texts:
        ids = e.encode(text)
        assert ids == reference_encode(text), text
        assert e.decode(ids) == text
    assert e.encode_all([*texts, None]).to_pylist() == [*map(reference_encode, texts), []]
    assert e.encode_all([]).to_pylist() == [] and e.encode_all([None, ""]).to_pylist() == [[], []]
    for token, content in list(e.bytes_of.items())[::97]:
        assert e.shorter(token) == next((t for n in range(len(content) - 1, 0, -1) if (t := e.id_of.get(content[:n])) is not None), -1)


@needs_vocabulary
def test_corpus_round_trip(spark):
    texts = [None, "", "   ", "plain text", "é\x00\n" * 9, "long " * 20_000, "plain text"]
    docs = spark.createDataFrame([(i, t, "s", "clash", 0) for i, t in enumerate(texts)], DOC)
    encoded = tokenize.encode(docs, VOCABULARY)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert ids[0] == [] and ids[1] == [] and ids[2] and ids[3] == ids[6] and encoded.schema["ids"].dataType.simpleString() == "array<int>"
    back = {r.doc_id: r.text for r in tokenize.decode(encoded, VOCABULARY).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert {r.doc_id: r.n_tokens for r in tokenize.token_counts(encoded).collect()} == {k: len(v) for k, v in ids.items()}
    assert tokenize.encode(docs.limit(0), VOCABULARY).count() == 0


# Leaks


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n, top in ((1, 2), (7, 1), (300, 2), (300, 40)):
        text = rng.integers(0, top, n)
        want = sorted(range(n), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == want


@pytest.mark.parametrize("top", [2, 3, 60])
def test_index_finds_every_occurrence(top):
    rng = np.random.default_rng(top)
    docs = [rng.integers(1, top + 1, int(n)) for n in rng.integers(1, 80, 40)] + [np.ones(50, np.int64)] * 3
    index = FMIndex(docs, top)
    for length in (1, 2, 4):
        phrases = np.unique(np.array([d[i : i + length] for d in docs for i in range(0, len(d) - length + 1, 3)] + [rng.integers(1, top + 1, length)]), axis=0)
        begin, end = index.search(phrases)
        for p, b, e in zip(phrases, begin, end, strict=True):
            want = {(d, i) for d, x in enumerate(docs) for i in range(len(x) - length + 1) if (x[i : i + length] == p).all()}
            document, offset = index.locate(np.arange(b, e))
            assert set(zip(document.tolist(), offset.tolist(), strict=True)) == want


def _brute(docs, items, length):
    grams = defaultdict(set)
    for item, passage in items:
        w = leaks.words(passage)
        for i in range(len(w) - length + 1):
            grams[tuple(w[i : i + length])].add(item)
    covered = defaultdict(set)
    for d, text in docs:
        w = leaks.words(text)
        for i in range(len(w) - length + 1):
            for item in grams.get(tuple(w[i : i + length]), ()):
                covered[d, item] |= set(range(i, i + length))
    return covered


@pytest.mark.parametrize("shard_words", [10, 60, 10_000])
def test_leaks_against_brute_force(spark, shard_words):
    rng, length = random.Random(shard_words), 5
    lexicon = [f"w{i}" for i in range(12)] + ["Ünï", "123"]
    items = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randint(3, 14)))) for i in range(12)] + [(90, None), (91, ""), (92, "one two")]
    docs = []
    for d in range(60):
        w = [rng.choice(lexicon) for _ in range(rng.randint(0, 40))]
        if d % 2:
            p = leaks.words(items[rng.randrange(12)][1])
            k = rng.randrange(len(p))
            w[5:5] = p[k : k + 9]
        docs.append((d, "".join(x.upper() + rng.choice([" ", "\n> ", ", ", "_-\xa0"]) if rng.random() < 0.3 else x + " " for x in w), "s", "", 1))
    docs += [(100, None, None, None, None), (101, "", "", "", 0), (102, docs[1][1], "", "", 0)]
    df = spark.createDataFrame(docs, DOC)
    got = defaultdict(set)
    for r in leaks.leaks(df.repartition(3), spark.createDataFrame(items, "item_id bigint, passage string"), length, shard_words).collect():
        got[r.doc_id, r.item_id] |= set(range(r.first_word, r.last_word + 1))
    want = _brute([(d[0], d[1]) for d in docs], items, length)
    assert set(got) == set(want)
    assert all(want[k] <= got[k] for k in want)
    blocks = leaks.leaks(df, spark.createDataFrame(items, "item_id bigint, passage string"), length, shard_words, block_words=15)
    whole = leaks.leaks(df, spark.createDataFrame(items, "item_id bigint, passage string"), length, 10**6)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))
    assert leaks.leaks(df.limit(0), spark.createDataFrame(items, "item_id bigint, passage string"), length).count() == 0
    assert leaks.leaks(df, spark.createDataFrame([], "item_id bigint, passage string"), length).count() == 0


def test_long_leak_in_pieces_is_one_span(spark):
    passage = " ".join(f"p{i}" for i in range(100))
    text = " ".join(f"a{i}" for i in range(50)) + " " + passage + " " + " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, "s", "", 0)], DOC)
    for shard in (60, 100, 1000):
        assert [tuple(r) for r in leaks.leaks(docs, spark.createDataFrame([(7, passage)], "item_id bigint, passage string"), 15, shard).collect()] == [(1, 7, 50, 149)], shard


# Truncation

COMPLETE = """commit abc
Author: A <a@b.example>

    Move the loader

    The loader moves. It was
    slow before.

diff --git a/x b/x
--- a/x
+++ b/x
@@ -1,3 +1,3 @@ f
 one
-two
+three
 four
"""


def test_complete_texts_are_no_cases():
    message = COMPLETE[: COMPLETE.index("\ndiff")]
    for text in (COMPLETE, COMPLETE[:-1], message, message[:-1], message.rstrip().rstrip(".") + "\n", "commit abc\nAuthor: A\n\n    Fix it", "Change: 1\nOwner: x\n\nwork in progress ...", "Change: 1\nOwner: x\n\ndrop it …",
                 message + "\n    Ticket: QX-1", message + "\n    - one thing", "Change: 1\n\nMerge\n\n# Conflicts:\n#\ta/b.c", "Change: 1\n\nkeep it [truncated] marker", COMPLETE.replace("\n", "\r\n"),
                 "Change: 1\n\nAdd\n\ndiff --git a/p.png b/p.png\nindex 1..2\nBinary files a/p.png and b/p.png differ", "x" * 10,
                 "Change: 1\n\nAdd\n\ndiff --git a/p b/p\nGIT binary patch\ndelta 10\nJ" + "a" * 15 + "\n\n"):
        assert not endings.is_cut(text), text


def test_cuts_are_cases():
    hunk = COMPLETE.index("@@") + 3
    for end in range(hunk, len(COMPLETE) - 7):
        assert endings.is_cut(COMPLETE[:end]) or COMPLETE[:end].endswith("@@ f"), COMPLETE[:end]
    body = "Subject: [PATCH] x\n\nThe loader moves. It was slow"
    for text in (body, body + " bef�", body + "\0", body + " [truncated]", body + " be\n[message too long]", body + " <snip>", body + " b (cut)", body + " b [truncated]\n", body + "\n<snip>\n", body + " be…", body + " be...",
                 COMPLETE[:-12] + " (cut)", "Change: 1\n\nAdd\n\ndiff --git a/p b/p\nGIT binary patch\ndelta 52\nz" + "a" * 30, "Change: 1\n\nAdd\n\ndiff --git a/p b/p\nindex 1..2"):
        assert endings.is_cut(text), text


def plain_lengths(text: str) -> dict[str, int]:
    """Length of a text under every form in which a store may have measured it."""
    crlf = text.count("\n") - text.count("\r\n")
    size = len(text.encode("utf-8", "surrogatepass"))
    entities = 4 * text.count("&") + 3 * (text.count("<") + text.count(">"))
    quoted = json.dumps(text, ensure_ascii=False)
    return {
        "chars": len(text),
        "utf8": size,
        "utf16": len(text.encode("utf-16-le", "surrogatepass")) // 2,
        "entities": len(text) + entities,
        "entities_utf8": size + entities,
        "json": len(quoted) - 2,
        "json_ascii": len(json.dumps(text)) - 2,
        "json_utf8": len(quoted.encode("utf-8", "surrogatepass")) - 2,
        "crlf": len(text) + crlf,
        "crlf_utf8": size + crlf,
    }


def test_lengths_are_what_plain_python_counts(spark):
    texts = ['é🙂\n<"\r\n', "a&b<c>\t\\\x01\x7f\x0b", "plain", "x\r\r\n\n", "日本\u2028" * 50, "\x00x", "x\ndiff --git a/b\n+é\r\n", "diff --git a b", "\n\n x"]
    docs = spark.createDataFrame([(i, t, "s", "", 0) for i, t in enumerate(texts)] + [(90, None, "s", "", 0), (91, "", "s", "", 0), (92, " \u00a0\n\t"[:4], None, "", 0), (93, " \n\t", None, "", 0)], DOC)
    got = {r.doc_id: r for r in truncation.features(docs).collect()}
    for i, t in enumerate(texts):
        for form, n in plain_lengths(t).items():
            assert got[i][f"text_{form}"] == n, (t, form)
            message = t.split("\ndiff --git ")[0] if "\ndiff --git " in t else None
            assert got[i][f"message_{form}"] == (None if message is None else plain_lengths(message)[form]), (t, form)
    assert all(got[i]["text_chars"] is None and not got[i].cut for i in (90, 91, 93)) and set(plain_lengths("")) == set(truncation.FORMS)


def _limited(rng, n):
    """Texts of sources with hidden limits: in bytes, in characters, none, and a null source."""
    rows = []
    for i in range(n):
        source = ["utf8", "chars", "free", None][i % 4]
        text = "Note: " + "".join(rng.choice("abc é") for _ in range(rng.randint(20, 400))) + "."
        if source == "utf8":
            while len(text.encode()) > 200:
                text = text.encode()[:200].decode("utf-8", "ignore") if len(text.encode()) != 200 else text
                text += "x" * (200 - len(text.encode()))
        elif source in ("chars", None):
            text = text[:300]
        rows.append((i, text, source, "", 0))
    return rows


def test_hidden_limits(spark):
    rng = random.Random(1)
    rows = _limited(rng, 3000) + [(9000, None, "free", "", 0), (9001, "  ", "free", "", 0), (9002, "", None, "", 0)]
    measured = truncation.features(spark.createDataFrame(rows, DOC)).cache()
    assert {(r.source, r.part, r.form, r["at"]) for r in truncation.limits(measured).collect()} == {("utf8", "text", "utf8", 200), ("chars", "text", "chars", 300), (None, "text", "chars", 300)}
    judged = truncation.truncated(measured)
    hit = {r.doc_id for r in judged.where("at_limit").collect()}
    assert hit == {i for i, t, s, *_ in rows if t and (s == "utf8" and len(t.encode()) == 200 or s in ("chars", None) and len(t) == 300)}
    assert judged.count() == len(rows)
    padded = [(i, (f"Note {i}: whole." + "\n" * 400)[:300] if i % 2 else f"Note: {i}" + "x" * (294 - len(str(i))), "pad", "", 0) for i in range(60)]
    assert {r.doc_id for r in truncation.truncated(truncation.features(spark.createDataFrame(padded, DOC))).where("truncated").collect()} == {i for i in range(60) if i % 2 == 0}
    shares = {r.source: r for r in truncation.by_source(judged).collect()}
    assert (shares["free"].n, shares["free"].n_cut) == (752, 0) and shares[None].n == 751 and shares["chars"].n_limit_only == shares["chars"].n_limit > 100
    assert truncation.truncated(truncation.features(spark.createDataFrame([], DOC))).count() == 0


def test_what_only_the_limit_explains(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(900):
        subject = "commit 1\n\n    " + " ".join(word() for _ in range(rng.randint(4, 40)))
        items = subject[:60] + "\n\n" + "\n".join(f"    - {word()} {word()}" for _ in range(rng.randint(3, 30)))
        text = subject if i % 2 else items
        # Two limits of one source: an old one of 150 characters, a newer one of 240 for what came later.
        rows.append((i, text[: 150 if i < 450 else 240] + ("" if len(text) > (150 if i < 450 else 240) else "\n"), "two", "", 0))
    full = {i for i, t, *_ in rows if not t.endswith("\n")}
    judged = truncation.truncated(truncation.features(spark.createDataFrame(rows, DOC)))
    got = {r.doc_id: r for r in judged.collect()}
    late = {i for i in full if i >= 450}
    assert {i for i, r in got.items() if r.truncated} >= late and sum(not got[i].cut for i in late) > 100
    # A peak with longer texts beyond it needs texts that break off by their endings.
    cut = [(i, t if i >= 450 else ("Subject: a\n\nIt goes on and " + t.replace("\n", " "))[:149] if i in full else t, s, k, n) for i, t, s, k, n in rows]
    limits = {(r.form, r["at"]) for r in truncation.limits(truncation.features(spark.createDataFrame(cut, DOC))).collect()}
    assert limits == {("chars", 149), ("chars", 240)}


def test_message_limits_and_notices_at_them(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        message = "commit 1\n\n    " + "".join(rng.choice("abc de") for _ in range(rng.randint(10, 300)))
        message = message[:120] + " {more below}" if len(message) > 120 else message
        rows.append((i, message + "\n" * (len(message) < 120) + "\ndiff --git a/x b/x\n" + "index 1..2\nBinary files differ\n" * rng.randint(1, 9), "m", "", 0))
    measured = truncation.features(spark.createDataFrame(rows, DOC)).cache()
    assert {(r.part, r.form, r["at"]) for r in truncation.limits(measured).collect()} == {("message", "chars", 133)}
    whole = [(i, t.split("\ndiff")[0], "w", "", 0) for i, t, *_ in rows] + [(5000, "commit 1\n\n    Short {more below}\n", "w", "", 0), (5001, "commit 1\n\n    Other {more}\n", "w", "", 0), (5002, "commit 1\n\n    Other {more below}\n", "v", "", 0)]
    measured = truncation.features(spark.createDataFrame(whole, DOC)).cache()
    judged = {r.doc_id: r for r in truncation.truncated(measured).collect()}
    assert judged[5000].noticed and judged[5000].truncated and not judged[5001].truncated and not judged[5002].truncated


def test_repeated_texts_make_no_limit(spark):
    rows = [(i, "Subject: bump\n\nBump the version", "auto", "", 0) for i in range(200)] + [(1000 + i, "Subject: x\n\n" + "y" * (i % 9) + ".", "auto", "", 0) for i in range(30)]
    assert truncation.limits(truncation.features(spark.createDataFrame(rows, DOC))).count() == 0
