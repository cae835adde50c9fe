"""Byte-level BPE, token counts, quality rules, chunks and repeats against plain versions."""

import collections
import functools
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from govgraph.llm import bpe, chunk_dedup, kernels, quality, suffix_dedup, token_counts, work

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = "doc_id long, text string"


def odd_rows():
    """Nulls, empty and long texts, repeated rows and a clashing extra column."""
    return [(1, None, "a"), (2, "", "b"), (None, "no id here at all", "c"), (4, "same text " * 40, "d"), (4, "same text " * 40, "d"), (5, "x" * 30_000, "e"), (6, "é漢字 " * 5, "f")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, n_words string")


@functools.cache
def library(ranks):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(ranks).rank, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 5, 9, 40])
def test_bpe_equals_library(leaf):
    c, rng = bpe.codec(bpe.RANKS), random.Random(leaf)
    for _ in range(400):
        text = "".join(rng.choice("ab c'sre  \n\t é漢字🙂1 2!?'ll \x1c") for _ in range(rng.randint(0, 60)))
        ids = c.encode(text, leaf)
        assert ids.tolist() == library(bpe.RANKS).encode_ordinary(text)
        assert c.decode(ids, 3) == text.encode()


def test_bpe_of_any_character_and_length():
    """All code points, each between a letter and a digit; and matches too long to remember."""
    c, plain = bpe.codec(bpe.RANKS), library(bpe.RANKS)
    for lo in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(i)}1 {chr(i)}{chr(i)}b" for i in range(lo, lo + 4096) if not 0xD800 <= i < 0xE000)
        assert c.encode(text).tolist() == plain.encode_ordinary(text)
    rng = random.Random(0)
    for text in ("x" * 50_000, "".join(rng.choice("abcdeé漢") for _ in range(20_000)), " " * 3000 + "a", "".join(rng.choice("!?'-") for _ in range(9000))):
        assert c.encode(text).tolist() == plain.encode_ordinary(text)


def test_bpe_join_is_associative():
    c, text = bpe.codec(bpe.RANKS), "one two, three's four\n\n  five 66 seven"
    whole = library(bpe.RANKS).encode_ordinary(text)
    for i in range(len(text)):
        for j in range(i, len(text), 5):
            left = c.join(text, 0, i, j, c.leaf(text[:i]), c.leaf(text[i:j]))
            assert c.join(text, 0, j, len(text), left, c.leaf(text[j:])) == whole


def test_bpe_rows(odd, spark):
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(odd, digests=True).collect()]
    c, want = library(bpe.RANKS), []
    for doc_id, text, _ in odd_rows():
        ids = c.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize(("rule", "counts"), [("first", [2, 1]), ("last", [1, 2]), ("most", [2, 1])])
def test_attribution_rules(rule, counts):
    got, crossing = token_counts.attribute(np.array([2, 6, 8]), np.array([5, 8]), rule)  # the second token lies 3 : 1 across the boundary
    assert got.tolist() == counts and crossing == 1


def test_token_counts(odd):
    c = library(token_counts.RANKS)
    for r in token_counts.token_counts(odd, keep=("doc_id", "text")).collect():
        assert r.n_tokens == len(c.encode_ordinary(r.text or "")) == sum(r.section_tokens)


def plain_quality(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    rng = random.Random(2)
    texts = [t for _, t, _ in odd_rows()] + [" ".join(rng.choice("ab# é\n c") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        want = plain_quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(df, keep=("doc_id", "text"), only_kept=True).count() == sum(r.kept for r in got.values())
    assert quality.quality_rules(spark.createDataFrame([], EMPTY)).count() == 0


def test_quality_verdict(spark):
    """Texts that pass the base rules and fail by the share of long passages alone, or by the longest alone."""
    say = lambda n, at: " ".join(f"w{at + i}" for i in range(n))
    texts = {
        1: f"{say(15, 0)} {say(70, 100)} {say(15, 0)} {say(100, 200)}",  # 30 of 200 words
        2: f"{say(60, 0)} {say(900, 100)} {say(60, 0)} {say(980, 2000)}",  # 120 of 2,000 words
        3: f"{say(15, 0)} {say(170, 100)} {say(15, 0)} {say(200, 300)}",  # 30 of 400 words
    }
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [(got[i].n_long_repeat_words, got[i].longest_repeat_words, got[i].kept) for i in (1, 2, 3)] == [(30, 15, False), (120, 60, False), (30, 15, True)]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 200):
        ids = rng.integers(0, 3, n)
        ends = np.full(n, n)
        sa = quality.suffix_array(ids, ends)
        assert sa.tolist() == sorted(range(n), key=lambda i: ids[i:].tolist())


def plain_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for (doc_id, _), x in zip(rows, data, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(x), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("at_once", [1 << 12, 7, 2, 1])
def test_repeats(spark, at_once, monkeypatch):
    """Whether groups are sorted as they are or parted first, to any depth."""
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    passages = ["".join(rng.choice("abcdeé \n") for _ in range(rng.randint(10, 120))) for _ in range(8)]
    rows = []
    for i in range(50):
        text = "".join(rng.choice(passages)[rng.randint(0, 40) :] if rng.random() < 0.6 else "".join(rng.choice("abcdeé ") for _ in range(30)) for _ in range(rng.randint(0, 6)))
        rows.append((i if i % 9 else 3, text))
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "x" + "a" * 90), rows[5], rows[5]]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, EMPTY), 40, 12, digests=True).collect()
    assert sorted(map(tuple, got), key=repr) == plain_repeats(rows, 40)
    if at_once > 2:
        assert suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY), digests=True).count() == 0


def test_repeats_hold_little(spark, monkeypatch):
    """Texts reach the workers a few MB at a time, and each task of the query leaves its worker without what it needed."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    frame = type(spark.range(0))
    sent, spared, plain = [], [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema: (sent.append(run), plain(self, run, schema))[1])
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 2)
    spark.conf.unset(limit)
    try:
        assert suffix_dedup.op2_suffix_array(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
        assert int(spark.conf.get(limit)) == work.BATCH_BYTES
    finally:
        spark.conf.unset(limit)
    monkeypatch.setattr(work, "spare", lambda: spared.append(1))
    assert len(sent) >= 7  # occurrences, packed texts twice, contexts, halves, groups, what is kept
    for run in sent:
        before = len(spared)
        assert not [b for b in run(iter(())) if len(b)] and len(spared) > before


def test_deep_shallow():
    rng = random.Random(5)
    for _ in range(60):
        text = [bytes(rng.choice([0, 97, 98]) for _ in range(rng.choice([0, 3, 40, 60]))) if rng.random() < 0.6 else b"a" * rng.randint(0, 70) for _ in range(rng.randint(1, 25))]
        group = np.array([rng.randint(0, 2) for _ in text])
        order, lcp = suffix_dedup.deep_shallow(group, text)
        assert [(group[i], text[i]) for i in order] == sorted((group[i], text[i]) for i in range(len(text)))
        for k in range(1, len(text)):
            a, b = text[order[k - 1]], text[order[k]]
            if group[order[k]] == group[order[k - 1]]:
                assert lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_chunks_follow_content():
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    pieces = []
    for text in (body, "inserted " + body):
        b = next(kernels.blocks(pa.array([text])))
        lo, hi = chunk_dedup.cuts(b)
        assert lo[0] == 0 and hi[-1] == len(text) and (lo[1:] == hi[:-1]).all() and (hi - lo).min() >= chunk_dedup.LEAST
        pieces.append({text[x:y] for x, y in zip(lo, hi, strict=True)})
    assert len(pieces[0] & pieces[1]) > 0.9 * len(pieces[0])


def test_chunk_dedup(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    own = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]
    rows = [(1, own[0] + passage + own[1]), (2, own[2] + passage + own[3]), (3, own[0] + passage + own[1]), (4, None), (5, "")]
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, EMPTY)).collect()}
    assert got[1].n_removed == 0 and got[1].n_shared > 0 and bytes(got[1].kept) == rows[0][1].encode()
    assert 200 < got[2].bytes_removed <= 400
    assert bytes(got[3].kept) == b"" and got[3].n_bytes == len(rows[2][1])
    assert got[4].n_bytes == got[5].n_bytes == 0
    assert chunk_dedup.dedup_chunks(spark.createDataFrame([], EMPTY)).count() == 0
