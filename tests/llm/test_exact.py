"""Operators with an exact contract against plain versions, on sf0.001 and on awkward rows."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from helixplane.llm import bpe, lines, substring, suffix
from helixplane.llm.common import table

from . import brute

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = brute.odd_documents(spark)
    return [docs, odd, odd.limit(0)]


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


CASES = {
    "substring": (lambda d: substring.digests(substring.dedup_substrings(d)), brute.substring),
    "suffix": (lambda d: suffix.digests(suffix.dedup_suffixes(d)), brute.suffix),
    "lines": (lambda d: lines.digests(lines.dedup_lines(d)), brute.lines),
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, sf_dir, name):
    ours, plain = CASES[name]
    for docs in inputs(spark, sf_dir):
        assert brute.ordered(ours(docs).collect()) == brute.ordered(plain(pairs(docs)))


@pytest.mark.parametrize("name", ["substring", "suffix"])
def test_hot_minimisers_and_small_chunks_change_nothing(spark, monkeypatch, name):
    module = {"substring": substring, "suffix": suffix}[name]
    monkeypatch.setattr(module, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(module, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(module, "HOT_CHUNKS", 1)
    monkeypatch.setattr("helixplane.llm.repeats.AT_ONCE", 700)
    random.seed(5)
    base = [f"w{random.randrange(4000)}" for _ in range(400)]
    rows = []
    for d in range(60):
        t = list(base)
        for _ in range(random.randrange(6)):
            t[random.randrange(len(t))] = f"e{random.randrange(30)}"
        rows.append((d, " ".join(t[random.randrange(50) :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ours, plain = CASES[name]
    assert brute.ordered(ours(docs).collect()) == brute.ordered(plain(rows))


def test_difference_cover_sort_groups_equal_windows():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 3000), np.full(500, 97), np.tile(rng.integers(97, 100, 90), 20)]).astype(np.uint8)
    size = np.array([1000, 2000, 500, 1800])
    at = np.cumsum(size) - size
    got = suffix.sort_windows(data, at, size, size - 49, 50)
    windows = [data[a + i : a + i + 50].tobytes() for a, s in zip(at, size) for i in range(s - 49)]
    names: dict = {}
    assert len({(g, names.setdefault(w, len(names))) for g, w in zip(got.tolist(), windows)}) == len(set(windows)) == len(set(got.tolist()))
    assert [w for _, w in sorted(zip(got.tolist(), windows))] == sorted(windows)


def test_bpe_equals_tiktoken(spark, sf_dir):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in inputs(spark, sf_dir):
        out = bpe.encode_decode(docs, PATH, PATTERN)
        texts = sorted((brute.key(d), t or "") for d, t in pairs(docs))
        got = sorted((brute.key(r.doc_id), bytes(r.decoded).decode(), list(r.ids)) for r in out.collect())
        assert got == [(d, t, enc.encode_ordinary(t)) for d, t in texts]
        expect = [(d, len(i := enc.encode_ordinary(t or "")), brute.sha(" ".join(map(str, i))), brute.sha(t or "")) for d, t in pairs(docs)]
        assert brute.ordered(bpe.digests(out).collect()) == brute.ordered(expect)


def test_bpe_long_pieces():
    enc = bpe.encoder(open(PATH, "rb").read(), PATTERN)
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    random.seed(2)
    for text in ("a" * 3001, "ab" * 999, "".join(random.choice("etaonhis") for _ in range(2000)), "=-" * 700, " " * 900):
        assert enc.encode([text])[0].tolist() == plain.encode_ordinary(text)
