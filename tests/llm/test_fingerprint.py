"""Fingerprints against the whole-table rule for edited texts, and what likeness must tell."""

import random

import numpy as np

from helixplane.llm import fingerprint as fp
from helixplane.llm.common import BASE, BYTE_KEYS, table

from . import brute


def prints(*texts):
    raw = [t.encode() for t in texts]
    return fp.parse(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_edited_texts_and_neighbours(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    for docs in (table(spark, sf_dir, "documents"), brute.odd_documents(spark), brute.odd_documents(spark).limit(1), brute.odd_documents(spark).limit(0)):
        rows = sorted((brute.key(r.doc_id), r.h, r.text or "") for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as h").collect())
        got = fp.digests(fp.fingerprints(docs)).collect()
        plain = lambda t: brute.fingerprint(t.encode(), BYTE_KEYS, BASE)
        hexa = lambda p: ".".join("".join(f"{x:012x}" for x in part) for part in p if part or part is p[0])
        expect = []
        for k, (d, _, t) in enumerate(rows):
            after, half = rows[(k + 1) % len(rows)][2], len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            a, b, c = plain(t), plain(edited), plain(after)
            expect.append((d, len(t), brute.sha(edited), hexa(a), hexa(b), brute.likeness(a, b), brute.likeness(a, c)))
        assert sorted((brute.key(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(expect)


def test_ids_that_fill_ranges_are_split(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    rows = [(None if k % 3 else 77, f"text {k} " * (k % 5)) for k in range(300)] + [(k, f"other {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted((brute.key(r.doc_id), r.h, r.text) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as h").collect())
    edited = []
    for k, (d, _, t) in enumerate(order):
        after, half = order[(k + 1) % len(order)][2], len(t) // 2
        edited.append((d, t[: len(t) - half] + after[:half]))
    assert sorted((brute.key(r.doc_id), r.edited) for r in fp.fingerprints(docs).collect()) == sorted(edited)


def test_equal_substrings_share_signatures_at_any_offset():
    random.seed(1)
    text = "".join(random.choice("abcdefgh ") for _ in range(4000))
    (a, b, c) = (set(p[0].tolist()) for p in [fp.parse(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0] for x in (text, "some other start" + text, "x" * 77 + text[::-1])])
    assert len(a & b) > 0.9 * len(a) and not a & c


def test_texts_in_one_batch_do_not_touch():
    texts = ["abc", "", "a" * 5000, "the same", "the same", "é" * 40]
    for alone, together in zip([prints(t)[0] for t in texts], prints(*texts), strict=True):
        assert [p.tolist() for p in alone] == [p.tolist() for p in together]


def test_likeness():
    random.seed(4)
    x, y = ("".join(random.choice("abcdefghijkl ") for _ in range(9000)) for _ in range(2))
    a, b, c = prints(x, y, x[:4500] + y[:4500])
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) == 0 and 0.15 < fp.likeness(a, c) < 0.55
    empty = prints("")[0]
    assert fp.likeness(empty, empty) == 1 and fp.likeness(empty, a) == 0


def test_likeness_of_short_texts():
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randrange(3, 9)))
    same, apart = [], []
    for _ in range(40):
        x, y = (" ".join(word() for _ in range(10)) for _ in range(2))
        a, b, c = prints(x, y, x[: len(x) // 2] + y[: len(y) // 2])
        same.append(fp.likeness(a, c))
        apart.append(fp.likeness(a, b))
    assert np.mean(same) > 0.2 and min(same) > 0 and np.mean(apart) < 0.06
