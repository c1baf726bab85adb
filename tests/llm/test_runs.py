"""Periodic runs against a plain search of every period at every place."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixplane.llm import runs as op
from helixplane.llm.common import table

from . import brute


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every stretch that keeps period q and can't be longer, unless a smaller period does for it."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - a >= max(12, 2 * q):
                out.setdefault((a, i + q), q)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def plain_words(text, doc_id) -> list[str]:
    w = brute.WORD.findall(text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def plain_row(doc_id, text) -> tuple:
    w = plain_words(text, doc_id)
    found = plain_runs(w)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (brute.key(doc_id), len(found), *longest, brute.sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def searched(w: list) -> list[tuple[int, int, int]]:
    ids = np.array(w, np.int64)
    keys = (ids.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
    scales = op.recurring(keys, np.array([0, len(w)]))
    return op.find(ids, {b: places for b, (places, _) in scales.items()})


def test_words_of_all_kinds():
    random.seed(3)
    for _ in range(400):
        n, letters = random.randrange(0, 140), random.choice((1, 2, 3, 6))
        w = [random.randrange(letters) for _ in range(n)]
        for _ in range(random.randrange(3)):  # planted powers, some inside others
            q = random.randrange(1, 30)
            part = [random.randrange(letters) for _ in range(q)]
            at = random.randrange(len(w) + 1)
            w[at:at] = (part * 6)[: random.randrange(q, 5 * q + 1)]
        assert searched(w) == plain_runs(w), w


def test_every_period_from_its_least_length_on():
    for q in range(1, 70):
        for at in range(6):
            n = max(12, 2 * q)
            w = list(range(1000, 1000 + at)) + [i % q for i in range(n)] + list(range(2000, 2010))
            assert searched(w) == [(at, n, q)] and searched(w[: at + n - 1]) == []


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    assert searched(b) == plain_runs(b)


def test_long_runs_take_time_in_proportion():
    n = 60_000
    assert searched([1] * n) == [(0, n, 1)]
    assert searched(([1] * 9 + [2]) * (n // 10)) == [(0, n, 10)]
    half = list(range(n // 2))
    assert searched(half + half) == [(0, n, n // 2)]


def test_scales_hold_every_period():
    for q in range(1, 5000):
        block = op._scale(q)
        assert 2 * block - 1 <= max(q, 12 - q) and q in op._distances(block).tolist()


def test_tables(spark, sf_dir):
    odd = [(100 + k, f"{'so it goes ' * 9}end {k} {' '.join(f'w{i % (k + 2)}' for i in range(60))}") for k in range(30)] + [(None, "a b " * 20), (50, "é " * 40), (50, "é " * 40)]
    odd = spark.createDataFrame(odd, "doc_id long, text string").withColumn("runs", F.lit("a clash")).withColumn("collapsed", F.lit(1))
    seen = 0
    for docs in (table(spark, sf_dir, "documents"), brute.odd_documents(spark), odd, odd.limit(0)):
        got = op.digests(op.runs(docs, alter=True)).collect()
        expect = sorted(plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        assert sorted((brute.key(r.doc_id), *tuple(r)[1:]) for r in got) == expect
        seen += sum(e[1] > 0 for e in expect)
    assert seen > 40


def test_small_batches_and_words_as_they_are(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").limit(40)
    whole = op.runs(docs).collect()
    monkeypatch.setattr(op, "AT_ONCE", 1)
    assert op.runs(docs).collect() == whole
    for r, t in zip(whole, docs.select("text").collect(), strict=True):
        w = brute.WORD.findall(t.text)
        assert [tuple(x) for x in r.runs] == plain_runs(w) and r.n_words == len(w)
