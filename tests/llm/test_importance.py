"""Importance resampling against a plain version, and its checksums against zlib's."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helixplane.llm import importance as op
from helixplane.llm.common import table

from . import brute

PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_buckets(text) -> tuple[int, list[int]]:
    w = PART.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs: list, target: list) -> list[tuple]:
    found = [(d, *plain_buckets(t)) for d, t in docs]
    s, t = Counter(b for _, _, bs in found for b in bs), Counter(b for x in target for b in plain_buckets(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for d, n, bs in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        rows.append((brute.key(d), n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    asked = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    most = 5 * len(asked) // 100
    return sorted([(r[0], *r[2:], k + 1 if k < most else None) for k, r in enumerate(asked)] + [(r[0], *r[2:], None) for r in rows if r[1] < 20], key=repr)


def test_tables(spark, sf_dir):
    target = table(spark, sf_dir, "benchmark")
    odd = brute.odd_documents(spark).withColumns({c: F.lit("x") for c in ("bucket", "weight", "rank", "n")})
    many = spark.createDataFrame([(k // 3, "the same words over and over again " * 4) for k in range(120)] + [(None, f"no id {k} " + "word " * 30) for k in range(40)], "doc_id long, text string")
    drawn = 0
    for docs, t in ((table(spark, sf_dir, "documents"), target), (odd, target), (many, target), (many, target.limit(0)), (odd.limit(0), target)):
        got = [(brute.key(r.doc_id), *tuple(r)[1:]) for r in op.resample(docs, t).collect()]
        assert sorted(got, key=repr) == plain_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in t.collect()])
        drawn += sum(r[4] is not None for r in got)
    assert drawn > 20


def test_features_are_zlibs_checksums_of_joined_words():
    random.seed(9)
    texts = ["", "One", "a" * 500 + " b " + "c" * 23 + " " + "d" * 24 + "-" + "e" * 25, "Été 9/10 été", "文" * 40 + " 文"]
    texts += ["".join(random.choice("aB9 .é-") for _ in range(random.randrange(80))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    buckets, docs, n_words = op.buckets_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        n, expect = plain_buckets(t)
        assert n_words[k] == n and [int(x) for b, d in zip(buckets, docs, strict=True) for x in b[d == k]] == expect


def test_target_like_documents_come_first(spark):
    docs = spark.createDataFrame([(k, " ".join(f"{'wanted' if k % 10 == 0 else 'other'}{(k * 7 + i) % 50}" for i in range(40))) for k in range(1000)], "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(f"wanted{i}" for i in range(50)),)] * 20, "text string")
    drawn = op.resample(docs, target).filter("rank is not null").collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 51)) and all(r.doc_id % 10 == 0 for r in drawn)


def test_parts_do_not_matter(spark, sf_dir, monkeypatch):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    whole = sorted(op.resample(docs, target).collect())
    monkeypatch.setattr(op, "AT_ONCE", 1000)
    assert sorted(op.resample(docs.repartition(5), target).collect()) == whole
