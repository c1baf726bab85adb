"""Exact top-k against all scores, with ties, awkward rows and small bins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixplane.llm import topk
from helixplane.llm.common import table


def plain(rows, k, is_query):
    ok = [(v, [math.floor(256 * x) for x in e]) for v, e in rows if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for q, a in {v: e for v, e in sorted(ok, reverse=True) if is_query(v)}.items():  # the least vector of an id asks
        best = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in ok if v != q)[:k]
        out |= {(q, r, v, -s) for r, (s, v) in enumerate(best, 1)}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


@pytest.mark.parametrize("bins,few,queries", [(topk.BINS, topk.FEW, topk.QUERIES), (4, 0, 3)])
def test_against_all_scores(spark, sf_dir, monkeypatch, bins, few, queries):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "FEW", few)
    monkeypatch.setattr(topk, "QUERIES", queries)
    vectors = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert found(topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)) == plain(rows, 5, lambda v: v % 50 == 0)


def test_odd_rows(spark):
    random.seed(3)
    rows = [(v, [random.choice([0.0, 0.5, -0.25]) for _ in range(4)]) for v in range(60)]
    rows += [(None, [1.0] * 4), (100, None), (101, [1.0, None, 1.0, 1.0]), (102, [float("nan")] * 4), (103, [float("inf")] * 4), (104, [0.5]), (105, []), (7, [0.5] * 4), (110, [0.1, 0.2, 0.3, 0.4]), (20, [0.25, -0.5, 0.75, 0.0]), (20, [-0.75, 0.0, 0.25, 0.5]), (20, [-0.75, 0.0])]
    df = spark.createDataFrame([(v, e, v, "x") for v, e in rows], "vec_id long, embedding array<float>, rank long, score string")
    for k in (5, 100):
        got = found(topk.top_k(df, F.col("vec_id") % 10 == 0, k))
        assert got == plain([(v, e and [x if x is None else float(__import__("numpy").float32(x)) for x in e]) for v, e in rows], k, lambda v: v % 10 == 0)
    assert found(topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0, 5)) == set()
    assert found(topk.top_k(df.filter("vec_id = 10"), F.col("vec_id") % 10 == 0, 5)) == set()
