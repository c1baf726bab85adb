"""Pfair schedules: deviations, completeness, and placed documents against a plain simulation."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from helixplane.llm import mixing
from helixplane.llm.common import table

from . import brute


@pytest.mark.parametrize("seed", range(20))
def test_every_source_stays_within_one_block_of_its_share(seed):
    rng = random.Random(seed)
    weights = {k: rng.random() ** 3 + 1e-6 for k in range(rng.randrange(1, 30))}
    slots = mixing.whole_weights(weights, 512)
    assert sum(slots.values()) == 512 and all(abs(slots[k] - w / sum(weights.values()) * 512) < 1 or slots[k] == 1 for k, w in weights.items()) or len(weights) > 20
    plan, n = mixing.period(slots), sum(slots.values())
    assert sorted(t for p in plan.values() for t in p) == list(range(n))
    for k, p in plan.items():
        for t in range(n + 1):
            assert abs((p < t).sum() - t * slots[k] / n) < 1


def test_phases_run_every_block_once():
    blocks, weights = {0: 100, 1: 7, 2: 3000, 3: 1, 4: 12}, {0: 3.0, 1: 1.0, 2: 2.0, 3: 0.1}
    plan = mixing.phases(blocks, weights, 64)
    slots = []
    for k, n in blocks.items():
        own = sorted((p for p in plan if p[0] == k), key=lambda p: p[1])
        for b in range(n):
            _, first, slot, size, at = [p for p in own if p[1] <= b][-1]
            slots.append(slot + (b - first) // len(at) * size + at[(b - first) % len(at)])
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_documents(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, block=4, resolution=256).collect()
    counts = Counter(r.source for r in docs.collect())
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())
    by_slot: dict = {}
    for r in out:
        by_slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert sorted(by_slot) == list(range(sum(-(-n // 4) for n in counts.values()))) and all(len(s) == 1 for s in by_slot.values())
    assert len({(r.slot, r.place) for r in out}) == len(out)
    # until the first source ends, shares follow the weights
    first_end = min(max(r.slot for r in out if r.source == s) for s in counts)
    total = sum(math.sqrt(n) for n in counts.values())
    ran = Counter(next(iter(by_slot[t]))[0] for t in range(first_end))
    assert all(abs(ran[s] - first_end * math.sqrt(n) / total) < 1.5 for s, n in counts.items())


@pytest.mark.parametrize("block", [1, 4, 32])
def test_against_a_plain_schedule(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    odd = brute.odd_documents(spark).withColumnRenamed("chunk", "source").select("doc_id", "source").dropDuplicates(["doc_id"])
    for docs, weights in ((table(spark, sf_dir, "documents"), None), (odd, {"a": 1, None: 2, "zz": 9, "d": 0}), (odd, None)):
        rows = [(r.h, r.doc_id, r.source) for r in docs.selectExpr("shiftrightunsigned(xxhash64(coalesce(doc_id, -1L), 11), 1) as h", "doc_id", "source").collect()]
        got = [r.doc_id for r in mixing.mix(docs, weights, block).orderBy("slot", "place").collect()]
        assert got == brute.mixed(rows, weights, block)


def test_large_tables_have_larger_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 20)
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, block=1).collect()
    assert {r.place for r in out} == set(range(10)) and len(out) == docs.count() == 200


def test_odd_rows(spark):
    docs = brute.odd_documents(spark).withColumnRenamed("chunk", "source").selectExpr("*", "1 as slot", "2 as block")
    out = mixing.mix(docs, {"a": 1, None: 2, "zz": 9, "d": 0}, block=2, resolution=16).collect()
    assert sorted(brute.key(r.doc_id) for r in out) == sorted(brute.key(r.doc_id) for r in docs.collect())
    assert len({(r.slot, r.place) for r in out}) == len(out) and {r.carried.slot for r in out} == {1}
    assert mixing.mix(docs.limit(0)).collect() == []


def test_sources_stay_within_one_block_of_unrounded_weights_over_long_runs(spark):
    weights = {**{f"s{k}": 1.0 for k in range(19)}, "rare": 0.003}
    sizes = {s: 1200 if s != "rare" else 5 for s in weights}
    rows = spark.createDataFrame([(1000 * k + j, s) for k, (s, n) in enumerate(sizes.items()) for j in range(n)], "doc_id long, source string")
    out = sorted((r.slot, r.source) for r in mixing.mix(rows, weights, block=1).collect())
    assert [t for t, _ in out] == list(range(len(rows.collect())))
    total, ran, ended = sum(weights.values()), Counter(), False
    for t, s in out:
        ran[s] += 1
        assert all(abs(ran[x] - (t + 1) * w / total) < 1 for x, w in weights.items())
        if ran[s] == sizes[s]:  # the first phase's end
            break
    assert t > 20_000


def test_a_million_slots_stay_within_one_block_of_their_targets():
    weights = {0: 1.0, 1: 0.7310585, 2: 0.00257, 3: 0.3}
    blocks = {0: 500_000, 1: 600_000, 2: 600_000, 3: 600_000}
    plan = mixing.period(mixing.exact_weights(weights), blocks)
    n, total = sum(map(len, plan.values())), sum(weights.values())
    assert n > 1_000_000 - 50_000
    for k, own in plan.items():
        before = np.arange(len(own)) - own * (weights[k] / total)  # ahead of its share as each block begins, and when it is through
        assert before.max() < 1 and before.min() > -1 and (before + 1 - weights[k] / total).max() < 1


def test_exact_weights_keep_proportions():
    assert mixing.exact_weights({0: 0.5, 1: 3, 2: 2.0**-40}) == {0: 2**39, 1: 3 * 2**40, 2: 1}
