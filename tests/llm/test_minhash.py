"""Near duplicates against all pairs, with large groups and small blocks."""

import random

import pytest

from helixplane.llm import minhash
from helixplane.llm.common import table

from . import brute


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def groups():
    """Copies with a few edits each, half of them beyond the threshold from the first; unrelated documents that share a passage; a chain."""
    random.seed(8)
    word = lambda: f"w{random.randrange(3000)}"
    base, passage = [word() for _ in range(120)], " ".join(word() for _ in range(60))
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(random.randrange(9)):
            t[random.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(random.randrange(5, 200))) + " " + passage for _ in range(60)]
    long = [word() for _ in range(700)]
    for _ in range(25):
        texts.append(" ".join(long))
        for _ in range(12):
            long[random.randrange(700)] = word()
    texts += ["One two THREE", "one TWO three", "four five six seven eight"] * 2
    random.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("block", [minhash.BLOCK_ROWS, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
    rows = groups()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute.ordered(minhash.near_duplicates(docs).collect()) == brute.ordered(brute.near_duplicates(rows))


def test_documents_and_odd_rows(spark, sf_dir):
    for docs in (table(spark, sf_dir, "documents"), brute.odd_documents(spark), brute.odd_documents(spark).limit(0)):
        assert brute.ordered(minhash.near_duplicates(docs).collect()) == brute.ordered(brute.near_duplicates(rows_of(docs)))


def test_components_of_long_chains(spark):
    pairs = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(500, 160), (159, 500)]
    got = {r.doc_id: r.component for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in [*range(100, 161), 500]}


def test_texts_that_share_an_id_are_compared_each(spark):
    rng = random.Random(2)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(60)] for _ in range(8)]
    near = lambda k, n: " ".join([*texts[k][:-1], f"other{n}"])
    rows = [(None, " ".join(texts[0])), (None, " ".join(texts[1])), (None, ""), (3, near(0, 3)), (4, near(1, 4))]
    rows += [(5, " ".join(texts[2])), (5, " ".join(texts[3])), (5, None), (2, near(3, 2)), (6, near(2, 6)), (7, " ".join(texts[4])), (7, " ".join(texts[5])), (8, near(5, 8)), (9, " ".join(texts[6]))]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        assert brute.ordered(minhash.near_duplicates(docs).collect()) == brute.ordered(brute.near_duplicates(order))
