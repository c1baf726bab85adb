"""The chain's held-out accuracy, what its later models learn from, and awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from helixplane.llm import toxicity as tox
from helixplane.llm.common import table

from . import brute


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))
    out = tox.judge(docs, labels.filter(fold > 0)).join(labels.filter(fold == 0).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    hit = sum(r.toxic and r.truth == 1 for r in out)
    assert hit >= 0.9 * sum(r.truth for r in out) and hit >= 0.95 * sum(r.toxic for r in out)


def test_later_models_use_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    n = 2000
    slots = [np.unique(rng.integers(0, 300, 20)) for _ in range(n)]
    first = np.array([float(5 in s or 6 in s) for s in slots])
    off = np.concatenate(([0], np.cumsum([len(s) for s in slots])))
    chain = tox.fit_chain(np.concatenate(slots), off, np.column_stack((first, first)))
    p = tox.predict(chain, np.concatenate(slots), off)
    assert chain[1].v[0] > 0 and ((p >= 0.5) == first[:, None]).mean() > 0.99


def test_features_of_a_text_do_not_depend_on_its_batch():
    texts = [b"Some Words, some words!", b"", b"x" * 5000 + b" words", "wörter für".encode()]
    slots, off = tox.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for k, t in enumerate(texts):
        assert slots[off[k] : off[k + 1]].tolist() == tox.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist()


def test_odd_rows(spark):
    docs = brute.odd_documents(spark)
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 1), (7, None, 1), (4, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        out = tox.judge(docs, l).collect()
        assert sorted(brute.key(r.doc_id) for r in out) == sorted(brute.key(r.doc_id) for r in docs.collect())
        assert all(0 <= r.p_toxic <= 1 for r in out)
    assert tox.judge(docs.limit(0), labels).collect() == []


def test_labels_of_one_id_that_disagree_and_texts_that_repeat_it(spark):
    docs = spark.createDataFrame([(k % 40, f"{'vile' if k % 40 < 20 else 'kind'} words number {k}") for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k < 20)) for k in range(40)] + [(k, 0, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    seen = [{(r.doc_id, r.text, r.p_toxic) for r in tox.judge(docs.orderBy(o), labels.orderBy(o)).collect()} for o in (F.col("doc_id"), F.col("doc_id").desc())]
    assert seen[0] == seen[1] and all((p >= 0.5) == (d < 20) for d, _, p in seen[0])


def test_the_sample_has_a_bound_in_features(spark, sf_dir, monkeypatch):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    monkeypatch.setattr(tox, "MAX_CELLS", 2000)
    assert tox.train(docs, labels, tox.categories())[1].b != -tox.NEVER
    monkeypatch.setattr(tox, "MAX_CELLS", 0)
    assert [m.b for m in tox.train(docs, labels, tox.categories())] == [-tox.NEVER] * 2


def test_nothing_is_toxic_without_training_rows(spark):
    docs = brute.odd_documents(spark)
    labels = spark.createDataFrame([(99, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        assert tox.judge(docs, l).filter("toxic").collect() == []
