"""Language identification: held-out accuracy, gradients, windows and awkward rows."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixplane.llm import language as op
from helixplane.llm.common import table

from . import brute


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = op.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out and r.lang is not None]
    assert len(rows) == docs.count() and 0.3 < len(out) / len(rows) < 0.36
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert {r.lang_pred for r in rows} <= {r.lang for r in rows} | {"und"} and all(0 <= r.score <= 1 for r in rows)


def test_held_out_languages_are_never_seen(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    other = docs.withColumn("lang", F.when(op.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(op.predict_languages(docs).collect()) == sorted(op.predict_languages(other.repartition(3)).collect())


def test_windows_cover_every_run_of_bytes():
    sizes = [0, 1, 3, 124, 125, 127, 128, 129, 250, 253, 254, 1000]
    off = np.cumsum([0, *sizes])
    start, text = op.windows(np.zeros(off[-1], np.uint8), off)
    for k, n in enumerate(sizes):
        mine = start[text == k] - off[k]
        for i in range(n - 3):
            assert any(s <= i and i + 4 <= s + op.WINDOW for s in mine), (n, i)
        assert (len(mine) > 0) == (n > 0)


def test_gradients():
    """One step of training moves weights against the slope of the loss, which differences give."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, op.SYMBOLS, (6, op.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = op.Network(["a", "b", "c"], 5)
    loss = lambda: -np.log(op.forward(net, net.pairs(), x)[0][np.arange(6), y]).mean()
    before = [p.copy() for p in net.parameters()]
    after = op.fit(x, y, ["a", "b", "c"], epochs=1).parameters()
    for p, b, a in zip(net.parameters(), before, after, strict=True):
        flat, step = p.reshape(-1), (a - b).reshape(-1)
        for i in np.argsort(-np.abs(step))[:5]:
            flat[i] += 1e-2
            up = loss()
            flat[i] -= 2e-2
            slope = (up - loss()) / 2e-2
            flat[i] += 1e-2
            assert abs(slope) < 1e-4 or np.sign(slope) == -np.sign(step[i])


def test_pair_tables_are_the_filters():
    rng = np.random.default_rng(2)
    net, x = op.Network(["a", "b"]), rng.integers(0, op.SYMBOLS, (3, op.WINDOW)).astype(np.uint8)
    two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    for width, tables, f in zip(op.WIDTHS, net.pairs(), net.filters, strict=True):
        n = op.WINDOW - width + 1
        plain = sum(f[k][x[:, k : k + n]] for k in range(width))
        assert np.allclose(op.responses(x, tables, width, two), plain, atol=1e-5)


def test_odd_rows(spark, sf_dir):
    letters = [(1, "123 !? \n"), (2, "漢字"), (3, "— € 5"), (4, "é"), (None, "the word"), (5, "the word " * 9000)]
    odd = brute.odd_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(letters, "doc_id long, text string")).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    net = op.train(table(spark, sf_dir, "documents"))
    out = op.identify(odd, net).join(odd.select("doc_id"), "doc_id", "left_semi").collect()
    by_text = dict(zip([t.text for t in odd.select("text").collect()], op.identify(odd, net).collect(), strict=True))
    for text, r in by_text.items():
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text or "")) and (r.lang_pred != "und" or r.score == 0)
    assert out and op.identify(odd.limit(0), net).collect() == []
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in op.predict_languages(none).collect()} == {("und", 0.0)}


def test_copies_of_one_row_train_once_and_the_sample_has_a_bound(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").limit(30)
    seen = []
    monkeypatch.setattr(op, "fit", lambda x, y, languages: seen.append((len(x), len(y))) or op.Network(languages))
    op.train(docs)
    op.train(docs.unionByName(docs).unionByName(docs))
    op.train(docs, max_rows=5)
    assert seen[0] == seen[1] and 0 < seen[2][0] <= 5 * op.PER_TEXT
