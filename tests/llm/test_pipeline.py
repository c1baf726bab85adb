"""The pipeline against plain versions of its stages, and each stage on awkward rows."""

import base64

import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from helixplane.llm import toxicity
from helixplane.llm.common import table

from . import brute


def test_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    toxic = {r.doc_id for r in toxicity.judge(docs, table(spark, sf_dir, "labels")).filter("toxic").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    keys = {}
    for d, t in rows:
        for x in brute.line_keys(t):
            keys.setdefault(x, set()).add(d)
    clean = lambda d, t: "\n".join(x for x, y in zip(t.split("\n"), brute.line_keys(t)) if len(y) < 10 or len(keys[y]) < 2 or min(keys[y]) == d)
    rows = [(d, clean(d, t)) for d, t in rows]
    kept = {d for d, _, _, k in brute.near_duplicates(rows) if k}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sources = [(r.h, r.doc_id, r.source) for r in docs.selectExpr("shiftrightunsigned(xxhash64(doc_id, 11), 1) as h", "doc_id", "source").collect() if r.doc_id in kept]
    place = {d: k for k, d in enumerate(brute.mixed(sources))}
    expect = [(d, len(i := enc.encode_ordinary(t)), brute.sha(" ".join(map(str, i))), brute.sha(t), place[d]) for d, t in rows if d in kept]
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mix_place"]
    got = [tuple(r) for r in out.collect()]
    assert got == sorted(expect, key=lambda r: r[4])


def test_stages_on_odd_rows(spark, sf_dir):
    docs = brute.odd_documents(spark).selectExpr("doc_id", "text", "chunk as source", "blob", "'x' as kept", "'x' as kept_id", "'x' as `no text`", "1 as rest", "2 as `null`", "3 as doc_id_")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()} and {r.kept for r in got} == {"x"}
        assert any(r.text is None for r in got), name
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert len(cp.mix_sources(spark, docs, sf_dir).collect()) == docs.count()


def test_mix_is_the_order_of_the_files(spark, sf_dir, tmp_path):
    from helixplane.llm import mixing

    docs = table(spark, sf_dir, "documents")
    order = [r.doc_id for r in mixing.mix(docs).orderBy("slot", "place").collect()]
    cp.mix_sources(spark, docs, sf_dir).write.parquet(str(tmp_path / "mix"))
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "mix").glob("part-*.parquet"))
    assert [d for f in files for d in pq.read_table(f).column("doc_id").to_pylist()] == order


def test_run_comes_in_the_order_of_the_mix(spark, sf_dir, monkeypatch):
    from helixplane.llm import mixing

    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(cp, "STAGES", cp.STAGES[-2:])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [r.doc_id for r in cp.run(spark, sf_dir).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [r.doc_id for r in mixing.mix(table(spark, sf_dir, "documents")).orderBy("slot", "place").collect()]


def test_tokenize_keeps_the_order_of_rows_from_elsewhere(spark):
    docs = spark.createDataFrame([(9 - k, f"text {k}") for k in range(9)], "doc_id long, text string").repartition(3).cache()
    assert [r.doc_id for r in cp.tokenize(spark, docs, "").collect()] == [r.doc_id for r in docs.collect()]
