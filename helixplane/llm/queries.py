"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, importance, language, lines, minhash, mixing, pii, runs, substring, suffix, topk, toxicity
from .common import table


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source")).drop("carried")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.dedup_substrings(table(spark, sf_dir, "documents"), 50))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_junk", "p_toxic", "toxic")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 5, 75)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.dedup_suffixes(table(spark, sf_dir, "documents"), 50))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.dedup_lines(table(spark, sf_dir, "documents"), 10, 2))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digests(fingerprint.fingerprints(table(spark, sf_dir, "documents")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, 42)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.runs(table(spark, sf_dir, "documents"), alter=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_toxicity": op2_toxicity,
    "op3_minhash": op3_minhash,
    "op4_suffix": op4_suffix,
    "op5_mix": op5_mix,
    "op6_bpe": op6_bpe,
    "op7_lines": op7_lines,
    "op8_pii": op8_pii,
    "op9_topk": op9_topk,
    "op10_fingerprints": op10_fingerprints,
    "op11_importance": op11_importance,
    "op12_language": op12_language,
    "op13_runs": op13_runs,
}
#: DuckDB SQL for those that SQL can express; tests hold the others against plain versions.
ORACLE: dict[str, str] = {
    "op1_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        f AS (SELECT s, min(doc_id) AS m FROM x GROUP BY s HAVING min(doc_id) <> max(doc_id)),
        c AS (SELECT DISTINCT doc_id, i + j AS p FROM x JOIN f USING (s), range(50) AS t(j) WHERE m < doc_id),
        u AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
        k AS (SELECT doc_id, count(c.p) AS n, string_agg(t, ' ' ORDER BY p) FILTER (WHERE c.p IS NULL) AS kept FROM u LEFT JOIN c USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op4_suffix": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        -- pieces of 500 windows, as a window of a long text is slow to cut
        w AS (SELECT doc_id, j, substr(h, 1000 * j + 1, 1098) AS piece FROM (SELECT doc_id, h, unnest(range(length(h) // 1000 + 1)) AS j FROM d)),
        x AS (SELECT doc_id, 500 * j + o AS i, substr(piece, 2 * o + 1, 100) AS s FROM (SELECT doc_id, j, piece, unnest(range(greatest(length(piece) // 2 - 49, 0))) AS o FROM w)),
        f AS (SELECT s, min(doc_id) AS m FROM x GROUP BY s HAVING min(doc_id) <> max(doc_id)),
        c AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM x JOIN f USING (s) WHERE m < doc_id),
        g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
        z AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
        n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM z GROUP BY doc_id),
        y AS (
            SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM z
            UNION ALL SELECT doc_id, coalesce(max(b), 0), max(length(h) // 2) FROM d LEFT JOIN z USING (doc_id) GROUP BY doc_id
        ), k AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS kept FROM y JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
        FROM d JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op7_lines": r"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
        l AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM s),
        n AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
        f AS (SELECT k, min(doc_id) AS m FROM n WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
        r AS (SELECT doc_id, line, i, coalesce(m <> doc_id, false) AS gone FROM n LEFT JOIN f USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id""",
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_importance": r"""
        WITH d AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        x AS (SELECT side, doc_id, array_to_string(w[i:i + n - 1], ' ') AS f FROM (SELECT side, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)),
        g AS (SELECT f, side, doc_id, count(*) AS n FROM x GROUP BY ALL),
        -- a crc32, bit by bit, of each distinct feature
        u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)),
        c AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(length(h) // 2), lambda i: list_transform(range(8), lambda k: (('0x' || h[2 * i + 1:2 * i + 2])::BIGINT >> k) & 1)))),
                lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 10000 AS bucket FROM u
        ), s AS (SELECT bucket, sum(n) FILTER (WHERE side = 0) AS s, sum(n) FILTER (WHERE side = 1) AS t FROM g JOIN c USING (f) GROUP BY bucket),
        k AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (SELECT sum(s)::DOUBLE + 10000 FROM s) / ((coalesce(s, 0) + 1)::DOUBLE * (SELECT coalesce(sum(t), 0)::DOUBLE + 10000 FROM s))))::BIGINT AS gain FROM s),
        v AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS w FROM g JOIN c USING (f) JOIN k USING (bucket) WHERE side = 0 GROUP BY doc_id),
        r AS (
            SELECT d.doc_id, coalesce(v.n, 0) AS n_features, coalesce(v.w, 0) AS weight, len(d.w) >= 20 AS asked,
                coalesce(v.w, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM d LEFT JOIN v USING (doc_id) WHERE side = 0
        ), o AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE asked) OVER () AS n FROM r)
        SELECT doc_id, n_features, weight, score, CASE WHEN asked AND place <= 5 * n // 100 THEN place END AS rank FROM o""",
    "op3_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, 2))) AS i FROM w WHERE len(a) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
        ), r AS (SELECT doc_id AS a, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)""",
}
