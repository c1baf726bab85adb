"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing builds a hierarchy of phrases: symbols are first the bytes of a text; a run
of equal symbols becomes one; each symbol's label is the lowest bit in which it differs from the one
before, and that bit, taken again until labels are small; a phrase begins where a label is a local
maximum; its name, the hash of its symbols, is a symbol of the next level. A boundary depends on a few
neighbours only, so equal substrings have the same phrases inside, wherever they start. A fingerprint is
the bottom-k sketch, by the names' own hash values, of the distinct phrase names of levels 3 and 4
(phrases of about 30 and 80 bytes), KEPT at most; a text with fewer than SHORT of them, which is one of
a few hundred bytes, adds the sketch of its names of levels 1 and 2 (about 3 and 9 bytes), FINE at most.
Likeness of two is the share of the smallest k of their union that both hold, over both kinds of names
if both fingerprints have the finer ones.

Nothing is gathered per group: documents are sorted by id within ranges of ids, each range also gets
the first document of the next, and tasks stream through them. Ids that fill whole ranges, null among
them, are split by a hash of the text. Null text is empty text; the fingerprint of empty text is empty,
and two empty ones are alike (1). A null doc_id sorts after all others. Rows that repeat an id are
neighbours, ordered by a hash of their texts, then the text. A lone document is its own next one. An
empty table gives an empty one; other columns don't matter. Texts of any length are parsed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, hand_back, id_and_text, mix, prefix_hash, real_id, span_hash

KEPT, SHORT, FINE, BOTTOM, TOP, ROUNDS = 64, 16, 32, 3, 4, 3
#: Documents in a range of ids, most ranges, and bytes that are parsed at a time.
RANGE_ROWS, MOST_RANGES, AT_ONCE = 500, 20_000, 1 << 18


LOW_BIT = np.array([0, *((x & -x).bit_length() - 1 for x in range(1, 256))], np.uint8)


def _toss(label: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest bit that differs from the symbol before, plus that bit."""
    differ = label ^ np.concatenate((label[:1], label[:-1]))
    differ[opens] = 1
    if label.dtype == np.uint8:
        place = LOW_BIT[differ]
        return (place << np.uint8(1)) | ((label >> place) & np.uint8(1))
    low = differ & (~differ + np.uint64(1))
    low[low == 0] = 1
    place = np.log2(low.astype(np.float64)).astype(np.uint8)  # exact: a power of two
    return (place << np.uint8(1)) | ((label & low) != 0)


def _phrases(label: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where phrases begin; neighbours within a document differ."""
    opens = np.ones(len(label), bool)
    opens[1:] = doc[1:] != doc[:-1]
    for _ in range(ROUNDS):
        label = _toss(label, opens)
    peak = np.zeros(len(label), bool)
    if len(label) > 2:
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~opens[2:]
    return np.flatnonzero(peak | opens)


def parse(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct phrase names of each text, smallest first: KEPT at most of the upper levels, and FINE at most of the lower ones where there are fewer than SHORT."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    sym, label = BYTE_KEYS[data], data
    upper, lower = [], []
    for level in range(1, TOP + 1):
        if not len(sym):
            break
        runs = np.ones(len(sym), bool)
        runs[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        runs = np.flatnonzero(runs)
        many = np.diff(np.append(runs, len(sym)))
        sym, doc, label = sym[runs], doc[runs], label[runs]
        sym = np.where(many > 1, mix(sym + many.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), sym)
        at = _phrases(label, doc)
        sym = label = span_hash(prefix_hash(sym), at, np.append(at[1:], len(sym)))
        doc = doc[at]
        (upper if level >= BOTTOM else lower).append((sym, doc))
    coarse, held = _least(upper, n, KEPT, np.ones(n, bool))
    fine, _ = _least(lower, n, FINE, held < SHORT)
    return list(zip(coarse, fine, strict=True))


def _least(found: list[tuple[np.ndarray, np.ndarray]], n: int, most: int, wanted: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The least distinct names of each text that wants them, and how many distinct ones it has."""
    if not wanted.all():
        found = [(names[some], owners[some]) for names, owners in found for some in [wanted[owners]]]
    names, owners = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, np.int32)))
    order = np.lexsort((names, owners))
    names, owners = names[order], owners[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (owners[1:] != owners[:-1])
    names, owners = names[new], owners[new]
    ends = np.searchsorted(owners, np.arange(n + 1))
    return [names[a : min(b, a + most)] for a, b in zip(ends[:-1], ends[1:], strict=True)], np.diff(ends)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    kinds = [(a[0], b[0], KEPT)]
    if len(a[1]) and len(b[1]):
        kinds.append((a[1], b[1], FINE))
    common = total = 0
    for x, y, most in kinds:
        union = np.union1d(x, y)[:most]
        common += int(np.isin(union, np.intersect1d(x, y, assume_unique=True), assume_unique=True).sum())
        total += len(union)
    return common / total if total else 1.0


def _cut(sketches: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The 48 bits of each name that a fingerprint keeps."""
    return sketches[0] >> np.uint64(16), sketches[1] >> np.uint64(16)


def _text(sketches: tuple[np.ndarray, np.ndarray]) -> str:
    """12 hexadecimal digits a name; the finer names, if any, after a dot."""
    upper, lower = (p.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex() for p in sketches)
    return f"{upper}.{lower}" if lower else upper


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (the text whose second half is the start of the next document), fingerprint, edited_fingerprint, near_edited, near_next."""
    spark, rows = docs.sparkSession, id_and_text(docs).withColumn("hash", F.xxhash64("text"))
    n = rows.count()
    ranges_ = max(1, min(MOST_RANGES, math.ceil(n / RANGE_ROWS)))
    cuts = (rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / ranges_) for k in range(1, ranges_)]), 10 * ranges_ + 1000)).first()[0] if ranges_ > 1 else None) or []
    edges = np.array(sorted(cuts), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        ids, hashes = ids.to_numpy(), hashes.to_numpy()
        low, high = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
        own = np.maximum(high - low - 1, 0)  # ranges that one id fills: split by the hash
        share = np.floor((hashes / 2.0**64 + 0.5).clip(0, 1 - 2**-53) * own).astype(np.int64)
        return pd.Series(np.where(own > 0, low + 1 + share, high).astype(np.int32))

    rows = rows.withColumn("part", part_of("doc_id", "hash"))
    firsts = sorted((r.part, r.x.doc_id, r.x.hash) for r in rows.groupBy("part").agg(F.min(F.struct("doc_id", "hash")).alias("x")).collect())
    # three numbers for each range, MOST_RANGES at most; the first document of all follows the last
    before = spark.createDataFrame([(d, h, p, firsts[k - 1][0]) for k, (p, d, h) in enumerate(firsts)], "doc_id long, hash long, part int, to int")
    tails = rows.join(F.broadcast(before), ["doc_id", "hash", "part"]).groupBy("to", "doc_id", "hash").agg(F.min("text").alias("text"))
    both = rows.select("part", F.lit(0).alias("tail"), "doc_id", "hash", "text").unionByName(tails.select(F.col("to").alias("part"), F.lit(1).alias("tail"), "doc_id", "hash", "text"))
    sorted_ = both.repartition("part").sortWithinPartitions("part", "tail", "doc_id", "hash", "text")
    out = sorted_.mapInArrow(_run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", real_id(F.col("doc_id")))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and id, the first of the next part last; each is done when the next is there."""
    rows: list[tuple] = []  # (part, tail, doc_id, text)
    size = 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
            rows.append(row)
            size += len(row[3])
            if size >= AT_ONCE and len(rows) > 1:
                yield _done(rows)
                rows, size = rows[-1:], len(rows[-1][3])
        hand_back()
    if len(rows) > 1:
        yield _done(rows)
    hand_back()


def _done(rows: list[tuple]) -> pa.RecordBatch:
    """All rows but the last, which only follows."""
    texts = [r[3] for r in rows]
    mine = [k for k in range(len(rows) - 1) if not rows[k][1]]
    edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in mine]
    raw = [x.encode() for x in texts + edited]
    off = np.cumsum([0, *map(len, raw)])
    prints = [_cut(p) for p in parse(np.frombuffer(b"".join(raw), np.uint8), off)]
    own, new = prints[: len(rows)], prints[len(rows) :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[k][2] for k in mine], pa.int64()),
            pa.array([len(texts[k]) for k in mine], pa.int64()),
            pa.array(edited, pa.string()),
            pa.array([_text(own[k]) for k in mine], pa.string()),
            pa.array([_text(p) for p in new], pa.string()),
            pa.array([likeness(own[k], p) for k, p in zip(mine, new, strict=True)], pa.float64()),
            pa.array([likeness(own[k], own[k + 1]) for k in mine], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
