"""Importance resampling towards a target distribution of hashed n-grams.

Position table: a batch's words are laid out one after the other with their document and place; lead()
within the document puts a word's next one and two words after it, which gives the features of orders 1
to 3 that begin there. Each is hashed (crc32 modulo BUCKETS), so a feature is a number; counts are grouped by bucket,
within tasks first, for the documents and for the target texts. A bucket's gain, the rounded log of the ratio
of the two smoothed shares, is joined to the features by bucket, and summed a document. Gumbel noise
that only depends on the seed and doc_id makes the highest scores a draw without replacement.

The checksum of words joined by spaces goes on from that of the words before, so no joined text is ever
made; the two passes over the texts shuffle 10,000 counts a task and nothing else. (The same table as
exploded rows under a DataFrame window costs several times the CPU: README.) Ranks come from a range sort
of scores: rows are counted by range and numbered within, so neither a task nor the driver holds all documents.

Null or empty text has no words: weight 0, and it is never drawn. Fewer than LEAST_WORDS words: not drawn. Ties of scores go to the
smaller doc_id; a null doc_id hashes as an empty id and sorts after all others. Rows that repeat an id count, score and
may be drawn each. Without documents, or with an empty target, sums are 0 and the formulas hold. Other columns don't matter. Texts and words of any length
count whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialise, real_id, texts_of

BUCKETS, ORDERS, LEAST_WORDS = 10_000, 3, 20
#: Bytes of text worked through at a time; bytes of a word that are hashed for all words together, longer words' rest one by one.
AT_ONCE, TOGETHER = 1 << 20, 24


def _checksums() -> np.ndarray:
    """What each byte adds to a crc32 (reflected polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


STEP = _checksums()
#: A-Z as a-z; bytes of words: digits, letters and all of characters beyond ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def position_table(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (data is folded), and the index of each text's first word (n + 1 values)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def _go_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Running checksums after these spans of bytes too."""
    state = state.copy()
    short = -np.minimum(size, TOGETHER + 1).astype(np.int16)
    order = np.argsort(short, kind="stable")
    state, start, size = state[order], start[order], size[order]
    longer = np.searchsorted(short[order], -np.arange(TOGETHER + 1), "left")  # how many spans have more bytes than k
    for k in range(TOGETHER):
        n = longer[k]
        if not n:
            break
        own = state[:n]
        state[:n] = STEP[(own ^ data[start[:n] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    for i in range(longer[TOGETHER]):
        rest = data[start[i] + TOGETHER : start[i] + size[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def buckets_of(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the buckets of all features, and the text of each; and the number of words of each text."""
    data = FOLD[data]
    start, end, first = position_table(data, off)
    size, n_words = end - start, np.diff(first)
    doc = np.repeat(np.arange(len(off) - 1), n_words)
    left = np.repeat(first[1:], n_words) - np.arange(len(start))  # words from here to the end of the text
    state, at = np.full(len(start), 0xFFFFFFFF, np.uint32), np.arange(len(start))
    buckets, docs = [], []
    for order in range(ORDERS):
        some = left[at] > order  # lead(order) is there
        at, state = at[some], state[some]
        if order:
            state = STEP[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = _go_on(state, data, start[at + order], size[at + order])
        buckets.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int32))
        docs.append(doc[at])
    return buckets, docs, n_words


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of AT_ONCE bytes of text, or one text."""
    for b in batches:
        ends, low = texts_of(b.column("text"))[1], 0
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + AT_ONCE, "right")) - 1)
            yield b.slice(low, high - low)
            low = high


def counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of all features of texts (text); a row for each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in _parts(batches):
            for b in buckets_of(*texts_of(part.column("text")))[0]:
                total += np.bincount(b, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, n: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floor(1000 ln((t+1)(S+n) / ((s+1)(T+n)))) from counts, for every bucket."""
    every = source.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(source.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    rows = rows.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    sums = rows.agg(F.sum("s").alias("S_"), F.sum("t").alias("T_"))  # one row
    ratio = (F.col("t") + 1) * (F.col("S_") + n) / ((F.col("s") + 1) * (F.col("T_") + n))
    return rows.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            buckets, owners, n_words = buckets_of(*texts_of(part.column("text")))
            n = len(n_words)
            # sums of whole numbers: exact in doubles up to 2 ** 53
            weight = sum((np.bincount(d, sent.value[b].astype(np.float64), minlength=n) for b, d in zip(buckets, owners, strict=True)), np.zeros(n))
            features = sum((np.bincount(d, minlength=n) for d in owners), np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that aren't among the floor(percent N / 100) drawn of N with least_words words."""
    found = gains(counts(id_and_text(docs)), counts(target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))).orderBy("bucket").toArrow()
    rows = weights(docs, found.column("gain").to_numpy())
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(real_id(F.col("doc_id")).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "utf-8"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    # a row of numbers for each document; its own number tells rows of one id and score apart
    rows = materialise(rows.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "weights")
    asked = F.col("n_words") >= least_words
    order = [F.desc("score"), F.col("doc_id"), F.col("row")]
    ordered = rows.filter(asked).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = materialise(ordered.withColumn("part", F.shiftright("at", 33)).withColumn("own", F.col("at").bitwiseAND((1 << 33) - 1) + 1), "ordered")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    most = sizes.agg((F.floor(F.coalesce(F.sum("n"), F.lit(0)) * percent / 100)).cast("long").alias("most"))
    place = F.col("before") + F.col("own")
    drawn = ordered.join(F.broadcast(before), "part").crossJoin(F.broadcast(most)).withColumn("rank", F.when(place <= F.col("most"), place))
    columns = [real_id(F.col("doc_id")).alias("doc_id"), "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rows.filter(~asked).withColumn("rank", F.lit(None).cast("long")).select(*columns))
