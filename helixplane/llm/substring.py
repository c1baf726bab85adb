"""Substring dedup over words by super-k-mer partitioning (see repeats.py).

A window is k consecutive words of one document; every word is removed that a window covers whose
words also start in a document with a smaller doc_id. Super-k-mers travel as words joined by a space;
a bucket sorts the windows' strings, so that equal windows meet, exactly.

Null or empty text has no words. Windows that repeat only within a document stay. Rows that share a
doc_id, and all rows with a null doc_id (after all others), count as one document and come out one by
one. An empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import remove_repeats

MINIMISER_WORDS = 20
CHUNK_BYTES, BUCKET_BYTES, HOT_CHUNKS = 4 << 20, 12 << 20, 20_000


def sort_windows(data: np.ndarray, at: np.ndarray, size: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Equal windows of k words get the same number; fragments are words joined by a space."""
    raw = data.tobytes()
    found: list[bytes] = []
    for a, s, count in zip(at.tolist(), size.tolist(), n.tolist(), strict=True):
        spaces = (np.flatnonzero(data[a : a + s] == 0x20) + a).tolist()
        begin, end = [a, *(x + 1 for x in spaces)], [*spaces, a + s]
        found += [raw[begin[w] : end[w + k - 1]] for w in range(count)]
    number, last = np.empty(len(found), np.int64), None
    now = -1
    for w in sorted(range(len(found)), key=found.__getitem__):
        if found[w] != last:
            now, last = now + 1, found[w]
        number[w] = now
    return number


def dedup_substrings(docs: DataFrame, k: int = 50) -> DataFrame:
    """doc_id, kept (text: the words that stay, joined by one space), n_words, n_removed, n_spans."""
    out = remove_repeats(docs, "word", k, min(MINIMISER_WORDS, k), sort_windows, CHUNK_BYTES, BUCKET_BYTES, HOT_CHUNKS)
    return out.select("doc_id", F.col("kept").cast("string").alias("kept"), F.col("n_units").alias("n_words"), "n_removed", "n_spans")


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
