"""Suffix-array dedup over bytes: every byte is removed that a 50-byte string covers which also starts
in a document with a smaller doc_id.

Strings that no other document shares are told apart by their minimisers before anything is sorted,
and what is left meets by them (see repeats.py). All windows that may be shared are then sorted
blockwise with a difference cover: in a block, the suffixes at positions of the cover {0, 1, 3} modulo 7
are ranked first, by doubling; then one suffix bucket at a time is sorted by its first 8 bytes, and what
ties is ordered by the ranks of the cover positions that both suffixes reach within 7 bytes. Equal
windows are neighbours in that order. Memory: three ranks for each 7 bytes, and one bucket.

Null text is empty text. Overlaps count; strings are judged on the input; matches never cross
documents, and strings that repeat only within one stay. Rows that share a doc_id, and all rows with a
null doc_id (after all others), count as one document and come out one by one. An empty table gives an
empty one; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges
from .repeats import remove_repeats

MINIMISER_BYTES = 16
CHUNK_BYTES, BUCKET_BYTES, HOT_CHUNKS = 4 << 20, 6 << 20, 20_000
#: A difference cover: any two residues modulo 7 come into the cover by one common step.
MODULUS, COVER = 7, (0, 1, 3)
STEP = [[next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER) for b in range(MODULUS)] for a in range(MODULUS)]
#: Suffixes of a bucket, unless more share their first two bytes.
BUCKET = 1 << 17


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number in the order of strings."""
    return np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)


def _ranked(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.uint64)


def cover_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions by their first bytes, at least so many; index 3 * (p // 7) + place in the cover."""
    blocks = len(words) // MODULUS
    rank = _ranked(words[(np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).reshape(-1)] >> np.uint64(8))
    reach, step = MODULUS, len(COVER)
    while reach < depth:
        after = np.zeros(len(rank), np.uint64)
        after[:-step] = rank[step:] + np.uint64(1)
        rank = _ranked((rank << np.uint64(32)) | after)
        reach, step = 2 * reach, 2 * step
    return rank


def sort_windows(data: np.ndarray, at: np.ndarray, size: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Equal windows of k bytes get the same number, in the order of the windows."""
    pos = ranges(at, n)
    words = _words(np.concatenate((data, np.zeros(k + 3 * MODULUS + 8, np.uint8))))
    rank = cover_ranks(words, k)
    place = np.array([COVER.index(c) if c in COVER else 0 for c in range(MODULUS)])
    rank_at = lambda p: rank[len(COVER) * (p // MODULUS) + place[p % MODULUS]]
    head = words[pos]
    two = (head >> np.uint64(48)).astype(np.int64)
    ends = np.cumsum(np.bincount(two, minlength=1 << 16))
    number, now, low = np.empty(len(pos), np.int64), 0, 0
    by_two = np.argsort(two, kind="stable")
    while low < 1 << 16:
        done = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + BUCKET, "right")))
        bucket = by_two[done : int(ends[high - 1])]
        low = high
        if not len(bucket):
            continue
        bucket = bucket[np.argsort(head[bucket], kind="stable")]
        h = head[bucket]
        new = np.ones(len(bucket), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(tied):
            bucket[tied] = bucket[tied[_order_ties(pos[bucket[tied]], group[tied].astype(np.uint64), rank_at)]]
            p, q = pos[bucket[tied[1:]]], pos[bucket[tied[:-1]]]
            same = np.flatnonzero(group[tied[1:]] == group[tied[:-1]])
            for step in [*range(8, k - 8, 8), k - 8]:
                same = same[words[p[same] + step] == words[q[same] + step]]
            new[tied[1:]] = True
            new[tied[1:][same]] = False
        number[bucket] = now + np.cumsum(new) - 1
        now += int(new.sum())
    return number


def _order_ties(pos: np.ndarray, group: np.ndarray, rank_at) -> np.ndarray:
    """The order of suffixes within each group, groups being in order already: each residue class counts how many of every other class go before its suffixes."""
    residue = pos % MODULUS
    classes = [np.flatnonzero(residue == c) for c in range(MODULUS)]
    by_step: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def ordered(c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """A class by its ranks d bytes on: keys, and whose they are."""
        if (c, d) not in by_step:
            key = (group[classes[c]] << np.uint64(32)) | rank_at(pos[classes[c]] + d)
            order = np.argsort(key)
            by_step[c, d] = key[order], classes[c][order]
        return by_step[c, d]

    before = np.zeros(len(pos), np.int64)
    for a, mine in enumerate(classes):
        for b, other in enumerate(classes):
            if len(mine) and len(other):
                keys, whose = ordered(a, STEP[a][b])
                before[whose] += np.searchsorted(ordered(b, STEP[a][b])[0], keys, "right" if b < a else "left")
    return np.argsort(before, kind="stable")


def dedup_suffixes(docs: DataFrame, k: int = 50) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), n_bytes, n_removed, n_spans."""
    out = remove_repeats(docs, "byte", k, min(MINIMISER_BYTES, k), sort_windows, CHUNK_BYTES, BUCKET_BYTES, HOT_CHUNKS)
    return out.withColumnRenamed("n_units", "n_bytes")


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
