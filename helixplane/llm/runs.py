"""Periodic runs of words: block matching at every scale, then exact extension.

A run is a maximal stretch of words of smallest period q, LEAST words and two periods long at least. At the scale of B
words (a power of two), the blocks that begin at multiples of B are keys (sequences of word numbers) of an
Aho-Corasick automaton, which is searched across the document; an occurrence at a distance of the scale (_distances)
after its block seeds a run with that distance as its period. A run of period q repeats its first length - q words, in which
an aligned block of its scale always lies: no run is missed. Seeds are extended to both sides, word by word, by comparing slices of
doubling length. What is found with a multiple of a known period within its run is that run; a run found with several
distances has the least of them as its period.

Blocks that can't seed anything aren't keys: a rolling hash of the B words must recur in the document at
a distance of the scale (worked out for all documents of a batch together; only places whose halves
recur are looked at on the next scale), and blocks whose whole reach lies within a known run of a period
of B at most only find that run again. So an automaton holds a document's repeated blocks of one scale: at most
as many words as the document has, and most documents need none.

A task streams through its documents; nothing is shuffled. Null or empty text has no words and no runs: the digests are those of nothing. Of runs of
equal length the first counts as the longest, then the one of least period. Repeated rows come out one by
one; an empty table gives an empty one; other columns don't matter. Texts of any length are searched whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, hand_back, id_and_text, mix, prefix_hash, span_hash, texts_of, words

#: Fewest words of a run; bytes of text worked through at a time.
LEAST, AT_ONCE = 12, 1 << 20


def _scale(q: int) -> int:
    """The block for period q: the largest power of two of which an aligned one lies in any max(q, LEAST - q) words."""
    size = (max(q, LEAST - q) + 1) // 2
    return 1 << (size.bit_length() - 1)


def _distances(block: int) -> np.ndarray:
    """The periods, ascending, that blocks of a scale seed."""
    return np.array([q for q in range(1, max(4 * block, LEAST)) if _scale(q) == block], np.int64)


def recurring(keys: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each scale, where blocks begin whose hash recurs at a distance of the scale: places among all words of the batch, and their documents. keys: a hash of each word; first: where each document's words begin (n + 1 values)."""
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    stop, begin = first[1:][doc], first[:-1][doc]
    sums = prefix_hash(keys)
    out, block = {}, 1
    places = np.arange(len(keys))
    while len(places):
        places = places[places + block <= stop[places]]
        if not len(places):
            break
        own = mix(span_hash(sums, places, places + block) ^ mix(doc[places].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own, kind="stable")
        new = np.ones(len(order), bool)
        sorted_ = own[order]
        new[1:] = sorted_[1:] != sorted_[:-1]
        group = np.cumsum(new)
        at = places[order]
        again = ~new
        again[:-1] |= ~new[1:]
        distances = _distances(block)
        if len(distances):
            # aligned blocks, and the next place of the same group that is far enough
            rank = group * np.int64(2 * len(keys) + 2) + at
            mine = np.flatnonzero(again & ((at - begin[at]) % block == 0))
            fits = np.zeros(len(mine), bool)
            # distances come in one range or, for the smallest scales, several
            for some in np.split(distances, np.flatnonzero(np.diff(distances) > 1) + 1):
                k = np.minimum(np.searchsorted(rank, rank[mine] + some[0]), len(rank) - 1)
                gap = rank[k] - rank[mine]
                fits |= (gap >= some[0]) & (gap <= some[-1])
            found = np.sort(at[mine[fits]])
            if len(found):
                out[block] = (found, doc[found])
        # the next scale: both halves recur somewhere
        held = np.zeros(len(keys) + 1, bool)
        held[at[again]] = True
        places = np.flatnonzero(held[:-1])
        places = places[held[np.minimum(places + block, len(keys))]]
        block *= 2
    return out


def _together(a: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from i and from j on agree, to the right (step 1) or left (step -1), `most` at most."""
    n, size = 0, 8
    while n < most:
        size = min(size, most - n)
        if step > 0:
            same = a[i + n : i + n + size] == a[j + n : j + n + size]
        else:
            same = a[i - n - size + 1 : i - n + 1][::-1] == a[j - n - size + 1 : j - n + 1][::-1]
        if not same.all():
            return n + int(np.argmin(same))
        n += size
        size *= 2
    return n


def find(ids: np.ndarray, blocks: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document: its words' numbers, and by scale where its recurring blocks begin."""
    n, runs = len(ids), {}
    whole = tuple(ids.tolist())
    for block in sorted(blocks):
        distances, begins = _distances(block), blocks[block]
        known = [(a, b, q) for (a, b), q in runs.items() if b - a >= distances[0] + block]
        stay = np.ones(len(begins), bool)
        for a, b, q in known:
            if q <= block:  # a block of a period or more only meets multiples of it within the run
                stay[np.searchsorted(begins, a) : np.searchsorted(begins, b - distances[-1] - block, "right")] = False
        begins = begins[stay]
        if not len(begins):
            continue
        keys: dict[tuple, list[int]] = {}
        for p in begins.tolist():
            keys.setdefault(whole[p : p + block], []).append(p)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, key in enumerate(keys):
            automaton.add_word(key, k)
        automaton.make_automaton()
        ends: list[list[int]] = [[] for _ in keys]
        for end, k in automaton.iter(whole):
            ends[k].append(end)
        seeds = []
        for k, starts in enumerate(keys.values()):
            at = np.array(ends[k], np.int64) - block + 1
            p = np.array(starts, np.int64)
            low, high = np.searchsorted(at, p + distances[0]), np.searchsorted(at, p + distances[-1], "right")
            size = high - low
            p = np.repeat(p, size)
            x = at[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            seeds.append(np.column_stack((x - p, p)))
        found = np.concatenate(seeds)
        found = found[np.isin(found[:, 0], distances)]
        found = found[np.argsort(found[:, 1], kind="stable")]
        stay = np.ones(len(found), bool)
        for a, b, q in known:  # multiples of a known run's period within it
            some = slice(np.searchsorted(found[:, 1], a), np.searchsorted(found[:, 1], b - distances[0] - block, "right"))
            stay[some] &= (found[some].sum(1) + block > b) | (found[some, 0] % q != 0)
        found = found[stay]
        found = found[np.argsort(found[:, 0], kind="stable")]
        last, until = 0, 0
        for q, p in found.tolist():
            if q == last and p + block + q <= until:  # within what the seed before was extended to
                continue
            left = _together(ids, p - 1, p - 1 + q, p, -1) if p else 0
            right = _together(ids, p + block, p + block + q, n - (p + block + q), 1)
            a, b = p - left, p + block + q + right
            last, until = q, b
            if b - a >= max(LEAST, 2 * q):
                runs[a, b] = min(q, runs.get((a, b), q))
    return sorted((a, b - a, q) for (a, b), q in runs.items())


def altered(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p) of a document whose words from a on repeat its first p from there, or None: one in ten, by the checksum of its id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def runs(docs: DataFrame, alter: bool = False) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed: the text's words joined by one space, those of each run only for its first period. alter: with altered()'s words in place of some documents' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, low = texts_of(b.column("text"))[1], 0
            while low < b.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + AT_ONCE, "right")) - 1)
                yield _part(b.slice(low, high - low), alter)
                low = high
            hand_back()

    out = id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.decode("collapsed", "utf-8"))


def _part(rows: pa.RecordBatch, alter: bool) -> pa.RecordBatch:
    data, off = texts_of(rows.column("text"))
    start, end, first = words(data, off)
    ids = [None if d == (1 << 63) - 1 else d for d in rows.column("doc_id").to_pylist()]
    keys = span_hash(prefix_hash(BYTE_KEYS[data]), start, end)
    own = np.arange(len(start))
    if alter:
        for k, d in enumerate(ids):
            if (cut := altered(int(first[k + 1] - first[k]), d)) is not None:
                a, p = first[k] + cut[0], cut[1]
                own[a : first[k + 1]] = a + (own[a : first[k + 1]] - a) % p
    scales = recurring(keys[own], first)
    doc_blocks: dict[int, dict[int, np.ndarray]] = {}
    for block, (places, owners) in scales.items():
        some, at = np.unique(owners, return_index=True)
        for d, part in zip(some.tolist(), np.split(places, at[1:]), strict=True):
            doc_blocks.setdefault(d, {})[block] = part - first[d]
    raw, found, collapsed = data.tobytes(), [], []
    for d in range(rows.num_rows):
        low, high = int(first[d]), int(first[d + 1])
        text = [raw[a:b] for a, b in zip(start[own[low:high]].tolist(), end[own[low:high]].tolist(), strict=True)]
        mine: list[tuple[int, int, int]] = []
        if d in doc_blocks:
            numbers: dict[bytes, int] = {}  # words as they are: hashes only chose the blocks
            mine = find(np.array([numbers.setdefault(w, len(numbers)) for w in text], np.int64), doc_blocks[d])
            if mine:
                gone = np.zeros(len(text) + 1, np.int64)
                for s, length, q in mine:
                    gone[s + q] += 1
                    gone[s + length] -= 1
                text = [w for w, g in zip(text, np.cumsum(gone).tolist(), strict=False) if not g]
        found.append([{"start": s, "length": length, "period": q} for s, length, q in mine])
        collapsed.append(b" ".join(text))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(first).astype(np.int64)), pa.array(found, kind), pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def digests(out: DataFrame) -> DataFrame:
    """The longest run of each document, and digests of its runs and of what is left."""
    # by greatest length, then least start and period
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    rows = out.withColumn("best", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(F.encode(listed, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )
