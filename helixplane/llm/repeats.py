"""Passages that start in an earlier document too: removal of every unit that such a window covers.

Units are words (substring dedup) or bytes (suffix-array dedup). A document's consecutive windows of k
units that share a minimiser, the least hash of the m-grams in a window, form a super-k-mer.

1. Each chunk of documents sends the distinct minimisers of its super-k-mers to buckets. A minimiser
   that only one document holds proves that no window of its super-k-mers is in another document.
2. Super-k-mers of the other minimisers travel, packed as strings, to the bucket of their minimiser.
   A chunk sends a string once, with the least and the greatest of its documents that hold it; where it
   occurs stays in the chunk. Where a minimiser is in over `hot_chunks` chunks, its windows go to the
   buckets of their own hashes instead: an exact way to split what one bucket couldn't hold.
3. A bucket takes its minimisers in blocks of bounded size: it sorts the windows of all distinct strings
   of a block, so that equal windows meet, exactly, and tells each chunk the least document of those
   windows of a string that an earlier document has.
4. Chunks remove what these windows cover, in every document after the least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_KEYS, gram_hash, hand_back, mix, pack, prefix_hash, ranges, real_id, sliding_min, span_hash, span_slices, take_spans, texts_of, unpack, words
from .exchange import ANSWER, ASKED, answer, ask, bucket_of, chunked, rows_of, told

#: Most windows of a super-k-mer (longer runs, of periodic text, are cut), and windows that are sorted in one block, unless one minimiser has more.
LONGEST, SORTED = 256, 150_000
#: Bytes of text whose windows are worked out at a time, unless one text is longer.
AT_ONCE = 1 << 19
#: Returns for each of all windows (fragment by fragment) a number that equal windows share.
Sorter = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


class Chunk:
    """Some texts of a chunk as units."""

    def __init__(self, t: pa.Table, unit: str):
        self.ids = t.column("doc_id").to_numpy()
        data, off = texts_of(t.column("text"))
        keys = BYTE_KEYS[data]
        if unit == "byte":
            self.first, self.hash, self.bytes, self.at = off, prefix_hash(keys), data, np.arange(len(data) + 1)
        else:
            start, end, self.first = words(data, off)
            self.hash = prefix_hash(span_hash(prefix_hash(keys), start, end))
            n = end - start
            self.at = np.concatenate(([0], np.cumsum(n + 1)))
            self.bytes = np.full(self.at[-1], 0x20, np.uint8)
            take_spans(data, start, n, self.bytes, self.at[:-1])

    def windows(self, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and minimiser of each window."""
        n = np.maximum(np.diff(self.first) - k + 1, 0)
        start = ranges(self.first[:-1], n)
        return np.repeat(np.arange(len(n)), n), start, sliding_min(gram_hash(self.hash, m), k - m + 1)[start]


def _blocks(t: pa.Table, unit: str) -> Iterator[tuple[int, Chunk]]:
    """A chunk's rows, in an order that doesn't depend on that of arrival, some at a time, with the number of the first."""
    t = t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")]))
    for s in span_slices(np.diff(texts_of(t.column("text"))[1]), AT_ONCE):
        yield s.start, Chunk(t.slice(s.start, s.stop - s.start), unit)


def _runs(*same: np.ndarray) -> np.ndarray:
    """Where a run of equal entries begins."""
    new = np.ones(len(same[0]), bool)
    if len(new):
        new[1:] = False
        for a in same:
            new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def _spread(least: np.ndarray) -> np.ndarray:
    """Minimisers are small hashes, by choice; their buckets need even ones. 48 bits travel: strings are compared in any case."""
    return mix(least ^ np.uint64(0x3C6EF372FE94F82B)) & ~np.uint64(0xFFFF)


def _emit_minimisers(unit: str, k: int, m: int, buckets: int) -> Callable:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        hand_back()
        found = []
        for _, c in _blocks(t, unit):
            row, _, least = c.windows(k, m)
            at = _runs(row, least)
            found.append((c.ids[row[at]], _spread(least[at])))
        doc, least = (np.concatenate([f[j] for f in found]) for j in range(2))
        order = np.lexsort((doc, least))
        order = order[_runs(doc[order], least[order])]
        return ask(key[0].as_py(), buckets, least[order], np.zeros(len(order), np.uint64), doc[order], least_wanted=False)

    return run


def _emit_fragments(unit: str, k: int, m: int, buckets: int, hot_chunks: int) -> Callable:
    def run(key: tuple, t: pa.Table, blobs: pa.Table) -> pa.Table:
        hand_back()
        shared, _, _, chunks = told(blobs)
        me = key[0].as_py()
        if not len(shared):
            return rows_of(["bucket", "chunk", "blob"], [], [], [])
        order = np.argsort(shared)
        shared, hot = shared[order], chunks[order] > hot_chunks
        found = []
        for first_row, c in _blocks(t, unit):
            row, start, least = c.windows(k, m)
            at = _runs(row, least)
            n, value = np.diff(np.append(at, len(start))), _spread(least[at])
            place = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
            held = np.flatnonzero(shared[place] == value)
            a, row, n, value, split = start[at[held]], row[at[held]], n[held], value[held], hot[place[held]]
            if split.any():
                w = ranges(a[split], n[split])
                a, row = np.concatenate((a[~split], w)), np.concatenate((row[~split], np.repeat(row[split], n[split])))
                value, n = np.concatenate((value[~split], span_hash(c.hash, w, w + k))), np.concatenate((n[~split], np.ones(len(w), np.int64)))
            pieces = -(-n // LONGEST)
            cut = ranges(np.zeros(len(n), np.int64), pieces) * LONGEST
            a, row, value, n = np.repeat(a, pieces) + cut, np.repeat(row, pieces), np.repeat(value, pieces), np.minimum(np.repeat(n, pieces) - cut, LONGEST)
            begin, end = c.at[a], c.at[a + n + k - 1] - (unit == "word")
            found.append((value, span_hash(c.hash, a, a + n + k - 1), n, c.ids[row], first_row + row, a - c.first[row], end - begin, take_spans(c.bytes, begin, end - begin)))
        value, content, n, doc, row, start, size, data = (np.concatenate([f[j] for f in found]) for j in range(8))
        del found
        at = np.cumsum(size) - size
        number = _distinct(value, content, size, at, data)
        order = np.argsort(number, kind="stable")
        g = _runs(number[order])
        least, greatest = (f.reduceat(doc[order], g) if len(g) else doc for f in (np.minimum, np.maximum))
        first = order[g]
        bucket = bucket_of(value[first], buckets)
        some = _runs(bucket)
        ends, out = np.append(some, len(g)), []
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            i = first[x:y]
            out.append(pack(np.array([x], np.uint32), np.diff(value[i], prepend=np.uint64(0)), n[i].astype(np.uint16), size[i].astype(np.uint32), take_spans(data, at[i], size[i]), least[x:y], greatest[x:y] - least[x:y]))
        # where the strings are stays with the chunk: a note to itself, by a bucket of its own
        out.append(pack(np.diff(np.append(g, len(order))).astype(np.uint32), row[order].astype(np.uint32), start[order].astype(np.uint32)))
        return rows_of(["bucket", "chunk", "blob"], np.append(bucket[some], buckets + me), [me] * len(out), out)

    return run


def _distinct(value: np.ndarray, content: np.ndarray, size: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A number for each fragment, the same for the same bytes under the same minimiser; hashes only propose."""
    order = np.lexsort((size, content, value))
    g = _runs(value[order], content[order], size[order])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(g)), np.diff(np.append(g, len(order))))
    first = order[g][number]
    other = np.flatnonzero(first != np.arange(len(order)))
    if len(other):
        same = np.empty(len(other), bool)
        for s in span_slices(size[other], 1 << 18):
            x, y = other[s], first[other[s]]
            equal = data[ranges(at[x], size[x])] == data[ranges(at[y], size[x])]
            same[s] = np.logical_and.reduceat(equal, np.cumsum(size[x]) - size[x])
        bad = other[~same]
        names: dict = {}
        for k in bad:  # two texts with equal hashes
            number[k] = len(g) + names.setdefault((number[k], data[at[k] : at[k] + size[k]].tobytes()), len(names))
    return np.unique(number, return_inverse=True)[1]


def _settle(k: int, sort: Sorter, buckets: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return rows.select(["chunk", "blob"])
        hand_back()
        parts = [unpack(b) for b in rows.column("blob").to_pylist()]
        chunk = np.repeat(rows.column("chunk").to_numpy(), [len(p[1]) for p in parts])
        string = np.concatenate([p[0][0] + np.arange(len(p[1]), dtype=np.uint32) for p in parts])
        value = np.concatenate([np.cumsum(p[1], dtype=np.uint64) for p in parts])
        n, size, least, more = (np.concatenate([p[j] for p in parts]).astype(np.int64) for j in (2, 3, 5, 6))
        data = np.concatenate([p.pop(4) for p in parts])
        del parts
        at = np.cumsum(size) - size
        order = np.argsort(value, kind="stable")
        g = _runs(value[order])
        ends, out = np.append(g, len(order)), []
        for keys in span_slices(np.add.reduceat(n[order], g), SORTED):  # blocks of whole minimisers
            mine = order[ends[keys.start] : ends[keys.stop]]
            out.append(_block(k, sort, value[mine], n[mine], least[mine], least[mine] + more[mine], size[mine], take_spans(data, at[mine], size[mine])))
            out[-1][0] = mine[out[-1][0]]
        which, offset, run, first = (np.concatenate([o[j] for o in out]) for j in range(4))
        by = np.argsort(chunk[which], kind="stable")
        which, offset, run, first = which[by], offset[by], run[by], first[by]
        to = _runs(chunk[which])
        ends = np.append(to, len(which))
        return rows_of(["chunk", "blob"], chunk[which][to], [pack(string[which[x:y]], offset[x:y].astype(np.uint16), run[x:y].astype(np.uint16), first[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)])

    return run


def _block(k: int, sort: Sorter, value: np.ndarray, n: np.ndarray, least: np.ndarray, greatest: np.ndarray, size: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Runs of the strings' windows that a document before the string's last one has too: string, first window, windows, least document. Windows of distinct strings are sorted."""
    at = np.cumsum(size) - size
    number = _distinct(value, span_hash(prefix_hash(BYTE_KEYS[data]), at, at + size), size, at, data)
    count = int(number.max()) + 1
    rep = np.zeros(count, np.int64)
    rep[number] = np.arange(len(number))
    held = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(held, number, least)
    local = np.cumsum(size[rep]) - size[rep]
    same = sort(take_spans(data, at[rep], size[rep]), local, size[rep], n[rep], k)
    first = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, same, np.repeat(held, n[rep]))
    first = first[same]
    begins = np.cumsum(n[rep]) - n[rep]
    first = first[ranges(begins[number], n)]
    which, offset = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
    yes = np.flatnonzero(first < greatest[which])
    which, offset, first = which[yes], offset[yes], first[yes]
    s = _runs(which, offset - np.arange(len(offset)), first)
    return [which[s], offset[s], np.diff(np.append(s, len(which))), first[s]]


def _remove(unit: str, k: int) -> Callable:
    def run(t: pa.Table, blobs: pa.Table) -> pa.Table:
        hand_back()
        parts = [unpack(b) for b in blobs.column("blob").to_pylist()]
        own, says = [p for p in parts if len(p) == 3], [p for p in parts if len(p) == 4]
        row = start = n = np.zeros(0, np.int64)
        if says:
            occurs, row, start = (x.astype(np.int64) for x in own[0])
            string, offset, n, least = (np.concatenate([p[j] for p in says]).astype(np.int64) for j in range(4))
            times, begins = occurs[string], (np.cumsum(occurs) - occurs)[string]
            at = ranges(begins, times)
            row, start, n, least = row[at], start[at] + np.repeat(offset, times), np.repeat(n, times), np.repeat(least, times)
            later = np.flatnonzero(least < np.sort(t.column("doc_id").to_numpy())[row])
            later = later[np.argsort(row[later], kind="stable")]
            row, start, n = row[later], start[later], n[later]
        out = []
        for base, c in _blocks(t, unit):
            mine = slice(*np.searchsorted(row, (base, base + len(c.ids))))
            out.append(_kept(c, unit, row[mine] - base, start[mine], n[mine] + k - 1))
        return pa.concat_tables(out)

    return run


def _kept(c: Chunk, unit: str, row: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Table:
    """What stays of some texts without the spans of n units from start."""
    total, first = int(c.first[-1]), c.first
    begin = first[row] + start
    gone = np.cumsum(np.bincount(begin, minlength=total + 1) - np.bincount(begin + n, minlength=total + 1))[:-1] > 0
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    inner = first[:-1][first[:-1] < total]
    opens[inner] = gone[inner]
    units = np.diff(c.at)
    stay = np.repeat(~gone, units)
    kept, ends = c.bytes[stay], np.concatenate(([0], np.cumsum(units * ~gone)))[first]
    if unit == "word":  # without the space after the last word
        tail = np.flatnonzero(np.diff(ends))
        kept = np.delete(kept, ends[1:][tail] - 1)
        ends = ends - np.concatenate(([0], np.cumsum(np.diff(ends) > 0)))
    text = pa.Array.from_buffers(pa.binary(), len(c.ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])
    return pa.table({"doc_id": pa.array(c.ids), "kept": text, "n_units": pa.array(np.diff(first)), "n_removed": pa.array(sums(gone)), "n_spans": pa.array(sums(opens))})


def remove_repeats(docs: DataFrame, unit: str, k: int, m: int, sort: Sorter, chunk_bytes: int, bucket_bytes: int, hot_chunks: int) -> DataFrame:
    """doc_id, kept (binary), n_units, n_removed, n_spans (maximal removed runs)."""
    rows, size = chunked(docs.select("doc_id", "text"), chunk_bytes)
    rows = rows.select("chunk", "doc_id", "text")
    buckets = 1 + size // bucket_bytes
    by_chunk = lambda: rows.groupBy("chunk")
    asked = by_chunk().applyInArrow(_emit_minimisers(unit, k, m, buckets), ASKED)
    answers = asked.groupBy("bucket").applyInArrow(answer(2), ANSWER)
    fragments = by_chunk().cogroup(answers.groupBy("chunk")).applyInArrow(_emit_fragments(unit, k, m, buckets, hot_chunks), ASKED)
    spans = fragments.groupBy("bucket").applyInArrow(_settle(k, sort, buckets), ANSWER)
    out = by_chunk().cogroup(spans.groupBy("chunk")).applyInArrow(_remove(unit, k), "doc_id long, kept binary, n_units long, n_removed long, n_spans long")
    return out.withColumn("doc_id", real_id(F.col("doc_id")))
