"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Texts are cut into pieces by the vocabulary's pattern; distinct pieces go, by length, into padded
numpy matrices of token ids. In each round every row merges its leftmost pair of least rank; pair
ranks come from a hash table with open addressing, rows without a pair leave the matrix, and the
columns close up. Nothing is shuffled: an encoder of fixed size (the vocabulary) is broadcast.

Null text is empty text: no ids, no bytes. A null doc_id stays null. Texts of any length are encoded
whole; pieces of over LONG bytes merge all occurrences of the least pair in one round where no pair
that a merge makes can have a smaller rank, which gives the same ids. Repeated rows give repeated
results, an empty table an empty one; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ranges

NONE = np.int32(2**31 - 1)
LONG = 128
#: Pieces whose ids a worker remembers, and characters of text that it works on at a time.
REMEMBERED, AT_ONCE = 500_000, 1 << 20


class Encoder:
    def __init__(self, file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.split = regex.compile(pattern)
        n = max(self.ranks.values()) + 1
        self.byte = np.array([self.ranks.get(bytes([b]), NONE) for b in range(256)], np.int32)
        tokens = [b""] * n
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        left, right, rank = [], [], []
        for t, r in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        least = np.full(n, NONE, np.int64)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        #: Merging into token r makes no pair of a smaller rank.
        self.safe = least > np.arange(n)
        size = 1 << max(4, int(3 * len(rank)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, todo = mix(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of two that want a slot, the last has it
            had = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[had]]] = rank[todo[had]]
            todo = todo[~had]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        byte = np.repeat(self.byte, 256), np.tile(self.byte, 256)
        self.byte_pairs = self.pair_rank(*byte).reshape(256, 256)
        self.index: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.index.clear()
        self.pool, self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE; NONE as left or right stands for no token."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = mix(key) & self.mask
        got = self.keys[slot]
        out = np.where(got == key, self.values[slot], NONE)
        todo = np.flatnonzero((got != key) & (got != np.uint64(2**64 - 1)))
        at = np.unravel_index(todo, key.shape) if key.ndim > 1 else (todo,)
        slot, key = slot[at], key[at]
        while len(slot):
            slot = (slot + np.uint64(1)) & self.mask
            got = self.keys[slot]
            hit = got == key
            out[tuple(a[hit] for a in at)] = self.values[slot[hit]]
            on = ~hit & (got != np.uint64(2**64 - 1))
            at, slot, key = tuple(a[on] for a in at), slot[on], key[on]
        return out

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of like length; one merge a row and round."""
        lens = np.array([len(p) for p in pieces])
        width = int(lens.max())
        ids = np.full((len(pieces), width + 1), NONE, np.int32)
        ids[np.arange(width + 1) < lens[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        row, out = np.arange(len(pieces)), [None] * len(pieces)
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        rank = np.full((len(pieces), width), NONE, np.int32)
        inner = np.arange(width) < lens[:, None] - 1
        follows = np.ones(len(raw), bool)
        follows[np.cumsum(lens) - 1] = False
        first = np.flatnonzero(follows)
        rank[inner] = self.byte_pairs[raw[first], raw[first + 1]]
        while len(row):
            j = rank.argmin(1)
            k = np.arange(len(row))
            least = rank[k, j]
            if (done := least == NONE).any():
                for x in np.flatnonzero(done):
                    out[row[x]] = ids[x][ids[x] != NONE]
                go = np.flatnonzero(~done)
                row, ids, rank, j, least = row[go], ids[go], rank[go], j[go], least[go]
                if not len(row):
                    break
                k = np.arange(len(row))
            ids[k, j] = least
            stay = np.ones(ids.shape, bool)
            stay[k, j + 1] = False
            ids = ids[stay].reshape(len(row), -1)
            if ids.shape[1] == 1:
                rank = np.full((len(row), 1), NONE, np.int32)
                continue
            stay = stay[:, :-1]
            stay[k, j] = False
            stay[k[j + 1 < stay.shape[1]], j[j + 1 < stay.shape[1]] + 1] = True
            rank = rank[stay].reshape(len(row), -1)
            here = j < rank.shape[1]
            left = j > 0
            a = np.concatenate((k[here], k[left]))
            b = np.concatenate((j[here], j[left] - 1))
            rank[a, b] = self.pair_rank(ids[a, b], ids[a, b + 1])
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            rank = self.pair_rank(ids[:-1], ids[1:])
            if (least := rank.min()) == NONE:
                break
            at = np.flatnonzero(rank == least)
            if self.safe[least]:
                first = np.concatenate(([True], np.diff(at) > 1))
                run = np.cumsum(first) - 1
                at = at[(np.arange(len(at)) - np.flatnonzero(first)[run]) % 2 == 0]
            else:
                at = at[:1]
            ids = ids.copy()
            ids[at] = least
            ids = np.delete(ids, at + 1)
        return ids

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[k] = np.array([r], np.int32)
            elif len(p) > LONG:
                out[k] = self._long(p)
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(k)
        for which in buckets.values():
            for k, ids in zip(which, self._matrix([pieces[k] for k in which]), strict=True):
                out[k] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        cut = [self.split.findall(t) for t in texts]
        if len(self.index) > REMEMBERED:
            self.forget()
        flat = list(itertools.chain.from_iterable(cut))
        if new := list(set(flat) - self.index.keys()):
            ids = self.pieces([p.encode() for p in new])
            lens = np.array([len(x) for x in ids], np.int64)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.at = np.concatenate((self.at, len(self.pool) + np.cumsum(lens) - lens))
            self.len = np.concatenate((self.len, lens))
            self.pool = np.concatenate((self.pool, *ids))
        counts = np.array([len(c) for c in cut], np.int64)
        which = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        lens = self.len[which]
        ends = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], np.cumsum(counts)))]
        return self.pool[ranges(self.at[which], lens)], np.diff(ends)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after the other, and how many each has."""
        lens = self.token_len[ids]
        ends = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], np.cumsum(counts)))]
        return self.token_bytes[ranges(self.token_at[ids], lens)], np.diff(ends)


@functools.lru_cache(2)
def encoder(file: bytes, pattern: str) -> Encoder:
    return Encoder(file, pattern)


def some(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of neighbours of at most so much in sum, or of one."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *more: str) -> DataFrame:
    """doc_id, ids (array of int) of the whole text, and decoded (binary), the bytes of these ids; other columns if asked for."""
    with open(ranks_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file.value, pattern)
        for batch in batches:
            for part in some(batch.column("n").to_pylist(), AT_ONCE):
                rows = batch.slice(part.start, part.stop - part.start)
                ids, counts = enc.encode(rows.column("text").to_pylist())
                raw, sizes = enc.decode(ids, counts)
                offsets = lambda x: np.concatenate(([0], np.cumsum(x))).astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets(sizes)), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets(counts)), pa.array(ids, pa.int32())), decoded, *map(rows.column, more)], ["doc_id", "ids", "decoded", *more])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).alias("n"), *more)
    return rows.mapInArrow(run, ", ".join(["doc_id long, ids array<int>, decoded binary", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)]))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        *more,
    )
