"""Chunks of documents that ask buckets of values which values other chunks hold too.

Documents are dealt into chunks of bounded size by a hash of their id and text, so a group of copies, a
source with a third of all rows, or very many rows without an id spread evenly; only rows that repeat
in both share a chunk. A chunk sends each value once, whatever the number of its documents that hold
it; a bucket owns a range of values and answers each chunk that asked. So a value that very many
documents share costs one entry a chunk, and neither a task nor the driver ever gathers the documents
of a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, pack, total_bytes, unpack

ASKED = "bucket int, chunk int, blob binary"
ANSWER = "chunk int, blob binary"


def chunked(docs: DataFrame, chunk_bytes: int, *by: str) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text, carried) and the bytes of text; carried holds the other columns as a struct, or nothing. Rows are dealt by the columns named, doc_id and text by default."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)
    rows = id_and_text(docs, carried.alias("carried"))
    size, _ = total_bytes(rows)
    return rows.withColumn("chunk", F.pmod(F.xxhash64(*(by or ("doc_id", "text"))), F.lit(max(1, math.ceil(size / chunk_bytes)))).cast("int")), size


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def rows_of(schema: list[str], *columns) -> pa.Table:
    kinds = {"chunk": pa.int32(), "bucket": pa.int32(), "blob": pa.binary()}
    return pa.table({n: pa.array(c, kinds[n]) for n, c in zip(schema, columns, strict=True)})


def ask(chunk: int, buckets: int, high: np.ndarray, low: np.ndarray, doc: np.ndarray, least_wanted: bool = True) -> pa.Table:
    """The distinct values of a chunk with the least document (0 if it isn't wanted) and the number of documents of each. (value, doc) pairs must be distinct."""
    order = np.lexsort((low, high))
    high, low, doc = high[order], low[order], doc[order]
    first = np.ones(len(high), bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(first)
    least = np.minimum.reduceat(doc, at) if len(at) and least_wanted else np.zeros(len(at), np.int64)
    count = np.diff(np.append(at, len(high))).astype(np.uint32)
    high, low = high[at], low[at]
    ends = np.searchsorted(bucket_of(high, buckets), np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(ends))
    blobs = [pack(np.diff(high[a:b], prepend=np.uint64(0)), low[a:b], least[a:b], count[a:b]) for a, b in zip(ends[some], ends[some + 1], strict=True)]
    return rows_of(["bucket", "chunk", "blob"], some, [chunk] * len(some), blobs)


def answer(least_docs: int) -> Callable[[pa.Table], pa.Table]:
    """To each chunk of a bucket: the values that it holds and that at least so many documents hold, with their least document and in how many chunks they are."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in rows.column("blob").to_pylist()]
        chunk = np.repeat(rows.column("chunk").to_numpy(), [len(p[0]) for p in parts])
        high = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        low, doc, count = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        order = np.lexsort((low, high))
        first = np.ones(len(order), bool)
        h, w = high[order], low[order]
        first[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        at, group = np.flatnonzero(first), np.cumsum(first) - 1
        held = np.add.reduceat(count[order].astype(np.int64), at) >= least_docs
        least = np.minimum.reduceat(doc[order], at)
        chunks = np.diff(np.append(at, len(order))).astype(np.uint32)
        yes = held[group]
        order, group = order[yes], group[yes]
        by = np.argsort(chunk[order], kind="stable")
        order, group = order[by], group[by]
        to, start = np.unique(chunk[order], return_index=True)
        ends = np.append(start, len(order))
        return rows_of(["chunk", "blob"], to, [pack(high[o := order[a:b]], low[o], least[group[a:b]], chunks[group[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)])

    return run


def told(blobs: pa.Table) -> list[np.ndarray]:
    """All answers to a chunk together: high, low, least document, chunks."""
    parts = [unpack(b) for b in blobs.column("blob").to_pylist()]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.uint64, np.uint64, np.uint64, np.uint32))]
