"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
import weakref

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id sorts after every id; all rows without an id count as one document.
NO_ID = (1 << 63) - 1

_SEED = np.random.default_rng(20240601)
BYTE_KEYS = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir or setCheckpointDir() names it."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return d


def hand_back() -> None:
    """Hands freed memory back: Python workers live long, and what one group needed would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[id(out)] = (weakref.ref(out), path)
    return out


_folders: dict[int, tuple] = {}


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of materialise()'s frames, which nothing may read any more."""
    for df in frames:
        ref, path = _folders.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (null: NO_ID) and text (null: empty); other columns, of whatever name, are left out unless asked for."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def real_id(c) -> object:
    return F.when(c == NO_ID, F.lit(None).cast("long")).otherwise(c)


def total_bytes(docs: DataFrame) -> tuple[int, int]:
    """Bytes of text and number of rows, in one pass."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return int(row["b"] or 0), int(row["n"])


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value; the bytes of equal significance lie together."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        if isinstance(a, bytes):
            out += [b"\0", len(a).to_bytes(8, "little"), a]
        else:
            a = np.ascontiguousarray(a)
            out += [bytes([a.dtype.itemsize]), len(a).to_bytes(8, "little"), a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list:
    """What pack() was given; numbers come as unsigned integers of their size."""
    b = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 2
    for _ in range(int.from_bytes(b[:2], "little")):
        size, n = b[at], int.from_bytes(b[at + 1 : at + 9], "little")
        at += 9
        if not size:
            out.append(b[at : at + n])
            at += n
        else:
            out.append(np.frombuffer(b, np.uint8, n * size, at).reshape(size, n).T.copy().view(f"<u{size}").reshape(-1) if n else np.zeros(0, f"<u{size}"))
            at += n * size
    return out


def texts_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, BASE_INV)):
            a = np.full(max(n + 1, 1 << 16), base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() takes the hash of any span."""
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][:-1], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64))


def gram_hash(h: np.ndarray, m: int) -> np.ndarray:
    """The hash of every m consecutive values."""
    n = len(h) - 1 - m + 1
    return mix((h[m:] - h[:-m]) * powers(len(h))[1][:n] + np.uint64(m)) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    if len(a) < w:
        return a[:0]
    size = 1
    while 2 * size <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    white = WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    prev = np.ones(len(data), bool)
    prev[1:] = white[:-1]
    start = np.flatnonzero(~white & (prev | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = white[1:]
    end = np.flatnonzero(~white & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the next."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, length)


def span_slices(size: np.ndarray, most: int) -> list[slice]:
    """Slices of neighbouring spans of about so much in sum."""
    ends = np.cumsum(size)
    out, low = [], 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        out.append(slice(low, high))
        low = high
    return out


def take_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, into: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """The spans of data, one after the other, or at the given places of another array; the index of few of them is in memory at a time."""
    out = np.empty(int(size.sum()), data.dtype) if into is None else into
    done = 0
    for s in span_slices(size, 1 << 18):
        part = data[ranges(start[s], size[s])]
        if at is None:
            out[done : done + len(part)] = part
        else:
            out[ranges(at[s], size[s])] = part
        done += len(part)
    return out
