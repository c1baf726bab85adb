"""Line dedup: lines that several documents hold stay only in the first of them.

Normalised lines are exploded and hashed (128 bits); distinct documents are counted per hash, within
a chunk first; lines over the threshold go, and the others are put together again by position.

Null or empty text is one empty line. A line's key is the line without white space at its ends and
with A-Z in lower case; keys of fewer than min_chars code points are never dropped. Ties don't arise:
the least doc_id keeps a line, all of its occurrences there included. Rows with a null doc_id count as
one document after all others, rows that repeat a doc_id as one document; they come out one by one.
An empty table gives an empty table; other columns, whatever their names, are carried unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import real_id
from .exchange import ANSWER, ASKED, answer, ask, chunked, told

STRIP = b" \t\n\x0b\x0c\r"
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


def _keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and the hash of each key that counts."""
    lines = text.split(b"\n")
    out: list = []
    for line in lines:
        key = line.strip(STRIP)
        n = len(key)
        if n < min_chars or (n < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key.lower()))
    return lines, out


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_dropped, carried (the other columns as a struct)."""
    # that two documents hold a line shows if a document has rows in several chunks too; greater numbers need its rows together
    rows, size = chunked(docs, CHUNK_BYTES, *(["doc_id"] if min_docs > 2 else []))
    buckets = 1 + size // BUCKET_BYTES

    def emit(key: tuple, t: pa.Table) -> pa.Table:
        ids, found, doc = t.column("doc_id").to_pylist(), [], []
        seen: dict[int, set] = {}
        for d, text in zip(ids, t.column("text").cast(pa.binary()).to_pylist(), strict=True):
            own = seen.setdefault(d, set())
            new = {h for h in _keys(text, min_chars)[1] if h is not None} - own
            own |= new
            found += new
            doc += [d] * len(new)
        pairs = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        return ask(key[0].as_py(), buckets, pairs[:, 0].copy(), pairs[:, 1].copy(), np.array(doc, np.int64))

    def apply(t: pa.Table, blobs: pa.Table) -> pa.Table:
        high, low, least, _ = told(blobs)
        digests = np.column_stack((high, low)).astype("<u8").tobytes()
        keeper = {digests[16 * k : 16 * k + 16]: d for k, d in enumerate(least.tolist())}
        texts, n_lines, n_dropped = [], [], []
        for d, text in zip(t.column("doc_id").to_pylist(), t.column("text").cast(pa.binary()).to_pylist(), strict=True):
            lines, hashes = _keys(text, min_chars)
            stay = [x for x, h in zip(lines, hashes, strict=True) if keeper.get(h, d) == d]
            texts.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        return pa.table({"doc_id": t.column("doc_id"), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "carried": t.column("carried")})

    asked = rows.select("chunk", "doc_id", "text", "carried").groupBy("chunk").applyInArrow(emit, ASKED)
    answers = asked.groupBy("bucket").applyInArrow(answer(min_docs), ANSWER)
    kinds = T.StructType.fromDDL("doc_id long, text string, n_lines long, n_dropped long").add("carried", rows.schema["carried"].dataType)
    out = rows.select("chunk", "doc_id", "text", "carried").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, kinds)
    return out.withColumn("doc_id", real_id(F.col("doc_id")))


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
