"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, in blocks; only counts leave the tasks. A histogram over
the whole range of a query's scores shows the bin that holds its kth best; that bin is refined until
few scores lie at or above its lower edge, or it is one score wide. One more pass keeps what reaches
the edge: each task its best k of a query at most, by score and then id, which no tie can widen.

Components are floor(256 * x), x as double. Vectors that are null, or hold a null or a component that
isn't finite, take no part; nor do rows with a null vec_id. Missing components of a shorter vector
count as 0. Rows with the query's own id aren't its candidates; other repeated rows each count. Of
query rows that share an id, the one with the least vector (in the order of arrays) asks. Empty tables,
or queries without candidates, give no rows. Other columns don't matter. Scores must fit 64 bits;
components beyond that raise an error. Queries are taken in blocks of about QUERIES, so what is
broadcast and gathered on the driver has a bound; within a task they meet the vectors in tiles.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

QUERIES, BINS, ROWS, TILE, FEW = 8192, 256, 2048, 512, 64
RESULT = "query_id long, rank int, vec_id long, score long"


def vectors(batch: pa.RecordBatch, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole-numbered components of the vectors that take part."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    off = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    n = np.diff(off)
    present = ~np.asarray(lists.is_null()) & ~np.asarray(ids.is_null())
    finite = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ok = np.flatnonzero(present & (finite[off[1:]] == finite[off[:-1]]))
    dims = int(n[ok].max(initial=0)) if dims is None else dims
    out = np.zeros((len(ok), dims))
    col = np.arange(dims)
    there = col < n[ok][:, None]
    out[there] = values[(off[:-1][ok][:, None] + col)[there]]
    return np.asarray(ids.fill_null(0))[ok], np.floor(256 * out)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    if float(np.abs(q).sum(1).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53:
        return (q @ c.T).astype(np.int64)
    if float(np.abs(q).sum(1).max()) * float(np.abs(c).max()) >= 2**63:
        raise OverflowError("scores don't fit 64 bits")
    return q.astype(np.int64) @ c.astype(np.int64).T


def _parts(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield vectors(b.slice(k, ROWS), dims)


def top_k(table: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query, ties to the smaller vec_id."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    queries = rows.filter(is_query & whole & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    norm = lambda c: F.sqrt(F.aggregate(F.filter(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(0.0), lambda a, x: a + F.pow(F.lit(256.0) * x + 1, 2) + F.pow(F.lit(256.0) * x - 1, 2)))
    most = float(rows.select(norm(F.col("embedding")).alias("n")).agg(F.max("n")).first()[0] or 0)
    path = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(path)
    for block in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        ids, vecs = zip(*(vectors(b) for b in mine.to_batches()), strict=True) if mine.num_rows else ((), ())
        if not ids or not sum(map(len, ids)):
            continue
        dims = max(v.shape[1] for v in vecs)
        vecs = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for v in vecs])
        ids, at = np.unique(np.concatenate(ids), return_index=True)
        _search(rows, ids, vecs[at], most, k).write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def _search(rows: DataFrame, ids: np.ndarray, vecs: np.ndarray, most: float, k: int) -> DataFrame:
    spark = rows.sparkSession
    n, dims = vecs.shape
    bound = np.ceil(np.sqrt((vecs**2).sum(1)) * most + 1).clip(max=2.0**62).astype(np.int64)
    low, width = -bound, np.maximum(1, -(-2 * bound // BINS) + 1)
    above = np.zeros(n, np.int64)  # scores beyond the bins
    edge, open_ = low.copy(), np.ones(n, bool)
    while open_.any():
        sent = spark.sparkContext.broadcast((ids[open_], vecs[open_], low[open_], width[open_]))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, q, lo, w = sent.value
            total = np.zeros((len(own), BINS), np.int64)
            for c_ids, c in _parts(batches, dims):
                for a in range(0, len(own), TILE):
                    mine = slice(a, a + TILE)
                    bins = (scores(q[mine], c) - lo[mine, None]) // w[mine, None]
                    ok = (bins >= 0) & (bins < BINS) & (own[mine, None] != c_ids)
                    part = total[mine]
                    part += np.bincount((np.arange(len(part))[:, None] * BINS + bins)[ok], minlength=part.size).reshape(part.shape)
            q_at, b_at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(q_at, pa.int32()), pa.array(b_at, pa.int32()), pa.array(total[q_at, b_at])], ["q", "bin", "n"])

        found = rows.mapInArrow(count, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        upward = Window.partitionBy("q").orderBy(F.desc("bin"))
        at = np.flatnonzero(open_)
        wanted = spark.createDataFrame(list(zip(range(len(at)), (k - above[at]).tolist(), strict=True)), "q int, need long")
        hit = found.withColumn("up", F.sum("n").over(upward)).join(F.broadcast(wanted), "q").filter((F.col("up") >= F.col("need")) & (F.col("up") - F.col("n") < F.col("need")))
        got = {r.q: r for r in hit.collect()}
        sent.unpersist()
        for x, g in enumerate(at.tolist()):
            if x not in got:  # fewer than k candidates: all of them
                edge[g], open_[g] = np.iinfo(np.int64).min, False
                continue
            edge[g] = low[g] + got[x].bin * width[g]
            if width[g] == 1 or above[g] + got[x].up <= FEW:
                open_[g] = False
            else:
                above[g] += got[x].up - got[x].n
                low[g], width[g] = edge[g], -(-width[g] // BINS)
    sent = spark.sparkContext.broadcast((ids, vecs, edge))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, least = sent.value
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * 3  # query, score, id
        for c_ids, c in _parts(batches, dims):
            found = []
            for a in range(0, len(own), TILE):
                s = scores(q[a : a + TILE], c)
                x, y = np.nonzero((s >= least[a : a + TILE, None]) & (own[a : a + TILE, None] != c_ids))
                found.append((x + a, s[x, y], c_ids[y]))
            best = [np.concatenate((b, *(f[j] for f in found))) for j, b in enumerate(best)]
            order = np.lexsort((best[2], -best[1], best[0]))
            best = [b[order] for b in best]
            first = np.searchsorted(best[0], best[0])
            best = [b[np.arange(len(first)) - first < k] for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(own[best[0]]), pa.array(best[2]), pa.array(best[1])], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = rows.mapInArrow(keep, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order))
    return kept.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
