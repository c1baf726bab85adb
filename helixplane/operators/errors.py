"""Sequencing errors: counts by mate, strand, quality and position, and a model of their frequencies."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the fit
LEAST_OBSERVATIONS, LEAST_PROBABILITY = 10, 1e-4
KEYS = ["mate", "strand", "qual", "pos"]
#: Reads whose cells are summed up at a time.
AT_ONCE = 500


def counts(best: DataFrame) -> DataFrame:
    """(mate, strand, qual, pos, n, mm) from reads with the genome where each lies best (read, genome, quality strings); pos from 1.

    Tasks sum up what some reads have in each cell before cells are dealt; reads whose strings aren't ASCII or differ in length go base by base.
    """
    kinds = T.StructType([*[T.StructField(c, best.schema[c].dataType) for c in ("mate", "strand")], T.StructField("qual", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("mm", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, AT_ONCE):
                yield from _summed(b.slice(low, AT_ONCE), kinds.names)

    cells = best.select("mate", "strand", "read", "genome", "quality").mapInArrow(run, kinds)
    return cells.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("mm").alias("mm"))


def _summed(b: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Cells of a batch of reads."""
    plain, other = [], {}
    for i, (mate, strand, *texts) in enumerate(zip(*(b.column(c).to_pylist() for c in ("mate", "strand", "read", "genome", "quality")), strict=True)):
        if any(x is None for x in texts):
            continue
        if mate is not None and strand is not None and len({*map(len, texts)}) == 1 and all(x.isascii() for x in texts):
            plain.append(i)
            continue
        for pos, (x, g, q) in enumerate(itertools.zip_longest(*texts), 1):
            cell = other.setdefault((mate, strand, None if q is None else ord(q), pos), [0, 0])
            cell[0] += 1
            cell[1] += x is not None and g is not None and x != g
    if other:
        columns = zip(*((*key, *sums) for key, sums in other.items()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (b.column("mate").type, b.column("strand").type, pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names)
    b = b.take(pa.array(plain, pa.int64()))
    read, genome, quality = (np.frombuffer("".join(b.column(c).to_pylist()).encode(), np.uint8) for c in ("read", "genome", "quality"))
    if not len(read):
        return
    size = np.array([len(x) for x in b.column("read").to_pylist()])
    pos = np.arange(len(read)) - np.repeat(np.cumsum(size) - size, size)
    mate, strand = (b.column(c).dictionary_encode() for c in ("mate", "strand"))
    group = np.repeat(mate.indices.to_numpy().astype(np.int64) * len(strand.dictionary) + strand.indices.to_numpy(), size)
    cell, at, n = np.unique((group * 256 + quality) * int(size.max()) + pos, return_inverse=True, return_counts=True)
    wrong = np.bincount(at[read != genome], minlength=len(cell))
    group, pos = np.divmod(cell, size.max())
    group, qual = np.divmod(group, 256)
    m, s = np.divmod(group, len(strand.dictionary))
    yield pa.RecordBatch.from_arrays([mate.dictionary.take(pa.array(m)), strand.dictionary.take(pa.array(s)), pa.array(qual.astype(np.int32)), pa.array((pos + 1).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(wrong.astype(np.int64))], names)


def limits(errors: DataFrame) -> DataFrame:
    return errors.groupBy("mate", "strand").agg(F.min("qual").alias("min_qual"), F.max("qual").alias("max_qual"), F.max("pos").alias("max_pos"), F.sum("n").alias("n"), F.sum("mm").alias("mm"))


#: Pieces of the splines of quality and position; weights of the penalty that are tried; most rounds.
KNOTS, PENALTIES, ROUNDS = 8, tuple(10.0**e for e in range(-2, 5)), 25


def splines(x: np.ndarray, low: float, high: float, pieces: int = KNOTS) -> np.ndarray:
    """Cubic B-splines over [low, high] cut into so many equal pieces: pieces + 3 columns that sum to 1."""
    step = (high - low) / pieces
    t = (np.clip(x, low, high) - low) / step if step else np.zeros(len(x))
    at = np.minimum(t.astype(np.int64), pieces - 1)
    u = t - at
    parts = ((1 - u) ** 3 / 6, (3 * u**3 - 6 * u**2 + 4) / 6, (-3 * u**3 + 3 * u**2 + 3 * u + 1) / 6, u**3 / 6)
    out = np.zeros((len(x), pieces + 3))
    for k, part in enumerate(parts):
        out[np.arange(len(x)), at + k] = part
    return out


def _design(qual: np.ndarray, pos: np.ndarray, ends: tuple[float, float, float, float]) -> np.ndarray:
    """A spline of the position and one of the quality; the latter's first column is left out, as both sum to 1."""
    return np.column_stack((splines(pos.astype(float), ends[2], ends[3]), splines(qual.astype(float), ends[0], ends[1])[:, 1:]))


def _penalty() -> np.ndarray:
    """Second differences of neighbouring coefficients, and a little of all of them."""
    n, m = KNOTS + 3, KNOTS + 2
    d, e = np.diff(np.eye(n), 2, axis=0), np.diff(np.eye(m + 1), 2, axis=0)[:, 1:]
    out = 1e-6 * np.eye(n + m)
    out[:n, :n] += d.T @ d
    out[n:, n:] += e.T @ e
    return out


def _solved(sums: np.ndarray, cells: float) -> np.ndarray:
    """Coefficients from the sums of a round (x'wx, x'wz, z'wz), with the penalty that generalised cross-validation likes best."""
    xx, xz, zz = sums[:-1, :-1], sums[:-1, -1], sums[-1, -1]
    best, out = np.inf, xz
    for weight in PENALTIES:
        both = xx + weight * _penalty()
        beta = np.linalg.solve(both, xz)
        free = cells - np.trace(np.linalg.solve(both, xx))
        score = max(zz - 2 * beta @ xz + beta @ xx @ beta, 0) * cells / max(free, 1e-3) ** 2
        if score < best:
            best, out = score, beta
    return out


def _rates(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ beta).clip(-25, 25)))


def fit(errors: DataFrame) -> DataFrame:
    """(mate, strand, qual, pos, p): a binomial regression (logit) on penalised splines of position and quality, a fit for each mate and strand; p is floored, and cells with few observations keep their own rate.

    Reweighted least squares: in each round tasks sum up what their cells add to the normal equations, and the driver solves one small
    system a group (mates and strands: four). The table of cells is spread as it is: no group sits in one task.
    """
    cells = errors.select(*KEYS, F.col("n").cast("double").alias("n"), F.col("mm").cast("double").alias("mm")).checkpoint()
    groups = cells.groupBy("mate", "strand").agg(F.min("qual").alias("q0"), F.max("qual").alias("q1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"), F.sum("n").alias("n"), F.sum("mm").alias("mm"), F.count(F.lit(1)).alias("cells")).collect()
    ends = {(r.mate, r.strand): (float(r.q0), float(r.q1), float(r.p0), float(r.p1)) for r in groups}
    size = 2 * KNOTS + 5
    rate = {(r.mate, r.strand): (r.mm + 0.5) / (r.n + 1) for r in groups}
    beta = {k: np.concatenate((np.full(KNOTS + 3, np.log(p / (1 - p))), np.zeros(KNOTS + 2))) for k, p in rate.items()}

    def sums(now: dict) -> dict:
        """x'wx, x'wz and z'wz of each group."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict = {}
            for b in batches:
                for key, own in b.groupby(["mate", "strand"]):
                    x = _design(own["qual"].to_numpy(), own["pos"].to_numpy(), ends[key])
                    n, k = own["n"].to_numpy(), own["mm"].to_numpy()
                    p = _rates(x, now[key])
                    w = n * p * (1 - p) + 1e-9
                    both = np.column_stack((x, (x @ now[key]).clip(-25, 25) + ((k - n * p) / w).clip(-4, 4)))  # a step at a time
                    total[key] = total.get(key, 0) + both.T @ (w[:, None] * both)
            yield pd.DataFrame([(m, s, v.ravel().tolist()) for (m, s), v in total.items()], columns=["mate", "strand", "sums"])

        # one small matrix a task and group
        out: dict = {}
        for r in cells.mapInPandas(run, "mate int, strand string, sums array<double>").collect():
            out[r.mate, r.strand] = out.get((r.mate, r.strand), 0) + np.array(r.sums).reshape(size + 1, size + 1)
        return out

    for _ in range(ROUNDS if groups else 0):
        found = sums(beta)
        after = {k: _solved(found[k], next(float(r.cells) for r in groups if (r.mate, r.strand) == k)) for k in beta}
        change = max(np.abs(after[k] - beta[k]).max() for k in beta)
        beta = after
        if change < 1e-4:
            break

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.zeros(len(b))
            for key, rows in b.groupby(["mate", "strand"]).indices.items():
                own = b.iloc[rows]
                p[rows] = _rates(_design(own["qual"].to_numpy(), own["pos"].to_numpy(), ends[key]), beta[key])
            dense = (b["n"] >= LEAST_OBSERVATIONS).to_numpy()
            yield b[KEYS].assign(p=np.where(dense, np.maximum(p, LEAST_PROBABILITY), b["mm"] / (b["n"] + 0.01)))

    return cells.mapInPandas(fitted, "mate int, strand string, qual int, pos int, p double")
