"""Scores and thresholds under an estimated error model: frequencies (mate, strand, qual, pos, p), pos from 1 along the read."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixplane.functions.quality import LEAST_ERROR, LOG10_3, N_SCORE
from helixplane.functions.sequence import MOST_PACKED, pack, packed_mismatches, reverse_complement
from helixplane.functions.stats import estimated_thresholds

from . import errors
from .sampling import uniform
from .search import MOST_BROADCAST, MOST_CHANGES, aligned, both_strands, piece_size


def best_hits(candidates: DataFrame, reads: DataFrame, contigs: DataFrame, size: int | None = None) -> DataFrame:
    """(mate, strand, read, genome, quality) of each read's best candidate, along the read; ties by a hash of the place."""
    size = piece_size(reads) if size is None else size
    order = Window.partitionBy("read_id", "mate").orderBy(F.desc("penalty"), F.pmod(F.col("start") * 7919 + F.col("chr") * 104_729, F.lit(1_000_003)), "chr", "start", "strand")
    best = candidates.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    rows = aligned(best, contigs, size).join(reads.select("read_id", "mate", "seq", "qual"), ["read_id", "mate"])
    place = F.col("genome")
    return rows.select("mate", "strand", F.upper("seq").alias("read"), F.when(F.col("strand") == "+", place).otherwise(reverse_complement(place)).alias("genome"), F.col("qual").alias("quality")).filter("genome is not null")


def learn(candidates: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Frequencies from a first mapping."""
    return errors.fit(errors.counts(best_hits(candidates, reads, contigs)))


def penalties(reads: DataFrame, frequencies: DataFrame, default: float = 0.01) -> DataFrame:
    """(read_id, mate, strand, good, bad, mean, variance): each read's scores of a match and a mismatch along the read, for either strand, and its score's moments."""
    cells = reads.select("read_id", "mate", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), F.posexplode(F.filter(F.split("qual", ""), lambda q: q != "")).alias("i", "q"))
    cells = cells.select("read_id", "mate", "strand", (F.col("i") + 1).alias("pos"), F.ascii("q").alias("qual"))
    # a cell for each mate, strand, quality and position
    p = F.greatest(F.coalesce("p", F.lit(default)), F.lit(LEAST_ERROR))
    cells = cells.join(frequencies, errors.KEYS, "left").withColumn("good", F.log10(1 - F.least(p, F.lit(1 - 1e-9)))).withColumn("bad", F.log10(p) - LOG10_3).withColumn("p", p)
    mean = (1 - F.col("p")) * F.col("good") + F.col("p") * F.col("bad")
    square = (1 - F.col("p")) * F.pow("good", F.lit(2)) + F.col("p") * F.pow("bad", F.lit(2))
    rows = cells.groupBy("read_id", "mate", "strand").agg(F.array_sort(F.collect_list(F.struct("pos", "good", "bad"))).alias("x"), F.sum(mean).alias("mean"), F.sum(square - mean * mean).alias("variance"))
    return rows.select("read_id", "mate", "strand", F.col("x.good").alias("good"), F.col("x.bad").alias("bad"), "mean", "variance")


@F.pandas_udf(T.DoubleType())
def floors(mean: pd.Series, variance: pd.Series, share: pd.Series) -> pd.Series:
    """The floor of scores of this mean and variance, which so many of them exceed: a gamma fit. Each distinct triple is worked out once a batch."""
    rows = pd.DataFrame({"m": mean.round(4), "v": variance.round(4), "a": share})
    distinct = rows.drop_duplicates()
    found = [estimated_thresholds(m, v, a)[0] if v > 0 else -2.1 for m, v, a in distinct.itertuples(index=False)]
    return rows.merge(distinct.assign(f=found), on=["m", "v", "a"], how="left")["f"]


def simulated_floors(reads: DataFrame, draws: int = 1000, alpha: float = 0.99, seed: int | None = None) -> DataFrame:
    """(read_id, floor) of reads (read_id, p: the error probability of each base): the score that a share alpha of so many simulated reads exceed, interpolated. Numbers come from read, draw and base."""
    rows = reads.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    more = [] if seed is None else [seed]
    score = F.aggregate(F.transform("p", lambda p, i: F.when(uniform(F.col("read_id"), F.col("draw"), i, *more) < p, F.log10(p) - LOG10_3).otherwise(F.log10(1 - p))), F.lit(0.0), lambda a, x: a + x)
    return rows.select("read_id", score.alias("score")).groupBy("read_id").agg(F.percentile("score", 1 - alpha).alias("floor"))


def informative(own: DataFrame, genome: int) -> DataFrame:
    """(read_id, mate) of the reads (penalties()) whose bases, less the errors to expect, tell more than a genome of so many bases."""
    expected = F.aggregate("good", F.lit(0.0), lambda a, x: a + 1 - F.pow(F.lit(10.0), x))
    return own.filter("strand = '+'").filter(F.pow(F.lit(4.0), F.size("good") - F.floor(expected) - 1) / 2 > genome).select("read_id", "mate")


def rescore(candidates: DataFrame, reads: DataFrame, contigs: DataFrame, own: DataFrame, size: int | None = None) -> DataFrame:
    """Candidates with the score of the whole read under its own penalties(), and the floor that the read's own score distribution allows."""
    size = piece_size(reads) if size is None else size
    rows = candidates.drop("penalty").join(reads.select("read_id", "mate", "seq"), ["read_id", "mate"]).join(own, ["read_id", "mate", "strand"])
    rows = aligned(rows, contigs, size)
    genome = F.when(F.col("strand") == "+", F.col("genome")).otherwise(reverse_complement(F.col("genome")))
    trim = F.col("trim") if "trim" in candidates.columns else F.lit(0)
    rest = lambda c: F.slice(c, trim + 1, F.size(c))
    cells = F.arrays_zip(F.split(F.upper(F.substr("seq", trim + 1)), "").alias("r"), F.split(genome, "").alias("g"), rest(F.col("good")).alias("good"), rest(F.col("bad")).alias("bad"))
    one = lambda x: F.when(x["good"].isNull(), 0.0).when(x["g"] == "N", F.lit(N_SCORE)).when(x["r"] == x["g"], x["good"]).otherwise(x["bad"])
    score = F.when(genome.isNotNull(), F.aggregate(F.transform(cells, one), F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("penalty", score).withColumn("floor", floors("mean", "variance", F.lit(0.99)))
    return rows.select("read_id", "mate", "chr", "start", "length", "strand", *[c for c in ("trim", "split", "gap") if c in candidates.columns], "penalty", "floor")


#: Parts that words are cut into, fewest first; a word is searched by the first number under which it is listed MOST_CHANGES times at most, or else the last. Parts have 11 bases at most.
PARTS = (2, 3, 4, 5, 6)
#: Losses are compared in units of 2 ** -UNIT, so sums are exact, in whatever order they are added.
UNIT, AT_ONCE, WIDEST = 20, 512, 11


def probe_targets(probes: DataFrame, reads: DataFrame, own: DataFrame, skipped: int = 0) -> DataFrame:
    """Under penalties() of reads whose first `skipped` bases the probes' reads lack: both strands of probes (…, strand, target) with `base`, the score of a full match, `loss`, what a mismatch costs at each base of the target, and `floor`, which a probe's own score distribution allows when so many probes (n, a column) must all miss a read with chance 0.01; `information`, the bases that tell something."""
    rows = both_strands(probes).join(own.select("read_id", "mate", "strand", "good", "bad"), ["read_id", "mate", "strand"]).join(reads.select("read_id", "mate", F.col("seq").alias("whole")), ["read_id", "mate"])
    known = F.transform(F.filter(F.split(F.upper(F.substr("whole", F.col("offset") + 1, F.col("length"))), ""), lambda x: x != ""), lambda x: x != "N")
    cut = lambda c: F.slice(c, F.col("offset") + skipped + 1, F.col("length"))
    # an unknown base costs the same whatever the genome has
    cells = F.zip_with(F.arrays_zip(cut("good").alias("good"), cut("bad").alias("bad")), known, lambda x, k: F.struct(F.when(k, x["good"]).otherwise(N_SCORE).alias("good"), F.when(k, x["bad"]).otherwise(N_SCORE).alias("bad"), F.when(k, 1 - F.pow(F.lit(10.0), x["good"])).otherwise(0.75).alias("p")))
    rows = rows.withColumn("cells", F.when(F.col("strand") == "+", cells).otherwise(F.reverse(cells))).drop("good", "bad", "whole")
    total = lambda f: F.aggregate(F.transform("cells", f), F.lit(0.0), lambda a, x: a + x)
    mean = lambda x: (1 - x["p"]) * x["good"] + x["p"] * x["bad"]
    variance = lambda x: (1 - x["p"]) * F.pow(x["good"], F.lit(2)) + x["p"] * F.pow(x["bad"], F.lit(2)) - F.pow(mean(x), F.lit(2))
    rows = rows.withColumns({"base": total(lambda x: x["good"]), "loss": F.transform("cells", lambda x: x["good"] - x["bad"]), "mean": total(mean), "variance": F.greatest(total(variance), F.lit(0.0))})
    information = F.col("length") - F.floor(total(lambda x: x["p"])) - 1
    return rows.withColumn("information", information).withColumn("floor", floors("mean", "variance", 1 - F.pow(F.lit(0.01), 1 / F.col("n")))).drop("cells", "mean", "variance")


@functools.cache
def _subsets(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All sets of changed bases of a part: as 0/1 rows; how many words each stands for, where they begin, and what changes a packed part into each of them."""
    rows = (np.arange(1 << size)[:, None] >> np.arange(size - 1, -1, -1)) & 1  # the first base is the highest
    change = np.arange(4**size, dtype=np.int64)
    bases = (change[:, None] >> (2 * np.arange(size - 1, -1, -1))) & 3
    of = ((bases > 0) << np.arange(size - 1, -1, -1)).sum(1)
    order = np.argsort(of, kind="stable")
    count = 3 ** rows.sum(1)
    return rows.astype(np.float64), count, np.cumsum(count) - count, change[order]


def _edges(k: int, parts: int) -> list[int]:
    return [k * p // parts for p in range(parts + 1)]


def _block(word: Column, k: int, parts: int, p: int) -> Column:
    """The bases of a part, with its number and the number of parts, as one whole number."""
    edges = _edges(k, parts)
    bases = F.shiftrightunsigned(word, 2 * (k - edges[p + 1])).bitwiseAND(F.lit((1 << 2 * (edges[p + 1] - edges[p])) - 1))
    return (bases * 8 + p) * 8 + parts


def _neighbours(k: int, parts: list[int]):
    """A function of batches of (target_no, word, units, budget): (target_no, part, parts, key) of all words within the budget, by their parts; a part gets its share of the budget."""

    def one(word: np.ndarray, units: np.ndarray, budget: np.ndarray, n: int) -> tuple[np.ndarray, list]:
        edges, listed, found = _edges(k, n), np.zeros(len(word), np.int64), []
        for p in range(n):
            a, b = edges[p], edges[p + 1]
            subsets, count, _, _ = _subsets(b - a)
            within = units[:, a:b] @ subsets.T <= (budget // n)[:, None]
            listed += within @ count
            found.append(within)
        return listed, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(low, AT_ONCE)
                number, word, budget = (b.column(c).to_numpy() for c in ("target_no", "word", "budget"))
                units = b.column("units").flatten().to_numpy().reshape(-1, k).astype(np.float64)
                left = np.arange(len(word))
                for n in parts:
                    listed, found = one(word[left], units[left], budget[left], n)
                    here = listed <= MOST_CHANGES if n != parts[-1] else np.ones(len(left), bool)
                    edges = _edges(k, n)
                    for p, within in enumerate(found):
                        a, e = edges[p], edges[p + 1]
                        _, count, begin, change = _subsets(e - a)
                        row, subset = np.nonzero(within & here[:, None])
                        size = count[subset]
                        at = np.repeat(begin[subset] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        row = np.repeat(left[row], size)
                        bases = ((word[row] >> (2 * (k - e))) & ((1 << 2 * (e - a)) - 1)) ^ change[at]
                        yield pa.RecordBatch.from_arrays([pa.array(number[row]), pa.array(np.full(len(row), p, np.int32)), pa.array(np.full(len(row), n, np.int32)), pa.array((bases * 8 + p) * 8 + n)], ["target_no", "part", "parts", "key"])
                    left = left[~here]
                    if not len(left):
                        break

    return run


def search(targets: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Hits of targets (strand, target, base, loss, floor, …) whose score under their own losses reaches their floor.

    The floor leaves a budget for losses. Words are cut into parts; a hit keeps within its share of the budget in one part at least, so each target is listed
    under all changes of each part that cost no more (in numpy, for many targets at once) and joins the index's parts by equality. The most mismatches that a budget can pay for
    and an exclusive or leave few pairs, whose exact loss is then summed; a pair that meets by several parts counts by the first. Poor targets, whose budget pays for
    many changes, are cut into more parts. The index isn't shuffled where targets make up to MOST_BROADCAST rows, which are counted.
    """
    if k > MOST_PACKED:
        raise ValueError(f"searches take words of up to {MOST_PACKED} bases")
    spark, parts = targets.sparkSession, [n for n in PARTS if -(-k // n) <= WIDEST and n <= k]
    units = F.transform("loss", lambda x: F.round(x * (1 << UNIT)).cast("long"))
    rows = targets.withColumn("word", pack(F.col("target"))).withColumn("target_no", F.monotonically_increasing_id()).withColumn("units", units).withColumn("budget", F.floor((F.col("base") - F.col("floor")) * (1 << UNIT)).cast("long"))
    rows = rows.filter("budget >= 0 and word is not null").checkpoint()  # numbers stay as they are
    # so many mismatches at most: the cheapest ones that fit
    most = F.aggregate(F.array_sort("units"), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + (s["sum"] + x <= F.col("budget")).cast("int")).alias("n")))["n"]
    listed = rows.select("target_no", "word", "units", "budget").mapInArrow(_neighbours(k, parts), "target_no long, part int, parts int, key long").checkpoint()
    used = [r.parts for r in listed.select("parts").distinct().collect()]  # a few numbers
    few = listed.count() <= MOST_BROADCAST
    wanted = listed.join(rows.select("target_no", "word", most.alias("most")), "target_no")
    keys = [_block(F.col("code"), k, n, p) for n in used for p in range(n)]
    held = index.withColumn("key", F.explode(F.array(*keys) if keys else F.array().cast("array<bigint>")))
    near = packed_mismatches(F.col("word"), F.col("code"), 0, k)
    pairs = (F.broadcast(wanted) if few else wanted).join(held, "key").filter(near <= F.col("most")).drop("key", "most", "head")
    pairs = pairs.withColumn("differ", F.col("word").bitwiseXOR(F.col("code"))).drop("word", "code").join(rows, "target_no")
    changed = F.array(*[F.shiftrightunsigned("differ", 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) != 0 for i in range(k)])
    lost = F.zip_with("units", changed, lambda x, c: F.when(c, x).otherwise(0))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    pairs = pairs.withColumn("lost", lost).withColumn("changed", changed).filter(total(F.col("lost")) <= F.col("budget"))

    def earlier(n: int) -> Column:
        """That no earlier part keeps within its share."""
        edges = _edges(k, n)
        return functools.reduce(Column.__and__, [(F.col("part") <= p) | (total(F.slice("lost", edges[p] + 1, edges[p + 1] - edges[p])) > F.floor(F.col("budget") / n)) for p in range(n - 1)], F.lit(True))

    first = functools.reduce(Column.__or__, [(F.col("parts") == n) & earlier(n) for n in used], F.lit(False))
    exact = F.aggregate(F.zip_with("loss", "changed", lambda x, c: F.when(c, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    hits = pairs.filter(first).withColumn("penalty", F.col("base") - exact)
    return hits.drop("target_no", "part", "parts", "differ", "units", "budget", "lost", "changed", "word", "target", "base", "loss", "floor", "information")
