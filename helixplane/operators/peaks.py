"""Treatment (IP) against control (NC): how often bootstrapped density is higher, and how unlikely that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixplane.functions.stats import half_tails

BOOTSTRAPS = 25
KEYS = ["chr", "track", "pos"]


def higher_counts(ip: DataFrame, nc: DataFrame, n: int = BOOTSTRAPS) -> DataFrame:
    """(chr, track, pos, count): of n pairs of bootstraps (bs, …, value), 1 where IP is higher and 0.5 where both are equal.

    Places without a row in either count 0.5: only places that differ from n / 2 in some pair have rows.
    """
    keys = ["bs", *KEYS]
    both = ip.withColumnRenamed("value", "ip").join(nc.withColumnRenamed("value", "nc"), keys, "full")
    a, b = F.coalesce("ip", F.lit(0.0)), F.coalesce("nc", F.lit(0.0))
    gain = F.when(a > b, 1.0).when(a == b, 0.5).otherwise(0.0)
    return both.groupBy(*KEYS).agg((F.sum(gain) + (n - F.count(F.lit(1))) * 0.5).alias("count"))


def higher_counts_of_wiggles(ip: DataFrame, nc: DataFrame) -> DataFrame:
    """As wiggles count: a missing control is lower, a place that both lack counts nothing."""
    both = ip.join(nc.withColumnRenamed("value", "nc"), ["bs", *KEYS], "left")
    return both.groupBy(*KEYS).agg(F.sum(F.when(F.col("nc").isNull() | (F.col("value") > F.col("nc")), 1.0).when(F.col("value") == F.col("nc"), 0.5).otherwise(0.0)).alias("count"))


def half_p_value(count: Column, n: int = BOOTSTRAPS) -> Column:
    """P(X >= floor(count)) of a Binomial(n, 1/2), from n + 1 numbers."""
    table = F.array(*[F.lit(p) for _, p in half_tails(n)])
    return F.element_at(table, F.floor(count).cast("int") + 1)


def scores(counts: DataFrame, n: int = BOOTSTRAPS) -> DataFrame:
    """1 - p of each place."""
    return counts.withColumn("value", 1 - half_p_value(F.col("count"), n))


def combined(scored: DataFrame, samples: DataFrame) -> DataFrame:
    """Scores of samples (sample, …, value) weighted by their likelihood (sample, log_lhd); a row for each sample, so it joins by key."""
    best = samples.agg(F.max("log_lhd").alias("best"))
    weights = samples.crossJoin(F.broadcast(best)).select("sample", F.pow(F.lit(10.0), F.col("log_lhd") - F.col("best")).alias("w"))
    return scored.join(weights, "sample").groupBy(*KEYS).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
