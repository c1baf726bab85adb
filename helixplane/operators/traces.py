"""Algebra of density traces and wiggles: (chr, track, pos, value), 0 where there is no row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["chr", "track", "pos"]


def _one(how: str, n: int) -> Column:
    absent = F.count(F.lit(1)) < n
    return {"sum": F.sum("value"), "max": F.when(absent, F.greatest(F.max("value"), F.lit(0.0))).otherwise(F.max("value")), "min": F.when(absent, F.least(F.min("value"), F.lit(0.0))).otherwise(F.min("value"))}[how]


def aggregate(traces: DataFrame, how: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """min, max or sum over n traces stacked in one table; a trace without a row has 0 there."""
    return traces.groupBy(*(keys or KEYS)).agg(_one(how, n).alias("value"))


def aggregates(traces: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """min_value, max_value and sum_value at once."""
    return traces.groupBy(*(keys or KEYS)).agg(*[_one(how, n).alias(f"{how}_value") for how in ("min", "max", "sum")])


def over_threshold(trace: DataFrame, least: float) -> DataFrame:
    return trace.filter(F.col("value") >= least)


def scale(trace: DataFrame, factor: float) -> DataFrame:
    return trace.withColumn("value", F.col("value") * factor)


def divide(trace: DataFrame, by: DataFrame) -> DataFrame:
    """Place by place; where the divisor has no row or is 0, there is no row."""
    rows = trace.join(by.filter("value <> 0").select(*KEYS, F.col("value").alias("by")), KEYS)
    return rows.withColumn("value", F.col("value") / F.col("by")).drop("by")


def apply(trace: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """A function of each value that has a row."""
    return trace.withColumn("value", f(F.col("value")))


def zero(trace: DataFrame) -> DataFrame:
    return trace.withColumn("value", F.lit(0.0))


def uniform(contigs: DataFrame, tracks: int = 1) -> DataFrame:
    """(chr, track, start, stop, value): the same everywhere, summing to 1; a run a contig."""
    total = contigs.agg(F.sum(F.length("seq")).alias("total"))
    rows = contigs.crossJoin(F.broadcast(total)).withColumn("track", F.explode(F.sequence(F.lit(0), F.lit(tracks - 1))))
    return rows.select("chr", "track", F.lit(0).alias("start"), F.length("seq").alias("stop"), (1 / (F.col("total") * tracks)).alias("value"))


def levels(samples: DataFrame, keys: list[str]) -> DataFrame:
    """min, max and sum within each sample, then of those over all samples: two levels at once."""
    inner = samples.groupBy("sample", *keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
    return inner.groupBy(*keys).agg(F.min("low").alias("min_value"), F.max("high").alias("max_value"), F.sum("total").alias("sum_value"))
