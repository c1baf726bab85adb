"""Samples and bootstraps with seeded, order-free randomness: numbers come from keys, not from row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a uniform number: hexadecimal digits of an md5, as many as a double holds exactly.
DIGITS = 13


def uniform(*keys: Column | int) -> Column:
    """In [0, 1): the first DIGITS hexadecimal digits of the md5 of the keys, whole numbers joined by colons. Any engine can repeat it; numbers of different keys only meet by chance (2 ** -52)."""
    name = F.concat_ws(":", *[F.lit(str(k)) if isinstance(k, int) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(F.encode(name, "utf-8")), 1, DIGITS), 16, 10).cast("double") / float(1 << 4 * DIGITS)


def choose(mappings: DataFrame, u: Column, *keys: str) -> DataFrame:
    """One mapping a read (and key): the first whose running sum of cond_prb, by mapping_no, reaches u."""
    w = Window.partitionBy(*keys, "read_id").orderBy("mapping_no")
    rows = mappings.withColumn("up", F.sum("cond_prb").over(w)).withColumn("u", u)
    reached = F.struct(F.when(F.col("up") >= F.col("u"), F.col("mapping_no")).otherwise(F.col("mapping_no") + F.lit(1 << 40)))
    first = F.row_number().over(Window.partitionBy(*keys, "read_id").orderBy(reached))
    return rows.withColumn("rn", first).filter("rn = 1").drop("rn", "up", "u")


def numbered(ids: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Distinct keys numbered from 0 in their order: by ranges of keys, and within each; no task holds them all."""
    rows = ids.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("at", 33)).withColumn("own", F.col("at").bitwiseAND((1 << 33) - 1)).drop("at").checkpoint()
    # a row for each range
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("own")).alias(name))


def bootstraps(mappings: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(bs, …, weight): for each of n bootstraps as many reads as there are are drawn with replacement, each draw at a mapping of its own; weight counts draws, and sums to the number of reads in every bootstrap.

    Reads are numbered; draw j of bootstrap bs takes read floor(u n), u from the seed, bs and j, and its mapping by another number. Draws meet reads by an equality on the read's number, evenly
    spread, and a read's mappings (a few) go with it as one row. A draw is dealt once, as two numbers, one of which tells bs and j: what follows from them is worked out where it arrives, and draws of a mapping are counted there. The join is a merge: Spark may take draws for fewer than they are, and broadcast them.
    """
    spark, ids = mappings.sparkSession, numbered(mappings, "read_id")
    total = ids.count()
    bs, draw = F.pmod("id", F.lit(n)).cast("int"), F.floor(F.col("id") / n)
    draws = spark.range(total * n).select("id", F.floor(uniform(seed, bs, draw) * total).alias("number"))
    others = [c for c in mappings.columns if c != "read_id"]
    up = F.sum("cond_prb").over(Window.partitionBy("read_id").orderBy("mapping_no"))
    nested = mappings.withColumn("up", up).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("mapping_no", "up", F.struct(*others).alias("own")))).alias("places"))
    # exploded, as it would be worked out for each place of a read else
    u = F.explode(F.array(uniform(seed + 1, bs, draw)))
    rows = nested.join(ids, "read_id").join(draws.hint("merge"), "number").select("number", "read_id", bs.alias("bs"), "places", u.alias("u"))
    first = F.element_at(F.filter("places", lambda x: x["up"] >= F.col("u")), 1)
    rows = rows.select("number", "bs", "read_id", F.coalesce(first, F.element_at("places", -1))["own"].alias("own"))
    # rows of a number lie in one task already
    drawn = rows.groupBy("number", "bs", "read_id", "own").agg(F.count(F.lit(1)).alias("weight"))
    return drawn.select("bs", "read_id", *[F.col("own")[c].alias(c) for c in others], "weight")


def random_start(mappings: DataFrame, sample: int, batches: int = 16, window: int = 100, m_step=None, e_step=None) -> DataFrame:
    """One chosen mapping a read, as a start for EM: reads come in batches, each placed by the density of those before (and a prior).

    Placing reads one by one depends on their order and can't be spread; batches, by a hash of the read, can.
    m_step, e_step: the assay's, by default those of start sites within the window.
    """
    from . import density as d

    m_step = m_step or d.start_sites
    e_step = e_step or (lambda rows, density: d.near_start(rows, density, window))

    batch = F.floor(uniform(F.col("read_id"), sample) * batches)
    prior = d.conditional(mappings).withColumn("batch", batch)
    placed = None
    for b in range(batches):
        own = prior.filter(F.col("batch") == b).drop("batch")
        if placed is not None:
            own = e_step(own.drop("cond_prb"), m_step(placed.withColumn("cond_prb", F.lit(1.0)))).drop("lhd")
        drawn = choose(own, uniform(F.col("read_id"), sample, 5)).select("read_id", "mapping_no", "chr", "start", "stop", "strand", "score")
        placed = (drawn if placed is None else placed.unionByName(drawn)).checkpoint()
    return placed
