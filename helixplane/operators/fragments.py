"""Fragment lengths: (len, p) tables, estimated or generated, and binding-site profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: quantiles that are cut off
LOW, HIGH = 0.001, 0.99


def empirical(mappings: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(len, p) from reads whose mappings all have one length, without the tails; p is of all such reads, so it sums to less than 1."""
    lengths = mappings.groupBy("read_id").agg(F.min(F.col("stop") - F.col("start")).alias("len"), F.max(F.col("stop") - F.col("start")).alias("most")).filter("len = most")
    counts = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    # a row for each length
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("up", F.sum("n").over(w)).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return rows.filter((F.col("up") > F.col("total") * low) & (F.col("up") <= F.col("total") * high)).select("len", (F.col("n") / F.col("total")).alias("p"))


def normals(settings: DataFrame) -> DataFrame:
    """(…, len, p) of normal distributions with the mean and sd of each row, cut at two standard deviations; a row's other columns tell them apart."""
    own = [c for c in settings.columns if c not in ("mean", "sd")]
    lengths = F.sequence((F.col("mean") - 2 * F.col("sd")).cast("long"), (F.col("mean") + 2 * F.col("sd")).cast("long"))
    rows = settings.withColumn("x", F.transform(lengths, lambda n: F.struct(n.alias("len"), F.exp(-F.pow((n - F.col("mean")) / F.col("sd"), F.lit(2)) / 2).alias("d"))))
    rows = rows.withColumn("total", F.aggregate("x", F.lit(0.0), lambda a, y: a + y["d"]))
    return rows.select(*own, "total", F.inline("x")).select(*own, "len", (F.col("d") / F.col("total")).alias("p"))


def normal(spark: SparkSession, mean: float, sd: float) -> DataFrame:
    """(len, p) of one."""
    return normals(spark.createDataFrame([(float(mean), float(sd))], "mean double, sd double"))


def learnt(mappings: DataFrame, least: int = 100, mean: float = 200, sd: float = 25) -> DataFrame:
    """empirical(), or where fewer than `least` reads tell their fragment's length, a normal distribution."""
    found = empirical(mappings).checkpoint()
    told = mappings.groupBy("read_id").agg(F.min(F.col("stop") - F.col("start")).alias("a"), F.max(F.col("stop") - F.col("start")).alias("b")).filter("a = b").limit(least).count()
    return found if told >= least else normal(mappings.sparkSession, mean, sd).select(F.col("len").cast(found.schema["len"].dataType).alias("len"), "p")


def binding_profile(lengths: DataFrame) -> DataFrame:
    """(offset, d): the chance that a fragment that starts at 0 has its binding site there."""
    return lengths.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len").cast("long") - 1))).groupBy("offset").agg(F.sum(F.col("p") / F.col("len")).alias("d"))


def with_probability(rows: DataFrame, lengths: DataFrame, column: str = "frag_len") -> DataFrame:
    """fl_prb of each row's length, 0 outside the table; the table has a row a length."""
    return rows.join(lengths.select(F.col("len").alias(column), F.col("p").alias("fl_prb")), column, "left").withColumn("fl_prb", F.coalesce("fl_prb", F.lit(0.0)))
