"""Gapped mapping of RNA reads: probes at both ends, chains of their hits, and where the intron lies between them.

A candidate with an intron has `split`, the bases of the read (as it lies on the forward strand) before the intron, and `gap`, the
intron's length: the read covers [start, start + split) and [start + split + gap, start + length + gap).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixplane.functions.quality import N_SCORE
from helixplane.functions.sequence import reverse_complement

from .search import aligned, piece_size, select_probes

#: Bases of an intron; the log10 chance that a read has one.
LEAST_INTRON, MOST_INTRON, INTRON = 4, 500_000, -1.0
# fixed values: an intron's first and last two bases, on the strand of its gene or on the other
FIRST, LAST = ("GT", "CT"), ("AG", "AC")


def end_probes(reads: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """As select_probes, with two probes a read, as far apart as their quality lets them: the best window of the first half (ties to the first) and of the second (ties to the last). Reads shorter than two probes have one."""
    length = F.length("seq")
    half = F.floor(length / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("probe_no"), F.sequence(F.lit(0), half - k).alias("offsets")), F.struct(F.lit(1).alias("probe_no"), F.sequence(length - half, length - k).alias("offsets")))
    rows = reads.filter(length >= 2 * k).select("*", F.inline(both)).withColumn("offset", F.explode("offsets"))
    rows = rows.withColumn("window", F.substring("seq", F.col("offset") + 1, F.lit(k)))
    score = -F.length(F.regexp_replace("window", "[^Nn]", "")) if score is None else score
    order = F.struct(score, F.when(F.col("probe_no") == 0, -F.col("offset")).otherwise(F.col("offset")))
    best = rows.groupBy("read_id", "mate", "probe_no").agg(F.max_by(F.struct("offset", "window"), order).alias("x"))
    ends = best.select("read_id", "mate", "probe_no", F.col("x.offset").alias("offset"), F.lit(k).alias("length"), F.translate(F.col("x.window"), "Nn", "AA").alias("seq"))
    return ends.unionByName(select_probes(reads.filter(length < 2 * k), k, 1, score))


def chain(hits: DataFrame, reads: DataFrame, k: int, least: int = LEAST_INTRON, most: int = MOST_INTRON) -> DataFrame:
    """(read_id, mate, chr, strand, start, length, gap, low, high): pairs of a read's probe hits in one order in read and genome, `least` to `most` bases further apart in the genome; the split lies from low to high.

    Hits meet within bins of `most` bases, each right one also those of the bin before: an equality of read, strand, contig and bin, so hits far apart never meet.
    """
    keys = ["read_id", "mate", "strand", "chr"]
    rows = hits.select(*keys, "probe_no", "offset", "loc").join(reads.select("read_id", "mate", F.length("seq").cast("int").alias("length")), ["read_id", "mate"])
    # places along the forward strand
    at = F.when(F.col("strand") == "+", F.col("offset")).otherwise(F.col("length") - F.col("offset") - k)
    rows = rows.withColumn("at", at).withColumn("start", (F.col("loc") - F.col("at")).cast("long")).withColumn("bin", F.floor(F.col("start") / most))
    left = rows.select(*keys, "length", "bin", "start", (F.col("at") + k).cast("int").alias("low"))
    right = rows.select(*keys, F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"), F.col("start").alias("far"), F.col("at").cast("int").alias("high"))
    gap = F.col("far") - F.col("start")
    pairs = left.join(right, [*keys, "bin"]).filter((gap >= least) & (gap <= most) & (F.col("low") <= F.col("high"))).withColumn("gap", gap)
    # hits of several probes that lie alike
    return pairs.groupBy(*keys, "start", "length", "gap").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def split(chains: DataFrame, reads: DataFrame, contigs: DataFrame, size: int | None = None) -> DataFrame:
    """Chains with `split` and `canonical`: of all splits from low to high the one with fewest mismatches; of equal ones one whose intron has the usual ends, then the first. Chains that leave their contig go.

    One pass along the read: the running sum of what a base costs on the left less what it costs on the right is least at the best split.
    """
    size = piece_size(reads) if size is None else size
    rows = chains.join(reads.select("read_id", "mate", "seq"), ["read_id", "mate"])
    rows = aligned(rows, contigs, size).withColumnRenamed("genome", "near")
    rows = aligned(rows.withColumn("begin", F.col("start")).withColumn("start", F.col("start") + F.col("gap")), contigs, size).withColumnRenamed("genome", "far").drop("start").withColumnRenamed("begin", "start")
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    read = F.when(F.col("strand") == "+", F.upper("seq")).otherwise(reverse_complement(F.col("seq")))
    rows = rows.filter("near is not null and far is not null").withColumns({"r": letters(read), "a": letters(F.col("near")), "b": letters(F.col("far"))})
    cost = lambda g, r: F.when(g == "N", F.lit(-N_SCORE)).when(g == r, 0.0).otherwise(1.0)
    r, a, b = F.col("r"), F.col("a"), F.col("b")

    def usual(i: Column) -> Column:
        """Whether an intron that begins at i has the usual ends."""
        first, last = F.concat(F.get(a, i), F.get(a, i + 1)), F.concat(F.get(b, i - 2), F.get(b, i - 1))
        return F.coalesce((first == FIRST[0]) & (last == LAST[0]) | (first == FIRST[1]) & (last == LAST[1]), F.lit(False)).cast("int")

    cells = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.struct(i.alias("i"), (cost(F.get(a, i), F.get(r, i)) - cost(F.get(b, i), F.get(r, i))).alias("d"), F.when(i.between(F.col("low"), F.col("high")), usual(i)).otherwise(0).alias("usual")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1e9).alias("best"), F.lit(0).alias("usual"), F.lit(-1).alias("at"))

    def step(s: Column, x: Column) -> Column:
        better = x["i"].between(F.col("low"), F.col("high")) & ((s["sum"] < s["best"]) | ((s["sum"] == s["best"]) & (x["usual"] > s["usual"])))
        pick = lambda new, name: F.when(better, new).otherwise(s[name]).alias(name)
        return F.struct((s["sum"] + x["d"]).alias("sum"), pick(s["sum"], "best"), pick(x["usual"], "usual"), pick(x["i"], "at"))

    rows = rows.withColumn("x", F.aggregate(cells, start, step))
    return rows.select("read_id", "mate", "chr", "start", "length", "strand", F.col("x.at").alias("split"), F.col("gap").cast("int").alias("gap"), (F.col("x.usual") == 1).alias("canonical"))


def candidates(hits: DataFrame, reads: DataFrame, contigs: DataFrame, k: int, least: int = LEAST_INTRON, most: int = MOST_INTRON, size: int | None = None) -> DataFrame:
    """(read_id, mate, chr, start, length, strand, split, gap): candidates with an intron between two probes' hits."""
    return split(chain(hits, reads, k, least, most), reads, contigs, size).drop("canonical")


def junctions(mappings: DataFrame, *keys: str) -> DataFrame:
    """(…, chr, intron_start, intron_stop, reads, weight): introns with the reads that cross them, and the sum of their cond_prb."""
    rows = mappings.filter("gap > 0").withColumn("intron_start", F.col("start") + F.col("split")).withColumn("intron_stop", F.col("start") + F.col("split") + F.col("gap"))
    return rows.groupBy(*keys, "chr", "intron_start", "intron_stop").agg(F.countDistinct("read_id").alias("reads"), F.sum("cond_prb").alias("weight"))
