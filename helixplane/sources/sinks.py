"""What is written: Parquet tables of a run, and SAM, wiggle and FASTQ text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a run and the columns that they are partitioned by.
TABLES = {"contigs": [], "kmers": [], "repeats": [], "counters": [], "dmap": [], "reads": [], "mappings": [], "rejects": [], "density": ["sample", "track"], "samples": [], "errors": [], "frequencies": [], "fragments": [], "control": [], "peaks": ["track"], "aggregates": ["track"], "pool": []}


class Run:
    """A folder with a Parquet table for each kind of result."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        df.write.mode(mode).partitionBy(*[c for c in TABLES[name] if c in df.columns]).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.path}/{name}")


def wiggle_lines(density: DataFrame, contigs: DataFrame, threshold: float) -> DataFrame:
    """(track, chr, pos, line): header lines have pos -2 (track) and -1 (contig); values over the threshold, positions from 1."""
    rows = density.filter(F.col("value") > threshold).join(contigs.select("chr", "name"), "chr")
    body = rows.select("track", "chr", "pos", F.concat_ws("\t", (F.col("pos") + 1).cast("string"), F.format_string("%e", "value")).alias("line"))
    heads = rows.select("track", "chr", "name").distinct().select("track", "chr", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("variableStep chrom="), "name").alias("line"))
    tracks = rows.groupBy("track").agg(F.lit(-1).alias("chr")).select("track", "chr", F.lit(-2).cast("long").alias("pos"), F.concat(F.lit("track type=wiggle_0 name="), F.col("track").cast("string")).alias("line"))
    return body.unionByName(heads).unionByName(tracks)


def write_wiggle(density: DataFrame, contigs: DataFrame, threshold: float, path: str) -> None:
    """Files in order, a folder for each track."""
    wiggle_lines(density, contigs, threshold).repartitionByRange("track", "chr", "pos").sortWithinPartitions("track", "chr", "pos").select("track", "line").write.partitionBy("track").text(path)


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+"), "name", F.lit("\n"), "qual").alias("value"))


def write_rejects(reads: DataFrame, rejects: DataFrame, path: str) -> None:
    """FASTQ of the reads that aren't mapped."""
    fastq_lines(reads.join(rejects.select("read_id"), "read_id", "left_semi")).write.text(path)


def write_sam(lines: DataFrame, header: DataFrame, path: str) -> None:
    """Header lines, then mappings by read; files in order."""
    mate = F.col("mate") if "mate" in lines.columns else F.lit(1)
    order = ["read_id", "mapping_no", "mate"]
    head = header.select(F.lit(-1).cast("long").alias("read_id"), F.col("chr").cast("int").alias("mapping_no"), F.lit(0).alias("mate"), "line")
    head.unionByName(lines.select("read_id", F.col("mapping_no").cast("int"), mate.alias("mate"), "line")).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
