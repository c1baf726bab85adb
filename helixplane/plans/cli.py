"""Command line: index a genome, map reads, write density."""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixplane.functions.quality import ENCODINGS
from helixplane.operators import density, diploid, fragments, index
from helixplane.operators import reads as reads_
from helixplane.sources import binary, inputs, sinks, text

from . import assays
from .config import Config
from .mapper import learn, map_reads


def load_genome(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Contigs of FASTA files, or of one binary store (.genome)."""
    if len(paths) == 1 and paths[0].endswith(".genome"):
        return binary.joined(binary.read_genome(spark, paths[0]))
    return text.fasta(functools.reduce(DataFrame.unionByName, [text.lines(spark, p) for p in paths]))


def load_reads(spark: SparkSession, unpaired: str | None, pair1: str | None, pair2: str | None) -> DataFrame:
    """Unpaired reads of a file, or of several (comma-separated), whose ids go on; or pairs."""
    if unpaired:
        files = [text.fastq(text.lines(spark, p)) for p in unpaired.split(",")]
        ids = reads_.offsets(*files) if len(files) > 1 else [0]
        rows = functools.reduce(DataFrame.unionByName, [f.withColumn("read_id", F.col("read_id") + n) for f, n in zip(files, ids, strict=True)])
        return rows.select("read_id", F.lit(1).alias("mate"), "name", "seq", "qual")
    return text.paired(text.fastq(text.lines(spark, pair1)), text.fastq(text.lines(spark, pair2)))


def steps(config: Config, contigs: DataFrame, lengths: DataFrame | None) -> tuple:
    """The assay's M-step and E-step: start sites for cage, whole fragments for pairs of chip, binding-site profiles for its single reads."""
    if config.assay == "cage":
        return density.start_sites, density.near_start
    if not config.unpaired:
        return density.fragments, density.over_fragment
    shape = fragments.binding_profile(lengths).checkpoint()
    ends = contigs.select("chr", F.length("seq").alias("length"))
    return lambda rows, *keys: density.profile(rows, shape, ends, *keys), lambda rows, places: density.over_profile(rows, places, shape)


def write_index(spark: SparkSession, out: sinks.Run, paths: list[str], k: int) -> None:
    """contigs, the index with its repeats beside it and, for a genome of two copies (files with a .map), the map between them."""
    maps = {p: g["map"] for p, g in inputs.genome_groups(paths).items() if "map" in g} if any(p.endswith(".map") for p in paths) else {}
    out.write("contigs", load_genome(spark, [p for p in paths if not p.endswith(".map")]))
    contigs = out.read("contigs")
    if maps:
        out.write("dmap", functools.reduce(DataFrame.unionByName, [text.diploid_map(spark, path, prefix) for prefix, path in maps.items()]))
        words = diploid.index(contigs, out.read("dmap"), k).checkpoint()
    else:
        words = index.packed(contigs, k).checkpoint()
    repeated = index.repeats(words).checkpoint()
    index.save(index.collapsed(words, repeated), f"{out.path}/kmers", k)
    out.write("repeats", index.postings(words, repeated))


def run(spark: SparkSession, config: Config) -> sinks.Run:
    """Maps, writes all tables, SAM and wiggle below config.output."""
    if config.threads:
        spark.conf.set("spark.sql.shuffle.partitions", str(config.threads))
    out = sinks.Run(spark, config.output)
    write_index(spark, out, config.genome, config.k)
    contigs, words, repeats = out.read("contigs"), out.read("kmers").drop("head"), out.read("repeats")
    out.write("reads", load_reads(spark, config.unpaired, config.pair1, config.pair2))
    reads = out.read("reads")
    config.encoding = config.encoding or reads_.quality_encoding(reads)
    spark.createDataFrame([(config.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{config.output}/config")
    lengths = text.fragment_lengths(spark, config.fragment_lengths) if config.fragment_lengths else None
    clip = config.clipped
    shorn = _shorn(reads, clip)
    frequencies = None
    if config.model == "estimated":
        errors, frequencies = learn(shorn, contigs, config.k, config.floor_p, words, config.untemplated, repeats, config.introns, encoding=config.encoding)
        out.write("errors", errors)
        out.write("frequencies", frequencies)
        frequencies = out.read("frequencies")
    one = functools.partial(map_reads, contigs=contigs, k=config.k, floor_p=config.floor_p, kmers=words, fragment_lengths=lengths, model=config.model, untemplated=config.untemplated, repeats=repeats, introns=config.introns, frequencies=frequencies, encoding=config.encoding)
    mappings, rejects = one(shorn)
    out.write("mappings", mappings)
    out.write("rejects", rejects)
    out.write("counters", reads_.counters(reads, out.read("mappings"), out.read("rejects")))
    mappings = out.read("mappings")
    if config.assay == "chip" and lengths is None:
        lengths = fragments.learnt(mappings).checkpoint()
    if lengths is not None:
        out.write("fragments", lengths)
    samples = None
    if config.assay in ("cage", "chip"):
        m, e = steps(config, contigs, lengths)
        if config.control or config.control1:
            control, _ = one(_shorn(load_reads(spark, config.control, config.control1, config.control2).checkpoint(), clip))
            out.write("control", control)
            out.write("peaks", assays.with_control(mappings, out.read("control"), m_step=m, e_step=e))
        if config.samples:
            samples, found = assays.posterior_samples(mappings, config.samples, m_step=m, e_step=e)
            # sample 0 is the density of the run itself
            samples = samples.withColumn("sample", F.col("sample") + 1)
            out.write("samples", found.withColumn("sample", F.col("sample") + 1))
        mappings, _ = density.iterate(mappings, m, e, stop_ratio=-1 if config.assay == "cage" else 1.05)
    sites = density.start_sites(mappings).withColumn("sample", F.lit(0))
    out.write("density", sites if samples is None else sites.unionByName(samples))
    sinks.write_wiggle(out.read("density").filter("sample = 0"), contigs, config.threshold, f"{config.output}/wiggle")
    lines = (reads_.sam_lines if config.unpaired else reads_.sam_pair_lines)(mappings, reads, contigs, clip)
    sinks.write_sam(lines, reads_.sam_header(contigs), f"{config.output}/sam")
    sinks.write_rejects(reads, out.read("rejects"), f"{config.output}/rejected_fastq")
    return out


def _shorn(reads: DataFrame, clip: int) -> DataFrame:
    rest = lambda c: F.substr(c, F.lit(clip + 1))
    return reads.withColumn("seq", rest("seq")).withColumn("qual", rest("qual")) if clip else reads


def session(folder: str) -> SparkSession:
    spark = SparkSession.builder.getOrCreate()
    if spark.sparkContext.getCheckpointDir() is None:  # rounds are written there; the output folder is shared
        spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    return spark


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Maps reads to a genome under a probability model.")
    p.add_argument("-g", dest="genome", nargs="+", required=True, help="FASTA files and .map files of diploid genomes, or a .genome store")
    p.add_argument("-o", dest="output", required=True)
    p.add_argument("-r", dest="unpaired")
    p.add_argument("-1", dest="pair1")
    p.add_argument("-2", dest="pair2")
    p.add_argument("-c", dest="control", help="unpaired reads of a negative control")
    p.add_argument("-3", dest="control1")
    p.add_argument("-4", dest="control2")
    p.add_argument("-k", type=int, default=20)
    p.add_argument("-a", dest="assay", choices=["cage", "chip", "rna"])
    p.add_argument("-f", dest="fragment_lengths")
    p.add_argument("-s", dest="model", choices=["mismatch", "estimated"], default="estimated")
    p.add_argument("-p", dest="floor_p", type=float, default=0.1)
    p.add_argument("-n", dest="samples", type=int, default=0)
    p.add_argument("-S", dest="soft_clip", type=int, default=0)
    p.add_argument("-t", dest="threads", type=int, default=0, help="shuffle partitions")
    p.add_argument("-i", dest="encoding", choices=sorted(ENCODINGS), help="encoding of qualities, else found from the reads")
    p.add_argument("--intron", type=int, default=500_000, help="longest intron within a read (rna)")
    p.add_argument("-V", dest="level", action="store_const", const="INFO", default="WARN")
    p.add_argument("-D", dest="level", action="store_const", const="DEBUG")
    given = vars(p.parse_args(args))
    level = given.pop("level")
    config = Config(**given)
    spark = session(config.output)
    spark.sparkContext.setLogLevel(level)
    run(spark, config)


if __name__ == "__main__":
    main()
