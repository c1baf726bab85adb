"""What is done with finished runs: peaks, aggregates, more samples, merging; and many samples mapped at once."""

from __future__ import annotations

import argparse
import dataclasses
import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixplane.operators import density, traces
from helixplane.operators import reads as reads_
from helixplane.sources import binary, sinks, text

from . import assays, cli
from .config import Config

#: Names of the tracks of stores: forward and reverse.
TRACKS = ["fwd_strnd_read_density", "rev_strnd_read_density"]


def config_of(spark: SparkSession, path: str) -> Config:
    return Config.loads("\n".join(r.value for r in spark.read.text(f"{path}/config", wholetext=True).collect()))


def _steps(run: sinks.Run) -> tuple:
    config = config_of(run.spark, run.path)
    lengths = run.read("fragments") if config.assay == "chip" else None
    return cli.steps(config, run.read("contigs"), lengths)


def peaks(run: sinks.Run, most: int = density.MOST_ITERATIONS) -> DataFrame:
    """Scores of the treatment against the control of a run, written as its `peaks`."""
    m, e = _steps(run)
    run.write("peaks", assays.with_control(run.read("mappings"), run.read("control"), most=most, m_step=m, e_step=e))
    return run.read("peaks")


def aggregates(run: sinks.Run) -> DataFrame:
    """min, max and sum of density over a run's posterior samples, written as its `aggregates`."""
    samples = run.read("density").filter("sample > 0")
    n = run.read("samples").count()  # a row a sample
    run.write("aggregates", traces.aggregates(samples, n))
    return run.read("aggregates")


def sample(run: sinks.Run, n: int = 1, most: int = density.MOST_ITERATIONS) -> None:
    """n more posterior samples."""
    m, e = _steps(run)
    assays.more_samples(run, n, most, m, e)


def export(run: sinks.Run, path: str, sample: int = 0) -> None:
    """A run's genome and the density of one of its samples as binary stores: path.genome and path.trace."""
    contigs = run.read("contigs")
    binary.write_genome(contigs, f"{path}.genome")
    trace = run.read("density").filter(F.col("sample") == sample)
    binary.write_trace(trace, contigs.select("chr", "name", F.length("seq").alias("length")), TRACKS, f"{path}.trace")


def merge(spark: SparkSession, paths: list[str], output: str) -> sinks.Run:
    """Runs over one genome and assay as one: reads, mappings and rejects, whose ids go on, and the density of all start sites."""
    configs, runs, out = [config_of(spark, p) for p in paths], [sinks.Run(spark, p) for p in paths], sinks.Run(spark, output)
    for what in ("genome", "assay", "k"):
        if any(getattr(c, what) != getattr(configs[0], what) for c in configs):
            raise ValueError(f"runs differ in {what}")
    ids = reads_.offsets(*[r.read("reads") for r in runs])
    for name in ("reads", "mappings", "rejects"):
        out.write(name, functools.reduce(DataFrame.unionByName, [r.read(name).withColumn("run_id", F.lit(k)).withColumn("read_id", F.col("read_id") + ids[k]) for k, r in enumerate(runs)]))
    out.write("contigs", runs[0].read("contigs"))
    out.write("density", density.start_sites(out.read("mappings")).withColumn("sample", F.lit(0)))
    own = configs[0]  # a copy adds cage's base again
    spark.createDataFrame([(dataclasses.replace(own, output=output, soft_clip=own.soft_clip - (own.assay == "cage")).dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/config")
    return out


def pool(spark: SparkSession, manifest: str, genome: list[str], output: str, at_once: int = 4, cut: int = 0, **settings) -> DataFrame:
    """Maps each sample of a manifest (name, sample id, files) as a run of its own below output, at_once of them side by side, each in a scheduler pool of its own; a sample that fails costs no other. `pool` has a row a sample: its run, or why there is none.

    cut: bases cut from the start of every read. Samples are few (a row each on the driver); their work is Spark's.
    """
    rows = text.manifest(spark, manifest).groupBy("name", "sample_id").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("name", "sample_id").collect()
    done: list[tuple] = []

    def one(row) -> None:
        path, error = f"{output}/{row['name']}_{row['sample_id']}", None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{row['name']}_{row['sample_id']}")
        try:
            cli.run(spark, Config(genome=genome, output=path, unpaired=",".join(row["files"]), soft_clip=cut, **settings))
        except Exception as e:  # noqa: BLE001 - whatever it is, it becomes the sample's row
            error = f"{type(e).__name__}: {str(e).splitlines()[0][:500] if str(e) else ''}"
        done.append((row["name"], row["sample_id"], path if error is None else None, error))

    with ThreadPoolExecutor(at_once) as threads:
        # each run in a thread whose properties are its own
        def start(row) -> None:
            t = InheritableThread(target=one, args=(row,))
            t.start()
            t.join()

        list(threads.map(start, rows))
    out = sinks.Run(spark, output)
    out.write("pool", spark.createDataFrame(sorted(done), "name string, sample_id string, output string, error string"))
    return out.read("pool")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Works on finished runs.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("peaks", "aggregates", "sample"):
        one = sub.add_parser(name)
        one.add_argument("run")
        if name == "sample":
            one.add_argument("-n", type=int, default=1)
    one = sub.add_parser("export")
    one.add_argument("run")
    one.add_argument("path")
    one = sub.add_parser("merge")
    one.add_argument("output")
    one.add_argument("runs", nargs="+")
    one = sub.add_parser("pool")
    one.add_argument("manifest")
    one.add_argument("output")
    one.add_argument("-g", dest="genome", nargs="+", required=True)
    one.add_argument("-a", dest="assay", choices=["cage", "chip", "rna"])
    one.add_argument("-s", dest="model", choices=["mismatch", "estimated"], default="estimated")
    one.add_argument("-n", dest="samples", type=int, default=0)
    one.add_argument("-k", type=int, default=20)
    one.add_argument("--at-once", type=int, default=4)
    one.add_argument("--cut", type=int, default=0)
    given = vars(p.parse_args(args))
    command = given.pop("command")
    folder = given.get("run") or given.get("output")
    spark = cli.session(folder)
    if command == "merge":
        merge(spark, given["runs"], given["output"])
    elif command == "pool":
        pool(spark, given.pop("manifest"), given.pop("genome"), given.pop("output"), **given)
    else:
        run = sinks.Run(spark, given["run"])
        {"peaks": lambda: peaks(run), "aggregates": lambda: aggregates(run), "sample": lambda: sample(run, given["n"]), "export": lambda: export(run, given["path"])}[command]()


if __name__ == "__main__":
    main()
