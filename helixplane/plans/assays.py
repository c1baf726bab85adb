"""Whole assays: posterior samples of density, treatment against control, peaks, most likely densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixplane.operators import density, overlay, peaks, sampling
from helixplane.sources.sinks import Run


def posterior_samples(mappings: DataFrame, n: int, most: int = density.MOST_ITERATIONS, m_step=density.start_sites, e_step=density.near_start, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(density of start sites with a sample column, samples with their log_lhd): random starts, each iterated to its end by the assay's steps; samples are numbered from `first`, which also seeds them."""
    spark, out, found = mappings.sparkSession, None, []
    for k in range(first, first + n):
        start = sampling.random_start(mappings, k, m_step=m_step, e_step=e_step).withColumn("cond_prb", F.lit(1.0))
        begun = e_step(density.conditional(mappings).drop("cond_prb"), m_step(start)).drop("lhd").checkpoint()
        rows, history = _iterated(begun, most, m_step, e_step)
        found.append((k, float(history)))
        own = density.start_sites(rows).withColumn("sample", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out, spark.createDataFrame(found, "sample int, log_lhd double")


def more_samples(run: Run, n: int, most: int = density.MOST_ITERATIONS, m_step=density.start_sites, e_step=density.near_start) -> None:
    """n more posterior samples of a finished run, added to its `density` and `samples` after the last one there."""
    last = run.read("samples").agg(F.max("sample")).first()[0] or 0
    trace, found = posterior_samples(run.read("mappings"), n, most, m_step, e_step, last + 1)
    run.write("density", trace, "append")
    run.write("samples", found, "append")


def _iterated(rows: DataFrame, most: int, m_step=density.start_sites, e_step=density.near_start) -> tuple[DataFrame, float]:
    lhd = 0.0
    for _ in range(most):
        places = m_step(rows)
        after = e_step(rows, density.normalised(places) if m_step is density.start_sites else places).checkpoint()
        row = density.convergence(rows, after).first()
        rows, lhd = after.drop("lhd"), row.log_lhd or 0.0
        if (row.max_change or 0.0) < density.LEAST_CHANGE:
            break
    return rows, lhd


def most_likely(mappings: DataFrame, stop_ratio: float = 1.5) -> DataFrame:
    """Fragment density from a uniform start: reads begin at the shares of their scores."""
    rows, _ = density.iterate(mappings, density.fragments, density.over_fragment, stop_ratio=stop_ratio)
    return density.fragments(rows)


def placed_by(mappings: DataFrame, trace: DataFrame) -> DataFrame:
    """Mappings with the shares that a saved density of start sites gives them."""
    return density.near_start(density.conditional(mappings), trace).drop("lhd")


def with_control(ip: DataFrame, nc: DataFrame, n: int = peaks.BOOTSTRAPS, most: int = density.MOST_ITERATIONS, m_step=density.fragments, e_step=density.over_fragment) -> DataFrame:
    """Peak scores (chr, track, pos, end, count, value) by runs: EM places the treatment's reads, one step places the control's by the treatment's density; n bootstraps of each are compared wherever any of them changes. m_step, e_step: the assay's; m_step takes the column that tells bootstraps apart."""
    placed, _ = density.iterate(ip, m_step, e_step, most=most)
    control = e_step(density.conditional(nc), m_step(placed)).drop("lhd")

    def drawn(rows: DataFrame, seed: int) -> DataFrame:
        one = sampling.bootstraps(rows.drop("lhd"), n, seed).withColumn("cond_prb", F.col("weight").cast("double"))
        runs = m_step(one, "bs")
        return runs if "end" in runs.columns else runs.withColumn("end", F.col("pos") + 1)

    return peaks.scores(overlay.higher_counts(drawn(placed, 1), drawn(control, 2), n), n)
