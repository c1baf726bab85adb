"""Reads that arrive over time, mapped in micro-batches, under errors learnt from the batches before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixplane.operators import errors, index
from helixplane.plans.mapper import learn, map_reads, mapped_errors


def map_stream(reads: DataFrame, contigs: DataFrame, k: int, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, model: str = "mismatch", floor_p: float = 0.1) -> StreamingQuery:
    """Each micro-batch's mappings below path, in a folder of its own: a batch that is run again replaces what it wrote. The genome is indexed once, before the first.

    model estimated: a batch is mapped under error frequencies fitted to the counts of all earlier batches (the first under those of its own
    search by mismatches), and its best mappings' counts are written below path + "_errors". A batch only reads
    counts of batches with smaller numbers, so what a restart repeats comes out the same.
    """
    contigs = contigs.checkpoint()
    kmers = index.packed(contigs, k).checkpoint()

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.checkpoint()
        frequencies = None
        if model == "estimated":
            frequencies = model_so_far(batch, f"{path}_errors", number)
            frequencies = learn(batch, contigs, k, floor_p, kmers)[1] if frequencies is None else frequencies
        mappings, _ = map_reads(batch, contigs, k, floor_p, kmers=kmers, model=model, frequencies=frequencies)
        mappings.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if model == "estimated":
            mapped_errors(mappings, batch, contigs).write.mode("overwrite").parquet(f"{path}_errors/batch={number}")
        if sink:
            sink(mappings, number)

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def model_so_far(batch: DataFrame, path: str, number: int) -> DataFrame | None:
    """Frequencies fitted to the counts of batches before this one; None where there are none."""
    if not number:
        return None
    counts = batch.sparkSession.read.schema("mate int, strand string, qual int, pos int, n long, mm long, batch int").parquet(path).filter(F.col("batch") < number)
    total = counts.groupBy(*errors.KEYS).agg(F.sum("n").alias("n"), F.sum("mm").alias("mm")).checkpoint()
    return None if total.isEmpty() else errors.fit(total)
