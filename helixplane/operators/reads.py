"""Mapped reads: nested and flat, ordered by read; rejected reads; runs put together; SAM lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixplane.functions import sam

#: Why a read isn't mapped. Fixed values.
REASONS = {1: "no probes", 2: "too many candidates", 3: "search too long", 4: "too few valid probes", 5: "stack overrun", 6: "no candidates", 7: "none after assay correction", 8: "no pairs", 9: "none after filtering"}


def numbered(mappings: DataFrame, *order: str) -> DataFrame:
    """mapping_no from 0 within each read, by a total order."""
    return mappings.withColumn("mapping_no", F.row_number().over(Window.partitionBy("read_id").orderBy(*order)) - 1)


def nest(mappings: DataFrame, columns: list[str]) -> DataFrame:
    """(read_id, mappings): one row a read, its mappings sorted."""
    return mappings.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("mappings"))


def unnest(nested: DataFrame) -> DataFrame:
    """One row a mapping, with mapping_no."""
    return nested.select("read_id", F.posexplode("mappings").alias("mapping_no", "x")).select("read_id", "mapping_no", "x.*")


def rejects(reads: DataFrame, *stages: tuple[int, DataFrame]) -> DataFrame:
    """(read_id, error) of reads missing from a stage, with the reason of the first that they miss."""
    rows = reads.select("read_id").distinct()
    reason: Column = F.lit(None).cast("int")
    for error, stage in reversed(stages):
        name = f"in{error}"
        rows = rows.join(stage.select("read_id").distinct().withColumn(name, F.lit(True)), "read_id", "left")
        reason = F.when(F.col(name).isNull(), F.lit(error)).otherwise(reason)
    return rows.select("read_id", reason.alias("error")).filter("error is not null")


def counters(reads: DataFrame, mappings: DataFrame, rejected: DataFrame) -> DataFrame:
    """(counter, n): reads, mapped reads, mappings, and rejected reads by reason."""
    count = lambda rows, name, distinct: rows.agg((F.countDistinct("read_id") if distinct else F.count(F.lit(1))).alias("n")).select(F.lit(name).alias("counter"), "n")
    names = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("error"))
    by_reason = rejected.groupBy(F.concat(F.lit("rejected: "), names).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return count(reads, "reads", True).unionByName(count(mappings, "mapped reads", True)).unionByName(count(mappings, "mappings", False)).unionByName(by_reason)


def offsets(*runs: DataFrame) -> list[int]:
    """Where each run's read ids begin when they go on from those of the runs before: a number a run."""
    out = [0]
    for run in runs:
        out.append(out[-1] + (run.agg(F.max("read_id")).first()[0] if not run.isEmpty() else -1) + 1)
    return out[:-1]


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Reads or mappings of several runs as one, with run_id; read ids go on where the run before ends."""
    out = None
    for k, run in enumerate(runs):
        part = run.withColumn("run_id", F.lit(k)).crossJoin(F.broadcast(_offset(runs[:k]))).withColumn("read_id", F.col("read_id") + F.col("offset")).drop("offset")
        out = part if out is None else out.unionByName(part)
    return out


def _offset(runs: tuple[DataFrame, ...]) -> DataFrame:
    """One row: where the next run's ids begin."""
    total = None
    for run in runs:
        one = run.agg((F.coalesce(F.max("read_id"), F.lit(-1)) + 1).alias("offset"))
        total = one if total is None else total.unionByName(one)
    return total.agg(F.sum("offset").alias("offset")) if total is not None else runs_start()


def runs_start() -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().range(1).select(F.lit(0).cast("long").alias("offset"))


def within_bounds(mappings: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mappings that lie on their contig and have a probability from 0 to 1."""
    rows = mappings.join(contigs.select("chr", F.length("seq").alias("contig")), "chr")
    return rows.filter((F.col("start") >= 0) & (F.col("stop") <= F.col("contig")) & (F.col("start") < F.col("stop")) & F.col("cond_prb").between(0, 1)).drop("contig")


def sam_lines(mappings: DataFrame, reads: DataFrame, contigs: DataFrame, soft_clip: int = 0) -> DataFrame:
    """(read_id, mapping_no, line) of single-end mappings with cond_prb and log_seq_error; positions 1-based; reverse reads reverse complemented, their qualities reversed. soft_clip: the reads' first bases that weren't mapped; a mapping's `trim`, if there is such a column, adds to them."""
    rows = mappings.join(reads.select("read_id", F.col("name").alias("read_name"), "seq", "qual"), "read_id")
    covered = F.col("stop") - F.col("start") - (F.col("gap") if "gap" in mappings.columns else F.lit(0))
    rows = rows.withColumns({"paired": F.lit(False), "mate": F.lit(1), "length": covered, "next": F.lit("*"), "next_pos": F.lit("0"), "fragment": F.lit("0")})
    return _sam(rows, contigs, soft_clip).select("read_id", "mapping_no", "line")


def sam_pair_lines(mappings: DataFrame, reads: DataFrame, contigs: DataFrame, soft_clip: int = 0) -> DataFrame:
    """(read_id, mapping_no, mate, line) of mappings with start, length and strand of both mates: a line for each mate, with the place of the other and the fragment's length, negative on the right one (of mates that start together, the second)."""
    own = ["start", "length", "strand", *[c for c in ("split", "gap") if f"{c}1" in mappings.columns]]
    one = lambda m, o: F.struct(F.lit(m).alias("mate"), *[F.col(f"{c}{m}").alias(c) for c in own], F.col(f"start{o}").alias("other"))
    rows = mappings.withColumn("frag_len", F.col("stop") - F.col("start")).select("read_id", "mapping_no", "chr", "cond_prb", "log_seq_error", "frag_len", F.inline(F.array(one(1, 2), one(2, 1))))
    rows = rows.join(reads.select("read_id", "mate", F.col("name").alias("read_name"), "seq", "qual"), ["read_id", "mate"])
    first = (F.col("start") < F.col("other")) | ((F.col("start") == F.col("other")) & (F.col("mate") == 1))
    rows = rows.withColumns({"paired": F.lit(True), "next": F.lit("="), "next_pos": (F.col("other") + 1).cast("string"), "fragment": F.when(first, F.col("frag_len")).otherwise(-F.col("frag_len")).cast("string")})
    return _sam(rows, contigs, soft_clip).select("read_id", "mapping_no", "mate", "line")


def _sam(rows: DataFrame, contigs: DataFrame, soft_clip: int) -> DataFrame:
    from helixplane.functions.sequence import reverse_complement

    rows = rows.join(contigs.select("chr", F.col("name").alias("contig_name")), "chr")
    back = F.col("strand") == "-"
    number = lambda c: F.format_string("%.6f", c)
    clipped = F.lit(soft_clip) + (F.col("trim") if "trim" in rows.columns else F.lit(0))
    matched, clip = F.concat(F.col("length").cast("string"), F.lit("M")), F.when(clipped > 0, F.concat(clipped.cast("string"), F.lit("S"))).otherwise("")
    if "gap" in rows.columns:
        part = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("int").alias("len"))
        spliced = sam.cigar_text(F.array(part("M", F.col("split")), part("N", F.col("gap")), part("M", F.col("length") - F.col("split"))))
        matched = F.when(F.col("gap") > 0, spliced).otherwise(matched)
    line = F.concat_ws(
        "\t", "read_name", sam.flag(F.col("paired"), back, F.col("mate") == 1).cast("string"), "contig_name", (F.col("start") + 1).cast("string"), sam.mapping_quality(F.col("cond_prb")).cast("string"),
        F.when(back, F.concat(matched, clip)).otherwise(F.concat(clip, matched)), "next", "next_pos", "fragment", F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), F.when(back, F.reverse("qual")).otherwise(F.col("qual")),
        F.concat(F.lit("PQ:i:"), sam.score_quality(F.col("log_seq_error")).cast("string")), F.concat(F.lit("XQ:f:"), number(F.col("log_seq_error"))), F.concat(F.lit("XP:f:"), number(F.col("cond_prb"))),
    )
    return rows.withColumn("line", line)


def quality_encoding(reads: DataFrame) -> str:
    """The encoding of the reads' quality characters, over all reads; raises ValueError if none fits."""
    from helixplane.functions.quality import encoding

    codes = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), F.ascii)
    row = reads.filter("qual <> ''").agg(F.min(F.array_min(codes)).alias("a"), F.max(F.array_max(codes)).alias("b")).select("a", "b", encoding(F.col("a"), F.col("b")).alias("name")).first()
    if row.name is None:
        raise ValueError(f"no quality encoding has characters from {row.a} to {row.b}")
    return row.name


def sam_header(contigs: DataFrame) -> DataFrame:
    return contigs.select("chr", F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.length("seq").cast("string")).alias("line"))


#: The log10 chance of an untemplated G.
UNTEMPLATED = -1.30103


def untemplated_g(candidates: DataFrame, most: int = 1, score: float = UNTEMPLATED) -> DataFrame:
    """Each candidate, and variants whose first bases, leading Gs, aren't templated: (…, trim). Needs `seq`, the read."""
    rows = candidates.withColumn("trim", F.explode(F.sequence(F.lit(0), F.lit(most))))
    rows = rows.filter(F.upper(F.substring("seq", F.lit(1), F.col("trim"))) == F.repeat(F.lit("G"), F.col("trim")))
    return rows.select("read_id", "chr", "strand", "trim", F.when(F.col("strand") == "+", F.col("start") + F.col("trim")).otherwise(F.col("start")).alias("start"), (F.col("length") - F.col("trim")).alias("length"), (F.col("penalty") + F.col("trim") * score).alias("penalty"))


def with_untemplated_g(candidates: DataFrame, reads: DataFrame, most: int) -> DataFrame:
    """Candidates of reads that were searched without their first `most` bases, as candidates of the whole reads (trim 0) and, where a read's first bases are G, of the reads without these (trim 1 to most). Scores come after."""
    rows = candidates.join(reads.select("read_id", "mate", "seq"), ["read_id", "mate"]).withColumn("trim", F.explode(F.sequence(F.lit(0), F.lit(most))))
    rows = rows.filter(F.upper(F.substring("seq", F.lit(1), F.col("trim"))) == F.repeat(F.lit("G"), F.col("trim")))
    start = F.when(F.col("strand") == "+", F.col("start") - most + F.col("trim")).otherwise(F.col("start"))
    return rows.withColumn("start", start).withColumn("length", F.col("length") + most - F.col("trim")).filter("start >= 0").drop("seq")
