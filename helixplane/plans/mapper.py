"""From reads to mappings to density: the operators in their order."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixplane.functions.quality import ENCODINGS
from helixplane.functions.stats import probe_thresholds
from helixplane.operators import density, diploid, errors, estimated, index, reads as reads_, search, spliced

#: Reads from which error frequencies are learnt, about so many by a hash of their id; the spread of scores under the estimated model.
LEARNT, SPREAD = 200_000, 2.0


def _probes(reads: DataFrame, k: int, introns: tuple[int, int] | None, encoding: str | None = None) -> DataFrame:
    """Probes with n, how many their read has: windows with the best qualities if their encoding is given, else with the fewest unknown bases."""
    score = search.window_quality(k, *ENCODINGS[encoding]) if encoding else None
    probes = spliced.end_probes(reads, k, score) if introns else search.select_probes(reads, k, score=score)
    counts = probes.groupBy("read_id", "mate").agg(F.count(F.lit(1)).alias("n"))
    return probes.join(counts, ["read_id", "mate"]).checkpoint()


def mismatch_hits(probes: DataFrame, kmers: DataFrame, k: int, floor_p: float) -> DataFrame:
    """Hits by mismatches: each class of probes (n to a read) has its own floor and spread."""
    classes: dict[tuple[int, int], list[int]] = {}
    for r in probes.select("n").distinct().orderBy("n").collect():  # MOST_PROBES numbers
        floor, spread = probe_thresholds(k, r.n, floor_p, floor_p / 2)
        classes.setdefault((-floor, spread), []).append(r.n)
    found = [search.staged(probes.filter(F.col("n").isin(ns)), kmers, k, m, spread) for (m, spread), ns in (classes or {(0, 0): [0]}).items()]
    return functools.reduce(DataFrame.unionByName, found).drop("n")


def estimated_hits(probes: DataFrame, reads: DataFrame, kmers: DataFrame, k: int, own: DataFrame, genome: int, skipped: int = 0) -> DataFrame:
    """Hits by scores under penalties of reads; reads and probes that tell too little for a genome of so many bases aren't searched."""
    told = probes.join(estimated.informative(own, genome), ["read_id", "mate"], "left_semi")
    targets = estimated.probe_targets(told, reads, own, skipped).filter(F.pow(F.lit(4.0), "information") / 2 > genome)
    return search.best_within(estimated.search(targets, kmers, k), ["read_id", "mate", "probe_no"], "penalty", SPREAD).drop("n")


def _whole(hits: DataFrame, repeats: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Hits with all their places, and the probes that have too many: copies of repeats count before they are listed."""
    keys = ["read_id", "mate", "probe_no"]
    if repeats is not None:
        void = hits.groupBy(*keys).agg(F.sum("copies").alias("n_hits")).filter(F.col("n_hits") > search.guard.__defaults__[0])
        hits = index.expand_postings(hits.join(void.select(*keys), keys, "left_anti"), repeats)
    else:
        hits, void = search.guard(hits, keys)
    return (diploid.expand_hits(hits) if "mat_loc" in hits.columns else hits), void


def _candidates(hits: DataFrame, reads: DataFrame, whole: DataFrame, contigs: DataFrame, k: int, untemplated: int, introns: tuple[int, int] | None) -> DataFrame:
    places = search.read_starts(search.merge_diagonals(hits), reads, contigs, k)
    if introns:
        both = places.withColumns({"split": F.lit(0), "gap": F.lit(0)})
        return both.unionByName(spliced.candidates(hits, reads, contigs, k, *introns))
    return reads_.with_untemplated_g(places, whole, untemplated) if untemplated else places


def _inner(reads: DataFrame, untemplated: int) -> DataFrame:
    """Reads without the bases that may be untemplated."""
    rest = lambda c: F.substr(c, F.lit(untemplated + 1))
    return reads.withColumn("seq", rest("seq")).withColumn("qual", rest("qual")) if untemplated else reads


def learn(reads: DataFrame, contigs: DataFrame, k: int, floor_p: float, kmers: DataFrame, untemplated: int = 0, repeats: DataFrame | None = None, introns: tuple[int, int] | None = None, probes: DataFrame | None = None, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(errors, frequencies): counts by mate, strand, quality and place where LEARNT reads (by a hash of their id) lie best by mismatches, and the frequencies fitted to them."""
    inner = _inner(reads, untemplated)
    probes = _probes(inner, k, introns, encoding) if probes is None else probes
    sample = F.pmod(F.xxhash64("read_id"), F.lit(1 << 20)) < max(1, (LEARNT << 20) // max(reads.count(), LEARNT))
    hits, _ = _whole(mismatch_hits(probes.filter(sample), kmers, k, floor_p).checkpoint(), repeats)
    # bases that may be untemplated tell nothing of errors: they have the frequencies of the first base after them
    found = search.rescore(_candidates(hits.checkpoint(), inner, inner, contigs, k, 0, introns), inner, contigs).filter("penalty is not null").checkpoint()
    found, _ = search.guard(found, ["read_id", "mate"])
    counts = errors.counts(estimated.best_hits(found, inner, contigs)).withColumn("pos", F.col("pos") + untemplated).checkpoint()
    fitted = errors.fit(counts).checkpoint()
    first = [fitted.filter(F.col("pos") == untemplated + 1).withColumn("pos", F.lit(p)) for p in range(1, untemplated + 1)]
    return counts, functools.reduce(DataFrame.unionByName, first, fitted)


def map_reads(
    reads: DataFrame, contigs: DataFrame, k: int, floor_p: float = 0.1, kmers: DataFrame | None = None, fragment_lengths: DataFrame | None = None, model: str = "mismatch", untemplated: int = 0,
    repeats: DataFrame | None = None, introns: tuple[int, int] | None = None, frequencies: DataFrame | None = None, encoding: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mappings, rejects) under the mismatch model, or one whose error frequencies are estimated: learnt (unless they are given) from a search by mismatches of LEARNT reads, then used in the search of all.

    reads: (read_id, mate, name, seq, qual), mate 1 alone or 1 and 2. mappings: (read_id, mapping_no, chr,
    start, stop, strand, log_seq_error, score, cond_prb), paired ones over the whole fragment with its mate 1's strand, and
    start, length and strand of each mate. untemplated: so many Gs may stand before a (single) read that the genome doesn't have;
    mappings then have `trim`, the Gs left out. kmers: an index, which may be collapsed (repeats then holds the places of its repeats) or
    diploid (shared hits then come in both copies). introns: the least and greatest length of an intron within a read; mappings then have
    `split` and `gap` (of each mate). encoding: of the qualities, by which probes are then chosen.
    """
    if introns and untemplated:
        raise ValueError("untemplated Gs and introns exclude each other")
    kmers = index.packed(contigs, k) if kmers is None else kmers
    inner = _inner(reads, untemplated)
    probes = _probes(inner, k, introns, encoding)
    if model == "estimated":
        if frequencies is None:
            _, frequencies = learn(reads, contigs, k, floor_p, kmers, untemplated, repeats, introns, probes)
        size = contigs.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0
        own = estimated.penalties(reads, frequencies).checkpoint()
        hits = estimated_hits(probes, inner, kmers, k, own, size, untemplated)
    else:
        hits = mismatch_hits(probes, kmers, k, floor_p)
    hits, void_probes = _whole(hits.checkpoint(), repeats)
    hits, void_probes = hits.checkpoint(), void_probes.checkpoint()
    places = _candidates(hits, inner, reads, contigs, k, untemplated, introns)
    if model == "estimated":
        found = estimated.rescore(places, reads, contigs, own).filter("penalty is not null").checkpoint()
    else:
        found = search.rescore(places, reads, contigs).filter("penalty is not null").checkpoint()
    # pairs would join all candidates of one mate with all of the other
    found, void_reads = search.guard(found, ["read_id", "mate"])
    length = F.col("length")
    floor, spread = -F.floor(floor_p * length) - 1.0, F.floor(floor_p / 2 * length) + 1.0
    if model == "estimated":
        floors_ = found.groupBy("read_id").agg(F.min("floor").alias("read_floor"))
        floor, spread = F.col("read_floor"), F.lit(SPREAD)
    more = ["trim"] if untemplated else ["split", "gap"] if introns else []
    if untemplated:
        found = found.withColumn("penalty", F.col("penalty") + F.col("trim") * reads_.UNTEMPLATED)
    if introns:
        found = found.withColumn("penalty", F.col("penalty") + F.when(F.col("gap") > 0, spliced.INTRON).otherwise(0.0))
        floor = floor + spliced.INTRON  # which makes no read too poor
    single = reads.filter("mate = 2").isEmpty()
    if single:
        good = found.withColumn("score", F.col("penalty"))
        good = (good.drop("floor").join(floors_, "read_id") if model == "estimated" else good).withColumn("floor", 2 * floor)
        good = search.best_within(good, ["read_id"], "score", spread, F.col("floor"), strict=True)
        stop = F.col("start") + length + (F.col("gap") if introns else F.lit(0))
        good = good.select("read_id", "chr", "start", stop.alias("stop"), "strand", F.col("score").alias("log_seq_error"), "score", *more)
    else:
        pairs = search.pair(found, fragment_lengths).withColumn("length", F.col("length1") + F.col("length2"))
        pairs = pairs.join(floors_, "read_id") if model == "estimated" else pairs
        good = search.best_within(pairs.withColumn("floor", 2 * floor), ["read_id"], "score", spread, F.col("floor"), strict=True)
        mates = [f"{c}{m}" for m in (1, 2) for c in ["start", "length", "strand", *more]]
        good = good.select("read_id", "chr", F.least("start1", "start2").alias("start"), (F.least("start1", "start2") + F.col("frag_len")).alias("stop"), F.col("strand1").alias("strand"), (F.col("penalty1") + F.col("penalty2")).alias("log_seq_error"), "score", *mates)
    order = ["chr", "start", "strand", "stop", "score", *[c for c in ("split", "gap") if c in good.columns]]
    mappings = density.conditional(reads_.numbered(good, *order)).checkpoint()
    rejects = reads_.rejects(reads, (1, probes), (4, hits), (8, found), (9, mappings))
    # what the guards left out had too many places, not too few
    void = void_probes.select("read_id").union(void_reads.select("read_id")).distinct().withColumn("void", F.lit(True))
    error = F.when(F.col("void") & F.col("error").isin(4, 8, 9), 2).otherwise(F.col("error"))
    return mappings, rejects.join(void, "read_id", "left").select("read_id", error.alias("error"))


def mapped_errors(mappings: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Error counts (mate, strand, qual, pos, n, mm) where each read's best mapping lies; of mappings without untemplated bases or introns."""
    if "start1" in mappings.columns:
        mates = F.array(*[F.struct(F.lit(m).alias("mate"), F.col(f"start{m}").alias("start"), F.col(f"length{m}").alias("length"), F.col(f"strand{m}").alias("strand")) for m in (1, 2)])
        rows = mappings.select("read_id", "chr", F.col("score").alias("penalty"), F.inline(mates))
    else:
        rows = mappings.select("read_id", "chr", F.col("score").alias("penalty"), F.lit(1).alias("mate"), "start", (F.col("stop") - F.col("start")).alias("length"), "strand")
    return errors.counts(estimated.best_hits(rows, reads, contigs))


def posterior_density(mappings: DataFrame) -> DataFrame:
    """Marginal density of start sites under the prior of the scores."""
    return density.start_sites(mappings)
