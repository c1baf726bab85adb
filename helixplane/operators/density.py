"""Read density: where mappings put their probability, and how density changes it (expectation-maximisation).

Densities are sparse: (chr, track, pos, value), 0 elsewhere. Track 0 is the forward strand, 1 the reverse.
Mappings: (read_id, mapping_no, chr, start, stop, strand, score, cond_prb), half-open and 0-based.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import overlay, rounds

#: Bases on either side of a start site that share its density; bases of a bin in which sums along a contig are worked out.
WINDOW, BIN = 100, 1 << 20
#: Bases of a bin in which a round's sums are worked out: few, as what they lose grows with them.
ROUND = 1 << 14
#: Bases of a piece in which spans are dealt, and of a task that makes rows of them, as long as there are up to SPANNING tasks; bases of a run of one span's rows in it.
SPAN, SPANNED, SPANNING, RUN = 1 << 12, 1 << 22, 1 << 12, 1 << 8
# fixed values: when the iteration stops
MOST_ITERATIONS, LEAST_CHANGE, PRIOR = 500, 1e-2, 1e-10


def conditional(mappings: DataFrame, score: str = "score") -> DataFrame:
    """cond_prb: the softmax of a read's log10 scores."""
    w = Window.partitionBy("read_id")
    p = F.pow(F.lit(10.0), F.col(score) - F.max(score).over(w))
    return mappings.withColumn("p", p).withColumn("cond_prb", F.col("p") / F.sum("p").over(w)).drop("p")


def _track() -> Column:
    return F.when(F.col("strand") == "+", 0).otherwise(1)


def start_sites(mappings: DataFrame) -> DataFrame:
    """M-step of start sites: forward reads count where they start, reverse ones at their last base."""
    pos = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("stop") - 1)
    return mappings.groupBy("chr", _track().alias("track"), pos.alias("pos")).agg(F.sum("cond_prb").alias("value"))


def fragments(mappings: DataFrame, *keys: str) -> DataFrame:
    """M-step of whole fragments: cond_prb spread evenly over [start, stop).

    Runs (pos, end, value), by the overlay of one member: mappings are dealt once, by bins of places. keys: columns by which to tell several densities apart.
    """
    share = F.col("cond_prb") / (F.col("stop") - F.col("start"))
    spans = mappings.select(*keys, "chr", _track().alias("track"), F.col("start").alias("pos"), F.col("stop").alias("end"), share.alias("value"))
    return overlay.overlay(spans, 1, lambda g: g[0], keys=keys, decimals=None, member=F.lit(0))


def single_track(mappings: DataFrame) -> DataFrame:
    """As fragments, with both strands on track 0."""
    return fragments(mappings.withColumn("strand", F.lit("+")))


def bases(runs: DataFrame) -> DataFrame:
    """Runs as one row a base."""
    return runs.select(*[c for c in runs.columns if c not in ("pos", "end", "value")], F.explode(F.sequence("pos", F.col("end") - 1)).alias("pos"), "value")


def positions(spans: DataFrame) -> DataFrame:
    """Spans (…, start, stop), a row a contig or so, as one row a base, pos. They are cut at multiples of SPAN and dealt by place, so that a task has some SPANNED bases: no array grows with a contig, and few rows with many bases don't meet in one task.

    A task's rows come in runs of up to RUN bases, the same places of one span after the other: so few places recur at such short distances that columnar files take next to no room for them.
    """
    keys = [c for c in spans.columns if c not in ("start", "stop")]
    spans = spans.filter("start < stop").checkpoint()  # read three times
    bases_ = spans.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    within = lambda size: F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))
    clipped = lambda at, size: {"start": F.greatest("start", F.col(at) * size), "stop": F.least("stop", (F.col(at) + 1) * size)}
    cut = spans.withColumn("piece", F.explode(within(SPAN)))
    cut = cut.repartitionByRange(int(bases_ // max(SPANNED, bases_ // SPANNING)) + 1, "piece", *keys)
    runs = cut.withColumns(clipped("piece", SPAN)).withColumn("run", F.explode(within(RUN))).withColumns(clipped("run", RUN))
    return runs.sortWithinPartitions("run", *keys).select(*keys, F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))


def profile(mappings: DataFrame, shape: DataFrame, contigs: DataFrame | None = None, *keys: str) -> DataFrame:
    """M-step of single-end fragments: each start carries the binding-site profile (offset, d), forward or mirrored.

    Mappings with one place are summed before the profile is laid over them. contigs: (chr, length), at whose ends profiles are cut. keys: columns by which to tell several densities apart.
    """
    anchor = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("stop") - 1)
    sums = mappings.groupBy(*keys, "chr", _track().alias("track"), anchor.alias("anchor")).agg(F.sum("cond_prb").alias("p"))
    pos = F.when(F.col("track") == 0, F.col("anchor") + F.col("offset")).otherwise(F.col("anchor") - F.col("offset"))
    laid = sums.crossJoin(F.broadcast(shape)).withColumn("pos", pos).filter("pos >= 0")  # the profile has a row for each base of a fragment
    laid = laid if contigs is None else laid.join(contigs.select("chr", "length"), "chr").filter("pos < length")
    return laid.groupBy(*keys, "chr", "track", "pos").agg(F.sum(F.col("p") * F.col("d")).alias("value"))


def near_start(mappings: DataFrame, density: DataFrame, window: int = WINDOW) -> DataFrame:
    """E-step of start sites: cond_prb ∝ 10^score × density within the window (forward [start-w, start+w), reverse [stop-1-w, stop-1+w)).

    One pass over places and mappings together: a range frame sums the density by position within bins;
    places near a bin's edge go to the next bin too.
    """
    site = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("stop") - 1)
    sites = mappings.select("chr", _track().alias("track"), site.cast("long").alias("pos")).distinct().withColumn("asked", F.lit(True)).withColumn("value", F.lit(0.0))
    bin_ = lambda c: F.floor(c / BIN)
    around_ = F.sequence(bin_(F.col("pos") - window), bin_(F.col("pos") + window))
    both = density.select("chr", "track", F.col("pos").cast("long").alias("pos"), F.lit(False).alias("asked"), F.col("value").cast("double").alias("value")).withColumn("bin", F.explode(around_))
    both = both.unionByName(sites.withColumn("bin", bin_(F.col("pos"))))
    frame = Window.partitionBy("chr", "track", "bin").orderBy("pos").rangeBetween(-window, window - 1)
    around = both.withColumn("around", F.sum("value").over(frame)).filter("asked").select("chr", "track", "pos", "around")
    rows = mappings.withColumn("track", _track()).withColumn("pos", site.cast("long")).join(around, ["chr", "track", "pos"])
    return _renormalised(rows.withColumn("weight", F.pow(F.lit(10.0), "score") * (F.col("around") + 2 * 2.220446049250313e-16))).drop("track", "pos", "around")


def near_own_start(mappings: DataFrame, total: float | None = None, window: int = WINDOW) -> DataFrame:
    """near_start by the density of the mappings' own start sites, divided by `total` if given: the same in two shuffles, by place and by read, instead of eight.

    Running sums along places within bins of ROUND bases: what lies up to a window's end less what lies before its start, so
    neither many mappings nor many at one place are summed more than once each; mappings near a bin's edge are seen by the next bin too.
    """
    pos = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("stop") - 1).cast("long")
    home = F.floor(F.col("pos") / ROUND)
    rows = mappings.select(*[c for c in mappings.columns if c not in ("lhd", "was")], _track().alias("track"), pos.alias("pos"))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos") - window) / ROUND), F.floor((F.col("pos") + window) / ROUND))))
    w = Window.partitionBy("chr", "track", "bin").orderBy("pos")
    up_to = F.sum("cond_prb").over(w.rangeBetween(Window.unboundedPreceding, window - 1))
    before = F.coalesce(F.sum("cond_prb").over(w.rangeBetween(Window.unboundedPreceding, -window - 1)), F.lit(0.0))
    # a window holds the mapping itself, whatever is lost between large sums
    rows = rows.withColumn("around", F.greatest(up_to - before, F.col("cond_prb")) / F.lit(1.0 if total is None else total)).filter(F.col("bin") == home)
    rows = rows.withColumn("was", F.col("cond_prb")).withColumn("weight", F.pow(F.lit(10.0), "score") * (F.col("around") + 2 * 2.220446049250313e-16))
    return _renormalised(rows.drop("track", "pos", "bin", "around"))


def over_fragment(mappings: DataFrame, runs: DataFrame) -> DataFrame:
    """E-step of whole fragments: cond_prb ∝ 10^score × density of both tracks summed over [start, stop).

    A read without any density keeps its scores' shares.
    """
    asked = mappings.withColumns({"from": F.col("start"), "to": F.col("stop"), "height": F.lit(0.0), "asked": F.lit(True)})
    laid = runs.select("chr", F.col("pos").alias("from"), F.col("end").alias("to"), F.col("value").alias("height"), F.lit(False).alias("asked"))
    return _over_runs(asked.unionByName(laid, allowMissingColumns=True))


def over_own_fragments(mappings: DataFrame, total: float | None = None) -> DataFrame:
    """over_fragment by the density of the mappings' own fragments, divided by `total` if given: the same in two shuffles, by place and by read, and without piling up fragments. `was` keeps the shares before."""
    share = F.when(F.col("stop") > F.col("start"), F.col("cond_prb") / (F.col("stop") - F.col("start"))) / F.lit(1.0 if total is None else total)
    rows = mappings.select(*[c for c in mappings.columns if c not in ("lhd", "was")])
    return _over_runs(rows.withColumns({"was": F.col("cond_prb"), "from": F.col("start"), "to": F.col("stop"), "height": F.coalesce(share, F.lit(0.0)), "asked": F.lit(True)}))


def _over_runs(rows: DataFrame) -> DataFrame:
    """Rows that hold a density of `height` over [from, to); those asked are mappings, which get their shares by what all rows have there.

    Rows are dealt once, cut at the edges of bins of ROUND bases. Within a bin, each end changes the level, and the area up to a place is
    place × level less the sum of changes × their places; both are running sums. Parts of a mapping in several bins add up by read.
    """
    low, high = F.col("from").cast("long"), F.greatest("from", "to").cast("long")
    bins = F.sequence(F.floor(low / ROUND), F.floor(F.greatest(low, high - 1) / ROUND))
    cut = rows.withColumn("bin", F.explode_outer(bins)).repartition("chr", "bin")
    inside = lambda c: F.least(F.greatest(c - F.col("bin") * ROUND, F.lit(0)), F.lit(ROUND))
    end = lambda at, sign: F.struct(inside(at).alias("at"), F.lit(sign).alias("sign"))
    ends = cut.withColumn("x", F.explode(F.array(end(low, 1.0), end(high, -1.0)))).withColumn("at", F.col("x.at"))
    change = F.col("height") * F.col("x.sign")
    w = Window.partitionBy("chr", "bin").orderBy("at")
    ends = ends.withColumn("up_to", F.col("at") * F.sum(change).over(w) - F.sum(change * F.col("at")).over(w)).filter("asked")
    # both ends of a mapping lie in this task; what it has itself is there, whatever is lost between large sums
    own = Window.partitionBy("chr", "bin", "read_id", "mapping_no")
    part = F.greatest(-F.sum(F.col("up_to") * F.col("x.sign")).over(own), F.sum(-change * F.col("at")).over(own), F.lit(0.0))
    parts = ends.withColumn("part", F.when(F.col("chr").isNotNull(), part)).filter("x.sign > 0").withColumn("home", F.coalesce(F.col("bin") == F.floor(low / ROUND), F.lit(True)))
    area = F.coalesce(F.sum("part").over(Window.partitionBy("read_id", "mapping_no")), F.lit(0.0))
    whole = parts.drop("from", "to", "height", "asked", "bin", "x", "at", "up_to").repartition("read_id").withColumn("area", area).filter("home")
    return _renormalised(whole.withColumn("weight", F.pow(F.lit(10.0), "score") * F.col("area"))).drop("part", "home", "area")


def over_profile(mappings: DataFrame, density: DataFrame, shape: DataFrame) -> DataFrame:
    """E-step of single-end fragments: cond_prb ∝ 10^score × density of both tracks times the binding-site profile (offset, d), from the read's first base on, forward or mirrored.

    A read without any density keeps its scores' shares.
    """
    asked = _sited(mappings).withColumns({"height": F.lit(0.0), "asked": F.lit(True)})
    laid = density.select("chr", F.lit(0).alias("track"), F.col("pos").cast("long").alias("site"), F.col("value").alias("height"), F.lit(False).alias("asked"))
    return _over_places(asked.unionByName(laid, allowMissingColumns=True), shape)


def over_own_profile(mappings: DataFrame, shape: DataFrame) -> DataFrame:
    """over_profile by the mappings' own profiles, which nothing cuts but a contig's start: the same in two shuffles, by place and by read. `was` keeps the shares before."""
    rows = _sited(mappings.select(*[c for c in mappings.columns if c not in ("lhd", "was")]))
    return _over_places(rows.withColumns({"was": F.col("cond_prb"), "height": F.col("cond_prb"), "asked": F.lit(True)}), shape, own=True)


def _sited(mappings: DataFrame) -> DataFrame:
    site = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("stop") - 1).cast("long")
    return mappings.withColumns({"track": _track(), "site": site})


def _over_places(rows: DataFrame, shape: DataFrame, own: bool = False) -> DataFrame:
    """Rows that hold a density of `height` at `site` or, if own, the profile times it from there on; those asked are mappings, which get their shares by what all rows have under their profiles.

    Rows are dealt once, by bins of ROUND bases; those near a bin's edge are seen by the next bin too. Within a bin, each place where rows are asked or held is laid out once for each base of the profile.
    """
    shape = shape.filter("offset IS NOT NULL AND d IS NOT NULL")
    reach = shape.agg(F.coalesce(F.max(F.abs("offset")), F.lit(0)).cast("long").alias("reach"))
    home, far = F.floor(F.col("site") / ROUND), F.col("reach") * (2 if own else 1)
    cut = rows.crossJoin(F.broadcast(reach)).withColumn("bin", F.explode_outer(F.sequence(F.floor((F.col("site") - far) / ROUND), F.floor((F.col("site") + far) / ROUND))))
    cut = cut.drop("reach").repartition("chr", "bin")
    # rows of one place: the first of them stands for all
    place = Window.partitionBy("chr", "bin", "track", "site", "asked")
    first = F.row_number().over(place.orderBy("site")) == 1
    cut = cut.withColumn("first", first).withColumn("height", F.sum("height").over(place))
    bases_ = shape.agg(F.sort_array(F.collect_list(F.struct(F.col("offset").cast("long").alias("offset"), F.col("d").cast("double").alias("d")))).alias("bases"))
    one = F.array(F.struct(F.lit(0).cast("long").alias("offset"), F.lit(None).cast("double").alias("d")))
    laid = cut.crossJoin(F.broadcast(bases_)).withColumn("bases", F.when(F.col("asked") & F.col("first"), F.concat(one, F.col("bases"))).otherwise(one)).withColumn("x", F.explode("bases")).drop("bases")
    pos = F.when(F.col("track") == 0, F.col("site") + F.col("x.offset")).otherwise(F.col("site") - F.col("x.offset"))
    # what a row adds to the density at its base: nothing without a base of the profile, unless it is density itself
    adds = F.when(F.col("asked"), F.col("height") * F.col("x.d")).otherwise(F.when(F.col("first"), F.col("height")))
    laid = laid.withColumn("pos", pos).withColumn("held", F.sum(F.when(F.col("pos") >= 0, adds)).over(Window.partitionBy("chr", "bin", "pos"))).filter("asked")
    area = F.sum(F.when(F.col("pos") >= 0, F.col("held") * F.col("x.d"))).over(Window.partitionBy("chr", "bin", "track", "site"))
    areas = laid.withColumn("area", F.when(F.col("chr").isNotNull(), area)).filter("x.d IS NULL").filter(F.coalesce(F.col("bin") == home, F.lit(True)))
    return _renormalised(areas.withColumn("weight", F.pow(F.lit(10.0), "score") * F.coalesce("area", F.lit(0.0)))).drop("track", "site", "height", "asked", "bin", "first", "x", "pos", "held", "area")


def _renormalised(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("read_id")
    total, plain = F.sum("weight").over(w), F.pow(F.lit(10.0), "score")
    rows = rows.withColumn("total", total).withColumn("plain", F.sum(plain).over(w))
    # log_lhd is of all placements; the sum of weights is kept for it
    return rows.withColumn("cond_prb", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(plain / F.col("plain"))).withColumn("lhd", F.col("total")).drop("weight", "total", "plain")


def convergence(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("read_id", "mapping_no")) -> DataFrame:
    """One row: max_change, the greatest sum of changes within a read, and log_lhd of the reads."""
    rows = after.select(*keys, "cond_prb", "lhd").join(before.select(*keys, F.col("cond_prb").alias("was")), list(keys))
    per_read = rows.groupBy("read_id").agg(F.sum(F.abs(F.col("cond_prb") - F.col("was"))).alias("change"), F.max("lhd").alias("lhd"))
    return per_read.agg(F.max("change").alias("max_change"), F.sum(F.when(F.col("lhd") > 0, F.log10("lhd"))).alias("log_lhd"))


def normalised(density: DataFrame, *keys: str) -> DataFrame:
    """Values that sum to 1, over everything or for each key; the sum is a row a key. Keys are few (tracks, samples): sums are broadcast, as rows dealt by few keys would lie in few tasks."""
    total = density.groupBy(*keys).agg(F.sum("value").alias("total")) if keys else density.agg(F.sum("value").alias("total"))
    joined = density.join(F.broadcast(total), list(keys)) if keys else density.crossJoin(F.broadcast(total))
    return joined.withColumn("value", F.col("value") / F.col("total")).drop("total")


def iterate(mappings: DataFrame, m_step=start_sites, e_step=near_start, most: int = MOST_ITERATIONS, stop_ratio: float = 1.05, least_change: float = LEAST_CHANGE) -> tuple[DataFrame, list[tuple[float, float]]]:
    """EM until reads change little, or from the second round the likelihood's ratio lies within stop_ratio (if 1 or more).

    Each round is written to the checkpoint folder, so lineage stays short and lost executors cost one round; rounds of start sites within their window only send numbers (`rounds`).
    """
    history: list[tuple[float, float]] = []
    done = lambda: len(history) > 1 and (history[-1][0] < least_change or (stop_ratio >= 1 and abs(math.log10(0.95)) > history[-1][1] - history[-2][1] > -abs(math.log10(stop_ratio))))
    if (m_step, e_step) == (start_sites, near_start) and most:

        def over(found: list[tuple[float, float]]) -> bool:
            history[:] = found
            return done()

        out = rounds.start_sites(conditional(mappings), None, most, ROUND, WINDOW, over)
        if out:
            return out
    now = conditional(mappings).checkpoint()
    own = over_own_fragments if (m_step, e_step) == (fragments, over_fragment) else None
    for _ in range(most):
        if own:
            after = own(now).checkpoint()
            row = after.groupBy("read_id").agg(F.sum(F.abs(F.col("cond_prb") - F.col("was"))).alias("change"), F.max("lhd").alias("lhd"))
            row = row.agg(F.max("change").alias("max_change"), F.sum(F.when(F.col("lhd") > 0, F.log10("lhd"))).alias("log_lhd")).first()
            after = after.drop("was")
        else:
            after = e_step(now.drop("lhd"), normalised(m_step(now)) if m_step is start_sites else m_step(now)).checkpoint()
            row = convergence(now, after).first()
        history.append((row.max_change or 0.0, row.log_lhd or 0.0))
        now = after
        if done():
            break
    return now, history
