"""Probes, searches with mismatches, and what becomes of their hits."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixplane.functions.quality import N_SCORE, error_probability, read_score
from helixplane.functions.sequence import MOST_PACKED, at, first_bases, pack, packed_mismatches, pieces, reverse_complement, without_n

MOST_PROBES, MOST_HITS, MOST_FRAGMENT = 5, 5000, 524_287
#: Bases of the pieces in which genomes join, unless reads are longer; first bases by which saved indexes are partitioned; most changes under which a target is listed.
PIECE, SAVED_HEAD, MOST_CHANGES = 2048, 4, 10_000
#: Rows of targets under their changes (24 bytes each) that are broadcast at most.
MOST_BROADCAST = 1_000_000
#: Targets, with their probes' columns (some 100 bytes), that are broadcast at most.
MOST_TARGETS = 200_000


def _regions(reads: DataFrame, k: int, most: int) -> DataFrame:
    n = F.least(F.floor(F.length("seq") / k), F.lit(most)).cast("int")
    rows = reads.withColumn("n", n).filter("n > 0").withColumn("size", F.floor(F.length("seq") / F.col("n")).cast("int"))
    return rows.withColumn("probe_no", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("region", F.col("probe_no") * F.col("size"))


def select_probes(reads: DataFrame, k: int, most: int = MOST_PROBES, score: Column | None = None) -> DataFrame:
    """(read_id, mate, probe_no, offset, length, seq): the best window of k bases of each of up to `most` equal parts of a read.

    Best by score, a column over `window` (the bases), by default fewest unknown bases; ties to the first.
    """
    rows = _regions(reads, k, most).withColumn("offset", F.explode(F.sequence(F.col("region"), F.col("region") + F.greatest(F.col("size") - k - 1, F.lit(0)))))
    rows = rows.withColumn("window", F.substring("seq", F.col("offset") + 1, F.lit(k)))
    score = -F.length(F.regexp_replace("window", "[^Nn]", "")) if score is None else score
    best = rows.groupBy("read_id", "mate", "probe_no").agg(F.max_by(F.struct("offset", "window"), F.struct(score, -F.col("offset"))).alias("x"))
    return best.select("read_id", "mate", "probe_no", F.col("x.offset").alias("offset"), F.lit(k).alias("length"), without_n(F.col("x.window")).alias("seq"))


def window_quality(k: int, shift: int, log_odds: bool = False) -> Column:
    """A score for select_probes: the sum of what matches of the window's bases score by their quality characters; an unknown base has N_SCORE."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    match = lambda q: F.log10(1 - F.least(error_probability(q, shift, log_odds), F.lit(0.75)))
    scores = F.zip_with(letters(F.col("window")), letters(F.substr("qual", F.col("offset") + 1, F.lit(k))), lambda b, q: F.when(F.upper(b) == "N", F.lit(N_SCORE)).otherwise(match(q)))
    return F.round(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), 9)


def hashed_probes(reads: DataFrame, k: int, seed: int, most: int = MOST_PROBES) -> DataFrame:
    """As select_probes, at places that only depend on the read and the seed."""
    rows = _regions(reads, k, most)
    offset = F.col("region") + F.pmod(F.col("read_id") * 31 + F.col("probe_no") * 17 + seed, F.greatest(F.col("size") - k + 1, F.lit(1))).cast("int")
    return rows.select("read_id", "mate", "probe_no", offset.alias("offset"), F.lit(k).alias("length"), without_n(F.substring("seq", offset + 1, F.lit(k))).alias("seq"))


def both_strands(probes: DataFrame) -> DataFrame:
    """Each probe as it is (+) and reverse complemented (-), as `target`."""
    return probes.withColumn("x", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("target")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("target"))))).select("*", "x.strand", "x.target").drop("x")


def search_exact(probes: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Hits without mismatches, on both strands. Of a saved index only the partitions of the targets' first bases are read; the index isn't shuffled where up to MOST_TARGETS targets, which are counted, are asked for."""
    targets, word = _targets(probes, index)
    keys = [word]
    if "head" in index.columns:
        targets, keys = targets.withColumn("head", first_bases(F.col("code"), k, SAVED_HEAD)), ["head", "code"]
    return (F.broadcast(targets) if targets.count() <= MOST_TARGETS else targets).join(index, keys).withColumn("penalty", F.lit(0.0)).drop(*keys, "target")


def _targets(probes: DataFrame, index: DataFrame) -> tuple[DataFrame, str]:
    """Both strands of probes, with what they join the index by."""
    if "code" in index.columns:
        return both_strands(probes).withColumn("code", pack(F.col("target"))), "code"
    return both_strands(probes).withColumn("kmer", F.col("target")), "kmer"


def asked(probes: DataFrame, index: DataFrame) -> DataFrame:
    """What an index (chr, loc, code or kmer, …) has of the words that exact searches of the probes ask for, with all their places; what is derived from it for such a search (repeats, postings) is the same as from the whole index."""
    targets, word = _targets(probes, index)
    words = targets.select(word).distinct()
    return index.join(F.broadcast(words) if words.count() <= MOST_BROADCAST else words, word, "left_semi")


def wanted(probes: DataFrame) -> np.ndarray | None:
    """The packed words, sorted, that exact searches of the probes ask for, for index.packed to leave out all others; None if they are over MOST_TARGETS, which are counted."""
    words = both_strands(probes).select(pack(F.col("target")).alias("code")).filter("code is not null").distinct().limit(MOST_TARGETS + 1).toArrow()
    return None if words.num_rows > MOST_TARGETS else np.sort(words.column("code").to_numpy())


def _ball(bases: int, most: int) -> list[int]:
    """What changes a packed word of so many bases in up to `most` of them, by exclusive or."""
    return [sum(x << 2 * i for i, x in zip(places, change, strict=True)) for n in range(most + 1) for places in itertools.combinations(range(bases), n) for change in itertools.product((1, 2, 3), repeat=n)]


def _parts(k: int, mismatches: int, most: int = MOST_CHANGES) -> tuple[list[int], int]:
    """Where a word is cut, and how many mismatches its best part has at most: the cut with the fewest chance matches whose parts aren't searched under more than `most` changes, or MOST_CHANGES if none is."""

    def cost(n: int) -> tuple[bool, bool, float]:
        sizes, h = [k * (p + 1) // n - k * p // n for p in range(n)], mismatches // n
        balls = [sum(math.comb(s, i) * 3**i for i in range(h + 1)) for s in sizes]
        return sum(balls) > MOST_CHANGES, sum(balls) > most, sum(b / 4.0**s for b, s in zip(balls, sizes, strict=True)) + n * 1e-7

    n = min(range(1, min(mismatches + 1, k) + 1), key=cost)
    return [k * p // n for p in range(n + 1)], mismatches // n


def search(probes: DataFrame, index: DataFrame, k: int, mismatches: int) -> DataFrame:
    """Hits with up to so many mismatches, on both strands.

    Words are cut into n parts, of which one has mismatches // n mismatches at most: each distinct target
    is listed under all such changes of each part, by one whole number for part and bases, and joins the
    index's parts by equality. Packed words are compared by exclusive or within the join, so only hits
    leave it; a pair that meets by several parts counts by the first. The targets are counted: words are cut
    so that they make up to MOST_BROADCAST rows, if any cut does, and the index isn't shuffled; beyond, both sides are dealt by key, and
    repeats are better taken out first (index.unique_part). Index: (chr, loc, code), or (chr, loc, kmer), which is packed here; k is 31 at most.
    """
    if k > MOST_PACKED:
        raise ValueError(f"searches take words of up to {MOST_PACKED} bases")
    if "code" not in index.columns:
        index = index.withColumn("code", pack(F.col("kmer"))).drop("kmer")
    targets = both_strands(probes).withColumn("word", pack(F.col("target")))
    distinct = targets.select("word").distinct()
    n = targets.agg(F.count(F.lit(1)).alias("all"), F.countDistinct("word").alias("words")).first()
    edges, h = _parts(k, mismatches, MOST_BROADCAST // max(n.words, 1))
    spans = [(k - b, k - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]  # bases from the last
    part = lambda c, p: F.shiftrightunsigned(c, 2 * spans[p][0]).bitwiseAND(F.lit((1 << 2 * (spans[p][1] - spans[p][0])) - 1))
    key = lambda p, block: block * len(spans) + p
    listed = [(p, x) for p, (a, b) in enumerate(spans) for x in _ball(b - a, h)]  # MOST_CHANGES at most
    changes = probes.sparkSession.createDataFrame(listed, "part int, change long")
    block = functools.reduce(lambda out, p: F.when(F.col("part") == p, part(F.col("word"), p)).otherwise(out), range(len(spans)), F.lit(None).cast("long"))
    few = n.words * len(listed) <= MOST_BROADCAST
    wanted = distinct.crossJoin(F.broadcast(changes)).select("word", "part", key(F.col("part"), block.bitwiseXOR(F.col("change"))).alias("key"))
    held = index.withColumn("key", F.explode(F.array(*[key(p, part(F.col("code"), p)) for p in range(len(spans))])))
    near = packed_mismatches(F.col("word"), F.col("code"), 0, k)
    # by no earlier part
    first = functools.reduce(Column.__and__, [(F.col("part") <= p) | (packed_mismatches(F.col("word"), F.col("code"), *spans[p]) > h) for p in range(len(spans) - 1)], F.lit(True))
    pairs = (F.broadcast(wanted) if few else wanted).join(held, "key").filter((near <= mismatches) & first).withColumn("penalty", -near.cast("double")).drop("key", "part", "code", "head")
    return (F.broadcast(targets) if n.all <= MOST_TARGETS else targets).join(pairs, "word").drop("word", "target")


def staged(probes: DataFrame, index: DataFrame, k: int, mismatches: int, spread: int) -> DataFrame:
    """As search and then best_within (keys read_id, mate, probe_no), in stages of more mismatches: a probe whose best hit is so good that all hits within its spread are known doesn't go to the next, which lists a target under many more changes."""
    keys, out = ["read_id", "mate", "probe_no"], None
    stages = sorted({min(spread, mismatches), min(spread + 1, mismatches), mismatches})
    for m in stages:
        hits = search(probes, index, k, m)
        if m < mismatches:
            hits = hits.checkpoint()
            done = hits.groupBy(*keys).agg(F.max("penalty").alias("best")).filter(F.col("best") >= spread - m).select(*keys).checkpoint()
            hits, probes = hits.join(done, keys, "left_semi"), probes.join(done, keys, "left_anti").checkpoint()
        hits = best_within(hits, keys, "penalty", float(spread))
        out = hits if out is None else out.unionByName(hits)
        if m < mismatches and probes.isEmpty():
            break
    return out


def best_within(hits: DataFrame, keys: list[str], score: str, spread: Column | float, floor: Column | float | None = None, strict: bool = False) -> DataFrame:
    """Rows whose score is within the spread of the best one of the same keys (and of the floor, if higher)."""
    best = F.max(score).over(Window.partitionBy(*keys))
    if floor is not None:
        best = F.greatest(best, F.lit(floor) if isinstance(floor, float) else floor)
    spread = spread if isinstance(spread, Column) else F.lit(spread)
    return hits.withColumn("best", best).filter(F.col(score) > F.col("best") - spread if strict else F.col(score) >= F.col("best") - spread).drop("best")


def guard(hits: DataFrame, keys: list[str], most: int = MOST_HITS) -> tuple[DataFrame, DataFrame]:
    """Hits of keys with `most` hits at most, and the keys that have more, which give no hits."""
    counts = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"))
    void = counts.filter(F.col("n_hits") > most)
    return hits.join(void.select(*keys), keys, "left_anti"), void


def merge_diagonals(hits: DataFrame) -> DataFrame:
    """(read_id, mate, strand, chr, diagonal, n_probes, penalty): hits of a read's probes that agree on where it lies."""
    diagonal = F.when(F.col("strand") == "+", F.col("loc") - F.col("offset")).otherwise(F.col("loc") + F.col("offset"))
    merged = hits.withColumn("diagonal", diagonal).groupBy("read_id", "mate", "strand", "chr", "diagonal")
    return merged.agg(F.countDistinct("probe_no").cast("int").alias("n_probes"), F.max("penalty").alias("penalty"))


def read_starts(merged: DataFrame, reads: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """Candidates (read_id, mate, chr, start, length, strand) from diagonals; those that leave the contig go."""
    rows = merged.join(reads.select("read_id", "mate", F.length("seq").alias("length")), ["read_id", "mate"]).join(contigs.select("chr", F.length("seq").alias("contig")), "chr")
    start = F.when(F.col("strand") == "+", F.col("diagonal")).otherwise(F.col("diagonal") + k - F.col("length"))
    rows = rows.withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("contig")))
    return rows.select("read_id", "mate", "chr", F.col("start").cast("long").alias("start"), "length", "strand")


def held(contigs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The contigs that candidates (chr, …) lie on, told by a broadcast if they are up to MOST_TARGETS; else all, and joins by place do it."""
    names = candidates.select("chr").distinct()
    return contigs.join(F.broadcast(names), "chr", "left_semi") if names.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS else contigs


def piece_size(reads: DataFrame) -> int:
    """Bases of pieces such that a read lies within the piece of its start and the next."""
    return max(PIECE, reads.agg(F.max(F.length("seq"))).first()[0] or 0)


def aligned(candidates: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """Candidates (chr, start, length, …) with `genome`, the bases that they cover along the forward strand; null where they leave their contig. Candidates with an intron (split, gap) cover what lies on both its sides. Genomes join in pieces, by place; pieces are as long as the longest read at least."""
    cut = chunks(contigs, size, size)
    rows = candidates.withColumn("piece_no", F.floor(F.col("start") / size).cast("int")).join(cut, ["chr", "piece_no"])
    inside = F.col("start") - F.col("piece_no") * size
    whole = at(F.col("piece"), inside, F.col("length"))
    if "split" not in candidates.columns:
        return rows.withColumn("genome", whole).drop("piece", "piece_no")
    far = F.col("start") + F.when(F.col("gap") > 0, F.col("split") + F.col("gap")).otherwise(0)
    rows = rows.withColumn("genome", F.when(F.col("gap") > 0, at(F.col("piece"), inside, F.col("split"))).otherwise(whole)).drop("piece")
    rows = rows.withColumn("piece_no", F.floor(far / size).cast("int")).join(cut, ["chr", "piece_no"])
    rest = at(F.col("piece"), far - F.col("piece_no") * size, F.col("length") - F.col("split"))
    return rows.withColumn("genome", F.when(F.col("gap") > 0, F.concat("genome", rest)).otherwise(F.col("genome"))).drop("piece", "piece_no")


def rescore(candidates: DataFrame, reads: DataFrame, contigs: DataFrame, size: int | None = None) -> DataFrame:
    """Candidates with the score of the whole read (but for its first `trim` bases, if there is such a column) against the genome; null where a read leaves its contig."""
    size = piece_size(reads) if size is None else size
    rows = aligned(candidates.join(reads.select("read_id", "mate", "seq"), ["read_id", "mate"]), contigs, size)
    whole = F.substr("seq", F.col("trim") + 1) if "trim" in candidates.columns else F.col("seq")
    read = F.when(F.col("strand") == "+", F.upper(whole)).otherwise(reverse_complement(whole))
    return rows.withColumn("penalty", read_score(read, F.col("genome"))).drop("seq", "genome")


def chunks(contigs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(chr, piece_no, piece): contigs in pieces that overlap, so that any read lies within the piece of its start."""
    return contigs.select("chr", F.posexplode(pieces(F.upper("seq"), size, overlap)).alias("piece_no", "piece"))


def fragment_length(start1: Column, length1: Column, start2: Column, length2: Column) -> Column:
    return F.greatest(start1 + length1, start2 + length2) - F.least(start1, start2)


def pair(candidates: DataFrame, fragment_scores: DataFrame | None = None, most: int = MOST_FRAGMENT) -> DataFrame:
    """Mates' candidates of a read on one contig, within a fragment of `most` bases (introns of the mates are part of it); score: both mates' and the log10 chance of the length, if given (len, p)."""
    own = ["start", "length", "strand", "penalty", *[c for c in ("split", "gap") if c in candidates.columns]]
    one = lambda m: candidates.filter(F.col("mate") == m).select("read_id", "chr", *[F.col(c).alias(f"{c}{m}") for c in own])
    covers = lambda m: F.col(f"length{m}") + (F.col(f"gap{m}") if "gap" in own else F.lit(0))
    rows = one(1).join(one(2), ["read_id", "chr"]).withColumn("frag_len", fragment_length(F.col("start1"), covers(1), F.col("start2"), covers(2))).filter(F.col("frag_len") <= most)
    score = F.col("penalty1") + F.col("penalty2")
    if fragment_scores is not None:
        rows = rows.join(fragment_scores.select(F.col("len").alias("frag_len"), F.col("p")), "frag_len")
        score = score + F.log10("p")
    return rows.withColumn("score", score)
