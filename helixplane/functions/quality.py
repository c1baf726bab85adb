"""Quality characters, error probabilities and scores. Scores are log10 probabilities; 0 is best."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import probe_thresholds

# fixed values of the scoring rules
LOG10_3 = 0.477121
N_SCORE = -0.60206
LEAST_ERROR = 1e-6
#: Decimals to which sums of probabilities are told apart.
SUM_DECIMALS = 6
#: Encodings: type, shift, log odds.
ENCODINGS = {"sanger": (33, False), "illumina_1.8": (33, False), "solexa": (59, True), "illumina_1.3": (64, False), "illumina_1.5": (64, False), "shifted_50": (50, False)}


def error_probability(quality: Column, shift: int, log_odds: bool = False) -> Column:
    """Of a quality character."""
    p = F.pow(F.lit(10.0), -(F.ascii(quality) - shift) / 10.0)
    return p / (1 + p) if log_odds else p


def quality_character(p: Column, shift: int) -> Column:
    return F.chr((F.floor(-10 * F.log10(p) + 0.5) + shift).cast("long"))


def encoding(least: Column, most: Column) -> Column:
    """The name of the encoding of characters with these least and greatest codes; null if none fits. The order of cases matters."""
    return (
        F.when(most == 73, "sanger")
        .when(most == 74, "illumina_1.8")
        .when(most.between(75, 90), "shifted_50")
        .when(least < 64, "solexa")
        .when(least < 66, "illumina_1.3")
        .when(least < 70, "illumina_1.5")
        .when(least < 90, "shifted_50")
    )


def mismatch_score(read: Column, genome: Column) -> Column:
    """0 for equal bases, -1 for others."""
    return F.when(read == genome, F.lit(0.0)).otherwise(F.lit(-1.0))


def estimated_score(read: Column, genome: Column, p: Column) -> Column:
    """With an error frequency p for this mate, strand, quality and position."""
    p = F.when(p == 0, F.lit(LEAST_ERROR)).otherwise(p)
    return F.when(genome == "N", F.lit(N_SCORE)).when(read == genome, F.log10(1 - p)).otherwise(F.log10(p) - LOG10_3)


def mismatch_probability(match_scores: Column) -> Column:
    """The chance that a base isn't the genome's, from an array of the scores of the letters it may be."""
    return 1 - F.pow(F.lit(10.0), F.array_max(match_scores))


def probe_score(scores: Column, start: Column, length: int) -> Column:
    """The sum of match scores (an array along the read) of a probe; unknown bases have N_SCORE there."""
    return F.aggregate(F.slice(scores, start + 1, length), F.lit(0.0), lambda a, x: a + x)


def read_score(read: Column, genome: Column) -> Column:
    """Of a whole read at a place, under the mismatch model; an unknown genome base costs N_SCORE."""
    pairs = F.zip_with(F.split(read, ""), F.split(genome, ""), lambda r, g: F.when(g == "N", F.lit(N_SCORE)).otherwise(mismatch_score(r, g)))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def score_moments(p: Column) -> tuple[Column, Column]:
    """Mean and variance of the score of reads with these error probabilities (an array of doubles)."""
    good, bad = lambda x: F.log10(1 - x), lambda x: F.log10(x) - LOG10_3
    mean = lambda x: (1 - x) * good(x) + x * bad(x)
    total = lambda f: F.aggregate(F.transform(p, f), F.lit(0.0), lambda a, x: a + x)
    return total(mean), total(lambda x: (1 - x) * F.pow(good(x), 2) + x * F.pow(bad(x), 2) - F.pow(mean(x), 2))


def effective_length(p: Column) -> Column:
    """Bases of a read that tell something: its length less expected errors, less one. Errors are summed to SUM_DECIMALS: sums of doubles may end just below the whole number that they make."""
    return F.size(p) - F.floor(F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), SUM_DECIMALS)) - 1


def is_informative(p: Column, genome_length: Column) -> Column:
    return F.pow(F.lit(4.0), effective_length(p)) / 2 > genome_length


def expected_score(p: Column) -> Column:
    """Sum of p log10 p over an array of probabilities; 0 counts nothing."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log10(x)).otherwise(0.0))


def drawn_base(u: Column, a: Column, c: Column, g: Column) -> Column:
    """The base that a uniform number draws from the chances of A, C and G; T has the rest."""
    return F.when(u < a, "A").when(u < a + c, "C").when(u < a + c + g, "G").otherwise("T")


def is_distribution(chances: Column, tolerance: float = 1e-6) -> Column:
    """Whether an array of log10 probabilities sums to 1."""
    return F.abs(F.aggregate(chances, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x)) - 1) <= tolerance


def probe_limits(probes: Column, k: int, most: int, floor_p: float, spread_p: float) -> tuple[Column, Column]:
    """Floor and spread of mismatch scores of probes of k bases, so many (1 to most) to a read: a number for each class."""
    found = [probe_thresholds(k, n, floor_p, spread_p) for n in range(1, most + 1)]
    return F.element_at(F.array(*[F.lit(f) for f, _ in found]), probes), F.element_at(F.array(*[F.lit(s) for _, s in found]), probes)


def read_limits(length: Column, floor_p: float, spread_p: float) -> tuple[Column, Column]:
    """Floor and spread of mismatch scores of whole reads."""
    return -F.floor(floor_p * length) - 1, F.floor(spread_p * length) + 1
