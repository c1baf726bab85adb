"""Columns of SAM lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mapping qualities and their cap.
MOST_QUALITY = 254


def flag(paired: Column, reverse: Column, first: Column) -> Column:
    """Bits 1 and 2 for pairs, 16 for the reverse strand, 64 or 128 for the mate."""
    bit = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    return bit(paired, 3).bitwiseOR(bit(reverse, 16)).bitwiseOR(F.when(paired, bit(first, 64).bitwiseOR(bit(~first, 128))).otherwise(F.lit(0)))


def mapping_quality(p: Column) -> Column:
    """Phred scale of 1 - p, MOST_QUALITY where p is 1."""
    return F.when(p >= 1, F.lit(MOST_QUALITY)).otherwise(F.least(F.lit(MOST_QUALITY), F.floor(-10 * F.log10(1 - p)))).cast("int")


def score_quality(score: Column) -> Column:
    return F.least(F.lit(MOST_QUALITY), F.floor(-10 * score)).cast("int")


def cigar_text(cigar: Column) -> Column:
    """Of an array of struct<op, len>."""
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def cigar_length(cigar: Column) -> Column:
    """Genome bases that it covers: matches and skipped regions."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin("M", "N")), F.lit(0), lambda a, x: a + x["len"])


def soft_clipped(length: Column, clip_start: Column, clip_end: Column) -> Column:
    """The CIGAR of a match with clipped ends."""
    part = lambda op, n: F.struct(F.lit(op).alias("op"), n.cast("int").alias("len"))
    whole = F.array(part("S", clip_start), part("M", length - clip_start - clip_end), part("S", clip_end))
    return F.filter(whole, lambda x: x["len"] > 0)
