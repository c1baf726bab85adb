"""Columns over nucleotide strings. N stands for an unknown base; case doesn't matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of base codes.
BASES = "ACGT"
#: Bases of the longest packed word.
MOST_PACKED = 31


def base_code(base: Column) -> Column:
    """A 0, C 1, G 2, T 3, anything else -1."""
    return F.instr(F.lit(BASES), F.upper(base)) - 1


def complement(seq: Column, strict: bool = False) -> Column:
    """N stays N; strict: it fails instead."""
    out = F.translate(F.upper(seq), "ACGT", "TGCA")
    return F.when(seq.rlike("[^ACGTacgt]"), F.raise_error(F.concat(F.lit("unknown base in "), seq))).otherwise(out) if strict else out


def reverse_complement(seq: Column) -> Column:
    """N stays N."""
    return F.reverse(complement(seq))


def without_n(seq: Column) -> Column:
    """Probes carry A where the base is unknown."""
    return F.translate(seq, "Nn", "AA")


def is_known(seq: Column) -> Column:
    return F.upper(seq).rlike("^[ACGT]+$")


def pack(seq: Column) -> Column:
    """Two bits a base, the first highest, as a long; null if a base isn't known or there are over MOST_PACKED."""
    code = F.conv(F.translate(F.upper(seq), BASES, "0123"), 4, 10).cast("long")
    return F.when(is_known(seq) & (F.length(seq) <= MOST_PACKED), code)


def packed_mismatches(a: Column, b: Column, low: int = 0, high: int = 31) -> Column:
    """Of packed words, among the bases low to high - 1 counted from the last."""
    differ = a.bitwiseXOR(b)
    return F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(sum(1 << 2 * i for i in range(low, high)))))


def unpack(code: Column, k: int) -> Column:
    letter = lambda i: F.substring(F.lit(BASES), (F.shiftrightunsigned(code, 2 * (k - 1 - i)).bitwiseAND(3) + 1).cast("int"), F.lit(1))
    return F.concat(*[letter(i) for i in range(k)])


def first_bases(code: Column, k: int, n: int) -> Column:
    """The first n of a packed word of k bases."""
    return F.shiftrightunsigned(code, 2 * (k - n))


def last_bases(code: Column, n: int) -> Column:
    return code.bitwiseAND((1 << 2 * n) - 1)


def at(seq: Column, start: Column, length) -> Column:
    """The slice from a 0-based start; null beyond either end."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.when((start >= 0) & (start + n <= F.length(seq)), F.substring(seq, start.cast("int") + 1, n.cast("int")))


def contig_prefix(name: Column) -> Column:
    """What stands before the first underscore: paternal and maternal copies share it."""
    return F.substring_index(name, "_", 1)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches between strings of equal length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def pieces(seq: Column, size: int, overlap: int) -> Column:
    """Array of pieces of so many bases, each with the start of the next (up to size bases): long sequences are cut once, from left to right."""
    cut = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    after = F.concat(F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1))), F.array(F.lit("")))
    return F.zip_with(cut, after, lambda a, b: F.concat(a, F.substring(b, 1, overlap)))
