"""Scalar functions and tables against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from helixplane.functions import quality, sam, sequence, stats


@pytest.mark.parametrize(
    "k,n,adjusted,floor,cli,boot",
    [(20, 1, 0.01, -6, 4, 1), (20, 2, 0.1, -4, 2, 0), (20, 3, 0.215443, -3, 2, 0), (20, 4, 0.316228, -3, 1, 0), (20, 5, 0.398107, -2, 1, 0), (24, 1, 0.01, -6, 4, 1), (24, 2, 0.1, -4, 3, 0), (24, 3, 0.215443, -3, 2, 0), (24, 4, 0.316228, -3, 2, 0), (24, 5, 0.398107, -3, 1, 0)],
)
def test_probe_thresholds(k, n, adjusted, floor, cli, boot):
    assert abs(0.01 ** (1 / n) - adjusted) < 1e-6
    assert stats.probe_thresholds(k, n, 0.1, 0.05) == (floor, cli) and stats.probe_thresholds(k, n, 0.1, 0.001)[1] == boot


def test_read_thresholds_and_tails():
    assert stats.read_thresholds(50, 0.1, 0.05) == (-6, 3)
    tails = dict(stats.half_tails())
    assert tails[0] == 1 and abs(tails[25] - 2**-25) < 1e-15 and abs(tails[12] - 0.654981) < 1e-6


def test_gamma():
    assert abs(stats.gamma_cdf(1.0, 1.0) - (1 - math.exp(-1))) < 1e-12
    for shape in (0.3, 2.5, 40.0):
        for q in (0.01, 0.5, 0.99):
            assert abs(stats.gamma_cdf(stats.qgamma(q, shape, 1.0), shape) - q) < 1e-9


def test_sequences(spark):
    rows = spark.createDataFrame([("ACGTN",), ("acgt",), ("",), (None,), ("ACGTACGTAC" * 3,)], "s string")
    got = rows.select("s", sequence.reverse_complement(F.col("s")).alias("rc"), sequence.pack(F.col("s")).alias("p"), sequence.without_n(F.col("s")).alias("c")).collect()
    assert [r.rc for r in got[:4]] == ["NACGT", "ACGT", "", None]
    assert got[0].p is None and got[1].p == 0b00011011 and got[0].c == "ACGTA"
    back = rows.filter("length(s) = 30").select(sequence.unpack(sequence.pack(F.col("s")), 30).alias("u"), sequence.first_bases(sequence.pack(F.col("s")), 30, 4).alias("f"), sequence.last_bases(sequence.pack(F.col("s")), 2).alias("l")).first()
    assert back.u == "ACGTACGTAC" * 3 and back.f == 0b00011011 and back.l == 0b0001


def test_pieces_overlap(spark):
    seq = "".join("ACGT"[i * i % 4] for i in range(1003))
    got = spark.createDataFrame([(seq,)], "s string").select(sequence.pieces(F.col("s"), 100, 19).alias("p")).first().p
    assert got == [seq[i : i + 119] for i in range(0, 1003, 100)]


def test_qualities(spark):
    rows = spark.createDataFrame([("I", 0.0001), ("!", 1.0), ("5", 0.01)], "q string, p double")
    got = rows.select(quality.error_probability(F.col("q"), 33).alias("e"), quality.quality_character(F.col("p"), 33).alias("c")).collect()
    assert [r.c for r in got] == ["I", "!", "5"] and all(abs(r.e - p) < 1e-12 for r, p in zip(got, (1e-4, 1.0, 1e-2)))
    codes = spark.createDataFrame([(33, 73), (33, 74), (50, 80), (60, 104), (64, 104), (66, 104), (75, 104), (95, 104)], "lo int, hi int")
    assert [r.e for r in codes.select(quality.encoding(F.col("lo"), F.col("hi")).alias("e")).collect()] == ["sanger", "illumina_1.8", "shifted_50", "solexa", "illumina_1.3", "illumina_1.5", "shifted_50", None]


def test_sam(spark):
    rows = spark.createDataFrame([(True, True, False, 1.0), (False, False, True, 0.9), (True, False, True, 0.5)], "p boolean, r boolean, f boolean, x double")
    got = rows.select(sam.flag(F.col("p"), F.col("r"), F.col("f")).alias("flag"), sam.mapping_quality(F.col("x")).alias("q")).collect()
    assert [(r.flag, r.q) for r in got] == [(147, 254), (0, 10), (67, 3)]


def test_simulated_floors_are_near_the_gamma_fit(spark):
    from helixplane.operators import estimated

    rows = spark.createDataFrame([(k, [p] * 60) for k, p in enumerate((0.01, 0.05, 0.2))], "read_id long, p array<double>")
    floors = {r.read_id: r.floor for r in estimated.simulated_floors(rows, 2000).collect()}
    for k, p in enumerate((0.01, 0.05, 0.2)):
        good, bad = math.log10(1 - p), math.log10(p) - 0.477121
        mean = 60 * ((1 - p) * good + p * bad)
        variance = 60 * ((1 - p) * good**2 + p * bad**2 - (mean / 60) ** 2)
        fitted = stats.estimated_thresholds(mean, variance)[0] + 2.1
        assert abs(floors[k] - fitted) < 0.6 + 0.15 * abs(fitted) and floors[k] < mean


def test_genome_groups():
    from helixplane.sources.inputs import genome_groups

    got = genome_groups(["a/chr1.fa", "chr2_paternal.fa", "chr2_maternal.fa", "chr2.map"], 20)
    assert got == {"chr1": {"reference": "a/chr1.fa"}, "chr2": {"paternal": "chr2_paternal.fa", "maternal": "chr2_maternal.fa", "map": "chr2.map"}}
    for bad in (["chr1.fa", "chr1_x.fa"], ["chr2_paternal.fa", "chr2_maternal.fa"]):
        with pytest.raises(ValueError):
            genome_groups(bad)
    with pytest.raises(ValueError):
        genome_groups(["chr1.fa"], 21)
