"""Numbers, fits, overlays and stages of searches against plain versions; whole runs with controls, pools of samples, streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixplane.operators import density, errors, fragments, index, overlay, sampling, search, traces
from helixplane.plans import cli, commands
from helixplane.plans.config import Config

READS, CONTIGS = "read_id long, mate int, name string, seq string, qual string", "chr int, name string, seq string"
FLIP = str.maketrans("ACGT", "TGCA")


def back(s):
    return s.translate(FLIP)[::-1]


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_numbers_of_many_keys_differ(spark):
    rows = spark.range(3_000_000).select("id", sampling.uniform(F.col("id"), 1, 5).alias("a"), sampling.uniform(F.col("id"), 2, 5).alias("b"))
    r = rows.agg(F.count_distinct("a", "b").alias("both"), F.count_distinct("a").alias("a"), F.avg("a").alias("mean"), F.corr("a", "b").alias("corr"), F.max("a").alias("top")).first()
    assert r.both == 3_000_000 and r.a >= 3_000_000 - 10 and abs(r.mean - 0.5) < 0.002 and abs(r["corr"]) < 0.003 and r.top < 1


def test_keys_are_numbered_in_their_order(spark):
    ids = [5, 900, 3, 77, 3, 12, 5, -4]
    rows = spark.createDataFrame([(i,) for i in ids], "read_id long")
    assert {r.read_id: r.number for r in sampling.numbered(rows, "read_id").collect()} == {d: k for k, d in enumerate(sorted(set(ids)))}
    assert sampling.numbered(rows.limit(0), "read_id").collect() == [] and sampling.bootstraps(density.conditional(_mappings(spark, 0)), 3).collect() == []


def _mappings(spark, n, seed=2):
    rng = random.Random(seed)
    rows = [(i, m, 1, at, at + 30, rng.choice("+-"), -rng.random() * 2) for i in range(n) for m in range(rng.randrange(1, 4)) for at in [rng.randrange(2000)]]
    return spark.createDataFrame(rows, "read_id long, mapping_no int, chr int, start int, stop int, strand string, score double")


def test_known_curves_are_fitted(spark):
    rng = random.Random(4)
    true = lambda mate, q, p: 1 / (1 + math.exp(-(-3 - 0.08 * (q - 40) + (0.9 if mate == 1 else -0.4) * math.sin(p / 9))))
    binomial = lambda n, p: sum(rng.random() < p for _ in range(n))
    rows = [(m, "+", q, p, 800, binomial(800, true(m, q, p))) for m in (1, 2) for q in range(35, 75, 5) for p in range(1, 61, 2)]
    rows += [(1, "+", 50, 70, 3, 1), (2, "-", 40, 1, 50, 0)]
    got = {(r.mate, r.qual, r.pos): r.p for r in errors.fit(spark.createDataFrame(rows, "mate int, strand string, qual int, pos int, n long, mm long").repartition(7)).collect() if r.strand == "+"}
    wrong = [abs(got[m, q, p] / true(m, q, p) - 1) for m, _, q, p, n, _ in rows[:-2]]
    assert len(got) == len(rows) - 1 and sum(wrong) / len(wrong) < 0.12 and max(wrong) < 0.6
    assert abs(got[1, 50, 70] - 1 / 3.01) < 1e-9  # few observations: its own rate


def test_splines_sum_to_one_and_are_local():
    import numpy as np

    x = np.linspace(3, 11, 200)
    b = errors.splines(x, 3, 11)
    assert np.allclose(b.sum(1), 1) and (b >= 0).all() and ((b > 0).sum(1) <= 4).all() and np.abs(np.diff(b, axis=0)).max() < 0.05
    assert errors.splines(np.array([5.0]), 5, 5).sum() == pytest.approx(1)


def test_overlays_do_not_depend_on_bins(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for m in range(6):
        at = 0
        while at < 900:
            at += rng.choice((0, 0, rng.randrange(1, 60)))
            n = rng.randrange(1, 90)
            rows.append((m, 1, 0, at, at + n, float(rng.randrange(1, 4))))
            at += n
    runs = spark.createDataFrame(rows, "member int, chr int, track int, pos long, end long, value double")
    grid = [[0.0] * 1200 for _ in range(6)]
    for m, _, _, a, b, v in rows:
        grid[m][a:b] = [v] * (b - a)
    held = [any(g[i] for g in grid) for i in range(1200)]
    for size in (1 << 16, 64):
        monkeypatch.setattr(overlay, "BIN", size)
        for how, f in (("min", min), ("max", max), ("sum", sum)):
            out = overlay.aggregate(runs, how, 6).collect()
            got = {i: r.value for r in out for i in range(r.pos, r.end)}
            assert got == {i: f(g[i] for g in grid) for i in range(1200) if held[i]} and len(got) == sum(r.end - r.pos for r in out)
            if size > 1200:
                ends = {r.end: r.value for r in out}
                assert all(ends.get(r.pos) != r.value for r in out)  # as long as they can be
    assert overlay.aggregate(runs.limit(0), "max", 6).collect() == []


def test_stages_equal_one_search_and_list_less(spark):
    rng = random.Random(12)
    seq = dna(rng, 20_000)
    contigs = spark.createDataFrame([(1, "c", seq)], CONTIGS)
    rows = []
    for i in range(40):
        s = list(seq[100 * i : 100 * i + 20])
        for p in rng.sample(range(20), (0, 0, 0, 0, 1, 2, 5, 6)[i % 8]):
            s[p] = rng.choice([b for b in "ACGT" if b != s[p]])
        rows.append((i, 1, 0, 0, 20, "".join(s)))
    probes = spark.createDataFrame(rows, "read_id long, mate int, probe_no int, offset int, length int, seq string")
    held = index.packed(contigs, 20).checkpoint()
    keys = ["read_id", "mate", "probe_no"]
    key = lambda d: sorted((r.read_id, r.strand, r.loc, r.penalty) for r in d.collect())
    assert key(search.staged(probes, held, 20, 6, 4)) == key(search.best_within(search.search(probes, held, 20, 6), keys, "penalty", 4.0))
    # exact reads, most of all, leave after the first stage: a target is listed ten times less often there
    edges = {m: search._parts(20, m) for m in (4, 6)}
    listed = {m: sum(len(search._ball(b - a, h)) for a, b in zip(e[:-1], e[1:])) for m, (e, h) in edges.items()}
    chance = {m: sum(len(search._ball(b - a, h)) / 4.0 ** (b - a) for a, b in zip(e[:-1], e[1:])) for m, (e, h) in edges.items()}
    assert chance[6] >= 8 * chance[4] and listed[6] > 0


def test_fragment_lengths_are_learnt_or_normal(spark):
    rows = spark.createDataFrame([(i, 0, 1, 0, 150 + i % 20) for i in range(200)], "read_id long, mapping_no int, chr int, start int, stop int")
    assert {r.len for r in fragments.learnt(rows).collect()} <= set(range(150, 170))
    few = fragments.learnt(rows.limit(20))
    assert few.count() == 101 and abs(few.agg(F.sum("p")).first()[0] - 1) < 1e-9


@pytest.fixture(scope="module")
def genome():
    return dna(random.Random(3), 6000)


def _pairs(path, seq, starts, name):
    one, two = [], []
    for i, at in enumerate(starts):
        one.append(f"@{name}{i}/1\n{seq[at : at + 40]}\n+\n{'I' * 40}\n")
        two.append(f"@{name}{i}/2\n{back(seq[at + 120 : at + 160])}\n+\n{'I' * 40}\n")
    (path / f"{name}_1.fq").write_text("".join(one))
    (path / f"{name}_2.fq").write_text("".join(two))
    return str(path / f"{name}_1.fq"), str(path / f"{name}_2.fq")


def test_a_run_with_a_control_its_peaks_aggregates_and_a_merge(spark, genome, tmp_path):
    rng = random.Random(9)
    (tmp_path / "g.fa").write_text(f">c\n{genome}\n")
    ip = _pairs(tmp_path, genome, [2000 + rng.randrange(40) for _ in range(60)] + [rng.randrange(5800) for _ in range(20)], "ip")
    nc = _pairs(tmp_path, genome, [rng.randrange(5800) for _ in range(60)], "nc")
    g = [str(tmp_path / "g.fa")]
    out = cli.run(spark, Config(genome=g, output=str(tmp_path / "a"), pair1=ip[0], pair2=ip[1], control1=nc[0], control2=nc[1], assay="chip", model="mismatch", encoding="sanger"))
    top = out.read("peaks").orderBy(F.desc("value"), F.desc(F.col("end") - F.col("pos"))).first()
    assert 2000 <= top.pos < top.end <= 2200 and top.value > 0.99 and out.read("control").select("read_id").distinct().count() == 60
    assert commands.config_of(spark, out.path).encoding == "sanger" and out.read("fragments").count() == 101
    commands.export(out, str(tmp_path / "kept"))
    from helixplane.sources import binary

    assert cli.load_genome(spark, [str(tmp_path / "kept.genome")]).first().seq == genome
    kept = binary.read_trace(spark, str(tmp_path / "kept.trace"))
    assert {(r.contig, r.track) for r in kept.collect()} == {("c", "fwd_strnd_read_density")} and kept.agg(F.sum("value")).first()[0] == pytest.approx(out.read("density").agg(F.sum("value")).first()[0], rel=1e-5)
    trace = density.start_sites(out.read("mappings"))
    out.write("density", trace.withColumn("sample", F.lit(1)).unionByName(trace.filter("value < 1").withColumn("sample", F.lit(2))), "append")
    out.write("samples", spark.createDataFrame([(1, -1.0), (2, -2.0)], "sample int, log_lhd double"))
    one = commands.aggregates(out)
    assert one.count() > 0 and one.filter("min_value > max_value or sum_value < max_value").count() == 0
    both = commands.merge(spark, [out.path, out.path], str(tmp_path / "both"))
    assert both.read("mappings").count() == 2 * out.read("mappings").count() and both.read("mappings").select("read_id").distinct().count() == 160
    assert both.read("density").agg(F.sum("value")).first()[0] == pytest.approx(160)
    with pytest.raises(ValueError, match="differ"):
        other = Config(genome=g, output=str(tmp_path / "x"), unpaired="r")
        spark.createDataFrame([(other.dumps(),)], "value string").coalesce(1).write.text(str(tmp_path / "x/config"))
        commands.merge(spark, [out.path, str(tmp_path / "x")], str(tmp_path / "y"))


def test_a_pool_of_samples_keeps_failures_apart(spark, genome, tmp_path):
    (tmp_path / "g.fa").write_text(f">c\n{genome}\n")
    for name, at in (("a", 100), ("b", 900), ("c", 2500)):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{name}{i}\n{genome[at + 50 * i : at + 50 * i + 50]}\n+\n{'I' * 50}\n" for i in range(6)))
    (tmp_path / "bad.fq").write_text("@x\nACGT\n+\n\x7f\x7f\x7f\x7f\n")
    (tmp_path / "samples.tsv").write_text(f"one\t1\t{tmp_path}/a.fq,{tmp_path}/b.fq\none\t2\t{tmp_path}/c.fq\nbad\t3\t{tmp_path}/bad.fq\n")
    done = commands.pool(spark, str(tmp_path / "samples.tsv"), [str(tmp_path / "g.fa")], str(tmp_path / "out"), at_once=3, model="mismatch")
    rows = {r.sample_id: (r.output, r.error) for r in done.collect()}
    assert rows["3"][0] is None and "ValueError" in rows["3"][1] and rows["1"][1] is None and rows["2"][1] is None
    mapped = {k: spark.read.parquet(rows[k][0] + "/mappings").select("read_id").distinct().count() for k in "12"}
    assert mapped == {"1": 12, "2": 6}


def test_a_stream_of_reads(spark, genome, tmp_path):
    from helixplane.streaming.blocks import map_stream

    starts = {k: [at, at + 400] for k, at in enumerate((50, 1500))}
    for k, ats in starts.items():
        rows = [(10 * k + i, 1, f"r{i}", genome[at : at + 50], "I" * 50) for i, at in enumerate(ats)]
        spark.createDataFrame(rows, READS).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = map_stream(stream, spark.createDataFrame([(1, "c", genome)], CONTIGS), 20, str(tmp_path / "out"), str(tmp_path / "check"), lambda m, n: seen.append(n))
        q.awaitTermination()
    got = {(r.read_id, r.start) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(10 * k + i, at) for k, ats in starts.items() for i, at in enumerate(ats)} and len(seen) == len(set(seen)) and seen


def test_a_stream_learns_from_earlier_batches_and_repeats_them_alike(spark, genome, tmp_path):
    from helixplane.streaming import blocks

    rng = random.Random(17)
    for k in range(2):
        rows = []
        for i in range(25):
            at = rng.randrange(5900)
            s = list(genome[at : at + 50])
            s[10 + k] = rng.choice("ACGT")
            rows.append((100 * k + i, 1, f"r{i}", "".join(s), "I" * 50))
        spark.createDataFrame(rows, READS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    contigs = spark.createDataFrame([(1, "c", genome)], CONTIGS)

    def run(out, check, folder):
        stream = spark.readStream.schema(READS).parquet(str(tmp_path / folder))
        blocks.map_stream(stream, contigs, 20, str(tmp_path / out), str(tmp_path / check), model="estimated").awaitTermination()

    import shutil

    shutil.copytree(tmp_path / "in0", tmp_path / "in")
    run("a", "check", "in")
    for f in (tmp_path / "in1").glob("part*"):
        shutil.copy(f, tmp_path / "in" / f"later-{f.name}")
    shutil.copytree(tmp_path / "check", tmp_path / "before")
    run("a", "check", "in")
    rows = lambda: sorted((r.batch, r.read_id, r.start, r.strand, round(r.score, 9)) for r in spark.read.parquet(str(tmp_path / "a")).collect())
    first = rows()
    assert {r[0] for r in first} == {0, 1} and len({r[1] for r in first}) >= 45
    counts = {(r.batch, r.pos): r.mm for r in spark.read.parquet(str(tmp_path / "a_errors")).groupBy("batch", "pos").agg(F.sum("mm").alias("mm")).collect()}
    assert counts[0, 11] + counts[0, 40] >= 10 and counts[0, 12] + counts[0, 39] < counts[1, 12] + counts[1, 39]
    # the second batch is run again, as after a failure: from the state before it, over what it had written
    run("a", "before", "in")
    assert rows() == first


def test_traces_at_once(spark):
    rows = spark.createDataFrame([(1, 0, 5, -2.0), (1, 0, 5, 3.0), (1, 0, 6, -1.0)], "chr int, track int, pos int, value double")
    assert sorted(tuple(r) for r in traces.aggregates(rows, 2).collect()) == [(1, 0, 5, -2.0, 3.0, 1.0), (1, 0, 6, -1.0, 0.0, -1.0)]


def test_probes_are_the_best_windows(spark):
    q = "I" * 30 + "#" * 10 + "I" * 24
    rows = spark.createDataFrame([(0, 1, "a", "ACGT" * 16, "#" * 3 + q[3:]), (1, 1, "b", "N" + "ACGT" * 15 + "ACG", "I" * 64)], READS)
    got = {(r.read_id, r.probe_no): r.offset for r in search.select_probes(rows, 20, most=2, score=search.window_quality(20, 33)).collect()}
    assert got == {(0, 0): 3, (0, 1): 40, (1, 0): 1, (1, 1): 32}


def test_primers(spark):
    from helixplane.sources import text

    rows = spark.createDataFrame([(0, "ACGTTAGG", "IIIIIIII"), (1, "ACGATAGG", "JJJJJJJJ"), (2, "TTTT", "KKKK"), (3, "AC", "LL")], "read_id long, seq string, qual string")
    primers = spark.createDataFrame([("ACG",), ("ACGTT",), ("acgtt",), ("",)], "primer string")
    got = {r.read_id: (r.seq, r.qual, r.trimmed) for r in text.primer_trimmed(rows, primers, 1).collect()}
    assert got == {0: ("AGG", "III", 5), 1: ("AGG", "JJJ", 5), 2: ("TTTT", "KKKK", 0), 3: ("AC", "LL", 0)}
    assert text.primer_trimmed(rows, primers, 0, strict=True).count() == 2 and text.primer_trimmed(rows, primers.limit(0), 1).count() == 4
