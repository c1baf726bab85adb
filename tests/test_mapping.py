"""Reads of known origin are found again; densities, samples and runs keep their invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixplane.operators import density, diploid, errors, index, peaks, reads, sampling, search, traces
from helixplane.plans.config import Config
from helixplane.plans.mapper import map_reads, posterior_density
from helixplane.sources import sinks, text

FLIP = str.maketrans("ACGT", "TGCA")


def back(s):
    return s.translate(FLIP)[::-1]


@pytest.fixture(scope="module")
def genome():
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (1500, 2600)]
    seqs.append(seqs[0][200:700] + "".join(rng.choice("ACGT") for _ in range(300)))  # a repeat
    return [(k, f"chr{k}", s) for k, s in enumerate(seqs, 1)]


def simulated(genome, n, length, wrong, seed=1):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        chr_, _, seq = rng.choice(genome)
        at = rng.randrange(len(seq) - length)
        s = list(seq[at : at + length])
        for _ in range(rng.randrange(wrong + 1)):
            p = rng.randrange(length)
            s[p] = rng.choice([b for b in "ACGT" if b != s[p]])
        strand = rng.choice("+-")
        s = "".join(s)
        rows.append((i, 1, f"r{i}", s if strand == "+" else back(s), "I" * length))
        truth[i] = (chr_, at, strand)
    return rows, truth


READS, CONTIGS = "read_id long, mate int, name string, seq string, qual string", "chr int, name string, seq string"


def test_origins_are_found(spark, genome):
    rows, truth = simulated(genome, 60, 60, 2)
    junk = (1000, 1, "junk", "ACGTTGCA" * 7 + "ACGT", "I" * 60)
    short = (1001, 1, "short", "ACGT", "IIII")
    contigs = spark.createDataFrame(genome, CONTIGS)
    mapped, rejected = map_reads(spark.createDataFrame([*rows, junk, short], READS), contigs, 20)
    found = {}
    for r in mapped.collect():
        found.setdefault(r.read_id, []).append(r)
    for i, (chr_, at, strand) in truth.items():
        own = found[i]
        assert (chr_, at, strand) in {(r.chr, r.start, r.strand) for r in own}
        assert abs(sum(r.cond_prb for r in own) - 1) < 1e-9
        inside = chr_ == 3 and at + 60 <= 500 or chr_ == 1 and 200 <= at and at + 60 <= 700
        assert len(own) == (2 if inside else 1) or 200 - 60 < at < 760
    assert {r.read_id: r.error for r in rejected.collect()} == {1000: 4, 1001: 1}
    total = posterior_density(mapped).agg(F.sum("value")).first()[0]
    assert abs(total - 60) < 1e-6


def test_pairs(spark, genome):
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(25):
        chr_, _, seq = rng.choice(genome[1:2])
        at = rng.randrange(len(seq) - 200)
        rows += [(i, 1, f"p{i}", seq[at : at + 40], "I" * 40), (i, 2, f"p{i}", back(seq[at + 160 : at + 200]), "I" * 40)]
        truth[i] = (chr_, at, at + 200)
    mapped, rejected = map_reads(spark.createDataFrame(rows, READS), spark.createDataFrame(genome, CONTIGS), 20)
    got = {(r.read_id, r.chr, r.start, r.stop) for r in mapped.collect()}
    assert {(i, *t) for i, t in truth.items()} <= got and rejected.count() == 0


def test_search_equals_brute_force(spark, genome):
    rng = random.Random(9)
    k, probes = 12, []
    for i in range(12):
        _, _, seq = rng.choice(genome)
        at = rng.randrange(len(seq) - k)
        p = list(seq[at : at + k])
        p[rng.randrange(k)] = rng.choice("ACGT")
        probes.append((i, 1, 0, 0, k, "".join(p)))
    kmers = index.kmers(spark.createDataFrame(genome, CONTIGS), k)
    hits = search.search(spark.createDataFrame(probes, "read_id long, mate int, probe_no int, offset int, length int, seq string"), kmers, k, 2)
    got = {(r.read_id, r.strand, r.chr, r.loc, r.penalty) for r in hits.collect()}
    expect = set()
    for i, *_, p in probes:
        for strand, target in (("+", p), ("-", back(p))):
            for chr_, _, seq in genome:
                for at in range(len(seq) - k + 1):
                    if (wrong := sum(a != b for a, b in zip(target, seq[at : at + k]))) <= 2:
                        expect.add((i, strand, chr_, at, -float(wrong)))
    assert got == expect


def test_index_edges(spark):
    contigs = spark.createDataFrame([(1, "ACGTNACGTA"), (2, "ACG"), (3, "")], "chr int, seq string")
    assert {(r.chr, r.loc, r.kmer) for r in index.kmers(contigs, 4).collect()} == {(1, 0, "ACGT"), (1, 5, "ACGT"), (1, 6, "CGTA")}
    assert index.kmers(contigs, 4, omit_last=True).filter("loc = 6").count() == 0
    assert [r.copies for r in index.repeats(index.kmers(contigs, 4), 2).collect()] == [2]


def mapped_rows(spark, n=300, seed=2):
    rng = random.Random(seed)
    rows = [(i, m, 1, at, at + 30, rng.choice("+-"), -rng.random() * 2) for i in range(n) for m in range(rng.randrange(1, 4)) for at in [rng.randrange(2000)]]
    return spark.createDataFrame(rows, "read_id long, mapping_no int, chr int, start int, stop int, strand string, score double")


def test_em_keeps_reads_whole(spark):
    rows = mapped_rows(spark)
    out, history = density.iterate(rows, stop_ratio=-1, most=6)
    sums = [r.s for r in out.groupBy("read_id").agg(F.sum("cond_prb").alias("s")).collect()]
    assert len(sums) == 300 and all(abs(s - 1) < 1e-9 for s in sums) and history[-1][0] <= history[0][0]
    total = density.bases(density.fragments(density.conditional(rows))).agg(F.sum("value")).first()[0]
    assert abs(total - 300) < 1e-6


def test_samples(spark):
    rows = density.conditional(mapped_rows(spark))
    one = sampling.choose(rows, sampling.uniform(F.col("read_id"), 3))
    assert one.count() == one.select("read_id").distinct().count() == 300
    drawn = sampling.bootstraps(rows, 20).checkpoint()
    assert {r.bs: r.n for r in drawn.groupBy("bs").agg(F.sum("weight").alias("n")).collect()} == {b: 300 for b in range(20)}
    reads_drawn = drawn.groupBy("bs", "read_id").agg(F.sum("weight").alias("n")).collect()
    # about as many reads are left out as 1 / e of them, and as many drawn twice as half of those
    assert abs(len(reads_drawn) / 6000 - (1 - math.exp(-1))) < 0.03 and abs(sum(r.n == 2 for r in reads_drawn) / 6000 - math.exp(-1) / 2) < 0.03
    share = drawn.join(rows.select("read_id", "mapping_no", "cond_prb").withColumnRenamed("cond_prb", "p"), ["read_id", "mapping_no"]).agg(F.sum("weight").alias("n"), F.sum(F.when(F.col("p") < 0.5, F.col("weight"))).alias("low"), F.count(F.lit(1))).first()
    assert share.n == 6000 and abs(share.low / 6000 - rows.filter("cond_prb < 0.5").agg(F.sum("cond_prb")).first()[0] / 300) < 0.04
    assert sampling.random_start(mapped_rows(spark), 1, batches=2).count() == 300


def test_peaks_and_traces(spark):
    ip = spark.createDataFrame([(b, 1, 0, 5, 2.0) for b in range(25)] + [(0, 1, 0, 9, 1.0)], "bs int, chr int, track int, pos int, value double")
    nc = spark.createDataFrame([(b, 1, 0, 5, 1.0) for b in range(24)] + [(0, 1, 0, 9, 1.0), (3, 1, 0, 11, 4.0)], ip.schema)
    got = {r.pos: r["count"] for r in peaks.higher_counts(ip, nc).collect()}
    assert got == {5: 25.0, 9: 12.5, 11: 12.0}
    two = ip.limit(0).unionByName(nc)
    assert traces.aggregate(two, "min", 30).filter("value <> 0").count() == 0


def test_diploid(spark):
    dmap = spark.createDataFrame([("c", 1, 1, 1), ("c", 2, 11, 0), ("c", 3, 16, 11), ("c", 4, 0, 21), ("c", 5, 26, 24)], "prefix string, ord int, pat int, mat int")
    kinds = [(r.ord, r.kind, r.pat_start, r.mat_start, r.length) for r in diploid.segments(dmap).orderBy("ord").collect()]
    assert kinds == [(1, "shared", 0, 0, 10), (2, "paternal", 10, None, 5), (3, "shared", 15, 10, 10), (4, "maternal", None, 20, 3)]
    asked = spark.createDataFrame([("c", p) for p in (1, 5, 12, 18, 30)], "prefix string, pos int")
    assert [r.mat for r in diploid.lift(asked, dmap).orderBy("pos").collect()] == [1, 5, 0, 13, 28]


def test_error_model_is_calibrated(spark):
    rng = random.Random(4)
    rows = [(1, "+", q, p, 2000, sum(rng.random() < 10 ** (-(q - 33) / 10) for _ in range(2000))) for q in (43, 48, 53) for p in range(1, 21)]
    fit = errors.fit(spark.createDataFrame(rows, "mate int, strand string, qual int, pos int, n long, mm long"))
    for r in fit.groupBy("qual").agg(F.avg("p").alias("p")).collect():
        true = 10 ** (-(r.qual - 33) / 10)
        assert 0.6 * true < r.p < 1.6 * true


def test_files_there_and_back(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 x\nACGT\nAC-GT\n>chr2\nGGGG\n")
    fa = text.fasta(text.lines(spark, str(tmp_path / "g.fa"))).orderBy("chr").collect()
    assert [(r.chr, r.name, r.seq) for r in fa] == [(1, "chr1", "ACGTACGT"), (2, "chr2", "GGGG")]
    (tmp_path / "a.fq").write_text("@x/1 z\nACGT\n+\nIIII\n@y/1 z\nAC\n+\nII\n")
    (tmp_path / "b.fq").write_text("@x/2 z\nTTTT\n+\nIIII\n")
    one, two = (text.fastq(text.lines(spark, str(tmp_path / f))) for f in ("a.fq", "b.fq"))
    assert [(r.read_id, r.mate, r.name, r.seq) for r in text.paired(one, two).orderBy("mate").collect()] == [(0, 1, "x", "ACGT"), (0, 2, "x", "TTTT")]
    sinks.write_rejects(one, one.filter("read_id = 1"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == "@y/1\nAC\n+y/1\nII\n"
    (tmp_path / "m.map").write_text("#REF\tPAT\tMAT\n1\t1\t1\n0\t5\t0\n")
    assert [(r.pat, r.mat) for r in text.diploid_map(spark, str(tmp_path / "m.map"), "c").orderBy("ord").collect()] == [(1, 1), (5, 0)]


def test_command_line(spark, genome, tmp_path):
    from helixplane.plans import cli

    rows, truth = simulated(genome, 20, 50, 1, seed=6)
    (tmp_path / "g.fa").write_text("".join(f">{n}\n{s}\n" for _, n, s in genome))
    (tmp_path / "r.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for _, _, n, s, q in rows))
    out = cli.run(spark, Config(genome=[str(tmp_path / "g.fa")], output=str(tmp_path / "run"), unpaired=str(tmp_path / "r.fq"), assay="cage"))
    got = {(r.read_id, r.chr, r.start, r.strand) for r in out.read("mappings").collect()}
    assert {(i, *t) for i, t in truth.items()} <= got
    sam = [x for p in sorted((tmp_path / "run/sam").glob("part*")) for x in p.read_text().splitlines()]
    assert sam[0].startswith("@SQ\tSN:chr1") and len([x for x in sam if x[0] != "@"]) == out.read("mappings").count()


def test_config():
    c = Config(genome=["g.fa"], output="o", unpaired="r.fq", assay="cage")
    assert c.soft_clip == 1 and Config.loads(c.dumps()) == c
    for bad in ({"unpaired": None}, {"assay": "dna"}, {"assay": "chip"}, {"control": "c"}, {"encoding": "x"}, {"assay": "rna", "samples": 1}, {"pair1": "x"}):
        with pytest.raises(ValueError):
            Config(**{"genome": ["g"], "output": "o", "unpaired": "r", **bad})


def test_runs_are_merged(spark):
    one = spark.createDataFrame([(0,), (4,)], "read_id long")
    assert sorted((r.run_id, r.read_id) for r in reads.merge_runs(one, one, one.limit(0), one).collect()) == [(0, 0), (0, 4), (1, 5), (1, 9), (3, 10), (3, 14)]


def test_estimated_model(spark, genome):
    rows, truth = simulated(genome, 40, 60, 2, seed=11)
    mapped, _ = map_reads(spark.createDataFrame(rows, READS), spark.createDataFrame(genome, CONTIGS), 20, model="estimated")
    got = mapped.collect()
    assert {(i, *t) for i, t in truth.items()} <= {(r.read_id, r.chr, r.start, r.strand) for r in got}
    assert all(r.score < 0 for r in got)


def test_assays(spark):
    from helixplane.plans import assays

    rows = mapped_rows(spark, 120)
    trace, samples = assays.posterior_samples(rows, 2, most=2)
    assert abs(trace.agg(F.sum("value")).first()[0] - 240) < 1e-6 and samples.count() == 2
    peak = spark.createDataFrame([(i, 0, 1, 500, 530, "+", 0.0) for i in range(60)], rows.schema)
    scored = assays.with_control(peak, mapped_rows(spark, 60, 7), most=3)
    top = scored.orderBy(F.desc("value"), "pos").first()
    assert (top.pos, top.end) == (500, 530) and top["count"] == 25.0 and top.value > 0.99
    assert assays.most_likely(rows).count() > 0
    assert assays.placed_by(rows, density.start_sites(density.conditional(rows))).count() == rows.count()


def test_short_reads_are_found_up_to_their_probes_floor(spark, genome):
    seq = genome[1][2]
    rows = []
    for i, (at, wrong) in enumerate([(100, (1, 4, 9, 13, 18)), (700, (0, 3, 8, 12, 16)), (1500, (2, 5, 6, 11, 15)), (1900, (3,))]):
        s = list(seq[at : at + 25])
        for p in wrong:
            s[p] = "CGTA"["ACGT".index(s[p])]
        s = "".join(s)
        rows.append((i, 1, f"r{i}", back(s) if i == 3 else s, "I" * 25))
    mapped, _ = map_reads(spark.createDataFrame(rows, READS), spark.createDataFrame(genome, CONTIGS), 20)
    got = {(r.read_id, r.chr, r.start) for r in mapped.collect()}
    assert {(0, 2, 100), (1, 2, 700), (2, 2, 1500), (3, 2, 1900)} <= got


@pytest.mark.parametrize("mismatches", [3, 4])
def test_searches_with_short_parts_equal_brute_force(spark, mismatches):
    rng = random.Random(4)
    k, seq = 10, "".join(rng.choice("ACGT") for _ in range(800))
    contigs = spark.createDataFrame([(1, "c", seq)], CONTIGS)
    probes = [(i, 1, 0, 0, k, "".join(rng.choice("ACGT") for _ in range(k))) for i in range(8)]
    hits = search.search(spark.createDataFrame(probes, "read_id long, mate int, probe_no int, offset int, length int, seq string"), index.kmers(contigs, k), k, mismatches)
    count = lambda a, b: sum(x != y for x, y in zip(a, b))
    expect = {(i, s, at, -float(count(t, seq[at : at + k]))) for i, *_, p in probes for s, t in (("+", p), ("-", back(p))) for at in range(len(seq) - k + 1) if count(t, seq[at : at + k]) <= mismatches}
    got = [(r.read_id, r.strand, r.loc, r.penalty) for r in hits.collect()]
    assert len(got) == len(expect) and set(got) == expect


def test_profile_steps_equal_plain_sums(spark):
    shape = [0.5, 0.3, 0.2]
    rows = [(0, 0, 1, 0, 4, "+", -0.5), (0, 1, 1, 5, 9, "-", -0.2), (0, 2, 1, 90, 94, "+", 0.0), (1, 0, 1, 98, 100, "+", 0.0), (2, 0, 1, 0, 2, "-", -1.0), (2, 1, 1, 6, 10, "+", -1.1)]
    mappings = spark.createDataFrame(rows, "read_id long, mapping_no int, chr int, start int, stop int, strand string, score double")
    profile = spark.createDataFrame(list(enumerate(shape)), "offset long, d double")
    ends = spark.createDataFrame([(1, 100)], "chr int, length int")
    prior = density.conditional(mappings)
    places = density.profile(prior, profile, ends)
    assert {r.pos for r in places.filter("pos > 95").collect()} == {98, 99}
    value = {}
    for r in places.collect():
        value[r.pos] = value.get(r.pos, 0.0) + r.value
    weight = {}
    for read, no, _, start, stop, strand, score in rows:
        first, step = (start, 1) if strand == "+" else (stop - 1, -1)
        weight[read, no] = 10**score * sum(value.get(first + step * i, 0.0) * d for i, d in enumerate(shape))
    got = {(r.read_id, r.mapping_no): r.cond_prb for r in density.over_profile(prior.drop("cond_prb"), places, profile).collect()}
    assert set(got) == set(weight) and all(abs(p - weight[k] / sum(w for x, w in weight.items() if x[0] == k[0])) < 1e-12 for k, p in got.items())
    bare = density.over_profile(prior.drop("cond_prb"), places.limit(0), profile).collect()
    assert sorted((r.read_id, r.mapping_no, round(r.cond_prb, 9)) for r in bare) == sorted((r.read_id, r.mapping_no, round(r.cond_prb, 9)) for r in prior.collect())


def test_command_line_single_chip_with_samples_and_soft_clip(spark, genome, tmp_path, monkeypatch):
    from helixplane.plans import cli

    used = []
    for name in ("over_profile", "over_fragment"):
        monkeypatch.setattr(density, name, lambda *a, f=getattr(density, name), name=name: used.append(name) or f(*a))
    rows, truth = simulated(genome, 12, 50, 0, seed=6)
    (tmp_path / "g.fa").write_text("".join(f">{n}\n{s}\n" for _, n, s in genome))
    # three bases that aren't the genome's before each read
    (tmp_path / "r.fq").write_text("".join(f"@{n}\nTTT{s}\n+\nIII{q}\n" for _, _, n, s, q in rows))
    (tmp_path / "fl.txt").write_text("100\t0.5\n150\t0.5\n")
    out = cli.run(spark, Config(genome=[str(tmp_path / "g.fa")], output=str(tmp_path / "run"), unpaired=str(tmp_path / "r.fq"), assay="chip", fragment_lengths=str(tmp_path / "fl.txt"), samples=1, soft_clip=3, model="mismatch"))
    assert set(used) == {"over_profile"}
    mappings = out.read("mappings").collect()
    assert {(i, *t) for i, t in truth.items()} <= {(r.read_id, r.chr, r.start, r.strand) for r in mappings} and {r.stop - r.start for r in mappings} == {50}
    assert {r.sample: round(r.v, 6) for r in out.read("density").groupBy("sample").agg(F.sum("value").alias("v")).collect()} == {0: 12.0, 1: 12.0}
    assert [r.sample for r in out.read("samples").collect()] == [1]
    sam = [x.split("\t") for p in sorted((tmp_path / "run/sam").glob("part*")) for x in p.read_text().splitlines() if x[0] != "@"]
    assert {(int(x[1]) & 16, x[5], len(x[9])) for x in sam} == {(0, "3S50M", 53), (16, "50M3S", 53)}


def test_stray_lines_cost_no_other_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "BLOCK_LINES", 5)
    records = [(f"r{k}", "ACGTACGT"[: 1 + k % 8], "@IIIIIII"[: 1 + k % 8]) for k in range(40)]
    body = [f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in records]
    body[3] += "stray\n"
    body[7] = "@cut\nACGT\n+\nII\n"
    body[20] += "\n\n"
    (tmp_path / "a.fq").write_text("".join(body))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = text.lines(spark, str(tmp_path / "a.fq"))
        assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == list(enumerate("".join(body).split("\n")[:-1]))
        got = [(r.read_id, r.name, r.seq, r.qual) for r in text.fastq(lines).orderBy("read_id").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(k, *r) for k, r in enumerate(records) if k != 7]


def test_mates_of_other_names_fail(spark):
    one = lambda *names: spark.createDataFrame([(k, n, "AC", "II") for k, n in enumerate(names)], "read_id long, name string, seq string, qual string")
    assert text.paired(one("a/1", "b/1"), one("a/2", "b/2", "c/2")).count() == 4
    with pytest.raises(Exception, match="mates don't belong together"):
        text.paired(one("a/1", "b/1"), one("a/2", "x/2")).collect()


def test_headers_are_carried_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(text, "BLOCK_LINES", 3)
    body = ["track name=a", "variableStep chrom=c1", "1 0.5", "2 1", "3 2", "4 3", "variableStep chrom=c2", "7 1", "8 1", "9 1", "track name=b", "1 4"]
    rows = text.wiggle(spark.createDataFrame([("f", k, x) for k, x in enumerate(body)], "file string, line_no long, line string"))
    got = sorted((r.track, r.chrom, r.pos, r.value) for r in rows.collect())
    assert got == sorted([("a", "c1", 1, 0.5), ("a", "c1", 2, 1.0), ("a", "c1", 3, 2.0), ("a", "c1", 4, 3.0), ("a", "c2", 7, 1.0), ("a", "c2", 8, 1.0), ("a", "c2", 9, 1.0), ("b", "c2", 1, 4.0)])
    fa = [">x", "AC", "GT", "AA", "CC", ">y", "TT"]
    seqs = text.fasta(spark.createDataFrame([("f", k, x) for k, x in enumerate(fa)], "file string, line_no long, line string"))
    assert [(r.chr, r.name, r.seq) for r in seqs.orderBy("chr").collect()] == [(1, "x", "ACGTAACC"), (2, "y", "TT")]


def test_sums_along_a_contig_do_not_depend_on_bins(spark, monkeypatch):
    rows = density.conditional(mapped_rows(spark, 200)).checkpoint()

    def results():
        runs = density.fragments(rows)
        out = [sorted((r.chr, r.track, r.pos, round(r.value, 9)) for r in density.bases(runs).collect() if abs(r.value) > 1e-12)]
        for step in (density.over_fragment(rows.drop("cond_prb"), runs), density.near_start(rows.drop("cond_prb"), density.start_sites(rows))):
            out.append(sorted((r.read_id, r.mapping_no, round(r.cond_prb, 9)) for r in step.collect()))
        return out

    whole = results()
    for size in (7, 64, 300):
        monkeypatch.setattr(density, "BIN", size)
        assert results() == whole


def test_sam_of_pairs(spark, genome):
    seq = genome[1][2]
    rows = [(0, 1, "p", seq[100:140], "I" * 40), (0, 2, "p", back(seq[260:300]), "J" * 40), (1, 1, "q", back(seq[900:940]), "I" * 40), (1, 2, "q", seq[800:840], "J" * 40)]
    contigs = spark.createDataFrame(genome, CONTIGS)
    pairs = spark.createDataFrame(rows, READS)
    mapped, _ = map_reads(pairs, contigs, 20)
    lines = [r.line.split("\t") for r in reads.sam_pair_lines(mapped, pairs, contigs).orderBy("read_id", "mate").collect()]
    assert [x[:9] for x in lines] == [
        ["p", "67", "chr2", "101", "254", "40M", "=", "261", "200"], ["p", "147", "chr2", "261", "254", "40M", "=", "101", "-200"],
        ["q", "83", "chr2", "901", "254", "40M", "=", "801", "-140"], ["q", "131", "chr2", "801", "254", "40M", "=", "901", "140"],
    ]
    assert lines[1][9] == seq[260:300] and lines[2][9] == seq[900:940]


def test_reads_with_too_many_places_say_so(spark, monkeypatch):
    rng = random.Random(12)
    unit = "".join(rng.choice("ACGT") for _ in range(60))
    contigs = spark.createDataFrame([(1, "c", unit * 30 + "".join(rng.choice("ACGT") for _ in range(300)))], CONTIGS)
    rows = spark.createDataFrame([(0, 1, "many", unit[:40], "I" * 40), (1, 1, "none", "ACGGT" * 8, "I" * 40)], READS)
    monkeypatch.setattr(search.guard, "__defaults__", (20,))
    _, rejected = map_reads(rows, contigs, 20)
    assert {r.read_id: r.error for r in rejected.collect()} == {0: 2, 1: 4}


def test_long_reads_map_whole(spark):
    rng = random.Random(13)
    seq = "".join(rng.choice("ACGT") for _ in range(9000))
    rows = spark.createDataFrame([(0, 1, "long", seq[1500:6500], "I" * 5000), (1, 1, "short", seq[100:160], "I" * 60)], READS)
    mapped, _ = map_reads(rows, spark.createDataFrame([(1, "c", seq)], CONTIGS), 20)
    assert {(r.read_id, r.start, r.stop) for r in mapped.collect()} == {(0, 1500, 6500), (1, 100, 160)}


def test_quality_encoding_of_reads(spark):
    of = lambda *q: reads.quality_encoding(spark.createDataFrame([(x,) for x in q], "qual string"))
    assert (of("!5I", "II", ""), of("!J"), of(";h"), of("Bh"), of("@h")) == ("sanger", "illumina_1.8", "solexa", "illumina_1.5", "illumina_1.3")
    with pytest.raises(ValueError):
        of("~~")


def test_packed_words(spark):
    rng = random.Random(14)
    s = "".join(rng.choice("ACGTNacgt" if k % 17 == 0 else "ACGT") for k in range(900))
    df = spark.createDataFrame([("a", s), ("b", "ACG"), ("c", ""), ("d", s[5:40])], "chr string, seq string")
    code = lambda w: sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))
    for k in (1, 2, 3, 7, 12, 20, 31):
        for step, omit in ((1, False), (3, True)):
            got = sorted(tuple(r) for r in index.packed(df, k, step, omit).collect())
            expect = [(n, i, x[i : i + k].upper()) for n, x in (("a", s), ("b", "ACG"), ("d", s[5:40])) for i in range(0, len(x) - k + (not omit), step)]
            assert got == [(n, i, code(w)) for n, i, w in expect if "N" not in w]


def test_searches_with_and_without_broadcast_agree(spark, genome, monkeypatch):
    probes = spark.createDataFrame([(i, 1, 0, 0, 20, genome[i % 3][2][40 * i : 40 * i + 20]) for i in range(10)], "read_id long, mate int, probe_no int, offset int, length int, seq string")
    held = index.packed(spark.createDataFrame(genome, CONTIGS), 20)
    one = sorted(tuple(r) for r in search.search(probes, held, 20, 2).collect())
    monkeypatch.setattr(search, "MOST_BROADCAST", 0)
    assert one == sorted(tuple(r) for r in search.search(probes, held, 20, 2).collect()) and len(one) >= 10


@pytest.mark.parametrize("model", ["mismatch", "estimated"])
def test_untemplated_gs(spark, genome, model):
    seq = genome[1][2]
    starts = [at for at in range(60, 2400, 60) if seq[at - 1] != "G"][:20]
    rows = [(i, 1, f"r{i}", "G" + seq[at : at + 49], "I" * 50) for i, at in enumerate(starts)]
    stops = [at for at in range(300, 2400, 70) if seq[at] != "C"][:20]
    rows += [(100 + i, 1, f"s{i}", "G" + back(seq[at - 49 : at]), "I" * 50) for i, at in enumerate(stops)]
    rows += [(200 + i, 1, f"t{i}", seq[at : at + 50], "I" * 50) for i, at in enumerate(range(100, 2000, 50)) if seq[at] != "G"]
    reads_, contigs = spark.createDataFrame(rows, READS), spark.createDataFrame(genome, CONTIGS)
    mapped, _ = map_reads(reads_, contigs, 20, model=model, untemplated=1)
    got = {(r.read_id, r.chr, r.start, r.stop, r.strand, r.trim): r.score for r in mapped.collect()}
    assert {(i, 2, at, at + 49, "+", 1) for i, at in enumerate(starts)} <= set(got)
    assert {(100 + i, 2, at - 49, at, "-", 1) for i, at in enumerate(stops)} <= set(got)
    assert all(x[5] == 0 for x in got if x[0] >= 200)
    if model == "mismatch":
        assert all(abs(got[i, 2, at, at + 49, "+", 1] + 1.30103) < 1e-9 and abs(got[i, 2, at - 1, at + 49, "+", 0] + 1) < 1e-9 for i, at in enumerate(starts))
    cigars = {x.split("\t")[5] for x in (r.line for r in reads.sam_lines(mapped.filter("trim = 1 and strand = '+'"), reads_, contigs).collect())}
    assert cigars == {"1S49M"}


def test_more_samples_of_a_finished_run(spark, tmp_path):
    from helixplane.plans import assays

    run = sinks.Run(spark, str(tmp_path))
    run.write("mappings", density.conditional(mapped_rows(spark, 60)))
    trace, found = assays.posterior_samples(run.read("mappings"), 1, 1, first=1)
    run.write("density", trace)
    run.write("samples", found)
    assays.more_samples(run, 1, 1)
    assert sorted(r.sample for r in run.read("samples").collect()) == [1, 2]
    assert {r.sample: round(r.v, 6) for r in run.read("density").groupBy("sample").agg(F.sum("value").alias("v")).collect()} == {1: 60.0, 2: 60.0}


def test_small_operators(spark):
    from helixplane.functions import quality, sequence

    one = spark.createDataFrame([([-0.1, -2.0, -3.0], "ACGN")], "p array<double>, s string")
    r = one.select(quality.mismatch_probability(F.col("p")).alias("m"), quality.probe_score(F.col("p"), F.lit(1), 2).alias("q"), sequence.complement(F.col("s")).alias("c")).first()
    assert abs(r.m - (1 - 10**-0.1)) < 1e-12 and r.q == -5.0 and r.c == "TGCN"
    with pytest.raises(Exception, match="unknown base"):
        one.select(sequence.complement(F.col("s"), strict=True)).collect()
    a = spark.createDataFrame([(1, 0, 5, 6.0), (1, 0, 6, 2.0), (1, 1, 5, 1.0)], "chr int, track int, pos int, value double")
    b = spark.createDataFrame([(1, 0, 5, 3.0), (1, 0, 6, 0.0)], a.schema)
    assert [tuple(r) for r in traces.divide(a, b).collect()] == [(1, 0, 5, 2.0)]
    assert sorted(r.value for r in traces.apply(a, F.sqrt).collect()) == [1.0, 2.0**0.5, 6.0**0.5]
    rows = density.conditional(mapped_rows(spark, 40))
    assert {r.track for r in density.single_track(rows).collect()} == {0}
    assert abs(density.bases(density.single_track(rows)).agg(F.sum("value")).first()[0] - 40) < 1e-6
    got = {r.counter: r.n for r in reads.counters(rows, rows.filter("read_id < 30"), spark.createDataFrame([(35, 4), (36, 4), (37, 1)], "read_id long, error int")).collect()}
    assert got["reads"] == 40 and got["mapped reads"] == 30 and got["rejected: too few valid probes"] == 2 and got["rejected: no probes"] == 1
    kmers = index.packed(spark.createDataFrame([(1, "ACGTACGTTT")], "chr int, seq string"), 4)
    assert sorted(r.loc for r in index.pseudo_locations(kmers, index.repeats(kmers, 2)).collect()) == [0, 4]
