"""Gapped mapping, searches under learnt errors, diploid genomes and lists of repeats: against plain versions and through whole runs."""

import itertools
import math
import random
import re

from pyspark.sql import functions as F

from helixplane.operators import diploid, estimated, index, reads, search, spliced
from helixplane.plans import cli
from helixplane.plans.config import Config
from helixplane.plans.mapper import map_reads

READS, CONTIGS = "read_id long, mate int, name string, seq string, qual string", "chr int, name string, seq string"
FLIP = str.maketrans("ACGT", "TGCA")


def back(s):
    return s.translate(FLIP)[::-1]


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_planted_junctions_are_found(spark):
    rng = random.Random(21)
    seq = dna(rng, 40_000)
    rows, truth = [], {}
    junctions = [(at, rng.randrange(10, 3000)) for at in range(1000, 36_000, 1000)]  # introns begin there
    for j, (at, gap) in enumerate(junctions):
        for part in (28, 38, 47):
            i = len(rows)
            s = list(seq[at - part : at] + seq[at + gap : at + gap + 76 - part])
            if i % 3 == 0:
                p = rng.randrange(76)
                s[p] = rng.choice([b for b in "ACGT" if b != s[p]])
            s, strand = "".join(s), rng.choice("+-")
            rows.append((i, 1, f"r{i}", s if strand == "+" else back(s), "I" * 76))
            truth[i] = (at - part, part, gap, strand, j)
    plain = [(1000 + k, 1, f"p{k}", seq[at : at + 76], "I" * 76) for k, at in enumerate(range(300, 30_000, 1500))]
    reads_, contigs = spark.createDataFrame(rows + plain, READS), spark.createDataFrame([(1, "c", seq)], CONTIGS)
    mapped, _ = map_reads(reads_, contigs, 20, introns=(4, 5000))
    got = {}
    for r in mapped.collect():
        got.setdefault(r.read_id, []).append(r)
    assert all(any(r.gap == 0 and r.start == at for r in got[1000 + k]) for k, at in enumerate(range(300, 30_000, 1500)))
    same = lambda r, t: (r.gap, r.stop, r.strand) == (t[2], t[0] + 76 + t[2], t[3]) and r.start == t[0]
    hit = {i for i, t in truth.items() if any(same(r, t) for r in got.get(i, []))}
    assert len(hit) >= 0.95 * len(truth)
    # where bases at the ends of an intron agree its place is open: the best split has no more mismatches than the planted one
    exact = {t[4] for i, t in truth.items() for r in got.get(i, []) if same(r, t) and seq[r.start : r.start + r.split] + seq[r.start + r.split + r.gap : r.stop] == seq[t[0] : t[0] + t[1]] + seq[t[0] + t[1] + t[2] : t[0] + 76 + t[2]]}
    assert len(exact) >= 0.95 * len(junctions)
    cigars = [r.line.split("\t")[5] for r in reads.sam_lines(mapped.filter("gap > 0"), reads_, contigs).collect()]
    assert cigars and all(re.fullmatch(r"\d+M\d+N\d+M", c) and sum(int(n) for n in re.findall(r"(\d+)M", c)) == 76 for c in cigars)
    found = {(r.intron_start, r.intron_stop) for r in spliced.junctions(mapped).collect()}
    assert sum((at, at + gap) in found for at, gap in junctions) >= 0.7 * len(junctions)


def test_the_usual_ends_decide_between_equal_splits(spark):
    rng = random.Random(8)
    left, right = dna(rng, 40), dna(rng, 40)
    intron = "GT" + dna(rng, 60) + "AG"
    # the base before the intron is the intron's last: two splits without mismatches
    left = left[:-1] + "G"
    contigs = spark.createDataFrame([(1, "c", dna(rng, 50) + left + intron + right + dna(rng, 50))], CONTIGS)
    read = spark.createDataFrame([(0, 1, "r", left + right, "I" * 80), (1, 1, "s", back(left + right), "I" * 80)], READS)
    hits = search.search_exact(spliced.end_probes(read, 20), index.packed(contigs, 20), 20)
    got = spliced.split(spliced.chain(hits, read, 20), read, contigs).collect()
    assert {(r.read_id, r.start, r.split, r.gap, r.canonical) for r in got} == {(0, 50, 40, 64, True), (1, 50, 40, 64, True)}


def test_probes_at_the_ends(spark):
    rows = spark.createDataFrame([(0, 1, "a", "N" + "ACGTT" * 12 + "N", "I" * 62), (1, 1, "b", "ACGTT" * 5, "I" * 25), (2, 1, "c", "ACG", "III")], READS)
    got = {(r.read_id, r.probe_no): r.offset for r in spliced.end_probes(rows, 20).collect()}
    assert got == {(0, 0): 1, (0, 1): 41, (1, 0): 0}


def test_pairs_with_introns(spark):
    rng = random.Random(4)
    seq = dna(rng, 6000)
    seq = seq[:1039] + "AC" + seq[1041:1539] + "CA" + seq[1541:]  # one split only
    one = seq[1000:1040] + seq[1540:1576]
    rows = [(0, 1, "p", one, "I" * 76), (0, 2, "p", back(seq[1700:1776]), "J" * 76)]
    pairs, contigs = spark.createDataFrame(rows, READS), spark.createDataFrame([(1, "c", seq)], CONTIGS)
    mapped, _ = map_reads(pairs, contigs, 20, introns=(4, 2000))
    r = mapped.first()
    assert mapped.count() == 1 and (r.start, r.stop, r.split1, r.gap1, r.gap2) == (1000, 1776, 40, 500, 0)
    lines = [x.line.split("\t") for x in reads.sam_pair_lines(mapped, pairs, contigs).orderBy("mate").collect()]
    assert [(x[3], x[5], x[7], x[8]) for x in lines] == [("1001", "40M500N36M", "1701", "776"), ("1701", "76M", "1001", "-776")]


def test_search_under_errors_equals_all_words_scored(spark):
    rng = random.Random(6)
    k, genome = 11, dna(rng, 600)
    contigs = spark.createDataFrame([(1, "c", genome)], CONTIGS)
    rows, expect = [], set()
    for i in range(30):
        word = dna(rng, k)
        if i % 2:
            at = rng.randrange(600 - k)
            word = genome[at : at + k]
        p = [rng.choice((0.3, 0.1, 0.02, 0.001, 0.6)) for _ in range(k)]
        good, bad = [math.log10(1 - x) for x in p], [math.log10(x) - 0.477121 for x in p]
        if i % 5 == 0:
            good[3] = bad[3] = -0.60206
        floor = sum(good) - rng.choice((0.0, 2.0, 4.0, 6.5))
        rows.append((i, "+", word, sum(good), [g - b for g, b in zip(good, bad)], floor))
        for at in range(600 - k + 1):
            score = sum(g if a == b else w for a, b, g, w in zip(word, genome[at : at + k], good, bad))
            if score > floor + 1e-4 or genome[at : at + k] == word:
                expect.add((i, at, round(score, 6)))
    targets = spark.createDataFrame(rows, "read_id long, strand string, target string, base double, loss array<double>, floor double")
    for change in (0, 0.0003):  # floors are compared with a tolerance of a millionth a base
        got = [(r.read_id, r.loc, round(r.penalty, 6)) for r in estimated.search(targets.withColumn("floor", F.col("floor") - change), index.packed(contigs, k), k).collect()]
        assert len(got) == len(set(got))
        assert {g for g in got if g in expect or g[2] > rows[g[0]][5] + 1e-4} == expect


def test_poor_targets_are_cut_into_more_parts(spark, monkeypatch):
    rng = random.Random(7)
    genome = dna(rng, 400)
    contigs = spark.createDataFrame([(1, "c", genome)], CONTIGS)
    targets = spark.createDataFrame([(i, "+", dna(rng, 12), 0.0, [0.5 + (i + j) % 3 for j in range(12)], -3.0 - i % 4) for i in range(24)], "read_id long, strand string, target string, base double, loss array<double>, floor double")
    held = index.packed(contigs, 12)
    one = sorted((r.read_id, r.loc, round(r.penalty, 9)) for r in estimated.search(targets, held, 12).collect())
    monkeypatch.setattr(estimated, "MOST_CHANGES", 40)
    monkeypatch.setattr(estimated, "MOST_BROADCAST", 0)
    assert one and one == sorted((r.read_id, r.loc, round(r.penalty, 9)) for r in estimated.search(targets, held, 12).collect())


def test_low_quality_mismatches_cost_less(spark):
    """A read whose poor bases differ is found under learnt errors where mismatches alone reject it."""
    rng = random.Random(15)
    seq = dna(rng, 5000)
    rows = []
    for i in range(150):
        at = rng.randrange(4900)
        s, q = list(seq[at : at + 60]), ["I"] * 60
        for p in rng.sample(range(60), 24):
            q[p] = "#"
            if rng.random() < 0.7:
                s[p] = rng.choice([b for b in "ACGT" if b != s[p]])
        rows.append((i, 1, f"{at}", "".join(s), "".join(q)))
    reads_, contigs = spark.createDataFrame(rows, READS), spark.createDataFrame([(1, "c", seq)], CONTIGS)
    frequencies = spark.createDataFrame([(1, st, ord(c), p, x) for st in "+-" for c, x in (("I", 1e-3), ("#", 0.7)) for p in range(1, 61)], "mate int, strand string, qual int, pos int, p double")
    right = lambda m: {r.read_id for r in m.collect() if r.start == int(rows[r.read_id][2])}
    learnt = right(map_reads(reads_, contigs, 20, model="estimated", frequencies=frequencies)[0])
    counted = right(map_reads(reads_, contigs, 20)[0])
    assert len(learnt) > len(counted) and len(learnt) >= 120


def two_copies(rng):
    """A paternal copy, a maternal one with a base changed, five lost and three more, and the map's anchors."""
    pat = dna(rng, 3000)
    mat = list(pat)
    mat[700] = "A" if pat[700] != "A" else "C"
    mat = "".join(mat[:1000]) + "".join(mat[1005:2000]) + "GAT" + "".join(mat[2000:])
    return pat, mat, [(1, 1, 1), (2, 1001, 0), (3, 1006, 1001), (4, 0, 1996), (5, 2001, 1999)]


def test_diploid_index_holds_each_word_of_either_copy_once(spark):
    pat, mat, anchors = two_copies(random.Random(31))
    extra = dna(random.Random(32), 200)
    contigs = spark.createDataFrame([(1, "c_paternal", pat), (2, "c_maternal", mat), (3, "m", extra)], CONTIGS)
    dmap = spark.createDataFrame([("c", *a) for a in anchors], "prefix string, ord int, pat int, mat int")
    rows = diploid.index(contigs, dmap, 20).collect()
    words = lambda s: [s[i : i + 20] for i in range(len(s) - 19)]
    shared = {(i, i if i < 1000 else i - 5 if i < 2000 else i - 2) for i in range(2981) if not (980 < i < 1005 or 1980 < i < 2000)}
    shared = {(p, m) for p, m in shared if pat[p : p + 20] == mat[m : m + 20]}
    assert {(r.loc, r.mat_loc) for r in rows if r.source == "shared"} == shared and len(shared) < len(rows)
    assert sorted(r.loc for r in rows if r.source == "paternal") == sorted(set(range(len(words(pat)))) - {p for p, _ in shared})
    assert sorted(r.loc for r in rows if r.source == "maternal") == sorted(set(range(len(words(mat)))) - {m for _, m in shared})
    assert len([r for r in rows if r.source == "reference"]) == 181


def test_a_diploid_run(spark, tmp_path):
    rng = random.Random(33)
    pat, mat, anchors = two_copies(rng)
    (tmp_path / "c_paternal.fa").write_text(f">c_paternal\n{pat}\n")
    (tmp_path / "c_maternal.fa").write_text(f">c_maternal\n{mat}\n")
    (tmp_path / "c.map").write_text("#REF\tPAT\tMAT\n" + "".join(f"0\t{p}\t{m}\n" for _, p, m in anchors))
    starts = {"both": 200, "snp": 680, "lost": 985, "more": 1975}
    rows = [("both", pat[200:250]), ("snp", mat[680:730]), ("lost", pat[985:1035]), ("more", mat[1975:2025])]
    rows += [(f"x{i}", pat[i : i + 50]) for i in range(0, 600, 60)]
    (tmp_path / "r.fq").write_text("".join(f"@{n}\n{s}\n+\n{'I' * 50}\n" for n, s in rows))
    out = cli.run(spark, Config(genome=[str(tmp_path / f) for f in ("c_paternal.fa", "c_maternal.fa", "c.map")], output=str(tmp_path / "run"), unpaired=str(tmp_path / "r.fq")))
    names = {r.chr: r.name for r in out.read("contigs").collect()}
    best = {}
    for r in out.read("mappings").join(out.read("reads").select("read_id", "name"), "read_id").collect():
        best.setdefault(r["name"], []).append((names[r.chr], r.start, round(r.score, 3)))
    top = {n: {x[:2] for x in b if x[2] == max(y[2] for y in b)} for n, b in best.items()}
    assert top["both"] == {("c_paternal", 200), ("c_maternal", 200)}
    assert top["snp"] == {("c_maternal", starts["snp"])} and top["lost"] == {("c_paternal", 985)} and top["more"] == {("c_maternal", 1975)}
    assert [(r.pat, r.mat) for r in out.read("dmap").orderBy("ord").collect()] == [a[1:] for a in anchors]
    assert {r.source for r in out.read("kmers").select("source").distinct().collect()} == {"shared", "paternal", "maternal"}


def test_lists_of_repeats_change_no_result(spark):
    rng = random.Random(40)
    unit = dna(rng, 120)
    seq = "".join(unit + dna(rng, rng.randrange(5, 60)) for _ in range(200)) + dna(rng, 2000)
    contigs = spark.createDataFrame([(1, "c", seq)], CONTIGS)
    rows = [(i, 1, f"r{i}", seq[at : at + 50], "I" * 50) for i, at in enumerate([10, 40, 60, len(seq) - 1500, len(seq) - 700, 3000])]
    reads_ = spark.createDataFrame(rows, READS)
    words = index.packed(contigs, 20).checkpoint()
    repeated = index.repeats(words, 150).checkpoint()
    lists, held = index.postings(words, repeated).checkpoint(), index.collapsed(words, repeated).checkpoint()
    assert held.count() < words.count() and held.filter("repeat is not null").count() == repeated.count() > 50
    assert lists.groupBy("repeat", "list_no").count().agg(F.max("count")).first()[0] <= 2 * index.POSTED
    key = lambda m: sorted((r.read_id, r.chr, r.start, r.strand, round(r.cond_prb, 9)) for r in m.collect())
    whole = key(map_reads(reads_, contigs, 20, kmers=words)[0])
    assert whole == key(map_reads(reads_, contigs, 20, kmers=held, repeats=lists)[0]) and len(whole) > 400


def test_an_rna_run(spark, tmp_path):
    rng = random.Random(50)
    seq = dna(rng, 8000)
    (tmp_path / "g.fa").write_text(f">c\n{seq}\n")
    at = list(itertools.islice(range(500, 7000, 300), 12))
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{seq[a : a + 38] + seq[a + 138 : a + 176]}\n+\n{'I' * 76}\n" for i, a in enumerate(at)))
    out = cli.run(spark, Config(genome=[str(tmp_path / "g.fa")], output=str(tmp_path / "run"), unpaired=str(tmp_path / "r.fq"), assay="rna", intron=2000))
    assert {(r.start, r.gap, r.stop) for r in out.read("mappings").collect()} >= {(a, 100, a + 176) for a in at}
    sam = [x.split("\t") for p in (tmp_path / "run/sam").glob("part*") for x in p.read_text().splitlines() if x[0] != "@"]
    assert all("N" in x[5] for x in sam) and out.read("frequencies").count() > 0 and out.read("errors").count() > 0
