"""Cases that a review found."""

from pyspark.sql import functions as F

from helixplane.functions import quality
from helixplane.operators import density, diploid, errors, index, overlay, sampling, search
from helixplane.plans import queries
from helixplane.sources import text


def test_effective_length_of_errors_that_sum_to_a_whole_number(spark):
    """sums that are 4, 1 and 3 in decimals; added one by one, ten doubles of 0.1 are less than 1."""
    p = [0.01] * 300 + [0.003] * 300 + [0.001] * 70 + [0.0003] * 100
    rows = spark.createDataFrame([(p,), ([0.1] * 10,), ([0.1] * 30,)], "p array<double>")
    assert [r[0] for r in rows.select(quality.effective_length(F.col("p"))).collect()] == [len(p) - 5, 8, 26]


def _genome(spark, n=3):
    seq = "".join("ACGT"[(i * i * 7 + i // 3) % 4] for i in range(400))
    return spark.createDataFrame([(c, f"g{c}", seq[c * 11 :]) for c in range(n)], "chr long, name string, seq string")


def test_search_leaves_the_index_where_it_is(spark, monkeypatch):
    """Targets that are too many under all changes of whole words are cut into more parts before the index is shuffled; hits are the same."""
    genome = _genome(spark)
    probes = genome.select(F.col("chr").alias("read_id"), F.lit(1).alias("mate"), F.lit(0).alias("probe_no"), F.lit(0).alias("offset"), F.lit(20).alias("length"), F.concat(F.substring("seq", 50, 9), F.lit("T"), F.substring("seq", 60, 10)).alias("seq"))
    words = index.packed(genome, 20)
    hits = lambda: search.search(probes, words, 20, 2)
    place = lambda r: (r.read_id, r.strand, r.chr, r.loc, r.penalty)
    whole = sorted(map(place, hits().collect()))
    assert whole
    monkeypatch.setattr(search, "MOST_BROADCAST", 1000)  # 6 targets: 10,626 rows in one part, 372 in two
    assert "hashpartitioning(key" not in hits()._jdf.queryExecution().toString()
    assert sorted(map(place, hits().collect())) == whole


def test_words_that_are_asked_for(spark, monkeypatch):
    """an index is cut to the words that probes ask for, with all places of them, before it is shuffled."""
    genome = _genome(spark)
    probes = genome.filter("chr = 0").select(F.lit(1).alias("read_id"), F.lit(1).alias("mate"), F.lit(0).alias("probe_no"), F.lit(0).alias("offset"), F.lit(20).alias("length"), F.substring("seq", 50, 20).alias("seq"))
    words = index.packed(genome, 20)
    held = search.asked(probes, words)
    want = sorted((r.chr, r.loc) for r in search.search_exact(probes, words, 20).collect())
    assert len(want) >= 3 and sorted((r.chr, r.loc) for r in held.distinct().collect()) == sorted(set(want))
    assert held.count() < words.count()
    pair = spark.createDataFrame([(0, "p_paternal", "ACGTTGCA" * 20), (1, "p_maternal", "ACGTTGCA" * 10 + "T" + "ACGTTGCA" * 10)], "chr long, name string, seq string")
    dmap = spark.createDataFrame([("p", 1, 1, 1), ("p", 2, 0, 81), ("p", 3, 81, 82)], "prefix string, ord int, pat int, mat int")
    probe = probes.withColumn("seq", F.lit("ACGTTGCAACGTTGCAACGT"))
    rows = lambda *x: sorted(tuple(map(str, r)) for r in search.search_exact(probe, diploid.index(pair, dmap, 20, *x), 20).collect())
    assert rows(probe) == rows() != []


def _plan(rows):
    return rows._jdf.queryExecution().toString()


def test_draws_of_bootstraps_are_not_broadcast(spark):
    """25 draws a read are exploded from numbers; Spark takes their size for that of the numbers."""
    rows = spark.range(200).select(F.col("id").alias("read_id"), F.lit(0).alias("mapping_no"), F.lit(1.0).alias("cond_prb"))
    drawn = sampling.bootstraps(rows, 25, 11)
    assert "SortMergeJoin [number" in _plan(drawn) and "BroadcastHashJoin [number" not in _plan(drawn)
    assert {r[1] for r in drawn.groupBy("bs").agg(F.sum("weight")).collect()} == {200}


def test_normalised_by_few_keys_is_not_dealt_by_them(spark):
    """with two tracks, rows that join their sums by track would lie in two tasks."""
    rows = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") % 2).alias("track"), F.col("id").cast("double").alias("value"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = density.normalised(rows, "track")
        assert "SortMergeJoin" not in _plan(out)
        got = {r[0]: round(r[1], 9) for r in out.groupBy("track").agg(F.sum("value")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {0: 1.0, 1: 1.0}


def test_spans_are_dealt_by_their_bases(spark, monkeypatch):
    """few spans with many bases lay in one task, each as one array; a span of no bases went backwards."""
    monkeypatch.setattr(density, "SPAN", 7)
    monkeypatch.setattr(density, "SPANNED", 10)
    spans = spark.createDataFrame([(1, 3, 40), (2, 14, 21), (3, 5, 5), (4, 0, 1)], "chr int, start long, stop long")
    rows = density.positions(spans)
    assert sorted(map(tuple, rows.collect())) == [(1, p) for p in range(3, 40)] + [(2, p) for p in range(14, 21)] + [(4, 0)]
    assert rows.rdd.getNumPartitions() == 5 and max(len(x) for x in rows.rdd.glom().collect()) <= 21


def test_words_are_counted_in_blocks(spark, monkeypatch):
    """words were dealt one by one, up to four times; counts, places and contents are those of the packed index, also of contigs that are long, come twice or have unknown bases."""
    monkeypatch.setattr(index, "BLOCK", 300)
    monkeypatch.setattr(index, "BUCKET", 500)
    monkeypatch.setattr(index, "LONG", 390)
    genome = _genome(spark, 5).select(F.when(F.col("chr") == 4, 3).otherwise(F.col("chr")).cast("string").alias("chr"), F.when(F.col("chr") == 1, F.concat("seq", F.lit("NNacgtN"), "seq")).otherwise(F.col("seq")).alias("seq"))
    for k in (6, 20, 31):
        words = index.packed(genome, k)
        rows = lambda x: sorted(map(tuple, x.collect()))
        sums = lambda x: rows(x.groupBy("chr").agg(F.count(F.lit(1)), F.sum("loc")))
        often = index.repeats(words, 5)
        assert rows(index.repeated(genome, k, 5)) == rows(often) != []
        assert rows(index.occurrences(genome, k, 5)) == sums(index.expand_repeats(often, words))
        assert rows(index.occurrences(genome, k, 5, often=False)) == sums(index.unique_part(words, often))
        assert rows(index.contents(genome, k)) == rows(words.groupBy("chr").agg(F.count(F.lit(1)), F.sum("loc"), F.countDistinct("code")))
        for found in (index.repeated(genome, k, 5), index.occurrences(genome, k, 5)):
            assert "hashpartitioning(code" not in _plan(found)


def test_a_round_deals_mappings_twice(spark, monkeypatch):
    """a round of start sites dealt rows eight times; the same probabilities come from two, also where windows reach over bins and many mappings lie at one place."""
    monkeypatch.setattr(density, "ROUND", 256)
    rows = spark.range(400).select((F.col("id") % 150).alias("read_id"), (F.col("id") / 150).cast("int").alias("mapping_no"), (F.col("id") % 3).alias("chr"), F.when(F.col("id") % 4 == 0, 250).otherwise((F.col("id") * 37) % 900).alias("start"), F.when(F.col("id") % 5 == 0, "-").otherwise("+").alias("strand"), (-(F.col("id") % 7) / 3).alias("score"))
    rows = density.conditional(rows.withColumn("stop", F.col("start") + 20)).checkpoint()
    sites = density.start_sites(rows)
    key = lambda x: {(r.read_id, r.mapping_no): (round(r.cond_prb, 9), round(r.lhd, 9)) for r in x.collect()}
    own = density.near_own_start(rows)
    assert key(own) == key(density.near_start(rows, sites)) and len(key(own)) == 400
    assert key(density.near_own_start(rows, 150.0)) == key(density.near_start(rows, density.normalised(sites)))
    assert _plan(density.near_own_start(rows)).split("== Physical Plan ==")[-1].count("Exchange hashpartitioning") == 2
    one, history = density.iterate(rows.drop("cond_prb"), most=3, stop_ratio=-1, least_change=0.0)
    two, plain = density.iterate(rows.drop("cond_prb"), lambda x: density.normalised(density.start_sites(x)), density.near_start, 3, -1, 0.0)
    assert key(one) == key(two) and set(one.columns) == set(two.columns) and [tuple(round(y, 6) for y in x) for x in history] == [tuple(round(y, 6) for y in x) for x in plain]


def test_errors_are_summed_within_tasks(spark, monkeypatch):
    """every base was a row before cells were summed; the same counts, also of reads that have no bases, other letters or strings of unlike length."""
    monkeypatch.setattr(errors, "AT_ONCE", 3)
    rows = [(i % 2 + 1, "+-"[i // 2 % 2], "ACGTA"[: i % 6], "ACCTA"[: i % 6], "5:?D5"[: i % 6]) for i in range(40)]
    rows += [(1, "+", "ACG", "AC", "5:?"), (1, "+", "AéG", "AeG", "5:?"), (None, "+", "AC", "AG", "55"), (1, "-", None, "A", "5")]
    best = spark.createDataFrame(rows, "mate int, strand string, read string, genome string, quality string")
    cells = errors.counts(best)
    got = {tuple(r)[:4]: (r.n, r.mm) for r in cells.collect()}
    want = {}
    for m, s, a, b, q in rows:
        for i in range(len(a or "")):
            n, mm = want.get((m, s, ord(q[i]), i + 1), (0, 0))
            want[m, s, ord(q[i]), i + 1] = (n + 1, mm + (i < len(b) and a[i] != b[i]))
    assert got == want and "MapInArrow" in _plan(cells)


def test_words_of_two_copies_are_not_shuffled(spark, monkeypatch):
    """all words of both copies went through several joins; they are compared where both copies' sequences meet, with the same rows by plain comparison, also at edges of segments and stretches, at unknown bases, and where a map goes beyond a contig."""
    monkeypatch.setattr(diploid, "STRETCH", 7)
    k, base = 6, "".join("ACGT"[(i * i * 7 + i // 3) % 4] for i in range(90))
    seqs = {("p", "paternal"): base, ("p", "maternal"): base[:30] + "T" + base[35:60] + "N" + base[61:], ("q", "paternal"): base[:40], ("q", "maternal"): base[5:30].lower(), ("r", "paternal"): base[:4], ("r", "maternal"): base[:9], ("h", "x"): base[3:20]}
    genome = spark.createDataFrame([(i, f"{p}_{c}", x) for i, ((p, c), x) in enumerate(seqs.items())], "chr long, name string, seq string")
    anchors = [("p", 1, 1, 1), ("p", 2, 31, 0), ("p", 3, 36, 32), ("q", 1, 6, 1), ("q", 2, 90, 90)]
    dmap = spark.createDataFrame(anchors, "prefix string, ord int, pat int, mat int")
    found = diploid.index(genome, dmap, k)
    # (start, start, length) of shared segments
    shared = {"p": [(0, 0, 30), (35, 31, 55)], "q": [(5, 0, 84)], "r": []}
    want, no = [], {x: i for i, x in enumerate(seqs)}
    word = lambda x, i: x[i : i + k].upper() if i + k <= len(x) and "N" not in x[i : i + k] else None
    for p, spans in shared.items():
        a, b = seqs[p, "paternal"], seqs[p, "maternal"]
        met = {(i, i - s + t) for s, t, n in spans for i in range(s, s + n - k + 1) if word(a, i) and word(a, i) == word(b, i - s + t)}
        want += [(no[p, "paternal"], i, "shared", no[p, "maternal"], j) for i, j in met]
        want += [(no[p, c], i, c, None, None) for c, x, at in (("paternal", a, {i for i, _ in met}), ("maternal", b, {j for _, j in met})) for i in range(len(x)) if word(x, i) and i not in at]
    want += [(no["h", "x"], i, "reference", None, None) for i in range(12)]
    rows = found.collect()
    assert sorted((r.chr, r.loc, r.source, r.mat_chr, r.mat_loc) for r in rows if r.source) == sorted(want, key=lambda x: x[:3]) and len({x[2] for x in want}) == 4
    code = lambda x: sum("ACGT".index(c) << 2 * (k - 1 - i) for i, c in enumerate(x))
    text = list(seqs.values())
    assert all(r.code == code(word(text[r.chr], r.loc)) for r in rows)
    assert not any("code" in line for line in _plan(found).split("== Physical Plan ==")[-1].splitlines() if "Exchange" in line)


def test_overlapping_runs_are_dealt_once(spark, monkeypatch):
    """fragments were piled up by several shuffles and checkpoints, then laid over each other bin by bin, once for each aggregate; runs that overlap add up in one deal, also where a bin's rows come in several batches."""
    monkeypatch.setattr(overlay, "BIN", 64)
    rows = [(i % 3, i % 2, 0, (i * 37) % 300, (i * 37) % 300 + 1 + i % 90, float(i % 4 + 1)) for i in range(200)] + [(1, 0, 1, 64, 128, 1.0)] * 50
    runs = spark.createDataFrame(rows, "member int, chr int, track int, pos int, end int, value double")
    want = {}
    for member, chr_, track, pos, end, value in rows:
        for p in range(pos, end):
            want.setdefault((chr_, track, p), [0.0] * 3)[member] += value
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = overlay.aggregates(runs, 3)
        each = lambda x: {(r.chr, r.track, p): r for r in x.collect() for p in range(r.pos, r.end)}
        assert {k: (r["min"], r["max"], r["sum"]) for k, r in each(found).items()} == {k: (min(v), max(v), sum(v)) for k, v in want.items()}
        assert {k: r.value for k, r in each(overlay.aggregate(runs, "max", 3)).items()} == {k: max(v) for k, v in want.items()}
        assert found.count() == len({(r.chr, r.track, r.pos) for r in found.collect()})
        higher = overlay.higher_counts(runs.filter("member = 0").withColumnRenamed("member", "bs"), runs.filter("member = 1").selectExpr("member - 1 AS bs", "chr", "track", "pos", "end", "value"), 1)
        assert {k: r["count"] for k, r in each(higher).items()} == {k: 0.5 if v[0] == v[1] else float(v[0] > v[1]) for k, v in want.items() if v[0] or v[1]}
        piled = density.fragments(runs.selectExpr("member", "chr", "pos AS start", "end AS stop", "'+' AS strand", "value * (end - pos) AS cond_prb"), "member")
        got = {(r.member, r.chr, p): round(r.value, 6) for r in piled.collect() for p in range(r.pos, r.end)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    sums = {}
    for member, chr_, _, pos, end, value in rows:
        for p in range(pos, end):
            sums[member, chr_, p] = sums.get((member, chr_, p), 0.0) + value
    assert got == sums
    for x in (found, piled):
        assert _plan(x.select("*")).split("== Physical Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_wiggle_headers_go_on_over_blocks(spark, monkeypatch):
    """every line was shuffled for each header kind, to be numbered and joined; headers reach over blocks of lines, also those without any."""
    monkeypatch.setattr(text, "BLOCK_LINES", 3)
    lines = ["1 0.5", 'track type=wiggle_0 name="a b"', "2 1.5", "variableStep chrom=c1", "3 2", "4 3", "5 4", "# 6", "7 5", "track name=d", "8 6", "variableStep chrom=c2", "9 7", None]
    rows = spark.createDataFrame([(f, i, x) for f in (1, 2) for i, x in enumerate(lines[: len(lines) // f])], "file int, line_no long, line string")
    one = [(None, None, 1, 0.5), ("a", None, 2, 1.5), *[("a", "c1", p, float(p - 1 if p < 6 else p - 2)) for p in (3, 4, 5, 7)], ("d", "c1", 8, 6.0), ("d", "c2", 9, 7.0)]
    found = text.wiggle(rows.repartition(5))
    key = lambda x: (x[0], x[3])
    assert sorted((tuple(r) for r in found.collect()), key=key) == [(1, *x) for x in one] + [(2, *x) for x in one[:5]]
    assert "SortMergeJoin" not in _plan(found.select("*"))


def test_words_that_are_not_asked_for_stay_in_their_task(spark):
    """each base of the genome left its task as a row, and the whole genome was cut and joined for each alignment."""
    genome = _genome(spark)
    probes = genome.filter("chr = 0").select(F.lit(1).alias("read_id"), F.lit(1).alias("mate"), F.lit(0).alias("probe_no"), F.lit(0).alias("offset"), F.lit(20).alias("length"), F.substring("seq", 50, 20).alias("seq"))
    only, words = search.wanted(probes), index.packed(genome, 20)
    some = index.packed(genome, 20, only=only)
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert len(only) == 2 and rows(some) == rows(words.filter(F.col("code").isin(only.tolist()))) != []
    assert rows(index.packed(genome, 20, only=only[:0])) == []
    assert rows(search.held(genome, some.filter("chr = 1")).select("chr")) == [(1,)]


def _placed(spark):
    """Mappings whose bins are crossed, many of which begin at one place or at a contig's start; one without a contig."""
    rows = [(i % 60, i // 60, None if i == 7 else i % 3, at, at + (5, 30, 90)[i % 3], "-" if i % 5 == 0 else "+", -(i % 7) / 3) for i in range(240) for at in [50 if i % 4 == 0 else i * 37 % 200]]
    return density.conditional(spark.createDataFrame(rows, "read_id long, mapping_no int, chr int, start int, stop int, strand string, score double")).checkpoint()


def _shares(mappings, areas):
    """cond_prb by read and mapping from an area for each."""
    weight = {(r.read_id, r.mapping_no): 10**r.score * areas[r.read_id, r.mapping_no] for r in mappings}
    total = {}
    for (read, _), w in weight.items():
        total[read] = total.get(read, 0.0) + w
    return {k: round(w / total[k[0]], 9) for k, w in weight.items()}


def test_a_round_of_profiles_deals_mappings_twice(spark, sf_dir, monkeypatch):
    """each place left its task once for each base of the profile, as density and as asked for, and was joined again; the same probabilities come from two shuffles."""
    monkeypatch.setattr(density, "ROUND", 16)
    mappings, bases = _placed(spark), [(0, 0.5), (1, 0.3), (3, 0.2), (9, 0.1)]
    shape = spark.createDataFrame([*bases, (None, 1.0), (2, None)], "offset long, d double")
    rows, held, areas = mappings.collect(), {}, {}
    under = lambda r: [(r.chr, p, d) for o, d in bases for p in [r.start + o if r.strand == "+" else r.stop - 1 - o] if p >= 0 and r.chr is not None]
    for r in rows:
        for c, p, d in under(r):
            held[c, p] = held.get((c, p), 0.0) + r.cond_prb * d
    for r in rows:
        areas[r.read_id, r.mapping_no] = sum(held[c, p] * d for c, p, d in under(r))
    expect = _shares(rows, areas)
    key = lambda x: sorted((r.read_id, r.mapping_no, round(r.cond_prb, 9)) for r in x.collect())
    own, other = density.over_own_profile(mappings, shape), density.over_profile(mappings.drop("cond_prb"), density.profile(mappings, shape.dropna()), shape)
    assert key(own) == key(other) == sorted((*k, v) for k, v in expect.items())
    assert set(own.columns) == {*mappings.columns, "lhd", "was"} and set(other.columns) == {*mappings.columns, "lhd"}
    physical = lambda x: _plan(x.select("*")).split("== Physical Plan ==")[-1]
    assert physical(own).count("Exchange hashpartitioning") == 2
    assert physical(queries.QUERIES["estep_profile"](spark, sf_dir)).count("Exchange hashpartitioning") == 3  # and one that numbers mappings
    assert density.over_own_profile(mappings, shape.limit(0)).filter("abs(cond_prb - was) > 1e-9").count() == 0


def test_a_round_of_fragments_deals_mappings_twice(spark, sf_dir, monkeypatch):
    """ends of runs and of mappings were summed, checkpointed and joined again at both ends; the same probabilities come from two shuffles."""
    monkeypatch.setattr(density, "ROUND", 16)
    mappings = _placed(spark)
    rows, held, areas = mappings.collect(), {}, {}
    for r in rows:
        for p in range(r.start, r.stop if r.chr is not None else 0):
            held[r.chr, p] = held.get((r.chr, p), 0.0) + r.cond_prb / (r.stop - r.start)
    for r in rows:
        areas[r.read_id, r.mapping_no] = sum(held.get((r.chr, p), 0.0) for p in range(r.start, r.stop))
    expect = _shares(rows, areas)
    key = lambda x: sorted((r.read_id, r.mapping_no, round(r.cond_prb, 9)) for r in x.collect())
    own, other = density.over_own_fragments(mappings), density.over_fragment(mappings.drop("cond_prb"), density.fragments(mappings.filter("chr IS NOT NULL")))
    assert key(own) == key(other) == sorted((*k, v) for k, v in expect.items())
    assert set(own.columns) == {*mappings.columns, "lhd", "was"} and set(other.columns) == {*mappings.columns, "lhd"}
    physical = lambda x: _plan(x.select("*")).split("== Physical Plan ==")[-1]
    assert physical(own).count("Exchange hashpartitioning") == 2
    assert physical(queries.QUERIES["estep_fragments"](spark, sf_dir)).count("Exchange hashpartitioning") == 3  # and one that numbers mappings
    # a mapping without bases has no density; a read of such ones keeps its scores' shares
    bare = density.conditional(spark.createDataFrame([(1, 0, 1, 5, 5, "+", -1.0), (1, 1, 1, 5, 8, "+", -1.0), (2, 0, 1, 6, 6, "-", 0.0), (2, 1, 1, 16, 16, "-", 0.0)], "read_id long, mapping_no int, chr int, start int, stop int, strand string, score double"))
    assert key(density.over_own_fragments(bare)) == [(1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.5), (2, 1, 0.5)]


def test_rounds_of_fragments_are_the_same_by_runs(spark):
    """rounds over the mappings' own fragments against rounds that pile them up."""
    mappings = _placed(spark).filter("chr IS NOT NULL").drop("cond_prb")
    one, history = density.iterate(mappings, density.fragments, density.over_fragment, 3, -1, 0.0)
    two, plain = density.iterate(mappings, lambda x: density.fragments(x), density.over_fragment, 3, -1, 0.0)
    key = lambda x: sorted((r.read_id, r.mapping_no, round(r.cond_prb, 9), round(r.lhd, 9)) for r in x.collect())
    assert key(one) == key(two) and set(one.columns) == set(two.columns)
    assert [tuple(round(y, 6) for y in x) for x in history] == [tuple(round(y, 6) for y in x) for x in plain]


def test_spans_come_in_runs_that_take_little_room(spark, tmp_path):
    """F1 of round 4: rows of a task came by whole pieces of 16,384 places, so files had over two bytes a row."""
    spans = spark.range(150).selectExpr("id AS chr", "id * 3 + 1 AS start", "id * 3 + 6001 AS stop")
    density.positions(spans).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert rows.count() == 900_000 == rows.distinct().count()
    assert rows.join(spans, "chr").filter("pos >= start AND pos < stop").count() == 900_000
    assert sum(x.stat().st_size for x in (tmp_path / "rows").glob("*.parquet")) < 900_000 // 2


def test_rounds_deal_numbers_not_rows(spark, monkeypatch):
    """F2, F6 of round 4: each round dealt all mappings twice, as rows, and wrote them; the same rounds by blocks that stay, also of several blocks and bins, hot places, strings and nulls."""
    from helixplane.operators import rounds

    monkeypatch.setattr(rounds, "BLOCK", 37)
    monkeypatch.setattr(rounds, "KEPT", 2)
    monkeypatch.setattr(density, "ROUND", 512)
    rows = [(i % 70 if i % 70 else None, i // 70, None if i % 11 == 0 else f"c{i % 3}", None if i == 13 else 500 if i % 4 == 0 else i * 37 % 1500, "-" if i % 5 == 0 else "+", None if i % 23 == 0 else -(i % 7) / 3, f"x{i}") for i in range(350)]
    mappings = spark.createDataFrame(rows, "read_id long, mapping_no int, chr string, start int, strand string, score double, more string").withColumn("stop", F.col("start") + 30)
    now, history = density.conditional(mappings).filter("start IS NOT NULL").checkpoint(), []
    total = now.agg(F.sum("cond_prb")).first()[0]
    for _ in range(3):
        now = density.near_own_start(now, total).checkpoint()
        one = now.groupBy("read_id").agg(F.sum(F.abs(F.col("cond_prb") - F.col("was"))).alias("change"), F.max("lhd").alias("lhd"), F.sum("cond_prb").alias("total"))
        r = one.agg(F.max("change").alias("change"), F.sum(F.when(F.col("lhd") > 0, F.log10("lhd"))).alias("lhd"), F.sum("total").alias("total")).first()
        history, total, now = [*history, (r.change, r.lhd)], r.total, now.drop("was")
    got, found = density.iterate(mappings, most=3, stop_ratio=-1, least_change=0.0)
    nine = lambda x: None if x is None else round(x, 9)
    key = lambda x: {r.more: (r.read_id, r.mapping_no, r.chr, r.start, r.stop, r.strand, r.score, nine(r.cond_prb), nine(r.lhd)) for r in x.collect()}
    assert key(got) == key(now) and len(key(got)) == 349 == got.count() and set(got.columns) == set(now.columns)
    assert [tuple(map(nine, x)) for x in found] == [tuple(map(nine, x)) for x in history]
    kinds = lambda x: {f.name: f.dataType for f in x.schema}
    assert kinds(got) == kinds(now)
    assert density.iterate(mappings.limit(0), most=3)[0].count() == 0


def test_draws_are_dealt_once(spark):
    """F4 of round 4: draws were dealt by read's number with their second number, and dealt again by bootstrap, read and mapping to be counted."""
    from hashlib import md5

    mappings = spark.range(60).select((F.col("id") % 20).alias("read_id"), (F.col("id") / 20).cast("int").alias("mapping_no"), (F.col("id") * 7).alias("start"), F.lit(1 / 3).alias("cond_prb"))
    drawn = sampling.bootstraps(mappings, 5, 11)
    physical = _plan(drawn).split("== Physical Plan ==")[-1]
    assert "Exchange hashpartitioning(number" in physical and "Exchange hashpartitioning(bs" not in physical
    u = lambda *x: int(md5(":".join(map(str, x)).encode()).hexdigest()[:13], 16) / 2**52
    want = {}
    for bs in range(5):
        for draw in range(20):
            at = u(12, bs, draw)
            place = (bs, int(u(11, bs, draw) * 20), 0 if at <= 1 / 3 else 1 if at <= 2 / 3 else 2)
            want[place] = want.get(place, 0) + 1
    rows = drawn.collect()
    assert {(r.bs, r.read_id, r.mapping_no): r.weight for r in rows} == want and len(rows) == len(want)
    assert all(r.start == (r.read_id + 20 * r.mapping_no) * 7 for r in rows)


def test_places_of_words_are_not_dealt(spark, monkeypatch):
    """F3, F5 of round 4: every word was dealt with its place and its contig; chunks deal words alone and get back a bit for each, also several chunks of a task, unknown bases, and contigs that come twice or have no word."""
    monkeypatch.setattr(index, "BLOCK", 300)
    monkeypatch.setattr(index, "BUCKET", 100)
    monkeypatch.setattr(index, "AT_ONCE", 1)
    genome = _genome(spark, 5).select(F.when(F.col("chr") == 4, None).otherwise(F.col("chr")).alias("chr"), F.when(F.col("chr") == 1, F.concat("seq", F.lit("NNacgtN"), "seq")).otherwise(F.col("seq")).alias("seq"))
    genome = genome.unionByName(spark.createDataFrame([(7, "ACG"), (8, "N" * 40), (9, None), (3, "ACGT" * 30), (10, "ACCGTTAGCATGCAATTGCCGGATAACGTTTACA")], "chr long, seq string")).coalesce(2)
    words = index.packed(genome, 20)
    sums = lambda x: sorted(map(str, x.groupBy("chr").agg(F.count(F.lit(1)), F.sum("loc")).collect()))
    plain = lambda x: sorted(str(r).replace("n=", "count(1)=").replace("locs=", "sum(loc)=") for r in x.collect())
    repeated = index.repeats(words, 5)
    often, seldom = index.occurrences(genome, 20, 5), index.occurrences(genome, 20, 5, often=False)
    assert plain(often) == sums(index.expand_repeats(repeated, words)) != []
    assert plain(seldom) == sums(index.unique_part(words, repeated)) != []
    assert "owner#" not in _plan(often) and "loc#" not in _plan(often)
    assert index.occurrences(genome.limit(0), 20, 5).collect() == []
