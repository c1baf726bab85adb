"""Diploid genomes: anchors between paternal and maternal copies, and what lies between them.

Maps are (prefix, ord, pat, mat): 1-based anchors where both copies go on together, 0 where one copy has nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import index as index_
from .search import asked, wanted

#: Words of a contig that are compared with its other copy's at a time, and that go on together.
STRETCH = 1 << 18
# fixed values: which copies have a word
COPIES = ["shared", "paternal", "maternal", "reference"]


def segments(dmap: DataFrame) -> DataFrame:
    """(prefix, ord, kind, pat_start, mat_start, length): from each anchor to the next of either copy; kind shared, paternal or maternal; starts 0-based, null where absent."""
    w = Window.partitionBy("prefix").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    ahead = lambda c: F.first(F.when(F.col(c) > 0, F.col(c)), ignorenulls=True).over(w)
    rows = dmap.withColumn("next_pat", ahead("pat")).withColumn("next_mat", ahead("mat"))
    kind = F.when((F.col("pat") > 0) & (F.col("mat") > 0), "shared").when(F.col("pat") > 0, "paternal").otherwise("maternal")
    length = F.when(kind == "shared", F.least(F.col("next_pat") - F.col("pat"), F.col("next_mat") - F.col("mat"))).when(kind == "paternal", F.col("next_pat") - F.col("pat")).otherwise(F.col("next_mat") - F.col("mat"))
    zero = lambda c: F.when(F.col(c) > 0, F.col(c) - 1)
    return rows.select("prefix", "ord", kind.alias("kind"), zero("pat").alias("pat_start"), zero("mat").alias("mat_start"), length.alias("length")).filter("length > 0")


def lift(positions: DataFrame, dmap: DataFrame) -> DataFrame:
    """Paternal positions (prefix, pos, 1-based) with `mat`, the maternal one: by the last anchor at or before; 0 within paternal-only sequence; null before the first anchor."""
    anchors = dmap.filter("pat > 0").select("prefix", F.col("pat").alias("pos"), F.col("pat").alias("a_pat"), F.col("mat").alias("a_mat"), F.lit(0).alias("asked"))
    asked = positions.select("prefix", "pos").distinct().select("prefix", "pos", F.lit(None).cast(anchors.schema["a_pat"].dataType).alias("a_pat"), F.lit(None).cast(anchors.schema["a_mat"].dataType).alias("a_mat"), F.lit(1).alias("asked"))
    w = Window.partitionBy("prefix").orderBy("pos", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = anchors.unionByName(asked).withColumn("last", F.last(F.when(F.col("asked") == 0, F.struct("a_pat", "a_mat")), ignorenulls=True).over(w)).filter("asked = 1")
    mat = F.when(F.col("last.a_mat") == 0, F.lit(0)).otherwise(F.col("last.a_mat") + F.col("pos") - F.col("last.a_pat"))
    return positions.join(last.select("prefix", "pos", mat.alias("mat")), ["prefix", "pos"])


def expand(hits: DataFrame) -> DataFrame:
    """Hits on shared sequence (…, pat, mat) as one row a copy: source PATERNAL or MATERNAL, loc."""
    both = F.array(F.struct(F.lit("PATERNAL").alias("source"), F.col("pat").alias("loc")), F.struct(F.lit("MATERNAL").alias("source"), F.col("mat").alias("loc")))
    rows = hits.withColumn("x", F.explode(both)).filter("x.loc > 0")
    return rows.select(*[c for c in hits.columns if c not in ("pat", "mat")], "x.source", "x.loc")


def snps(paternal: DataFrame, maternal: DataFrame, shared: DataFrame) -> DataFrame:
    """(prefix, pat_pos, mat_pos, pat_base, mat_base), 0-based: bases that differ within shared segments. Copies: (prefix, seq)."""
    rows = shared.filter("kind = 'shared'").join(paternal.select("prefix", F.col("seq").alias("p_seq")), "prefix").join(maternal.select("prefix", F.col("seq").alias("m_seq")), "prefix")
    rows = rows.select("prefix", "pat_start", "mat_start", F.upper(F.substring("p_seq", F.col("pat_start").cast("int") + 1, F.col("length").cast("int"))).alias("p"), F.upper(F.substring("m_seq", F.col("mat_start").cast("int") + 1, F.col("length").cast("int"))).alias("m"))
    both = F.zip_with(F.split("p", ""), F.split("m", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    marked = F.filter(F.transform(both, lambda x, i: F.struct(i.alias("i"), x["a"].alias("pat_base"), x["b"].alias("mat_base"))), lambda x: x["pat_base"] != x["mat_base"])
    rows = rows.filter("p <> m").select("prefix", "pat_start", "mat_start", F.inline(marked))
    return rows.select("prefix", (F.col("pat_start") + F.col("i")).alias("pat_pos"), (F.col("mat_start") + F.col("i")).alias("mat_pos"), "pat_base", "mat_base")


def copies(contigs: DataFrame) -> DataFrame:
    """(prefix, pat_chr, pat_len, mat_chr, mat_len) of contigs (chr, name, seq) that come in a paternal and a maternal copy: names are the prefix, an underscore, and a rest that says which. Other contigs are haploid."""
    kind = F.regexp_extract(F.lower("name"), "(paternal|maternal)", 1)
    rows = contigs.select(F.substring_index("name", "_", 1).alias("prefix"), "chr", F.length("seq").alias("len"), kind.alias("kind")).filter("kind <> ''")
    one = lambda k, c: rows.filter(F.col("kind") == k).select("prefix", F.col("chr").alias(f"{c}_chr"), F.col("len").alias(f"{c}_len"))
    return one("paternal", "pat").join(one("maternal", "mat"), "prefix")


def closed(dmap: DataFrame, pairs: DataFrame) -> DataFrame:
    """The map with an anchor behind each pair's last bases, so that what follows the last anchor is a segment too."""
    last = dmap.groupBy("prefix").agg((F.max("ord") + 1).alias("ord")).join(pairs, "prefix")
    kinds = {c: dmap.schema[c].dataType for c in ("prefix", "ord", "pat", "mat")}
    ends = last.select(F.col("prefix").cast(kinds["prefix"]).alias("prefix"), F.col("ord").cast(kinds["ord"]).alias("ord"), (F.col("pat_len") + 1).cast(kinds["pat"]).alias("pat"), (F.col("mat_len") + 1).cast(kinds["mat"]).alias("mat"))
    return dmap.select("prefix", "ord", "pat", "mat").unionByName(ends)


def index(contigs: DataFrame, dmap: DataFrame, k: int, probes: DataFrame | None = None) -> DataFrame:
    """(chr, loc, code, source, mat_chr, mat_loc): the packed k-mers of a genome whose contigs may come in two copies.

    A word that lies within shared sequence and is the same in both copies has one row, with the paternal place and the
    maternal one (source shared); words over a differing base, over a segment's edge or in one copy only
    have a row for each copy that has them (paternal, maternal); haploid contigs' words are `reference`. Contigs are
    read once; copies and the map meet by prefix, and words are compared there, STRETCH at a time: no word is shuffled.
    probes: only words that exact searches of these ask for; they are told apart as in the whole index.
    """
    only = None if probes is None else wanted(probes)
    kind = F.regexp_extract(F.lower("name"), "(paternal|maternal)", 1)
    # haploid contigs may have one prefix: each is dealt by itself
    rows = contigs.select(F.substring_index("name", "_", 1).alias("prefix"), F.when(kind == "", F.col("chr").cast("string")).otherwise("").alias("alone"), F.struct(kind.alias("kind"), "chr", "seq").alias("x"))
    anchors = dmap.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("pat").cast("long").alias("pat"), F.col("mat").cast("long").alias("mat")))).alias("x"))
    anchors = anchors.select("prefix", F.lit("").alias("alone"), F.col("x.pat").alias("pat"), F.col("x.mat").alias("mat"))
    both = rows.groupBy("prefix", "alone").agg(F.collect_list("x").alias("x")).join(anchors, ["prefix", "alone"], "left").select("x.kind", "x.chr", "x.seq", "pat", "mat")
    own = contigs.schema["chr"].dataType
    kinds = T.StructType([T.StructField("chr", own), T.StructField("loc", T.LongType()), T.StructField("code", T.LongType()), T.StructField("copy", T.ByteType()), T.StructField("mat_chr", own), T.StructField("mat_loc", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = index_.among(only)
        for b in batches:
            held, n = [], 0
            names = b.column("chr").flatten()
            begin, places = 0, pa.array(np.arange(len(names)))
            for i in range(b.num_rows):
                copies_, seqs = b.column("kind")[i].as_py(), b.column("seq")[i].as_py()
                codes = [index_.CODES[np.frombuffer(seq.encode(), np.uint8)] for seq in seqs]
                found = _told_apart(copies_, codes, [np.asarray(b.column(c)[i].as_py() or [], np.int64) for c in ("pat", "mat")], k)
                for copy, at, loc, code, other, far in found:
                    keep = tell(code)
                    held.append((copy, begin + at, loc[keep], code[keep], None if far is None else begin + other, None if far is None else far[keep]))
                    n += len(held[-1][2])
                    if n >= STRETCH:
                        yield _batch(held, names, kinds.names)
                        held, n = [], 0
                begin += len(seqs)
            if n:
                yield _batch(held, names, kinds.names)

    source = functools.reduce(lambda out, x: F.when(F.col("copy") == x, COPIES[x]).otherwise(out), range(1, len(COPIES)), F.lit(COPIES[0]))
    out = both.mapInArrow(run, kinds).withColumn("source", source).select("chr", "loc", "code", "source", "mat_chr", "mat_loc")
    return out if probes is None or only is not None else asked(probes, out)


def _batch(held: list[tuple], names: pa.Array, columns: list[str]) -> pa.RecordBatch:
    """Rows of stretches, whose contigs are places in `names`."""
    size = [len(x[2]) for x in held]
    each = lambda c, none: np.repeat([none if x[c] is None else x[c] for x in held], size)
    other = each(4, -1)
    far = np.concatenate([np.zeros(len(x[2]), np.int64) if x[5] is None else x[5] for x in held])
    loc, code = (np.concatenate([x[c] for x in held]) for c in (2, 3))
    arrays = [names.take(pa.array(each(1, 0))), pa.array(loc), pa.array(code), pa.array(each(0, 0).astype(np.int8)), names.take(pa.array(other, mask=other < 0)), pa.array(far, mask=other < 0)]
    return pa.RecordBatch.from_arrays(arrays, columns)


def _lengths(pat: np.ndarray, mat: np.ndarray, sizes: tuple[int, int]) -> list[np.ndarray]:
    """As segments() of a closed map: starts in both copies and lengths of what is shared."""
    if not len(pat):
        return [pat, mat, pat]
    ends = []
    for at, size in ((pat, sizes[0]), (mat, sizes[1])):
        closed_ = np.append(at, size + 1)
        ahead = np.minimum.accumulate(np.where(closed_ > 0, np.arange(len(closed_)), len(closed_) - 1)[::-1])[::-1][1:]
        ends.append(closed_[ahead])
    n = np.minimum(ends[0] - pat, ends[1] - mat)
    keep = (pat > 0) & (mat > 0) & (n > 0)
    return [pat[keep] - 1, mat[keep] - 1, n[keep]]


def _told_apart(kinds: list[str], codes: list[np.ndarray], anchors: list[np.ndarray], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int | None, np.ndarray | None]]:
    """(copy, contig, places, words, other contig, places there) of the contigs of a prefix, by stretches: shared words, and those that a contig has for itself."""

    def words(seq: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Those that begin from low to high - 1, and which have all their bases known."""
        part = seq[low : high + k - 1]
        unknown = np.concatenate(([0], np.cumsum(part < 0)))
        return index_._packed(part, k), unknown[k:] == unknown[:-k]

    for own, kind in enumerate(kinds):
        others = [i for i, x in enumerate(kinds) if kind and x and x != kind]
        copy = COPIES.index(kind if others else "reference")
        spans = []
        for i in others:
            pair = (own, i) if kind == "paternal" else (i, own)
            begin, far, n = _lengths(*anchors, (len(codes[pair[0]]), len(codes[pair[1]])))
            begin, far = (begin, far) if kind == "paternal" else (far, begin)
            # words that end within the segment and within both contigs
            spans.append((i, begin, far, begin + np.minimum(np.minimum(n, len(codes[own]) - begin), len(codes[i]) - far) - k + 1))
        for low in range(0, len(codes[own]) - k + 1, STRETCH):
            high = min(low + STRETCH, len(codes[own]) - k + 1)
            code, known = words(codes[own], low, high)
            met = np.zeros(high - low, bool)
            for i, begin, far, end in spans:
                for x in np.flatnonzero((begin < high) & (end > low) & (end > begin)):
                    a, b, shift = max(low, int(begin[x])), min(high, int(end[x])), int(far[x] - begin[x])
                    there, known_there = words(codes[i], a + shift, b + shift)
                    same = np.flatnonzero(known[a - low : b - low] & known_there & (code[a - low : b - low] == there)) + a
                    met[same - low] = True
                    if kind == "paternal":
                        yield 0, own, same, code[same - low], i, same + shift
            alone = np.flatnonzero(known & ~met)
            yield copy, own, alone + low, code[alone], None, None


def expand_hits(hits: DataFrame) -> DataFrame:
    """Hits of a diploid index with a row for each copy: shared ones become a paternal and a maternal one. They are counted and filtered before, as one."""
    own = F.struct(F.col("chr").alias("chr"), F.col("loc").alias("loc"), F.when(F.col("source") == "shared", "paternal").otherwise(F.col("source")).alias("source"))
    other = F.struct(F.col("mat_chr").alias("chr"), F.col("mat_loc").alias("loc"), F.lit("maternal").alias("source"))
    rows = hits.withColumn("x", F.explode(F.when(F.col("source") == "shared", F.array(own, other)).otherwise(F.array(own))))
    return rows.drop("chr", "loc", "source", "mat_chr", "mat_loc").select("*", "x.*").drop("x")
