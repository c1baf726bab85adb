"""The genome's k-mer index: a table, bucketed by what searches join on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixplane.functions.sequence import BASES, MOST_PACKED, first_bases, is_known, pieces

from . import rounds

#: Sequences with so many copies in the genome count as repeats.
MIN_COPIES = 150
#: Places of a repeat that are listed together.
POSTED = 150
#: Bases of a piece in which k-mers are enumerated, and pieces at a time; base codes by letter, -1 for others.
PIECE, AT_ONCE = 256, 2000
#: Words that a task sorts at a time when they are dealt in blocks, and that a bucket gets on average; bases of a contig whose words are told apart within its task.
BLOCK, BUCKET, LONG = 1 << 21, 1 << 21, 1 << 22
#: Names of such longer or repeated contigs that are broadcast at most.
MOST_OTHER = 200_000
CODES = np.full(256, -1, np.int8)
for _code, _base in enumerate(BASES):
    CODES[[ord(_base), ord(_base.lower())]] = _code


def packed(contigs: DataFrame, k: int, step: int = 1, omit_last: bool = False, start: str | None = None, only: np.ndarray | None = None) -> DataFrame:
    """(chr, loc, code) of all k-mers of contigs (chr, seq) without unknown bases, as packed words (MOST_PACKED bases at most).

    omit_last: leave out each contig's last k-mer. start: a column to add to positions, for segments. only: sorted words; others
    don't leave their task. Words
    are put together in Arrow batches: built-in functions take some 20 operations of arrays, or of base
    conversion, for each base (measured: ten times as long).
    """
    if k > MOST_PACKED:
        raise ValueError(f"packed words have up to {MOST_PACKED} bases")
    rows, run = _enumerated(contigs, k, step, omit_last, start, only)
    kinds = T.StructType([T.StructField("chr", rows.schema["chr"].dataType), T.StructField("loc", T.LongType()), T.StructField("code", T.LongType())])
    return rows.mapInArrow(run, kinds)


def among(few: np.ndarray | None) -> Callable[[np.ndarray], np.ndarray]:
    """What tells which words are among a few sorted ones, most by their last bases; all are, if there is None."""
    if few is None:
        return lambda words: np.ones(len(words), bool)
    last = np.zeros(1 << 22, bool)
    last[few & (len(last) - 1)] = True

    def tell(words: np.ndarray) -> np.ndarray:
        found = last[words & (len(last) - 1)]
        at = np.flatnonzero(found)
        if len(few):
            found[at] = few[np.minimum(np.searchsorted(few, words[at]), len(few) - 1)] == words[at]
        return found

    return tell


def _enumerated(contigs: DataFrame, k: int, step: int = 1, omit_last: bool = False, start: str | None = None, only: np.ndarray | None = None) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """Pieces of contigs, and what makes (chr, loc, code) of batches of them."""
    size = max(PIECE, k)
    rows = _pieces(contigs, k, start).select("chr", F.col("n").cast("long").alias("n"), (F.col("part") * size).cast("long").alias("at"), F.col("first").cast("long").alias("first"), "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = among(only)
        for whole in batches:
            for low in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(low, AT_ONCE)
                text = pa.array(b.column("piece").cast(pa.large_binary()))
                off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                codes = CODES[np.frombuffer(text.buffers()[2], np.uint8)[off[0] : off[-1]]]
                words, unknown = _packed(codes, k), np.concatenate(([0], np.cumsum(codes < 0)))
                count = np.diff(off) - k + 1
                row = np.repeat(np.arange(len(count)), count)
                i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = (off[:-1] - off[0])[row] + i
                place = b.column("at").to_numpy()[row] + i
                keep = unknown[at + k] == unknown[at]
                if omit_last:
                    keep &= place < b.column("n").to_numpy()[row] - k
                if step > 1:
                    keep &= place % step == 0
                if only is not None:
                    keep &= tell(words[at])
                row, i, at = row[keep], i[keep], at[keep]
                yield pa.RecordBatch.from_arrays([b.column("chr").take(pa.array(row)), pa.array(b.column("first").to_numpy()[row] + i), pa.array(words[at])], ["chr", "loc", "code"])

    return rows, run


def _packed(codes: np.ndarray, k: int) -> np.ndarray:
    """The word of k bases from each base on, by doubling: words of 1, 2, 4, ... bases, of which k is put together."""
    word, size = codes.astype(np.int64), 1
    out, have = word[:0], 0
    while size <= k:
        if k & size:
            out, have = (word, size) if not have else (_joined(out, have, word, size), have + size)
        word, size = _joined(word, size, word, size), 2 * size
    return out


def _joined(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Each word of n bases with the word of m bases that follows it."""
    last = max(len(b) - n, 0)
    return (a[:last] << 2 * m) + b[n : n + last]


def kmers(contigs: DataFrame, k: int, step: int = 1, omit_last: bool = False, start: str | None = None) -> DataFrame:
    """As packed, with the bases as a string, kmer; k may be any length."""
    rows = _pieces(contigs, k, start)
    found = F.transform(F.sequence(F.lit(0), F.length("piece") - k, F.lit(1)), lambda i: F.struct(i.alias("i"), F.substring(F.col("piece"), i + 1, F.lit(k)).alias("kmer")))
    return _placed(rows.select("chr", "n", "part", "first", F.inline(found)).filter(is_known(F.col("kmer"))), k, step, omit_last, "kmer")


def _pieces(contigs: DataFrame, k: int, start: str | None) -> DataFrame:
    size = max(PIECE, k)
    first = F.col("part") * size + (F.col(start) if start else F.lit(0))
    rows = contigs.filter(F.length("seq") >= k).select("chr", *([start] if start else []), F.length("seq").alias("n"), F.posexplode(pieces(F.upper(F.col("seq")), size, k - 1)).alias("part", "piece"))
    return rows.filter(F.length("piece") >= k).withColumn("first", first)


def _placed(rows: DataFrame, k: int, step: int, omit_last: bool, word: str) -> DataFrame:
    place = F.col("part") * max(PIECE, k) + F.col("i")
    if omit_last:
        rows = rows.filter(place < F.col("n") - k)
    if step > 1:
        rows = rows.filter(place % step == 0)
    return rows.select("chr", (F.col("first") + F.col("i")).alias("loc"), word)


def _word(index: DataFrame) -> str:
    return "code" if "code" in index.columns else "kmer"


def repeats(index: DataFrame, min_copies: int = MIN_COPIES) -> DataFrame:
    """(kmer or code, copies) of sequences that are in the genome so often; counted where they lie first."""
    return index.groupBy(_word(index)).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") >= min_copies)


def contents(contigs: DataFrame, k: int) -> DataFrame:
    """(chr, n, locs, n_kmers): of each contig with words, their number, the sum of their places, and how many differ. A contig of up to LONG bases that comes once is worked out where it lies; words of the others are dealt by word."""
    kinds = T.StructType([T.StructField("chr", contigs.schema["chr"].dataType), *[T.StructField(c, T.LongType()) for c in ("n", "locs", "n_kmers")]])
    rows = contigs.filter(F.length("seq") >= k).select("chr", "seq")
    rest = rows.groupBy("chr").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("seq")).alias("most")).filter((F.col("rows") > 1) | (F.col("most") > LONG)).select(F.col("chr").alias("other")).checkpoint()
    rest = F.broadcast(rest) if rest.count() <= MOST_OTHER else rest  # contigs stay where they are
    same = F.col("chr").eqNullSafe(F.col("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, seq in enumerate(b.column("seq").to_pylist()):
                codes = CODES[np.frombuffer(seq.encode(), np.uint8)]
                unknown = np.concatenate(([0], np.cumsum(codes < 0)))
                loc = np.flatnonzero(unknown[k:] == unknown[:-k])
                if len(loc):
                    found.append((i, len(loc), int(loc.sum()), len(np.unique(_packed(codes, k)[loc]))))
            if found:
                at, *sums = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("chr").take(pa.array(at)), *map(pa.array, sums)], kinds.names)

    own = rows.join(rest, same, "left_anti").mapInArrow(run, kinds)
    words = packed(rows.join(rest, same, "left_semi"), k)
    return own.unionByName(words.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.sum("loc").alias("locs"), F.countDistinct("code").alias("n_kmers")))


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, second bytes, ...: those that are 0 take next to no room when packed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


class _Numbers:
    """Words as numbers: words times an odd number, within 2k bits. High bits, by which buckets are told apart, depend on all bases, and a word has one number."""

    def __init__(self, bases: int, k: int):
        self.mask, self.bits = np.uint64((1 << 2 * k) - 1), min(int(bases // BUCKET).bit_length(), 2 * k, 20)
        self.odd, self.shift = 0x9E3779B97F4A7C15 & int(self.mask) | 1, 2 * k - self.bits
        self.back = pow(self.odd, -1, 1 << 2 * k)

    def of(self, words: np.ndarray) -> np.ndarray:
        return (words.astype(np.uint64) * np.uint64(self.odd) & self.mask).astype(np.int64)

    def words(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers.astype(np.uint64) * np.uint64(self.back) & self.mask).astype(np.int64)

    def spans(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of sorted numbers."""
        edges = np.searchsorted(numbers, np.arange((1 << self.bits) + 1, dtype=np.int64) << self.shift)
        return [(n, int(a), int(b)) for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]


def _blocks(contigs: DataFrame, k: int) -> tuple[DataFrame, _Numbers]:
    """(bucket, words, copies): words of contigs in buckets, as differences of sorted numbers, and how often each occurs. A row is what a block of BLOCK words has of a bucket."""
    numbers = _Numbers(contigs.agg(F.sum(F.length("seq"))).first()[0] or 0, k)
    pieces_, enumerate_ = _enumerated(contigs, k)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        number, copies = np.unique(numbers.of(np.concatenate([b.column("code").to_numpy() for b in held])), return_counts=True)
        return _dealt(numbers, number, copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in enumerate_(batches):
            held, n = [*held, b], n + b.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return pieces_.mapInArrow(run, "bucket int, words binary, copies binary"), numbers


def _dealt(numbers: _Numbers, number: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    spans = numbers.spans(number)
    out = [pa.array([n for n, _, _ in spans], pa.int32()), pa.array([_planes(np.diff(number[a:b], prepend=0)) for _, a, b in spans], pa.binary())]
    return pa.RecordBatch.from_arrays([*out, pa.array([_planes(copies[a:b].astype(np.int64)) for _, a, b in spans], pa.binary())], ["bucket", "words", "copies"])


def _chunks(contigs: DataFrame, k: int) -> DataFrame:
    """(chunk, bases, data): pieces of contigs of some BLOCK bases together, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, chunk = [], 0, TaskContext.get().partitionId() << 32
        row = lambda: pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([n]), pa.array([rounds.frozen(pa.Table.from_batches(held))], pa.binary())], ["chunk", "bases", "data"])
        for whole in batches:
            for low in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(low, AT_ONCE)
                held, n = [*held, b], n + (pc.sum(pc.utf8_length(b.column("piece"))).as_py() or 0)
                if n >= BLOCK:
                    yield row()
                    held, n, chunk = [], 0, chunk + 1
        if held:
            yield row()

    return _enumerated(contigs, k)[0].mapInArrow(run, "chunk long, bases long, data binary")


def repeated(contigs: DataFrame, k: int, min_copies: int = MIN_COPIES) -> DataFrame:
    """As repeats of the packed index, (code, copies): words are counted in blocks, which are dealt instead of words."""
    blocks, numbers = _blocks(contigs, k)

    def run(t: pa.Table) -> pa.Table:
        number = np.concatenate([np.cumsum(_numbers(x)) for x in t.column("words").to_pylist()])
        copies = np.concatenate([_numbers(x) for x in t.column("copies").to_pylist()])
        order = np.argsort(number, kind="stable")
        number, copies = number[order], copies[order]
        first = np.flatnonzero(np.diff(number, prepend=-1))
        total = np.add.reduceat(copies, first)
        often = total >= min_copies
        return pa.table([pa.array(numbers.words(number[first[often]])), pa.array(total[often])], ["code", "copies"])

    return blocks.groupBy("bucket").applyInArrow(run, "code long, copies long")


def occurrences(contigs: DataFrame, k: int, min_copies: int, often: bool = True) -> DataFrame:
    """(chr, n, locs): how often repeats occur in each contig that has some, and the sum of their places; often=False: the same of all other words. As expand_repeats and unique_part of the packed index.

    Chunks of contigs deal their words once, as sorted numbers without their places, and get back a bit for each word, by which they tell their places themselves.
    """
    chunks = _chunks(contigs, k).checkpoint()  # read three times
    enumerate_ = _enumerated(contigs, k)[1]
    numbers = _Numbers(chunks.agg(F.sum("bases")).first()[0] or 0, k)
    kinds = T.StructType([T.StructField("chr", contigs.schema["chr"].dataType), T.StructField("n", T.LongType()), T.StructField("locs", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column("chunk").to_pylist(), b.column("data"), strict=True):
                codes = [x.column("code").to_numpy() for x in enumerate_(rounds.thawed(data.as_py()).to_batches())]
                out = _dealt(numbers, *np.unique(numbers.of(np.concatenate(codes)), return_counts=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, chunk)), *out.columns], ["chunk", *out.schema.names])

    def told(t: pa.Table) -> pa.Table:
        words = [np.cumsum(_numbers(x)) for x in t.column("words").to_pylist()]
        _, which = np.unique(np.concatenate(words), return_inverse=True)
        # copies are far fewer than a double holds exactly
        total = np.bincount(which, np.concatenate([_numbers(x) for x in t.column("copies").to_pylist()]))
        bits = np.split((total >= min_copies)[which], np.cumsum([len(x) for x in words])[:-1])
        some = [i for i, x in enumerate(bits) if x.any()]
        return pa.table([*(t.column(c).combine_chunks().take(pa.array(some, pa.int64())) for c in ("chunk", "bucket")), pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary())], ["chunk", "bucket", "bits"])

    def summed(data: pa.Table, bits: pa.Table) -> pa.Table:
        none = pa.Table.from_batches([], pa.schema([("chr", names_of(data)), ("n", pa.int64()), ("locs", pa.int64())]))
        found = [x for d in data.column("data") for x in enumerate_(rounds.thawed(d.as_py()).to_batches())]
        t = pa.Table.from_batches(found)
        number, which = np.unique(numbers.of(t.column("code").to_numpy()), return_inverse=True)
        repeated_, by = np.zeros(len(number), bool), dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
        for n, a, b in numbers.spans(number):
            if n in by:
                repeated_[a:b] = np.unpackbits(np.frombuffer(by[n], np.uint8), count=b - a)
        t = t.filter(pa.array(repeated_[which] == often))
        if not len(t):
            return none
        sums = t.group_by("chr").aggregate([("loc", "count"), ("loc", "sum")])
        return pa.table([sums.column("chr"), sums.column("loc_count"), sums.column("loc_sum")], kinds.names)

    def names_of(data: pa.Table) -> pa.DataType:
        return rounds.thawed(data.column("data")[0].as_py()).schema.field("chr").type

    flags = chunks.select("chunk", "data").mapInArrow(counted, "chunk long, bucket int, words binary, copies binary").groupBy("bucket").applyInArrow(told, "chunk long, bucket int, bits binary")
    out = chunks.select("chunk", "data").groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(summed, kinds)
    return out.groupBy("chr").agg(F.sum("n").alias("n"), F.sum("locs").alias("locs"))


def unique_part(index: DataFrame, repeated: DataFrame) -> DataFrame:
    """The index without repeats, which would skew joins."""
    return index.join(repeated.select(_word(index)), _word(index), "left_anti")


def pseudo_locations(index: DataFrame, repeated: DataFrame) -> DataFrame:
    """(kmer or code, chr, loc): where the repeats lie, to be stored beside an index without them."""
    return index.join(repeated.select(_word(index)), _word(index)).select(_word(index), "chr", "loc")


def expand_repeats(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits on a repeat (kmer or code, ...) become hits on all of its places."""
    return hits.join(index, _word(index))


def collapsed(index: DataFrame, repeated: DataFrame) -> DataFrame:
    """The packed index with one row for each repeat, without a place: (chr, loc, code, copies, repeat); repeat is the word there, null elsewhere."""
    kinds = {c: index.schema[c].dataType for c in ("chr", "loc")}
    once = unique_part(index, repeated).withColumns({"copies": F.lit(1).cast("long"), "repeat": F.lit(None).cast("long")})
    return once.unionByName(repeated.select(*[F.lit(None).cast(t).alias(c) for c, t in kinds.items()], "code", F.col("copies").cast("long").alias("copies"), F.col("code").alias("repeat")), allowMissingColumns=True)


def _lists(copies: Column) -> Column:
    return F.ceil(copies / POSTED).cast("int")


def postings(index: DataFrame, repeated: DataFrame) -> DataFrame:
    """(repeat, list_no, chr, loc, …): where repeats lie, in lists of about POSTED places each, told apart by a hash of the place: no list grows with a word's copies."""
    rows = index.join(repeated.select("code", "copies"), "code")
    return rows.withColumn("list_no", F.pmod(F.xxhash64("chr", "loc"), _lists(F.col("copies"))).cast("int")).withColumnRenamed("code", "repeat").drop("copies")


def expand_postings(hits: DataFrame, lists: DataFrame) -> DataFrame:
    """Hits of a collapsed index with all places of the repeats among them; each list of a word's places is met by a key of its own."""
    places = [c for c in lists.columns if c not in ("repeat", "list_no")]
    many = hits.filter("repeat is not null").drop(*places).withColumn("list_no", F.explode(F.sequence(F.lit(0), _lists(F.col("copies")) - 1)))
    return hits.filter("repeat is null").drop("copies", "repeat").unionByName(many.join(lists, ["repeat", "list_no"]).drop("copies", "repeat", "list_no"))


def save(index: DataFrame, path: str, k: int, bases: int = 4) -> None:
    """The packed index as Parquet, partitioned by the first bases (head), so that exact searches read what they need."""
    index.withColumn("head", first_bases(F.col("code"), k, bases)).repartition("head").sortWithinPartitions("code").write.partitionBy("head").parquet(path)
