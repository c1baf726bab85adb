"""Binary stores of traces and genomes as Spark data sources: `trace_store` and `genome_store`.

Layout of traces (fixed values, little endian): the magic BTRACE; the number of tracks (int32); the length of each track's
name (uint64), then the names; the number of contigs (int32); the length of each contig's name (uint64), then the names; the
length of each contig (uint32); then a float32 for each base, contig by contig, track by track.

Layout of genomes: the magic SM_OD_GEN; version 1, the bytes of the whole store and where the genome begins (uint64 each); the number of contigs
(int32); for each the length of its name with a closing zero (int32) and the name; the contigs' lengths (uint32); their sources (int32: 1
reference, 2 paternal, 3 maternal); then their bases. Contig 0 is a pseudo one without bases. Rows are (chr, name, source, pos, seq), a row a slice.

A store is a file, or a folder of parts that are the file cut in the order of their names (what the writer leaves, as tasks can't write
into one file; `cat` makes it one). Reading: the header is read once; each task reads the bytes of its own slice of a contig and
gives rows (track, contig, pos, value) of the values that aren't 0. The options `track` and `contig` leave out the slices of
others, whose bytes are never touched; `slice` is the bases of a slice. Paths are whatever pyarrow's file systems reach.
"""

from __future__ import annotations

import dataclasses
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC, SLICE = b"BTRACE", 1 << 20
GENOME_MAGIC, GENOME_VERSION, PSEUDO = b"SM_OD_GEN", 1, "Pseudo"
SOURCES = ["reference", "paternal", "maternal"]
GENOME_SCHEMA = "chr int, name string, source string, pos long, seq string"
SCHEMA = "track string, contig string, pos long, value float"
PARTS = "slice_no long, blob binary"


def _files(path: str) -> tuple[pafs.FileSystem, list[tuple[str, int]]]:
    """The store's file, or its parts in their order, with their sizes."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return fs, [(at, info.size)]
    parts = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and f.base_name.startswith("part-"))
    return fs, parts


def _bytes(fs: pafs.FileSystem, files: list[tuple[str, int]], start: int, size: int) -> bytes:
    """So many bytes of the store from a place on; only the parts that hold them are opened."""
    out, at = [], 0
    for path, n in files:
        low, high = max(start, at), min(start + size, at + n)
        if low < high:
            with fs.open_input_file(path) as f:
                f.seek(low - at)
                out.append(f.read(high - low))
        at += n
    got = b"".join(out)
    if len(got) != size:
        raise ValueError(f"the store ends {size - len(got)} bytes early")
    return got


@dataclasses.dataclass
class Header:
    tracks: list[str]
    contigs: list[str]
    lengths: list[int]

    def dumps(self) -> bytes:
        names = lambda xs: struct.pack("<i", len(xs)) + struct.pack(f"<{len(xs)}Q", *[len(x.encode()) for x in xs]) + "".join(xs).encode()
        return MAGIC + names(self.tracks) + names(self.contigs) + struct.pack(f"<{len(self.lengths)}I", *self.lengths)

    @classmethod
    def read(cls, fs: pafs.FileSystem, files: list[tuple[str, int]]) -> tuple[Header, int]:
        """The header, and how many bytes it has."""
        at = 0

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return _bytes(fs, files, at - size, size)

        def names() -> list[str]:
            (n,) = struct.unpack("<i", take(4))
            return [take(size).decode() for size in struct.unpack(f"<{n}Q", take(8 * n))]

        if take(len(MAGIC)) != MAGIC:
            raise ValueError("not a trace store")
        tracks, contigs = names(), names()
        return cls(tracks, contigs, list(struct.unpack(f"<{len(contigs)}I", take(4 * len(contigs))))), at


@dataclasses.dataclass
class Part(InputPartition):
    track: str
    contig: str
    pos: int
    size: int
    offset: int


class TraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.slice = options["path"], int(options.get("slice", SLICE))
        self.track, self.contig = options.get("track"), options.get("contig")

    def partitions(self) -> list[Part]:
        fs, files = _files(self.path)
        head, at = Header.read(fs, files)
        if sum(n for _, n in files) != at + 4 * len(head.tracks) * sum(head.lengths):
            raise ValueError("the store's size isn't what its header says")
        out = []
        for track in head.tracks:
            for contig, n in zip(head.contigs, head.lengths, strict=True):
                if self.track in (None, track) and self.contig in (None, contig):
                    out += [Part(track, contig, p, min(self.slice, n - p), at + 4 * p) for p in range(0, n, self.slice)]
                at += 4 * n
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(_bytes(*_files(self.path), part.offset, 4 * part.size), "<f4")
        some = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array([part.track] * len(some), pa.string()), pa.array([part.contig] * len(some), pa.string()), pa.array(part.pos + some, pa.int64()), pa.array(values[some])], ["track", "contig", "pos", "value"])


class PartWriter(DataSourceWriter):
    """Writes blobs as the parts of a store, named by their number; a part that is written again replaces itself."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, at = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        fs.create_dir(at, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{at}/.tmp-{r.slice_no:012d}") as f:
                f.write(bytes(r.blob))
            fs.move(f"{at}/.tmp-{r.slice_no:012d}", f"{at}/part-{r.slice_no:012d}")
        return WriterCommitMessage()


@dataclasses.dataclass
class Genome:
    """What a genome store says before its bases; contig 0 among them."""

    names: list[str]
    lengths: list[int]
    sources: list[int]

    def dumps(self) -> bytes:
        n = len(self.names)
        body = struct.pack("<i", n) + b"".join(struct.pack("<i", len(x.encode()) + 1) + x.encode() + b"\0" for x in self.names)
        body += struct.pack(f"<{n}I", *self.lengths) + struct.pack(f"<{n}i", *self.sources)
        begin = len(GENOME_MAGIC) + 24
        return GENOME_MAGIC + struct.pack("<3Q", GENOME_VERSION, begin + len(body) + sum(self.lengths), begin) + body

    @classmethod
    def read(cls, fs: pafs.FileSystem, files: list[tuple[str, int]]) -> tuple[Genome, int]:
        at = len(GENOME_MAGIC) + 24
        head = _bytes(fs, files, 0, at)
        if not head.startswith(GENOME_MAGIC):
            raise ValueError("not a genome store")
        version, size, at = struct.unpack("<3Q", head[len(GENOME_MAGIC) :])
        if version != GENOME_VERSION or size != sum(n for _, n in files):
            raise ValueError("the store's version or size isn't what its header should say")

        def take(n: int) -> bytes:
            nonlocal at
            at += n
            return _bytes(fs, files, at - n, n)

        (n,) = struct.unpack("<i", take(4))
        names = [take(struct.unpack("<i", take(4))[0])[:-1].decode() for _ in range(n)]
        return cls(names, list(struct.unpack(f"<{n}I", take(4 * n))), list(struct.unpack(f"<{n}i", take(4 * n)))), at


@dataclasses.dataclass
class Bases(InputPartition):
    chr: int
    name: str
    source: str
    pos: int
    size: int
    offset: int


class GenomeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.slice, self.contig = options["path"], int(options.get("slice", SLICE)), options.get("contig")

    def partitions(self) -> list[Bases]:
        head, at = Genome.read(*_files(self.path))
        out = []
        for k, (name, n, source) in enumerate(zip(head.names, head.lengths, head.sources, strict=True)):
            if self.contig in (None, name):
                out += [Bases(k, name, SOURCES[source - 1], p, min(self.slice, n - p), at + p) for p in range(0, n, self.slice)]
            at += n
        return out

    def read(self, part: Bases) -> Iterator[tuple]:
        yield part.chr, part.name, part.source, part.pos, _bytes(*_files(self.path), part.offset, part.size).decode("ascii")


class GenomeStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "genome_store"

    def schema(self) -> str:
        return GENOME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GenomeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PartWriter(dict(self.options))


class TraceStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TraceReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PartWriter(dict(self.options))


def read_trace(spark: SparkSession, path: str, track: str | None = None, contig: str | None = None, slice_: int = SLICE) -> DataFrame:
    """(track, contig, pos, value) of a store, or of one track or contig of it."""
    spark.dataSource.register(TraceStore)
    reader = spark.read.format("trace_store").option("path", path).option("slice", slice_)
    for name, value in (("track", track), ("contig", contig)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load()


def write_trace(density: DataFrame, contigs: DataFrame, tracks: list[str], path: str, slice_: int = SLICE) -> None:
    """A density (chr, track, pos, value; tracks by number) of contigs (chr, name, length) as a store in a folder, contigs in the order of chr. Each task makes the bytes of its slices; the header names the contigs (a row each on the driver, as in any such file)."""
    spark = density.sparkSession
    spark.dataSource.register(TraceStore)
    rows = contigs.select("chr", "name", F.col("length").cast("long").alias("length")).orderBy("chr").collect()
    head = Header(tracks, [r.name for r in rows], [r.length for r in rows])
    every = contigs.select("chr", F.col("length").cast("long").alias("length")).filter("length > 0")
    every = every.select("chr", "length", F.explode(F.sequence(F.lit(0), F.lit(len(tracks) - 1))).alias("track")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / slice_))))
    held = density.filter((F.col("pos") >= 0)).select("chr", F.col("track").cast("int").alias("track"), F.floor(F.col("pos") / slice_).alias("k"), F.pmod(F.col("pos"), F.lit(slice_)).cast("int").alias("i"), F.col("value").cast("float").alias("value"))
    before, total = {}, 0
    for r in rows:
        before[r.chr], total = total, total + -(-r.length // slice_)
    first = spark.createDataFrame([(r.chr, before[r.chr]) for r in rows], every.select("chr").schema.add("before", "long"))
    slots = every.join(first, "chr").withColumn("slice_no", F.lit(1) + F.col("track") * total + F.col("before") + F.col("k")).withColumn("size", F.least(F.col("length") - F.col("k") * slice_, F.lit(slice_)).cast("int"))
    slots = slots.select("chr", "track", "k", "slice_no", "size")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for no, size in zip(left.column("slice_no").to_pylist(), left.column("size").to_pylist(), strict=True):
            values = np.zeros(size, "<f4")
            i, v = right.column("i").to_numpy(), right.column("value").to_numpy()
            values[i[i < size]] = v[i < size]
            out.append((no, values.tobytes()))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["slice_no", "blob"])

    parts = slots.groupBy("chr", "track", "k").cogroup(held.groupBy("chr", "track", "k")).applyInArrow(run, PARTS)
    parts = parts.unionByName(spark.createDataFrame([(0, head.dumps())], PARTS))
    parts.write.format("trace_store").option("path", path).mode("append").save()


def read_genome(spark: SparkSession, path: str, contig: str | None = None, slice_: int = SLICE) -> DataFrame:
    """(chr, name, source, pos, seq) of a store, a row a slice, or of one contig of it."""
    spark.dataSource.register(GenomeStore)
    reader = spark.read.format("genome_store").option("path", path).option("slice", slice_)
    return (reader if contig is None else reader.option("contig", contig)).load()


def joined(slices: DataFrame) -> DataFrame:
    """Contigs (chr, name, seq, source), a row each, of slices."""
    pieces = F.array_sort(F.collect_list(F.struct("pos", "seq")))
    return slices.groupBy("chr", "name", "source").agg(F.array_join(F.transform(pieces, lambda x: x["seq"]), "").alias("seq")).select("chr", "name", "seq", "source")


def write_genome(contigs: DataFrame, path: str, slice_: int = SLICE) -> None:
    """Contigs (chr from 1, name, seq and, if there is such a column, source) as a store in a folder, in the order of chr; each part is a slice."""
    from helixplane.functions.sequence import pieces

    spark = contigs.sparkSession
    spark.dataSource.register(GenomeStore)
    own = contigs.select("chr", "name", "seq", F.col("source") if "source" in contigs.columns else F.lit(SOURCES[0]).alias("source"))
    rows = own.select("chr", "name", "source", F.length("seq").alias("length")).orderBy("chr").collect()  # a row a contig, as in the header
    head = Genome([PSEUDO, *[r.name for r in rows]], [0, *[r.length for r in rows]], [1, *[SOURCES.index(r.source) + 1 for r in rows]])
    before, total = [], 1
    for r in rows:
        before.append((r.chr, total))
        total += -(-r.length // slice_)
    first = spark.createDataFrame(before, own.select("chr").schema.add("before", "long"))
    cut = own.filter("seq <> ''").select("chr", F.posexplode(pieces(F.col("seq"), slice_, 0)).alias("k", "piece")).join(first, "chr")
    parts = cut.select((F.col("before") + F.col("k")).alias("slice_no"), F.encode("piece", "utf-8").alias("blob"))
    parts.unionByName(spark.createDataFrame([(0, head.dumps())], PARTS)).write.format("genome_store").option("path", path).mode("append").save()
