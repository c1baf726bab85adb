"""The binary trace store, there and back byte by byte."""

import struct

import numpy as np
import pytest

from helixplane.sources import binary


def plain_store(tracks, contigs, values):
    """The bytes of a store, from its layout alone."""
    out = b"BTRACE" + struct.pack("<i", len(tracks))
    out += b"".join(struct.pack("<Q", len(t)) for t in tracks) + "".join(tracks).encode()
    out += struct.pack("<i", len(contigs)) + b"".join(struct.pack("<Q", len(c)) for c, _ in contigs) + "".join(c for c, _ in contigs).encode()
    out += b"".join(struct.pack("<I", n) for _, n in contigs)
    for t in tracks:
        for c, n in contigs:
            own = np.zeros(n, "<f4")
            for p, v in values.get((t, c), {}).items():
                own[p] = v
            out += own.tobytes()
    return out


TRACKS, CONTIGS = ["fwd", "rev_strand"], [("chr1", 250), ("chrEmpty", 0), ("c2", 1001)]
VALUES = {("fwd", "chr1"): {0: 1.5, 99: 2.0, 100: 0.25, 249: 7.0}, ("rev_strand", "c2"): {1000: 3.0, 500: 0.5}, ("fwd", "c2"): {1: 1e-3}}


def test_a_file_is_read_in_slices(spark, tmp_path):
    raw = plain_store(TRACKS, CONTIGS, VALUES)
    (tmp_path / "a.trace").write_bytes(raw)
    for size in (100, 1 << 20):
        got = binary.read_trace(spark, str(tmp_path / "a.trace"), slice_=size)
        assert {(r.track, r.contig, r.pos, round(r.value, 6)) for r in got.collect()} == {(t, c, p, round(v, 6)) for (t, c), x in VALUES.items() for p, v in x.items()}
    one = binary.read_trace(spark, f"file://{tmp_path}/a.trace", "fwd", "c2", 100)
    assert one.rdd.getNumPartitions() == 11 and [(r.pos, r.contig) for r in one.collect()] == [(1, "c2")]
    reader = binary.TraceReader({"path": str(tmp_path / "a.trace"), "track": "fwd", "contig": "chr1", "slice": "1000"})
    (part,) = reader.partitions()
    # bytes beyond the part may be anything: they aren't read
    (tmp_path / "a.trace").write_bytes(raw[: part.offset + 4 * part.size] + b"\xff" * (len(raw) - part.offset - 4 * part.size))
    assert next(reader.read(part)).num_rows == 4


def test_a_density_is_written_as_the_file_is(spark, tmp_path):
    names = {c: k for k, (c, _) in enumerate(CONTIGS, 1)}
    density = spark.createDataFrame([(names[c], TRACKS.index(t), p, v) for (t, c), x in VALUES.items() for p, v in x.items()], "chr int, track int, pos long, value double")
    contigs = spark.createDataFrame([(names[c], c, n) for c, n in CONTIGS], "chr int, name string, length int")
    for size in (100, 1 << 20):
        path = tmp_path / f"store{size}"
        binary.write_trace(density, contigs, TRACKS, str(path), size)
        assert b"".join(p.read_bytes() for p in sorted(path.glob("part-*"))) == plain_store(TRACKS, CONTIGS, VALUES)
        back = binary.read_trace(spark, str(path), slice_=77).collect()
        assert {(r.track, r.contig, r.pos) for r in back} == {(t, c, p) for (t, c), x in VALUES.items() for p in x}


def plain_genome(contigs):
    """The bytes of a genome store, from its layout alone."""
    every = [("Pseudo", "", 1), *contigs]
    body = struct.pack("<i", len(every))
    for name, _, _ in every:
        body += struct.pack("<i", len(name) + 1) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", len(s)) for _, s, _ in every) + b"".join(struct.pack("<i", k) for _, _, k in every)
    body += "".join(s for _, s, _ in every).encode()
    return b"SM_OD_GEN" + struct.pack("<QQQ", 1, 33 + len(body), 33) + body


def test_genomes_there_and_back(spark, tmp_path):
    contigs = [("c_paternal", "ACGTNacgt" * 37, 2), ("c_maternal", "GATTACA" * 51, 3), ("m", "T", 1)]
    raw = plain_genome(contigs)
    (tmp_path / "g").write_bytes(raw)
    names = ["reference", "paternal", "maternal"]
    for size in (50, 1 << 20):
        slices = binary.read_genome(spark, str(tmp_path / "g"), slice_=size)
        rows = binary.joined(slices).orderBy("chr").collect()
        assert [(r.chr, r.name, r.seq, r.source) for r in rows] == [(k, n, s, names[x - 1]) for k, (n, s, x) in enumerate(contigs, 1)]
        binary.write_genome(binary.joined(slices), str(tmp_path / f"out{size}"), size)
        assert b"".join(p.read_bytes() for p in sorted((tmp_path / f"out{size}").glob("part-*"))) == raw
    one = binary.read_genome(spark, str(tmp_path / "out50"), "c_maternal", 100).collect()
    assert [(r.pos, len(r.seq)) for r in one] == [(0, 100), (100, 100), (200, 100), (300, 57)]
    (tmp_path / "short").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="size"):
        binary.read_genome(spark, str(tmp_path / "short")).collect()


def test_what_is_no_store_fails(spark, tmp_path):
    raw = plain_store(TRACKS, CONTIGS, VALUES)
    for name, bad in (("magic", b"XTRACE" + raw[6:]), ("short", raw[:-4]), ("long", raw + b"\0")):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception, match="trace store|size"):
            binary.read_trace(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="nowhere"):
        binary.read_trace(spark, str(tmp_path / "nowhere")).collect()
