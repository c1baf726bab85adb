"""Text formats whose records or headers span lines: FASTA, FASTQ, wiggle, logs; and plain tables.

Files are read by Spark, each split by a task of its own: lines are numbered within splits, and what a
file's earlier splits hold is added from a table with a row for each split. What spans lines is worked
out in blocks of lines in the same way, so no task holds a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines that a task works through together.
BLOCK_LINES = 250_000
#: Primers of a trimming.
MOST_PRIMERS = 2_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): line_no, from 0, is a line's place in its file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    own = F.row_number().over(Window.partitionBy("file", "split").orderBy("id")) - 1
    sizes = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("own", own).join(_before(sizes, "split"), ["file", "split"]).select("file", (F.col("before") + F.col("own")).alias("line_no"), "line")


def _before(sizes: DataFrame, part: str) -> DataFrame:
    """(file, part, before): the sum of n over a file's earlier parts; a row for each part."""
    earlier = Window.partitionBy("file").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _counted(text: DataFrame, flag: Column, name: str) -> DataFrame:
    """How many lines of a file up to each line have the flag, by blocks of lines."""
    rows = text.withColumn("block", F.floor(F.col("line_no") / BLOCK_LINES)).withColumn("flag", F.coalesce(flag, F.lit(False)).cast("long"))
    inside = F.sum("flag").over(Window.partitionBy("file", "block").orderBy("line_no"))
    sizes = rows.groupBy("file", "block").agg(F.sum("flag").alias("n"))
    return rows.withColumn("inside", inside).join(_before(sizes, "block"), ["file", "block"]).withColumn(name, F.col("before") + F.col("inside")).drop("block", "flag", "inside", "before")


def fasta(text: DataFrame) -> DataFrame:
    """(file, chr, name, seq, len) of FASTA text (file, line_no, line).

    Names end at white space; sequence before any header is named Default; other characters than letters are dropped.
    Contigs are numbered from 1 by file and place: 0 stands for none.
    """
    header = F.col("line").startswith(">")
    rows = _counted(text, header, "group")
    rows = rows.groupBy("file", "group").agg(F.max(F.when(header, F.regexp_extract("line", r"^>\s*(\S*)", 1))).alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~header, F.struct("line_no", "line")))), lambda x: x["line"]), "").alias("seq"))
    rows = rows.select("file", "group", F.coalesce("name", F.lit("Default")).alias("name"), F.regexp_replace("seq", "[^A-Za-z]", "").alias("seq")).filter("seq <> ''")
    # a row for each contig, without its sequence
    numbers = rows.select("file", "group").withColumn("chr", F.row_number().over(Window.orderBy("file", "group")))
    return rows.join(numbers, ["file", "group"]).select("file", "chr", "name", "seq", F.length("seq").alias("len"))


def fastq(text: DataFrame) -> DataFrame:
    """(file, read_id, name, seq, qual) of FASTQ text.

    A record begins at a line with @ whose second next line begins with +, wherever it stands, so stray
    lines cost no other record. Names are cut at the last space; read_id is the record's place in the
    file. Records whose lengths differ, or whose sequence is empty, are dropped; they keep their place.
    """
    block = F.floor(F.col("line_no") / BLOCK_LINES)
    # the first lines of a block are the last ones of a record that begins in the block before
    blocks = F.array(block, F.when((F.col("line_no") % BLOCK_LINES < 3) & (block > 0), block - 1))
    rows = text.withColumn("block", F.explode(F.array_compact(blocks)))
    w = Window.partitionBy("file", "block").orderBy("line_no")
    rows = rows.select("file", "block", "line_no", F.col("line").alias("head"), *[F.lead("line", k).over(w).alias(name) for k, name in ((1, "seq"), (2, "plus"), (3, "qual"))])
    heads = rows.filter((F.floor(F.col("line_no") / BLOCK_LINES) == F.col("block")) & F.col("head").startswith("@") & F.col("plus").startswith("+"))
    sizes = heads.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.withColumn("own", F.row_number().over(w) - 1).join(_before(sizes, "block"), ["file", "block"]).withColumn("read_id", F.col("before") + F.col("own"))
    heads = heads.filter((F.length("seq") == F.length("qual")) & (F.length("seq") > 0))
    return heads.select("file", "read_id", F.regexp_replace(F.substring("head", 2, 1 << 30), r"\s+\S*$", "").alias("name"), "seq", "qual")


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(read_id, mate, name, seq, qual) of two files whose records belong together by place; mates must have one name but for /1 and /2, else it fails. Records that only one file has whole are left out."""
    bare = lambda c: F.regexp_replace(c, "/[12]$", "")
    both = first.select("read_id", bare("name").alias("n1"), F.struct(F.lit(1).alias("mate"), "seq", "qual").alias("m1")).join(second.select("read_id", bare("name").alias("n2"), F.struct(F.lit(2).alias("mate"), "seq", "qual").alias("m2")), "read_id")
    wrong = F.raise_error(F.concat(F.lit("mates don't belong together: "), "n1", F.lit(", "), "n2"))
    both = both.withColumn("name", F.when(F.col("n1") == F.col("n2"), F.col("n1")).otherwise(wrong)).filter("name is not null")
    return both.select("read_id", "name", F.explode(F.array("m1", "m2")).alias("x")).select("read_id", "x.mate", "name", "x.seq", "x.qual")


def split_mates(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads of one file by the suffix of their names, /1 and /2."""
    return reads.filter(F.col("name").endswith("/1")), reads.filter(F.col("name").endswith("/2"))


def trimmed(reads: DataFrame, start: int, end: int) -> DataFrame:
    """Without so many bases at either end."""
    n = F.greatest(F.length("seq") - start - end, F.lit(0))
    return reads.withColumn("qual", F.substring("qual", F.lit(start + 1), n)).withColumn("seq", F.substring("seq", F.lit(start + 1), n))


def primer_trimmed(reads: DataFrame, primers: DataFrame, mismatches: int, strict: bool = False) -> DataFrame:
    """Reads without the longest primer that their start matches with up to so many mismatches; strict: reads without a primer go. Adds `trimmed`, the bases cut.

    Primers are counted, MOST_PRIMERS at most; they go with each read as one list, longest first, so reads aren't shuffled.
    """
    from helixplane.functions.sequence import hamming

    rows = [r.primer for r in primers.select(F.upper("primer").alias("primer")).filter("primer <> ''").distinct().limit(MOST_PRIMERS + 1).collect()]
    if len(rows) > MOST_PRIMERS:
        raise ValueError(f"more than {MOST_PRIMERS} primers")
    listed = F.array(*[F.lit(p) for p in sorted(rows, key=lambda p: (-len(p), p))]) if rows else F.array().cast("array<string>")
    near = lambda p: (F.length("seq") >= F.length(p)) & (hamming(F.upper(F.substring("seq", F.lit(1), F.length(p))), p) <= mismatches)
    best = reads.withColumn("trimmed", F.coalesce(F.length(F.get(F.filter(listed, near), F.lit(0))), F.lit(0)))
    rest = lambda c: F.substring(c, F.col("trimmed") + 1, F.length(c)).alias(c)
    best = best.filter("trimmed > 0") if strict else best
    return best.select(*[rest(c) if c in ("seq", "qual") else c for c in reads.columns], "trimmed")


def wiggle(text: DataFrame) -> DataFrame:
    """(file, track, chrom, pos, value) of wiggle text; pos as written, from 1. fixedStep lines fail.

    Headers hold for the lines after them, by blocks of lines; what earlier blocks end with is broadcast, a row for each block but a file's first.
    """
    fixed = F.when(F.col("line").startswith("fixedStep"), F.raise_error(F.lit("fixedStep wiggles aren't supported")))
    line = F.coalesce(fixed, F.col("line"))
    track = F.when(F.col("line").startswith("track"), F.regexp_extract("line", r'name="?([^"\s]*)', 1))
    chrom = F.when(F.col("line").startswith("variableStep"), F.regexp_extract("line", r"chrom=(\S+)", 1))
    rows = text.select("file", "line_no", F.floor(F.col("line_no") / BLOCK_LINES).alias("block"), line.alias("line")).withColumns({"track": track, "chrom": chrom})
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    ends = rows.groupBy("file", "block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c) for c in ("track", "chrom")])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", last("track", earlier).alias("track0"), last("chrom", earlier).alias("chrom0")).filter("block > 0")
    own = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("file", "block", "line", last("track", own).alias("track"), last("chrom", own).alias("chrom")).filter(F.col("line").rlike(r"^[0-9]+\s")).join(F.broadcast(ends), ["file", "block"], "left")
    part = F.split("line", r"\s+")
    return rows.select("file", F.coalesce("track", "track0").alias("track"), F.coalesce("chrom", "chrom0").alias("chrom"), part[0].cast("long").alias("pos"), part[1].cast("double").alias("value"))


def log_rows(text: DataFrame) -> DataFrame:
    """(file, thread, read_no, key, value) of log lines "… [thread] key value"; a thread's reads are numbered by its read_id lines."""
    found = lambda k: F.regexp_extract("line", r"\[\D*(\d+)\]:?\s+(\S+)\s+(\S+)\s*$", k)
    rows = text.select("file", "line_no", found(1).alias("thread"), found(2).alias("key"), found(3).alias("value")).filter("thread <> ''")
    w = Window.partitionBy("file", "thread").orderBy("line_no")
    return rows.withColumn("read_no", F.sum((F.col("key") == "read_id").cast("int")).over(w)).filter("read_no > 0").select("file", "thread", "read_no", "key", "value")


def fragment_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(len, p) of a tab-separated file without header; lengths between the least and the greatest that the file leaves out have p 0."""
    rows = spark.read.csv(path, sep="\t", schema="len int, p double")
    every = rows.agg(F.min("len").alias("a"), F.max("len").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("len"))
    return every.join(rows, "len", "left").select("len", F.coalesce("p", F.lit(0.0)).alias("p"))


def diploid_map(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(prefix, ord, pat, mat) of a .map file: reference, paternal, maternal anchors; lines with # are comments."""
    if not path.endswith(".map"):
        raise ValueError("diploid maps end in .map")
    rows = lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != ""))
    part = F.split("line", r"\s+")
    return rows.select(F.lit(prefix).alias("prefix"), F.col("line_no").alias("ord"), part[1].cast("int").alias("pat"), part[2].cast("int").alias("mat"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sample_id, file) of a tab-separated list of samples and their comma-separated files."""
    rows = spark.read.csv(path, sep="\t", schema="name string, sample_id string, files string")
    return rows.select("name", "sample_id", F.explode(F.split("files", ",")).alias("file"))
