"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

1. Toxicity: documents that the classifier chain finds toxic go.
2. Line dedup: lines stay only in the first document that holds them; n_chars follows the text.
3. MinHash near-dedup: the first document of each group of near-duplicates stays.
4. Mixing: documents are put in the order of the mix to target weights (files and rows in order).
5. BPE: what stays is encoded and decoded; token counts and digests come out in the order of the mix,
   with mix_place, the document's place in it from 0.

Null text stays null; columns beyond doc_id and text are carried. SQL can't express the classifier or
BPE, so there is no ORACLE_SQL; tests hold run() against plain versions of the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixplane.llm import bpe, lines, minhash, mixing, toxicity
from helixplane.llm.common import discard, materialise, table

ORACLE_SQL = None


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, with whether text is null; their names meet no others."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    own = F.struct(*(others or [F.lit(0)]))
    return docs.select("doc_id", "text", F.struct(own.alias("own"), F.col("text").isNull().alias("null")).alias("rest"))


def _unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.when(~F.col("rest")["null"], F.col("text")).alias(c) if c == "text" else F.col("doc_id") if c == "doc_id" else F.col("rest")["own"][c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = toxicity.judge(_wrapped(docs), table(spark, sf_dir, "labels"), "rest").filter(~F.col("toxic"))
    return _unwrapped(out, docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_wrapped(docs)).withColumn("rest", F.col("carried")["rest"])
    out = _unwrapped(out, docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = max([*docs.columns, "kept"], key=len) + "_"  # no column's name
    kept = minhash.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs)
    out = out.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return out.select(*[c if c in ("doc_id", "source") else F.col("carried")[c].alias(c) for c in docs.columns])


def _with_place(docs: DataFrame) -> DataFrame:
    """doc_id, text and place_ (part, file, row), which sorts rows as the files and their rows lie; Spark itself reads the largest splits first. Rows that aren't read from Parquet files keep the order that they have."""
    try:
        part = F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as int)")
        return docs.select("doc_id", "text", F.struct(part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place_"))
    except AnalysisException:
        part = F.spark_partition_id()
        row = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
        return docs.select("doc_id", "text", F.struct(part.alias("part"), F.lit("").alias("file"), row.alias("row")).alias("place_"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_decode(_with_place(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "place_")
    # digests are small; written first, as finding the ranges to sort by would encode all texts once more
    out = materialise(bpe.digests(encoded, "place_"), "digests")
    files = out.groupBy("place_.part", "place_.file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = files.select(F.struct("part", "file").alias("of_"), before.alias("begin_"))
    out = out.join(begins, F.struct(F.col("place_.part"), F.col("place_.file")).eqNullSafe(F.col("of_")))
    out = out.withColumn("mix_place", F.col("begin_") + F.col("place_.row"))
    return out.repartitionByRange("mix_place").sortWithinPartitions("mix_place").drop("place_", "of_", "begin_")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
