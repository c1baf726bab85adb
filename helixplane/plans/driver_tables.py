"""The driver's tables seen as genomes, reads, mappings and densities; the same in SQL as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FROM, _TO = "BDEFHIJKLMNOPQRSUVWXYZ", "CGATCGATCGATCGATCGATCG"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: Column) -> Column:
    """Letters as bases, whole texts."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")), _FROM, _TO)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chr"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), dna(F.col("text")).alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read_id"), F.lit(1).alias("mate"), F.concat(F.lit("read_"), F.col("item_id").cast("string")).alias("name"), dna(F.col("text")).alias("seq"))
    return rows.withColumn("qual", F.translate("seq", "ACGT", "5:?D"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = read(spark, sf_dir, "lineitem").withColumn("mapping_no", F.row_number().over(order) - 1)
    return rows.select(
        F.col("l_orderkey").alias("read_id"), "mapping_no", F.col("l_suppkey").alias("chr"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("stop"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), (-F.col("l_quantity") / 10).alias("score")
    )


def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_linenumber").alias("sample"), (F.col("l_linestatus") == "O").cast("int").alias("track"), F.col("l_suppkey").alias("chr"), F.col("l_partkey").alias("pos")).agg(F.sum("l_quantity").alias("value"))


def bootstraps(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == status)
    return rows.groupBy(F.pmod("l_orderkey", F.lit(25)).cast("int").alias("bs"), F.col("l_suppkey").alias("chr"), F.lit(0).alias("track"), F.col("l_partkey").alias("pos")).agg(F.sum("l_quantity").alias("value"))


def dmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors by user: shared, paternal-only and maternal-only ones in turn."""
    rows = read(spark, sf_dir, "events")
    ordinal = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.pmod(F.col("event_id"), F.lit(5))
    rows = rows.select(F.col("user_id").alias("prefix"), ordinal.alias("ord"), kind.alias("kind"))
    return rows.select("prefix", "ord", F.when(F.col("kind") == 3, 0).otherwise(F.col("ord") * 10 + 1).alias("pat"), F.when(F.col("kind") == 4, 0).otherwise(F.col("ord") * 10 + 3).alias("mat"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, line) of documents."""
    rows = read(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_DNA = f"translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{_FROM}', '{_TO}')"
C = f"c AS (SELECT doc_id AS chr, 'doc_' || doc_id AS name, {_DNA} AS seq FROM documents)"
R = f"r AS (SELECT item_id AS read_id, 1 AS mate, 'read_' || item_id AS name, {_DNA} AS seq FROM benchmark)"
M = """m AS (SELECT l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS mapping_no,
    l_suppkey AS chr, l_partkey AS start, l_partkey + l_quantity::INT AS stop, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, -l_quantity / 10 AS score FROM lineitem)"""
P = M + """, p AS (SELECT *, pow(10, score - mx) / sum(pow(10, score - mx)) OVER (PARTITION BY read_id) AS cond_prb, CASE WHEN strand = '+' THEN 0 ELSE 1 END AS track,
    CASE WHEN strand = '+' THEN start ELSE stop - 1 END AS site FROM (SELECT *, max(score) OVER (PARTITION BY read_id) AS mx FROM m))"""
D = "d AS (SELECT l_linenumber AS sample, (l_linestatus = 'O')::INT AS track, l_suppkey AS chr, l_partkey AS pos, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
B = "b AS (SELECT l_linestatus AS status, l_orderkey % 25 AS bs, l_suppkey AS chr, 0 AS track, l_partkey AS pos, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
A = """a AS (SELECT prefix, ord, CASE WHEN kind = 3 THEN 0 ELSE ord * 10 + 1 END AS pat, CASE WHEN kind = 4 THEN 0 ELSE ord * 10 + 3 END AS mat
    FROM (SELECT user_id AS prefix, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id % 5 AS kind FROM events))"""
L = "l AS (SELECT doc_id AS file, unnest(s) AS line, unnest(range(len(s))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"
