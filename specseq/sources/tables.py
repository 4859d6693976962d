"""The given tables under the names of the domain: scans, peaks, pairs, results, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a given table that one task is dealt.
TASK_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks(rows: DataFrame, per: int = TASK_ROWS) -> int:
    """How many tasks the rows ask for if each is dealt ``per``. Rows are counted: those of a given table come from its footers."""
    return max(-(-rows.count() // per), 1)


def dealt(rows: DataFrame, *keys: str, of: DataFrame | None = None, per: int = TASK_ROWS) -> DataFrame:
    """rows dealt by the keys into as many partitions as their number, or that of the given rows ``of`` that they come from, asks for: what a task holds doesn't grow with the table.

    What is then grouped, ordered or joined by the keys needs no further shuffle.
    """
    return rows.repartition(tasks(rows if of is None else of, per), *keys)


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    """scan, peak, mz, intensity: the parts of an order."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("scan"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("peak"), "l_extendedprice", "l_quantity")
    return dealt(lines, "scan").groupBy("scan", "peak").agg(F.max("l_extendedprice").alias("mz"), F.sum("l_quantity").alias("intensity"))


def scan_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """light, heavy: consecutive orders of a customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("light"), F.lead("o_orderkey").over(w).alias("heavy")).where("heavy is not null")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """scan, total: a mass for each order."""
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("scan"), F.col("o_totalprice").alias("total"))


def program_results(spark: SparkSession, folder: str) -> DataFrame:
    """scan, program, answer, score, items: for each order and return flag the part of the dearest line, its price and all parts."""
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("scan"), F.col("l_returnflag").alias("program"))
    return rows.agg((F.max(F.struct("l_extendedprice", "l_partkey"))["l_partkey"] % 50).alias("answer"), F.max("l_extendedprice").alias("score"), F.array_sort(F.collect_set("l_partkey")).alias("items"))


def part_supplier_edges(spark: SparkSession, folder: str) -> DataFrame:
    """src (part), dst (-1 - supplier): who supplies what."""
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).distinct()


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst: consecutive parts of orders, from the smaller to the greater key: an acyclic graph."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return lines.where("dst > src").select("src", "dst").distinct()
