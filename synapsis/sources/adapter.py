"""The engine's relations from the driver's tables, and a small knowledge base over their gene names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INTERACTION, MEMBER, Database, Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("group_name"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct()


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity that a customer ordered of a brand."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(part, lines.l_partkey == part.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    return rows.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(expression(spark, sf_dir), cells(spark, sf_dir), genes(spark, sf_dir))


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.concat(F.lit("g"), F.col("label").cast("string")).alias("group_name"))


def spot_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension d of an embedding, where it is positive, is the value of gene Brand#(d - 1), d from 3 to 26."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.posexplode(F.slice("embedding", 3, 24)).alias("d", "v"))
    return e.where("v > 0").select("cell_id", F.concat(F.lit("Brand#"), (F.col("d") + 1).cast("string")).alias("gene"), F.col("v").cast("double").alias("value"))


def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft types of a spot: its positive values in dimensions 31 to 34, over their sum."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spot_id"), F.posexplode(F.slice("embedding", 31, 4)).alias("d", "v")).where("v > 0")
    rows = e.select("spot_id", F.concat(F.lit("t"), F.col("d").cast("string")).alias("type"), F.col("v").cast("double").alias("v"))
    total = rows.groupBy("spot_id").agg(F.sum("v").alias("s"))
    return rows.join(total, "spot_id").select("spot_id", "type", (F.col("v") / F.col("s")).alias("w"))


_B = "Brand#"
#: A knowledge base for tests and benchmarks: single genes, complexes (one of them half measured), names nobody
#: measured, blank and missing cofactors.
LR = [
    (1, "B1_B2", "P1", _B + "1", _B + "2", None, None, None, None, "Secreted Signaling"),
    (2, "B3_B4", "P1", _B + "3", _B + "4", "AGO1", "", None, "", "Secreted Signaling"),
    (3, "B5_CX1", "P1", _B + "5", "CX1", None, "ANT1", "COA1", None, "ECM-Receptor"),
    (4, "CX2_B6", "P2", "CX2", _B + "6", "AGO1", "ANT1", "COA1", "COI1", "Secreted Signaling"),
    (5, "B7_B8", "P2", _B + "7", _B + "8", "", "", "", "", "Cell-Cell Contact"),
    (6, "B9_CX3", "P2", _B + "9", "CX3", None, None, None, "COI1", "Cell-Cell Contact"),
    (7, "NONE_B10", "P3", "UNMEASURED", _B + "10", None, None, None, None, "Secreted Signaling"),
    (8, "B11_B12", "P3", _B + "11", _B + "12", "AGO1", None, None, None, "Secreted Signaling"),
    (9, "B13_B14", "P3", _B + "13", _B + "14", None, None, "COA1", None, "ECM-Receptor"),
    (10, "CX1_CX2", "P4", "CX1", "CX2", None, "ANT1", None, None, "Secreted Signaling"),
    (11, "B15_B15", "P4", _B + "15", _B + "15", None, None, None, None, "Cell-Cell Contact"),
    (12, "B16_GHOST", "P4", _B + "16", "GHOST", None, None, None, None, "Secreted Signaling"),
]
COMPLEXES = [("CX1", _B + "17"), ("CX1", _B + "18"), ("CX2", _B + "19"), ("CX2", "MISSING"), ("CX3", _B + "20"), ("CX3", _B + "21"), ("CX3", _B + "22"), ("GHOST", "MISSING")]
COFACTORS = [("AGO1", _B + "23"), ("AGO1", _B + "24"), ("ANT1", _B + "25"), ("COA1", _B + "1"), ("COA1", "MISSING"), ("COI1", _B + "2"), ("COI1", _B + "3")]


def database(spark: SparkSession) -> Database:
    return Database(spark.createDataFrame(LR, INTERACTION), spark.createDataFrame(COMPLEXES, MEMBER), spark.createDataFrame(COFACTORS, MEMBER))
