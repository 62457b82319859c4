"""Synthetic datasets for benchmarks, generated on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INTERACTION, MEMBER, Database, Dataset


def structured(spark: SparkSession, n_cells: int, n_types: int = 14, n_genes: int = 3000, seed: int = 42, density: float = 0.1) -> Dataset:
    """Counts of at least two in a share of the genes, a block of which each type has more of."""
    cells = spark.range(n_cells).select(F.col("id").alias("cell_id"), (F.col("id") % n_types).alias("t"))
    labels = cells.select("cell_id", F.format_string("CT%02d", "t").alias("group_name"))
    genes = spark.range(n_genes).select(F.concat(F.lit("GENE"), "id").alias("gene"))
    per_cell = int(n_genes * density)
    picks = cells.select("cell_id", "t", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))).alias("k"))
    h = F.pmod(F.xxhash64("cell_id", "k", F.lit(seed)), F.lit(n_genes))
    block = n_genes // n_types
    own = F.col("g").between(F.col("t") * block, F.col("t") * block + block - 1)
    value = 2 + F.floor(-F.log(1 - F.rand(seed)) * F.when(own, 3.0).otherwise(1.0))
    rows = picks.select("cell_id", "t", h.alias("g")).distinct().select("cell_id", F.concat(F.lit("GENE"), "g").alias("gene"), value.cast("double").alias("value"))
    return Dataset(rows, labels, genes)


def spatial(spark: SparkSession, n_cells: int, n_types: int = 14, seed: int = 42) -> DataFrame:
    """(cell_id, x, y): each type around its place on a grid of 250 microns, 50 microns wide."""
    side = int(n_types**0.5 + 0.999)
    t = F.col("id") % n_types
    return spark.range(n_cells).select(F.col("id").alias("cell_id"), ((t % side) * 250 + F.randn(seed) * 50).alias("x"), (F.floor(t / side) * 250 + F.randn(seed + 1) * 50).alias("y"))


def pairs(spark: SparkSession, n_pairs: int, n_genes: int = 3000, seed: int = 42) -> Database:
    """A knowledge base of single genes: a ligand and a receptor for each pair, fifty pairs a pathway."""
    pick = lambda side: F.concat(F.lit("GENE"), F.pmod(F.xxhash64("id", F.lit(side), F.lit(seed)), F.lit(n_genes)))
    blank = {c: F.lit(None).cast("string") for c in ("agonist", "antagonist", "co_a_receptor", "co_i_receptor", "interaction_type")}
    rows = spark.range(n_pairs).select(
        F.col("id").cast("int").alias("lr_id"), F.concat(F.lit("LR"), "id").alias("interaction_name"), F.concat(F.lit("P"), F.floor(F.col("id") / 50)).alias("pathway_name"),
        pick("ligand").alias("ligand"), pick("receptor").alias("receptor"), *(v.alias(c) for c, v in blank.items()),
    )
    none = spark.createDataFrame([], MEMBER)
    return Database(rows.select(*INTERACTION.names), none, none)
