"""Normalisation, scaling, and genes that groups over-express."""

from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_normalized
from .aggregate import gene_moments, group_counts, library_size, zero_inflated


def normalize(expression: DataFrame, scale: float = 1e4, log: bool = True) -> DataFrame:
    """Values over their cell's sum (one if that is zero), times ``scale``; log(1 + x) unless told not to."""
    return expression.join(library_size(expression), "cell_id").select("cell_id", "gene", log_normalized(F.col("value"), F.col("library"), scale, log).alias("value"))


def scale(expression: DataFrame, cells: DataFrame, genes: DataFrame, center: bool = True) -> DataFrame:
    """Values over their gene's deviation, less its mean if ``center``: then a row for every cell and gene, as zeros move too."""
    m = gene_moments(expression, cells, genes)
    if not center:
        return expression.join(m, "gene").select("cell_id", "gene", (F.col("value") / F.col("sd")).alias("value"))
    grid = cells.select("cell_id").join(m)
    return grid.join(expression, ["cell_id", "gene"], "left").select("cell_id", "gene", ((F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.col("sd")).alias("value"))


def rank_sums(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, group_name, n1, n, rank_sum, z): Wilcoxon's rank sum of a group against all other cells, ties averaged.

    Zeros are one row with their count, so a gene's ranks come from its distinct values.
    """
    rows = zero_inflated(expression, cells, genes)
    values = rows.groupBy("gene", "value").agg(F.sum("freq").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranks = values.select("gene", "value", (upto - F.col("k") + (F.col("k") + 1) / 2).alias("rank"))
    sums = rows.join(ranks, ["gene", "value"]).groupBy("gene", "group_name").agg(F.sum(F.col("rank") * F.col("freq")).alias("rank_sum"), F.sum("freq").alias("n1"))
    out = sums.withColumn("n", F.sum("n1").over(Window.partitionBy("gene")))
    n2 = F.col("n") - F.col("n1")
    spread = F.sqrt(F.col("n1") * n2 * (F.col("n") + 1) / F.lit(12.0))
    return out.select("gene", "group_name", "n1", "n", "rank_sum", F.when(spread == 0, 0.0).otherwise((F.col("rank_sum") - F.col("n1") * (F.col("n") + 1) / 2) / F.when(spread == 0, 1.0).otherwise(spread)).alias("z"))


def adjust_bh(tests: DataFrame, p: str = "p", out: str = "p_adj") -> DataFrame:
    """Benjamini and Hochberg over all rows. Only the distinct p-values are ranked, pre-aggregated before the one ordered pass."""
    levels = tests.groupBy(p).agg(F.count("*").alias("__k"))
    upto = F.sum("__k").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    ranked = levels.withColumn("__rank", upto).withColumn("__m", F.sum("__k").over(Window.partitionBy(F.lit(0))))
    adjusted = F.min(F.least(F.lit(1.0), F.col(p) * F.col("__m") / F.col("__rank"))).over(Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    return tests.join(ranked.select(p, adjusted.alias(out)), p)


def two_sided(z: str) -> Column:
    """Two-sided p of a normal deviate; SQL has no error function, so an Arrow batch at a time."""

    def of(values: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((erfc(abs(x) / 2**0.5) for x in values), float, len(values)))

    return F.pandas_udf(of, "double")(z)


def over_expressed(expression: DataFrame, cells: DataFrame, genes: DataFrame, thresh_p: float = 0.05, thresh_pct: float = 0.0, thresh_fc: float = 0.0, min_cells: int = 10) -> DataFrame:
    """(gene, cluster, logfc, pct_1, pct_2, pval, p_val_adj) of genes that a group has more of than the other cells.

    logfc is the difference of means. Groups under ``min_cells`` and genes without spread are not tested. The filter
    goes by p, positive logfc of at least ``thresh_fc``, and the larger share of cells with the gene.
    """
    rows = zero_inflated(expression, cells, genes)
    each = rows.groupBy("gene", "group_name").agg(F.sum(F.col("value") * F.col("freq")).alias("s"), F.sum(F.when(F.col("value") > 0, F.col("freq")).otherwise(0)).alias("k"), F.sum("freq").alias("n1"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = Window.partitionBy("gene")
    each = each.withColumn("s_all", F.sum("s").over(w)).withColumn("k_all", F.sum("k").over(w)).withColumn("n_all", F.sum("n1").over(w)).withColumn("spread", F.min("lo").over(w) < F.max("hi").over(w))
    n2 = F.greatest(F.col("n_all") - F.col("n1"), F.lit(1))
    stats = each.where((F.col("n1") >= min_cells) & F.col("spread")).select("gene", "group_name", (F.col("s") / F.col("n1") - (F.col("s_all") - F.col("s")) / n2).alias("logfc"), (100.0 * F.col("k") / F.col("n1")).alias("pct_1"), (100.0 * (F.col("k_all") - F.col("k")) / n2).alias("pct_2"))
    tests = stats.join(rank_sums(expression, cells, genes).select("gene", "group_name", "z"), ["gene", "group_name"]).withColumn("pval", two_sided("z"))
    out = adjust_bh(tests, "pval", "p_val_adj")
    kept = out.where((F.col("pval") < thresh_p) & (F.col("logfc") > 0) & (F.abs("logfc") >= thresh_fc) & (F.greatest("pct_1", "pct_2") > thresh_pct * 100))
    return kept.select("gene", F.col("group_name").alias("cluster"), "logfc", "pct_1", "pct_2", "pval", "p_val_adj").orderBy("cluster", "pval", "gene")


__all__ = ["adjust_bh", "group_counts", "normalize", "over_expressed", "rank_sums", "scale", "two_sided"]
