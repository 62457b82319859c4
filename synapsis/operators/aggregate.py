"""Aggregates of zero-inflated values: n comes from the cells of a group, not from the rows that are there.

Any further columns of ``cells`` (a permutation's number, say) are keys of the result as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MeanMethod


def extra_keys(cells: DataFrame) -> list[str]:
    return [c for c in cells.columns if c not in ("cell_id", "group_name")]


def group_counts(cells: DataFrame) -> DataFrame:
    """(keys.., group_name, n): cells of each group; cells without a label are left out."""
    return cells.where("group_name is not null").groupBy(*extra_keys(cells), "group_name").agg(F.count("*").alias("n"))


def zero_inflated(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(keys.., gene, group_name, value, freq): the values there are, and one row for all zeros of a gene in a group."""
    keys = [*extra_keys(cells), "gene", "group_name"]
    # both branches below filter by value, so that Spark reuses the exchange under an expression that is itself a sum
    there = expression.where("value != 0").join(cells.where("group_name is not null"), "cell_id").select(*keys, "value", F.lit(1).cast("bigint").alias("freq"))
    sizes = group_counts(cells)
    # sizes at zero, less the values there are: one partial aggregation instead of a join with counts of its own
    grid = genes.select("gene").distinct().join(sizes).select(*keys, F.col("n").alias("freq"))
    zeros = grid.unionByName(there.select(*keys, (-F.col("freq")).alias("freq"))).groupBy(*keys).agg(F.sum("freq").alias("freq")).where("freq > 0")
    return there.unionByName(zeros.withColumn("value", F.lit(0.0)))


def group_aggregate(expression: DataFrame, cells: DataFrame, genes: DataFrame, method: MeanMethod = MeanMethod.TRI_MEAN, trim: float = 0.1) -> DataFrame:
    """(keys.., gene, group_name, avg) for every gene and group, zeros included."""
    rows, method = zero_inflated(expression, cells, genes), MeanMethod(method)
    keys = [*extra_keys(cells), "gene", "group_name"]
    if method in (MeanMethod.TRI_MEAN, MeanMethod.MEDIAN):
        q = quantiles(rows, keys, (0.25, 0.5, 0.75) if method is MeanMethod.TRI_MEAN else (0.5,))
        return q.select(*keys, ((F.col("q0") + 2 * F.col("q1") + F.col("q2")) / 4 if method is MeanMethod.TRI_MEAN else F.col("q0")).alias("avg"))
    n, total = F.sum("freq"), F.sum(F.col("value") * F.col("freq"))
    if method is MeanMethod.MEAN:
        return rows.groupBy(*keys).agg((total / n).alias("avg"))
    if method is MeanMethod.THRESHOLDED:
        nonzero = F.sum(F.when(F.col("value") != 0, F.col("freq")).otherwise(0))
        return rows.groupBy(*keys).agg(F.when(nonzero / n >= trim, total / n).otherwise(0.0).alias("avg"))
    return truncated_mean(rows, keys, trim)


def quantiles(rows: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """(keys.., q0, q1, ..): interpolated quantiles of (value, freq). Running sums over a sort, which spills, instead of
    a buffer of all distinct values."""
    group = Window.partitionBy(*keys)
    upto = F.sum("freq").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("upto", upto).withColumn("n", F.sum("freq").over(group))
    out = []
    for i, f in enumerate(at):
        h = F.lit(f) * (F.col("n") - 1)
        low = F.floor(h)
        first = F.min(F.when(F.col("upto") > low, F.col("value")))
        second = F.min(F.when(F.col("upto") > F.least(low + 1, F.col("n") - 1), F.col("value")))
        part = F.first(h - low)
        out.append(((1 - part) * first + part * second).alias(f"q{i}"))
    return ranked.groupBy(*keys).agg(*out)


def truncated_mean(rows: DataFrame, keys: list[str], trim: float) -> DataFrame:
    """Mean between the ranks that ``trim`` of the values at either end leave; the middle value if it leaves none."""
    group = Window.partitionBy(*keys)
    upto = F.sum("freq").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("upto", upto).withColumn("n", F.sum("freq").over(group)).withColumn("cut", F.floor(F.col("n") * F.lit(trim)))
    low = F.when(F.col("cut") >= F.col("n") - F.col("cut"), F.expr("n div 2")).otherwise(F.col("cut"))
    high = F.when(F.col("cut") >= F.col("n") - F.col("cut"), F.expr("n div 2") + 1).otherwise(F.col("n") - F.col("cut"))
    weight = F.greatest(F.lit(0), F.least("upto", high) - F.greatest(F.col("upto") - F.col("freq"), low))
    weighed = ranked.withColumn("weight", weight)
    return weighed.groupBy(*keys).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("avg"))


def geometric_mean(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(keys.., gene, group_name, avg): exp of the mean logarithm; zero if any value is zero or less."""
    keys = [*extra_keys(cells), "gene", "group_name"]
    safe = F.when(F.col("value") > 0, F.ln("value")).otherwise(0.0) * F.col("freq")
    mean = F.exp(F.sum(safe) / F.sum("freq"))
    return zero_inflated(expression, cells, genes).groupBy(*keys).agg(F.when(F.min("value") <= 0, 0.0).otherwise(mean).alias("avg"))


def global_max(expression: DataFrame) -> float:
    """Largest value; one if there is none above zero. A single number, so that scaling is a literal in the plan."""
    top = expression.agg(F.max("value")).first()[0]
    return float(top) if top and top > 0 else 1.0


def scaled(expression: DataFrame) -> DataFrame:
    """Values over the largest of all: [0, 1]."""
    top = expression.agg(F.greatest(F.max("value"), F.lit(0.0)).alias("top"))
    return expression.join(top).select("cell_id", "gene", F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(F.col("value")).alias("value"))


def library_size(expression: DataFrame) -> DataFrame:
    return expression.groupBy("cell_id").agg(F.sum("value").alias("library"))


def gene_moments(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene, mean, sd): over all cells, zeros included; the population's deviation, one where it is zero."""
    n = cells.agg(F.count("*").alias("n"))
    sums = expression.join(cells.select("cell_id"), "cell_id", "left_semi").groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    all_genes = genes.select("gene").distinct().join(sums, "gene", "left").join(n)
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n")
    var = F.greatest(F.lit(0.0), F.coalesce("ss", F.lit(0.0)) / F.col("n") - mean * mean)
    return all_genes.select("gene", mean.alias("mean"), F.when(F.sqrt(var) == 0, 1.0).otherwise(F.sqrt(var)).alias("sd"))
