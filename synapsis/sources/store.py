"""Reading knowledge bases and datasets, writing and reading results."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network
from ..operators.lrdb import members
from ..schema import CELLS, COORDS, EXPRESSION, GENES, INTERACTION, Database, Dataset, check

SPECIES = ("human", "mouse", "zebrafish")
PARTS = ("interaction", "complex", "cofactor", "geneInfo")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_database(spark: SparkSession, root: str, species: str = "human") -> Database:
    """The knowledge base of a species: interaction, complex, cofactor and geneInfo tables as Parquet below ``root``.

    FileNotFoundError if the species' folder or one of the four is missing. Wide complex and cofactor tables are
    unpivoted; interactions without ids are numbered by name.
    """
    folder = f"{root}/{species.lower()}"
    for p in ("", *(f"/{n}.parquet" for n in PARTS)):
        if not _exists(spark, folder + p):
            raise FileNotFoundError(folder + p)
    wide = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in PARTS}
    lr = wide["interaction"]
    rename = {"co_A_receptor": "co_a_receptor", "co_I_receptor": "co_i_receptor"}
    lr = lr.withColumnsRenamed({a: b for a, b in rename.items() if a in lr.columns})
    lr = lr.withColumns({c: F.lit(None).cast("string") for c in ("interaction_type",) if c not in lr.columns})
    if "lr_id" not in lr.columns:
        from pyspark.sql import Window

        lr = lr.withColumn("lr_id", F.row_number().over(Window.orderBy("interaction_name")))
    return Database(check(lr, INTERACTION, "interaction"), members(wide["complex"], "subunit"), members(wide["cofactor"], "cofactor"))


def from_long(expression: DataFrame, cells: DataFrame, genes: DataFrame | None = None, coords: DataFrame | None = None) -> Dataset:
    """A dataset of long tables, their columns checked. Genes are those with values unless given."""
    expression = check(expression, EXPRESSION, "expression").where("value != 0")
    genes = check(genes, GENES, "genes") if genes is not None else expression.select("gene").distinct()
    return Dataset(expression, check(cells, CELLS, "cells"), genes, None if coords is None else check(coords, COORDS, "coords"))


def from_wide(wide: DataFrame, group_by: str, cell_id: str = "cell_id", spatial: tuple[str, str] | None = None) -> Dataset:
    """A dataset of one row a cell and one column a gene; ``spatial`` names the coordinates, which make it spatial."""
    for c in (group_by, cell_id, *(spatial or ())):
        if c not in wide.columns:
            raise ValueError(f"no column {c}; there are {wide.columns}")
    genes = [c for c in wide.columns if c not in (group_by, cell_id, *(spatial or ()))]
    long = wide.select(F.col(cell_id).alias("cell_id"), *(F.col(g).cast("double").alias(g) for g in genes)).unpivot(["cell_id"], genes, "gene", "value").where("value is not null")
    names = wide.sparkSession.createDataFrame([(g,) for g in genes], GENES)
    at = wide.select(F.col(cell_id).alias("cell_id"), F.col(spatial[0]).alias("x"), F.col(spatial[1]).alias("y")) if spatial else None
    return from_long(long, wide.select(F.col(cell_id).alias("cell_id"), F.col(group_by).alias("group_name")), names, at)


def save(path: str, net: DataFrame, lr: DataFrame, cells: DataFrame, options: dict | None = None, thresh: float = 0.05) -> None:
    """net and its roll-ups as Parquet, and as CSV net_count, net_weight, pathway_summary and lr_pairs, with summary.json."""
    spark, agg = net.sparkSession, network.aggregate_net(net, thresh)
    netp = network.pathway_network(net, lr, thresh)
    groups = cells.where("group_name is not null").select("group_name").distinct()
    for name, df in {"net": net, "netp": netp, "net_agg": agg, "interaction": lr}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    names = [r[0] for r in groups.orderBy("group_name").collect()]  # one column each
    summary = network.pathway_summary(netp, groups).orderBy(F.desc("total"), "pathway")
    csv = {"net_count.csv": network.heatmap(agg, "n", names), "net_weight.csv": network.heatmap(agg, "weight", names), "pathway_summary.csv": summary, "lr_pairs.csv": lr}
    for name, df in csv.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    counts = agg.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    text = json.dumps({"groups": names, "n_interactions": counts["n"], "total_weight": counts["w"], "n_pathways": netp.select("pathway").distinct().count(), "options": options or {}, "saved": datetime.now(timezone.utc).isoformat()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary.json")


def load(spark: SparkSession, path: str) -> dict:
    """What `save` wrote and is still there: DataFrames by name, and the summary."""
    out = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in ("net", "netp", "net_agg", "interaction") if _exists(spark, f"{path}/{n}.parquet")}
    out |= {n: spark.read.option("header", True).csv(f"{path}/{n}.csv") for n in ("net_count", "net_weight", "pathway_summary", "lr_pairs") if _exists(spark, f"{path}/{n}.csv")}
    if _exists(spark, f"{path}/summary.json"):
        out["summary"] = json.loads(spark.read.text(f"{path}/summary.json").first()[0])
    return out
