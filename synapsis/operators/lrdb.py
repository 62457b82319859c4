"""The ligand-receptor knowledge base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import none_if_blank
from ..schema import Database

FACTORS = ("agonist", "antagonist", "co_a_receptor", "co_i_receptor")


def members(wide: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """(name, gene) of a wide table with columns ``prefix``1, ``prefix``_1 and so on; blank names and members are left out."""
    columns = [c for c in wide.columns if c.lower().startswith(prefix.lower())]
    if not columns:
        raise ValueError(f"no column begins with {prefix}")
    long = wide.unpivot([name], columns, "at", "gene")
    return long.select(none_if_blank(F.col(name)).alias("name"), none_if_blank(F.col("gene")).alias("gene")).where("name is not null and gene is not null").distinct()


def cleaned(interaction: DataFrame) -> DataFrame:
    """Interactions with null for every blank name."""
    return interaction.select(*(none_if_blank(F.col(c)).alias(c) if t == "string" else c for c, t in interaction.dtypes))


def signaling_genes(db: Database, genes: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Measured genes that the knowledge base names, as ligand, receptor, subunit or cofactor; ``features`` narrows them."""
    lr = cleaned(db.interaction)
    names = reduce(DataFrame.union, [lr.select(F.col(c).alias("gene")) for c in ("ligand", "receptor")] + [db.complex_member.select("gene"), db.cofactor_member.select("gene")])
    found = genes.select("gene").join(names.where("gene is not null").distinct(), "gene", "left_semi").distinct()
    return found.where(F.col("gene").isin(features)) if features else found


def subset_expression(expression: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` genes; ValueError if there are none to want."""
    if wanted.isEmpty():
        raise ValueError("no measured gene is in the knowledge base")
    return expression.join(wanted.select("gene"), "gene", "left_semi")
