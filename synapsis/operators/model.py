"""Communication scores of group pairs: P = Hill(L R coA coI) * spatial * agonist * antagonist * population.

All of it happens on group averages: ``avgs(keys.., gene, group_name, avg)``, whose rows are genes x groups (x keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hill, hill_inverse
from ..schema import Database, Params
from .aggregate import group_counts
from .lrdb import cleaned

FLOOR = 1e-10


def _keys(avgs: DataFrame) -> list[str]:
    return [c for c in avgs.columns if c not in ("gene", "avg")]  # group_name among them


def expr_names(names: DataFrame, avgs: DataFrame, complex_member: DataFrame) -> DataFrame:
    """(name, keys.., group_name, expr) of each name that is a measured gene, or a complex with measured subunits.

    A gene goes before a complex of its name. A complex has the geometric mean of its measured subunits, each at
    least 1e-10. Names that are neither are absent: zero.
    """
    keys = _keys(avgs)
    single = names.join(avgs, names.name == avgs.gene).select("name", *keys, F.col("avg").alias("expr"))
    rest = names.join(avgs.select("gene").distinct(), F.col("name") == F.col("gene"), "left_anti")
    units = rest.join(complex_member.distinct(), "name").join(avgs, "gene")
    whole = units.groupBy("name", *keys).agg(F.exp(F.avg(F.ln(F.greatest("avg", F.lit(FLOOR))))).alias("expr"))
    return single.unionByName(whole)


def factor(avgs: DataFrame, cofactor_member: DataFrame, names: DataFrame, of) -> DataFrame:
    """(name, keys.., group_name, f): the product of ``of(avg)`` over a cofactor's measured genes; absent means one."""
    keys = _keys(avgs)
    rows = names.join(cofactor_member.distinct(), "name").join(avgs, "gene")
    return rows.groupBy("name", *keys).agg(F.exp(F.sum(F.ln(of(F.col("avg"))))).alias("f"))


def coreceptor(avgs: DataFrame, cofactor_member: DataFrame, names: DataFrame, activating: bool = True) -> DataFrame:
    """prod(1 + expr), or its inverse for inhibiting ones."""
    out = factor(avgs, cofactor_member, names, lambda x: 1 + x)
    return out if activating else out.withColumn("f", 1 / F.col("f"))


def agonist(avgs: DataFrame, cofactor_member: DataFrame, names: DataFrame, p: Params = Params()) -> DataFrame:
    return factor(avgs, cofactor_member, names, lambda x: 1 + hill(x, p.kh, p.n))


def antagonist(avgs: DataFrame, cofactor_member: DataFrame, names: DataFrame, p: Params = Params()) -> DataFrame:
    return factor(avgs, cofactor_member, names, lambda x: hill_inverse(x, p.kh, p.n))


def distinct_names(lr: DataFrame, column: str) -> DataFrame:
    return lr.select(F.col(column).alias("name")).where("name is not null").distinct()


def lr_expression(avgs: DataFrame, db: Database, p: Params = Params()) -> DataFrame:
    """(lr_id, keys.., group_name, l, r, ago, anta): the sides of every pair in every group; r has its coreceptors' factors.

    Each distinct name is worked out once; pairs then look it up.
    """
    lr, keys = cleaned(db.interaction), _keys(avgs)
    groups = avgs.select(*keys).distinct()
    out = lr.select("lr_id", "ligand", "receptor", "agonist", "antagonist", "co_a_receptor", "co_i_receptor").join(groups)
    both = distinct_names(lr, "ligand").union(distinct_names(lr, "receptor")).distinct()
    names = expr_names(both, avgs, db.complex_member)

    def look(frame: DataFrame, table: DataFrame, column: str, value: str, name: str, default: float) -> DataFrame:
        side = table.select(F.col("name").alias(column), *keys, F.col(value).alias(name))
        return frame.join(side, [column, *keys], "left").withColumn(name, F.coalesce(name, F.lit(default)))

    out = look(out, names, "ligand", "expr", "l", 0.0)
    out = look(out, names, "receptor", "expr", "r0", 0.0)
    cof = db.cofactor_member
    out = look(out, coreceptor(avgs, cof, distinct_names(lr, "co_a_receptor")), "co_a_receptor", "f", "co_a", 1.0)
    out = look(out, coreceptor(avgs, cof, distinct_names(lr, "co_i_receptor"), False), "co_i_receptor", "f", "co_i", 1.0)
    out = look(out, agonist(avgs, cof, distinct_names(lr, "agonist"), p), "agonist", "f", "ago", 1.0)
    out = look(out, antagonist(avgs, cof, distinct_names(lr, "antagonist"), p), "antagonist", "f", "anta", 1.0)
    return out.select("lr_id", *keys, "l", (F.col("r0") * F.col("co_a") * F.col("co_i")).alias("r"), "ago", "anta")


def probability(sides: DataFrame, p: Params = Params(), population: DataFrame | None = None, p_spatial: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(keys.., source, target, lr_id, prob) for all pairs of groups.

    ``population(group_name, share)`` and ``p_spatial(source, target, p)`` are further factors. ``digits`` rounds, so
    that scores which are equal on paper tie in a permutation test.
    """
    keys = [c for c in sides.columns if c not in ("lr_id", "group_name", "l", "r", "ago", "anta")]
    a = sides.select("lr_id", *keys, F.col("group_name").alias("source"), "l", F.col("ago").alias("ago_i"), F.col("anta").alias("anta_i"))
    b = sides.select("lr_id", *keys, F.col("group_name").alias("target"), "r", F.col("ago").alias("ago_j"), F.col("anta").alias("anta_j"))
    out = a.join(b, ["lr_id", *keys])
    prob: Column = hill(F.col("l") * F.col("r"), p.kh, p.n) * (F.col("ago_i") * F.col("ago_j")) * (F.col("anta_i") * F.col("anta_j"))
    if population is not None:
        out = out.join(population.select(F.col("group_name").alias("source"), F.col("share").alias("share_i")), "source").join(population.select(F.col("group_name").alias("target"), F.col("share").alias("share_j")), "target")
        prob = prob * F.col("share_i") * F.col("share_j")
    if p_spatial is not None:
        out = out.join(p_spatial.select("source", "target", "p"), ["source", "target"], "left")
        prob = prob * F.coalesce("p", F.lit(0.0))
    return out.select(*keys, "source", "target", "lr_id", (F.round(prob, digits) if digits else prob).alias("prob"))


def population_shares(cells: DataFrame) -> DataFrame:
    """(group_name, share): cells of a group over all labelled cells."""
    n = group_counts(cells.select("cell_id", "group_name"))
    return n.join(n.agg(F.sum("n").alias("total"))).select("group_name", (F.col("n") / F.col("total")).alias("share"))
