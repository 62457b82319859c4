"""Roll-ups, filters, ranks, enrichment and comparison of networks, and the tables that figures are drawn from.

``net`` is (source, target, lr_id, prob, pval); ``lr`` the interactions; ``netp`` (source, target, pathway, prob).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe_ratio
from .lrdb import cleaned


def everything():
    """All rows, for results that have a row for each pair of groups or pathway only."""
    return Window.partitionBy(F.lit(0))



def significant(net: DataFrame, thresh: float = 0.05) -> DataFrame:
    """Probabilities over the threshold's p become zero."""
    return net.withColumn("prob", F.when(F.col("pval") > thresh, 0.0).otherwise(F.col("prob")))


def with_pathway(net: DataFrame, lr: DataFrame) -> DataFrame:
    return net.join(cleaned(lr).select("lr_id", F.col("pathway_name").alias("pathway")), "lr_id")


def pathway_network(net: DataFrame, lr: DataFrame, thresh: float = 0.05) -> DataFrame:
    """netp with rank: significant probabilities summed over a pathway's pairs; pathways without any go; rank by total, then name."""
    each = with_pathway(significant(net, thresh), lr).groupBy("source", "target", "pathway").agg(F.sum("prob").alias("prob"))
    total = F.sum("prob").over(Window.partitionBy("pathway"))
    some = each.withColumn("total", total).where("total > 0")
    return some.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("total"), "pathway")).cast("bigint")).drop("total")


def aggregate_net(net: DataFrame, thresh: float = 0.05) -> DataFrame:
    """(source, target, n, weight): pairs with prob > 0 and p < thresh, and the summed prob with p <= thresh."""
    return net.groupBy("source", "target").agg(F.count_if((F.col("prob") > 0) & (F.col("pval") < thresh)).alias("n"), F.sum(F.when(F.col("pval") <= thresh, F.col("prob")).otherwise(0.0)).alias("weight"))


def filter_communication(net: DataFrame, sizes: DataFrame, min_cells: int = 10, min_links: int = 1) -> DataFrame:
    """prob 0 and p 1 where a group has too few cells, then where a pair of groups has too few pairs at p < 0.05."""
    side = lambda c: sizes.select(F.col("group_name").alias(c), F.col("n").alias(f"n_{c}"))
    small = (F.coalesce("n_source", F.lit(0)) < min_cells) | (F.coalesce("n_target", F.lit(0)) < min_cells)
    out = net.join(side("source"), "source", "left").join(side("target"), "target", "left").withColumn("bad", small)
    out = out.withColumn("prob", F.when(F.col("bad"), 0.0).otherwise(F.col("prob"))).withColumn("pval", F.when(F.col("bad"), 1.0).otherwise(F.col("pval")))
    links = F.sum(F.when(F.col("pval") < 0.05, 1).otherwise(0)).over(Window.partitionBy("source", "target"))
    few = F.col("links") < min_links
    out = out.withColumn("links", links)
    return out.select("source", "target", "lr_id", F.when(few, 0.0).otherwise(F.col("prob")).alias("prob"), F.when(few, 1.0).otherwise(F.col("pval")).alias("pval"))


def subset_communication(net: DataFrame, lr: DataFrame, sources: list[str] | None = None, targets: list[str] | None = None, pathways: list[str] | None = None) -> DataFrame:
    """Rows of net with their interaction, of the named sources, targets and pathways (all by default)."""
    out = net.join(cleaned(lr).select("lr_id", "interaction_name", F.col("pathway_name").alias("pathway"), "ligand", "receptor"), "lr_id")
    for column, wanted in (("source", sources), ("target", targets), ("pathway", pathways)):
        if wanted:
            out = out.where(F.col(column).isin(wanted))
    return out


def lift(netp: DataFrame, groups: DataFrame) -> DataFrame:
    """netp on all pairs of ``groups(group_name)``; pairs that it lacks have zero."""
    a, b = groups.select(F.col("group_name").alias("source")).distinct(), groups.select(F.col("group_name").alias("target")).distinct()
    grid = a.join(b).join(netp.select("pathway").distinct())
    return grid.join(netp.select("source", "target", "pathway", "prob"), ["source", "target", "pathway"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def rank_net(netp: DataFrame) -> DataFrame:
    """(pathway, total, rank), positive totals only."""
    total = netp.groupBy("pathway").agg(F.sum("prob").alias("total")).where("total > 0")
    return total.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "pathway")).cast("bigint"))


def rank_similarity(similarity: DataFrame) -> DataFrame:
    """(pathway, mean_sim, rank): mean of a pathway's row, itself included."""
    mean = similarity.groupBy(F.col("pathway_a").alias("pathway")).agg(F.avg("sim").alias("mean_sim"))
    return mean.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("mean_sim", 12)), "pathway")).cast("bigint"))


def merge(tables: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """The tables, one after another, with their dataset's name."""
    names = names or [f"dataset{i}" for i in range(len(tables))]
    if len(names) != len(tables):
        raise ValueError(f"{len(tables)} tables have {len(names)} names")
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("dataset"), "*") for t, n in zip(tables, names)])


def compare(merged: DataFrame, first: str, second: str, measure: str = "weight") -> DataFrame:
    """(source, target, a, b, difference) of a measure in two datasets of merged `aggregate_net`s; absent pairs count as zero."""
    of = lambda name, c: merged.where(F.col("dataset") == name).select("source", "target", F.col(measure).alias(c))
    out = of(first, "a").join(of(second, "b"), ["source", "target"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return out.select("source", "target", a.alias("a"), b.alias("b"), (b - a).alias("difference"))


def map_deg(lr: DataFrame, deg: DataFrame) -> DataFrame:
    """(pathway, n, genes): differential genes that are a ligand or receptor of the pathway."""
    names = cleaned(lr).select(F.col("pathway_name").alias("pathway"), F.explode(F.array("ligand", "receptor")).alias("gene")).where("gene is not null")
    hits = names.join(deg.select("gene").distinct(), "gene", "left_semi")
    return hits.groupBy("pathway").agg(F.countDistinct("gene").alias("n"), F.array_join(F.sort_array(F.collect_set("gene")), ",").alias("genes"))


def enrichment_score(netp: DataFrame, groups: DataFrame) -> DataFrame:
    """(pathway, score): the largest row or column sum over the mean one; zero without any communication."""
    k = groups.select("group_name").distinct().agg(F.count("*").alias("k"))
    total = netp.groupBy("pathway").agg(F.sum("prob").alias("total"))
    side = lambda c: netp.groupBy("pathway", c).agg(F.sum("prob").alias("s"))
    top = side("source").select("pathway", "s").unionByName(side("target").select("pathway", "s")).groupBy("pathway").agg(F.max("s").alias("top"))
    return total.join(top, "pathway").join(k).select("pathway", safe_ratio(F.col("top"), F.col("total") / (2 * F.col("k"))).alias("score"))


def enriched_lr(net: DataFrame, lr: DataFrame, pathway: str, thresh: float = 0.05) -> DataFrame:
    return subset_communication(net, lr, pathways=[pathway]).where(F.col("pval") < thresh)


def enriched_signaling(net: DataFrame, lr: DataFrame, thresh: float = 0.05) -> DataFrame:
    return with_pathway(net, lr).where(F.col("pval") < thresh).select("pathway").distinct()


def pathway_summary(netp: DataFrame, groups: DataFrame) -> DataFrame:
    """(pathway, total, mean, max): over all pairs of groups, those without communication included."""
    k = groups.select("group_name").distinct().agg(F.count("*").alias("k"))
    out = netp.groupBy("pathway").agg(F.sum("prob").alias("total"), F.greatest(F.max("prob"), F.lit(0.0)).alias("max")).join(k)
    return out.select("pathway", "total", (F.col("total") / (F.col("k") * F.col("k"))).alias("mean"), "max")


# Figures: the tables behind them.


def heatmap(agg: DataFrame, measure: str = "weight", groups: list[str] | None = None) -> DataFrame:
    """One row a source, one column a target; absent pairs are zero."""
    return agg.groupBy("source").pivot("target", groups).agg(F.sum(measure)).na.fill(0)


def bubble(net: DataFrame, lr: DataFrame, thresh: float = 0.05) -> DataFrame:
    """(pathway, pair, prob, pval, size, colour) of significant pathways and group pairs: mean prob, least p."""
    each = with_pathway(net, lr).groupBy("pathway", "source", "target").agg(F.avg("prob").alias("prob"), F.min("pval").alias("pval")).where((F.col("pval") < thresh) & (F.col("prob") > 0))
    return each.select("pathway", F.concat("source", F.lit(" -> "), "target").alias("pair"), "prob", "pval", (F.col("prob") / F.max("prob").over(everything()) * 300 + 20).alias("size"), (-F.log10(F.col("pval") + 1e-300)).alias("colour"))


def top_pathways(net: DataFrame, lr: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` pathways of largest unfiltered total."""
    return with_pathway(net, lr).groupBy("pathway").agg(F.sum("prob").alias("total")).orderBy(F.desc("total"), "pathway").limit(n)


def bars(merged: DataFrame, measure: str = "weight") -> DataFrame:
    return merged.groupBy("dataset").agg(F.sum(measure).alias("total"))


def _totals(agg: DataFrame, measure: str) -> DataFrame:
    ends = agg.select(F.col("source").alias("node"), F.col(measure).alias("out_sum"), F.lit(0.0).alias("in_sum")).union(agg.select("target", F.lit(0.0), F.col(measure)))
    return ends.groupBy("node").agg(F.sum("out_sum").alias("out_sum"), F.sum("in_sum").alias("in_sum"))


def circle_nodes(agg: DataFrame, measure: str = "weight") -> DataFrame:
    """(node, total, size): in and out, sized 0.5 to 2."""
    t = _totals(agg, measure).withColumn("total", F.col("out_sum") + F.col("in_sum"))
    return t.select("node", "total", (0.5 + 1.5 * safe_ratio(F.col("total"), F.max("total").over(everything()))).alias("size"))


def circle_edges(agg: DataFrame, measure: str = "weight") -> DataFrame:
    """(source, target, weight, width) of edges between different groups."""
    e = agg.select("source", "target", F.col(measure).alias("weight"), F.max(measure).over(everything()).alias("top"))
    return e.where("source != target and weight > 0").select("source", "target", "weight", (0.5 + 4 * F.col("weight") / F.col("top")).alias("width"))


def chord(agg: DataFrame, measure: str = "weight") -> DataFrame:
    """(source, target, weight, out_share, in_share, arc): shares of the ends' sums, and the source's arc of the circle."""
    w = agg.select("source", "target", F.col(measure).alias("weight"))
    t = _totals(agg, measure).withColumn("arc", safe_ratio(F.col("out_sum") + F.col("in_sum"), F.sum(F.col("out_sum") + F.col("in_sum")).over(everything())))
    out = w.withColumn("row", F.sum("weight").over(Window.partitionBy("source"))).withColumn("col", F.sum("weight").over(Window.partitionBy("target"))).where("weight > 0")
    return out.join(t.select(F.col("node").alias("source"), "arc"), "source").select("source", "target", "weight", (F.col("weight") / F.col("row")).alias("out_share"), (F.col("weight") / F.col("col")).alias("in_share"), "arc")


def hierarchy(agg: DataFrame, measure: str = "weight") -> DataFrame:
    """(node, out_size, in_size): sums of either side over the largest of that side."""
    t = _totals(agg, measure)
    return t.select("node", safe_ratio(F.col("out_sum"), F.max("out_sum").over(everything())).alias("out_size"), safe_ratio(F.col("in_sum"), F.max("in_sum").over(everything())).alias("in_size"))


def pathway_matrix(net: DataFrame, lr: DataFrame, pathway: str) -> DataFrame:
    """(source, target, prob): a pathway's sum, whatever its p."""
    return with_pathway(net, lr).where(F.col("pathway") == pathway).groupBy("source", "target").agg(F.sum("prob").alias("prob"))


def contribution(net: DataFrame, lr: DataFrame) -> DataFrame:
    """(pathway, interaction_name, total, share, rank) of every pair in its pathway."""
    t = subset_communication(net, lr).groupBy("pathway", "interaction_name").agg(F.sum("prob").alias("total"))
    w = Window.partitionBy("pathway")
    return t.withColumn("share", safe_ratio(F.col("total"), F.sum("total").over(w))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("total"), "interaction_name")).cast("bigint"))


def river(pattern_w: DataFrame, pattern_h: DataFrame, least: float = 0.01) -> DataFrame:
    """(side, pattern, name, weight) of the links of a pattern to groups and pathways over ``least``."""
    a = pattern_w.select(F.lit("group").alias("side"), "pattern", F.col("group_name").alias("name"), "weight")
    return a.union(pattern_h.select(F.lit("pathway"), "pattern", "pathway", "weight")).where(F.col("weight") > least)


def pattern_input(netp: DataFrame, outgoing: bool = True) -> DataFrame:
    """(group_name, pathway, total, value): sums of one side, and over each pathway's largest; groups without any are left out."""
    side = "source" if outgoing else "target"
    t = netp.groupBy(F.col(side).alias("group_name"), "pathway").agg(F.sum("prob").alias("total"))
    top = F.max("total").over(Window.partitionBy("pathway"))
    out = t.withColumn("value", F.when(top == 0, 0.0).otherwise(F.col("total") / top))
    return out.withColumn("any", F.sum("value").over(Window.partitionBy("group_name"))).where("any > 0").drop("any")
