"""One query for each operator over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hill, hill_inverse, hill_lut, register
from .operators import aggregate, graph, lrdb, model, network, patterns, permute, preprocess, spatial
from .plans.storage import settle, shared_folder
from .schema import MeanMethod, Params, SpatialParams
from .sources import adapter, store
from .sql import BASE, MODEL, NET, NETP, SPACE, dense_aggregate, with_ctes
from .streaming import group_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NBOOT, SEED = 10, 1
SPACING = SpatialParams(interaction_range=0.05, contact_range=0.01, ratio=1.0, tol=0.0, scale_distance=1.0)


def query(sql: str | None = None, *ctes):
    """Registers a query under its function's name; ``sql`` is its oracle's final SELECT over ``ctes``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_ctes(sql, *ctes)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places; minus zero is zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


_kept: dict[tuple, DataFrame] = {}


def keep(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A small result that many queries begin with, computed once a session and directory."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = settle(make())
    return _kept[key]


def net_of(spark: SparkSession, d: str, p: Params = Params(nboot=NBOOT, seed=SEED)) -> DataFrame:
    return keep(spark, d, f"net-{p}", lambda: permute.commun_prob(adapter.dataset(spark, d), adapter.database(spark), p))


def lr_of(spark: SparkSession) -> DataFrame:
    return adapter.database(spark).interaction


def netp_of(spark: SparkSession, d: str) -> DataFrame:
    return network.pathway_network(net_of(spark, d), lr_of(spark))


def groups_of(spark: SparkSession, d: str) -> DataFrame:
    return adapter.cells(spark, d).select("group_name").distinct()


def avgs_of(spark: SparkSession, d: str) -> DataFrame:
    def make():
        data = adapter.dataset(spark, d)
        return aggregate.group_aggregate(aggregate.scaled(data.expression), data.cells, data.genes)

    return keep(spark, d, "avgs", make)


# Aggregates


def _aggregate(spark, d, method):
    data = adapter.dataset(spark, d)
    return rounded(aggregate.group_aggregate(data.expression, data.cells, data.genes, method), "avg")


@query(dense_aggregate("(quantile_cont(value, 0.25) + 2 * quantile_cont(value, 0.5) + quantile_cont(value, 0.75)) / 4"), *BASE)
def tri_mean(spark, d):
    return _aggregate(spark, d, MeanMethod.TRI_MEAN)


@query(dense_aggregate("quantile_cont(value, 0.5)"), *BASE)
def median(spark, d):
    return _aggregate(spark, d, MeanMethod.MEDIAN)


@query(
    "SELECT gene, group_name, round(avg(value), 6) AS avg FROM (SELECT *, row_number() OVER (PARTITION BY gene, group_name ORDER BY value) AS k, count(*) OVER (PARTITION BY gene, group_name) AS n FROM dense) WHERE k > floor(n * 0.1::DOUBLE) AND k <= n - floor(n * 0.1::DOUBLE) GROUP BY 1, 2",
    *BASE,
)
def truncated_mean(spark, d):
    return _aggregate(spark, d, MeanMethod.TRUNCATED)


@query(dense_aggregate("CASE WHEN count(*) FILTER (value <> 0) / count(*)::DOUBLE >= 0.1 THEN avg(value) ELSE 0 END"), *BASE)
def thresholded_mean(spark, d):
    return _aggregate(spark, d, MeanMethod.THRESHOLDED)


@query(dense_aggregate("avg(value)"), *BASE)
def sparse_mean(spark, d):
    return _aggregate(spark, d, MeanMethod.MEAN)


@query(dense_aggregate("CASE WHEN min(value) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN value > 0 THEN value ELSE 1 END))) END"), *BASE)
def geometric_mean(spark, d):
    data = adapter.dataset(spark, d)
    return rounded(aggregate.geometric_mean(data.expression, data.cells, data.genes), "avg")


@query("SELECT group_name, n FROM sizes", *BASE)
def group_counts(spark, d):
    return aggregate.group_counts(adapter.cells(spark, d))


@query("SELECT cell_id, round(sum(value), 6) AS library FROM expression GROUP BY 1", *BASE)
def library_size(spark, d):
    return rounded(aggregate.library_size(adapter.expression(spark, d)), "library")


@query("SELECT gene, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END, 6) AS sd FROM dense GROUP BY 1", *BASE)
def gene_moments(spark, d):
    data = adapter.dataset(spark, d)
    return rounded(aggregate.gene_moments(data.expression, data.cells, data.genes), "mean", "sd")


@query("SELECT cell_id, gene, round(value, 6) AS value FROM scaled", *BASE)
def scaled_expression(spark, d):
    return rounded(aggregate.scaled(adapter.expression(spark, d)), "value")


@query("SELECT cell_id, gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000), 6) AS value FROM expression", *BASE)
def normalize(spark, d):
    return rounded(preprocess.normalize(adapter.expression(spark, d)), "value")


@query("SELECT cell_id, gene, round((value - avg(value) OVER (PARTITION BY gene)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY gene) = 0 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY gene) END, 5) + 0 AS value FROM dense", *BASE)
def scale(spark, d):
    data = adapter.dataset(spark, d)
    return rounded(preprocess.scale(data.expression, data.cells, data.genes), "value", digits=5)


@query(
    "SELECT cell_id, gene, round(value / (0.5::DOUBLE + value), 6) AS h, round(0.5::DOUBLE / (0.5::DOUBLE + value), 6) AS inv, round(value * value / (0.25::DOUBLE + value * value), 6) AS h2, round(value / (0.5::DOUBLE + value), 4) AS lut FROM scaled",
    *BASE,
)
def hill_functions(spark, d):
    v = F.col("value")
    out = aggregate.scaled(adapter.expression(spark, d)).select("cell_id", "gene", hill(v).alias("h"), hill_inverse(v).alias("inv"), hill(v, 0.5, 2.0).alias("h2"), hill_lut(v, digits=4).alias("lut"))
    return rounded(out, "h", "inv", "h2")


# Knowledge base


@query("SELECT gene FROM genes WHERE gene IN (SELECT ligand FROM interaction UNION SELECT receptor FROM interaction UNION SELECT gene FROM complex_member UNION SELECT gene FROM cofactor_member)", *BASE)
def signaling_genes(spark, d):
    return lrdb.signaling_genes(adapter.database(spark), adapter.genes(spark, d))


@query("SELECT gene, count(*) AS n, round(sum(value), 6) AS total FROM expression WHERE gene IN (SELECT ligand FROM interaction UNION SELECT receptor FROM interaction UNION SELECT gene FROM complex_member UNION SELECT gene FROM cofactor_member) GROUP BY 1", *BASE)
def subset_expression(spark, d):
    wanted = lrdb.signaling_genes(adapter.database(spark), adapter.genes(spark, d))
    out = lrdb.subset_expression(adapter.expression(spark, d), wanted).groupBy("gene").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(out, "total")


@query("SELECT * FROM (VALUES ('CX1', 'A'), ('CX1', 'B'), ('CX2', 'C')) t(name, gene)")
def complex_members(spark, d):
    wide = spark.createDataFrame([("CX1", "A", "B"), ("CX2", "C", ""), ("", "D", None)], "name string, subunit_1 string, subunit_2 string")
    return lrdb.members(wide, "subunit")


# Model


@query("SELECT name, group_name, round(expr, 6) AS expr FROM expr_names", *MODEL(0))
def expr_lr(spark, d):
    lr = lrdb.cleaned(lr_of(spark))
    names = model.distinct_names(lr, "ligand").union(model.distinct_names(lr, "receptor")).distinct()
    return rounded(model.expr_names(names, avgs_of(spark, d), adapter.database(spark).complex_member), "expr")


def _factors(spark, d, which):
    db, avgs = adapter.database(spark), avgs_of(spark, d)
    names = db.cofactor_member.select("name").distinct()
    if which in ("agonist", "antagonist"):
        out = getattr(model, which)(avgs, db.cofactor_member, names)
    else:
        out = model.coreceptor(avgs, db.cofactor_member, names, which == "co_a")
    return rounded(out, "f")


@query("SELECT name, group_name, round(one, 6) AS f FROM factors", *MODEL(0))
def coreceptor_activating(spark, d):
    return _factors(spark, d, "co_a")


@query("SELECT name, group_name, round(1 / one, 6) AS f FROM factors", *MODEL(0))
def coreceptor_inhibiting(spark, d):
    return _factors(spark, d, "co_i")


@query("SELECT name, group_name, round(ago, 6) AS f FROM factors", *MODEL(0))
def agonist(spark, d):
    return _factors(spark, d, "agonist")


@query("SELECT name, group_name, round(anta, 6) AS f FROM factors", *MODEL(0))
def antagonist(spark, d):
    return _factors(spark, d, "antagonist")


@query("SELECT source, target, lr_id, round(prob, 6) AS prob FROM scores", *MODEL(0))
def commun_score(spark, d):
    sides = model.lr_expression(avgs_of(spark, d), adapter.database(spark))
    return rounded(model.probability(sides), "prob")


@query("SELECT perm, cell_id, group_name FROM labels WHERE perm >= 0", *MODEL(NBOOT))
def permuted_labels(spark, d):
    return permute.permuted_labels(adapter.cells(spark, d), NBOOT, SEED)


@query("SELECT source, target, lr_id, round(prob, 6) AS prob, round(pval, 6) AS pval FROM net", *NET(NBOOT))
def commun_prob(spark, d):
    data = adapter.dataset(spark, d)
    return rounded(permute.commun_prob(data, adapter.database(spark), Params(nboot=NBOOT, seed=SEED), "kernel"), "prob", "pval")


@query("SELECT source, target, lr_id, round(prob, 6) AS prob, round(pval, 6) AS pval FROM net", *NET(3))
def commun_prob_sql(spark, d):
    data = adapter.dataset(spark, d)
    return rounded(permute.commun_prob(data, adapter.database(spark), Params(nboot=3, seed=SEED), "sql"), "prob", "pval")


@query("SELECT source, target, lr_id, round(prob, 6) AS prob, round(pval, 6) AS pval FROM net", *NET(5, "quantile_cont(value, 0.5)"))
def commun_prob_fast(spark, d):
    return rounded(net_of(spark, d, Params(mean_method=MeanMethod.MEDIAN, nboot=5, seed=SEED)), "prob", "pval")


@query("SELECT s.source, s.target, s.lr_id, round(prob * a.n * b.n / ((SELECT sum(n) FROM sizes)::DOUBLE * (SELECT sum(n) FROM sizes)::DOUBLE), 6) AS prob FROM scores s JOIN sizes a ON a.group_name = source JOIN sizes b ON b.group_name = target", *MODEL(0))
def commun_prob_population(spark, d):
    sides = model.lr_expression(avgs_of(spark, d), adapter.database(spark))
    return rounded(model.probability(sides, population=model.population_shares(adapter.cells(spark, d))), "prob")


@query("SELECT s.source, s.target, s.lr_id, round(prob * CASE WHEN source = target THEN 1 ELSE 0.25 END, 6) AS prob FROM scores s", *MODEL(0))
def commun_prob_group_space(spark, d):
    sides, g = model.lr_expression(avgs_of(spark, d), adapter.database(spark)), groups_of(spark, d)
    p = g.select(F.col("group_name").alias("source")).join(g.select(F.col("group_name").alias("target"))).withColumn("p", F.when(F.col("source") == F.col("target"), 1.0).otherwise(0.25))
    return rounded(model.probability(sides, p_spatial=p), "prob")


@query(
    "SELECT o.source, o.target, o.lr_id, round(o.prob, 6) AS prob, round(count(*) FILTER (s.prob >= o.prob) / 10.0::DOUBLE, 6) AS pval FROM near o JOIN near s ON s.perm >= 0 AND s.source = o.source AND s.target = o.target AND s.lr_id = o.lr_id WHERE o.perm = -1 GROUP BY o.source, o.target, o.lr_id, o.prob",
    *MODEL(NBOOT),
    "near AS (SELECT perm, source, target, lr_id, round(prob * CASE WHEN source = target THEN 1 ELSE 0.25 END, 12) AS prob FROM scores)",
)
def commun_prob_group_space_test(spark, d):
    g = groups_of(spark, d)
    p = g.select(F.col("group_name").alias("source")).join(g.select(F.col("group_name").alias("target"))).withColumn("p", F.when(F.col("source") == F.col("target"), 1.0).otherwise(0.25))
    return rounded(permute.commun_prob(adapter.dataset(spark, d), adapter.database(spark), Params(nboot=NBOOT, seed=SEED), p_spatial=p), "prob", "pval")


# Networks


@query("SELECT source, target, pathway, round(prob, 6) AS prob, rank FROM netp", *NETP(NBOOT))
def pathway_network(spark, d):
    return rounded(netp_of(spark, d), "prob")


@query("SELECT source, target, n, round(weight, 6) AS weight FROM agg", *NETP(NBOOT))
def aggregate_net(spark, d):
    return rounded(network.aggregate_net(net_of(spark, d)), "weight")


@query(
    "SELECT source, target, lr_id, round(CASE WHEN links < 3 THEN 0 ELSE prob END, 6) AS prob, round(CASE WHEN links < 3 THEN 1 ELSE pval END, 6) AS pval FROM (SELECT *, sum(CASE WHEN pval < 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY source, target) AS links FROM (SELECT source, target, lr_id, CASE WHEN a.n < 290 OR b.n < 290 THEN 0 ELSE prob END AS prob, CASE WHEN a.n < 290 OR b.n < 290 THEN 1 ELSE pval END AS pval FROM net JOIN sizes a ON a.group_name = source JOIN sizes b ON b.group_name = target))",
    *NET(NBOOT),
)
def filter_communication(spark, d):
    out = network.filter_communication(net_of(spark, d), aggregate.group_counts(adapter.cells(spark, d)), 290, 3)
    return rounded(out, "prob", "pval")


@query("SELECT source, target, n.lr_id, interaction_name, pathway_name AS pathway, ligand, receptor, round(prob, 6) AS prob, round(pval, 6) AS pval FROM net n JOIN interaction i USING (lr_id) WHERE source IN ('BUILDING', 'MACHINERY') AND target = 'HOUSEHOLD' AND pathway_name IN ('P1', 'P2')", *NET(NBOOT))
def subset_communication(spark, d):
    out = network.subset_communication(net_of(spark, d), lr_of(spark), ["BUILDING", "MACHINERY"], ["HOUSEHOLD"], ["P1", "P2"])
    return rounded(out, "prob", "pval")


@query("SELECT g.group_name AS source, h.group_name AS target, p.pathway, round(coalesce(prob, 0), 6) AS prob FROM (SELECT group_name FROM sizes UNION SELECT 'NEW') g CROSS JOIN (SELECT group_name FROM sizes UNION SELECT 'NEW') h CROSS JOIN (SELECT DISTINCT pathway FROM netp) p LEFT JOIN netp n ON n.source = g.group_name AND n.target = h.group_name AND n.pathway = p.pathway", *NETP(NBOOT))
def lift_groups(spark, d):
    more = groups_of(spark, d).union(spark.createDataFrame([("NEW",)], "group_name string"))
    return rounded(network.lift(netp_of(spark, d), more), "prob")


@query("SELECT pathway, round(sum(prob), 6) AS total, row_number() OVER (ORDER BY sum(prob) DESC, pathway) AS rank FROM netp GROUP BY 1 HAVING sum(prob) > 0", *NETP(NBOOT))
def rank_net(spark, d):
    return rounded(network.rank_net(netp_of(spark, d)), "total")


@query("SELECT pathway_a, pathway_b, round(sim, 6) AS sim FROM similarity", *NETP(NBOOT))
def network_similarity(spark, d):
    return rounded(graph.network_similarity(netp_of(spark, d)), "sim")


@query("SELECT pathway_a AS pathway, round(avg(sim), 6) AS mean_sim, row_number() OVER (ORDER BY round(avg(sim), 12) DESC, pathway_a) AS rank FROM similarity GROUP BY 1", *NETP(NBOOT))
def rank_similarity(spark, d):
    return rounded(network.rank_similarity(graph.network_similarity(netp_of(spark, d))), "mean_sim")


def _merged(spark, d):
    agg = network.aggregate_net(net_of(spark, d))
    return network.merge([agg, agg.where("source != 'BUILDING'").withColumn("weight", F.col("weight") * 2)], ["a", "b"])


@query("SELECT dataset, round(sum(weight), 6) AS total FROM (SELECT 'a' AS dataset, weight FROM agg UNION ALL SELECT 'b', weight * 2 FROM agg WHERE source <> 'BUILDING') GROUP BY 1", *NETP(NBOOT))
def merged_bars(spark, d):
    return rounded(network.bars(_merged(spark, d)), "total")


@query("SELECT source, target, round(weight, 6) AS a, round(CASE WHEN source = 'BUILDING' THEN 0 ELSE 2 * weight END, 6) AS b, round(CASE WHEN source = 'BUILDING' THEN -weight ELSE weight END, 6) + 0 AS difference FROM agg", *NETP(NBOOT))
def compare_interactions(spark, d):
    return rounded(network.compare(_merged(spark, d), "a", "b"), "a", "b", "difference")


@query("SELECT pathway, count(*) AS n, string_agg(gene, ',' ORDER BY gene) AS genes FROM (SELECT DISTINCT pathway_name AS pathway, unnest([ligand, receptor]) AS gene FROM interaction) WHERE gene IN ('Brand#1', 'Brand#4', 'Brand#7', 'Brand#13', 'Brand#14') GROUP BY 1", *BASE)
def map_deg(spark, d):
    deg = spark.createDataFrame([(f"Brand#{i}",) for i in (1, 4, 7, 13, 14)], "gene string")
    return network.map_deg(lr_of(spark), deg)


@query(
    "SELECT pathway, round(CASE WHEN total = 0 THEN 0 ELSE top / (total / (2 * (SELECT count(*) FROM sizes))) END, 6) AS score FROM (SELECT pathway, sum(prob) AS total FROM netp GROUP BY 1) JOIN (SELECT pathway, max(s) AS top FROM (SELECT pathway, sum(prob) AS s FROM netp GROUP BY pathway, source UNION ALL SELECT pathway, sum(prob) FROM netp GROUP BY pathway, target) GROUP BY 1) USING (pathway)",
    *NETP(NBOOT),
)
def enrichment_score(spark, d):
    return rounded(network.enrichment_score(netp_of(spark, d), groups_of(spark, d)), "score")


@query("SELECT source, target, n.lr_id, interaction_name, pathway_name AS pathway, ligand, receptor, round(prob, 6) AS prob, round(pval, 6) AS pval FROM net n JOIN interaction i USING (lr_id) WHERE pathway_name = 'P1' AND pval < 0.05", *NET(NBOOT))
def enriched_lr(spark, d):
    return rounded(network.enriched_lr(net_of(spark, d), lr_of(spark), "P1"), "prob", "pval")


@query("SELECT DISTINCT pathway_name AS pathway FROM net JOIN interaction USING (lr_id) WHERE pval < 0.05", *NET(NBOOT))
def enriched_signaling(spark, d):
    return network.enriched_signaling(net_of(spark, d), lr_of(spark))


@query('SELECT pathway, round(sum(prob), 6) AS total, round(sum(prob) / ((SELECT count(*) FROM sizes) * (SELECT count(*) FROM sizes)), 6) AS mean, round(max(prob), 6) AS "max" FROM netp GROUP BY 1', *NETP(NBOOT))
def pathway_summary(spark, d):
    return rounded(network.pathway_summary(netp_of(spark, d), groups_of(spark, d)), "total", "mean", "max")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT source, " + ", ".join(f"round(sum(CASE WHEN target = '{s}' THEN weight ELSE 0 END), 6) AS {s}" for s in _SEGMENTS) + " FROM agg GROUP BY 1", *NETP(NBOOT))
def heatmap(spark, d):
    return rounded(network.heatmap(network.aggregate_net(net_of(spark, d)), "weight", _SEGMENTS), *_SEGMENTS)


@query(
    "SELECT pathway, source || ' -> ' || target AS pair, round(prob, 6) AS prob, round(pval, 6) AS pval, round(prob / max(prob) OVER () * 300 + 20, 4) AS size, round(-log10(pval + 1e-300), 4) + 0 AS colour FROM (SELECT pathway_name AS pathway, source, target, avg(prob) AS prob, min(pval) AS pval FROM net JOIN interaction USING (lr_id) GROUP BY 1, 2, 3) WHERE pval < 0.05 AND prob > 0",
    *NET(NBOOT),
)
def bubble(spark, d):
    return rounded(rounded(network.bubble(net_of(spark, d), lr_of(spark)), "prob", "pval"), "size", "colour", digits=4)


@query("SELECT pathway_name AS pathway, round(sum(prob), 6) AS total FROM net JOIN interaction USING (lr_id) GROUP BY 1 ORDER BY sum(prob) DESC, 1 LIMIT 3", *NET(NBOOT))
def top_pathways(spark, d):
    return rounded(network.top_pathways(net_of(spark, d), lr_of(spark), 3), "total")


_ENDS = "ends AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT source AS node, weight AS o, 0::DOUBLE AS i FROM agg UNION ALL SELECT target, 0, weight FROM agg) GROUP BY 1)"


@query("SELECT node, round(o + i, 6) AS total, round(0.5 + 1.5 * (o + i) / max(o + i) OVER (), 6) AS size FROM ends", *NETP(NBOOT), _ENDS)
def circle_nodes(spark, d):
    return rounded(network.circle_nodes(network.aggregate_net(net_of(spark, d))), "total", "size")


@query("SELECT source, target, round(weight, 6) AS weight, round(0.5 + 4 * weight / top, 6) AS width FROM (SELECT *, max(weight) OVER () AS top FROM agg) WHERE source <> target AND weight > 0", *NETP(NBOOT))
def circle_edges(spark, d):
    return rounded(network.circle_edges(network.aggregate_net(net_of(spark, d))), "weight", "width")


@query(
    "SELECT source, target, round(weight, 6) AS weight, round(weight / r, 6) AS out_share, round(weight / c, 6) AS in_share, round(arc, 6) AS arc FROM (SELECT *, sum(weight) OVER (PARTITION BY source) AS r, sum(weight) OVER (PARTITION BY target) AS c FROM agg) JOIN (SELECT node AS source, (o + i) / sum(o + i) OVER () AS arc FROM ends) USING (source) WHERE weight > 0",
    *NETP(NBOOT),
    _ENDS,
)
def chord(spark, d):
    return rounded(network.chord(network.aggregate_net(net_of(spark, d))), "weight", "out_share", "in_share", "arc")


@query("SELECT node, round(o / max(o) OVER (), 6) AS out_size, round(i / max(i) OVER (), 6) AS in_size FROM ends", *NETP(NBOOT), _ENDS)
def hierarchy(spark, d):
    return rounded(network.hierarchy(network.aggregate_net(net_of(spark, d))), "out_size", "in_size")


@query("SELECT source, target, round(sum(prob), 6) AS prob FROM net JOIN interaction USING (lr_id) WHERE pathway_name = 'P2' GROUP BY 1, 2", *NET(NBOOT))
def pathway_matrix(spark, d):
    return rounded(network.pathway_matrix(net_of(spark, d), lr_of(spark), "P2"), "prob")


@query("SELECT pathway, interaction_name, round(total, 6) AS total, round(total / sum(total) OVER (PARTITION BY pathway), 6) AS share, row_number() OVER (PARTITION BY pathway ORDER BY total DESC, interaction_name) AS rank FROM (SELECT pathway_name AS pathway, interaction_name, sum(prob) AS total FROM net JOIN interaction USING (lr_id) GROUP BY 1, 2)", *NET(NBOOT))
def contribution(spark, d):
    return rounded(network.contribution(net_of(spark, d), lr_of(spark)), "total", "share")


def _pattern_sql(side):
    return f"SELECT group_name, pathway, round(total, 6) AS total, round(value, 6) AS value FROM (SELECT *, sum(value) OVER (PARTITION BY group_name) AS entire FROM (SELECT *, CASE WHEN max(total) OVER (PARTITION BY pathway) = 0 THEN 0 ELSE total / max(total) OVER (PARTITION BY pathway) END AS value FROM (SELECT {side} AS group_name, pathway, sum(prob) AS total FROM netp GROUP BY 1, 2))) WHERE entire > 0"


@query(_pattern_sql("source"), *NETP(NBOOT))
def pattern_input_outgoing(spark, d):
    return rounded(network.pattern_input(netp_of(spark, d), True), "total", "value")


@query(_pattern_sql("target"), *NETP(NBOOT))
def pattern_input_incoming(spark, d):
    return rounded(network.pattern_input(netp_of(spark, d), False), "total", "value")


# Iterative kernels: no SQL; tests hold them against definitions


@query()
def communication_patterns(spark, d):
    return rounded(patterns.communication_patterns(network.pattern_input(netp_of(spark, d)), 2), "weight")


@query()
def pattern_river(spark, d):
    p = settle(patterns.communication_patterns(network.pattern_input(netp_of(spark, d)), 2))
    w = p.where("side = 'group'").select("pattern", F.col("name").alias("group_name"), "weight")
    h = p.where("side = 'pathway'").select("pattern", F.col("name").alias("pathway"), "weight")
    return rounded(network.river(w, h), "weight")


@query()
def select_k(spark, d):
    return rounded(patterns.select_k(network.pattern_input(netp_of(spark, d)), [2, 3], 3), "score", digits=4)


@query()
def pathway_embedding(spark, d):
    return rounded(patterns.embedding(graph.network_similarity(netp_of(spark, d))), "x", "y")


@query()
def centrality(spark, d):
    return rounded(graph.centrality(netp_of(spark, d), groups_of(spark, d)), "value")


@query(
    """SELECT pathway, node, round(rank, 6) AS rank FROM walk WHERE i = 4""",
    *NETP(NBOOT),
    "e AS (SELECT pathway, source, target, prob / sum(prob) OVER (PARTITION BY pathway, source) AS p FROM netp WHERE prob > 0), nodes AS (SELECT pathway, node, count(*) OVER (PARTITION BY pathway) AS n FROM (SELECT pathway, source AS node FROM e UNION SELECT pathway, target FROM e))",
    "w0 AS (SELECT pathway, node, n, 1.0::DOUBLE / n AS rank FROM nodes)",
    *(
        f"f{i} AS (SELECT x.pathway, x.node, x.n, coalesce(sum(y.rank * e.p), 0) AS flow FROM w{i - 1} x LEFT JOIN e ON e.pathway = x.pathway AND e.target = x.node LEFT JOIN w{i - 1} y ON y.pathway = e.pathway AND y.node = e.source GROUP BY 1, 2, 3), w{i} AS (SELECT pathway, node, n, 0.15::DOUBLE / n + 0.85::DOUBLE * (flow + (1 - sum(flow) OVER (PARTITION BY pathway)) / n) AS rank FROM f{i})"
        for i in range(1, 5)
    ),
    "walk AS (SELECT *, 4 AS i FROM w4)",
)
def pagerank(spark, d):
    return rounded(graph.pagerank_sql(netp_of(spark, d), 4), "rank")


@query(
    "SELECT pathway, node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round(sum(os), 6) AS out_strength, round(sum(s), 6) AS in_strength FROM (SELECT pathway, source AS node, 1 AS o, 0 AS i, prob AS os, 0::DOUBLE AS s FROM netp WHERE prob > 0 UNION ALL SELECT pathway, target, 0, 1, 0, prob FROM netp WHERE prob > 0) GROUP BY 1, 2",
    *NETP(NBOOT),
)
def degrees(spark, d):
    return rounded(graph.degrees(netp_of(spark, d)), "out_strength", "in_strength")


# Space


@query("SELECT src, dst, round(dist, 6) AS dist, contact FROM edges", *SPACE)
def cell_edges(spark, d):
    return rounded(spatial.cell_edges(adapter.coords(spark, d), SPACING), "dist")


@query("SELECT src, dst, contact, round(p, 6) AS p FROM p_spatial", *SPACE)
def p_spatial(spark, d):
    c = adapter.coords(spark, d)
    return rounded(spatial.p_spatial(spatial.cell_edges(c, SPACING), c, SPACING), "p")


_scores: dict[tuple, spatial.CellScores] = {}


def prob_cell_of(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _scores:
        e = adapter.spot_expression(spark, d)
        genes = spark.createDataFrame([(f"Brand#{i}",) for i in range(1, 25)], "gene string")
        _scores[key] = spatial.cell_scores(e, genes, adapter.coords(spark, d), adapter.database(spark), SPACING)
    return _scores[key]


@query("SELECT src, dst, lr_id, round(prob, 6) AS prob FROM prob_cell", *SPACE)
def prob_cell(spark, d):
    return rounded(prob_cell_of(spark, d).rows(), "prob")


@query("SELECT source, target, lr_id, round(sum(prob), 6) AS prob FROM prob_cell JOIN (SELECT cell_id AS src, group_name AS source FROM spots) USING (src) JOIN (SELECT cell_id AS dst, group_name AS target FROM spots) USING (dst) GROUP BY 1, 2, 3", *SPACE)
def cell_to_group(spark, d):
    return rounded(spatial.cell_to_group(prob_cell_of(spark, d), adapter.spots(spark, d)), "prob")


@query(
    "SELECT source, target, lr_id, round(prob, 6) AS prob, round(pval, 6) AS pval FROM (SELECT o.source, o.target, o.lr_id, o.prob, count(*) FILTER (round(coalesce(s.prob, 0), 9) >= round(o.prob, 9)) / 5.0::DOUBLE AS pval FROM sums o CROSS JOIN range(5) r(perm) LEFT JOIN sums s ON s.perm = r.perm AND s.source = o.source AND s.target = o.target AND s.lr_id = o.lr_id WHERE o.perm = -1 GROUP BY 1, 2, 3, 4)",
    *SPACE,
    "spot_labels AS (SELECT -1 AS perm, cell_id, group_name FROM spots UNION ALL SELECT perm, cell_id, group_name FROM (SELECT p.perm, s.cell_id, row_number() OVER (PARTITION BY p.perm ORDER BY md5('1|' || p.perm || '|' || s.cell_id), s.cell_id) AS r FROM range(5) p(perm) CROSS JOIN spots s) JOIN (SELECT group_name, row_number() OVER (ORDER BY md5('1|base|' || cell_id), cell_id) AS r FROM spots) USING (r))",
    "sums AS (SELECT a.perm, a.group_name AS source, b.group_name AS target, lr_id, sum(prob) AS prob FROM prob_cell c JOIN spot_labels a ON a.cell_id = c.src JOIN spot_labels b ON b.cell_id = c.dst AND b.perm = a.perm GROUP BY 1, 2, 3, 4)",
)
def avg_commun_prob(spark, d):
    return rounded(spatial.avg_commun_prob(prob_cell_of(spark, d), adapter.spots(spark, d), 5, SEED), "prob", "pval")


@query(
    "SELECT a.type AS source, b.type AS target, lr_id, round(sum(a.w * prob * b.w) / count(*), 6) AS prob FROM prob_cell c JOIN proportions a ON a.spot_id = c.src JOIN proportions b ON b.spot_id = c.dst GROUP BY 1, 2, 3",
    *SPACE,
)
def spot_prob(spark, d):
    return rounded(spatial.spot_prob(prob_cell_of(spark, d), adapter.proportions(spark, d)), "prob")


@query(
    "SELECT o.source, o.target, o.lr_id, round(o.prob, 6) AS prob, round((count(*) FILTER (round(s.prob, 9) >= round(o.prob, 9)) + CASE WHEN round(o.prob, 9) <= 0 THEN 5 - count(s.perm) ELSE 0 END) / 5.0::DOUBLE, 6) AS pval FROM soft_scores o LEFT JOIN soft_scores s ON s.perm >= 0 AND s.source = o.source AND s.target = o.target AND s.lr_id = o.lr_id WHERE o.perm = -1 GROUP BY o.source, o.target, o.lr_id, o.prob",
    *SPACE,
    "types AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS id FROM (SELECT DISTINCT type FROM proportions))",
    "swaps AS (SELECT -1 AS perm, type, type AS moved FROM types UNION ALL SELECT perm, s.type, b.type FROM (SELECT p.perm, type, row_number() OVER (PARTITION BY p.perm ORDER BY md5('1|' || p.perm || '|' || id), id) AS r FROM range(5) p(perm) CROSS JOIN types) s JOIN (SELECT type, row_number() OVER (ORDER BY md5('1|base|' || id), id) AS r FROM types) b USING (r))",
    "relabelled AS (SELECT perm, spot_id, moved AS type, w FROM proportions JOIN swaps USING (type))",
    "soft_scores AS (SELECT a.perm, a.type AS source, b.type AS target, lr_id, sum(a.w * prob * b.w) / count(*) AS prob FROM prob_cell c JOIN relabelled a ON a.spot_id = c.src JOIN relabelled b ON b.spot_id = c.dst AND b.perm = a.perm GROUP BY 1, 2, 3, 4)",
)
def spot_test(spark, d):
    return rounded(spatial.spot_test(prob_cell_of(spark, d), adapter.proportions(spark, d), nboot=5), "prob", "pval")


_GRID = "placed AS (SELECT cell_id, x, y, floor((x - (SELECT min(x) FROM coords)) / 0.1::DOUBLE)::BIGINT AS gx, floor((y - (SELECT min(y) FROM coords)) / 0.1::DOUBLE)::BIGINT AS gy FROM coords)"


@query("SELECT gx, gy, round(x, 6) AS x, round(y, 6) AS y, n, group_name FROM (SELECT gx, gy, avg(x) AS x, avg(y) AS y, count(*) AS n FROM placed GROUP BY 1, 2) JOIN (SELECT gx, gy, group_name FROM (SELECT gx, gy, group_name, row_number() OVER (PARTITION BY gx, gy ORDER BY count(*) DESC, group_name) AS k FROM placed JOIN spots USING (cell_id) GROUP BY 1, 2, 3) WHERE k = 1) USING (gx, gy)", *SPACE, _GRID)
def grid_labels(spark, d):
    return rounded(spatial.grid_labels(adapter.coords(spark, d), adapter.spots(spark, d), 0.1), "x", "y")


@query("SELECT gx, gy, gene, round(sum(value) / n, 6) AS value FROM spot_expression JOIN placed USING (cell_id) JOIN (SELECT gx, gy, count(*) AS n FROM placed GROUP BY 1, 2) USING (gx, gy) GROUP BY gx, gy, gene, n", *SPACE, _GRID)
def grid_expression(spark, d):
    return rounded(spatial.grid_expression(adapter.spot_expression(spark, d), adapter.coords(spark, d), 0.1), "value")


@query("SELECT source, target, round(dist, 6) AS dist FROM (SELECT a.group_name AS source, b.group_name AS target, quantile_cont(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 0.5) AS dist FROM here a JOIN here b ON a.group_name <> b.group_name GROUP BY 1, 2 UNION ALL SELECT DISTINCT group_name, group_name, 0 FROM spots)", *SPACE, "here AS (SELECT * FROM coords JOIN spots USING (cell_id))")
def region_distance(spark, d):
    return rounded(spatial.region_distance(adapter.coords(spark, d), adapter.spots(spark, d)), "dist")


@query(
    "SELECT o.source, o.target, o.n, round(count(*) FILTER (coalesce(s.n, 0) >= o.n) / 5.0::DOUBLE, 6) AS pval FROM counts o CROSS JOIN range(5) r(perm) LEFT JOIN counts s ON s.perm = r.perm AND s.source = o.source AND s.target = o.target WHERE o.perm = -1 GROUP BY 1, 2, 3",
    *SPACE,
    "spot_labels AS (SELECT -1 AS perm, cell_id, group_name FROM spots UNION ALL SELECT perm, cell_id, group_name FROM (SELECT p.perm, s.cell_id, row_number() OVER (PARTITION BY p.perm ORDER BY md5('1|' || p.perm || '|' || s.cell_id), s.cell_id) AS r FROM range(5) p(perm) CROSS JOIN spots s) JOIN (SELECT group_name, row_number() OVER (ORDER BY md5('1|base|' || cell_id), cell_id) AS r FROM spots) USING (r))",
    "counts AS (SELECT x.perm, x.group_name AS source, y.group_name AS target, count(*) AS n FROM (SELECT a.cell_id AS src, b.cell_id AS dst FROM coords a JOIN coords b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05::DOUBLE * 0.05::DOUBLE) JOIN spot_labels x ON x.cell_id = src JOIN spot_labels y ON y.cell_id = dst AND y.perm = x.perm GROUP BY 1, 2, 3)",
)
def colocalization(spark, d):
    return rounded(spatial.colocalization(adapter.coords(spark, d), adapter.spots(spark, d), 0.05, 5, SEED), "pval")


@query(
    "SELECT round(median(sqrt(d2)), 6) AS radius, count(*) AS n FROM pairs WHERE d2 > 0",
    *SPACE,
)
def median_radius(spark, d):
    radius, n = spatial.median_distance(adapter.coords(spark, d))
    return rounded(spark.createDataFrame([(n, radius if n else None)], "n bigint, radius double"), "radius")


@query("SELECT l_orderkey, l_linenumber, round(l_discount / (0.5::DOUBLE + l_discount), 6) AS h, round(0.5::DOUBLE / (0.5::DOUBLE + l_discount), 6) AS inverse, round((l_discount + 2 * l_tax + l_quantity) / 4, 6) AS mean FROM lineitem")
def sql_functions(spark, d):
    register(spark)
    adapter.table(spark, d, "lineitem").createOrReplaceTempView("synapsis_lineitem")
    return rounded(spark.sql("SELECT l_orderkey, l_linenumber, hill(l_discount, 0.5D, 1D) AS h, hill_inverse(l_discount, 0.5D, 1D) AS inverse, tri_mean_of(l_discount, l_tax, l_quantity) AS mean FROM synapsis_lineitem"), "h", "inverse", "mean")


@query("SELECT src, dst, contact, 1.0::DOUBLE AS p FROM edges UNION ALL SELECT cell_id, cell_id, false, 1.0::DOUBLE FROM coords", *SPACE)
def p_spatial_without_distance(spark, d):
    c = adapter.coords(spark, d)
    return spatial.p_spatial(spatial.cell_edges(c, SPACING), c, SPACING, distance_use=False)


@query("SELECT src, dst, contact, round(CASE WHEN src = dst THEN 2 ELSE p END, 6) AS p FROM p_spatial", *SPACE)
def p_spatial_self_value(spark, d):
    c = adapter.coords(spark, d)
    return rounded(spatial.p_spatial(spatial.cell_edges(c, SPACING), c, SPACING, self_value=2.0), "p")


@query("SELECT gene, group_name, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest(['size', 'price']) AS gene, unnest([p_size::DOUBLE, p_retailprice]) AS value, p_brand AS group_name FROM part) WHERE value <> 0 GROUP BY 1, 2")
def wide_dataset(spark, d):
    part = adapter.table(spark, d, "part")
    data = store.from_wide(part.select(F.col("p_partkey").alias("cell_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")), "brand")
    return rounded(data.expression.join(data.cells, "cell_id").groupBy("gene", "group_name").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)


@query("SELECT group_name, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM coords JOIN spots USING (cell_id) GROUP BY 1", *SPACE)
def centroids(spark, d):
    return rounded(spatial.centroids(adapter.coords(spark, d), adapter.spots(spark, d)), "x", "y")


@query("SELECT source, target, round(weight, 6) AS weight, round(a.x, 6) AS x1, round(a.y, 6) AS y1, round(b.x, 6) AS x2, round(b.y, 6) AS y2 FROM (SELECT s.group_name AS source, t.group_name AS target, sum(prob) AS weight FROM prob_cell JOIN spots s ON s.cell_id = src JOIN spots t ON t.cell_id = dst GROUP BY 1, 2) JOIN c a ON a.group_name = source JOIN c b ON b.group_name = target", *SPACE, "c AS (SELECT group_name, avg(x) AS x, avg(y) AS y FROM coords JOIN spots USING (cell_id) GROUP BY 1)")
def network_lines(spark, d):
    agg = spatial.cell_to_group(prob_cell_of(spark, d), adapter.spots(spark, d)).groupBy("source", "target").agg(F.sum("prob").alias("weight"))
    return rounded(spatial.network_lines(agg, spatial.centroids(adapter.coords(spark, d), adapter.spots(spark, d))), "weight", "x1", "y1", "x2", "y2")


@query("SELECT cell_id, round(x, 6) AS x, round(y, 6) AS y, round(coalesce(value, 0), 6) AS value FROM coords LEFT JOIN (SELECT cell_id, value FROM spot_expression WHERE gene = 'Brand#5') USING (cell_id)", *SPACE)
def spatial_feature(spark, d):
    return rounded(spatial.feature(adapter.coords(spark, d), adapter.spot_expression(spark, d), "Brand#5"), "x", "y", "value")


@query("SELECT cell_id, round(x, 6) AS x, round(y, 6) AS y, group_name FROM coords JOIN spots USING (cell_id)", *SPACE)
def spatial_dim(spark, d):
    return rounded(spatial.dim(adapter.coords(spark, d), adapter.spots(spark, d)), "x", "y")


_KNN = "near AS (SELECT a.cell_id, b.cell_id AS neighbor_id, CASE WHEN a.cell_id = b.cell_id THEN -1 ELSE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) END AS d2 FROM coords a CROSS JOIN coords b), knn AS (SELECT cell_id, neighbor_id, row_number() OVER (PARTITION BY cell_id ORDER BY d2, neighbor_id) AS rank FROM near WHERE d2 <= 0.2::DOUBLE * 0.2::DOUBLE QUALIFY rank <= 6)"


@query("SELECT cell_id, rank::INTEGER AS rank, neighbor_id FROM knn", *SPACE, _KNN)
def knn(spark, d):
    return graph.knn(adapter.coords(spark, d), 6, 0.2)


@query("SELECT i, j, round(s / (12.0::DOUBLE - s), 6) AS weight FROM (SELECT a.cell_id AS i, b.cell_id AS j, count(*) AS s FROM knn a JOIN knn b USING (neighbor_id) GROUP BY 1, 2) WHERE s / (12.0::DOUBLE - s) >= 1 / 15.0::DOUBLE", *SPACE, _KNN)
def snn(spark, d):
    return rounded(graph.snn(graph.knn(adapter.coords(spark, d), 6, 0.2), 6), "weight")


# Tests


_RANKS = "ranked AS (SELECT gene, group_name, value, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY gene) AS n FROM dense), ranksums AS (SELECT gene, group_name, count(*) AS n1, max(n) AS n, sum(r) AS rank_sum FROM ranked GROUP BY 1, 2), z AS (SELECT *, (rank_sum - n1 * (n + 1) / 2.0::DOUBLE) / sqrt(n1::DOUBLE * (n - n1) * (n + 1) / 12) AS z FROM ranksums)"


@query("SELECT gene, group_name, n1, n, round(rank_sum, 6) AS rank_sum, round(z, 6) AS z FROM z", *BASE, _RANKS)
def rank_sum_test(spark, d):
    data = adapter.dataset(spark, d)
    return rounded(preprocess.rank_sums(data.expression, data.cells, data.genes), "rank_sum", "z")


@query(
    "SELECT gene, group_name, round(p, 6) AS p, round(min(least(1, p * m / k)) OVER (ORDER BY p DESC), 6) AS p_adj FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS k FROM (SELECT gene, group_name, round(exp(-abs(z)), 9) AS p FROM z))",
    *BASE,
    _RANKS,
)
def bh_adjust(spark, d):
    data = adapter.dataset(spark, d)
    z = preprocess.rank_sums(data.expression, data.cells, data.genes).select("gene", "group_name", F.round(F.exp(-F.abs("z")), 9).alias("p"))
    return rounded(preprocess.adjust_bh(settle(z)), "p", "p_adj").select("gene", "group_name", "p", "p_adj")


@query()
def over_expressed(spark, d):
    data = adapter.dataset(spark, d)
    out = preprocess.over_expressed(data.expression, data.cells, data.genes, thresh_p=0.5)
    return rounded(out, "logfc", "pct_1", "pct_2", "pval", "p_val_adj")


# Stream and storage


@query(
    "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type AS \"group\", count(*) AS n, count(*) FILTER (value <> 0) AS nonzero, round(sum(value), 4) AS total, round(sum(value) / count(*), 6) AS mean, round(CASE WHEN count(*) FILTER (value <> 0) / count(*)::DOUBLE >= 0.1 THEN sum(value) / count(*) ELSE 0 END, 6) AS thresholded FROM events GROUP BY 1, 2"
)
def stream_group_stats(spark, d):
    import uuid

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    name = "stats_" + uuid.uuid4().hex
    base = shared_folder(spark)
    out = group_stats.snapshot(group_stats.windowed_stats(stream, "ts", "event_type", "value"), name, f"{base}/{name}")
    out = out.select(F.unix_timestamp("start").alias("start"), "group", "n", "nonzero", F.round("total", 4).alias("total"), "mean", "thresholded")
    return rounded(out, "mean", "thresholded")


@query("SELECT source, target, n, round(weight, 6) AS weight FROM agg", *NETP(NBOOT))
def saved_results(spark, d):
    import uuid

    base = shared_folder(spark)
    path = f"{base}/saved-{uuid.uuid4().hex}"
    store.save(path, net_of(spark, d), lr_of(spark), adapter.cells(spark, d))
    return rounded(store.load(spark, path)["net_agg"], "weight")
