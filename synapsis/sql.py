"""The oracle's common table expressions: the engine's relations in plain SQL, independent of the operators."""

from __future__ import annotations

from .sources.adapter import COFACTORS, COMPLEXES, LR


def with_ctes(final: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {final}" if ctes else final


def _values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


BASE = (
    "cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS group_name FROM customer)",
    "genes AS (SELECT DISTINCT p_brand AS gene FROM part)",
    "expression AS (SELECT o_custkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
    "scaled AS (SELECT cell_id, gene, value / (SELECT max(value) FROM expression) AS value FROM expression)",
    "sizes AS (SELECT group_name, count(*) AS n FROM cells GROUP BY 1)",
    "dense AS (SELECT c.cell_id, c.group_name, g.gene, coalesce(e.value, 0)::DOUBLE AS value FROM cells c CROSS JOIN genes g LEFT JOIN expression e ON e.cell_id = c.cell_id AND e.gene = g.gene)",
    "lr AS (" + _values(LR, "lr_id, interaction_name, pathway_name, ligand, receptor, agonist, antagonist, co_a_receptor, co_i_receptor, interaction_type") + ")",
    "interaction AS (SELECT lr_id::INTEGER AS lr_id, interaction_name, pathway_name, ligand, receptor, nullif(agonist, '') AS agonist, nullif(antagonist, '') AS antagonist, nullif(co_a_receptor, '') AS co_a_receptor, nullif(co_i_receptor, '') AS co_i_receptor, interaction_type FROM lr)",
    "complex_member AS (" + _values(COMPLEXES, "name, gene") + ")",
    "cofactor_member AS (" + _values(COFACTORS, "name, gene") + ")",
)
TRI = "(quantile_cont(value, 0.25) + 2 * quantile_cont(value, 0.5) + quantile_cont(value, 0.75)) / 4"


def dense_aggregate(of: str) -> str:
    return f"SELECT gene, group_name, round({of}, 6) AS avg FROM dense GROUP BY 1, 2"


def AVGS(nboot: int, mean: str = TRI) -> tuple[str, ...]:
    """labels (perm -1: as observed) and avgs by permutation, gene and group."""
    shuffled = f" UNION ALL SELECT perm, cell_id, group_name FROM (SELECT p.perm, cell_id, row_number() OVER (PARTITION BY p.perm ORDER BY md5('1|' || p.perm || '|' || cell_id), cell_id) AS r FROM range({nboot}) p(perm) CROSS JOIN cells) JOIN (SELECT group_name, row_number() OVER (ORDER BY md5('1|base|' || cell_id), cell_id) AS r FROM cells) USING (r)"
    return (
        *BASE,
        "labels AS (SELECT perm::INTEGER AS perm, cell_id, group_name FROM (SELECT -1 AS perm, cell_id, group_name FROM cells" + (shuffled if nboot else "") + "))",
        f"avgs AS (SELECT perm, gene, l.group_name, {mean} AS avg FROM (SELECT cell_id, gene, value / (SELECT max(value) FROM expression) AS value FROM dense) d JOIN labels l USING (cell_id) GROUP BY 1, 2, 3)",
    )


def _hill(x: str) -> str:
    return f"({x}) / (0.5::DOUBLE + ({x}))"


def MODEL(nboot: int, mean: str = TRI) -> tuple[str, ...]:
    """expr_names, factors, sides and scores."""
    factor = lambda c, f: f"LEFT JOIN factors {c} ON {c}.name = i.{f} AND {c}.perm = g.perm AND {c}.group_name = g.group_name"
    return (
        *AVGS(nboot, mean),
        "names AS (SELECT ligand AS name FROM interaction UNION SELECT receptor FROM interaction)",
        "expr_names AS (SELECT name, perm, group_name, avg AS expr FROM names JOIN avgs ON gene = name UNION ALL SELECT n.name, perm, group_name, exp(avg(ln(greatest(avg, 1e-10)))) FROM names n JOIN complex_member m ON m.name = n.name JOIN avgs a ON a.gene = m.gene WHERE n.name NOT IN (SELECT gene FROM genes) GROUP BY 1, 2, 3)",
        f"factors AS (SELECT name, perm, group_name, product(1 + avg) AS one, product(1 + {_hill('avg')}) AS ago, product(0.5::DOUBLE / (0.5::DOUBLE + avg)) AS anta FROM cofactor_member JOIN avgs USING (gene) GROUP BY 1, 2, 3)",
        "sides AS (SELECT i.lr_id, g.perm, g.group_name, coalesce(l.expr, 0) AS l, coalesce(r.expr, 0) * coalesce(a.one, 1) / coalesce(b.one, 1) AS r, coalesce(c.ago, 1) AS ago, coalesce(d.anta, 1) AS anta FROM interaction i CROSS JOIN (SELECT DISTINCT perm, group_name FROM avgs) g "
        "LEFT JOIN expr_names l ON l.name = i.ligand AND l.perm = g.perm AND l.group_name = g.group_name LEFT JOIN expr_names r ON r.name = i.receptor AND r.perm = g.perm AND r.group_name = g.group_name "
        + " ".join(factor(*x) for x in (("a", "co_a_receptor"), ("b", "co_i_receptor"), ("c", "agonist"), ("d", "antagonist"))) + ")",
        f"scores AS (SELECT s.perm, s.group_name AS source, t.group_name AS target, s.lr_id, {_hill('s.l * t.r')} * (s.ago * t.ago) * (s.anta * t.anta) AS prob FROM sides s JOIN sides t ON s.lr_id = t.lr_id AND s.perm = t.perm)",
    )


def NET(nboot: int, mean: str = TRI) -> tuple[str, ...]:
    return (
        *MODEL(nboot, mean),
        f"net AS (SELECT o.source, o.target, o.lr_id, round(o.prob, 12) AS prob, count(*) FILTER (round(s.prob, 12) >= round(o.prob, 12)) / {nboot}::DOUBLE AS pval FROM scores o JOIN scores s ON s.perm >= 0 AND s.source = o.source AND s.target = o.target AND s.lr_id = o.lr_id WHERE o.perm = -1 GROUP BY o.source, o.target, o.lr_id, o.prob)",
    )


def NETP(nboot: int) -> tuple[str, ...]:
    return (
        *NET(nboot),
        "agg AS (SELECT source, target, count(*) FILTER (prob > 0 AND pval < 0.05) AS n, sum(CASE WHEN pval <= 0.05 THEN prob ELSE 0 END) AS weight FROM net GROUP BY 1, 2)",
        "paths AS (SELECT source, target, pathway_name AS pathway, sum(CASE WHEN pval > 0.05 THEN 0 ELSE prob END) AS prob FROM net JOIN interaction USING (lr_id) GROUP BY 1, 2, 3)",
        "netp AS (SELECT source, target, pathway, prob, dense_rank() OVER (ORDER BY total DESC, pathway) AS rank FROM (SELECT *, sum(prob) OVER (PARTITION BY pathway) AS total FROM paths) WHERE total > 0)",
        "supports AS (SELECT pathway, source, target FROM netp WHERE prob > 0)",
        "similarity AS (SELECT x.pathway AS pathway_a, y.pathway AS pathway_b, coalesce(n, 0)::DOUBLE / (x.k + y.k - coalesce(n, 0)) AS sim FROM (SELECT pathway, count(*) AS k FROM supports GROUP BY 1) x CROSS JOIN (SELECT pathway, count(*) AS k FROM supports GROUP BY 1) y LEFT JOIN (SELECT a.pathway AS pa, b.pathway AS pb, count(*) AS n FROM supports a JOIN supports b USING (source, target) GROUP BY 1, 2) ON pa = x.pathway AND pb = y.pathway)",
    )


SPACE = (
    *BASE,
    "coords AS (SELECT vec_id AS cell_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)",
    "spots AS (SELECT vec_id AS cell_id, 'g' || label AS group_name FROM embeddings)",
    "spot_expression AS (SELECT cell_id, 'Brand#' || (d - 2) AS gene, v::DOUBLE AS value FROM (SELECT vec_id AS cell_id, unnest(range(3, 27)) AS d, unnest(embedding[3:26]) AS v FROM embeddings) WHERE v > 0)",
    "soft AS (SELECT spot_id, 't' || d AS type, v::DOUBLE AS v FROM (SELECT vec_id AS spot_id, unnest(range(0, 4)) AS d, unnest(embedding[31:34]) AS v FROM embeddings) WHERE v > 0)",
    "proportions AS (SELECT spot_id, type, v / sum(v) OVER (PARTITION BY spot_id) AS w FROM soft)",
    "pairs AS (SELECT a.cell_id AS src, b.cell_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM coords a JOIN coords b ON a.cell_id <> b.cell_id)",
    "edges AS (SELECT src, dst, sqrt(d2) AS dist, sqrt(d2) <= 0.01 AS contact FROM pairs WHERE d2 > 0 AND d2 <= 0.05::DOUBLE * 0.05::DOUBLE)",
    "p_spatial AS (SELECT src, dst, contact, 1 / dist AS p FROM edges UNION ALL SELECT cell_id, cell_id, false, (SELECT 1 / min(dist) FROM edges) FROM coords)",
    "spot_genes AS (SELECT 'Brand#' || i AS gene FROM range(1, 25) t(i))",
    "spot_names AS (SELECT ligand AS name FROM interaction UNION SELECT receptor FROM interaction)",
    "spot_units AS (SELECT m.name, m.gene FROM complex_member m WHERE m.name IN (SELECT name FROM spot_names) AND m.name NOT IN (SELECT gene FROM spot_genes) AND m.gene IN (SELECT gene FROM spot_genes))",
    "cell_names AS (SELECT name, cell_id, value AS expr FROM spot_names JOIN spot_expression ON gene = name UNION ALL SELECT u.name, c.cell_id, exp(avg(ln(greatest(coalesce(e.value, 0), 1e-10)))) FROM spot_units u CROSS JOIN coords c LEFT JOIN spot_expression e ON e.cell_id = c.cell_id AND e.gene = u.gene GROUP BY 1, 2 HAVING count(e.value) > 0)",
    "ls AS (SELECT lr_id, cell_id, expr AS l FROM interaction JOIN cell_names ON name = ligand)",
    "rs AS (SELECT lr_id, cell_id, expr AS r FROM interaction JOIN cell_names ON name = receptor)",
    "least_cells AS (SELECT greatest(1, floor(count(*) * 0.01)) AS k FROM coords)",
    "usable AS (SELECT lr_id, coalesce(interaction_type LIKE '%Cell-Cell Contact%', false) AS touching FROM interaction WHERE lr_id IN (SELECT lr_id FROM ls GROUP BY 1 HAVING count(*) >= (SELECT k FROM least_cells)) AND lr_id IN (SELECT lr_id FROM rs GROUP BY 1 HAVING count(*) >= (SELECT k FROM least_cells)))",
    "prob_cell AS (SELECT src, dst, u.lr_id, l * r / (0.5::DOUBLE + l * r) * p AS prob FROM usable u JOIN ls ON ls.lr_id = u.lr_id JOIN p_spatial e ON e.src = ls.cell_id AND (NOT touching OR contact) JOIN rs ON rs.lr_id = u.lr_id AND rs.cell_id = e.dst)",
)
