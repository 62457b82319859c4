import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from synapsis.functions import hill, hill_inverse, hill_lut, register
from synapsis.operators import aggregate, preprocess
from synapsis.schema import CELLS, EXPRESSION, GENES, MeanMethod, check


def relations(spark, values, groups):
    """One gene with these values, zeros left out, in cells of these groups."""
    cells = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], CELLS)
    rows = [(i, "G", float(v)) for i, v in enumerate(values) if v]
    return spark.createDataFrame(rows, EXPRESSION), cells, spark.createDataFrame([("G",), ("EMPTY",)], GENES)


def avg(spark, values, method, trim=0.1, gene="G"):
    e, c, g = relations(spark, values, ["a"] * len(values))
    return {r.gene: r.avg for r in aggregate.group_aggregate(e, c, g, method, trim).collect()}[gene]


@pytest.mark.parametrize("method,values,trim,want", [
    ("triMean", [5], 0.1, 5), ("triMean", [1, 2, 3, 4, 5], 0.1, 3), ("median", [1, 2, 3], 0.1, 2), ("median", [1, 2, 3, 4], 0.1, 2.5),
    ("truncatedMean", list(range(1, 11)), 0.1, 5.5), ("thresholdedMean", [0, 1, 2, 0, 3], 0.5, 1.2), ("thresholdedMean", [0, 5, 0, 0, 0], 0.5, 0),
    ("mean", [1, 2, 3, 4], 0.1, 2.5), ("truncatedMean", [1, 2, 9], 0.5, 2),
])
def test_closed_forms(spark, method, values, trim, want):
    assert avg(spark, values, method, trim) == pytest.approx(want)


def test_all_zero_gene_is_there(spark):
    assert avg(spark, [1, 2], "triMean", gene="EMPTY") == 0


def test_geometric_mean(spark):
    e, c, g = relations(spark, [1, 4, 16], ["a"] * 3)
    got = {r.gene: r.avg for r in aggregate.geometric_mean(e, c, g).collect()}
    assert got["G"] == pytest.approx(4) and got["EMPTY"] == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from("ab")), min_size=2, max_size=25))
def test_sparse_equals_dense(spark, rows):
    values, groups = [r[0] for r in rows], [r[1] for r in rows]
    e, c, g = relations(spark, values, groups)
    for method, of in (("triMean", lambda v: np.quantile(v, [0.25, 0.5, 0.5, 0.75]).mean()), ("median", np.median), ("mean", np.mean)):
        got = {r.group_name: r.avg for r in aggregate.group_aggregate(e, c, g, MeanMethod(method)).where("gene = 'G'").collect()}
        for k in set(groups):
            assert got[k] == pytest.approx(of([v for v, x in rows if x == k]))


def test_unlabelled_cells_are_left_out(spark):
    cells = spark.createDataFrame([(0, "a"), (1, None)], CELLS)
    assert [tuple(r) for r in aggregate.group_counts(cells).collect()] == [("a", 1)]


def test_hill(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1e15,), (0.7,), (-1.0,)], "x double")
    rows = df.select("x", hill(F.col("x")).alias("h"), hill_inverse(F.col("x")).alias("i"), hill_lut(F.col("x")).alias("l")).collect()
    want = {0.0: 0, 0.5: 0.5, 1.0: 1 / 1.5, 1e15: 1, -1.0: 0}
    for r in rows:
        assert r.h + r.i == pytest.approx(1) and r.l == pytest.approx(r.h, abs=1e-4)
        assert r.x not in want or r.h == pytest.approx(want[r.x])
    register(spark)
    assert spark.sql("SELECT hill(0.5D, 0.5D, 1D) + hill_inverse(100D, 0.5D, 1D) + tri_mean_of(1D, 2D, 3D)").first()[0] == pytest.approx(0.5 + 0.5 / 100.5 + 2)


def test_check_names_what_is_missing(spark):
    with pytest.raises(ValueError, match="gene"):
        check(spark.range(1), EXPRESSION, "expression")


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.2, 0.04]
    got = {(r.i): r.p_adj for r in preprocess.adjust_bh(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    order = np.argsort(p)
    ranked = np.array(p)[order] * 5 / np.arange(1, 6)
    want = np.minimum.accumulate(ranked[::-1])[::-1]
    for k, i in enumerate(order):
        assert got[int(i)] == pytest.approx(max(want[k], min(w for w, j in zip(want, order) if p[j] == p[i])), rel=1e-9) or got[int(i)] == pytest.approx(want[k])


def test_over_expressed_finds_the_planted_gene(spark):
    cells = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(40)], CELLS)
    rows = [(i, "UP", 5.0 + i % 3) for i in range(20)] + [(i, "FLAT", 1.0 + i % 2) for i in range(40)]
    e, g = spark.createDataFrame(rows, EXPRESSION), spark.createDataFrame([("UP",), ("FLAT",)], GENES)
    got = preprocess.over_expressed(e, cells, g).collect()
    assert [(r.gene, r.cluster) for r in got] == [("UP", "a")] and got[0].pval < 1e-6


def test_empty_tables(spark):
    e, c, g = spark.createDataFrame([], EXPRESSION), spark.createDataFrame([], CELLS), spark.createDataFrame([], GENES)
    assert aggregate.group_aggregate(e, c, g).count() == 0 and preprocess.normalize(e).count() == 0


def test_rounded_lut_is_the_rounded_hill(spark):
    df = spark.range(1, 200001).select((F.col("id") / 150000.0).alias("x"))
    for n in (1.0, 2.0, 3.0):
        both = df.select(hill_lut(F.col("x"), n=n, digits=4).alias("l"), F.round(hill(F.col("x"), n=n), 4).alias("h"), F.round(hill_lut(F.col("x"), n=n), 4).alias("old"))
        assert both.where("l <> h").count() == 0
        assert n != 1 or both.where("old <> h").count() > 0
