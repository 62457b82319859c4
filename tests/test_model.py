import random

import numpy as np
import pytest

from synapsis.operators import lrdb, model, network, permute
from synapsis.schema import CELLS, EXPRESSION, GENES, INTERACTION, MEMBER, Database, Dataset, MeanMethod, Params
from synapsis.sources import adapter, store, synthetic

AVGS = "gene string, group_name string, avg double"


def test_single_and_complex(spark):
    avgs = spark.createDataFrame([("A", "g", 0.1), ("B", "g", 0.4), ("AB", "h", 0.3)], AVGS)
    members = spark.createDataFrame([("AB", "A"), ("AB", "B"), ("CX", "A"), ("CX", "B"), ("CX", "NOWHERE"), ("NO", "NOWHERE")], MEMBER)
    names = spark.createDataFrame([("A",), ("AB",), ("CX",), ("NO",)], "name string")
    got = {(r.name, r.group_name): r.expr for r in model.expr_names(names, avgs, members).collect()}
    assert got == {("A", "g"): 0.1, ("AB", "h"): 0.3, ("CX", "g"): pytest.approx(0.2)}  # a gene goes before a complex; unmeasured units are skipped


def test_cofactors(spark):
    avgs = spark.createDataFrame([("X", "g", 0.5), ("Y", "g", 1.0)], AVGS)
    members, names = spark.createDataFrame([("F", "X"), ("F", "Y"), ("F", "Z")], MEMBER), spark.createDataFrame([("F",)], "name string")
    one = lambda df: df.first().f
    assert one(model.coreceptor(avgs, members, names)) == pytest.approx(1.5 * 2)
    assert one(model.coreceptor(avgs, members, names, False)) == pytest.approx(1 / 3)
    assert one(model.agonist(avgs, members, names)) == pytest.approx(1.5 * (1 + 1 / 1.5))
    assert one(model.antagonist(avgs, members, names)) == pytest.approx(0.5 * 0.5 / 1.5)


def test_members_skip_blanks(spark):
    wide = spark.createDataFrame([("AB", "A", "B", "")], "name string, subunit_1 string, subunit_2 string, subunit_3 string")
    assert sorted(r.gene for r in lrdb.members(wide, "subunit").collect()) == ["A", "B"]


def test_permutations_keep_sizes_and_rerun(spark):
    cells = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(31)] + [(99, None)], CELLS)
    a, b = (permute.permuted_labels(cells, 4, 7).orderBy("perm", "cell_id").collect() for _ in range(2))
    assert a == b and len(a) == 4 * 31
    for k in range(4):
        labels = [r.group_name for r in a if r.perm == k]
        assert {g: labels.count(g) for g in "abc"} == {"a": 11, "b": 10, "c": 10}
    assert len({tuple(r.group_name for r in a if r.perm == k) for k in range(4)}) == 4


def test_kernel_equals_sql(spark):
    cells = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(12)], CELLS)
    e = spark.createDataFrame([(i, g, float((i * 7 + ord(g)) % 5)) for i in range(12) for g in "LRC" if (i + ord(g)) % 3], EXPRESSION)
    lr = spark.createDataFrame([(1, "L_R", "P", "L", "R", None, None, None, None, None), (2, "L_NO", "P", "L", "NO", "F", "", "F", None, None)], INTERACTION)
    db = Database(lr, spark.createDataFrame([], MEMBER), spark.createDataFrame([("F", "C")], MEMBER))
    data = Dataset(e, cells, spark.createDataFrame([("L",), ("R",), ("C",)], GENES))
    for method in (MeanMethod.TRI_MEAN, MeanMethod.MEDIAN):
        p = Params(mean_method=method, nboot=6)
        a, b = (permute.commun_prob(data, db, p, plan).orderBy("source", "target", "lr_id").collect() for plan in ("kernel", "sql"))
        assert a == b
        for r in a:
            assert r.pval * 6 == pytest.approx(round(r.pval * 6)) and (r.prob > 0 or r.pval == 1)


def test_averages_of_all_plans(spark):
    """Genes dense and sparse, many ties, negative values, cells without a label, a gene without any value."""
    rng = random.Random(3)
    cells = spark.createDataFrame([(i, rng.choice(["a", "b", "c", "c", None])) for i in range(200)], CELLS)
    density = {"A": 0.95, "B": 0.5, "C": 0.2, "D": 0.7}
    rows = [(i, g, rng.choice([1.0, 1.0, 2.0, -1.0, rng.random()])) for i in range(200) for g in density if rng.random() < density[g]]
    e, genes = spark.createDataFrame(rows, EXPRESSION), spark.createDataFrame([(g,) for g in "ABCDE"], GENES)
    label = {(r.perm, r.cell_id): r.group_name for r in permute.permuted_labels(cells, 2, observed=True).collect()}
    size = {g: sum(1 for (k, _), x in label.items() if k == -1 and x == g) for g in "abc"}
    for method, at in ((MeanMethod.TRI_MEAN, (25, 50, 75)), (MeanMethod.MEDIAN, (50,))):
        want = {}
        for k in (-1, 0, 1):
            for gene in "ABCDE":
                for g in "abc":
                    v = [x for i, name, x in rows if name == gene and label.get((k, i)) == g]
                    q = np.percentile(v + [0.0] * (size[g] - len(v)), at)
                    want[k, gene, g] = pytest.approx((q[0] + 2 * q[1] + q[2]) / 4 if len(q) == 3 else q[0])
        p = Params(mean_method=method, nboot=2)
        plans = [permute.sorted_gene_kernel(e, cells, genes, p)] + [permute.split_gene_averages(e, cells, genes, p, n) for n in (1 << 16, 7)]
        for avgs in plans:
            got = avgs.collect()
            assert len(got) == len(want) and {(r.perm, r.gene, r.group_name): r.avg for r in got} == want
    none = e.limit(0)
    assert {r.avg for r in permute.split_gene_averages(none, cells, genes, p).collect()} == {0.0}
    assert permute.split_gene_averages(e, cells.limit(0), genes, p).count() == 0


def test_split_equals_kernel(spark, sf):
    data, db, p = adapter.dataset(spark, sf), adapter.database(spark), Params(nboot=3)
    a, b = (permute.commun_prob(data, db, p, plan).orderBy("source", "target", "lr_id").collect() for plan in ("kernel", "split"))
    assert a == b and any(r.prob > 0 for r in a)


def test_fast_parameters():
    assert Params.fast().mean_method is MeanMethod.MEDIAN and Params.fast().nboot == 50 and Params.fast(nboot=7).nboot == 7


def test_save_and_load(spark, tmp_path):
    net = spark.createDataFrame([("a", "b", 1, 0.5, 0.0), ("b", "a", 1, 0.2, 1.0)], "source string, target string, lr_id int, prob double, pval double")
    lr = adapter.database(spark).interaction
    cells = spark.createDataFrame([(0, "a"), (1, "b")], CELLS)
    store.save(f"file://{tmp_path}/r", net, lr, cells, {"nboot": 1})
    back = store.load(spark, f"file://{tmp_path}/r")
    assert back["summary"]["n_interactions"] == 1 and back["summary"]["groups"] == ["a", "b"]
    assert sorted(map(tuple, back["net"].collect())) == sorted(map(tuple, net.collect()))
    assert {(r.source, r.b) for r in back["net_weight"].collect()} == {("a", "0.5"), ("b", "0.0")}
    assert store.load(spark, f"file://{tmp_path}/nothing") == {}


def test_load_database(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    with pytest.raises(FileNotFoundError):
        store.load_database(spark, root, "Human")
    spark.createDataFrame([("L_R", "P", "L", "R", None, "", "C", None)], "interaction_name string, pathway_name string, ligand string, receptor string, agonist string, antagonist string, co_A_receptor string, co_I_receptor string").write.parquet(f"{root}/human/interaction.parquet")
    spark.createDataFrame([("AB", "A", "")], "name string, subunit_1 string, subunit_2 string").write.parquet(f"{root}/human/complex.parquet")
    spark.createDataFrame([("C", "X", "Y")], "name string, cofactor1 string, cofactor2 string").write.parquet(f"{root}/human/cofactor.parquet")
    spark.createDataFrame([("X",)], "Symbol string").write.parquet(f"{root}/human/geneInfo.parquet")
    db = store.load_database(spark, root, "Human")
    genes = spark.createDataFrame([("L",), ("X",), ("Q",)], GENES)
    assert sorted(r.gene for r in lrdb.signaling_genes(db, genes).collect()) == ["L", "X"]
    assert [r.gene for r in lrdb.signaling_genes(db, genes, ["X"]).collect()] == ["X"]
    assert db.interaction.first().lr_id == 1


def test_wide_and_synthetic(spark):
    wide = spark.createDataFrame([(1, "a", 0.0, 2.0, 5.0, 1.0), (2, "b", 1.0, 0.0, 4.0, None)], "cell_id long, kind string, x double, y double, G1 double, G2 double")
    data = store.from_wide(wide, "kind", spatial=("x", "y"))
    assert data.datatype == "spatial" and data.expression.count() == 3 and data.genes.count() == 2
    with pytest.raises(ValueError):
        store.from_wide(wide, "nothing")
    made = synthetic.structured(spark, 50, 5, 100)
    assert made.cells.count() == 50 and made.expression.agg({"value": "min"}).first()[0] >= 2 and synthetic.spatial(spark, 10).count() == 10


def test_filters_and_ranks_of_nothing(spark):
    net = spark.createDataFrame([], "source string, target string, lr_id int, prob double, pval double")
    lr = adapter.database(spark).interaction
    assert network.pathway_network(net, lr).count() == 0 and network.aggregate_net(net).count() == 0
    assert network.compare(network.merge([network.aggregate_net(net)], ["a"]), "a", "b").count() == 0
    with pytest.raises(ValueError):
        network.merge([net], ["a", "b"])
