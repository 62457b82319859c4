"""Scores of cells within a radius against plain loops, and what they leave in the shared folder."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_space_graph import coords

from synapsis.operators import distances, graph, spatial, tiles
from synapsis.plans.storage import shared_folder
from synapsis.schema import INTERACTION, MEMBER, Database, Params, SpatialParams

SP = SpatialParams(interaction_range=2.0, contact_range=0.5, ratio=1.0, tol=0.0, scale_distance=1.0)


def stored() -> int:
    from pyspark.sql import SparkSession

    return sum(f.stat().st_size for f in Path(shared_folder(SparkSession.active()).removeprefix("file://")).rglob("*") if f.is_file())


def world(spark, n, pairs=18, side=6.0, seed=3):
    """Cells, half of them without one of the genes, pairs of genes (every third by contact), and the plain scores."""
    rng = np.random.default_rng(seed)
    xy = np.round(rng.random((n, 2)) * side - side / 2, 2)
    xy[1] = xy[0]
    value = np.where(rng.random((n, 4)) < 0.5, rng.random((n, 4)), 0)
    genes = spark.createDataFrame([(f"G{g}",) for g in range(4)], "gene string")
    expression = spark.createDataFrame([(i, f"G{g}", float(value[i, g])) for i in range(n) for g in range(4) if value[i, g]] + [(n, "G0", 0.5), (n, "G1", 0.5)], "cell_id long, gene string, value double")
    lr = [(100 + k, f"I{k}", "P", f"G{k % 4}", f"G{(k // 4 + k) % 4}", None, None, None, None, "Cell-Cell Contact" if k % 3 == 0 else "Secreted Signaling") for k in range(pairs)]
    db = Database(spark.createDataFrame(lr, INTERACTION), spark.createDataFrame([], MEMBER), spark.createDataFrame([], MEMBER))
    places = coords(spark, xy).unionByName(spark.createDataFrame([(n, None, 1.0)], "cell_id long, x double, y double"))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    top = 1 / d[(d > 0) & (d <= 2)].min()
    value, d = np.vstack([value, [0.5, 0.5, 0, 0]]), np.pad(d, ((0, 1), (0, 1)), constant_values=99.0)
    want = {}
    for k in range(pairs):
        for i in range(n + 1):
            for j in range(n + 1):
                x = value[i, k % 4] * value[j, (k // 4 + k) % 4]
                p = (0 if k % 3 == 0 else top) if i == j else 1 / d[i, j] if 0 < d[i, j] <= (0.5 if k % 3 == 0 else 2) else 0
                if x and p:
                    want[i, j, 100 + k] = x / (0.5 + x) * p
    return (expression, genes, places, db, SP, Params()), want


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles.tiles, "__defaults__", (5,))


def test_blocks_hold_every_near_pair(monkeypatch):
    monkeypatch.setattr(tiles, "AREA", 64)
    rng = np.random.default_rng(6)
    a, b = (rng.random((n, 2)) * 3 for n in (50, 70))
    a, b = (tuple(x[np.argsort(x[:, 0])].T) for x in (a, b))
    got = np.full((50, 70), np.inf)
    for i, j, d2 in tiles.blocks(a, b, 0.7):
        got[i, j] = d2
    want = (a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2
    assert (np.where(got <= 0.49, got, 0) == np.where(want <= 0.49, want, 0)).all()


def test_prob_cell_against_loops(spark, small_tiles):
    args, want = world(spark, 60)
    got = {(r.src, r.dst, r.lr_id): r.prob for r in spatial.prob_cell(*args).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_scores_are_not_stored(spark):
    args, _ = world(spark, 20)
    n = 1200
    places = spark.range(n).select(F.col("id").alias("cell_id"), (F.col("id") % 40 / 40.0).alias("x"), (F.col("id") / n).alias("y"))
    expression = spark.range(n).select(F.col("id").alias("cell_id"), F.explode(F.array(*(F.lit(f"G{g}") for g in range(4)))).alias("gene"), F.lit(0.5).alias("value"))
    before = stored()
    assert spatial.prob_cell(expression, args[1], places, *args[3:]).count() > n * n * 12  # 17 million rows
    assert stored() - before < 20_000_000


def test_cell_to_group_and_permutations(spark, small_tiles):
    args, want = world(spark, 40)
    cells = spark.createDataFrame([(i, "abc"[i % 3] if i else None) for i in range(41)], "cell_id long, group_name string")
    scores = spatial.cell_scores(*args)
    plain = {}
    for (i, j, k), v in want.items():
        key = ("abc"[i % 3] if i else None, "abc"[j % 3] if j else None, k)
        plain[key] = plain.get(key, 0) + v
    got = {(r.source, r.target, r.lr_id): r.prob for r in spatial.cell_to_group(scores, cells).collect()}
    assert got == pytest.approx(plain, rel=1e-9)
    rows = scores.rows()
    old = {(r.source, r.target, r.lr_id): (r.prob, r.pval) for r in spatial.avg_commun_prob(rows, cells, 4).collect()}
    new = {(r.source, r.target, r.lr_id): (r.prob, r.pval) for r in spatial.avg_commun_prob(scores, cells, 4).collect()}
    assert {k: v[0] for k, v in new.items()} == pytest.approx({k: v[0] for k, v in old.items()}, rel=1e-9)
    assert {k: v[1] for k, v in new.items()} == {k: v[1] for k, v in old.items()}


def test_soft_types(spark, small_tiles):
    args, want = world(spark, 40)
    rng = np.random.default_rng(1)
    w = np.where(rng.random((41, 3)) < 0.6, rng.random((41, 3)), 0)
    soft = spark.createDataFrame([(i, "xyz"[t], float(w[i, t])) for i in range(41) for t in range(3)], "spot_id long, type string, w double")
    plain = {}
    for (i, j, k), v in want.items():
        for a in range(3):
            for b in range(3):
                if w[i, a] and w[j, b]:
                    plain.setdefault(("xyz"[a], "xyz"[b], k), []).append(w[i, a] * v * w[j, b])
    scores = spatial.cell_scores(*args)
    got = {(r.source, r.target, r.lr_id): r.prob for r in spatial.spot_prob(scores, soft).collect()}
    assert got == pytest.approx({k: np.mean(v) for k, v in plain.items()}, rel=1e-9)
    test = {(r.source, r.target, r.lr_id): r.pval for r in spatial.spot_test(scores, soft, nboot=6).collect()}
    assert test == {(r.source, r.target, r.lr_id): r.pval for r in spatial.spot_test(scores.rows(), soft, nboot=6).collect()}


def test_colocalization_keeps_no_pairs(spark):
    n = 1500
    places = spark.range(n).select(F.col("id").alias("cell_id"), (F.col("id") % 2 / 10.0).alias("x"), F.lit(0.0).alias("y"))
    cells = spark.range(n).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("group_name"))
    before = stored()
    got = {(r.source, r.target): r.n for r in spatial.colocalization(places, cells, 1.0, 2).collect()}
    assert got == {("a", "a"): 500 * 500, ("a", "b"): 500 * 1000, ("b", "a"): 500 * 1000, ("b", "b"): 1000 * 1000}
    assert stored() - before < 3_000_000
    lost = spark.createDataFrame([(1, None, None), (2, 0.0, 0.0), (3, 0.0, 0.0)], "cell_id long, x double, y double")
    assert [r.n for r in spatial.colocalization(lost, lost.select("cell_id", F.lit("a").alias("group_name")), 1.0, 1).collect()] == [5]


def test_knn_of_a_dense_square(spark):
    """Two thousand cells within the first radius: all pairs of them would be four million rows."""
    n, k = 2000, 5
    xy = np.round(np.random.default_rng(5).random((n, 2)) / 10, 3)
    xy[:40] = xy[0]
    before = stored()
    got = {}
    for r in sorted(graph.knn(coords(spark, xy), k, 0.2).collect()):
        got.setdefault(r.cell_id, []).append(r.neighbor_id)
        assert r["rank"] == len(got[r.cell_id])
    x, y = xy[:, 0], xy[:, 1]
    for i in range(n):
        d2 = (x - x[i]) * (x - x[i]) + (y - y[i]) * (y - y[i])
        d2[i] = -1
        assert got[i] == np.lexsort((np.arange(n), d2))[:k].tolist()
    assert stored() - before < 2_000_000
    calls = []
    real = spatial.range_pairs
    spatial.range_pairs = lambda *a: calls.append(a) or real(*a)
    try:
        graph.knn(coords(spark, xy), k, 0.2).count()
    finally:
        spatial.range_pairs = real
    assert not calls


def test_medians_of_all_distances(spark, monkeypatch):
    """Against numpy, with blocks of a few points, and with two passes of a few steps before the values."""
    rng = np.random.default_rng(2)
    for n, digits, leave in ((90, 1, 1 << 21), (121, 6, 1 << 21), (90, 6, 40), (60, 0, 5), (1, 1, 5)):
        monkeypatch.setattr(distances, "BLOCK", 16)
        monkeypatch.setattr(distances, "STEPS", 8 if leave < 100 else 2048)
        monkeypatch.setattr(distances, "LEAVE", leave)
        xy = np.round(rng.normal(size=(n, 2)), digits)
        c = coords(spark, xy)
        dx, dy = (xy[:, None, k] - xy[None, :, k] for k in (0, 1))
        d = np.sqrt(dx * dx + dy * dy)
        assert spatial.median_distance(c) == ((float(np.median(d[d > 0])), int((d > 0).sum())) if (d > 0).any() else (0.0, 0))
        cells = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(n)], "cell_id long, group_name string")
        got = {(r.source, r.target): r.dist for r in spatial.region_distance(c, cells, 2.0).collect()}
        label = np.arange(n) % 4
        want = {("abcd"[a], "abcd"[b]): 2 * float(np.median(d[label == a][:, label == b])) if a != b else 0.0 for a in range(min(n, 4)) for b in range(min(n, 4))}
        assert got == pytest.approx(want, rel=1e-14)


def test_median_of_two_large_groups(spark):
    n = 3000
    xy = np.random.default_rng(4).random((n, 2))
    c = coords(spark, xy)
    cells = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(n)], "cell_id long, group_name string")
    d = np.sqrt(((xy[::2, None] - xy[None, 1::2]) ** 2).sum(2))
    got = {(r.source, r.target): r.dist for r in spatial.region_distance(c, cells).collect()}
    assert got["a", "b"] == pytest.approx(float(np.median(d)), rel=1e-14) and got["b", "a"] == got["a", "b"]


def test_tiles_of_every_size(spark):
    """Each pair within the radius once, from tiles of four radii to a quarter; few copies of a cell where tiles are large."""
    n, reach = 1500, 0.25
    xy = np.random.default_rng(7).integers(-128, 128, (n, 2)) / 64  # on the tiles' edges, and many of them on one place
    cells = coords(spark, xy).select("cell_id", F.lit(0).alias("slice"), "x", "y").unionByName(spark.createDataFrame([(n, 0, None, 1.0)], "cell_id long, slice int, x double, y double"))
    want = int((((xy[:, None] - xy[None]) ** 2).sum(2) <= reach * reach).sum()) + 1
    weights = cells.select("cell_id", F.array(F.lit(0)).alias("columns"))
    rows = {}
    for chunk in (5000, 400, 100, 30, 10, 3):
        made = tiles.tiles(cells, cells, reach, chunk)
        rows[chunk] = made.where("side = 1").count()
        assert made.where("side = 0").count() == n + 1
        both = tiles.tiles(cells.join(weights, "cell_id"), cells.join(weights, "cell_id"), reach, chunk)
        got = both.mapInArrow(tiles.sums_of(tiles.Within(reach), 1, 1, False), spatial._SUMS)
        assert got.agg(F.sum("total")).first()[0] == want
    assert n < rows[5000] < 3 * n and rows[5000] < rows[100] < rows[3]


def test_names_do_not_shuffle_expression(spark):
    """Knowledge-base tables come with their sizes, so that cells' values meet them where they are."""
    args, _ = world(spark, 20)
    for side in spatial.cell_expression(args[0], args[1], args[3]):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_middle_found_in_fewer_looks(spark, monkeypatch):
    """Two looks at all pairs, as a few points say where the middle is; where they are wrong, all distances are counted."""
    n = 3000
    monkeypatch.setattr(distances, "STEPS", 64)
    monkeypatch.setattr(distances, "LEAVE", 8000)
    xy = np.random.default_rng(8).random((n, 2))
    points = spark.createDataFrame([(i % 2, float(x), float(y), 1) for i, (x, y) in enumerate(xy)], "g int, x double, y double, w long")
    d = np.sqrt(((xy[::2, None] - xy[None, 1::2]) ** 2).sum(2))
    want = float(np.median(d)), d.size
    looks, real = [], type(points).mapInArrow
    monkeypatch.setattr(type(points), "mapInArrow", lambda self, *a: looks.append(1) or real(self, *a))
    assert distances.medians(points, same=False)[0, 1] == pytest.approx(want, rel=1e-14)
    assert len(looks) == 2
    heavy = points.withColumn("w", F.when(F.col("x") < 0.1, 5).otherwise(1).cast("long"))
    many = np.where(xy[:, 0] < 0.1, 5, 1)
    wide = np.repeat(np.repeat(d, many[::2], 0), many[1::2], 1)
    assert distances.medians(heavy, same=False)[0, 1] == pytest.approx((float(np.median(wide)), wide.size), rel=1e-14)
    for wrong in ((1e-9, 2e-9), (1.5, 1.6)):
        monkeypatch.setattr(distances, "_intervals", lambda *a, wrong=wrong: {(0, 1): wrong})
        assert distances.medians(points, same=False)[0, 1] == pytest.approx(want, rel=1e-14)


def test_permuted_labels_are_not_stored_as_rows(spark):
    """What a test by permutation leaves: a row for each cell, not for each cell and permutation."""
    n, nboot = 3000, 40
    places = spark.range(n).select(F.col("id").alias("cell_id"), (F.col("id") % 60 / 2.0).alias("x"), F.floor(F.col("id") / 60).cast("double").alias("y"))
    cells = spark.range(n).select(F.col("id").alias("cell_id"), F.concat(F.lit("a group of a long name "), F.col("id") % 7).alias("group_name"))
    before = stored()
    got = {(r.source, r.target): r.n for r in spatial.colocalization(places, cells, 0.1, nboot).collect()}
    assert sum(got.values()) == n and all(a == b for a, b in got)
    assert stored() - before < 600_000
