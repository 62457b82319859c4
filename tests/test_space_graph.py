import numpy as np
import pytest

from synapsis.operators import graph, patterns, spatial
from synapsis.schema import CELLS, COORDS, SpatialParams


def coords(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], COORDS)


def edges(spark, points, **more):
    return {(r.src, r.dst): (r.dist, r.contact) for r in spatial.cell_edges(coords(spark, points), SpatialParams(**more)).collect()}


def test_distance_and_contact(spark):
    got = edges(spark, [(0, 0), (10, 0), (0, 10)])
    assert got[0, 1] == (10.0, True) and (0, 0) not in got
    got = edges(spark, [(0, 0), (5, 0), (100, 100)], interaction_range=250, contact_range=10, tol=5)
    assert got[0, 1][1] and not got[0, 2][1]
    got = edges(spark, [(0, 0), (1, 0), (3, 0), (10, 0), (0, 0)], interaction_range=5, contact_range=1.5, tol=0)
    assert got[0, 1] == (1.0, True) and (0, 3) not in got and got[0, 2] == (3.0, False) and (0, 4) not in got


def test_ratio_below_one(spark):
    rng = np.random.default_rng(0)
    pts = rng.random((40, 2)) * 30
    got = edges(spark, pts, interaction_range=5, contact_range=1, tol=0, ratio=0.5)
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)) * 0.5
    assert set(got) == {(i, j) for i in range(40) for j in range(40) if i != j and d[i, j] <= 5}


def test_p_spatial(spark):
    c = coords(spark, [(0, 0), (1, 0), (3, 0)])
    sp = SpatialParams(interaction_range=5, tol=0, scale_distance=0.1)
    got = {(r.src, r.dst): r.p for r in spatial.p_spatial(spatial.cell_edges(c, sp), c, sp).collect()}
    assert got[0, 1] == pytest.approx(10) and got[2, 2] == pytest.approx(10) and got[0, 2] == pytest.approx(10 / 3)
    assert {r.p for r in spatial.p_spatial(spatial.cell_edges(c, sp), c, sp, False).collect()} == {1.0}


def test_cell_to_group(spark):
    prob = spark.createDataFrame([(0, 1, 1, 0.5), (1, 2, 1, 0.3), (0, 2, 1, 0.1)], "src long, dst long, lr_id int, prob double")
    cells = spark.createDataFrame([(0, "0"), (1, "0"), (2, "1")], CELLS)
    got = {(r.source, r.target): r.prob for r in spatial.cell_to_group(prob, cells).collect()}
    assert got == {("0", "0"): pytest.approx(0.5), ("0", "1"): pytest.approx(0.4)}
    soft = spark.createDataFrame([(0, "t", 1.0), (1, "t", 0.5), (2, "u", 1.0)], "spot_id long, type string, w double")
    got = {(r.source, r.target): r.prob for r in spatial.spot_prob(prob, soft, False).collect()}
    assert got[("t", "u")] == pytest.approx(0.3 * 0.5 + 0.1)


def test_region_and_grid(spark):
    c = coords(spark, [(0, 0), (1, 0), (100, 100), (101, 100)])
    cells = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "a")], CELLS)
    got = {(r.source, r.target): r.dist for r in spatial.region_distance(c, cells).collect()}
    assert got["a", "a"] == 0 and got["a", "b"] > 50
    near = {(r.source, r.target): r.dist for r in spatial.region_distance(c, cells, bins=1000).collect()}
    assert near["a", "b"] == pytest.approx(got["a", "b"], abs=0.3)
    grid = {(r.gx, r.gy): (r.n, r.group_name) for r in spatial.grid_labels(c, cells, 10).collect()}
    assert grid == {(0, 0): (2, "a"), (10, 10): (2, "a")}  # a tie goes to the first name


def test_snn(spark):
    rows = [(i, k + 1, n) for i, near in enumerate([[1, 2, 3], [2, 1, 3], [3, 1, 4], [4, 3, 1]]) for k, n in enumerate(near)]
    knn = spark.createDataFrame(rows, "cell_id long, rank int, neighbor_id long")
    got = {(r.i, r.j): r.weight for r in graph.snn(knn, 3).collect()}
    assert got[0, 1] == 1 and got[0, 3] == 0.5 and got[2, 2] == 1
    assert (0, 3) not in {(r.i, r.j) for r in graph.snn(knn, 3, 0.6).collect()}


@pytest.mark.parametrize("k", [1, 3, 40])
def test_knn_reaches_every_cell(spark, k):
    """Clusters, twins, a far cell and one without coordinates against a full sort; more cells than there are is no error."""
    rng = np.random.default_rng(3)
    xy = np.vstack([rng.normal(0, 0.01, (9, 2)), rng.normal(5, 0.01, (2, 2)), [[5, 5], [5, 5], [900, -900]]])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(90, None, 1.0), (91, float("nan"), 1.0), (92, float("inf"), 1.0), (None, 0.0, 0.0)]
    got = [tuple(r) for r in graph.knn(spark.createDataFrame(rows, "cell_id long, x double, y double"), k, 0.02).collect()]
    assert got.count((None, 1, None)) == 1
    got = sorted(r for r in got if r[0] is not None)
    want = [(i, 1, i) for i in (90, 91, 92)]
    for i, at in enumerate(xy):
        d2 = ((xy - at) ** 2).sum(1)
        want += [(i, n + 1, int(j)) for n, j in enumerate(sorted(range(len(xy)), key=lambda j: (j != i, d2[j], j))[:k])]
    assert got == sorted(want)


def test_knn_of_nothing(spark):
    empty = spark.createDataFrame([], "cell_id long, x double, y double")
    assert graph.knn(empty, 3, 0.1).collect() == []
    with pytest.raises(ValueError):
        graph.knn(empty, 3, 0.0)


TOY = np.array([[0, 0.5, 0], [0.3, 0, 0.2], [0, 0.4, 0]])


def test_centralities():
    got = graph.centralities(TOY)
    assert all((v >= -1e-10).all() for v in got.values())
    assert got["pagerank"].sum() == pytest.approx(1) and got["betweenness"].tolist() == [0, 1, 0]
    assert all(not v.any() for k, v in graph.centralities(np.zeros((3, 3))).items() if k != "pagerank")
    # path a - b - c with unit conductances: closeness 1 / sum of resistances
    path = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0.0]])
    assert graph.information(path) == pytest.approx([1 / 3, 1 / 2, 1 / 3])


def test_pagerank_by_joins(spark):
    netp = spark.createDataFrame([("abc"[i], "abc"[j], "P", float(TOY[i, j])) for i in range(3) for j in range(3) if TOY[i, j]], "source string, target string, pathway string, prob double")
    got = {r.node: r["rank"] for r in graph.pagerank_sql(netp, 40).collect()}
    assert [got[k] for k in "abc"] == pytest.approx(graph.pagerank(TOY), abs=1e-3)
    groups = spark.createDataFrame([(g,) for g in "abc"], "group_name string")
    assert graph.centrality(netp, groups).count() == 3 * len(graph.METRICS)
    sim = {(r.pathway_a, r.pathway_b): r.sim for r in graph.network_similarity(netp).collect()}
    assert sim == {("P", "P"): 1.0}


def test_nmf_and_cophenetic():
    rng = np.random.default_rng(1)
    m = rng.random((6, 2)) @ rng.random((2, 7))
    w, h = patterns.nmf(m, 2)
    assert np.abs(w @ h - m).max() < 0.02 and (w >= 0).all() and (h >= 0).all()
    assert patterns.cophenetic(np.array([[0, 0], [0, 1], [9, 9], [9, 8.0]])) > 0.95


def random_graph(seed, n=6, share=0.6):
    rng = np.random.default_rng(seed)
    w = rng.integers(1, 4, (n, n)) * (rng.random((n, n)) < share).astype(float)
    ring = np.roll(np.eye(n), 1, axis=1)  # strongly connected, so that every value below is unique
    return np.where((w == 0) & (ring > 0), 1.0, w)


def paths(length, at, to, seen=()):
    if at == to:
        return [(0.0, (to,))]
    steps = [u for u in np.flatnonzero(length[at]) if u not in (*seen, at)]
    return [(length[at, u] + d, (at, *p)) for u in steps for d, p in paths(length, u, to, (*seen, at))]


@pytest.mark.parametrize("seed", range(8))
def test_betweenness_against_all_paths(seed):
    length = random_graph(seed, share=0.4)
    n = len(length)
    want = np.zeros(n)
    for s in range(n):
        for t in set(range(n)) - {s}:
            every = paths(length, s, t)
            short = [p for d, p in every if d == min(every)[0]]
            for v in set(range(n)) - {s, t}:
                want[v] += sum(v in p for p in short) / len(short)
    assert graph.betweenness(length) == pytest.approx(want / ((n - 1) * (n - 2)))


@pytest.mark.parametrize("seed", range(8))
def test_information_against_resistances(seed):
    w = random_graph(seed)
    u = np.maximum(w, w.T)
    np.fill_diagonal(u, 0)
    lap, n = np.diag(u.sum(1)) - u, len(u)
    far = np.zeros(n)
    for s in range(n):
        for t in set(range(n)) - {s}:
            rest = [i for i in range(n) if i != t]  # one unit goes in at s and out at t, which is grounded
            far[s] += np.linalg.solve(lap[np.ix_(rest, rest)], np.eye(n)[s][rest])[rest.index(s)]
    assert graph.information(w) == pytest.approx(1 / far)


@pytest.mark.parametrize("seed", range(8))
def test_spectral_centralities_against_eigenvectors(seed):
    w = random_graph(seed)
    n = len(w)

    def top(m):
        values, vectors = np.linalg.eig(m)
        v = np.abs(np.real(vectors[:, np.argmax(np.real(values))]))
        return v / v.sum()

    hub, authority = graph.hits(w)
    assert hub == pytest.approx(top(w @ w.T), abs=1e-5) and authority == pytest.approx(top(w.T @ w), abs=1e-5)
    assert graph.centralities(w)["eigenvector"] == pytest.approx(top((w > 0).astype(float).T), abs=1e-5)
    flow = np.linalg.solve(np.eye(n) - 0.85 * (w / w.sum(1)[:, None]).T, np.full(n, 0.15 / n))
    assert graph.pagerank(w) == pytest.approx(flow, abs=1e-9)


def test_snn_counts_pairs_once(spark, tmp_path):
    """Shuffled rows of the count: one for each pair of cells, not one for each order."""
    n, k = 400, 4
    rows = [(i, (i + s) % n) for i in range(n) for s in range(k)]
    table = spark.createDataFrame(rows, "cell_id long, neighbor_id long").repartition(1)
    out = graph.snn(table, k, 0)
    got = {(r.i, r.j): r.weight for r in out.collect()}
    near = [set(b for a, b in rows if a == i) for i in range(n)]
    want = {(i, j): s / (2 * k - s) for i in range(n) for j in range(n) if (s := len(near[i] & near[j]))}
    assert got == pytest.approx(want) and out.count() == len(want)

    def made(plan):
        """Rows that the joins of an executed plan gave out."""
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            return made(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return made(plan.plan())
        own = plan.metrics().get("numOutputRows").get().value() if "Join" in plan.nodeName() else 0
        return own + sum(made(plan.children().apply(i)) for i in range(plan.children().size()))

    plan = graph.snn(table, k, 0)._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert made(plan) == (n * k * k + n * k) // 2
