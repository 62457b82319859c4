"""Spatial operators: range edges, cell-level scores, their group sums and tests, spots, grids and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hill
from ..plans.storage import settle, small
from ..schema import Database, Params, SpatialParams
from . import distances, tiles
from .lrdb import cleaned
from .model import distinct_names
from .permute import OBSERVED, permuted_labels

CONTACT_TYPES = ("Cell-Cell Contact", "Cell-CellContact")


def range_pairs(coords: DataFrame, reach: float, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, d2) of all ordered pairs of different cells within ``reach``, in the coordinates' own unit; those of
    ``sources`` only if given.

    Grid join: a square of side ``reach`` meets its nine neighbours by an equi-join on the square, then the distance
    decides. Rows grow with cells x cells of a neighbourhood; a crowded square is an equi-join key that adaptive
    execution splits.
    """
    square = lambda c: F.floor(F.col(c) / F.lit(float(reach)))
    squares = lambda c: c.where("x is not null and y is not null").select("cell_id", "x", "y", square("x").alias("gx"), square("y").alias("gy"))
    here = squares(coords)
    a = (here if sources is None else squares(sources)).select(F.col("cell_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1)).alias("gx"), "gy")
    a = a.select("src", "x1", "y1", "gx", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)).alias("gy"))
    b = here.select(F.col("cell_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "gx", "gy")
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    return a.join(b, ["gx", "gy"]).select("src", "dst", (dx * dx + dy * dy).alias("d2")).where((F.col("src") != F.col("dst")) & (F.col("d2") <= reach * reach))


def cell_edges(coords: DataFrame, sp: SpatialParams = SpatialParams()) -> DataFrame:
    """(src, dst, dist, contact): distances in microns up to the range and its tolerance; cells on one spot have no edge."""
    reach = (sp.interaction_range + sp.tolerance) / sp.ratio
    d = F.sqrt("d2") * sp.ratio
    return range_pairs(coords, reach).where("d2 > 0").select("src", "dst", d.alias("dist"), (d <= sp.contact_range + sp.tolerance).alias("contact"))


def p_spatial(edges: DataFrame, coords: DataFrame, sp: SpatialParams = SpatialParams(), distance_use: bool = True, self_value: float | None = None) -> DataFrame:
    """(src, dst, contact, p): 1 / (distance * scale); a cell with itself has the largest of all (one if there is none), or ``self_value``.

    Without ``distance_use`` every p is one.
    """
    p = F.when(F.col("dist") > 0, 1 / (F.col("dist") * sp.scale_distance)) if distance_use else F.lit(1.0)  # guarded: filters may be pushed below
    out = edges.select("src", "dst", "contact", p.alias("p"))
    own = coords.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(False).alias("contact"))
    if not distance_use:
        return out.unionByName(own.withColumn("p", F.lit(1.0)))
    top = F.lit(float(self_value)) if self_value is not None else None
    if top is not None:
        return out.unionByName(own.withColumn("p", top))
    largest = edges.agg(F.coalesce(1 / (F.min("dist") * sp.scale_distance), F.lit(1.0)).alias("p"))
    return out.unionByName(own.join(largest).select("src", "dst", "contact", "p"))


def cell_expression(expression: DataFrame, genes: DataFrame, db: Database) -> tuple[DataFrame, DataFrame]:
    """(lr_id, cell_id, l) and (lr_id, cell_id, r), values above zero only.

    A complex with measured subunits is at least the floor's mean in every cell that has one of them; where all its
    subunits are zero its score is of the order of the floor, and left out.
    """
    lr = small(cleaned(db.interaction).select("lr_id", "ligand", "receptor"))
    measured = genes.select("gene").distinct()
    both = small(distinct_names(lr, "ligand").union(distinct_names(lr, "receptor")).distinct())
    rest = both.join(measured, F.col("name") == F.col("gene"), "left_anti")
    units = small(rest.join(db.complex_member.distinct(), "name").join(measured, "gene").select("name", "gene"))
    n_units = small(units.groupBy("name").agg(F.count("*").alias("units")))
    values = expression.where("value > 0")
    single = both.join(values, both.name == values.gene).select("name", "cell_id", F.col("value").alias("expr"))
    logs = units.join(values, "gene").groupBy("name", "cell_id").agg(F.sum(F.ln(F.greatest("value", F.lit(1e-10)))).alias("s"), F.count("*").alias("k"))
    # subunits that the cell lacks count as the floor
    whole = logs.join(n_units, "name").select("name", "cell_id", F.exp((F.col("s") + (F.col("units") - F.col("k")) * F.ln(F.lit(1e-10))) / F.col("units")).alias("expr"))
    names = single.unionByName(whole)
    side = lambda c, v: lr.select("lr_id", F.col(c).alias("name")).join(names, "name").select("lr_id", "cell_id", F.col("expr").alias(v))
    return side("ligand", "l"), side("receptor", "r")


def closest(coords: DataFrame, reach: float) -> float | None:
    """The smallest squared distance above zero within ``reach``, or None. Small radii go first, and cells on one spot count once.

    Squares are four radii wide, so that few places lie within a radius of a second one.
    """
    spots = settle(coords.where(tiles.finite()).select("x", "y").distinct())
    for part in (256, 16, 1):
        near, wide = reach / part, reach / part * (1 + 1e-9)
        square = lambda c: F.floor(c / F.lit(4 * near))  # noqa: B023, E731
        around = lambda c: F.explode(F.sequence(square(F.col(c) - wide), square(F.col(c) + wide)))  # noqa: B023, E731
        a = spots.select("x", "y", square(F.col("x")).alias("gx"), square(F.col("y")).alias("gy"))
        b = spots.select(F.col("x").alias("u"), F.col("y").alias("v"), around("x").alias("gx"), "y").select("u", "v", "gx", around("y").alias("gy"))
        dx, dy = F.col("x") - F.col("u"), F.col("y") - F.col("v")
        found = a.join(b, ["gx", "gy"]).select((dx * dx + dy * dy).alias("d2")).where((F.col("d2") > 0) & (F.col("d2") <= near * near)).agg(F.min("d2")).first()[0]
        if found is not None:
            return found
    return None


class CellScores:
    """Scores (src, dst, lr_id, prob) > 0 of pairs of cells, worked out where they are needed: their number grows with the
    square of the density, so they are not stored. ``rows`` gives them out, ``sums`` adds them up by weights of the cells."""

    def __init__(self, sources: DataFrame, targets: DataFrame, scores: tiles.Scores, lr_ids: list, lr_type: str):
        self.sources, self.targets, self.scores, self.lr_ids, self.lr_type = sources, targets, scores, lr_ids, lr_type

    def rows(self) -> DataFrame:
        kernel = tiles.rows_of(self.scores, self.lr_ids)
        out = tiles.tiles(self.sources, self.targets, self.scores.reach).mapInArrow(kernel, "src bigint, dst bigint, lr_id bigint, prob double")
        return out.withColumn("lr_id", F.col("lr_id").cast(self.lr_type)).select("src", "dst", "lr_id", "prob")

    def sums(self, weights: DataFrame, columns: int, sets: int = 1, counted: bool = False) -> DataFrame:
        """(perm, a, b, lr_id, total, n) as in `tiles.sums_of`, for ``weights`` (cell_id, columns[, weights]) of the cells; ones if there are none."""
        both = (t.join(weights, "cell_id") for t in (self.sources, self.targets))
        parts = tiles.tiles(*both, self.scores.reach).mapInArrow(tiles.sums_of(self.scores, columns, sets, counted), _SUMS)
        lr = self.sources.sparkSession.createDataFrame(list(enumerate(self.lr_ids)), f"k int, lr_id {self.lr_type}")
        return parts.groupBy("perm", "a", "b", "k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).join(lr, "k").drop("k")


_SUMS = "perm int, a int, b int, k int, total double, n bigint"


def cell_scores(expression: DataFrame, genes: DataFrame, coords: DataFrame, db: Database, sp: SpatialParams = SpatialParams(), p: Params = Params(), min_expr_percent: float = 0.01, contact_dependent: bool = True) -> CellScores:
    """Hill(L of src * R of dst) * p_spatial of pairs of cells, for every ligand-receptor pair.

    Pairs whose ligand or receptor is in fewer than max(1, int(N * min_expr_percent)) cells are left out. Pairs of a
    contact type count on contact edges only, the cell itself excluded.
    """
    l, r = (settle(t) for t in cell_expression(expression, genes, db))
    n = coords.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(min_expr_percent))).alias("least"))
    enough = lambda t: t.groupBy("lr_id").agg(F.count("*").alias("k")).join(n).where("k >= least").select("lr_id")
    touching = F.coalesce(F.col("interaction_type").contains(CONTACT_TYPES[0]) | F.col("interaction_type").contains(CONTACT_TYPES[1]), F.lit(False)).alias("touching")
    kept = enough(l).join(enough(r), "lr_id").join(cleaned(db.interaction).select("lr_id", touching), "lr_id").orderBy("lr_id").collect()
    at = small(coords.sparkSession.createDataFrame([(x.lr_id, i // tiles.SLICE, i % tiles.SLICE) for i, x in enumerate(kept)], f"lr_id {dict(l.dtypes)['lr_id']}, slice int, at tinyint"))
    cells = coords.where("cell_id is not null").select("cell_id", "x", "y")
    packed = lambda t, v: settle(t.join(at, "lr_id").groupBy("cell_id", "slice").agg(F.collect_list(F.struct("at", F.col(v).alias("value"))).alias("v")).select("cell_id", "slice", F.col("v.at").alias("at"), F.col("v.value").alias("value")).join(cells, "cell_id"))
    reach, least = (sp.interaction_range + sp.tolerance) / sp.ratio, None
    if kept:
        least = closest(coords, reach)
    top = 1.0 if least is None else 1 / (least**0.5 * sp.ratio * sp.scale_distance)
    scores = tiles.Scores([contact_dependent and x.touching for x in kept], reach, sp.contact_range + sp.tolerance, sp.ratio, sp.scale_distance, top, p.kh, p.n)
    return CellScores(packed(l, "l"), packed(r, "r"), scores, [x.lr_id for x in kept], dict(l.dtypes)["lr_id"])


def prob_cell(expression: DataFrame, genes: DataFrame, coords: DataFrame, db: Database, sp: SpatialParams = SpatialParams(), p: Params = Params(), min_expr_percent: float = 0.01, contact_dependent: bool = True) -> DataFrame:
    """(src, dst, lr_id, prob) > 0 of `cell_scores`."""
    return cell_scores(expression, genes, coords, db, sp, p, min_expr_percent, contact_dependent).rows()


def _coded(table: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(code, name) of the distinct values of a column, null included; and their number."""
    names = sorted((r[0] for r in table.select(name).distinct().collect()), key=lambda x: (x is None, x))
    return small(table.sparkSession.createDataFrame(list(enumerate(names)), f"code int, {name} {dict(table.dtypes)[name]}")), len(names)


def _group_sums(scores, labels: DataFrame, cells: DataFrame, nboot: int) -> DataFrame:
    """(perm, source, target, lr_id, prob) over labels (perm, cell_id, group_name) with the groups of ``cells``, perm from
    OBSERVED to ``nboot`` - 1. The labels are read once."""
    codes, n = _coded(cells, "group_name")
    kind = "smallint" if n * (nboot + 1) < 1 << 15 else "int"
    at = ((F.col("perm") - OBSERVED) * n + F.col("code")).cast(kind)
    named = codes.withColumnRenamed("group_name", "named")
    weights = settle(labels.join(named, F.col("group_name").eqNullSafe(F.col("named"))).groupBy("cell_id").agg(F.collect_list(at).alias("columns")))
    out = scores.sums(weights, n, nboot + 1)
    side = lambda c, to: codes.select(F.col("code").alias(c), F.col("group_name").alias(to))
    return out.join(side("a", "source"), "a").join(side("b", "target"), "b").select((F.col("perm") + OBSERVED).alias("perm"), "source", "target", "lr_id", F.col("total").alias("prob"))


def cell_to_group(prob: DataFrame | CellScores, cells: DataFrame) -> DataFrame:
    """(keys.., source, target, lr_id, prob): sums over the cells of both groups; further columns of ``cells`` are keys
    (none if ``prob`` are scores that are not stored)."""
    if not isinstance(prob, DataFrame):
        return _group_sums(prob, cells.select(F.lit(OBSERVED).alias("perm"), "cell_id", "group_name"), cells, 0).drop("perm")
    keys = [c for c in cells.columns if c not in ("cell_id", "group_name")]
    a = cells.select(*keys, F.col("cell_id").alias("src"), F.col("group_name").alias("source"))
    b = cells.select(*keys, F.col("cell_id").alias("dst"), F.col("group_name").alias("target"))
    return prob.join(a, "src").join(b, ["dst", *keys]).groupBy(*keys, "source", "target", "lr_id").agg(F.sum("prob").alias("prob"))


def _share(scores: DataFrame, keys: list[str], nboot: int, digits: int = 9) -> DataFrame:
    """Share of permutations that reach the observed value; groups absent from a permutation have zero in it."""
    seen = scores.where(F.col("perm") == OBSERVED).select(*keys, F.col("prob").alias("seen"))
    null = scores.where(F.col("perm") != OBSERVED)
    hits = seen.join(null.select(*keys, "perm", "prob"), keys, "left").groupBy(*keys, "seen").agg(F.count_if(F.round("prob", digits) >= F.round("seen", digits)).alias("hits"), F.count("perm").alias("there"))
    zero = F.when(F.round("seen", digits) <= 0, nboot - F.col("there")).otherwise(0)
    return hits.select(*keys, F.col("seen").alias("prob"), ((F.col("hits") + zero) / F.lit(float(nboot))).alias("pval"))


def avg_commun_prob(prob: DataFrame | CellScores, cells: DataFrame, nboot: int = 20, seed: int = 1) -> DataFrame:
    """(source, target, lr_id, prob, pval): group sums, tested by shuffling the cells' labels."""
    labels = permuted_labels(cells, nboot, seed, observed=True)
    sums = settle(cell_to_group(prob, settle(labels)) if isinstance(prob, DataFrame) else _group_sums(prob, labels, cells, nboot))
    return _share(sums, ["source", "target", "lr_id"], nboot)


def spot_prob(prob: DataFrame | CellScores, proportions: DataFrame, avg: bool = True) -> DataFrame:
    """(keys.., source, target, lr_id, prob) of soft types: sum of w * prob * w, over the links between spots that have the types if ``avg``."""
    if not isinstance(prob, DataFrame):
        codes, n = _coded(proportions, "type")
        weights = proportions.where("w != 0").join(codes, "type").groupBy(F.col("spot_id").alias("cell_id")).agg(F.collect_list(F.struct("code", "w")).alias("v")).select("cell_id", F.col("v.code").alias("columns"), F.col("v.w").alias("weights"))
        out = prob.sums(weights, n, counted=True).where("n > 0")
        side = lambda c, to: codes.select(F.col("code").alias(c), F.col("type").alias(to))
        return out.join(side("a", "source"), "a").join(side("b", "target"), "b").select("source", "target", "lr_id", (F.col("total") / F.col("n") if avg else F.col("total")).alias("prob"))
    keys = [c for c in proportions.columns if c not in ("spot_id", "type", "w")]
    some = proportions.where("w != 0")
    a = some.select(*keys, F.col("spot_id").alias("src"), F.col("type").alias("source"), F.col("w").alias("wi"))
    b = some.select(*keys, F.col("spot_id").alias("dst"), F.col("type").alias("target"), F.col("w").alias("wj"))
    total = F.sum(F.col("wi") * F.col("prob") * F.col("wj"))
    out = prob.join(a, "src").join(b, ["dst", *keys]).groupBy(*keys, "source", "target", "lr_id").agg((total / F.count("*") if avg else total).alias("prob"))
    return out


def spot_test(prob: DataFrame | CellScores, proportions: DataFrame, avg: bool = True, nboot: int = 100, seed: int = 1) -> DataFrame:
    """(source, target, lr_id, prob, pval): types are permuted among themselves.

    All spots' types change name together, so a permutation's scores are the observed ones under other names.
    """
    # numbers by name, so that no two types share one; a type for each task would be a lot of types
    numbered = proportions.select("type").distinct().select((F.row_number().over(Window.orderBy("type")) - 1).cast("bigint").alias("cell_id"), F.col("type").alias("group_name"))
    swaps = permuted_labels(numbered, nboot, seed, observed=True).join(numbered.select("cell_id", F.col("group_name").alias("type")), "cell_id").select("perm", "type", F.col("group_name").alias("to"))
    seen, swaps = settle(spot_prob(prob, proportions, avg)), settle(swaps)
    side = lambda c, to: swaps.select("perm", F.col("type").alias(c), F.col("to").alias(to))
    scores = seen.join(side("source", "a"), "source").join(side("target", "b"), ["perm", "target"]).select("perm", F.col("a").alias("source"), F.col("b").alias("target"), "lr_id", "prob")
    return _share(scores, ["source", "target", "lr_id"], nboot)


def grid_labels(coords: DataFrame, cells: DataFrame, resolution: float) -> DataFrame:
    """(gx, gy, x, y, n, group_name) of each grid square: centroid, cells, and the commonest label (the first by name in a tie)."""
    placed = _placed(coords, resolution)
    centre = placed.groupBy("gx", "gy").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    votes = placed.join(cells.select("cell_id", "group_name"), "cell_id").groupBy("gx", "gy", "group_name").agg(F.count("*").alias("k"))
    best = votes.groupBy("gx", "gy").agg(F.min(F.struct((-F.col("k")).alias("k"), "group_name"))["group_name"].alias("group_name"))
    return centre.join(best, ["gx", "gy"], "left")


def grid_expression(expression: DataFrame, coords: DataFrame, resolution: float) -> DataFrame:
    """(gx, gy, gene, value): mean over the cells of a square, zeros included."""
    placed = _placed(coords, resolution).select("cell_id", "gx", "gy")
    n = placed.groupBy("gx", "gy").agg(F.count("*").alias("n"))
    return expression.join(placed, "cell_id").groupBy("gx", "gy", "gene").agg(F.sum("value").alias("s")).join(n, ["gx", "gy"]).select("gx", "gy", "gene", (F.col("s") / F.col("n")).alias("value"))


def _placed(coords: DataFrame, resolution: float) -> DataFrame:
    corner = coords.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    square = lambda c, o: F.floor((F.col(c) - F.col(o)) / F.lit(float(resolution)))
    return coords.join(corner).select("cell_id", "x", "y", square("x", "x0").alias("gx"), square("y", "y0").alias("gy"))


def region_distance(coords: DataFrame, cells: DataFrame, ratio: float = 1.0, bins: int | None = None, mean: bool = False) -> DataFrame:
    """(source, target, dist): median (or mean) distance between the cells of two groups; zero within a group.

    The median over all pairs looks at all pairs a few times and stores none (`distances.medians`). ``bins`` rounds
    coordinates to that many steps a side first, so that the pairs are of weighted grid points, bounded whatever the
    number of cells.
    """
    here = coords.join(cells.where("group_name is not null").select("cell_id", "group_name"), "cell_id")
    if bins:
        box = here.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"))
        snap = lambda c, o: F.col(o) + F.round((F.col(c) - F.col(o)) / F.col("side") * bins) * F.col("side") / bins
        here = here.join(box).select("group_name", snap("x", "x0").alias("x"), snap("y", "y0").alias("y"))
    points = settle(here.where(tiles.finite()).groupBy("group_name", "x", "y").agg(F.count("*").alias("w")))
    schema = "source string, target string, dist double"
    if mean:
        a = points.select(F.col("group_name").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("w").alias("w1"))
        b = points.select(F.col("group_name").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"))
        dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
        pairs = a.join(b, F.col("source") != F.col("target")).select("source", "target", (F.sqrt(dx * dx + dy * dy) * ratio).alias("d"), (F.col("w1") * F.col("w2")).alias("w"))
        out = pairs.groupBy("source", "target").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("dist"))
    else:
        codes, _ = _coded(points, "group_name")
        name = {r.code: r.group_name for r in codes.collect()}
        found = distances.medians(points.join(codes, "group_name").select(F.col("code").alias("g"), "x", "y", "w"), same=False)
        out = coords.sparkSession.createDataFrame([(name[i], name[j], d * ratio) for (g, h), (d, _) in found.items() for i, j in ((g, h), (h, g))], schema)
    own = here.select("group_name").distinct().select(F.col("group_name").alias("source"), F.col("group_name").alias("target"), F.lit(0.0).alias("dist"))
    return out.unionByName(own)


def colocalization(coords: DataFrame, cells: DataFrame, radius: float | None = None, nboot: int = 20, seed: int = 1) -> DataFrame:
    """(source, target, n, pval): ordered pairs of cells within ``radius``, each with itself included, tested by shuffled labels.

    Without a ``radius`` it is the median distance of all pairs (`median_radius`), so half of them count.
    """
    radius = median_radius(coords) if radius is None else radius
    cells_at = coords.where("cell_id is not null").select("cell_id", F.lit(0).alias("slice"), "x", "y")
    labels = permuted_labels(cells, nboot, seed, observed=True)
    counts = settle(_group_sums(CellScores(cells_at, cells_at, tiles.Within(radius), [0], "int"), labels, cells, nboot))
    out = _share(counts, ["source", "target", "lr_id"], nboot)
    return out.select("source", "target", F.col("prob").cast("bigint").alias("n"), "pval")


def median_distance(coords: DataFrame) -> tuple[float, int]:
    """Median positive distance of ordered pairs of cells (zero if there is none), and the number of such pairs."""
    points = coords.where(tiles.finite()).groupBy("x", "y").agg(F.count("*").alias("w")).select(F.lit(0).alias("g"), "x", "y", "w")
    return distances.medians(points, same=True).get((0, 0), (0.0, 0))


def median_radius(coords: DataFrame) -> float:
    """The median of `median_distance`."""
    return median_distance(coords)[0]


def centroids(coords: DataFrame, cells: DataFrame) -> DataFrame:
    return coords.join(cells.where("group_name is not null").select("cell_id", "group_name"), "cell_id").groupBy("group_name").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def network_lines(agg: DataFrame, centres: DataFrame, measure: str = "weight") -> DataFrame:
    """(source, target, weight, x1, y1, x2, y2) of edges above zero between different groups."""
    a = centres.select(F.col("group_name").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = centres.select(F.col("group_name").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return agg.where(F.col(measure) > 0).select("source", "target", F.col(measure).alias("weight")).join(a, "source").join(b, "target")


def feature(coords: DataFrame, expression: DataFrame, gene: str) -> DataFrame:
    """(cell_id, x, y, value) of a gene; zero where it is absent."""
    v = expression.where(F.col("gene") == gene).select("cell_id", "value")
    return coords.join(v, "cell_id", "left").select("cell_id", "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def dim(coords: DataFrame, cells: DataFrame) -> DataFrame:
    return coords.join(cells.select("cell_id", "group_name"), "cell_id")
