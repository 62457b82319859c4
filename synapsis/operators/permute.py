"""Permutation tests: labels shuffled by the order of md5(seed|permutation|cell), so that every rerun agrees."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import settle
from ..schema import Database, Dataset, Params
from .aggregate import group_aggregate, scaled
from .model import lr_expression, population_shares, probability

OBSERVED, DIGITS = -1, 12
QUANTILES = {"triMean": (0.25, 0.5, 0.75), "median": (0.5,)}


def ranked(df: DataFrame, keys: list[str], code) -> DataFrame:
    """``df`` with ``rank``, from 1 within ``keys`` by the hex digest ``code``, then cell_id.

    Counts of the digest's 4,096 ranges are added up first, then rows are numbered within their range: no task sorts
    more than a range.
    """
    coded = df.withColumn("__code", code).withColumn("__range", F.conv(F.substring("__code", 1, 3), 16, 10).cast("smallint")).withColumn("__code", F.unhex("__code"))
    sums = coded.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    start = sums.select(*keys, "__range", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("__code", "cell_id"))
    return coded.withColumn("__k", within).join(start, [*keys, "__range"]).withColumn("rank", F.col("__start") + F.col("__k")).drop("__code", "__range", "__n", "__k", "__start")


def permuted_labels(cells: DataFrame, nboot: int, seed: int = 1, observed: bool = False) -> DataFrame:
    """(perm, cell_id, group_name): the labels in one fixed order go to the cells in each permutation's order of md5(seed|perm|cell).

    Group sizes stay. The fixed order is that of md5(seed|base|cell).
    """
    known = cells.where("group_name is not null").select("cell_id", "group_name")
    digest = lambda part: F.md5(F.concat_ws("|", F.lit(str(seed)), part, F.col("cell_id").cast("string")))
    labels = ranked(known, [], digest(F.lit("base"))).select("rank", "group_name")
    perms = cells.sparkSession.range(nboot).select(F.col("id").cast("int").alias("perm"))
    shuffled = ranked(known.select("cell_id").join(perms), ["perm"], digest(F.col("perm").cast("string")))
    out = shuffled.join(labels, "rank").select("perm", "cell_id", "group_name")
    return out.unionByName(known.select(F.lit(OBSERVED).alias("perm"), "cell_id", "group_name")) if observed else out


def reject_share(scores: DataFrame, keys: list[str], nboot: int) -> DataFrame:
    """(keys.., prob, pval) of scores (perm, keys.., prob): the share of permutations that reach the observed one."""
    seen = scores.where(F.col("perm") == OBSERVED).select(*keys, F.col("prob").alias("seen"))
    null = scores.where(F.col("perm") != OBSERVED)
    hits = null.join(seen, keys).groupBy(*keys).agg(F.sum(F.when(F.col("prob") >= F.col("seen"), 1).otherwise(0)).alias("hits"))
    return seen.join(hits, keys, "left").select(*keys, F.col("seen").alias("prob"), (F.coalesce("hits", F.lit(0)) / F.lit(float(nboot))).alias("pval"))


def _order(ids: np.ndarray, seed: int, part) -> np.ndarray:
    """Places of ``ids`` in the order of md5(seed|part|id), then id."""
    digests = b"".join(hashlib.md5(f"{seed}|{part}|{i}".encode()).digest() for i in ids.tolist())
    high, low = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64).T
    return np.lexsort((ids, low, high))


def _places(quantiles: tuple[float, ...], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the values on both sides of every quantile (2 x quantiles, groups), and the share of the upper one."""
    h = np.array(quantiles)[:, None] * (sizes - 1)[None, :]
    low = np.floor(h).astype(np.int64)
    return np.repeat(low, 2, axis=0) + np.tile([[0], [1]], (len(quantiles), 1)), h - low


def _in_order(places: np.ndarray, n: np.ndarray, negative: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where ``places`` are among a group's ``n`` sorted values other than zero; -1 for a zero and past the end."""
    zeros = sizes - n
    at = np.where(places < negative, places, places - zeros)
    return np.where((places >= negative) & (places < negative + zeros) | (places >= sizes), -1, at)


def _group_values(value: np.ndarray, codes: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values at the places ``at`` (any, groups) of each group's part of the sorted ``value``; zero where -1."""
    if (at < 0).all():
        return np.zeros(at.shape)
    grouped = value[np.argsort(codes, kind="stable")]  # a radix sort of small integers keeps the order of values
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    return np.where(at < 0, 0.0, grouped[np.maximum(first + at, 0).clip(max=len(grouped) - 1)])


def sorted_gene_kernel(expression: DataFrame, cells: DataFrame, genes: DataFrame, p: Params) -> DataFrame:
    """(perm, gene, group_name, avg) of the observed and the permuted labels, without a row for each value and permutation.

    A task holds the non-zero values of one gene, sorted once, and reads every permutation's labels from a table of
    small integers (cells x permutations; its size is checked by the caller). Quantile methods only.
    """
    labels = cells.where("group_name is not null").orderBy("cell_id").toPandas()
    names, codes = np.unique(labels.group_name.to_numpy(str), return_inverse=True)
    ids = labels.cell_id.to_numpy()
    kind = np.int16 if len(names) <= 1 << 15 else np.int32
    table = np.empty((p.nboot + 1, len(ids)), kind)
    table[0] = codes
    spark = expression.sparkSession
    base = codes[_order(ids, p.seed, "base")].astype(kind)
    first = spark.sparkContext.broadcast((ids, base))

    def labels_of(batches):  # a permutation is a task's sort of ids; its labels come back as two bytes a cell
        for b in batches:
            ids, base = first.value
            out = []
            for k in b.column("id").to_pylist():
                row = np.empty(len(ids), kind)
                row[_order(ids, p.seed, k)] = base
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "labels"])

    drawn = spark.range(p.nboot).repartition(max(p.nboot, 1)).mapInArrow(labels_of, "id bigint, labels binary").toArrow()  # LABEL_BYTES at most
    for k, row in zip(drawn["id"].to_pylist(), drawn["labels"]):
        table[k + 1] = np.frombuffer(row.as_buffer(), kind)
    sizes = np.bincount(codes, minlength=len(names))
    shared = spark.sparkContext.broadcast((ids, table))
    places, share = _places(QUANTILES[p.mean_method.value], sizes)

    def one(key, rows):
        ids, table = shared.value
        value, cell = rows.column("value").to_numpy(), rows.column("cell_id").to_numpy()
        at = np.searchsorted(ids, cell)
        known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == cell)
        value, at = value[known], at[known]
        value, at = value[value != 0], at[value != 0]
        order = np.argsort(value, kind="stable")
        value, at = value[order], at[order]
        below = np.searchsorted(value, 0.0)
        out = np.zeros((len(table), len(names)))
        for k, row in enumerate(table):
            mine = row[at]
            n = np.bincount(mine, minlength=len(names))
            v = _group_values(value, mine, _in_order(places, n, np.bincount(mine[:below], minlength=len(names)), sizes), n)
            past = places[1::2] >= sizes
            q = v[::2] + np.where(past, 0.0, share * (v[1::2] - v[::2]))
            out[k] = (q[0] + 2 * q[1] + q[2]) / 4 if len(q) == 3 else q[0]
        perm = np.repeat(np.arange(-1, len(table) - 1), len(names)).astype(np.int32)
        return pa.table({"perm": perm, "gene": pa.array([key[0].as_py()] * out.size), "group_name": pa.array(np.tile(names, len(table)).tolist()), "avg": out.ravel()})

    # a gene without any value still has its row of zeros
    rows = expression.unionByName(genes.select(F.lit(None).cast("bigint").alias("cell_id"), "gene", F.lit(0.0).alias("value")))
    clean = rows.select(F.coalesce("cell_id", F.lit(-(1 << 62))).alias("cell_id"), "gene", "value")
    return clean.groupBy("gene").applyInArrow(one, "perm int, gene string, group_name string, avg double")


#: Labels of all permutations up to this size may be broadcast.
LABEL_BYTES = 256 << 20
#: Values of a gene that one task of the plan "split" sorts, about.
PART_ROWS = 1 << 16


def split_gene_averages(expression: DataFrame, cells: DataFrame, genes: DataFrame, p: Params, part_rows: int = PART_ROWS) -> DataFrame:
    """(perm, gene, group_name, avg) as of ``sorted_gene_kernel``, for any number of cells: nothing is broadcast or
    collected but counts, and no task holds all cells or a whole gene.

    A row for each value carries its cell's labels under all permutations as small integers. A gene's values are cut at
    approximate quantiles: values between two cuts are one part, and those equal to a cut, however many, another, which
    is dealt to several tasks. Parts count their values by permutation and group; a gene's counts, added up, tell which
    part has the values around a quantile, and at which place; those parts look them up. Quantile methods only.
    """
    spark = expression.sparkSession
    named = cells.where("group_name is not null").groupBy("group_name").agg(F.count("*").alias("size"))
    groups = settle(named.withColumn("code", F.row_number().over(Window.orderBy("group_name")) - 1))  # a row for each group
    n_groups, n_perms = groups.count(), p.nboot + 1
    if not n_groups:
        return spark.createDataFrame([], "perm int, gene string, group_name string, avg double")
    sizes = np.array([r.size for r in groups.orderBy("code").collect()])
    quantiles = QUANTILES[p.mean_method.value]
    places, share = _places(quantiles, sizes)
    kind = "smallint" if n_groups <= 1 << 15 else "int"

    labels = permuted_labels(cells, p.nboot, p.seed, observed=True).join(groups.select("group_name", F.col("code").cast(kind)), "group_name")
    of_cell = labels.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("perm", "code"))).alias("__l")).select("cell_id", F.col("__l.code").alias("labels"))
    there = expression.where("value != 0").select("cell_id", "gene", "value")
    most = there.groupBy("gene").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    parts = -(-most // part_rows)
    fractions = [(k + 1) / parts for k in range(parts - 1)] or [0.5]
    cuts = there.groupBy("gene").agg(F.percentile_approx("value", fractions, max(10000, 10 * parts)).alias("cuts"), F.ceil(F.count("*") / part_rows).alias("m"))
    chosen = lambda c, k: F.floor((k + 1) * F.col("m") / parts) > F.floor(k * F.col("m") / parts)
    cuts = settle(cuts.select("gene", "m", F.array_distinct(F.filter("cuts", chosen)).alias("cuts") if parts > 1 else F.expr("cast(array() as array<double>)").alias("cuts")))
    below = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    equal = F.array_contains("cuts", F.col("value"))
    dealt = F.when(equal, F.pmod(F.xxhash64("cell_id"), F.col("m"))).otherwise(0).cast("int")
    rows = there.join(cuts, "gene").select("cell_id", "gene", "value", (2 * below + equal.cast("int")).alias("part"), dealt.alias("salt"))
    rows = settle(rows.join(of_cell, "cell_id").select("gene", "part", "salt", "value", "labels").repartition("gene", "part", "salt"))

    def matrix(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_perms)

    def count(key, t):
        flat = matrix(t.column("labels")).astype(np.int64) + np.arange(n_perms) * n_groups
        under = t.column("value").to_numpy() < 0
        n, negative = (np.bincount(f.ravel(), minlength=n_perms * n_groups).astype(np.int64).tobytes() for f in (flat, flat[under]))
        return pa.table({"gene": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([n], pa.binary()), "negative": pa.array([negative], pa.binary())})

    def aim(key, t):
        total, negative, by_part = 0, 0, {}
        for k, n, under in zip(t.column("part").to_pylist(), t.column("n"), t.column("negative")):
            n, under = (np.frombuffer(x.as_buffer(), np.int64).reshape(n_perms, n_groups) for x in (n, under))
            by_part[k], total, negative = by_part.get(k, 0) + n, total + n, negative + under
        want = np.stack([_in_order(places, total[k], negative[k], sizes) for k in range(n_perms)])  # permutation, slot, group
        out, before = [], 0
        for k in sorted(by_part):
            upto = before + by_part[k]
            at = want - (before if isinstance(before, int) else before[:, None, :])
            hit = np.argwhere((want >= 0) & (at >= 0) & (want < upto[:, None, :]))
            out.append(np.column_stack([np.full(len(hit), k), hit, at[tuple(hit.T)]]))
            before = upto
        part, perm, slot, code, at = np.concatenate(out).T
        return pa.table({"gene": pa.array([key[0].as_py()] * len(part), pa.string()), "part": part.astype(np.int32), "perm": perm.astype(np.int32), "slot": slot.astype(np.int32), "code": code.astype(np.int32), "at": at.astype(np.int64)})

    def pick(key, t, wanted):
        value, codes = t.column("value").to_numpy(), matrix(t.column("labels"))
        order = np.argsort(value, kind="stable")
        value, codes = value[order], codes[order]
        perm, slot, code, at = (wanted.column(c).to_numpy() for c in ("perm", "slot", "code", "at"))
        found = np.empty(len(perm))
        for k in np.unique(perm):
            here, mine = perm == k, codes[:, k]
            first = np.concatenate([[0], np.cumsum(np.bincount(mine, minlength=n_groups))[:-1]])
            found[here] = value[np.argsort(mine, kind="stable")][first[code[here]] + at[here]]
        return pa.table({"gene": pa.array([key[0].as_py()] * len(perm), pa.string()), "perm": perm, "slot": slot, "code": code, "value": found})

    counts = rows.groupBy("gene", "part", "salt").applyInArrow(count, "gene string, part int, n binary, negative binary")
    aims = settle(counts.groupBy("gene").applyInArrow(aim, "gene string, part int, perm int, slot int, code int, at bigint"))
    between, on_cut = F.col("part") % 2 == 0, F.col("part") % 2 == 1
    looked = rows.where(between).join(aims.select("gene", "part").distinct(), ["gene", "part"], "left_semi").groupBy("gene", "part").cogroup(aims.where(between).groupBy("gene", "part"))
    values = looked.applyInArrow(pick, "gene string, perm int, slot int, code int, value double")
    equals = aims.where(on_cut).join(cuts, "gene").select("gene", "perm", "slot", "code", F.expr("cuts[cast((part - 1) / 2 as int)]").alias("value"))
    slots = [F.max(F.when(F.col("slot") == k, F.col("value"))).alias(f"v{k}") for k in range(2 * len(quantiles))]
    seen = values.unionByName(equals).groupBy("gene", "perm", "code").agg(*slots)

    grid = genes.select("gene").union(cuts.select("gene")).distinct().join(groups).join(spark.range(n_perms).select(F.col("id").cast("int").alias("perm")))
    q = []
    for k, f in enumerate(quantiles):
        h = F.lit(f) * (F.col("size") - 1)
        a, b = (F.coalesce(f"v{2 * k + j}", F.lit(0.0)) for j in (0, 1))
        q.append(a + F.when(F.floor(h) + 1 < F.col("size"), (h - F.floor(h)) * (b - a)).otherwise(0.0))
    avg = (q[0] + 2 * q[1] + q[2]) / 4 if len(q) == 3 else q[0]
    return grid.join(seen, ["gene", "perm", "code"], "left").select((F.col("perm") - 1).alias("perm"), "gene", "group_name", avg.alias("avg"))


def commun_prob(data: Dataset, db: Database, p: Params = Params(), plan: str = "auto", p_spatial: DataFrame | None = None) -> DataFrame:
    """(source, target, lr_id, prob, pval) over all pairs of groups and ligand-receptor pairs.

    ``p_spatial(source, target, p)`` is a factor between groups, of the observed and the permuted scores alike.

    plan "sql" carries a row for each value and permutation; "kernel" sorts each gene once (quantile methods, labels
    within LABEL_BYTES); "split" cuts genes into parts (quantile methods, any size). All give the same numbers; "auto"
    takes the kernel within that size and "split" beyond it, and "sql" for the other methods.
    """
    expression, cells = scaled(data.expression), data.cells.select("cell_id", "group_name")
    quantile = p.mean_method.value in ("triMean", "median")
    if plan == "auto":
        small = p.nboot and quantile and cells.count() * 2 * (p.nboot + 1) <= LABEL_BYTES
        plan = "kernel" if small else "split" if quantile and p.nboot else "sql"
    if plan == "kernel":
        avgs = sorted_gene_kernel(expression, cells, data.genes, p)
    elif plan == "split":
        avgs = split_gene_averages(expression, cells, data.genes, p)
    else:
        avgs = group_aggregate(expression, permuted_labels(cells, p.nboot, p.seed, observed=True), data.genes, p.mean_method, p.trim)
    shares = population_shares(cells) if p.population_size else None
    sides = settle(lr_expression(settle(avgs), db, p))  # genes, then pairs, x groups x permutations: read many times
    scores = probability(sides, p, shares, p_spatial, DIGITS)
    return reject_share(scores, ["source", "target", "lr_id"], p.nboot or 1)
