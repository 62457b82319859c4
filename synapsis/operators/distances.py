"""Exact medians of all distances between points, without storing them: counts narrow down where the middle lies.

Blocks of points meet in pairs, and squared distances are compared. A pass counts those below, in steps of and above an
interval that should hold the middle by what a few points say, the next by steps of the step that holds it, until what is
left there is small enough to be given out. A middle outside its interval is looked for among all. Counting is by group pairs.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import settle

#: Points of a block; steps of a pass; distances that the last pass gives out at most, unless they no longer part.
BLOCK, STEPS, LEAVE, DEPTH = 2048, 2048, 1 << 21, 5
#: Points of a group, and distances of them in all, at most, by which intervals are chosen.
FEW, GUESSED = 1024, 25_000_000


def _blocks(points: DataFrame) -> tuple[DataFrame, int]:
    """(g, b, xs, ys, ws) of points (g, x, y, w), g an int, in blocks of one group; and their number."""
    sizes = points.groupBy("g").agg(F.expr(f"cast((count(*) + {BLOCK - 1}) div {BLOCK} as int)").alias("parts"))
    dealt = points.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("parts")))
    rows = dealt.groupBy("g", "part").agg(F.collect_list(F.struct("x", "y", "w")).alias("v")).select("g", F.row_number().over(Window.orderBy("g", "part")).alias("b"), F.col("v.x").alias("xs"), F.col("v.y").alias("ys"), F.col("v.w").alias("ws"))
    rows = settle(rows)
    n = rows.count()
    # the blocks meet in a cartesian product, whose tasks are as many as the square of these
    side = math.ceil(math.sqrt(4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return settle(rows.repartition(max(1, min(n, side)))), n


def _pairs(batches, wanted: dict, work):
    """Calls ``work`` with the group pair, the squared distances and the weights of each pair of blocks of a pair in ``wanted``, some rows at a time."""
    for batch in batches:
        columns = [batch.column(c) for c in ("g", "b", "xs", "ys", "ws", "h", "c", "us", "vs", "zs")]
        for row in range(batch.num_rows):
            pair = columns[0][row].as_py(), columns[5][row].as_py()
            if not wanted.get(pair):
                continue
            b, x, y, w, c, u, v, z = (col[row].as_py() if k in (1, 6) else np.asarray(col[row].values.to_numpy()) for k, col in enumerate(columns) if k not in (0, 5))
            step = max(1, (1 << 16) // len(u))
            for i in range(0, len(x), step):
                dx, dy = x[i : i + step, None] - u[None], y[i : i + step, None] - v[None]
                dx *= dx
                dy *= dy
                dx += dy
                work(pair, dx.ravel(), np.multiply.outer(w[i : i + step], z).ravel() if (w.max() > 1 or z.max() > 1) else None, b == c)


def _scale(low: float, high: float, steps: int) -> float:
    return min(steps / ((high - low) * (1 + 1e-9)), 1e300)


def _step(d: np.ndarray, low: float, high: float, path: tuple, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``d`` lie from ``low`` to below ``high`` and there in the steps of ``path``, and their step in the next pass."""
    scale, least, most = _scale(low, high, steps), low, high
    for k, at in enumerate(path):  # about where the path leads, with room for rounding
        width = 1 / scale / steps**k
        least, most = least + at * width, least + (at + 1) * width
    room = 0 if not path else most - least + 1e-12 * high
    kept = np.flatnonzero((d >= max(low, least - room)) & (d < (high if not path or path[-1] == steps - 1 else min(high, most + room))))
    at = (d[kept] - low) * scale
    for k in path:
        sel = np.minimum(np.floor(at), steps - 1) == k
        kept, at = kept[sel], (at[sel] - k) * steps
    return kept, np.minimum(np.floor(at), steps - 1).astype(np.int64)


def _intervals(points: DataFrame, sizes: dict[int, int], pairs: list, same: bool, high: float) -> dict[tuple[int, int], tuple[float, float]]:
    """Where each pair's middle should be: some hundredths of the distances between a few points on both sides of theirs."""
    few = int(min(FEW, math.sqrt(GUESSED / max(1, len(pairs)))))
    share = 2 / math.sqrt(max(1, few))
    if share >= 0.5:
        return {}
    spark = points.sparkSession
    table = spark.createDataFrame([(g, min(1.0, few / n)) for g, n in sizes.items()], "g int, part double")
    some = points.join(table, "g").where(F.pmod(F.xxhash64("x", "y", F.lit(17)), F.lit(1 << 20)) < F.col("part") * (1 << 20)).select("g", "x", "y", "w").toArrow().sort_by("g")
    g, x, y, w = (np.asarray(some.column(c).to_numpy()) for c in ("g", "x", "y", "w"))
    out = {}
    for i, j in pairs:
        a, b = (slice(*np.searchsorted(g, [k, k + 1])) for k in (i, j))
        d = ((x[a, None] - x[None, b]) ** 2 + (y[a, None] - y[None, b]) ** 2).ravel()
        weight = np.multiply.outer(w[a], w[b]).ravel()
        if same:
            d, weight = d[d > 0], weight[d > 0]
        if len(d) < 100:
            continue
        if weight.max() == 1:
            at = [int(len(d) * (0.5 - share)), int(len(d) * (0.5 + share))]
            low, top = np.partition(d, at)[at]
        else:
            order = np.argsort(d)
            upto = np.cumsum(weight[order])
            low, top = d[order][np.searchsorted(upto, upto[-1] * np.array([0.5 - share, 0.5 + share]))]
        if 0 < low < top < high:
            out[i, j] = float(low), float(np.nextafter(top, np.inf))
    return out


def medians(points: DataFrame, same: bool) -> dict[tuple[int, int], tuple[float, int]]:
    """The median distance above zero (``same``: all points, as ordered pairs, zeros left out) or of any size (pairs of
    different groups) and the number of pairs, by (group, group), the smaller first. Points are (g, x, y, w) with finite
    coordinates, w the number of points there; they are distinct."""
    points, steps = settle(points), STEPS
    rows, n = _blocks(points)
    box = points.agg(*(f(c) for c in ("x", "y") for f in (F.min, F.max))).first()
    if not n or box[0] is None:
        return {}
    everything = 0.0, max(((box[1] - box[0]) * (box[1] - box[0]) + (box[3] - box[2]) * (box[3] - box[2])) * (1 + 1e-9), 1e-300)
    other = rows.select(F.col("g").alias("h"), F.col("b").alias("c"), F.col("xs").alias("us"), F.col("ys").alias("vs"), F.col("ws").alias("zs"))
    met = rows.join(other, (F.col("b") <= F.col("c")) if same else (F.col("g") < F.col("h")))
    sizes = {r.g: r.n for r in points.groupBy("g").agg(F.count("*").alias("n")).collect()}
    pairs = [(g, h) for g in sorted(sizes) for h in sorted(sizes) if (g == h if same else g < h)]
    base = _intervals(points, sizes, pairs, same, everything[1])

    def counts(wanted: dict):
        """(g, h, path, step, n): for each group pair and each path in ``wanted``; below and above an interval are the steps -1 and STEPS."""
        places = {pair: base.get(pair, everything) for pair in wanted}

        def run(batches):
            found = defaultdict(lambda: np.zeros(steps + 2, np.int64))

            def work(pair, d, w, own):
                # a block with itself has both orders, two blocks one; ordered pairs count
                times, (low, high) = 1 if own or not same else 2, places[pair]
                for path in wanted[pair]:
                    kept, step = _step(d, low, high, path, steps)
                    if same and low <= 0:
                        above = d[kept] > 0
                        kept, step = kept[above], step[above]
                    into = found[(*pair, path)]
                    into[1:-1] += times * np.bincount(step, None if w is None else w[kept], steps).astype(np.int64)
                    if not path:
                        number = (lambda at: int(np.count_nonzero(at))) if w is None else (lambda at: int(w[at].sum()))  # noqa: B023
                        into[0] += times * ((number(d < low) - (number(d == 0) if same else 0)) if low > 0 else 0)
                        into[-1] += times * (number(d >= high))

            _pairs(batches, wanted, work)
            out = [(g, h, list(path), int(k) - 1, int(v[k])) for (g, h, path), v in found.items() for k in np.flatnonzero(v)]
            yield pa.RecordBatch.from_pylist([dict(zip(("g", "h", "path", "step", "n"), r)) for r in out], schema=pa.schema([("g", pa.int32()), ("h", pa.int32()), ("path", pa.list_(pa.int32())), ("step", pa.int32()), ("n", pa.int64())]))

        return met.mapInArrow(run, "g int, h int, path array<int>, step int, n bigint").groupBy("g", "h", "path", "step").agg(F.sum("n").alias("n"))

    def values(wanted: dict):
        """(g, h, path, d, n): the squared distances themselves, equal ones once."""
        places = {pair: base.get(pair, everything) for pair in wanted}

        def run(batches):
            found = defaultdict(list)

            def work(pair, d, w, own):
                for path in wanted[pair]:
                    kept, _ = _step(d, *places[pair], path, steps)
                    v, weight = d[kept], np.ones(len(kept), np.int64) if w is None else w[kept]
                    above = v > 0 if same else slice(None)
                    v, at = np.unique(v[above], return_inverse=True)
                    if len(v):
                        found[(*pair, path)].append((v, (1 if own or not same else 2) * np.bincount(at, weight[above]).astype(np.int64)))

            _pairs(batches, wanted, work)
            for (g, h, path), many in found.items():
                v, at = np.unique(np.concatenate([x[0] for x in many]), return_inverse=True)
                k = np.bincount(at, np.concatenate([x[1] for x in many])).astype(np.int64)
                m = len(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, g, np.int32)), pa.array(np.full(m, h, np.int32)), pa.array([list(path)] * m, pa.list_(pa.int32())), pa.array(v), pa.array(k)], names=["g", "h", "path", "d", "n"])

        return met.mapInArrow(run, "g int, h int, path array<int>, d double, n bigint").groupBy("g", "h", "path", "d").agg(F.sum("n").alias("n"))

    # ranks (from 0) still to be found: (pair, which) -> (path, rank in it, pairs in it)
    total, state, wanted = {}, {}, {pair: [()] for pair in pairs}
    for depth in range(DEPTH + 1):
        upto = F.sum("n").over(Window.partitionBy("g", "h", "path").orderBy("step"))
        seen = defaultdict(list)
        for r in counts(wanted).withColumn("upto", upto).collect():
            seen[(r.g, r.h), tuple(r.path)].append((r.step, r.n, r.upto))
        missed = False
        for (pair, path), found_ in seen.items():
            found_.sort()
            if not path:
                total[pair] = sum(s[1] for s in found_)
                for which, rank in enumerate(((total[pair] - 1) // 2, total[pair] // 2)):
                    state[pair, which] = ((), rank, total[pair])
                if any(next(s[0] for s in found_ if s[2] > rank) in (-1, steps) for rank in ((total[pair] - 1) // 2, total[pair] // 2)):
                    missed |= base.pop(pair, None) is not None
                    continue
            for which in (0, 1):
                at, rank, _ = state[pair, which]
                if at == path:
                    step, n_, end = next(s for s in found_ if s[2] > rank)
                    state[pair, which] = ((*path, step), rank - (end - n_), n_)
        open_ = {(pair, path): n_ for (pair, _), (path, _, n_) in state.items() if path}
        if not missed and (sum(open_.values()) <= LEAVE or depth >= DEPTH - 1):
            break
        wanted = defaultdict(set)
        for (pair, _), (path, _, _) in state.items():
            if path or pair not in base:
                wanted[pair].add(path)
        wanted = {k: sorted(v) for k, v in wanted.items()}
    wanted = defaultdict(set)
    for (pair, _), (path, _, _) in state.items():
        if path:
            wanted[pair].add(path)
    upto = F.sum("n").over(Window.partitionBy("g", "h", "path").orderBy("d"))
    ranks = rows.sparkSession.createDataFrame([(*pair, list(path), which, rank) for (pair, which), (path, rank, _) in state.items()], "g int, h int, path array<int>, which int, rank bigint")
    last = values({k: sorted(v) for k, v in wanted.items()}).withColumn("upto", upto)
    middle = last.join(ranks, ["g", "h", "path"]).where("upto > rank and upto - n <= rank").select("g", "h", "which", "d").collect()
    # distances too large for their squares are in no step
    found = {(pair, which): math.inf for pair, which in state} | {((r.g, r.h), r.which): math.sqrt(r.d) for r in middle}
    return {pair: (found[pair, 0] if found[pair, 0] == found[pair, 1] else found[pair, 0] + (found[pair, 1] - found[pair, 0]) * 0.5, n_) for pair, n_ in total.items()}
