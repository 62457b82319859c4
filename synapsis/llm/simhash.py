"""SimHash near-duplicates through pivot distance tables.

Fingerprints that differ in at most ``max_bits`` bits are linked. The 64 bits fall into blocks, ``intact`` more than the
bits that may differ, and each block has REFS reference fingerprints (pivots) or more. The pivot table is computed once
and kept: for each distinct fingerprint, the vector of its Hamming distances to every reference within the block. Both
steps below read those vectors alone.

Candidates: two fingerprints within four bits have at least ``intact`` blocks where all coordinates are equal, so they
meet under the coordinates of those blocks, one key for each choice of blocks. With more fingerprints keys take in more
blocks (`choose`), so that a bucket holds a few unrelated ones whatever their number.

Discards: for any reference r, |d(x, r) - d(y, r)| <= d(x, y); the maximum coordinate differences of the blocks, added
up, are a lower bound of the distance, and pairs over ``max_bits`` go. The fingerprints themselves verify the survivors.

Only distinct fingerprints are compared, and a bucket gives out a spanning forest of its links, never its pairs.
Buckets over ``BUCKET`` fingerprints, which only a dense cluster fills, take another exact way: two fingerprints within
4 bits have a common point within 2 bits of both, so each hot fingerprint is attached to its 2,081 points within 2
bits, and a point holds at most 2,081 fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_binary, batch, components, pieces, with_rid
from .exchange import step

SEED, REFS, BUCKET = 42, 12, 4096
#: Unrelated fingerprints that a bucket may hold, and the blocks of a key at most (210 keys for each fingerprint then).
EXPECTED, MOST_INTACT = 32, 6


def choose(n: int, max_bits: int) -> int:
    """Blocks of a key, two or more, for ``n`` distinct fingerprints: their 64 * k / (max_bits + k) bits tell the
    unrelated ones apart but for EXPECTED."""
    k = 2
    while k < MOST_INTACT and n > EXPECTED * 2 ** (64 * k / (max_bits + k)):
        k += 1
    return k


def _layout(max_bits: int, intact: int = 2) -> list[tuple[int, int]]:
    """(first bit, width) of each block: ``intact`` blocks more than the bits that may differ."""
    n = max_bits + intact
    cuts = [round(64 * j / n) for j in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def references(max_bits: int = 4, intact: int = 2) -> list[list[int]]:
    """For each block, reference fingerprints whose distances tell any two contents of the block apart."""
    rng, out = np.random.default_rng(SEED), []
    for first, width in _layout(max_bits, intact):
        while True:
            signs = rng.integers(0, 2, (max(REFS, width), width)) * 2 - 1
            if np.linalg.matrix_rank(signs) == width:
                break
        out.append([sum(1 << (first + i) for i in range(width) if s[i] > 0) for s in signs])
    return out


def shingles(raw: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``words``-word shingles of UTF-8 text, A-Z lower-cased, repeats included."""
    parts = raw.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - n + 1].tolist(), ends[n - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that over half of ``h`` have; zero for none."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes, words: int = 4) -> int:
    """Fingerprint of UTF-8 text, unsigned."""
    return majority(shingles(raw, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``docs(.., raw binary)`` with ``raw`` replaced by ``fp`` (signed long with the fingerprint's bits)."""
    keys = [c for c in docs.columns if c != "raw"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "raw")

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, words) for x in b.column("raw").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(fp)], names=[*keys, "fp"])

    return docs.select(*keys, "raw").mapInArrow(run, f"{schema}, fp bigint")


def _pivots(max_bits: int, intact: int):
    """The pivot table: part, fingerprint, vector of distances (a byte each, block by block), and its buckets."""
    refs = [np.array(r, np.uint64) for r in references(max_bits, intact)]
    masks = [np.uint64(((1 << w) - 1) << a) for a, w in _layout(max_bits, intact)]

    def run(batches):
        for b in batches:
            fp, part = b.column("fp").to_numpy().view(np.uint64), b.column("part").to_numpy().astype(np.uint64)
            near = [np.bitwise_count((fp[:, None] ^ r) & m) for r, m in zip(refs, masks)]
            codes = []
            for v in near:  # all coordinates of a block as one name
                code = np.zeros(len(fp), np.uint64)
                for c in v.T:
                    code = step(code, c.astype(np.uint64))
                codes.append(code)
            buckets = np.zeros((len(fp), 0), np.uint64)
            for t, chosen in enumerate(combinations(range(len(codes)), intact)):
                key = step(part, np.full(len(fp), t, np.uint64))
                for i in chosen:
                    key = step(key, codes[i])
                buckets = np.concatenate([buckets, key[:, None]], 1)
            rows = np.concatenate(near, 1)
            offsets = np.arange(len(fp) + 1, dtype=np.int32) * buckets.shape[1]
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("fp"), pa.array([r.tobytes() for r in rows], pa.binary()), keys], names=["part", "fp", "vector", "buckets"])

    return run


def _forest(fp: np.ndarray, vector: np.ndarray, first: np.ndarray, last: np.ndarray, max_bits: int, edges: np.ndarray):
    """Links (i, j) that span the linked fingerprints of each bucket [first, last). ``edges``: where blocks begin in a vector."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = parent.get(p, p)
            i = p
        return i

    size, d = last - first, 1
    end = np.repeat(last, size)
    at = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(first) else np.zeros(0, np.int64)
    out: list[tuple[int, int]] = []
    while len(at):
        live = at + d < end
        at, end = at[live], end[live]
        for k in range(0, len(at), 1 << 15):
            i = at[k : k + (1 << 15)]
            apart = np.abs(vector[i] - vector[i + d])
            i = i[np.maximum.reduceat(apart, edges, axis=1).sum(1) <= max_bits]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
            for a in i.tolist():
                if (r := root(a)) != (s := root(a + d)):
                    parent[max(r, s)] = min(r, s)
                    out.append((a, a + d))
        d += 1
    return out


def _links(max_bits: int, intact: int, most: int):
    schema = pa.schema([("part", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])
    sizes = [len(r) for r in references(max_bits, intact)]
    edges, wide = np.cumsum([0, *sizes[:-1]]), sum(sizes)

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros((0, wide), np.int8)]
        hot = None  # the bucket that is over the bound and has been given out in part

        def settle(key, part, fp, vector, closed):
            nonlocal hot
            edge = np.flatnonzero(np.diff(key)) + 1
            first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            if hot is not None and key[0] != hot:
                hot = None
            many = (last - first > most) | (key[first] == hot if hot is not None else False)
            shut = np.ones(len(first), bool)
            shut[-1] = closed
            if many[-1] and not closed:  # given out at once: memory stays bounded
                hot, shut[-1] = key[-1], True
            at = np.concatenate([np.arange(a, b) for a, b in zip(first[many], last[many])]) if many.any() else np.zeros(0, np.int64)
            use = shut & ~many & (last - first > 1)
            pairs = np.array(_forest(fp, vector, first[use], last[use], max_bits, edges), np.int64).reshape(-1, 2)
            a, b = fp[pairs[:, 0]].view(np.int64), fp[pairs[:, 1]].view(np.int64)
            hots = fp[at].view(np.int64)
            rows = batch(schema, np.concatenate([part[pairs[:, 0]], part[at]]), np.concatenate([a, hots]), np.concatenate([b, hots]), np.arange(len(a) + len(hots)) >= len(a))
            keep = last[-1] if shut[-1] else first[-1]
            return [x[keep:] for x in (key, part, fp, vector)], rows

        for b in batches:
            vector = np.frombuffer(b"".join(b.column("vector").to_pylist()), np.int8).reshape(-1, wide)
            fresh = [b.column("bucket").to_numpy(), b.column("part").to_numpy(), b.column("fp").to_numpy().view(np.uint64), vector]
            held = [np.concatenate(x) for x in zip(held, fresh)]
            if len(held[0]):
                held, rows = settle(*held, False)
                yield rows
        if len(held[0]):
            yield settle(*held, True)[1]

    return run


def link_fingerprints(distinct: DataFrame, max_bits: int = 4, most: int = BUCKET, scratch: Scratch | None = None, intact: int | None = None) -> DataFrame:
    """(part, a, b): links that connect exactly the fingerprints ``fp`` of a ``part`` (distinct, int and long) within
    ``max_bits`` bits (4 at most). ``intact``: blocks of a key; by default they follow from the number of fingerprints."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits is 4 at most")
    scratch = scratch or Scratch(distinct.sparkSession, "simhash")
    intact = intact or choose(distinct.count(), max_bits)
    table = scratch.save(distinct.select("part", "fp").mapInArrow(_pivots(max_bits, intact), "part int, fp bigint, vector binary, buckets array<bigint>"), "pivots")
    dealt = table.select("part", "fp", "vector", F.explode("buckets").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket")
    found = scratch.save(dealt.mapInArrow(_links(max_bits, intact, most), "part int, a bigint, b bigint, hot boolean").distinct(), "found")
    hot = found.where("hot").select("part", F.col("a").alias("fp")).distinct()
    bits = [1 << i for i in range(64)]
    flips = [0, *bits, *(a | b for a, b in combinations(bits, 2))] if max_bits > 2 else [0, *bits]
    ball = hot.select("part", "fp", F.explode(F.transform(F.array(*(F.lit(v - (1 << 64) if v >> 63 else v) for v in flips)), lambda m: m.bitwiseXOR(F.col("fp")))).alias("point")) if not hot.isEmpty() else None
    links = found.where("not hot").select("part", "a", "b")
    if ball is None:
        return links
    groups = ball.groupBy("part", "point").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    near = groups.select("part", F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, len(flips))).alias("b"))
    return links.union(near.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, most: int = BUCKET) -> DataFrame:
    """(rid, doc_id, fingerprint, component_id, keep) for each row of ``docs``.

    component_id is the smallest id reachable over links; ``keep`` marks one row of each component (smallest id,
    then row). Null text is empty; texts without words have fingerprint zero and link like any other. A row with a
    null id gets its component's smallest id, null if no row there has one. Repeated rows are each returned. An
    empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = with_rid(docs, [F.col(id_col).alias("doc_id"), as_binary(F.col(text_col)).alias("raw")])
    prints = scratch.save(fingerprints(rows, words), "prints")
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
    comp = components(link_fingerprints(each.select(F.lit(0).alias("part"), "fp"), max_bits, most, scratch), scratch)
    placed = scratch.save(each.join(comp, each.fp == comp.node, "left").select("fp", "low", "best", F.coalesce("component", "fp").alias("c")), "placed")
    best = placed.groupBy("c").agg(F.min("low").alias("component_id"), F.min("best").alias("best"))
    named = placed.select("fp", "c").join(best, "c").select("fp", "component_id", F.col("best.rid").alias("first"))
    return prints.join(named, "fp").select("rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("rid") == F.col("first")).alias("keep"))


#: Shingles of a part, and parts of a text. Texts of SHORT shingles at most have parts of one shingle; those of four
#: fifths of SHORT or more have parts of PART, so partners on either side of the border share a kind.
PART, PARTS, SHORT = 5, 20, 24
#: Slots of a sketch; equal slots of a candidate (a similarity of 0.8 has 51) and of two texts joined first; and the
#: largest bucket that gives out all its candidates.
SKETCH, NEAR, SURE, FEW = 64, 38, 62, 16
#: Odd factors: h * factor is a permutation of the hashes.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, PARTS + SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def _least(h: np.ndarray, factors: np.ndarray, m: int) -> np.ndarray:
    """For each factor, the ``m`` hashes of ``h`` (distinct, ``m`` or more) that its permutation puts first."""
    best, step = np.zeros((len(factors), 0), np.uint64), 1 << 14
    for k in range(0, len(h), step):
        block = np.concatenate([best, np.broadcast_to(h[k : k + step], (len(factors), len(h[k : k + step])))], 1)
        order = block * factors[:, None]
        at = order.argmin(1)[:, None] if m == 1 else np.argpartition(order, m - 1, 1)[:, :m] if block.shape[1] > m else None
        best = block if at is None else np.take_along_axis(block, at, 1)
    return best


def _parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and fingerprints of the parts of a text with the distinct shingle hashes ``h``."""
    number, fp = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if 0 < len(h) <= SHORT:
        number.append(np.arange(PARTS))
        fp.append(_least(h, FACTORS[:PARTS], 1)[:, 0])
    if 5 * len(h) >= 4 * SHORT:
        ones = np.unpackbits(_least(h, FACTORS[:PARTS], PART).view(np.uint8).reshape(PARTS, PART, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
        number.append(np.arange(PARTS, 2 * PARTS))
        fp.append(np.packbits(2 * ones > PART, axis=1, bitorder="little").view(np.uint64)[:, 0])
    return np.concatenate(number), np.concatenate(fp)


def part_fingerprints(raw: bytes, words: int) -> list[tuple[int, int]]:
    """(part, fingerprint) of a text's parts. A part is the PART shingles (one in short texts) that a permutation of
    the hashes puts first, so two texts of similarity s have equal parts with a chance of about s^PART, whatever
    their length. A text without words has none: it is only a copy of others."""
    return list(zip(*(x.tolist() for x in _parts(np.unique(shingles(raw, words))))))


def _sketch(h: np.ndarray) -> bytes:
    """A byte of the hash that each of SKETCH permutations puts first; equal slots estimate the similarity."""
    return _least(h, FACTORS[PARTS:], 1)[:, 0].astype(np.uint8).tobytes() if len(h) else bytes(SKETCH)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingle hashes have a Jaccard similarity of 0.8 or more; two empty ones have."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _spanning(sketch: np.ndarray) -> list[tuple[int, int]]:
    """Candidates that span a bucket's groups of sketches, likely ones first; partners are drawn, so no row is a hub."""
    n, rng, out = len(sketch), np.random.default_rng(SEED), []
    group, heads, members = np.zeros(n, np.int64), np.zeros_like(sketch), []
    for i in range(n):
        equal = (heads[: len(members)] == sketch[i]).sum(1)
        g = int(equal.argmax()) if len(equal) else 0
        if len(equal) and equal[g] >= SURE:
            other = members[g][int(rng.integers(len(members[g])))]
            out.append((other if (sketch[other] == sketch[i]).sum() >= SURE else members[g][0], i))
            members[g].append(i)
        else:
            g = len(members)
            heads[g] = sketch[i]
            members.append([i])
        group[i] = g
    left = len(members)
    for i in range(1, n):
        if left == 1:
            break
        equal = (sketch[:i] == sketch[i]).sum(1)
        while True:
            open_ = np.where(group[:i] != group[i], equal, 0)
            other = int(open_.argmax())
            if open_[other] < NEAR:
                break
            out.append((other, i))
            group[group == group[other]] = group[i]
            left -= 1
    return out


def _candidates():
    """(a, b, bucket) of (bucket, node, sketch) sorted by bucket. Buckets of FEW nodes give all pairs whose sketches
    allow the similarity, and no bucket; larger ones a spanning forest of them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64())])

    def pairs(first, last, sketch):
        """All pairs of the buckets [first, last) that may be similar."""
        size = last - first
        end, d = np.repeat(last, size), 1
        at = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(first) else np.zeros(0, np.int64)
        found = [np.zeros((0, 2), np.int64)]
        while len(at):
            live = at + d < end
            at, end = at[live], end[live]
            for k in range(0, len(at), 1 << 15):
                i = at[k : k + (1 << 15)]
                i = i[(sketch[i] == sketch[i + d]).sum(1) >= NEAR]
                found.append(np.stack([i, i + d], 1))
            d += 1
        return np.concatenate(found)

    def settle(key, node, sketch):
        edge = np.flatnonzero(np.diff(key)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        few = (last - first > 1) & (last - first <= FEW)
        at, bucket = pairs(first[few], last[few], sketch), []
        rows = [at]
        for a, b in zip(first[~few & (last - first > 1)], last[~few & (last - first > 1)]):
            rows.append(np.array(_spanning(sketch[a:b]), np.int64).reshape(-1, 2) + a)
            bucket += [int(key[a])] * len(rows[-1])
        at = np.concatenate(rows)
        a, b = node[at[:, 0]], node[at[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([None] * len(rows[0]) + bucket, pa.int64())], schema=schema)

    def run(batches):
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros((0, SKETCH), np.uint8)]
        for b in batches:
            fresh = [b.column(c).to_numpy() for c in ("bucket", "node")] + [np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)]
            held = [np.concatenate(x) for x in zip(held, fresh)]
            if len(held[0]) and (cut := int(np.flatnonzero(held[0] == held[0][-1])[0])):
                yield settle(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield settle(*held)

    return run


#: Bytes of shingle hashes that a task compares with one another at most, but for a single larger text.
TILE = 1 << 25


def _linked(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a similarity of 0.8 or more that join all components they can join; each by both whole sets.

    Common shingles are counted through a list of the members that have each: a member is compared with all others at
    once. Those of the largest component need not ask, for others ask them."""
    names, inverse = np.unique(comp, return_inverse=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(h) for h in sets])
    shingle, code = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.searchsorted(code[order], np.arange(len(shingle) + 1))
    most, out = np.bincount(inverse).argmax(), []
    for i in np.flatnonzero(inverse != most).tolist():
        mine = code[begin[i] : begin[i] + sizes[i]]
        if not len(mine):
            continue
        count = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(5 * both >= 4 * (sizes + sizes[i] - both)).tolist():
            if (a := root(inverse[i])) != (b := root(inverse[j])):
                parent[a] = b
                out.append((int(node[i]), int(node[j])))
    return out


def _links_of_tiles(batches):
    """(a, b) of (bucket, x, y, node, component, hashes) sorted by the first three."""
    held: list[tuple] = []

    def settle():
        links = _linked(np.array([r[3] for r in held]), np.array([r[4] for r in held]), [np.frombuffer(r[5], np.uint64) for r in held])
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "x", "y", "node", "component", "hashes"))):
            if held and held[0][:3] != r[:3]:
                yield settle()
                held = []
            held.append(r)
    if held:
        yield settle()


def similar_documents(docs: DataFrame, rid_col: str, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(rid, keep): one row of each group of documents is kept; links are shingle similarities of 0.8 or more.

    One fingerprint of 64 bits cannot tell a similarity of 0.8, which changes ten bits, from chance among many
    documents. So a text has PARTS fingerprints of small parts; texts with an equal one meet in a bucket. Candidates
    are the pairs there whose sketches allow 0.8, and each one's similarity is computed from both texts before it
    links. A large bucket gives a spanning forest of its candidates; only where one of those proves too low, all its
    members' whole sets of shingles come together, TILE bytes against TILE bytes, and give the links between different
    components, so no link is lost and no pairs are given out. Equal sets of shingles are one node. The row kept has
    the smallest id, then the least set, then row id; null ids come last; null text is empty; texts without words are
    copies of each other. Repeated rows are judged like any other, an empty table gives an empty result, and other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    rows = docs.select(F.col(f"`{rid_col}`").alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), as_binary(F.col(f"`{text_col}`")).alias("raw"))
    kind = dict(rows.dtypes)["doc_id"]

    def prints(batches):
        for b in pieces(batches):
            node, buckets, sketch = [], [], []
            for raw in b.column("raw").to_pylist():
                h = np.unique(shingles(raw, words))
                number, fp = _parts(h)
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                buckets.append((fp ^ number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                sketch.append(_sketch(h))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["rid", "doc_id", "node", "buckets", "sketch"])

    def whole_sets(batches):
        for b in pieces(batches):
            sets = [np.unique(shingles(raw, words)).tobytes() for raw in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "hashes"])

    def verify(batches):
        for b in pieces(batches):
            ok = [similar(*(np.unique(shingles(x, words)) for x in both)) for both in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    sets = scratch.save(rows.mapInArrow(prints, f"rid bigint, doc_id {kind}, node bigint, buckets array<bigint>, sketch binary"), "sets")
    nodes = scratch.save(sets.groupBy("node").agg(F.min("rid").alias("rid"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rid")).alias("best")), "nodes")
    dealt = sets.join(nodes.select("rid"), "rid", "left_semi").select("node", "sketch", F.explode("buckets").alias("bucket"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, ok) of distinct pairs, by the texts of both."""
        wanted = nodes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node").select("rid", "node")
        texts = scratch.save(rows.select("rid", "raw").join(wanted, "rid").select("node", "raw"), f"texts-{name}")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("raw").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("raw").alias("y")), "b")
        out = scratch.save(both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint, ok boolean"), f"verified-{name}")
        scratch.drop(f"texts-{name}")
        return out

    met = dealt.select("bucket", "node", "sketch").repartition("bucket").sortWithinPartitions("bucket", "node")
    found = scratch.save(met.mapInArrow(_candidates(), "a bigint, b bigint, bucket bigint"), "found")
    seen = verified(found.select("a", "b").distinct(), "first")
    links = seen.where("ok").select("a", "b")
    comp = scratch.save(components(links, scratch), "components")
    wrong = scratch.save(found.where("bucket is not null").join(seen.where("not ok"), ["a", "b"], "left_semi").select("bucket").distinct(), "wrong")
    if not wrong.isEmpty():
        of = dealt.select("bucket", "node").join(wrong, "bucket", "left_semi").join(comp, "node", "left")
        members = scratch.save(of.select("bucket", "node", F.coalesce("component", "node").alias("component")), "members")
        wanted = nodes.join(members.select("node").distinct(), "node").select("rid", "node")
        whole = scratch.save(rows.select("rid", "raw").join(wanted, "rid").select("node", "raw").mapInArrow(whole_sets, "node bigint, hashes binary"), "whole")
        bytes_ = members.join(whole.select("node", F.octet_length("hashes").alias("n")), "node").groupBy("bucket").agg(F.sum("n").alias("n"))
        tiles = members.join(bytes_.select("bucket", F.expr(f"cast(n div {TILE} + 1 as int)").alias("tiles")), "bucket")
        tiles = tiles.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        tiles = tiles.select("bucket", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "node", "component").join(whole, "node")
        more = tiles.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(_links_of_tiles, "a bigint, b bigint")
        comp = scratch.save(components(links.union(scratch.save(more.distinct(), "more")), scratch), "components-all")
    first = nodes.join(comp, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("best").alias("best")).select(F.col("best.rid").alias("first"))
    return sets.join(first, sets.rid == F.col("first"), "left").select("rid", F.col("first").isNotNull().alias("keep"))
