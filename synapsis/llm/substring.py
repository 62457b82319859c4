"""Exact removal of repeated passages: 20-word windows seen earlier, and 200-byte strings seen anywhere else.

**Words: fixed-block anchors.** The non-overlapping ten-word blocks of every document, at multiples of ten words, are the
index. Every rolling ten words of every document probes it: index and probes meet by the block's name, and all places
of a block that is in the index and occurs twice are hits. Any 20 words hold a whole block of their own document's
grid, so two equal windows share a hit, wherever they lie. Hits are then extended to the windows around them: each
such window has the name of the pair of its halves, equal windows meet in the order of their documents, and all but
the first are repeats; their union in a document is its maximal exact repeats.

**Bytes: distributed prefix doubling.** Positions are sampled by content: of every 100 bytes, the one where the least
32-gram hash begins (leftmost on ties), so equal strings have equal samples; any 200 bytes have at least two. A sample's
first rank is that of the bytes up to the next sample. Then offsets double: the rank of 2, 4, 8, .. such stretches is
that of the pair (rank at i, rank at i + offset), looked up in the document's ranks of the round before. Every round,
Spark brings equal ranks together; samples whose rank is unique leave, and so do those past the threshold of 200 bytes.
A window's inner samples have the rank of the pair of the two longest ranks that cover them; the windows of one such
pair are first compared with everything that they cover together, and, where that differs among equal pairs, one by
one: by the pair and the bytes to its left and right.

Names and ranks are 64-bit hashes of what they stand for, each formed from two earlier ones, so looking one up takes
no join; equal ones count as equal content. No pair of documents is formed, and no group needs one task: see
`exchange` for how equal names meet.
"""

from __future__ import annotations

import atexit
import contextlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_binary, with_rid
from .exchange import Entries, Layout, chunks, decide, fold, groups, home, merged, mix, own_route, ranks, send, step

PRIME = 0x9E3779B97F4A7C15
PIECE = 1 << 19  # windows searched at once: a hash's low 20 bits make room for the position


class Search(NamedTuple):
    """The least hash of ``gram`` units (a power of two) is chosen of every ``length`` units."""

    length: int
    gram: int


BYTES = Search(200, 32)


def units(raw: bytes, words: bool) -> tuple[np.ndarray, bytes, int]:
    """(value of each unit, what to slice for the bytes of units, bytes a unit takes there)."""
    if words:
        digest = xxhash.xxh3_64_intdigest
        values = np.array([digest(w) for w in raw.split()], np.uint64)
        return values, values.tobytes(), 8
    return np.frombuffer(raw, np.uint8).astype(np.uint64), raw, 1


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive values, by doubling."""
    size, power = 1, PRIME
    with np.errstate(over="ignore"):
        values = values + np.uint64(1)
        while size < k:
            values = values[:-size] * np.uint64(power) + values[size:]
            size, power = size * 2, power * power % (1 << 64)
        return mix(values)


def anchors(values: np.ndarray, at: Search) -> tuple[np.ndarray, ...]:
    """(hash, first window, offset of the anchor from there, further windows) of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(values) < at.length:
        return none.astype(np.uint64), none, none, none
    hashes, low, out = grams(values, at.gram), np.uint64((1 << 20) - 1), []
    for start in range(0, len(values) - at.length + 1, PIECE):
        n = min(PIECE, len(values) - at.length + 1 - start)
        h = hashes[start : start + n + at.length - at.gram]
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size, width = 1, at.length - at.gram + 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[:n], least[width - size : width - size + n])
        where = (least & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        last = np.concatenate([first[1:], [n]]) - 1
        p = where[first]
        out.append((h[p], first + start, p - first, last - first))
    return tuple(np.concatenate(x) for x in zip(*out))


def names(values: np.ndarray, k: int) -> np.ndarray:
    """The name of every ``k`` consecutive values, put together from those of powers of two."""
    out, size, part, width = None, 0, mix(values), 1
    while True:
        if k & width:
            n = len(values) - size - width + 1
            if n <= 0:
                return values[:0]
            out, size = part[:n] if out is None else step(out[:n], part[size : size + n]), size + width
        if size == k:
            return out
        part, width = step(part[:-width], part[width:]), 2 * width


# Words


PROBE, FOUND = Layout({"key": ("uint64", 5), "flags": ("uint8", 1)}), Layout({})
FIXED, AGAIN = 1, 2


def _word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _windows(segments: list[tuple[int, int, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, name) of every ``k`` consecutive values in segments of (doc, first place, values)."""
    segments = [x for x in segments if len(x[2]) >= k]
    if not segments:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = np.array([len(v) for _, _, v in segments])
    begin = np.cumsum(sizes) - sizes
    n = sizes - k + 1
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    name = names(np.concatenate([v for _, _, v in segments]), k)[np.repeat(begin, n) + within]
    return np.repeat([d for d, _, _ in segments], n), np.repeat([a for _, a, _ in segments], n) + within, name


def _probes(window: int):
    """Every rolling block of documents that have a window; FIXED: it is one of the document's own grid, the index."""
    block = window // 2

    def make(b, parts):
        for rows in chunks(b, parts, "rid", "raw"):
            rids, segments = np.array([r for r, _ in rows], np.int64), []
            for d, (_, raw) in enumerate(rows):
                if len(words := raw.split()) >= window:
                    segments.append((d, 0, _word_values(words)))
            doc, place, key = _windows(segments, block)
            fixed = place % block == 0
            later, again, route = fold((key,), own_route(rids[doc], place))
            order, number, _ = groups(key)
            whole = np.zeros(len(key), bool)  # the one that goes by the key stands for its equals
            whole[order] = np.bincount(number, fixed[order])[number] > 0 if len(key) else False
            flags = np.where(whole, FIXED, 0) | np.where(again, AGAIN, 0)
            yield Entries(rids, doc, place, {"key": key >> np.uint64(24), "flags": flags.astype(np.uint8)}), route

    return make


def _hits(e: Entries) -> Entries:
    """The places of blocks that are in the index and occur twice."""
    order, number, size = groups(e.columns["key"])
    flags = e.columns["flags"][order]
    indexed = np.bincount(number, flags & FIXED)[number] > 0
    return e._replace(columns={}).take(order[(flags & AGAIN > 0) | (indexed & (size > 1))])


def _extended(window: int):
    """Windows (runs of their starts) around the hits of each row."""
    return lambda place, _: (merged(np.maximum(place - (window - window // 2), 0), place + 1).tobytes(),)


def _candidates(window: int):
    """Every window in a row's runs, named by its halves; in a chunk, only the first of equal ones goes by its name."""

    def make(b, parts):
        all_ids = b.column("doc_id")
        begin = 0
        for rows in chunks(b, parts, "rid", "raw", "runs"):
            rids, ids, segments = np.array([r for r, _, _ in rows], np.int64), all_ids.slice(begin, len(rows)), []
            begin += len(rows)
            for d, (_, raw, runs) in enumerate(rows):
                words = raw.split()
                for a, z in np.frombuffer(runs, np.int64).reshape(-1, 2).tolist():
                    segments.append((d, a, _word_values(words[a : z - 1 + window])))
            doc, place, key = _windows(segments, window)
            later, _, route = fold((place, ranks(ids, rids)[doc], key), own_route(rids[doc], place))
            yield Entries(rids, doc, place, {"key": key, "flags": later.astype(np.uint8)}, ids), route

    return make


def _seen_earlier(e: Entries) -> Entries:
    """All windows but the first of each name."""
    settled = e.columns["flags"] > 0
    key = e.columns["key"]
    order = np.lexsort((e.place, ranks(e.ids, e.rids)[e.doc], key, settled))
    repeated = settled[order]
    repeated[1:] |= ~settled[order][1:] & (key[order][1:] == key[order][:-1]) & ~settled[order][:-1]
    return Entries(e.rids, e.doc, e.place, {}).take(order[repeated])


def _ranges(length: int):
    return lambda place, _: (merged(place, place + length).tobytes(),)


def repeated_words(corpus: "Corpus", scratch: Scratch, window: int) -> list[DataFrame]:
    """[(rid, ranges)]: word ranges that windows seen earlier cover."""
    if window < 2:
        raise ValueError("a window has two words at least")
    hits = decide(send(corpus.rows.select("rid", "raw"), _probes(window), PROBE), PROBE, _hits, FOUND)
    runs = scratch.save(home(hits, FOUND, _extended(window), ["runs"]), "runs")
    scratch.release()
    layout = Layout({"key": ("uint64", 8), "flags": ("uint8", 1)}, corpus.rows.schema["doc_id"].dataType)
    sent = send(corpus.rows.join(runs, "rid").select("doc_id", "rid", "raw", "runs"), _candidates(window), layout)
    found = scratch.save(home(decide(sent, layout, _seen_earlier, FOUND), FOUND, _ranges(window), ["ranges"]), "ranges")
    scratch.release()
    return [found]


# Bytes

RANK = Layout({"key": ("uint64", 8), "size": ("uint16", 2), "flags": ("uint8", 1)})
RANKED = Layout({"key": ("uint64", 8), "size": ("uint16", 2)})
CLASS = Layout({"key": ("uint64", 8), "cover": ("uint64", 8), "left": ("uint16", 2), "right": ("uint16", 2), "span": ("uint16", 2), "flags": ("uint8", 1)})
JUDGED = Layout({"key": ("uint64", 8), "left": ("uint16", 2), "right": ("uint16", 2), "span": ("uint16", 2), "flags": ("uint8", 1)})
WINDOW = Layout({"key": ("uint64", 8), "flags": ("uint8", 1)})
SETTLED, REPEATED, OPEN = 1, 2, 4


def _sampling(length: int) -> Search:
    """Half a window, so that a window has two samples at least, and grams of a sixth to a third of that, 32 at most."""
    half = length // 2
    return Search(half, min(32, 1 << max(0, (half // 3).bit_length() - 1)))


def samples(raw: bytes, at: Search) -> tuple[np.ndarray, np.ndarray]:
    """(positions, first stretch of ``at.length`` bytes that chooses each)"""
    _, first, offset, _ = anchors(units(raw, False)[0], at)
    p = first + offset
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    return p[new], first[new]


def _ranked(parts: list[tuple], rids: np.ndarray):
    """(entries, routes) of (doc, places, ranks, sizes); equal ranks of a chunk go once by the rank."""
    doc = np.repeat(np.array([x[0] for x in parts], np.int64), [len(x[1]) for x in parts])
    place, key, size = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in (1, 2, 3))
    _, again, route = fold((key,), own_route(rids[doc], place))
    return Entries(rids, doc, place, {"key": key, "size": size, "flags": again.astype(np.uint8)}), route


def _first_ranks(length: int):
    at = _sampling(length)

    def make(b, parts):
        digest = xxhash.xxh3_64_intdigest
        for rows in chunks(b, parts, "rid", "raw"):
            rids, ranked = np.array([r for r, _ in rows], np.int64), []
            for d, (_, raw) in enumerate(rows):
                if len(raw) >= length:
                    p, _ = samples(raw, at)
                    key = np.array([digest(raw[x:y]) for x, y in zip(p[:-1].tolist(), (p[1:] + at.gram).tolist())], np.uint64)
                    ranked.append((d, p[:-1], key, np.diff(p)))
            yield _ranked(ranked, rids)

    return make


def _next_ranks(length: int):
    """Ranks of twice as many stretches: the pair of the rank at i and the rank where that ends."""
    most = length - _sampling(length).gram

    def make(b, parts):
        rids, ranked = b.column("rid").to_numpy(), []
        for d, (p, size, key) in enumerate(zip(*(b.column(c).to_pylist() for c in ("places", "sizes", "keys")))):
            p, size, key = np.frombuffer(p, np.int64), np.frombuffer(size, np.uint16).astype(np.int64), np.frombuffer(key, np.uint64)
            at = np.minimum(np.searchsorted(p, p + size), len(p) - 1)
            ok = (p[at] == p + size) & (size + size[at] <= most)
            i, j = np.flatnonzero(ok), at[ok]
            if len(i):
                ranked.append((d, p[i], step(key[i], key[j]), size[i] + size[j]))
        yield _ranked(ranked, rids)

    return make


def _not_unique(e: Entries) -> Entries:
    order, _, size = groups(e.columns["key"])
    keep = order[(size > 1) | (e.columns["flags"][order] > 0)]
    return e._replace(columns={"key": e.columns["key"], "size": e.columns["size"]}).take(keep)


def _table(place, columns):
    return place.astype(np.int64).tobytes(), columns["size"].tobytes(), columns["key"].tobytes()


def _classes(length: int, levels: int):
    """Windows with the same inner samples, whose rank is the pair of two ranks that are not unique."""
    at = _sampling(length)

    def make(b, parts):
        digest = xxhash.xxh3_64_intdigest
        names_of = [c for k in range(levels) for c in (f"places{k}", f"keys{k}")]
        for rows in chunks(b, parts, "rid", "raw", *names_of):
            rids, out = np.array([r[0] for r in rows], np.int64), []
            for d, (_, raw, *tables) in enumerate(rows):
                p, first = samples(raw, at)
                last = len(raw) - length
                far = first - (length - at.length)
                begin = np.unique(np.concatenate([[0], first[first <= last], far[(far > 0) & (far <= last)]]))
                end = np.append(begin[1:], last + 1) - 1
                f = np.searchsorted(first, begin, "right") - 1
                g = np.searchsorted(first, begin + (length - at.length), "right") - 1
                level = np.floor(np.log2(g - f)).astype(np.int64)
                key, alive = np.zeros(len(begin), np.uint64), np.zeros(len(begin), bool)
                for k in range(levels):
                    if tables[2 * k] is None:
                        break
                    rank, there = np.zeros(len(p), np.uint64), np.zeros(len(p), bool)
                    where = np.searchsorted(p, np.frombuffer(tables[2 * k], np.int64))
                    rank[where], there[where] = np.frombuffer(tables[2 * k + 1], np.uint64), True
                    mine = np.flatnonzero(level == k)
                    x, y = f[mine], g[mine] - (1 << k)
                    alive[mine] = there[x] & there[y]
                    key[mine] = step(step(rank[x], rank[y]), (g[mine] - f[mine]).astype(np.uint64))
                i = np.flatnonzero(alive)
                if not len(i):
                    continue
                s, e, left, right = begin[i], end[i], p[f[i]] - begin[i], p[g[i]] + at.gram - begin[i]
                cover = np.array([digest(raw[x:y]) for x, y in zip(s.tolist(), (e + length).tolist())], np.uint64)
                cover = step(cover, (left * (length + 1) + (e - s)).astype(np.uint64))
                out.append((d, s, key[i], cover, left, right, e - s))
            doc = np.repeat(np.array([x[0] for x in out], np.int64), [len(x[1]) for x in out])
            place, key, cover, left, right, span = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(1, 7))
            both = step(key, cover) if len(key) else key
            later, again, _ = fold((both,), both)
            route = np.where(later, own_route(rids[doc], place), key) if len(key) else key
            flags = np.where(later, SETTLED, 0) | np.where(again, REPEATED, 0)
            yield Entries(rids, doc, place, {"key": key, "cover": cover, "left": left, "right": right, "span": span, "flags": flags}), route

    return make


def _judged(e: Entries) -> Entries:
    """REPEATED: another class covers the same; OPEN: the first of its cover among equal ranks of different covers."""
    c = e.columns
    settled, key, cover = c["flags"] & SETTLED > 0, c["key"], c["cover"]
    order = np.lexsort((cover, key, settled))
    key, cover, live = key[order], cover[order], ~settled[order]
    same_key = np.zeros(len(order), bool)
    same_key[1:] = (key[1:] == key[:-1]) & live[1:]
    same = same_key.copy()
    same[1:] &= cover[1:] == cover[:-1]
    number = np.cumsum(~same_key) - 1
    covers = np.bincount(number, ~same)[number]
    repeated = same | (c["flags"][order] & REPEATED > 0)
    repeated[:-1] |= same[1:]
    is_open = live & ~same & (covers > 1)
    keep = repeated | is_open
    flags = np.where(repeated, REPEATED, 0) | np.where(is_open, OPEN, 0)
    out = Entries(e.rids, e.doc, e.place, {x: c[x] for x in ("left", "right", "span")}).take(order[keep])
    return out._replace(columns=out.columns | {"key": np.where(is_open, key, np.uint64(0))[keep], "flags": flags[keep]})


def _settled_and_open(length: int):
    def summary(place, c):
        r, o = c["flags"] & REPEATED > 0, c["flags"] & OPEN > 0
        ranges = merged(place[r], place[r] + c["span"][r] + length).tobytes() if r.any() else None
        open_ = np.stack([place[o], c["left"][o], c["right"][o], c["span"][o]], 1).astype(np.int64).tobytes() if o.any() else None
        return ranges, open_, c["key"][o].tobytes() if o.any() else None

    return summary


def _open_windows(length: int):
    """Every window of the open classes, named by its rank pair and the bytes to its left and right."""

    def make(b, parts):
        digest = xxhash.xxh3_64_intdigest
        for rows in chunks(b, parts, "rid", "raw", "open", "keys"):
            rids, docs, place, key, rest = np.array([r[0] for r in rows], np.int64), [], [], [], []
            for d, (_, raw, open_, keys) in enumerate(rows):
                for (s, left, right, span), k in zip(np.frombuffer(open_, np.int64).reshape(-1, 4).tolist(), np.frombuffer(keys, np.uint64)):
                    rest += [digest(raw[x : s + left] + raw[s + right : x + length]) for x in range(s, s + span + 1)]
                    at = np.arange(s, s + span + 1)
                    place.append(at)
                    docs.append(np.full(len(at), d))
                    key.append(step(np.full(len(at), k), (s + left - at).astype(np.uint64)))
            doc, place, key = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, place, key))
            key = step(key, np.array(rest, np.uint64)) if len(key) else key
            _, again, route = fold((key,), own_route(rids[doc], place))
            yield Entries(rids, doc, place, {"key": key, "flags": again.astype(np.uint8)}), route

    return make


def _found_twice(e: Entries) -> Entries:
    order, _, size = groups(e.columns["key"])
    return Entries(e.rids, e.doc, e.place, {}).take(order[(size > 1) | (e.columns["flags"][order] > 0)])


def repeated_bytes(corpus: "Corpus", scratch: Scratch, length: int) -> list[DataFrame]:
    """[(rid, ranges), ..]: byte ranges that repeated strings cover."""
    if length < 2:
        raise ValueError("a string has two bytes at least")
    levels: list[DataFrame] = []
    source, make = corpus.rows.select("rid", "raw"), _first_ranks(length)
    while True:
        alive = decide(send(source, make, RANK), RANK, _not_unique, RANKED)
        state = scratch.save(home(alive, RANKED, _table, ["places", "sizes", "keys"]), f"ranks-{len(levels)}")
        scratch.release()
        if state.isEmpty() and levels:  # a number of rounds that follows from the length alone
            break
        levels.append(state)
        source, make = state, _next_ranks(length)
    rows = corpus.rows.select("rid", "raw")
    for k, t in enumerate(levels):
        rows = rows.join(t.select("rid", F.col("places").alias(f"places{k}"), F.col("keys").alias(f"keys{k}")), "rid", "left" if k else "inner")
    judged = decide(send(rows, _classes(length, len(levels)), CLASS), CLASS, _judged, JUDGED)
    classes = scratch.save(home(judged, JUDGED, _settled_and_open(length), ["ranges", "open", "keys"]), "classes")
    scratch.release()
    todo = corpus.rows.select("rid", "raw").join(classes.where("open is not null").select("rid", "open", "keys"), "rid")
    windows = decide(send(todo, _open_windows(length), WINDOW), WINDOW, _found_twice, FOUND)
    found = scratch.save(home(windows, FOUND, _ranges(length), ["ranges"]), "windows")
    scratch.release()
    return [classes.where("ranges is not null").select("rid", "ranges"), found]


class Corpus:
    """Documents bucketed by row id in the shared folder, so that no later join moves a text again."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch):
        spark = docs.sparkSession
        self.name, self.n = "docs_" + scratch.root.rsplit("-", 1)[1], int(spark.conf.get("spark.sql.shuffle.partitions"))
        # the ids are written before anything is shuffled by them: a task that is done again could number its rows otherwise
        rows = scratch.save(with_rid(docs, [F.col(f"`{id_col}`").alias("doc_id"), as_binary(F.col(f"`{text_col}`")).alias("raw")]), "rows")
        (rows.repartition(self.n, "rid").write.bucketBy(self.n, "rid").sortBy("rid").option("path", f"{scratch.root}/docs").saveAsTable(self.name))
        scratch.drop("rows")
        self.rows = spark.table(self.name)
        atexit.register(self._forget, spark)

    def _forget(self, spark) -> None:
        with contextlib.suppress(Exception):  # the session may have ended first
            spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _removed(corpus: Corpus, ranges: list[DataFrame]) -> DataFrame:
    rows = corpus.rows.select("doc_id", "rid", "raw")
    for k, r in enumerate(ranges):
        rows = rows.join(r.select("rid", F.col("ranges").alias(f"ranges{k}")), "rid", "left")
    return rows.select("doc_id", "raw", F.concat(*(F.coalesce(f"ranges{k}", F.lit(b"")) for k in range(len(ranges)))).alias("ranges"))


def spans(n: int, low, high) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs that the ranges cover."""
    edge = np.zeros(n + 2, np.int32)
    if low is not None:
        np.add.at(edge, np.asarray(low, np.int64) + 1, 1)
        np.add.at(edge, np.asarray(high, np.int64) + 1, -1)
    on = np.diff((np.cumsum(edge) > 0).astype(np.int8))
    return np.flatnonzero(on > 0), np.flatnonzero(on < 0)


def _cut(words: bool):
    def run(batches):
        for b in batches:
            n, starts, ends, kept = [], [], [], []
            for raw, ranges in zip(*(b.column(c).to_pylist() for c in ("raw", "ranges"))):
                parts = raw.split() if words else raw
                low, high = np.frombuffer(ranges, np.int64).reshape(-1, 2).T
                a, e = spans(len(parts), low, high)
                left, pieces = 0, []
                for x, y in zip(a.tolist(), e.tolist()):
                    pieces.append(parts[left:x])
                    left = y
                pieces.append(parts[left:])
                kept.append(b" ".join(w for p in pieces for w in p) if words else b"".join(pieces))
                n.append(len(parts))
                starts.append(a)
                ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_units", "starts", "ends", "kept"])

    return run


def _remove(docs: DataFrame, id_col: str, text_col: str, repeated, length: int, words: bool) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "substring")
    corpus = Corpus(docs, id_col, text_col, scratch)
    kind = corpus.rows.schema["doc_id"].dataType.simpleString()
    out = _removed(corpus, repeated(corpus, scratch, length)).mapInArrow(_cut(words), f"doc_id {kind}, n_units bigint, starts array<bigint>, ends array<bigint>, kept binary")
    gone: Column = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return out.withColumn("n_removed", gone)


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_units, starts, ends, kept, n_removed): words covered by a ``window``-word sequence that starts earlier are removed.

    Earlier: a smaller id (of any type that has an order; null ids last), or an earlier start in the same document. ``starts``/``ends`` are the removed
    word spans, ``kept`` the other words, joined by a space, in UTF-8. Null text has no words. Rows that repeat an id
    are different documents, in the order they are read. One row comes back for each row; an empty table gives an
    empty result; other columns are ignored.
    """
    return _remove(docs, id_col, text_col, repeated_words, window, True)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, n_units, starts, ends, kept, n_removed): bytes covered by a ``length``-byte string that also starts elsewhere are removed.

    ``starts``/``ends`` are the removed byte spans, ``kept`` the remaining bytes (not always UTF-8: a span may cut a
    character). Null text is empty. Rows that repeat an id or a text are different documents, so each is the other's
    repeat. One row comes back for each row; an empty table gives an empty result; other columns are ignored.
    """
    return _remove(docs, id_col, text_col, repeated_bytes, length, False)
