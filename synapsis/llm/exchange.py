"""Packed exchanges: many small entries meet by a key, and what is decided about them comes home to their rows.

An entry is (key, row, place, ..): a position in a document and the name of what stands there. Corpora have one for
each word or every few bytes, so entries travel packed: a task sorts a batch of them into parts and sends one Spark row
for each part, with the row ids, the places as differences and the other columns as byte planes (zero bytes cost next
to nothing once compressed). A part is decided on in numpy at once; parts number a few for each shuffle partition,
so a part's memory is a fraction of a partition's. Verdicts are packed again by row id, and each row's are put together.

A key that is in very many places would fill one part. So a batch sends one of its equal entries by the key; the others
already know that they have an equal, and travel by a route of their own (`fold`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StructField, StructType

PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Parts for each shuffle partition on the way to a decision.
SPLIT = 2
#: Bytes of text that are packed at once (for many parts, SHARE bytes for each, so that its rows stay worth their
#: overhead, WIDE at most), and verdicts that a task gathers before it packs them.
CHUNK, SHARE, WIDE, GATHER = 1 << 22, 64, 1 << 26, 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = np.asarray(h).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def step(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of the pair of two names."""
    with np.errstate(over="ignore"):
        return mix(a * PRIME + b)


class Entries(NamedTuple):
    """``doc`` numbers ``rids`` (and ``ids``); by doc, then by place. ``columns`` are unsigned numbers."""

    rids: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    columns: dict[str, np.ndarray]
    ids: pa.Array | None = None

    def take(self, at: np.ndarray) -> "Entries":
        return Entries(self.rids, self.doc[at], self.place[at], {c: v[at] for c, v in self.columns.items()}, self.ids)


class Layout(NamedTuple):
    """``columns``: (type, bytes that travel) by name. ``ids``: type of the ids that travel along, if any."""

    columns: dict[str, tuple[str, int]]
    ids: DataType | None = None

    def schema(self) -> StructType:
        fields = [StructField("part", IntegerType()), *(StructField(c, BinaryType()) for c in ("rids", "counts", "places", *self.columns))]
        return StructType([*fields, *([StructField("ids", ArrayType(self.ids))] if self.ids else [])])


def parts_of(df: DataFrame) -> tuple[int, int]:
    """(shuffle partitions, parts)"""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n, SPLIT * n


def _planes(values: np.ndarray, width: int) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T.tobytes()


def _values(planes: bytes, kind: str, width: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    n = len(planes) // width
    out = np.zeros((n, size), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view(kind).ravel()


def pack(e: Entries, route: np.ndarray, layout: Layout, parts: int) -> pa.RecordBatch:
    """One row for each part that has any of the entries."""
    part = (mix(route) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    part, doc, place = part[order], e.doc[order], e.place[order]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    delta = place.copy()
    delta[1:] -= place[:-1]
    delta[new] = place[new]
    delta = delta.astype(np.uint32)
    at = np.flatnonzero(new)
    counts, used = np.diff(at, append=len(part)).astype(np.uint32), doc[at]
    rids = e.rids[used]
    first = np.flatnonzero(np.diff(part, prepend=part[:1] + 1)) if len(part) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(part))
    runs = np.searchsorted(at, np.append(first, len(part)))
    columns = {c: e.columns[c][order].astype(k) for c, (k, _) in layout.columns.items()}
    out = [
        pa.array(part[first].astype(np.int32)),
        pa.array([_planes(rids[i:j], 8) for i, j in zip(runs, runs[1:])], pa.binary()),
        pa.array([_planes(counts[i:j], 4) for i, j in zip(runs, runs[1:])], pa.binary()),
        pa.array([_planes(delta[a:b], 4) for a, b in zip(first, last)], pa.binary()),
        *(pa.array([_planes(columns[c][a:b], w) for a, b in zip(first, last)], pa.binary()) for c, (_, w) in layout.columns.items()),
    ]
    if layout.ids:
        out.append(pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), e.ids.take(pa.array(used))))
    return pa.RecordBatch.from_arrays(out, names=layout.schema().names)


def _unpack(rows: list[pa.RecordBatch], layout: Layout) -> Entries:
    t = pa.Table.from_batches(rows)
    whole = lambda c, kind, width: np.concatenate([_values(x, kind, width) for x in t.column(c).to_pylist()])
    rids, counts, delta = whole("rids", "int64", 8), whole("counts", "uint32", 4), whole("places", "uint32", 4)
    start = np.cumsum(counts.astype(np.int64)) - counts
    total = np.cumsum(delta.astype(np.int64))
    place = total - np.repeat(total[start] - delta[start], counts)
    ids = pa.concat_arrays([x.flatten() for x in t.column("ids").chunks]) if layout.ids else None
    return Entries(rids, np.repeat(np.arange(len(rids)), counts), place, {c: whole(c, k, w) for c, (k, w) in layout.columns.items()}, ids)


def _by_part(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[Entries]:
    """The entries of one part after the other; rows come sorted by part."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        part = b.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for x, y in zip(cuts, cuts[1:]):
            if x < y:
                if held and held[0].column("part")[0].as_py() != part[x]:
                    yield _unpack(held, layout)
                    held = []
                held.append(b.slice(x, y - x))
    if held:
        yield _unpack(held, layout)


def send(source: DataFrame, make: Callable[[pa.RecordBatch, int], Iterator[tuple[Entries, np.ndarray]]], layout: Layout) -> DataFrame:
    """``make`` gives (entries, routes) of a batch of ``source``, told the number of parts; they are packed and dealt to their parts."""
    n, parts = parts_of(source)

    def run(batches):
        for b in batches:
            for e, route in make(b, parts):
                if len(e.place):
                    yield pack(e, route, layout, parts)

    return source.mapInArrow(run, layout.schema()).repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part")


def decide(sent: DataFrame, layout: Layout, verdict: Callable[[Entries], Entries], back: Layout) -> DataFrame:
    """``verdict`` is called with all entries of a part and returns those that matter at home, with the columns of ``back``."""
    n, _ = parts_of(sent)

    def packed(held):
        rid, place = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        columns = {c: np.concatenate([x[2][c] for x in held]) for c in back.columns}
        order = np.lexsort((place, rid))
        known, doc = np.unique(rid[order], return_inverse=True)
        e = Entries(known, doc, place[order], {c: v[order] for c, v in columns.items()})
        return pack(e, known[doc].view(np.uint64), back, n)

    def run(batches):
        held, size = [], 0
        for e in _by_part(batches, layout):
            out = verdict(e)
            if len(out.place):
                held.append((out.rids[out.doc], out.place, out.columns))
                size += len(out.place)
            if size >= GATHER:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return sent.mapInArrow(run, back.schema()).repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part")


def home(decided: DataFrame, back: Layout, summary: Callable[[np.ndarray, dict[str, np.ndarray]], tuple], names: list[str]) -> DataFrame:
    """(rid, ``names`` as binary): what ``summary`` makes of the places and columns of each row that has any, by place."""
    schema = StructType([StructField("rid", LongType()), *(StructField(c, BinaryType()) for c in names)])

    def run(batches):
        for e in _by_part(batches, back):
            rid = e.rids[e.doc]
            order = np.lexsort((e.place, rid))
            rid, place, columns = rid[order], e.place[order], {c: v[order] for c, v in e.columns.items()}
            first = np.flatnonzero(np.diff(rid, prepend=rid[:1] + 1))
            found = [summary(place[a:b], {c: v[a:b] for c, v in columns.items()}) for a, b in zip(first, np.append(first[1:], len(rid)))]
            yield pa.RecordBatch.from_arrays([pa.array(rid[first]), *(pa.array([f[k] for f in found], pa.binary()) for k in range(len(names)))], names=schema.names)

    return decided.mapInArrow(run, schema)


def fold(keys: tuple[np.ndarray, ...], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, again, route) of a batch's entries. ``keys``: the last one is the first that counts, as in lexsort; what
    stands before the key in it orders equals. ``later``: an equal entry goes before; ``again``: there is an equal one.
    ``own`` is a number of each entry's own: the route of the later ones. Others go by their key."""
    order, key = np.lexsort(keys), keys[-1]
    same = key[order][1:] == key[order][:-1]
    later, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return later, again, np.where(later, own, key)


def own_route(rids: np.ndarray, place: np.ndarray) -> np.ndarray:
    return step(mix(rids.view(np.uint64)), place.astype(np.uint64))


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, number of its group, size of its group) of each entry in the order of ``key``."""
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=key[order][:1] + 1) != 0 if len(key) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    return order, number, np.bincount(number)[number] if len(key) else number


def ranks(ids: pa.Array, rids: np.ndarray) -> np.ndarray:
    """Place of each document in the order of ids (null last), then row ids."""
    at = pc.sort_indices(pa.table({"id": ids, "rid": rids}), sort_keys=[("id", "ascending"), ("rid", "ascending")], null_placement="at_end").to_numpy()
    out = np.empty(len(at), np.int64)
    out[at] = np.arange(len(at))
    return out


def merged(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The union of the ranges [low, high), low ascending, as (low, high) pairs in one array."""
    high = np.maximum.accumulate(high)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return np.stack([low[first], high[np.append(first[1:], len(low)) - 1]], 1).astype(np.int64).ravel()


def chunks(b: pa.RecordBatch, parts: int, *columns: str) -> Iterator[list[tuple]]:
    """The rows of a batch, ``raw`` among their columns, in lists of about CHUNK bytes (more for many ``parts``)."""
    out, size, most = [], 0, max(CHUNK, min(WIDE, SHARE * parts))
    at = columns.index("raw")
    for row in zip(*(b.column(c).to_pylist() for c in columns)):
        out.append(row)
        size += len(row[at])
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out
