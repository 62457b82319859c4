"""Token counts of a piece model without token ids: pieces once per distinct pre-token, joined to frequencies.

The model replaces spaces with U+2581 and puts one in front. No piece has U+2581 behind another character, and none
but the byte piece has a newline, so no merge crosses those places: a text's count is the sum over its pre-tokens,
which begin there. `cuts` checks both facts on the model at hand.

Every distinct pre-token of the corpus is counted once. Documents' frequencies meet these counts in two ways: the
most frequent pre-tokens (HEAD at most, of 64 bytes at most) travel as a broadcast table of proven size, the rest by
a shuffled join on the pre-token.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_rid

SPACE = "▁"
HEAD, HEAD_BYTES = 1 << 19, 64
#: Frequencies are told apart by so many steps a doubling when the head is chosen.
STEPS = 4


def _level() -> F.Column:
    return F.floor(F.log2("n") * STEPS).cast("int")


@lru_cache(2)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def cuts(path: str) -> bool:
    """Whether pre-tokens may begin at each first space of a run and at each newline."""
    m = model(path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
    return not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces) and len(m.encode("a b")) == len(m.encode("a")) + len(m.encode("b"))


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text: those at a space without the first of its spaces, those at a newline with it."""
    if not text:
        return []
    parts = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if not p:
            run += 1
        elif p[0] == "\n":
            if run:
                out.append(SPACE * (run - 1))
            out.append(p)
            run = 0
        else:
            out.append(SPACE * run + p)
            run = 0
    if run:
        out.append(SPACE * (run - 1))
    return out


def pieces(path: str, keys: list[str]) -> list[int]:
    """Pieces of each pre-token. A model puts a space before what it encodes; at a newline that one is taken off."""
    ids = model(path).encode(keys, num_threads=1) if keys else []
    return [1 if not k else len(x) - (k[0] == "\n") for k, x in zip(keys, ids)]


_heads: dict[str, dict[str, int]] = {}


def _head(shared) -> dict[str, int]:
    """The broadcast table as a dictionary, built once in each Python worker."""
    if shared.id not in _heads:
        table = pa.ipc.open_stream(shared.value[1]).read_all()
        _heads.clear()
        _heads[shared.id] = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
    return _heads[shared.id]


class _Shared:
    """A broadcast with a name of its own that all tasks agree on."""

    def __init__(self, spark, table: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.id, self.inner = uuid.uuid4().hex, spark.sparkContext.broadcast((0, sink.getvalue().to_pybytes()))

    @property
    def value(self):
        return self.inner.value


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row: UTF-8 bytes and pieces of the whole text by the model at ``path``.

    Null and empty texts have zero of both. Rows are counted one by one, so repeated ids and texts are each returned;
    an empty table gives an empty result; other columns are ignored; ids are of any type. ``head`` bounds the broadcast table.
    """
    if not cuts(path):
        raise ValueError("pieces of this model cross pre-tokens")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "tokens")
    rows = with_rid(docs, [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")])

    def distinct(batches):
        for b in batches:
            c: Counter = Counter()
            for t in b.column("text").to_pylist():
                c.update(pretokens(t))
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["token", "n"])

    def once(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("n"), pa.array(pieces(path, b.column("token").to_pylist()), pa.int64())], names=["token", "n", "pieces"])

    counts = rows.select("text").mapInArrow(distinct, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    vocabulary = scratch.save(counts.mapInArrow(once, "token string, n bigint, pieces bigint"), "vocabulary")
    scratch.release()

    short = vocabulary.where(F.octet_length("token") <= HEAD_BYTES).withColumn("level", _level())
    level, total = 64 * STEPS, 0
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # a few hundred rows at most
        if (total := total + r["count"]) > head:
            break
        level = r["level"]
    shared = _Shared(spark, short.where(F.col("level") >= level).select("token", "pieces").toArrow())
    is_rest = (F.octet_length("token") > HEAD_BYTES) | (_level() < level)

    def frequencies(batches):
        known = _head(shared)
        for b in batches:
            doc, rid, sizes, tokens, times, sums = b.column("doc_id"), b.column("rid").to_pylist(), [], [], [], []
            at = []
            for i, t in enumerate(b.column("text").to_pylist()):
                total = 0
                for k, f in Counter(pretokens(t)).items():
                    p = known.get(k)
                    if p is None:
                        at.append(i)
                        tokens.append(k)
                        times.append(f)
                    else:
                        total += p * f
                sums.append(total)
                sizes.append(len(t.encode()))
            n, rid, names = len(sums), pa.array(rid, pa.int64()), ["rid", "doc_id", "n_bytes", "token", "f"]
            base = pa.RecordBatch.from_arrays([rid, doc, pa.array(sizes, pa.int64()), pa.nulls(n, pa.string()), pa.array(sums, pa.int64())], names=names)
            rest = pa.RecordBatch.from_arrays([rid.take(pa.array(at, pa.int64())), pa.nulls(len(at), doc.type), pa.nulls(len(at), pa.int64()), pa.array(tokens, pa.string()), pa.array(times, pa.int64())], names=names)
            yield base
            yield rest

    kind = dict(rows.dtypes)["doc_id"]
    each = scratch.save(rows.mapInArrow(frequencies, f"rid bigint, doc_id {kind}, n_bytes bigint, token string, f bigint"), "frequencies")
    rest = each.where("token is not null").join(vocabulary.where(is_rest).select("token", "pieces"), "token").select("rid", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("bigint").alias("n_bytes"), (F.col("f") * F.col("pieces")).alias("f"))
    parts = each.where("token is null").select("rid", "doc_id", "n_bytes", "f").union(rest)
    return parts.groupBy("rid").agg(F.first("doc_id", True).alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("f").alias("n_tokens")).drop("rid")
