"""What goes to a Python worker at once, and what it gives back."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from synapsis.llm import bpe, common


def rss():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_scratch_tables_are_made_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    scratch = common.Scratch(spark, "batches")
    got = scratch.save(spark.range(0, 9000, 1, 1).mapInArrow(rows, "n bigint"), "n").agg(F.max("n"), F.sum("n")).first()
    assert got[0] <= 2000 and got[1] == 9000 and spark.conf.get(key) == before
    scratch.clear()


def test_freed_memory_goes_back():
    many = [bytes(3000) for _ in range(60_000)]  # 180 MB
    last = many[-1]  # at the heap's end, so that the rest stays without a trim
    full = rss()
    del many
    common.trim()
    assert len(last) == 3000 and rss() < full - 100_000_000


def test_other_steps_empty_the_encoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = bpe.encoder(path).encode("some words, some words")
    assert bpe._encoders
    assert list(common.pieces([], False)) == [] and bpe._encoders
    rows = pa.record_batch({"n": list(range(4500))})
    assert [b.num_rows for b in common.pieces([rows])] == [2000, 2000, 500] and not bpe._encoders
    assert bpe.encoder(path).encode("some words, some words") == want
