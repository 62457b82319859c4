"""What the operators of this folder share: word rules, shared scratch tables, row ids, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: A word is a run of anything but space and the control characters 9 to 13. ``bytes.split()`` cuts the same way.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local folder serves
    a local master; on a cluster, executors would not see one another's files, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file://" + os.path.join(tempfile.gettempdir(), "synapsis-scratch")).rstrip("/")


#: Rows that go to a Python worker at once: ten thousand texts and what is made of them fill its memory, and the JVM's.
ROWS = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """What runs in here hands ROWS rows at most to Python at once; the session's setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS if int(before) <= 0 else min(ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Give what a batch has freed back to the system: idle workers stay beside the busy ones, and they would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


#: What empties the memory that modules keep in a worker between tasks, such as an encoder's.
KEPT: list = []


def lighten() -> None:
    """For steps that need none of KEPT: the same workers serve all steps of a job."""
    for empty in KEPT:
        empty()


def pieces(batches, light: bool = True):
    """Batches of ROWS rows at most; what a piece has left is given back before the next one and at the end."""
    if light:
        lighten()
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)
            trim()


class Scratch:
    """Parquet tables in the shared folder: they cut lineage, survive lost executors and go when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Delete all tables; results that read them must be written first. Done at the driver's end if not before."""
        atexit.unregister(self.clear)
        with contextlib.suppress(Exception):  # the session may have ended first
            self._delete(self.root)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced: what one collection
        frees may hold on to others, so there are two, and the cleaner has a moment in between."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)


def with_rid(docs: DataFrame, columns: list) -> DataFrame:
    """``columns`` of ``docs`` and a row id ``rid``. Another scan may number the rows otherwise, so the rows, or what is
    worked out from them, are to be written once and read from there."""
    return docs.select(*columns, F.monotonically_increasing_id().alias("rid"))


def map_rows(docs: DataFrame, keys: list[str], value: F.Column, outputs: str, of) -> DataFrame:
    """The columns ``keys`` of ``docs``, whatever their names and types, then ``outputs`` ("name type, ...").

    ``of`` takes the ``value``s of a batch and returns arrays of the outputs, one row for each value; or, before
    those, the number of the value that each output row belongs to.
    """
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)), value.alias("value"))
    made = _parse_datatype_string(outputs).fields
    kinds = StructType([*source.schema.fields[:-1], *(StructField(f"o{i}", f.dataType) for i, f in enumerate(made))])

    def run(batches):
        for b in pieces(batches, False):
            rows, kept = of(b.column("value").to_pylist()), b.columns[:-1]
            if isinstance(rows, tuple):
                at, rows = rows
                kept = [c.take(at) for c in kept]
            yield pa.RecordBatch.from_arrays([*kept, *rows], names=kinds.names)

    out = source.mapInArrow(run, kinds)
    return out.select(*(F.col(c).alias(n) for c, n in zip(kinds.names, [*keys, *(f.name for f in made)])))


def as_binary(col) -> F.Column:
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(col.cast("binary"), F.lit(b""))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges(a, b)``, both long.

    Alternating large-star and small-star contraction: each round is two aggregations and two equi-joins on the
    edges, written to the shared folder; chains shorten geometrically. Minima are pre-aggregated before each shuffle
    and joined back. A hub's links meet in one task until they are large enough for adaptive execution to split them. Nothing is collected but a count
    and a checksum.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        joined = both.join(low, both.a == low.u)
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def sign(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.save(edges.select("a", "b").where("a != b").distinct(), "edges-0")
    k, before = 0, None
    while (seen := sign(now)) != before:
        before, k = seen, k + 1
        after = scratch.save(star(star(now, True), False), f"edges-{k}")
        scratch.drop(f"edges-{k - 1}")
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
