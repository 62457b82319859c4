import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from synapsis import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, sf, duck, name):
    got = engine.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in engine.ORACLE:
        want = duck.sql(engine.ORACLE[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(a, b, check_dtype=True, rtol=0, atol=2e-6)


def test_stream_equals_batch(spark, sf, tmp_path):
    from synapsis.streaming import group_stats

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stats = group_stats.windowed_stats(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"), "ts", "event_type", "value")
    group_stats.run_available(stats, f"{tmp_path}/out", f"{tmp_path}/ck")
    out = spark.read.parquet(f"{tmp_path}/out")
    batch = group_stats.windowed_stats(spark.read.parquet(f"{sf}/events.parquet"), "ts", "event_type", "value")
    assert out.count() > 0 and out.select("start", "group", "n").subtract(batch.select("start", "group", "n")).count() == 0
