"""The near-duplicate stage against the exact graph of shingle similarities: real pairs are found, false links drop nothing."""

import corpus_pipeline as pipeline
import numpy as np
from pyspark.sql import functions as F
from synapsis.llm import simhash


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = df.withColumn("r", F.col("doc_id") + 1000)
    return sorted(r.rid - 1000 for r in simhash.similar_documents(rows, "r").collect() if r.keep)


def exact(texts):
    sets = [np.unique(simhash.shingles(t.encode(), 5)) for t in texts]
    root = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            if root[i] != root[j] and simhash.similar(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def test_pairs_just_above_are_found(spark):
    rng, texts = np.random.default_rng(5), []
    for n, edits in ((5, 0), (20, 1), (60, 1), (150, 3), (400, 8), (1500, 30)):
        for k in range(12):
            a = [f"w{n}-{k}-{i}" for i in range(n + 4)]
            b = list(a)
            for at in range(edits):  # far apart: each changes five shingles; similarity 0.81 or more but for n=20, 60
                b[(at + 1) * (n + 4) // (edits + 1)] = f"edit{at}"
            if n == 5:
                b = [*a, "more"]  # 5 of 6 shingles
            if n == 20:
                b = [*a[:-2], "x", "y"]  # 18 of 22
            texts += [" ".join(a), " ".join(b)] if rng.random() < 0.5 else [" ".join(b), " ".join(a)]
    want = exact(texts)
    assert len(want) == len(texts) // 2 and kept(spark, texts) == want


def test_shared_passage_drops_nothing(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"own{d}-{i}" for i in range(44)) for d in range(600)]
    assert kept(spark, texts) == list(range(600))


def test_large_groups_are_whole(spark):
    """A bucket over FEW: near copies, neighbours of a chain that link only through each other, and pairs just too low."""
    texts = []
    for g in range(3):
        base = [f"g{g}-{i}" for i in range(200)]
        for k in range(60):
            w = list(base)
            w[(3 * k) % 200] = f"e{k}"
            texts.append(" ".join(w))
    low = [f"low{i}" for i in range(104)]
    for k in range(60):
        texts.append(" ".join(low + [f"end{k}-{i}" for i in range(14 + k % 3)]))
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[8 * k : 8 * k + 120]) for k in range(30)]
    assert kept(spark, texts) == exact(texts)


def test_stage_against_the_exact_graph(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").collect()
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema).repartition(2)
    rows = sorted(rows, key=lambda r: r.doc_id)
    want = [rows[i].doc_id for i in exact([r.text or "" for r in rows])]
    second = pipeline.near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in second.collect()) == want and second.columns == docs.columns
    fourth = pipeline.source_mixing(spark, second, sf)
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} <= set(want)


def test_members_of_a_large_group_in_tiles(spark, monkeypatch):
    """A large group of which few pairs are similar: every link is found, whatever the tiles, and none by a pair given out."""
    rng, base = np.random.default_rng(11), [f"b{i}" for i in range(150)]
    texts = []
    for k in range(250):
        w = list(base)
        for at in rng.choice(150, rng.integers(0, 16), replace=False):
            w[at] = f"e{k}-{at}"
        texts.append(" ".join(w))
    want = exact(texts)
    assert 1 < len(want) < 200 and kept(spark, texts) == want
    monkeypatch.setattr(simhash, "TILE", 1 << 15)
    assert kept(spark, texts) == want
