"""The dealt methods where small tables do not reach: keys of more blocks, ids of any type and order, windows of any length."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from synapsis.llm import simhash, substring

from test_operators import brute_components, plain_bytes, plain_words


@pytest.mark.parametrize(("bits", "intact"), [(4, 3), (4, 4), (3, 2), (1, 2), (0, 3)])
def test_links_by_keys_of_more_blocks(spark, bits, intact):
    rng, fps = np.random.default_rng(7), set()
    for base in rng.integers(0, 1 << 63, 4).tolist():
        for _ in range(30):
            fps.add(base ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 6), replace=False)))
    fps = sorted(fps)
    links = simhash.link_fingerprints(spark.createDataFrame([(0, f) for f in fps], "part int, fp bigint"), bits, intact=intact).collect()
    at = {f: i for i, f in enumerate(fps)}
    assert all((r.a ^ r.b).bit_count() <= bits for r in links)
    true = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    a, b = brute_components(fps, true), brute_components(fps, [(at[r.a], at[r.b]) for r in links])
    assert len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_keys_grow_with_the_rows():
    assert [simhash.choose(n, 4) for n in (0, 10**6, 10**8, 5 * 10**10)] == [2, 2, 3, 4]


def test_the_pivot_table_bounds_distances():
    rng = np.random.default_rng(1)
    refs = [np.array(r, np.uint64) for r in simhash.references(4, 3)]
    for _ in range(200):
        x, y = rng.integers(0, 1 << 63, 2).astype(np.uint64)
        bound = 0
        for (first, width), r in zip(simhash._layout(4, 3), refs):
            mask = np.uint64(((1 << width) - 1) << first)
            bound += np.abs(np.bitwise_count((x ^ r) & mask).astype(int) - np.bitwise_count((y ^ r) & mask).astype(int)).max()
        assert bound <= int(np.bitwise_count(x ^ y))


WORDS30 = " ".join(f"t{i}" for i in range(30))


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_null_ids_come_last_in_any_partition(spark, parts):
    rows = [(None, WORDS30), (5, WORDS30), (None, "own words " * 3), (2, "x " + WORDS30[30:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts, "text" if parts == 1 else F.coalesce("doc_id", F.lit(-1)))
    got = Counter((r.doc_id, r.n_removed) for r in substring.remove_repeated_words(df).collect())
    want = Counter((d, n) for d, _, n, _ in plain_words(rows))
    assert got == want and got[None, 30] == 1


def test_ids_of_other_types(spark):
    rows = [("b10", WORDS30), ("b9", "z " + WORDS30), (None, WORDS30), ("ü", WORDS30)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in substring.remove_repeated_words(df).collect()}
    assert got == {"b10": 0, "b9": 30, "ü": 30, None: 30}
    dated = df.withColumn("doc_id", F.expr("case doc_id when 'b10' then date'2024-01-02' when 'b9' then date'2024-01-01' end"))
    assert Counter(r.n_removed for r in substring.remove_repeated_words(dated).collect()) == Counter([0, 30, 30, 30])
    assert substring.remove_repeated_bytes(dated.withColumn("text", F.repeat("text", 3))).schema["doc_id"].dataType.simpleString() == "date"


@pytest.mark.parametrize("length", [2, 3, 7, 40, 64, 201])
def test_strings_of_any_length(spark, length):
    rng = np.random.default_rng(length)
    pool = ["".join(rng.choice(list("ab"), rng.integers(1, 3 * length))) for _ in range(5)] + ["a" * 3 * length, "ab" * 2 * length]
    rows = [(i, "".join(pool[k] for k in rng.integers(0, 7, 4)) + "".join(rng.choice(list("abcdefgh"), 2 * length))) for i in range(9)] + [(9, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substring.remove_repeated_bytes(df, length=length).collect()
    assert sorted((r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in got) == sorted(plain_bytes(rows, length))


@pytest.mark.parametrize("window", [2, 3, 5])
def test_windows_of_any_length(spark, window):
    rng = np.random.default_rng(window)
    rows = [(i, " ".join(rng.choice(list("abcdefghijkl"), rng.integers(0, 40)))) for i in range(25)]
    seen, want = set(), []
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - window + 1) if (tuple(w[i : i + window]) in seen or seen.add(tuple(w[i : i + window]))) for j in range(i, i + window)}
        want.append((d, len(gone)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeated_words(df, window=window).collect()) == want
