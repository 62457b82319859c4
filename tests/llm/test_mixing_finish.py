"""Sources smaller than a block, or little larger, against their targets."""

import pytest
from pyspark.sql import functions as F
from synapsis.llm import mixing


def test_every_source_ends_at_its_target(spark):
    rows = [(i, "w " * 1000, "c") for i in range(400)]
    rows += [(1000, "x " * 60, "a"), (1001, "x " * 30, "b"), (1002, "x " * 30, "b"), (1003, "x " * 70, None), (1004, "", "a"), (1005, None, "d")]
    rows += [(2000 + i, "y " * 50, "e") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(df, slots=100, finish=True).collect()  # a block has 4,008 words
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=0.5)
    assert sum(r.taken for r in got if r.source in ("a", "b", "e") or r.source is None) == 3 * (60 + 60 + 70 + 450)
    assert mixing.mix(df.limit(0), finish=True).count() == 0
    assert mixing.mix(df.where("text is null or text = ''"), finish=True).agg(F.sum("taken")).first()[0] == 0


def test_a_finished_mix_begins_with_the_schedule(spark, monkeypatch):
    """Whatever blocks the schedule names are taken; only the missing or surplus words of a source are moved at its end."""
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    real, calls = mixing.schedule, []

    def seen(goals, n_slots, block):
        out = real(goals, n_slots, block)
        calls.append(out.agg(F.sum("times")).first()[0])
        return out

    monkeypatch.setattr(mixing, "schedule", seen)
    slots = {r.doc_id: r.taken for r in mixing.mix(df, slots=16).collect()}
    done = {r.doc_id: r.taken for r in mixing.mix(df, slots=16, finish=True).collect()}
    assert calls == [16, 16]
    for odd in (0, 1):
        assert sum(abs(done[i] - slots[i]) for i in slots if i % 2 == odd) <= 2 * 125  # two slots of 125 words at most
