"""Every stage of the pipeline against a plain version on the smallest tables."""

import corpus_pipeline as pipeline
import public_tokenizers
from synapsis.llm import quality, secrets, simhash
from tokenizers import Tokenizer


def test_stages(spark, sf):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "source_mixing", "bpe_encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    docs = spark.createDataFrame(docs.collect() + [(None, None, None, None, None), (901, "", "en", None, 0)], docs.schema).repartition(2)
    columns = docs.columns

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    first = pipeline.quality_rules(spark, docs, sf)
    kept = []
    for r in docs.collect():
        m = quality.measure(r.text or "")
        bad = m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or m["n_dup_lines"] > 0.3 * m["n_lines"] or m["dup_line_chars"] > 0.2 * m["line_chars"]
        if not bad and all(c <= s * m["word_chars"] for c, s in zip(m["dup_ngram_chars"], quality.NGRAM_SHARE.values())):
            kept.append(tuple(r))
    assert first.columns == columns and rows(first) == sorted(kept, key=str) and 0 < len(kept) < 122

    second = pipeline.near_duplicates(spark, first, sf)
    parts = {r[0]: simhash.part_fingerprints(r[1].encode(), 5) for r in kept}
    groups = {i: i for i in parts}

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for i in parts:
        for j in parts:
            if j < i and any(p == q and (a ^ b).bit_count() <= 4 for p, a in parts[i] for q, b in parts[j]):
                x, y = sorted((root(i), root(j)))
                groups[y] = x
    assert second.columns == columns and sorted(r.doc_id for r in second.collect()) == sorted(i for i in parts if root(i) == i)

    third = pipeline.secret_scans(spark, second, sf)
    assert third.columns == columns and third.count() == second.count()
    assert all(not [f for f in secrets.find(r.text) if f[0] in secrets.KINDS[1:3]] and r.n_chars == len(r.text) for r in third.collect())

    fourth = pipeline.source_mixing(spark, third, sf)
    assert fourth.columns == columns and set(rows(fourth)) <= set(rows(third))
    times = {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 3 and len(times) > len(rows(third)) / 3

    fifth = pipeline.bpe_encoding(spark, fourth, sf).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in third.collect()}
    assert len(fifth) == fourth.count() and all(r.ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in fifth)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
