"""Secrets, mix and tokens of the pipeline against plain versions, on what the near-duplicate stage kept."""

import corpus_pipeline as pipeline
import public_tokenizers
from synapsis.llm import secrets
from test_operators import WORD, plain_targets
from tokenizers import Tokenizer


def test_later_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    second = pipeline.near_duplicates(spark, pipeline.quality_rules(spark, docs, sf), sf)
    texts = {r.doc_id: r.text for r in second.collect()}
    third = pipeline.secret_scans(spark, second, sf).collect()
    assert {r.doc_id for r in third} == set(texts) and third[0].asDict().keys() == docs.first().asDict().keys()
    for r in third:
        assert (r.text == texts[r.doc_id]) == (not secrets.find(texts[r.doc_id])) and r.n_chars == len(r.text)
        assert not [f for f in secrets.find(r.text) if f[0] != "assign"]
    fourth = pipeline.source_mixing(spark, spark.createDataFrame(third, docs.schema), sf)
    sizes, times = {}, {}
    for r in third:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    for r in fourth.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3 and set(times) <= set(texts)
    longest = max(len(WORD.findall(r.text)) for r in third)
    for source, goal in plain_targets(sizes).items():
        words = sum(len(WORD.findall(r.text)) * times.get(r.doc_id, 0) for r in third if r.source == source)
        assert goal - 1 <= words <= goal + longest  # the last document is there whole
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in third}
    fifth = pipeline.bpe_encoding(spark, fourth, sf).collect()
    assert len(fifth) == sum(times.values())
    assert all(r.ids == tok.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in fifth)
