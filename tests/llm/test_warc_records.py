"""Bytes that hold several records give a row for each response."""

from synapsis.llm import warc


def test_every_response_gives_a_row(spark):
    one, two = (warc.response(f"http://x/{k}", f"<p>page {k}".encode(), k) for k in "ab")
    raw = one + warc.derive(one)["metadata"] + two
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None), (3, bytearray(two))], "k int, warc binary")
    got = sorted((r.k, r.target_uri or "", r.text or "") for r in warc.derivatives(df).collect())
    assert got == [(1, "http://x/a", "page a"), (1, "http://x/b", "page b"), (2, "", ""), (3, "http://x/b", "page b")]
