"""Parsers of MPEG and WARC on arbitrary and damaged bytes, and against plain versions."""

import gzip
import hashlib
import json
import math
import re
import time
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from synapsis.llm import mpeg, queries, warc

MANY = settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
VBRI = bytes.fromhex("fff31000") + bytes(32) + b"VBRI"
PIECES = st.sampled_from([b"\xff\xfb\x90\x00", b"\xff\xfa\x90\xc0" + bytes(30), VBRI, b"ID3\x03\0\0\0\0\0\x7f", b"TAG", b"Xing", b"\xff\xfd\x80\x00", bytes(200), b"\xff" * 9])


def plain_crc(bits):
    """Remainder of a division by x^16 + x^15 + x^2 + 1, bit by bit, on lists."""
    reg = [1] * 16
    for b in bits:
        top, reg = reg[0] ^ b, [*reg[1:], 0]
        if top:
            reg = [r ^ k for r, k in zip(reg, (1, *[0] * 12, 1, 0, 1))]
    return int("".join(map(str, reg)), 2)


def bits_of(data):
    return [int(b) for byte in data for b in f"{byte:08b}"]


@MANY
@given(st.lists(st.one_of(st.binary(max_size=300), PIECES), max_size=12))
def test_any_bytes_are_parsed(parts):
    raw = b"".join(parts)
    info = mpeg.parse(raw)
    assert all(0 <= x and x + n <= len(raw) for x, n, _, _ in info["frames"])
    with pytest.raises(ValueError):
        mpeg.load(raw + b"\0" * 5)


def test_short_vbri_and_long_junk():
    assert mpeg.parse(VBRI.ljust(48, b"\0") * 2)["vbr"] is None
    began = time.time()
    assert mpeg.parse(b"\xff" * (1 << 20))["skipped"] == 1 << 20
    assert time.time() - began < 1


# header, allocation bits of the table, (band, value) set in it, and the bits of scale-factor selection that follow
CASES = [
    ("fffe90c0", 32 * 4, 0),  # Layer I, mono
    ("fffe9000", 64 * 4, 0),  # Layer I, stereo
    ("fffe9060", (12 * 2 + 20) * 4, 0),  # Layer I, joint from band 12
    ("fffca000", 2 * (11 * 4 + 12 * 3 + 7 * 2), 0),  # Layer II, 192 kbit/s stereo, 44.1 kHz: 30 bands
    ("fffca000", 2 * (11 * 4 + 12 * 3 + 7 * 2), 2),  # the same with the first band in use
    ("fffc20c0", 2 * 4 + 6 * 3, 0),  # Layer II, 48 kbit/s mono: 8 bands
    ("fff480c0", 4 * 4 + 7 * 3 + 19 * 2, 2),  # MPEG-2 Layer II, mono
]


@pytest.mark.parametrize(("head", "allocation", "extra"), CASES)
def test_checksums_of_layers_one_and_two(head, allocation, extra):
    head = bytes.fromhex(head)
    h = mpeg.header(int.from_bytes(head))
    body = bytearray(h[3] - 6)
    if extra:
        body[0] = 0x10  # four bits of the first band
    crc = plain_crc(bits_of(head[2:] + body)[: 16 + allocation + extra])
    good = head + crc.to_bytes(2) + bytes(body)
    bad = head + (crc ^ 1).to_bytes(2) + bytes(body)
    assert [f[2:] for f in mpeg.parse(good + bad + good)["frames"]] == [(True, True), (True, False), (True, True)]


def plain_feature(media):
    """The feature of a stream that `store` wrote, from its bytes alone."""
    tag_end = 10 + int("".join(f"{b:07b}" for b in media[6:10]), 2)
    at, sizes, offsets, seen = tag_end, [], [], 0
    kbit = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    while at < len(media):
        assert media[at : at + 2] == b"\xff\xfa" and media[at + 3] == 0xC0
        n = 144 * kbit[media[at + 2] >> 4] * 1000 // 32000
        assert plain_crc(bits_of(media[at + 2 : at + 4] + media[at + 6 : at + 23])) == int.from_bytes(media[at + 4 : at + 6])
        if at > tag_end:
            sizes.append(n)
            offsets.append(at)
        at += n
    assert at == len(media) and media[tag_end + 23 : tag_end + 27] == b"Xing"
    frames, size = int.from_bytes(media[tag_end + 31 : tag_end + 35]), int.from_bytes(media[tag_end + 35 : tag_end + 39])
    n = len(sizes)
    g = math.gcd(1152 * n, 32000)
    seconds = f"{1152 * n // g}" + (f"/{32000 // g}" if g != 32000 else "")
    seek = zlib.crc32(b"".join(o.to_bytes(8) for o in offsets))
    return f"layer=3;rate=32000;channels=1;frames={n};samples={1152 * n};seconds={seconds};bad_crc={seen};skipped=0;vbr=Xing:{frames}:{size};tags=PRIV;seek={seek:08x}"


def test_features_of_the_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op2_media_columns"](spark, sf).collect()
    for r in got:
        media = mpeg.store(mpeg.payload((texts[r.doc_id] or "").encode()))
        assert (r.feature, r.media_sha256, r.media_bytes) == (plain_feature(media), hashlib.sha256(media).hexdigest(), len(media))


def test_read_back_of_null_and_damaged_streams(spark):
    good = mpeg.store(mpeg.payload(b"x" * 100))
    df = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(good[:-9])), (4, bytearray(good))], "__raw int, media binary")
    rows = {r["__raw"]: r for r in mpeg.read_back(df, ["__raw"]).collect()}
    assert rows[1].media_bytes is None and rows[2].payload_bytes is None and rows[2].media_bytes == 4 and rows[3].payload_sha256 is None and rows[4].payload_bytes == 128


WARC_PIECES = st.sampled_from([b"WARC/1.0\r\n", b"WARC-Type: response\r\n", b"warc-type: RESPONSE\r\n", b"Content-Length: 5\r\n", b"content-length: abc\r\n", b"\r\n", b"HTTP/1.1 200 OK\r\n", b"Content-Type: text/html; charset=undefined\r\n", b"Transfer-Encoding: chunked\r\n", b"Content-Encoding: gzip\r\n", b"5\r\nhello\r\n", b"0\r\n\r\n", b"<a href='x'", b"<!--", b"\x1f\x8b"])


@MANY
@given(st.lists(st.one_of(st.binary(max_size=40), WARC_PIECES), max_size=25))
def test_any_bytes_are_derived(parts):
    for d in warc.derive_all(b"".join(parts)):
        assert d["conversion"].startswith(b"WARC/1.0\r\n") and json.loads(next(warc.records(d["metadata"]))[1])["Conversion"] == d["conversion_id"]


def built(http, body, length=True, name="WARC-Type"):
    block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + body
    size = len(block) if length else "abc"
    return b"WARC/1.0\r\n%s: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %s\r\n\r\n" % (name.encode(), str(size).encode()) + block + b"\r\n\r\n"


def test_codings_and_spellings():
    page = "<p>café hello".encode("latin-1")
    text = lambda raw: warc.derive(raw)["text"]
    assert text(built(b"content-type: text/html; charset=latin-1", page, name="warc-type")) == "café hello"
    assert text(built(b"Content-Type: x; charset=undefined", b"hello")) == text(built(b"Content-Type: x; charset=base64", b"hello")) == "hello"
    assert text(built(b"Transfer-Encoding: chunked", b"5\r\nhello\r\n1;x=y\r\n!\r\n0\r\n\r\n")) == "hello!"
    assert text(built(b"Transfer-Encoding: chunked", b"not chunked")) == "not chunked"
    assert text(built(b"Content-Encoding: gzip", gzip.compress(b"hello"))) == text(built(b"Content-Encoding: deflate", zlib.compress(b"hello"))) == "hello"
    assert text(built(b"Content-Encoding: br", b"\x01\x02")) == "" and text(built(b"Content-Encoding: gzip", b"no")) == ""
    assert text(built(b"A: b", b"hello", length=False) + built(b"A: b", b"two")) == "hello"
    both = built(b"A: b", b"one") + built(b"A: b", b"two")
    assert [d["text"] for d in warc.derive_all(gzip.compress(both))] == ["one", "two"] and b"WARC-Date" not in warc.derive(both)["metadata"]


def plain_text(page):
    """Lines of a page by a hand-written scan: comments, raw-text elements and tags go, block elements end lines."""
    import html

    out, i, low = [], 0, page.lower()
    while i < len(page):
        if page.startswith("<!--", i):
            j = page.find("-->", i)
            i = len(page) if j < 0 else j + 3
            continue
        raw = re.match(r"<(script|style|template|noscript)\b", low[i : i + 12])
        if raw:
            end = re.compile(rf"</{raw[1]}\s*>").search(low, i)
            out.append(" ")
            i = end.end() if end else len(page)
            continue
        tag = re.match(r"</?([a-z][a-z0-9-]*)", low[i : i + 40]) if page[i] == "<" else None
        if tag:
            j, quote = i + len(tag[0]), ""
            while j < len(page) and (quote or page[j] not in "<>"):
                quote = "" if page[j] == quote else quote or (page[j] if page[j] in "\"'" else "")
                j += 1
            if j < len(page) and page[j] == ">":
                out.append("\n" if tag[1] in warc.BREAKS else "")
                i = j + 1
                continue
        if other := re.compile(r"<[!?/][^>]*>").match(page, i):
            i = other.end()
            continue
        out.append(" " if page[i] == "\n" else page[i])
        i += 1
    lines = [re.sub(r"[ \t\r\f\v ]+", " ", html.unescape(x)).strip() for x in "".join(out).split("\n")]
    return "\n".join(x for x in lines if x)


def test_derivatives_of_the_query(spark, sf):
    import base64
    import uuid

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op3_warc_derivatives"](spark, sf).collect()
    assert len(got) == len(pages)
    named = lambda *p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(p))}>"
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in got:
        p = pages[r.page_id]
        body = (p.html or "").encode()
        source = named("response", str(p.page_id), p.url or "")
        text = plain_text(p.html or "")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        head = [f"WARC-Record-ID: {named('conversion', source)}", f"WARC-Target-URI: {p.url or ''}", f"WARC-Refers-To: {source}", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/plain; charset=utf-8"]
        conversion = "\r\n".join(["WARC/1.0", "WARC-Type: conversion", *head, f"WARC-Block-Digest: {sha1(text.encode())}", f"Content-Length: {len(text.encode())}", "", ""]).encode() + text.encode() + b"\r\n\r\n"
        assert (r.response_id, r.target_uri, r.payload_digest, r.source_block_digest, r.n_chars, r.text_sha256, r.conversion_sha256) == (source, p.url or "", sha1(body), sha1(block), len(text), sha(text.encode()), sha(conversion))
        assert (r.metadata_id, r.conversion_id) == (named("metadata", source), named("conversion", source))
