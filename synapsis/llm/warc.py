"""WARC derivatives: linked metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Date of the responses that are built around pages, which have none of their own.
DATE = "2024-01-01T00:00:00Z"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space: a fixed value
EOL = b"\r\n"
#: What is no text: comments, declarations, raw-text elements, tags.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
HREF = re.compile(r"(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that end a line: fixed values.
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
BLANK = re.compile(r"[ \t\r\f\v ]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """An id that the same parts always give."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, chr(0).join(parts))}>"


def record(kind: str, block: bytes, fields: dict[str, str]) -> bytes:
    """One WARC/1.0 record."""
    head = {"WARC-Type": kind, **fields, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    lines = [b"WARC/1.0", *(f"{k}: {v}".encode() for k, v in head.items())]
    return EOL.join(lines) + EOL * 2 + block + EOL * 2


def headers(raw: bytes) -> dict[str, str]:
    """Named fields of a header block; continuation lines are joined, and a repeated name's values by a comma. Names
    that differ in case are one, spelt as the first."""
    out: dict[str, str] = {}
    spelt: dict[str, str] = {}
    name = None
    for line in raw.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = spelt.setdefault(name.strip().lower(), name.strip())
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def field(fields: dict[str, str], name: str, default: str = "") -> str:
    """The value of the field ``name``, in whatever case it is spelt."""
    return next((v for k, v in fields.items() if k.lower() == name.lower()), default)


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; bytes between records are skipped. A block without a usable length ends where
    the next record begins."""
    at = raw.find(b"WARC/")
    while at >= 0:
        end = raw.find(EOL * 2, at)
        if end < 0:
            return
        fields = headers(raw[raw.find(EOL, at) + 2 : end])
        size = field(fields, "Content-Length")
        if size.isascii() and size.isdigit() and len(size) < 19:
            stop = min(end + 4 + int(size), len(raw))
        else:
            stop = raw.find(EOL + b"WARC/", end + 4)
            stop = len(raw) if stop < 0 else stop + 2
        yield fields, raw[end + 4 : stop]
        at = raw.find(b"WARC/", stop)


def unchunked(body: bytes) -> bytes:
    """The body without its chunk sizes; as it is, if it is not chunked after all."""
    out, at = [], 0
    while at < len(body):
        line = body.find(EOL, at)
        size = re.match(rb"\s*([0-9a-fA-F]{1,15})\s*(?:;|$)", body[at : line if line >= 0 else len(body)])
        if not size or line < 0:
            return body
        if not (n := int(size[1], 16)):
            break
        out.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2
    return b"".join(out)


def decoded(body: bytes, coding: str) -> bytes | None:
    """The body without its content codings, the last first; None for one that is unknown or does not fit."""
    for name in reversed([c.strip().lower() for c in coding.split(",") if c.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif name == "deflate":
                body = zlib.decompress(body, 15 if body[:1] == b"x" else -15)
            elif name != "identity":
                return None
        except (OSError, EOFError, zlib.error):
            return None
    return body


def as_text(body: bytes, kind: str) -> str:
    """``body`` in the charset that the content type names; in UTF-8 if that is none or cannot decode it."""
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    with contextlib.suppress(LookupError, ValueError):
        if charset:
            return body.decode(charset.group(1), "replace")
    return body.decode("utf-8", "replace")


def extract(page: str) -> tuple[str, str, list[str]]:
    """(title, text, links) of a page. Text has one line for each block element, runs of blanks as one, no empty lines."""
    out, links, at = [], [], 0
    for m in MARKUP.finditer(page):
        out.append(page[at : m.start()].replace("\n", " "))
        at = m.end()
        if m.group(1):
            out.append(" ")
        elif name := m.group(3):
            name = name.lower()
            if name in BREAKS:
                out.append("\n")
            if name == "a" and not m.group(2) and (h := HREF.search(m.group(4))):
                links.append(html.unescape(next(x for x in h.groups() if x is not None)))
    out.append(page[at:].replace("\n", " "))
    lines = (BLANK.sub(" ", html.unescape(x)).strip() for x in "".join(out).split("\n"))
    title = TITLE.search(page)
    return (BLANK.sub(" ", html.unescape(title.group(1)).replace("\n", " ")).strip() if title else ""), "\n".join(x for x in lines if x), links


def response(target: str, body: bytes, key: str, date: str = DATE) -> bytes:
    """A response record for a page without one."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return record("response", block, {
        "WARC-Record-ID": record_id("response", key, target), "WARC-Date": date, "WARC-Target-URI": target,
        "WARC-Payload-Digest": digest(body), "Content-Type": "application/http; msgtype=response",
    })


def derive(raw: bytes) -> dict | None:
    """The metadata and conversion records of the first response in ``raw``, or None."""
    return next(derive_all(raw), None)


def derive_all(raw: bytes) -> Iterator[dict]:
    """The metadata and conversion records of each response in ``raw``.

    Both refer to the response's id and carry its target and date; the metadata block has the response's own fields
    and HTTP headers, its digests, title and links; the conversion block is the plain text. Ids follow from the
    response's id, so building them again gives the same bytes. Field names are read in any case; chunks and gzip or
    deflate are undone first (the payload's digest is that of the unchunked body), and a body in another coding has no
    text. No bytes fail: what cannot be read is taken as it is, or as no text. A record without a date gets none.
    """
    if raw[:2] == b"\x1f\x8b":  # records are often compressed one by one
        raw = decoded(raw, "gzip") or b""
    for fields, block in records(raw):
        if field(fields, "WARC-Type").lower() != "response":
            continue
        head, _, body = block.partition(EOL * 2)
        status, _, rest = head.partition(EOL)
        http = headers(rest)
        if "chunked" in field(http, "Transfer-Encoding").lower():
            body = unchunked(body)
        plain_body = decoded(body, field(http, "Content-Encoding"))
        title, text, links = extract(as_text(plain_body or b"", field(http, "Content-Type")))
        source, own_digest = field(fields, "WARC-Record-ID"), digest(body)
        common = {"WARC-Target-URI": field(fields, "WARC-Target-URI"), "WARC-Refers-To": source}
        if date := field(fields, "WARC-Date"):
            common["WARC-Date"] = date
        conversion_id, metadata_id = record_id("conversion", source), record_id("metadata", source)
        plain = text.encode("utf-8", "replace")
        meta = json.dumps({
            "Response": fields, "Status": status.decode("latin-1"), "HTTP": http, "Title": title, "Links": links,
            "Payload-Digest": own_digest, "Payload-Length": len(body), "Conversion": conversion_id,
        }, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
        yield {
            "response_id": source, "target_uri": common["WARC-Target-URI"], "payload_digest": own_digest, "source_block_digest": field(fields, "WARC-Block-Digest") or digest(block),
            "metadata_id": metadata_id, "conversion_id": conversion_id, "title": title, "text": text, "n_links": len(links),
            "metadata": record("metadata", meta, {"WARC-Record-ID": metadata_id, **common, "WARC-Concurrent-To": conversion_id, "Content-Type": "application/json"}),
            "conversion": record("conversion", plain, {"WARC-Record-ID": conversion_id, **common, "Content-Type": "text/plain; charset=utf-8"}),
        }


FIELDS = pa.schema([*((c, pa.string()) for c in ("response_id", "target_uri", "payload_digest", "source_block_digest", "metadata_id", "conversion_id", "title", "text")), ("n_links", pa.int64()), ("metadata", pa.binary()), ("conversion", pa.binary())])
FIELDS_SQL = ", ".join(f"{f.name} {({pa.string(): 'string', pa.int64(): 'bigint'}).get(f.type, 'binary')}" for f in FIELDS)


def derivatives(responses: DataFrame, warc_col: str = "warc", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all other columns by default) and the derived records of each response record: a row for each.

    Bytes without a response record (null and empty too) give one row of nulls. Rows stand alone, so repeated rows give equal
    records; an empty table gives an empty result. Kept columns that have an output's name are replaced.
    """
    keys = [c for c in (keep if keep is not None else [c for c in responses.columns if c != warc_col]) if c not in FIELDS.names]
    return map_rows(responses, keys, F.col(f"`{warc_col}`").cast("binary"), FIELDS_SQL, _derived)


def page_derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, derived records) of each page, which first becomes a response record. Null pages and addresses are
    empty; repeated rows give equal records; an empty table gives an empty result; other columns are ignored."""
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), text(url_col).alias("url"), text(html_col).alias("html"))
    page = F.struct(F.col("page_id").cast("string").alias("key"), "url", "html")

    def of(rows):
        return _derived([response(r["url"], r["html"].encode(), str(r["key"])) for r in rows])

    return map_rows(rows, ["page_id"], page, FIELDS_SQL, of)


def _derived(raws: list) -> tuple[pa.Array, list[pa.Array]]:
    each = [list(derive_all(r or b"")) or [{}] for r in raws]
    at, found = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each])), [x for r in each for x in r]
    return at, [pa.array([x.get(f.name) for x in found], f.type) for f in FIELDS]
