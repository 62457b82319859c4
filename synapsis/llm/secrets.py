"""Secret scans over an incremental ledger of content-addressed blobs.

A version of a document is a blob, named by the SHA-256 of its text. The ledger holds what each rule version found in
each blob. A scan reads only the (blob, rule version) pairs that the ledger lacks, one copy of each, and joins the
findings back to every row (path) that has the blob.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pieces

#: Kinds in the order in which equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "github", "slack", "google", "jwt")
# The base rules, then forms of well-known credentials.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more
OTHER = {
    "private_key": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),  # and what `_key_end` adds
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
}
KEY_EDGE = re.compile(r"-----(BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----")
#: Lines of a key without an END line: fields, or letters of Base64 (escaped line ends too).
KEY_BODY = re.compile(r"(?:\s|\\[nr]|(?:Proc-Type|DEK-Info|Key-Info|Version|Comment|Charset|Hash): [^\n]*\n|[A-Za-z0-9+/=]{16,}|[A-Za-z0-9+/]*={1,2}(?![A-Za-z0-9+/=]))*+")
HINTS = ("pass", "secret", "token", "api")
MARKS = {"private_key": "PRIVATE KEY-----", "github": "gh", "slack": "xox", "google": "AIza", "jwt": ".eyJ"}
RULES = "2-" + hashlib.sha256(repr((ASSIGN.pattern, ACCESS.pattern, HEX.pattern, KEY_EDGE.pattern, KEY_BODY.pattern, sorted((k, p.pattern) for k, p in OTHER.items()))).encode()).hexdigest()[:12]


def private_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of every private key: from its BEGIN line through its END line. A key that is cut off before that
    ends with the last line that can belong to it, or where the next one begins."""
    edges, out = [(m.start(), m.end(), m[1]) for m in KEY_EDGE.finditer(text)], []
    for (a, b, kind), follows in zip(edges, [*edges[1:], None]):
        if kind == "BEGIN":
            whole = follows and follows[2] == "END"
            out.append((a, follows[1] if whole else KEY_BODY.match(text, b, follows[0] if follows else len(text)).end()))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind; code points."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for kind, rule in OTHER.items():
        if MARKS[kind] in text:
            out += [(kind, *x) for x in (private_keys(text) if kind == "private_key" else (m.span() for m in rule.finditer(text)))]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches):
    for b in pieces(batches):
        found = [find(t) for t in b.column("text").to_pylist()]
        kinds, starts, ends = ([[x[i] for x in f] for f in found] for i in range(3))
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["blob", "kinds", "starts", "ends"])


class Ledger:
    """A ledger kept as Parquet under ``path``, a folder that the cluster shares: one subfolder for each scan.

    A scan counts once its _SUCCESS file is there, so a scan that was cut off is done again. Scans that ran side by
    side may both hold a pair; `scan_versions` takes each pair once. ``read`` is None before the first scan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        done = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        parts = [f.getPath().getParent().toString() for f in done]
        return self.spark.read.schema(f"{LEDGER}, rule_version string").parquet(*parts) if parts else None

    def append(self, entries: DataFrame) -> None:
        entries.write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def scan(self, versions: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: str = RULES) -> tuple[DataFrame, DataFrame]:
        """`scan_versions` against this ledger, which then holds what was scanned now."""
        found, entries = scan_versions(versions, text_col, keep, self.read(), rules)
        self.append(entries)
        return found, entries


LEDGER = "blob string, kinds array<string>, starts array<int>, ends array<int>"


def scan_versions(versions: DataFrame, text_col: str = "text", keep: list[str] | None = None, ledger: DataFrame | None = None, rules: str = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, entries): ``keep`` (all columns by default) with blob, kinds, starts and ends of each row, and new ledger rows.

    ``ledger`` has (blob, rule_version, kinds, starts, ends) of earlier scans; pairs that it holds are not scanned
    again. ``entries`` are the pairs scanned now, already written to the shared folder: append them to the ledger.
    Null text is the empty blob. Rows that repeat a text share its one scan and are each returned, in any number; an
    empty table gives two empty results. Kept columns that have an output's name are replaced.
    """
    names = ("blob", "kinds", "starts", "ends")
    keys = [c for c in (versions.columns if keep is None else keep) if c not in names]
    scratch = Scratch(versions.sparkSession, "ledger")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blob = F.sha2(text, 256)
    blobs = versions.select(blob.alias("blob"), text.alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rules).select(*names).dropDuplicates(["blob"])
        blobs = blobs.join(known.select("blob"), "blob", "left_anti")
    # copies of a blob are folded into one before the shuffle, so a very common text is a row of each task at most
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    entries = scratch.save(unseen.mapInArrow(_scan, LEDGER).withColumn("rule_version", F.lit(rules)), "entries")
    scratch.release()
    found = entries.select(*names) if ledger is None else entries.select(*names).union(known)
    return versions.select(*(F.col(f"`{c}`") for c in keys), blob.alias("blob")).join(found, "blob").select(*keys, *names), entries


def listed(base: bool):
    """The spans as kind:start:end, comma-joined; ``base``: those of the base kinds."""
    each = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string")))
    if base:
        each = F.filter(each, lambda x: F.split(x, ":")[0].isin(*KINDS[:3]))
    return F.array_join(each, ",")


def count(kind: str):
    return F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")


def redact(docs: DataFrame, text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``[kind]``; overlapping spans become one, named after the first.

    Null stays null, and a text without secrets stays as it is. Rows that repeat a text are each returned; an empty
    table gives an empty result. Other columns, whatever their names, come back as they were.
    """
    columns = docs.columns
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    found, _ = scan_versions(docs.select(*inner), f"c{columns.index(text_col)}", None, ledger)
    at = columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name not in ("blob", "kinds", "starts", "ends"))

    def run(batches):
        for b in pieces(batches):
            texts = []
            for text, kinds, starts, ends in zip(*(b.column(c).to_pylist() for c in (f"c{at}", "kinds", "starts", "ends"))):
                if starts:
                    parts, left = [], 0
                    for kind, x, y in zip(kinds, starts, ends):
                        if x >= left:
                            parts += [text[left:x], f"[{kind}]"]
                        left = max(left, y)
                    text = "".join([*parts, text[left:]])
                texts.append(text)
            rows = [pa.array(texts, pa.string()) if i == at else b.column(f"c{i}") for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(rows, names=[f"c{i}" for i in range(len(columns))])

    return found.mapInArrow(run, schema).toDF(*columns)
