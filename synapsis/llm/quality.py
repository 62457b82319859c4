"""Repetition rules: characters inside duplicated n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, batch, lighten, map_rows

#: Largest share of the characters in words that repeated n-grams may cover (places after the first), by n: fixed values.
NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of the characters in lines, that may be repeats of an earlier line: fixed values.
LINE_SHARE, LINE_CHAR_SHARE = 0.30, 0.20
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash, mod 2^64, of each ``n`` consecutive 64-bit word hashes."""
    if len(values) < n:
        return values[:0]
    with np.errstate(over="ignore"):
        out = values[: len(values) - n + 1].copy()
        for i in range(1, n):
            out = out * BASE + values[i : len(values) - n + 1 + i]
    return out


def covered(h: np.ndarray, n: int, words: int, first: bool) -> np.ndarray:
    """Mask of the words in n-grams found twice or more; ``first``: also in their first place."""
    mask = np.zeros(words + 1, np.int64)
    if len(h):
        _, start, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        at = count[back] > 1
        if not first:
            at[start] = False
        at = np.flatnonzero(at)
        np.add.at(mask, at, 1)
        np.add.at(mask, at + n, -1)
    return np.cumsum(mask)[:words] > 0


def measure(text: str) -> dict:
    """All counts of one text."""
    words = WORD.findall(text)
    n, digest = len(words), xxhash.xxh3_64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, n)
    values = np.array([digest(w) for w in words], np.uint64)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    earlier, dup_lines, dup_line_chars = set(), 0, 0
    for x in lines:
        if x in earlier:
            dup_lines += 1
            dup_line_chars += len(x)
        earlier.add(x)
    five = rolling(values, WINDOW)
    chars = {k: int(sizes[covered(five if k == WINDOW else rolling(values, k), k, n, False)].sum()) for k in NGRAM_SHARE}
    return {
        "n_words": n, "word_chars": int(sizes.sum()), "n_symbols": len(SYMBOLS.findall(text)), "n_dup_lines": dup_lines,
        "n_repeat_words": int(covered(five, WINDOW, n, True).sum()), "n_lines": len(lines), "line_chars": sum(map(len, lines)),
        "dup_line_chars": dup_line_chars, "dup_ngram_chars": [chars[k] for k in NGRAM_SHARE],
    }


SCHEMA = pa.schema([*((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "line_chars", "dup_line_chars")), ("dup_ngram_chars", pa.list_(pa.int64()))])
SCHEMA_SQL = ", ".join(f"{f.name} {'array<bigint>' if pa.types.is_list(f.type) else 'bigint'}" for f in SCHEMA)


def repetition(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), then the counts, base_failed and kept.

    base_failed: under 10 words, or over 20 % of the words in repeated 5-word windows. kept: not base_failed, and the
    characters inside repeated 5- to 10-grams and repeated lines stay within NGRAM_SHARE, LINE_SHARE and
    LINE_CHAR_SHARE. Null and empty texts have zero counts and fail; each row is judged alone, so repeated rows get
    equal verdicts and an empty table gives an empty result. A kept column that has a count's name is replaced by it.
    """
    outputs = {*SCHEMA.names, "base_failed", "kept"}
    keys = [c for c in (docs.columns if keep is None else keep) if c not in outputs]

    def of(texts):
        lighten()
        found = [measure(x) for x in texts]
        return batch(SCHEMA, *([m[c] for m in found] for c in SCHEMA.names)).columns

    out = map_rows(docs, keys, F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SCHEMA_SQL, of)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    bad = (F.col("n_dup_lines") > LINE_SHARE * F.col("n_lines")) | (F.col("dup_line_chars") > LINE_CHAR_SHARE * F.col("line_chars"))
    for i, share in enumerate(NGRAM_SHARE.values()):
        bad = bad | (F.col("dup_ngram_chars")[i] > share * F.col("word_chars"))
    return out.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~bad)
