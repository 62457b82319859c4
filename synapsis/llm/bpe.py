"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

Encoding. For every prefix of a pre-token, BPE's encoding ends in one token, and the tokens before it are the
encoding of the shorter prefix. The last token of the next prefix is the one vocabulary suffix whose predecessor
stays apart from it (`Merges.apart`). A token of at most ``lookahead + 1`` bytes must end among the last
``lookahead + 1`` prefixes, however the text goes on; so a token that all of these prefixes have in common is final:
it is given out and its bytes forgotten. ``lookahead`` follows from the merge list alone.

Decoding. Each token's bytes go through an incremental UTF-8 state machine that holds back an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, map_rows

#: How byte-level models cut text before merges: a fixed value.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The pattern's classes are those of Unicode 15; later letters and numbers are in neither class there.
BEYOND = regex.compile("[\\u0530-\U0010ffff]")
INFINITE = 1 << 60
#: Bytes of text that pick the tokens which may end there.
TAIL = 4
#: Distinct pre-tokens a worker remembers, of this many bytes at most; older ones are forgotten all at once.
REMEMBER, SHORT = 1 << 19, 64


def byte_letters() -> dict[str, int]:
    """The letters that byte-level models write bytes in: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(1)
def _later() -> regex.Pattern:
    """Letters and numbers of the regex library that Unicode 15 has not assigned."""
    known = regex.compile(r"[\p{L}\p{N}]")
    new = [c for c in map(chr, range(0x530, 0x110000)) if unicodedata.category(c) == "Cn" and known.match(c)]
    return regex.compile("[" + "".join(map(regex.escape, new)) + "]") if new else regex.compile("(?!)")


def classed(text: str) -> str:
    """``text`` as the pattern is to see it, of the same length: later letters become a private-use character."""
    return _later().sub("\ue000", text) if BEYOND.search(text) else text


class Merges:
    """A merge list and what follows from it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair[a, b] = rank
            parts.setdefault(whole, (a, b))
            self.rank.setdefault(whole, rank)
        self.parts = parts
        self.left: dict[int, list[int]] = {}
        self.right: dict[int, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        # by rank, so that parts are known before what they make: tokens that BPE can make of their own bytes
        self.token: dict[bytes, int] = {self.of[i]: i for i in vocab.values() if i not in parts}
        for whole, (a, b) in sorted(parts.items(), key=lambda x: self.rank[x[0]]):
            if self.of[a] in self.token and self.of[b] in self.token and self._first_join(a, b) == (a, b):
                self.token[self.of[whole]] = whole
        self.longest = max(map(len, self.token))
        #: By the last TAIL bytes: tokens that may end there, longest first, as (token, size); those beyond TAIL bytes
        #: are still to be looked up, so they have no token here. Shorter keys serve where the longer ones are missing.
        keys = {raw_[-TAIL:] for raw_ in self.token}
        long: dict[bytes, set[int]] = {}
        for raw_ in self.token:
            if len(raw_) > TAIL:
                long.setdefault(raw_[-TAIL:], set()).add(len(raw_))
        self.tails: dict[bytes, tuple[tuple[int | None, int], ...]] = {}
        for k in keys:
            short = [(self.token[k[-size:]], size) for size in range(len(k), 0, -1) if k[-size:] in self.token]
            self.tails[k] = (*((None, size) for size in sorted(long.get(k, ()), reverse=True)), *short)
        #: Bytes behind a token's end that always suffice to tell whether it stays.
        self.lookahead = self.longest - 1

    def _spine(self, t: int, side: int) -> list[int]:
        """``t``'s outermost parts on one side (0: left, 1: right), from the byte up to ``t``."""
        known = (self.left, self.right)[side]
        if t not in known:
            out = [t]
            while out[-1] in self.parts:
                out.append(self.parts[out[-1]][side])
            known[t] = out[::-1]
        return known[t]

    def _first_join(self, a: int, b: int) -> tuple[int, int] | None:
        """The first parts that merge across the border of ``a`` and ``b``, or None: the lowest rank goes first, then the leftmost."""
        xs, ys, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            grow_x = self.rank[xs[i + 1]] if i + 1 < len(xs) else INFINITE
            grow_y = self.rank[ys[j + 1]] if j + 1 < len(ys) else INFINITE
            across = self.pair.get((xs[i], ys[j]), INFINITE)
            if across < grow_x and across <= grow_y:
                return xs[i], ys[j]
            if grow_x == grow_y == INFINITE:
                return None
            if grow_x <= grow_y:
                i += 1
            else:
                j += 1

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` before ``b`` stays as these two tokens."""
        if (a, b) not in self.pairs:
            if len(self.pairs) >= REMEMBER:
                self.pairs.clear()
            self.pairs[a, b] = self._first_join(a, b) is None
        return self.pairs[a, b]


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


class Transducer:
    """Encodes the bytes of one pre-token as they come: ``feed`` gives the ids that have become final, ``finish`` the rest."""

    def __init__(self, table: Merges):
        self.table, self.buf, self.last = table, b"", []  # last: (token, bytes) that end each prefix of buf
        self.before: int | None = None  # the token that ends where buf begins

    def feed(self, part: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(part), 256):
            self._extend(part[at : at + 256])
            if len(self.buf) > 4 * self.table.longest:
                out += self._settle()
        return out

    def _extend(self, part: bytes) -> None:
        table, last, n, before = self.table, self.last, len(self.buf), self.before
        token, tails, pairs, apart = table.token.get, table.tails.get, table.pairs.get, table.apart
        self.buf = buf = self.buf + part
        for i in range(n + 1, len(buf) + 1):
            tail = buf[max(i - TAIL, 0) : i]
            while (found := tails(tail)) is None:
                if not (tail := tail[1:]):
                    raise ValueError(f"byte {buf[i - 1]} is not in the vocabulary")
            for end in found:
                t, size = end
                if t is None:
                    if size > i or (t := token(buf[i - size : i])) is None:
                        continue
                    end = t, size
                prev = last[i - size - 1][0] if i > size else before
                if prev is None or (apart(prev, t) if (known := pairs((prev, t))) is None else known):
                    last.append(end)
                    break
            else:
                raise ValueError(f"no token ends at byte {buf[i - 1]}")

    def _chain(self, end: int) -> list[int]:
        out = []
        while end:
            t, size = self.last[end - 1]
            out.append(t)
            end -= size
        return out[::-1]

    def _settle(self) -> list[int]:
        """Gives out what all prefixes that may hold the next token end have in common."""
        n = len(self.buf)
        ends = set(range(max(1, n - self.table.lookahead), n + 1))
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(top - self.last[top - 1][1])
        if not (at := ends.pop()):
            return []
        out = self._chain(at)
        self.before, self.buf, self.last = out[-1], self.buf[at:], self.last[at:]
        return out

    def finish(self) -> list[int]:
        out = self._chain(len(self.buf))
        self.buf, self.last, self.before = b"", [], None
        return out


class Encoder:
    """Encodes texts; remembers the ids of short pre-tokens within a bound."""

    def __init__(self, table: Merges):
        self.table, self.known, self.said = table, {}, {}
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(table.special, key=len, reverse=True)) + ")") if table.special else None

    def of(self, pre: str) -> tuple[int, ...]:
        raw = pre.encode()
        t = Transducer(self.table)
        ids = tuple(t.feed(raw) + t.finish())
        if len(raw) <= SHORT:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[pre] = ids
        return ids

    def part(self, pre: str) -> tuple[int, str, bytes]:
        """(ids, the ids as text, the bytes they stand for) of one pre-token."""
        ids = _long(self, pre)
        out = len(ids), ",".join(map(str, ids)), b"".join(map(self.table.of.__getitem__, ids))
        if len(pre) <= SHORT:
            if len(self.said) >= REMEMBER:
                self.said.clear()
            self.said[pre] = out
        return out

    def stream(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of ``text``, a few at a time; special strings in it become special tokens."""
        known = self.known
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                yield (self.table.special[part],)
                continue
            for m in PATTERN.finditer(classed(part)):
                pre = part[m.start() : m.end()]
                if len(pre) > 4 * SHORT:
                    t = Transducer(self.table)
                    for i in range(0, len(pre), 1024):
                        yield tuple(t.feed(pre[i : i + 1024].encode()))
                    yield tuple(t.finish())
                else:
                    yield known.get(pre) or self.of(pre)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]


class Decoder:
    """Ids to text as they come; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, table: Merges):
        self.of, self.machine = table.of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        try:
            raw = b"".join(map(self.of.__getitem__, ids))
        except KeyError:
            raw = b"".join([self.of.get(i, b"") for i in ids])
        return self.machine.decode(raw)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_encoders: dict[str, Encoder] = {}


def _forget() -> None:
    if _encoders:
        _encoders.clear()
        merges.cache_clear()


KEPT.append(_forget)


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(merges(path))
    return _encoders[path]


def _digests(e: Encoder, text: str) -> tuple[int, str, str]:
    """(tokens, SHA-256 of the ids, SHA-256 of what they decode to), a stretch of ids at a time."""
    ids_sha, text_sha, decoder, n, held, sep = hashlib.sha256(), hashlib.sha256(), Decoder(e.table), 0, [], ""
    table = e.table

    def flush():
        nonlocal n, sep
        n += len(held)
        ids_sha.update((sep + ",".join(map(str, held))).encode())
        text_sha.update(decoder.feed(held).encode())
        sep = ","
        held.clear()

    plain = len(text) < 1 << 16 and not any(s in text for s in table.special) and classed(text) is text
    if plain:  # the same as stream(), with less per pre-token: what is remembered is ids and bytes as they go into the digests
        known = e.said.get
        found = [known(pre) or e.part(pre) for pre in PATTERN.findall(text)]
        ids_sha.update(",".join([x[1] for x in found]).encode())
        text_sha.update((decoder.machine.decode(b"".join([x[2] for x in found])) + decoder.finish()).encode())
        return sum([x[0] for x in found]), ids_sha.hexdigest(), text_sha.hexdigest()
    for ids in e.stream(text):
        held += ids
        if len(held) > 1 << 14:
            flush()
    if held:
        flush()
    text_sha.update(decoder.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _long(e: Encoder, pre: str) -> list[int]:
    t = Transducer(e.table)
    return t.feed(pre.encode()) + t.finish()


def encode_column(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """``keep`` (all columns by default) and the ids of each whole text.

    Null and empty texts have none. Rows stand alone, so repeated rows give equal ids and an empty table gives an
    empty result. A kept column called ``out`` is replaced.
    """
    keys = [c for c in (docs.columns if keep is None else keep) if c != out]
    return _map(docs, keys, text_col, f"`{out}` array<int>", lambda texts: [pa.array([encoder(path).encode(t) for t in texts], pa.list_(pa.int32()))])


def decode_column(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the text of ``ids_col``; a null list is empty, and an id that is null or not in the vocabulary
    gives nothing, as in the library. Rows stand alone, so repeated rows give equal texts and an empty table gives an
    empty result. A column called ``out`` is replaced."""
    def of(lists):
        texts = []
        for ids in lists:
            d = Decoder(merges(path))
            texts.append(d.feed(ids or []) + d.finish())
        return [pa.array(texts, pa.string())]

    return map_rows(docs, [c for c in docs.columns if c != out], F.col(f"`{ids_col}`"), f"`{out}` string", of)


def digests(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    Null is empty: no tokens, and the digests of nothing. Rows stand alone, so repeated rows give equal results and an
    empty table gives an empty one. Kept columns that have an output's name are replaced.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keys = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def of(texts):
        found = [_digests(encoder(path), t) for t in texts]
        return [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())]

    return _map(docs, keys, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", of)


def _map(docs: DataFrame, keys: list[str], text_col: str, outputs: str, of) -> DataFrame:
    return map_rows(docs, keys, F.coalesce(F.col(f"`{text_col}`"), F.lit("")), outputs, of)
