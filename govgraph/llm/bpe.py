"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts are a few characters; each part is split by the pattern, and every
match is merged byte by byte in the order of ranks.  Neighbours are joined by encoding again a window
around their seam that grows on both sides until the tokens outside are provably final.  That is so
at a safe cut: where a letter, digit or ASCII mark is followed by white space.  No match of the split
pattern holds white space after anything else, and what the pattern matches before such a place never
depends on what follows it.  So joining is associative, with the empty text as its unit.  Decoding
concatenates up the same tree.

Null and empty texts have no tokens.  Texts of any length are encoded whole, in memory that follows
the longest one; rows are independent, repeated ones too, and an empty table gives an empty result.
Extra columns of any name are not read unless kept; a kept column may not have the name of a result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .work import mapped

LEAF_CHARS, LEAF_TOKENS = 256, 64
FIRST_WINDOW = 16
#: Matches remembered by a process, short ones only, in each of two generations: about 120 MB in all.
REMEMBERED, SHORT_MATCH = 1 << 18, 32
RANKS = "byte_bpe_multi_50k.tiktoken"


@cache
def codec(ranks: str) -> "Codec":
    return Codec(ranks)


class Codec:
    """An encoding from a file of ranks: a name among the public tokenizers, or a path."""

    def __init__(self, ranks: str):
        import public_tokenizers

        with open(ranks if "/" in ranks else public_tokenizers.path(ranks), "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.spelled = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.spelled[rank] = token
        self.shown = [str(i) for i in range(len(self.spelled))]
        self.length = np.array([len(token) for token in self.spelled], np.int64)
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, match: bytes) -> list[int]:
        """Of all neighbours that make up a token, those of the lowest rank (the first such) merge, until none do."""
        rank = self.rank
        if match in rank:
            return [rank[match]]
        n = len(match)
        ends = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is merged into the one before
        starts = list(range(-1, n))  # where the part before the place begins
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(match[i : i + 2])) is not None]
        heapify(waiting)
        while waiting:
            _, at, end = heappop(waiting)
            middle = ends[at]
            if not middle or middle >= end or ends[middle] != end:
                continue  # one of the two has been merged since
            ends[at], ends[middle] = end, 0
            starts[end] = at
            if end < n and (r := rank.get(match[at : ends[end]])) is not None:
                heappush(waiting, (r, at, ends[end]))
            if at and (r := rank.get(match[starts[at] : end])) is not None:
                heappush(waiting, (r, starts[at], end))
        out, at = [], 0
        while at < n:
            out.append(rank[match[at : ends[at]]])
            at = ends[at]
        return out

    def leaf(self, text: str) -> list[int]:
        known, new = self.remembered.get, self._new
        return [i for match in self.split(text) for i in known(match) or new(match)]

    def _new(self, match: str) -> tuple[int, ...]:
        ids = self.older.get(match) or tuple(self.merged(match.encode()))
        if len(match) <= SHORT_MATCH:
            if len(self.remembered) >= REMEMBERED:
                self.older, self.remembered = self.remembered, {}
            self.remembered[match] = ids
        return ids

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        return np.array(self.tokens(text, leaf_chars), np.uint32)

    def tokens(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        return self._range(text, 0, len(text), leaf_chars)

    def _range(self, text: str, start: int, end: int, leaf_chars: int) -> list[int]:
        if end - start <= leaf_chars:
            return self.leaf(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._range(text, start, middle, leaf_chars), self._range(text, middle, end, leaf_chars))

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[start:end] from those of its two parts."""
        if not left or not right or _safe(text, middle):
            return left + right
        lo, hi = _cut_before(text, start, middle), _cut_after(text, middle, end)
        before, after = len(text[lo:middle].encode()), len(text[middle:hi].encode())
        keep, skip = len(left), 0
        while before > 0:
            keep -= 1
            before -= len(self.spelled[left[keep]])
        while after > 0:
            after -= len(self.spelled[right[skip]])
            skip += 1
        return left[:keep] + self.leaf(text[lo:hi]) + right[skip:]

    def decode(self, ids: list[int], leaf_tokens: int = LEAF_TOKENS) -> bytes:
        return self._spelled(ids, 0, len(ids), leaf_tokens)

    def _spelled(self, ids: list[int], start: int, end: int, leaf_tokens: int) -> bytes:
        if end - start <= leaf_tokens:
            return b"".join(map(self.spelled.__getitem__, ids[start:end]))
        middle = (start + end) // 2
        return self._spelled(ids, start, middle, leaf_tokens) + self._spelled(ids, middle, end, leaf_tokens)


def _safe(text: str, at: int) -> bool:
    return text[at] in " \n\t\r" and (text[at - 1].isalnum() or "!" <= text[at - 1] <= "~")


def _cut_before(text: str, start: int, middle: int) -> int:
    """The last safe cut in text[start + 1 : middle], looked for in windows of growing size; start without one."""
    size, seen = FIRST_WINDOW, middle
    while seen > start + 1:
        low = max(start + 1, middle - size)
        for at in range(seen - 1, low - 1, -1):
            if text[at] in " \n\t\r" and _safe(text, at):
                return at
        seen, size = low, size * 2
    return start


def _cut_after(text: str, middle: int, end: int) -> int:
    size, seen = FIRST_WINDOW, middle + 1
    while seen < end:
        high = min(end, middle + size)
        for at in range(seen, high):
            if text[at] in " \n\t\r" and _safe(text, at):
                return at
        seen, size = max(seen, high), size * 2
    return end


def encode_documents(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str = RANKS, digests: bool = False) -> DataFrame:
    """The columns ``keep`` with ``ids`` and ``decoded``, or with ``digests`` their number and SHA-256 sums."""
    sent = docs.select(*dict.fromkeys((*keep, text)))
    types = {f.name: f.dataType.simpleString() for f in sent.schema.fields}
    named = ", ".join(f"`{c}` {types[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                rows = [part.column(k) for k in keep]
                found = []
                for value in part.column(text):
                    ids = c.tokens(value.as_py() or "")
                    decoded = c.decode(ids)
                    if digests:
                        shown = ",".join(map(c.shown.__getitem__, ids)).encode()
                        found.append((len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                    else:
                        found.append((pa.array(ids, pa.int32()), decoded))
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                if digests:
                    out = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    sizes = np.cumsum([0, *map(len, columns[0])]).astype(np.int32)
                    flat = pa.concat_arrays(columns[0]) if columns[0] else pa.array([], pa.int32())
                    out = [pa.ListArray.from_arrays(pa.array(sizes), flat), pa.array(columns[1], pa.binary())]
                    names = ["ids", "decoded"]
                yield pa.record_batch([*rows, *out], names=[*keep, *names])

    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return mapped(sent, run, f"{named}, {more}")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of what they decode to."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
