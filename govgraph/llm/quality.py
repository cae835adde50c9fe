"""Quality rules with suffix-array repetition.

The words of each text get a suffix array (prefix doubling over word identities; only suffixes that
are still tied take part in a round).  Longest common prefixes of neighbours give the maximal
repeated passages; their spans are united per text.  The verdict limits the fraction of words in
repeated passages and the length of the longest one.

Null and empty texts have no words and fail the base rules.  Rows are independent: ties, repeated
rows and extra columns of any name change nothing.  Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .work import mapped

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Limits of the repetition verdict: a passage counts from LONG_WORDS words on.  Its words are among those that the base
#: counts, so its share must be below the base's to reject anything; one passage over 50 words is a copied paragraph.
LONG_WORDS, MAX_LONG_PERCENT, MAX_LONGEST_WORDS = 10, 10, 50
BLANK = b" \t\n\v\f\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_long_repeat_words long, longest_repeat_words long, base_failed boolean, kept boolean"


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of the sequence in the order of their suffixes.

    ``ids`` are non-negative integers, ``ends`` gives for each position the end of its own row: a
    suffix stops there, and its row is the first thing compared when the ids keep rows apart.
    """
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    if not n:
        return sa
    key = ids[sa]
    head = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(at, np.diff(np.r_[at, n]))
    step = 1
    while True:
        first = np.r_[head, True]
        slots = np.flatnonzero(~(first[:-1] & first[1:]))  # of groups with more than one member
        if not len(slots):
            return sa
        pos = sa[slots]
        nxt = pos + step
        second = np.where(nxt < ends[pos], rank[np.minimum(nxt, n - 1)] + 1, 0)
        group = rank[pos]
        order = np.lexsort((second, group))
        pos, second, group = pos[order], second[order], group[order]
        sa[slots] = pos
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        head[slots] = new
        starts = slots[new]
        rank[pos] = np.repeat(starts, np.diff(np.r_[np.flatnonzero(new), len(pos)]))
        step *= 2


def common_prefix(left: np.ndarray, right: np.ndarray, ends: np.ndarray, hashes: K.Prefix) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``left`` and ``right``, by halving over slice hashes."""
    room = np.minimum(ends[left] - left, ends[right] - right)
    got = np.zeros(len(left), np.int64)
    step = 1 << max(0, int(room.max(initial=0)).bit_length() - 1)
    while step:
        can = np.flatnonzero(got + step <= room)
        a, b = left[can] + got[can], right[can] + got[can]
        same = can[hashes.raw(a, a + step) == hashes.raw(b, b + step)]
        got[same] += step
        step //= 2
    return got


def repeats(word_hash: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words where a passage of at least ``least`` words begins that the row holds twice, and its length."""
    n = len(word_hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = K.row_of(first)
    ends = first[1:][row]
    _, ids = np.unique(K.mix(word_hash + row.astype(np.uint64) * K.P_BYTE), return_inverse=True)
    sa = suffix_array(ids, ends)
    pair = np.flatnonzero(ids[sa[1:]] == ids[sa[:-1]])
    hashes = K.Checked(word_hash)
    a, b = sa[pair], sa[pair + 1]
    enough = np.flatnonzero((a + least <= ends[a]) & (b + least <= ends[b]))
    enough = enough[hashes.raw(a[enough], a[enough] + least) == hashes.raw(b[enough], b[enough] + least)]
    lcp = common_prefix(a[enough], b[enough], ends, hashes)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a[enough], lcp)
    np.maximum.at(best, b[enough], lcp)
    at = np.flatnonzero(best)
    return at, best[at]


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the spans cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def _dup_lines(b: K.Block) -> np.ndarray:
    """Lines with a word that equal an earlier one of their row, compared as they are."""
    data, out = b.data.tobytes(), np.zeros(b.rows, np.int64)
    for row, (lo, hi) in enumerate(zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True)):
        lines = [line for line in data[lo:hi].split(b"\n") if line.strip(BLANK)]
        out[row] = len(lines) - len(set(lines))
    return out


def measure(b: K.Block) -> dict[str, np.ndarray]:
    starts, ends, first = K.word_spans(b)
    n_words = np.diff(first)
    word_hash = K.word_hashes(b.data, starts, ends)
    points = (b.data & 0xC0) != 0x80
    at, length = repeats(word_hash, first, WINDOW_WORDS)
    row = K.row_of(first)
    long = length >= LONG_WORDS
    n_repeat = K.row_sums(covered(at, length, len(starts)), first)
    n_long = K.row_sums(covered(at[long], length[long], len(starts)), first)
    longest = np.zeros(b.rows, np.int64)
    np.maximum.at(longest, row[at], length)
    base = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    verdict = (100 * n_long <= MAX_LONG_PERCENT * n_words) & (longest <= MAX_LONGEST_WORDS)
    return {
        "n_words": n_words,
        "word_chars": K.row_sums(points & K.WORD_BYTE[b.data], b.offs),
        "n_symbols": K.row_sums(_SYMBOL[b.data], b.offs),
        "n_dup_lines": _dup_lines(b),
        "n_repeat_words": n_repeat,
        "n_long_repeat_words": n_long,
        "longest_repeat_words": longest,
        "base_failed": base,
        "kept": ~base & verdict,
    }


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), only_kept: bool = False) -> DataFrame:
    """The columns ``keep`` of each row with its measures; with ``only_kept`` the rows that pass, without measures."""
    sent = docs.select(*dict.fromkeys((*keep, text)))
    fields = [f for f in sent.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.blocks(batch.column(text)):
                found = measure(b)
                rows = batch.slice(b.first, b.rows)
                columns = [rows.column(c) for c in keep]
                if only_kept:
                    out = pa.record_batch(columns, names=list(keep)).filter(pa.array(found["kept"]))
                else:
                    out = pa.record_batch([*columns, *(pa.array(v) for v in found.values())], names=[*keep, *found])
                yield out

    order = {c: i for i, c in enumerate(keep)}
    fields.sort(key=lambda f: order[f.name])
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return mapped(sent, run, named if only_kept else f"{named}, {SCHEMA}")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Every document with its base measures, base verdict and final verdict."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
