"""Suffix-array dedup of repeated passages, with deep-shallow sorting.

A byte goes when a ``length``-byte string that covers it also starts anywhere else, in the same text
or another.  Strings are judged on the input and never cross texts.

1. Anchors.  Each string has one anchor, its least hash of a short gram (a minimizer), so equal
   strings have equal anchors in the same place.  Neighbouring strings share anchors: about one row
   for 75 bytes describes all strings of a text as (anchor, range of starts, hash of their context).
2. An anchor seen once has only unique strings.  A context seen twice has only repeated ones.  What
   is left are contexts of their own under a shared anchor, at the edges of passages.
3. One copy of each such context goes to its anchor.  There two suffix arrays are built, of what
   follows the anchor and, reversed, of what precedes it, by multikey quicksort down to
   ``SHALLOW`` bytes and a blind trie for each group that is still tied.  A string repeats where two
   contexts agree far enough on both sides, which the common prefixes along both arrays tell.
4. A group of more contexts than ``AT_ONCE`` is parted first, by the bytes next to the anchor: the
   places where its strings may begin are halved, the strings of a half share more bytes around the
   anchor, and contexts that differ in those go to different groups.  Contexts that are equal as far
   as a half's strings reach are repeated there, and one of them goes on.  At a single place nothing
   can be left, so every group gets small, and no task holds more than that.

Null and empty texts and those under ``length`` bytes lose nothing.  Equal rows are copies of each
other and lose all (from ``length`` bytes on).  Texts of any length are read whole, and an empty
table gives an empty result.  Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .work import mapped, small_batches, stash, steady

LENGTH, GRAM = 200, 48
SHALLOW = 32
#: Contexts of a group that are sorted at once: about 1 MB.
AT_ONCE = 1 << 12


def sliding(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each window of w: prefix and suffix minima of blocks of w."""
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    y = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def anchors(b: K.Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash, context hash) of each run of strings with one anchor."""
    n, w = len(b.data), length - gram + 1
    nothing = np.zeros(0, np.int64)
    if n < length:
        return nothing, nothing, nothing, nothing.view(np.uint64), nothing.view(np.uint64)
    prefix = K.Prefix(b.data)
    at = np.arange(n - gram + 1)
    grams = K.mix(prefix.raw(at, at + gram))
    least = sliding(grams, w)
    inside = np.zeros(n - length + 1, bool)
    for lo, hi in zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True):
        inside[lo : max(lo, hi - length + 1)] = True
    starts = np.flatnonzero(inside)
    if not len(starts):
        return nothing, nothing, nothing, nothing.view(np.uint64), nothing.view(np.uint64)
    of = least[starts]
    # A new run: another anchor, another text, or the anchor lay at the start just passed.
    new = np.r_[True, (of[1:] != of[:-1]) | (starts[1:] != starts[:-1] + 1) | (grams[starts[:-1]] == of[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(starts)] - 1
    lo, hi = starts[first], starts[last]
    row = np.searchsorted(b.offs, lo, "right") - 1
    return row, lo - b.offs[row], hi - b.offs[row], of[first], prefix.of(lo, hi + length)


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, context, doc_id, at: mark (24 bits), first start (32), number of starts less one (8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        for batch in batches:
            ids = batch.column("doc_id")
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            for b in K.blocks(batch.column("text")):
                row, lo, hi, anchor, context = anchors(b, length, gram)
                at = (marks[b.first + row] << 40) | (lo << 8) | (hi - lo)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), ids.take(pa.array(b.first + row)), pa.array(at)], names=["anchor", "context", "doc_id", "at"])

    return mapped(docs.select("doc_id", "mark", "text"), run, "anchor long, context long, doc_id long, at long")


def blind_trie(items: list[int], text: list[bytes]) -> list[tuple[int, int]]:
    """(item, common prefix with the one before) in sorted order.

    A node is [depth, branches by byte]; only branching places are stored.  An item goes down blindly
    by the bytes at those places to some leaf, is compared with that one string, and is put in where
    they part.
    """
    root: list | int | None = None
    same: dict[int, list[int]] = {}
    for item in items:
        own = text[item]
        if root is None:
            root = item
            continue
        node = root
        while isinstance(node, list):
            depth, below = node
            node = below.get(own[depth] if depth < len(own) else -1)
            if node is None:
                node = next(iter(below.values()))
        other = text[node]
        n = min(len(own), len(other))
        if own[:n] == other[:n]:
            part = n
        else:
            x = int.from_bytes(own[:n], "big") ^ int.from_bytes(other[:n], "big")
            part = n - (x.bit_length() + 7) // 8
        if part == n and len(own) == len(other):
            same.setdefault(node, []).append(item)
            continue
        above, node = None, root
        while isinstance(node, list) and node[0] < part:
            above, node = node, node[1][own[node[0]]]
        byte = own[part] if part < len(own) else -1
        if isinstance(node, list) and node[0] == part:
            node[1][byte] = item
        else:
            split = [part, {byte: item, (other[part] if part < len(other) else -1): node}]
            if above is None:
                root = split
            else:
                above[1][own[above[0]]] = split
    out: list[tuple[int, int]] = []
    todo: list[tuple[object, int]] = [(root, 0)]
    while todo:
        node, lcp = todo.pop()
        if isinstance(node, list):
            ordered = sorted(node[1].items())
            todo += [(child, node[0] if i else lcp) for i, (_, child) in reversed(list(enumerate(ordered)))]
        else:
            out.append((node, lcp))
            out += [(twin, len(text[node])) for twin in same.get(node, ())]
    return out


def deep_shallow(group: np.ndarray, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings by (group, content) and the common prefix of each with the one before (0 in another group).

    Shallow: multikey quicksort on words of 8 bytes, splitting only what is tied, down to SHALLOW
    bytes.  Deep: a blind trie for each group that is tied there.
    """
    n = len(text)
    order = np.argsort(group, kind="stable")
    head = np.r_[True, group[order][1:] != group[order][:-1]] if n else np.zeros(0, bool)
    lcp = np.zeros(n, np.int64)
    size = np.array([len(t) for t in text], np.int64)
    packed = np.frombuffer(b"".join(t[:SHALLOW].ljust(SHALLOW, b"\0") for t in text), ">u8").reshape(n, -1).astype(np.uint64)
    for depth in range(SHALLOW // 8):
        slots = np.flatnonzero(~(head & np.r_[head[1:], True]))
        if not len(slots):
            break
        items = order[slots]
        within = np.cumsum(head)[slots]
        word, rest = packed[items, depth], np.minimum(size[items] - 8 * depth, 8)  # short strings first
        by = np.lexsort((rest, word, within))
        items, word, rest, within = items[by], word[by], rest[by], within[by]
        order[slots] = items
        tied = np.r_[False, within[1:] == within[:-1]]
        differ = np.r_[False, (word[1:] != word[:-1]) | (rest[1:] != rest[:-1])]
        new = np.flatnonzero(tied & differ)
        gap = word[new] ^ word[new - 1]
        equal = np.full(len(new), 8, np.int64)
        for byte in range(7, -1, -1):
            equal[(gap >> np.uint64(8 * (7 - byte))) & np.uint64(255) > 0] = byte
        lcp[slots[new]] = 8 * depth + np.minimum(equal, np.minimum(rest[new], rest[new - 1]))
        head[slots[new]] = True
    heads = np.flatnonzero(head)
    sizes = np.diff(np.r_[heads, n])
    for lo, m in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        found = blind_trie(order[lo : lo + m].tolist(), text)
        order[lo : lo + m] = [f[0] for f in found]
        lcp[lo + 1 : lo + m] = [f[1] for f in found[1:]]
    return order, lcp


def repeated_starts(group: np.ndarray, before: list[bytes], after: list[bytes], first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, j): strings that begin j bytes before the anchor and stand in another context of the group.

    before is reversed.  first and last bound j in each context.
    """
    n = len(group)
    right, right_lcp = deep_shallow(group, after)
    left, left_lcp = deep_shallow(group, before)
    hits: list[np.ndarray] = []
    steps: list[np.ndarray] = []
    for j in range(int(first.min()), int(last.max()) + 1):
        who = np.flatnonzero((first <= j) & (j <= last))
        if len(who) < 2:
            continue
        classes = np.empty((2, n), np.int64)
        for k, (order, lcp, least) in enumerate(((right, right_lcp, length - j), (left, left_lcp, j))):
            fresh = (lcp < least) if least > 0 else np.r_[True, group[order][1:] != group[order][:-1]]
            if n:
                fresh[0] = True
                fresh[1:] |= group[order][1:] != group[order][:-1]
            classes[k, order] = np.cumsum(fresh)
        _, of, times = np.unique(classes[0, who] * (n + 1) + classes[1, who], return_inverse=True, return_counts=True)
        hit = who[times[of] > 1]
        hits.append(hit)
        steps.append(np.full(len(hit), j))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hits), np.concatenate(steps)


GROUPED = "group long, n long, low int, high int, at int, bytes binary, doc_id long, mark long, start int"


def _contexts(packed: DataFrame, length: int, gram: int) -> DataFrame:
    """Of the wanted ranges of each text: anchor (group), its contexts (n), where strings may begin (low to high bytes
    before the anchor), place of the anchor in the bytes, the bytes, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(len(batch)):
                doc_id, mark = batch.column("doc_id")[i].as_py(), batch.column("mark")[i].as_py()
                data = unpack.decompress(batch.column("packed")[i].as_py())
                prefix = K.Prefix(np.frombuffer(data, np.uint8))
                out = []
                for r in batch.column("ranges")[i].as_py():
                    lo, hi = r["lo"], r["lo"] + r["n"]
                    # The anchor: the least gram that all strings of the range hold.
                    s = np.arange(hi, lo + length - gram + 1)
                    at = int(s[np.argmin(K.mix(prefix.raw(s, s + gram)))])
                    out.append((r["anchor"], r["contexts"], 0, length - gram, at - lo, data[lo : hi + length], doc_id, mark, lo))
                yield _grouped(out)

    return mapped(packed, run, GROUPED)


_GROUPED = pa.schema([("group", pa.int64()), ("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32())])


def _grouped(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_GROUPED)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _GROUPED, strict=True)], schema=_GROUPED)


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Each context once for each half of its group's places that it has strings in, cut to what those reach, with a digest of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digests = [], []
            for group, _, low, high, at, data, doc_id, mark, start in zip(*(c.to_pylist() for c in batch.select(_GROUPED.names).columns), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(a, at - (len(data) - length)), min(b, at)
                    if first > last:
                        continue
                    shared = data[at - a : at + length - b]  # what all strings of the half hold
                    part = hashlib.blake2b(shared, digest_size=8, key=struct.pack("qi", group, a)).digest()
                    own = data[at - last : at + length - first]
                    out.append((struct.unpack("q", part)[0], None, a, b, last, own, doc_id, mark, start + at - last))
                    digests.append(hashlib.blake2b(own, digest_size=16).digest())
            yield pa.record_batch([*_grouped(out).columns, pa.array(digests, pa.binary())], names=[*_GROUPED.names, "own"])

    return mapped(rows, run, f"{GROUPED}, own binary")


def _parted(rows: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(groups that are small enough to sort, ranges found repeated on the way): doc_id, mark, lo, hi."""
    small, whole = [rows.filter(F.col("n") <= AT_ONCE)], []
    large = rows.filter(F.col("n") > AT_ONCE)
    place = F.struct("doc_id", "mark", "start")
    like = ["group", "at", "own"]
    while not large.isEmpty():
        halves = stash(_halves(large, length))
        alike = halves.groupBy(*like).agg(F.count("*").alias("times"), F.min(place).alias("chosen"))
        sizes = alike.groupBy("group").agg(F.count("*").alias("contexts"))
        met = stash(halves.drop("n").join(alike, like).join(sizes, "group").filter("times > 1 or contexts > 1"))
        whole.append(met.filter("times > 1").select("doc_id", "mark", F.col("start").alias("lo"), (F.col("start") + F.length("bytes") - length).alias("hi")))
        left = met.filter((F.col("contexts") > 1) & place.eqNullSafe(F.col("chosen"))).withColumnRenamed("contexts", "n").select(*_GROUPED.names)
        small.append(left.filter(F.col("n") <= AT_ONCE))
        large = left.filter(F.col("n") > AT_ONCE)
    return small, whole


def _resolve(contexts: DataFrame, length: int) -> DataFrame:
    """doc_id, mark, lo, hi: starts of strings that another context of the group holds.

    The groups are dealt to partitions whole; a task takes them in order, some thousand contexts at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            group = np.unique([r[0] for r in rows], return_inverse=True)[1]
            at = np.array([r[1] for r in rows], np.int64)
            size = np.array([len(r[2]) for r in rows], np.int64)
            before = [r[2][: r[1]][::-1] for r in rows]
            after = [r[2][r[1] :] for r in rows]
            # Starts 0 .. size - length of a context lie at .. at - (size - length) bytes before the anchor.
            who, j = repeated_starts(group, before, after, at - (size - length), at, length)
            start = at[who] - j
            order = np.lexsort((start, who))
            who, start = who[order], start[order]
            new = np.r_[True, (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)] if len(who) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(who)] - 1 if len(who) else first
            pick = lambda k: [rows[i][k] for i in who[first]]
            own = np.array(pick(5), np.int64)
            return pa.record_batch([pa.array(pick(3), pa.int64()), pa.array(pick(4), pa.int64()), pa.array((own + start[first]).astype(np.int32)), pa.array((own + start[last]).astype(np.int32))], names=["doc_id", "mark", "lo", "hi"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("group", "at", "bytes", "doc_id", "mark", "start")), strict=True)
            if len(held) > 4000:  # all but the last group, which may go on
                edge = len(held)
                while edge and held[edge - 1][0] == held[-1][0]:
                    edge -= 1
                if edge:
                    yield done(held[:edge])
                    held = held[edge:]
        if held:
            yield done(held)

    dealt = contexts.select("group", "at", "bytes", "doc_id", "mark", "start").repartition("group").sortWithinPartitions("group")
    return mapped(dealt, run, "doc_id long, mark long, lo int, hi int")


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                values = [pack.compress((x or "").encode()) for x in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), part.column("mark"), pa.array(values, pa.binary())], names=["doc_id", "mark", "packed"])

    return mapped(docs.select("doc_id", "mark", "text"), run, "doc_id long, mark long, packed binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, mark, ranges: array of (lo, hi), first and last start of repeated strings.

    docs: doc_id long, mark long (24 bits that tell rows of one doc_id apart), text.
    """
    seen = _occurrences(docs, length, gram)
    twice = seen.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    shared = stash(seen.join(twice, "anchor"))
    own = F.xxhash64("doc_id", "at")
    classes = shared.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(own).alias("chosen"))
    classes = stash(classes)
    several = classes.groupBy("anchor").agg(F.count("*").alias("contexts"))
    classes = classes.join(several, "anchor").filter("n > 1 or contexts > 1")
    met = shared.join(classes, ["anchor", "context"])
    mark, lo, more = F.shiftrightunsigned("at", 40), F.shiftright("at", 8).bitwiseAND(0xFFFFFFFF), F.col("at").bitwiseAND(255)
    met = met.select("anchor", "contexts", "doc_id", mark.cast("long").alias("mark"), lo.cast("int").alias("lo"), more.cast("int").alias("more"), (F.col("n") > 1).alias("repeats"), ((F.col("contexts") > 1) & (own == F.col("chosen"))).alias("asked"))
    met = stash(met)

    asked = met.filter("asked").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "contexts", "lo", F.col("more").alias("n"))).alias("ranges"))
    asked = asked.withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m")
    texts = _packed(docs).join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("doc_id", "mark", "packed", "ranges")
    small, found = _parted(stash(_contexts(texts, length, gram)), length)
    together = small[0]
    for more_ in small[1:]:
        together = together.unionByName(more_)
    every = met.filter("repeats").select("doc_id", "mark", "lo", (F.col("lo") + F.col("more")).alias("hi"))
    for ranges in (_resolve(together, length), *found):
        every = every.unionByName(ranges)
    return every.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _kept(joined: DataFrame, length: int, digests: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, packed, ranges in zip(batch.column("doc_id"), batch.column("packed"), batch.column("ranges"), strict=True):
                data = unpack.decompress(packed.as_py())
                spans = 0
                left = data
                if ranges.is_valid and len(ranges):
                    lo, hi = (ranges.values.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
                    step = np.zeros(len(data) + 1, np.int32)
                    np.add.at(step, lo, 1)
                    np.add.at(step, hi + length, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    left = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((doc_id.as_py(), len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest() if digests else left))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if digests else pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "kept"]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    last = "kept_sha256 string" if digests else "kept binary"
    return mapped(joined.select("doc_id", "packed", "ranges"), run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that are left, or their SHA-256."""
    if not 0 <= length - gram < 256:
        raise ValueError("the gram must be shorter than the length, by less than 256")
    mark = F.xxhash64("text").bitwiseAND(0xFFFFFF)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), "text")
    ranges = stash(repeated_ranges(docs, length, gram)).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "ranges")
    joined = _packed(docs).join(ranges, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return _kept(joined, length, digests)


def op2_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Every document with what repeated 200-byte strings take from it and the digest of what is left."""
    small_batches(spark)
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
