"""Line dedup by a segment-partition edit join.

Two lines are linked when at most so many insertions, deletions and substitutions of code points
apart as the length of the shorter one allows: one from 20 code points on, two from 50, three from
100 (``ALLOWED_FROM``); shorter lines are linked when equal.  A line of length n is split into edits + 1 segments; one of them must stand, unchanged and
within a shift that the edits allow, in any line linked with it.  So each line writes its segments to
an index keyed by (length, segment number, content) and probes the index of each length that a
partner may have with the few substrings in question.  Few lines under a key are compared with each
other.  Many lines under a key take that substring out and partition what remains again: what the
edit changed is all in there.  Once it is too short to split, lines with equal remainders hang on
one of them and only distinct remainders are compared, whose number the alphabet bounds.  With more
than one edit the partitions of near lines would multiply; there the lines under a key are compared
in blocks, by counts of their code points and then by the automaton, unless already connected.
Candidates are verified on whole lines by a banded bit-parallel automaton.

Of each component of lines (copies included) the first occurrence stays, by (doc_id, text hash, line
number); the others are removed, however short (empty lines too).

Equal lines are told by 96 bits of hash, long ones by those of a digest; near ones are compared.

Null and empty texts have no such line and stay as they are.  Rows with one doc_id keep their own
lines; fully equal rows are treated alike.  A null doc_id comes first in the order.  Texts of any
length are read whole, and an empty table gives an empty result.  Extra columns, of any name, are
carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .components import components
from .work import mapped, matched, packed, stash

#: The code points from which a line may differ by one, two, three edits.
ALLOWED_FROM = (20, 50, 100)
FEW = 16  # lines under a key that are compared with each other
BLOCK = 128  # lines of a block, where blocks are compared
BUCKET_BITS = 12  # of a key: its bucket
FLUSH = 1 << 19  # keys that a task deals to the buckets at once
HELD = 1 << 22  # index entries of a bucket, before those of keys with several lines leave it
INDEX, PROBE = 1, 2
EDITS_BIT = 2  # from this bit on, the role has the edits of its key
_SECOND = np.uint64(0xA0761D6478BD642F)
_ROW = np.dtype([("key", np.uint64), ("lid", np.int64), ("role", np.int8)])


def allowed(n: np.ndarray, edits: int | None) -> np.ndarray:
    """Edits between two lines of which the shorter has n code points: ``edits``, or by its length."""
    return np.searchsorted(ALLOWED_FROM, n, "right") if edits is None else np.full(np.shape(n), edits)


def points(b: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and the rows' offsets in them."""
    if not len(b.data):
        return np.zeros(0, np.uint32), np.zeros(len(b.offs), np.int64)
    inner = np.flatnonzero((b.data & 0xC0) == 0x80)
    return np.frombuffer(b.data.tobytes().decode().encode("utf-32-le"), np.uint32), b.offs - np.searchsorted(inner, b.offs)


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number in the row of each line; an empty row has none."""
    cuts = np.flatnonzero(data == 10) + 1
    filled = offs[:-1][np.diff(offs) > 0]
    lo = np.unique(np.r_[filled, cuts[cuts < len(data)]])
    row = np.searchsorted(offs, lo, "right") - 1
    hi = np.r_[lo[1:], len(data)] if len(lo) else lo
    hi = hi - (data[hi - 1] == 10) if len(lo) else hi
    number = np.arange(len(lo)) - np.searchsorted(lo, offs[:-1])[row] if len(lo) else lo
    return lo, hi, row, number


def keys(prefix: K.Prefix, lo: np.ndarray, hi: np.ndarray, edits: int, seed: np.ndarray, rule: int | None = None, every: bool = True) -> Iterator[tuple]:
    """Keys of strings: (which strings, key, role, start and length of the substring under it).

    Unless ``every``, only of lengths to which ``allowed`` gives these edits.
    """
    parts = edits + 1
    size = hi - lo
    for delta in range(edits + 1):
        n = size - delta
        ok = np.flatnonzero((n >= parts) & (every or allowed(n, rule) == edits))
        n = n[ok]
        for i in range(parts):
            at = i * n // parts
            length = (i + 1) * n // parts - at
            for shift in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
                start = at + shift
                fits = np.flatnonzero((start >= 0) & (start + length <= size[ok]))
                which = ok[fits]
                begin = lo[which] + start[fits]
                content = prefix.of(begin, begin + length[fits])
                key = K.mix(content + n[fits].astype(np.uint64) * K.P_WORD + np.uint64(i) + seed[which])
                role = (INDEX | PROBE) if delta == 0 and shift == 0 else PROBE
                yield which, key.view(np.int64), np.full(len(which), role, np.int8), start[fits], length[fits]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most edits: a banded bit-parallel automaton on what is left of common ends."""
    if abs(len(a) - len(b)) > edits:
        return False
    lo, least = 0, min(len(a), len(b))
    while lo < least and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < least - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lo : len(a) - tail], b[lo : len(b) - tail]
    # Bit edits + d of state[e]: after j characters of b, a[: j + d] can be reached with e edits.
    width = (1 << (2 * edits + 1)) - 1
    state = [1 << edits]
    for _ in range(edits):
        state.append((state[-1] | state[-1] << 1) & width & ((1 << (edits + len(a) + 1)) - 1))
    for j, char in enumerate(b):
        first = max(0, j - edits)
        match = 0
        for at, other in enumerate(a[first : j + edits + 1], first):
            if other == char:
                match |= 1 << (edits + at - j)
        inside = width & ((1 << max(0, edits + len(a) - j)) - 1)
        was = now = 0
        for e, old in enumerate(state):
            now = ((old & match) | was | was >> 1 | now << 1) & inside if e else old & match & inside
            state[e], was = now, old
        if not any(state):
            return False
    return any(s >> (edits + len(a) - len(b)) & 1 for s in state)


def _identities(data: np.ndarray, prefix: K.Prefix, lo: np.ndarray, hi: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """64 and, if ``both``, 32 more bits that stand for each line; ``prefix`` is that of the data."""
    first = prefix.of(lo, hi)
    second = K.Prefix(data, _SECOND).of(lo, hi) if both else None
    long = np.flatnonzero(hi - lo > K.SHORT)
    if len(long):
        digests = K.digests(data, lo[long], hi[long], 16)
        first[long] = digests[:, 0]
        if both:
            second[long] = digests[:, 1]
    return first.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32) if both else None


def _occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, mark, line, lid, more: every line of least_chars or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.blocks(batch.column("text")):
                data, offs = points(b)
                lo, hi, row, number = line_spans(data, offs)
                long = hi - lo >= least_chars
                lid, more = _identities(data, K.Prefix(data), lo[long], hi[long])
                rows = pa.array(b.first + row[long])
                yield pa.record_batch([batch.column("doc_id").take(rows), batch.column("mark").take(rows), pa.array(number[long].astype(np.int32)), pa.array(lid), pa.array(more)], names=["doc_id", "mark", "line", "lid", "more"])

    return mapped(docs.select("doc_id", "mark", "text"), run, "doc_id long, mark long, line int, lid long, more int")


def _parcels(rows: np.ndarray) -> pa.RecordBatch:
    """bucket, probe, rows: the keys of each bucket in one row, index entries apart from mere probes."""
    side = (rows["key"] >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16) << 1 | ((rows["role"] & INDEX) == 0)
    counts = np.bincount(side, minlength=2 << BUCKET_BITS)
    used = np.flatnonzero(counts)
    offs = (np.r_[0, np.cumsum(counts[used])] * _ROW.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(offs), pa.py_buffer(rows[np.argsort(side, kind="stable")])])
    return pa.record_batch([pa.array((used >> 1).astype(np.int32)), pa.array((used & 1).astype(bool)), data], names=["bucket", "probe", "rows"])


class _Bucket:
    """The rows of one bucket, index entries before probes: what comes back are those under a key of two lines.

    All rows of such a key come back, some more than once.  Of index entries at most HELD and one of each key are kept.
    """

    def __init__(self) -> None:
        self.held, self.n, self.table = [], 0, None

    def index(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        self.held.append(rows)
        self.n += len(rows)
        if self.n > HELD:
            yield from self._parted()

    def _parted(self) -> Iterator[np.ndarray]:
        """Gives back the held rows of keys with several lines; one row of each key stays, in order."""
        rows = np.concatenate(self.held)
        rows = rows[np.argsort(rows["key"])]
        new = np.r_[True, rows["key"][1:] != rows["key"][:-1]]
        several = np.zeros(np.count_nonzero(new), bool)
        key = np.cumsum(new) - 1
        several[key[1:][~new[1:] & (rows["lid"][1:] != rows["lid"][:-1])]] = True
        met = rows[several[key]]
        met = met[np.lexsort((met["lid"], met["key"]))]
        yield met[np.r_[True, (met["key"][1:] != met["key"][:-1]) | (met["lid"][1:] != met["lid"][:-1])][: len(met)]]
        self.held, self.n = [rows[new]], 0

    def probes(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        if not self.held:
            return
        if self.table is None:
            yield from self._parted()
            self.kept = self.held[0]
            self.keys, self.lids, self.hit = self.kept["key"].copy(), self.kept["lid"].copy(), np.zeros(len(self.kept), bool)
            self.mask = np.uint64((16 << len(self.keys).bit_length()) - 1)
            self.table = np.zeros(int(self.mask) + 1, bool)
            self.table[self.keys & self.mask] = True
        rows = rows[self.table[rows["key"] & self.mask]]
        at = np.minimum(np.searchsorted(self.keys, rows["key"]), len(self.keys) - 1)
        met = (self.keys[at] == rows["key"]) & (self.lids[at] != rows["lid"])
        self.hit[at[met]] = True
        yield rows[met]

    def done(self) -> Iterator[np.ndarray]:
        if self.table is not None:
            yield self.kept[self.hit]
        elif self.held:
            yield from self._parted()


def _line_keys(docs: DataFrame, edits: int | None, least_chars: int) -> DataFrame:
    """key, lid, role of every line that may differ from another, under the keys of two lines; the role has the key's edits above its two bits.

    Nearly all keys are those of one line, so they cross the shuffle as arrays, and only the others become rows.
    """
    levels = range(1, len(ALLOWED_FROM) + 1) if edits is None else [edits]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0

        def parcels() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(found)
            yield from (_parcels(rows[lo : lo + FLUSH]) for lo in range(0, len(rows), FLUSH))

        for batch in batches:
            for b in K.blocks(batch.column("text")):
                data, offs = points(b)
                lo, hi, _, _ = line_spans(data, offs)
                long = hi - lo >= least_chars
                prefix = K.Prefix(data)
                lo, hi = lo[long], hi[long]
                lid, once = np.unique(_identities(data, prefix, lo, hi, False)[0], return_index=True)
                lo, hi = lo[once], hi[once]
                for level in levels:
                    for which, key, role, _, _ in keys(prefix, lo, hi, level, np.zeros(len(lo), np.uint64), edits, False):
                        rows = np.empty(len(which), _ROW)
                        rows["key"], rows["lid"], rows["role"] = key.view(np.uint64), lid[which], role + np.int8(level << EDITS_BIT)
                        found.append(rows)
                        n += len(rows)
                if n >= FLUSH:
                    yield from parcels()
                    found, n = [], 0
        if n:
            yield from parcels()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = None, _Bucket()

        def answer(found: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate([*found, np.zeros(0, _ROW)])
            return pa.record_batch([pa.array(rows["key"].copy().view(np.int64)), pa.array(rows["lid"].copy()), pa.array(rows["role"].copy())], names=["key", "lid", "role"])

        for batch in batches:
            found = []
            bucket, probe = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "probe"))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (probe[1:] != probe[:-1])) + 1
            for b in K.blocks(batch.column("rows"), 1 << 40):
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
                    if bucket[lo] != at:
                        found += one.done()
                        at, one = bucket[lo], _Bucket()
                    rows = b.data[b.offs[lo] : b.offs[hi]].view(_ROW)
                    found += one.probes(rows) if probe[lo] else one.index(rows)
            yield answer(found)
        yield answer(list(one.done()))

    dealt = mapped(docs.select("text"), write, "bucket int, probe boolean, rows binary").repartition("bucket").sortWithinPartitions("bucket", "probe")
    return mapped(dealt, meet, "key long, lid long, role byte")


def _texts(docs: DataFrame, seen: DataFrame, lids: DataFrame) -> DataFrame:
    """lid, content: the wanted lines, each from one place where it stands."""
    first = seen.join(lids, "lid").groupBy("lid").agg(F.min(F.struct("doc_id", "mark", "line")).alias("at"))
    asked = first.groupBy(F.col("at.doc_id").alias("d"), F.col("at.mark").alias("m")).agg(F.collect_list(F.struct("lid", F.col("at.line").alias("line"))).alias("lines"))
    met = matched(packed(docs.select("doc_id", "mark", "text")), asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for small, wanted in zip(batch.column("text"), batch.column("lines"), strict=True):
                lines = unpack(small.as_buffer()).decode().split("\n")
                lid, line = (wanted.values.field(c) for c in ("lid", "line"))
                yield pa.record_batch([lid, pa.array([lines[i] for i in line.to_pylist()], pa.string())], names=["lid", "content"])

    return mapped(met.select("text", "lines"), run, "lid long, content string").dropDuplicates(["lid"])


def _remainders(met: DataFrame, edits: int, first: bool) -> DataFrame:
    """key, lid, role, content of lines under crowded keys -> the same under the keys of what remains.

    The first time the content is the whole line and the substring under the key is still in it.
    A content too short to split keeps its key with ``leaf`` set.
    """

    def cut(content: list[str], key: np.ndarray, role: np.ndarray, lid: np.ndarray, seed: np.ndarray, match: bool):
        data = np.frombuffer("".join(content).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(c) for c in content], dtype=np.int64)
        lo = ends - np.array([len(c) for c in content], np.int64)
        for which, new, as_role, start, length in keys(K.Prefix(data), lo, ends, edits, seed):
            hit = (new == key[which]) if match else (as_role & role[which]) > 0
            for j in np.flatnonzero(hit):
                w, s = which[j], start[j]
                yield int(new[j]), int(lid[w]), int(as_role[j] & role[w]) or int(as_role[j]), content[w][:s] + content[w][s + length[j] :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                content = part.column("content").to_pylist()
                key, lid, role = (part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lid", "role"))
                rows = []
                if first:
                    rows = list(cut(content, key, role, lid, np.zeros(len(content), np.uint64), True))
                    key, lid, role, content = ([r[i] for r in rows] for i in range(4))
                    key, lid, role = np.array(key, np.int64), np.array(lid, np.int64), np.array(role, np.int8)
                # An index entry too short to split ends here; its probes, as short or longer by some edits, wait with it.
                out = [(int(k), int(i), int(r), c, True) for k, i, r, c in zip(key, lid, role, content, strict=True) if len(c) <= 2 * edits]
                out += [(*r, False) for r in cut(list(content), key, role, lid, K.mix(key.view(np.uint64)), False)] if len(content) else []
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int8(), pa.string(), pa.bool_()), strict=True)], names=["key", "lid", "role", "content", "leaf"])

    return mapped(met.select("key", "lid", "role", "content"), run, "key long, lid long, role byte, content string, leaf boolean")


def _crowd(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Rows under keys that an index entry and a probe of two lines share, with n, the lines under the key."""
    rows = rows.repartition("key")  # dealt once: what follows reads the same exchange, as it asks for the same columns
    keys = rows.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.bit_or("role").alias("roles"))
    shared = keys.filter(f"lo != hi and roles & {INDEX | PROBE} = {INDEX | PROBE}").select("key")
    rows = stash(rows.join(shared.hint("shuffle_hash"), "key").groupBy("key", "lid", *extra).agg(F.bit_or("role").alias("role")))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_or("role").alias("roles")).filter(f"roles & {INDEX | PROBE} = {INDEX | PROBE}")
    return stash(rows.join(counts.select("key", "n"), "key"))


def _pairs(few: DataFrame) -> DataFrame:
    members = few.groupBy("key").agg(F.collect_list(F.struct("lid", "role")).alias("m"))
    other = lambda x, y: (x["role"].bitwiseAND(INDEX) > 0) & (y["role"].bitwiseAND(PROBE) > 0) & (x["lid"] != y["lid"])
    pair = F.transform("m", lambda x: F.transform(F.filter("m", lambda y: other(x, y)), lambda y: F.struct(F.least(x["lid"], y["lid"]).alias("a"), F.greatest(x["lid"], y["lid"]).alias("b"))))
    return members.select(F.explode(F.array_distinct(F.flatten(pair))).alias("p")).select("p.a", "p.b")


def _leaf_pairs(rows: DataFrame) -> DataFrame:
    """Lines with one remainder hang on the smallest; the smallest of each remainder under a key are all compared."""
    least = rows.groupBy("key", "content").agg(F.min("lid").alias("m"))
    star = rows.join(least, ["key", "content"]).filter("lid != m").select(F.col("m").alias("a"), F.col("lid").alias("b"))
    x, y = least.select("key", F.col("m").alias("a")), least.select("key", F.col("m").alias("b"))
    return star.unionByName(x.join(y, "key").filter("a < b").select("a", "b"))


def _block_links(crowded: DataFrame, edits: int | None) -> DataFrame:
    """a, b: links that connect what the lines (key, lid, role, content, n) under one key connect, compared in blocks."""
    rows = crowded.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("x"), F.greatest("part", k).alias("y"), (k < F.col("part")).alias("right")))
    columns = ["key", "x", "y", "right", "lid", "role", "content"]
    dealt = rows.select("key", "lid", "role", "content", F.explode(cell).alias("c")).select("key", "c.x", "c.y", "c.right", "lid", "role", "content")
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def compare(m: list[dict], left: np.ndarray, right: np.ndarray, root: list[int]) -> Iterator[tuple[int, int]]:
        """Links between the lines left and right that connect two components."""

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        size = np.array([len(r["content"]) for r in m])
        role = np.array([r["role"] for r in m])
        counts = np.zeros((len(m), 32), np.int16)
        for i, r in enumerate(m):
            counts[i] = np.bincount(np.frombuffer(r["content"].encode("utf-32-le"), np.uint32) & 31, minlength=32)
        for i in left.tolist():
            least = allowed(np.minimum(size[i], size[right]), edits)
            index = (role[i] & INDEX > 0) & (role[right] & PROBE > 0) | (role[i] & PROBE > 0) & (role[right] & INDEX > 0)
            apart = counts[right] - counts[i]
            far = np.maximum(np.where(apart > 0, apart, 0).sum(1), np.where(apart < 0, -apart, 0).sum(1))
            for j, most in zip(right[near := index & (far <= least)].tolist(), least[near].tolist(), strict=True):
                if i != j and (a := find(i)) != (b := find(j)) and within(m[i]["content"], m[j]["content"], most):
                    root[a] = b
                    yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            x, y = sides
            same, m = not y, x + y
            left, right, root = np.arange(len(x)), np.arange(len(x), len(m)), list(range(len(m)))
            found = list(compare(m, left, left, root))
            if not same:  # what a block connects within is the work of its own cell
                list(compare(m, right, right, root))
                found = list(compare(m, left, right, root))
            return pa.record_batch([pa.array([m[p[i]]["lid"] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *cell, right, lid, role, content in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if cell != at:
                    if sides[0]:
                        yield done()
                    at, sides = cell, ([], [])
                sides[right].append({"lid": lid, "role": role, "content": content})
        if sides[0]:
            yield done()

    return mapped(dealt, run, "a long, b long")


def line_links(docs: DataFrame, seen: DataFrame, edits: int | None = None, least_chars: int = 0) -> DataFrame:
    """a, b: pairs of lines (hashes) within the edits, enough to connect each component.

    docs: doc_id, mark, text; seen: their lines.
    """
    met = _crowd(_line_keys(docs, edits, least_chars), [])
    texts = stash(_texts(docs, seen, met.select("lid").distinct()))
    found, first = [_pairs(met.filter(F.col("n") <= FEW))], True
    crowded = met.filter(F.col("n") > FEW).select("key", "lid", "role", "n")
    blocked = None
    if more := not crowded.isEmpty():
        crowded = stash(crowded.join(texts, "lid"))
        one = F.shiftright("role", EDITS_BIT) == 1
        blocked = _block_links(crowded.filter(~one), edits)
        crowded = crowded.filter(one).withColumn("role", F.col("role").bitwiseAND(INDEX | PROBE).cast("byte"))
        more = not crowded.isEmpty()
    while more:
        rest = stash(_remainders(crowded, 1, first))
        met = _crowd(rest.filter("not leaf"), ["content"])
        found.append(stash(_leaf_pairs(rest.filter("leaf")).unionByName(_pairs(met.filter(F.col("n") <= FEW)))))
        crowded, first = met.filter(F.col("n") > FEW), False
        more = not crowded.isEmpty()
    pairs = found[0]
    for one in found[1:]:
        pairs = pairs.unionByName(one)
    pairs = pairs.distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in "xy")
            most = allowed(np.array([min(len(i), len(j)) for i, j in zip(x, y, strict=True)], np.int64), edits).tolist()
            ok = [within(*one) for one in zip(x, y, most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("content").alias("x")), "a")
    both = both.join(texts.select(F.col("lid").alias("b"), F.col("content").alias("y")), "b")
    links = mapped(both.select("a", "b", "x", "y"), run, "a long, b long")
    return links.unionByName(blocked) if blocked else links


def removed_lines(docs: DataFrame, edits: int | None = None, least_chars: int = 0) -> DataFrame:
    """d, m (doc_id and mark of docs), lines: numbers of the removed lines; n_near: how many equal no line that stays."""
    seen = stash(_occurrences(docs, least_chars))
    roots = stash(components(stash(line_links(docs, seen, edits, least_chars)))).select(F.col("node").alias("lid"), "root")
    place = F.struct("doc_id", "mark", "line")
    lines = seen.groupBy("lid", "more").agg(F.count("*").alias("n"), F.min(place).alias("first")).join(roots, "lid", "left")
    # Lines that no other is near are told apart by all 96 bits; others go with what they are connected to.
    group = {"g": F.coalesce("root", "lid"), "h": F.when(F.col("root").isNull(), F.col("more")).otherwise(0)}
    lines = stash(lines.filter("n > 1 or root is not null").withColumns(group))
    best = lines.groupBy("g", "h").agg(F.min("first").alias("stays"))
    hit = lines.join(best, ["g", "h"]).select("lid", "more", "stays", F.col("first").alias("own"))
    gone = seen.join(hit, ["lid", "more"]).filter(~place.eqNullSafe(F.col("stays")))
    near = F.col("stays") != F.col("own")
    return gone.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.collect_set("line").alias("gone"), F.count_if(near).alias("n_near"))


def dedup_lines(docs: DataFrame, edits: int | None = None, least_chars: int = 0) -> DataFrame:
    """The rows of docs with their text without removed lines, and __n_lines, __n_removed, __n_near (removed as nearly equal)."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), "text")
    met = matched(packed(marked), removed_lines(marked.select("doc_id", "mark", "text"), edits, least_chars), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for small, numbers in zip(batch.column("text"), batch.column("gone"), strict=True):
                text = unpack(small.as_buffer()).decode() if small.is_valid else None
                out = set(numbers.as_py()) if numbers.is_valid else ()
                n_lines.append(text.count("\n") + (text[-1] != "\n") if text else 0)
                n_removed.append(len(out))
                texts.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in out) if out else text)
            yield pa.record_batch([batch.column("rest"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), batch.column("n_near")], names=["rest", "text", "n_lines", "n_removed", "n_near"])

    kind = marked.schema["rest"].dataType
    schema = T.StructType([T.StructField("rest", kind), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_near"))])
    done = mapped(met.select("rest", "text", "gone", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), run, schema)
    plain = [F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return done.select(*plain, *(F.col(c).alias(f"__{c}") for c in ("n_lines", "n_removed", "n_near")))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its lines, those removed, and the digest of the text that is left (null: empty)."""
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.coalesce("text", F.lit(""))
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__n_near").alias("n_near"), F.length(kept).cast("long").alias("n_chars_left"), F.sha2(kept, 256).alias("kept_sha256"))
