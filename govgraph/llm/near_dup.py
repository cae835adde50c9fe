"""MinHash near-dedup by a chosen-path similarity join.

Texts become sets of word shingles.  Equal sets form a class, which takes part once.  A class's path
starts at the root of each of several independent trees; at a node, coordinates of the MinHash
sketch are chosen by the node's name, and the class goes on to one child for each, named by the node,
the coordinate and the token there.  So similar sets meet in many nodes and others part quickly.
Classes that share a small node are compared exhaustively; a large node compares every class with
one of its members, and those unlike it branch again, until nodes are small.  The trees are
as many as the target recall takes at the threshold itself.

Sketches only choose candidates, whose connections are loose components: a link needs
``100 * |A & B| >= percent * |A | B|`` on the full sets.  First each class is checked against its
likeliest neighbour.  Where a loose component is still in parts, all classes outside its largest part
are compared with all of it, in blocks.  So copies cost a check each, not one for each pair.

Null and empty texts and those without words have an empty set and no links.  Equal rows are one
class.  Rows that share doc_id keep their own sets.  A row with a null doc_id is in the component of
its class, which it names only if no other id does; it is kept in that case alone.  Texts of any
length are read whole.  An empty table gives an empty result.  Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .work import mapped, matched, packed, stash, unpacked

TOKENS = 96  # coordinates of a sketch
TREES, DEPTH, BRANCHES = 4, 4, 2
#: Below a large node, so many nodes in four have a second child: 1.75 * 0.8 is well above 1, so a shared path lives on at any depth.
#: A pair at 0.8, with one sketch for all trees, is missed with probability 0.00006 at depth 4 and 0.00017 at depth 32.
SECOND_CHILD = 3
#: Levels that a large node goes down at once: few, as nodes left with one class are dropped before the next.
SMALL_NODE, AGAIN, MAX_DEPTH = 12, 2, 32
#: In a large node, classes at least so like its chosen member belong to its loose component; below the second they branch again.
#: They are 20 apart: of a pair at 0.8, one cannot be above the second and the other below the first, but for the estimates' error.
LOOSE_PERCENT, AGAIN_PERCENT = 20, 40
ASKING, ANSWERING = 256, 1024  # classes on the sides of a block of exact comparisons
#: Candidates whose estimate is below the threshold less almost five standard deviations (0.041) are dropped.
SLACK_PERCENT = 20

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def shingle_sets(b: K.Block, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; a shorter text is one shingle."""
    low = K.Block(b.first, K.LOWER[b.data], b.offs)
    starts, ends, first = K.word_spans(low)
    prefix = K.Prefix(K.word_hashes(low.data, starts, ends), K.P_WORD)
    last = K.row_of(first)
    to = np.minimum(np.arange(len(starts)) + words, first[1:][last])
    hashes = prefix.of(np.arange(len(starts)), to)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(hashes[lo : max(hi - words + 1, min(lo + 1, hi))])


def sketch(found: np.ndarray) -> np.ndarray:
    """Smallest value of each of TOKENS hash functions over the set: 16 bits of it, which choose paths.

    Pairs are estimated by 8 bits: unlike tokens agree by chance in one case of 256, so none is underrated.
    """
    out = np.full(TOKENS, np.uint32(0xFFFFFFFF))
    for lo in range(0, len(found), 4096):
        part = found[lo : lo + 4096]
        out = np.minimum(out, ((part[None, :] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out.astype(np.uint16)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.blocks(batch.column("text")):
                ids = [batch.column(c).slice(b.first, b.rows) for c in ("doc_id", "mark")]
                n, digests, sketches, briefs = [], [], [], []
                for found in shingle_sets(b, words):
                    n.append(len(found))
                    digests.append(hashlib.md5(found).digest())
                    tokens = sketch(found)
                    sketches.append(tokens.tobytes())
                    briefs.append(tokens.astype(np.uint8).tobytes())
                yield pa.record_batch([*ids, pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, sketches, briefs))], names=["doc_id", "mark", "n_shingles", "digest", "sketch", "brief"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"), run, "doc_id long, mark long, n_shingles long, digest binary, sketch binary, brief binary")


def _sets(small: DataFrame, words: int) -> DataFrame:
    """digest, members: the sets of compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, len(batch), 500):
                texts = pa.array([unpack(v.as_buffer()) for v in batch.column("text").slice(lo, 500)], pa.binary())
                for b in K.blocks(texts):
                    found = list(shingle_sets(b, words))
                    yield pa.record_batch([pa.array([hashlib.md5(x).digest() for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], names=["digest", "members"])

    return mapped(small.select("text"), run, "digest binary, members binary")


def _children(node: np.ndarray, sketches: np.ndarray, levels: int) -> np.ndarray:
    """Names of the nodes that each row reaches, some levels below each of its nodes: [row, node]."""
    for _ in range(levels):
        below = []
        for branch in range(BRANCHES):
            chosen = K.mix(node + np.uint64((branch + 1) * int(K.P_BYTE) % (1 << 64)))
            token = np.take_along_axis(sketches, (chosen % np.uint64(TOKENS)).astype(np.int64), axis=1)
            below.append(K.mix(chosen ^ (token.astype(np.uint64) * K.P_WORD)))
        node = np.concatenate(below, axis=1)
    return node


def _below(node: np.ndarray, sketches: np.ndarray, row: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of nodes some levels below, and the row of each: every node has a child, and some have two."""
    for _ in range(levels):
        out = _children(node[:, None], sketches[row], 1)
        more = K.mix(node) % np.uint64(4) < np.uint64(SECOND_CHILD)
        node, row = np.concatenate([out[:, 0], out[more, 1]]), np.concatenate([row, row[more]])
    return node, row


def _paths(at: DataFrame, levels: int) -> DataFrame:
    """cid, sketch and perhaps node -> node, cid: some levels below the roots, or below the node."""
    rooted = "node" in at.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                n = len(part)
                sketches = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(n, TOKENS)
                if rooted:
                    node = part.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None]
                else:
                    node = np.broadcast_to(K.mix(np.arange(1, TREES + 1, dtype=np.uint64)), (n, TREES))
                cid = part.column("cid").to_numpy(zero_copy_only=False)
                if rooted:
                    out, row = _below(node[:, 0], sketches, np.arange(n), levels)
                    cid = cid[row]
                else:
                    out = _children(node, sketches, levels)
                    cid = np.repeat(cid, out.shape[1])
                yield pa.record_batch([pa.array(out.reshape(-1).view(np.int64)), pa.array(cid)], names=["node", "cid"])

    return mapped(at.select(*(["node"] if rooted else []), "cid", "sketch"), run, "node long, cid long")


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """a, b, sim: pairs of classes that meet in a node and whose sketches agree well enough.

    A class like the chosen member of a large node joins its loose component, which is compared
    exactly later; those unlike it go on.  At MAX_DEPTH all of a large node are one loose component.
    """
    paths, depth, small, found = _paths(classes, DEPTH), DEPTH, [], []
    while True:
        rank = F.struct(F.xxhash64("cid", "node").alias("h"), F.col("cid").alias("p"))
        nodes = paths.groupBy("node").agg(F.count("*").alias("n"), F.min(rank).getField("p").alias("pivot")).filter("n > 1")
        met = stash(paths.join(nodes, "node"))
        members = met.filter(F.col("n") <= SMALL_NODE).groupBy("node").agg(F.array_sort(F.collect_set("cid")).alias("m"))
        pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        small.append(members.filter("size(m) > 1").select(F.explode(pairs).alias("p")).select("p.a", "p.b"))
        large = met.filter((F.col("n") > SMALL_NODE) & (F.col("cid") != F.col("pivot")))
        if large.isEmpty():
            break
        star = stash(_alike(large.select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct(), classes, 0))
        if depth >= MAX_DEPTH:
            found.append(star.withColumn("sim", F.greatest("sim", F.lit(float(LOOSE_PERCENT)))))
            break
        found.append(star)
        far = star.filter(F.col("sim") < AGAIN_PERCENT).select(F.col("a").alias("cid"), F.col("b").alias("pivot"))
        rest = large.join(far, ["cid", "pivot"]).select("node", "cid")
        paths = _paths(rest.join(classes.select("cid", "sketch"), "cid"), AGAIN)
        depth += AGAIN
    union = small[0]
    for more in small[1:]:
        union = union.unionByName(more)
    every = _alike(union.distinct(), classes, percent - SLACK_PERCENT)
    for more in found:
        every = every.unionByName(more.filter(F.col("sim") >= LOOSE_PERCENT))
    return every.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))


def _alike(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """a, b, sim: how many percent of the sketches agree, for pairs from ``least`` on."""
    left = sketches.select(F.col("cid").alias("a"), F.col("brief").alias("sa"))
    right = sketches.select(F.col("cid").alias("b"), F.col("brief").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(len(part), TOKENS) for c in ("sa", "sb"))
                sim = 100 * (x == y).mean(axis=1)
                yield pa.record_batch([part.column("a"), part.column("b"), pa.array(sim)], names=["a", "b", "sim"]).filter(pa.array(sim >= least))

    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, "a long, b long, sim double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that the threshold links, on the full sets."""
    left = sets.select(F.col("cid").alias("a"), F.col("members").alias("ma"))
    right = sets.select(F.col("cid").alias("b"), F.col("members").alias("mb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ma, mb in zip(batch.column("ma"), batch.column("mb"), strict=True):
                x, y = (np.frombuffer(m.as_buffer(), np.uint64) for m in (ma, mb))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "ma", "mb"), run, "a long, b long")


def _across(loose: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that connect the parts of each loose component, not all of them.  loose: cid, loose, part.

    All but the largest part ask, against every class of the loose component, in blocks of some
    classes by some classes: a task holds two blocks, however large the component.
    """
    parts = loose.groupBy("loose", "part").agg(F.count("*").alias("n"))
    whole = parts.groupBy("loose").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    whole = whole.select("loose", "n", (F.col("n") - F.col("largest.n")).alias("asking"), F.col("largest.part").alias("largest"))
    blocks = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    rows = loose.join(whole, "loose").join(sets, "cid").withColumn("asks", F.col("part") != F.col("largest"))
    rows = rows.withColumns({"nq": blocks("asking", ASKING), "na": blocks("n", ANSWERING), "h": F.xxhash64("cid")})
    asks = rows.filter("asks").withColumn("q", F.pmod("h", F.col("nq"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    answers = rows.withColumn("a", F.pmod("h", F.col("na"))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).withColumn("asks", F.lit(False))
    columns = ["loose", "q", "a", "asks", "cid", "part", "members"]
    dealt = asks.select(*columns).unionByName(answers.select(*columns)).repartition("loose", "q", "a").sortWithinPartitions("loose", "q", "a", F.col("asks").desc())

    def links(asking: list[tuple], answering: list[tuple]) -> Iterator[tuple[int, int]]:
        members = [np.frombuffer(m, np.uint64) for _, _, m in asking]
        sizes, part = np.array([len(m) for m in members]), np.array([p for _, p, _ in asking])
        token, owner = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        above: dict[int, int] = {}

        def find(part: int) -> int:
            while (up := above.setdefault(part, part)) != part:
                above[part] = above[up]
                part = above[part]
            return part

        for cid, own, m in answering:
            x = np.frombuffer(m, np.uint64)
            lo, hi = np.searchsorted(token, x), np.searchsorted(token, x, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(members))
            for i in np.flatnonzero((100 * common >= percent * (sizes + len(x) - common)) & (part != own)):
                a, b = find(int(part[i])), find(own)
                if a != b:  # one link between two parts is enough
                    above[a] = b
                    yield asking[i][0], cid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking, answering = None, [], []

        def done() -> pa.RecordBatch:
            found = list(links(asking, answering)) if asking else []
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for *at, asks, cid, own, m in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if at != key:
                    yield done()
                    key, asking, answering = at, [], []
                (asking if asks else answering).append((cid, own, m))
        yield done()

    return mapped(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, mark (xxhash64 of the text), n_shingles, component_id (smallest doc_id
    reachable), kept (doc_id = component_id), stays (true in one document of each component, equal rows alike).
    """
    rows = stash(_sketches(docs, words))
    label = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")  # a null id comes last
    least = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min(label).alias("label"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief"))
    classes = stash(least.withColumn("cid", F.monotonically_increasing_id()))
    pairs = stash(_candidates(classes, percent))

    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = classes.join(ends, "cid").select("cid", "digest", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    asked = wanted.select(F.col("label.doc_id").alias("d"), F.col("label.mark").alias("m")).distinct()
    sets = _sets(matched(packed(texts), asked, "left_semi"), words).join(wanted.select("digest", "cid"), "digest").dropDuplicates(["cid"])
    sets = stash(sets.select("cid", "members"))

    best = lambda x, y: pairs.select(F.col(x).alias("x"), F.struct("sim", F.col(y).alias("y")).alias("near"))
    nearest = best("a", "b").unionByName(best("b", "a")).groupBy("x").agg(F.max("near").alias("near"))
    first = nearest.select(F.least("x", "near.y").alias("a"), F.greatest("x", "near.y").alias("b")).distinct()
    links = stash(_confirmed(first, sets, percent))
    parts = stash(components(links)).select(F.col("node").alias("cid"), F.col("root").alias("part"))
    loose = stash(components(pairs.select("a", "b"))).select(F.col("node").alias("cid"), F.col("root").alias("loose"))
    loose = loose.join(parts, "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    more = stash(_across(loose, sets, percent))
    roots = stash(components(links.unionByName(more)))

    named = classes.select("cid", "digest", "label").join(roots.withColumnRenamed("node", "cid"), "cid")
    smallest = named.groupBy("root").agg(F.min("label").alias("smallest"))
    linked = named.join(smallest, "root").select("digest", "smallest")
    alone = classes.select("digest", "label")
    of_class = alone.join(linked, "digest", "left").select("digest", F.coalesce("smallest", "label").alias("smallest"))
    result = rows.join(of_class, "digest", "left").withColumn("smallest", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(label))
    component = F.col("smallest.doc_id")
    return result.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), label.eqNullSafe(F.col("smallest")).alias("stays"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each component; documents without words all stay, and equal rows are one."""
    stays = near_duplicates(docs, words, percent).filter("stays").select(F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), rest, "text")
    met = matched(packed(rows), stays.distinct(), "left_semi").dropDuplicates(["doc_id", "mark"])
    done = unpacked(met.select("rest", "text"))
    return done.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document with its set's size, its component and whether it is the one that stays; 2-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2).select("doc_id", "n_shingles", "component_id", "kept")
