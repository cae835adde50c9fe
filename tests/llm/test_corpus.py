"""Line dedup, near-dedup, mixing, language, top-k and the pipeline against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from govgraph.llm import components, language, line_dedup, mixing, near_dup, top_k, work

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within():
    rng = random.Random(3)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in "xy")
        for k in (1, 2, 3):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


def plain_lines(rows, edits, least):
    seen = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if len(x) >= least]
    lines, groups = sorted({x for _, _, x in seen}), Groups()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                groups.join(a, b)
    first, gone = {}, collections.defaultdict(set)
    for d, i, x in sorted(seen):
        if first.setdefault(groups.find(x), (d, i)) != (d, i):
            gone[d].add(i)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) if gone[d] else t for d, t in rows}


@pytest.mark.parametrize(("edits", "few"), [(1, 3), (2, 3), (1, 16)])
def test_line_dedup(spark, edits, few, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(edits)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(3, 14))) for _ in range(10)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, max(0, len(s) - 1))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        return "".join(s)

    rows = [(i, None if i == 5 else "" if i == 6 else "\n".join(changed(rng.choice(base)) for _ in range(rng.randint(0, 5))) + rng.choice(["", "\n"])) for i in range(30)]
    df = spark.createDataFrame([(d, t, "kept") for d, t in rows], "doc_id long, text string, lines string")
    got = line_dedup.dedup_lines(df, edits, 4).collect()
    assert {r.doc_id: r.text for r in got} == plain_lines(rows, edits, 4)
    assert all(r.lines == "kept" for r in got)


@pytest.mark.parametrize("few", [0, 16])
def test_line_dedup_by_length(spark, few, monkeypatch):
    """Several edits in longer lines, and exact copies of lines of any length."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rng, allowed = random.Random(few), lambda n: sum(n >= least for least in (20, 50, 100))
    rows, seen, groups = [], [], Groups()
    for n in (2, 19, 20, 48, 50, 60, 98, 100, 140):
        base = "".join(rng.choice("abcdé") for _ in range(n))
        for k in range(9):
            line = list(base)
            for _ in range(k // 2):
                i = rng.randrange(len(line))
                line[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            rows.append((len(rows), "".join(line) + "\nok\nunlike " + str(len(rows))))
    for d, t in rows:
        seen += [(d, i, x) for i, x in enumerate(t.split("\n"))]
    lines = sorted({x for _, _, x in seen})
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= allowed(min(len(a), len(b))) and distance(a, b) <= allowed(min(len(a), len(b))):
                groups.join(a, b)
    first = {}
    for d, i, x in seen:
        first.setdefault(groups.find(x), (d, i))
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if first[groups.find(x)] == (d, i)) for d, t in rows}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_keys_of_one_line_stay_behind(spark, monkeypatch):
    """Only keys under which two lines meet become rows, however few entries of a bucket are held."""
    rng = random.Random(8)
    unlike = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in range(20, 200)]
    docs = spark.createDataFrame([(x,) for x in [*unlike, *unlike, None, ""]], "text string")
    assert line_dedup._line_keys(docs, None, 0).count() == 0
    near = spark.createDataFrame([(unlike[0] + "\n" + unlike[0][1:] + "z",), (unlike[100],)], "text string")
    assert line_dedup._line_keys(near, 2, 0).select("lid").distinct().count() == 2
    rows = np.zeros(6000, line_dedup._ROW)
    for name, most in (("key", 2000), ("lid", 900), ("role", 2)):
        rows[name] = [rng.randrange(most) for _ in rows]
    rows["role"] = np.where(rows["role"] == 1, line_dedup.INDEX | line_dedup.PROBE, line_dedup.PROBE)
    rows["key"] = rows["key"] << np.uint64(50)
    lines = collections.defaultdict(set)
    for key, lid, role in rows.tolist():
        lines[key].add(lid)
    index = {key for key, _, role in rows.tolist() if role & line_dedup.INDEX}
    # An index entry is a probe too, so what a line's own probe adds to its index entry is nothing.
    entries = {(key, lid) for key, lid, role in rows.tolist() if role & line_dedup.INDEX}
    want = {(k, i, r) for k, i, r in rows.tolist() if k in index and len(lines[k]) > 1 and (r & line_dedup.INDEX or (k, i) not in entries)}
    for held in (10, 1 << 22):
        monkeypatch.setattr(line_dedup, "HELD", held)
        buckets, got = collections.defaultdict(list), set()
        for lo in range(0, len(rows), 500):
            part = line_dedup._parcels(rows[lo : lo + 500])
            for bucket, probe, data in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                buckets[bucket].append((probe, np.frombuffer(data, line_dedup._ROW)))
        for parts in buckets.values():
            one = line_dedup._Bucket()
            for probe, data in sorted(parts, key=lambda p: p[0]):
                got |= {r for found in (one.probes(data) if probe else one.index(data)) for r in found.tolist()}
            got |= {r for found in one.done() for r in found.tolist()}
        assert want <= got <= {r for r in rows.tolist() if r[0] in index and len(lines[r[0]]) > 1}


def sets_of(text, words):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def near_rows():
    rng, vocabulary = random.Random(6), [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(text).replace("w1", rng.choice(["w1", "W1"]))))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), rows[4], (None, "alone without an id")]


@pytest.mark.parametrize(("small", "block"), [(12, 64), (2, 2)])
def test_near_duplicates(spark, small, block, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_NODE", small)
    monkeypatch.setattr(near_dup, "ASKING", block)
    monkeypatch.setattr(near_dup, "ANSWERING", block)
    rows = near_rows()
    sets, groups = {d: sets_of(t, 2) for d, t in rows if d is not None}, Groups()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                groups.join(a, b)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), groups.find(r.doc_id), groups.find(r.doc_id) == r.doc_id)


def test_near_duplicates_null_ids(spark):
    rows = [(None, "one text that is held"), (5, "one text that is held"), (7, "one text that is held"), (None, "alone without an id"), (None, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted(map(repr, ((r.doc_id, r.component_id, r.kept) for r in got))) == sorted(map(repr, [(None, 5, False), (5, 5, True), (7, 5, False), (None, None, True), (None, None, True)]))
    assert sum(r.stays for r in got) == 3


def alternating(n, a, b):
    """Two sequences that sums modulo a power of two cannot tell apart: Thue and Morse's and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_content_identity(spark, n):
    """Texts that collide in polynomial hashes modulo 2 ** 64 are different lines and different shingles."""
    x, y = alternating(n, "a", "b")
    docs = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {1: x, 2: y, 3: ""}
    got = near_dup.near_duplicates(docs, words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_near_recall_in_a_crowd(spark, monkeypatch):
    """One family of variants, all in large nodes: of the pairs in each band of similarity, how many share a component."""
    monkeypatch.setattr(near_dup, "SMALL_NODE", 3)
    rng, vocabulary = random.Random(9), [f"t{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(160):
        text = list(base)
        for at in rng.sample(range(150), rng.choice([2, 5, 8, 20, 40])):
            text[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    sets, bands = {d: sets_of(t, 2) for d, t in rows}, collections.defaultdict(list)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 100 * len(x & y) >= 80 * len(x | y):
                bands[100 * len(x & y) // len(x | y) // 5].append(got[a] == got[b])
    assert len(bands) >= 3 and all(np.mean(found) >= 0.99 for found in bands.values())


def test_near_duplicates_at_the_last_depth(spark, monkeypatch):
    """A node that is still large at MAX_DEPTH is compared exactly, also what is unlike its chosen member."""
    monkeypatch.setattr(near_dup, "SMALL_NODE", 2)
    monkeypatch.setattr(near_dup, "DEPTH", 0)
    monkeypatch.setattr(near_dup, "MAX_DEPTH", 0)
    rows = [r for r in near_rows() if r[0] is not None]
    sets, groups = {d: sets_of(t, 2) for d, t in rows}, Groups()
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                groups.join(a, b)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: groups.find(d) for d in sets}


def test_near_recall():
    """Pairs of sketches that agree as those of sets at the threshold do meet at every depth in 0.999 of the cases."""
    rng, n = np.random.default_rng(4), 20000
    x = rng.integers(0, 1 << 32, (n, near_dup.TOKENS), dtype=np.uint32)
    y = np.where(rng.random(x.shape) < 0.8, x, rng.integers(0, 1 << 32, x.shape, dtype=np.uint32))
    roots = near_dup.K.mix(np.arange(1, near_dup.TREES + 1, dtype=np.uint64))
    a, b = (near_dup._children(np.broadcast_to(roots, (n, near_dup.TREES)), s, near_dup.DEPTH) for s in (x, y))
    row, at = np.nonzero(a == b)  # a node's name has its whole path, so only shared ones matter
    node, depth = a[row, at], near_dup.DEPTH
    while depth < near_dup.MAX_DEPTH:
        assert len(np.unique(row)) / n > 0.999
        node, row, other = *near_dup._below(node, x, row, 1), near_dup._below(node, y, row, 1)[0]
        row, node = row[node == other], node[node == other]
        few = np.lexsort((node, row))  # some dozen paths of a pair stand for all
        nth = np.arange(len(few)) - np.searchsorted(row[few], row[few])
        row, node, depth = row[few][nth < 40], node[few][nth < 40], depth + 1
    assert len(np.unique(row)) / n > 0.999


def test_components(spark, monkeypatch):
    rng, groups = random.Random(2), Groups()
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]
    edges += [(100 + i, 101 + i) for i in range(30)]
    for a, b in edges:
        groups.join(a, b)
    want = {x: groups.find(x) for a, b in edges if a != b for x in (a, b)}
    for few in (1 << 20, 0):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_near_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_targets(sizes):
    """Sources stop one after the other until none is above twice its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_mixing(spark):
    rng = random.Random(1)
    names = ["a", "b", "B", "é", None, "hot", "tiny", "zero"]
    rows = []
    for i in range(900):
        name = "hot" if i % 3 == 0 else rng.choice(names)
        rows.append((i, None if i % 97 == 0 else "" if name == "zero" else " ".join("x" * rng.randint(1, 60)), name))
    rows.append(rows[7])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda: mixing.plan_mix(mixing.document_sizes(df))[0].collect()
    got = run()
    assert len(got) == len(rows)
    sizes, taken = collections.Counter({n: 0 for n in names}), collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    assert sum(sizes.values()) == sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    want = plain_targets({n: sizes[n] for n in names})
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for n in names:
        assert taken[n] == pytest.approx(want[n], rel=0.01, abs=4)
    assert sorted(map(repr, run())) == sorted(map(repr, got))
    assert mixing.plan_mix(mixing.document_sizes(df.limit(0)))[0].count() == 0


def test_mixing_draws_shards(spark, monkeypatch):
    """The draw is in the plan of the words taken; shards are full but the last, and hold the sources in proportion."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 256)
    rows = [(i, "x " * 20, "ab"[i % 2]) for i in range(400)]
    taken, slots = mixing.plan_mix(mixing.document_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert "shard" in taken._jdf.queryExecution().optimizedPlan().toString()
    got = slots.collect()
    assert sorted(r.place for r in got) == list(range(len(got))) and all(r.shard == r.place // 256 for r in got)
    full = collections.Counter(r.shard for r in got)
    assert len(full) > 4 and all(full[k] == 256 for k in list(range(len(full) - 1)))
    share = sum(r.sid == 0 for r in got) / len(got)
    counts = collections.Counter(r.shard for r in got if r.sid == 0)
    assert all(abs(counts[k] - 256 * share) < 60 for k in range(len(full) - 1)) and len({counts[k] for k in range(len(full) - 1)}) > 1


def test_mixed_documents(spark):
    """Whole documents, near the targets, with columns of any name; long and null texts, a null id, repeated rows."""
    rows = [(i, "w " * (3 + i % 40), "abc"[i % 3], i, "x") for i in range(600)]
    rows += [(None, "no id", "a", 1, "y"), (601, None, "b", 2, None), (602, "long " * 50_000, "c", 3, "z"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, times int, `m.k` string")
    got = mixing.mix_documents(docs).collect()
    assert got[0].__fields__ == docs.columns
    known = collections.Counter(map(repr, rows))
    assert all(n <= 2 * known[one] for one, n in collections.Counter(repr(tuple(r)) for r in got).items())
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r.x for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x")).collect()]
        assert sorted(got) == list(range(n))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.learn(docs.filter(~held))
    got = language.identify(docs.filter(held), model, keep=("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "漢字"), (5, "the " * 30000)], "doc_id long, text string")
    by = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[4].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in by.values())
    repeated = odd.union(odd).withColumn("held_out", F.lit("clash")).withColumn("n", F.lit(0))
    assert collections.Counter((r.doc_id, r.lang_pred, r.held_out) for r in language.identify(repeated, model, keep=("doc_id", "held_out")).collect()) == collections.Counter({(i, by[i].lang_pred, "clash"): 2 for i in by})
    assert language.identify(odd.limit(0), model).count() == 0
    unnamed = spark.createDataFrame([(None, "un chien dort", "fr"), (None, "a dog sleeps", "en")], "doc_id long, text string, lang string")
    assert language.learn(unnamed).languages == ["en", "fr"]
    assert language.learn(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}


def test_language_against_plain_kernel(spark):
    """Kernel, landmarks and ridge regression written out over sets of n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.filter("lang is not null and text is not null").orderBy("doc_id").collect() if re.search("[a-z]", r.text)]
    held = lambda t: {t.encode().lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    sets = [held(t) for t, _ in rows]
    table = pa.array([t for t, _ in rows], pa.string())
    model = language.Model([x.astype(np.int32) for b in language.K.blocks(table) for x in language.grams(b)], [x for _, x in rows], 40)
    kernel = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    marks = [sets[i] for i in model.chosen]
    assert {rows[i][1] for i in model.chosen} == set(model.languages) and len(marks) == 40
    value, vector = np.linalg.eigh(np.array([[kernel(x, y) for y in marks] for x in marks]))
    root = vector / np.sqrt(value)
    z = np.c_[np.array([[kernel(x, y) for y in marks] for x in sets]) @ root, np.ones(len(sets))]
    y = np.array([[1.0 if lang == one else -1.0 for one in model.languages] for _, lang in rows])
    want = z @ np.linalg.solve(z.T @ z + language.RIDGE * np.eye(41), z.T @ y)
    got = np.concatenate([model.scores(b) for b in language.K.blocks(table)])
    assert np.abs(got - want).max() < 0.01
    assert (got.argmax(axis=1) == want.argmax(axis=1)).mean() > 0.99


def test_fold(spark):
    got = spark.createDataFrame([(17,)], "doc_id long").select(F.crc32(F.col("doc_id").cast("string")).alias("c")).first().c
    assert got == zlib.crc32(b"17")


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(top_k, "ROW_BLOCK", block)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", max(2, block // 8))
    monkeypatch.setattr(top_k, "FIRST", 8)
    monkeypatch.setattr(top_k, "STEP", 4)
    rng = np.random.default_rng(block)
    x = np.round(rng.normal(0, 0.3, (120, 8)), 2)
    x[50:60] = x[0]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0, None] * 4), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (250, [0.5, 0.25])]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    whole = np.floor(256 * x).astype(int)
    want = set()
    for i in (0, 50, 100):
        score = whole @ whole[i]
        order = [j for j in np.lexsort((np.arange(120), -score)) if j != i][:5]
        want |= {(i, n, int(j), int(score[j])) for n, j in enumerate(order, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert top_k.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_mixed_magnitudes():
    """Exact also where rows, and so pivots, are of very different lengths in few dimensions."""
    rng = np.random.default_rng(5)
    for dim in (1, 2, 3, 8):
        x = rng.integers(-300, 300, (1500, dim)) * np.where(rng.random((1500, 1)) < 0.5, 1, 10 ** rng.integers(4, 7, (1500, 1)))
        pivots = x[rng.choice(1500, 32, replace=False)].astype(float)
        far = np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(axis=2))
        some = np.arange(0, 1500, 10)
        got = collections.defaultdict(list)
        for row, _, vec, score in top_k.best_of((some, some, x[some], far[some]), (np.arange(1500), np.arange(1500), x, far), 5):
            got[row].append((vec, score))
        for i in some.tolist():
            score = x @ x[i]
            want = [(int(j), int(score[j])) for j in np.lexsort((np.arange(1500), -score)) if j != i][:5]
            assert got[i] == want


def test_pipeline(spark):
    """Each stage against a plain version on its own input."""
    rng, words = random.Random(8), [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        lines = [say(rng.randint(12, 30)) for _ in range(3)]
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
    rows += [(100, rows[0][1], "en", "src0", 0), (101, "too short", "en", "src1", 0), (102, None, None, None, None), (103, "again and again " * 30, "en", "src2", 0)]
    near = rows[1][1].replace("\n", " ").split(" ")
    near[5] = "changed"
    rows.append((104, " ".join(near), "en", "src1", 0))
    docs = spark.createDataFrame(rows, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, "")
    assert {r.doc_id for r in good.collect()} == {*range(60), 100, 104}
    lines = stages["line dedup"](spark, good, "").cache()
    assert {r.doc_id for r in lines.collect()} == {*range(60), 104} and lines.columns == docs.columns
    kept = stages["minhash near-dedup"](spark, lines, "").cache()
    assert {r.doc_id for r in kept.collect()} <= {*range(60), 104} and kept.count() in (60, 61)
    mixed = stages["mixing sources"](spark, kept, "").cache()
    assert max(collections.Counter(r.doc_id for r in mixed.collect()).values()) <= 2 and mixed.columns == docs.columns
    out = stages["byte-level BPE"](spark, mixed, "").collect()
    assert len(out) == mixed.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_pipeline_batches_stay_small(spark):
    """Whole texts reach the workers a few MB at a time; a lower limit of the session's own stands."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 48, 1, 1).selectExpr("id as doc_id", "repeat(cast(id as string), 500000) as text", "'en' as lang", "'s' as source", "0L as n_chars")
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches)
    spark.conf.unset(limit)
    try:
        for _, stage in corpus_pipeline.STAGES[:1]:
            stage(spark, docs, "")
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert len(found) > 5 and max(found) < corpus_pipeline.BATCH_BYTES + (2 << 20)
        spark.conf.set(limit, "1m")
        corpus_pipeline.prepared(spark)
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit)


def test_workers_give_memory_back(spark):
    """What a task needed and freed is no longer held by its worker when the task is over."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous")) >> 10

    def run(batches):
        list(batches)
        before, parts, pins = held(), [], []
        for i in range(80_000):  # pieces that the C library keeps when they are freed, as some between them stay
            parts.append(bytes(1500))
            if i % 1000 == 999:
                pins.append(bytes(1500))
        parts.clear()
        Pins.kept = pins
        yield pa.record_batch([pa.array([before]), pa.array([held()])], names=["before", "after"])

    class Pins:
        kept = None

    class Sent:
        def mapInArrow(self, run, schema):
            return run

    task = work.mapped(Sent(), run, "")(iter(()))
    one = next(task).to_pylist()[0]
    assert one["after"] > one["before"] + 60 and not list(task)
    assert held() < one["before"] + 30


def test_workers_begin_without_others_memory():
    """What tasks of another kind freed, but left in the worker, is given back before a task begins."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous")) >> 10

    class Sent:
        def mapInArrow(self, run, schema):
            return run

    parts = [bytes(1500) for _ in range(120_000)]
    pins = parts[::1000]
    full = held()
    parts.clear()
    found = next(work.mapped(Sent(), lambda batches: iter([held()]), "")(iter(())))
    assert len(pins) == 120 and found < full - 100
