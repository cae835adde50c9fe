"""Communities, greedy duplicates, streams in several batches and hooks against plain versions and literal cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from govgraph import hooks
from govgraph.functions import answers
from govgraph.operators import answering, curation, traverse
from govgraph.plans.projection import Graph
from govgraph.sources import benchmarks
from govgraph.streaming import streams


def test_communities_of_two_cliques(spark):
    cliques = [(f"{k}{i}", f"{k}{j}") for k in "xy" for i in range(5) for j in range(i)]
    rows = [(a, "LINKS", b) for a, b in [*cliques, ("x0", "y0")]]
    triples = spark.createDataFrame(rows, "subject string, relation string, object string")
    got = {r.id: r.community_id for r in traverse.communities(triples).collect()}
    assert got == {f"{k}{i}": f"{k}0" for k in "xy" for i in range(5)}
    member = traverse.louvain(triples)
    assert traverse.modularity(triples, member).first().modularity > 0.4
    star = spark.createDataFrame([("hub", "L", f"n{i}") for i in range(6)], "subject string, relation string, object string")
    assert traverse.communities(star).select("community_id").distinct().count() == 1


def plain_louvain(pairs, bits, rounds=8, levels=3):
    step = Counter()
    for a, b in {tuple(sorted(p)) for p in pairs if p[0] != p[1]}:
        step[a, b] = step[b, a] = 1
    member = {a: a for a, _ in step}
    for _ in range(levels):
        k, ends, still = Counter(), sum(step.values()), 0
        for (a, _), w in step.items():
            k[a] += w
        label = {a: a for a in k}
        for turn in range(rounds):
            total, inside = Counter(), {a: Counter({c: 0}) for a, c in label.items()}
            for a, c in label.items():
                total[c] += k[a]
            for (a, b), w in step.items():
                if a != b:
                    inside[a][label[b]] += w
            gain = lambda a, c: round(inside[a][c] - k[a] * (total[c] - (k[a] if c == label[a] else 0)) / ends, 9)  # noqa: B023, E731
            new = {a: max((gain(a, c), c == label[a], c) for c in inside[a])[2] if bits[a][turn] else label[a] for a in label}
            label, still = new, 0 if new != label else still + 1
            if still == 2:
                break
        member = {a: label[c] for a, c in member.items()}
        above = Counter()
        for (a, b), w in step.items():
            above[label[a], label[b]] += w
        step = above
        if all(a == c for a, c in label.items()):
            break
    return {a: min(x for x in member if member[x] == c) for a, c in member.items()}


def test_louvain_in_blocks(spark):
    draw = random.Random(5)
    pairs = [(f"n{draw.randrange(120)}", f"n{draw.randrange(120)}") for _ in range(150)]
    pairs += [(f"n{30 * g + draw.randrange(30)}", f"n{30 * g + draw.randrange(30)}") for g in range(4) for _ in range(70)]
    pairs += [(b, a) for a, b in pairs[::7]] + [(None, "n1"), ("far", "away"), ("\u00e9", "\U0001f600")]
    triples = spark.createDataFrame([(a, "LINKS", b) for a, b in pairs], "subject string, relation string, object string")
    ids = spark.createDataFrame([(i,) for i in {x for p in pairs for x in p if x}], "id string")
    bits = {r.id: r.bits for r in ids.select("id", F.array(*(F.pmod(F.xxhash64("id", F.lit(t)), F.lit(2)) == 0 for t in range(8))).alias("bits")).collect()}
    want = plain_louvain([p for p in pairs if None not in p], bits)
    for size in (256, 1 << 20):  # several blocks, one
        assert {r.id: r.community_id for r in traverse.louvain(triples, size=size).collect()} == want
    assert 4 < len(set(want.values())) < 60


def test_louvain_modularity(spark):
    cliques = [(f"{k}{i}", f"{k}{j}") for k in "xy" for i in range(5) for j in range(i)]
    triples = spark.createDataFrame([(a, "LINKS", b) for a, b in [*cliques, ("x0", "y0"), ("y0", "x0"), ("x1", "x1")]], "subject string, relation string, object string")
    # Of 42 ends each clique holds 21, 20 of them inside.
    assert math.isclose(traverse.louvain_modularity(triples, size=16).first().modularity, 40 / 42 - 0.5)
    assert math.isclose(traverse.modularity(triples, traverse.louvain(triples)).first().modularity, 40 / 42 - 0.5)
    assert traverse.louvain_modularity(triples.limit(0)).first().modularity is None


def test_links_are_the_ends_of_triples(spark):
    g = Graph(spark, "/root/testdata/sf0.001")
    assert {tuple(r) for r in g.links.collect()} == {tuple(r) for r in g.triples.select("subject", "object").collect()}


def grams(text):
    padded = f"  {' '.join(text.lower().replace('_', ' ').split())}  "
    return Counter(padded[i : i + 3] for i in range(max(1, len(padded) - 2)))


def cosine(a, b):
    x, y = grams(a), grams(b)
    return sum(x[g] * y[g] for g in x) / math.sqrt(sum(v * v for v in x.values())) / math.sqrt(sum(v * v for v in y.values()))


def test_semantic_duplicates(spark):
    names = ["New York City", "new york_city", "New York City.", "Boston", "Bostons", "version 1984", "version 1985", "Paris", "Paris", "the large and heavy metal bolts of an old bridge", "the large and heavy metal bolt of an old bridge", "the large and heavy metal bolts of the old bridge"]
    kinds = ["LOC", "", "UNKNOWN", "LOC", "ORG", "", "", "LOC", "PER", "", "", ""]
    rows = [(1, i, n, k, i) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
    want, consumed = set(), set()
    for i, a in enumerate(names):
        if i in consumed:
            continue
        for j in range(i + 1, len(names)):
            x, y = (k if k not in ("UNKNOWN", "?") else "" for k in (kinds[i], kinds[j]))
            digits = [[*filter(str.isdigit, n)] for n in (a, names[j])]
            if j not in consumed and not (x and y and x != y) and not (digits[0] and digits[1] and digits[0] != digits[1]) and cosine(a, names[j]) >= 0.88:
                consumed.add(j)
                want.add((i, j))
    df = spark.createDataFrame(rows, "doc long, id long, name string, type string, pos long")
    assert {(r.canonical, r.merged) for r in curation.semantic_duplicates(df, "doc").collect()} == want and len(want) >= 2
    vectors = df.withColumn("vector", F.when(F.col("id").isin(3, 7), F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.col("id").cast("double"), -F.col("id") * F.lit(9.0) - 1)))
    assert (3, 7) in {(r.canonical, r.merged) for r in curation.semantic_duplicates(vectors.filter("id in (3, 7)"), "doc").collect()}


def test_guarded_merges(spark):
    names = spark.createDataFrame([(1, f"e{i}", f"name{'' if i else ' 7'}", "T" if i < 9 else "U") for i in range(12)] + [(1, "x", "name 8", "T")], "doc long, id string, name string, type string")
    groups = spark.createDataFrame([(1, 1, "e0", ["e1", "x", "e11", "gone"]), (1, 2, "none", ["e2"]), (1, 3, "e2", [f"e{i}" for i in range(12)])], "doc long, at int, canonical string, merged array<string>")
    r = curation.guarded_merges(groups, names).first()
    assert (r.n_left, r.n_merged, r.n_skipped, r.n_blocked) == (12, 1, 2, 1)


@pytest.mark.parametrize(("reply", "want"), [('{"a": [1, 2', {"a": [1, 2]}), ('x {"a": "b', {"a": "b"}), ("[1, 2, 3", [1, 2, 3]), ('<think>{"z": 1}</think>{"a": 1}', {"a": 1}), ("none", None), ('```json\n{"a": {"b": [1, {"c": 2}\n```', {"a": {"b": [1, {"c": 2}]}})])
def test_repaired_json(reply, want):
    import json

    got = answers._repaired(reply)
    assert (None if got is None else json.loads(got)) == want


def test_several_batches(spark, tmp_path):
    """Windows, latest values and a restart over files that arrive one after the other."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = streams.split_in_time(events, f"file://{tmp_path}/in")
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() >= 4
    stream = streams.read(spark, f"{path}/*.parquet")
    assert streams.drain(streams.windows(stream, "1 hour"), "complete").agg(F.sum("n")).first()[0] == events.count()
    out, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    first = streams.drain(stream, out=out, state=state).count()
    assert first == events.count() == streams.drain(stream, out=out, state=state).count()
    with pytest.raises(ValueError, match="keys"):
        streams.drain(streams.latest(stream.select(F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("relation"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))), "update")


def test_hooks(spark):
    assert hooks.answer_format("BEAM").style == "verbose" and hooks.answer_format(None) == hooks.answer_format("default")
    assert hooks.Retrieval().but(hops=1).hops == 1
    with pytest.raises(ValueError, match="mode"):
        hooks.Retrieval(mode="other")
    assert answering.mode("other") == "hybrid"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    with pytest.raises(Exception, match="another number"):
        hooks.embedded(rows, lambda texts: []).collect()


def test_refusals(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [1.0], "entity")], "id long, vector array<double>, collection string")
    benchmarks.save_index(vectors, "h1", f"file://{tmp_path}/index")
    with pytest.raises(ValueError, match="another graph"):
        benchmarks.load_index(spark, f"file://{tmp_path}/index", "h2")
    with pytest.raises(ValueError, match="part"):
        benchmarks.save_state({"other": vectors}, f"file://{tmp_path}/state")
    (tmp_path / "up").mkdir()
    for name, text in (("a.txt", "words"), ("b.md", "no"), ("c.txt", "  "), ("d.pdf", "one|two")):
        (tmp_path / "up" / name).write_text(text)
    read = lambda **more: {r.document_id: r.text for r in benchmarks.read_uploads(spark, f"file://{tmp_path}/up", **more).collect()}
    assert read() == {"a.txt": "words"}
    assert read(pages=lambda data: data.decode().split("|")) == {"a.txt": "words", "d.pdf": "one\n\ntwo"}


def test_json_layouts(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "lines.json").write_text('{"a": 3}\n{"a": 4}\n')
    assert sorted(r.a for r in benchmarks.read_json(spark, f"file://{tmp_path}/*.json", "a long").collect()) == [1, 2, 3, 4]


def test_values_of_what_has_a_year_for_its_number(spark):
    """"Order 1995" is a name: its number is a year only where it stands again."""
    said = [(1, "Order 1995 opened on 3 May 1995, 20 km off.", "Order 1995"), (2, "Order 1850 opened on 3 May 1995.", "Order 1850"), (3, "Order 1850 is from 1850.", None), (4, "Order 18501 opened in 1850, of Order 1850.", "Order 1850")]
    rows = spark.createDataFrame(said, "doc_id long, text string, name string")
    years = lambda **more: sorted((r.doc_id, r.text) for r in answers.values_in(rows, **more).collect() if r.type == "Year")
    assert years(name="name") == [(1, "1995"), (2, "1995"), (3, "1850"), (4, "1850")]
    assert years() == [(1, "1995"), (2, "1850"), (2, "1995"), (3, "1850"), (4, "1850")]


def grown(tmp_path, **tables):
    """A folder with these small tables beside the smallest ones."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in os.listdir("/root/testdata/sf0.001"):
        os.symlink(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    for name, columns in tables.items():
        os.unlink(tmp_path / f"{name}.parquet")
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def against_sql(spark, name, folder):
    """Rows of a query and of its SQL, in order."""
    import os

    import duckdb

    from govgraph.plans import registry

    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{table}'")
    got = registry.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def orders_of_years():
    from datetime import datetime

    return {"o_orderkey": [1700, 1850, 1995, 1996, 2050], "o_custkey": [1, 2, 3, 4, 5], "o_orderdate": [datetime(1995, 5, i + 1) for i in range(5)]}


def test_values_of_orders(spark, tmp_path):
    got, want = against_sql(spark, "n18_values", grown(tmp_path, orders=orders_of_years()))
    assert got == want and len(got) == 35


def test_relations_of_orders(spark, tmp_path):
    got, want = against_sql(spark, "n19_value_relation", grown(tmp_path, orders=orders_of_years()))
    assert got == want


def test_thresholds_at_their_steps(spark, tmp_path):
    """Scores that stand on a step of the grid."""
    n = list(range(14))
    documents = {"doc_id": n, "text": [""] * 14, "lang": ["en"] * 14, "source": ["s"] * 14, "n_chars": [1200 + 200 * i for i in n]}
    got, want = against_sql(spark, "e30_thresholds", grown(tmp_path, labels={"doc_id": n, "quality": [i % 2 for i in n], "toxic": [0] * 14}, documents=documents))
    assert got == want and len(got) == 14


def test_long_numbers_are_garbage(spark, tmp_path):
    keys = [1, 7, 1003, 2101, 10003, 15001, 100003, 150001, 199903, 2000203, 19991999]
    keys = [k - (k - 1) % 6 for k in keys]
    customers = {"c_custkey": keys, "c_name": ["n"] * len(keys), "c_nationkey": [1] * len(keys), "c_acctbal": [1.0] * len(keys), "c_mktsegment": ["s"] * len(keys)}
    got, want = against_sql(spark, "p7_garbage_entities", grown(tmp_path, customer=customers))
    assert got == want


def test_nearest_of_ties_and_odd_balances(spark, tmp_path):
    """Against all pairs: equal gaps on both sides, equal balances, null, NaN and infinite ones, nations of one kind only."""
    nan, inf = float("nan"), float("inf")
    balances = [1.0, 2.0, 2.0, 3.0, -5.0, None, nan, inf, -inf, 0.0, 7.5]
    supplier = [(i, nation, y) for nation in range(4) for i, y in enumerate(balances, 20 * nation) if nation < 2 or (nation == 2 and not (y is not None and abs(y) < inf)) or (nation == 3 and y in (2.0, 3.0))]
    asked = [1.5, 2.5, 2.0, -9.0, 100.0, None, nan, inf, -inf, 5.25, 0.5]
    customer = [(i, n, x) for i, (n, x) in enumerate((n, x) for n in range(5) for x in asked)]
    k, n, y = map(list, zip(*supplier[::-1], strict=True))
    c, m, x = map(list, zip(*customer, strict=True))
    tables = {"supplier": {"s_suppkey": k, "s_name": ["s"] * len(k), "s_nationkey": n, "s_acctbal": y}, "customer": {"c_custkey": c, "c_name": ["c"] * len(c), "c_nationkey": m, "c_acctbal": x, "c_mktsegment": ["m"] * len(c)}}
    got, want = against_sql(spark, "j11_nearest", grown(tmp_path, **tables))
    assert got == want and len(got) == 44


def test_nearest_compares_no_pairs(spark):
    """Of one nation with many suppliers, no join meets customers with all of them."""
    from govgraph.plans.join_plans import nearest

    c = spark.range(2000).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.col("id").cast("double").alias("c_acctbal"))
    s = spark.range(2000).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), (F.col("id") * 3).cast("double").alias("s_acctbal"))
    plan = nearest(c, s)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    assert {r.c_custkey: r.s_suppkey for r in nearest(c, s).collect()} == {i: (i + 1) // 3 for i in range(2000)}


def test_copies_of_similar_names(spark):
    """Names in several copies, of types that agree, differ or say nothing, with positions against their ids' order."""
    base = ["New York City", "new york_city", "New York City.", "Boston", "version 1984", "version 1985", "version 1984 b", "", None]
    rows = [(i % 2, i, base[(i * 5) % len(base)], ["LOC", "", "ORG", "?"][(i // 3) % 4], (i * 7) % 60) for i in range(120)]
    df = spark.createDataFrame(rows, "doc long, id long, name string, type string, pos long")

    def fits(x, y):
        kinds = [k if k != "?" else "" for k in (x[3], y[3])]
        digits = [[*filter(str.isdigit, n)] for n in (x[2], y[2])]
        return not (kinds[0] and kinds[1] and kinds[0] != kinds[1]) and not (digits[0] and digits[1] and digits[0] != digits[1]) and cosine(x[2], y[2]) >= 0.88 - 1e-12

    named = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[4], r[1]))
    want = {(x[0], x[1], y[1]) for i, x in enumerate(named) for y in named[i + 1 :] if x[0] == y[0] and fits(x, y)}
    assert sorted(tuple(r) for r in curation.alike(df, "doc").select("doc", "a", "b").collect()) == sorted(want)
    consumed, merged = set(), set()
    for i, x in enumerate(named):
        for y in named[i + 1 :]:
            if x[1] not in consumed and y[1] not in consumed and (x[0], x[1], y[1]) in want:
                consumed.add(y[1])
                merged.add((x[0], x[1], y[1]))
    assert {(r.doc, r.canonical, r.merged) for r in curation.semantic_duplicates(df, "doc").collect()} == merged


def test_semantic_duplicates_of_a_large_class(spark):
    """Thirty thousand copies of one name: their pairs would be 450 million."""
    df = spark.range(30_000).select(F.lit(1).alias("doc"), "id", F.lit("the same name").alias("name"), F.lit("").alias("type"), F.col("id").alias("pos"))
    found = curation.semantic_duplicates(df, "doc")
    assert found.agg(F.count("*"), F.count_distinct("merged"), F.max("canonical")).first() == (29_999, 29_999, 0)
