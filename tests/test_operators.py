"""Small literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from govgraph.functions import text as T
from govgraph.operators import governance as G
from govgraph.operators import scoring as S
from govgraph.operators import store, traverse, vectors

TRIPLES = "subject string, relation string, object string, confidence double, source string"


def triples(spark, *rows):
    return spark.createDataFrame([(*r, 0.5, "t")[:5] if len(r) == 3 else r for r in rows], TRIPLES)


def chart(spark):
    owned = spark.createDataFrame([("cardio", "heart"), ("cardio", "blood_pressure"), ("inflammation", "il6"), ("inflammation", "crp")], "domain_id string, entity_id string")
    return owned, spark.createDataFrame([("cardio", "AFFECTS"), ("inflammation", "ELEVATES")], "domain_id string, relation string")


def test_routing(spark):
    out = G.route(triples(spark, ("heart", "AFFECTS", "il6"), ("heart", "AFFECTS", "blood_pressure"), ("x", "NONE", "y"), ("x", "ELEVATES", "y")), *chart(spark))
    got = {(r.subject, r.relation, r.object): (r.assignment_type, r.domain_ids) for r in out.collect()}
    assert got["heart", "AFFECTS", "il6"] == ("cross_domain", ["cardio", "inflammation"])
    assert got["heart", "AFFECTS", "blood_pressure"] == ("single_owner", ["cardio"])
    assert got["x", "NONE", "y"] == ("unowned", [])
    assert got["x", "ELEVATES", "y"] == ("single_owner", ["inflammation"])


def test_modes(spark):
    routed = G.route(triples(spark, ("heart", "AFFECTS", "il6", 0.8, "t"), ("heart", "AFFECTS", "blood_pressure", 0.9, "t")), *chart(spark))
    action = lambda mode, **k: [r.action for r in G.decide(routed, mode, **k).orderBy("object").collect()]
    assert action("strict") == ["escalate", "escalate"]
    assert action("audit_only") == ["auto_approve", "auto_approve"]
    assert action("triage") == ["auto_approve", "escalate"]
    assert action("audit_only", floor=0.85) == ["auto_approve", "reject"]
    with pytest.raises(ValueError):
        G.decide(routed, "unknown")


def test_fragmentation(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("orphan",)], "id string")
    found = traverse.components(triples(spark, ("a", "R", "b")), nodes).collect()
    assert {r.id: r.component for r in found} == {"a": "a", "b": "a", "orphan": "orphan"}


def two_clusters(spark):
    chain = lambda names: [(a, "R", b) for a, b in zip(names, names[1:], strict=False)]
    physics, cooking = ["curie", "radium", "polonium", "nobel", "paris"], ["bread", "flour", "oven", "yeast", "salt"]
    extra = [("curie", "R", "nobel"), ("curie", "R", "polonium"), ("bread", "R", "yeast"), ("bread", "R", "oven"), ("paris", "R", "bread")]
    return triples(spark, *chain(physics), *chain(cooking), *extra), physics


def test_pagerank(spark):
    graph, physics = two_clusters(spark)
    seeds = spark.createDataFrame([("curie",), ("nowhere",)], "id string")
    top = [r.id for r in traverse.pagerank(graph, seeds).orderBy(F.desc("rank"), "id").limit(5).collect()]
    assert top[0] == "curie" and len(set(top) & set(physics)) >= 4
    assert traverse.pagerank(graph, spark.createDataFrame([("nowhere",)], "id string")).isEmpty()


def test_walks(spark):
    graph = triples(spark, ("a", "R", "b"), ("b", "R", "c"), ("c", "R", "d"), ("d", "R", "e"))
    seed = spark.createDataFrame([("a",)], "id string")
    assert traverse.neighbourhood(graph, seed, 1).count() == 2
    goal = spark.createDataFrame([("c",)], "id string")
    assert [r.nodes for r in traverse.simple_paths(graph, seed, goal).collect()] == [["a", "b", "c"]]


def test_merge(spark):
    base = triples(spark, ("a", "R", "x", 0.5, "old"))
    new = triples(spark, ("a", "R", "y", 0.5, "new"), ("b", "R", "z", 0.1, "new"))
    objects = lambda how: {(r.subject, r.object) for r in store.merge(new, base, how).collect()}
    assert objects("keep_higher_confidence") == {("a", "x"), ("b", "z")}  # a tie keeps the existing one
    assert objects("keep_new") == {("a", "y"), ("b", "z")}
    assert objects("keep_both") == {("a", "x"), ("a", "y"), ("b", "z")}
    assert objects("keep_existing") == {("a", "x"), ("b", "z")}


@pytest.mark.parametrize(
    ("a", "b", "clash"),
    [("1911", "1939", True), ("1 million", "100 million", True), ("12,000", "12000", False), ("no digits", "1911", False)],
)
def test_literal_conflict(spark, a, b, clash):
    assert spark.range(1).select(T.literal_conflict(F.lit(a), F.lit(b)).alias("x")).first().x is clash


@pytest.mark.parametrize(("value", "kind"), [("13 march 1963", "DATE"), ("1997-98", "DATE"), ("3.5", "NUMBER"), ("23 years", "QUANTITY"), ("heart", None), ("", None)])
def test_value_type(spark, value, kind):
    assert spark.range(1).select(T.value_type(F.lit(value)).alias("x")).first().x == kind


@pytest.mark.parametrize("name", ["HOMA-IR", "homair", "homa_ir"])
def test_matching_key(spark, name):
    assert spark.range(1).select(T.matching_key(F.lit(name)).alias("x")).first().x == "homair"


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.exact_match(F.lit("The  Beatles!"), F.lit("beatles"))) == 1.0
    assert one(T.token_f1(F.lit(""), F.lit(""))) == 1.0 and one(T.token_f1(F.lit("x"), F.lit(""))) == 0.0
    assert one(T.token_f1(F.lit("red red fox"), F.lit("red fox"))) == pytest.approx(0.8)
    assert one(T.clean_prediction(F.lit("Answer: Paris."), F.lit("Paris"))) == "Paris"
    assert one(T.clean_prediction(F.lit("Yes, it is"), F.lit("yes"))) == "yes"


def test_upsert_hash(spark):
    rows = spark.createDataFrame([("a", "one")], "id string, text string")
    empty = spark.createDataFrame([], "id string, text_hash string")
    first = vectors.changed(rows, empty)
    assert first.count() == 1 and vectors.changed(rows, first).count() == 0
    assert vectors.changed(spark.createDataFrame([("a", "two")], "id string, text string"), first).count() == 1


def test_normalized_flat_scores(spark):
    rows = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 2.0)], "collection string, id int, score double")
    assert [r.score for r in vectors.normalized(rows).collect()] == [1.0, 1.0]


def test_greedy_match(spark):
    pairs = spark.createDataFrame([("d", 1, 1, 0.9), ("d", 1, 2, 0.8), ("d", 2, 1, 0.85), ("d", 2, 2, 0.6)], "doc string, pred int, gold int, score double")
    assert {(r.pred, r.gold) for r in S.greedy_match(pairs, "doc", 0.5).collect()} == {(1, 1), (2, 2)}


def test_sign_test(spark):
    row = spark.createDataFrame([(9, 1), (0, 0)], "w int, l int").select(S.sign_test(F.col("w"), F.col("l")).alias("p")).collect()
    assert row[0].p == pytest.approx(22 / 1024) and row[1].p == 1.0


def test_graph_files(spark, tmp_path):
    from govgraph.sources import files

    (tmp_path / "kg.json").write_text('{"knowledge_graph": {"entities": [{"id": "a", "labels": ["A"]}], "triples": [{"subject": "a", "relation": "R", "object": "b"}, {"subject": "", "relation": "R", "object": "b"}]}}')
    entities, found = files.read_graph(spark, str(tmp_path / "kg.json"))
    assert entities.count() == 1 and [(r.subject, r.object) for r in found.collect()] == [("a", "b")]
    (tmp_path / "s.jsonl").write_text('{"doc_key": "d", "sentences": [["Heart", "rate"], ["is", "high"]], "ner": [[["0", "1", "Metric"]], [["3", "3", "Generic"]]], "relations": [[["0", "1", "3", "3", "IS"]]]}\n')
    e, r = files.read_token_spans(spark, str(tmp_path / "s.jsonl"))
    assert [x.text for x in e.collect()] == ["Heart rate"] and [(x.subject, x.object) for x in r.collect()] == [("Heart rate", "high")]


def test_partial_match_takes_every_part(spark):
    """Against all pairs of a brand, with keys of 400 and more."""
    from govgraph.plans.scoring_plans import partial_matches

    names = ["red tin cup", "red tin jug", "blue oak box", "blue oak box lid", "one", "two", "red red tin"]
    rows = [(390 + 7 * i, f"b{i % 2}", names[i % len(names)]) for i in range(16)]
    left = []
    for k, b, x in rows:
        for k2, b2, y in rows:
            one, two = set(x.split()), set(y.split())
            if k != k2 and b == b2 and 2 * len(one & two) >= len(one | two):
                left.append((-len(one & two) / len(one | two), b, k, k2))
    used, want = set(), set()
    for _, b, k, k2 in sorted(left):
        if (b, "p", k) not in used and (b, "g", k2) not in used:
            used |= {(b, "p", k), (b, "g", k2)}
            want.add((b, k, k2))
    got = partial_matches(spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string")).collect()
    assert {(r.p_brand, r.pred, r.gold) for r in got} == want and max(k for _, k, _ in want) >= 400


def test_alike_names_against_all_pairs(spark):
    """Names that differ in their last character, at both ends or in the middle, and short ones."""
    from difflib import SequenceMatcher

    from govgraph.plans.text_plans import alike_names

    names = ["supplier 0001", "supplier 0002", "supplier 0011", "xupplier 0001", "supplyer 0001", "abcd", "abxcd", "xabcd", "abcdx", "the long name of a firm", "xhe long name of a firx", "the long nameof a firm", "other"]
    rows = [(i, i // len(names), x) for i, x in enumerate(names * 2)]
    want = {(i, j) for i, m, x in rows for j, n, y in rows if i < j and m == n and round(SequenceMatcher(None, x, y).ratio(), 6) >= 0.9}
    got = alike_names(spark.createDataFrame(rows, "s_suppkey long, s_nationkey long, s_name string")).collect()
    assert {(r.s_suppkey, r.other) for r in got} == want and (0, 1) in want


def test_partial_match_of_copies(spark):
    """Many copies of a name, against all pairs: each takes the smallest free other one."""
    from govgraph.plans.scoring_plans import partial_matches

    names = ["red tin cup", "tin red cup", "red tin", "red", "blue oak", "oak", ""]
    parts = spark.createDataFrame([((i * 37) % 101, f"b{i % 2}", names[(i // 2) % len(names)]) for i in range(90)] + [(500, "b0", None), (501, None, "red"), (502, None, "red")], "p_partkey long, p_brand string, p_name string")
    rows = parts.filter("p_name is not null and p_brand is not null").collect()
    left = []
    for x in rows:
        for y in rows:
            one, two = set(x.p_name.split(" ")), set(y.p_name.split(" "))
            if x.p_partkey != y.p_partkey and x.p_brand == y.p_brand and 2 * len(one & two) >= len(one | two):
                left.append((-len(one & two) / len(one | two), x.p_brand, x.p_partkey, y.p_partkey))
    used, want = set(), set()
    for _, b, p, g in sorted(left):
        if (b, "p", p) not in used and (b, "g", g) not in used:
            used |= {(b, "p", p), (b, "g", g)}
            want.add((b, p, g))
    assert {(r.p_brand, r.pred, r.gold) for r in partial_matches(parts).collect()} == want


def test_partial_match_of_a_large_class(spark):
    """Forty thousand parts of one name: their pairs would be 1.6 billion."""
    from govgraph.plans.scoring_plans import partial_matches

    parts = spark.range(40_000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("red cup").alias("p_name"))
    found = partial_matches(parts)
    assert found.agg(F.count("*"), F.count_distinct("pred"), F.count_distinct("gold"), F.count_if(F.col("pred") == F.col("gold"))).first() == (40_000, 40_000, 40_000, 0)


def test_alike_names_of_many_suppliers(spark):
    """Against all pairs: copies, names of lengths around the bounds, and a count that all pairs would not reach in time."""
    import random
    from difflib import SequenceMatcher

    from govgraph.plans.text_plans import alike_names

    draw = random.Random(3)
    names = []
    for n in (3, 9, 10, 11, 17, 18, 19, 20, 21, 22):
        base = "".join(draw.choice("abc0") for _ in range(n))
        names += [base, base]
        for _ in range(6):
            cut, put = draw.randrange(n), draw.randrange(n)
            names += [base[:cut] + base[cut + 1 :], base[:put] + draw.choice("abcd") + base[put:], base[:cut] + "z" + base[cut + 1 :], (base[:cut] + base[cut + 1 :])[:put] + "y" + (base[:cut] + base[cut + 1 :])[put:]]
    rows = [(i, 1, x) for i, x in enumerate(names)] + [(900, 1, "#"), (901, 1, "?"), (902, 1, None), (903, None, names[0])]
    norm = {i: "".join(c for c in x if c.isalnum()) for i, g, x in rows if x is not None and g is not None}
    want = {(i, j): round(1.0 if norm[i] == norm[j] else SequenceMatcher(None, norm[i], norm[j]).ratio(), 6) for i in norm for j in norm if i < j}
    got = {(r.s_suppkey, r.other): r.ratio for r in alike_names(spark.createDataFrame(rows, "s_suppkey long, s_nationkey long, s_name string")).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.9} and len(got) > 200
    many = spark.range(6000).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), F.format_string("Supplier#%09d", F.col("id") * 7919 % 1000003).alias("s_name"))
    assert alike_names(many).count() > 0
