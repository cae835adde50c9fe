"""Further governance, memory, retrieval and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import governance as G
from ..operators import scoring as S
from ..operators import store, traverse, vectors
from .base import plan
from .governance_plans import _VOTES, ROUTED, routed, votes
from .retrieval_plans import query, table


@plan("g9_pending", "AND q AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS idx FROM kg_facts WHERE confidence < 0.1) SELECT seq, idx FROM q WHERE idx NOT IN (0, 3, 5)")
def _(g):
    """The queue without the entries resolved by index; its order is by seq, its size that of the backlog."""
    q = g.facts.filter("confidence < 0.1").select("seq", (F.row_number().over(Window.orderBy("seq")) - 1).alias("idx"))
    done = g.spark.createDataFrame([(0,), (3,), (5,)], "idx int")
    return q.join(F.broadcast(done), "idx", "left_anti").select("seq", "idx")


@plan("g11_bootstrap_domains", "SELECT relation, CASE WHEN relation LIKE 'IN_%' THEN 'place' WHEN relation IN ('SUPPLIES', 'ORDERED') THEN 'trade' ELSE 'kind' END AS bucket, count(*) AS n FROM kg_triples GROUP BY 1, 2")
def _(g):
    hits = F.array(F.struct(F.col("relation").startswith("IN_").cast("int").alias("n"), F.lit("place").alias("b")), F.struct(F.col("relation").isin("SUPPLIES", "ORDERED").cast("int").alias("n"), F.lit("trade").alias("b")))
    best = F.array_max(hits)
    return g.triples.groupBy("relation", F.when(best["n"] > 0, best["b"]).otherwise("kind").alias("bucket")).agg(F.count("*").alias("n"))


@plan("g12_domain_similarity", "AND r AS (SELECT domain_id, list(DISTINCT relation) AS rel FROM domain_relations GROUP BY 1) SELECT a.domain_id AS a, b.domain_id AS b, round(len(list_intersect(a.rel, b.rel))::DOUBLE / len(list_distinct(list_concat(a.rel, b.rel))), 4) AS overlap FROM r a JOIN r b ON a.domain_id < b.domain_id WHERE len(list_intersect(a.rel, b.rel)) > 0")
def _(g):
    """Overlap of relation schemas, by a join on the relations they share: domains without any do not meet."""
    r = g.domain_relations
    size = r.groupBy("domain_id").agg(F.count_distinct("relation").alias("n"))
    a = r.select(F.col("domain_id").alias("a"), "relation")
    b = r.select(F.col("domain_id").alias("b"), "relation")
    met = a.join(b, "relation").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    na, nb = size.select(F.col("domain_id").alias("a"), F.col("n").alias("na")), size.select(F.col("domain_id").alias("b"), F.col("n").alias("nb"))
    return met.join(na, "a").join(nb, "b").select("a", "b", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 4).alias("overlap"))


@plan("g14_single_domain", "SELECT 'all' AS domain_id, count(*) AS entities, count(DISTINCT type) AS types FROM kg_entities")
def _(g):
    return g.entities.agg(F.count("*").alias("entities"), F.count_distinct("type").alias("types")).select(F.lit("all").alias("domain_id"), "entities", "types")


@plan("g19_evidence_votes", "SELECT event_type, CASE WHEN value >= 40 THEN 'strong_accept' WHEN value >= 20 THEN 'accept' WHEN value >= 10 THEN 'weak_accept' WHEN value >= 5 THEN 'abstain' ELSE 'reject' END AS vote, count(*) AS n FROM events GROUP BY 1, 2", graph=False)
def _(g):
    v = F.col("value")
    vote = F.when(v >= 40, "strong_accept").when(v >= 20, "accept").when(v >= 10, "weak_accept").when(v >= 5, "abstain").otherwise("reject")
    return g.table("events").groupBy("event_type", vote.alias("vote")).agg(F.count("*").alias("n"))


@plan("g21_value_nodes", r"SELECT DISTINCT object AS id, 'NUMBER' AS type FROM (SELECT substr(object, 3) AS object FROM kg_facts) WHERE regexp_full_match(object, '\d[\d,.]*') AND NOT regexp_full_match(object, '(1[0-9]{3}|20[0-9]{2})(\s*[-/]?\s*\d{2,4})?')")
def _(g):
    value = F.substring("object", 3, 100)
    return g.facts.select(value.alias("id"), T.value_type(value).alias("type")).filter("type = 'NUMBER'").distinct()


@plan("g22_memory_upsert", "SELECT md5(props) AS id, count(*) AS stored, max(ts) AS last FROM events GROUP BY 1", graph=False)
def _(g):
    return g.table("events").groupBy(F.md5("props").alias("id")).agg(F.count("*").alias("stored"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last"))


@plan("v10_exact_dedup", "SELECT lower(trim(p_name)) AS name, min(p_partkey) AS first, count(*) - 1 AS removed FROM part GROUP BY 1", graph=False)
def _(g):
    return g.table("part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.min("p_partkey").alias("first"), (F.count("*") - 1).alias("removed"))


@plan("v14_entity_linking")
def _(g):
    """Lexical (weight 2) and dense (weight 1) rankings of vectors, fused; the best 12."""
    lexical = vectors.ranked(table(g).filter("label = 1").orderBy("id").limit(20), F.col("id"))
    dense = vectors.ranked(vectors.nearest(table(g), query(g), 20), F.desc("score"), F.col("id"))
    return vectors.fuse([(2.0, lexical), (1.0, dense)]).orderBy(F.desc("score"), "id").limit(12)


@plan("v17_hybrid")
def _(g):
    """Seeds by name, mass by personalized PageRank, triples by lexical score and mass."""
    graph = g.triples
    seeds = g.entities.filter("type = 'Nation' and lower(label) in ('nation_3', 'nation_7')").select("id")
    mass = traverse.pagerank(graph, seeds, rounds=10)
    s, o = mass.select(F.col("id").alias("subject"), F.col("rank").alias("a")), mass.select(F.col("id").alias("object"), F.col("rank").alias("b"))
    return graph.join(s, "subject").join(o, "object").select(*store.KEY, F.round(3 * F.greatest("a", "b") + F.col("confidence"), 4).alias("score")).orderBy(F.desc("score"), *store.KEY).limit(20)


@plan("v26_fallback", ROUTED + "SELECT relation, bool_or(assignment_type = 'unowned') AS fallback FROM routed GROUP BY relation")
def _(g):
    return routed(g).groupBy("relation").agg(F.bool_or(F.col("assignment_type") == "unowned").alias("fallback"))


@plan("e2_entity_strict", "AND g AS (SELECT DISTINCT p_brand AS doc, lower(p_name) AS e FROM part WHERE p_size <= 30), p AS (SELECT DISTINCT p_brand AS doc, lower(p_name) AS e FROM part WHERE p_size > 20) SELECT coalesce(g.doc, p.doc) AS doc, count(*) FILTER (g.e IS NOT NULL AND p.e IS NOT NULL) AS tp, count(*) FILTER (g.e IS NULL) AS fp, count(*) FILTER (p.e IS NULL) AS fn FROM g FULL JOIN p ON g.doc = p.doc AND g.e = p.e GROUP BY 1")
def _(g):
    part = g.table("part").select(F.col("p_brand").alias("doc"), F.lower("p_name").alias("e"), "p_size")
    return S.counts(part.filter("p_size <= 30"), part.filter("p_size > 20"), ["e"], ["doc"])


@plan("e4_triple_match")
def _(g):
    """Predicted against gold triples of each document by greedy one-to-one matching of surface overlap."""
    f = g.facts.filter("seq < 1500").select("subject", "seq", F.split(F.concat_ws(" ", "relation", "object"), "[ _:]").alias("w"))
    pred, gold = f.filter("seq % 2 = 0"), f.filter("seq % 2 = 1")
    pairs = pred.select("subject", F.col("seq").alias("pred"), F.col("w").alias("a")).join(gold.select("subject", F.col("seq").alias("gold"), F.col("w").alias("b")), "subject")
    pairs = pairs.select("subject", "pred", "gold", T.jaccard(F.col("a"), F.col("b")).alias("score")).filter("score >= 0.6")
    return S.greedy_match(pairs, "subject", 0.6).groupBy("subject").agg(F.count("*").alias("tp"))


@plan("e10_judge_coverage", "SELECT user_id, count(DISTINCT event_type) FILTER (value >= 10) AS strict, count(DISTINCT event_type) AS covered FROM events GROUP BY user_id", graph=False)
def _(g):
    kind = F.when(F.col("value") >= 10, F.col("event_type"))
    return g.table("events").groupBy("user_id").agg(F.count_distinct(kind).alias("strict"), F.count_distinct("event_type").alias("covered"))


@plan("e11_flips", "AND gold AS (SELECT DISTINCT subject, relation, object FROM kg_facts WHERE seq % 2 = 0), pred AS (SELECT DISTINCT object AS subject, relation, subject AS object FROM kg_facts WHERE seq % 4 = 0) SELECT g.relation, count(*) AS flips FROM gold g JOIN pred p ON g.subject = p.object AND g.object = p.subject AND g.relation = p.relation GROUP BY 1 ORDER BY flips DESC, relation LIMIT 3")
def _(g):
    gold = g.facts.filter("seq % 2 = 0").select(*store.KEY).distinct()
    turned = g.facts.filter("seq % 4 = 0").select(F.col("object").alias("s"), "relation", F.col("subject").alias("o")).distinct()
    met = turned.select(F.col("o").alias("subject"), "relation", F.col("s").alias("object")).join(gold, list(store.KEY))
    return met.groupBy("relation").agg(F.count("*").alias("flips")).orderBy(F.desc("flips"), "relation").limit(3)


@plan("e12_atomic_support", "SELECT c.subject, c.object, EXISTS (SELECT 1 FROM kg_triples t WHERE t.subject = c.subject AND t.object = c.object AND t.relation = 'SUPPLIES') AS supported FROM (SELECT DISTINCT 'supplier:' || s_suppkey AS subject, 'part:' || (s_suppkey * 3) AS object FROM supplier) c")
def _(g):
    k = F.col("s_suppkey")
    claims = g.table("supplier").select(F.concat(F.lit("supplier:"), k.cast("string")).alias("subject"), F.concat(F.lit("part:"), (k * 3).cast("string")).alias("object")).distinct()
    held = store.by(g.triples, relation="SUPPLIES").select("subject", "object", F.lit(True).alias("hit"))
    return claims.join(held, ["subject", "object"], "left").select("subject", "object", F.coalesce("hit", F.lit(False)).alias("supported"))


@plan("e18_means_by_type", "SELECT event_type, user_id % 3 AS difficulty, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1, 2", graph=False)
def _(g):
    return g.table("events").groupBy("event_type", (F.col("user_id") % 3).alias("difficulty")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@plan("e29_governance_benchmark", ROUTED + "SELECT assignment_type, count(*) AS n, round(avg(CASE WHEN relation = 'HAS_TYPE' AND assignment_type <> 'cross_domain' THEN 1.0 WHEN relation = 'ORDERED' AND assignment_type = 'cross_domain' THEN 1.0 ELSE 0.0 END), 4) AS as_expected FROM routed GROUP BY 1")
def _(g):
    right = ((F.col("relation") == "HAS_TYPE") & (F.col("assignment_type") != "cross_domain")) | ((F.col("relation") == "ORDERED") & (F.col("assignment_type") == "cross_domain"))
    return routed(g).groupBy("assignment_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(right, 1.0).otherwise(0.0)), 4).alias("as_expected"))


@plan("e33_blind_rows")
def _(g):
    """Shared ids with the two systems' order shuffled by hash, and the key."""
    e = g.table("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("x"), F.min_by("event_type", "event_id").alias("y"))
    swap = F.xxhash64("user_id", F.lit(11)).bitwiseAND(1) == 1
    return e.select("user_id", F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), swap.alias("swapped"))


@plan("d4_entity_votes", "SELECT CASE WHEN length(label) < 2 OR length(label) > 100 THEN 'reject' WHEN type = 'Region' THEN 'accept' WHEN regexp_matches(label, '^[A-Z]') THEN 'weak_accept' ELSE 'abstain' END AS vote, count(*) AS n FROM kg_entities GROUP BY 1")
def _(g):
    n = F.length("label")
    vote = F.when((n < 2) | (n > 100), "reject").when(F.col("type") == "Region", "accept").when(F.col("label").rlike("^[A-Z]"), "weak_accept").otherwise("abstain")
    return g.entities.groupBy(vote.alias("vote")).agg(F.count("*").alias("n"))


@plan("d5_endpoint_votes", "SELECT CASE WHEN s.id IS NOT NULL AND o.id IS NOT NULL THEN 'accept' WHEN s.id IS NOT NULL OR o.id IS NOT NULL THEN 'weak_accept' ELSE 'abstain' END AS vote, count(*) AS n FROM core t LEFT JOIN kg_entities s ON s.id = t.subject LEFT JOIN kg_entities o ON o.id = t.object GROUP BY 1")
def _(g):
    s, o = g.entities.select(F.col("id").alias("subject"), F.lit(1).alias("s")), g.entities.select(F.col("id").alias("object"), F.lit(1).alias("o"))
    known = F.coalesce("s", F.lit(0)) + F.coalesce("o", F.lit(0))
    return g.core.join(s, "subject", "left").join(o, "object", "left").groupBy(F.when(known == 2, "accept").when(known == 1, "weak_accept").otherwise("abstain").alias("vote")).agg(F.count("*").alias("n"))


@plan("d7_apply_validations", "SELECT f.seq, coalesce(v.value, f.confidence) AS confidence FROM kg_facts f LEFT JOIN (SELECT event_id, value / 1000 AS value, event_id % 4 <> 0 AS valid FROM events WHERE event_id % 2 = 0) v ON v.event_id = f.seq WHERE coalesce(v.valid, TRUE)")
def _(g):
    v = g.table("events").filter("event_id % 2 = 0").select(F.col("event_id").alias("seq"), (F.col("value") / 1000).alias("new"), (F.col("event_id") % 4 != 0).alias("valid"))
    return g.facts.join(v, "seq", "left").filter(F.coalesce("valid", F.lit(True))).select("seq", F.coalesce("new", "confidence").alias("confidence"))


@plan("d9_claim_provenance", "AND m AS (SELECT subject, relation, object, confidence, row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, object) AS n FROM kg_triples WHERE relation = 'SUPPLIES') SELECT subject, object FROM m WHERE n <= 5")
def _(g):
    n = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("confidence"), "object"))
    return store.by(g.triples, relation="SUPPLIES").withColumn("n", n).filter("n <= 5").select("subject", "object")


@plan("d10_groundedness", "SELECT lang, round(count(*) FILTER (n_chars > 1000)::DOUBLE / greatest(count(*), 1), 4) AS grounded FROM documents GROUP BY lang", graph=False)
def _(g):
    return g.table("documents").groupBy("lang").agg(F.round(F.count_if(F.col("n_chars") > 1000) / F.greatest(F.count("*"), F.lit(1)), 4).alias("grounded"))


@plan("d14_best_answer", "SELECT user_id, arg_max(event_type, {'v': value, 'e': event_id}) AS answer FROM events GROUP BY user_id", graph=False)
def _(g):
    return g.table("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("answer"))


@plan("d21_consulted", "SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, count(DISTINCT role) AS consulted FROM conversations GROUP BY conv_id", graph=False)
def _(g):
    return g.table("conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_distinct("role").alias("consulted"))


@plan("d22_config_deltas", "AND m AS (SELECT event_type AS config, avg(value) AS v FROM events GROUP BY 1) SELECT config, round(v - (SELECT v FROM m WHERE config = 'click'), 4) AS delta FROM m")
def _(g):
    m = g.table("events").groupBy(F.col("event_type").alias("config")).agg(F.avg("value").alias("v"))
    base = m.filter("config = 'click'").select(F.col("v").alias("base"))
    return m.join(F.broadcast(base)).select("config", F.round(F.col("v") - F.col("base"), 4).alias("delta"))


@plan("d24_paragraph_batches", "AND t AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source) SELECT source, (row_number() OVER (ORDER BY first) - 1) // 8 AS batch FROM t")
def _(g):
    t = g.table("documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return t.select("source", F.floor((F.row_number().over(Window.orderBy("first")) - 1) / 8).alias("batch"))


@plan("d35_recent_memory", "SELECT subject, relation, object FROM (SELECT *, row_number() OVER (PARTITION BY relation, confidence >= 0.5 ORDER BY seq DESC) AS n FROM kg_facts) WHERE n <= 5")
def _(g):
    n = F.row_number().over(Window.partitionBy("relation", F.col("confidence") >= 0.5).orderBy(F.desc("seq")))
    return g.facts.withColumn("n", n).filter("n <= 5").select(*store.KEY)


@plan("d37_sampled_text", "AND l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) SELECT doc_id, CASE WHEN len(s) <= 5 THEN len(s) ELSE 4 END AS n FROM l")
def _(g):
    s = F.split("text", "\n")
    n = F.size(s)
    some = F.filter(s, lambda x, i: (n <= 5) | i.isin(0, 1) | (i == F.floor(n / 2)) | (i == n - 1))
    return g.table("documents").select("doc_id", F.size(some).cast("long").alias("n"))


@plan("d39_timeouts", _VOTES + "SELECT hyp, CASE WHEN hyp % 3 = 0 AND abs(mean) < 0.3 THEN 'debate' WHEN hyp % 3 = 0 THEN 'forced' ELSE 'waiting' END AS next FROM summary")
def _(g):
    s = G.vote_summary(votes(g), "hyp")
    old = F.col("hyp") % 3 == 0
    return s.select("hyp", F.when(old & (F.abs("mean") < 0.3), "debate").when(old, "forced").otherwise("waiting").alias("next"))


@plan("d40_acceptance", _VOTES + "SELECT round(avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END), 4) AS rate, count(*) AS n FROM summary")
def _(g):
    return G.vote_summary(votes(g), "hyp").agg(F.round(F.avg(F.when(F.col("mean") > 0, 1.0).otherwise(0.0)), 4).alias("rate"), F.count("*").alias("n"))


@plan("d42_pending_replies", "SELECT a.conv_id, a.turn FROM conversations a WHERE a.role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)", graph=False)
def _(g):
    c = g.table("conversations")
    answered = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.filter("role = 'user'").select("conv_id", "turn").join(answered, ["conv_id", "turn"], "left_anti")


@plan("d44_conflict_text", "SELECT seq, subject || ' ' || relation || ' ' || object || ' (' || source || ')' AS said FROM kg_facts WHERE seq < 500")
def _(g):
    return g.facts.filter("seq < 500").select("seq", F.format_string("%s %s %s (%s)", *store.KEY, "source").alias("said"))


@plan("d46_graph_dump", "SELECT subject, relation, object, superseded_by IS NOT NULL AS superseded, cast(document_date AS DATE) AS day FROM kg_facts")
def _(g):
    return g.facts.select(*store.KEY, F.col("superseded_by").isNotNull().alias("superseded"), F.col("document_date").cast("date").alias("day"))


@plan("d47_api_rows", "SELECT 't' || (row_number() OVER (ORDER BY subject, relation, object) - 1) AS id, subject, object FROM core WHERE relation = 'IN_REGION'")
def _(g):
    page = g.core.filter("relation = 'IN_REGION'")
    n = F.row_number().over(Window.orderBy(*store.KEY)) - 1
    return page.select(F.concat(F.lit("t"), n.cast("string")).alias("id"), "subject", "object")


@plan("d53_best_snapshot", "AND c AS (SELECT event_id % 24 AS snapshot, count(*) AS n FROM events GROUP BY 1) SELECT arg_max(snapshot, {'n': n, 's': -snapshot}) AS snapshot FROM c")
def _(g):
    c = g.table("events").groupBy((F.col("event_id") % 24).alias("snapshot")).agg(F.count("*").alias("n"))
    return c.agg(F.max_by("snapshot", F.struct("n", -F.col("snapshot"))).alias("snapshot"))
