"""Governance queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators import store
from .base import plan

ROUTED = """AND own AS (SELECT entity_id, list_sort(list(DISTINCT domain_id)) AS owners FROM domain_entities GROUP BY entity_id),
rel AS (SELECT relation, list_sort(list(DISTINCT domain_id)) AS ro FROM domain_relations GROUP BY relation),
met AS (SELECT t.*, coalesce(s.owners, []) AS so, coalesce(o.owners, []) AS oo, coalesce(r.ro, []) AS ro FROM kg_triples t LEFT JOIN own s ON s.entity_id = subject LEFT JOIN own o ON o.entity_id = object LEFT JOIN rel r ON r.relation = t.relation),
pooled AS (SELECT *, CASE WHEN len(so) + len(oo) > 0 THEN list_distinct(list_concat(so, oo)) ELSE ro END AS pool, len(so) > 0 AND len(oo) > 0 AND NOT list_has_any(so, oo) AS apart FROM met),
scored AS (SELECT *, list_transform(pool, lambda d: 3 * list_contains(so, d)::INT + 2 * list_contains(oo, d)::INT + list_contains(ro, d)::INT) AS scores FROM pooled),
topped AS (SELECT *, CASE WHEN apart THEN list_sort(pool) ELSE list_sort(list_filter(pool, lambda d: 3 * list_contains(so, d)::INT + 2 * list_contains(oo, d)::INT + list_contains(ro, d)::INT = list_max(scores))) END AS domain_ids FROM scored),
routed AS (SELECT subject, relation, object, confidence, source, domain_ids, domain_ids[1] AS primary_domain_id, CASE WHEN apart THEN 'cross_domain' WHEN len(pool) = 0 THEN 'unowned' WHEN len(domain_ids) = 1 THEN 'single_owner' ELSE 'cross_domain' END AS assignment_type FROM topped)
"""


def routed(g, triples=None):
    return G.route(g.triples if triples is None else triples, g.domain_entities, g.domain_relations)


@plan("g1_routing", ROUTED + "SELECT subject, relation, object, assignment_type, primary_domain_id, array_to_string(domain_ids, ',') AS domain_ids FROM routed")
def _(g):
    return routed(g).select(*store.KEY, "assignment_type", "primary_domain_id", F.array_join("domain_ids", ",").alias("domain_ids"))


@plan("g1_routing_summary", ROUTED + "SELECT relation, assignment_type, primary_domain_id, count(*) AS n, round(avg(confidence), 4) AS confidence FROM routed GROUP BY 1, 2, 3")
def _(g):
    return routed(g).groupBy("relation", "assignment_type", "primary_domain_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@plan("g2_admission", "SELECT relation, CASE WHEN coalesce(confidence, 0) < 0.95 THEN 'reject' ELSE 'admit' END AS verdict, count(*) AS n FROM kg_triples GROUP BY 1, 2")
def _(g):
    return g.triples.groupBy("relation", F.when(G.admission(F.col("confidence"), 0.95), "admit").otherwise("reject").alias("verdict")).agg(F.count("*").alias("n"))


@plan("g3_conflict_resolution", """AND cand AS (SELECT subject, relation, object, confidence, document_date, seq FROM kg_facts WHERE seq % 4 = 0), old AS (SELECT * FROM kg_facts WHERE superseded_by IS NULL),
c AS (SELECT n.seq AS seq, o.seq AS other, CASE WHEN n.document_date > o.document_date THEN 'supersede' WHEN n.document_date < o.document_date AND o.confidence >= n.confidence THEN 'discard_new' ELSE 'coexist' END AS resolution
  FROM cand n JOIN old o ON n.subject = o.subject AND n.relation = o.relation WHERE n.object <> o.object) SELECT seq, other, resolution FROM c""")
def _(g):
    n, o = g.facts.filter("seq % 4 = 0").alias("n"), store.active(g.facts).alias("o")
    same = n.join(o, (F.col("n.subject") == F.col("o.subject")) & (F.col("n.relation") == F.col("o.relation"))).filter("n.object <> o.object")
    later = F.col("n.document_date") > F.col("o.document_date")
    older = (F.col("n.document_date") < F.col("o.document_date")) & (F.col("o.confidence") >= F.col("n.confidence"))
    return same.select(F.col("n.seq").alias("seq"), F.col("o.seq").alias("other"), F.when(later, "supersede").when(older, "discard_new").otherwise("coexist").alias("resolution"))


@plan("g4_triage", ROUTED + "SELECT CASE WHEN confidence < 0.94 THEN 'low_confidence' WHEN assignment_type IN ('cross_domain', 'unowned') THEN assignment_type WHEN relation = 'HAS_TYPE' THEN 'schema_novel' ELSE 'none' END AS reason, count(*) AS n FROM routed GROUP BY 1")
def _(g):
    reason = G.triage_reason(F.col("confidence"), F.col("assignment_type"), F.col("relation") == "HAS_TYPE", F.lit(False), 0.94)
    return routed(g).groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@plan("g5_propose", ROUTED.rstrip() + """, m AS (SELECT unnest(['audit_only', 'permissive', 'triage', 'strict']) AS mode),
d AS (SELECT mode, CASE WHEN confidence < 0.92 THEN 'reject' WHEN mode = 'audit_only' THEN 'auto_approve' WHEN mode = 'strict' THEN 'escalate' WHEN mode = 'permissive' THEN CASE WHEN assignment_type = 'unowned' THEN 'escalate' ELSE 'auto_approve' END
 ELSE CASE WHEN confidence < 0.7 OR assignment_type IN ('cross_domain', 'unowned') THEN 'escalate' ELSE 'auto_approve' END END AS action FROM routed, m) SELECT mode, action, count(*) AS n FROM d GROUP BY 1, 2""")
def _(g):
    # One pass: the modes' actions side by side, counted together.
    modes = ("audit_only", "permissive", "triage", "strict")
    each = routed(g).groupBy(*(G.action(mode, 0.92).alias(mode) for mode in modes)).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(mode).alias("mode"), F.col(mode).alias("action")) for mode in modes)))
    return each.select("n", pairs.alias("x")).groupBy("x.mode", "x.action").agg(F.sum("n").alias("n"))


@plan("g6_commit", """AND cand AS (SELECT subject, relation, object, max(confidence) AS confidence FROM kg_facts WHERE seq % 2 = 1 AND confidence >= 0.5 GROUP BY 1, 2, 3), base AS (SELECT DISTINCT subject, relation, object FROM kg_facts WHERE seq % 2 = 0)
SELECT c.subject, c.relation, c.object, CASE WHEN b.subject IS NULL THEN 'inserted' ELSE 'present' END AS outcome FROM cand c LEFT JOIN base b ON b.subject = c.subject AND b.relation = c.relation AND b.object = c.object""")
def _(g):
    cand = g.facts.filter("seq % 2 = 1 and confidence >= 0.5").select(*store.KEY).distinct()
    base = g.facts.filter("seq % 2 = 0").select(*store.KEY).distinct().withColumn("known", F.lit(True))
    return cand.join(base, list(store.KEY), "left").select(*store.KEY, F.when(F.col("known"), "present").otherwise("inserted").alias("outcome"))


@plan("g10_domain_assignment", """AND e AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS toks, lower(p_type) AS kind FROM part),
d AS (SELECT * FROM (VALUES ('metal', ['bolt', 'ring', 'widget'], ['economy', 'standard']), ('colour', ['red', 'blue', 'green'], ['promo']), ('size', ['small', 'large', 'medium'], ['small', 'large', 'medium'])) v(domain_id, seeds, kinds)),
s AS (SELECT p_partkey, domain_id, (CASE WHEN list_contains(kinds, kind) THEN 5.0 ELSE 0.0 END) + least(2.5, 0.75 * len(list_intersect(list_distinct(toks), seeds))) AS score FROM e, d),
b AS (SELECT *, max(score) OVER (PARTITION BY p_partkey) AS best FROM s) SELECT p_partkey, domain_id, score::DOUBLE AS score FROM b WHERE score > 0 AND score >= greatest(best - 1.0, 0.7 * best)""")
def _(g):
    domains = g.spark.createDataFrame([("metal", ["bolt", "ring", "widget"], ["economy", "standard"]), ("colour", ["red", "blue", "green"], ["promo"]), ("size", ["small", "large", "medium"], ["small", "large", "medium"])], "domain_id string, seeds array<string>, kinds array<string>")
    e = g.table("part").select("p_partkey", F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("toks"), F.lower("p_type").alias("kind"))
    # Domains are a handful of literal rows here: every entity is scored against each, and a window keeps the best.
    score = F.when(F.array_contains("kinds", F.col("kind")), 5.0).otherwise(0.0) + F.least(F.lit(2.5), 0.75 * F.size(F.array_intersect("toks", "seeds")))
    scored = e.join(F.broadcast(domains)).select("p_partkey", "domain_id", score.cast("double").alias("score"))
    best = F.max("score").over(Window.partitionBy("p_partkey"))
    return scored.withColumn("best", best).filter("score > 0 and score >= greatest(best - 1.0, 0.7 * best)").select("p_partkey", "domain_id", "score")


@plan("g15_relation_schema", "SELECT DISTINCT d.domain_id, t.relation FROM kg_triples t JOIN domain_entities d ON d.entity_id = t.subject UNION SELECT DISTINCT d.domain_id, t.relation FROM kg_triples t JOIN domain_entities d ON d.entity_id = t.object")
def _(g):
    ends = g.triples.select("relation", F.explode(F.array("subject", "object")).alias("entity_id")).groupBy("relation", "entity_id").agg(F.lit(1).alias("one"))
    return ends.join(g.domain_entities, "entity_id").select("domain_id", "relation").distinct()


@plan("g16_rule_replay", ROUTED + "SELECT relation, CASE WHEN confidence >= 0.94 AND (assignment_type = 'single_owner' OR (assignment_type = 'cross_domain' AND len(domain_ids) >= 2)) THEN 'approve' ELSE 'reject' END AS action, count(*) AS n FROM routed GROUP BY 1, 2")
def _(g):
    return G.rule_replay(routed(g), 0.94).groupBy("relation", "action").agg(F.count("*").alias("n"))


_VOTES = """AND votes AS (SELECT user_id % 40 AS hyp, user_id AS voter, event_id AS seq, CASE event_type WHEN 'signup' THEN 'strong_accept' WHEN 'purchase' THEN 'accept' WHEN 'view' THEN 'weak_accept' WHEN 'click' THEN 'abstain' ELSE 'reject' END AS vote,
  (50 + event_id % 50) / 100.0::DOUBLE AS confidence, CASE WHEN user_id % 3 = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS voter_weight FROM events),
last AS (SELECT hyp, voter, max_by(vote, seq) AS vote, max_by(confidence, seq) AS confidence, max_by(voter_weight, seq) AS voter_weight FROM votes GROUP BY hyp, voter),
w AS (SELECT hyp, (CASE vote WHEN 'strong_accept' THEN 1.0 WHEN 'accept' THEN 0.75 WHEN 'weak_accept' THEN 0.5 WHEN 'abstain' THEN 0.0 ELSE -0.75 END)::DOUBLE * least(confidence * voter_weight, 1.0) AS weight FROM last),
summary AS (SELECT hyp, sum(weight) AS total, count(*) AS n_votes, count(*) FILTER (weight > 0) AS support, count(*) FILTER (weight < 0) AS oppose, sum(weight) / count(*) AS mean FROM w GROUP BY hyp)
"""


def votes(g):
    kind = F.col("event_type")
    vote = F.when(kind == "signup", "strong_accept").when(kind == "purchase", "accept").when(kind == "view", "weak_accept").when(kind == "click", "abstain").otherwise("reject")
    return g.table("events").select((F.col("user_id") % 40).alias("hyp"), F.col("user_id").alias("voter"), F.col("event_id").alias("seq"), vote.alias("vote"), ((50 + F.col("event_id") % 50) / 100.0).cast("double").alias("confidence"), F.when(F.col("user_id") % 3 == 0, 1.5).otherwise(1.0).alias("voter_weight"))


@plan("a15_vote_summary", _VOTES + "SELECT hyp, round(total, 6) AS total, n_votes, support, oppose, round(mean, 6) AS mean FROM summary")
def _(g):
    return G.vote_summary(votes(g), "hyp").select("hyp", F.round("total", 6).alias("total"), "n_votes", "support", "oppose", F.round("mean", 6).alias("mean"))


@plan("g17_consensus", _VOTES + "SELECT hyp, CASE WHEN n_votes < 2 THEN 'pending' WHEN mean >= 0.6 THEN 'accept' WHEN mean <= -0.6 THEN 'reject' WHEN abs(mean) < 0.3 THEN 'debate' ELSE 'pending' END AS verdict FROM summary")
def _(g):
    return G.vote_summary(votes(g), "hyp").select("hyp", G.consensus(F.col("mean"), F.col("n_votes")).alias("verdict"))


@plan("g18_forced", _VOTES + "SELECT hyp, mean + 0.1 * (support - oppose) > 0 AS accepted, round(least(0.5 + 0.5 * abs(mean + 0.1 * (support - oppose)), 0.95), 4) AS confidence FROM summary")
def _(g):
    accepted, sure = G.forced(F.col("mean"), F.col("support"), F.col("oppose"), F.col("n_votes"), F.lit(0.5))
    return G.vote_summary(votes(g), "hyp").select("hyp", accepted.alias("accepted"), F.round(sure, 4).alias("confidence"))


@plan("w11_latest_vote", _VOTES + "SELECT hyp, voter, vote FROM last")
def _(g):
    return votes(g).groupBy("hyp", "voter").agg(F.max_by("vote", "seq").alias("vote"))


@plan("d3_multi_domain_promotion", """AND x AS (SELECT t.subject AS entity, b.domain_id AS foreign_domain FROM kg_triples t JOIN domain_entities a ON a.entity_id = t.subject JOIN domain_entities b ON b.entity_id = t.object WHERE a.domain_id <> b.domain_id)
SELECT entity, foreign_domain, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(g):
    a = g.domain_entities.select(F.col("entity_id").alias("subject"), F.col("domain_id").alias("own"))
    b = g.domain_entities.select(F.col("entity_id").alias("object"), F.col("domain_id").alias("foreign_domain"))
    met = g.triples.join(a, "subject").join(b, "object").filter("own <> foreign_domain")
    return met.groupBy(F.col("subject").alias("entity"), "foreign_domain").agg(F.count("*").alias("n")).filter("n >= 2")


@plan("d6_vote_rules", "SELECT relation, CASE WHEN subject IS NULL OR object IS NULL THEN 'reject' WHEN relation IN ('HAS_TYPE', 'IN_NATION') THEN 'accept' WHEN regexp_full_match(relation, '[A-Z][A-Z_]+') THEN 'weak_accept' ELSE 'weak_reject' END AS vote, count(*) AS n FROM kg_triples GROUP BY 1, 2")
def _(g):
    vote = F.when(F.col("subject").isNull() | F.col("object").isNull(), "reject").when(F.col("relation").isin("HAS_TYPE", "IN_NATION"), "accept").when(F.col("relation").rlike("^[A-Z][A-Z_]+$"), "weak_accept").otherwise("weak_reject")
    return g.triples.groupBy("relation", vote.alias("vote")).agg(F.count("*").alias("n"))
