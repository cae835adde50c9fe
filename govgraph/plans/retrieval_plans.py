"""Vector search, rank fusion, lexical scores, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import store, vectors
from .base import plan
from .text_plans import TERMS

_TOP = """AND q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), scored AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)
"""


def table(g):
    return g.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query(g, vec_id: int = 0):
    return g.table("embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


@plan("v1_changed")
def _(g):
    """Documents to embed again when every third stored hash is stale."""
    docs = g.table("documents").select(F.col("doc_id").alias("id"), "text")
    stored = docs.select("id", F.sha1(F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("old"))).otherwise(F.col("text"))).alias("text_hash"))
    return vectors.changed(docs, stored).select("id", "text_hash")


@plan("v2_cosine_top_k", _TOP + "SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20")
def _(g):
    return vectors.nearest(table(g), query(g), 20)


@plan("v2_cosine_floor", _TOP + "SELECT id, score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 20) WHERE score >= 0.3")
def _(g):
    return vectors.nearest(table(g), query(g), 20, 0.3)


@plan("v3_remove", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", graph=False)
def _(g):
    gone = g.table("labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return table(g).join(gone, "id", "left_anti").select("id")


@plan("v4_rrf", _TOP.rstrip() + """, q2 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1), s2 AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q2),
a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 30)), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT * FROM s2 ORDER BY score DESC, id LIMIT 30))
SELECT id, round(sum(w / (60 + r + 1)), 8) AS score FROM (SELECT id, r, 1.0::DOUBLE AS w FROM a UNION ALL SELECT id, r, 2.0::DOUBLE FROM b) GROUP BY id""")
def _(g):
    one = vectors.ranked(vectors.nearest(table(g), query(g, 0), 30), F.desc("score"), F.col("id"))
    two = vectors.ranked(vectors.nearest(table(g), query(g, 1), 30), F.desc("score"), F.col("id"))
    return vectors.fuse([(1.0, one), (2.0, two)])


@plan("v5_normalized", "SELECT c_custkey AS id, CASE WHEN max(c_acctbal) OVER w - min(c_acctbal) OVER w < 1e-9 THEN 1.0 ELSE round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) END AS score FROM customer WINDOW w AS (PARTITION BY c_nationkey)", graph=False)
def _(g):
    rows = g.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("collection"), F.col("c_acctbal").alias("score"))
    return vectors.normalized(rows).select("id", F.round("score", 6).alias("score"))


@plan("v6_store_texts", "SELECT 'entity' AS collection, id, label || ' (' || type || ')' AS text FROM kg_entities WHERE type IN ('Nation', 'Region') UNION ALL SELECT 'triple', subject || '|' || relation || '|' || object, subject || ' ' || replace(relation, '_', ' ') || ' ' || object FROM core WHERE relation = 'IN_REGION' UNION ALL SELECT 'domain', domain_id, domain_id || ': ' || kind FROM domains")
def _(g):
    e = g.entities.filter("type in ('Nation', 'Region')").select(F.lit("entity").alias("collection"), "id", F.format_string("%s (%s)", "label", "type").alias("text"))
    t = g.core.filter("relation = 'IN_REGION'").select(F.lit("triple").alias("collection"), T.uid(*map(F.col, store.KEY)).alias("id"), T.verbalize(*map(F.col, store.KEY)).alias("text"))
    d = g.domains.select(F.lit("domain").alias("collection"), F.col("domain_id").alias("id"), F.concat_ws(": ", "domain_id", "kind").alias("text"))
    return e.unionByName(t).unionByName(d)


@plan("v7_dirty", "AND c AS (SELECT * FROM kg_facts WHERE seq % 50 = 0) SELECT DISTINCT id FROM (SELECT subject AS id FROM c UNION ALL SELECT object FROM c)")
def _(g):
    return store.endpoints(g.facts.filter("seq % 50 = 0")).distinct()


@plan("v12_relation_conflicts", """AND v AS (SELECT DISTINCT relation, length(relation) AS len FROM kg_facts), a AS (SELECT DISTINCT subject, relation FROM kg_facts WHERE superseded_by IS NULL)
SELECT x.subject, x.relation AS r1, y.relation AS r2 FROM a x JOIN a y ON x.subject = y.subject AND x.relation < y.relation JOIN v p ON p.relation = x.relation JOIN v q ON q.relation = y.relation WHERE p.len = q.len""")
def _(g):
    a = store.active(g.facts).select("subject", "relation").distinct()
    x, y = a.withColumnRenamed("relation", "r1"), a.withColumnRenamed("relation", "r2")
    return x.join(y, "subject").filter("r1 < r2 and length(r1) = length(r2)")


_QUERY = "which red bolt or small ring is economy"
_QTERMS = TERMS.replace("@@", f"'{_QUERY}'")


@plan("v15_entity_lexical", f"""AND s AS (SELECT 'part:' || p_partkey AS id, lower(p_name) AS name, {TERMS.replace('@@', "p_name")} AS terms FROM part)
SELECT id, (CASE WHEN contains(' ' || '{_QUERY}' || ' ', ' ' || name || ' ') THEN 8 ELSE 0 END) + 2 * len(list_intersect(terms, {_QTERMS})) AS score FROM s WHERE (CASE WHEN contains(' ' || '{_QUERY}' || ' ', ' ' || name || ' ') THEN 8 ELSE 0 END) + 2 * len(list_intersect(terms, {_QTERMS})) > 0""")
def _(g):
    names = g.entities.filter("type = 'Part'")
    query = F.lit(_QUERY)
    whole = F.when(T.contains_words(query, F.lower("label")), 8).otherwise(0)
    score = whole + 2 * F.size(F.array_intersect(T.terms(F.col("label")), T.terms(query)))
    return names.select("id", score.alias("score")).filter("score > 0")


@plan("v16_triple_lexical", f"""AND lab AS (SELECT id, label FROM kg_entities), t AS (SELECT subject, relation, object, confidence, {TERMS.replace('@@', "coalesce(label, '') || ' ' || object")} AS ends, {TERMS.replace('@@', 'relation')} AS rel FROM core LEFT JOIN lab ON lab.id = subject WHERE relation = 'HAS_TYPE')
SELECT subject, relation, object, 3 * len(list_intersect(ends, {_QTERMS})) + 4 * len(list_intersect(rel, {_QTERMS})) + CAST(floor(least(confidence, 1.0) * 2) AS BIGINT) AS score FROM t""")
def _(g):
    wanted = T.terms(F.lit(_QUERY))
    label = g.entities.select(F.col("id").alias("subject"), "label")
    t = g.core.filter("relation = 'HAS_TYPE'").join(label, "subject", "left")
    ends = T.terms(F.concat_ws(" ", "label", "object"))
    score = 3 * F.size(F.array_intersect(ends, wanted)) + 4 * F.size(F.array_intersect(T.terms(F.col("relation")), wanted)) + F.floor(F.least(F.col("confidence"), F.lit(1.0)) * 2)
    return t.select(*store.KEY, score.alias("score"))


@plan("v22_coverage", "AND d AS (SELECT domain_id, count(*) AS n, count(*) FILTER (e.label LIKE '%7%') AS hits FROM domain_entities d JOIN kg_entities e ON e.id = d.entity_id GROUP BY domain_id) SELECT domain_id, n, round(hits::DOUBLE / n, 3) AS entity_coverage, least(1.0, n / 20.0::DOUBLE) AS triple_coverage FROM d")
def _(g):
    met = g.domain_entities.join(g.entities.select(F.col("id").alias("entity_id"), "label"), "entity_id")
    d = met.groupBy("domain_id").agg(F.count("*").alias("n"), F.count_if(F.col("label").contains("7")).alias("hits"))
    return d.select("domain_id", "n", F.round(F.col("hits") / F.col("n"), 3).alias("entity_coverage"), F.least(F.lit(1.0), F.col("n") / 20.0).alias("triple_coverage"))


@plan("v24_topic_routing", "SELECT item_id, contains(lower(text), 'the') AS the, contains(lower(text), 'de') AS de FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", F.lower("text").contains("the").alias("the"), F.lower("text").contains("de").alias("de"))


@plan("v25_ownership_hints", "SELECT e.id, string_agg(d.domain_id, ',' ORDER BY d.domain_id) AS owners FROM kg_entities e JOIN domain_entities d ON d.entity_id = e.id WHERE e.type IN ('Supplier', 'Nation') GROUP BY e.id")
def _(g):
    named = g.entities.filter("type in ('Supplier', 'Nation')").join(g.domain_entities, F.col("id") == F.col("entity_id"))
    return named.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("domain_id")), ",").alias("owners"))


@plan("v27_materialize")
def _(g):
    """The unprocessed chunks nearest to a query, at most six, in document order."""
    processed = table(g).filter("id % 7 = 0").select("id")
    near = vectors.nearest(table(g), query(g), 8).join(processed, "id", "left_anti")
    return near.orderBy(F.desc("score"), "id").limit(6).withColumn("place", F.row_number().over(Window.orderBy("id")))


@plan("x1_hashed_embedding")
def _(g):
    """The deterministic embedding used where no model is plugged in."""
    e = g.entities.filter("type = 'Part'").select("id", vectors.hashed_trigrams(F.col("label")).alias("vector"))
    return e.select("id", F.size("vector").alias("dims"), F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))
