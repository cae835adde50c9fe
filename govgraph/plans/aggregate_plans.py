"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from .base import plan


@plan("a1_relation_counts", "SELECT relation, count(*) AS n FROM kg_triples GROUP BY relation")
def _(g):
    return g.triples.groupBy("relation").agg(F.count("*").alias("n"))


@plan("a1_type_counts", "SELECT type, count(*) AS n FROM kg_entities WHERE type <> '' GROUP BY type")
def _(g):
    return g.entities.filter("type <> ''").groupBy("type").agg(F.count("*").alias("n"))


@plan("a3_entity_coverage", "AND own AS (SELECT entity_id, count(DISTINCT domain_id) AS n FROM domain_entities GROUP BY entity_id) SELECT (SELECT count(*) FROM kg_entities) AS entities, count(*) AS owned, count(*) FILTER (n > 1) AS multi_owned FROM own")
def _(g):
    own = g.domain_entities.groupBy("entity_id").agg(F.count_distinct("domain_id").alias("n"))
    owned = own.agg(F.count("*").alias("owned"), F.count_if(F.col("n") > 1).alias("multi_owned"))
    return g.entities.agg(F.count("*").alias("entities")).join(owned)


@plan("a4_memory_card", """AND r AS (SELECT d.domain_id, e.label, row_number() OVER (PARTITION BY d.domain_id ORDER BY e.id) AS n FROM domain_entities d JOIN kg_entities e ON e.id = d.entity_id)
SELECT domain_id, string_agg(label, '; ' ORDER BY n) AS card FROM r WHERE n <= 12 GROUP BY domain_id""")
def _(g):
    from pyspark.sql import Window

    named = g.domain_entities.join(g.entities.select(F.col("id").alias("entity_id"), "label"), "entity_id")
    rank = F.row_number().over(Window.partitionBy("domain_id").orderBy("entity_id"))
    top = named.withColumn("n", rank).filter("n <= 12")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"])
    return top.groupBy("domain_id").agg(F.array_join(ordered, "; ").alias("card"))


@plan("a6_provenance_merge", """AND refs AS (SELECT user_id AS k, event_id AS seq, 'doc' || event_id % 30 AS document_id, event_id % 3 AS char_start, 10 AS char_end, (event_id % 100) / 100.0 AS confidence, event_type AS confidence_source FROM events),
u AS (SELECT k, document_id, char_start, char_end, min(seq) AS seq FROM refs GROUP BY 1, 2, 3, 4) SELECT k, count(*) AS n_refs FROM u GROUP BY k""")
def _(g):
    e = F.col("event_id")
    refs = g.table("events").select(F.col("user_id").alias("k"), e.alias("seq"), F.concat(F.lit("doc"), (e % 30).cast("string")).alias("document_id"), (e % 3).alias("char_start"), F.lit(10).alias("char_end"), (e % 100 / 100.0).alias("confidence"), F.col("event_type").alias("confidence_source"), F.col("props").alias("evidence"))
    return store.merge_provenance(refs, ["k"]).select("k", "n_refs")


@plan("a7_entity_upsert", "SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'error') AS type, max(event_id) AS last_seq, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS labels FROM events GROUP BY user_id", graph=False)
def _(g):
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return g.table("events").groupBy("user_id").agg(F.min_by(kind, F.when(kind.isNotNull(), F.col("event_id"))).alias("type"), F.max("event_id").alias("last_seq"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("labels"))


@plan("a9_dedup_best", "SELECT subject, relation, object, confidence, seq FROM (SELECT *, row_number() OVER (PARTITION BY lower(subject), relation, lower(object) ORDER BY confidence DESC, seq) AS n FROM kg_facts) WHERE n = 1")
def _(g):
    best = store.first_per(g.facts, [F.lower("subject"), "relation", F.lower("object")], F.desc("confidence"), F.col("seq"))
    return best.select(*store.KEY, "confidence", "seq")


@plan("a10_dedup_first", "SELECT subject, relation, object, min(seq) AS seq FROM kg_facts WHERE subject <> object GROUP BY 1, 2, 3")
def _(g):
    return g.facts.filter("subject <> object").groupBy(*store.KEY).agg(F.min("seq").alias("seq"))


@plan("a12_majority_type", """AND c AS (SELECT user_id, upper(event_type) AS t, count(*) AS n, min(event_id) AS first FROM events WHERE event_type NOT IN ('error') GROUP BY 1, 2)
SELECT user_id, arg_max(t, {'n': n, 'f': -first}) AS type FROM c GROUP BY user_id""")
def _(g):
    c = g.table("events").filter("event_type not in ('error')").groupBy("user_id", F.upper("event_type").alias("t")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.max_by("t", F.struct("n", -F.col("first"))).alias("type"))


@plan("a13_consensus", """AND s AS (SELECT subject, relation, object, seq % 5 AS sample, confidence FROM kg_facts), n AS (SELECT count(DISTINCT sample) AS total FROM s)
SELECT subject, relation, object, count(DISTINCT sample) AS support, round((max(confidence) + 0.5 + 0.5 * count(DISTINCT sample) / any_value(total)) / 2, 6) AS confidence FROM s, n GROUP BY 1, 2, 3 HAVING count(DISTINCT sample) >= 2""")
def _(g):
    """Facts that several samples hold; support raises confidence."""
    samples = g.facts.select(*store.KEY, (F.col("seq") % 5).alias("sample"), "confidence")
    total = samples.agg(F.count_distinct("sample").alias("total"))
    per = samples.groupBy(*store.KEY).agg(F.count_distinct("sample").alias("support"), F.max("confidence").alias("base")).filter("support >= 2").join(F.broadcast(total))
    return per.select(*store.KEY, "support", F.round((F.col("base") + 0.5 + 0.5 * F.col("support") / F.col("total")) / 2, 6).alias("confidence"))


@plan("a14_scalar_consensus", """AND c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, {'n': n, 'f': -first}) AS value, round(max(n)::DOUBLE / sum(n), 6) AS confidence FROM c GROUP BY user_id""")
def _(g):
    c = g.table("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("value"), F.round(F.max("n") / F.sum("n"), 6).alias("confidence"))


@plan("a17_relation_funnel", "SELECT l_returnflag, count(*) AS seen, count(*) FILTER (l_discount > 0.05) AS kept, round(count(*) FILTER (l_discount > 0.05)::DOUBLE / count(*), 4) AS ratio FROM lineitem GROUP BY l_returnflag", graph=False)
def _(g):
    kept = F.count_if(F.col("l_discount") > 0.05)
    return g.table("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("seen"), kept.alias("kept"), F.round(kept / F.count("*"), 4).alias("ratio"))


@plan("a18_gold_build", """AND c AS (SELECT lower(p_name) AS e, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT e, arg_max(p_type, {'n': n, 't': p_type}) AS type, sum(n)::BIGINT AS support FROM c GROUP BY e""")
def _(g):
    c = g.table("part").groupBy(F.lower("p_name").alias("e"), "p_type").agg(F.count("*").alias("n"))
    return c.groupBy("e").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("type"), F.sum("n").alias("support"))


@plan("a19_org_overlap", """AND a AS (SELECT p_brand AS d, p_partkey AS e FROM part WHERE p_size > 10), b AS (SELECT p_type AS d, p_partkey AS e FROM part), i AS (SELECT a.d AS x, b.d AS y, count(*) AS n FROM a JOIN b ON a.e = b.e GROUP BY 1, 2),
na AS (SELECT d, count(*) AS n FROM a GROUP BY d), nb AS (SELECT d, count(*) AS n FROM b GROUP BY d), j AS (SELECT x, y, i.n::DOUBLE / (na.n + nb.n - i.n) AS jac FROM i JOIN na ON na.d = x JOIN nb ON nb.d = y)
SELECT x, arg_max(y, {'j': jac, 'y': y}) AS best, round(max(jac), 6) AS jaccard FROM j GROUP BY x""")
def _(g):
    a = g.table("part").filter("p_size > 10").select(F.col("p_brand").alias("x"), F.col("p_partkey").alias("e"))
    b = g.table("part").select(F.col("p_type").alias("y"), F.col("p_partkey").alias("e"))
    common = a.join(b, "e").groupBy("x", "y").agg(F.count("*").alias("n"))
    na, nb = a.groupBy("x").agg(F.count("*").alias("na")), b.groupBy("y").agg(F.count("*").alias("nb"))
    j = common.join(na, "x").join(nb, "y").withColumn("jac", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    return j.groupBy("x").agg(F.max_by("y", F.struct("jac", "y")).alias("best"), F.round(F.max("jac"), 6).alias("jaccard"))


@plan("a20_usage_totals", "SELECT event_type AS model, count(*) AS calls, sum(event_id % 1000)::BIGINT AS prompt_tokens, count(DISTINCT user_id) AS users FROM events GROUP BY event_type", graph=False)
def _(g):
    return g.table("events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 1000).alias("prompt_tokens"), F.count_distinct("user_id").alias("users"))


@plan("a21_session_counters", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY role", graph=False)
def _(g):
    return g.table("conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("sessions"))


@plan("a22_degree", "SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM core UNION ALL SELECT object FROM core) GROUP BY id")
def _(g):
    return store.degree(g.core)


@plan("a24_decision_pivot", "SELECT l_returnflag AS relation, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1", graph=False)
def _(g):
    p = g.table("lineitem").groupBy(F.col("l_returnflag").alias("relation")).pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1)))
    return p.select("relation", F.coalesce("O", F.lit(0)).alias("o"), F.coalesce("F", F.lit(0)).alias("f"))


@plan("a25_run_totals", "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, count(*) FILTER (c_acctbal < 0) AS errors FROM customer GROUP BY 1, 2", graph=False)
def _(g):
    return g.table("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count_if(F.col("c_acctbal") < 0).alias("errors"))


@plan("a26_memory_stats", "SELECT event_type, user_id % 5 AS source, count(*) AS n FROM events GROUP BY ROLLUP (event_type, source)", graph=False)
def _(g):
    return g.table("events").withColumn("source", F.col("user_id") % 5).rollup("event_type", "source").agg(F.count("*").alias("n"))


@plan("a27_entity_context", "SELECT subject, min(document_date) AS first_seen, max(document_date) AS last_seen, count(*) AS mentions, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations FROM kg_facts GROUP BY subject")
def _(g):
    return g.facts.groupBy("subject").agg(F.min("document_date").alias("first_seen"), F.max("document_date").alias("last_seen"), F.count("*").alias("mentions"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"))


@plan("r13_content_hash", "SELECT md5(string_agg(h, '' ORDER BY h)) AS hash, count(*) AS n FROM (SELECT md5(subject || '|' || relation || '|' || object) AS h FROM core)")
def _(g):
    """Hash of the sorted hashes of small shards would be the form for large graphs; the core is small by definition."""
    h = g.core.select(F.md5(F.concat_ws("|", *store.KEY)).alias("h"))
    return h.agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("hash"), F.count("*").alias("n"))
