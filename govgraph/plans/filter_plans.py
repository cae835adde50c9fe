"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import store
from .base import plan


@plan("p1_active", "SELECT seq, subject, relation, object FROM kg_facts WHERE superseded_by IS NULL")
def _(g):
    return store.active(g.facts).select("seq", "subject", "relation", "object")


@plan("p2_by_relation", "SELECT subject, object FROM kg_triples WHERE relation = 'IN_NATION' AND object = 'nation:7'")
def _(g):
    return store.by(g.triples, relation="IN_NATION", object="nation:7").select("subject", "object")


@plan("p3_find_triple", "SELECT subject, relation, object, confidence FROM kg_triples WHERE subject = 'part:11' AND relation = 'HAS_TYPE' AND object LIKE 'type:%'")
def _(g):
    return store.by(g.triples, subject="part:11", relation="HAS_TYPE").filter(F.col("object").startswith("type:")).select(*store.KEY, "confidence")


@plan("p4_confidence_floor", "SELECT subject, relation, object, confidence FROM kg_triples WHERE coalesce(confidence, 0) >= 0.97 AND relation = 'SUPPLIES'")
def _(g):
    return store.confident(store.by(g.triples, relation="SUPPLIES"), 0.97).select(*store.KEY, "confidence")


@plan("p5_audit_page", "SELECT seq, subject, relation FROM kg_facts WHERE relation = 'LAST_ERROR' ORDER BY seq DESC LIMIT 50 OFFSET 20")
def _(g):
    page = g.facts.filter("relation = 'LAST_ERROR'").select("seq", "subject", "relation")
    return page.orderBy(F.desc("seq")).offset(20).limit(50)


@plan("p7_garbage_entities", """AND e AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN cast(c_custkey AS VARCHAR) WHEN 2 THEN 'the results' WHEN 3 THEN 'x' ELSE c_name END AS t,
  CASE WHEN c_custkey % 6 = 4 AND c_custkey % 4 = 0 THEN 'STUDY_DESIGN' ELSE 'Customer' END AS kind FROM customer),
r AS (SELECT CASE WHEN trim(t) = '' THEN 'empty_text' WHEN regexp_full_match(t, '\\d+') AND NOT regexp_full_match(t, '(1[0-9]{3}|20[0-9]{2})') THEN 'numeric_unreferenced'
  WHEN lower(t) IN ('the results', 'our findings', 'this study') THEN 'garbage_phrase' WHEN length(t) < 2 THEN 'too_short' WHEN upper(kind) IN ('STUDY_DESIGN', 'UNRESOLVED') THEN 'garbage_type' ELSE 'kept' END AS reason FROM e)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def _(g):
    k = F.col("c_custkey")
    t = F.when(k % 6 == 0, "").when(k % 6 == 1, k.cast("string")).when(k % 6 == 2, "the results").when(k % 6 == 3, "x").otherwise(F.col("c_name"))
    e = g.table("customer").select(t.alias("t"), F.when((k % 6 == 4) & (k % 4 == 0), "STUDY_DESIGN").otherwise("Customer").alias("kind"))
    return e.select(garbage_reason(F.col("t"), F.col("kind")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


GARBAGE_PHRASES = ("the results", "our findings", "this study")
GARBAGE_TYPES = ("STUDY_DESIGN", "UNRESOLVED")


def garbage_reason(text, kind):
    """Why an entity is dropped, the first reason that applies, or kept; a bare number stays only as a year of four digits."""
    number = text.rlike(r"^\d+\z") & ~text.rlike(r"^(1[0-9]{3}|20[0-9]{2})\z")
    return (
        F.when(F.trim(text) == "", "empty_text").when(number, "numeric_unreferenced").when(F.lower(text).isin(*GARBAGE_PHRASES), "garbage_phrase")
        .when(F.length(text) < 2, "too_short").when(F.upper(kind).isin(*GARBAGE_TYPES), "garbage_type").otherwise("kept")
    )


@plan("p8_triple_hygiene", """AND c AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'user:' || user_id END AS s, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE event_type END AS r, CASE WHEN event_id % 17 = 0 THEN 'user:' || user_id ELSE 'day:' || day(ts) END AS o FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY seq) AS n FROM c)
SELECT CASE WHEN s = '' THEN 'missing_field' WHEN length(r) < 3 THEN 'bad_relation' WHEN s = o THEN 'self_reference' WHEN n > 1 THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS n FROM d GROUP BY 1""")
def _(g):
    from pyspark.sql import Window

    k = F.col("event_id")
    user = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    c = g.table("events").select(
        k.alias("seq"), F.when(k % 11 == 0, "").otherwise(user).alias("s"), F.when(k % 13 == 0, "x").otherwise(F.col("event_type")).alias("r"),
        F.when(k % 17 == 0, user).otherwise(F.concat(F.lit("day:"), F.dayofmonth("ts").cast("string"))).alias("o"),
    )
    again = F.row_number().over(Window.partitionBy("s", "r", "o").orderBy("seq")) > 1
    reason = F.when(F.col("s") == "", "missing_field").when(F.length("r") < 3, "bad_relation").when(F.col("s") == F.col("o"), "self_reference").when(F.col("again"), "duplicate").otherwise("kept")
    return c.withColumn("again", again).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@plan("p9_type_consolidation", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'BASIC' WHEN 'STANDARD' THEN 'BASIC' WHEN 'PROMO' THEN 'OFFER' ELSE p_type END AS kind, CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'PROMO') THEN p_type END AS original_type FROM part", graph=False)
def _(g):
    table = F.create_map(*(F.lit(x) for pair in {"ECONOMY": "BASIC", "STANDARD": "BASIC", "PROMO": "OFFER"}.items() for x in pair))
    to = F.try_element_at(table, F.col("p_type"))
    return g.table("part").select("p_partkey", F.coalesce(to, "p_type").alias("kind"), F.when(to.isNotNull(), F.col("p_type")).alias("original_type"))


@plan("p11_entity_schema", "SELECT id, 'Cust-Omer' AS kind FROM kg_entities WHERE type = 'Customer' UNION ALL SELECT id, 'PART' FROM kg_entities WHERE type = 'Part'")
def _(g):
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    allowed = g.spark.createDataFrame([("Cust-Omer",), ("PART",)], "kind string")
    return g.entities.withColumn("k", plain(F.col("type"))).join(F.broadcast(allowed.withColumn("k", plain(F.col("kind")))), "k").select("id", "kind")


@plan("p13_relation_canonical", "SELECT subject, CASE relation WHEN 'IN_NATION' THEN 'LOCATED_IN' WHEN 'IN_REGION' THEN 'LOCATED_IN' WHEN 'HAS_TYPE' THEN 'HAS_TYPE' END AS relation, object FROM core")
def _(g):
    canonical = F.upper(F.regexp_replace("relation", "[- ]", "_"))
    alias = F.create_map(*(F.lit(x) for pair in {"IN_NATION": "LOCATED_IN", "IN_REGION": "LOCATED_IN"}.items() for x in pair))
    known = F.coalesce(F.try_element_at(alias, canonical), F.when(canonical.isin("HAS_TYPE", "LOCATED_IN"), canonical))
    return g.core.withColumn("relation", known).filter("relation is not null").select(*store.KEY)


@plan("p18_source_support", r"""AND q AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS e FROM benchmark)
SELECT item_id, count(*) AS n_sources, min(doc_id) AS first_source FROM b JOIN q ON contains(t, e) GROUP BY item_id""")
def _(g):
    """Benchmark passages that documents hold, by normalized containment; the passages are few and known in size."""
    docs = g.table("documents").select("doc_id", T.quote(F.col("text")).alias("t"))
    items = g.table("benchmark").select("item_id", T.quote(F.col("text")).alias("e"))
    return docs.join(items, F.contains("t", F.col("e"))).groupBy("item_id").agg(F.count("*").alias("n_sources"), F.min("doc_id").alias("first_source"))


@plan("p20_verification_gate", "SELECT event_id, CASE WHEN value >= 10 THEN 'verified' WHEN value >= 5 THEN 'partial' END AS status FROM events WHERE (value >= 10 OR value >= 5) AND (event_id % 100) / 100.0 >= 0.5", graph=False)
def _(g):
    status = F.when(F.col("value") >= 10, "verified").when(F.col("value") >= 5, "partial")
    return g.table("events").select("event_id", status.alias("status"), (F.col("event_id") % 100 / 100.0).alias("c")).filter("status is not null and c >= 0.5").drop("c")


@plan("p22_confidence_bands", "SELECT CASE WHEN confidence >= 0.97 THEN 'accept' WHEN confidence < 0.93 THEN 'reject' ELSE 'vote' END AS band, count(*) AS n FROM kg_triples GROUP BY 1")
def _(g):
    c = F.col("confidence")
    return g.triples.groupBy(F.when(c >= 0.97, "accept").when(c < 0.93, "reject").otherwise("vote").alias("band")).agg(F.count("*").alias("n"))


@plan("p24_pilot_selection", """AND a AS (SELECT conv_id, turn, text, len(string_split(text, ' ')) AS n, conv_id % 7 = 0 AS yes_no FROM conversations WHERE text IS NOT NULL),
w AS (SELECT *, sum(yes_no::INT) OVER (ORDER BY conv_id, turn) AS seen FROM a WHERE n <= 40) SELECT conv_id, turn, n FROM w WHERE NOT yes_no OR seen <= 10 ORDER BY conv_id, turn LIMIT 50""")
def _(g):
    from pyspark.sql import Window

    a = g.table("conversations").filter("text is not null").select("conv_id", "turn", F.size(F.split("text", " ")).cast("long").alias("n"), (F.col("conv_id") % 7 == 0).alias("yes_no")).filter("n <= 40")
    seen = F.row_number().over(Window.partitionBy("yes_no").orderBy("conv_id", "turn"))
    return a.withColumn("seen", seen).filter("not yes_no or seen <= 10").orderBy("conv_id", "turn").limit(50).select("conv_id", "turn", "n")


@plan("p26_view_filter", """AND deg AS (SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM core UNION ALL SELECT object FROM core) GROUP BY id)
SELECT e.id, degree FROM kg_entities e JOIN deg ON deg.id = e.id WHERE type IN ('Nation', 'Region', 'Customer') ORDER BY degree DESC, e.id LIMIT 150""")
def _(g):
    nodes = g.entities.filter(F.col("type").isin("Nation", "Region", "Customer")).join(store.degree(g.core), "id")
    return nodes.orderBy(F.desc("degree"), "id").limit(150).select("id", "degree")
