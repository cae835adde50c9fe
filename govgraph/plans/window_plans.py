"""Windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .base import plan


@plan("w2_reciprocal_rank", """AND a AS (SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS r FROM customer), b AS (SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) - 1 AS r FROM customer)
SELECT k, round(sum(1.0 / (60 + r + 1)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k""")
def _(g):
    c = g.table("customer")
    ranked = lambda *order: c.select(F.col("c_custkey").alias("k"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*order)) - 1).alias("r"))
    return reciprocal_fusion(ranked(F.desc("c_acctbal"), "c_custkey").unionByName(ranked("c_name", "c_custkey")), 60)


def reciprocal_fusion(rankings, k: int, weight=1.0):
    """k, score: each ranking gives weight / (k + rank + 1)."""
    return rankings.groupBy("k").agg(F.round(F.sum(F.lit(weight) / (k + F.col("r") + 1)), 8).alias("score"))


@plan("w3_min_max", """AND m AS (SELECT c_custkey, c_acctbal AS s, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer WINDOW w AS (PARTITION BY c_mktsegment)) SELECT c_custkey, CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE round((s - lo) / (hi - lo), 6) END AS norm FROM m""")
def _(g):
    w = Window.partitionBy("c_mktsegment")
    lo, hi = F.min("c_acctbal").over(w), F.max("c_acctbal").over(w)
    return g.table("customer").select("c_custkey", F.when(hi - lo < 1e-9, 1.0).otherwise(F.round((F.col("c_acctbal") - lo) / (hi - lo), 6)).alias("norm"))


@plan("w4_segments")
def _(g):
    """Sentence segments of 20 to 80 words with the last sentence repeated, by a fold over the sentences."""
    from ..functions.text import sentences

    words = F.transform(F.filter(sentences(F.col("text")), lambda x: x != ""), lambda x: F.struct(x.alias("s"), F.size(F.split(x, r"\s+")).alias("n")))
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(acc, x):
        full = acc["n"] + x["n"] > 80
        enough = full & (acc["n"] >= 20)
        last = F.slice(acc["open"], -1, 1)
        kept = F.when(enough, F.concat(last, F.array(x["s"]))).otherwise(F.concat(acc["open"], F.array(x["s"])))
        n = F.when(enough, F.size(F.split(F.get(last, 0), r"\s+")) + x["n"]).otherwise(acc["n"] + x["n"])
        return F.struct(F.when(enough, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), kept.alias("open"), n.alias("n"))

    folded = F.aggregate(words, zero, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    segments = g.table("benchmark").select("item_id", F.posexplode(folded).alias("index", "parts"))
    return segments.select("item_id", "index", F.array_join("parts", " ").alias("text"))


@plan("w5_chunks", "SELECT doc_id, i AS index, substr(text, i * 500 + 1, 600) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 100) / 500.0) AS BIGINT)))) AS i FROM documents)", graph=False)
def _(g):
    """Character chunks of 600 that overlap by 100."""
    docs = g.table("documents")
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / 500.0)).cast("long")
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("index")).select("doc_id", "index", F.substring("text", (F.col("index") * 500 + 1).cast("int"), F.lit(600)).alias("chunk"))


@plan("w7_offsets", "AND s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) SELECT doc_id, i - 1 AS index, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, i = 1 AS is_first, i = count(*) OVER (PARTITION BY doc_id) AS is_last FROM s")
def _(g):
    lines = g.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("index", "line"))
    doc = Window.partitionBy("doc_id")
    start = F.coalesce(F.sum(F.length("line") + 1).over(doc.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.select("doc_id", "index", start.alias("char_start"), (F.col("index") == 0).alias("is_first"), (F.col("index") == F.count("*").over(doc) - 1).alias("is_last"))


@plan("w9_last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3", graph=False)
def _(g):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return g.table("conversations").withColumn("n", n).filter("n <= 3").select("conv_id", "turn", "role")


@plan("w10_rank_votes", "AND r AS (SELECT c_nationkey AS d, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank FROM customer QUALIFY rank < 25) SELECT d, sum(greatest(1, 12 - 2 * rank))::BIGINT AS votes FROM r GROUP BY d")
def _(g):
    """Domains of the best 25, weighed by rank: the ordering is a top-k, the window sees 25 rows."""
    top = g.table("customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)
    rank = F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")) - 1
    return top.select(F.col("c_nationkey").alias("d"), F.greatest(F.lit(1), 12 - 2 * rank).alias("v")).groupBy("d").agg(F.sum("v").alias("votes"))


@plan("t2_top_seeds", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 40", graph=False)
def _(g):
    return g.table("part").filter("p_retailprice > 0").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey", "p_retailprice")


@plan("t6_community_facts", "SELECT subject, relation, object FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY coalesce(confidence, 0) DESC, subject, object) AS n FROM kg_triples) WHERE n <= 60")
def _(g):
    n = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "subject", "object"))
    return g.triples.withColumn("n", n).filter("n <= 60").select("subject", "relation", "object")


@plan("t10_memory_retrieve", "SELECT event_id, value FROM events WHERE event_type IN ('view', 'click') ORDER BY value DESC, ts DESC, event_id LIMIT 100", graph=False)
def _(g):
    return g.table("events").filter(F.col("event_type").isin("view", "click")).orderBy(F.desc("value"), F.desc("ts"), "event_id").limit(100).select("event_id", "value")


@plan("t11_messages", "SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY CASE turn % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'normal' ELSE 'urgent' END, conv_id, turn LIMIT 50", graph=False)
def _(g):
    t = F.col("turn") % 4
    priority = F.when(t == 0, "high").when(t == 1, "low").when(t == 2, "normal").otherwise("urgent")
    return g.table("conversations").filter("role = 'user'").orderBy(priority, "conv_id", "turn").limit(50).select("conv_id", "turn")


@plan("t13_hash_sample")
def _(g):
    """A reproducible sample: the 100 smallest hashes of id and seed."""
    return g.table("part").orderBy(F.xxhash64("p_partkey", F.lit(7)), "p_partkey").limit(100).select("p_partkey")


@plan("t14_misses", "SELECT object, count(*) AS n FROM core WHERE object NOT IN (SELECT id FROM kg_entities) GROUP BY object ORDER BY n DESC, object LIMIT 20")
def _(g):
    missed = g.core.join(g.entities.select(F.col("id").alias("object")), "object", "left_anti")
    return missed.groupBy("object").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "object").limit(20)
