"""Queries that clean names and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..operators.vectors import hashed_trigrams
from .base import plan


def names(g):
    """doc, id, name, type, pos: the parts of each brand as the entities of a document."""
    name = F.concat_ws(" ", "p_name", F.lower("p_type"))
    return g.table("part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("id"), name.alias("name"), F.when(F.col("p_size") % 2 == 0, "unknown").otherwise(F.col("p_type")).alias("type"), F.col("p_partkey").alias("pos"))


@plan("v8_similar_names", """WITH w AS (SELECT p_brand AS doc, p_partkey AS id, p_name || ' ' || lower(p_type) AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS type FROM part),
g AS (SELECT doc, id, gram, count(*) AS n FROM (SELECT doc, id, unnest(list_transform(range(1, length(name) + 3), lambda i: substr('  ' || name || '  ', i, 3))) AS gram FROM w) GROUP BY 1, 2, 3),
z AS (SELECT id, sqrt(sum(n * n)) AS z FROM g GROUP BY 1),
p AS (SELECT a.doc, a.id AS a, b.id AS b, sum(a.n * b.n) AS s FROM g a JOIN g b ON a.doc = b.doc AND a.gram = b.gram AND a.id < b.id GROUP BY 1, 2, 3)
SELECT p.doc, a, b FROM p JOIN z u ON u.id = a JOIN z v ON v.id = b JOIN w x ON x.id = a JOIN w y ON y.id = b WHERE s / u.z / v.z >= 0.88 - 1e-12 AND (x.type = '' OR y.type = '' OR x.type = y.type)""", graph=False)
def _(g):
    return C.alike(names(g), "doc").select("doc", "a", "b")


@plan("v9_semantic_dedup", graph=False)
def _(g):
    """Greedy, so SQL cannot say it: the tests hold it against a plain loop."""
    return C.semantic_duplicates(names(g), "doc")


@plan("v11_guarded_merges", """WITH n AS (SELECT n_regionkey AS doc, count(*) AS n FROM nation GROUP BY 1)
, m AS (SELECT doc, n, CASE WHEN n > 4 THEN 2 WHEN n > 1 THEN 1 ELSE 0 END AS first FROM n), e AS (SELECT *, n - 1 - first AS more, n > 3 AND n - 1 - first <= least(8, greatest(1, n // 2)) AS fits FROM m)
SELECT doc, n - first - CASE WHEN fits THEN more ELSE 0 END AS n_left, first + CASE WHEN fits THEN more ELSE 0 END AS n_merged, CASE WHEN n > 3 AND NOT fits THEN 2 ELSE 1 END AS n_skipped, 0 AS n_blocked FROM e""", graph=False)
def _(g):
    """Nations of a region: the first takes the next two (one, of few), then all that are left if they are not more than
    half of the region; a group without an existing name is skipped."""
    n = g.table("nation").select(F.col("n_regionkey").alias("doc"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.translate("n_name", "0123456789", "abcdefghij").alias("name"), F.lit("Nation").alias("type"), "n_nationkey")
    ids = n.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "id"))).alias("s")).select("doc", F.transform("s", lambda x: x["id"]).alias("s"))
    some = F.slice("s", 2, F.when(F.size("s") > 4, 2).otherwise(1))
    proposals = F.array(F.struct(F.lit(1).alias("at"), F.element_at("s", 1).alias("canonical"), some.alias("merged")), F.struct(F.lit(2).alias("at"), F.lit("nobody").alias("canonical"), F.col("s").alias("merged")), F.struct(F.lit(3).alias("at"), F.element_at("s", 1).alias("canonical"), F.when(F.size("s") > 3, F.col("s")).otherwise(F.array().cast("array<string>")).alias("merged")))
    groups = ids.select("doc", F.explode(proposals).alias("p")).select("doc", "p.*")
    return C.guarded_merges(groups, n.drop("n_nationkey"))


@plan("a16_relation_clusters", """WITH r AS (SELECT p_type || suffix AS relation, count(*) AS n FROM part, (SELECT unnest(['', '_', '__']) AS suffix) WHERE suffix = '' OR (suffix = '_' AND p_size > 10) OR (suffix = '__' AND p_size > 30) GROUP BY 1)
SELECT relation, rtrim(relation, '_') AS canonical FROM r""", graph=False)
def _(g):
    """Types of parts in three spellings; the most frequent spelling of each stands for it."""
    suffix = F.explode(F.array_compact(F.array(F.lit(""), F.when(F.col("p_size") > 10, "_"), F.when(F.col("p_size") > 30, "__")))).alias("suffix")
    named = g.table("part").select("p_type", suffix).groupBy(F.concat("p_type", "suffix").alias("relation")).agg(F.count("*").alias("n"))
    ranked = named.withColumn("pos", F.xxhash64("relation"))
    names = ranked.select(F.lit(0).alias("doc"), F.col("pos").alias("id"), F.regexp_replace("relation", "_+$", "").alias("name"), F.lit("").alias("type"), "pos")
    return C.relation_clusters(ranked, C.alike(names, "doc", C.SAME_RELATION).select("a", "b").union(C.alike(names, "doc", C.SAME_RELATION).select("b", "a")))


@plan("v13_schema_novelty", "SELECT DISTINCT p_type || ' OF' AS relation FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY')", graph=False)
def _(g):
    """A schema that holds two of the types in other spellings: as they are, in canonical form, or near by vector."""
    vector = hashed_trigrams(F.lower("relation")).alias("vector")
    found = g.table("part").select(F.concat("p_type", F.lit(" OF")).alias("relation")).distinct().select("relation", vector)
    known = g.table("region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "PROMO_OF").otherwise("ECONOMY OF").alias("relation")).select("relation", vector)
    return C.novel_relations(found, known).select("relation")


@plan("v28_resolved_names", """SELECT CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ' ' ELSE n_name || ' x' END AS name, 'nation:' || n_nationkey AS id, n_nationkey % 3 + 1 AS tier FROM nation""", graph=False)
def _(g):
    """Names as they are, in other letters, and misspelt: the last by cosine of trigrams."""
    n, own = g.table("nation"), F.col("n_nationkey") % 3
    names = n.select(F.when(own == 0, F.col("n_name")).when(own == 1, F.concat(F.lower("n_name"), F.lit(" "))).otherwise(F.concat("n_name", F.lit(" x"))).alias("name"))
    nations = g.entities.filter("type = 'Nation'")

    def nearest(left):
        both = left.select(F.concat(F.lit("n:"), F.col("name")).alias("id"), "name").unionByName(nations.select("id", F.col("label").alias("name")))
        near = C.alike(both.withColumns({"doc": F.lit(0), "type": F.lit(""), "pos": F.xxhash64("id")}), "doc", C.RESOLVED)
        ends = near.select(F.col("a").alias("x"), F.col("b").alias("y"), "score").unionByName(near.select(F.col("b").alias("x"), F.col("a").alias("y"), "score"))
        return ends.filter("x like 'n:%' and y like 'nation:%'").select(F.substring(F.col("x"), 3, 1000).alias("name"), F.col("y").alias("id"), "score")

    return C.resolve_names(names, nations, nearest)
