"""Queries that lead from questions to facts.  Questions are rendered from nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answering as R
from ..operators.store import KEY
from .base import plan



def asked(g):
    """key, text: a question on each nation."""
    return g.table("nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("Who lives in "), "n_name", F.lit("?")).alias("text"))


@plan("d11_relevant_evidence", """AND s AS (SELECT id FROM kg_entities WHERE id IN ('region:0', 'nation:' || (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 0))),
e AS (SELECT DISTINCT * FROM (SELECT subject AS a, object AS b FROM kg_triples UNION ALL SELECT object, subject FROM kg_triples)),
one AS (SELECT id FROM s UNION SELECT b FROM e JOIN s ON a = id), two AS (SELECT id FROM one UNION SELECT b FROM e JOIN one ON a = id)
SELECT DISTINCT subject, relation, object FROM kg_triples WHERE subject IN (SELECT id FROM two) OR object IN (SELECT id FROM two) ORDER BY subject, relation, object LIMIT 80""")
def _(g):
    n = g.table("nation").filter("n_regionkey = 0").agg(F.min(F.struct("n_nationkey", "n_name")).alias("n"))
    r = g.table("region").filter("r_regionkey = 0")
    text = n.join(F.broadcast(r)).select(F.lit(0).alias("key"), F.concat(F.lit("Is "), F.col("n.n_name"), F.lit(" part of "), "r_name", F.lit("?")).alias("text"))
    return R.relevant_evidence(text, g.entities, g.triples)


@plan("d12_fuzzy_names", """SELECT 's' || s_suppkey AS name, s_name AS label FROM supplier""", graph=False)
def _(g):
    """Names without their marks, and names with words around them, find their suppliers."""
    s = g.table("supplier")
    entities = s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("label"))
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    asked_ = s.select(key.alias("own"), F.when(F.col("s_suppkey") % 2 == 0, F.lower(F.replace("s_name", F.lit("#"), F.lit(" - ")))).otherwise(F.concat(F.lit("old "), "s_name", F.lit(" of old"))).alias("name"))
    found = R.fuzzy_resolved(asked_.select("name"), entities)
    return found.join(asked_, "name").join(entities, "id").select(F.col("own").alias("name"), "label")


@plan("d13_exploration", """AND t AS (SELECT 'region:' || r_regionkey AS key, 'nation:' || n_nationkey AS id, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS r FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0),
f AS (SELECT key, id, subject, relation, object, row_number() OVER (PARTITION BY key, id ORDER BY subject, relation, object) AS k FROM t JOIN kg_triples ON subject = id OR object = id WHERE r <= 2)
SELECT key, id, subject, relation, object FROM f WHERE k <= 20""")
def _(g):
    """The first two nations of each region that are not explored yet, 20 triples of each."""
    n = g.table("nation").select(F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("key"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("pos"))
    return R.explored(n, n.filter("pos % 4 = 0").select("id"), g.triples)


@plan("d50_bridge_context", """AND b AS (SELECT 'region:' || n_regionkey AS id, n_nationkey AS key FROM nation),
f AS (SELECT key, id, subject, relation, object, row_number() OVER (PARTITION BY key, id ORDER BY subject, relation, object) AS k FROM b JOIN kg_triples ON subject = id OR object = id)
SELECT key, id, subject, relation, object FROM f WHERE k <= 15""")
def _(g):
    bridges = g.table("nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("id"))
    return R.around(bridges, g.triples)


@plan("r12_pairwise_paths", """AND e AS (SELECT subject AS a, object AS b FROM core WHERE relation = 'IN_REGION' UNION ALL SELECT object, subject FROM core WHERE relation = 'IN_REGION'),
m AS (SELECT 'nation:' || n_nationkey AS id FROM nation)
SELECT x.id AS a, y.id AS b, e.b AS via FROM m x JOIN e ON e.a = x.id JOIN e f ON f.a = e.b JOIN m y ON y.id = f.b WHERE x.id < y.id""")
def _(g):
    """Paths of two steps between any two nations: by their region, as no customer or supplier has two nations."""
    nations = g.table("nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    found = R.pairwise_context(nations, g.core)
    return found.select("a", "b", F.element_at("nodes", 2).alias("via"))


@plan("d15_coverage", """AND m AS (SELECT id, lower(replace(label, '_', ' ')) AS name FROM kg_entities WHERE type IN ('Nation', 'Region')),
q AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'who?' ELSE 'where is ' || lower(replace(n_name, '_', ' ')) || ' ?' END AS q, 'it lies in ' || lower(replace(r_name, '_', ' ')) AS a FROM nation JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT key, id FROM q JOIN m ON contains(q.q, name)), s AS (SELECT key, id FROM q JOIN m ON contains(q.a, name)),
t AS (SELECT DISTINCT key, subject, relation, object FROM n JOIN kg_triples ON subject = id OR object = id),
c AS (SELECT t.key, avg(CASE WHEN x.id IS NULL AND y.id IS NULL THEN 0.0 ELSE 1.0 END) AS c FROM t LEFT JOIN s x ON x.key = t.key AND x.id = t.subject LEFT JOIN s y ON y.key = t.key AND y.id = t.object GROUP BY t.key)
SELECT key, round(coalesce(c, 0.5), 6)::DOUBLE AS coverage FROM q LEFT JOIN c USING (key)""")
def _(g):
    """Answers name the region, and every fifth question names nothing.  A name inside a longer one is named as well."""
    n = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    q = n.select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 5 == 0, "Who?").otherwise(F.concat(F.lit("Where is "), "n_name", F.lit(" ?"))).alias("text"))
    a = n.select(F.col("n_nationkey").alias("key"), F.concat(F.lit("It lies in "), "r_name").alias("text"))
    found = R.coverage(q, a, g.entities.filter("type in ('Nation', 'Region')"), g.triples)
    return found.select("key", F.round("coverage", 6).alias("coverage"))


@plan("d16_path_baseline", """SELECT 'ring' AS part, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY id ORDER BY subject, relation, object) AS k FROM (SELECT DISTINCT id, subject, relation, object FROM (SELECT 'nation:' || n_nationkey AS id FROM nation ORDER BY n_nationkey LIMIT 4) JOIN kg_triples ON subject = id OR object = id)) WHERE k <= 20
UNION ALL SELECT 'paths', count(*) FROM (SELECT * FROM (SELECT 'nation:' || n_nationkey AS id, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 4) a JOIN (SELECT 'nation:' || n_nationkey AS id, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 4) b ON a.id < b.id AND a.n_regionkey = b.n_regionkey LIMIT 8)""")
def _(g):
    """What a path-focused answer reads: 20 triples around each of the first four entities and the paths between them, 8 at most."""
    four = g.table("nation").orderBy("n_nationkey").limit(4).select(F.lit(0).alias("key"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    ring = R.around(four, g.triples, 20).agg(F.count("*").alias("n")).select(F.lit("ring").alias("part"), "n")
    paths = R.pairwise_context(four.select("id"), g.core).orderBy("hops", "nodes").limit(8).agg(F.count("*").alias("n"))
    return ring.unionByName(paths.select(F.lit("paths").alias("part"), "n"))


@plan("d17_oracle_routing", """WITH e AS (SELECT c_custkey AS key, p_brand, min(l_orderkey * 10 + l_linenumber) AS pos FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 10 GROUP BY 1, 2),
r AS (SELECT key, 'D:brand:' || p_brand AS domain_id, row_number() OVER (PARTITION BY key ORDER BY pos, p_brand) AS r FROM e) SELECT key, domain_id FROM r WHERE r <= 4""", graph=False)
def _(g):
    """The domains that a question is expected to need, known ones, four at most."""
    lines = g.table("lineitem").join(g.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(g.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    expected = lines.select(F.col("o_custkey").alias("key"), F.concat(F.lit("D:brand:"), "p_brand").alias("domain_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "p_size").filter("p_size > 10").drop("p_size")
    return R.target_domains(expected, g.domains).select("key", "domain_id")


@plan("d51_target_domains", """SELECT n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'D:region:' || n_regionkey ELSE (SELECT min('D:region:' || r_regionkey) FROM region) END AS domain_id FROM nation""", graph=False)
def _(g):
    """Unknown domains go; a question left without one gets the first."""
    own = F.col("n_nationkey")
    wanted = g.table("nation").select(own.alias("key"), F.explode(F.array(F.struct(F.lit("nowhere").alias("d"), F.lit(0).alias("pos")), F.struct(F.when(own % 2 == 0, F.concat(F.lit("D:region:"), F.col("n_regionkey").cast("string"))).otherwise("elsewhere").alias("d"), F.lit(1).alias("pos")))).alias("x"))
    return R.target_domains(wanted.select("key", F.col("x.d").alias("domain_id"), "x.pos"), g.domains.filter("kind = 'region'")).select("key", "domain_id")


@plan("v18_chunk_mode", "SELECT item_id AS id, 0.5::DOUBLE AS score FROM benchmark ORDER BY item_id LIMIT 5", graph=False)
def _(g):
    """No dense hit: the lexical order."""
    lexical = g.table("benchmark").select(F.col("item_id").alias("id"), F.lit(0.5).alias("score"))
    return R.chunk_mode(lexical.filter("score > 1"), lexical, 5)


@plan("v19_graph_completion", """AND s AS (SELECT 'nation:' || n_nationkey AS id, (max(n_nationkey) OVER () - n_nationkey) * 1.0 / (max(n_nationkey) OVER () - min(n_nationkey) OVER ()) AS score FROM nation),
t AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 10), e AS (SELECT subject AS a, object AS b FROM core UNION SELECT object, subject FROM core), n AS (SELECT id FROM t UNION SELECT b FROM e JOIN t ON a = id),
k AS (SELECT DISTINCT subject, relation, object FROM core WHERE subject IN (SELECT id FROM n) OR object IN (SELECT id FROM n))
SELECT subject, relation, object, round(greatest(coalesce(x.score, 0), coalesce(y.score, 0)), 6)::DOUBLE AS score FROM k LEFT JOIN s x ON x.id = subject LEFT JOIN s y ON y.id = object ORDER BY score DESC, subject, relation, object LIMIT 20""")
def _(g):
    scored = g.table("nation").select(F.lit("entity").alias("collection"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), (-F.col("n_nationkey")).cast("double").alias("score"))
    return R.graph_completion(scored, g.core)


@plan("v20_graph_summary", "AND f AS (SELECT relation, count(*) AS n FROM core GROUP BY relation) SELECT relation, n FROM f")
def _(g):
    """More facts than a prompt takes are compressed: here to their number by relation."""
    return R.graph_summary(g.core.select(*KEY), lambda facts: facts.groupBy("relation").agg(F.count("*").alias("n")))


@plan("v21_modes", "SELECT p_type, CASE p_type WHEN 'PROMO' THEN 'chunk' WHEN 'ECONOMY' THEN 'graph_summary' ELSE 'hybrid' END AS mode FROM part GROUP BY p_type", graph=False)
def _(g):
    """Each type of part asks by a mode; what is none is hybrid."""
    wanted = F.when(F.col("p_type") == "PROMO", "chunk").when(F.col("p_type") == "ECONOMY", "graph_summary").otherwise(F.lower("p_type"))
    known = F.array(*map(F.lit, R.MODES))
    return g.table("part").select("p_type").distinct().select("p_type", F.when(F.array_contains(known, wanted), wanted).otherwise(R.mode("unknown")).alias("mode"))


@plan("v23_community_context", """WITH c AS (SELECT p_type, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS summary FROM part GROUP BY 1),
s AS (SELECT *, len(list_filter(['small', 'bolt', 'promo'], lambda w: contains(lower(p_type || ' ' || summary), w))) AS n FROM c) SELECT p_type AS community_id, '[' || p_type || '] ' || summary AS line FROM s WHERE n > 0 ORDER BY n DESC, p_type DESC LIMIT 3""", graph=False)
def _(g):
    c = g.table("part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ", ").alias("summary"))
    return R.community_context(c.select(F.col("p_type").alias("community_id"), F.col("p_type").alias("title"), "summary"), "small bolt or PROMO")


@plan("t3_focused_triples", """AND q AS (SELECT DISTINCT p_type AS key FROM part), f AS (SELECT key, subject, relation, object, row_number() OVER (PARTITION BY key ORDER BY 2 + CAST(object = 'type:' || key AS INTEGER) DESC, subject, relation, object) AS r FROM q, core WHERE relation = 'HAS_TYPE')
SELECT key, subject, relation, object FROM f WHERE r <= 50""")
def _(g):
    """The 50 facts that share most words with a question on each type of part."""
    q = g.table("part").select(F.col("p_type").alias("key"), F.concat(F.lit("Which part has the type "), "p_type").alias("text")).distinct()
    return R.focused(q, g.core).select("key", *KEY)


@plan("d20_verdicts", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END AS tier, CASE WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'supported' WHEN l_returnflag = 'R' THEN 'contradicted' ELSE 'unverifiable' END AS verdict FROM lineitem""", graph=False)
def _(g):
    tier = lambda c, v: F.when(F.col(c) == v, "supported").otherwise("unverifiable")
    last = F.when(F.col("l_returnflag") == "R", "contradicted")
    return g.table("lineitem").select("l_orderkey", "l_linenumber", R.verdict(tier("l_returnflag", "A"), tier("l_linestatus", "F"), last).alias("v")).select("l_orderkey", "l_linenumber", "v.tier", "v.verdict")


@plan("d52_enrichment_triage", """AND x AS (SELECT seq, CASE WHEN confidence < 0.5 THEN 'low_confidence' WHEN relation NOT IN ('LAST_VIEW', 'LAST_CLICK') THEN 'schema_novel' END AS reason FROM kg_facts) SELECT seq, reason FROM x WHERE reason IS NOT NULL""")
def _(g):
    """Why an added fact goes to review: confidence, then assignment, then a relation outside the schema; separators do not matter."""
    schema = F.array(F.lit("last view"), F.lit("LAST-CLICK"))
    outside = ~F.array_contains(F.transform(schema, lambda r: F.regexp_replace(F.upper(r), "[- ]", "_")), F.regexp_replace(F.upper("relation"), "[- ]", "_"))
    return g.facts.select("seq", F.when(F.coalesce("confidence", F.lit(0.0)) < 0.5, "low_confidence").when(outside, "schema_novel").alias("reason")).filter("reason is not null")
