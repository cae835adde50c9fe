"""Further filters, joins, functions and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import store
from .base import plan
from .governance_plans import ROUTED, routed


@plan("p6_history_by_domain", ROUTED + "SELECT subject, relation, object FROM routed WHERE primary_domain_id = 'D:region:1' OR list_contains(domain_ids, 'D:region:1')")
def _(g):
    mine = (F.col("primary_domain_id") == "D:region:1") | F.array_contains("domain_ids", "D:region:1")
    return routed(g).filter(mine).select(*store.KEY)


@plan("p12_relation_schema", "SELECT t.relation, CASE WHEN t.relation IN ('IN_REGION', 'HAS_TYPE') THEN 'exact' WHEN replace(lower(t.relation), '_', '') IN ('innation') THEN 'canonical' ELSE 'open' END AS tier, count(*) AS n FROM kg_triples t GROUP BY 1, 2")
def _(g):
    """Exact names, then canonical forms, then the open world, by two joins with the few allowed names."""
    allowed = g.spark.createDataFrame([("IN_REGION",), ("HAS_TYPE",), ("In Nation",)], "name string")
    plain = lambda c: F.regexp_replace(F.lower(c), "[ _-]", "")
    exact = allowed.select(F.col("name").alias("relation"), F.lit("exact").alias("exact"))
    canonical = allowed.select(plain(F.col("name")).alias("form"), F.lit("canonical").alias("canonical"))
    names = g.triples.groupBy("relation").agg(F.count("*").alias("n")).withColumn("form", plain(F.col("relation")))
    return names.join(exact, "relation", "left").join(canonical, "form", "left").select("relation", F.coalesce("exact", "canonical", F.lit("open")).alias("tier"), "n")


@plan("p15_degenerate_relink", "SELECT p_partkey, trim(p_name) = '' OR lower(p_name) = lower(p_type) OR p_size % 10 = 0 AS degenerate FROM part", graph=False)
def _(g):
    """The relink variant counts a blank end as degenerate."""
    name = F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_name"))
    return g.table("part").select("p_partkey", T.degenerate_pair(name, F.col("p_type"), F.lit(""), blank=True).alias("degenerate"))


@plan("p17_cooccurrence", "SELECT doc_id, instr(text, 'the') AS a, instr(text, 'and') AS b, instr(text, 'the') > 0 AND instr(text, 'and') > 0 AND abs(instr(text, 'the') - instr(text, 'and')) > 40 AS dropped FROM documents", graph=False)
def _(g):
    a, b = F.instr("text", "the"), F.instr("text", "and")
    return g.table("documents").select("doc_id", a.cast("long").alias("a"), b.cast("long").alias("b"), ((a > 0) & (b > 0) & (F.abs(a - b) > 40)).alias("dropped"))


@plan("p21_quote_grounding", "SELECT d.doc_id, length(substr(text, 5, d.doc_id::INT % 25)) >= 10 AND contains(text, substr(text, 5, d.doc_id::INT % 25)) AS grounded FROM documents d", graph=False)
def _(g):
    quote = F.substring("text", F.lit(5), (F.col("doc_id") % 25).cast("int"))
    return g.table("documents").select("doc_id", ((F.length(quote) >= 10) & F.contains("text", quote)).alias("grounded"))


@plan("p23_good_triples", "SELECT t.subject, t.relation, t.object FROM core t WHERE length(relation) >= 3 AND subject IN (SELECT id FROM kg_entities WHERE length(label) >= 3 AND NOT regexp_full_match(label, '\\d+') AND type <> 'Region') AND object IN (SELECT id FROM kg_entities WHERE length(label) >= 3)")
def _(g):
    good = g.entities.filter(r"length(label) >= 3")
    s = good.filter(~F.col("label").rlike(r"^\d+$") & (F.col("type") != "Region")).select(F.col("id").alias("subject"))
    o = good.select(F.col("id").alias("object"))
    return g.core.filter("length(relation) >= 3").join(s, "subject", "left_semi").join(o, "object", "left_semi").select(*store.KEY)


@plan("j10_sentence_pairs", """AND s AS (SELECT item_id, unnest(string_split(text, '.')) AS sentence FROM benchmark), w AS (SELECT DISTINCT item_id, sentence, unnest(list_filter(string_split(trim(sentence), ' '), lambda x: length(x) >= 9)) AS word FROM s),
p AS (SELECT a.item_id, a.sentence, a.word AS a, b.word AS b, row_number() OVER (PARTITION BY a.item_id, a.sentence ORDER BY a.word, b.word) AS n FROM w a JOIN w b ON a.item_id = b.item_id AND a.sentence = b.sentence AND a.word < b.word) SELECT item_id, a, b FROM p WHERE n <= 18""")
def _(g):
    """Pairs of long words in a sentence, at most 18 of each sentence; a sentence bounds its own pairs."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.trim("sentence"), " "), lambda x: F.length(x) >= 9)))
    s = g.table("benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", r"\."))).alias("sentence")).withColumn("w", words)
    pairs = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return s.filter("size(w) > 1").select("item_id", F.explode(F.slice(pairs, 1, 18)).alias("p")).select("item_id", "p.a", "p.b")


@plan("j15_first_host", "SELECT o.p_partkey AS orphan, min(h.p_partkey) AS host FROM part o JOIN part h ON o.p_brand = h.p_brand AND o.p_type = h.p_type WHERE o.p_size > 45 AND h.p_size <= 45 GROUP BY 1", graph=False)
def _(g):
    part = g.table("part")
    host = part.filter("p_size <= 45").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("host"))
    return part.filter("p_size > 45").join(host, ["p_brand", "p_type"]).select(F.col("p_partkey").alias("orphan"), "host")


@plan("j17_bridges", """AND a AS (SELECT 'nation_3 supplier of region_1 nation_12 nation_15' AS answer, 'where is nation_3' AS question)
SELECT id FROM kg_entities, a WHERE type IN ('Nation', 'Region') AND regexp_matches(answer, '\\b' || lower(label) || '\\b') AND NOT regexp_matches(question, '\\b' || lower(label) || '\\b') ORDER BY id LIMIT 4""")
def _(g):
    word = F.concat(F.lit(r"\b"), F.lower("label"), F.lit(r"\b"))
    said = lambda text: F.rlike(F.lit(text), word)
    named = g.entities.filter("type in ('Nation', 'Region')")
    return named.filter(said("nation_3 supplier of region_1 nation_12 nation_15") & ~said("where is nation_3")).orderBy("id").limit(4).select("id")


@plan("j21_gold_mapping", "AND c AS (SELECT row_number() OVER (ORDER BY p_type) - 1 AS cluster, lower(p_type) AS mention FROM (SELECT DISTINCT p_type FROM part)), p AS (SELECT p_partkey, lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' goods' END AS name FROM part) SELECT p_partkey, min(cluster) AS cluster FROM p JOIN c ON name = mention OR (length(mention) >= 4 AND contains(name, mention)) GROUP BY p_partkey")
def _(g):
    """Exact mentions by an equi-join; only what that leaves is searched for containment in the few mentions."""
    kinds = g.table("part").select(F.lower("p_type").alias("mention")).distinct()
    c = kinds.select("mention", (F.row_number().over(Window.orderBy("mention")) - 1).alias("cluster"))
    name = F.concat(F.lower("p_type"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" goods"))
    p = g.table("part").select("p_partkey", name.alias("name"))
    exact = p.join(c, F.col("name") == F.col("mention")).select("p_partkey", "cluster")
    rest = p.join(exact, "p_partkey", "left_anti").join(F.broadcast(c), (F.length("mention") >= 4) & F.contains("name", F.col("mention")))
    return exact.unionByName(rest.groupBy("p_partkey").agg(F.min("cluster").alias("cluster")))


@plan("a2_governed_stats", ROUTED + "SELECT assignment_type, unnest(CASE WHEN len(domain_ids) = 0 THEN ['none'] ELSE domain_ids END) AS domain_id, count(*) AS n FROM routed GROUP BY 1, 2")
def _(g):
    ids = F.when(F.size("domain_ids") == 0, F.array(F.lit("none"))).otherwise(F.col("domain_ids"))
    return routed(g).select("assignment_type", F.explode(ids).alias("domain_id")).groupBy("assignment_type", "domain_id").agg(F.count("*").alias("n"))


@plan("a5_domain_summary", "AND t AS (SELECT d.domain_id, e.type, count(*) AS n FROM domain_entities d JOIN kg_entities e ON e.id = d.entity_id GROUP BY 1, 2) SELECT domain_id, string_agg(type || ':' || n, ',' ORDER BY n DESC, type) AS types FROM t GROUP BY domain_id")
def _(g):
    t = g.domain_entities.join(g.entities.select(F.col("id").alias("entity_id"), "type"), "entity_id").groupBy("domain_id", "type").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "type", "n")))
    return t.groupBy("domain_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string"))), ",").alias("types"))


@plan("a8_coref_merge", "SELECT user_id, max(value) AS confidence, bool_or(event_type = 'signup') AS is_known, count(DISTINCT props) AS mentions FROM events GROUP BY user_id", graph=False)
def _(g):
    return g.table("events").groupBy("user_id").agg(F.max("value").alias("confidence"), F.bool_or(F.col("event_type") == "signup").alias("is_known"), F.count_distinct("props").alias("mentions"))


@plan("a11_seed_merge", "AND base AS (SELECT DISTINCT subject, relation, object FROM kg_facts WHERE seq % 2 = 0), seed AS (SELECT DISTINCT subject, relation, object FROM kg_facts WHERE seq % 2 = 1) SELECT * FROM seed EXCEPT SELECT * FROM base")
def _(g):
    half = lambda r: g.facts.filter(F.col("seq") % 2 == r).select(*store.KEY).distinct()
    return half(1).join(half(0), list(store.KEY), "left_anti")


@plan("w6_lazy_chunks", "SELECT item_id, i AS index, i * 80 AS char_start, least(length(text), i * 80 + 100) AS char_end FROM (SELECT item_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 20) / 80.0)) AS BIGINT))) AS i FROM benchmark)", graph=False)
def _(g):
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 20) / 80.0)).cast("long")
    c = g.table("benchmark").select("item_id", F.length("text").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("index"))
    return c.select("item_id", "index", (F.col("index") * 80).alias("char_start"), F.least(F.col("n"), F.col("index") * 80 + 100).alias("char_end"))


@plan("t7_lexical_documents", "AND q AS (SELECT ['the', 'of', 'and', 'for'] AS q), s AS (SELECT doc_id, len(list_intersect(list_distinct(string_split(lower(text), ' ')), q)) AS score, source FROM documents, q) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 4")
def _(g):
    wanted = F.array(*map(F.lit, ("the", "of", "and", "for")))
    score = F.size(F.array_intersect(F.array_distinct(F.split(F.lower("text"), " ")), wanted)).cast("long")
    return g.table("documents").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(4)


@plan("t12_blackboard", "SELECT conv_id, max(turn) AS last, count(*) AS responses FROM conversations GROUP BY conv_id HAVING count(*) >= 4 ORDER BY last DESC, conv_id LIMIT 20", graph=False)
def _(g):
    per = g.table("conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("responses")).filter("responses >= 4")
    return per.orderBy(F.desc("last"), "conv_id").limit(20)


@plan("u3_seed_union", "AND a AS (SELECT p_partkey AS k, 1 AS src FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10), b AS (SELECT p_partkey AS k, 2 AS src FROM part ORDER BY p_size DESC, p_partkey LIMIT 20) SELECT k, min(src) AS src FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k ORDER BY src, k LIMIT 24")
def _(g):
    top = lambda c, n, src: g.table("part").orderBy(F.desc(c), "p_partkey").limit(n).select(F.col("p_partkey").alias("k"), F.lit(src).alias("src"))
    return top("p_retailprice", 10, 1).unionByName(top("p_size", 20, 2)).groupBy("k").agg(F.min("src").alias("src")).orderBy("src", "k").limit(24)


@plan("u9_audit_candidates", "SELECT subject, relation, object, source, min(seq) AS seq FROM kg_facts GROUP BY 1, 2, 3, 4")
def _(g):
    return g.facts.groupBy(*store.KEY, "source").agg(F.min("seq").alias("seq"))


@plan("n7_relation_hints", "SELECT item_id, list_has_any(string_split(lower(text), ' '), ['born', 'birthplace', 'birth']) AS birth, list_has_any(string_split(lower(text), ' '), ['when', 'date', 'year', 'time']) AS time FROM benchmark", graph=False)
def _(g):
    words = F.split(F.lower("text"), " ")
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    return g.table("benchmark").select("item_id", has("born", "birthplace", "birth").alias("birth"), has("when", "date", "year", "time").alias("time"))


@plan("n27_judge_verdict", "SELECT event_id, CASE event_type WHEN 'view' THEN TRUE WHEN 'error' THEN FALSE END AS verdict FROM events", graph=False)
def _(g):
    """yes or no in the last line of a reply; null if neither."""
    reply = F.concat(F.lit("some reasoning\n"), F.when(F.col("event_type") == "view", "Yes.").when(F.col("event_type") == "error", "no").otherwise("unclear"))
    last = F.lower(F.element_at(F.split(reply, "\n"), -1))
    return g.table("events").select("event_id", F.when(last.startswith("yes"), True).when(last.startswith("no"), False).alias("verdict"))


@plan("n28_pairwise_winner", "SELECT event_id, CASE WHEN event_type LIKE 'v%' THEN 'a' WHEN event_type LIKE 'c%' THEN 'b' ELSE 'tie' END AS winner FROM events", graph=False)
def _(g):
    said = F.when(F.col("event_type") == "view", " A is better").when(F.col("event_type") == "click", "b").otherwise("neither")
    first = F.substring(F.lower(F.trim(said)), 1, 1)
    return g.table("events").select("event_id", F.when(first == "a", "a").when(first == "b", "b").otherwise("tie").alias("winner"))


@plan("n32_keyword_domain", "AND s AS (SELECT item_id, len(list_filter(['the', 'of', 'and'], lambda k: contains(lower(text), k))) AS en, len(list_filter(['der', 'die', 'und'], lambda k: contains(lower(text), k))) AS de FROM benchmark) SELECT item_id, CASE WHEN de > en THEN 'de' WHEN en > 0 THEN 'en' ELSE 'general' END AS domain FROM s")
def _(g):
    hits = lambda *words: sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    en, de = hits("the", "of", "and"), hits("der", "die", "und")
    return g.table("benchmark").select("item_id", F.when(de > en, "de").when(en > 0, "en").otherwise("general").alias("domain"))


@plan("n37_placeholders", "SELECT conv_id, turn, 'Who met ' || coalesce(role, '') || ' later?' AS question FROM conversations", graph=False)
def _(g):
    return g.table("conversations").select("conv_id", "turn", F.regexp_replace(F.lit("Who met [answer from step 1] later?"), F.lit(r"\[answer from step 1\]"), F.coalesce("role", F.lit(""))).alias("question"))


@plan("n39_type_mapping", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Task' WHEN 'SMALL' THEN 'Method' ELSE CASE WHEN contains(lower(p_type), 'e') THEN 'Material' ELSE 'OtherScientificTerm' END END AS kind FROM part", graph=False)
def _(g):
    table = F.create_map(F.lit("PROMO"), F.lit("Task"), F.lit("SMALL"), F.lit("Method"))
    return g.table("part").select("p_partkey", F.coalesce(F.try_element_at(table, F.col("p_type")), F.when(F.contains(F.lower("p_type"), F.lit("e")), "Material"), F.lit("OtherScientificTerm")).alias("kind"))


@plan("n41_alias_flattening", "AND a AS (SELECT 'n' || n_nationkey AS alias, 'n' || (n_nationkey // 2) AS canonical FROM nation WHERE n_nationkey > 0) SELECT a.alias, coalesce(b.canonical, a.canonical) AS canonical FROM a LEFT JOIN a b ON b.alias = a.canonical WHERE a.alias <> coalesce(b.canonical, a.canonical)")
def _(g):
    n = F.col("n_nationkey")
    a = g.table("nation").filter("n_nationkey > 0").select(F.concat(F.lit("n"), n.cast("string")).alias("alias"), F.concat(F.lit("n"), F.floor(n / 2).cast("string")).alias("canonical"))
    b = a.select(F.col("alias").alias("canonical"), F.col("canonical").alias("final"))
    return a.join(b, "canonical", "left").select("alias", F.coalesce("final", "canonical").alias("canonical")).filter("alias <> canonical")
