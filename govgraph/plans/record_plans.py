"""Hooks, boards, added facts, samples and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import hooks
from ..functions import text as T
from ..operators import curation, store, traverse
from ..operators.store import KEY
from .base import plan


@plan("x1_embedding_hook", "SELECT item_id AS id, length(text) AS n, 2 AS dims FROM benchmark", graph=False)
def _(g):
    texts = g.table("benchmark").select(F.col("item_id").alias("id"), "text")
    vectors = hooks.embedded(texts, lambda batch: [[float(len(t)), 1.0] for t in batch], at_once=7, most_chars=100_000)
    return vectors.select("id", F.col("vector")[0].cast("long").alias("n"), F.size("vector").alias("dims"))


@plan("x2_review_hook", "AND r AS (SELECT seq, CASE WHEN confidence >= 0.8 THEN 'approve' WHEN confidence < 0.2 THEN 'reject' ELSE 'escalate' END AS decision FROM kg_facts) SELECT * FROM r")
def _(g):
    """A reviewer that also says what is no decision."""
    review = lambda r: "approve" if r["confidence"] >= 0.8 else "reject" if r["confidence"] < 0.2 else "perhaps"
    return hooks.reviewed(g.facts.select("seq", "confidence"), review).select("seq", "decision")


@plan("x3_resolver_hook", "AND n AS (SELECT DISTINCT subject, relation, object FROM kg_facts WHERE superseded_by IS NULL), o AS (SELECT subject, relation, list_sort(list(object)) AS old FROM kg_facts WHERE superseded_by IS NOT NULL GROUP BY 1, 2) SELECT subject, relation, object, 'supersede' AS action, [old[1]] AS superseded FROM n JOIN o USING (subject, relation)")
def _(g):
    resolve = lambda new, old: {"action": "supersede", "superseded_indices": [0, 10**6]}
    return hooks.resolved(g.facts.filter("superseded_by is null"), g.facts.filter("superseded_by is not null"), resolve)


@plan("x4_summarizer_hook", "SELECT p_brand AS community_id, min(p_name) AS title, CAST(least(60, count(*)) AS VARCHAR) AS summary FROM part GROUP BY 1", graph=False)
def _(g):
    facts = g.table("part").select(F.col("p_brand").alias("community_id"), F.col("p_name").alias("fact"), F.lit(None).cast("double").alias("confidence"))
    return hooks.summarized(facts, lambda f: (min(f), str(len(f))))


@plan("x5_extraction_hook", "SELECT string_split(text, ' ')[1] AS subject, string_split(text, ' ')[2] AS object, CAST(item_id AS VARCHAR) AS source FROM benchmark WHERE item_id % 5 <> 0", graph=False)
def _(g):
    """A function that fails on every fifth document."""

    def process(text, own):
        if int(own) % 5 == 0:
            raise RuntimeError("no")
        words = text.split(" ")
        return [(words[0], "BEFORE", words[1], 0.5)]

    docs = g.table("benchmark").select(F.col("item_id").cast("string").alias("document_id"), "text")
    return hooks.extracted(docs, process).select("subject", "object", "source")


@plan("x8_answer_formats", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 5 WHEN 1 THEN 30 ELSE 8 END AS words FROM region", graph=False)
def _(g):
    words = F.create_map(*[F.lit(v) for name in ("locomo", "BEAM", "else") for v in (name, hooks.answer_format(name).short_answer_words)])
    profile = F.when(F.col("r_regionkey") == 0, "locomo").when(F.col("r_regionkey") == 1, "BEAM").otherwise("else")
    return g.table("region").select("r_regionkey", F.element_at(words, profile).alias("words"))


@plan("a23_decision_counts", "AND d AS (SELECT CASE WHEN confidence >= 0.5 THEN 'approve' ELSE 'escalate' END AS decision FROM kg_facts) SELECT decision, count(*) AS n FROM d GROUP BY 1")
def _(g):
    return hooks.reviewed(g.facts.select("seq", "confidence")).groupBy("decision").agg(F.count("*").alias("n"))


@plan("w1_first_per_key", "SELECT subject, relation, object, min(seq) AS seq FROM kg_facts GROUP BY 1, 2, 3")
def _(g):
    return store.first_per(g.facts, list(KEY), F.col("seq")).select(*KEY, "seq")


@plan("w8_first_last", "SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS is_first, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations", graph=False)
def _(g):
    own = Window.partitionBy("conv_id").orderBy("turn")
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return g.table("conversations").select("conv_id", "turn", (F.row_number().over(own) == 1).alias("is_first"), (F.row_number().over(own) == n).alias("is_last"))


@plan("t5_largest_communities", "SELECT p_type AS community_id, count(*) AS size FROM part GROUP BY 1 ORDER BY size DESC, p_type LIMIT 3", graph=False)
def _(g):
    return g.table("part").groupBy(F.col("p_type").alias("community_id")).agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community_id").limit(3)


@plan("t8_document_scores", """WITH d AS (SELECT doc_id, coalesce(lower(text), '') AS t FROM documents), s AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(t, '[a-z0-9]+')), ['reading', 'about', 'that'])) AS terms, len(list_filter(['reading', 'about', 'that'], lambda w: contains(t, w))) AS hits FROM d)
SELECT doc_id, terms, hits FROM s WHERE hits > 0 ORDER BY terms DESC, hits DESC, doc_id LIMIT 8""", graph=False)
def _(g):
    """Documents by words shared with a question, then by words that stand anywhere in them."""
    wanted = F.array(*map(F.lit, ("reading", "about", "that")))
    text = F.coalesce(F.lower("text"), F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))
    scored = g.table("documents").select("doc_id", F.size(F.array_intersect(words, wanted)).cast("long").alias("terms"), F.size(F.filter(wanted, lambda w: F.contains(text, w))).cast("long").alias("hits"))
    return scored.filter("hits > 0").orderBy(F.desc("terms"), F.desc("hits"), "doc_id").limit(8)


@plan("t9_community_scores", "SELECT p_brand AS community_id, len(list_intersect(list(DISTINCT p_name), ['small bolt', 'cold widget'])) AS entities, len(list_intersect(list(DISTINCT lower(p_type)), ['promo', 'small'])) AS words FROM part GROUP BY 1 ORDER BY entities DESC, words DESC, community_id LIMIT 5", graph=False)
def _(g):
    named, said = F.array(F.lit("small bolt"), F.lit("cold widget")), F.array(F.lit("promo"), F.lit("small"))
    per = g.table("part").groupBy(F.col("p_brand").alias("community_id")).agg(F.size(F.array_intersect(F.collect_set("p_name"), named)).cast("long").alias("entities"), F.size(F.array_intersect(F.collect_set(F.lower("p_type")), said)).cast("long").alias("words"))
    return per.orderBy(F.desc("entities"), F.desc("words"), "community_id").limit(5)


@plan("p19_source_only", "SELECT item_id, TRUE AS own, FALSE AS other FROM benchmark", graph=False)
def _(g):
    """Verified if some quote stands in the source; blank quotes do not count."""
    source = T.quote(F.col("text"))
    stands = lambda quotes: F.exists(F.transform(quotes, T.quote), lambda q: (q != "") & F.contains(source, q))
    return g.table("benchmark").select("item_id", stands(F.array(F.lit("no such quote"), F.substring("text", 3, 20))).alias("own"), stands(F.array(F.lit(""), F.lit("zzz zzz"))).alias("other"))


@plan("p25_evidence_gate", "SELECT event_id, event_id % 4 <> 0 AS found FROM events", graph=False)
def _(g):
    """Whether a payload holds any evidence, however deep: a non-blank string, a number or a flag that is true, outside empty lists."""
    own = F.col("event_id") % 4
    payload = F.when(own == 0, '{"a": [], "b": {"c": "", "d": null, "e": [{}]}}').when(own == 1, '{"a": [{"b": ["x"]}]}').when(own == 2, '{"a": {"b": 3}}').otherwise('{"a": "text"}')
    # What is left of a JSON text without keys, blanks, brackets and empty values.
    rest = F.regexp_replace(F.regexp_replace(payload, r'"[^"]*"\s*:', ""), r'""|null|false|[\[\]{},\s]', "")
    return g.table("events").select("event_id", (rest != "").alias("found"))


@plan("g8_bypass_insert", "AND t AS (SELECT 'nation:' || n_nationkey AS subject, 'SEEN_IN' AS relation, 'region:' || n_regionkey AS object FROM nation) SELECT subject, relation, object, 'auto_approve' AS action, TRUE AS committed FROM t")
def _(g):
    """Facts put in without routing, each with its audit row."""
    new = g.core.filter("relation = 'IN_REGION'").select("subject", F.lit("SEEN_IN").alias("relation"), "object", "confidence", "source")
    return store.insert_absent(new, g.core).select(*KEY, F.lit("auto_approve").alias("action"), F.lit(True).alias("committed"))


@plan("g13_domain_compaction", "SELECT DISTINCT p_brand AS domain_id, min(p_brand) OVER (PARTITION BY types) AS folded FROM (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS types FROM part GROUP BY 1)", graph=False)
def _(g):
    """Domains of the same relation schema fold into the first of them."""
    kinds = g.table("part").groupBy(F.col("p_brand").alias("domain_id")).agg(F.array_sort(F.collect_set("p_type")).alias("types"))
    return kinds.join(kinds.groupBy("types").agg(F.min("domain_id").alias("folded")), "types").select("domain_id", "folded")


@plan("g20_enrichment", """AND base AS (SELECT DISTINCT subject, relation, object FROM kg_facts WHERE seq % 3 <> 0), new AS (SELECT subject, relation, object, max(confidence) AS confidence FROM kg_facts WHERE seq % 3 = 0 GROUP BY 1, 2, 3),
d AS (SELECT new.*, EXISTS (SELECT 1 FROM base b WHERE b.subject = new.subject AND b.relation = new.relation) AS known FROM new WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.subject = new.subject AND b.relation = new.relation AND b.object = new.object))
SELECT subject, relation, object, CASE WHEN confidence < 0.5 THEN 'escalate' WHEN known THEN 'conflict' ELSE 'commit' END AS action FROM d""")
def _(g):
    """Facts of new documents against a base: what it has goes, the unsure are escalated, those against known values are
    conflicts, others are committed."""
    base = g.facts.filter("seq % 3 <> 0").select(*KEY).distinct()
    new = g.facts.filter("seq % 3 = 0").groupBy(*KEY).agg(F.max("confidence").alias("confidence"))
    fresh = new.join(base, list(KEY), "left_anti")
    known = base.select("subject", "relation").distinct().withColumn("known", F.lit(True))
    action = F.when(F.col("confidence") < 0.5, "escalate").when(F.col("known"), "conflict").otherwise("commit")
    return fresh.join(known, ["subject", "relation"], "left").select(*KEY, action.alias("action"))


@plan("d2_domain_fallback", """SELECT p_partkey, CASE WHEN upper(p_type) = 'PROMO' THEN 'd3' WHEN contains('ECONOMY GOODS', upper(p_type)) THEN 'd2' ELSE 'd1' END AS domain_id FROM part""", graph=False)
def _(g):
    """A domain by the last one whose key types equal or hold the entity's type; the first one else."""
    keys = (("d1", "SMALL THING"), ("d2", "ECONOMY GOODS"), ("d3", "PROMO"))
    kind = F.upper(F.coalesce("p_type", F.lit("")))
    domain = F.lit("d1")
    for name, key in keys:
        domain = F.when(F.contains(F.lit(key), kind) & (F.lit(name) != "d1"), name).otherwise(domain)
    return g.table("part").select("p_partkey", domain.alias("domain_id"))


@plan("d18_source_documents", "SELECT DISTINCT source FROM kg_triples UNION SELECT 'entity ' || type FROM kg_entities")
def _(g):
    """Documents of triples and of entities; brackets around a name go."""
    of = g.entities.select(F.concat(F.lit("[entity "), "type", F.lit("]")).alias("source"))
    return g.triples.select("source").unionByName(of).select(F.regexp_replace("source", r"[\[\]]", "").alias("source")).distinct()


@plan("d23_prompt_runs", "SELECT event_type AS config, round(avg(CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS em, round(avg(CASE WHEN user_id % 3 = 2 THEN 0.0 ELSE 1.0 END), 6)::DOUBLE AS substring_em FROM events GROUP BY 1", graph=False)
def _(g):
    """Answers under either key, scored for each configuration."""
    own = F.col("user_id") % 3
    reply = F.when(own == 0, '{"answer": "The Red Sea"}').when(own == 1, '{"final_answer": "It is the red sea."}').otherwise('{"prediction": "blue"}')
    answer = F.coalesce(*(F.get_json_object(reply, f"$.{k}") for k in ("answer", "final_answer", "prediction")))
    gold = F.lit("red sea")
    inside = F.contains(T.normalize_answer(answer), T.normalize_answer(gold)).cast("double")
    return g.table("events").groupBy(F.col("event_type").alias("config")).agg(F.round(F.avg(T.exact_match(answer, gold)), 6).alias("em"), F.round(F.avg(inside), 6).alias("substring_em"))


@plan("d26_split", "SELECT CASE WHEN count(*) >= 30 THEN 20 ELSE least(20, count(*)) END AS train, greatest(0, least(10, count(*) - 20)) AS test, 0 AS in_both FROM conversations WHERE turn % 5 <> 4", graph=False)
def _(g):
    """Questions of category 5 left out; by hash order the first 20 train and the next 10 test."""
    top = g.table("conversations").filter("turn % 5 <> 4").select("conv_id", "turn", F.xxhash64("conv_id", "turn", F.lit(7)).alias("h")).orderBy("h", "conv_id", "turn").limit(30)
    split = top.withColumn("r", F.row_number().over(Window.orderBy("h", "conv_id", "turn"))).withColumn("side", F.when(F.col("r") <= 20, "train").otherwise("test"))
    per = split.groupBy("conv_id", "turn").agg(F.count_if(F.col("side") == "train").alias("train"), F.count_if(F.col("side") == "test").alias("test"))
    return per.agg(F.sum("train").alias("train"), F.sum("test").alias("test"), F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("in_both"))


@plan("d27_subset", "SELECT conv_id, turn FROM conversations WHERE turn IN (0, 2) AND conv_id % 2 = 0", graph=False)
def _(g):
    """Of each sample's list, the places on its allowlist."""
    c = g.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("qa"))
    allowed = c.filter("conv_id % 2 = 0").select("conv_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("at"))
    return c.select("conv_id", F.posexplode("qa").alias("at", "turn")).join(allowed, ["conv_id", "at"], "left_semi").select("conv_id", "turn")


@plan("d31_document_graphs", "AND e AS (SELECT source, subject AS id FROM core UNION SELECT source, object FROM core) SELECT source, count(*) AS entities FROM e GROUP BY source")
def _(g):
    ends = g.core.select("source", F.explode(F.array("subject", "object")).alias("id")).distinct()
    return ends.groupBy("source").agg(F.count("*").alias("entities"))


@plan("d32_supported_fraction", "SELECT source, round(avg(CASE WHEN confidence >= 0.95 OR relation = 'HAS_TYPE' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS supported FROM kg_triples GROUP BY 1".replace("SELECT source", "AND x AS (SELECT 1) SELECT source", 1))
def _(g):
    held = (F.col("confidence") >= 0.95) | (F.col("relation") == "HAS_TYPE")
    return g.triples.groupBy("source").agg(F.round(F.avg(F.when(held, 1.0).otherwise(0.0)), 6).alias("supported"))


@plan("d33_funnel", "SELECT conv_id, count(*) AS segments, sum(length(text)) AS chars, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY 1", graph=False)
def _(g):
    per = g.table("conversations").select("conv_id", "turn", F.create_map(F.lit("segments"), F.lit(1), F.lit("chars"), F.length("text"), F.lit("asked"), (F.col("role") == "user").cast("int")).alias("counters"))
    added = lambda k: F.sum(F.element_at("counters", k)).alias(k)
    return per.groupBy("conv_id").agg(added("segments"), added("chars"), added("asked"))


@plan("d34_suggested_relations", "AND s AS (SELECT relation FROM kg_facts GROUP BY 1 HAVING count(*) >= 2 AND avg(confidence) >= 0.4) SELECT relation FROM s UNION SELECT 'IN_REGION'")
def _(g):
    """Configured ones, those found often and confidently enough, and remembered ones."""
    found = g.facts.groupBy("relation").agg(F.count("*").alias("n"), F.avg("confidence").alias("c")).filter("n >= 2 and c >= 0.4").select("relation")
    known = g.core.filter("relation = 'IN_REGION'").select("relation")
    return found.unionByName(known).distinct()


@plan("d36_replay_insert", "SELECT subject, upper(relation) AS relation, object, 'replay' AS origin FROM core")
def _(g):
    """Facts taken over with their canonical relation and where they came from, each once."""
    old = g.core.select("subject", F.lower(F.replace("relation", F.lit("_"), F.lit("-"))).alias("relation"), "object")
    new = old.unionByName(old.limit(5)).select("subject", curation.canonical_relation(F.col("relation")).alias("relation"), "object")
    return new.distinct().withColumn("origin", F.lit("replay"))


@plan("d41_board", """SELECT conv_id, count(*) FILTER (turn > 0) AS responses, count(*) FILTER (role = 'assistant') AS votes, CASE WHEN count(*) FILTER (turn > 0) >= 3 THEN 'resolved' WHEN count(*) FILTER (turn > 0) > 0 THEN 'active' ELSE 'open' END AS status FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY 1""", graph=False)
def _(g):
    """Entries with their responses and each agent's last vote; an entry with three responses is resolved."""
    c = g.table("conversations")
    responses = c.groupBy("conv_id").agg(F.count_if(F.col("turn") > 0).alias("responses"))
    votes = c.filter("role = 'assistant'").select("conv_id", F.concat(F.lit("agent"), F.col("turn").cast("string")).alias("agent"), (F.length("text") % 2 == 0).alias("vote"), "turn")
    # Each agent votes twice: the last one counts.
    twice = votes.unionByName(votes.withColumns({"vote": ~F.col("vote"), "turn": F.col("turn") - 100}))
    last = store.first_per(twice, ["conv_id", "agent"], F.desc("turn")).groupBy("conv_id").agg(F.count("*").alias("votes"))
    status = F.when(F.col("responses") >= 3, "resolved").when(F.col("responses") > 0, "active").otherwise("open")
    return responses.join(last, "conv_id", "left").select("conv_id", "responses", F.coalesce("votes", F.lit(0)).alias("votes"), status.alias("status"))


@plan("d43_domain_cards", """AND n AS (SELECT domain_id, entity_id, row_number() OVER (PARTITION BY domain_id ORDER BY entity_id) AS r FROM domain_entities), c AS (SELECT domain_id, string_agg(entity_id, ', ' ORDER BY entity_id) FILTER (r <= 3) AS few, count(*) AS n FROM n GROUP BY 1)
SELECT domain_id, domain_id || ': ' || few || CASE WHEN n > 3 THEN ' and ' || (n - 3) || ' more' ELSE '' END AS card FROM c""")
def _(g):
    """A domain in a line: its first three entities and how many more there are."""
    rank = F.row_number().over(Window.partitionBy("domain_id").orderBy("entity_id"))
    few = g.domain_entities.withColumn("r", rank).groupBy("domain_id").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("entity_id")))).alias("few"), F.count("*").alias("n"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(" and "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return few.select("domain_id", F.concat(F.col("domain_id"), F.lit(": "), F.array_join("few", ", "), more).alias("card"))


@plan("d45_provenance_text", "AND p AS (SELECT subject, relation, list_sort(list(seq)) AS s FROM kg_facts GROUP BY 1, 2) SELECT subject, relation, array_to_string(s[1:3], ', ') AS places, len(s) AS n FROM p")
def _(g):
    """Where a fact stands: the first three places and their number."""
    p = g.facts.groupBy("subject", "relation").agg(F.array_sort(F.collect_list("seq")).alias("s"))
    return p.select("subject", "relation", F.array_join(F.slice("s", 1, 3).cast("array<string>"), ", ").alias("places"), F.size("s").cast("long").alias("n"))


@plan("d48_referenced", """AND r AS (SELECT 'nation:' || n_nationkey AS id, n_nationkey % 2 = 0 AS said FROM nation) SELECT r.id, count(*) AS edges FROM r JOIN core ON (said AND subject = r.id AND relation = 'IN_REGION') OR (NOT said AND (subject = r.id OR object = r.id)) GROUP BY 1""")
def _(g):
    """Facts that an evidence text quotes, or all facts at its entity where it quotes none."""
    n = g.core.filter("relation = 'IN_REGION'").withColumn("key", F.substring_index("subject", ":", -1).cast("int"))
    said = n.withColumn("text", F.when(F.col("key") % 2 == 0, F.concat(F.lit("("), "subject", F.lit(", IN_REGION, "), "object", F.lit(")"))).otherwise("no quote")).select(F.col("subject").alias("id"), "text")
    parts = F.regexp_extract_all("text", F.lit(r"\(([^,()]+), ([^,()]+), ([^()]+)\)"), F.lit(0))
    quoted = said.select("id", F.explode(parts).alias("q")).select("id", *(F.regexp_extract("q", r"\(([^,()]+), ([^,()]+), ([^()]+)\)", i + 1).alias(c) for i, c in enumerate(KEY)))
    exact = quoted.join(g.core.select(*KEY), list(KEY)).select("id", *KEY)
    rest = said.select("id").join(exact.select("id").distinct(), "id", "left_anti")
    s = rest.join(g.core.select(*KEY), F.col("id") == F.col("subject"))
    o = rest.join(g.core.select(*KEY), F.col("id") == F.col("object"))
    return exact.unionByName(s).unionByName(o).distinct().groupBy("id").agg(F.count("*").alias("edges"))


@plan("e13_entity_index", """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'key' ELSE 'part' END AS tier FROM supplier""", graph=False)
def _(g):
    """Mentions by normalized name, then by letters and digits, then inside a longer name."""
    s, own = g.table("supplier"), F.col("s_suppkey") % 3
    mention = F.when(own == 0, F.upper("s_name")).when(own == 1, F.replace("s_name", F.lit("#"), F.lit(" / "))).otherwise(F.substring("s_name", 3, 100))
    asked = s.select("s_suppkey", mention.alias("m"))
    index = s.select(T.normalize_name(F.col("s_name")).alias("n"), T.matching_key(F.col("s_name")).alias("k"))
    one = asked.join(index.select(F.col("n")).distinct(), T.normalize_name(F.col("m")) == F.col("n")).select("s_suppkey", F.lit("exact").alias("tier"))
    left = asked.join(one, "s_suppkey", "left_anti")
    two = left.join(index.select("k").distinct(), T.matching_key(F.col("m")) == F.col("k")).select("s_suppkey", F.lit("key").alias("tier"))
    rest = left.join(two, "s_suppkey", "left_anti").withColumn("key", T.matching_key(F.col("m"))).withColumn("gram", F.substring("key", -6, 6))
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("k") - 5)), lambda i: F.substring(F.col("k"), i, 6)))).alias("gram")
    three = rest.join(index.select("k", grams), "gram").filter(F.contains("k", F.col("key"))).select("s_suppkey", F.lit("part").alias("tier")).distinct()
    return one.unionByName(two).unionByName(three)


@plan("e14_path_support", "SELECT 'customer:' || c_custkey AS subject, 'region:' || n_regionkey AS object, 2 AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey", graph=False)
def _(g):
    """Claims without a triple of their own that a path of two steps supports: whom a region holds."""
    step = g.core.filter("relation in ('IN_NATION', 'IN_REGION')").select("subject", "object")
    claims = g.core.filter("relation = 'IN_NATION' and subject like 'customer:%'").select("subject", F.col("object").alias("via"))
    return claims.join(step.select(F.col("subject").alias("via"), "object"), "via").select("subject", "object", F.lit(2).alias("hops"))


@plan("e24_budget_split", "SELECT kind, CAST(17 // n + CASE WHEN r <= 17 % n THEN 1 ELSE 0 END AS BIGINT) AS budget FROM (SELECT p_type AS kind, row_number() OVER (ORDER BY p_type) AS r, count(*) OVER () AS n FROM part GROUP BY p_type)", graph=False)
def _(g):
    """17 questions over the types: an equal share each, the remainder to the first.  Types are few."""
    kinds = g.table("part").agg(F.array_sort(F.collect_set("p_type")).alias("k"))
    each = kinds.select(F.size("k").alias("n"), F.posexplode("k").alias("r", "kind"))
    return each.select("kind", (F.floor(F.lit(17) / F.col("n")) + F.when(F.col("r") < 17 % F.col("n"), 1).otherwise(0)).cast("long").alias("budget"))


@plan("r7_component_communities", "SELECT 'region:' || r_regionkey AS community_id, count(*) + 1 AS size FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey HAVING FALSE UNION ALL SELECT min(id), count(*) FROM (SELECT 'nation:' || n_nationkey AS id, n_regionkey AS r FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_regionkey FROM region) GROUP BY r", graph=False)
def _(g):
    """The baseline's fallback: connected components as communities."""
    found = traverse.components(g.core.filter("relation = 'IN_REGION'"))
    return found.groupBy(F.col("component").alias("community_id")).agg(F.count("*").alias("size"))


@plan("d8_relink_batches", """AND o AS (SELECT user_id AS id, min(event_id) AS segment FROM events GROUP BY 1 HAVING count(*) < 70), b AS (SELECT id, segment % 7 AS segment, (row_number() OVER (PARTITION BY segment % 7 ORDER BY id) - 1) // 8 AS batch FROM o) SELECT segment, batch, count(*) AS n FROM b GROUP BY 1, 2""")
def _(g):
    """Entities with few facts, by their first segment, in batches of eight."""
    o = g.table("events").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("segment"), F.count("*").alias("n")).filter("n < 70").select("id", (F.col("segment") % 7).alias("segment"))
    rank = F.row_number().over(Window.partitionBy("segment").orderBy("id"))
    return o.withColumn("batch", F.floor((rank - 1) / 8)).groupBy("segment", "batch").agg(F.count("*").alias("n"))


@plan("w12_scores_by_question", "SELECT turn % 5 + 1 AS category, count(*) AS n, count(*) FILTER (length(text) > 200) AS long FROM conversations GROUP BY 1", graph=False)
def _(g):
    return g.table("conversations").groupBy((F.col("turn") % 5 + 1).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.length("text") > 200).alias("long"))
