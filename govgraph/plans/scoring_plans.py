"""Scoring and benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring as S
from .base import plan
from .text_plans import ANSWER, answers

#: The doubles next to the decimal steps: 0.30 + 0.05 * 6 is above 0.6.
GRID = [(30 + 5 * i) / 100 for i in range(14)]


def _pred(g):
    """Documents called good: long enough."""
    return g.table("documents").filter("n_chars > 1000").select("doc_id", "lang")


_SETS = "AND gold AS (SELECT DISTINCT l.doc_id, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 1), pred AS (SELECT DISTINCT doc_id, lang FROM documents WHERE n_chars > 1000 AND doc_id IN (SELECT doc_id FROM labels))\n"
_COUNT = "c AS (SELECT coalesce(g.lang, p.lang) AS lang, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM gold g FULL JOIN pred p ON g.doc_id = p.doc_id AND g.lang = p.lang GROUP BY 1)"


def gold_and_pred(g):
    labelled = g.table("labels").select("doc_id").distinct()
    gold = g.table("labels").filter("quality = 1").join(g.table("documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang")
    return gold, _pred(g).join(labelled, "doc_id", "left_semi")


@plan("e1_prf_by_language", _SETS.rstrip() + ", " + _COUNT + " SELECT lang, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 4) AS f1 FROM c")
def _(g):
    gold, found = gold_and_pred(g)
    p, r, f = S.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return S.counts(gold, found, ["doc_id"], ["lang"]).select("lang", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


@plan("e7_micro", _SETS.rstrip() + ", " + _COUNT + " SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c")
def _(g):
    gold, found = gold_and_pred(g)
    return S.counts(gold, found, ["doc_id"], ["lang"]).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


@plan("e9_macro", _SETS.rstrip() + ", " + _COUNT + " SELECT round(avg(tp::DOUBLE / (tp + fp)), 4) AS precision, round(avg(tp::DOUBLE / (tp + fn)), 4) AS recall FROM c")
def _(g):
    gold, found = gold_and_pred(g)
    p, r, _ = S.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return S.counts(gold, found, ["doc_id"], ["lang"]).agg(F.round(F.avg(p), 4).alias("precision"), F.round(F.avg(r), 4).alias("recall"))


@plan("e3_partial_match")
def _(g):
    """Parts' names against types' names of one brand, greedily by token overlap."""
    return partial_matches(g.table("part")).groupBy("p_brand").agg(F.count("*").alias("n"))


def partial_matches(part):
    """Greedy pairs of one brand.  Parts with the same set of tokens are one class, and only classes that share a token are
    compared, as all others have score 0."""
    cls = F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " ")))
    members = part.select("p_brand", F.col("p_partkey").alias("key"), cls.alias("tokens")).withColumn("cls", F.array_join("tokens", " ")).filter("tokens is not null")
    classes = members.select("p_brand", "cls", "tokens").distinct()
    side = lambda key, names: classes.select("p_brand", F.col("cls").alias(key), F.col("tokens").alias(names)).withColumn("token", F.explode(names))
    met = side("x", "a").join(side("y", "b"), ["p_brand", "token"])
    pairs = met.select("p_brand", "x", "y", T.jaccard(F.col("a"), F.col("b")).alias("score")).filter("score >= 0.5").distinct()
    return S.greedy_match_classes(members, pairs, "p_brand")


@plan("e5_degeneracy", """AND f AS (SELECT seq, relation, subject, object, CASE WHEN seq % 9 = 0 THEN subject ELSE object END AS o FROM kg_facts) SELECT relation, count(*) FILTER (subject = o) AS self_ref, count(*) FILTER (o IN ('v:0', 'v:1')) AS generic_node, round(count(*) FILTER (subject = o OR o IN ('v:0', 'v:1'))::DOUBLE / count(*), 6) AS rate FROM f GROUP BY relation""")
def _(g):
    f = g.facts.withColumn("o", F.when(F.col("seq") % 9 == 0, F.col("subject")).otherwise(F.col("object")))
    own, generic = F.col("subject") == F.col("o"), F.col("o").isin("v:0", "v:1")
    return f.groupBy("relation").agg(F.count_if(own).alias("self_ref"), F.count_if(generic).alias("generic_node"), F.round(F.count_if(own | generic) / F.count("*"), 6).alias("rate"))


@plan("e6_rogue", "SELECT CASE WHEN e.id IS NULL THEN 'UNRESOLVED' ELSE 'KNOWN' END AS flag, count(*) AS n FROM (SELECT DISTINCT object AS id FROM kg_triples) o LEFT JOIN kg_entities e ON e.id = o.id GROUP BY 1")
def _(g):
    ends = g.triples.select(F.col("object").alias("id")).distinct()
    known = g.entities.select("id", F.lit(True).alias("known"))
    return ends.join(known, "id", "left").groupBy(F.when(F.col("known"), "KNOWN").otherwise("UNRESOLVED").alias("flag")).agg(F.count("*").alias("n"))


@plan("e8_pair_recall", "AND gold AS (SELECT DISTINCT subject, object FROM kg_facts WHERE seq % 2 = 0), pred AS (SELECT DISTINCT subject, object FROM kg_facts WHERE seq % 3 = 0 UNION SELECT DISTINCT object, subject FROM kg_facts WHERE seq % 5 = 0) SELECT count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM pred p WHERE p.subject = g.subject AND p.object = g.object) OR EXISTS (SELECT 1 FROM pred p WHERE p.subject = g.object AND p.object = g.subject)) AS hit FROM gold g")
def _(g):
    pair = lambda df, a, b: df.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    gold = g.facts.filter("seq % 2 = 0").select("subject", "object").distinct()
    pred = pair(g.facts.filter("seq % 3 = 0 or seq % 5 = 0"), "subject", "object").distinct().withColumn("hit", F.lit(True))
    met = gold.withColumns({"x": F.least("subject", "object"), "y": F.greatest("subject", "object")}).join(pred, ["x", "y"], "left")
    return met.agg(F.count("*").alias("gold"), F.count_if("hit").alias("hit"))


@plan("e15_composite", "SELECT event_type, round(avg(0.30 * (event_id % 10) / 10.0 + 0.25 * (1 - (event_id % 4) / 4.0) + 0.20 * (event_id % 5) / 5.0 + 0.15 * (event_id % 3) / 3.0 + 0.10 * (event_id % 2)), 4) AS score FROM events GROUP BY event_type", graph=False)
def _(g):
    e = F.col("event_id")
    score = 0.30 * (e % 10) / 10.0 + 0.25 * (1 - (e % 4) / 4.0) + 0.20 * (e % 5) / 5.0 + 0.15 * (e % 3) / 3.0 + 0.10 * (e % 2)
    return g.table("events").groupBy("event_type").agg(F.round(F.avg(score), 4).alias("score"))


@plan("e19_judge_panel", "SELECT user_id, round(avg(0.35 * (event_id % 2) + 0.25 * (event_id % 3) / 2.0 + 0.40 * (event_id % 5) / 4.0), 4) AS score, bool_and(event_type <> 'error') AND avg(0.35 * (event_id % 2) + 0.25 * (event_id % 3) / 2.0 + 0.40 * (event_id % 5) / 4.0) >= 0.65 AS passed FROM events GROUP BY user_id", graph=False)
def _(g):
    e = F.col("event_id")
    mean = F.avg(0.35 * (e % 2) + 0.25 * (e % 3) / 2.0 + 0.40 * (e % 5) / 4.0)
    return g.table("events").groupBy("user_id").agg(F.round(mean, 4).alias("score"), (F.bool_and(F.col("event_type") != "error") & (mean >= 0.65)).alias("passed"))


@plan("e20_pairwise", "AND p AS (SELECT user_id % 6 AS dim, CASE WHEN event_id % 2 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'tie' END ELSE CASE event_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE 'tie' END END AS winner FROM events) SELECT dim, winner, count(*) AS n FROM p GROUP BY 1, 2")
def _(g):
    e = F.col("event_id")
    said = F.when(e % 3 == 0, "a").when(e % 3 == 1, "b").otherwise("tie")
    swapped = F.when(said == "a", "b").when(said == "b", "a").otherwise("tie")
    return g.table("events").groupBy((F.col("user_id") % 6).alias("dim"), F.when(e % 2 == 0, said).otherwise(swapped).alias("winner")).agg(F.count("*").alias("n"))


@plan("e21_bootstrap")
def _(g):
    return S.bootstrap(g.table("events").filter("event_type = 'purchase'").select(F.col("event_id").alias("key"), "value")).select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@plan("e22_sign_test")
def _(g):
    e = g.table("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("wins"), F.count_if(F.col("event_type") == "click").alias("losses"))
    return e.select("user_id", F.round(S.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


@plan("e23_questions", """AND agg AS (SELECT subject, relation, count(DISTINCT object) AS n FROM kg_triples WHERE relation = 'ORDERED' GROUP BY 1, 2 HAVING count(DISTINCT object) >= 2) SELECT 'aggregation' AS kind, subject, relation, n FROM agg
UNION ALL SELECT 'multi_hop', t.subject, u.object, 2 FROM core t JOIN core u ON t.object = u.subject""")
def _(g):
    many = g.triples.filter("relation = 'ORDERED'").groupBy("subject", "relation").agg(F.count_distinct("object").alias("n")).filter("n >= 2")
    t, u = g.core.select("subject", F.col("object").alias("mid")), g.core.select(F.col("subject").alias("mid"), F.col("object").alias("relation"))
    two = t.join(u, "mid").select(F.lit("multi_hop").alias("kind"), "subject", "relation", F.lit(2).cast("long").alias("n"))
    return many.select(F.lit("aggregation").alias("kind"), "subject", "relation", "n").unionByName(two)


@plan("e25_support", "SELECT count(*) AS items, count(*) FILTER (EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))) AS supported FROM benchmark b", graph=False)
def _(g):
    docs = g.table("documents").select("text")
    items = g.table("benchmark").select("item_id", F.col("text").alias("wanted"))
    held = docs.join(F.broadcast(items), F.contains("text", F.col("wanted"))).select("item_id").distinct().withColumn("hit", F.lit(True))
    return items.join(held, "item_id", "left").agg(F.count("*").alias("items"), F.count_if("hit").alias("supported"))


_NORM = f"AND qa AS (SELECT item_id, text AS gold, array_to_string(string_split(text, ' ')[1:1 + item_id % 12], ' ') AS prediction FROM benchmark), n AS (SELECT {ANSWER.replace('@@', 'prediction')} AS p, {ANSWER.replace('@@', 'gold')} AS g FROM qa)"


@plan("e26_answer_metrics", _NORM + " SELECT count(*) AS num_questions, round(avg(CASE WHEN p = g THEN 1.0 ELSE 0.0 END), 4) AS exact_match, round(avg(CASE WHEN p <> '' THEN 1.0 ELSE 0.0 END), 4) AS answer_rate FROM n")
def _(g):
    a = answers(g)
    p = T.normalize_answer(F.col("prediction"))
    return a.agg(F.count("*").alias("num_questions"), F.round(F.avg(T.exact_match(F.col("prediction"), F.col("gold"))), 4).alias("exact_match"), F.round(F.avg(F.when(p != "", 1.0).otherwise(0.0)), 4).alias("answer_rate"))


@plan("e27_accuracy_by_type", "SELECT lang, round(avg(quality), 4) AS accuracy, count(quality) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang", graph=False)
def _(g):
    met = g.table("documents").select("doc_id", "lang").join(g.table("labels"), "doc_id", "left")
    return met.groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("accuracy"), F.count("quality").alias("n"))


@plan("e28_kendall")
def _(g):
    ranks = g.table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    return ranks.select("conv_id", F.round(S.kendall_tau(F.col("t.turn"), F.col("t.n")), 6).alias("tau"))


@plan("e30_thresholds", """AND s AS (SELECT l.doc_id, quality AS label, least(1.0, n_chars / 4000.0) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id), t AS (SELECT unnest(generate_series(0, 13)) AS i),
c AS (SELECT i, count(*) FILTER (score >= 0.30 + 0.05 * i AND label = 1) AS tp, count(*) FILTER (score >= 0.30 + 0.05 * i AND label = 0) AS fp, count(*) FILTER (score < 0.30 + 0.05 * i AND label = 1) AS fn FROM s, t GROUP BY i) SELECT i::INT AS i, tp, fp, fn FROM c""")
def _(g):
    s = g.table("labels").join(g.table("documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    return S.thresholds(s, GRID).select(F.round((F.col("threshold") - 0.30) / 0.05).cast("int").alias("i"), "tp", "fp", "fn")


@plan("e31_build_analysis", "SELECT d.source, count(*) AS docs, count(l.doc_id) AS labelled, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source", graph=False)
def _(g):
    lab = g.table("labels").select("doc_id", F.lit(1).alias("l"))
    return g.table("documents").select("doc_id", "source").join(lab, "doc_id", "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("l").alias("labelled"), F.count_if(F.col("l").isNull()).alias("missing"))


@plan("e32_noise", "SELECT d.domain_id, f.f AS factor, 'fake:' || d.domain_id || ':' || f.f || ':' || i.i AS entity FROM domains d, (SELECT unnest([1, 2]) AS f) f, (SELECT unnest([0, 1, 2, 3]) AS i) i WHERE i.i < 2 * f.f")
def _(g):
    factors = g.domains.select("domain_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("factor"))
    fakes = factors.withColumn("i", F.explode(F.sequence(F.lit(0), 2 * F.col("factor") - 1)))
    return fakes.select("domain_id", "factor", F.concat_ws(":", F.lit("fake"), "domain_id", F.col("factor").cast("string"), F.col("i").cast("string")).alias("entity"))
