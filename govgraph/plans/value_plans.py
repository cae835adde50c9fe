"""Values, answers and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from .base import plan

#: A sentence on every order; the same in SQL.
_SAID = "'Order ' || o_orderkey || ' opened on ' || day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) || ' for ' || (100 + o_custkey % 900) || ',000 seats, from ' || year(o_orderdate) || ' to ' || (year(o_orderdate) + 1) || ', ' || (o_orderkey % 90 + 10) || ' km off.'"


def said(g):
    at = F.col("o_orderdate")
    s = lambda c: c.cast("string")
    parts = ["Order ", s(F.col("o_orderkey")), " opened on ", s(F.dayofmonth(at)), " ", F.date_format(at, "MMMM"), " ", s(F.year(at)), " for ", s(100 + F.col("o_custkey") % 900), ",000 seats, from ", s(F.year(at)), " to ", s(F.year(at) + 1), ", ", s(F.col("o_orderkey") % 90 + 10), " km off."]
    return g.table("orders").withColumn("text", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).withColumn("name", F.concat(F.lit("Order "), s(F.col("o_orderkey"))))


@plan("n18_values", f"""WITH s AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y, day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) AS d FROM orders)
SELECT o_orderkey, d AS text, 'Date' AS type FROM s UNION ALL SELECT o_orderkey, d, 'Date' FROM s
UNION ALL SELECT o_orderkey, 'from ' || y || ' to ' || (y + 1), 'DateRange' FROM s UNION ALL SELECT o_orderkey, '' || y, 'Year' FROM s UNION ALL SELECT o_orderkey, '' || (y + 1), 'Year' FROM s
UNION ALL SELECT o_orderkey, (100 + o_custkey % 900) || ',000 seats', 'Quantity' FROM s UNION ALL SELECT o_orderkey, (o_orderkey % 90 + 10) || ' km', 'Quantity' FROM s""", graph=False)
def _(g):
    """Dates twice: with the verb before them and without are two surfaces of one value."""
    return A.values_in(said(g), "o_orderkey", "name").select("o_orderkey", "text", "type")


@plan("n19_value_relation", """SELECT relation, count(*) AS n FROM (SELECT unnest(['HAS_TIMEFRAME', 'HAS_TIMEFRAME', 'HAS_TIMEFRAME', 'HAS_YEAR', 'HAS_YEAR', 'HAS_CAPACITY', 'HAS_CAPACITY']) AS relation FROM orders) GROUP BY relation""", graph=False)
def _(g):
    found = A.values_in(said(g), "o_orderkey", "name")
    return found.groupBy(A.value_relation(F.col("type"), F.col("context")).alias("relation")).agg(F.count("*").alias("n"))


@plan("j12_attribute_subject", f"""WITH s AS (SELECT o_orderkey, {_SAID} AS text, 'Order ' || o_orderkey AS subject, year(o_orderdate) || '' AS value FROM orders)
SELECT o_orderkey, CASE WHEN abs(instr(text, subject) - instr(text, value)) - 50 < abs(instr(text, ' km') - instr(text, value)) THEN subject ELSE 'distance' END AS subject FROM s""", graph=False)
def _(g):
    """The subject nearest to a value, 50 characters nearer if it stands before it."""
    s = said(g).select("o_orderkey", "text", F.year("o_orderdate").cast("string").alias("value"))
    at = lambda c: F.instr(F.col("text"), c)
    named = F.array(F.struct(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("subject"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("surface")), F.struct(F.lit("distance").alias("subject"), F.lit(" km").alias("surface")))
    each = s.select("o_orderkey", "text", "value", F.explode(named).alias("s"))
    gap = F.abs(at(F.col("s.surface")) - at(F.col("value"))) - F.when(at(F.col("s.surface")) < at(F.col("value")), 50).otherwise(0)
    return each.groupBy("o_orderkey").agg(F.min_by("s.subject", F.struct(gap, "s.subject")).alias("subject"))


@plan("d38_named_subject", "SELECT c_custkey, TRUE AS by_type, c_mktsegment SIMILAR TO '[A-Z][A-Za-z0-9''.-]{2,}' AS by_name FROM customer", graph=False)
def _(g):
    one = F.array("c_mktsegment")
    return g.table("customer").select("c_custkey", A.named_subject(F.lit("Shipping Company"), F.array(F.lit("x"))).alias("by_type"), A.named_subject(F.lit(""), one).alias("by_name"))


_NO_ARTICLES = "array_to_string(list_filter(string_split(regexp_replace({}, '{}', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@plan("n9_support_text", "SELECT item_id, " + _NO_ARTICLES.format("lower(text)", r"[!-/:-@\[-`{-~]|\s") + " AS text FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", A.support_text(F.col("text")).alias("text"))


@plan("n9_word_text", "SELECT item_id, " + _NO_ARTICLES.format("lower(text)", r"[^\p{L}\p{N}\p{M}_]") + " AS text FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", A.word_text(F.col("text")).alias("text"))


@plan("n25_category_score", """WITH s AS (SELECT conv_id, turn, turn % 5 + 1 AS category FROM conversations)
SELECT conv_id, turn, CASE category WHEN 1 THEN 0.75 WHEN 3 THEN 1.0 WHEN 5 THEN 1.0 ELSE 0.4 END::DOUBLE AS score FROM s""", graph=False)
def _(g):
    """Rendered predictions of each kind of question, whose scores are known."""
    kind = F.col("turn") % 5 + 1
    prediction = F.when(kind == 1, "a red kite, blue sea").when(kind == 5, "That was not mentioned.").otherwise("red kite")
    gold = F.when(kind == 1, "red kite, the sea and sky").when(kind == 3, "Red kite; hawk").otherwise("red sea bird")
    return g.table("conversations").select("conv_id", "turn", F.round(A.category_score(prediction, gold, kind.cast("int")), 4).alias("score"))


@plan("n31_batch_size", "SELECT p_partkey, greatest(1, least(50, CAST(floor((floor(8192 * 0.7) * 4 - 500) / (100 * p_size + 50)) AS INTEGER))) AS n FROM part", graph=False)
def _(g):
    return g.table("part").select("p_partkey", A.batch_size(F.lit(8192), 100 * F.col("p_size") + 50).alias("n"))


@plan("n33_json_repair", "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 5 IN (0, 1) THEN CAST(event_id AS BIGINT) END AS id FROM events", graph=False)
def _(g):
    """Replies with thoughts, fences, cut ends and no JSON at all."""
    kind, own = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("id"))), F.col("event_id") % 5
    cut = F.concat(F.lit('{"kind": "'), F.col("event_type"))
    reply = F.when(own == 0, F.concat(F.lit("<think>{not this}</think>Here:\n```json\n"), kind, F.lit("\n```"))).when(own == 1, F.concat(F.lit("So "), kind, F.lit(" it is"))).when(own == 2, F.concat(cut, F.lit('", "id": '))).when(own == 3, F.concat(cut, F.lit('", "id'))).otherwise(F.lit("I do not know."))
    found = g.table("events").select("event_id", F.from_json(A.repaired_json(reply), "kind string, id long").alias("x"))
    return found.select("event_id", "x.kind", "x.id")


@plan("n34_items", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS n FROM events", graph=False)
def _(g):
    own = F.col("event_id") % 4
    raw = F.when(own == 0, '{"items": [{"a": 1}, "x", {"b": 2}]}').when(own == 1, '{"a": 1}').when(own == 2, '[[{"a": 1}, {"b": 2}], {"c": 3}, 4]').otherwise("nothing")
    return g.table("events").select("event_id", F.size(A.items_of(raw, "entities", "items")).alias("n"))


@plan("n38_expanded_evidence", "SELECT item_id, trim(substr(text, 5, 36)) AS evidence, text AS missing FROM (SELECT item_id, trim(text) AS text FROM benchmark)", graph=False)
def _(g):
    text = F.trim("text")
    cut = F.concat(F.substring(text, 5, 20), F.lit(" ... "), F.substring(text, 20, 21))
    return g.table("benchmark").select("item_id", A.expanded_evidence(cut, text).alias("evidence"), A.expanded_evidence(F.lit("nowhere said ... at all"), text).alias("missing"))


@plan("d19_plain_answer", r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS answer FROM benchmark", graph=False)
def _(g):
    wrapped = F.concat(F.when(F.col("item_id") % 2 == 0, "Based on the knowledge graph, ").otherwise("The graph shows that "), F.col("text"), F.lit(" (sales_expert) [global_expert]"))
    return g.table("benchmark").select("item_id", A.plain_answer(wrapped).alias("answer"))


@plan("d30_surface_variants", "SELECT s_suppkey, len(list_distinct(['supplier:' || s_suppkey, s_name])) * 1 AS n FROM supplier", graph=False)
def _(g):
    subjects = A.surface_variants(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")), F.col("s_name"), F.lit(""), F.col("s_name"))
    objects = A.surface_variants(F.lit(None).cast("string"), F.lit(""))
    return g.table("supplier").select("s_suppkey", (F.size(subjects) * F.size(objects)).cast("long").alias("n"))


@plan("d49_relation_similarity", """AND r AS (SELECT DISTINCT relation FROM kg_triples), w AS (SELECT relation, string_split(lower(replace(relation, '_', ' ')), ' ') AS w FROM r)
SELECT a.relation AS a, b.relation AS b, CASE WHEN a.relation = b.relation THEN 1.0 ELSE round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) END::DOUBLE AS score FROM w a, w b""")
def _(g):
    """Relation names are few: their number is that of the schema's relations."""
    names = g.triples.select("relation").distinct()
    pairs = names.agg(F.collect_set("relation").alias("all")).select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    return pairs.select("a", "b", F.round(A.relation_similarity(F.col("a"), F.col("b")), 6).alias("score"))


@plan("e16_answer_metrics", """WITH a AS (SELECT n_nationkey, n_name, r_name, CASE n_nationkey % 3 WHEN 0 THEN n_name || ' is in ' || r_name WHEN 1 THEN 'It is ' || n_name ELSE 'There is no evidence' END AS answer FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS entity_recall, n_nationkey % 3 = 2 AS abstains, len(string_split(answer, ' ')) AS words FROM a""", graph=False)
def _(g):
    n = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.col("n_nationkey") % 3
    answer = F.when(own == 0, F.concat_ws(" is in ", "n_name", "r_name")).when(own == 1, F.concat(F.lit("It is "), F.col("n_name"))).otherwise("There is no evidence")
    return n.select("n_nationkey", A.mentioned_share(F.array("n_name", "r_name"), answer).alias("entity_recall"), A.abstains(answer).alias("abstains"), F.size(F.split(answer, " ")).cast("long").alias("words"))


@plan("e17_abstention_credit", """SELECT conv_id, turn, CASE WHEN negative AND cue THEN 1.0 ELSE 0.0 END::DOUBLE AS faithfulness, CASE WHEN negative AND cue THEN greatest(1, facts) ELSE facts END AS facts FROM
(SELECT conv_id, turn, role = 'user' AS negative, (' ' || lower(text) || ' ') SIMILAR TO '(.|\n)*( no | not |does not|do not|cannot|can''t|not contain|no evidence|not directly support|unknown)(.|\n)*' AS cue, turn % 3 AS facts FROM conversations WHERE text IS NOT NULL)""", graph=False)
def _(g):
    """A negative question whose answer abstains counts as wholly faithful, on one fact at least."""
    c = g.table("conversations").filter("text is not null")
    credit, facts = (F.col("role") == "user") & A.abstains(F.col("text")), F.col("turn") % 3
    return c.select("conv_id", "turn", F.when(credit, 1.0).otherwise(0.0).alias("faithfulness"), F.when(credit, F.greatest(F.lit(1), facts)).otherwise(facts).alias("facts"))


@plan("d28_string_lists", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM benchmark", graph=False)
def _(g):
    raw = F.when(F.col("item_id") % 3 == 0, F.to_json(F.array("text", F.lit("b")))).when(F.col("item_id") % 3 == 1, F.lit("plain words")).otherwise(F.lit(" "))
    return g.table("benchmark").select("item_id", F.size(A.string_list(raw)).alias("n"))


@plan("s16_probing_questions", "SELECT item_id, CASE item_id % 3 WHEN 2 THEN NULL ELSE 'Why?' END AS question FROM benchmark", graph=False)
def _(g):
    """JSON, Python's notation, and neither."""
    own = F.col("item_id") % 3
    raw = F.when(own == 0, '{"recall": [{"question": "Why?"}]}').when(own == 1, "{'recall': [{'question': 'Why?'}]}").otherwise("unreadable")
    parsed = F.from_json(A.parsed_object(raw), "recall array<struct<question:string>>")
    return g.table("benchmark").select("item_id", F.get(parsed["recall"]["question"], F.lit(0)).alias("question"))
