"""Scalar functions, applied to names, texts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .base import plan

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_MONTHS = ", ".join(f"'{m}'" for m in T.MONTHS)
P = r"[!-/:-@\[-`{-~]"
ANSWER = rf"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce(@@, '')), '{P}', '', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
SURFACE = r"trim(regexp_replace(regexp_replace(lower(@@), '[_-]', ' ', 'g'), '\s+', ' ', 'g'))"
TERMS = r"list_distinct(list_filter(regexp_extract_all(lower(replace(@@, '_', ' ')), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN (" + _STOP + ")))"


def _joined(c):
    return F.array_join(F.array_sort(c), ",")


@plan("n1_normalize", r"SELECT item_id, regexp_replace(regexp_replace(trim(lower(text)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g') AS norm FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", T.normalize(F.col("text")).alias("norm"))


@plan("n2_entity_name", r"SELECT id, trim(regexp_replace(regexp_replace(lower(trim(label)), '[-_]+', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM kg_entities")
def _(g):
    return g.entities.select("id", T.normalize_name(F.col("label")).alias("name"))


@plan("n3_matching_key", "SELECT id, regexp_replace(lower(trim(label)), '[^a-z0-9]', '', 'g') AS key FROM kg_entities")
def _(g):
    return g.entities.select("id", T.matching_key(F.col("label")).alias("key"))


@plan("n4_fuzzy_ratio")
def _(g):
    """Names of suppliers that share a nation, at least 0.9 alike."""
    return alike_names(g.table("supplier"))


LEAST_RATIO, SHORT_PAIR = 0.9, 40


def _unmatched(n: int, m: int) -> tuple[int, int] | None:
    """How many characters of strings of n >= m may be unmatched at the least ratio (rounded to 6 digits), by string."""
    most = int((1 - LEAST_RATIO + 1e-6) * (n + m))
    most -= (most - n - m) % 2
    gone = (most + m - n) // 2
    return None if gone < 0 or most < 0 else (gone + n - m, gone)


def _remains(names):
    """g, key, norm: what may be left of a name in common with another of its group, of the lengths that are in the group.

    Names with M matched characters have a common subsequence of M: both leave it when their other characters are deleted.
    """
    from itertools import combinations

    import pandas as pd

    def run(batches):
        for rows in batches:
            out = []
            for g, norm, lengths in zip(rows["g"], rows["norm"], rows["lengths"], strict=True):
                n = len(norm)
                for m in map(int, lengths):
                    gone = _unmatched(max(n, m), min(n, m)) if n + m < SHORT_PAIR else None
                    if gone is None:
                        continue
                    kept = n - gone[0 if n >= m else 1]
                    left = {"".join(c) for c in combinations(norm, kept)} if n - kept != 1 else {norm[:i] + norm[i + 1 :] for i in range(n)}
                    out += [(g, f"{max(n, m)},{min(n, m)},{x}", norm) for x in left]
            yield pd.DataFrame(out, columns=["g", "key", "norm"])

    lengths = names.groupBy("g").agg(F.collect_set(F.length("norm")).alias("lengths"))
    kind = names.schema["g"].dataType.simpleString()
    return names.join(lengths, "g").select("g", "norm", "lengths").mapInPandas(run, f"g {kind}, key string, norm string")


def alike_names(supplier):
    """Pairs of one nation whose names reach 0.9, equal names compared once.

    Of names with under 40 code points together, those that leave one string when as many characters are deleted as the ratio
    allows.  Of longer ones, those that share a padded trigram and are of like length: none that reaches 0.9 does otherwise, as
    of names with S code points together, at most S / 10 are unmatched, in as many gaps, and some matched run has three.
    """
    own = supplier.select("s_suppkey", F.col("s_nationkey").alias("g"), T.normalize(F.col("s_name")).alias("norm")).filter("norm is not null and g is not null")
    names = own.select("g", "norm").distinct()
    keys = _remains(names)
    short = keys.withColumnRenamed("norm", "x").join(keys.withColumnRenamed("norm", "y"), ["g", "key"]).filter("x <> y").select("g", "x", "y").distinct()
    s = names.withColumn("n", F.length("norm")).join(names.groupBy("g").agg(F.max(F.length("norm")).alias("longest")), "g").filter(F.col("n") + F.col("longest") >= SHORT_PAIR)
    s = s.select("g", F.col("norm").alias("x"), "n", T.trigrams(F.col("norm")).alias("grams"))
    o = s.select("g", F.col("x").alias("y"), F.col("n").alias("n2"), F.col("grams").alias("grams2"))
    like = (20 * F.least("n", "n2") >= 9 * (F.col("n") + F.col("n2"))) & F.arrays_overlap("grams", "grams2")
    long = s.join(o, "g").filter((F.col("n") + F.col("n2") >= SHORT_PAIR) & (F.col("x") != F.col("y")) & like).select("g", "x", "y")
    # Few bytes but much work a pair: dealt to all tasks, which the size of the pairs would not do.
    tasks = int(supplier.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rated = short.unionByName(long).repartition(tasks, "x", "y").withColumn("ratio", F.round(T.normal_ratio(F.col("x"), F.col("y")), 6)).filter(F.col("ratio") >= LEAST_RATIO)
    rated = rated.unionByName(names.select("g", F.col("norm").alias("x"), F.col("norm").alias("y"), F.lit(1.0).alias("ratio")))
    side = lambda key, c: own.select("g", F.col("norm").alias(c), F.col("s_suppkey").alias(key))
    both = rated.join(side("s_suppkey", "x"), ["g", "x"]).join(side("other", "y"), ["g", "y"])
    return both.filter("s_suppkey < other").select("s_suppkey", "other", "ratio")


@plan("n5_trigram_cosine", """AND names AS (SELECT DISTINCT p_type AS name FROM part),
grams AS (SELECT DISTINCT name, unnest(list_transform(range(1, length(name) + 3), lambda i: substr('  ' || lower(name) || '  ', i, 3))) AS gram FROM names),
sizes AS (SELECT name, count(*) AS n FROM grams GROUP BY name)
SELECT a.name AS a, b.name AS b, round(count(*) / sqrt(x.n * y.n), 6) AS cosine FROM grams a JOIN grams b ON a.gram = b.gram AND a.name < b.name
JOIN sizes x ON x.name = a.name JOIN sizes y ON y.name = b.name GROUP BY a.name, b.name, x.n, y.n HAVING count(*) / sqrt(x.n * y.n) >= 0.01""")
def _(g):
    names = g.table("part").select(F.col("p_type").alias("name")).distinct()
    return similar_names(names, 0.01)


def similar_names(names, least):
    """Pairs of names by cosine of their distinct trigrams: a join on trigrams blocks by itself."""
    grams = names.select("name", T.trigrams(F.col("name")).alias("grams"))
    one = grams.select(F.col("name").alias("a"), F.size("grams").alias("na"), F.explode("grams").alias("gram"))
    two = grams.select(F.col("name").alias("b"), F.size("grams").alias("nb"), F.explode("grams").alias("gram"))
    both = one.join(two, "gram").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    cosine = F.col("n") / F.sqrt(F.col("na") * F.col("nb"))
    return both.filter(cosine >= least).select("a", "b", F.round(cosine, 6).alias("cosine"))


@plan("n6_query_terms", f"SELECT item_id, array_to_string(list_sort({TERMS.replace('@@', 'text')}), ',') AS terms FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", _joined(T.terms(F.col("text"))).alias("terms"))


@plan("n8_answer", f"SELECT item_id, {ANSWER.replace('@@', 'text')} AS answer FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", T.normalize_answer(F.col("text")).alias("answer"))


@plan("n10_spaced", rf"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '{P}', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", T.normalize_spaced(F.col("text")).alias("norm"))


@plan("n11_trim_marks", r"""SELECT item_id, regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '^[.,;:!?()\[\]{}"'']+|[.,;:!?()\[\]{}"'']+$', '', 'g') AS norm FROM benchmark""", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", T.trim_marks(F.col("text")).alias("norm"))


@plan("n12_surface", f"SELECT id, {SURFACE.replace('@@', 'label')} AS surface FROM kg_entities")
def _(g):
    return g.entities.select("id", T.surface(F.col("label")).alias("surface"))


@plan("n13_quote", r"SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS quote FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", T.quote(F.col("text")).alias("quote"))


@plan("n14_clean_text")
def _(g):
    return g.table("benchmark").select("item_id", T.clean_text(F.col("text")).alias("clean"))


@plan("n15_sentences", r"SELECT doc_id, length(text) - length(regexp_replace(text, '([.!?])\s+', '\1', 'g')) >= 0 AS ok, len(regexp_extract_all(text, '[.!?]\s+')) + 1 AS n_sentences FROM documents", graph=False)
def _(g):
    docs = g.table("documents")
    return docs.select("doc_id", F.col("text").isNotNull().alias("ok"), F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@plan("n16_slug", r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages", graph=False)
def _(g):
    return g.table("pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@plan("n17_value_type", rf"""AND v AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN cast(year(o_orderdate) AS VARCHAR) WHEN 1 THEN cast(o_custkey AS VARCHAR)
  WHEN 2 THEN cast(o_custkey AS VARCHAR) || ' units' WHEN 3 THEN '3 march ' || year(o_orderdate) ELSE o_orderpriority END AS s FROM orders)
SELECT k, CASE WHEN s = '' OR length(s) > 40 THEN NULL WHEN list_has_any(string_split(lower(s), ' '), [{_MONTHS}]) AND regexp_matches(s, '\d') THEN 'DATE'
  WHEN regexp_full_match(lower(s), '(1[0-9]{{3}}|20[0-9]{{2}})(\s*[-/]?\s*\d{{2,4}})?') THEN 'DATE' WHEN regexp_full_match(lower(s), '\d[\d,.]*') THEN 'NUMBER'
  WHEN regexp_full_match(lower(s), '\d[\d,.]*\s?%?\s*[a-z]{{1,15}}') THEN 'QUANTITY' END AS kind FROM v""")
def _(g):
    k, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    custkey = F.col("o_custkey").cast("string")
    s = F.when(k % 5 == 0, year).when(k % 5 == 1, custkey).when(k % 5 == 2, F.concat(custkey, F.lit(" units"))).when(k % 5 == 3, F.concat(F.lit("3 march "), year)).otherwise(F.col("o_orderpriority"))
    return g.table("orders").select(k.alias("k"), T.value_type(s).alias("kind"))


@plan("n20_sentence_containing", r"""AND m AS (SELECT doc_id, text, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: contains(x, 'an')) AS hits FROM documents)
SELECT doc_id, coalesce(hits[1], substr(text, 1, 300)) AS sentence FROM m""")
def _(g):
    hits = F.filter(T.sentences(F.col("text")), lambda x: F.contains(x, F.lit("an")))
    return g.table("documents").select("doc_id", F.coalesce(F.get(hits, 0), F.substring("text", 1, 300)).alias("sentence"))


@plan("n21_verbalize", "SELECT subject, relation, object, replace(subject, '_', ' ') || ' ' || replace(relation, '_', ' ') || ' ' || replace(object, '_', ' ') AS said FROM core")
def _(g):
    return g.core.select("subject", "relation", "object", T.verbalize(*map(F.col, ("subject", "relation", "object"))).alias("said"))


@plan("n22_token_jaccard", """AND t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM t""")
def _(g):
    a, b = (F.array_distinct(F.split(F.lower(c), " ")) for c in ("p_name", "p_type"))
    return g.table("part").select("p_partkey", F.round(T.jaccard(a, b), 6).alias("jaccard"))


_QA = """AND qa AS (SELECT item_id, text AS gold, array_to_string(string_split(text, ' ')[1:1 + item_id % 12], ' ') AS prediction FROM benchmark),
tok AS (SELECT item_id, list_filter(string_split(@P@, ' '), lambda x: x <> '') AS p, list_filter(string_split(@G@, ' '), lambda x: x <> '') AS g FROM qa),
same AS (SELECT item_id, len(p) AS np, len(g) AS ng, list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda z: z = x))))) AS same FROM tok)
""".replace("@P@", ANSWER.replace("@@", "prediction")).replace("@G@", ANSWER.replace("@@", "gold"))


def answers(g):
    """item_id, gold, prediction: the first words of each benchmark text as an answer to it."""
    words = F.split("text", " ")
    return g.table("benchmark").select("item_id", F.col("text").alias("gold"), F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 12 + 1).cast("int")), " ").alias("prediction"))


@plan("n23_token_f1", _QA + "SELECT item_id, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE round(2.0 * coalesce(same, 0) / (np + ng), 6) END AS f1 FROM same")
def _(g):
    return answers(g).select("item_id", F.round(T.token_f1(F.col("prediction"), F.col("gold")), 6).alias("f1"))


@plan("n24_exact_and_substring", f"""AND qa AS (SELECT item_id, text AS gold, array_to_string(string_split(text, ' ')[1:1 + item_id % 12], ' ') AS prediction FROM benchmark),
n AS (SELECT item_id, {ANSWER.replace('@@', 'prediction')} AS p, {ANSWER.replace('@@', 'gold')} AS g FROM qa) SELECT item_id, CASE WHEN p = g THEN 1.0 ELSE 0.0 END AS em, CASE WHEN contains(g, p) THEN 1.0 ELSE 0.0 END AS sub_em FROM n""")
def _(g):
    p, w = T.normalize_answer(F.col("prediction")), T.normalize_answer(F.col("gold"))
    return answers(g).select("item_id", T.exact_match(F.col("prediction"), F.col("gold")).alias("em"), F.when(F.contains(w, p), 1.0).otherwise(0.0).alias("sub_em"))


@plan("n26_clean_prediction", r"""AND a AS (SELECT conv_id, turn, 'Answer: ' || text || ' [1, 2].' AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(trim(regexp_replace(trim(regexp_replace(t, '\[[0-9,\s]+\]', '', 'g')), '^(?i)(the answer is|answer:|short answer:|final answer:)', '')), '\.+$', '') AS cleaned FROM a WHERE NOT contains(t, '"') AND NOT contains(t, '''') AND NOT contains(t, '[Data')""")
def _(g):
    t = g.table("conversations").select("conv_id", "turn", F.concat(F.lit("Answer: "), "text", F.lit(" [1, 2].")).alias("t"))
    t = t.filter(~F.contains("t", F.lit('"')) & ~F.contains("t", F.lit("'")) & ~F.contains("t", F.lit("[Data")))
    return t.select("conv_id", "turn", T.clean_prediction(F.col("t"), F.lit("text")).alias("cleaned"))


@plan("n29_evidence_confidence", """AND t AS (SELECT event_id, value, event_type FROM events WHERE value IS NOT NULL)
SELECT event_id, round(greatest(0.0, least(1.0, 0.4 * ((event_id % 100) / 100.0) + 0.3 * (CASE event_type WHEN 'view' THEN 0.95 WHEN 'click' THEN 0.75 ELSE 0.55 END)
 + 0.3 * ((event_id % 7) / 7.0::DOUBLE) + (CASE event_type WHEN 'signup' THEN 0.10 WHEN 'error' THEN -0.20 ELSE 0.0 END) - 0.05 * least(event_id % 5, 3))), 4) AS confidence FROM t""")
def _(g):
    e, kind = F.col("event_id"), F.col("event_type")
    c = T.evidence_confidence(e % 100 / 100.0, F.when(kind == "view", "explicit").when(kind == "click", "implicit"), e % 7 / 7.0, F.when(kind == "signup", "supported").when(kind == "error", "contradicted"), e % 5)
    return g.table("events").filter("value is not null").select("event_id", F.round(c, 4).alias("confidence"))


@plan("n30_segment_quality", r"""AND s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) AS n FROM s)
SELECT doc_id, count(*) AS n_segments, round(avg(CASE WHEN n BETWEEN 20 AND 200 THEN 1.0 WHEN n >= 5 THEN 0.5 ELSE 0.0 END), 6) AS quality, least(1.0, count(*) / 3.0::DOUBLE) >= 1.0 AS covered FROM c GROUP BY doc_id""")
def _(g):
    lines = g.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = F.size(F.filter(F.split("line", r"\s+"), lambda x: x != ""))
    score = F.when(n.between(20, 200), 1.0).when(n >= 5, 0.5).otherwise(0.0)
    return lines.withColumn("score", score).groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.round(F.avg("score"), 6).alias("quality"), (F.count("*") >= 3).alias("covered"))


@plan("n35_hashes", "SELECT item_id, md5(text) AS id, sha1(text) AS text_hash FROM benchmark", graph=False)
def _(g):
    return g.table("benchmark").select("item_id", F.md5("text").alias("id"), F.sha1("text").alias("text_hash"))


@plan("n36_multi_hop_question", r"SELECT conv_id, turn, regexp_matches(lower(text), '\b(and|then|between|both)\b') AS multi_hop FROM conversations", graph=False)
def _(g):
    return g.table("conversations").select("conv_id", "turn", F.lower("text").rlike(r"\b(and|then|between|both)\b").alias("multi_hop"))


@plan("n40_parse_triples", r"""AND said AS (SELECT subject AS s0, relation AS r0, object AS o0, '(' || subject || ') -[' || relation || ']-> (' || object || ')' AS line FROM core)
SELECT regexp_extract(line, '\(([^)]*)\) -\[([^\]]*)\]-> \(([^)]*)\)', 1) AS subject, regexp_extract(line, '\(([^)]*)\) -\[([^\]]*)\]-> \(([^)]*)\)', 2) AS relation, regexp_extract(line, '\(([^)]*)\) -\[([^\]]*)\]-> \(([^)]*)\)', 3) AS object FROM said""")
def _(g):
    line = g.core.select(F.format_string("(%s) -[%s]-> (%s)", "subject", "relation", "object").alias("line"))
    pattern = F.lit(r"\(([^)]*)\) -\[([^\]]*)\]-> \(([^)]*)\)")
    found = F.arrays_zip(*(F.regexp_extract_all("line", pattern, i).alias(c) for i, c in enumerate(("subject", "relation", "object"), 1)))
    return line.select(F.explode(found).alias("t")).select("t.subject", "t.relation", "t.object")


@plan("p10_generic_reference", """AND c AS (SELECT conv_id, turn, lower(array_to_string(string_split(trim(text), ' ')[1:2], ' ')) AS s FROM conversations)
SELECT conv_id, turn, s = '' OR s IN (%s) OR (regexp_matches(s, '^(%s)') AND regexp_matches(regexp_extract(s, '^\\S* (.*)$', 1), '^(%s)')) AS generic FROM c""" % (", ".join(f"'{w}'" for w in T.PRONOUNS + T.GENERIC_WORDS), "|".join(T.GENERIC_LEADS), "|".join(T.GENERIC_WORDS)))
def _(g):
    s = F.array_join(F.slice(F.split(F.trim("text"), " "), 1, 2), " ")
    return g.table("conversations").select("conv_id", "turn", T.generic_reference(s).alias("generic"))


@plan("p14_degenerate_pair", rf"""AND t AS (SELECT p_partkey, p_name AS s, p_type AS o FROM part), n AS (SELECT p_partkey, {SURFACE.replace('@@', 's')} AS s, {SURFACE.replace('@@', 'o')} AS o FROM t),
m AS (SELECT p_partkey, s, o, CASE WHEN len(string_split(s, ' ')) <= len(string_split(o, ' ')) THEN s ELSE o END AS x, CASE WHEN len(string_split(s, ' ')) <= len(string_split(o, ' ')) THEN o ELSE s END AS y FROM n)
SELECT p_partkey, s = o OR (len(string_split(x, ' ')) >= 2 AND contains(' ' || y || ' ', ' ' || x || ' ')) AS degenerate FROM m""")
def _(g):
    return g.table("part").select("p_partkey", T.degenerate_pair(F.col("p_name"), F.col("p_type"), F.lit("RELATED")).alias("degenerate"))


@plan("p16_literal_conflict", r"""AND n AS (SELECT s_suppkey, regexp_extract_all(s_name, '\d+') AS a, regexp_extract_all(cast(s_nationkey AS VARCHAR), '\d+') AS b FROM supplier)
SELECT s_suppkey, len(a) > 0 AND len(b) > 0 AND a <> b AS conflict FROM n""")
def _(g):
    return g.table("supplier").select("s_suppkey", T.literal_conflict(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("conflict"))
