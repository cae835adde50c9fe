"""From a question to facts: names in texts, rings around them, retrieval modes, coverage.

Questions and seeds are bounded by what a user asks; graphs are tables.  Every list that is cut has a unique order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import traverse
from .store import KEY, first_per
from .vectors import normalized

MODES = ("chunk", "triple", "hybrid", "graph_completion", "graph_summary", "community")
MOST_SEEDS, MOST_EVIDENCE, MOST_EXPLORED, MOST_NEIGHBOURS, MOST_DOMAINS, COMPRESS_FROM = 10, 80, 20, 15, 4, 40


def mode(name: str, strict: bool = False) -> str:
    """A retrieval mode by name; an unknown one is hybrid, or an error where a configuration says it."""
    if name not in MODES and strict:
        raise ValueError(f"no such mode: {name}")
    return name if name in MODES else "hybrid"


def named_in(texts: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """key, id: entities whose normalized name (label, or id without its underscores) stands in a text (key, text).

    Names and texts meet on the names' first words, so only names that may be there are compared; a name counts
    wherever it begins, as part of a word too, when its first word ends one there.
    """
    name = F.explode(F.array_distinct(F.array(T.normalize_name(F.col("label")), T.normalize_name(F.replace("id", F.lit("_"), F.lit(" "))))))
    names = entities.select("id", name.alias("name")).filter(F.length("name") >= least).withColumn("word", F.substring_index("name", " ", 1))
    said = texts.select("key", T.normalize_name(F.col("text")).alias("said"))
    words = said.select("key", "said", F.explode(F.array_distinct(F.split("said", " "))).alias("word"))
    whole = words.join(names, "word").filter(F.contains("said", F.col("name")))
    return whole.select("key", "id").distinct()


def named_anywhere(texts: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """The same inside words too: texts and names meet on the names' first ``least`` characters, wherever those stand."""
    name = F.explode(F.array_distinct(F.array(T.normalize_name(F.col("label")), T.normalize_name(F.replace("id", F.lit("_"), F.lit(" "))))))
    names = entities.select("id", name.alias("name")).filter(F.length("name") >= least).withColumn("gram", F.substring("name", 1, least))
    said = texts.select("key", T.normalize_name(F.col("text")).alias("said")).filter(F.length("said") >= least)
    grams = said.select("key", "said", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("said") - least + 1), lambda i: F.substring(F.col("said"), i, least)))).alias("gram"))
    return grams.join(names, "gram").filter(F.contains("said", F.col("name"))).select("key", "id").distinct()


def relevant_evidence(text: DataFrame, entities: DataFrame, triples: DataFrame, hops: int = 2, most: int = MOST_EVIDENCE) -> DataFrame:
    """Triples within some hops of the entities that a question and its answer (key, text) name, the first by their parts."""
    seeds = named_anywhere(text, entities).select("id").distinct()
    return traverse.neighbourhood(triples, seeds, hops).orderBy(*KEY).limit(most)


def fuzzy_resolved(names: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """name, id: by letters and digits; what is left, where one normalized name holds the other (``least`` characters and more)."""
    labels = entities.select("id", T.matching_key(F.col("label")).alias("k"), T.normalize_name(F.col("label")).alias("n"))
    keyed = names.select("name", T.matching_key(F.col("name")).alias("k"), T.normalize_name(F.col("name")).alias("m"))
    equal = keyed.filter("k <> ''").join(labels.select("id", "k"), "k").select("name", "id")
    left = keyed.join(equal.select("name").distinct(), "name", "left_anti").filter(F.length("m") >= least)
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - least + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, least)))).alias("gram")
    long_ = labels.filter(F.length("n") >= least)
    inside = left.select("name", "m", F.substring("m", 1, least).alias("gram")).join(long_.select("id", "n", grams("n")), "gram").filter(F.contains("n", F.col("m")))
    around = left.select("name", "m", grams("m")).join(long_.select("id", "n", F.substring("n", 1, least).alias("gram")), "gram").filter(F.contains("m", F.col("n")))
    return equal.unionByName(inside.select("name", "id")).unionByName(around.select("name", "id")).distinct()


def explored(resolved: DataFrame, done: DataFrame, triples: DataFrame, most_names: int = 2, most: int = MOST_EXPLORED) -> DataFrame:
    """key, subject, relation, object: for each key the first names not explored yet (id, pos), and of each triples at it."""
    fresh = resolved.join(done.select("id"), "id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("pos", "id"))
    return around(fresh.withColumn("r", rank).filter(F.col("r") <= most_names).select("key", "id"), triples, most)


def around(seeds: DataFrame, triples: DataFrame, most: int = MOST_NEIGHBOURS) -> DataFrame:
    """key, id, subject, relation, object: up to ``most`` triples at each seed (key, id), by their parts."""
    s = seeds.join(triples.select(*KEY), F.col("id") == F.col("subject"))
    o = seeds.join(triples.select(*KEY), F.col("id") == F.col("object"))
    rank = F.row_number().over(Window.partitionBy("key", "id").orderBy(*KEY))
    return s.unionByName(o).distinct().withColumn("r", rank).filter(F.col("r") <= most).drop("r")


def pairwise_context(matched: DataFrame, triples: DataFrame, hops: int = 2) -> DataFrame:
    """a, b, nodes, hops: simple paths between any two of a question's entities (id): each from the smaller id."""
    paths = traverse.simple_paths(triples, matched, matched, hops)
    ends = paths.select(F.element_at("nodes", 1).alias("a"), F.element_at("nodes", -1).alias("b"), "nodes", "hops")
    return ends.filter("a < b").distinct()


def coverage(question: DataFrame, answer: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """key, coverage: of the triples at entities that a question names, the share with an end that its answer names; 0.5
    where it names none.  question, answer: key, text."""
    asked = named_anywhere(question, entities)
    at = asked.join(triples.select(*KEY), F.col("id") == F.col("subject")).unionByName(asked.join(triples.select(*KEY), F.col("id") == F.col("object"))).drop("id").distinct()
    said = named_anywhere(answer, entities).distinct()
    s = said.select("key", F.col("id").alias("subject"), F.lit(True).alias("has_s"))
    o = said.select("key", F.col("id").alias("object"), F.lit(True).alias("has_o"))
    share = at.join(s, ["key", "subject"], "left").join(o, ["key", "object"], "left").groupBy("key").agg(F.avg(F.when(F.coalesce("has_s", "has_o", F.lit(False)), 1.0).otherwise(0.0)).alias("share"))
    named = asked.select("key").distinct().withColumn("named", F.lit(True))
    return question.select("key").distinct().join(named, "key", "left").join(share, "key", "left").select("key", F.when(F.col("named").isNull(), 0.5).otherwise(F.coalesce("share", F.lit(0.0))).alias("coverage"))


def chunk_mode(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """id, score: the dense order as it is; the lexical one only where there is no dense hit."""
    none = dense.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(1).alias("__none"))
    fallback = lexical.join(F.broadcast(none)).select("id", "score")
    return dense.select("id", "score").unionByName(fallback).orderBy(F.desc("score"), "id").limit(k)


def graph_completion(scored: DataFrame, triples: DataFrame, hops: int = 1, most_seeds: int = MOST_SEEDS, most: int = 20) -> DataFrame:
    """subject, relation, object, score: scores (collection, id, score) to 0 .. 1 by collection, the best of each entity
    as a seed, triples around the best seeds, ranked by the larger score of their ends."""
    fused = normalized(scored).groupBy("id").agg(F.max("score").alias("score"))
    seeds = fused.orderBy(F.desc("score"), "id").limit(most_seeds)
    near = traverse.neighbourhood(triples, seeds, hops)
    end = lambda c: fused.select(F.col("id").alias(c), F.col("score").alias(f"__{c}"))
    rated = near.join(end("subject"), "subject", "left").join(end("object"), "object", "left")
    best = F.greatest(F.coalesce("__subject", F.lit(0.0)), F.coalesce("__object", F.lit(0.0)))
    return rated.select(*KEY, F.round(best, 6).alias("score")).orderBy(F.desc("score"), *KEY).limit(most)


def graph_summary(facts: DataFrame, compress: Callable[[DataFrame], DataFrame] | None = None, above: int = COMPRESS_FROM) -> DataFrame:
    """facts as they are, or what ``compress`` makes of them if there are more than ``above``."""
    if compress is None or facts.limit(above + 1).count() <= above:
        return facts
    return compress(facts)


def community_context(communities: DataFrame, query: str, k: int = 3, hits: DataFrame | None = None) -> DataFrame:
    """line: titles and summaries of the k communities (community_id, title, summary) of the vector hits (id, score), or,
    without any, those that hold most of the query's words of three characters and more."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 2]
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    overlap = F.size(F.filter(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), lambda w: F.contains(text, w)))
    lexical = communities.withColumn("score", overlap.cast("double")).filter("score > 0")
    chosen = lexical
    if hits is not None and not hits.isEmpty():
        chosen = communities.join(hits.select(F.col("id").alias("community_id"), "score"), "community_id")
    top = chosen.orderBy(F.desc("score"), F.desc("community_id")).limit(k)
    return top.filter("summary <> '' or title <> ''").select("community_id", F.concat(F.lit("["), F.coalesce("title", F.col("community_id").cast("string")), F.lit("] "), F.coalesce("summary", F.lit(""))).alias("line"))


def target_domains(wanted: DataFrame, known: DataFrame, most: int = MOST_DOMAINS) -> DataFrame:
    """key, domain_id, pos: each key's known domains once, the first few; the first known one where none is left."""
    every = wanted.select("key").distinct()
    once = first_per(wanted.join(known.select("domain_id"), "domain_id", "left_semi"), ["key", "domain_id"], F.col("pos"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("pos", "domain_id"))
    kept = once.withColumn("r", rank).filter(F.col("r") <= most).select("key", "domain_id", (F.col("r") - 1).alias("pos"))
    default = known.agg(F.min("domain_id").alias("domain_id"))
    rest = every.join(kept.select("key").distinct(), "key", "left_anti").join(F.broadcast(default)).select("key", "domain_id", F.lit(0).alias("pos"))
    return kept.unionByName(rest)


def focused(texts: DataFrame, triples: DataFrame, most: int = 50) -> DataFrame:
    """key, subject, relation, object, score: triples whose words a question (key, text) holds most of."""
    words = texts.select("key", F.explode(T.terms(F.col("text"))).alias("term"))
    said = triples.select(*KEY, F.explode(T.terms(T.verbalize(F.col("subject"), F.col("relation"), F.col("object")))).alias("term"))
    hits = words.join(said, "term").groupBy("key", *KEY).agg(F.count("*").alias("score"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), *KEY))
    return hits.withColumn("r", rank).filter(F.col("r") <= most).drop("r")


def verdict(strict: Column, path: Column, entailed: Column) -> Column:
    """The first tier that supports a fact, with its number; else what the last tier says."""
    return F.when(strict == "supported", F.struct(F.lit(1).alias("tier"), strict.alias("verdict"))).when(path == "supported", F.struct(F.lit(2).alias("tier"), path.alias("verdict"))).otherwise(F.struct(F.lit(3).alias("tier"), F.coalesce(entailed, F.lit("unverifiable")).alias("verdict")))


