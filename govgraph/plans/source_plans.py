"""Source shapes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.traverse import shared_path
from ..sources import files
from .base import plan


@plan("s4_graph_round_trip", "SELECT relation, count(*) AS n, round(sum(confidence), 4) AS total FROM core GROUP BY relation")
def _(g):
    path = shared_path(g.spark)
    files.write_graph(g.entities, g.core, path)
    _, triples = files.load_graph(g.spark, path)
    return triples.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@plan("s9_resume", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0", graph=False)
def _(g):
    docs = g.table("documents").select(F.col("doc_id").alias("document_id"))
    done = docs.filter("document_id % 4 = 0").withColumn("stage", F.lit("extract"))
    return files.unfinished(docs, done, "extract").select(F.col("document_id").alias("doc_id"))


@plan("s15_session_text", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS hash FROM conversations WHERE trim(text) <> '' GROUP BY conv_id", graph=False)
def _(g):
    return files.sessions_as_text(g.table("conversations")).select("conv_id", F.md5("text").alias("hash"))


@plan("s17_context_corpus", "SELECT lang AS title, arg_min(doc_id, doc_id) AS first FROM documents GROUP BY lang", graph=False)
def _(g):
    return g.table("documents").groupBy(F.col("lang").alias("title")).agg(F.min("doc_id").alias("first"))


@plan("s19_usage", "SELECT event_type AS model, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens, count(*) AS calls FROM events GROUP BY 1", graph=False)
def _(g):
    tokens = F.get_json_object("props", "$.k").try_cast("long")
    return g.table("events").groupBy(F.col("event_type").alias("model")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("calls"))


@plan("s20_log_recovery", "SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events", graph=False)
def _(g):
    log = g.table("events").select(F.concat(F.lit("12:00 INFO "), "props", F.lit(" done")).alias("value"))
    return files.recover_json(log, "k int")


@plan("s21_split_by_source", "SELECT source, count(*) AS triples, count(DISTINCT subject) AS subjects FROM kg_triples GROUP BY source")
def _(g):
    return g.triples.groupBy("source").agg(F.count("*").alias("triples"), F.count_distinct("subject").alias("subjects"))
