"""Streams over the events table, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.traverse import shared_path
from ..streaming import streams
from .base import plan


def events(g):
    """The events as four files that arrive one after the other, a micro-batch each."""
    folder = streams.split_in_time(g.table("events"), shared_path(g.spark))
    return streams.read(g.spark, f"{folder}/*.parquet")


@plan("k_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", graph=False)
def _(g):
    out = streams.drain(streams.windows(events(g), "1 hour"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@plan("k_sliding", "AND w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - i * INTERVAL '30 minutes' AS start, event_type FROM events, (SELECT unnest([0, 1]) AS i)) SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def _(g):
    out = streams.drain(streams.windows(events(g), "1 hour", "30 minutes"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@plan("k_sessions", "AND s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k")
def _(g):
    out = streams.drain(streams.sessions(events(g), "6 hours"), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@plan("k2_latest_wins", "SELECT subject, relation, arg_max(seq, {'d': document_date, 's': seq}) AS seq FROM kg_facts GROUP BY 1, 2")
def _(g):
    e = events(g)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    facts = e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"), F.concat(F.lit("LAST_"), F.upper("event_type")).alias("relation"), at.alias("at"), F.col("event_id").alias("seq"))
    return streams.drain(streams.latest(facts), "update", ("subject", "relation")).select("subject", "relation", "seq")


@plan("k5_dedup", "SELECT DISTINCT event_id FROM events", graph=False)
def _(g):
    return streams.drain(streams.deduplicated(events(g))).select("event_id")


def facts(e):
    return e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("subject"), F.concat(F.lit("LAST_"), F.upper("event_type")).alias("relation"), F.concat(F.lit("v:"), F.floor("value").cast("string")).alias("object"), ((F.col("event_id") % 100) / F.lit(100.0)).cast("double").alias("confidence"), F.lit("stream").alias("source"))


@plan("k1_incremental_merge", "AND b AS (SELECT DISTINCT subject, relation, object FROM kg_facts WHERE relation = 'LAST_SIGNUP'), a AS (SELECT DISTINCT subject, relation, object FROM kg_facts WHERE relation <> 'LAST_SIGNUP') SELECT *, 'base' AS source FROM b UNION ALL SELECT *, 'stream' FROM a")
def _(g):
    """Micro-batches merged into a base that has some of their triples: what it has stays, what is new enters once."""
    base = g.facts.filter("relation = 'LAST_SIGNUP'").select("subject", "relation", "object").distinct().withColumns({"confidence": F.lit(1.0), "source": F.lit("base")})
    done = streams.merge_into(facts(events(g)), base, shared_path(g.spark), shared_path(g.spark))
    return done.select("subject", "relation", "object", "source")


@plan("k3_resume", "SELECT count(*) AS n, count(*) AS ids FROM events", graph=False)
def _(g):
    """A stream that stops and starts again on its own checkpoint puts out each event once."""
    out, state, folder = shared_path(g.spark), shared_path(g.spark), shared_path(g.spark)
    early = g.table("events").filter("event_id % 2 = 0")
    streams.split_in_time(early, folder, parts=2)
    read = lambda: streams.read(g.spark, f"{folder}/*.parquet")
    streams.drain(read(), out=out, state=state)
    streams.split_in_time(g.table("events").filter("event_id % 2 = 1"), folder, parts=2)
    done = streams.drain(read(), out=out, state=state)
    return done.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@plan("k4_subscriber", "SELECT event_id FROM events WHERE (event_type <> 'error' AND user_id % 10 = 3) OR (event_type = 'error' AND user_id <> 3)", graph=False)
def _(g):
    """Messages to agent 3, and broadcasts on its topic: errors go to all, others to the last digit of the user."""
    e = events(g)
    to = F.when(F.col("event_type") != "error", (F.col("user_id") % 10).cast("string"))
    sent = e.select("event_id", F.col("user_id").cast("string").alias("sender"), to.alias("recipient"), F.col("event_type").alias("topic"))
    return streams.drain(streams.messages_for(sent, "3", ("error",))).select("event_id")


@plan("k7_usage_log", "SELECT event_type AS model, count(*) AS calls, sum(length(props)) AS tokens FROM events GROUP BY 1", graph=False)
def _(g):
    """Calls appended to a log of JSON lines by a file sink, then read back and added up."""
    out, state = shared_path(g.spark), shared_path(g.spark)
    log = events(g).select(F.col("event_type").alias("model"), F.length("props").alias("prompt_tokens"))
    streams.run_to_end(log.writeStream.format("json").outputMode("append").option("path", out), state)
    back = g.spark.read.schema("model string, prompt_tokens long").json(out)
    return back.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("tokens"))
