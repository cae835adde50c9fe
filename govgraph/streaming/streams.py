"""Structured Streaming forms: latest-wins supersession, event-time windows, idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """A stream of the parquet files at a path; a single file is a stream of one."""
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name)
    return source.parquet(folder)


def messages_for(messages: DataFrame, agent: str, topics: tuple[str, ...] = ()) -> DataFrame:
    """What a subscriber gets of a stream or table of messages (id, sender, recipient, topic, reply_to, text): those to it,
    and broadcasts (no recipient) of others on its topics; without topics, on all."""
    own = F.col("recipient") == agent
    wide = F.col("recipient").isNull() & (F.col("sender") != agent)
    return messages.filter(own | (wide & F.col("topic").isin(*topics) if topics else own | wide))


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windows(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows."""
    return timed(events).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def latest(facts: DataFrame) -> DataFrame:
    """Changes of the current value of each (subject, relation): an older fact never replaces a newer one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (-1, -1)
        best, seen = held, []
        for rows in batches:
            for at, seq in zip(rows["at"].tolist(), rows["seq"].tolist(), strict=True):
                seen.append((at, seq))
        for one in sorted(seen):
            best = max(best, one)
        state.update(best)
        if best != held:
            yield pd.DataFrame({"subject": [key[0]], "relation": [key[1]], "seq": [best[1]], "superseded": [None if held[1] < 0 else held[1]]}).astype({"superseded": "Int64"})

    return facts.groupBy("subject", "relation").applyInPandasWithState(run, "subject string, relation string, seq long, superseded long", "at long, seq long", "update", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = (), out: str | None = None, state: str | None = None) -> DataFrame:
    """Run a stream over what there is now and return its result, for batch use.

    In ``complete`` mode the last batch is the result; in ``update`` mode the last row of each of the ``keys``; in
    ``append`` mode all rows.  A batch that runs again after a restart (same ``out`` and ``state``) overwrites its own folder.
    """
    spark = stream.sparkSession
    from ..operators.traverse import shared_path

    out, state = out or shared_path(spark), state or shared_path(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_to_end(stream.writeStream.outputMode(mode).foreachBatch(put), state)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.filter(F.col("batch") == F.lit(last))
    elif mode == "update":
        if not keys:
            raise ValueError("the keys of an updating stream are needed")
        whole = F.struct(*rows.columns)
        rows = rows.groupBy(*keys).agg(F.max_by(whole, "batch").alias("row")).select("row.*")
    return rows.drop("batch")


def run_to_end(writer, state: str) -> None:
    query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def merge_into(stream: DataFrame, base: DataFrame, out: str, state: str) -> DataFrame:
    """base with the stream's triples (subject, relation, object, confidence, source) merged in, batch after batch.

    Of each batch, triples that neither base nor an earlier batch has enter, each once.  What a batch adds is a folder of
    its own, so running it again replaces what it added and nothing else.
    """
    from ..operators.store import KEY, insert_absent

    spark, columns = stream.sparkSession, [*KEY, "confidence", "source"]
    schema = stream.select(*columns).schema

    def added(before: int | None = None) -> DataFrame:
        """What batches have added; earlier ones only, if a number is given."""
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
        return (rows if before is None else rows.filter(F.col("batch") < before)).select(*columns)

    def put(batch: DataFrame, number: int) -> None:
        known = base.select(*KEY).unionByName(added(number).select(*KEY))
        insert_absent(batch.select(*columns), known).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_to_end(stream.writeStream.outputMode("append").foreachBatch(put), state)
    return base.select(*columns).unionByName(added())


def split_in_time(rows: DataFrame, path: str, at: str = "ts", parts: int = 4) -> str:
    """The rows as files that arrive one after the other, each a later stretch of time."""
    cuts = rows.select(F.unix_micros(F.col(at).cast("timestamp")).alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if lo is None else rows.filter(t > lo)
        (part if hi is None else part.filter(t <= hi)).coalesce(1).write.mode("append").parquet(path)
    return path
