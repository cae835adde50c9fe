"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, its documents in a fixed order, are packed into blocks of one length.  The
mix is a sequence of slots, dealt to output shards; how many slots of each source a shard gets is a
multinomial draw given the sources' totals, made by sending the slots through one pseudorandom
permutation of all of them.  Slot j of a source reads block perm(j mod n) of pass j div n, by a
permutation for each source and pass, so no block is read more than once in a pass.  Blocks are then
joined with the slots by (source, index), and a document takes the words it has in the blocks read.

Permutations are swap-or-not shuffles: exact on any domain size, computed by value, nothing stored.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating.  Together they get 150 %
of all words; none more than twice its own.  Texts that are null or empty have size 0 and take 0.
Rows that share doc_id, or repeat entirely, count each on its own; ties in the order are between
equal rows.  A null doc_id is an id like others.  A text of any length is counted whole and spans as
many blocks as it takes.  An empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import stash

WEIGHTS = (5, 2, 1)
SHARE, MOST_PASSES = 1.5, 2
#: Words of a block: at most the first; fewer for a small source, so that it has about BLOCKS_LEAST.
BLOCK_WORDS, BLOCKS_LEAST = 512, 1024
ROUNDS, SEED = 24, 20240607
SLOTS_AT_ONCE, MOST_TASKS = 1 << 14, 1 << 12
SHARD_SLOTS = 1 << 12
WORD = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, size: Column, *key: Column) -> Column:
    """Place of x in a pseudorandom permutation of 0 .. size - 1, one for each key (swap-or-not shuffle)."""

    def swap(at: Column, turn: Column) -> Column:
        other = F.pmod(F.xxhash64(turn, *key) - at, size)
        return F.when(F.xxhash64(turn, F.greatest(at, other), *key).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(SEED + i).cast("long") for i in range(ROUNDS)]), x.cast("long"), swap)


def source_targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a source: source_size, weight, target.

    Raising a level until the shares sum up stops the sources in the order of size / weight; the one
    cumulative sum in that order gives the level.  The windows see one row a source.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("sid", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.get(cycle, F.col("sid") % len(weights)).cast("double"))
    per = per.withColumn("most", (F.col("source_size") * MOST_PASSES).cast("double"))
    everything = Window.partitionBy()
    lowest_first = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    per = per.withColumns({
        "goal": F.sum("source_size").over(everything) * F.lit(SHARE),
        "stopped": F.sum("most").over(lowest_first) - F.col("most"),
        "open": F.sum("weight").over(everything) - F.sum("weight").over(lowest_first) + F.col("weight"),
    })
    # With all lower sources stopped, the level of the others; the first source above it ends the search.
    per = per.withColumn("level", (F.col("goal") - F.col("stopped")) / F.col("open"))
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("most") / F.col("weight"))).over(everything)
    per = per.withColumn("first_open", first_open)
    level = F.max(F.when((F.col("most") / F.col("weight") == F.col("first_open")), F.col("level"))).over(everything)
    per = per.withColumn("reached", level)
    target = F.least(F.col("most"), F.coalesce(F.col("reached") * F.col("weight"), F.col("most")))
    return per.select(source, "sid", "source_size", "weight", target.alias("target"))


def document_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def plan_mix(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each document the words that the mix takes, and the slots of the mix.

    sizes: doc_id, source, size.  Slots: shard, place, sid, block, pass.
    """
    buckets = max(1, math.isqrt(sizes.count()))
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    in_bucket = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(in_bucket.withColumnRenamed("words", "size"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / BLOCKS_LEAST))).cast("long")
    sources = targets.withColumn("block_words", block)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    # Slots to read: the target in mean blocks, as the last block of a source may be short.
    slots = F.round(F.col("target") * F.col("n_blocks") / F.greatest(F.col("source_size"), F.lit(1)))
    sources = sources.withColumn("n_slots", F.least(slots.cast("long"), F.col("n_blocks") * MOST_PASSES))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("slots_before", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))
    sources = stash(sources.withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy())))

    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / SLOTS_AT_ONCE)))
    dealt = sources.filter("n_slots > 0").select("sid", "n_blocks", "n_slots", "slots_before", "all_slots", chunk.alias("chunk"))
    chunks = sources.agg(F.sum(F.ceil(F.col("n_slots") / SLOTS_AT_ONCE))).first()[0]
    dealt = dealt.repartition(int(min(max(chunks or 1, 1), MOST_TASKS)), F.col("sid"), F.col("chunk"))
    lo = F.col("chunk") * SLOTS_AT_ONCE
    hi = F.least(lo + SLOTS_AT_ONCE, F.col("n_slots")) - 1
    dealt = dealt.select("sid", "n_blocks", "slots_before", "all_slots", F.explode(F.sequence(lo, hi)).alias("slot"))
    dealt = dealt.withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks")))
    index = permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.col("sid"), F.col("pass"))
    place = permuted(F.col("slots_before") + F.col("slot"), F.col("all_slots"))
    slots = dealt.select("sid", "pass", index.alias("block"), place.alias("place"))
    slots = slots.withColumn("shard", F.floor(F.col("place") / SHARD_SLOTS))
    # What is read is what the shards were dealt, so the draw is part of every plan.
    per_shard = slots.groupBy("shard", "sid", "block").agg(F.count("*").alias("times"))
    reads = per_shard.groupBy("sid", "block").agg(F.sum("times").alias("times"))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_bucket.withColumn("bucket_start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.join(sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "block_words"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = starts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start", "sid", "source_size", "target", "block_words")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # Buckets and blocks grow with the input, so neither is broadcast.
    placed = placed.join(starts.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("start", F.col("start") + F.col("bucket_start"))
    placed = placed.select("doc_id", "source", "size", "source_size", "target", "sid", "block_words", "start")

    end = F.col("start") + F.col("size")
    spans = F.sequence(F.floor(F.col("start") / F.col("block_words")), F.floor((end - 1) / F.col("block_words")))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(spans))
    words = F.least(end, (F.col("block") + 1) * F.col("block_words")) - F.greatest(F.col("start"), F.col("block") * F.col("block_words"))
    pieces = pieces.select("doc_id", "source", "size", "source_size", "target", "sid", "block", "start", words.alias("words"))
    read = pieces.join(reads.hint("merge"), ["sid", "block"], "left")
    taken = read.groupBy("doc_id", "source", "size", "source_size", "target", "sid", "start").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    empty = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(*columns).unionByName(empty.select(*columns)), slots.select("shard", "place", "sid", "block", "pass")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken, _ = plan_mix(stash(document_sizes(docs)))
    return taken.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each 0, 1 or 2 times: its share of words taken, rounded by a hash of its id without bias.

    Rows equal in doc_id and text share what they take.  Extra columns, of any name, are carried along.
    """
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("m"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sizes = document_sizes(docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "source", "text"))
    taken, _ = plan_mix(stash(sizes))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / F.lit(1 << 20)
    mean = taken.filter("size > 0").groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias("mean"))
    chosen = mean.select("doc_id.doc_id", "doc_id.mark", F.floor(F.col("mean") + unit).cast("int").alias("times")).filter("times > 0")
    mixed = rows.join(chosen, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")))
    mixed = mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
