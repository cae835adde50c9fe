"""Walks over the graph: neighbourhoods, paths, components, ranks, communities.

Loops run on edge tables; each round's frontier or labels are a table in the shared folder, so plans
stay short and survive lost executors.  Only counts and convergence sums come to the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .store import KEY


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary folder only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='govgraph-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/govgraph-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edges(triples: DataFrame) -> DataFrame:
    """a, b: both directions of each distinct pair of ends; loops left out."""
    pairs = triples.select(F.col("subject").alias("a"), F.col("object").alias("b")).filter("a <> b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def reach(triples: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id, distance of nodes up to some hops from the seeds (id): a frontier loop."""
    step = edges(triples)
    seen = frontier = held(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    for hop in range(1, hops + 1):
        following = frontier.join(step, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = held(following.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(triples: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Every triple at a node within the hops: one ring more than the nodes themselves."""
    near = reach(triples, seeds, hops).select("id")
    s = triples.join(near.withColumnRenamed("id", "subject"), "subject", "left_semi").select(*KEY)
    o = triples.join(near.withColumnRenamed("id", "object"), "object", "left_semi").select(*KEY)
    return s.unionByName(o).distinct()


def simple_paths(triples: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 3) -> DataFrame:
    """nodes, hops of simple undirected paths that end at the first target they meet.

    One join a hop; a path carries its nodes.  Paths at a target stop there.
    """
    pairs = triples.select(F.col("subject").alias("a"), F.col("object").alias("b"), "relation")
    step = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation")).filter("a <> b")
    goal = targets.select(F.col("id").alias("tip"), F.lit(True).alias("hit")).distinct()
    open_ = sources.select(F.col("id").alias("tip"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("relations")).distinct()
    done = None
    for hop in range(1, max_hops + 1):
        grown = open_.join(step, F.col("tip") == F.col("a")).filter(~F.array_contains("nodes", F.col("b")))
        grown = grown.select(F.col("b").alias("tip"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"))
        grown = held(grown.join(goal, "tip", "left"))
        found = grown.filter("hit").select("nodes", "relations", F.lit(hop).alias("hops"))
        done = found if done is None else done.unionByName(found)
        open_ = grown.filter("hit is null").drop("hit")
    return done


def depths(links: DataFrame) -> DataFrame:
    """id, depth of messages (id, parent; null at the start of a thread): replies up to the start, or to an unknown parent.

    Each round doubles how far a message has looked up, so rounds grow as the logarithm of the longest thread.
    """
    now = held(links.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while not now.filter("up is not null").isEmpty():
        above = now.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        now = held(now.join(above, "up", "left").select("id", F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return now.select("id", "depth")


def components(triples: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """id, component: the smallest id reachable.  Labels of neighbours, then labels of labels, until nothing changes."""
    step = held(edges(triples))
    ids = step.select(F.col("a").alias("id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select("id"))
    label = held(ids.distinct().withColumn("component", F.col("id")))
    for _ in range(most_rounds):
        near = step.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        better = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = better.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = held(better.join(jump, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component")))
        changed = new.withColumnRenamed("component", "n").join(label, "id").filter("n <> component").limit(1).count()
        label = new
        if not changed:
            break
    return label


def pagerank(triples: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """id, rank: personalized PageRank on the undirected simple graph; unknown seeds are ignored.

    Nothing for no known seed.  Stops at a change below n * tolerance.
    """
    step = held(edges(triples))
    size = step.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    known = size.join(seeds.select("id").distinct().withColumn("seed", F.lit(1.0)), "id", "left")
    start = held(known.select("id", "degree", F.coalesce("seed", F.lit(0.0)).alias("seed")))
    n, n_seeds = start.agg(F.count("*"), F.sum("seed")).first()
    if not n_seeds:
        return start.select("id", F.col("seed").alias("rank")).limit(0)
    start = start.withColumn("seed", F.col("seed") / n_seeds)
    rank = start.withColumn("rank", F.col("seed"))
    for i in range(rounds):
        given = rank.select(F.col("id").alias("a"), (F.col("rank") / F.col("degree")).alias("share")).join(step, "a")
        got = given.groupBy(F.col("b").alias("id")).agg(F.sum("share").alias("got"))
        new = rank.join(got, "id", "left").select("id", "degree", "seed", (alpha * F.coalesce("got", F.lit(0.0)) + (1 - alpha) * F.col("seed")).alias("rank"), F.col("rank").alias("old"))
        new = held(new)
        gap = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new.drop("old")
        if gap < n * tolerance:
            break
    return rank.select("id", "rank")


def _partition(triples: DataFrame, rounds: int, levels: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """names: id, x; member: x, c; step: the communities' edges, packed.  Numbers x follow the order of the ids; their last
    bits, one a round, are a hash of id and round and say when a node may move.  Edges carry hashes that no two ids share."""
    if rounds > 16:
        raise ValueError("at most 16 rounds")
    pairs = held(triples.select(F.col("subject").alias("a"), F.col("object").alias("b")).filter("a <> b"))
    ids = held(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    bits = F.lit(0).cast("long")
    for turn in range(rounds):
        bits += F.when(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0, 1 << turn).otherwise(0)
    seed = 0
    hashed = lambda c: F.xxhash64(F.lit(seed), c)
    while not ids.groupBy(hashed("id")).count().filter("count > 1").isEmpty():
        seed += 1
    names = held(ids.sort("id").select("id", hashed("id").alias("h"), (F.monotonically_increasing_id() * (1 << rounds) + bits).alias("x")))
    n = -(-2 * pairs.count() // size) or 1
    dealt = blocks.from_rows(pairs.select(hashed("a").alias("a"), hashed("b").alias("b")), n)
    member = names.select("x", F.col("x").alias("c"))
    for level in range(levels):
        label, step = blocks.moved(dealt, n, None if level else names, rounds, held)
        label = held(label)
        member = held(member.join(label, "c").select("x", F.col("d").alias("c")))
        if label.filter("c <> d").isEmpty():
            break
        n = -(-(step.agg(F.sum("n")).first()[0] or 0) // size) or 1
        dealt = blocks.from_packed(step, n)
    return names, member, step


def louvain(triples: DataFrame, rounds: int = 8, levels: int = 3, size: int = blocks.SIZE) -> DataFrame:
    """community_id, id: Louvain's method in rounds.  After moves on a level its communities are the next one's nodes, until
    none join.  A community goes by its smallest id.  size: edges of a block."""
    names, member, _ = _partition(triples, rounds, levels, size)
    least = member.groupBy("c").agg(F.min("x").alias("least"))
    of = least.join(names.select(F.col("x").alias("least"), F.col("id").alias("community_id")), "least").select("c", "community_id")
    return member.join(of, "c").join(names, "x").select("community_id", "id")


def louvain_modularity(triples: DataFrame, rounds: int = 8, levels: int = 3, size: int = blocks.SIZE) -> DataFrame:
    """One row: modularity of Louvain's partition of all nodes, from the edges within and between its communities."""
    step = blocks.unpacked(_partition(triples, rounds, levels, size)[2])
    per = step.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("ends"))
    per = per.join(F.broadcast(per.agg(F.sum("ends").alias("m"))))
    return per.agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("ends") / F.col("m"), 2)).alias("modularity"))


def communities(triples: DataFrame, least_size: int = 3, most: int = 40) -> DataFrame:
    """community_id, id, size: the largest communities.  The cap on their number comes before the least size."""
    label = held(louvain(triples))
    sizes = label.groupBy("community_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community_id").limit(most).filter(F.col("size") >= least_size)
    return label.join(sizes, "community_id").select("community_id", "id", "size")


def modularity(triples: DataFrame, member: DataFrame) -> DataFrame:
    """One row: modularity of a partition (community_id, id) of all nodes."""
    step = edges(triples)
    a = member.select(F.col("id").alias("a"), F.col("community_id").alias("ca"))
    b = member.select(F.col("id").alias("b"), F.col("community_id").alias("cb"))
    inside = step.join(a, "a").join(b, "b").filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("inside"))
    total = step.join(a, "a").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("ends"))
    m = step.agg(F.count("*").alias("m"))
    per = total.join(inside, "c", "left").join(F.broadcast(m))
    return per.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("ends") / F.col("m"), 2)).alias("modularity"))
