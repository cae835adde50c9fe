"""Vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, query: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """id, score of the k vectors most like the one query (a single row, column q); the floor comes after the k."""
    scored = vectors.join(F.broadcast(query)).select("id", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score"))
    top = scored.filter("score is not null").orderBy(F.desc("score"), "id").limit(k)
    return top if floor is None else top.filter(F.col("score") >= floor)


def fuse(rankings: dict[float, DataFrame] | list[tuple[float, DataFrame]], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (id, rank from 0) with weights."""
    out = None
    for weight, ranking in rankings if isinstance(rankings, list) else list(rankings.items()):
        one = ranking.select("id", (F.lit(float(weight)) / (k + F.col("rank") + 1)).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.round(F.sum("part"), 8).alias("score"))


def ranked(scored: DataFrame, *order: Column) -> DataFrame:
    """id, rank from 0 of a list that is already short (top-k)."""
    return scored.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def normalized(scored: DataFrame) -> DataFrame:
    """Scores to 0 .. 1 within a collection; 1 where they are all the same."""
    own = Window.partitionBy("collection")
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    return scored.withColumn("score", F.when(hi - lo < 1e-9, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def changed(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (id, text) of new whose text the store (id, text_hash) has not, with their hash: what an upsert embeds."""
    new = new.withColumn("text_hash", F.sha1("text"))
    known = stored.select("id", F.col("text_hash").alias("known"))
    return new.join(known, "id", "left").filter("known is null or known <> text_hash").drop("known")


def hashed_trigrams(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding: trigram counts by hash, never all zero."""
    from ..functions.text import trigrams

    slots = F.transform(trigrams(text), lambda x: F.pmod(F.xxhash64(x), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))
    return F.when(F.size(slots) == 0, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (i == 0).cast("float"))).otherwise(counts)
