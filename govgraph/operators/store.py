"""Storage, hygiene and set operations on triples (subject, relation, object, confidence, source, ...).

Plans stay on built-in functions; joins are equi-joins on the triples' keys that Spark may broadcast
or sort, and every "first" or "best" has a unique tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("subject", "relation", "object")


def active(triples: DataFrame) -> DataFrame:
    """Not superseded; an empty mark counts as none."""
    mark = F.col("superseded_by").cast("string")
    return triples.filter(mark.isNull() | (mark == ""))


def by(triples: DataFrame, **values: str) -> DataFrame:
    for column, value in values.items():
        triples = triples.filter(F.col(column) == value)
    return triples


def confident(triples: DataFrame, least: float) -> DataFrame:
    return triples.filter(F.coalesce("confidence", F.lit(0.0)) >= least)


def first_per(rows: DataFrame, keys: list, *order: Column) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def endpoints(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("subject", "object")).alias("id"))


def conflicts(candidates: DataFrame, base: DataFrame, skip_superseded: bool = True) -> DataFrame:
    """Pairs that share subject and relation with different objects."""
    base = active(base) if skip_superseded and "superseded_by" in base.columns else base
    new = candidates.select("subject", "relation", F.col("object").alias("new_object"), F.col("confidence").alias("new_confidence"))
    old = base.select("subject", "relation", F.col("object").alias("old_object"), F.col("confidence").alias("old_confidence"))
    return new.join(old, ["subject", "relation"]).filter("new_object <> old_object")


def orphan_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """An endpoint is no entity."""
    known = entities.select("id").distinct()
    s = triples.join(known.withColumnRenamed("id", "subject"), "subject", "left_anti")
    o = triples.join(known.withColumnRenamed("id", "object"), "object", "left_anti")
    return s.unionByName(o).distinct()


def orphan_entities(entities: DataFrame, triples: DataFrame) -> DataFrame:
    return entities.join(endpoints(triples).distinct(), "id", "left_anti")


def degree(triples: DataFrame) -> DataFrame:
    """Ends of triples at each node; a loop counts twice."""
    return endpoints(triples).groupBy("id").agg(F.count("*").alias("degree"))


def insert_absent(new: DataFrame, base: DataFrame) -> DataFrame:
    """Triples of new that base has not, each once, the most confident first."""
    fresh = new.join(base.select(*KEY), list(KEY), "left_anti")
    return first_per(fresh, list(KEY), F.desc("confidence"), F.col("source"))


def diff(new: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New triples, and conflicts: a (subject, relation) that base knows only ever conflicts."""
    known = base.select("subject", "relation").distinct()
    fresh = new.join(known, ["subject", "relation"], "left_anti")
    return fresh, conflicts(new, base, skip_superseded=False)


def merge(new: DataFrame, base: DataFrame, strategy: str = "keep_higher_confidence") -> DataFrame:
    """base with new merged in.  On a conflict the strategies keep_existing, keep_new, keep_both and
    keep_higher_confidence decide; a tie keeps the existing one, and null counts as 0."""
    if strategy not in {"keep_existing", "keep_new", "keep_both", "keep_higher_confidence"}:
        raise ValueError(f"no such strategy: {strategy}")
    columns = [*KEY, "confidence", "source"]
    new, base = first_per(new.select(*columns), list(KEY), F.desc("confidence"), F.col("source")), base.select(*columns)
    added = new.join(base.select(*KEY), list(KEY), "left_anti")
    if strategy == "keep_both":
        return base.unionByName(added)
    pair = ["subject", "relation"]
    best = lambda df, name: df.groupBy(*pair).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias(name))
    old, fresh = best(base, "old"), best(added, "fresh")
    if strategy == "keep_existing":
        return base.unionByName(added.join(old, pair, "left_anti"))
    wins = fresh.join(old, pair)
    wins = wins if strategy == "keep_new" else wins.filter("fresh > old")
    stays = base.join(wins.select(*pair), pair, "left_anti")
    enters = added.join(old, pair, "left_anti").unionByName(added.join(wins.select(*pair), pair, "left_semi"))
    return stays.unionByName(enters)


def supersede(facts: DataFrame) -> DataFrame:
    """Facts with superseded_by: the latest one of the same subject and relation, by date and seq."""
    latest = F.max(F.struct("document_date", "seq")).over(Window.partitionBy("subject", "relation"))["seq"]
    return facts.withColumn("superseded_by", F.when(latest != F.col("seq"), latest))


def merge_provenance(refs: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: references once each, the largest confidence and where it comes from, evidence in order."""
    unique = refs.dropDuplicates([*key, "document_id", "char_start", "char_end"])
    return unique.groupBy(*key).agg(
        F.count("*").alias("n_refs"),
        F.max("confidence").alias("confidence"),
        F.max_by("confidence_source", F.struct("confidence", -F.col("seq"))).alias("confidence_source"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"])).alias("evidence"),
    )
