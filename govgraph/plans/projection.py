"""The graph over the star schema that all registered queries run on, and the same in SQL.

Entities are regions, nations, customers, suppliers and parts; triples come from their keys and from
order lines; facts are dated values of users' events, where a later one supersedes an earlier one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_RELATIONS = {"region": ("IN_REGION", "IN_NATION", "SUPPLIES", "ORDERED"), "brand": ("HAS_TYPE", "SUPPLIES")}


def node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


class Graph:
    """Lazy tables of the projection."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        """id, label, type"""
        parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
        out = None
        for kind, key, name in parts:
            one = self.table(kind).select(node(kind, key).alias("id"), F.col(name).alias("label"), F.lit(kind.capitalize()).alias("type"))
            out = one if out is None else out.unionByName(one)
        return out

    @cached_property
    def triples(self) -> DataFrame:
        """subject, relation, object, confidence, source"""

        def fixed(df: DataFrame, s, relation: str, o, confidence: float, source: str) -> DataFrame:
            return df.select(s.alias("subject"), F.lit(relation).alias("relation"), o.alias("object"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

        nation, customer, supplier, part = map(self.table, ("nation", "customer", "supplier", "part"))
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.round(F.col("l_discount") * 100).cast("long").alias("cents"))
        lines_of = lines.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))

        def measured(df: DataFrame, kind: str, key: str, relation: str) -> DataFrame:
            whole = F.expr("(10000 * count(*) - 100 * sum(cents)) div count(*)")
            per = df.groupBy(key, "l_partkey").agg((whole / F.lit(10000)).cast("double").alias("confidence"))
            return per.select(node(kind, key).alias("subject"), F.lit(relation).alias("relation"), node("part", "l_partkey").alias("object"), "confidence", F.lit("lineitem").alias("source"))

        out = fixed(nation, node("nation", "n_nationkey"), "IN_REGION", node("region", "n_regionkey"), 1.0, "nation")
        for more in (
            fixed(customer, node("customer", "c_custkey"), "IN_NATION", node("nation", "c_nationkey"), 0.95, "customer"),
            fixed(supplier, node("supplier", "s_suppkey"), "IN_NATION", node("nation", "s_nationkey"), 0.9, "supplier"),
            fixed(part, node("part", "p_partkey"), "HAS_TYPE", F.concat(F.lit("type:"), F.col("p_type")), 0.8, "part"),
            measured(lines, "supplier", "l_suppkey", "SUPPLIES"),
            measured(lines_of, "customer", "o_custkey", "ORDERED"),
        ):
            out = out.unionByName(more)
        return out

    @cached_property
    def links(self) -> DataFrame:
        """subject, object of all triples, without their measures: a pair comes as often as lines hold it"""
        of = lambda df, s, o: df.select(s.alias("subject"), o.alias("object"))
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        lines_of = lines.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        out = of(self.table("nation"), node("nation", "n_nationkey"), node("region", "n_regionkey"))
        for more in (
            of(self.table("customer"), node("customer", "c_custkey"), node("nation", "c_nationkey")),
            of(self.table("supplier"), node("supplier", "s_suppkey"), node("nation", "s_nationkey")),
            of(self.table("part"), node("part", "p_partkey"), F.concat(F.lit("type:"), F.col("p_type"))),
            of(lines, node("supplier", "l_suppkey"), node("part", "l_partkey")),
            of(lines_of, node("customer", "o_custkey"), node("part", "l_partkey")),
        ):
            out = out.unionByName(more)
        return out

    @cached_property
    def core(self) -> DataFrame:
        """The triples without the order lines: a small graph for walks."""
        return self.triples.filter(F.col("relation").isin("IN_REGION", "IN_NATION", "HAS_TYPE"))

    @cached_property
    def facts(self) -> DataFrame:
        """seq, subject, relation, object, confidence, source, document_date, superseded_by"""
        from pyspark.sql import Window

        key = Window.partitionBy("subject", "relation")
        facts = self.table("events").select(
            F.col("event_id").alias("seq"),
            node("user", "user_id").alias("subject"),
            F.concat(F.lit("LAST_"), F.upper("event_type")).alias("relation"),
            F.concat(F.lit("v:"), F.floor(F.col("value")).cast("string")).alias("object"),
            ((F.col("event_id") % 100) / F.lit(100.0)).cast("double").alias("confidence"),
            F.lit("events").alias("source"),
            F.col("ts").cast("timestamp_ntz").alias("document_date"),
        )
        latest = F.max(F.struct("document_date", "seq")).over(key)["seq"]
        return facts.withColumn("superseded_by", F.when(latest != F.col("seq"), latest))

    @cached_property
    def domain_entities(self) -> DataFrame:
        """domain_id, entity_id"""
        nation = self.table("nation").select("n_nationkey", node("D:region", "n_regionkey").alias("domain_id"))
        of = lambda t, kind, key, at: self.table(t).join(nation, F.col(at) == F.col("n_nationkey")).select("domain_id", node(kind, key).alias("entity_id"))
        out = self.table("region").select(node("D:region", "r_regionkey").alias("domain_id"), node("region", "r_regionkey").alias("entity_id"))
        out = out.unionByName(nation.select("domain_id", node("nation", "n_nationkey").alias("entity_id")))
        out = out.unionByName(of("customer", "customer", "c_custkey", "c_nationkey")).unionByName(of("supplier", "supplier", "s_suppkey", "s_nationkey"))
        brand = self.table("part").filter("p_size > 10").select(F.concat(F.lit("D:brand:"), F.col("p_brand")).alias("domain_id"), node("part", "p_partkey").alias("entity_id"))
        return out.unionByName(brand)

    @cached_property
    def domains(self) -> DataFrame:
        """domain_id, kind"""
        region = self.table("region").select(node("D:region", "r_regionkey").alias("domain_id"), F.lit("region").alias("kind"))
        return region.unionByName(self.table("part").filter("p_size > 10").select(F.concat(F.lit("D:brand:"), F.col("p_brand")).alias("domain_id"), F.lit("brand").alias("kind")).distinct())

    @cached_property
    def domain_relations(self) -> DataFrame:
        """domain_id, relation: each domain's relation schema"""
        kinds = F.when(F.col("kind") == "region", F.array(*map(F.lit, SCHEMA_RELATIONS["region"]))).otherwise(F.array(*map(F.lit, SCHEMA_RELATIONS["brand"])))
        return self.domains.select("domain_id", F.explode(kinds).alias("relation"))


_MEASURED = "cast((10000 * count(*) - 100 * sum(cast(round(l_discount * 100) AS BIGINT))) // count(*) AS DOUBLE) / 10000"
#: The same tables for the SQL side.
SQL = f"""WITH kg_entities AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'Region' AS type FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'Nation' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'Customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'Part' FROM part),
kg_triples AS (
  SELECT 'nation:' || n_nationkey AS subject, 'IN_REGION' AS relation, 'region:' || n_regionkey AS object, 1.0::DOUBLE AS confidence, 'nation' AS source FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey, 0.95::DOUBLE, 'customer' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey, 0.9::DOUBLE, 'supplier' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'HAS_TYPE', 'type:' || p_type, 0.8::DOUBLE, 'part' FROM part
  UNION ALL SELECT 'supplier:' || l_suppkey, 'SUPPLIES', 'part:' || l_partkey, {_MEASURED}, 'lineitem' FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'customer:' || o_custkey, 'ORDERED', 'part:' || l_partkey, {_MEASURED}, 'lineitem' FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
core AS (SELECT * FROM kg_triples WHERE relation IN ('IN_REGION', 'IN_NATION', 'HAS_TYPE')),
kg_facts0 AS (SELECT event_id AS seq, 'user:' || user_id AS subject, 'LAST_' || upper(event_type) AS relation, 'v:' || cast(floor(value) AS BIGINT) AS object,
    (event_id % 100) / 100.0::DOUBLE AS confidence, 'events' AS source, ts AS document_date FROM events),
kg_facts1 AS (SELECT *, first_value(seq) OVER (PARTITION BY subject, relation ORDER BY document_date DESC, seq DESC) AS latest FROM kg_facts0),
kg_facts AS (SELECT seq, subject, relation, object, confidence, source, document_date, CASE WHEN latest <> seq THEN latest END AS superseded_by FROM kg_facts1),
domain_entities AS (
  SELECT 'D:region:' || r_regionkey AS domain_id, 'region:' || r_regionkey AS entity_id FROM region
  UNION ALL SELECT 'D:region:' || n_regionkey, 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'D:region:' || n_regionkey, 'customer:' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'D:region:' || n_regionkey, 'supplier:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'D:brand:' || p_brand, 'part:' || p_partkey FROM part WHERE p_size > 10),
domains AS (SELECT 'D:region:' || r_regionkey AS domain_id, 'region' AS kind FROM region
  UNION ALL SELECT DISTINCT 'D:brand:' || p_brand, 'brand' FROM part WHERE p_size > 10),
domain_relations AS (SELECT domain_id, unnest(CASE WHEN kind = 'region' THEN ['IN_REGION', 'IN_NATION', 'SUPPLIES', 'ORDERED'] ELSE ['HAS_TYPE', 'SUPPLIES'] END) AS relation FROM domains)
"""
