"""From raw documents to token ids: five stages, each written and read again as the next one's input.

quality rules -> line dedup -> MinHash near-dedup -> mixing sources -> byte-level BPE.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govgraph.llm import bpe, line_dedup, mixing, near_dup, quality
from govgraph.llm.work import BATCH_BYTES as BATCH_BYTES
from govgraph.llm.work import small_batches, stash
from govgraph.session import reachable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def prepared(spark: SparkSession) -> None:
    """What a stage needs of its session: the package on the workers, and batches of whole texts that stay small."""
    reachable(spark)
    small_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    prepared(spark)
    return quality.quality_rules(docs, keep=COLUMNS, only_kept=True)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that had nothing else; n_chars follows the text."""
    prepared(spark)
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    done = done.filter((F.col("__n_removed") == 0) | (F.regexp_count("text", F.lit(mixing.WORD)) > 0))
    return done.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    prepared(spark)
    return near_dup.drop_near_duplicates(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepared(spark)
    return mixing.mix_documents(docs.select(*COLUMNS))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    prepared(spark)
    encoded = bpe.encode_documents(docs, keep=("doc_id", "lang", "source", "text"))
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: Edit joins, similarity joins and BPE are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs)
    return docs
