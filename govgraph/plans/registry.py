"""All queries of the engine proper, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import aggregate_plans, answer_plans, curation_plans, evaluation_plans, filter_plans, governance_plans, graph_plans, hygiene_plans, join_plans, record_plans, retrieval_plans, scoring_plans, source_plans, state_plans, streaming_plans, text_plans, value_plans, window_plans  # noqa: F401
from .base import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["g1_routing_summary"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
