"""The registered queries and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.plans import batch, joins, masks, poses, rasters, recordings, runs, small, suite, trajectories, visibility

PLANS = visibility.QUERIES | trajectories.QUERIES | masks.QUERIES | batch.QUERIES | poses.QUERIES | recordings.QUERIES | runs.QUERIES | rasters.QUERIES | joins.QUERIES | suite.QUERIES | small.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.recording_chunks(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
