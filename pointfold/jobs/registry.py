"""Queries of the library by operator, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointfold.jobs import base, clouds, labels, scene, tracking  # noqa: F401


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.c3_objects(spark, sf_dir)
