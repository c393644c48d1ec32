"""All registered queries: name → Spark callable ``(spark, sf_dir) -> DataFrame`` and SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newslens.plans import daily_run, dashboard, density, enrichment, texts

_MODULES = (dashboard, texts, enrichment, daily_run, density)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.SPARK)
    return out


def oracle_queries() -> dict[str, str]:
    out: dict = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
