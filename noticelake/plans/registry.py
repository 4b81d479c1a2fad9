"""All registered queries of the library itself, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticelake.operators.filters import facets
from noticelake.plans import q_aggregates, q_feeds, q_filters, q_models, q_tables
from noticelake.plans.notices import view

_PARTS = (q_filters, q_aggregates, q_tables, q_feeds, q_models)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts of the notice view: entities, category, severity, then every facet in one scan."""
    return facets(view(spark, sf_dir), category="pathogen")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
