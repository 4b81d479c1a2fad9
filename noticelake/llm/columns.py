"""Input columns beside an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with every column but the used ones named by its place, so that none clashes with an inner name; ``toDF(*docs.columns)`` undoes it."""
    return docs.toDF(*[c if c in used else f"other_{i}" for i, c in enumerate(docs.columns)])
