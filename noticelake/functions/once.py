"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose expressions the optimiser does not copy into what reads them.

    A costly column that a filter or a lambda reads would otherwise be evaluated there again, and
    again for every element. The optimiser does not look through a generator, which costs a row copy.
    """
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.withColumn("__once", held).select(*kept, *[F.col(f"__once.{n}").alias(n) for n in columns])


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
