"""Sharding by weighted rendezvous hashing of stable keys, in DataFrame functions only.

Every key draws one exponential waiting time per shard, ``-ln(u) / weight`` with ``u`` hashed from
key and shard, and goes to the shard that comes first. Another shard can only win keys over for
itself, so growing by one moves about ``weight / total`` of the rows and moves them nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticelake.llm.columns import aside

#: Rows of a shard that are numbered together, in one sort that may spill.
SLOT_ROWS = 1_000_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. A null key counts as one fixed key; zero weights take no rows."""
    name = F.coalesce(key.cast("string"), F.lit("\0null"))
    draws = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        # 52 hashed bits, moved half a step off zero, are exact in a double
        u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)
        draws.append(F.struct((-F.log(u) / float(weight)).alias("wait"), F.lit(shard).alias("shard")))
    if not draws:
        raise ValueError("no shard has a positive weight")
    return F.array_min(F.array(*draws))["shard"]


def slots(df: DataFrame, shard: str, key: str, out: str = "slot", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Numbers the rows of every shard from 0 without gaps and without sorting a whole shard.

    Rows are numbered inside hashed parts of a shard, at least 256 and as many as its counted size
    asks for; the parts' counts are summed up and added. Rows go by key and then by a hash of the
    whole row, so that a task that runs again gives the same slots; wholly equal rows share a part
    and are the same in any order. Null keys come last. A column named ``out`` is replaced.
    """
    part, within, base = "__part", "__within", "__base"
    held = [c for c in df.columns if c != out]
    df = aside(df.select(*[F.col(f"`{c}`") for c in held]), shard, key)
    whole = [F.col(f"`{c}`") for c in df.columns]
    most = df.groupBy(shard).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    parts = max(256, -(-most // slot_rows))
    # the second hash spreads rows that repeat one key; it is of the whole row
    rows = df.select(*whole, F.pmod(F.xxhash64(F.lit(17), *whole), F.lit(parts)).cast("int").alias(part))
    counts = rows.groupBy(shard, part).count()
    before = W.partitionBy(shard).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(shard, part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    order = W.partitionBy(shard, part).orderBy(F.col(f"`{key}`").asc_nulls_last(), F.xxhash64(F.lit(29), *whole))
    numbered = rows.withColumn(within, F.row_number().over(order) - 1)
    joined = numbered.join(bases, [shard, part])
    return joined.select(*whole, (F.col(base) + F.col(within)).cast("long")).toDF(*held, out)


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """Adds the shard of every row under the given weights. Other columns pass through."""
    return df.withColumn(shard, rendezvous(F.col(f"`{key}`"), weights))
