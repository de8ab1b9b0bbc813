"""Joins by key: missing keys as keys, checked broadcasts, large keys that Spark can split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it is broadcast (some 50 MB).
BROADCAST_ROWS = 500_000


def beside(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """df with the other side's columns by key; missing keys are keys too. other has one row a key."""
    if not keys:
        return df.crossJoin(F.broadcast(other))
    named = other.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[x for x in other.columns if x not in keys])
    return df.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]), how).drop(*[f"_key{i}" for i in range(len(keys))])


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has max_rows rows at most (they are counted), else as it is. df should be cheap to read twice."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as there are shuffle partitions, by keys that rarely repeat: a narrow table of many rows is one
    split of a file, and one task would do all the work that its rows make. To be called before rows become wide."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
