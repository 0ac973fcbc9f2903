"""Joins with a side of one row per key whose other side may hold most of its rows under a few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key is hot with over 1 / HOT of all rows, so that at most HOT keys are; their rows are dealt over SALTS tasks each
HOT, SALTS = 1000, 64


def hot_keys(df: DataFrame, on: str) -> list:
    """Keys that hold over ``1 / HOT`` of the rows (and over HOT rows): at most HOT of them, at any size."""
    total = df.count()
    counted = df.groupBy(on).count().filter(F.col(on).isNotNull() & (F.col("count") > max(HOT, total // HOT)))
    return [r[on] for r in counted.collect()]


def join_hot(left: DataFrame, right: DataFrame, on: str, spread: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``on``; ``left`` is read twice, so it should be a stored table.

    Rows of hot keys are dealt over SALTS tasks by a hash of the column ``spread``, and the few rows of ``right`` that they
    meet are repeated as often.  ``on`` must not be null in ``left``, as null keys would meet in one task.
    """
    hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, how)
    is_hot = F.col(on).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = left.withColumn("__salt", salt)
    return salted.join(right.withColumn("__salt", F.explode(copies)), [on, "__salt"], how).drop("__salt")
