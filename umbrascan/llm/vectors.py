"""Vectors in shards, queries in blocks, and tasks that meet one block with one shard.

Ids are dealt by hash, so shards are even whatever the vectors are.  The stated queries meet all rows in such tasks:
their number, and what is copied, is (rows / SHARD) * (queries / BLOCK).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrascan.llm.shared import stored

SHARD, BLOCK, LEAST_SHARDS = 4096, 4096, 32


class Dealt(NamedTuple):
    """``data`` (id, v), as many rows as ``n``, ``shards`` and query ``blocks``; the widest vector, and a bound of the inner
    products of different rows: the product of the two largest norms."""

    data: DataFrame
    n: int
    width: int
    largest: float
    shards: int
    blocks: int


def deal(df: DataFrame, key: str, vec: str, each: Column, least_shards: int = LEAST_SHARDS) -> Dealt:
    """Clean vectors, one per id: components ``each`` of ``x``, without null ids, null vectors or bad components.

    Rows that repeat an id count once, with the smallest vector.
    """
    sound = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound)
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("v", F.transform("v", each))
    data = stored(rows, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, width = data.agg(F.count("*"), F.max(F.size("v"))).first()
    norms = [r["s"] ** 0.5 for r in data.select(square.alias("s")).orderBy(F.desc("s")).limit(2).collect()]
    return Dealt(data, n, width or 0, norms[0] * norms[1] if len(norms) > 1 else 0.0, max(least_shards, -(-n // SHARD)), 0)


def with_queries(d: Dealt, of: Column) -> tuple[Dealt, DataFrame]:
    """The rows that are queries (query, asked), and the number of blocks they need."""
    queries = d.data.filter(of).select(F.col("id").alias("query"), F.col("v").alias("asked"))
    return d._replace(blocks=max(1, -(-queries.count() // BLOCK))), queries


def meet(d: Dealt, queries: DataFrame, work, schema: str) -> DataFrame:
    """``work(queries, rows)`` on Arrow tables for every block and shard."""
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = queries.withColumn("block", place("query", d.blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(d.shards - 1))))
    rows = d.data.withColumn("shard", place("id", d.shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(d.blocks - 1))))
    return asked.groupBy("block", "shard").cogroup(rows.groupBy("block", "shard")).applyInArrow(work, schema)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles; a shorter vector's missing components are 0."""
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]
