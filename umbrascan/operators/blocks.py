"""Balanced blocks of an ordered log: written once in order, then numbered without one task per key.

A log is range-partitioned by key and time into blocks of about equal size, however many rows a key has, and written to the
shared folder, so that every later step sees the same blocks even if executors are lost.  Row numbers and running sums
are taken inside blocks; one small row per block gives what came before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "__block"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without the setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="umbrascan-")
    return f"{root.rstrip('/')}/umbrascan-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, order: list[str], name: str = "blocks") -> DataFrame:
    """``df`` written in blocks that follow ``order``, with the block's number; a block's rows are all between its neighbours'."""
    return written(df.repartitionByRange(*order).withColumn(BLOCK, F.spark_partition_id()), name)


def numbered(
    blocks: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], seq: str = "__seq"
) -> DataFrame:
    """Add ``seq``, the row's number from 1 in the order of its key, and running ``sums`` up to and with the row.

    Two passes over the written blocks: local numbers by block, and one row of totals per key and block whose running sums
    are the offsets.  The totals of a key are as few as its blocks.
    """
    local = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumns({seq: F.row_number().over(local)} | {n: F.sum(c).over(run) for n, c in sums.items()})
    names = [seq, *sums]
    totals = blocks.groupBy(*keys, BLOCK).agg(F.count("*").alias(seq), *[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, BLOCK, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names])
    same = [rows[k].eqNullSafe(offsets[k]) for k in [*keys, BLOCK]]
    joined = rows.join(offsets, same)
    return joined.select(
        *[rows[c] for c in blocks.columns if c != BLOCK],
        *[(rows[n] + offsets[f"{n}_before"]).alias(n) for n in names],
    )


def trailing(rows: DataFrame, keys: list[str], seq: str, of: str, window: int, out: str, block: int = 1 << 16) -> DataFrame:
    """Add ``out``: the sum of ``of`` over the last ``window`` rows of the key, the row included.

    Rows are dealt into blocks of equal length by their number; the last ``window`` rows of a block go into the next one as
    well, as its edge, so every block has what it needs and no key or hour is one task's.  Inside a block the trailing sum
    is a running sum less the running sum ``window`` rows before.
    """
    size = max(block, window)
    home = F.floor((F.col(seq) - 1) / size)
    edge = F.pmod(F.col(seq) - 1, F.lit(size)) >= size - window
    placed = rows.withColumns({"__home": home, "__at": F.explode(F.when(edge, F.array(home, home + 1)).otherwise(F.array(home)))})
    order = Window.partitionBy(*keys, "__at").orderBy(seq)
    running = F.sum(of).over(order.rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("__run", running)
    before = F.coalesce(F.lag("__run", window).over(order), F.lit(0))
    out_rows = summed.withColumn(out, F.col("__run") - before).filter(F.col("__at") == F.col("__home"))
    return out_rows.drop("__run", "__home", "__at")
