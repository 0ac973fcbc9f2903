"""Helpers of the llm operators: reading tables, tables written on the way, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    A local session without the setting gets a temporary folder; a cluster without it is an error, as a
    machine-local folder would lose rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: rows and bytes of an Arrow batch while a table is written: batches are held twice by a task, in the JVM and in Python
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to a new folder below the shared one and read back: cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def by_rows(work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], step: int = 256):
    """``mapInArrow`` function that hands ``work`` at most ``step`` rows at a time, to bound a worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield from work(batch.slice(at, step))

    return run


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
