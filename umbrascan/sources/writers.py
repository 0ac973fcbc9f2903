"""Sinks (S5-S7)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CSV_COLUMNS = [
    "timestamp", "api_key", "origin_hash", "raw_preview", "redacted_prompt", "action", "patterns", "latency_ms",
]
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def append_audit(rows: DataFrame, path: str) -> None:
    """Append to the date-partitioned table.  Rows meet by date, and a busy date is split by size, so its number
    of tasks and files follows its rows."""
    rows.hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def replace_dates(rows: DataFrame, path: str) -> None:
    """Overwrite only the dates present in ``rows`` (key rotation, boundary-date purge)."""
    rows.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def purge_to(rows: DataFrame, as_of: dt.datetime, path: str, days: int = 90) -> None:
    """Write the retained rows to a new table path; readers switch when it is complete."""
    from ..operators import audit

    audit.purge(rows, as_of, days).write.mode("errorifexists").partitionBy("dt").parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    """The store's file system and a path in it, whatever store Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def purge_dates(spark: SparkSession, path: str, as_of: dt.datetime, days: int = 90) -> dict[str, list[dt.date]]:
    """Rows older than the cutoff leave the date-partitioned table at ``path``, in place.

    Folders of older dates are dropped as a whole; only the cutoff's own date is rewritten, from a copy in the shared folder;
    files of later dates are not touched.  Returns the dates dropped and rewritten.  A run that was cut short can be
    repeated.  Rows without a date stay.
    """
    from ..operators import blocks

    cutoff = as_of - dt.timedelta(days=days)
    log = spark.read.parquet(path)
    dates = [r["dt"] for r in log.select(F.col("dt").cast("date").alias("dt")).distinct().collect() if r["dt"] is not None]
    old, edge = sorted(d for d in dates if d < cutoff.date()), [d for d in dates if d == cutoff.date()]
    store, _ = _hadoop_path(spark, path)
    for date in old:
        store.delete(_hadoop_path(spark, f"{path}/dt={date.isoformat()}")[1], True)
    if edge:
        at_edge = spark.read.parquet(path).filter(F.col("dt") == F.lit(edge[0]))
        kept = blocks.written(at_edge.filter(F.col("timestamp") >= F.lit(cutoff)), "edge")
        if kept.isEmpty():
            store.delete(_hadoop_path(spark, f"{path}/dt={edge[0].isoformat()}")[1], True)
        else:
            replace_dates(kept, path)
    return {"dropped": old, "rewritten": edge}


def fingerprint_index(log: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """The distinct fingerprints of a log as a table in buckets, so that look-ups need not shuffle the log.

    The table is saved under ``name`` with its files at ``path``; the number of buckets is that of the look-ups' tasks.
    """
    distinct = log.select("redacted_fingerprint").filter("redacted_fingerprint IS NOT NULL").distinct()
    placed = distinct.repartition(buckets, "redacted_fingerprint")
    placed.write.bucketBy(buckets, "redacted_fingerprint").sortBy("redacted_fingerprint").option("path", path).saveAsTable(name)


def csv_view(log: DataFrame) -> DataFrame:
    """The eight export columns: ISO time, JSON-quoted texts, types joined by a pipe."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
    return log.select(
        F.date_format("timestamp", ISO).alias("timestamp"),
        F.col("api_key").cast("string").alias("api_key"),
        "origin_hash",
        quoted("raw_preview").alias("raw_preview"),
        quoted("redacted_prompt").alias("redacted_prompt"),
        "action",
        F.array_join("triggered_patterns", "|").alias("patterns"),
        "latency_ms",
    )


def export_csv(log: DataFrame, path: str) -> None:
    """Header plus rows, many part files."""
    csv_view(log).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_report(cases: DataFrame, metrics: DataFrame, path: str) -> None:
    """Per-case rows and per-label metric rows as two CSV tables."""
    listed = cases.withColumn(
        "detections",
        F.concat(F.lit("["), F.array_join(F.transform("detections", lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]")),
    )
    names = [c for c in ("text", "label", "detections", "block", "latency") if c in listed.columns]
    listed.select(*names).write.mode("errorifexists").option("header", True).option("escape", '"').csv(f"{path}/cases")
    metrics.write.mode("errorifexists").option("header", True).csv(f"{path}/metrics")
