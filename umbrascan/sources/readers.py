"""Sources (S1, S2, S4, S8) and the tables a deployment reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CORPUS_SCHEMA = "id string, section string, text string"
FLOW_SCHEMA = "id string, host string, path string, body string"
MAX_TEXT = 100_000


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{id, section, text}`` with a fixed schema (no inference pass)."""
    return spark.read.schema(CORPUS_SCHEMA).json(path)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Captured chat requests, one JSON object per line."""
    return spark.read.schema(FLOW_SCHEMA).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and multi-line quoted text, the shape the CSV export writes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit table; files written before a column existed read as null in that column."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read_relational(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int,
                    properties: dict[str, str] | None = None) -> DataFrame:
    """An audit table held in a relational store, read in parallel ranges of ``column``."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts,
                           properties=properties or {})


def validate(df: DataFrame, text_col: str = "text", max_chars: int = MAX_TEXT) -> tuple[DataFrame, DataFrame]:
    """Texts of 1 to ``max_chars`` characters, and the rest with a reason."""
    reasoned = with_validity(df, text_col, max_chars)
    return reasoned.filter("reason is null").drop("reason"), reasoned.filter("reason is not null")


def with_validity(df: DataFrame, text_col: str = "text", max_chars: int = MAX_TEXT) -> DataFrame:
    size = F.length(text_col)
    reason = (
        F.when(F.col(text_col).isNull(), "missing").when(size < 1, "empty").when(size > max_chars, "too long")
    )
    return df.withColumn("reason", reason)


def union_versions(*tables: DataFrame) -> DataFrame:
    """Older and newer layouts of one table; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def evolve(df: DataFrame, schema: str) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as nulls, in schema order."""
    wanted = df.sparkSession.createDataFrame([], schema)
    return wanted.unionByName(df, allowMissingColumns=True)
