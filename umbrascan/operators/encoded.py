"""Statistics of base64 runs in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ENCODED_RUN
from .scan import decode_run


def run_counts(base: str) -> list[Column]:
    """Number of base64 runs and of runs that are properly padded."""
    runs = F.regexp_extract_all(F.col(base), F.lit(ENCODED_RUN), F.lit(0))
    padded = F.filter(runs, lambda r: decode_run(r).isNotNull())
    return [F.size(runs).cast("long").alias("runs"), F.size(padded).cast("long").alias("padded")]


def readable(base: str, min_decoded: int) -> Column:
    """Number of runs that decode to at least ``min_decoded`` characters."""
    runs = F.regexp_extract_all(F.col(base), F.lit(ENCODED_RUN), F.lit(0))
    return F.size(F.filter(F.transform(runs, decode_run), lambda t: F.length(t) >= min_decoded)).cast("long")
