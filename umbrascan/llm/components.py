"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrascan.llm.shared import stored


#: links in a file of a round's table
LINKS = 1_000_000


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("a"), "m").union(least.select("u", "m")).toDF("u", "v").filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) of any direction -> (node, component) for every linked node; a component is its smallest node.

    Null ends, loops and repeated links don't matter.  Every round is written to the shared folder; rounds grow with the
    logarithm of the longest chain.  A star's centre is a key of joins whose other side has one row per key, so a large
    component is split like any skewed join.
    """
    now = stored(links.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u != v"), "links")
    files = now.count() // LINKS + 1  # later rounds hold about as many, or fewer
    mark = None
    while True:
        now = stored(_small(_large(now)).coalesce(files), "links")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
