"""Exact top-k search by distributed histogram selection.

All scores are integers.  Each pass scores every query against every row and counts scores per bin of the query's
current interval; summed over all shards, the counts show the bin that holds the k-th highest score, which is the next
interval.  When bins are one wide, the k-th value is known exactly.  A last pass keeps scores at or above it and breaks
ties by id.  A shard reports only its top bins down to its own k-th score, and at most k rows in the last pass: no other
row of it can be among the k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbrascan.llm.shared import stored
from umbrascan.llm.vectors import best, deal, matrix, meet, with_queries

BINS, ROWS = 1024, 256
#: bound of the product of the two largest norms, below which all scores and their partial sums are exact in 64 bits
MOST = 2.0**61


def _scores(asked: pa.Table, rows: pa.Table, width: int, exact: bool):
    """Slices of queries with their scores; a query's own row scores below everything."""
    ids, data = np.asarray(rows["id"]), matrix(rows["v"], width)
    queries, names = matrix(asked["asked"], width), np.asarray(asked["query"])
    if not exact:
        data, queries = data.astype(np.int64), queries.astype(np.int64)
    for at in range(0, len(names), ROWS):
        part = slice(at, at + ROWS)
        scores = (queries[part] @ data.T).astype(np.int64)
        scores[names[part][:, None] == ids] = np.iinfo(np.int64).min
        yield part, names[part], ids, scores


def _histogram(width: int, exact: bool, k: int, step: int):
    def run(asked, rows):
        out = []
        low, high = np.asarray(asked["lo"]), np.asarray(asked["hi"])
        if rows.num_rows:
            for part, names, _, scores in _scores(asked, rows, width, exact):
                lo, hi = low[part][:, None], high[part][:, None]
                inside = (scores >= lo) & (scores < hi)
                cell = np.where(inside, (np.where(inside, scores, lo) - lo) // step, BINS) + np.arange(len(names))[:, None] * (BINS + 1)
                counts = np.bincount(cell.ravel(), minlength=len(names) * (BINS + 1)).reshape(-1, BINS + 1)[:, :BINS]
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                q, b = np.nonzero((counts > 0) & (above < k))
                out.append((names[q], b, counts[q, b]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query", "bin", "n"])

    return run


def _at_least(width: int, exact: bool, k: int):
    def run(asked, rows):
        low, out = np.asarray(asked["lo"]), []
        if rows.num_rows:
            for part, names, ids, scores in _scores(asked, rows, width, exact):
                keep = scores >= low[part][:, None]
                keep &= scores > np.iinfo(np.int64).min
                for i in np.flatnonzero(keep.any(axis=1)).tolist():
                    at = np.flatnonzero(keep[i])
                    at = at[best(scores[i, at], ids[at], k)]
                    out.append((np.full(len(at), names[i]), ids[at], scores[i, at]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _floor(x: Column) -> Column:
    """The floor as a double; from 2**53 on, doubles are whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of highest inner product of ``floor(scale * x)``.

    ``is_query`` is a condition on ``id``.  A query's own row is no candidate.  Null ids, null vectors and vectors with
    null or non-finite components take no part; a repeated id counts once; a shorter vector is filled with zeros.  If two
    rows are so long that their score might not fit 64 bits, a ``ValueError`` names them: scores are never rounded.
    """
    d = deal(df, key, vec, lambda x: _floor(F.lit(scale) * x))
    if not d.largest < MOST:
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        ids = [str(r["id"]) for r in d.data.orderBy(square.desc(), "id").limit(2).collect()]
        raise ValueError(f"{key} {' and '.join(ids)}: components too large for scores of 64 bits")
    d, queries = with_queries(d, is_query)
    exact = d.largest < 2.0**52
    most = int(d.largest * (1 + 1e-9)) + 2
    wanted = min(k, d.n - 1)
    asked = queries.withColumns({"lo": F.lit(-most).cast("long"), "hi": F.lit(most + 1).cast("long"), "above": F.lit(0).cast("long")})
    span = 2 * most + 1
    while wanted > 0 and span > 1:
        step = -(-span // BINS)
        counted = meet(d, asked, _histogram(d.width, exact, wanted, step), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        top_down = W.partitionBy("query").orderBy(F.desc("bin"))
        summed = counted.withColumn("upto", F.sum("n").over(top_down)).join(asked.select("query", "lo", "above"), "query")
        reached = summed.filter((F.col("above") + F.col("upto") >= wanted) & (F.col("above") + F.col("upto") - F.col("n") < wanted))
        found = reached.select(
            "query",
            (F.col("lo") + F.col("bin") * step).alias("lo"),
            (F.col("lo") + (F.col("bin") + 1) * step).alias("hi"),
            (F.col("above") + F.col("upto") - F.col("n")).alias("above"),
        )
        asked = queries.join(stored(found, "intervals"), "query")
        span = step
    rows = meet(d, asked, _at_least(d.width, exact, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
