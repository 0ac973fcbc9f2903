"""Approximate nearest neighbours by collision counting.

Vectors get one more component, so that the largest inner product becomes the least distance.  Each of ``m`` random
lines sorts a shard's vectors by projection.  A query opens a window around its own projection on every line; virtual
rehashing widens all windows by ``GROWTH`` until ``k + LEAST + beta * rows`` vectors, or all, fall into at least ``threshold``
of them.  Only those are verified, on the original vectors.  Windows of later queries start at the narrowest one that
PILOT queries of the shard needed.  Measured with the defaults on unit vectors of 64 components: see the README.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from umbrascan.llm.vectors import best, deal, matrix, meet, with_queries

LINES, THRESHOLD, BETA, LEAST, START, GROWTH, PILOT, ROWS = 128, 0.75, 0.08, 120, 0.5, 1.06, 24, 256


def _lines(width: int, lines: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((width + 1, lines))


def candidates(data: np.ndarray, queries: np.ndarray, largest: float, k: int, lines: int, threshold: float, beta: float):
    """Slices of queries with a mask of the vectors to verify."""
    n, unit = len(data), max(largest, 1e-300) ** 0.5
    axes = _lines(data.shape[1], lines)
    rest = np.sqrt(np.maximum(0.0, largest - np.einsum("ij,ij->i", data, data)))
    on = np.column_stack([data, rest]) @ axes
    order = np.argsort(on, axis=0, kind="stable")
    values = np.take_along_axis(on, order, axis=0)
    rank = np.empty((lines, n), np.uint16 if n < 1 << 16 else np.uint32)
    for j in range(lines):
        rank[j, order[:, j]] = np.arange(n)
    # a query is scaled to the largest norm, which leaves the order of its inner products as it is
    length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    asked = (queries * (unit / np.where(length > 0, length, 1))[:, None]) @ axes[:-1]
    need = int(np.ceil(threshold * lines))
    enough = min(n, k + LEAST + int(np.ceil(beta * n)))
    def widened(spot: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in at least ``need`` windows of each query, and the half width of its windows."""
        mask, reached = np.zeros((len(spot), n), bool), np.zeros(len(spot))
        open_ = np.arange(len(spot))
        while len(open_):
            hits = np.zeros((len(open_), n), np.uint8)
            for j in range(lines):
                low = np.searchsorted(values[:, j], spot[open_, j] - half, "left").astype(rank.dtype)[:, None]
                size = np.searchsorted(values[:, j], spot[open_, j] + half, "right").astype(rank.dtype)[:, None] - low
                hits += (rank[j] - low) < size  # unsigned: below the window wraps around
            got = hits >= need
            ended = got.sum(axis=1) >= enough
            mask[open_[ended]], reached[open_[ended]] = got[ended], half
            open_, half = open_[~ended], half * GROWTH
        return mask, reached

    begin = widened(asked[:PILOT], START * unit)[1].min() if len(asked) else 0.0
    for at in range(0, len(queries), ROWS):
        yield slice(at, at + ROWS), widened(asked[at : at + ROWS], begin)[0]


def _search(width: int, scale: float, largest: float, k: int, lines: int, threshold: float, beta: float):
    def run(asked, rows):
        out = []
        if rows.num_rows and asked.num_rows:
            ids, data = np.asarray(rows["id"]), matrix(rows["v"], width)
            names, queries = np.asarray(asked["query"]), matrix(asked["asked"], width)
            for part, mask in candidates(data / scale, queries / scale, largest, k + 1, lines, threshold, beta):
                mask &= names[part][:, None] != ids
                for q, row in zip(range(part.start, part.stop), mask):
                    at = np.flatnonzero(row)
                    with np.errstate(over="ignore"):
                        scores = (data[at] * queries[q]).sum(axis=1)
                    keep = best(scores, ids[at], k)
                    out.append((np.full(len(keep), names[q]), ids[at][keep], scores[keep]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0) for i in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def search(
    df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding",
    lines: int = LINES, threshold: float = THRESHOLD, beta: float = BETA,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest found by largest inner product, in double precision.

    ``is_query`` is a condition on ``id``.  A query's own row is no candidate.  Null ids and null, zero or empty vectors
    and those with null or non-finite components take no part; a repeated id counts once; a shorter vector is filled
    with zeros.  Every row is indexed; lines are fixed by a seed.  Finite components may be as large as a double: the index
    uses vectors scaled by the largest one, and an inner product beyond a double is infinite.
    """
    sound = F.exists(F.col(vec), lambda x: x != 0)
    d = deal(df.filter(sound), key, vec, lambda x: x, least_shards=1)
    d, queries = with_queries(d, is_query)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("scale")) * (x / F.col("scale")))
    scale = d.data.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    largest = d.data.withColumn("scale", F.lit(scale)).agg(F.max(square)).first()[0] or 0.0
    rows = meet(d, queries, _search(d.width, scale, largest, k, lines, threshold, beta), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
