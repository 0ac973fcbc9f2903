import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from umbrascan.llm import exact_topk, neighbours


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.standard_normal(8).round(1)], "x") for i in range(400)]
    rows += [(400 + i, rows[3][1], "x") for i in range(60)]  # ties
    rows += [(7, rows[7][1], "x"), (None, rows[1][1], "x"), (500, None, "x"), (501, [1.0, None] + [0.0] * 6, "x")]
    rows += [(502, [math.nan] * 8, "x"), (503, [math.inf] * 8, "x"), (520, [0.0] * 8, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)


def brute(vectors, scale, zeros):
    kept = {}
    for r in vectors.collect():
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (not zeros and not any(v)):
            continue
        kept[r["vec_id"]] = [math.floor(scale * x) for x in v] if scale else v
    out = []
    for q in (k for k in kept if k % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(kept[q], v)), k) for k, v in kept.items() if k != q)[:20]
        out += [(q, i + 1, k, -s) for i, (s, k) in enumerate(scored)]
    return sorted(out)


def test_exact_topk(vectors):
    got = sorted(tuple(r) for r in exact_topk.search(vectors, F.col("id") % 20 == 0).collect())
    assert got == brute(vectors, 64, True)


def test_exact_topk_of_few_rows(spark, vectors):
    few = vectors.filter("vec_id < 5")
    assert sorted(tuple(r) for r in exact_topk.search(few, F.col("id") % 20 == 0).collect()) == brute(few, 64, True)
    assert exact_topk.search(vectors.limit(0), F.col("id") % 20 == 0).count() == 0
    assert exact_topk.search(vectors.filter("vec_id = 20"), F.col("id") % 20 == 0).count() == 0


def test_neighbours_recall(vectors):
    got = neighbours.search(vectors, F.col("id") % 20 == 0).collect()
    want = brute(vectors, None, False)
    scores = {(q, i): s for q, i, _, s in want}
    assert len(got) == len(want)
    near = sum(abs(r["score"] - scores[r["query_id"], r["rank"]]) < 1e-9 for r in got)
    assert near >= 0.9 * len(want)
    assert neighbours.search(vectors.limit(0), F.col("id") % 20 == 0).count() == 0


def test_neighbours_recall_on_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = neighbours.search(df, F.col("id") % 20 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        top = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit, total = hit + len(top & found[ids[q]]), total + 20
    assert hit >= 0.9 * total


def test_large_components(spark, vectors):
    """One long vector changes nothing but its own scores; two that 64 bits can't hold are named."""
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.filter("vec_id < 120").collect()]
    long = spark.createDataFrame([*rows, (121, [1e8, -3.0, 0.5, 0.0, 0.0, 0.0, 0.0, 1e8])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in exact_topk.search(long, F.col("id") % 20 == 0).collect()) == brute(long, 64, True)
    two = long.union(spark.createDataFrame([(140, [1e9] * 8)], long.schema))
    with pytest.raises(ValueError, match="vec_id 140 and 121"):
        exact_topk.search(two, F.col("id") % 20 == 0)
    for big in (1e8, 1e200, 1e308):
        df = spark.createDataFrame([*rows, (121, [big, -3.0, 0.5, 0.0, 0.0, 0.0, 0.0, big]), (140, [big] * 8)], long.schema)
        got = neighbours.search(df, F.col("id") % 20 == 0).collect()
        kept = {i for i, v in rows if i is not None and any(v)} | {121, 140}
        assert len(got) == 20 * len([i for i in kept if i % 20 == 0])
    tiny = spark.createDataFrame([(i, [x * 1e-200 for x in v] if v else v) for i, v in rows], long.schema)
    assert neighbours.search(tiny, F.col("id") % 20 == 0).count() > 0


def test_few_vectors_are_verified():
    """Recall of the index together with the share that it verifies."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64))
    x = centres[rng.integers(0, 60, 4000)] + 0.8 * rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked, hit, seen = x[::40], 0, 0
    for part, mask in neighbours.candidates(x, asked, 1.0, 21, neighbours.LINES, neighbours.THRESHOLD, neighbours.BETA):
        top = np.argsort(-(asked[part] @ x.T), axis=1)[:, :20]
        hit += np.take_along_axis(mask, top, axis=1).sum()
        seen += mask.sum()
    assert hit >= 0.9 * 20 * len(asked) and seen < 0.2 * len(asked) * len(x)
