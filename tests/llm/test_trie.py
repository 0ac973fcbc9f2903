import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from umbrascan.llm import hot_joins, prefix_trie, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """[(conv_id, turn, role, text)] -> result rows, from all prefixes written out; % is that of SQL."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    nodes, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(int(c / 20) * 20, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
        ends[seq].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, members in nodes.items():
        words = len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(members) - 1) * words
    return sorted(
        (min(m), len(v), min(nodes[v[:-1]]) if v else None, len(m), len(kids[v]), leaves[v], saved[v],
         hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest())
        for v, m in nodes.items()
    )


def result(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, path string, lo int").repartition(4)
    return sorted(map(tuple, prefix_trie.prefix_nodes(prefix_trie.rebuilt(df)).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def by_null(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_and_shared_prefixes(spark, seed):
    """Few turns, so that conversations nest, branch at all depths and repeat; some long ones."""
    rng = random.Random(seed)
    rows = []
    for c in range(260):
        n = rng.choice([1, 1, 2, 3, 5, 8, 8, 30 if c % 9 == 0 else 4])
        text = "a" if rng.random() < 0.5 else None
        for turn in range(n):
            rows.append((c if c < 250 else c * 1000, turn, "user" if turn % 2 == 0 else "assistant", text if rng.random() < 0.9 else rng.choice(["b c", " d\te\x1cf "])))
    assert result(spark, rows) == by_null(brute(rows))


def test_chain_of_prefixes(spark):
    rows = [(c * 20, t, "user", "same words") for c in range(40) for t in range(c + 1)]
    assert result(spark, rows) == by_null(brute(rows))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, "user", "null first"), (0, 1, None, None), (0, 1, None, None), (0, 0, "user", ""),
        (1, 0, "user", "own"), (40, 0, "user", "own"), (41, 0, "system", "x" * 100_000), (60, 5, "user", "own"), (61, 1, "a", "b"), (61, 1, "b", "a"),
        (-7, 0, "user", "negative"), (7_000_000_000, 0, "user", "far"),
    ]
    assert result(spark, rows) == by_null(brute(rows))
    assert result(spark, [(None, 0, "user", "lost")]) == []
    assert result(spark, [(5, 0, "user", "lost")]) == by_null(brute([(5, 0, "user", "lost")]))  # turnless where crc32 takes the first turn


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(hot_joins, "HOT", 20)
    rng = random.Random(3)
    rows = [(c, t, "user", "same" if t < 2 else f"t{rng.randrange(40)}") for c in range(300) for t in range(5)]
    assert result(spark, rows) == by_null(brute(rows))
    left = spark.range(500).select("id", F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(490).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = hot_joins.join_hot(left, right, "k", "id")
    assert hot_joins.hot_keys(left, "k") == [7]
    assert sorted((r["id"], r["v"]) for r in got.collect()) == sorted(((i, 14 if i < 400 else 2 * i if i < 490 else None) for i in range(500)))


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 0, "user", "one") for c in range(0, 4000, 20)] + [(c, 0, "user", "two") for c in range(20, 4000, 40)]
    assert result(spark, rows) == by_null(brute(rows))


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    want = con.sql(queries.oracles()["op11_prefix_trie"])
    assert by_null(map(tuple, queries.op11_prefix_trie(spark, sf).select(*want.columns).collect())) == by_null(want.fetchall())
