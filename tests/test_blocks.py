"""Balanced blocks, rolling sums and suppression, against plain loops; one key holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from umbrascan.operators import blocks, windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def many_blocks(spark):
    """Small blocks would be put together otherwise."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(3000):
        t += rng.choice([0, 0, 1, 2, 30, 400])
        rows.append((i, T0 + dt.timedelta(seconds=t), rng.choice(["hot"] * 8 + ["b", None]), rng.expovariate(1 / 200), rng.random() < 0.05))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, ts timestamp, key string, latency_ms double, is_error boolean").repartition(6)
    return df, sorted(rows, key=lambda r: (r[1], r[0]))


def test_numbers_and_running_sums(spark, log):
    df, rows = log
    ordered = blocks.in_blocks(df, ["key", "ts", "id"])
    assert ordered.select(blocks.BLOCK).distinct().count() > 4
    got = blocks.numbered(ordered, ["key"], ["ts", "id"], {"errors": F.col("is_error").cast("long")})
    want, seq, errors = {}, {}, {}
    for i, _, key, _, bad in rows:
        seq[key], errors[key] = seq.get(key, 0) + 1, errors.get(key, 0) + bad
        want[i] = (seq[key], errors[key])
    assert {r.id: (r["__seq"], r.errors) for r in got.collect()} == want
    assert set(got.columns) == {*df.columns, "__seq", "errors"}


@pytest.mark.parametrize("window,block", [(7, 16), (16, 16), (40, 16), (5000, 16)])
def test_trailing_sums(spark, log, window, block):
    df, rows = log
    numbered = blocks.numbered(blocks.in_blocks(df, ["key", "ts", "id"]), ["key"], ["ts", "id"], {})
    out = blocks.trailing(numbered.withColumn("slow", (F.col("latency_ms") > 300).cast("long")), ["key"], "__seq", "slow", window, "n", block)
    history, want = {}, {}
    for i, _, key, ms, _ in rows:
        history.setdefault(key, []).append(ms > 300)
        want[i] = sum(history[key][-window:])
    assert {r.id: r.n for r in out.collect()} == want


def test_breaches_read_the_log_once_and_do_not_join_it_with_itself(spark, log):
    df, _ = log
    out = windows.slo_breaches(df, ts="ts", window=50)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    assert out.count() == 3000


@pytest.mark.parametrize("limit,packed", [(1, 5), (3, 5), (3, 1 << 16)])
def test_suppression_of_a_hot_recipient(spark, log, monkeypatch, limit, packed):
    monkeypatch.setattr(windows, "PACKED", packed)
    df, rows = log
    odd = spark.createDataFrame([(9001, None, "hot"), (9002, None, "silent"), (9003, T0, "single")], "id long, ts timestamp, key string")
    got = windows.suppress_alerts(df.select("id", "ts", "key").union(odd), recipient="key", limit=limit, span_s=600)
    sent, want = {}, {9001: False, 9002: False, 9003: True}
    for i, t, key, _, _ in rows:
        recent = [x for x in sent.setdefault(key, []) if (t - x).total_seconds() < 600]
        want[i] = len(recent) < limit
        if want[i]:
            sent[key].append(t)
    assert {r.id: r.sent for r in got.collect()} == want


def test_empty_log(spark, log):
    df, _ = log
    none = df.limit(0)
    assert windows.slo_breaches(none, ts="ts").collect() == []
    assert windows.suppress_alerts(none, recipient="key").collect() == []
