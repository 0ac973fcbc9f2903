"""Purge in place, look-ups without a shuffle of the log, ranks over wide ranges, opened texts."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from umbrascan.operators import audit, metrics
from umbrascan.sources import writers

AS_OF = dt.datetime(2024, 6, 30, 12)


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_purge_rewrites_only_the_cutoffs_date(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, AS_OF - dt.timedelta(hours=5 * i)) for i in range(200)]
    log = spark.createDataFrame(rows, "id long, timestamp timestamp").withColumn("dt", F.to_date("timestamp"))
    writers.append_audit(log, path)
    before = files(path)
    done = writers.purge_dates(spark, path, AS_OF, days=10)
    edge = (AS_OF - dt.timedelta(days=10)).date()
    after = files(path)
    assert done["rewritten"] == [edge] and len(done["dropped"]) == len({r[1].date() for r in rows if r[1].date() < edge})
    assert {r.id for r in spark.read.parquet(path).collect()} == {i for i, t in rows if t >= AS_OF - dt.timedelta(days=10)}
    for name, changed in before.items():
        date = dt.date.fromisoformat(name.split("dt=")[1][:10])
        assert (name in after) == (date > edge) and (date <= edge or after[name] == changed)
    again = writers.purge_dates(spark, path, AS_OF, days=10)
    assert again["dropped"] == [] and spark.read.parquet(path).count() == 49
    # all of the cutoff's date is too old
    assert writers.purge_dates(spark, path, dt.datetime.combine(AS_OF.date(), dt.time(23, 59)), days=10)["rewritten"] == [edge]
    assert spark.read.parquet(path).filter(F.col("dt") == F.lit(edge)).count() == 0


def test_lookups_do_not_shuffle_the_log(spark, tmp_path):
    words = [f"text {i % 300}" for i in range(1000)]
    log = spark.createDataFrame([(w,) for w in words[:500]] + [(None,)], "t string").select(F.sha2("t", 256).alias("redacted_fingerprint"))
    writers.fingerprint_index(log, "lookups_index", str(tmp_path / "index"), buckets=4)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(600)] + [(600, None)], "id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen, new = audit.split_seen_indexed(docs, spark.table("lookups_index"), "text")
        for out in (seen, new):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
        assert sorted(r.id for r in seen.collect()) == list(range(300))
        assert sorted(r.id for r in new.collect()) == list(range(300, 601))
        assert spark.table("lookups_index").count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("ranked", [1, 40, 100_000])
def test_ranks_over_nine_orders(spark, ranked):
    rng = random.Random(ranked)
    rows = []
    for key in ("wide", "tiny", "same", "mostly", "negative", None):
        for _ in range(700):
            x = 10 ** rng.uniform(-3, 6)
            x = {"tiny": x * 1e-9, "same": 7.5, "mostly": 3.25 if rng.random() < 0.7 else x, "negative": -x}.get(key, x)
            rows.append((key, x))
    rows += [("empty", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "key string, x double").repartition(5)
    values = {}
    for key, x in rows:
        if x is not None:
            values.setdefault(key, []).append(x)
    for rank in (lambda n: F.floor(n / 2), lambda n: F.floor(0.95 * (n - 1)), lambda n: n - 1, lambda n: n * 0):
        at = {k: int(spark.range(1).select(rank(F.lit(len(v))).cast("long")).first()[0]) for k, v in values.items()}
        got = {r.key: r.m for r in metrics.rank_pick(df, "x", rank, "m", ["key"], ranked=ranked).collect()}
        assert got == {k: sorted(v)[at[k]] for k, v in values.items()}
    every = sorted(x for v in values.values() for x in v)
    assert metrics.rank_pick(df, "x", lambda n: F.floor(n / 2), "m", ranked=ranked).first()["m"] == every[len(every) // 2]
    assert metrics.rank_pick(df.limit(0), "x", lambda n: F.floor(n / 2), "m").collect() == []


def test_opened_texts_are_compared(spark):
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    d = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id int, redacted_prompt string")
    sealed = audit.encrypt(d.withColumn("redacted_fingerprint", F.sha2("redacted_prompt", 256)), key, "k1")
    swapped = sealed.withColumn("redacted_fingerprint", F.when(F.col("id") < 3, F.lit("x")).otherwise(F.col("redacted_fingerprint")))
    rotated = audit.rotate_key(swapped, {"k1": key}, other, "k2")
    assert [tuple(r) for r in audit.verify_encryption(rotated, {"k2": other}).collect()] == [("k2", 20, 0, 3)]
    assert [tuple(r) for r in audit.verify_encryption(rotated, {"k2": key}).collect()] == [("k2", 20, 20, 0)]
    opened = audit.decrypt(rotated, {"k2": other}).select("id", "decrypted").collect()
    assert {r.id: r.decrypted for r in opened} == {i: f"text {i}" for i in range(20)}
