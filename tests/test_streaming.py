"""Streams drained from files give the batch results."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamReader

from umbrascan.operators import scan, windows
from umbrascan.plans import registry
from umbrascan.streaming import jobs as stream

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Four files of increasing time, read one per micro-batch."""
    rng = random.Random(3)
    path = str(tmp_path_factory.mktemp("log") / "in")
    t, i = 0.0, 0
    for _ in range(4):
        rows = []
        for _ in range(150):
            t += rng.choice([0.5, 5.0, 30.0, 300.0])
            rows.append((i, T0 + dt.timedelta(seconds=t), rng.choice("aab"), rng.expovariate(1 / 100), rng.random() < 0.1))
            i += 1
        df = spark.createDataFrame(rows, "id long, timestamp timestamp, key string, latency_ms double, is_error boolean")
        df.coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stream.ROCKSDB)
    yield
    spark.conf.set(key, before)


def drain(spark, log, build, tmp_path, mode="append"):
    source = spark.readStream.schema(spark.read.parquet(log).schema).option("maxFilesPerTrigger", 1).parquet(log)
    out = str(tmp_path / "out")
    stream.run_available(build(source), str(tmp_path / "checkpoint"), stream.append_batches(out), mode)
    return spark.read.parquet(out)


def test_stream_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "PAN ABCDE1234F"), (2, "hello")], "doc_id int, text string")
    path = str(tmp_path / "in")
    docs.write.parquet(path)
    got = drain(spark, path, lambda d: stream.scan_stream(d).select("doc_id", "detections"), tmp_path)
    assert {(r.doc_id, tuple(r.detections)) for r in got.collect()} == {(1, ("PAN",)), (2, ())}


def test_audit_stream_is_replay_safe(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, "PAN ABCDE1234F"), (2, "hello")], "doc_id int, text string").write.parquet(path)
    source = spark.readStream.schema("doc_id int, text string").parquet(path)
    for _ in range(2):  # the second start finds nothing new
        q = stream.audit_stream(source, str(tmp_path / "audit"), str(tmp_path / "cp"), timestamp=F.lit(T0), available_now=True)
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1


def test_quota_counts(spark, log, tmp_path):
    build = lambda d: stream.quota_counts(d, key="key", quota=2)
    got = drain(spark, log, build, tmp_path, mode="update")
    latest = got.groupBy("key", "window_start").agg(F.max("requests").alias("requests"))
    want = windows.quota_counts(spark.read.parquet(log), key="key", quota=2).select("key", "window_start", "requests")
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect()))


def test_exact_alerts(spark, log, tmp_path, rocksdb):
    bad = F.col("latency_ms") > 40
    got = drain(spark, log, lambda d: stream.exact_alerts(d, key="key", violation=bad), tmp_path)
    want = windows.alert_rule(spark.read.parquet(log), key="key", violation=bad)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()) != []


def test_suppression(spark, log, tmp_path, rocksdb):
    build = lambda d: stream.suppress_alerts(d, recipient="key", ts="timestamp")
    got = drain(spark, log, build, tmp_path)
    want = windows.suppress_alerts(spark.read.parquet(log), recipient="key", ts="timestamp")
    assert {r.id: r.sent for r in got.collect()} == {r.id: r.sent for r in want.collect()}


def test_slo_monitor(spark, log, tmp_path, rocksdb):
    build = lambda d: stream.slo_monitor(d, service=F.lit("all"), window=200)
    got = drain(spark, log, build, tmp_path, mode="update")
    last = got.orderBy(F.desc("total")).first()
    rows = spark.read.parquet(log).orderBy("timestamp", "id").collect()
    tail = sorted(r.latency_ms for r in rows[-200:])
    assert (last.total, last.samples) == (600, 200)
    assert last.p95_ms == round(tail[int(0.95 * 199)], 2)
    assert last.error_rate == round(sum(r.is_error for r in rows) / 600, 4) and last.breach


def test_sliding_alerts_cover_exact_ones(spark, log):
    bad = F.col("latency_ms") > 40
    df = spark.read.parquet(log)
    sliding = stream.sliding_alerts(df, key="key", violation=bad).select("key").distinct()
    exact = windows.alert_rule(df, key="key", violation=bad).select("key").distinct()
    assert exact.exceptAll(sliding).count() == 0


def test_checkpoint_root(spark, tmp_path):
    assert stream.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scan.MAX_DEPTH == 3


def test_late_violations_are_handed_on_not_judged():
    class Cell:
        rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    alerts = stream.ExactAlerts("key", 2, 60.0)
    alerts.recent = Cell()

    def feed(*seconds):
        batch = pd.DataFrame({"id": range(len(seconds)), "seconds": [float(s) for s in seconds]})
        out = list(alerts.handleInputRows(("k",), iter([batch]), None))
        return [(s, bool(late)) for f in out for s, late in zip(f["seconds"], f["late"])]

    assert feed(1000, 1002, 1001) == [(1002.0, False)]
    assert feed(500) == [(500.0, True)]
    assert alerts.recent.rows == [(1001.0,), (1002.0,)]
    assert feed(1003, 400) == [(400.0, True), (1003.0, False)]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """Events in files of mixed order: two sources up to five minutes out of step, ties, and 20 days without a pause."""
    rng = random.Random(8)
    folder = tmp_path_factory.mktemp("mixed")
    t, rows = 0.0, []
    for i in range(600):
        t += rng.choice([0, 0, 20, 200, 400, 900])
        rows.append((t + (300 if rng.random() < 0.5 else 0), i, t))
    rows.sort()  # in order of arrival
    for at in range(0, len(rows), 60):
        part = [(i, T0 + dt.timedelta(seconds=t), rng.choice("aab"), 40.0 * rng.random()) for _, i, t in rows[at : at + 60]]
        df = spark.createDataFrame(part, "event_id long, ts timestamp, event_type string, value double")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


def one_file_per_batch(monkeypatch):
    schema = DataStreamReader.schema
    monkeypatch.setattr(DataStreamReader, "schema", lambda self, s: schema(self, s).option("maxFilesPerTrigger", 1))


def wanted(spark, folder):
    log = spark.read.parquet(f"{folder}/events.parquet")
    rule = windows.alert_rule(log, key="event_type", violation=F.col("value") > 20, ts="ts", window_s=1800)
    return sorted(r.event_id for r in rule.collect())


def test_alerts_of_micro_batches_in_mixed_order(spark, mixed, monkeypatch):
    one_file_per_batch(monkeypatch)
    got = [r.id for r in registry.QUERIES["stream_exact_alerts"](spark, mixed).collect()]
    assert sorted(got) == wanted(spark, mixed) != []


def test_only_violations_behind_the_watermark_are_late(spark, tmp_path, rocksdb):
    path = str(tmp_path / "in")
    for n, seconds in enumerate([[5000, 5010], [4405, 4400, 5011], [9000], [8399, 8400]]):
        rows = [(100 * n + i, T0 + dt.timedelta(seconds=s), "a") for i, s in enumerate(seconds)]
        spark.createDataFrame(rows, "id long, timestamp timestamp, key string").coalesce(1).write.mode("append").parquet(path)
    build = lambda d: stream.exact_alerts(d, key="key", violation=F.lit(True), threshold=2, window_s=700)
    got = sorted((r.id, r.late) for r in drain(spark, path, build, tmp_path).collect())
    # watermarks: none, 4410, 4411, 8400; 5000 s and 5010 s plus 5011 s make three
    assert got == [(100, True), (101, True), (102, False), (300, True)]
