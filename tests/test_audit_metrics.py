"""Audit table, metrics, windows and sources against plain-Python brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from umbrascan.functions import checks, views
from umbrascan.operators import audit, decide, evaluate, metrics, scan, windows
from umbrascan.plans import jobs
from umbrascan.sources import readers, writers

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def requests(spark):
    """A log in which one key holds a third of the rows."""
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(1500):
        t += rng.choice([0.0, 0.5, 3.0, 20.0, 400.0]) if i % 200 else 9000.0
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(12)}"
        rows.append((i, T0 + dt.timedelta(seconds=t), key, round(rng.expovariate(1 / 90), 2), rng.random() < 0.02))
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, key string, latency_ms double, is_error boolean")
    return rows, df.repartition(6).cache()


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(r[2], []).append(r)
    return out


def test_upper_median(spark, requests):
    rows, df = requests
    want = {k: sorted(x[3] for x in v)[len(v) // 2] for k, v in by_key(rows).items()}
    got = {r.key: r.median for r in metrics.upper_median(df, "latency_ms", ["key"]).collect()}
    assert got == want
    assert metrics.upper_median(df, "latency_ms").first().median == sorted(r[3] for r in rows)[len(rows) // 2]
    four = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "latency_ms double")
    assert metrics.upper_median(four, "latency_ms").first().median == 3.0
    assert metrics.upper_median(four.limit(0), "latency_ms").first().median == 0


def test_health_and_empty_log(spark):
    log = spark.createDataFrame([], "action string, types array<string>")
    assert metrics.kpi_block(log).first().asDict() == {"total": 0, "blocked": 0, "redacted": 0, "tokens": 0, "health": 100}
    log = spark.createDataFrame([("block", ["A", "B"])] + [("pass", [])] * 7, "action string, types array<string>")
    got = metrics.kpi_block(log).first()
    assert (got.tokens, got.health) == (2, 87)  # 12.5 % rounds up to 13


def test_quota_counts_match_decisions(requests):
    rows, df = requests
    seen, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        start = int(r[1].replace(tzinfo=dt.timezone.utc).timestamp()) // 60 * 60
        seen[r[2], start] = seen.get((r[2], start), 0) + 1
        want[r[0]] = seen[r[2], start] <= 3
    got = {r.id: r.allowed for r in windows.quota_decisions(df, key="key", quota=3).collect()}
    assert got == want
    counts = windows.quota_counts(df, key="key", quota=3).agg(F.sum("allowed"), F.sum("rejected")).first()
    assert tuple(counts) == (sum(want.values()), len(want) - sum(want.values()))


def test_alert_rule(requests):
    rows, df = requests
    want = set()
    for items in by_key(rows).values():
        bad = [r for r in items if r[3] > 50]
        for r in bad:
            n = sum(1 for x in bad if 0 <= (r[1] - x[1]).total_seconds() < 60)
            if n > 3:
                want.add((r[0], n))
    got = windows.alert_rule(df, key="key", violation=F.col("latency_ms") > 50)
    assert {(r.id, r.violations) for r in got.collect()} == want and want


def brute_suppress(times, limit, span):
    sent, flags = [], []
    for t in times:
        live = [s for s in sent if s > t - span]
        flags.append(len(live) < limit)
        if flags[-1]:
            sent.append(t)
    return flags


def test_alert_suppression(requests):
    rows, df = requests
    want = {}
    for items in by_key(rows).values():
        flags = brute_suppress([(r[1] - T0).total_seconds() for r in items], 10, 3600)
        want.update({r[0]: f for r, f in zip(items, flags, strict=True)})
    got = windows.suppress_alerts(df, recipient="key", ts="timestamp").collect()
    assert {r.id: r.sent for r in got} == want
    assert any(want.values()) and not all(want.values())


def test_suppression_boundary():
    import numpy as np

    times = np.array([float(i) for i in range(10)] + [3599.0, 3600.0, 3600.5, 3601.0])
    flags, _ = windows.sent_flags(times, [], 10, 3600)
    assert flags.tolist() == brute_suppress(times, 10, 3600)
    assert flags.tolist()[10:] == [False, True, False, True]


def brute_slo(items, window):
    out, errors = {}, 0
    for n, r in enumerate(items, 1):
        errors += r[4]
        last = sorted(x[3] for x in items[max(0, n - window):n])
        p95 = last[int(0.95 * (len(last) - 1))]
        rate = errors / n
        out[r[0]] = (len(last), round(rate, 4), len(last) >= 20 and (p95 > 300 or rate > 0.01))
    return out


@pytest.mark.parametrize("by", [None, ["key"]])
def test_slo_breaches(requests, by):
    rows, df = requests
    groups = by_key(rows).values() if by else [sorted(rows, key=lambda r: (r[1], r[0]))]
    want = {}
    for items in groups:
        want.update(brute_slo(items, 100))
    got = windows.slo_breaches(df, by=by, window=100).collect()
    assert {r.id: (r.samples, r.error_rate, r.breach) for r in got} == want


def test_slo_snapshot(requests):
    rows, df = requests
    newest = sorted(x[3] for x in sorted(rows, key=lambda r: (r[1], r[0]))[-300:])
    got = metrics.slo_snapshot(df, window=300).first()
    assert got.p95_detection_ms == round(newest[int(0.95 * 299)], 2) and got.window_size == 300
    assert got.detection_error_rate == round(sum(r[4] for r in rows) / len(rows), 4)
    empty = metrics.slo_snapshot(df.limit(0)).first()
    assert (empty.window_size, empty.p95_detection_ms, empty.detection_error_rate) == (0, 0.0, 0.0)


def test_latest_and_policy(spark, requests):
    rows, df = requests
    want = {r[0] for items in by_key(rows).values() for r in sorted(items, key=lambda r: (-r[1].timestamp(), r[0]))[:4]}
    assert {r.id for r in audit.latest_per_key(df, 4, key="key").collect()} == want
    policy = spark.createDataFrame([("hot", 1)], "key string, quota int")
    got = {r.key: r.quota for r in windows.with_policy(df, policy, "key").select("key", "quota").distinct().collect()}
    assert got["hot"] == 1 and got["k1"] == 60


# --- audit ------------------------------------------------------------------------


def make_log(spark):
    rows = [
        (str(i), T0 + dt.timedelta(days=i), f"u{i % 3}", f"t{i % 2}", "text <b>" if i % 4 else "[REDACTED] done",
         ["high", "medium", "low"][i % 3], None if i else "fine")
        for i in range(12)
    ]
    df = spark.createDataFrame(
        rows, "id string, timestamp timestamp, user_id string, tenant_id string, redacted_prompt string, severity string, "
        "llm_response_redacted string",
    )
    return df.withColumn("dt", F.to_date("timestamp"))


def test_query_filters_and_pages(spark):
    log = make_log(spark)
    assert [r.id for r in audit.query(log, limit=3).collect()] == ["11", "10", "9"]
    assert [r.id for r in audit.query(log, severity="high", limit=2, offset=1).collect()] == ["6", "3"]
    assert [r.id for r in audit.query(log, user_id="u1", tenant_id="t1").collect()] == ["7", "1"]
    assert audit.query(log).filter("llm_response_redacted is null").count() == 11


def test_purge_prunes_dates(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_audit(make_log(spark), path)
    kept = audit.purge(spark.read.parquet(path), T0 + dt.timedelta(days=95, hours=12), days=90)
    assert sorted(int(r.id) for r in kept.collect()) == [6, 7, 8, 9, 10, 11]
    assert "PartitionFilters: [isnotnull(dt" in kept._jdf.queryExecution().executedPlan().toString()


def test_leaks_and_repeats(spark):
    log = make_log(spark)
    got = audit.leak_summary(log).first()
    assert (got.total, got.unredacted) == (12, 0)  # "text <b>" is not longer than ten characters
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, text string")
    rep = audit.repeats(texts, "text", "k").collect()
    assert [(r.copies, r.first_key) for r in rep] == [(2, 1)]
    seen, new = audit.split_seen(texts, texts.filter("k = 1").select(checks.fingerprint(F.col("text")).alias("redacted_fingerprint")), "text")
    assert {r.k for r in seen.collect()} == {1, 3} and {r.k for r in new.collect()} == {2}


def test_encryption_round_trip_and_rotation(spark):
    old, new, wrong = F.lit("0123456789abcdef"), F.lit("fedcba9876543210"), F.lit("x" * 16)
    df = spark.createDataFrame([("secret one",), ("zwei ü",)], "redacted_prompt string")
    sealed = audit.encrypt(df, old, "k1")
    assert {r.redacted_prompt for r in sealed.collect()} == {"__encrypted__"}
    assert {r.decrypted for r in audit.decrypt(sealed, {"k1": old}).collect()} == {"secret one", "zwei ü"}
    assert audit.verify_encryption(sealed, {"k1": wrong}).first().failures == 2
    moved = audit.rotate_key(sealed, {"k1": old}, new, "k2")
    assert {r.decrypted for r in audit.decrypt(moved, {"k2": new}).collect()} == {"secret one", "zwei ü"}
    kept = audit.rotate_key(sealed, {"k1": wrong}, new, "k2")
    assert {r.redacted_prompt_key_id for r in kept.collect()} == {"k1"}


def test_detect_job_rows_are_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "PAN ABCDE1234F <x>"), (2, "nothing here"), (3, "ping 10.0.0.1")], "doc_id int, text string")
    rows = jobs.detect_job(docs, F.lit(T0))
    first = {r.id: r for r in rows.collect()}
    assert len(first) == 2 and {r.action for r in first.values()} == {"block", "redact"}
    assert "PAN [REDACTED] &lt;x&gt;" in {r.redacted_prompt for r in first.values()}
    assert set(first) == {r.id for r in rows.collect()}
    path = str(tmp_path / "audit")
    writers.append_audit(rows, path)
    assert readers.read_audit(spark, path).count() == 2
    work = jobs.worker_job(docs, F.lit(T0)).collect()
    assert sorted(r.action for r in work) == ["block", "pass", "pass"]


def test_log_job_escalates_dirty_responses(spark):
    rows = [
        ("u<1>", "hello", "fine answer", "allow", "low"),
        ("u2", "hello", "your PAN is ABCDE1234F", "allow", "low"),
        ("u3", "hello", None, "redact", "medium"),
    ]
    df = spark.createDataFrame(rows, "user_id string, redacted_prompt string, llm_response_redacted string, action string, severity string")
    df = df.withColumns({"tenant_id": F.lit("t"), "detection_types": F.array(), "timestamp": F.lit(T0)})
    got = {r.user_id: r for r in jobs.log_job(df).collect()}
    assert (got["u&lt;1&gt;"].action, got["u&lt;1&gt;"].trace_metadata["output_moderation"]) == ("pass", "clean")
    assert (got["u2"].action, got["u2"].severity) == ("block", "high")
    assert got["u2"].trace_metadata["output_moderation"] == "contains_detection:PAN"
    assert (got["u3"].action, got["u3"].trace_metadata["output_moderation"]) == ("redact", "not-run")


# --- small functions ----------------------------------------------------------------


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a",), ("foobar",), ("",)], "t string")
    got = {r.t: r.h for r in df.select("t", checks.origin_hash(F.col("t")).alias("h")).collect()}
    assert got == {"a": "e40c292c", "foobar": "bf9cf968", "": "811c9dc5"}
    row = spark.createDataFrame([("<a href=\"x\">&'", "x" * 81, "Zé€")], "h string, p string, e string").select(
        checks.html_escape(F.col("h")).alias("h"), checks.preview(F.col("p")).alias("p"), checks.mock_embedding(F.col("e")).alias("e")
    ).first()
    assert row.h == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert row.p == "x" * 80 + "…"
    assert row.e == [float(ord(c) % 97) for c in "Zé€"]


def test_views(spark):
    def show(fn, text):
        return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("v")).first().v

    assert show(views.strip_null, "a\x00b") == "ab"
    assert show(views.strip_invisible, "a​b­c﻿") == "abc"
    assert show(views.compatibility_fold, "４１ Ａ𝟏é") == "41 A1é"
    assert show(views.exact_nfkc, "ﬁ ½ Ａ é") == "fi 1⁄2 A é"
    assert show(views.lookalike_fold, "АВ Ρο") == "AB Po"
    assert show(views.span_alphabet_fold, "Щука – „x“") == 'Shchyka - "x"'
    assert show(views.leet_fold, "A@dh4ar 2345\tp4$$") == "Aadhaar 2345\tpass"
    assert show(views.leet_fold_all, "h3ll0 4!") == "hello ai"
    assert show(views.ocr_fold, "call 234S 6789 l234 now") == "call 2345 6789 1234 now"
    assert show(views.ocr_compact, "l-2 S.g:O_") == "12590"
    assert show(views.dot_to_dash, "1.2.3 4.5") == "1-2.3 4-5"
    assert show(views.without_space, " a\tb\n") == "ab"
    assert show(views.word_chars, "a-b_c é") == "ab_c"
    assert show(views.licence_fold, "DL-O4 2o") == "DL0420"
    inner = "aGVsbG8gZnJpZW5kcw=="  # hello friends
    assert show(views.decoded_view, f"x  {inner} y") == "x hello friends y"
    twice = "YUdWc2JHOGdabkpwWlc1a2N3PT0="
    assert show(views.decoded_view, twice) == "hello friends"


def test_tenant_failure_and_moderation(spark):
    rows = [("h", '{"org":"o"}'), ("", '{"tenant":"t","org":"o"}'), (None, '{"tenant_id":""}'), (None, None)]
    df = spark.createDataFrame(rows, "header string, claims string")
    got = df.withColumn("tenant_id", decide.resolve_tenant(F.col("header"), F.col("claims")))
    assert [r.tenant_id for r in got.collect()] == ["h", "t", "", ""]
    known, unknown = decide.split_by_tenant(got)
    assert (known.count(), unknown.count()) == (2, 2)
    failed = spark.createDataFrame([("boom", ["PAN"], True, True, "high")], "error string, detections array<string>, block boolean, redact boolean, severity string")
    opened = decide.failure_policy(failed).first()
    assert (opened.detections, opened.block, opened.severity, opened.status) == ([], False, "none", "ok")
    assert decide.failure_policy(failed, mode="fail_closed").first().status == "reject"


def test_sources(spark, tmp_path):
    import json

    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join(json.dumps({"id": f"c{i}", "section": "s", "text": t}) for i, t in enumerate(["", "ok", "x" * 11])))
    corpus = readers.read_corpus(spark, str(path))
    valid, rejected = readers.validate(corpus, max_chars=10)
    assert [r.text for r in valid.collect()] == ["ok"]
    assert sorted(r.reason for r in rejected.collect()) == ["empty", "too long"]
    assert readers.evolve(corpus, "id string, section string, text string, tenant_id string").columns[-1] == "tenant_id"

    log = spark.createDataFrame(
        [(T0, "k", "00", 'say "hi"\nyou', "red", "block", ["A", "B"], 1.5)],
        "timestamp timestamp, api_key string, origin_hash string, raw_preview string, redacted_prompt string, action string, "
        "triggered_patterns array<string>, latency_ms double",
    )
    writers.export_csv(log, str(tmp_path / "csv"))
    schema = "timestamp string, api_key string, origin_hash string, raw_preview string, redacted_prompt string, action string, patterns string, latency_ms double"
    back = readers.read_csv(spark, str(tmp_path / "csv"), schema).first()
    assert (back.timestamp, back.raw_preview, back.patterns) == ("2024-01-01T00:00:00.000Z", json.dumps('say "hi"\nyou'), "A|B")

    cases = spark.createDataFrame([("t", "positive", ["PAN"], True)], "text string, label string, detections array<string>, block boolean")
    writers.write_report(cases, evaluate.precision_recall(cases), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/cases")).first().detections == "['PAN']"


def test_gate_and_bypass(spark):
    df = scan.scan(spark.createDataFrame([("PAN ABCDE1234F",), ("ping 10.0.0.1",), ("hi",)], "text string"))
    from umbrascan.operators import conversation

    routes = conversation.gate(df)
    assert {k: v.count() for k, v in routes.items()} == {"block": 1, "redact": 1, "pass": 1}
    cases = spark.createDataFrame(
        [(True, ["A"], ["A", "B"]), (True, ["C"], ["A"]), (True, None, []), (False, None, [])],
        "should_detect boolean, expected_types array<string>, detections array<string>",
    )
    got = evaluate.bypass_rate(evaluate.bypasses(cases)).first()
    assert (got.total, got.passed, got.bypassed, got.bypass_rate) == (4, 2, 1, 0.25)
    assert math.isclose(got.success_rate, 0.5)
