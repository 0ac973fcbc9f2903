"""Nothing is cut: short encoded texts, long texts, tables in folders, deep nesting."""

import base64
import os

from pyspark.sql import functions as F
from umbrascan.operators import findings, scan
from umbrascan.plans import jobs, registry


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_short_encoded_texts_are_scanned_like_clear_ones(spark):
    texts = ["J0hn D0e", "John Doe", "Str33t", "L0nd0n", "London"]
    df = spark.createDataFrame([(i, f"x {t} y", f"x {b64(t)} y") for i, t in enumerate(texts)], "id long, clear string, coded string")
    clear = {r.id: set(r.detections) for r in scan.scan_types(df, "clear").collect()}
    coded = {r.id: set(r.detections) for r in scan.scan_types(df, "coded").collect()}
    least = scan.profile_of("standard").min_decoded
    for i, t in enumerate(texts):
        alone = {r.detections[0] for r in scan.scan_types(spark.createDataFrame([(t,)], "text string")).collect() if r.detections}
        assert clear[i] >= alone
        if len(t) >= least:
            assert {f"BASE64_{x}" for x in alone} <= coded[i], t


def test_levels_below_the_last_one_are_reported(spark):
    text, rows = "mail bob@example.com now", []
    for level in range(7):
        rows.append((level, text))
        text = b64(text)
    df = spark.createDataFrame(rows, "id long, text string")
    more = {r.id: r.more_levels for r in scan.deeper_levels(df).collect()}
    assert [more[i] for i in range(7)] == [False, False, False, False, True, True, True]
    found = {r.id: r.type for r in findings.encoded_findings(df, ["id"]).filter("type like '%EMAIL%'").collect()}
    assert set(found) == {1, 2, 3}


def test_long_texts_are_scanned(spark, tmp_path):
    long = "word " * 30_000 + "bob@example.com"
    df = spark.createDataFrame([(1, long), (2, "clean"), (3, None), (4, "ann@example.com")], "doc_id long, text string")
    stamp = F.lit("2025-01-01 00:00:00").cast("timestamp")
    jobs.scan_to_tables(df, stamp, f"{tmp_path}/audit", f"{tmp_path}/listed")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 2
    assert {r.reason for r in spark.read.parquet(f"{tmp_path}/listed").collect()} == {"too long", "missing"}
    jobs.scan_to_tables(df, stamp, f"{tmp_path}/audit2", f"{tmp_path}/listed2", reject=True)
    assert spark.read.parquet(f"{tmp_path}/audit2").count() == 1


def test_streams_read_tables_in_folders(spark, sf, tmp_path):
    whole = spark.read.parquet(f"{sf}/events.parquet")
    whole.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    assert os.path.isdir(f"{tmp_path}/events.parquet")
    for name in ("stream_quota_counts", "stream_slo_monitor"):
        one = sorted(map(tuple, registry.QUERIES[name](spark, sf).collect()))
        assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == one
