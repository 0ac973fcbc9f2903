"""Decoded texts and unbroken runs: views are made once, gates and row flags never change an answer."""

import base64
import random

from pyspark.sql import functions as F

from umbrascan.functions import views
from umbrascan.operators import rules, scan
from umbrascan.plans import plants, registry

GAPS = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", " ", " ", "\u0085", ".", "-", "_", ":", "", "/"]
SWAPS = {"o": "0", "l": "1", "e": "3", "a": "@", "s": "$", "0": "O", "1": "l", "5": "S", "2": "٢", "3": "３", "A": "А", "k": "K", "i": "İ"}


def texts(n):
    """Samples of every rule, with other gaps and characters, cut, joined and in another case."""
    rnd, out = random.Random(3), []
    samples = [t for _, t in plants.DOCUMENT_PLANTS]
    for _ in range(n):
        t = rnd.choice([" ", "", "\n", "="]).join(rnd.choices(samples, k=rnd.choice([1, 1, 1, 2])))
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            i = rnd.randrange(len(t)) if t else 0
            kind = rnd.randrange(6)
            if kind < 2 and t:
                t = t[:i] + rnd.choice(GAPS) + t[i + rnd.randrange(2):]
            elif kind == 2 and t:
                t = t[:i] + SWAPS.get(t[i], t[i]) + t[i + 1:]
            elif kind == 3:
                t = t[i:] if rnd.random() < 0.5 else t[:i]
            elif kind == 4:
                t = t.replace(" ", rnd.choice(GAPS))
            else:
                t = rnd.choice([t.upper(), t.lower(), t.swapcase()])
        out.append(t)
    return out + ["token=========", "x=1234567", "secret:12345678", "a" * 40 + "=", "token=" + "A" * 12, "t oken=" + "A" * 12]


def sealed(text):
    return base64.b64encode(text.encode()).decode()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_views_of_decoded_texts_are_made_once(spark):
    df = spark.createDataFrame([("x " + sealed("my p4n is ABCDE1234F"),)], "text string")
    shown = plan(scan.with_encoded_types(scan.with_views(df, "text"), "standard").select("__encoded"))
    assert shown.count(views.LEET_TOKEN) == scan.MAX_DEPTH
    assert scan.scan_types(df).first().detections == ["BASE64_PAN"]


def test_gates_change_nothing_in_any_view_or_level(spark):
    found = texts(500)
    df = spark.createDataFrame([(i, t, "x " + sealed(t)) for i, t in enumerate(found)], "id int, clear string, coded string").repartition(8)
    seen = set()
    for column in ("clear", "coded"):
        rows = {}
        for gated in (True, False):
            for r in scan.scan_types(df, column, prefilter=gated).select("id", "detections").collect():
                assert rows.setdefault(r["id"], r["detections"]) == r["detections"], (column, found[r["id"]])
        seen |= {t for d in rows.values() for t in d}
    assert len([t for t in seen if not t.startswith("BASE64_")]) > 15 and len([t for t in seen if t.startswith("BASE64_")]) > 15


def test_unbroken_runs_pass_few_gates(spark):
    """Base64 of plain text holds no white space, and no four digits in a row: most rules need one of them."""
    text = sealed("The quick brown fox jumps over the lazy dog 4 times in 1999. " * 50)
    row = scan.with_views(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert row[scan.DIGIT] and row[scan.LEET] and not (row[scan.SPACE] or row[scan.FOUR] or row[scan.EIGHT] or row[scan.ASSIGN])
    named = [f"{{{flag}}}" for flag in ("space", "four", "eight", "gapped", "assign")]
    assert sum(any(n in (r.gate or "") for n in named) for r in rules.STANDARD_RULES) > 30


def test_runs_are_decoded_with_any_padding(spark):
    runs = ["QUJDREVGR0g=", "QUJDREVGR0hJ", "QUJDREVGR0hJSg==", "QUJDREVGR0hJSg=", "QUJDREVGR0hJSg", "QUJDREVGR0g", "QUJDREVGR0g==", "QUJDREVGR0hJ==", "QUJDREVGR", "/////////w==", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "id int, run string")
    got = {r["id"]: r["t"] for r in df.select("id", scan.decode_run(F.col("run")).alias("t")).collect()}
    assert [got[i] for i in range(len(runs))] == ["ABCDEFGH", "ABCDEFGHI", "ABCDEFGHIJ", None, None, None, "ABCDEFGH", "ABCDEFGHI", None, "", None]


def test_round_trip_finds_all_again(spark, tmp_path):
    found = texts(150)
    spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.encoded_round_trip(spark, str(tmp_path)).collect()
    plain = scan.scan_types(registry.texts(spark, str(tmp_path)), encoded=False).select(F.explode("detections").alias("type"))
    counts = {r["type"]: r["count"] for r in plain.groupBy("type").count().collect()}
    least = scan.profile_of("standard").min_decoded
    assert all(r["lost"] == 0 for r in rows) or any(len(t) < least for t in found)
    assert {r["type"]: r["n"] + r["lost"] for r in rows if r["n"] + r["lost"]} == counts and all(r["invented"] == 0 for r in rows)
