"""Samples of every rule in the tables' texts, against SQL; every rule fires somewhere."""

import pytest

from umbrascan.operators import findings, scan
from umbrascan.operators.rules import PROFILES, WORTH_SCANNING, u
from umbrascan.plans import oracles, plants, registry

duckdb = pytest.importorskip("duckdb")

NAMES = [
    "planted_types", "planted_decisions", "planted_encoded_findings", "encoded_findings", "encoded_readable", "planted_moderation",
    "planted_conversations", "planted_log_path", "merged_places",
]


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf, name):
    with duckdb.connect() as db:
        for t in ("documents", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        got = registry.QUERIES[name](spark, sf)
        want = db.execute(oracles.build()[name])
        order = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(order)
        assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want.fetchall()))


def samples(spark):
    rows = [(i, text) for i, (_, text) in enumerate(plants.DOCUMENT_PLANTS)]
    rows += [(1000 + i, "token = sk-abcd efgh ijkl mnop qrst uvwx" if i else "secret = abcd efgh ijkl") for i in range(2)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_every_rule_finds_its_sample(spark):
    found = {r.rule_id for r in findings.findings(samples(spark), ["doc_id"]).select("rule_id").distinct().collect()}
    assert {r.rule_id for r in PROFILES["standard"].rules} - found == set()


def test_gates_change_nothing(spark):
    df = samples(spark)
    for profile in PROFILES:
        fast, slow = (
            {r.doc_id: r.detections for r in scan.scan_types(df, profile=profile, prefilter=p).collect()} for p in (True, False)
        )
        assert fast == slow


def test_decoded_texts_left_out_hold_nothing(spark):
    """A text that the early test rejects has no finding in any view, without gates."""
    base = [t for _, t in plants.DOCUMENT_PLANTS]
    parts = sorted({piece for t in base for n in (3, 5, 8, 12) for piece in (t[i : i + n] for i in range(0, len(t), 2))})
    df = spark.createDataFrame([(t,) for t in parts + base], "text string")
    rejected = df.filter(~scan.base_text(df.text, PROFILES["standard"]).rlike(u(WORTH_SCANNING)))
    assert rejected.count() > 100
    for profile in PROFILES:
        assert scan.scan_types(rejected, profile=profile, prefilter=False).filter("size(detections) > 0").collect() == []


def test_token_before_a_line_end_is_not_part_of_the_id(spark):
    df = spark.createDataFrame([(1, "Some text here.\n2345 6789 1234"), (2, "Some text here. 2345 6789 1234"), (3, "xy-2345 6789 1234")], "doc_id long, text string")
    assert {r.doc_id: r.detections for r in scan.scan_types(df).collect()} == {1: ["AADHAAR"], 2: ["AADHAAR"], 3: []}
