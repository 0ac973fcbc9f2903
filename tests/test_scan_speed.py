"""Costly steps of the scan that are evaluated once a row, and only where a cheaper test holds."""

import re

import pytest
from pyspark.sql import functions as F

from umbrascan.functions import views
from umbrascan.operators import rules, scan

TEXTS = ["p4n c4rd", "2345 6789 0123", "no digit", "", None, "S8O9 1234 5678 9012", "abcde 1234 f", "5 o 1 l", "m1x \x1cn0w\x0b4 $1\t@b"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_views_are_folded_once(spark):
    df = scan.with_views(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "text")
    shown = plan(df.select(scan.LEET, scan.OCR))
    assert shown.count(views.LEET_TOKEN) == 1
    rows = df.select(scan.BASE, scan.LEET, views.leet_fold(F.col(scan.BASE)).alias("folded")).collect()
    assert all((r[scan.LEET] or r[scan.BASE]) == r["folded"] for r in rows)
    assert any(r[scan.LEET] for r in rows)


def test_leet_tokens_are_words_between_white_space(spark):
    plain = re.compile(r"(?<!\S)[^\s@431057$]*[@431057$]\S*", re.ASCII)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "id int, v string")
    for r in df.select("id", F.regexp_extract_all("v", F.lit(views.LEET_TOKEN), F.lit(0)).alias("found")).collect():
        assert r["found"] == plain.findall(TEXTS[r["id"]])


@pytest.mark.parametrize("rule_id", ["pan_split", "aadhaar"])
def test_costly_tests_follow_cheap_ones(spark, rule_id):
    """Gated and ungated in one projection: what follows the loose test stays in a branch of ``if``."""
    rule = {r.rule_id: r for r in rules.STANDARD_RULES}[rule_id]
    df = scan.with_views(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "text")
    refs = scan.view_refs(df)
    gated, ungated = (F.expr(rule.fires(refs, p)) for p in (True, False))
    out = df.select(gated.alias("gated"), ungated.alias("ungated"))
    assert plan(out).count(f"if (RLIKE({scan.BASE}") == 2
    rows = out.collect()
    assert all(r["gated"] is r["ungated"] is not None for r in rows) and any(r["gated"] for r in rows)
