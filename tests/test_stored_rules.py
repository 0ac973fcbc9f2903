"""Rules kept as a table give the findings of the built-in ones; bad rows are refused with a reason."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from umbrascan.operators import findings, rules_table
from umbrascan.operators.rules import PROFILES, Rule
from umbrascan.plans import plants


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rules") / "rules")
    for profile in PROFILES:
        rules_table.rules_frame(spark, profile, 1).write.mode("append").parquet(path)
    more = PROFILES["standard"].with_rules(Rule("ticket", "TICKET", r"\bTKT-\d{4}\b"))
    rules_table.rules_frame(spark, more, 2).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("profile", list(PROFILES))
def test_stored_rules_are_the_built_in_ones(spark, table, profile):
    stored, version = rules_table.stored_profile(table, profile, 1)
    assert (stored, version) == (PROFILES[profile], 1) and stored.worth_scanning is not None
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(plants.DOCUMENT_PLANTS)], "doc_id long, text string")
    got = rules_table.versioned_findings(df, ["doc_id"], table, profile, 1)
    assert {r.rules_version for r in got.collect()} == {1}
    want = findings.findings(df, ["doc_id"], profile=profile)
    assert sorted(map(repr, got.drop("rules_version").collect())) == sorted(map(repr, want.collect()))


def test_the_newest_version_counts(spark, table):
    stored, version = rules_table.stored_profile(table, "standard")
    assert version == 2 and stored.rules[-1].rule_id == "ticket" and stored.worth_scanning is None
    df = spark.createDataFrame([(1, "see TKT-1234")], "doc_id long, text string")
    rows = rules_table.versioned_findings(df, ["doc_id"], table, "standard").collect()
    assert [(r.rule_id, r.value, r.rules_version) for r in rows] == [("ticket", "TKT-1234", 2)]


@pytest.mark.parametrize(
    "change,reason",
    [
        ({"pattern": "(unclosed"}, "INVALID_PARAMETER_VALUE"), ({"views": ("base", "mirror")}, "mirror"), ({"pattern": None}, "neither"),
        ({"group": 3}, "group"), ({"accept": "no_such_function(m)"}, "no_such_function"), ({"rule_id": "email"}, "twice"),
    ],
)
def test_bad_rules_are_refused(spark, change, reason):
    rule = dataclasses.replace(Rule("ticket", "TICKET", r"\bTKT-\d{4}\b"), **change)
    profile = dataclasses.replace(PROFILES["hardened"].with_rules(Rule("email", "EMAIL_ADDRESS", "@"), rule), name="mine")
    with pytest.raises(rules_table.InvalidRules, match=f"(?i){reason}"):
        rules_table.stored_profile(rules_table.rules_frame(spark, profile, 1), "mine")


def test_missing_rules(spark, table):
    with pytest.raises(rules_table.InvalidRules, match="no rules"):
        rules_table.stored_profile(table, "other")
    with pytest.raises(rules_table.InvalidRules, match="version 9"):
        rules_table.stored_profile(table, "standard", 9)
    assert table.filter(F.col("pattern").isNull() & F.col("test").isNull()).count() == 0
