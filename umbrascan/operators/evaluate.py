"""Detector evaluation jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: sections of the labelled corpus that must stay clean -----------
CLEAN_SECTIONS = ("invalid", "invalid luhn", "invalidAB1234567", "false positive")


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """Share rounded half to even; 0 without a denominator."""
    return F.coalesce(F.bround(part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def precision_recall(scanned: DataFrame, label: str = "label", types: str = "detections") -> DataFrame:
    """tp/fn from positive and adversarial cases, fp from negative ones, per label."""
    hit = F.size(types) > 0
    wanted = F.col(label).isin("positive", "adversarial")
    counts = scanned.groupBy(label).agg(
        F.count("*").alias("samples"),
        F.count_if(wanted & hit).alias("tp"),
        F.count_if((F.col(label) == "negative") & hit).alias("fp"),
        F.count_if(wanted & ~hit).alias("fn"),
    )
    return counts.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )


def section_expectations(spark: SparkSession, sections: list[str]) -> DataFrame:
    """Expected outcome by section: the four clean sections must not be redacted."""
    rows = [(s, s not in CLEAN_SECTIONS) for s in sections]
    return spark.createDataFrame(rows, "section string, expect_redact boolean")


def corpus_accuracy(scanned: DataFrame, expectations: DataFrame, by_section: bool = True, weight: str | None = None) -> DataFrame:
    """Correct, false positives and false negatives, per section or in total.

    Sections without an expectation row are expected to be redacted.  Counts are taken per section first, so that only a row
    per section and outcome meets the expectations.  ``weight`` is how many texts a row stands for.
    """
    rows_of = F.count("*") if weight is None else F.sum(weight)
    outcomes = scanned.groupBy("section", F.coalesce("redact", F.lit(False)).alias("redact")).agg(rows_of.alias("__n"))
    judged = outcomes.join(expectations, "section", "left")
    expected = F.coalesce("expect_redact", F.lit(True))
    actual = F.col("redact")
    rows = lambda where: F.coalesce(F.sum(F.when(where, F.col("__n")).otherwise(0)), F.lit(0))
    aggregates = [
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total"),
        rows(expected).alias("expected"),
        rows(actual).alias("actual"),
        rows(expected == actual).alias("correct"),
        rows(~expected & actual).alias("false_positives"),
        rows(expected & ~actual).alias("false_negatives"),
    ]
    return judged.groupBy(*(["section"] if by_section else [])).agg(*aggregates)


def compare_runs(before: DataFrame, after: DataFrame, key: str = "section") -> DataFrame:
    """Per-section deltas of two accuracy tables."""
    names = [c for c in before.columns if c != key]
    a = before.select(key, *[F.col(c).alias(f"{c}_before") for c in names])
    b = after.select(key, *[F.col(c).alias(f"{c}_after") for c in names])
    out = a.join(b, key, "full_outer")
    deltas = {
        f"{c}_delta": F.coalesce(f"{c}_after", F.lit(0)) - F.coalesce(f"{c}_before", F.lit(0)) for c in names
    }
    return out.withColumns(deltas)


def bypasses(scanned: DataFrame, *, should: str = "should_detect", expected: str = "expected_types",
             types: str = "detections") -> DataFrame:
    """E4, per case: success, and whether a case that should be found went through unseen."""
    found = F.size(types) > 0
    missing = F.size(F.array_except(F.coalesce(expected, F.array().cast("array<string>")), types)) > 0
    return scanned.withColumns(
        {
            "success": F.when(F.col(should), found & ~missing).otherwise(~found),
            "bypassed": F.col(should) & ~found,
        }
    )


def bypass_rate(cases: DataFrame) -> DataFrame:
    """Totals and shares over judged cases."""
    counted = cases.agg(
        F.count("*").alias("total"), F.count_if("success").alias("passed"), F.count_if("bypassed").alias("bypassed")
    )
    return counted.withColumns(
        {
            "success_rate": ratio(F.col("passed"), F.col("total"), 4),
            "bypass_rate": ratio(F.col("bypassed"), F.col("total"), 4),
        }
    )


def confusion(scanned: DataFrame, labels: DataFrame, key: str, truth: Column, predicted: Column) -> DataFrame:
    """Confusion counts of a prediction against a label table, joined on the key.

    Only the key and the prediction are shuffled; the text is dropped before the join.
    """
    guesses = scanned.select(key, predicted.alias("predicted"))
    facts = labels.select(key, truth.alias("truth"))
    counted = guesses.join(facts, key).groupBy("predicted", "truth").agg(F.count("*").alias("n"))
    return counted


def quality(confused: DataFrame) -> DataFrame:
    """Precision and recall from confusion counts."""
    cell = lambda p, t: F.sum(F.when((F.col("predicted") == p) & (F.col("truth") == t), F.col("n")).otherwise(0))
    counts = confused.agg(
        cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, True).alias("fn"),
        cell(False, False).alias("tn"),
    )
    return counts.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )


def lost_types(before: Column, after: Column) -> Column:
    """O2 inside a row: types of an earlier run that a later one no longer reports."""
    return F.array_except(before, after)


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of an earlier run that a later run no longer reports."""
    return before.exceptAll(after)
