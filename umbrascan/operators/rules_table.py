"""Rules kept as a versioned table, checked before use and compiled to the columns of the built-in profiles.

A row is a rule of one profile version; the profile's own settings are repeated on its rows.  Rules are read once, as
the scan's expressions are built from them: a few hundred rows at most, checked by ``MOST_RULES``.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import findings, scan
from .rules import Profile, Rule, profile_of, u

FIELDS = ["rule_id", "type", "pattern", "views", "gate", "accept", "context", "test", "find", "group", "also"]
SCHEMA = (
    "profile string, version int, place int, rule_id string, type string, pattern string, views array<string>, gate string, "
    "accept string, context string, test string, find string, `group` int, also string, high_types array<string>, "
    "encoded_blocks boolean, min_decoded int"
)
VIEWS = {"base", "leet", "ocr", "packed"}
MOST_RULES = 10_000


class InvalidRules(ValueError):
    """Rules that cannot be used, with a reason each."""


def rules_frame(spark: SparkSession, profile: str | Profile, version: int) -> DataFrame:
    """A profile as rows, to be stored."""
    p = profile_of(profile)
    rows = [
        (p.name, version, i, *[list(v) if f == "views" else v for f in FIELDS for v in (getattr(r, f),)], list(p.high_types), p.encoded_blocks, p.min_decoded)
        for i, r in enumerate(p.rules)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def problems(spark: SparkSession, rules: list[Rule]) -> list[tuple[str, str]]:
    """(rule_id, reason) of rules that would fail or never fire: checked by compiling each against an empty text."""
    found, seen = [], set()
    probe = scan.with_views(spark.range(1).select(F.lit("").alias("text")), "text")
    refs = scan.view_refs(probe)
    for r in rules:
        if r.rule_id in seen:
            found.append((r.rule_id, "the id occurs twice"))
        seen.add(r.rule_id)
        if not r.pattern and not r.test:
            found.append((r.rule_id, "neither a pattern nor a test"))
            continue
        if strange := set(r.views) - VIEWS or (not r.views and {"no view"}):
            found.append((r.rule_id, f"views: {', '.join(sorted(strange))}"))
            continue
        try:
            if r.pattern:  # in Java's dialect; or nothing, so that there is a match whose groups are counted
                spark.range(1).select(F.regexp_extract(F.col("id").cast("string"), f"{u(r.pattern)}|", r.group)).collect()
            probe.select(F.expr(r.fires(refs))).collect()
        except PySparkException as e:
            found.append((r.rule_id, str(e).splitlines()[0][:200]))
    return found


def stored_profile(table: DataFrame, profile: str, version: int | None = None) -> tuple[Profile, int]:
    """The named profile of a rules table, of ``version`` or its newest one, and that version; raises ``InvalidRules``."""
    mine = table.filter(F.col("profile") == profile)
    if version is None:
        version = mine.agg(F.max("version")).first()[0]
    rows = mine.filter(F.col("version") == version).orderBy("place").limit(MOST_RULES + 1).collect() if version is not None else []
    if not rows:
        raise InvalidRules(f"no rules of profile {profile!r}, version {version}")
    if len(rows) > MOST_RULES:
        raise InvalidRules(f"over {MOST_RULES} rules")
    rules = [Rule(**{f: tuple(r[f] or ()) if f == "views" else r[f] for f in FIELDS}) for r in rows]
    if bad := problems(table.sparkSession, rules):
        raise InvalidRules("; ".join(f"{i}: {why}" for i, why in bad))
    first = rows[0]
    return Profile(profile, tuple(rules), tuple(first["high_types"]), first["encoded_blocks"], first["min_decoded"]), version


def versioned_findings(df: DataFrame, keys: list[str], table: DataFrame, profile: str, version: int | None = None, text_col: str = "text") -> DataFrame:
    """Findings by stored rules; every row carries ``rules_version``."""
    rules, used = stored_profile(table, profile, version)
    return findings.findings(df, keys, text_col, rules).withColumn("rules_version", F.lit(used))
