"""P2 for the type-list profiles: one row per rule, view and matched value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import positions
from ..functions import views as V
from . import decide, scan
from .rules import Profile, profile_of, quote

_EMPTY = (
    "cast(array() as array<struct<rule_id:string,type:string,view:string,value:string>>)"
)


def _row(rule_id: str, type_: str, view: str, value: str) -> str:
    return (
        f"named_struct('rule_id', {quote(rule_id)}, 'type', {quote(type_)}, 'view', {quote(view)}, 'value', {value})"
    )


def _rule_findings(rule, view: str, refs: dict[str, str]) -> str:
    fired = rule.condition(view, refs)
    found = rule.matches(view, refs)
    rows = []
    for type_ in rule.types:
        if found is None:
            rows.append(f"array({_row(rule.rule_id, type_, view, 'cast(null as string)')})")
        else:
            rows.append(f"transform({found}, x -> {_row(rule.rule_id, type_, view, 'x')})")
    return f"if({fired}, concat({', '.join(rows)}), {_EMPTY})"


def findings(
    df: DataFrame,
    keys: list[str],
    text_col: str = "text",
    profile: str | Profile = "standard",
    *,
    rule_ids: list[str] | None = None,
    types: list[str] | None = None,
) -> DataFrame:
    """One row per distinct (rule, view, value) with its first place in the raw text.

    ``start`` and ``end`` count code points of the raw text, whatever view the value was found in; of a place that
    a view wrote as one, such as an expanded letter, the whole counts.  ``value`` and the place are null for detectors
    that judge the whole text.  ``rule_ids`` or ``types`` compile only those rules.
    """
    out, found = _placed(df, keys, text_col, profile, rule_ids, types)
    rows = out.select(*keys, F.explode(scan.settled(found)).alias("f")).select(*keys, "f.*")
    return rows if types is None else rows.filter(F.col("type").isin(types))


def merged_findings(
    df: DataFrame,
    keys: list[str],
    text_col: str = "text",
    profile: str | Profile = "standard",
    *,
    rule_ids: list[str] | None = None,
    types: list[str] | None = None,
) -> DataFrame:
    """One row per place: overlapping findings of a type, of all rules and views, as (type, start, end, rules, views, text).

    All places of a value count, not only the first; ``text`` is the place in the raw text.  Detectors that judge the
    whole text have no place and no row.
    """
    out, found = _placed(df, keys, text_col, profile, rule_ids, types, every=True)
    wanted = found if types is None else F.filter(found, lambda f: f["type"].isin(types))
    rows = out.select(*keys, text_col, F.explode(scan.settled(positions.merged(wanted))).alias("m"))
    raw = F.substring(F.col(text_col), F.col("m.start") + 1, F.col("m.end") - F.col("m.start"))
    return rows.select(*keys, "m.*", raw.alias("text"))


def _placed(
    df: DataFrame, keys: list[str], text_col: str, profile: str | Profile, rule_ids, types, every: bool = False
) -> tuple[DataFrame, Column]:
    """The texts with their views, and the array of distinct findings with their first place, or with every place of a value."""
    profile = profile_of(profile)
    wanted = [
        r for r in profile.rules
        if (rule_ids is None or r.rule_id in rule_ids) and (types is None or set(r.types) & set(types))
    ]
    profile = Profile(profile.name, tuple(wanted), profile.high_types, profile.encoded_blocks, profile.min_decoded)
    out = scan.with_views(df.select(*keys, text_col), text_col, profile)
    refs = scan.view_refs(out)
    parts = [_rule_findings(r, v, refs) for r in wanted for v in r.views if v in refs]
    found = F.expr(f"array_distinct(concat({', '.join(parts)}))")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.col(scan.BASE)

    def view_of(f: Column) -> Column:
        if scan.PACKED not in out.columns:
            return base
        view = F.when(f["view"] == "leet", F.col(scan.LEET)).when(f["view"] == "ocr", F.col(scan.OCR))
        return view.when(f["view"] == "packed", F.col(scan.PACKED)).otherwise(base)

    def in_raw(f: Column, at: Column) -> Column:
        """Leet and OCR repair write one character for one, so only packed places need a way back to the base view."""
        packed = positions.source_place(positions.dropped(base, V.SPACE), at)
        in_base = F.when(f["view"] == "packed", packed).otherwise(at)
        return positions.bound(in_base, lambda p: positions.in_raw(raw, p, profile.name))

    def with_place(f: Column, p: Column) -> Column:
        names = ["rule_id", "type", "view", "value"]
        return F.struct(*[f[c].alias(c) for c in names], p["start"].alias("start"), p["end"].alias("end"))

    def first(f: Column) -> Column:
        at = positions.bound(positions.found_at(view_of(f), f["value"]), lambda at: F.when(at.isNotNull(), in_raw(f, at)))
        return positions.bound(at, lambda p: with_place(f, p))

    def all_places(f: Column) -> Column:
        places = positions.bound(view_of(f), lambda v: positions.all_found(v, f["value"]))
        return F.transform(places, lambda at: positions.bound(in_raw(f, at), lambda p: with_place(f, p)))

    if every:
        return out, F.flatten(F.transform(F.filter(found, lambda f: f["value"].isNotNull()), all_places))
    return out, F.transform(found, first)


def encoded_findings(
    df: DataFrame,
    keys: list[str],
    text_col: str = "text",
    profile: str | Profile = "standard",
    max_runs: int | None = None,
) -> DataFrame:
    """P3 as rows: type (prefixed once per nesting level) and depth."""
    profile = profile_of(profile)
    out = df.select(*keys, text_col).withColumn(
        scan.BASE, scan.base_text(F.coalesce(F.col(text_col), F.lit("")), profile)
    )
    out = scan.with_encoded_types(out, profile, max_runs)
    rows = out.select(*keys, F.explode(scan.settled(F.col("__encoded"))).alias("type"))
    depth = (F.length("type") - F.length(F.replace("type", F.lit("BASE64_"), F.lit("")))) / len("BASE64_")
    return rows.withColumn("depth", depth.cast("int"))


def union_runs(*runs: DataFrame) -> DataFrame:
    """O1: the findings of several runs, each once."""
    return reduce(DataFrame.unionByName, runs).distinct()


def with_severity(found: DataFrame, policy: DataFrame) -> DataFrame:
    """Findings joined to the severity policy.  How is left to the planner, which sees the policy's size."""
    return found.join(policy, "type", "left")


def severity_of_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """D1 on long findings: highest level per source row (two aggregates, no collected lists)."""
    per_key = found.groupBy(*keys).agg(
        F.max(F.coalesce(F.col("blocks"), F.lit(False))).alias("block"),
        F.count_distinct("type").alias("n_types"),
    )
    level = F.when(F.col("block"), "high").when(F.col("n_types") >= 2, "medium").otherwise("low")
    return per_key.withColumn("severity", level)


def policy_for(spark, profile: str = "standard") -> DataFrame:
    return decide.severity_policy(spark, profile)
