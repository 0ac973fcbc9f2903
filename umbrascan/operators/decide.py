"""Severity, flags, actions and moderation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import Profile, profile_of

# --- fixed values -----------------------------------------------------------
TENANT_CLAIMS = ("tenant_id", "tenant", "org", "organization")
SPAN_SEVERITY = {
    "AADHAAR": "critical", "PAN": "critical", "DRIVING_LICENSE": "high", "GSTIN": "high",
    "PASSPORT_IN": "critical", "EMAIL": "low", "UPI": "medium", "CREDIT_CARD": "critical",
    "API_KEY": "critical", "PHONE_IN": "medium",
}
SPAN_BLOCK_TYPES = ["AADHAAR", "PAN", "PASSPORT_IN", "CREDIT_CARD", "API_KEY"]


def blocks(types: Column, profile: str | Profile) -> Column:
    """Any high type, and for the hardened profile any base64 finding."""
    profile = profile_of(profile)
    high = F.arrays_overlap(types, F.array(*[F.lit(t) for t in profile.high_types]))
    if profile.encoded_blocks:
        high = high | F.exists(types, lambda t: t.startswith("BASE64_"))
    return high


def severity(types: Column, block: Column) -> Column:
    """High if blocked, else by the number of types."""
    return (
        F.when(block, "high").when(F.size(types) >= 2, "medium").when(F.size(types) == 1, "low").otherwise("none")
    )


def with_decision(df: DataFrame, profile: str | Profile, types: str = "detections") -> DataFrame:
    out = df.withColumns({"block": blocks(F.col(types), profile), "redact": F.size(types) > 0})
    return out.withColumn("severity", severity(F.col(types), F.col("block")))


def action(block: Column, redact: Column) -> Column:
    """Block > redact > pass."""
    return F.when(block, "block").when(redact, "redact").otherwise("pass")


def canonical_action(name: Column) -> Column:
    """``allow`` is read as ``pass``."""
    return F.when(F.lower(name) == "allow", "pass").otherwise(F.lower(name))


def span_action(types: Column) -> Column:
    """D3: allow, redact or block by the block-type set of the span profile."""
    block = F.arrays_overlap(types, F.array(*[F.lit(t) for t in SPAN_BLOCK_TYPES]))
    return F.when(F.size(types) == 0, "allow").when(block, "block").otherwise("redact")


def severity_policy(spark: SparkSession, profile: str | Profile = "standard") -> DataFrame:
    """The severity lookup as a table ``type, level, blocks``; a few dozen rows."""
    if profile == "spans":
        rows = [(t, level, t in SPAN_BLOCK_TYPES) for t, level in SPAN_SEVERITY.items()]
    else:
        profile = profile_of(profile)
        rows = [(t, "high" if t in profile.high_types else "low", t in profile.high_types) for t in profile.types]
    return spark.createDataFrame(rows, "type string, level string, blocks boolean")


def strict_moderation(types: Column) -> Column:
    """Any detection blocks; the reason lists the types."""
    hit = F.size(types) > 0
    return F.struct(
        hit.alias("blocked"),
        F.when(hit, F.concat(F.lit("contains_detection:"), F.array_join(types, ","))).otherwise("clean").alias("reason"),
    )


def high_only_moderation(block: Column, level: Column, block_on_high: bool = True) -> Column:
    """High severity blocks; otherwise the scan's own flag stands."""
    return block | (level == "high") if block_on_high else block


def escalate(df: DataFrame, blocked: str, reason: str) -> DataFrame:
    """A dirty response raises the row to block / high and stores the reason."""
    dirty = F.coalesce(F.col(blocked), F.lit(False))
    moderated = F.map_from_arrays(
        F.array(F.lit("output_moderation")), F.array(F.coalesce(F.col(reason), F.lit("not-run")))
    )
    kept = F.map_filter(F.col("trace_metadata"), lambda k, v: k != "output_moderation")
    return df.withColumns(
        {
            "action": F.when(dirty, "block").otherwise(F.col("action")),
            "severity": F.when(dirty, "high").otherwise(F.col("severity")),
            "trace_metadata": F.map_concat(kept, moderated),
        }
    )


def failure_policy(df: DataFrame, error: str = "error", mode: str = "fail_open") -> DataFrame:
    """Rows whose scan failed pass unmarked (fail_open) or are rejected (fail_closed)."""
    if mode not in ("fail_open", "fail_closed"):
        raise ValueError(f"unknown failure mode {mode!r}")
    failed = F.col(error).isNotNull()
    empty = F.array().cast("array<string>")
    return df.withColumns(
        {
            "detections": F.when(failed, empty).otherwise(F.col("detections")),
            "block": F.when(failed, F.lit(False)).otherwise(F.col("block")),
            "redact": F.when(failed, F.lit(False)).otherwise(F.col("redact")),
            "severity": F.when(failed, "none").otherwise(F.col("severity")),
            "status": F.when(failed & F.lit(mode == "fail_closed"), "reject").otherwise("ok"),
        }
    )


def resolve_tenant(header: Column, claims_json: Column) -> Column:
    """Header first, then the first non-empty of four claims, else the empty string."""
    filled = lambda c: F.when(F.length(c) > 0, c)
    claims = [filled(F.get_json_object(claims_json, f"$.{name}")) for name in TENANT_CLAIMS]
    return F.coalesce(filled(header), *claims, F.lit(""))


def split_by_tenant(df: DataFrame, tenant: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """D10 with required tenants: accepted rows and rows for quarantine."""
    known = F.coalesce(F.length(tenant) > 0, F.lit(False))
    return df.filter(known), df.filter(~known).withColumn("reason", F.lit("tenant context required"))
