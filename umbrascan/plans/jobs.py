"""Whole jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..operators import audit, conversation, decide, scan, spans
from ..operators.rules import Profile
from ..sources import readers, writers


def detect_job(texts: DataFrame, timestamp: Column, *, text_col: str = "text", key_col: str = "doc_id",
               profile: str | Profile = "standard", tenant_id: Column | None = None) -> DataFrame:
    """The detect path: scan and build audit rows for texts with detections."""
    scanned = scan.scan(texts, text_col, profile)
    return audit.build_rows(scanned, text_col=text_col, key_col=key_col, timestamp=timestamp, tenant_id=tenant_id)


def worker_job(texts: DataFrame, timestamp: Column, *, text_col: str = "text", key_col: str = "doc_id",
               user_id: Column | None = None) -> DataFrame:
    """A2: batch detect-and-log; every text gets a row, action block or pass."""
    scanned = scan.scan(texts, text_col)
    return audit.build_rows(
        scanned, text_col=text_col, key_col=key_col, timestamp=timestamp,
        user_id=F.lit("worker") if user_id is None else user_id,
        request_type="worker", only_detected=False, clean_action="pass",
    )


def log_job(requests: DataFrame, profile: str | Profile = "hardened") -> DataFrame:
    """The log path: the sanitized response is moderated strictly, dirty rows escalate."""
    shown = checks.html_escape(F.col("llm_response_redacted"))
    scanned = scan.scan_types(requests.withColumn("__response", shown), "__response", profile)
    verdict = decide.strict_moderation(F.col("detections"))
    present = F.length("__response") > 0
    judged = scanned.withColumns(
        {
            "response_blocked": F.coalesce(present & verdict["blocked"], F.lit(False)),
            "response_reason": F.when(present, verdict["reason"]),
        }
    ).drop("__response", "detections")
    return audit.log_rows(judged)


def intercept_job(flows: DataFrame, profile: str | Profile = "standard") -> DataFrame:
    """Interception: watched traffic, joined prompt, scan, rewritten payload and action."""
    prompts = conversation.prompt_text(conversation.parse_payloads(conversation.target_traffic(flows)))
    judged = scan.scan(prompts, "full_text", profile)
    routed = judged.withColumn("action", decide.action(F.col("block"), F.col("redact")))
    rewritten = conversation.redact_last_user(routed)
    forwarded = F.when(F.col("action") != "block", F.to_json(F.struct("messages")))
    return rewritten.withColumn("forwarded_body", forwarded)


def request_log(prompts: DataFrame, *, text_col: str, api_key: Column, timestamp: Column,
                latency_ms: Column | None = None) -> DataFrame:
    """Client-side audit rows of the span profile: origin hash, preview, action, patterns."""
    scanned = spans.scan_spans(prompts, text_col)
    key = api_key.cast("string")
    return scanned.select(
        timestamp.alias("timestamp"),
        key.alias("api_key"),
        checks.origin_hash(F.concat(key, F.substring(text_col, 1, 16))).alias("origin_hash"),
        checks.preview(F.col(text_col)).alias("raw_preview"),
        "redacted_prompt",
        decide.canonical_action(F.col("action")).alias("action"),
        F.col("triggered").alias("triggered_patterns"),
        (F.lit(None).cast("double") if latency_ms is None else latency_ms).alias("latency_ms"),
    )


def scan_to_tables(texts: DataFrame, timestamp: Column, audit_path: str, quarantine_path: str, *,
                   text_col: str = "text", key_col: str = "doc_id", profile: str | Profile = "standard",
                   reject: bool = False) -> None:
    """Scan every text and append the audit table.  Texts that fail the validation are also listed, with the reason,
    in a second table; with ``reject`` they are listed only."""
    valid, rejected = readers.validate(texts, text_col)
    rejected.write.mode("append").parquet(quarantine_path)
    scanned = valid if reject else texts
    writers.append_audit(detect_job(scanned, timestamp, text_col=text_col, key_col=key_col, profile=profile), audit_path)
