"""Audit-table jobs: build, encrypt, query, retain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from . import decide

PLACEHOLDER = "__encrypted__"
REDACTED = "[REDACTED]"
AUDIT_SCHEMA = (
    "id string, timestamp timestamp, user_id string, tenant_id string, redacted_prompt string, "
    "redacted_prompt_ciphertext string, redacted_prompt_key_id string, redacted_fingerprint string, "
    "detection_types array<string>, trace_metadata map<string,string>, action string, severity string, "
    "llm_response_redacted string, dt date"
)


def as_utc(ts: str) -> Column:
    """A zone-less or zoned event time as an instant (session zone is UTC in every job)."""
    return F.col(ts).cast("timestamp")


def trace_metadata(request_type: str, policy_version: str = "v1", moderation: Column | None = None) -> Column:
    """Policy version, request type and moderation result."""
    return F.create_map(
        F.lit("policy_version"), F.lit(policy_version),
        F.lit("request_type"), F.lit(request_type),
        F.lit("output_moderation"), F.lit("not-run") if moderation is None else moderation,
    )


def build_rows(
    scanned: DataFrame,
    *,
    text_col: str = "text",
    key_col: str = "doc_id",
    timestamp: Column,
    user_id: Column | None = None,
    tenant_id: Column | None = None,
    request_type: str = "detect",
    only_detected: bool = True,
    clean_action: str = "redact",
) -> DataFrame:
    """A1: scanned rows as audit rows.

    The detect path logs only rows with detections and writes block/redact; the worker path
    (``only_detected=False, clean_action="pass"``) logs every row.  Ids are hashes of the
    source key, so a re-run writes the same ids.
    """
    rows = scanned.filter(F.size("detections") > 0) if only_detected else scanned
    fingerprint = checks.fingerprint(F.col(text_col)) if request_type == "detect" else F.lit("")
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(request_type), F.col(key_col).cast("string")), 256).alias("id"),
        timestamp.alias("timestamp"),
        (F.lit("direct-api") if user_id is None else user_id).cast("string").alias("user_id"),
        (F.lit(None) if tenant_id is None else tenant_id).cast("string").alias("tenant_id"),
        checks.html_escape(F.coalesce("redacted_text", F.lit(""))).alias("redacted_prompt"),
        F.lit(None).cast("string").alias("redacted_prompt_ciphertext"),
        F.lit(None).cast("string").alias("redacted_prompt_key_id"),
        fingerprint.alias("redacted_fingerprint"),
        F.col("detections").alias("detection_types"),
        trace_metadata(request_type).alias("trace_metadata"),
        F.when(F.col("block"), "block").otherwise(clean_action).alias("action"),
        F.col("severity"),
        F.lit(None).cast("string").alias("llm_response_redacted"),
        F.to_date(timestamp).alias("dt"),
    )


def log_rows(requests: DataFrame, moderated: bool = True) -> DataFrame:
    """The log path: sanitize, fingerprint the prompt, moderate the response, escalate.

    Input columns: ``user_id, tenant_id, redacted_prompt, detection_types, action, severity,
    llm_response_redacted, timestamp`` and, when ``moderated``, ``response_blocked`` and
    ``response_reason`` from a scan of the sanitized response.
    """
    out = requests.withColumns(
        {
            "user_id": checks.html_escape(F.col("user_id").cast("string")),
            "redacted_prompt": checks.html_escape(F.col("redacted_prompt")),
            "llm_response_redacted": checks.html_escape(F.col("llm_response_redacted")),
            "trace_metadata": trace_metadata("log"),
            "action": decide.canonical_action(F.col("action")),
            "dt": F.to_date("timestamp"),
        }
    )
    out = out.withColumn("redacted_fingerprint", checks.fingerprint(F.col("redacted_prompt")))
    if moderated:
        out = decide.escalate(out, "response_blocked", "response_reason")
        out = out.drop("response_blocked", "response_reason")
    return out


# --- encryption ---------------------------------------------------------------------


def encrypt(df: DataFrame, key: Column, key_id: str, column: str = "redacted_prompt") -> DataFrame:
    """AES-GCM ciphertext and key id beside a placeholder.  A bad key fails the job;
    clear text is never written as a fallback."""
    sealed = F.base64(F.aes_encrypt(F.col(column), key, F.lit("GCM")))
    return df.withColumns(
        {
            f"{column}_ciphertext": sealed,
            f"{column}_key_id": F.lit(key_id),
            column: F.lit(PLACEHOLDER),
        }
    )


def decrypt(df: DataFrame, keys: dict[str, Column], column: str = "redacted_prompt", out_col: str = "decrypted") -> DataFrame:
    """Clear text by key id; null where the key is unknown or the ciphertext is damaged."""
    sealed = F.unbase64(F.col(f"{column}_ciphertext"))
    clear = F.lit(None).cast("string")
    for key_id, key in keys.items():
        opened = F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")
        clear = F.when(F.col(f"{column}_key_id") == key_id, opened).otherwise(clear)
    return df.withColumn(out_col, clear)


def verify_encryption(df: DataFrame, keys: dict[str, Column], column: str = "redacted_prompt") -> DataFrame:
    """Rows per key id, how many cannot be opened, and, with a ``redacted_fingerprint`` column, how many open to another text."""
    opened = decrypt(df, keys, column).filter(F.col(f"{column}_ciphertext").isNotNull())
    counts = [F.count("*").alias("rows"), F.count_if(F.col("decrypted").isNull()).alias("failures")]
    if "redacted_fingerprint" in df.columns:
        counts.append(F.count_if(checks.fingerprint(F.col("decrypted")) != F.col("redacted_fingerprint")).alias("mismatches"))
    return opened.groupBy(f"{column}_key_id").agg(*counts)


def rotate_key(
    df: DataFrame, old: dict[str, Column], new_key: Column, new_id: str, column: str = "redacted_prompt"
) -> DataFrame:
    """Re-encrypt rows sealed with an old key.  Rows that cannot be opened stay as they are."""
    opened = decrypt(df, old, column)
    sealed = F.base64(F.aes_encrypt(F.col("decrypted"), new_key, F.lit("GCM")))
    moved = F.col("decrypted").isNotNull()
    return opened.withColumns(
        {
            f"{column}_ciphertext": F.when(moved, sealed).otherwise(F.col(f"{column}_ciphertext")),
            f"{column}_key_id": F.when(moved, F.lit(new_id)).otherwise(F.col(f"{column}_key_id")),
        }
    ).drop("decrypted")


# --- queries --------------------------------------------------------------------------


def query(
    log: DataFrame,
    *,
    severity: str | None = None,
    user_id: str | None = None,
    tenant_id: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    tie: str = "id",
) -> DataFrame:
    """Optional equality filters, newest first; all rows, or the page that ``limit`` and ``offset`` name."""
    for column, wanted in (("severity", severity), ("user_id", user_id), ("tenant_id", tenant_id)):
        if wanted:
            log = log.filter(F.col(column) == wanted)
    ordered = log.orderBy(F.desc("timestamp"), F.asc(tie)).offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def purge(log: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    """Rows younger than the cutoff.  The date filter prunes whole partitions."""
    cutoff = as_of - dt.timedelta(days=days)
    return log.filter((F.col("dt") >= F.lit(cutoff.date())) & (F.col("timestamp") >= F.lit(cutoff)))


def latest_per_key(log: DataFrame, n: int, key: str = "user_id", ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows of every key.

    The rank filter is pushed into a per-partition group limit before the shuffle, so a hot
    key sends at most ``n`` rows per input partition.
    """
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.asc(tie))
    return log.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= n).drop("__rn")


def leaks(log: DataFrame, column: str = "redacted_prompt") -> DataFrame:
    """Stored prompts longer than ten characters that show no redaction."""
    return log.filter(~F.contains(F.col(column), F.lit(REDACTED)) & (F.length(column) > 10))


def leak_summary(log: DataFrame, column: str = "redacted_prompt") -> DataFrame:
    leaked = ~F.contains(F.col(column), F.lit(REDACTED)) & (F.length(column) > 10)
    return log.agg(F.count("*").alias("total"), F.count_if(leaked).alias("unredacted"))


def repeats(texts: DataFrame, text_col: str, key_col: str) -> DataFrame:
    """Fingerprints that occur more than once; only the 64-character hash is shuffled."""
    hashed = texts.select(checks.fingerprint(F.col(text_col)).alias("fingerprint"), F.col(key_col).alias("key"))
    return (
        hashed.groupBy("fingerprint")
        .agg(F.count("*").alias("copies"), F.min("key").alias("first_key"))
        .filter(F.col("copies") > 1)
    )


def split_seen_indexed(prompts: DataFrame, index: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """J5 against a ``fingerprint_index`` table: only the prompts are shuffled, into the index's buckets."""
    keyed = prompts.withColumn("__fp", checks.fingerprint(F.col(text_col)))
    known = index.select(F.col("redacted_fingerprint").alias("__fp")).hint("merge")
    return keyed.join(known, "__fp", "left_semi").drop("__fp"), keyed.join(known, "__fp", "left_anti").drop("__fp")


def split_seen(prompts: DataFrame, log: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Prompts already in the log and new ones, by fingerprint.

    The log side is reduced to distinct fingerprints first, so one fingerprint holding a
    large share of the log becomes a single row before the join.
    """
    known = log.select(F.col("redacted_fingerprint").alias("__fp")).filter("__fp is not null").distinct()
    keyed = prompts.withColumn("__fp", checks.fingerprint(F.col(text_col)))
    seen = keyed.join(known, "__fp", "left_semi").drop("__fp")
    new = keyed.join(known, "__fp", "left_anti").drop("__fp")
    return seen, new
