"""Chat payloads and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decide, scan
from .rules import Profile

# --- fixed values -----------------------------------------------------------
TARGET_HOSTS = ["api.openai.com", "api.anthropic.com"]
TARGET_PATH = "/v1/chat/completions"
MESSAGES = "struct<messages:array<struct<role:string,content:string>>>"


def target_traffic(flows: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """S3: traffic to the watched hosts and path."""
    return flows.filter(F.col(host).isin(TARGET_HOSTS) & F.contains(F.col(path), F.lit(TARGET_PATH)))


def parse_payloads(flows: DataFrame, body: str = "body") -> DataFrame:
    """Messages of a JSON body; contents that are not strings count as absent."""
    parsed = F.from_json(
        F.col(body), "struct<messages:array<struct<role:string,content:variant>>>"
    )["messages"]
    messages = F.transform(
        parsed,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when(F.schema_of_variant(m["content"]) == "STRING", F.try_variant_get(m["content"], "$", "string")).alias("content"),
        ),
    )
    return flows.withColumn("messages", messages)


def prompt_text(flows: DataFrame, messages: str = "messages") -> DataFrame:
    """Contents joined with one space; payloads without text are skipped."""
    contents = F.filter(F.transform(messages, lambda m: m["content"]), lambda c: c.isNotNull())
    joined = flows.withColumn("full_text", F.array_join(contents, " "))
    return joined.filter(F.length("full_text") > 0)


def conversation_text(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """S2, table form: one row per conversation with its turns joined in order.

    A conversation is one prompt in the reference, so its joined text must exist as one
    value; its size is the size of that prompt.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn), F.col(text))))
    spoken = turns.filter(F.col(text).isNotNull())
    return (
        spoken.groupBy(conv)
        .agg(F.array_join(F.transform(ordered, lambda s: s[text]), " ").alias("full_text"))
        .filter(F.length("full_text") > 0)
    )


def redact_last_user(payloads: DataFrame, messages: str = "messages", redacted: str = "redacted_text") -> DataFrame:
    """X5 on payload rows: the last user message becomes the redacted joined text."""
    last = F.array_max(
        F.transform(messages, lambda m, i: F.when(m["role"] == "user", i).otherwise(-1))
    )
    rewritten = F.transform(
        messages,
        lambda m, i: F.when(F.col("redact") & (i == last), F.struct(m["role"].alias("role"), F.col(redacted).alias("content"))).otherwise(m),
    )
    return payloads.withColumn(messages, rewritten)


def redact_conversations(
    turns: DataFrame,
    profile: str | Profile = "standard",
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """X5/J2, table form: turns with the last user turn of flagged conversations replaced."""
    joined = conversation_text(turns, conv, turn, text)
    judged = scan.scan(joined, "full_text", profile).select(conv, "block", "redact", "redacted_text")
    last = turns.filter(F.col(role) == "user").groupBy(conv).agg(F.max(turn).alias("__last"))
    flagged = judged.filter("redact or block").join(last, conv, "left")
    out = turns.join(flagged, conv, "left")
    block = F.coalesce("block", F.lit(False))
    redact = F.coalesce("redact", F.lit(False))
    swap = redact & ~block & (F.col(turn) == F.col("__last"))
    return out.withColumns(
        {text: F.when(swap, F.col("redacted_text")).otherwise(F.col(text)), "action": decide.action(block, redact)}
    ).drop("block", "redact", "redacted_text", "__last")


def moderate_turns(turns: DataFrame, text: str = "text", profile: str | Profile = "hardened") -> DataFrame:
    """Both moderation policies on every turn."""
    scanned = scan.scan_types(turns, text, profile)
    scanned = decide.with_decision(scanned, profile)
    strict = decide.strict_moderation(F.col("detections"))
    return scanned.withColumns(
        {
            "strict_blocked": strict["blocked"],
            "reason": strict["reason"],
            "high_blocked": decide.high_only_moderation(F.col("block"), F.col("severity")),
        }
    )


def redact_responses(responses: DataFrame, text: str = "response", profile: str | Profile = "standard") -> DataFrame:
    """A flagged response is replaced as a whole by its redacted text; blocked ones are withheld."""
    scanned = scan.scan(responses, text, profile)
    shown = F.when(F.col("block"), F.lit(None).cast("string")).otherwise(F.col("redacted_text"))
    return scanned.withColumn("shown_response", shown)


def gate(scanned: DataFrame) -> dict[str, DataFrame]:
    """Blocked, redacted and passing rows of one scan.  Write the scan first if all three are used."""
    routed = scanned.withColumn("action", decide.action(F.col("block"), F.col("redact")))
    return {a: routed.filter(F.col("action") == a) for a in ("block", "redact", "pass")}
