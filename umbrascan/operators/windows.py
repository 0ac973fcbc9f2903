"""Quotas, alert rules and rolling SLO windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, metrics

# --- fixed values -----------------------------------------------------------
QUOTA = 60
QUOTA_WINDOW_S = 60
ALERT_THRESHOLD = 3
ALERT_WINDOW_S = 60
MAX_ALERTS_PER_HOUR = 10
ALERT_SPAN_S = 3600
# ------------------------------------------------------------------------------
#: times in one row of a suppression walk
PACKED = 1 << 16


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed epoch window, in seconds."""
    return F.floor(F.unix_seconds(ts) / seconds) * seconds


def quota_decisions(
    requests: DataFrame,
    *,
    key: str,
    ts: str = "timestamp",
    tie: str = "id",
    quota: int | Column = QUOTA,
    window_s: int = QUOTA_WINDOW_S,
) -> DataFrame:
    """Allow a request while its rank inside (key, epoch window) is within the quota.

    The partition key includes the window, so even a key with a third of all requests is
    spread over its minutes.
    """
    out = requests.withColumn("window_start", window_start(F.col(ts), window_s))
    rank = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, tie))
    limit = F.lit(quota) if isinstance(quota, int) else quota
    return out.withColumn("rank", rank).withColumn("allowed", F.col("rank") <= limit)


def quota_counts(requests: DataFrame, *, key: str, ts: str = "timestamp", quota: int = QUOTA,
                 window_s: int = QUOTA_WINDOW_S) -> DataFrame:
    """W1 as counts: requests, allowed and rejected per key and window (partial aggregation, no ranking)."""
    counted = requests.groupBy(key, window_start(F.col(ts), window_s).alias("window_start")).agg(
        F.count("*").alias("requests")
    )
    return counted.withColumns(
        {
            "allowed": F.least(F.col("requests"), F.lit(quota).cast("long")),
            "rejected": F.greatest(F.col("requests") - quota, F.lit(0).cast("long")),
        }
    )


def with_policy(requests: DataFrame, policy: DataFrame, key: str, default_quota: int = QUOTA) -> DataFrame:
    """Add each key's quota, with a default for keys without a policy row.

    How to join is left to the planner, which sees the policy table's size at run time.
    """
    return requests.join(policy, key, "left").withColumn("quota", F.coalesce("quota", F.lit(default_quota)))


def alert_rule(
    requests: DataFrame,
    *,
    key: str,
    violation: Column,
    ts: str = "timestamp",
    threshold: int = ALERT_THRESHOLD,
    window_s: int = ALERT_WINDOW_S,
) -> DataFrame:
    """Violations at which one key has more than ``threshold`` of them in under ``window_s``.

    Violations are counted over a range frame of the span.  Keys are cut into time slices of an hour with a carried-over
    edge, so a hot key is not one task.
    """
    bad = requests.filter(violation).withColumn("__us", F.unix_micros(F.col(ts)))
    slice_us = 3_600 * 1_000_000
    span_us = window_s * 1_000_000
    home = F.floor(F.col("__us") / slice_us)
    # A row also serves as history for the next slice if it lies within one span of its start.
    next_edge = (home + 1) * slice_us - F.col("__us") < span_us
    copies = F.when(next_edge, F.array(home, home + 1)).otherwise(F.array(home))
    sliced = bad.withColumn("__home", home).withColumn("__slice", F.explode(copies))
    order = Window.partitionBy(key, "__slice").orderBy("__us")
    frame = order.rangeBetween(-(span_us - 1), 0)
    counted = sliced.withColumn("violations", F.count("*").over(frame))
    hits = counted.filter((F.col("__slice") == F.col("__home")) & (F.col("violations") > threshold))
    return hits.drop("__us", "__home", "__slice")


def alert_triggers(log: DataFrame) -> DataFrame:
    """Only high severity raises an alert."""
    return log.filter(F.col("severity") == "high")


def sent_flags(times: np.ndarray, history: list, limit: int, span: float) -> tuple[np.ndarray, list]:
    """Greedy trailing cap over ordered times, continuing from ``history`` (sent times).

    An alert is sent while fewer than ``limit`` sent alerts are younger than ``span``.  The
    walk jumps from one sent alert to the next, so its cost follows the alerts sent, which
    the cap bounds, not the alerts raised.
    """
    flags = np.zeros(len(times), dtype=bool)
    at = 0
    while at < len(times):
        if len(history) >= limit:
            at += int(np.searchsorted(times[at:], history[-limit] + span, side="left"))
            if at >= len(times):
                break
        flags[at] = True
        history = [*history, times[at].item()][-limit:]
        at += 1
    return flags, history


def suppress_alerts(
    alerts: DataFrame,
    *,
    recipient: str = "recipient",
    ts: str = "ts",
    tie: str = "id",
    limit: int = MAX_ALERTS_PER_HOUR,
    span_s: int = ALERT_SPAN_S,
) -> DataFrame:
    """``recipient, ts, tie`` plus ``sent``: at most ``limit`` sent alerts in any trailing span.

    Whether an alert is sent depends on the ones sent before, so a recipient's alerts must be walked in order.  The walk
    jumps from sent alert to sent alert and needs nothing of the others but their times.  So the alerts are written in
    balanced blocks, and only packed times travel to a recipient's walk: one row per PACKED alerts, read as they come, with
    ``limit`` times as the whole state.  What the walk returns, the numbers of the sent alerts, is joined to the blocks
    again by number.  A recipient with most of all alerts is spread over blocks before and after the walk, and costs the
    walk itself eight bytes and no work per alert that is not sent.  Alerts without a time are not sent.
    """
    us = F.unix_micros(F.col(ts)).alias("__us")
    rows = blocks.in_blocks(alerts.select(recipient, ts, tie, us), [recipient, "__us", tie], "alerts")
    order = Window.partitionBy(recipient, blocks.BLOCK).orderBy("__us", tie)
    rows = rows.withColumn("__row", F.row_number().over(order) - 1)
    rows = rows.withColumns({"__part": F.floor(F.col("__row") / PACKED), "__at": F.pmod("__row", F.lit(PACKED)).cast("int")})
    timed = rows.filter("__us IS NOT NULL")
    packed = timed.groupBy(recipient, blocks.BLOCK, "__part").agg(F.sort_array(F.collect_list(F.struct("__at", "__us"))).alias("times"))
    packed = packed.select(recipient, blocks.BLOCK, "__part", F.col("times.__at").alias("ats"), F.col("times.__us").alias("times"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, history = (), []
        for batch in batches:
            places: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                if (name,) != current:
                    current, history = (name,), []
                times = np.asarray(batch.column(4)[i].values)
                flags, history = sent_flags(times, history, limit, span_s * 1_000_000)
                sent = np.asarray(batch.column(3)[i].values)[flags].tolist()
                for column, value in zip(places, (name, batch.column(1)[i].as_py(), batch.column(2)[i].as_py())):
                    column.extend([value] * len(sent))
                places[3].extend(sent)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int32()]
            names = [recipient, blocks.BLOCK, "__part", "__at"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(places, kinds)], names)

    kind = rows.schema[recipient].dataType.simpleString()
    ordered = packed.repartition(recipient).sortWithinPartitions(recipient, blocks.BLOCK, "__part")
    sent = ordered.mapInArrow(walk, f"`{recipient}` {kind}, {blocks.BLOCK} int, __part long, __at int").withColumn("sent", F.lit(True))
    place = [recipient, blocks.BLOCK, "__part", "__at"]
    flagged = rows.join(sent.withColumnsRenamed({c: f"{c}_s" for c in place}), [rows[c].eqNullSafe(F.col(f"{c}_s")) for c in place], "left")
    return flagged.select(recipient, ts, tie, F.coalesce("sent", F.lit(False)).alias("sent"))


def slo_breaches(
    requests: DataFrame,
    *,
    ts: str = "timestamp",
    tie: str = "id",
    latency_ms: str = "latency_ms",
    is_error: str = "is_error",
    by: list[str] | None = None,
    window: int = metrics.SLO_WINDOW,
) -> DataFrame:
    """Per sample, rolling p95 of the last ``window`` samples and the running error rate.

    "p95 > target" is decided without sorting: with n samples the value at index
    floor(0.95 (n-1)) exceeds the target exactly if at least n - index of them do, so a
    rolling count of slow samples is enough.  The log is written once in balanced blocks; running counts take one row of
    totals per block, and the rolling count takes each block with an edge of ``window`` rows: no join of the log with
    itself, and neither a key nor an hour is one task.
    """
    keys = by or []
    slow = F.coalesce((F.col(latency_ms) > metrics.SLO_P95_MS).cast("long"), F.lit(0))
    bad = F.coalesce(F.col(is_error).cast("long"), F.lit(0))
    ordered = blocks.in_blocks(requests.withColumns({"__slow": slow, "__bad": bad}), [*keys, ts, tie], "slo")
    rows = blocks.numbered(ordered, keys, [ts, tie], {"__errors": F.col("__bad")})
    rows = blocks.trailing(rows, keys, "__seq", "__slow", window, "__slow_in_window")
    size = F.least(F.col("__seq"), F.lit(window))
    over_p95 = F.col("__slow_in_window") >= size - metrics.p95_rank(size)
    rate = F.col("__errors") / F.col("__seq")
    out = rows.withColumns(
        {
            "samples": size,
            "error_rate": F.bround(rate, 4),
            "p95_over": over_p95,
            "breach": (size >= metrics.SLO_MIN_SAMPLES) & (over_p95 | (rate > metrics.SLO_ERROR_RATE)),
        }
    )
    return out.drop("__seq", "__slow", "__bad", "__errors", "__slow_in_window")


def last_user_turn(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Number of the last user turn of each conversation (map-side combined maximum)."""
    return turns.filter(F.col(role) == "user").groupBy(conv).agg(F.max(turn).alias(turn))
