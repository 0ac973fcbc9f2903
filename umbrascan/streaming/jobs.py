"""Structured Streaming forms of the jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..operators import audit, decide, metrics, scan, windows

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names; ``fallback`` only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return root


def scan_stream(texts: DataFrame, text_col: str = "text", profile: str = "standard") -> DataFrame:
    """The scan of a text stream: row-local, append mode, no state."""
    scanned = scan.scan(texts, text_col, profile)
    return scanned.withColumn("action", decide.action(F.col("block"), F.col("redact")))


def audit_stream(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    *,
    text_col: str = "text",
    key_col: str = "doc_id",
    timestamp: Column | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Scan and append audit rows.

    Row ids are hashes of the source key and each micro-batch replaces its own folder, so a
    batch replayed after a lost executor or driver leaves no duplicates.
    """
    stamp = F.current_timestamp() if timestamp is None else timestamp

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = audit.build_rows(scan.scan(batch, text_col), text_col=text_col, key_col=key_col, timestamp=stamp)
        rows.write.mode("overwrite").partitionBy("dt").parquet(f"{path}/batch={batch_id}")

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def quota_counts(requests: DataFrame, *, key: str, ts: str = "timestamp", quota: int = windows.QUOTA,
                 window_s: int = windows.QUOTA_WINDOW_S, watermark: str = WATERMARK) -> DataFrame:
    """Requests, allowed and rejected per key and tumbling window."""
    counted = (
        requests.withWatermark(ts, watermark)
        .groupBy(F.window(ts, f"{window_s} seconds").alias("w"), key)
        .agg(F.count("*").alias("requests"))
    )
    return counted.select(
        key,
        F.unix_seconds("w.start").alias("window_start"),
        "requests",
        F.least(F.col("requests"), F.lit(quota).cast("long")).alias("allowed"),
        F.greatest(F.col("requests") - quota, F.lit(0).cast("long")).alias("rejected"),
    )


def sliding_alerts(requests: DataFrame, *, key: str, violation: Column, ts: str = "timestamp",
                   threshold: int = windows.ALERT_THRESHOLD, window_s: int = windows.ALERT_WINDOW_S,
                   slide_s: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """T4, approximate: windows of ``window_s`` sliding by ``slide_s`` with too many violations."""
    counted = (
        requests.filter(violation)
        .withWatermark(ts, watermark)
        .groupBy(F.window(ts, f"{window_s} seconds", f"{slide_s} seconds").alias("w"), key)
        .agg(F.count("*").alias("violations"))
    )
    return counted.filter(F.col("violations") > threshold).select(key, "w.start", "w.end", "violations")


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in time order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class ExactAlerts(StatefulProcessor):
    """T4 for streams without a watermark: state is the last ``threshold`` violation times of the key, in order.

    A violation older than the newest one judged in an earlier micro-batch comes too late to be judged; it is handed on
    with ``late`` set, for the side metric (T8), and leaves the state as it is.  It is exact if every key comes in order.
    """

    def __init__(self, key: str, threshold: int, span_s: float):
        self.key, self.threshold, self.span_s = key, threshold, span_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", StructType([StructField("t", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["seconds", "id"])
        times = [t for (t,) in self.recent.get()]
        newest = times[-1] if times else float("-inf")
        late, shown = [], []
        for t in batch["seconds"]:
            late.append(t < newest)
            # more than ``threshold`` in the span: the threshold-th earlier one is inside it
            shown.append(late[-1] or (len(times) == self.threshold and t - times[0] < self.span_s))
            if not late[-1]:
                times = [*times, t][-self.threshold:]
        self.recent.put([(float(t),) for t in times])
        batch["late"] = late
        hits = batch[pd.Series(shown, index=batch.index, dtype=bool)]
        if len(hits):
            yield pd.DataFrame({self.key: str(key[0]), "id": hits["id"], "seconds": hits["seconds"], "late": hits["late"]})

    def close(self) -> None:
        pass


class WatermarkAlerts(StatefulProcessor):
    """T4, exact: state is the violations of the key by time bucket of one span, from one span before the watermark on.

    A violation that comes out of order takes its place and may complete the alerts of later ones that are there already:
    of its own bucket or the next.  So a batch reads and writes the buckets that it touches and their neighbours, however
    many others the key has.  A violation only ever adds to counts, so an alert is given at once, in the micro-batch that
    completes it, and never again or withdrawn; nothing is left waiting when the stream ends.  Only a violation behind
    the watermark (or without a time) is late: it is handed on with ``late`` set, for the side metric (T8).  Every
    bucket has a timer that drops it once the watermark is a span past it, so a silent key leaves the state.
    """

    def __init__(self, key: str, threshold: int, span_us: int):
        self.key, self.threshold, self.span_us = key, threshold, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packed = StructType([StructField(n, BinaryType()) for n in ("us", "id", "told")])
        self.held = handle.getMapState("held", StructType([StructField("bucket", LongType())]), packed)

    def _bucket(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times in order, ids and whether told, of one bucket."""
        cells = self.held.getValue((number,)) if self.held.containsKey((number,)) else (b"", b"", b"")
        return tuple(np.frombuffer(bytes(c), t) for c, t in zip(cells, ("<i8", "<i8", "?"), strict=True))

    def _judge(self, us: np.ndarray, ids: np.ndarray, horizon: int) -> list[tuple[int, int]]:
        """Takes violations into their buckets and returns the alerts that they complete, as (id, us)."""
        home = us // self.span_us
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        fresh = [int(b) for b in np.unique(home)]
        for b in sorted({n for b in fresh for n in (b - 1, b, b + 1)}):
            held[b] = self._bucket(b)
        for b in fresh:
            if not len(held[b][0]):
                self._expire_later(b, horizon)
            mine = home == b
            joined = [np.concatenate([x, y]) for x, y in zip(held[b], (us[mine], ids[mine], np.zeros(mine.sum(), bool)), strict=True)]
            order = np.lexsort((joined[1], joined[0]))
            held[b] = tuple(x[order] for x in joined)
        alerts, changed = [], set(fresh)
        for b in sorted({n for b in fresh for n in (b, b + 1)}):
            times, names, told = held[b]
            window = np.concatenate([held[b - 1][0], times]) if b - 1 in held else times
            violations = np.searchsorted(window, times, "right") - np.searchsorted(window, times - self.span_us, "right")
            new = (violations > self.threshold) & ~told
            if new.any():
                alerts += list(zip(names[new].tolist(), times[new].tolist(), strict=True))
                held[b] = (times, names, told | new)
                changed.add(b)
        for b in changed:
            self.held.updateValue((b,), tuple(x.astype(t).tobytes() for x, t in zip(held[b], ("<i8", "<i8", "?"), strict=True)))
        return alerts

    def _expire_later(self, bucket: int, horizon: int) -> None:
        expiry = (bucket + 2) * self.span_us // 1000 + 1
        if expiry > horizon // 1000:
            self.handle.registerTimer(expiry)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        horizon = _horizon(timerValues)
        for batch in rows:
            late = batch["us"].isna() | (batch["us"] < horizon)
            on_time = batch[~late]
            alerts = self._judge(on_time["us"].to_numpy(np.int64), on_time["id"].to_numpy(np.int64), horizon) if len(on_time) else []
            told = pd.DataFrame(alerts, columns=["id", "us"]).assign(late=False)
            hits = pd.concat([told, batch.loc[late, ["id", "us"]].assign(late=True)]) if late.any() else told
            if len(hits):
                yield pd.DataFrame({self.key: str(key[0]), "id": hits["id"], "seconds": hits["us"] / 1e6, "late": hits["late"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        horizon = _horizon(timerValues)
        for (bucket,) in list(self.held.keys()):
            if (bucket + 2) * self.span_us <= horizon:
                self.held.removeKey((bucket,))
        return iter([])

    def close(self) -> None:
        pass


def _horizon(timers) -> int:
    """The watermark in microseconds; before the first one, nothing is behind it."""
    ms = timers.getCurrentWatermarkInMs()
    return ms * 1000 if ms > 0 else np.iinfo(np.int64).min


def exact_alerts(requests: DataFrame, *, key: str, violation: Column, ts: str = "timestamp", id_col: str = "id",
                 threshold: int = windows.ALERT_THRESHOLD, window_s: int = windows.ALERT_WINDOW_S,
                 watermark: str | None = WATERMARK) -> DataFrame:
    """T4, exact: violations at which a key exceeds the rule, and (``late``) those that came too late to be judged.

    Only key, id and time are shuffled.  Without a watermark the micro-batches must come in order of time.
    """
    marked = requests if watermark is None else requests.withWatermark(ts, watermark)
    # the handler sees late rows as well: the shuffled columns don't carry the watermark, so Spark drops none
    narrow = marked.filter(violation).select(
        F.col(key).cast("string").alias(key), F.col(id_col).cast("long").alias("id"), F.unix_micros(ts).alias("us"),
    )
    schema = f"{key} string, id long, seconds double, late boolean"
    if watermark is None:
        timed = narrow.withColumn("seconds", F.col("us") / 1e6)
        return timed.groupBy(key).transformWithStateInPandas(ExactAlerts(key, threshold, window_s), schema, "Append", "None")
    alerts = WatermarkAlerts(key, threshold, window_s * 1_000_000)
    return narrow.groupBy(key).transformWithStateInPandas(alerts, schema, "Append", "EventTime")


class SloMonitor(StatefulProcessor):
    """T5: the last ``window`` latencies in buckets of BUCKET samples, and running totals; one status row per micro-batch.

    A batch writes the newest buckets and drops the ones that the window has left; the others are read for the percentile
    only.  A service without requests for ``idle_ms`` of event time leaves the state.  Samples count in order of arrival,
    inside a micro-batch in order of time.
    """

    BUCKET = 256

    def __init__(self, window: int, idle_ms: int):
        self.window, self.idle_ms = window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState(
            "buckets", StructType([StructField("bucket", LongType())]), StructType([StructField("ms", BinaryType())])
        )
        self.totals = handle.getValueState(
            "totals", StructType([StructField("n", LongType()), StructField("errors", LongType()), StructField("newest", LongType())])
        )

    def _read(self, bucket: int) -> np.ndarray:
        (cell,) = self.buckets.getValue((bucket,)) if self.buckets.containsKey((bucket,)) else (b"",)
        return np.frombuffer(bytes(cell), "<f8")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["seconds", "id"])
        n, errors, newest = self.totals.get() if self.totals.exists() else (0, 0, 0)
        fresh, first = batch["ms"].to_numpy("<f8"), n // self.BUCKET
        start = n  # number of the first fresh sample
        n, errors = n + len(batch), errors + int(batch["is_error"].sum())
        seen = batch["seconds"].max()
        newest = max(newest, int(seen * 1000)) if pd.notna(seen) else newest
        self.totals.update((n, errors, newest))
        joined = np.concatenate([self._read(first)[: start - first * self.BUCKET], fresh])
        low = max(0, n - self.window)
        for b in range(max(first, low // self.BUCKET), (n - 1) // self.BUCKET + 1):
            at = (b - first) * self.BUCKET
            self.buckets.updateValue((b,), (joined[at : at + self.BUCKET].tobytes(),))
        for (b,) in list(self.buckets.keys()):
            if b < low // self.BUCKET:
                self.buckets.removeKey((b,))
        older = [self._read(b) for b in range(low // self.BUCKET, first)]
        window = np.concatenate([*older, joined])[-(n - low):]
        p95 = float(np.sort(window)[int(0.95 * (len(window) - 1))])
        rate = errors / max(1, n)
        if newest + self.idle_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(newest + self.idle_ms)
        breach = len(window) >= metrics.SLO_MIN_SAMPLES and (
            p95 > metrics.SLO_P95_MS or rate > metrics.SLO_ERROR_RATE
        )
        yield pd.DataFrame(
            {"service": [str(key[0])], "total": [n], "samples": [len(window)], "p95_ms": [round(p95, 2)],
             "error_rate": [round(rate, 4)], "breach": [breach]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists() and self.totals.get()[2] + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            self.totals.clear()
            self.buckets.clear()
        return iter([])

    def close(self) -> None:
        pass


def slo_monitor(requests: DataFrame, *, service: Column, ts: str = "timestamp", id_col: str = "id",
                latency_ms: str = "latency_ms", is_error: str = "is_error",
                window: int = metrics.SLO_WINDOW, watermark: str = WATERMARK, idle_s: int = 7 * 86_400) -> DataFrame:
    """T5: SLO status per service after each micro-batch.

    The state of a service is ``window`` samples and its totals; it ends when the service is silent for ``idle_s``.
    """
    narrow = requests.withWatermark(ts, watermark).select(
        service.cast("string").alias("service"), F.col(id_col).cast("long").alias("id"),
        (F.unix_micros(ts) / 1e6).alias("seconds"), F.col(latency_ms).cast("double").alias("ms"),
        F.col(is_error).alias("is_error"),
    )
    return narrow.groupBy("service").transformWithStateInPandas(
        SloMonitor(window, idle_s * 1000),
        "service string, total long, samples long, p95_ms double, error_rate double, breach boolean",
        "Update", "EventTime",
    )


class AlertSuppressor(StatefulProcessor):
    """State is the sent times of the recipient that still count, at most ``limit``.

    An alert is judged when it arrives, as a mailer must; inside a micro-batch in order of time.  A timer ends the state
    once the watermark is a span past the last alert sent.
    """

    def __init__(self, limit: int, span_us: int):
        self.limit, self.span_us = limit, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getListState("sent", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, ["us", "id"])
        history = [t for (t,) in self.sent.get()]
        timed = batch["us"].notna().to_numpy()
        flags = np.zeros(len(batch), bool)
        flags[timed], history = windows.sent_flags(batch.loc[timed, "us"].to_numpy(np.int64), history, self.limit, self.span_us)
        self.sent.put([(int(t),) for t in history])
        if history and (expiry := (history[-1] + self.span_us) // 1000 + 1) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(expiry)
        yield pd.DataFrame(
            {"recipient": [str(key[0])] * len(batch), "id": batch["id"], "seconds": batch["us"] / 1e6, "sent": flags}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        history = [t for (t,) in self.sent.get()]
        if not history or history[-1] + self.span_us <= _horizon(timerValues):
            self.sent.clear()
        return iter([])

    def close(self) -> None:
        pass


def suppress_alerts(alerts: DataFrame, *, recipient: str = "recipient", ts: str = "ts", id_col: str = "id",
                    limit: int = windows.MAX_ALERTS_PER_HOUR, span_s: int = windows.ALERT_SPAN_S,
                    watermark: str = WATERMARK) -> DataFrame:
    """Alerts with a ``sent`` flag: at most ``limit`` sent per recipient in the trailing span.  Alerts without a time are not sent."""
    narrow = alerts.withWatermark(ts, watermark).select(
        F.col(recipient).cast("string").alias("recipient"), F.col(id_col).cast("long").alias("id"), F.unix_micros(ts).alias("us"),
    )
    return narrow.groupBy("recipient").transformWithStateInPandas(
        AlertSuppressor(limit, span_s * 1_000_000), "recipient string, id long, seconds double, sent boolean", "Append", "EventTime"
    )


def run_available(
    stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Drain everything a source holds now into ``sink`` and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def late_rows(requests: DataFrame, batch_max: Column, ts: str = "timestamp", minutes: int = 10) -> DataFrame:
    """Rows older than the watermark would allow, for the side metric."""
    return requests.filter(F.col(ts) < batch_max - F.expr(f"interval {minutes} minutes"))


def split_late(path: str, ts: str = "timestamp", minutes: int = 10) -> Callable[[DataFrame, int], None]:
    """A sink that writes rows to ``path/rows``, parted by whether they are ``late``, and counts to ``path/counts``.

    A row is late if it lies more than ``minutes`` behind the newest row of all earlier micro-batches; a row without a time is.
    The counts of a micro-batch are observed while its rows are written, one pass over the batch.  What earlier batches saw
    is read from their counts, and every folder is replaced on replay, so a batch that runs again gives the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = "n long, late long, newest_us long"
        before = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/counts") if batch_id else spark.createDataFrame([], f"{schema}, batch long")
        newest = before.filter(F.col("batch") < batch_id).agg(F.max("newest_us")).first()[0]
        seen = Observation()
        behind = F.lit(False) if newest is None else F.unix_micros(ts) < newest - minutes * 60_000_000
        late = F.coalesce(behind, F.lit(True)) | F.col(ts).isNull()
        marked = batch.withColumn("late", late).observe(
            seen, F.count("*").alias("n"), F.count_if("late").alias("late"), F.unix_micros(F.max(ts)).alias("newest_us")
        )
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
        found = spark.createDataFrame([(seen.get["n"], seen.get["late"], seen.get["newest_us"])], schema)
        found.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")

    return write


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to its own folder, replay-safe."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


__all__ = [
    "append_batches", "audit_stream", "checkpoint_root", "exact_alerts", "late_rows", "quota_counts",
    "run_available", "scan_stream", "sliding_alerts", "slo_monitor", "split_late", "suppress_alerts",
]
