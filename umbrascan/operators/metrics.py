"""Metrics over a request log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

# --- fixed values -----------------------------------------------------------
SLO_WINDOW = 3000
SLO_MIN_SAMPLES = 20
SLO_P95_MS = 300.0
SLO_ERROR_RATE = 0.01
LATENCY_BOUNDS_MS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)  # ours


def health(blocked: Column, total: Column) -> Column:
    """100 minus the rounded blocked percentage, at least 0; 100 for an empty log."""
    share = F.floor(blocked / F.nullif(total, F.lit(0)) * 100 + 0.5)
    return F.when(total == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), 100 - share)).cast("long")


def kpi_block(log: DataFrame, by: list[str] | None = None, action: str = "action", types: str = "types") -> DataFrame:
    """Totals, blocked, redacted, detected tokens and health, optionally per group."""
    return log.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(action) == "block").alias("blocked"),
        F.count_if(F.col(action) == "redact").alias("redacted"),
        F.coalesce(F.sum(F.size(types)), F.lit(0)).alias("tokens"),
        health(F.count_if(F.col(action) == "block"), F.count("*")).alias("health"),
    )


#: rows that a bracket may hold when it is ranked, steps of the sketched grid, and the sketch's accuracy (finer than a step)
RANKED, GRID, ACCURACY = 100_000, 500, 10_000


def rank_pick(
    log: DataFrame, value: str, rank: Callable[[Column], Column], out_col: str, by: list[str] | None = None, ranked: int = RANKED
) -> DataFrame:
    """The value at a zero-based rank of a sorted column, whole or per group, exactly, whatever the range of values.

    A mergeable quantile sketch gives a grid of values; the rank lies between the steps next to its own share, as the
    sketch is finer than a step.  One exact pass counts the rows below that bracket and inside it.  Brackets of more than
    ``ranked`` rows are sketched again, which leaves about a hundredth of them, until they are small or hold little but one
    value.  At last the distinct values of a bracket are ranked.  No group is sorted as a whole; per group a grid and
    six numbers are kept.  ``rank`` maps the group's row count to the wanted rank; nulls don't count.
    """
    by = by or []
    kind = log.schema[value].dataType
    rows = log.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__value"))
    counted = rows.groupBy(*by).agg(F.count("*").alias("__n")).filter("__n > 0")
    state = counted.select(
        *by, rank(F.col("__n")).cast("long").alias("__rank"), F.lit(None).cast(kind).alias("__lo"), F.lit(None).cast(kind).alias("__hi"),
        F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__in"), F.lit(False).alias("__done"),
    )

    def meet(groups: DataFrame) -> DataFrame:
        if not by:  # exactly one row
            return rows.withColumn("__one", F.lit(0)).join(F.broadcast(groups.withColumn("__one", F.lit(0))), "__one").drop("__one")
        return rows.join(groups, [rows[k].eqNullSafe(groups[k]) for k in by]).drop(*[groups[k] for k in by])

    at_least_lo = F.coalesce(F.col("__value") >= F.col("__lo"), F.lit(True))
    inside = at_least_lo & F.coalesce(F.col("__value") <= F.col("__hi"), F.lit(True))
    while True:
        state = blocks.written(state, "brackets")
        wide = state.filter((F.col("__in") > ranked) & ~F.col("__done"))
        if wide.isEmpty():
            break
        grid = F.percentile_approx("__value", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("__grid")
        known = ["__rank", "__lo", "__hi", "__in"]
        sketched = meet(wide).filter(inside).groupBy(*by, *known, "__below").agg(grid)
        step = F.floor((F.col("__rank") - F.col("__below")) / F.col("__in") * GRID).cast("int")
        narrow = sketched.select(
            *by, "__rank", F.col("__in").alias("__was"),
            F.when(step > 1, F.get("__grid", step - 1)).otherwise(F.col("__lo")).alias("__lo"),
            F.when(step < GRID - 2, F.get("__grid", step + 2)).otherwise(F.col("__hi")).alias("__hi"),
        )
        again = meet(narrow).groupBy(*by, "__rank", "__lo", "__hi", "__was").agg(
            F.count_if(~at_least_lo).alias("__below"), F.count_if(inside).alias("__in")
        )
        again = again.withColumn("__done", F.col("__in") * 2 > F.col("__was")).select(state.columns)
        state = state.filter((F.col("__in") <= ranked) | F.col("__done")).unionByName(again)
    values = meet(state).filter(inside).groupBy(*by, "__rank", "__below", "__value").agg(F.count("*").alias("__k"))
    upto = F.sum("__k").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__value"))
    left = F.col("__rank") - F.col("__below")
    hit = (F.col("__upto") > left) & (F.col("__upto") - F.col("__k") <= left)
    return values.withColumn("__upto", upto).filter(hit).select(*by, F.col("__value").alias(out_col))


def upper_median(log: DataFrame, value: str, by: list[str] | None = None, out_col: str = "median") -> DataFrame:
    """The element at floor(n/2) of the sorted values (not the interpolated median)."""
    found = rank_pick(log, value, lambda n: F.floor(n / 2), out_col, by)
    if by:
        return found
    kind = log.schema[value].dataType
    return found.agg(F.coalesce(F.max(out_col), F.lit(0).cast(kind)).alias(out_col))  # an empty log has the median 0


def p95_rank(n: Column) -> Column:
    """The index floor(0.95 * (n - 1)) of the sorted samples."""
    return F.floor(F.lit(0.95) * (n - 1))


def distinct_keys(log: DataFrame, key: str) -> DataFrame:
    """Filter choices for keys."""
    return log.select(key).distinct()


def distinct_types(log: DataFrame, types: str = "types") -> DataFrame:
    """Filter choices for types."""
    return log.select(F.explode(types).alias("type")).distinct()


def filtered_slice(
    log: DataFrame,
    as_of: dt.datetime,
    hours: int = 24,
    *,
    key: tuple[str, object] | None = None,
    action: str | None = None,
    pattern: str | None = None,
    ts: str = "timestamp",
    types: str = "types",
) -> DataFrame:
    """The last ``hours`` with optional key, action and type filters."""
    out = log.filter(F.col(ts) >= F.lit(as_of - dt.timedelta(hours=hours)))
    if key is not None:
        out = out.filter(F.col(key[0]) == F.lit(key[1]))
    if action is not None:
        out = out.filter(F.col("action") == action)
    if pattern is not None:
        out = out.filter(F.array_contains(types, pattern))
    return out


def detections_by_type(scanned: DataFrame, types: str = "detections", by: list[str] | None = None) -> DataFrame:
    """Counts per type, optionally per group."""
    return (
        scanned.select(*(by or []), F.explode(types).alias("type"))
        .groupBy(*(by or []), "type")
        .agg(F.count("*").alias("n"))
    )


def type_severity_rollup(found: DataFrame) -> DataFrame:
    """Convenience: counts by type and severity with subtotals."""
    return found.rollup("type", "severity").agg(F.count("*").alias("n"))


def slo_snapshot(
    requests: DataFrame,
    *,
    ts: str = "timestamp",
    tie: str = "id",
    latency_ms: str = "latency_ms",
    is_error: str = "is_error",
    window: int = SLO_WINDOW,
) -> DataFrame:
    """Newest-window p95 and the error rate over all rows, with the targets.

    The window is a top-k (``window`` rows), so the p95 sort is bounded whatever the log size.
    """
    one = F.lit(1).alias("__one")
    newest = requests.orderBy(F.desc(ts), F.desc(tie)).limit(window).select(latency_ms)
    totals = requests.agg(F.count("*").alias("__all"), F.count_if(F.col(is_error)).alias("__errors")).select("*", one)
    sample = newest.agg(F.sort_array(F.collect_list(latency_ms)).alias("__v")).select("*", one)
    index = p95_rank(F.size("__v")).cast("int")
    return sample.join(F.broadcast(totals), "__one").select(  # one row on each side
        F.size("__v").cast("long").alias("window_size"),
        F.bround(F.coalesce(F.col("__errors") / F.nullif(F.col("__all"), F.lit(0)), F.lit(0.0)), 4).alias("detection_error_rate"),
        F.bround(F.coalesce(F.get("__v", index), F.lit(0.0)), 2).alias("p95_detection_ms"),
        F.lit(SLO_P95_MS).alias("target_p95_ms"),
        F.lit(SLO_ERROR_RATE).alias("target_error_rate"),
    )


def counters(requests: DataFrame, is_error: str = "is_error", by: list[str] | None = None) -> DataFrame:
    """Request, detection and error counters."""
    return requests.groupBy(*(by or [])).agg(
        F.count("*").alias("requests"),
        F.count_if(~F.col(is_error)).alias("detections_ok"),
        F.count_if(F.col(is_error)).alias("errors"),
    )


def breach_counter(judged: DataFrame, breach: str = "breach", by: list[str] | None = None) -> DataFrame:
    """Requests after which the service level was breached."""
    return judged.groupBy(*(by or [])).agg(F.count_if(F.col(breach)).alias("breaches"))


def latency_histogram(requests: DataFrame, latency_ms: str = "latency_ms", bounds=LATENCY_BOUNDS_MS) -> DataFrame:
    """Rows per latency bucket, by upper bound (infinity for the last)."""
    upper = F.lit(float("inf"))
    for bound in sorted(bounds, reverse=True):
        upper = F.when(F.col(latency_ms) <= bound, F.lit(float(bound))).otherwise(upper)
    return requests.filter(F.col(latency_ms).isNotNull()).groupBy(upper.alias("le")).agg(F.count("*").alias("n"))


def status_tally(requests: DataFrame, status: str = "status") -> DataFrame:
    """Requests per response code."""
    return requests.groupBy(status).agg(F.count("*").alias("n"))
