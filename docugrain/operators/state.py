"""Usage, limits, jobs and caches as batch operators over event tables; streaming twins are in docugrain.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Settings

# Lives in minutes. What is allowed per hour and month is a setting.
JOB_TTL_MIN, CACHE_TTL_MIN = 30, 5


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def hour_epoch(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 3_600_000_000).cast("bigint")


def usage(events: DataFrame, device: str, ts: str) -> DataFrame:
    return events.groupBy(device, month(F.col(ts)).alias("month")).agg(F.count(F.lit(1)).alias("used_count"))


def hourly(events: DataFrame, device: str, ts: str, limit: int | None = None) -> DataFrame:
    limit = Settings.of(events.sparkSession).audit_rate_limit_per_hour if limit is None else limit
    n = F.count(F.lit(1))
    return events.groupBy(device, hour_epoch(F.col(ts)).alias("hour_epoch")).agg(n.alias("requests"), F.least(n, F.lit(limit)).alias("allowed"))


def hourly_decisions(events: DataFrame, device: str, ts: str, tie: str, limit: int | None = None) -> DataFrame:
    """The place of each request within its device and hour; a window of one hour of one device. The limit is the session's, if not given."""
    limit = Settings.of(events.sparkSession).audit_rate_limit_per_hour if limit is None else limit
    rows = events.withColumn("hour_epoch", hour_epoch(F.col(ts)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(device, "hour_epoch").orderBy(ts, tie)).cast("bigint")).withColumn("allowed", F.col("place") <= limit)


def quota_decisions(events: DataFrame, device: str, ts: str, tie: str, pro: Column, limit: int | None = None) -> DataFrame:
    limit = Settings.of(events.sparkSession).free_monthly_limit if limit is None else limit
    rows = events.withColumn("month", month(F.col(ts)))
    place = F.row_number().over(Window.partitionBy(device, "month").orderBy(ts, tie))
    return rows.withColumn("decision", F.when(pro, "ALLOWED_PRO").when(place <= limit, "ALLOWED").otherwise("MONTHLY_LIMIT_REACHED"))


def job_state(events: DataFrame, job: str, status: Column, cancelled: Column, order: list[str]) -> DataFrame:
    """The last status, of the rows that have one. The cancel flag is read once, when the work ends, which is the first DONE: a job that
    was cancelled before it is FAILED; cancelled later, or before any end, it stays as it is. An aggregate, without a sort of a job's events."""
    at = F.struct(*order)
    of = lambda x: F.when(status.isNotNull(), x)
    rows = events.groupBy(job).agg(F.max_by(status, of(at)).alias("last"), F.min(F.when(status == "DONE", at)).alias("end"), F.min(F.when(cancelled, at)).alias("cancel"))
    return rows.withColumn("status", F.when((F.col("last") == "DONE") & (F.col("cancel") < F.col("end")), "FAILED").otherwise(F.col("last")))


def fold_hits(at, until: int | None, life: int):
    """Hits of one device's look-ups, in order, and the end of its last entry; until: the end of the entry it has, if any. Jumps from miss to miss."""
    import numpy as np

    hit, k = np.ones(len(at), bool), 0
    while k < len(at):
        k += 0 if until is None else int(np.searchsorted(at[k:], until))
        if k < len(at):
            hit[k], until = False, int(at[k]) + life
            k += 1
    return hit, until


def cache_hits(lookups: DataFrame, device: str, ts: str, tie: str, minutes: int = CACHE_TTL_MIN) -> DataFrame:
    """(device, tie, hit) for each look-up: an entry lives for some minutes from the miss that put it; a hit doesn't renew it.

    Each answer depends on the one before, so a device's rows go to one task; they are sorted there (with spill) and folded in
    Arrow batches with one instant of state, jumping from miss to miss. No device is held in memory."""
    import numpy as np
    import pyarrow as pa

    kinds, life = dict(lookups.dtypes), minutes * 60_000_000
    rows = lookups.select(device, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")).repartition(device).sortWithinPartitions(device, "_at", tie)

    def run(batches):
        last, until = object(), None
        for batch in batches:
            at, own = batch.column(2).to_numpy(), batch.column(0).to_pylist()
            hit = np.ones(len(at), bool)
            k = 0
            while k < len(at):
                # The end of this device's rows in the batch.
                low, high = k, len(at)
                while low < high:
                    middle = (low + high) // 2
                    low, high = (middle + 1, high) if own[middle] == own[k] else (low, middle)
                last, until = own[k], until if own[k] == last else None
                hit[k:low], until = fold_hits(at[k:low], until, life)
                k = low
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit)], names=[device, tie, "hit"])

    return rows.mapInArrow(run, f"{device} {kinds[device]}, {tie} {kinds[tie]}, hit boolean")


def latest(events: DataFrame, key: str, value: Column, order: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("value"))
