"""Monthly quota that only successes use up.

A request is decided as it comes: a pro device is always allowed, another one while the month's usage is below the limit. Usage
grows as an allowed request of a free device ends well, in the month in which it ends. So requests under way don't count yet, and
failed ones never do.

A device's state is its month, that month's usage and the allowed requests under way. The same fold serves the batch form (rows in order,
one device after another) and the stream (value and map state; a timer drops a device's state once its month is over and nothing is under way)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import month
from ..sources.tables import Settings

DECISIONS = "device long, request long, decision string"


def actions(requests: DataFrame, device: str, request: str, asked: Column, ended: Column, well: Column, pro: Column) -> DataFrame:
    """device, request, ts, at, month, ends, well and pro: a row as a request is made and one as it ends; one that never ends (null) has the first only."""
    rows = requests.select(F.col(device).cast("long").alias("device"), F.col(request).cast("long").alias("request"), asked.alias("_asked"), ended.alias("_ended"), F.coalesce(well, F.lit(False)).alias("well"), F.coalesce(pro, F.lit(False)).alias("pro"))
    both = rows.select("device", "request", "well", "pro", F.explode(F.array(F.struct(F.col("_asked").alias("ts"), F.lit(False).alias("ends")), F.struct(F.col("_ended").alias("ts"), F.lit(True).alias("ends")))).alias("x")).where("x.ts is not null")
    return both.select("device", "request", "x.ts", F.unix_micros(F.col("x.ts").cast("timestamp")).alias("at"), month(F.col("x.ts")).alias("month"), "x.ends", "well", "pro")


class Usage:
    """What is known of one device."""

    def __init__(self, now: str = "", used: int = 0, under_way: set | None = None):
        self.month, self.used, self.under_way = now, used, under_way if under_way is not None else set()

    def take(self, row_month: str, request: int, ends: bool, well: bool, pro: bool, limit: int) -> str | None:
        """The decision on a request, None for an end."""
        if row_month > self.month:
            self.month, self.used = row_month, 0
        if ends:
            if request in self.under_way:
                self.under_way.discard(request)
                # An end that comes late, after another month has begun, counts for a month that is over.
                self.used += well and row_month == self.month
            return None
        if pro:
            return "ALLOWED_PRO"
        if self.used < limit:
            self.under_way.add(request)
            return "ALLOWED"
        return "MONTHLY_LIMIT_REACHED"


def decisions(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """device, request and decision from actions; the limit is the session's, if not given. A device's rows go to one task, sorted with spill; what is held is one Usage."""
    limit = Settings.of(rows.sparkSession).free_monthly_limit if limit is None else limit
    ordered = rows.repartition("device").sortWithinPartitions("device", "at", "request", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, usage = object(), Usage()
        for batch in batches:
            out: list[tuple] = []
            for device, request, m, ends, well, pro in zip(*(batch.column(c).to_pylist() for c in ("device", "request", "month", "ends", "well", "pro")), strict=True):
                if device != now:
                    now, usage = device, Usage()
                told = usage.take(m, request, ends, well, pro, limit)
                if told:
                    out.append((device, request, told))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["device", "request", "decision"])

    return ordered.select("device", "request", "month", "ends", "well", "pro").mapInArrow(run, DECISIONS)


class QuotaKeeper(StatefulProcessor):
    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.usage = handle.getValueState("usage", "month string, used long")
        self.under_way = handle.getMapState("under_way", "request long", "asked long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.usage.get()
        usage = Usage(*held) if held is not None else Usage()
        acts = sorted((x for f in rows for x in zip(*(f[c].tolist() for c in ("at", "request", "ends", "month", "well", "pro")), strict=True)), key=lambda x: x[:3])
        # Only the requests that this batch ends are looked up, not all that are under way; none where nothing is, as each look-up is a call.
        any_ = held is not None and self.under_way.exists()
        known = {x[1] for x in acts if x[2] and self.under_way.containsKey((x[1],))} if any_ else set()
        before, usage.under_way, out = usage.month, set(known), []
        for _, request, ends, m, well, pro in acts:
            told = usage.take(m, request, ends, well, pro, self.limit)
            if told:
                out.append((key[0], request, told))
        for r in usage.under_way - known:
            self.under_way.updateValue((r,), (0,))
        for r in known - usage.under_way:
            self.under_way.removeKey((r,))
        self.usage.update((usage.month, usage.used))
        # A device that is held has a timer for its month.
        if held is None or usage.month != before:
            self.again(usage.month)
        if out:
            yield pd.DataFrame(out, columns=["device", "request", "decision"])

    def again(self, now: str) -> None:
        """A timer for the first instant after the month."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        after = (pd.Period(now, "M") + 1).start_time
        self.handle.registerTimer(int(after.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.under_way.exists():
            self.usage.clear()
        else:  # looked at again a day later
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + 86_400_000)
        return iter(())

    def close(self) -> None:
        pass


def stream_decisions(rows: DataFrame, limit: int | None = None, late: str = "1 hour") -> DataFrame:
    """The same from a stream of actions: a device's rows come in order over batches, or together in one."""
    limit = Settings.of(rows.sparkSession).free_monthly_limit if limit is None else limit
    return rows.withWatermark("ts", late).groupBy("device").transformWithStateInPandas(QuotaKeeper(limit), DECISIONS, "Append", "eventTime")
