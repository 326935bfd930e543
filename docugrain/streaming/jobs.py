"""The job store as a stream: entries that are put, change, are cancelled or removed, and go some minutes after their creation.

One small record of state a job, with a timer in event time that removes it; nothing stays once the watermark has passed the
last entry's end. An entry that is over by the time of a row counts as gone for that row, whether or not its timer has fired, so what
comes out doesn't depend on how rows fall into batches, as long as a job's rows come in order or within one batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import JOB_TTL_MIN

STATE = "created long, status string, ended long, cancelled long"
OUT = "job long, created timestamp, status string, state string"
#: Where the states of jobs are kept; value states and timers need this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entry:
    """A job's entry: created and the like in microseconds. status is that of the last row that has one; done counts as failed if the cancel flag was set before the first end."""

    def __init__(self, created: int, status: str | None = None, ended: int | None = None, cancelled: int | None = None):
        self.created, self.status, self.ended, self.cancelled = created, status, ended, cancelled

    def told(self) -> str | None:
        early = self.cancelled is not None and self.ended is not None and self.cancelled < self.ended
        return "FAILED" if self.status == "DONE" and early else self.status


def fold(entry: Entry | None, rows: list[tuple[int, str, str | None]], life: int) -> tuple[Entry | None, list[tuple[Entry, str]]]:
    """The entry after rows (at, action, status) in order, and the entries that ended meanwhile. A put without an entry makes one; any other action without one has no effect."""
    over = []
    for at, action, status in rows:
        if entry is not None and at - entry.created > life:
            over.append((entry, "EVICTED"))
            entry = None
        if entry is None:
            if action == "put":
                entry = Entry(at, status)
            continue
        if action == "remove":
            over.append((entry, "REMOVED"))
            entry = None
        elif action == "cancel":
            entry.cancelled = at if entry.cancelled is None else entry.cancelled
        elif status is not None:
            entry.status = status
            if status == "DONE" and entry.ended is None:
                entry.ended = at
    return entry, over


class JobStore(StatefulProcessor):
    def __init__(self, minutes: int = JOB_TTL_MIN):
        self.life = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", STATE)

    def held(self) -> Entry | None:
        values = self.entry.get()
        return None if values is None else Entry(*(None if pd.isna(x) else x for x in values))

    def keep(self, entry: Entry | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update((entry.created, entry.status, entry.ended, entry.cancelled))
            # The first millisecond in which the entry is over.
            self.handle.registerTimer((entry.created + self.life) // 1000 + 1)

    @staticmethod
    def rows(key: tuple, found: list[tuple[Entry, str]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], pd.Timestamp(e.created, unit="us"), e.told(), s) for e, s in found], columns=["job", "created", "status", "state"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A job's rows of one batch, in order of time; a job has few.
        frame = pd.concat(list(rows)).sort_values(["at", "tie"], kind="stable")
        own = [(int(a), action, None if pd.isna(s) else s) for a, action, s in zip(frame["at"], frame["action"], frame["status"], strict=True)]
        entry, over = fold(self.held(), own, self.life)
        self.keep(entry)
        yield from self.rows(key, over + ([(entry, "LIVE")] if entry else []))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entry = self.held()
        if entry is not None and expiredTimerInfo.getExpiryTimeInMs() * 1000 - entry.created > self.life:
            self.entry.clear()
            yield from self.rows(key, [(entry, "EVICTED")])

    def close(self) -> None:
        pass


def store(actions: DataFrame, minutes: int = JOB_TTL_MIN, late: str = "2 hours") -> DataFrame:
    """job, created, status and state (LIVE, REMOVED, EVICTED) from a stream of (job long, ts, tie, at in microseconds, action, status); the last row of each (job, created) holds."""
    rows = actions.withWatermark("ts", late).select("job", "ts", "tie", "at", "action", "status")
    return rows.groupBy("job").transformWithStateInPandas(JobStore(minutes), OUT, "Update", "eventTime")
