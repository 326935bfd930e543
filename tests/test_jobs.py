"""The streamed job store against a plain fold."""

import datetime

from pyspark.sql import functions as F

from docugrain.plans import catalog
from docugrain.streaming import jobs, rate

SMALL = "/root/testdata/sf0.001"


def plain(events, minutes):
    """{(job, created): (status, state)} from (job, ts, tie, action, status)."""
    out, life = {}, datetime.timedelta(minutes=minutes)
    live = {}
    for job, ts, _, action, status in sorted(events, key=lambda e: (e[1], e[2])):
        e = live.get(job)
        if e and ts - e["created"] > life:
            e["state"], e = "EVICTED", None
            live.pop(job)
        if e is None:
            if action == "put":
                live[job] = out[job, ts] = {"created": ts, "status": status, "state": "LIVE", "end": None, "cancel": None}
        elif action == "remove":
            e["state"] = "REMOVED"
            live.pop(job)
        elif action == "cancel":
            e["cancel"] = e["cancel"] or (ts, _)
        elif status:
            e["status"] = status
            if status == "DONE" and not e["end"]:
                e["end"] = (ts, _)
    told = lambda e: "FAILED" if e["status"] == "DONE" and e["cancel"] and e["end"] and e["cancel"] < e["end"] else e["status"]
    return {k: (told(e), e["state"]) for k, e in out.items()}


def test_registered_store_equals_a_plain_fold(spark):
    events = []
    for r in spark.read.parquet(f"{SMALL}/events.parquet").collect():
        action = "put" if r.event_type == "view" else "cancel" if r.event_type == "signup" and r.event_id % 3 == 0 else "remove" if r.event_type == "signup" and r.event_id % 3 == 1 else "change"
        status = {"view": "PENDING", "purchase": "DONE", "error": "FAILED"}.get(r.event_type, "PROCESSING") if action in ("put", "change") else None
        events.append((r.user_id, r.ts, r.event_id, action, status))
    want = plain(events, 600)
    got = {(r.job, r.created): (r.status, r.state) for r in catalog.stream_job_store(spark, SMALL).collect()}
    # A live entry at the end may be evicted as the watermark passes it.
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and (got[k][1] == want[k][1] or (want[k][1], got[k][1]) == ("LIVE", "EVICTED")) for k in want)
    assert {s for _, s in want.values()} == {"LIVE", "REMOVED", "EVICTED"}


def test_timers_empty_the_state(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, at(0), 1, "put", "PENDING"), (1, at(5), 2, "change", "DONE"), (2, at(1), 3, "put", "PENDING"), (2, at(2), 4, "cancel", None), (2, at(3), 5, "change", "DONE"), (3, at(4), 6, "put", "PENDING"), (3, at(6), 7, "remove", None), (4, at(7), 8, "cancel", None), (1, at(31), 9, "put", "PENDING")]
    for k, part in enumerate((rows, [(9, at(2000), 10, "put", "PENDING")])):
        spark.createDataFrame(part, "job long, ts timestamp, tie long, action string, status string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("job long, ts timestamp, tie long, action string, status string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    out = rate.drained(jobs.store(stream.withColumn("at", F.unix_micros("ts")), late="1 minute"), ["job", "created"], f"file://{tmp_path}/out", jobs.PROVIDER, seen)
    got = {(r.job, r.created): (r.status, r.state) for r in out.collect()}
    assert got == {(1, at(0)): ("DONE", "EVICTED"), (1, at(31)): ("PENDING", "EVICTED"), (2, at(1)): ("FAILED", "EVICTED"), (3, at(4)): ("PENDING", "REMOVED"), (9, at(2000)): ("PENDING", "LIVE")}
    assert got == plain([*rows, (9, at(2000), 10, "put", "PENDING")], 30) | {(1, at(31)): ("PENDING", "EVICTED"), (2, at(1)): ("FAILED", "EVICTED")}
    assert seen[0]["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 1) <= 1
