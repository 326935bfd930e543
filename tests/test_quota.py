"""Quota by successes against a plain loop, and a stream that goes on from its checkpoint."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from docugrain.plans import catalog
from docugrain.streaming import jobs, quota, rate

SMALL = "/root/testdata/sf0.001"


def plain(requests, limit):
    """{(device, request): decision} from (device, request, asked, ended or None, well, pro)."""
    acts = sorted([(a, r, False, d, w, p) for d, r, a, _, w, p in requests] + [(e, r, True, d, w, p) for d, r, _, e, w, p in requests if e is not None])
    used, allowed, out = {}, set(), {}
    for at, r, ends, d, well, pro in acts:
        key = (d, at.strftime("%Y-%m"))
        if ends:
            if (d, r) in allowed and well:
                used[key] = used.get(key, 0) + 1
        elif pro:
            out[d, r] = "ALLOWED_PRO"
        elif used.get(key, 0) < limit:
            allowed.add((d, r))
            out[d, r] = "ALLOWED"
        else:
            out[d, r] = "MONTHLY_LIMIT_REACHED"
    return out


def of_events(spark):
    return [(r.user_id, r.event_id, r.ts, r.ts + datetime.timedelta(minutes=r.event_id % 50 + 1) if r.event_id % 9 else None, r.event_id % 4 > 0, r.user_id % 10 == 0) for r in spark.read.parquet(f"{SMALL}/events.parquet").collect()]


def test_decisions_equal_a_plain_loop(spark):
    want = plain(of_events(spark), 20)
    for run in (catalog.quota_by_success, catalog.stream_quota_by_success):
        rows = run(spark, SMALL).collect()
        assert len(rows) == len(want) and {(r.device, r.request): r.decision for r in rows} == want
    assert set(want.values()) == {"ALLOWED", "ALLOWED_PRO", "MONTHLY_LIMIT_REACHED"}


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 30) + datetime.timedelta(minutes=m)
    requests = [(1, k, at(20 * k), at(20 * k + 15) if k % 3 else None, k % 4 > 0, False) for k in range(300)] + [(2, 1000 + k, at(7 * k), at(7 * k + 3000), True, k % 2 == 0) for k in range(30)]
    df = spark.createDataFrame(requests, "device long, request long, asked timestamp, ended timestamp, well boolean, pro boolean")
    acts = quota.actions(df, "device", "request", F.col("asked"), F.col("ended"), F.col("well"), F.col("pro"))
    middle = acts.agg(F.percentile("at", 0.5)).first()[0]
    schema = acts.schema
    out = None
    for k, part in enumerate((acts.where(F.col("at") <= middle), acts.where(F.col("at") > middle))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        # A run of its own each time: state comes from the checkpoint only.
        out = rate.drained(quota.stream_decisions(stream, 5), ["device", "request"], "", jobs.PROVIDER, mode="append", at=f"file://{tmp_path}/run")
    assert {(r.device, r.request): r.decision for r in out.collect()} == plain(requests, 5)
    assert {(r.device, r.request): r.decision for r in quota.decisions(acts, 5).collect()} == plain(requests, 5)


def test_a_device_without_requests_under_way_is_not_asked_for_each():
    """One call for each request that ends was made, though nothing was held."""
    calls = []

    class Kept:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or {"get": None, "exists": False, "containsKey": False, "listTimers": []}.get(name)

    keeper = quota.QuotaKeeper(5)
    keeper.handle = keeper.usage = keeper.under_way = Kept()
    rows = pd.DataFrame([(k + e, k, bool(e), "2024-01", k % 2 == 0, False) for k in range(100) for e in (0, 1)], columns=["at", "request", "ends", "month", "well", "pro"])
    told = pd.concat(keeper.handleInputRows((7,), iter([rows[:90], rows[90:]]), None))
    assert (told["decision"] == "ALLOWED").sum() >= 5 and len(told) == 100 and "containsKey" not in calls and len(calls) < 20
