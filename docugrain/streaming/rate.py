"""Structured Streaming twins of the rate operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..sources.tables import forget


def requests(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A stream over the files of a table; ts as an instant, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A source of files wants a pattern or folder, the table may be one file or a folder of them.
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, device: str, limit: int, late: str = "2 hours") -> DataFrame:
    """Requests and allowed ones by device and hour; state older than the watermark is dropped."""
    n = F.count(F.lit(1))
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), device).agg(n.alias("requests"))
    return grouped.select(device, F.floor(F.unix_seconds("window.start") / 3600).cast("bigint").alias("hour_epoch"), "requests", F.least("requests", F.lit(limit)).cast("bigint").alias("allowed"))


def job_states(stream: DataFrame, job: str, status, cancelled, order: list[str]) -> DataFrame:
    """The streaming twin of the job fold: one state a job, as in the reference's store."""
    return state.job_state(stream, job, status, cancelled, order).select(job, "status")


def latest(stream: DataFrame, key: str, value, order: list[str]) -> DataFrame:
    """The streaming twin of last write wins."""
    return state.latest(stream, key, value, order)


def cache_hits(stream: DataFrame, device: str, ts: str, tie: str, minutes: int = state.CACHE_TTL_MIN, late: str = "2 hours") -> DataFrame:
    """The streaming twin of the cache: one instant of state a device, which goes once the watermark has passed it. Look-ups of a batch are taken in order of time."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds, life = dict(stream.dtypes), minutes * 60_000_000

    def step(key, frames, held):
        import pandas as pd

        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["_at", tie], kind="stable")
        hit, until = state.fold_hits(rows["_at"].to_numpy(), held.get[0] if held.exists else None, life)
        held.update((until,))
        held.setTimeoutTimestamp(max(until // 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({device: rows[device], tie: rows[tie], "hit": hit})

    rows = stream.withWatermark(ts, late).select(device, tie, ts, F.unix_micros(ts).alias("_at"))
    return rows.groupBy(device).applyInPandasWithState(step, f"{device} {kinds[device]}, {tie} {kinds[tie]}, hit boolean", "until long", "update", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, keys: list[str], folder: str, provider: str | None = None, seen: list | None = None, mode: str = "update", at: str | None = None) -> DataFrame:
    """Runs a stream over what is there to its end and returns the last row of each key.

    Update mode: each batch writes the rows it changed, and state goes with the watermark. A batch's folder carries its number
    and is replaced if the batch runs again, so the sink is idempotent; the reader takes each key's row of the last batch."""
    spark = stream.sparkSession
    path = at or f"{folder}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    setting, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    if provider:
        spark.conf.set(setting, provider)
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    spark.conf.set(setting, before)
    query.awaitTermination()
    if seen is not None:
        seen.append(query.lastProgress)
    rows = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, batch long").parquet(f"{path}/out")
    rest = [c for c in stream.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
    atexit.register(forget, spark, path)
    return out
