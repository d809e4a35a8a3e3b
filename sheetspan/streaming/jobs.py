"""Live views of job leases, tile progress and training: batch forms and Structured Streaming forms.

Events carry event time ``ts``; lease rules are those of the queue: a claim adds an attempt and
starts a lease of two minutes, heartbeats of the claiming worker extend it, a failed job is queued
again until its attempts are used up, and an expired lease puts it back in the queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col
LEASE_S, MAX_ATTEMPTS = 120, 3
STATE = "status string, attempt int, worker_id long, lease_ms long"
OUT = "job_id long, status string, attempt int, worker_id long, last_ts timestamp"
#: The processing stages of an analysis in order.
STAGES = (
    "queued", "rendering_pdf", "identifying_floor_plan_pages", "preprocessing", "running_structural_models", "running_ocr", "reconstructing_geometry", "inferring_corridors",
    "inferring_units", "calculating_measurements", "running_policy_checks", "generating_outputs", "review_required",
)


def transition(state: tuple, kind: str, worker: int, at_ms: int, most: int = MAX_ATTEMPTS) -> tuple:
    """The next (status, attempt, worker, lease end) of a job after an event."""
    status, attempt, owner, lease = state
    if status == "running" and lease and at_ms >= lease:
        status, owner, lease = "queued", None, None
    if kind == "claim" and status == "queued":
        return "running", attempt + 1, worker, at_ms + 1000 * LEASE_S
    if kind == "heartbeat" and status == "running" and owner == worker:
        return status, attempt, owner, at_ms + 1000 * LEASE_S
    if kind == "complete" and status not in ("completed", "dead"):
        return "completed", attempt, owner, None
    if kind == "fail" and status == "running":
        return ("dead", attempt, owner, None) if attempt >= most else ("queued", attempt, None, None)
    return status, attempt, owner, lease


def job_lifecycle(events: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """T-1: stream of job states: job_id, status, attempt, worker_id, last_ts after each batch of a
    job's events, and when its lease runs out.  Events older than the watermark are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get if state.exists else ("queued", 0, None, None)
        if state.hasTimedOut:
            if own[0] == "running":
                own = ("queued", own[1], None, None)
            state.update(own)
            yield pd.DataFrame({"job_id": [key[0]], "status": [own[0]], "attempt": [own[1]], "worker_id": [own[2]], "last_ts": [pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in rows.itertuples(index=False):
            own = transition(own, r.kind, int(r.worker_id), int(r.ts.value // 1_000_000))
        state.update(own)
        if own[3] and own[3] > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(own[3])
        yield pd.DataFrame({"job_id": [key[0]], "status": [own[0]], "attempt": [own[1]], "worker_id": [own[2]], "last_ts": [rows["ts"].iloc[-1]]})

    seen = events.withWatermark("ts", delay).groupBy("job_id")
    return seen.applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def expired_leases(events: DataFrame, now: str) -> DataFrame:
    """T-2: jobs whose last event is a claim or heartbeat with a lease that ended by ``now``."""
    from ..sources.readers import latest_jobs

    ends = C("ts") + F.make_dt_interval(secs=F.lit(LEASE_S))
    return latest_jobs(events).where(C("kind").isin("claim", "heartbeat") & (ends <= F.lit(now).cast("timestamp"))).select("job_id", "worker_id", ends.alias("lease_end"))


def claimable(events: DataFrame, now: str, n: int) -> DataFrame:
    """K4: the oldest jobs that wait: last event enqueue or fail, or a lease that ended; n a poll."""
    from ..sources.readers import latest_jobs

    waits = C("kind").isin("enqueue", "fail") | (C("kind").isin("claim", "heartbeat") & (C("ts") + F.make_dt_interval(secs=F.lit(LEASE_S)) <= F.lit(now).cast("timestamp")))
    return latest_jobs(events).where(waits).orderBy("ts", "job_id").limit(n).select("job_id", "ts")


def tile_progress(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """T-3: events of each run by hour: tiles done, regions so far, finished; on a stream give a watermark."""
    own = events if watermark is None else events.withWatermark("ts", watermark)
    return own.groupBy("run_id", F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.when(C("kind") == "tile", 1)).alias("tiles"), F.sum("regions").alias("regions"), F.max(C("kind").isin("final", "error").cast("int")).alias("finished")
    ).select("run_id", C("w.start").alias("hour"), "tiles", "regions", "finished")


def stage_progress(analyses: DataFrame) -> DataFrame:
    """T-4: percent of the processing stages; completed is 100, a stage that is not listed 0."""
    spark = analyses.sparkSession
    table = spark.createDataFrame([(s, int((i + 1) * 100 / len(STAGES) + 0.5)) for i, s in enumerate(STAGES)], "stage string, percent int")
    percent = F.when(C("stage") == "completed", 100).otherwise(F.coalesce("percent", F.lit(0)))
    return analyses.join(F.broadcast(table), "stage", "left").select("analysis_id", "stage", percent.cast("long").alias("percent"))


def worker_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """T-5: sessions of each worker's events without a pause of ``gap``."""
    own = events if watermark is None else events.withWatermark("ts", watermark)
    per = own.groupBy("worker_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"))
    return per.select("worker_id", "first_ts", "events")


def publish_results(stream: DataFrame, path: str, checkpoint: str):
    """T-6: completed analyses merged into a results table by key, each batch a new version of it, so
    a repeated batch changes nothing."""
    from ..sources.writers import upsert

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = batch.where("status = 'completed'").select("job_id", C("last_ts").alias("version"))
        previous = f"{path}/v={epoch - 1}"
        base = done.limit(0) if epoch == 0 else spark.read.schema(done.schema).parquet(previous)
        upsert(base, done.dropDuplicates(["job_id"]), "job_id", "version").write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def epoch_monitor(metrics: DataFrame, rise: float = 1.08) -> DataFrame:
    """T-7 in batch form: whether each job's last loss is over ``rise`` times that of three epochs before."""
    w = Window.partitionBy("job_id").orderBy(F.desc("epoch"))
    last = metrics.withColumn("k", F.row_number().over(w)).where("k IN (1, 4)")
    per = last.groupBy("job_id").agg(F.max(F.when(C("k") == 1, C("loss"))).alias("loss"), F.max(F.when(C("k") == 4, C("loss"))).alias("before"))
    return per.select("job_id", F.coalesce((C("before") > 0) & (C("loss") > C("before") * rise), F.lit(False)).alias("rising"))
