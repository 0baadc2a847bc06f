"""Streams: files of a watched folder, deduplicated, and leased jobs with timers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(stream: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark's delay: the state of older keys is dropped. Batch frames keep the first row of each key."""
    if not stream.isStreaming:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, event_time: str, kind: str, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """kind, window_start, events: counts per tumbling window; later rows than the delay are left out."""
    t = F.col(event_time).cast("timestamp")
    rows = stream.withColumn("__t", t)
    rows = rows.withWatermark("__t", delay) if stream.isStreaming else rows
    return rows.groupBy(F.window("__t", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("events")).select(kind, F.col("w.start").alias("window_start"), "events")


JOB = "job_id string, status string, attempts int, owner string, available_at timestamp, lease_until timestamp, error string"
_STATE = "status string, attempts int, owner string, available_at long, lease_until long, error string"
#: Where a job can be: NEW, QUEUED, RUNNING, RETRYABLE_FAILURE, FAILED, SUCCEEDED.
CLAIMABLE = ("QUEUED", "RETRYABLE_FAILURE")


@dataclass(frozen=True)
class LeaseTerms:
    """How long a lease lasts, how long a failed job waits, and how often it may be tried."""

    lease_seconds: int = 120
    retry_seconds: int = 30
    most_attempts: int = 3


@dataclass
class Job:
    """The state of one job; times are milliseconds since the epoch."""

    status: str = "NEW"
    attempts: int = 0
    owner: str | None = None
    available_at: int | None = None
    lease_until: int | None = None
    error: str | None = None

    def held_by(self, who: str | None, now: int) -> bool:
        return self.status == "RUNNING" and self.owner == who and self.lease_until is not None and self.lease_until > now

    def expire(self, now: int, terms: LeaseTerms) -> None:
        """A lease that has run out: the last attempt has failed for good, any other can be claimed again."""
        if self.status == "RUNNING" and self.lease_until is not None and self.lease_until <= now and self.attempts >= terms.most_attempts:
            self.status, self.owner, self.lease_until, self.error = "FAILED", None, None, "LEASE_EXPIRED"

    def apply(self, action: str, who: str | None, now: int, terms: LeaseTerms) -> None:
        """One request. submit queues a new job; claim leases one that waits and is available, or whose lease has run out, while attempts are left; renew, complete, fail
        and abort count only from the holder of a lease that still runs. fail makes the job wait for another attempt if any is left; abort never does."""
        self.expire(now, terms)
        if action == "submit" and self.status == "NEW":
            self.status, self.available_at = "QUEUED", now
        elif action == "claim" and self.attempts < terms.most_attempts:
            lost = self.status == "RUNNING" and self.lease_until is not None and self.lease_until <= now
            if (self.status in CLAIMABLE and (self.available_at or 0) <= now) or lost:
                self.status, self.attempts, self.owner, self.error = "RUNNING", self.attempts + 1, who, None
                self.lease_until = now + 1000 * terms.lease_seconds
        elif self.held_by(who, now):
            if action == "renew":
                self.lease_until = now + 1000 * terms.lease_seconds
            elif action == "complete":
                self.status, self.owner, self.lease_until, self.error = "SUCCEEDED", None, None, None
            elif action in ("fail", "abort"):
                again = action == "fail" and self.attempts < terms.most_attempts
                self.status, self.error = "RETRYABLE_FAILURE" if again else "FAILED", "REPORTED"
                self.available_at, self.owner, self.lease_until = now + (1000 * terms.retry_seconds if again else 0), None, None

    def row(self, job_id: str) -> pd.DataFrame:
        at = lambda ms: pd.Timestamp(ms, unit="ms") if ms is not None else pd.NaT
        return pd.DataFrame({"job_id": [job_id], "status": [self.status], "attempts": [self.attempts], "owner": [self.owner], "available_at": [at(self.available_at)], "lease_until": [at(self.lease_until)], "error": [self.error]})


def _requests(pdf: pd.DataFrame) -> list[tuple[str, str, int]]:
    ordered = pdf.sort_values(["at", "action", "owner"])
    return [(a, o, int(t.value // 1_000_000)) for a, o, t in zip(ordered["action"], ordered["owner"], ordered["at"])]


def leases(requests: DataFrame, terms: LeaseTerms = LeaseTerms(), now=None, delay: str = "1 minute") -> DataFrame:
    """The state (JOB) of each job after its requests (job_id, action, owner, at), applied in order of at, action and owner; rows with a null job, action or time are left
    out. Batch frames give each job as it is at `now`, or at its last request. Streams give a job whenever
    it changes; a lease that runs out is noticed when the watermark passes it, whether or not another request comes."""
    rows = requests.where("job_id is not null and action is not null and at is not null").select("job_id", "action", "owner", F.col("at").cast("timestamp").alias("at"))
    if not requests.isStreaming:
        until = int(pd.Timestamp(now).value // 1_000_000) if now is not None else None

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            job, current, out = Job(), None, []

            def close() -> None:
                if current is not None:
                    if until is not None:
                        job.expire(until, terms)
                    out.append((current, job.status, job.attempts, job.owner, job.available_at, job.lease_until, job.error))

            def table() -> pa.RecordBatch:
                cols = list(zip(*out)) or [()] * 7
                ms = lambda c: pa.array(c, pa.int64())
                text = lambda c: pa.array(c, pa.string())
                return pa.RecordBatch.from_arrays([text(cols[0]), text(cols[1]), pa.array(cols[2], pa.int32()), text(cols[3]), ms(cols[4]), ms(cols[5]), text(cols[6])], names=["job_id", "status", "attempts", "owner", "a", "l", "error"])

            for rb in batches:
                for job_id, action, owner, at in zip(*(rb.column(i).to_pylist() for i in range(4))):
                    if job_id != current:
                        close()
                        job, current = Job(), job_id
                    job.apply(action, owner, at, terms)
                yield table()
                out.clear()
            close()
            yield table()

        # one job's requests come in order, so a task holds one state at a time, however many requests a job has
        ordered = rows.select("job_id", "action", "owner", F.unix_millis("at").alias("at")).repartition("job_id").sortWithinPartitions("job_id", "at", "action", "owner")
        done = ordered.mapInArrow(whole, "job_id string, status string, attempts int, owner string, a bigint, l bigint, error string")
        return done.select("job_id", "status", "attempts", "owner", F.timestamp_millis("a").alias("available_at"), F.timestamp_millis("l").alias("lease_until"), "error")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else Job()
        if state.hasTimedOut:
            job.expire(state.getCurrentWatermarkMs(), terms)
        else:
            for action, who, at in _requests(pd.concat(list(frames))):
                job.apply(action, who, at, terms)
        state.update((job.status, job.attempts, job.owner, job.available_at, job.lease_until, job.error))
        if job.lease_until is not None and job.lease_until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(job.lease_until)
        yield job.row(key[0])

    return rows.withWatermark("at", delay).groupBy("job_id").applyInPandasWithState(run, JOB, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def claimable(jobs: DataFrame, now: Column, most_attempts: int = 3) -> DataFrame:
    """The jobs (status, available_at, lease_expires_at, attempts) that can be claimed now."""
    waiting = F.col("status").isin(*CLAIMABLE) | ((F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= now))
    return jobs.where(waiting & (F.col("available_at") <= now) & (F.col("attempts") < most_attempts))


def exhausted(jobs: DataFrame, now: Column, most_attempts: int = 3) -> DataFrame:
    """The jobs whose last attempt's lease has run out: they are to be failed for good."""
    return jobs.where((F.col("status") == "RUNNING") & (F.col("lease_expires_at") <= now) & (F.col("attempts") >= most_attempts))
