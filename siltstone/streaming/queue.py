"""A leased priority queue: batch replay as the reference semantics, and the same fold as a stateful stream.

An action is (job_id, seq, action, lease_id, at): enqueue, lease, complete,
fail or sweep. A lease lasts `ttl` seconds; a failed or expired one returns the
job to pending until its third attempt, then it is dead. complete and fail
count only under the job's own, unexpired lease.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.sources.versions import Versions

TTL, MAX_ATTEMPTS = 300.0, 3
SCHEMA = "job_id long, state string, attempts int"
_STATE = "state string, attempts int, lease_id string, until double"
Job = tuple[str, int, str | None, float]
NEW: Job = ("new", 0, None, 0.0)


def step(job: Job, action: str, lease_id: str | None, at: float, ttl: float = TTL, most: int = MAX_ATTEMPTS) -> Job:
    """The job after one action; an expired lease is recovered first."""
    state, attempts, lease, until = job
    if state == "processing" and at >= until:
        state, lease = ("dead" if attempts >= most else "pending"), None
    if action == "enqueue" and state == "new":
        state = "pending"
    elif action == "lease" and state == "pending":
        state, attempts, lease, until = "processing", attempts + 1, lease_id, at + ttl
    elif action in ("complete", "fail") and state == "processing" and lease == lease_id:
        state, lease = ("done" if action == "complete" else "dead" if attempts >= most else "pending"), None
    return state, attempts, lease, until


def replayed(actions: DataFrame) -> DataFrame:
    """(job_id, state, attempts) after all actions; one job is one group, as small as its own history."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        job = NEW
        for r in rows.sort_values(["at", "seq"]).itertuples():
            job = step(job, r.action, r.lease_id, r.at)
        return pd.DataFrame([(key[0], job[0], job[1])], columns=["job_id", "state", "attempts"])

    return actions.groupBy("job_id").applyInPandas(fold, SCHEMA)


def streamed(actions: DataFrame) -> DataFrame:
    """The same as a stateful stream: each batch emits the jobs that it touched."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job: Job = state.get if state.exists else NEW
        rows = pd.concat(list(batches))
        for r in rows.sort_values(["at", "seq"]).itertuples():
            job = step(tuple(job), r.action, r.lease_id, r.at)
        state.update(job)
        yield pd.DataFrame([(key[0], job[0], job[1])], columns=["job_id", "state", "attempts"])

    return actions.groupBy("job_id").applyInPandasWithState(fold, SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)


def expired_dead(jobs: DataFrame, now, days: int = 30) -> DataFrame:
    """Dead jobs to archive."""
    return jobs.where((F.col("state") == "dead") & (F.col("ts") < now - F.make_dt_interval(F.lit(days))))


def redacted_events(events: DataFrame) -> DataFrame:
    """Hook events with every string in them cleaned, at any depth."""
    from siltstone.functions.nested import cleaned_rows

    return cleaned_rows(events)


def append_events(events: DataFrame, store: Versions, checkpoint: str, id_column: str = "event_id", ts: str = "ts", late: str = "1 day", dry: bool = False):
    """A stream of hook events into a versioned ledger, each event once; returns the query, which ends with the input.

    Within the watermark an event id counts once, whichever file or batch it
    comes in. A batch is a part of the ledger under its number, so a batch that
    is run again after a restart replaces nothing: its part is there already. A
    dry run keeps nothing.
    """
    once = redacted_events(events).withWatermark(ts, late).dropDuplicatesWithinWatermark([id_column])
    writer = once.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if dry:
        return writer.format("noop").start()

    def keep(batch: DataFrame, number: int) -> None:
        version = store.version()
        if str(number) in version.parts.get("events", {}):
            batch.write.format("noop").mode("append").save()  # the state of the stream has to take the batch all the same
            return
        folder = store.stage(events=batch.withColumn("part", F.lit(str(number))))
        store.commit(version, folder, ["events"], store.staged(folder, "events"))

    return writer.foreachBatch(keep).start()
