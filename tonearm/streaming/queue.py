"""The job queue over a stream: one active job for each (kind, key), whatever arrives again or late."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, attempts int, job_id long"
OUT = "kind long, dedup_key string, job_id long, event string, status string, attempts int"


def step(status: str | None, attempts: int, job_id: int | None, event: str, new_id: int, most: int) -> tuple[str | None, int, int | None]:
    """The next state of a key's job. 'enqueue' makes a job unless one is pending or running; 'claim' starts a pending or
    failed one; 'lost' is a lease run out, which makes it claimable again; 'ok' and 'error' settle a running one, dead once
    its attempts are used up. Anything else changes nothing."""
    if event == "enqueue" and status not in ("pending", "running"):
        return "pending", 0, new_id
    if event == "claim" and status in ("pending", "failed"):
        return "running", attempts + 1, job_id
    if status == "running":
        if event == "ok":
            return "succeeded", attempts, job_id
        if event == "error":
            return ("dead" if attempts >= most else "failed"), attempts, job_id
        if event == "lost":
            return "failed", attempts, job_id
    return status, attempts, job_id


def transitions(events: DataFrame, most: int = 5, lease_ms: int | None = None) -> DataFrame:
    """`events` is a stream of (event_id, kind, dedup_key, event). Emits the state of the key's job after each event, in order
    of event_id within a micro-batch. State is one row a key. With `lease_ms`, a running job whose worker is silent for that
    long (by the clock of the stream, as leases are) is lost, and the loss comes out as an event."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, job = state.get if state.exists else (None, 0, None)
        if state.hasTimedOut:
            arrived = [(-1, "lost")]
        else:
            arrived = sorted((r.event_id, r.event) for pdf in batches for r in pdf.itertuples())
        out = []
        for event_id, event in arrived:
            status, attempts, job = step(status, attempts, job, event, event_id, most)
            out.append((key[0], key[1], job, event, status, attempts))
        state.update((status, attempts, job))
        if lease_ms is not None and status == "running":
            state.setTimeoutDuration(lease_ms)
        yield pd.DataFrame(out, columns=["kind", "dedup_key", "job_id", "event", "status", "attempts"])

    timeout = GroupStateTimeout.NoTimeout if lease_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("kind", "dedup_key").applyInPandasWithState(run, OUT, STATE, "append", timeout)
