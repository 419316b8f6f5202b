"""Job states over a stream of events: one state per job, rejected events leave it unchanged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafline.operators.jobs import ALLOWED


def job_states(events: DataFrame, job: str = "job_id") -> DataFrame:
    """events (job, ts, event_id, status) -> job, status, accepted, rejected after each micro-batch that has events of the job."""

    def run(key, frames, state: GroupState):
        now, good, bad = state.get if state.exists else ("queued", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for status in rows["status"]:
            if status in ALLOWED.get(now, ()):
                now, good = status, good + 1
            else:
                bad += 1
        state.update((now, good, bad))
        yield pd.DataFrame([(key[0], now, good, bad)], columns=[job, "status", "accepted", "rejected"])

    kind = events.schema[job].dataType.simpleString()
    return events.groupBy(job).applyInPandasWithState(run, f"{job} {kind}, status string, accepted long, rejected long", "status string, accepted long, rejected long", "update", GroupStateTimeout.NoTimeout)
