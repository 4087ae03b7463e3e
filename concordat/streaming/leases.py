"""Review tasks as a stream: the state machine of the batch log, kept as typed state with timers.

State is one row a task (RocksDB, so it may outgrow memory) and goes ``FORGET`` after the
task's last event. Each event gives its outcome, as ``review.revisions`` gives it for a whole
log; a lease that nobody renews gives a notice when its timer runs out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from concordat.operators import review

FORGET = 90 * 24 * 3600 * 1000
#: Set on the session before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTCOME = "task long, seq long, kind string, who string, at timestamp, state string, version long, refusal string"
#: A task as it is stored; the columns of ``review.QUEUE``, spelled out as workers have no session to parse them.
STORED = (
    T.StructType().add("state", "string").add("version", "long").add("locked_by", "string").add("locked_until", "timestamp").add("corrections", "string")
    .add("queued_at", "timestamp").add("updated_at", "timestamp").add("revisions", "long").add("refused", "long")
)
EVENTS = ("seq", "kind", "who", "at", "lease_s", "expected_version", "corrections", "errors", "misfit")


def plain(x: object) -> object:
    return None if x is None or (not isinstance(x, str) and pd.isna(x)) else x


class Reviews(StatefulProcessor):
    def __init__(self, forget: int = FORGET):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", STORED, self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        t = review.Task.unpacked(self.task.get()) if self.task.exists() else review.Task()
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            seq, kind, who, at, lease, expected, corrections, errors, misfit = (plain(getattr(r, c)) for c in EVENTS)
            number = lambda x: None if x is None else int(x)
            why = t.take(kind, who, at, number(lease), number(expected), corrections, number(errors), misfit)
            out.append((key[0], seq, kind, who, at, t.state, t.version if why is None else None, why))
        self.task.update(t.packed())
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if t.owner is not None:
            left = int((t.until - out[-1][4]).total_seconds() * 1000)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(left, 0))
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        t = review.Task.unpacked(self.task.get()) if self.task.exists() else review.Task()
        yield self.frame([(key[0], None, "expired", t.owner, t.until, t.state, None, None)] if t.owner is not None else [])

    def close(self) -> None:
        pass

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=["task", "seq", "kind", "who", "at", "state", "version", "refusal"])
        return f.astype({"seq": "Int64", "version": "Int64"})


def leases(events: DataFrame, forget: int = FORGET) -> DataFrame:
    """The outcome of each event of a stream of (task, seq, kind, who, at, lease_s, expected_version, corrections, errors, misfit).

    A task's events come in order, as the queue writes them; those of one batch are sorted. Verdicts (errors, misfit) come with
    the events: a stream has no second look at them.
    """
    return events.groupBy("task").transformWithStateInPandas(Reviews(forget), T.StructType.fromDDL(OUTCOME), outputMode="Update", timeMode="ProcessingTime")
