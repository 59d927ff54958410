"""The folds of ``operators.usage`` over streams: state by key between batches, event time in order within a batch.

State is small and kept in Spark's checkpointed state store, so a lost executor costs a replay of the last batch and no
state.  The meter and the bucket set a timer for the time from which their state says no more than none; it is removed then,
so what is stored are the users of the last while, and not all that were ever seen.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from folioflow.operators.usage import Bucket, Burst, Meter

LATE = "1 day"  #: how far behind the newest event one may come


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """One key's fold: its state as JSON, and the timer (ms) at which it goes."""

    def __init__(self, make: Callable, key: str, id_: str, names: tuple[str, ...]):
        self.make, self.key, self.id, self.names = make, key, id_, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, due bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        step, due = self.make(), None
        if self.held.exists():
            state, due = self.held.get()
            step.state = json.loads(state)
        frame = pd.concat(list(rows))
        frame.columns = [self.key, self.id, "_ts", "_us"]  # names with an underscore ahead don't reach here
        frame = frame.sort_values(["_us", self.id], ignore_index=True)
        made = pd.DataFrame([step(int(t)) for t in frame["_us"]], columns=list(self.names))
        until = step.until()
        now = timerValues.getCurrentWatermarkInMs()
        after = None if until is None else max(until // 1000 + 1, now + 1)
        if due is not None and due != after:
            self.handle.deleteTimer(due)
        if after is not None and due != after:
            self.handle.registerTimer(after)
        self.held.update((json.dumps(step.state), after))
        yield pd.concat([frame[[self.key, self.id]], made], axis=1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def _streamed(rows: DataFrame, key: str, ts: str, id_: str, make: Callable, names: tuple[str, ...], out: str, late: str) -> DataFrame:
    kinds = dict(rows.dtypes)
    if rows.sparkSession.conf.get(STORE) != ROCKSDB:
        raise ValueError(f"timers need {STORE} = {ROCKSDB}")
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    shaped = timed.select(key, id_, ts, F.unix_micros(ts).alias("_us"))
    return shaped.groupBy(key).transformWithStateInPandas(_Fold(make, key, id_, names), f"{key} {kinds[key]}, {id_} {kinds[id_]}, {out}", "append", "EventTime")


def conversation_meter(ticks: DataFrame, key: str = "user_id", ts: str = "ts", id_: str = "event_id", late: str = LATE, **dials: int) -> DataFrame:
    """The stream of decisions on a stream of ticks; the same as the batch operator's while events come in order.

    Events that come more than ``late`` behind the newest one are left out by Spark, as their user's state may be gone.  The
    session's state store has to be RocksDB (``STORE``), which timers need; anything else is an error.
    """
    return _streamed(ticks, key, ts, id_, lambda: Meter(**dials), ("conversation_no", "query_no", "decision"), "conversation_no int, query_no int, decision string", late)


def token_bucket(calls: DataFrame, key: str = "user_id", ts: str = "ts", id_: str = "event_id", late: str = LATE, **dials: float) -> DataFrame:
    """The stream of ``usage.token_bucket``'s decisions; lateness and state store as in ``conversation_meter``."""
    return _streamed(calls, key, ts, id_, lambda: Bucket(**dials), ("tokens", "decision"), "tokens double, decision string", late)


def debounce(events: DataFrame, key: str = "user_id", ts: str = "ts", quiet: float = 30, ceiling: float = 300, late: str = "10 seconds", eager: float | None = None, idle: float | None = None) -> DataFrame:
    """key, first_us, run_us and events of each run, sent once the watermark has passed its time.

    With ``eager``, a burst after at least ``idle`` (``quiet`` if not given) without events runs that soon, as in the batch
    operator.  The key's last event stays in the state until the watermark has passed that rest too.  An event that comes
    after a later one counts at that one's time.
    """
    kinds = dict(events.dtypes)
    us = lambda s: None if s is None else int(s * 1e6)
    rest = us(idle or quiet) if eager is not None else 0

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        burst = Burst(us(quiet), us(ceiling), us(eager), us(idle))
        if state.exists:
            burst.first, burst.due, burst.count, burst.last, burst.fixed = state.get
        out = []
        if state.hasTimedOut:
            if burst.count:
                out.append(burst.run())
                burst.count = 0
        else:
            out += [r for t in sorted(t for f in frames for t in f["_us"].tolist()) if (r := burst(max(t, burst.last or t)))]
        until = burst.due if burst.count else burst.last + rest
        if state.hasTimedOut and until // 1000 < state.getCurrentWatermarkMs():
            state.remove()
        else:
            state.update((burst.first, burst.due, burst.count, burst.last, burst.fixed))
            state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["first_us", "run_us", "events"])
        frame.insert(0, key, group[0])
        yield frame

    shaped = events.withWatermark(ts, late).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    return shaped.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, first_us bigint, run_us bigint, events int", "first_us bigint, due_us bigint, n int, last_us bigint, fixed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(requests: DataFrame, keys: tuple[str, ...] = ("user_id", "fingerprint_class"), ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Requests by key and day, as the days close."""
    return requests.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("request_count")).select(*keys, F.to_date("w.start").alias("day"), "request_count")


def first_responses(requests: DataFrame, keys: tuple[str, ...], ts: str = "ts", keep: str = "24 hours") -> DataFrame:
    """The first request with each idempotency key within ``keep``."""
    return requests.withWatermark(ts, keep).dropDuplicatesWithinWatermark(list(keys))


def session_gaps(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap: an extension; the conversation meter's windows are anchored and differ."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
