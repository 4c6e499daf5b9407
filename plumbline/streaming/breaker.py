"""Circuit breaker over an event stream, with value state and event-time timers.

Per key the breaker opens after ``limit`` failures in a row and half-opens ``cooldown_seconds`` after the last of them, by a timer: no
further event is needed. A key that no event has reached for ``idle_seconds`` leaves the state, by a timer as well.
State is four numbers a key. Only what follows the last success of a batch matters, so rows need no order: a
batch of one key takes sixteen bytes a row, whatever else the rows hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "key string, state string, failures long, events long"


class Breaker(StatefulProcessor):
    def __init__(self, limit: int, cooldown_seconds: int, idle_seconds: int) -> None:
        self.limit, self.cooldown, self.idle = limit, cooldown_seconds * 1000, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", "failures long, opened long, total long, last long")

    def rows(self, key: tuple, state: str, failures: int, total: int) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": [str(key[0])], "state": [state], "failures": [failures], "events": [total]})

    def clear_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, opened, total, last = self.state.get() if self.state.exists() else (0, -1, 0, -1)
        bad, good = [], (-1, -1)
        for part in rows:
            at = part["at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
            order = np.stack([at, part["seq"].to_numpy().astype(np.int64)], axis=1)
            failed = (part["type"] == "failed").to_numpy()
            good = max([good, *map(tuple, order[~failed][np.lexsort(order[~failed].T[::-1])][-1:].tolist())])
            bad.append(order[failed])
            total, last = total + len(part), max(last, int(at.max(initial=-1)))
        late = np.concatenate(bad)
        late = late[(late[:, 0] > good[0]) | ((late[:, 0] == good[0]) & (late[:, 1] > good[1]))]
        failures = (0 if good != (-1, -1) else failures) + len(late)
        opened = (int(late[:, 0].max()) if len(late) else opened) if failures >= self.limit else -1
        self.state.update((failures, opened, total, last))
        self.clear_timers()
        self.handle.registerTimer(last + self.idle)
        if opened >= 0:
            self.handle.registerTimer(opened + self.cooldown)
        yield from self.rows(key, "open" if opened >= 0 else "closed", failures, total)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        failures, opened, total, last = self.state.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if due >= last + self.idle:
            self.state.clear()
            self.clear_timers()
            yield from self.rows(key, "forgotten", failures, total)
        elif opened >= 0 and due >= opened + self.cooldown:
            yield from self.rows(key, "half_open", failures, total)

    def close(self) -> None:
        pass


def circuit_breaker(events: DataFrame, key: str = "execution", limit: int = 3, cooldown_seconds: int = 600, idle_seconds: int = 86_400, late: str = "1 minute") -> DataFrame:
    """``(key, state, failures, events)`` of a stream ``key, type, at, seq``: a row after every batch with events of the key, when its breaker half-opens and when it is forgotten.

    Timers and several state variables need the RocksDB state store; the session is switched to it.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    return events.withWatermark("at", late).groupBy(key).transformWithStateInPandas(Breaker(limit, cooldown_seconds, idle_seconds), OUT, "Update", "EventTime")
