"""Strength of keys in event time, with state, timers and expiry."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import params as P

DAY_US = 86_400_000_000


class EventTimeStrength(StatefulProcessor):
    """A key's events wait in a list until the watermark has passed them, and are then applied in the order of their times: strength decays with the days since the last one and rises by a step.

    Whatever the order in which events arrive within the allowed lateness, the result is that of the sorted events.  Events behind the watermark are
    dropped.  A key idle for `idle_days` is put out once more, expired, and forgotten.
    """

    def __init__(self, rate: float, step: float, start: float, idle_days: float):
        self.rate, self.step, self.start, self.idle = rate, step, start, int(idle_days * DAY_US)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "strength double, n long, last_us long")
        self.waiting = handle.getListState("waiting", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            for t in frame["ts"]:
                us = pd.Timestamp(t).value // 1000
                if us > passed:
                    self.waiting.appendValue((us,))
                    self.handle.registerTimer(us // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(us for (us,) in self.waiting.get())
        ready = [us for us in held if us <= passed]
        strength, n, last = self.now.get() if self.now.exists() else (self.start, 0, None)
        for us in ready:
            strength, n, last = min(1.0, self._decayed(strength, last, us) + self.step), n + 1, us
        if ready:
            self.waiting.put([(us,) for us in held[len(ready) :]]) if len(held) > len(ready) else self.waiting.clear()
            self.now.update((strength, n, last))
            self.handle.registerTimer((last + self.idle) // 1000 + 1)
            yield self._row(key, strength, n, last, False)
        elif not held and last is not None and passed >= last + self.idle:
            self.now.clear()
            yield self._row(key, self._decayed(strength, last, last + self.idle), n, last, True)
        else:
            yield pd.DataFrame()

    def _decayed(self, strength: float, last: int | None, us: int) -> float:
        return strength if last is None else strength * math.exp(-self.rate * max(0, us - last) / DAY_US)

    def _row(self, key, strength: float, n: int, last: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "strength": [round(strength, 6)], "n": [n], "last_us": [last], "expired": [expired]})

    def close(self) -> None:
        pass


def event_time_strength(events: DataFrame, late: str = "1 hour", rate: float = P.INITIAL_DECAY_RATE, step: float = P.EXPLICIT_INCREMENT, start: float = 0.4, idle_days: float = 90.0) -> DataFrame:
    """(user_id, strength, n, last_us, expired) whenever the watermark lets events of a key through or lets it expire.  State is a few numbers a key and its events within the lateness.

    Needs a state store that knows column families: spark.sql.streaming.stateStore.providerClass set to RocksDBStateStoreProvider.
    """
    keyed = events.select("user_id", "ts").where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).groupBy("user_id")
    return keyed.transformWithStateInPandas(
        EventTimeStrength(rate, step, start, idle_days), "user_id long, strength double, n long, last_us long, expired boolean", outputMode="Update", timeMode="EventTime"
    )
