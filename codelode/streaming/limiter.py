"""The rate limiter as a stateful stream: requests wait for a free key and are released by timers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codelode.operators.ratelimit import Limits, Rotation

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ADMITTED = "request_id string, model_name string, ts timestamp, api_key string, admitted_at timestamp"
STATE = "now long, turn int, keys array<string>, times array<array<long>>"
REQUEST = "ts long, request_id string"
WAITING = "at long, ts long, request_id string, api_key string"


class Admission(StatefulProcessor):
    """One model's requests. Those that the watermark has passed are dealt to keys in the order of ts and request_id; each is
    given out when the watermark passes its time of admission. All that is known of a model goes a longest period
    after its last admission, if no request waits.
    """

    def __init__(self, limits: Mapping[str, Limits], keys: Sequence[str]):
        self.limits, self.keys = dict(limits), list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)
        self.pending = handle.getListState("pending", REQUEST)
        self.waiting = handle.getListState("waiting", WAITING)

    def _wake(self, at: int) -> None:
        """A timer for the first millisecond that isn't before a time in microseconds."""
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for ts, request_id in zip(pdf["us"].tolist(), pdf["request_id"].tolist(), strict=True):
                self.pending.appendValue((ts, request_id))
                first = ts if first is None else min(first, ts)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        model, passed = key[0], timerValues.getCurrentWatermarkInMs() * 1000
        pending, waiting = sorted(tuple(x) for x in self.pending.get()), [tuple(x) for x in self.waiting.get()]
        due = [x for x in pending if x[0] <= passed]
        rotation = Rotation(self.limits.get(model, ()), self.keys)
        if self.known.exists():
            rotation.restore(*self.known.get())
        for ts, request_id in due:
            api_key, at = rotation.admit(ts)
            waiting.append((at, ts, request_id, api_key))
        out, waiting = [x for x in waiting if x[0] <= passed], sorted(x for x in waiting if x[0] > passed)
        pending = pending[len(due) :]
        self._keep(self.pending, pending)
        self._keep(self.waiting, waiting)
        if pending:
            self._wake(pending[0][0])
        if waiting:
            self._wake(waiting[0][0])
        ends = rotation.now + rotation.longest
        if not pending and not waiting and ends <= passed:
            self.known.clear()
        else:
            self.known.update(rotation.state())
            self._wake(ends)
        if out:
            times = lambda k: pd.to_datetime([x[k] for x in out], unit="us")
            yield pd.DataFrame({"request_id": [x[2] for x in out], "model_name": model, "ts": times(1), "api_key": [x[3] for x in out], "admitted_at": times(0)})

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def rate_limiter(requests: DataFrame, limits: Mapping[str, Limits], keys: Sequence[str], late: str = "1 minute") -> DataFrame:
    """request_id, model_name, ts, api_key and admitted_at of a stream of requests (request_id, model_name, ts).

    What it gives equals ratelimit.replay over the whole log. A request is given out once the watermark, `late` behind the latest
    request, has passed its admission; requests that come later than that are dropped. limits maps a model
    to its (requests, seconds); models without limits always get the first key. Requests without a model or ts are left out.
    State is a model's last admissions of each key, as many as its largest limit, and the requests that wait.
    """
    spark = requests.sparkSession
    spark.conf.set(PROVIDER, ROCKS)  # the only store that has timers
    ts = F.col("ts").cast("timestamp")
    rows = requests.select(F.col("request_id").cast("string").alias("request_id"), "model_name", ts.alias("ts")).where("model_name is not null and ts is not null")
    rows = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("model_name").transformWithStateInPandas(Admission(limits, keys), ADMITTED, "Append", "EventTime")
