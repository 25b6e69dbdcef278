"""Rate limits over a log of requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(requests: DataFrame, period_seconds: float, by: list[str], ts: str = "ts") -> DataFrame:
    """requests with in_window: how many of the same key lie within the period up to each, itself included.

    A request exactly one period old has expired.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(t).rangeBetween(-(round(period_seconds * 1_000_000) - 1), 0)
    return requests.withColumn("in_window", F.count("*").over(w))


def violations(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests that exceed a limit of their model (model_name, max_requests, period_seconds), one row per limit.

    Requests are counted in one window per distinct period, in microseconds. Without limits there are no rows.
    """
    out = requests.withColumn("in_window", F.lit(0).cast("long")).join(limits, "model_name").where(F.lit(False))
    for r in limits.select("period_seconds").distinct().orderBy("period_seconds").collect():  # entries of a configuration
        counted = window_counts(requests, float(r[0]), ["api_key", "model_name"])
        hit = counted.join(limits.where(F.col("period_seconds") == r[0]), "model_name").where("in_window > max_requests")
        out = out.unionByName(hit)
    return out


def round_robin(items: DataFrame, order: list[str], n: int) -> DataFrame:
    """items with slot: 0 to n-1 in turn, by the given order within each model."""
    w = Window.partitionBy("model_name").orderBy(*order)
    return items.withColumn("slot", (F.row_number().over(w) - 1) % n)


#: (requests, seconds) of each limit of a model.
Limits = Sequence[tuple[int, float]]
#: Microseconds that a request waits beyond the moment at which a key comes free.
MORE = 10_000


class Rotation:
    """Keys that take turns under the limits of one model. Times are whole microseconds.

    A request gets the first free key from the one after the last that was given; if none is free, it waits for
    the least time that frees one, and MORE. Requests are served in turn, so later ones wait as well. Once no key
    has been used for the longest period, turns begin with the first key again. Without limits the first key is always free.
    """

    def __init__(self, limits: Limits, keys: Sequence[str]):
        if any(most < 1 for most, _ in limits):
            raise ValueError("a limit must allow a request")
        self.limits = [(int(most), round(period * 1_000_000)) for most, period in limits]
        self.keys = list(keys)
        self.longest = max([p for _, p in self.limits], default=0)
        # of a key only as many of the latest times matter as the largest limit allows
        self.most = max([n for n, _ in self.limits], default=0)
        self.used = [deque(maxlen=self.most) for _ in self.keys]
        self.turn, self.now = 0, -(1 << 62)

    def state(self) -> tuple[int, int, list[str], list[list[int]]]:
        """What restore() needs, without times that no longer count."""
        return self.now, self.turn, self.keys, [[t for t in own if t > self.now - self.longest] for own in self.used]

    def restore(self, now: int, turn: int, keys: Sequence[str], times: Sequence[Sequence[int]]) -> None:
        """Keys that are no longer there are forgotten; new ones are unused."""
        known = dict(zip(keys, times, strict=True))
        self.now, self.turn = now, turn % len(self.keys)
        self.used = [deque(known.get(k, ()), maxlen=self.most) for k in self.keys]

    def admit(self, t: int) -> tuple[str, int]:
        """The key of a request that comes at t, which isn't before the one before it, and when it may go."""
        if not self.limits:
            self.now = max(self.now, t)
            return self.keys[0], self.now
        self.now = now = max(self.now, t)
        if all(not own or own[-1] <= now - self.longest for own in self.used):
            self.turn = 0
        while True:
            waits = []
            for i in range(len(self.keys)):
                k = (self.turn + i) % len(self.keys)
                own, wait = self.used[k], 0
                for most, period in self.limits:
                    if len(own) >= most and own[-most] > now - period:
                        wait = max(wait, own[-most] + period - now)
                if wait <= 0:
                    own.append(now)
                    self.turn, self.now = (k + 1) % len(self.keys), now
                    return self.keys[k], now
                waits.append(wait)
            now += min(waits) + MORE


def replay(requests: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """requests (request_id, model_name, ts) with api_key, admitted_at (seconds) and admitted_us (whole microseconds, which seconds in
    a double no longer tell some decades ahead): the log replayed through the limiter, model by model.

    A model's requests depend on one another, so they pass one task in the order of ts and request_id; it streams them and
    holds no more than each key's last admissions. streaming.limiter does the same for a stream.
    """
    import pandas as pd

    rules: dict[str, list[tuple[int, float]]] = {}
    for r in limits.select("model_name", F.col("max_requests").cast("int"), F.col("period_seconds").cast("double")).collect():  # entries of a configuration
        rules.setdefault(r[0], []).append((r[1], r[2]))
    kind = dict(requests.dtypes)["request_id"]
    rows = requests.select("request_id", "model_name", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us is not null")
    dealt = rows.repartition("model_name").sortWithinPartitions("model_name", "us", "request_id")

    def run(batches):
        model, rotation = None, None
        for pdf in batches:
            out = []
            for request_id, name, us in zip(pdf["request_id"], pdf["model_name"], pdf["us"], strict=True):
                if rotation is None or name != model:
                    model, rotation = name, Rotation(rules.get(name, ()), keys)
                out.append((request_id, name, *rotation.admit(int(us))))
            found = pd.DataFrame(out, columns=["request_id", "model_name", "api_key", "admitted_us"])
            yield found.assign(admitted_at=found["admitted_us"] / 1e6)

    return dealt.mapInPandas(run, f"request_id {kind}, model_name string, api_key string, admitted_at double, admitted_us long")


def admit(times: Iterable[float], limits: Limits, keys: Sequence[str]) -> list[tuple[str, float]]:
    """(key, admitted_at) of requests at the given seconds, ascending, as Rotation deals them."""
    rotation = Rotation(limits, keys)
    return [(k, at / 1e6) for k, at in (rotation.admit(round(t * 1_000_000)) for t in times)]
