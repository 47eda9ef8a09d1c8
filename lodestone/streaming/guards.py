"""Whether each run of a stream may start: a breaker after failures in a row, a cooldown after a success; state by source, timers on event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "source string, run_id long, ts timestamp, tripped boolean, suppressed boolean"


class RunGuard(StatefulProcessor):
    """Runs of a source wait until the watermark has passed them and are then judged in order of (ts, run_id), so the order in which they arrive doesn't matter.

    State: the number of failures in a row, at most `failures`, the time of the last success, and the waiting runs, which are those of the watermark's delay.
    """

    def __init__(self, failures: int, seconds: int) -> None:
        self.failures, self.seconds = failures, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "failed int, succeeded timestamp")
        self.waiting = handle.getListState("waiting", "ts timestamp, run_id long, ok boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [(r.ts, r.run_id, r.ok) for r in rows]
        self.waiting.appendList(came)
        self.handle.registerTimer(1 + max(int(ts.timestamp() * 1000) for ts, _, _ in came))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        runs = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due = [r for r in runs if r[0].timestamp() * 1000 < mark]
        if not due:
            return
        rest = runs[len(due) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        failed, succeeded = tuple(self.past.get()) if self.past.exists() else (0, None)
        for ts, run_id, ok in due:
            near = succeeded is not None and (ts - succeeded).total_seconds() < self.seconds
            yield Row(source=key[0], run_id=run_id, ts=ts, tripped=failed >= self.failures, suppressed=near)
            failed, succeeded = (0, ts) if ok else (min(failed + 1, self.failures), succeeded)
        self.past.update((failed, succeeded))

    def close(self) -> None:
        pass


def guarded(runs: DataFrame, failures: int = 3, seconds: int = 6 * 3600, delay: str = "1 day") -> DataFrame:
    """(source, run_id, ts, tripped, suppressed) of a stream of runs (source, run_id, ts, ok).

    tripped: the `failures` runs of the source before failed. suppressed: the last success was less than `seconds` before. A run is judged once the watermark, `delay` behind the
    latest run seen, has passed it; one that comes later than that is dropped by the watermark. A null source is a source, a null ok a failure; runs without a time are dropped.
    The session needs STATE_STORE. Out come the same rows as the batch operators circuit_breaker() and cooldown() give, whatever the batches were.
    """
    rows = runs.where("ts IS NOT NULL").select(F.col("source").cast("string").alias("source"), F.col("run_id").cast("long").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.withWatermark("ts", delay).groupBy("source").transformWithState(RunGuard(failures, seconds), OUT, "Append", "EventTime")
