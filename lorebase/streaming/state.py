"""Streams that hold state of their own with timers: counters of traces, and a result cache that expires."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lorebase.streaming.tables import drained, stream_of

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # a drained stream has to end; timers go off with the next rows
}


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """State variables and timers need a store that keeps several tables a key."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Timed(StatefulProcessor):
    """A processor whose keys end ``keep_ms`` of processing time after their last row."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle

    def _wait(self, timers) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.keep_ms)

    def close(self) -> None:
        pass


COUNTERS = "trace_id long, root_id long, n_spans long, n_failed long, value double, complete boolean"


class HeldCounters(_Timed):
    """Counters of a trace, held until its root span is there; spans that come later are added to what was told.

    A trace whose root hasn't come when its time is up is told as incomplete.
    """

    def init(self, handle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "root_id long, n_spans long, n_failed long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        root, spans, failed, value = self.held.get() or (None, 0, 0, 0.0)
        for r in rows:
            spans, failed, value = spans + 1, failed + int(bool(r.failed)), value + (r.value or 0.0)
            if r.is_root and (root is None or r.span_id < root):
                root = r.span_id
        self.held.update((root, spans, failed, value))
        self._wait(timerValues)
        if root is not None:
            yield Row(trace_id=key[0], root_id=root, n_spans=spans, n_failed=failed, value=value, complete=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        root, spans, failed, value = self.held.get() or (None, 0, 0, 0.0)
        self.held.clear()
        if root is None and spans:
            yield Row(trace_id=key[0], root_id=None, n_spans=spans, n_failed=failed, value=value, complete=False)


def trace_counters(spark: SparkSession, path: str, spans, keep_ms: int = 3_600_000, home: str | None = None) -> DataFrame:
    """The last counters told of each trace of a folder of spans; see :class:`HeldCounters`.

    ``spans`` makes (trace_id, span_id, is_root, failed, value) of the stream.  With the same
    ``home`` the stream goes on where it ended: counters of traces that wait, timers and what
    was told are all in its checkpoint and sink, so a stop in the middle of a trace changes nothing.
    State goes ``keep_ms`` after a trace's last span; a span that comes after that begins anew.
    """
    with _rocksdb(spark):
        told = spans(stream_of(spark, path)).groupBy("trace_id").transformWithState(HeldCounters(keep_ms), COUNTERS, "Update", "ProcessingTime")
        rows = drained(told, "update", "trace-counters", home)
    names = ["root_id", "n_spans", "n_failed", "value", "complete"]
    last = rows.groupBy("trace_id").agg(F.max_by(F.struct(*names), F.struct("__batch", "n_spans")).alias("r"))
    return last.select("trace_id", "r.*")


CACHED = "key string, result long, at timestamp, expired boolean"


class ExpiringCache(_Timed):
    """The newest result of a key, until ``keep_ms`` of processing time after it came."""

    def init(self, handle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "at timestamp, result long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = self.newest.get()
        before = best = tuple(best) if best else None
        for r in rows:
            if best is None or (r.at, r.result) > best:
                best = (r.at, r.result)
        self._wait(timerValues)
        if best is not None and best != before:
            self.newest.update(best)
            yield Row(key=key[0], result=best[1], at=best[0], expired=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        best = self.newest.get()
        self.newest.clear()
        if best:
            yield Row(key=key[0], result=best[1], at=best[0], expired=True)


def expiring_cache(spark: SparkSession, path: str, results, keep_ms: int, home: str | None = None) -> DataFrame:
    """(key, result, at) of the results that haven't expired, as the stream of (key, result, at) was last run.

    ``results`` makes the three columns of the stream; keys or times that are null are passed over.
    """
    with _rocksdb(spark):
        stream = results(stream_of(spark, path)).where("key IS NOT NULL AND at IS NOT NULL")
        rows = drained(stream.groupBy("key").transformWithState(ExpiringCache(keep_ms), CACHED, "Update", "ProcessingTime"), "update", "expiring-cache", home)
    last = rows.groupBy("key").agg(F.max_by(F.struct("result", "at", "expired"), F.struct("__batch", F.expr("NOT expired"), "at")).alias("r"))
    return last.select("key", "r.*").where("NOT expired").drop("expired")
