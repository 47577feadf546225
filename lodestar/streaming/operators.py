"""Streaming variants: incidents, exceptions, sightings with a time to live, and windows of runs.

They are an extension of the batch operators, which stay the reference for
results. State is bounded by watermarks or by a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lodestar.functions.ids import norm_url


def incident_stream(observations: DataFrame) -> DataFrame:
    """Transitions of incidents from a stream of (fingerprint string, at timestamp, seq long, active boolean).

    The state of a fingerprint is that its incident is open, and goes when it
    has recovered, so there are as many states as open incidents. Rows of one
    batch count in order of (at, seq).
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        active = rows["active"].astype(bool)
        changed = rows[active != active.shift(fill_value=state.exists)]
        if active.iloc[-1]:
            state.update((True,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"fingerprint": key[0], "seq": changed["seq"].astype("int64"), "transition": changed["active"].astype(bool).map({True: "open", False: "recovered"})})

    return observations.groupBy("fingerprint").applyInPandasWithState(step, "fingerprint string, seq long, transition string", "open boolean", "append", GroupStateTimeout.NoTimeout)


def first_sightings(pages: DataFrame, days: int = 30) -> DataFrame:
    """Pages (url, at) whose address wasn't seen within some days before, by a watermark of that length."""
    return pages.withColumn("norm", norm_url(F.col("url"))).withWatermark("at", f"{days} days").dropDuplicatesWithinWatermark(["norm"])


def run_windows(runs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs (source_key, at, status) by window and source, late ones up to a limit included."""
    return runs.withWatermark("at", late).groupBy(F.window("at", window), "source_key").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))


def ledger_sink(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream's rows to a table, each batch once: a batch that comes again replaces itself."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


#: The state store that the operators with timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_DAY = 86_400_000


class _Exceptions(StatefulProcessor):
    """What of a subject's fingerprints was seen from when to when, and which is open; gone after some silent days."""

    def __init__(self, silent: int) -> None:
        self.silent = silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "input_fingerprint string", "detected long, last long, event_id long, n long")
        self.open = handle.getValueState("open", "input_fingerprint string, last long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        told: dict[str, tuple[int, int, int, int]] = {}
        for batch in rows:
            batch = batch.sort_values(["observed_us", "event_id"])
            for print_, some in batch.groupby("input_fingerprint", sort=False):
                last = (int(some["observed_us"].iloc[-1]), int(some["event_id"].iloc[-1]))
                told[print_] = _joined(told.get(print_), (int(some["observed_us"].iloc[0]), *last, len(some)))
        if not told:
            return
        before = self.open.get() if self.open.exists() else None
        for print_, row in told.items():
            told[print_] = _joined(self.seen.getValue((print_,)) if self.seen.containsKey((print_,)) else None, row)
            self.seen.updateValue((print_,), told[print_])
        newest = max(told, key=lambda p: told[p][1:3])
        if before is None or told[newest][1:3] > tuple(before[1:3]):
            self.open.update((newest, *told[newest][1:3]))
            if before is not None and before[0] not in told:
                told[before[0]] = tuple(self.seen.getValue((before[0],)))  # it is open no more
        open_at = tuple(self.open.get()[1:3])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(open_at[0] // 1000 + self.silent * _DAY)
        yield pd.DataFrame([(key[0], p, d, last, n, "open" if (last, event) == open_at else "superseded") for p, (d, last, event, n) in told.items()], columns=["subject_id", "input_fingerprint", "detected_us", "last_us", "n_observed", "status"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def _joined(a: tuple | None, b: tuple) -> tuple:
    """Two parts of what was seen of a fingerprint (detected, last, event_id, n) as one."""
    return b if a is None else (min(a[0], b[0]), *max(tuple(a[1:3]), tuple(b[1:3])), a[3] + b[3])


def exception_stream(observations: DataFrame, late: str = "1 day", silent: int = 365) -> DataFrame:
    """Changes of exceptions from a stream of (subject_id string, input_fingerprint string, observed timestamp, event_id long).

    Of an exception the last change counts, and is what
    `validity.observe` gives for all rows, however they are split into
    batches; event_id tells observations apart. Rows without a fingerprint or a
    moment are left out, and rows later than the watermark. The state of a subject goes when nothing of it was
    seen for silent days of the stream's time, so there are as many states as
    subjects of that time; one that comes back later is a new exception.
    """
    rows = observations.where("input_fingerprint is not null and observed is not null").withWatermark("observed", late)
    rows = rows.select("subject_id", "input_fingerprint", "observed", "event_id", F.unix_micros("observed").alias("observed_us"))
    changes = rows.groupBy("subject_id").transformWithStateInPandas(
        _Exceptions(silent), "subject_id string, input_fingerprint string, detected_us long, last_us long, n_observed long, status string", "Update", "EventTime")
    return changes.select("subject_id", "input_fingerprint", F.timestamp_micros("detected_us").alias("detected"), F.timestamp_micros("last_us").alias("last_observed"), "n_observed", "status")


class _Renewed(StatefulProcessor):
    """When an address was last let through; forgotten by a timer."""

    def __init__(self, days: int) -> None:
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        passed = []
        some = pd.concat([batch[["at_us", "seq"]] for batch in rows]).sort_values(["at_us", "seq"])
        for at, seq in zip(some["at_us"].tolist(), some["seq"].tolist()):
            if until is None or at >= until:
                passed.append((key[0], at, seq))
                until = at + self.days * _DAY * 1000
        if passed:
            self.until.update((until,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-until // 1000))
            yield pd.DataFrame(passed, columns=["norm", "at_us", "seq"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def renewed_sightings(pages: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """Pages (url, at, seq long) that are let through: an address's first one, and the first one at least so many days after that, and so on.

    Unlike `first_sightings` rows beyond the time to live pass again whether or
    not the watermark has moved. Rows of a batch count in order of (at, seq),
    those of later batches after them; a batch bounds how many rows of an
    address are held at once. A timer ends a state when its time to live is
    over, so there are as many as addresses of that time.
    """
    rows = pages.where("at is not null").withColumn("norm", norm_url(F.col("url"))).withWatermark("at", late).select("norm", "at", "seq", F.unix_micros("at").alias("at_us"))
    passed = rows.groupBy("norm").transformWithStateInPandas(_Renewed(days), "norm string, at_us long, seq long", "Append", "EventTime")
    return passed.select("norm", F.timestamp_micros("at_us").alias("at"), "seq")
