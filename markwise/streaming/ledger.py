"""The job ledger kept up to date from a stream of job events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from markwise import fixed_values as fixed

RESULT = "job_id bigint, status string, created timestamp, updated timestamp, n_events bigint, expired boolean"
RECORD = "status string, last_event bigint, created timestamp, updated timestamp, n_events bigint"
#: One event, or all of a job's events of one second: counts and the newest status.
PART = "job_id bigint, second timestamp, first timestamp, at timestamp, event_id bigint, status string, n bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of a job's events of one second, put together within a batch.

    This runs before the shuffle, so a job with a large share of all events
    sends a row per second and batch. Records begin and expire on whole
    seconds, so a part never lies in two of them.
    """
    for batch in batches:
        batch = batch.sort_values(["at", "event_id"], kind="stable")
        groups = batch.groupby(["job_id", "second"], sort=False, dropna=False)
        newest = groups[["at", "event_id", "status"]].last().reset_index()
        counts = groups.agg(first=("first", "min"), n=("n", "sum")).reset_index()
        yield newest.merge(counts, on=["job_id", "second"])[["job_id", "second", "first", "at", "event_id", "status", "n"]]


class Ledger(StatefulProcessor):
    """One record per job: its newest status, and when it was created.

    A record expires ``days`` after the second in which it was created, by a
    timer of event time; events at or after that begin a new record.
    """

    def __init__(self, days: int):
        self.lifetime = pd.Timedelta(days=days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)

    def _expiry(self, created) -> pd.Timestamp:
        return pd.Timestamp(created).floor("s") + self.lifetime

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.record.get() if self.record.exists() else None
        began = held[2] if held else None
        parts = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        gone = []
        for part in parts.itertuples(index=False):
            if held and part.second >= self._expiry(held[2]):
                gone.append(self._row(key, held, True))
                held = None
            if held is None:
                held = (part.status, part.event_id, part.first, part.at, part.n)
                continue
            status, last, created, updated, n = held
            newer = (part.at, part.event_id) > (pd.Timestamp(updated), last)
            held = (
                part.status if newer else status, part.event_id if newer else last,
                min(pd.Timestamp(created), part.first), max(pd.Timestamp(updated), part.at), n + part.n,
            )
        status, last, created, updated, n = held
        self.record.update((status, int(last), self._plain(created), self._plain(updated), int(n)))
        if began is None or pd.Timestamp(began) != pd.Timestamp(created):
            if began is not None:
                self.handle.deleteTimer(self._millis(began))
            self.handle.registerTimer(self._millis(created))
        yield pd.DataFrame([*gone, self._row(key, held, False)], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.record.exists():
            return
        held = self.record.get()
        self.record.clear()
        yield pd.DataFrame([self._row(key, held, True)], columns=_COLUMNS)

    def close(self) -> None:
        pass

    def _millis(self, created) -> int:
        return int(self._expiry(created).timestamp() * 1000)

    @staticmethod
    def _plain(time) -> dt.datetime:
        return pd.Timestamp(time).to_pydatetime()

    @staticmethod
    def _row(key, held, expired: bool) -> list:
        status, _, created, updated, n = held
        return [key[0], status, pd.Timestamp(created), pd.Timestamp(updated), n, expired]


_COLUMNS = ["job_id", "status", "created", "updated", "n_events", "expired"]


def ledger_stream(job_events: DataFrame, days: int = fixed.JOB_TTL_DAYS, late: str = "1 hour") -> DataFrame:
    """Updates (job_id, status, created, updated, n_events, expired) per batch.

    State is one small record per job. It is dropped, and a last row with
    ``expired`` sent, ``days`` after the job was created, so state does not grow
    without end. Events come to a job's record as parts of a second, combined
    before the shuffle. Events of a batch may be in any order; where batches follow
    each other in time, the records do not depend on how events are cut into batches.
    """
    spark = job_events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    parts = job_events.withWatermark("at", late).select(
        "job_id", F.date_trunc("second", "at").alias("second"), F.col("at").alias("first"), "at", "event_id", "status",
        F.lit(1).cast("bigint").alias("n"),
    )
    return (
        parts.mapInPandas(combined, PART)
        .groupBy("job_id")
        .transformWithStateInPandas(Ledger(days), RESULT, "Update", "EventTime")
    )
