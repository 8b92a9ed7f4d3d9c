"""Change events of a stream of record snapshots, from a state kept per record.

Snapshots may come late, repeated and out of order.  A record's state is the last snapshot that was compared and those
that wait; a snapshot waits until the watermark has passed its time, when a timer compares what waits in the order of
versions.  What comes in with a version not above the last one compared is a repetition, or later than the stream said it
would be, and makes no event.  The state gives out pairs; the events are read off them by the rule that tables use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corroborate.operators import quality as Q

_PAIR = "report_id string, record_id string, version long, at timestamp, before string, after string"


class RecordStates(StatefulProcessor):
    """Per record: the version and body last compared, and the bodies that wait by version."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "version long, body string")
        self.waiting = handle.getMapState("waiting", "version long", "at long, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's names
        last = self.last.get()[0] if self.last.exists() else None
        for batch in rows:
            for version, at, body in zip(batch["version"], batch["at"], batch["body"], strict=True):
                if last is None or version > last:
                    ms = at.value // 10**6
                    self.waiting.updateValue((int(version),), (ms, body))
                    self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((version[0], at, body) for version, (at, body) in self.waiting.iterator() if at <= now)
        was = tuple(self.last.get()) if self.last.exists() else (None, None)
        out = []
        for version, at, body in ready:
            self.waiting.removeKey((version,))
            if was[0] is not None and version <= was[0]:
                continue
            out.append((str(key[0]), str(key[1]), version, pd.Timestamp(at, unit="ms"), was[1], body))
            was = (version, body)
        if ready:
            self.last.update(was)
        yield pd.DataFrame(out, columns=["report_id", "record_id", "version", "at", "before", "after"]).astype({"version": "int64", "at": "datetime64[ns]"})


def record_events(snapshots: DataFrame, late: str) -> DataFrame:
    """report_id, record_id, version and the event's columns of a stream of snapshots (report_id, id, version, at, deleted and what ``quality`` compares).

    late: how long after a later one a snapshot may come; the first snapshot of a record that is not made by hand gives no event."""
    body = F.when(~F.coalesce("deleted", F.lit(False)), F.to_json(Q.as_state(snapshots), {"ignoreNullFields": "false"}))
    rows = snapshots.select(F.col("report_id").cast("string"), F.col("id").cast("string").alias("record_id"), F.col("version").cast("long"), F.col("at").cast("timestamp"), body.alias("body"))
    told = rows.withWatermark("at", late).groupBy("report_id", "record_id").transformWithStateInPandas(RecordStates(), outputStructType=_PAIR, outputMode="Append", timeMode="EventTime")
    read = {side: F.from_json(side, Q.STATE) for side in ("before", "after")}
    pairs = told.withColumns(read).where("before is not null or after is not null")
    return pairs.select("report_id", "record_id", "version", F.explode(Q.record_changes(F.col("at"))).alias("e")).select("report_id", "record_id", "version", "e.*")


def once(events: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """A stream of events without those of equal keys that come again within ``late``."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)

