"""The refresh plan as a stream: which active deals to look at again, tick by tick."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.outcomes import TIERS
from .upserts import SCHEMA, run_to_end, shared_dir, with_state_store

OUT = "id long, seq long, minutes int"
MINUTE_MS = 60_000
LONGEST_MS = max(every for _, every in TIERS) * MINUTE_MS


class Refresh(StatefulProcessor):
    """The ticks (seq, minutes of the interval) at which a deal is due: never refreshed so far, or no less ago than the interval that its
    time left calls for. The state is the last refresh. A timer drops it once the longest interval has passed: every tick that
    the watermark lets through is due by then, with the state or without, also when the deal is listed again after its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = last = self.last.get()[0] if self.last.exists() else None
        due, every = [], []
        for ms, end, seq in pd.concat(list(rows)).sort_values(["ms", "seq"])[["ms", "end_ms", "seq"]].itertuples(index=False):
            left = (end - ms) / MINUTE_MS
            tier = next((t for most, t in TIERS if left <= most), None) if left > 0 else None
            if tier is not None and (last is None or ms - last >= tier * MINUTE_MS):
                due.append(seq)
                every.append(tier)
                last = ms
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + LONGEST_MS)
            self.last.update((int(last),))
            self.handle.registerTimer(int(last) + LONGEST_MS)
        if due:
            yield pd.DataFrame({"id": key[0], "seq": due, "minutes": every})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def follow(ticks: DataFrame, base: str) -> DataFrame:
    """(id, seq, minutes) of the due ticks after all that the stream `ticks` (id, seq, at, end_time) holds, in folder `base`; a
    process that starts anew on it goes on from its state. Ticks up to an hour late are planned, later ones are dropped."""
    s = ticks.withWatermark("at", "1 hour").select("id", "seq", "at", F.unix_millis("at").alias("ms"), F.unix_millis("end_time").alias("end_ms"))
    with with_state_store(ticks.sparkSession):
        out = s.groupBy("id").transformWithStateInPandas(Refresh(), OUT, "Append", "EventTime")
        run_to_end(out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log"))
    return ticks.sparkSession.read.schema(OUT).parquet(f"{base}/out")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: the user is the deal, which ends at the next full hour."""
    e = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = F.col("ts").cast("timestamp")
    hour = F.timestamp_seconds((F.floor(F.unix_seconds(at) / 3600) + 1) * 3600)
    ticks = e.where("user_id is not null and ts is not null").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), at.alias("at"), hour.alias("end_time"))
    return follow(ticks, f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}")
