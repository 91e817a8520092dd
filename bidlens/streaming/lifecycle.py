"""Deal lifecycle as a stateful stream: PENDING until a sale is seen (SOLD) or a completed page shows the deal without one
(UNSOLD), GAVE_UP a week after the deal's end. What comes for a deal after that goes to a side table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .upserts import SCHEMA, run_to_end, shared_dir, with_state_store

OUT = "id long, status string, sale long, turn long, late long"
WEEK_MS = 7 * 86400 * 1000
#: How long after a deal's end its state is kept.
KEEP_MS = 5 * WEEK_MS


class Lifecycle(StatefulProcessor):
    """The state of one deal, one value: its latest end, how often its state was written, whether it was given up, the first seq of a
    page that showed its sale and whether a completed page showed it. It has one timer at a time: a week after the end an open deal is given
    up; five weeks after the end any deal is forgotten. Sightings whose own time is a week or more past the end, or that come when the
    watermark is, are late: they change nothing and are put out as they are.

    Every call of a state or timer is a message to the JVM and back: a deal seen for the first time takes three."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deal = handle.getValueState("deal", "end_ms long, turn long, over boolean, sale long, completed boolean")

    @staticmethod
    def _status(sale: int | None, completed: bool) -> str:
        return "SOLD" if sale is not None else ("UNSOLD" if completed else "PENDING")

    @staticmethod
    def _due(end: int, over: bool, sale: int | None, completed: bool) -> int:
        """When the deal's timer rings."""
        return end + (KEEP_MS if over or sale is not None or completed else WEEK_MS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.deal.get()
        end, turn, over, sale, completed = before or (None, 0, False, None, False)
        fresh, mark = False, timerValues.getCurrentWatermarkInMs()
        for _, mode, seq, ms, end_ms in sorted(rows, key=lambda r: (r.ms, r.seq)):
            latest = end_ms if end is None else max(end, end_ms)
            if over or max(ms, mark) >= latest + WEEK_MS:
                yield Row(id=key[0], status="LATE", sale=None, turn=None, late=seq)
                continue
            end, fresh = latest, True
            if mode == "sold":
                sale = seq if sale is None else min(sale, seq)
            completed = completed or mode == "completed"
        if not fresh:
            return
        due = self._due(end, over, sale, completed)
        old = self._due(before[0], *before[2:]) if before else None
        if due != old:
            if before:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        self.deal.update((end, turn + 1, over, sale, completed))
        yield Row(id=key[0], status=self._status(sale, completed), sale=sale, turn=turn + 1, late=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end, turn, over, sale, completed = self.deal.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= end + KEEP_MS:
            self.deal.clear()
            return
        yield Row(id=key[0], status="GAVE_UP", sale=None, turn=turn + 1, late=None)
        if end + KEEP_MS < timerValues.getCurrentWatermarkInMs():
            self.deal.clear()
        else:
            self.deal.update((end, turn + 1, True, sale, completed))
            self.handle.registerTimer(end + KEEP_MS)

    def close(self) -> None:
        pass


def follow(rows: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(id, status, sale) of each deal after all that the stream `rows` (id, mode, seq, at, end_time) holds, and the side table (id, seq) of late
    rows, in folder `base`; a process that starts anew on it goes on from its state. The watermark allows a day. The event
    time reaches the deals as a number, so that late rows are theirs to judge and aren't dropped before."""
    s = rows.withWatermark("at", "1 day").select("id", "mode", "seq", F.unix_millis("at").alias("ms"), F.unix_millis("end_time").alias("end_ms"))
    with with_state_store(rows.sparkSession):
        out = s.groupBy("id").transformWithState(Lifecycle(), OUT, "Append", "EventTime")
        run_to_end(out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log"))
    log = rows.sparkSession.read.schema(OUT).parquet(f"{base}/out")
    last = log.where("status <> 'LATE'").groupBy("id").agg(F.max_by(F.struct("status", "sale"), "turn").alias("r")).select("id", "r.*")
    return last, log.where("status = 'LATE'").select("id", F.col("late").alias("seq"))


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sightings of deals: sixteen a user, by event; each ends at an hour of January 2024 that its id gives. Purchases are sales, every
    other signup a completed page without one."""
    e = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir).where("user_id is not null and ts is not null")
    deal = F.col("user_id") * 16 + F.col("event_id") % 16
    mode = F.when(F.col("event_type") == "purchase", "sold").when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), "completed").otherwise("active")
    s = e.select(deal.alias("id"), mode.alias("mode"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    end = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("id") * 37 % 720 * 3600)
    return s.withColumn("end_time", end)


def run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The deals of events: their last states, and the late sightings."""
    return follow(deals(spark, sf_dir), f"{shared_dir(spark)}/lifecycle-{uuid.uuid4().hex}")
