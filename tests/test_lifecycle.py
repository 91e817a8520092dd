"""The deal lifecycle over several batches, a file each, with a restart after every one."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import Row

from bidlens.streaming import lifecycle

SCHEMA = "id long, mode string, seq long, at timestamp, end_time timestamp"
#: Day on which each deal ends.
ENDS = {1: 3, 2: 3, 3: 3, 4: 5, 5: 30, 6: 12, 7: 3, 9: 100}
#: (id, mode, seq, day) of each batch. The watermark is a day before the latest day of earlier batches.
BATCHES = [
    [(1, "active", 1, 1), (2, "active", 2, 1), (3, "active", 3, 1), (4, "active", 4, 1), (5, "active", 5, 1), (6, "active", 6, 1), (7, "active", 7, 2)],
    # 1 is sold in its week and 4 ended unsold; 7's only later page comes more than a week after its end
    [(1, "sold", 12, 9), (1, "sold", 11, 8), (4, "completed", 13, 9), (7, "sold", 14, 10)],
    [(9, "active", 15, 12)],
    # the watermark has passed day 10: 2, 3 and 7 are given up, what comes for them is late, however early its own time
    [(2, "sold", 16, 4), (3, "active", 17, 12), (4, "sold", 18, 11), (6, "completed", 19, 13)],
    # 6 is listed again and ends a week later; 5 is seen for the last time
    [(6, "active", 20, 14), (5, "active", 21, 14)],
    [(9, "active", 22, 40)],
    [(9, "active", 23, 41)],
    # five weeks after its end 1 is forgotten: what comes then is new, and late by its own time
    [(9, "active", 24, 60)],
    [(1, "sold", 25, 60), (9, "active", 26, 60)],
]


def day(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n - 1)


def test_deals_are_settled_given_up_and_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(BATCHES):
        data = [(d, m, s, day(at), day(19 if (d, s) == (6, 20) else ENDS[d])) for d, m, s, at in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        part = next((tmp_path / f"w{i}").glob("*.parquet"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        if i in (0, 3, 4, 8):  # in between, files wait and come as batches of one run
            last, late = lifecycle.follow(stream, f"{tmp_path}/deals")
    assert {r["id"]: (r["status"], r["sale"]) for r in last.collect()} == {1: ("SOLD", 11), 2: ("GAVE_UP", None), 3: ("GAVE_UP", None), 4: ("SOLD", 18), 5: ("GAVE_UP", None), 6: ("UNSOLD", None), 7: ("GAVE_UP", None), 9: ("PENDING", None)}
    assert {tuple(r) for r in late.collect()} == {(7, 14), (2, 16), (3, 17), (1, 25)}


class Messages:
    """A handle, and its one value and timers, that counts the messages which a real one would send."""

    def __init__(self):
        self.value, self.timers, self.sent = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.sent += 1
        return self.value

    def update(self, value):
        self.sent, self.value = self.sent + 1, value

    def registerTimer(self, at):
        self.sent += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.sent += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_deal_takes_few_messages(spark):
    handle, deal, row = Messages(), lifecycle.Lifecycle(), Row("id", "mode", "seq", "ms", "end_ms")
    deal.init(handle)
    out = list(deal.handleInputRows((1,), iter([row(1, m, n, 10 - n, 100) for n, m in enumerate(("active", "completed", "active"))]), handle))
    assert [(r.status, r.turn) for r in out] == [("UNSOLD", 1)]
    assert handle.sent == 3 and handle.timers == {100 + lifecycle.KEEP_MS}  # before, 13 of them and two timers
    list(deal.handleInputRows((1,), iter([row(1, "sold", 9, 20, 100)]), handle))
    assert handle.sent == 5 and handle.value == (100, 2, False, 9, True)


def test_a_purge_works_its_tables_out_once(spark):
    from bidlens.plans import queries

    plan = queries.QUERIES["delete_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan  # before, each of eight joins derived its table and the suspects from there


def test_prices_and_deals_work_their_listings_out_once(spark):
    from bidlens.plans import queries

    for name in ("potential_gain", "join_model_stats", "discount_pct", "deal_score", "basket_value"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "lineitem" not in plan, name


def test_pages_land_packed(spark, tmp_path):
    import os

    from bidlens.operators import ingest

    ingest.land_pages(spark.sql("select 'q' query, 'sold' mode, timestamp '2024-01-01' fetched_at, 'x' html"), str(tmp_path / "p"))
    assert [f for f in os.listdir(tmp_path / "p" / "mode=sold") if f.endswith(".zstd.parquet")]


def test_tasks_follow_the_cards(spark, monkeypatch):
    from bidlens.sources import adapters

    monkeypatch.setattr(adapters, "CARDS_A_TASK", 2000)
    sf = "/root/testdata/sf0.01"
    # 60 000 cards; before, tasks followed the bytes of the narrow rows that the cards are made of
    assert adapters.cards(spark, sf, "query", "mode").rdd.getNumPartitions() == 30
    assert adapters.raw_pages(spark, sf).rdd.getNumPartitions() == 30  # pages are built where their cards are
