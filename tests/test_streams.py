"""Streams over several micro-batches and with a restart in between give what one batch gives."""

from __future__ import annotations

import datetime
import glob
import os

import numpy as np
import pytest

from bidlens.operators import table
from bidlens.operators.outcomes import TIERS
from bidlens.streaming import ledger, refresh, upserts, verify


def feed(spark, folder, name, data, schema):
    """data as one more file of the folder, later than those before."""
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/w{name}")
    (folder / "in").mkdir(exist_ok=True)
    part = next((folder / f"w{name}").glob("*.parquet"))
    part.rename(folder / "in" / f"{name}.parquet")
    os.utime(folder / "in" / f"{name}.parquet", (1000 + name, 1000 + name))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    schema = "id long, price double, mode string, seq long"
    rng = np.random.default_rng(1)
    rows = [(int(i), float(p), "active", n) for n, (i, p) in enumerate(zip(rng.integers(0, 40, 300), rng.random(300), strict=True))]
    base = f"{tmp_path}/table"
    want = {}
    for n in range(6):
        part = rows[50 * n : 50 * n + 50]
        feed(spark, tmp_path, n, part[::-1], schema)
        want |= {r[0]: r for r in part}
        if n in (2, 5):  # a new query on the same folder each time
            got = upserts.merge_stream(stream(spark, tmp_path, schema), base)
            assert {r["id"]: tuple(r) for r in got.collect()} == want
    assert {r["id"]: tuple(r) for r in upserts.merge_stream(stream(spark, tmp_path, schema), base).collect()} == want


def modified(base):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{base}/rows/**/*.parquet", recursive=True)}


def test_a_batch_rewrites_only_what_it_touches(spark, tmp_path):
    schema = "id long, price double, mode string, seq long"
    base = f"{tmp_path}/table"
    feed(spark, tmp_path, 0, [(i, 1.0, "active", i) for i in range(200)], schema)
    upserts.merge_stream(stream(spark, tmp_path, schema), base)
    before = modified(base)
    feed(spark, tmp_path, 1, [(7, 2.0, "sold", 300), (7, 3.0, "sold", 299)], schema)
    got = upserts.merge_stream(stream(spark, tmp_path, schema), base)
    assert {r["id"]: r["price"] for r in got.collect()} == {i: 2.0 if i == 7 else 1.0 for i in range(200)}
    after = modified(base)
    folder = lambda f: os.path.dirname(f)
    assert len(set(map(folder, after))) == upserts.BUCKETS
    assert len({folder(f) for f in after if before.get(f) != after[f]}) == 1
    # a row of an older write changes nothing
    feed(spark, tmp_path, 2, [(7, 9.0, "active", 5), (8, 4.0, "active", 400)], schema)
    got = upserts.merge_stream(stream(spark, tmp_path, schema), base)
    assert {r["id"]: r["price"] for r in got.where("id in (7, 8)").collect()} == {7: 2.0, 8: 4.0}


def test_a_batch_that_failed_half_way_runs_again(spark, tmp_path, monkeypatch):
    schema = "id long, price double, mode string, seq long"
    base = f"{tmp_path}/table"
    feed(spark, tmp_path, 0, [(1, 1.0, "a", 1), (2, 1.0, "a", 2)], schema)
    upserts.merge_stream(stream(spark, tmp_path, schema), base)
    feed(spark, tmp_path, 1, [(2, 2.0, "a", 3), (5, 5.0, "a", 4)], schema)
    real = table.merge

    def dies(*a, **k):  # once the rows are written, before the stream notes that the batch is done
        real(*a, **k)
        raise RuntimeError("lost")

    monkeypatch.setattr(table, "merge", dies)
    with pytest.raises(Exception, match="lost"):
        upserts.merge_stream(stream(spark, tmp_path, schema), base)
    monkeypatch.setattr(table, "merge", real)
    got = upserts.merge_stream(stream(spark, tmp_path, schema), base)
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, "a", 1), (2, 2.0, "a", 3), (5, 5.0, "a", 4)]


def planned(ticks):
    out, last = set(), {}
    for i, seq, at, end in sorted(ticks, key=lambda t: (t[2], t[1])):
        left = (end - at).total_seconds() / 60
        every = next((t for most, t in TIERS if left <= most), None) if left > 0 else None
        if every and (i not in last or (at - last[i]).total_seconds() >= 60 * every):
            out.add((i, seq, every))
            last[i] = at
    return out


def test_refresh_plan_over_batches(spark, tmp_path):
    schema = "id long, seq long, at timestamp, end_time timestamp"
    start, rng = datetime.datetime(2026, 3, 1, 10), np.random.default_rng(2)
    ticks, base = [], f"{tmp_path}/plan"
    for n in range(400):
        i = int(rng.integers(0, 6))
        ticks.append((i, n, start + datetime.timedelta(seconds=30 * n), start + datetime.timedelta(minutes=30 * i + 20)))
    for n in range(5):
        feed(spark, tmp_path, n, ticks[80 * n : 80 * n + 80], schema)
        if n in (2, 4):
            got = refresh.follow(stream(spark, tmp_path, schema), base)
    assert {tuple(r) for r in got.collect()} == planned(ticks)


def test_a_deal_listed_again_keeps_its_last_refresh(spark, tmp_path):
    """Its end passes, the watermark too, and it is listed again while the last refresh is minutes ago."""
    schema = "id long, seq long, at timestamp, end_time timestamp"
    at = lambda h, m, s=0: datetime.datetime(2026, 3, 1, h, m, s)
    batches = [
        [(1, 1, at(10, 59, 50), at(11, 0))],
        [(2, 2, at(11, 0, 30), at(12, 0))],
        [(1, 3, at(11, 1), at(12, 0)), (1, 4, at(11, 14, 49), at(12, 0)), (1, 5, at(11, 14, 50), at(12, 0))],
        [(2, 6, at(14, 0), at(14, 30))],
        [(1, 7, at(14, 1), at(14, 59)), (1, 8, at(13, 1), at(14, 0))],
    ]
    ticks = []
    for n, rows in enumerate(batches):
        feed(spark, tmp_path, n, rows, schema)
        ticks += rows
        got = refresh.follow(stream(spark, tmp_path, schema), f"{tmp_path}/plan")
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1), (2, 2, 15), (1, 5, 15), (2, 6, 15), (1, 8, 15), (1, 7, 15)}
    assert planned(ticks) == {tuple(r) for r in got.collect()}


def test_first_sightings_over_batches(spark, tmp_path):
    schema = "id long, price double, at timestamp"
    day = lambda n: datetime.datetime(2026, 1, n)
    static = spark.createDataFrame([(5, "x")], "id long, other string")
    batches = [[(1, 3.0, day(3)), (1, 2.0, day(2)), (5, 1.0, day(1))], [(1, 9.0, day(1)), (2, 4.0, day(5))], [(2, 8.0, day(9)), (3, 1.0, day(9))], [(3, 0.5, day(1)), (1, 7.0, day(20))]]
    for n, rows in enumerate(batches):
        feed(spark, tmp_path, n, rows, schema)
        if n in (0, 1, 3):
            got = ledger.record_first_sightings(stream(spark, tmp_path, schema), f"{tmp_path}/deals", static)
    assert sorted(map(tuple, got.collect())) == [(1, 2.0, day(2)), (2, 4.0, day(5)), (3, 1.0, day(9))]
    # the last batch again, as after a failure: the same rows
    for name in ("3", ".3.crc"):
        os.remove(f"{tmp_path}/deals/log/commits/{name}")
    again = ledger.record_first_sightings(stream(spark, tmp_path, schema), f"{tmp_path}/deals", static)
    assert sorted(map(tuple, again.collect())) == [(1, 2.0, day(2)), (2, 4.0, day(5)), (3, 1.0, day(9))]


def test_verification_as_deals_and_pages_arrive(spark, tmp_path):
    """Over several batches, with restarts: what a plain loop over all rows gives."""
    rng = np.random.default_rng(9)
    start = datetime.datetime(2026, 1, 1)
    deals, pages = [], []
    for n in range(120):
        deals.append((n, int(rng.integers(0, 40)), start + datetime.timedelta(hours=6 * n + 30)))
    for n in range(200):
        mode = ["sold", "completed", "active"][int(rng.integers(0, 3))]
        at = start + datetime.timedelta(hours=4 * n, minutes=7)
        pages.append((int(rng.integers(0, 40)), mode, n, at.date() if mode == "sold" and n % 5 else None, n + 0.129, n % 7, at))
    for part in ("deals", "pages"):
        (tmp_path / part).mkdir()
    for n in range(5):
        feed(spark, tmp_path / "deals", n, deals[24 * n : 24 * n + 24], "deal long, id long, end_time timestamp")
        feed(spark, tmp_path / "pages", n, pages[40 * n : 40 * n + 40], "id long, mode string, seq long, sold_date date, price double, bids int, at timestamp")
        if n in (1, 4):
            d = stream(spark, tmp_path / "deals", "deal long, id long, end_time timestamp")
            p = stream(spark, tmp_path / "pages", "id long, mode string, seq long, sold_date date, price double, bids int, at timestamp")
            got = verify.follow(d, p, f"{tmp_path}/out")
    shown = [x for x in pages if x[1] == "completed" or (x[1] == "sold" and x[3])]
    mark = min(max(x[6] for x in shown) - datetime.timedelta(days=1), max(d[2] for d in deals) - datetime.timedelta(days=2))
    want = {}
    for deal, i, end in deals:
        near = [x for x in shown if x[0] == i and datetime.timedelta(hours=6) < x[6] - end < datetime.timedelta(days=7)]
        sold = max((x for x in near if x[1] == "sold"), key=lambda x: x[2], default=None)
        if sold:
            want[deal] = ("SOLD", sold[3], int(sold[4] * 100), sold[5], False)
        elif near:
            want[deal] = ("UNSOLD", end.date(), None, None, True)
        elif end + datetime.timedelta(days=7) <= mark:
            want[deal] = ("PENDING", None, None, None, False)
    assert {r["deal"]: (r["status"], r["sold_date"], r["price_pence"], r["bids"], r["ended_unsold"]) for r in got.collect()} == want
    assert {x[0] for x in want.values()} == {"SOLD", "UNSOLD", "PENDING"}
