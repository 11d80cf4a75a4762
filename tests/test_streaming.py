import datetime as dt

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import consumption, positions
from shelfwise.sources import writers
from shelfwise.streaming.changes import change_capture
from shelfwise.streaming.consumption import running_consumption
from shelfwise.streaming.late import ConsumptionLog
from shelfwise.streaming.refresh import StockRefresh
from shelfwise.streaming.versions import VersionedTables
from tests.fixtures import TODAY, classified, daily, empty_masters, records

KEYS = ("record_date", "location_code", "item_code")


def test_changes_between_snapshots(spark):
    same = records([0], item_code="same") + records([0, 0], item_code="twice")
    before = same + records([0], item_code="gone") + records([0], item_code="new stock")
    after = (
        records([0], item_code="same") + records([0], item_code="twice")
        + records([0], item_code="new stock", closing_stock=5.0)
        + records([0, 0], item_code="added") + records([0], item_code=None)
    )
    got = change_capture(daily(spark, before), daily(spark, after), KEYS).collect()
    assert sorted((str(r["item_code"]), r["change_type"], r["action"], r["copies"])
                  for r in got) == [
        ("None", "INSERT", "INSERT", 1),
        ("added", "INSERT", "INSERT", 2),
        ("gone", "DELETE", "DELETE", 1),
        ("new stock", "UPDATE", "DELETE", 1),
        ("new stock", "UPDATE", "INSERT", 1),
        ("twice", "DELETE", "DELETE", 1),
    ]


def _refresh(spark, tmp_path, schema):
    items, locations, params = empty_masters(spark)
    return StockRefresh(
        spark, str(tmp_path / "facts"), schema, str(tmp_path / "tables"), items, locations,
        params, TODAY, buckets=4,
    )


def _same_rows(got, expected):
    columns = [c for c in expected.columns if c != "calculated_timestamp"]
    left, right = got.select(columns), expected.select(columns)
    assert left.count() == right.count()
    assert left.exceptAll(right).count() == 0


def test_refresh_equals_batch_after_every_arrival(spark, tmp_path):
    waves = [
        [row for n in range(12) for row in
         records([40, 20, 3], item_code=f"I{n}", issues=float(n), closing_stock=30.0)],
        # late and fresh rows of some pairs, one renamed item, one new pair
        records([50, 1], item_code="I3", issues=9.0, closing_stock=2.0)
        + records([0], item_code="I5", item_name="Renamed", issues=1.0, closing_stock=0.0)
        + records([0], item_code="NEW", issues=2.0),
        records([60], item_code="I7", closing_stock=1.0),
    ]
    for number, wave in enumerate(waves):
        for n, row in enumerate(wave):
            row["stock_record_id"] = number * 1000 + n
    schema = daily(spark, waves[0]).schema
    refresh = _refresh(spark, tmp_path, schema)
    seen = []
    for wave in waves:
        writers.append_daily_stock(daily(spark, wave), refresh.fact_path)
        seen += wave
        refresh.start(every=None, with_rollups=True).awaitTermination()
        _same_rows(refresh.health(), classified(spark, seen))
    logged = refresh.alerts()
    assert logged.filter("batch_id = 1 AND item_code = 'I5' AND alert_type = 'STOCK_OUT'").count()
    assert logged.filter("batch_id = 1 AND item_code = 'I4'").count() == 0
    summary = spark.read.parquet(f"{refresh.root}/executive_summary").first()
    assert summary["total_items"] == 13

    # repeating a batch, and rebuilding from the whole table, change nothing
    refresh.refresh(daily(spark, waves[1]), 1)
    _same_rows(refresh.health(), classified(spark, seen))
    refresh.rebuild()
    _same_rows(refresh.health(), classified(spark, seen))


def test_running_consumption_drops_late_rows(spark, tmp_path):
    def wave(name, rows):
        frame = spark.createDataFrame(
            [(dt.datetime(2024, 1, day, 12), "L1", "I1", issues) for day, issues in rows],
            "ts timestamp, location_code string, item_code string, issues double",
        )
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return frame.schema

    def run():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        running_consumption(source, "3 days", "1 day").writeStream.format("parquet").outputMode(
            "append"
        ).option("checkpointLocation", str(tmp_path / "check")).trigger(
            availableNow=True
        ).start(str(tmp_path / "out")).awaitTermination()
        return {
            r["window_end"].day: (r["issues"], r["movements"])
            for r in spark.read.parquet(str(tmp_path / "out")).collect()
        }

    schema = wave("a", [(5, 1.0), (5, 2.0), (6, 4.0), (10, 8.0)])
    first = run()
    assert first == {6: (3.0, 2), 7: (7.0, 3), 8: (7.0, 3), 9: (4.0, 1)}
    wave("b", [(5, 100.0), (20, 1.0)])  # the row of the 5th is too late
    second = run()
    assert second == {**first, 11: (8.0, 1), 12: (8.0, 1), 13: (8.0, 1)}


def test_a_new_day_ages_all_pairs_and_replays_nothing(spark, tmp_path):
    first = records([20], item_code="I1", issues=1.0, stock_record_id=1)
    first += records([5], item_code="I2", issues=2.0, stock_record_id=2)
    schema = daily(spark, first).schema
    items, locations, params = empty_masters(spark)
    day = [TODAY]

    def started():
        return StockRefresh(
            spark, str(tmp_path / "facts"), schema, str(tmp_path / "tables"), items, locations,
            params, lambda: day[0], buckets=4,
        )

    def arrive(rows):
        writers.append_daily_stock(daily(spark, rows), str(tmp_path / "facts"), by_date=False)
        refresh = started()  # a new process goes on with the same folders
        refresh.start(every=None).awaitTermination()
        return refresh

    arrive(first)
    day[0] = TODAY + dt.timedelta(days=45)
    later = records([-44], item_code="I2", issues=1.0, closing_stock=0.0, stock_record_id=3)
    refresh = arrive(later)
    _same_rows(refresh.health(), classified(spark, first + later, as_of=day[0]))
    alerts = refresh.alerts().collect()
    assert {r["item_code"] for r in alerts if r["alert_date"] == day[0]} <= {"I2"}
    assert len({r["batch_id"] for r in alerts}) <= 2


def _waves():
    waves = [
        [row for n in range(8) for row in
         records([40, 20, 3], item_code=f"I{n}", issues=float(n), closing_stock=30.0)],
        records([50, 1], item_code="I3", issues=9.0, closing_stock=2.0)
        + records([0], item_code="I5", item_name="Renamed", issues=1.0, closing_stock=0.0),
        records([2, 2], item_code="I3", issues=4.0) + records([0], item_code="NEW", issues=2.0),
    ]
    for number, wave in enumerate(waves):
        for n, row in enumerate(wave):
            row["stock_record_id"] = number * 1000 + n
    return waves


def test_readers_see_one_whole_version_during_a_refresh(spark, tmp_path, monkeypatch):
    waves = _waves()
    refresh = _refresh(spark, tmp_path, daily(spark, waves[0]).schema)
    with pytest.raises(LookupError):
        refresh.health()
    # No fact folder exists: what a batch needs is in the tables and the batch itself.
    refresh.refresh(daily(spark, waves[0]), 0)
    opened = refresh.health()  # planned now, read after the next version is there
    before = classified(spark, waves[0])

    publish = VersionedTables.publish

    def lost(tables, version):
        raise OSError("the writer is lost before its version is published")

    monkeypatch.setattr(VersionedTables, "publish", lost)
    with pytest.raises(OSError):
        refresh.refresh(daily(spark, waves[1]), 1)
    _same_rows(refresh.health(), before)
    monkeypatch.setattr(VersionedTables, "publish", publish)
    for _ in range(2):  # the batch is repeated, once more after it was published
        refresh.refresh(daily(spark, waves[1]), 1)
        _same_rows(refresh.health(), classified(spark, waves[0] + waves[1]))
    _same_rows(opened, before)
    _same_rows(refresh.health(1), before)

    refresh.refresh(daily(spark, waves[2]), 2)
    refresh.tables.expire(keep=2)
    assert refresh.tables.numbers() == [2, 3]
    _same_rows(refresh.health(2), classified(spark, waves[0] + waves[1]))
    _same_rows(refresh.health(), classified(spark, sum(waves, [])))


def test_positions_hold_one_row_a_pair_and_name(spark, tmp_path):
    waves = _waves()
    refresh = _refresh(spark, tmp_path, daily(spark, waves[0]).schema)
    for number, wave in enumerate(waves):
        refresh.refresh(daily(spark, wave), number)
    now = refresh.tables.version()
    kept = refresh.tables.read(now, "positions")
    assert kept.count() == kept.select("location_code", "item_code", "item_name").distinct().count() == 10
    partials = refresh.tables.read(now, "partials")
    assert partials.count() == partials.select("item_code", "item_name", "record_date").distinct().count()


def test_partials_give_the_consumption_of_all_records(spark):
    rng = random.Random(4)
    rows = []
    for n in range(400):
        rows += records(
            [rng.randint(-40, 130)], item_code=f"I{rng.randint(0, 8)}",
            item_name=rng.choice(["A", "A", "B", None]), stock_record_id=n,
            issues=rng.choice([0.0, None, 1.5, float(rng.randint(1, 90))]),
        )
    rows += records([5, 6], item_code="only nulls", issues=None)
    since = TODAY - dt.timedelta(days=90)
    parts = [consumption.day_partials(daily(spark, rows[i::3]), since) for i in range(3)]
    merged = consumption.merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2]), since)
    got = consumption.metrics_of_partials(merged, TODAY)
    expected = consumption.consumption_metrics(daily(spark, rows), TODAY)
    assert got.columns == expected.columns
    rounded = lambda frame: sorted(
        str([round(v, 7) if isinstance(v, float) else v for v in row]) for row in frame.collect()
    )
    assert rounded(got) == rounded(expected)
    # days that left the window are gone, and a later day needs no others
    later = TODAY + dt.timedelta(days=30)
    evicted = consumption.merge_partials(merged, later - dt.timedelta(days=90))
    assert evicted.count() < merged.count()
    assert rounded(consumption.metrics_of_partials(evicted, later)) == rounded(
        consumption.consumption_metrics(daily(spark, rows), later)
    )


def test_one_pass_equals_position_joined_to_consumption(spark):
    rng = random.Random(9)
    rows = []
    for n in range(300):
        rows += records(
            [rng.choice([rng.randint(-5, 89), rng.randint(91, 300)])],
            item_code=f"I{rng.randint(0, 30)}", item_name=rng.choice(["A", "A", "A", "B", None]),
            stock_record_id=n, closing_stock=float(rng.randint(0, 9)),
            issues=rng.choice([0.0, None, 3.0]),
        )
    rows += records([200], item_code="old") + records([300], item_code="older", item_name="Z")
    rows.append({**rows[0], "record_date": None})
    frame = daily(spark, rows)
    usage = consumption.consumption_metrics(frame, TODAY).drop(
        "location_name", "item_name", "item_category", "unit_of_measure"
    )
    expected = positions.latest_stock_position(frame).join(usage, ["location_code", "item_code"], "left")
    got = consumption.position_with_consumption(frame, TODAY)
    assert set(got.columns) == set(expected.columns)
    same = sorted(got.columns)
    text = lambda found: sorted(str(tuple(r)) for r in found.select(*same).collect())
    assert text(got) == text(expected)


def test_the_change_feed_adds_up_to_the_end_states(spark, tmp_path):
    waves = _waves()
    schema = daily(spark, waves[0]).schema
    states = []
    for wave in waves:
        writers.append_daily_stock(daily(spark, wave), str(tmp_path / "facts"))
        refresh = _refresh(spark, tmp_path, schema)  # restarted for every batch
        refresh.start(every=None).awaitTermination()
        states.append(refresh.health().drop("calculated_timestamp"))
    feed = refresh.changes()
    columns = states[0].columns
    text = lambda frame: sorted(map(str, frame.select(*columns, "change_type", "action", "copies").collect()))
    before = states[0].limit(0)
    for number, after in enumerate(states):
        expected = change_capture(before, after, ("location_code", "item_code"))
        assert text(feed.filter(F.col("batch_id") == number)) == text(expected)
        before = after
    net = feed.groupBy(*columns).agg(
        F.sum(F.when(F.col("action") == "INSERT", F.col("copies")).otherwise(-F.col("copies"))).alias("n")
    ).filter("n != 0")
    assert net.filter("n != 1").count() == 0
    _same_rows(net.drop("n"), states[-1])
    out = str(tmp_path / "consumed")
    refresh.stream_changes().writeStream.format("parquet").option(
        "checkpointLocation", f"{out}-check"
    ).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == feed.count()


def test_a_rebuild_and_a_stream_count_no_file_twice(spark, tmp_path):
    waves = _waves()
    refresh = _refresh(spark, tmp_path, daily(spark, waves[0]).schema)
    writers.append_daily_stock(daily(spark, waves[0]), refresh.fact_path)
    refresh.rebuild()
    refresh.start(every=None).awaitTermination()  # meets the files of the rebuild
    _same_rows(refresh.health(), classified(spark, waves[0]))
    writers.append_daily_stock(daily(spark, waves[1]), refresh.fact_path)
    refresh.rebuild()  # ahead of the stream
    writers.append_daily_stock(daily(spark, waves[2]), refresh.fact_path)
    refresh.start(every=None).awaitTermination()
    _same_rows(refresh.health(), classified(spark, sum(waves, [])))


def test_rollups_follow_the_versions_at_their_own_lag(spark, tmp_path):
    waves = _waves()
    refresh = _refresh(spark, tmp_path, daily(spark, waves[0]).schema)
    refresh.refresh(daily(spark, waves[0]), 0)
    refresh.publish_rollups()
    refresh.refresh(daily(spark, waves[1]), 1)
    quick = {"location_risk_summary": "once"}
    for query in refresh.start_rollups(quick).values():
        query.awaitTermination()
    opened = refresh.rollup_table("executive_summary")
    assert opened.first()["total_items"] == 8  # keeps its own, longer lag
    refresh.refresh(daily(spark, waves[2]), 2)
    for _ in range(2):  # the second time nothing new was published
        for query in refresh.start_rollups({"executive_summary": "once"}).values():
            query.awaitTermination()
    assert refresh.rollup_table("executive_summary").first()["total_items"] == 9
    assert refresh.rollup("executive_summary").numbers() == [1, 2]
    assert refresh.rollup("location_risk_summary").version().notes == {"of": 2}
    assert opened.first()["total_items"] == 8  # an open reader keeps its version
    assert refresh.rollup_table("reorder_recommendations").count() >= 0


MOVEMENTS = "ts timestamp, location_code string, item_code string, issues double"


def _movements(spark, rows):
    return spark.createDataFrame(
        [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), place, item, q) for h, place, item, q in rows], MOVEMENTS
    )


def _plain_windows(rows, days):
    """(window end as day of the year from 0, pair) -> (issues, movements)."""
    found = {}
    for hours, place, item, issues in rows:
        for end in range(hours // 24 + 1, hours // 24 + days + 1):
            total, n = found.get((end, place, item), (0.0, 0))
            found[end, place, item] = total + issues, n + 1
    return found


def _window_rows(frame):
    return {
        ((r["window_end"] - dt.date(2024, 1, 1)).days, r["location_code"], r["item_code"]): (r["issues"], r["movements"])
        for r in frame.collect()
    }


def test_late_rows_correct_closed_windows(spark, tmp_path):
    rnd = random.Random(3)
    log = ConsumptionLog(spark, str(tmp_path / "log"), window_days=3)
    seen, newest = [], 0
    for number in range(5):
        rows = [  # each batch reaches further, and back to the first day
            (rnd.randint(0, 24 * (4 + 4 * number)), f"L{rnd.randint(1, 2)}", rnd.choice(["a", "b", None]), float(rnd.randint(1, 9)))
            for _ in range(40)
        ]
        late = [r for r in rows if number and (r[0] // 24 + 1) * 24 <= (newest - 24) // 24 * 24]
        log.update(_movements(spark, rows), number)
        log.update(_movements(spark, rows), number)  # a repeated batch
        seen += rows
        newest = max([newest] + [r[0] for r in rows])
        expected = _plain_windows(seen, 3)
        closed_to = (newest - 24) // 24
        assert _window_rows(log.closed()) == {k: v for k, v in expected.items() if k[0] <= closed_to}
        assert _window_rows(log.still_open()) == {k: v for k, v in expected.items() if k[0] > closed_to}
        if number:
            assert late and log.late().filter(F.col("batch_id") == number).count() == len(late)


def test_late_rows_of_a_stream_and_batches_that_close_nothing(spark, tmp_path):
    log = ConsumptionLog(spark, str(tmp_path / "log"), window_days=3)
    rows = []
    waves = [[(200, "L1", "a", 1.0)], [(201, "L1", "a", 2.0)], [(0, "L1", "a", 4.0)], [(700, "L1", "a", 8.0)]]
    for wave in waves:
        _movements(spark, wave).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(MOVEMENTS).parquet(str(tmp_path / "in"))
        log.start(source).awaitTermination()
        rows += wave
        got = _window_rows(log.closed()) | _window_rows(log.still_open())
        assert got == _plain_windows(rows, 3)
    assert [r["issues"] for r in log.late().collect()] == [4.0]
    log.update(spark.createDataFrame([(None, "L1", "a", 1.0)], MOVEMENTS), 99)
    log.update(spark.createDataFrame([], MOVEMENTS), 100)
    assert _window_rows(log.closed()) | _window_rows(log.still_open()) == _plain_windows(rows, 3)
    with pytest.raises(LookupError):
        ConsumptionLog(spark, str(tmp_path / "none")).closed()
