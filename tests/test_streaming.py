import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetspan.plans import catalog
from fleetspan.plans.prepare import alert_stream
from fleetspan.schema import FEATURES
from fleetspan.streaming import alerts, messages, ordered
from fleetspan.streaming.ordered import ordered_stream_windows
from fleetspan.streaming.statistics import fleet_statistics
from fleetspan.streaming.windows import stream_windows, windows_of_runs

NAMES = ["op_setting_1", "sensor_1"]


def body(engine, cycle, sensors=None, names=FEATURES):
    values = {name: float(cycle + i) for i, name in enumerate(names)} if sensors is None else sensors
    return json.dumps({"engine_id": engine, "cycle": cycle, "timestamp": "2024-01-01T00:00:00.5", "sensors": values})


def stream(spark, folder, files):
    """One file per trigger, in the order given."""
    for i, lines in enumerate(files):
        path = folder / f"{i:03d}.txt"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))


def drain(made, folder):
    query = alerts.write_alerts(made, str(folder / "rows"), str(folder / "checkpoint"), availableNow=True)
    assert query.awaitTermination(180)
    return made.sparkSession.read.schema(made.schema).parquet(str(folder / "rows"))


def kept(spark, tmp_path, files, late="drop", window=3):
    source = tmp_path / "in"
    source.mkdir(exist_ok=True)
    came = messages.valid_messages(messages.decode_messages(stream(spark, source, files), NAMES))
    return drain(stream_windows(came, ["engine_id"], len(NAMES), window, late=late), tmp_path)


def test_decoding(spark):
    full = {name: float(i) for i, name in enumerate(FEATURES)}
    lacking = {name: value for name, value in full.items() if name != "sensor_7"}
    bodies = [body(1, 1, full), body(1, 2, lacking), "{broken", None, json.dumps({"cycle": 3, "sensors": full}), body(2, 1, {**full, "sensor_7": None})]
    rows = spark.createDataFrame([(value,) for value in bodies], "value string")
    made = messages.decode_messages(rows)
    good = messages.valid_messages(made).collect()
    assert [(row["engine_id"], row["cycle"], row["features"]) for row in good] == [(1, 1, [float(i) for i in range(24)])]
    assert str(good[0]["timestamp"]).startswith("2024-01-01 00:00:00.5")
    errors = [row["error"] for row in messages.rejected_messages(made).collect()]
    assert sorted(errors) == [messages.MALFORMED] * 3 + [messages.MISSING] * 2
    assert alerts.engines_monitored(made).first()[0] == 2
    assert alerts.engines_monitored(made, approximate=True).first()[0] == 2


def test_encoding_and_decoding_agree(spark):
    rows = spark.createDataFrame([(7, 3, "2024-01-02 03:04:05", *[float(i) for i in range(24)])], "engine_id int, cycle int, timestamp string, " + ", ".join(f"{name} double" for name in FEATURES))
    sent = messages.to_sensor_messages(rows)
    assert sent.first()["key"] == "engine_7"
    assert list(json.loads(sent.first()["value"])["sensors"]) == FEATURES
    back = messages.valid_messages(messages.decode_messages(sent)).first()
    assert (back["engine_id"], back["cycle"], back["features"]) == (7, 3, [float(i) for i in range(24)])


def test_alert_levels(spark):
    rows = spark.createDataFrame([(1, 1, 25.0), (1, 2, 25.1), (1, 3, 10.0), (1, 4, 10.1), (2, 5, None)], "engine_id int, cycle int, rul double")
    made = alerts.rul_alerts(rows)
    assert {row["cycle"]: row["severity"] for row in made.collect()} == {1: "WARNING", 3: "CRITICAL", 4: "WARNING"}
    assert made.where("cycle = 3").first()["message"] == "Engine 1 has 10.0 cycles remaining!"
    row = alerts.alert_statistics(made).first()
    assert (row["total_alerts"], row["critical_alerts"], row["warning_alerts"]) == (3, 1, 2)
    assert [row["cycle"] for row in alerts.recent_alerts(made, 2).collect()] == [4, 3]


def test_windows_of_interleaved_engines(spark, tmp_path):
    lines = [body(engine, cycle, names=NAMES) for cycle in range(1, 32) for engine in (1, 2)] + [body(3, c, names=NAMES) for c in range(1, 30)]
    found = kept(spark, tmp_path, [lines[:40], lines[40:]], window=30).collect()
    assert sorted((row["engine_id"], row["window_end"]) for row in found) == [(1, 30), (1, 31), (2, 30), (2, 31)]
    for row in found:
        end = row["window_end"]
        assert row["x"] == [[float(c), float(c + 1)] for c in range(end - 29, end + 1)]


def test_rejected_message_leaves_the_window_alone(spark, tmp_path):
    lines = [body(1, 1, names=NAMES), body(1, 2, {"op_setting_1": 1.0}), "{", body(1, 3, names=NAMES), body(1, 4, names=NAMES)]
    found = kept(spark, tmp_path, [lines]).collect()
    assert [(row["window_end"], [step[0] for step in row["x"]]) for row in found] == [(4, [1.0, 3.0, 4.0])]


@pytest.mark.parametrize("late", ["keep", "drop", "report", "arrival"])
def test_late_readings(spark, tmp_path, late):
    files = [[body(1, c, names=NAMES) for c in (5, 4, 6)], [body(1, c, names=NAMES) for c in (2, 7, 7)]]
    found = kept(spark, tmp_path, files, late).collect()
    windows = sorted((row["window_end"], [step[0] for step in row["x"]]) for row in found if row["x"])
    if late == "keep":
        assert windows == [(2, [5.0, 6.0, 2.0]), (6, [4.0, 5.0, 6.0]), (7, [2.0, 7.0, 7.0]), (7, [6.0, 2.0, 7.0])]
    elif late == "arrival":
        assert windows == [(2, [4.0, 6.0, 2.0]), (6, [5.0, 4.0, 6.0]), (7, [2.0, 7.0, 7.0]), (7, [6.0, 2.0, 7.0])]
    else:
        assert windows == [(6, [4.0, 5.0, 6.0]), (7, [5.0, 6.0, 7.0])]
    if late == "report":
        assert sorted(row["window_end"] for row in found if row["late"]) == [2, 7]


def test_unknown_late_rule(spark):
    with pytest.raises(ValueError):
        stream_windows(spark.createDataFrame([(1, 1, [1.0])], "engine_id int, cycle int, features array<double>"), late="wait")


def test_stream_survives_a_restart(spark, tmp_path):
    first = kept(spark, tmp_path, [[body(1, c, names=NAMES) for c in (1, 2)]])
    assert first.count() == 0
    more = tmp_path / "in" / "100.txt"
    more.write_text(body(1, 3, names=NAMES) + "\n")
    came = messages.valid_messages(messages.decode_messages(spark.readStream.text(str(tmp_path / "in")), NAMES))
    again = drain(stream_windows(came, ["engine_id"], 2, 3), tmp_path)
    assert [(row["window_end"], row["x"]) for row in again.collect()] == [(3, [[1.0, 2.0], [2.0, 3.0], [3.0, 4.0]])]


def test_messages_to_alerts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [body(1, c, {"op_setting_1": 0.0, "sensor_1": 40.0 - 4 * c}) for c in range(1, 9)]

    def load():
        return lambda x: x[:, -1, 1]

    made = alert_stream(stream(spark, source, [lines]), load, NAMES, 3)
    found = {row["cycle"]: (row["severity"], row["rul"]) for row in drain(made, tmp_path).collect()}
    assert found == {4: ("WARNING", 24.0), 5: ("WARNING", 20.0), 6: ("WARNING", 16.0), 7: ("WARNING", 12.0), 8: ("CRITICAL", 8.0)}


def test_running_statistics(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("5\n15\n50\n")
    rul = spark.readStream.text(str(source)).select(F.lit(1).alias("engine_id"), F.lit(1).alias("cycle"), F.col("value").cast("double").alias("rul"))
    seen = []
    query = (
        alerts.alert_statistics(alerts.rul_alerts(rul))
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, _: seen.extend(map(tuple, batch.collect())))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    assert seen[-1] == (2, 1, 1)


def timed(engine, cycle, seconds, names=NAMES):
    at = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)
    values = {name: float(cycle + i) for i, name in enumerate(names)}
    return json.dumps({"engine_id": engine, "cycle": cycle, "timestamp": at.strftime("%Y-%m-%dT%H:%M:%S.%f"), "sensors": values})


def in_order(spark, folder, files, window=5, **options):
    """Windows in event order of one file per trigger, closed by a message of no engine."""
    (folder / "in").mkdir(parents=True)
    lines = [[timed(*row) for row in rows] for rows in [*files, [(-1, 0, 1_000_000)]]]
    came = messages.valid_messages(messages.decode_messages(stream(spark, folder / "in", lines), NAMES))
    made = drain(ordered_stream_windows(came, ["engine_id"], len(NAMES), window, **options), folder)
    return sorted((row["engine_id"], row["window_end"], [step[0] for step in row["x"]]) for row in made.collect())


def test_windows_in_event_order_do_not_depend_on_triggers(spark, tmp_path):
    rows = [(engine, c, 10 * c + engine) for engine in (1, 2) for c in range(1, 40)]
    # An engine that is silent for more than five minutes, and one with equal times.
    rows += [(3, c, 10 * c + (500 if c > 20 else 0)) for c in range(1, 40)] + [(4, c, 7) for c in range(1, 9)]
    shuffled = random.Random(1).sample(rows, len(rows))
    by_time = sorted(rows, key=lambda row: row[2])
    options = {"delay": "1 day", "forget_after": "5 minutes"}
    one = in_order(spark, tmp_path / "one", [rows], **options)
    five = in_order(spark, tmp_path / "five", [shuffled[i::5] for i in range(5)], **options)
    many = in_order(spark, tmp_path / "many", [by_time[i : i + 25] for i in range(0, len(by_time), 25)], delay="1 second", forget_after="5 minutes")
    wanted = [(engine, c, [float(x) for x in range(c - 4, c + 1)]) for engine in (1, 2) for c in range(5, 40)]
    wanted += [(3, c, [float(x) for x in range(c - 4, c + 1)]) for c in range(5, 40) if not 21 <= c <= 24]
    wanted += [(4, c, [float(x) for x in range(c - 4, c + 1)]) for c in range(5, 9)]
    assert one == five == many == sorted(wanted)


def test_silent_engines_leave_the_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = [[timed(engine, c, c) for engine in range(1, 9) for c in range(1, 4)], [timed(1, 4, 5000)], [timed(1, 5, 10_000)], [timed(-1, 0, 10_100)]]
    came = messages.valid_messages(messages.decode_messages(stream(spark, tmp_path / "in", files), NAMES))
    made = ordered_stream_windows(came, ["engine_id"], len(NAMES), 2, delay="10 seconds", forget_after="1 minute")
    query = alerts.write_alerts(made, str(tmp_path / "rows"), str(tmp_path / "checkpoint"), availableNow=True)
    assert query.awaitTermination(180)
    rows = [progress["stateOperators"][0]["numRowsTotal"] for progress in map(lambda p: json.loads(p.json), query.recentProgress) if progress["stateOperators"]]
    assert max(rows) >= 8 and rows[-1] <= 6
    found = spark.read.parquet(str(tmp_path / "rows")).where("engine_id = 1").collect()
    # Readings 4 and 5 come after a silence: each starts anew.
    assert sorted(row["window_end"] for row in found) == [2, 3]


def test_fleet_statistics_after_every_trigger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = [
        [body(e, c, {"op_setting_1": 0.0, "sensor_1": 40.0 - 4 * c + e}) for c in range(k, k + 3) for e in (1, 2)] + [body(9 + k, 1, {}), "{"]
        for k in (1, 4, 7)
    ]
    raw = stream(spark, tmp_path / "in", files)
    raised = alert_stream(raw, lambda: lambda x: x[:, -1, 1], NAMES, 3)
    found = drain(fleet_statistics(raised, messages.decode_messages(raw, NAMES), newest=3), tmp_path).orderBy("updates").collect()
    ruls = [(c, e, 40.0 - 4 * c + e) for c in range(3, 10) for e in (1, 2) if 40 - 4 * c + e <= 25]
    for i, row in enumerate(found):
        seen = [alert for alert in ruls if alert[0] <= 3 * (i + 1)]
        critical = sum(rul <= 10 for _, _, rul in seen)
        assert (row["updates"], row["total_alerts"], row["critical_alerts"], row["warning_alerts"], row["engines_monitored"]) == (
            i + 1, len(seen), critical, len(seen) - critical, 3 + i)
        assert [(a["cycle"], a["engine_id"], a["rul"]) for a in row["recent"]] == sorted(seen, reverse=True)[:3]
    assert len(found) == 3


def test_engines_share_a_bounded_number_of_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "GROUPS", 3, raising=False)
    keys = ["if(e = 7, null, concat('a\"', e)) as site", "if(e = 8, null, shiftleft(cast(e as bigint), 55)) as unit"]
    rows = [(e, c, 10 * c + e) for c in range(1, 13) for e in range(40)]
    for i in range(3):
        mine = [row for row in rows if (row[0] + row[1]) % 3 == i] + ([(-1, 0, 1_000_000)] if i == 2 else [])
        made = spark.createDataFrame(mine, "e int, cycle int, s int").coalesce(1)
        made.selectExpr(*keys, "cycle", "timestamp_seconds(s) as timestamp", "array(double(cycle), double(e)) as features").write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = ordered_stream_windows(source, ["site", "unit"], 2, 4, delay="1 hour", forget_after="1 hour")
    query = alerts.write_alerts(made, str(tmp_path / "rows"), str(tmp_path / "checkpoint"), availableNow=True)
    assert query.awaitTermination(180)
    found = spark.read.schema(made.schema).parquet(str(tmp_path / "rows")).collect()
    name = lambda e: (None if e == 7 else f'a"{e}', None if e == 8 else e << 55)
    wanted = [(*name(e), c, [[float(k), float(e)] for k in range(c - 3, c + 1)]) for e in range(40) for c in range(4, 13)]
    assert sorted(map(repr, [(row["site"], row["unit"], row["window_end"], row["x"]) for row in found])) == sorted(map(repr, wanted))
    states = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) for p in query.recentProgress) if p["stateOperators"]]
    # A few rows for each group: blocks of readings, readings held, and a timer.
    assert 0 < max(states) <= 3 * 8


def test_disordered_events_come_in_as_many_triggers_however_many_files(spark, tmp_path):
    events = spark.range(600).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id % 7 as user_id", "'view' as event_type", "double(id) as value", "'{\"k\": 1}' as props")
    events.repartition(24).write.parquet(str(tmp_path / "events.parquet"))
    catalog._disordered(spark, str(tmp_path), str(tmp_path))
    came = catalog._disordered_stream(spark, str(tmp_path), str(tmp_path))
    query = alerts.write_alerts(came.select("event_id"), str(tmp_path / "rows"), str(tmp_path / "checkpoint"), availableNow=True)
    assert query.awaitTermination(180)
    triggers = [p["numInputRows"] for p in (json.loads(p.json) for p in query.recentProgress) if p["numInputRows"]]
    assert sum(triggers) == 601 and 3 <= len(triggers) <= 2 * catalog.PARTS
    assert spark.read.parquet(str(tmp_path / "rows")).distinct().count() == 601


def test_few_tasks_that_read_the_events_leave_many_equal_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 20, raising=False)
    events = spark.range(600).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id % 7 as user_id", "'view' as event_type", "double(id) as value", "'{\"k\": 1}' as props")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    catalog._disordered(spark, str(tmp_path), str(tmp_path))
    files = spark.read.parquet(str(tmp_path / "source")).groupBy(F.input_file_name()).count().collect()
    assert sum(row["count"] for row in files) == 601
    # One file is one task of those who decode the messages.
    assert max(row["count"] for row in files) <= 20 and len(files) >= 30


def test_windows_of_runs_with_and_without_readings(spark):
    rows = [(1, [7, 8, 9], [float(x) for x in range(8)]), (2, [4], None), (3, [5], [1.0, 2.0, 3.0, None])]
    runs = spark.createDataFrame(rows, "unit int, ends array<bigint>, flat array<double>")
    found = sorted(map(tuple, windows_of_runs(runs, ["unit"], 2, 2).collect()))
    assert found == [
        (1, 7, [[0.0, 1.0], [2.0, 3.0]]), (1, 8, [[2.0, 3.0], [4.0, 5.0]]), (1, 9, [[4.0, 5.0], [6.0, 7.0]]),
        (2, 4, None), (3, 5, [[1.0, 2.0], [3.0, None]])]
