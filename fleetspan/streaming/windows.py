"""Keyed count windows on a stream: the last readings of every engine."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetspan.schema import TIME, WINDOW

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
HDFS = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = ("keep", "drop", "report", "arrival")
# Windows that share one run of readings on their way back to Spark.
WINDOWS_PER_RUN = 256


class _LastReadings(StatefulProcessor):
    """Keeps the last ``window - 1`` readings and the last cycle of one engine."""

    def __init__(self, keys, time, window, width, late):
        self.keys, self.time, self.window, self.width, self.late = keys, time, window, width, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("readings", "last bigint, held array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Held as plain numbers: a few bytes per value, however many readings a trigger brings.
        parts = [
            (part[self.time].to_numpy(dtype=np.int64), np.stack(part["features"].to_numpy()).astype(float))
            for part in rows
            if len(part)
        ]
        times = np.concatenate([part[0] for part in parts])
        readings = np.concatenate([part[1] for part in parts])
        if self.late != "arrival":
            order = np.argsort(times, kind="stable")
            times, readings = times[order], readings[order]
        last, held = None, np.empty((0, self.width))
        if self.state.exists():
            last, flat = self.state.get()
            held = np.asarray(flat, dtype=float).reshape(-1, self.width)
        if self.late in ("arrival", "keep"):
            fresh = np.ones(len(times), dtype=bool)
        else:
            # A reading is fresh when its cycle lies beyond everything seen before it.
            earlier = np.concatenate(([np.iinfo(np.int64).min if last is None else last], times[:-1]))
            fresh = times > np.maximum.accumulate(earlier)
        if self.late == "report" and not fresh.all():
            yield self._run(key, times[~fresh], None, True)
        times, readings = times[fresh], readings[fresh]
        if not len(times):
            return
        line = np.concatenate([held, readings])
        first = max(0, self.window - 1 - len(held))
        for start in range(first, len(times), WINDOWS_PER_RUN):
            stop = min(start + WINDOWS_PER_RUN, len(times))
            yield self._run(key, times[start:stop], line[len(held) + start + 1 - self.window : len(held) + stop], False)
        newest = int(times[-1]) if self.late == "arrival" else int(max(times[-1], times[-1] if last is None else last))
        kept = line[len(line) - min(len(line), self.window - 1) :]
        self.state.update((newest, kept.reshape(-1).tolist()))

    def _run(self, key, ends, readings, late) -> pd.DataFrame:
        flat = None if readings is None else readings.reshape(-1)
        return pd.DataFrame({**dict(zip(self.keys, ([part] for part in key))), "ends": [ends], "flat": [flat], "late": [late]})

    def close(self) -> None:
        pass


def require_rocksdb(df: DataFrame) -> None:
    """State with its own variables lives on RocksDB only; a session with another store is told, not changed."""
    conf = df.sparkSession.conf
    if conf.get(STATE_STORE, None) not in (None, HDFS, ROCKSDB):
        raise ValueError(f"set {STATE_STORE} to {ROCKSDB}")
    if df.isStreaming and conf.get(STATE_STORE, None) != ROCKSDB:
        conf.set(STATE_STORE, ROCKSDB)


def stream_windows(
    df: DataFrame,
    keys=("engine_id",),
    width: int = 24,
    window: int = WINDOW,
    time=TIME,
    late: str = "keep",
) -> DataFrame:
    """The window of the last ``window`` readings, for every reading once so many are there.

    ``df`` holds ``keys``, ``time`` and the array ``features``.  Each trigger's readings of an
    engine are put in the order of ``time``.  Readings no newer than what an earlier trigger brought
    follow all the same, so that none is lost (``keep``); ``report`` returns them with ``late`` = true
    and no window, ``drop`` leaves them out, ``arrival`` takes all readings as they come.

    The state of an engine is ``window - 1`` readings; it stays on the RocksDB store, so memory
    does not grow with the fleet.  A trigger must be bounded at the source, since the readings
    one trigger brings for one engine are ordered in one task.  That task returns runs of
    consecutive readings, each only once; the windows are cut out of the runs after these have
    been spread over all tasks, so that a busy engine does not keep its windows in one place.
    """
    if late not in LATE:
        raise ValueError(f"unknown late {late!r}, expected one of {LATE}")
    require_rocksdb(df)
    rows = df.select(*keys, F.col(time).cast("long").alias(time), "features")
    schema = T.StructType(
        [rows.schema[name] for name in keys]
        + [
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("flat", T.ArrayType(T.DoubleType())),
            T.StructField("late", T.BooleanType()),
        ]
    )
    made = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_LastReadings(list(keys), time, window, width, late),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )
    spread = made.repartition(F.xxhash64(*keys, F.col("ends")[0]))

    shaped = windows_of_runs(spread, keys, width, window, ["late"])
    return shaped if late == "report" else shaped.drop("late")


def windows_of_runs(runs: DataFrame, keys, width: int, window: int, keep=()) -> DataFrame:
    """The windows that runs of readings (``ends``, ``flat``) stand for, with ``window_end``."""
    places = F.sequence(F.lit(0), F.size("ends") + (window - 2))
    # Cut once for a run, as its windows share nearly all readings.
    readings = F.when(F.col("flat").isNotNull(), F.transform(places, lambda place: F.slice("flat", place * width + 1, width)))
    cut = runs.select(*keys, "ends", readings.alias("_readings"), *keep)

    def window_at(place):
        return F.struct(F.element_at("ends", place).alias("window_end"), F.slice("_readings", place, window).alias("x"))

    # Generated, so that each window is built once however often later columns use it.
    return cut.select(*keys, F.inline(F.transform(F.sequence(F.lit(1), F.size("ends")), window_at)), *keep)
