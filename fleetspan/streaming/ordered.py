"""Windows of a stream in the order of event time, whatever triggers bring the readings."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetspan.schema import TIME, WINDOW
from fleetspan.streaming.windows import WINDOWS_PER_RUN, require_rocksdb, windows_of_runs

# Names that begin with an underscore don't reach a processor.
MICROS = "event_micros"
ENGINE = "event_engine"
GROUP = "event_group"
# Groups of engines that share a state: every call of the processor and every read of its state costs some
# milliseconds, whatever it holds.  Fixed, as the state of a stream outlives its settings.
GROUPS = 256
# Numbers that one batch of runs holds at least before it is sent on.
RUN_NUMBERS = 1 << 20
# Keys as text, exact in every type.
KEY_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _packed(columns: dict) -> bytes:
    rows = pa.record_batch(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(blocks: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(block).read_all() for block in blocks]).combine_chunks()


class _InEventOrder(StatefulProcessor):
    """Readings of a group of engines wait until the watermark has passed them, then join their series in order.

    ``waiting`` holds what the watermark has not reached, in blocks of many readings, ``held`` the last ``window - 1``
    readings of every engine that it has.  One timer at a time stands for the group: at its next waiting reading, or
    where one of its engines falls silent.
    """

    def __init__(self, time, window, width, forget_ms):
        self.time, self.window, self.width, self.forget_ms = time, window, width, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.held = handle.getValueState("held", "block binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, at_ms: int) -> None:
        """Have the earlier of the timer set and this one."""
        if self.timer.exists():
            before = self.timer.get()[0]
            if before <= at_ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def _block(self, engines, at, places, readings) -> tuple[bytes]:
        flat = pa.FixedSizeListArray.from_arrays(pa.array(readings.reshape(-1)), self.width)
        return (_packed({"engine": engines, "at": pa.array(at), "place": pa.array(places), "reading": flat}),)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        blocks, first = [], None
        for part in rows:
            if len(part):
                at = part[MICROS].to_numpy(dtype=np.int64)
                readings = np.stack(part["features"].to_numpy()).astype(float).reshape(-1, self.width)
                places = part[self.time].astype("int64").to_numpy()
                blocks.append(self._block(pa.array(part[ENGINE], pa.string()), at, places, readings))
                first = int(at.min()) if first is None else min(first, int(at.min()))
        if blocks:
            self.waiting.appendList(blocks)
            self._wake(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        following = []
        blocks = [bytes(item[0]) for item in self.waiting.get()]
        if blocks:
            waiting = _unpacked(blocks)
            at = waiting["at"].to_numpy()
            due = at <= passed
            if due.any():
                yield from self._joined(waiting.filter(pa.array(due)), held)
                if due.all():
                    self.waiting.clear()
                else:
                    rest = waiting.filter(pa.array(~due)).combine_chunks()
                    self.waiting.put([(_packed({name: rest[name].chunk(0) for name in rest.column_names}),)])
            if not due.all():
                following.append(-(-int(at[~due].min()) // 1000))
        if self.forget_ms is not None:
            silent = {engine: -(-last // 1000) + self.forget_ms for engine, (last, _) in held.items()}
            held = {engine: series for engine, series in held.items() if silent[engine] * 1000 > passed}
            following += [silent[engine] for engine in held]
        self._hold(held)
        if following:
            self._wake(min(following))

    def _held(self) -> dict[str, tuple[int, np.ndarray]]:
        """The time of the last reading and the readings held, by engine."""
        if not self.held.exists():
            return {}
        rows = _unpacked([bytes(self.held.get()[0])])
        ends = np.cumsum(rows["n"].to_numpy()) * self.width
        flat = rows["flat"].chunk(0).flatten().to_numpy()
        parts = zip(rows["engine"].to_pylist(), rows["last"].to_pylist(), np.split(flat, ends[:-1]))
        return {engine: (last, part.reshape(-1, self.width)) for engine, last, part in parts}

    def _hold(self, held: dict[str, tuple[int, np.ndarray]]) -> None:
        if not held:
            self.held.clear()
            return
        lengths = np.array([len(readings) for _, readings in held.values()], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths))) * self.width
        flat = np.concatenate([readings.reshape(-1) for _, readings in held.values()])
        lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(flat))
        last = pa.array([last for last, _ in held.values()], pa.int64())
        self.held.update((_packed({"engine": pa.array(list(held), pa.string()), "last": last, "n": pa.array(lengths), "flat": lists}),))

    def _joined(self, due: pa.Table, held: dict) -> Iterator[pd.DataFrame]:
        """Put readings in order behind those held, which change with them, and cut the runs."""
        names = due["engine"].combine_chunks().dictionary_encode()
        code, names = names.indices.to_numpy(), names.dictionary.to_pylist()
        at, places = due["at"].to_numpy(), due["place"].to_numpy()
        readings = due["reading"].combine_chunks().flatten().to_numpy().reshape(-1, self.width)
        order = np.lexsort((*readings.T[::-1], places, at, code))
        code, at, places, readings = code[order], at[order], places[order], readings[order]
        bounds = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        engines, ends, flats, numbers = [], [], [], 0
        for begin, end in zip(bounds, bounds[1:]):
            engine = names[code[begin]]
            last, line = held.get(engine, (None, readings[:0]))
            cuts = [begin]
            if self.forget_ms is not None:
                gaps = np.diff(at[begin:end], prepend=at[begin] if last is None else last)
                fresh = begin + np.flatnonzero(gaps > self.forget_ms * 1000)
                if len(fresh) and fresh[0] == begin:
                    line, fresh = line[:0], fresh[1:]
                cuts += fresh.tolist()
            for start, stop in zip(cuts, [*cuts[1:], end]):
                if start > begin:
                    line = line[:0]
                before = len(line)
                line = np.concatenate([line, readings[start:stop]])
                for run in range(max(0, self.window - 1 - before), stop - start, WINDOWS_PER_RUN):
                    following = min(run + WINDOWS_PER_RUN, stop - start)
                    engines.append(engine)
                    ends.append(places[start + run : start + following])
                    flats.append(line[before + run + 1 - self.window : before + following].reshape(-1))
                    numbers += flats[-1].size
                    if numbers >= RUN_NUMBERS:
                        yield pd.DataFrame({ENGINE: engines, "ends": ends, "flat": flats})
                        engines, ends, flats, numbers = [], [], [], 0
                line = line[max(0, len(line) - self.window + 1) :]
            held[engine] = (int(at[end - 1]), line)
        if engines:
            yield pd.DataFrame({ENGINE: engines, "ends": ends, "flat": flats})

    def close(self) -> None:
        pass


def ordered_stream_windows(
    df: DataFrame,
    keys=("engine_id",),
    width: int = 24,
    window: int = WINDOW,
    time=TIME,
    event_time: str = "timestamp",
    delay: str = "10 minutes",
    forget_after: str | None = None,
) -> DataFrame:
    """The window of the last ``window`` readings for every reading, each sent once, in the order of event time.

    ``df`` holds ``keys``, ``time``, ``event_time`` and the array ``features``.  Readings wait in the state until the
    watermark, which follows the newest event time by ``delay``, has passed them.  They then follow each other by
    event time, ``time`` and values, so that the windows are the same however triggers deal the readings.  What comes
    later than ``delay`` is dropped and counted by Spark; readings without event time are left out.  The last readings
    of a stream stay until something moves the watermark past them.

    ``forget_after`` starts an engine anew when it was silent for longer by event time, and takes its state away once
    the watermark says so.  An engine's state is its last ``window - 1`` readings and those within ``delay``; engines
    share the state of one of ``GROUPS`` groups, so that a trigger costs as many calls, however many engines there are.
    A checkpoint of a stream with a state by engine can't be taken up.
    """
    require_rocksdb(df)
    forget_ms = None
    if forget_after is not None:
        seconds = df.sparkSession.sql(f"SELECT timestampdiff(MILLISECOND, TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + INTERVAL {forget_after})")
        forget_ms = int(seconds.first()[0])
    known = df.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    engine = F.to_json(F.struct(*keys), KEY_FORMATS)
    rows = known.select(
        engine.alias(ENGINE), event_time, F.unix_micros(event_time).alias(MICROS), F.col(time).cast("long").alias(time), "features"
    ).withColumn(GROUP, F.pmod(F.xxhash64(ENGINE), F.lit(GROUPS)))
    made = rows.groupBy(GROUP).transformWithStateInPandas(
        statefulProcessor=_InEventOrder(time, window, width, forget_ms),
        outputStructType=f"{ENGINE} string, ends array<bigint>, flat array<double>",
        outputMode="Append",
        timeMode="EventTime",
    )
    spread = made.repartition(F.xxhash64(ENGINE, F.col("ends")[0]))
    kinds = T.StructType([known.schema[name] for name in keys])
    named = spread.withColumn(ENGINE, F.from_json(ENGINE, kinds, KEY_FORMATS)).select(f"{ENGINE}.*", "ends", "flat")
    return windows_of_runs(named, keys, width, window)
