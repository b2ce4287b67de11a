"""Mean, deviation and slope of sliding windows from running moments, in time linear in the readings.

Readings come sorted by series and place.  A series is cut into blocks as long as a window; every window is the end
of one block and the beginning of the next.  Counts, sums and products run forward through each block and backward
through it, and a window's moments are those of its two parts put together.  No sum is ever taken back out of
another, so nothing cancels, and a reading is looked at twice however long the window is.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Readings taken at a time: bounds the memory of a Python worker.
ROWS_AT_ONCE = 8192


@dataclass
class _Part:
    """Running moments of one direction: ``n, mean, m2`` of values, and those of values with a time."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    both: np.ndarray
    time_mean: np.ndarray
    value_mean: np.ndarray
    time_m2: np.ndarray
    cross: np.ndarray


def _running(time: np.ndarray, values: np.ndarray) -> _Part:
    """Moments of the first 1, 2, ... places of every block; ``time`` [blocks, W, 1], ``values`` [blocks, W, F]."""
    present = ~np.isnan(values)
    known = present & ~np.isnan(time)

    def first(of: np.ndarray, there: np.ndarray) -> np.ndarray:
        at = there.argmax(axis=1)[:, None, :]
        return np.where(there.any(axis=1)[:, None, :], np.take_along_axis(of, at, axis=1), 0.0)

    with np.errstate(invalid="ignore", divide="ignore"):
        # Counted from the block's first value, sums stay small and a block of equal values has no deviation.
        origin = first(values, present)
        apart = np.where(present, values - origin, 0.0)
        n, total = present.cumsum(axis=1), apart.cumsum(axis=1)
        m2 = np.maximum((apart * apart).cumsum(axis=1) - total * total / np.maximum(n, 1), 0.0)
        mean = origin + total / np.maximum(n, 1)
        times = np.broadcast_to(time, values.shape)
        begin = first(times, known)
        late = np.where(known, times - begin, 0.0)
        base = first(values, known)
        high = np.where(known, values - base, 0.0)
        both = known.cumsum(axis=1)
        least = np.maximum(both, 1)
        time_sum, value_sum = late.cumsum(axis=1), high.cumsum(axis=1)
        time_m2 = np.maximum((late * late).cumsum(axis=1) - time_sum * time_sum / least, 0.0)
        cross = (late * high).cumsum(axis=1) - time_sum * value_sum / least
    return _Part(n, mean, m2, both, begin + time_sum / least, base + value_sum / least, time_m2, cross)


def _joined(a: _Part, b: _Part) -> np.ndarray:
    """Mean, deviation and slope of the rows of both parts, side by side."""
    with np.errstate(invalid="ignore", divide="ignore"):
        n = a.n + b.n
        weight = a.n * b.n / np.maximum(n, 1)
        gap = np.where((a.n > 0) & (b.n > 0), b.mean - a.mean, 0.0)
        mean = np.where(a.n > 0, a.mean, b.mean) + gap * b.n / np.maximum(n, 1)
        m2 = a.m2 + b.m2 + gap * gap * weight
        both = a.both + b.both
        share = a.both * b.both / np.maximum(both, 1)
        meet = (a.both > 0) & (b.both > 0)
        time_gap = np.where(meet, b.time_mean - a.time_mean, 0.0)
        value_gap = np.where(meet, b.value_mean - a.value_mean, 0.0)
        time_m2 = a.time_m2 + b.time_m2 + time_gap * time_gap * share
        cross = a.cross + b.cross + time_gap * value_gap * share
        slope = np.where(both > 0, cross / time_m2, np.nan)
        empty = n == 0
        mean, deviation = np.where(empty, np.nan, mean), np.where(empty, np.nan, np.sqrt(m2 / np.maximum(n, 1)))
    return np.concatenate([mean, deviation, slope], axis=-1)


def _picked(part: _Part, block: np.ndarray, place: np.ndarray, there: np.ndarray | None = None) -> _Part:
    fields = []
    for name in part.__dataclass_fields__:
        chosen = getattr(part, name)[block, place]
        fields.append(chosen if there is None else np.where(there[:, None], chosen, 0))
    return _Part(*fields)


def series_moments(time: np.ndarray, values: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Last rows of all windows, and ``mean, deviation, slope`` of every feature over each of them.

    ``starts`` are the rows at which a series begins.
    """
    endless = np.isinf(values)
    if endless.any():
        rows, found = series_moments(time, np.where(endless, np.nan, values), starts, window)
        return rows, _with_endless(found, values, rows, window)
    ends = np.append(starts[1:], len(time))
    long = ends - starts >= window
    starts, ends = starts[long], ends[long]
    width = values.shape[1]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, 3 * width))
    sizes = ends - starts
    blocks = -(-sizes // window)
    first_block = np.cumsum(blocks) - blocks
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(starts, sizes) + inside
    place = np.repeat(first_block * window, sizes) + inside
    filled = np.full((blocks.sum() * window, width + 1), np.nan)
    filled[place, :1], filled[place, 1:] = time[rows][:, None], values[rows]
    filled = filled.reshape(-1, window, width + 1)
    forward = _running(filled[:, :, :1], filled[:, :, 1:])
    backward = _running(filled[:, ::-1, :1], filled[:, ::-1, 1:])
    whole = inside >= window - 1
    block, at = np.divmod(place[whole], window)
    # The window's first part: the rows of the block before that lie behind this place.
    split = at < window - 1
    before = _picked(backward, np.maximum(block - 1, 0), np.maximum(window - 2 - at, 0), split)
    return rows[whole], _joined(before, _picked(forward, block, at))


def _with_endless(found: np.ndarray, values: np.ndarray, rows: np.ndarray, window: int) -> np.ndarray:
    """Infinite values make the mean of their windows infinite (undefined, if of both signs) and leave no other measure."""
    width = values.shape[1]

    def held(there: np.ndarray) -> np.ndarray:
        counts = np.vstack([np.zeros((1, width), np.int64), there.cumsum(axis=0)])
        return counts[rows + 1] - counts[rows + 1 - window] > 0

    up, down = held(np.isposinf(values)), held(np.isneginf(values))
    mean = np.where(up & down, np.nan, np.where(up, np.inf, np.where(down, -np.inf, found[:, :width])))
    rest = np.where(np.tile(up | down, 2), np.nan, found[:, width:])
    return np.concatenate([mean, rest], axis=1)


def summarised(keys: list[str], window: int, horizon: int, features: list[str], has_target: bool, schema: T.StructType):
    """A function of Arrow batches of sorted readings to batches of window summaries.

    Readings hold ``keys``, ``_series`` (changes with the series), ``_end``, ``_time``, ``_own`` (whether windows
    that end here are wanted), ``_y`` and the features.  The last rows of a series are carried into the next batch.
    """
    kind = to_arrow_schema(schema)
    carried_rows = window - 1 + horizon

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).cast(pa.float64()).to_numpy().astype(float)

    def measured(table: pa.Table, fresh: int) -> Iterator[pa.RecordBatch]:
        """Summaries of the windows whose answer lies among the last ``fresh`` rows."""
        series = table.column("_series").to_numpy()
        starts = np.flatnonzero(np.append(True, series[1:] != series[:-1]))
        values = np.stack([column(table, name) for name in features], axis=1)
        rows, found = series_moments(column(table, "_time"), values, starts, window)
        answer = rows + horizon
        stop = np.append(starts[1:], len(series))[np.searchsorted(starts, rows, side="right") - 1]
        # A carried window has gone out once its answer was there.
        wanted = (answer < stop) & (answer >= len(series) - fresh)
        wanted[wanted] = table.column("_own").to_numpy(zero_copy_only=False)[rows[wanted]]
        rows, found = rows[wanted], found[wanted]
        at = pa.array(rows)
        made = [table.column(name).take(at) for name in [*keys, "_end"]]
        made += [pa.array(found[:, i], mask=np.isnan(found[:, i])) for i in range(found.shape[1])]
        made += [table.column(name).take(at).cast(pa.float64()) for name in features]
        if has_target:
            made.append(table.column("_y").take(pa.array(rows + horizon)).cast(pa.float64()))
        yield from pa.Table.from_arrays(made, schema=kind).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                fresh = pa.Table.from_batches([batch.slice(start, ROWS_AT_ONCE)])
                table = fresh if carried is None else pa.concat_tables([carried, fresh]).combine_chunks()
                yield from measured(table, len(fresh))
                series = table.column("_series").to_numpy()
                same = len(series) - int(np.argmax(series[::-1] != series[-1])) if (series != series[-1]).any() else 0
                carried = table.slice(max(same, len(series) - carried_rows)) if carried_rows else None

    return run
