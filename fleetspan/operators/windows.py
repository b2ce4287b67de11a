"""Sliding windows of consecutive readings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspan.operators.layout import StoredSeries, pieces_of
from fleetspan.operators.series import ROWS_PER_TASK, last_rows, moment, number_rows
from fleetspan.operators.summaries import summarised
from fleetspan.schema import HORIZON, KEYS, TARGET, TIME, WINDOW, remaining_columns

# The row limit up to which Spark cuts ranked rows before the shuffle.
RANK_LIMIT = 1000


def _vector(features) -> Column:
    return F.array(*[F.col(name).cast("double") for name in features])


def sliding_windows(
    df: DataFrame | StoredSeries,
    window: int = WINDOW,
    horizon: int = HORIZON,
    features=None,
    keys=KEYS,
    time=TIME,
    target=TARGET,
    ties=(),
    rows_per_task: int = ROWS_PER_TASK,
    keep=(),
) -> DataFrame:
    """Every run of ``window`` readings with the target ``horizon`` readings later.

    Returns ``keys``, ``window_end`` (time of the last reading), ``x`` (readings by features)
    and ``y``.  Readings follow each other in the order of ``time``; gaps do not matter.
    Engines with fewer than ``window + horizon`` readings give no window.  ``target=None`` leaves
    ``y`` out.  Where an engine can have several readings at one time, ``ties`` names the columns
    that put them in order; what is equal in these, too, goes by content.  ``keep`` names columns of the
    window's last reading to add.  From :class:`StoredSeries` no reading is shuffled.
    """
    features = list(features or remaining_columns(df, keys, time, target))
    targets = [target] if target else []
    wanted = [*keys, *keep, time, *ties, *targets, _vector(features).alias("_row")]
    pieces = pieces_of(df, wanted, keys, [time, *ties], window - 1, horizon, rows_per_task)

    def columns(series):
        made = {"x": F.collect_list("_row").over(series.rowsBetween(1 - window, 0))}
        return {**made, "y": F.lead(target, horizon).over(series)} if target else made

    full = (F.col("_rn") >= window) & (F.col("_rn") <= F.col("_n") - horizon)
    cut = pieces.over(columns, full)
    answer = [F.col("y").cast("double").alias("y")] if target else []
    return cut.select(*keys, *keep, F.col(time).alias("window_end"), "x", *answer)


def window_summaries(
    df: DataFrame | StoredSeries,
    window: int = WINDOW,
    horizon: int = HORIZON,
    features=None,
    keys=KEYS,
    time=TIME,
    target=TARGET,
    ties=(),
    rows_per_task: int = ROWS_PER_TASK,
    keep=(),
) -> DataFrame:
    """Mean, deviation, slope and last value of every feature over each sliding window.

    The windows of :func:`sliding_windows`; missing values are left out of the measures.  Every reading goes to
    Python once, sorted, and running moments give the measures: as aggregates over sliding frames Spark would work
    through every frame again for each of them.  ``keep`` names columns of the window's last reading to add.
    """
    features = list(features or remaining_columns(df, keys, time, target))
    at = moment(df, time)
    wanted = [
        *keys,
        *keep,
        time,
        *ties,
        at.alias("_time"),
        *[F.col(name) for name in features],
        *([F.col(target).alias("_y")] if target else []),
    ]
    pieces = pieces_of(df, wanted, keys, [time, *ties], window - 1, horizon, rows_per_task)
    kinds = pieces.ordinary.schema
    number = T.DoubleType()
    schema = T.StructType(
        [kinds[name] for name in (*keys, *keep)]
        + [T.StructField("window_end", kinds[time].dataType)]
        + [T.StructField(f"{name}_{part}", number) for part in ("mean", "std", "slope") for name in features]
        + [T.StructField(f"{name}_last", number) for name in features]
        + ([T.StructField("y", number)] if target else [])
    )
    measure = summarised([*keys, *keep], window, horizon, features, bool(target), schema)
    made = None
    for part in pieces.sorted():
        rows = part.select(*keys, *keep, "_series", "_own", F.col(time).alias("_end"), "_time", *features, *(["_y"] if target else []))
        measured = rows.mapInArrow(measure, schema)
        made = measured if made is None else made.unionByName(measured)
    return made


def latest_windows(
    df: DataFrame | StoredSeries,
    window: int = WINDOW,
    features=None,
    keys=KEYS,
    time=TIME,
    ties=(),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The last ``window`` readings of every engine that has so many: ``keys, window_end, x``."""
    features = list(features or remaining_columns(df, keys, time))
    order = [time, *ties]
    wanted = [*keys, *order, _vector(features).alias("_row")]
    if isinstance(df, StoredSeries):
        newest = df.tail(window).select(*wanted, "_rn", "_n")
        tail = newest.withColumn("_back", F.col("_n") - F.col("_rn") + 1)
        return _gathered(tail, keys, time, window)
    rows = df.select(*wanted)
    if window <= RANK_LIMIT:
        tail = last_rows(rows, keys, order, window)
    else:
        numbered = number_rows(rows, keys, order, "_rn", "_n", rows_per_task)
        tail = numbered.withColumn("_back", F.col("_n") - F.col("_rn") + 1).where(F.col("_back") <= window)
    return _gathered(tail, keys, time, window)


def _gathered(tail: DataFrame, keys, time, window: int) -> DataFrame:
    gathered = tail.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("at"), F.col(time).alias("end"), F.col("_row").alias("row")))).alias("_rows")
    )
    return gathered.where(F.size("_rows") == window).select(
        *keys,
        F.element_at("_rows", -1)["end"].alias("window_end"),
        F.transform("_rows", lambda item: item["row"]).alias("x"),
    )


def window_sample(df: DataFrame, steps: int = 5, features: int = 5) -> DataFrame:
    """The first steps and features of each window, to look at."""
    return df.withColumn(
        "x", F.slice(F.transform("x", lambda row: F.slice(row, 1, features)), 1, steps)
    )
