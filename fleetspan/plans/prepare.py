"""From raw readings to labelled, scaled and split windows, and from messages to alerts."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.operators.labels import remaining_useful_life
from fleetspan.operators.layout import StoredSeries, store_series
from fleetspan.operators.profiling import missing_values
from fleetspan.operators.scaling import apply_minmax, fit_minmax
from fleetspan.operators.scoring import DEADLINE, Predict, scale_windows, score_windows
from fleetspan.operators.splitting import engine_side, split_by_engine
from fleetspan.operators.windows import sliding_windows
from fleetspan.schema import FEATURES, HORIZON, KEYS, SEED, VALIDATION_SHARE, WINDOW, feature_columns
from fleetspan.shared import settle
from fleetspan.streaming.alerts import rul_alerts
from fleetspan.streaming.messages import decode_messages, valid_messages
from fleetspan.streaming.ordered import ordered_stream_windows
from fleetspan.streaming.windows import stream_windows


@dataclass(frozen=True)
class PreparedFleet:
    """Labelled and scaled readings with their ``split``, and the scaler that was fitted."""

    readings: DataFrame
    scaler: DataFrame

    def split(self, name: str) -> DataFrame:
        return self.readings.where(F.col("split") == name)

    def missing(self) -> DataFrame:
        return missing_values(self.readings)


def prepare_fleet(
    train: DataFrame,
    test: DataFrame,
    rul_at_end: DataFrame,
    share: float = VALIDATION_SHARE,
    seed: int = SEED,
    keys=KEYS,
    features=None,
    order: Callable[..., Column] | None = None,
) -> PreparedFleet:
    """Label, scale and split a fleet.

    The scaler is fitted on all training readings, before the validation engines are taken out.
    """
    features = list(features or feature_columns(train))
    scaler = fit_minmax(train, features)
    labelled = remaining_useful_life(train, keys=keys)
    tested = remaining_useful_life(test, rul_at_end, keys=keys)
    split = split_by_engine(labelled, share, seed, keys, order)
    whole = split.unionByName(tested.withColumn("split", F.lit("test")))
    return PreparedFleet(apply_minmax(whole, scaler), scaler)


@dataclass(frozen=True)
class PreparedLayout:
    """The same from one layout by engine; ``kind`` tells training from test engines."""

    series: StoredSeries
    scaler: DataFrame

    @property
    def readings(self) -> DataFrame:
        return self.series.readings().drop("kind")

    def split(self, name: str) -> DataFrame:
        return self.readings.where(F.col("split") == name)

    def missing(self) -> DataFrame:
        return missing_values(self.readings)


def prepare_layout(
    train: DataFrame,
    test: DataFrame,
    rul_at_end: DataFrame,
    path: str | None = None,
    share: float = VALIDATION_SHARE,
    seed: int = SEED,
    keys=KEYS,
    features=None,
    order: Callable[..., Column] | None = None,
    window: int = WINDOW,
    horizon: int = HORIZON,
    **layout,
) -> PreparedLayout:
    """:func:`prepare_fleet` with one shuffle of the readings, that of the layout.

    Both fleets are written by engine together.  Labels, scaler, split, windows and features then come from the
    buckets as they lie; ``layout`` takes what :func:`store_series` takes.
    """
    features = list(features or feature_columns(train))
    both = train.withColumn("kind", F.lit("train")).unionByName(test.withColumn("kind", F.lit("test")))
    left = rul_at_end.withColumn("kind", F.lit("test"))
    stored = store_series(both, path, ["kind", *keys], rul_at_end=left, before=window - 1, after=horizon, **layout)
    training = F.col("kind") == "train"
    scaler = settle(fit_minmax(stored.readings().where(training), features)).df
    side = engine_side(stored.engines().where(training).select(*keys), share, seed, keys, order)
    split = F.when(training, side).otherwise(F.lit("test"))
    labelled = stored.labelled(truncated=~training)
    return PreparedLayout(labelled.map(lambda rows: apply_minmax(rows.withColumn("split", split), scaler)), scaler)


def prepare_windows(
    fleet: PreparedFleet | PreparedLayout, window: int = WINDOW, horizon: int = HORIZON, features=None, keys=KEYS
) -> DataFrame:
    """The sliding windows of all splits with their ``split``."""
    if isinstance(fleet, PreparedLayout):
        features = list(features or feature_columns(fleet.series))
        made = sliding_windows(fleet.series, window, horizon, features, ["kind", *keys], keep=["split"])
        return made.select("split", *keys, "window_end", "x", "y")
    features = list(features or feature_columns(fleet.readings))
    return sliding_windows(fleet.readings, window, horizon, features, ["split", *keys])


def alert_stream(
    messages: DataFrame,
    load: Callable[[], Predict],
    features=FEATURES,
    window: int = WINDOW,
    scaler: DataFrame | None = None,
    late: str = "keep",
    delay: str | None = None,
    forget_after: str | None = None,
    deadline: float | None = DEADLINE,
    **alerting,
) -> DataFrame:
    """Messages to alerts in one query: decode, keep windows, scale, score, compare.

    With ``delay`` readings are put in order by event time, see :func:`ordered_stream_windows`.
    """
    readings = valid_messages(decode_messages(messages, features))
    if delay is not None:
        windows = ordered_stream_windows(readings, ["engine_id"], len(features), window, delay=delay, forget_after=forget_after)
    else:
        windows = stream_windows(readings, ["engine_id"], len(features), window, late=late)
        if late == "report":
            windows = windows.where(~F.col("late"))
    if scaler is not None:
        windows = scale_windows(windows, scaler, features)
    scored = score_windows(windows, load, len(features), window, deadline=deadline)
    return rul_alerts(scored, cycle="window_end", **alerting)
