"""Running statistics of a fleet, kept in the state of the stream itself."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetspan.streaming.windows import require_rocksdb

# Fixed value: alerts shown as the newest.
NEWEST = 10

COUNTS = ["total_alerts", "critical_alerts", "warning_alerts", "engines_monitored"]
ALERT = "cycle bigint, engine_id bigint, rul double, severity string"
PARTIAL = ", ".join(f"{name} bigint" for name in COUNTS) + f", recent array<struct<{ALERT.replace(' ', ':').replace(',:', ',')}>>"


def _newest(alerts: list[tuple], k: int) -> list[tuple]:
    return sorted(alerts, key=lambda alert: alert[:2], reverse=True)[:k]


def _summed(k: int):
    """What one task has seen in one trigger, in one row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, newest = [0, 0, 0, 0], []
        for part in parts:
            found = part[~part["heard"]]
            severity = found["severity"].value_counts()
            for i, more in enumerate((len(found), severity.get("CRITICAL", 0), severity.get("WARNING", 0), int(part["heard"].sum()))):
                counts[i] += int(more)
            top = found.sort_values(["cycle", "engine_id"], ascending=False).head(k)
            rows = zip(top["cycle"], top["engine_id"], top["rul"], top["severity"])
            newest = _newest(newest + [(int(cycle), int(engine), float(rul), level) for cycle, engine, rul, level in rows], k)
        if any(counts):
            named = [dict(zip(("cycle", "engine_id", "rul", "severity"), alert)) for alert in newest]
            yield pd.DataFrame({**{name: [count] for name, count in zip(COUNTS, counts)}, "recent": [named]})

    return run


class _Totals(StatefulProcessor):
    """Counters, and the newest alerts as a list of bounded length."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "updates bigint, " + ", ".join(f"{name} bigint" for name in COUNTS))
        self.newest = handle.getListState("newest", ALERT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        updates, *counts = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0)
        newest = [tuple(alert) for alert in self.newest.get()] if self.newest.exists() else []
        for part in rows:
            counts = [count + int(part[name].sum()) for count, name in zip(counts, COUNTS)]
            for recent in part["recent"]:
                newest += [(a["cycle"], a["engine_id"], a["rul"], a["severity"]) for a in recent]
            newest = _newest(newest, self.k)
        self.counts.update((updates + 1, *counts))
        if newest:
            self.newest.put(newest)
        named = [dict(zip(("cycle", "engine_id", "rul", "severity"), alert)) for alert in newest]
        yield pd.DataFrame({"updates": [updates + 1], **{name: [count] for name, count in zip(COUNTS, counts)}, "recent": [named]})

    def close(self) -> None:
        pass


def fleet_statistics(alerts: DataFrame, messages: DataFrame, engine: str = "engine_id", newest: int = NEWEST) -> DataFrame:
    """Alerts by severity, engines heard of and the newest alerts: one row after every trigger that changes them.

    ``alerts`` are those of :func:`rul_alerts`, ``messages`` all decoded messages of the same stream, rejected ones
    too, as far as they name an engine.  Every engine is counted when it is first heard of; that is a state of its own,
    spread over the fleet.  Each task sums up what it sees of a trigger, so that the one task that holds the totals
    gets a row from each.  ``updates`` counts the rows sent; the row with the highest is the newest.
    """
    require_rocksdb(alerts)
    first = messages.where(F.col(engine).isNotNull()).select(F.col(engine).cast("long").alias("engine_id")).dropDuplicates()
    heard = first.select(
        "engine_id", F.lit(None).cast("long").alias("cycle"), F.lit(None).cast("double").alias("rul"), F.lit(None).cast("string").alias("severity"), F.lit(True).alias("heard"))
    raised = alerts.select(
        F.col("engine_id").cast("long"), F.col("cycle").cast("long"), F.col("rul").cast("double"), "severity", F.lit(False).alias("heard"))
    partial = raised.unionByName(heard).mapInPandas(_summed(newest), PARTIAL)
    totals = partial.withColumn("fleet", F.lit("fleet")).groupBy("fleet").transformWithStateInPandas(
        statefulProcessor=_Totals(newest), outputStructType=f"updates bigint, {PARTIAL}", outputMode="Append", timeMode="None")
    return totals
