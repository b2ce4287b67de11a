"""Maintenance alerts from predicted remaining life; for batches and streams alike."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetspan.schema import ALERT_THRESHOLD, CRITICAL_RUL
from fleetspan.sources import versions


def rul_alerts(
    df: DataFrame,
    threshold: float = ALERT_THRESHOLD,
    critical: float = CRITICAL_RUL,
    engine="engine_id",
    cycle="cycle",
    rul="rul",
) -> DataFrame:
    """``timestamp, engine_id, cycle, rul, severity, message`` for each RUL at or below the threshold."""
    left = F.col(rul)
    message = F.concat(
        F.lit("Engine "), F.col(engine).cast("string"), F.lit(" has "), F.format_string("%.1f", left), F.lit(" cycles remaining!")
    )
    return df.where(left <= threshold).select(
        F.current_timestamp().alias("timestamp"),
        F.col(engine).alias("engine_id"),
        F.col(cycle).alias("cycle"),
        left.alias("rul"),
        F.when(left <= critical, "CRITICAL").otherwise("WARNING").alias("severity"),
        message.alias("message"),
    )


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Alerts in total and by severity.  On a stream: run in ``update`` or ``complete`` mode."""
    return alerts.groupBy().agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_alerts"),
    )


def engines_monitored(messages: DataFrame, engine="engine_id", approximate: bool = False) -> DataFrame:
    """Engines heard of, whether or not their messages were usable."""
    known = messages.where(F.col(engine).isNotNull())
    if approximate:
        return known.groupBy().agg(F.approx_count_distinct(engine).alias("engines_monitored"))
    return known.select(engine).distinct().groupBy().agg(F.count(F.lit(1)).alias("engines_monitored"))


def recent_alerts(alerts: DataFrame, k: int = 10, order=("cycle", "engine_id")) -> DataFrame:
    """The newest ``k`` alerts, newest first."""
    return alerts.orderBy(*[F.col(name).desc() for name in order]).limit(k)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, format: str = "parquet", **trigger) -> StreamingQuery:
    """Append a stream of alerts to a table; restarts go on from ``checkpoint``."""
    writer = (
        alerts.writeStream.format(format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def write_statistics(statistics: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep running statistics up to date in a table: every trigger replaces the row by the totals so far.

    A trigger that is repeated after a failure writes the same totals again.  Readers of :func:`read_statistics`
    always meet a whole version; the two newest stay.
    """

    def replace(totals: DataFrame, _: int) -> None:
        versions.replace(totals.sparkSession, path, lambda folder: totals.coalesce(1).write.parquet(folder))
        versions.forget(totals.sparkSession, path)

    writer = statistics.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The totals that :func:`write_statistics` wrote last."""
    return spark.read.parquet(versions.current(spark, path))
