"""Sensor messages: reading the stream, decoding, encoding."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.schema import FEATURES, MESSAGE_SCHEMA

# The topic and the consumer group.
TOPIC = "sensor-data"
GROUP = "rul-predictor-group"
# Bounds what one trigger, and so one task, takes in at a time.
MESSAGES_PER_TRIGGER = 1_000_000

MALFORMED = "malformed message"
MISSING = "missing sensor values"


def read_sensor_stream(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    group: str = GROUP,
    starting: str = "latest",
    per_trigger: int = MESSAGES_PER_TRIGGER,
) -> DataFrame:
    """The message stream of a topic.  Needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("kafka.group.id", group)
        .option("startingOffsets", starting)
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
    )


def decode_messages(df: DataFrame, features=FEATURES, value="value") -> DataFrame:
    """Decode message bodies: ``engine_id, cycle, timestamp, features, error``.

    ``features`` holds the sensor values in fixed order.  Messages that are no valid JSON, lack
    engine or cycle, or lack a sensor have an ``error`` and null ``features``.
    """
    body = F.from_json(F.col(value).cast("string"), MESSAGE_SCHEMA, {"mode": "PERMISSIVE"})
    # Generated columns are parsed once per message; a plain column would be parsed again for
    # every filter that Spark pushes below it.
    parsed = df.select(F.col(value).cast("string").alias("message"), F.inline(F.array(body)))
    names = F.array(*map(F.lit, features))
    found = F.transform(names, lambda name: F.try_element_at(F.col("sensors"), name))
    gaps = F.coalesce(F.exists("_found", lambda number: number.isNull()), F.lit(True))
    lacks = F.col("engine_id").isNull() | F.col("cycle").isNull()
    return (
        parsed.withColumn("_found", found)
        .withColumn("error", F.when(lacks, F.lit(MALFORMED)).when(gaps, F.lit(MISSING)))
        .select(
            "message",
            "engine_id",
            "cycle",
            F.try_to_timestamp("timestamp").alias("timestamp"),
            F.when(F.col("error").isNull(), F.col("_found")).alias("features"),
            "error",
        )
    )


def valid_messages(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull()).drop("error", "message")


def rejected_messages(df: DataFrame) -> DataFrame:
    """The dead-letter side: bodies that could not be used, and why."""
    return df.where(F.col("error").isNotNull()).drop("features")


def to_sensor_messages(df: DataFrame, features=FEATURES, engine="engine_id", cycle="cycle", timestamp="timestamp") -> DataFrame:
    """Encode readings as ``key`` (``engine_<id>``) and JSON ``value``."""
    sensors = F.map_from_arrays(
        F.array(*map(F.lit, features)), F.array(*[F.col(name).cast("double") for name in features])
    )
    body = F.struct(
        F.col(engine).cast("int").alias("engine_id"),
        F.col(cycle).cast("int").alias("cycle"),
        F.date_format(F.col(timestamp).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        sensors.alias("sensors"),
    )
    return df.select(
        F.concat(F.lit("engine_"), F.col(engine).cast("string")).alias("key"), F.to_json(body).alias("value")
    )
