"""Column names, schemas and defaults shared by every operator."""

from pyspark.sql import types as T

# File layout and message layout of the sensor data.
SETTINGS = ["op_setting_1", "op_setting_2", "op_setting_3"]
SENSORS = [f"sensor_{i}" for i in range(1, 22)]
FEATURES = SETTINGS + SENSORS
READING_COLUMNS = ["unit", "cycle"] + FEATURES
DATASETS = ["FD001", "FD002", "FD003", "FD004"]

# Default parameters of the analysis.
WINDOW = 30
HORIZON = 1
VALIDATION_SHARE = 0.2
SEED = 42
ALERT_THRESHOLD = 25.0
CRITICAL_RUL = 10.0

KEYS = ["dataset_id", "unit"]
TIME = "cycle"
TARGET = "RUL"

READING_SCHEMA = T.StructType(
    [T.StructField("unit", T.IntegerType()), T.StructField("cycle", T.IntegerType())]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
)

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("engine_id", T.IntegerType()),
        T.StructField("cycle", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("sensors", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("data", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
    ]
)


def feature_columns(df, parts=("sensor", "op_setting")):
    """Columns whose name contains one of ``parts``, in table order."""
    return [name for name in df.columns if any(part in name for part in parts)]


def remaining_columns(df, keys=KEYS, time=TIME, target=TARGET):
    """Columns that are left once keys, time, target and the dataset tag are taken out."""
    reserved = {*keys, time, target, "dataset_id"}
    return [name for name in df.columns if name not in reserved]
