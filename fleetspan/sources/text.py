"""Reading raw sensor text and remaining-life lists."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.schema import DATASETS, FEATURES, READING_COLUMNS
from fleetspan.shared import settle

BLANK_ENDS = r"^\s+|\s+$"


def _read_lines(spark: SparkSession, paths) -> DataFrame:
    try:
        lines = spark.read.text(list(paths))
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"data file not found: {problem.getMessageParameters().get('path')}") from problem
        raise
    return lines


def _require_rows(spark: SparkSession, paths) -> None:
    for path in paths:
        if _read_lines(spark, [path]).where(F.trim("value") != "").isEmpty():
            raise ValueError(f"data file is empty: {path}")


def parse_sensor_lines(df: DataFrame, value="value", columns=READING_COLUMNS, keep=()) -> DataFrame:
    """Split whitespace-separated lines into typed columns.

    The first two columns are integers, the rest doubles.  Blank lines are left out.  Lines of
    another width, with a field that is no number or an id that is no whole number get null readings and keep their text in
    ``_corrupt``.
    """
    line = F.regexp_replace(value, BLANK_ENDS, "")
    rows = df.where(line != "").withColumn("_fields", F.split(line, r"\s+"))
    fits = F.size("_fields") == len(columns)
    numbers = F.transform("_fields", lambda field: field.try_cast("double"))
    ids = [F.get("_numbers", F.lit(i)) for i in range(2)]
    whole = [F.coalesce(number.try_cast("int") == number, F.lit(False)) for number in ids]
    sound = fits & ~F.exists(F.col("_numbers"), lambda number: number.isNull()) & whole[0] & whole[1]
    typed = [
        F.when(F.col("_sound"), F.col("_numbers")[i].try_cast("int") if i < 2 else F.col("_numbers")[i]).alias(name)
        for i, name in enumerate(columns)
    ]
    return (
        rows.withColumn("_numbers", numbers)
        .withColumn("_sound", sound)
        .select(*keep, *typed, F.when(~F.col("_sound"), F.col(value)).alias("_corrupt"))
    )


def read_sensor_text(spark: SparkSession, paths, on_bad_lines: str = "keep") -> DataFrame:
    """Readings from headerless text files or folders of them, with the path in ``_file``.

    ``on_bad_lines``: ``keep`` them in ``_corrupt``, ``drop`` them, or ``fail``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = _read_lines(spark, paths).select("value", F.col("_metadata.file_path").alias("_file"))
    _require_rows(spark, paths)
    rows = parse_sensor_lines(lines, keep=["_file"])
    if on_bad_lines == "keep":
        return rows
    if on_bad_lines == "drop":
        return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")
    if on_bad_lines == "fail":
        stop = F.raise_error(F.concat(F.lit("unreadable line: "), F.col("_corrupt"))).cast("int")
        checked = F.when(F.col("_corrupt").isNotNull(), stop).otherwise(F.col("unit"))
        return rows.withColumn("unit", checked).drop("_corrupt")
    raise ValueError(f"unknown on_bad_lines {on_bad_lines!r}")


def read_fleet(
    spark: SparkSession, folder: str, kind: str = "train", datasets=DATASETS, on_bad_lines: str = "fail"
) -> DataFrame:
    """The readings of several datasets in one scan, tagged with ``dataset_id``."""
    paths = [f"{folder}/{kind}_{dataset}.txt" for dataset in datasets]
    rows = read_sensor_text(spark, paths, on_bad_lines)
    tagged = rows.withColumn("dataset_id", F.regexp_extract("_file", rf"{kind}_([^/]+)\.txt", 1))
    corrupt = ["_corrupt"] if "_corrupt" in rows.columns else []
    return tagged.select("dataset_id", "unit", "cycle", *FEATURES, *corrupt)


def _whole_number(field):
    """A field as int; what is no whole number, or too large for one, fails the read."""
    number = field.try_cast("double").try_cast("int")
    sound = number == field.try_cast("double")
    stop = F.raise_error(F.concat(F.lit("unreadable remaining life: "), field)).cast("int")
    return F.when(F.coalesce(sound, F.lit(False)), number).otherwise(stop)


def read_rul_at_end(
    spark: SparkSession, folder: str, datasets=DATASETS, continuous: bool = False
) -> DataFrame:
    """``dataset_id, unit, rul_at_end``: the engine id is the line number in its file.

    With ``continuous`` the numbers run on over all files in the order of ``datasets``, for
    fleets whose engines are told apart by ``unit`` alone.

    A file may also be a folder of part files, whose lines follow each other in name order.
    Lines are numbered inside their file block and shifted by the counts of the blocks before,
    so that a long list is still read in parallel.  A line that does not begin with a whole number fails the read.
    """
    paths = [f"{folder}/RUL_{dataset}.txt" for dataset in datasets]
    lines = _read_lines(spark, paths)
    _require_rows(spark, paths)
    rank = F.create_map(*[F.lit(item) for i, dataset in enumerate(datasets) for item in (dataset, i)])
    rows = (
        lines.select(
            F.regexp_extract("_metadata.file_path", r"RUL_([^/]+)\.txt", 1).alias("dataset_id"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_place"),
            F.regexp_replace("value", BLANK_ENDS, "").alias("_line"),
        )
        .where(F.col("_line") != "")
        .withColumn("_rank", F.try_element_at(rank, F.col("dataset_id")))
    )
    blocks = rows.groupBy("dataset_id", "_rank", "_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    scope = Window.partitionBy() if continuous else Window.partitionBy("dataset_id")
    before = scope.orderBy("_rank", "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        blocks.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_file", "_block").orderBy("_place")
    return (
        rows.withColumn("_at", F.row_number().over(inside))
        .join(offsets.side, ["_file", "_block"])
        .select(
            "dataset_id",
            (F.col("_before") + F.col("_at")).cast("int").alias("unit"),
            _whole_number(F.split("_line", r"\s+")[0]).alias("rul_at_end"),
        )
    )
