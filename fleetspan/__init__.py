"""Fleet analytics for run-to-failure sensor data, written as Spark DataFrame operators."""
