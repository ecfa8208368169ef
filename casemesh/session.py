"""Session settings shared by the bench, the tests and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: Settings for any session. The number of shuffle partitions is none of them: on a cluster it follows from the data (adaptive
#: execution only joins partitions, so it should start with more than are needed, some hundred per TB).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(cpus: str | int = "*", memory: str = "8g", shuffle_partitions: int | None = 8) -> SparkSession:
    """A local session for the bench, the tests and single machines."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("casemesh").config("spark.driver.memory", memory).config(map=SETTINGS)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
