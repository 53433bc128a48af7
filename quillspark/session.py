"""Session settings the package is designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "quillspark", cpus: str | int | None = None, shuffle_partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A session with the package's settings.

    Master, memory and partitions are left to the cluster; ``cpus`` asks for a
    local session instead.
    """
    builder = SparkSession.builder.appName(app)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
        # Local Python workers find the package from any working directory; a cluster gets it installed or by --py-files.
        paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    if memory is not None:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
