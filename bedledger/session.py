"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app_name: str = "bedledger") -> SparkSession:
    """A session on this machine, for tests and measurements."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # no call-site look-up for every column expression that is built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names.

    Only a session on one machine (tests) may go without that setting; it gets a folder
    of its own in the temporary folder.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {key} to a folder that all executors can reach")
    return f"{tempfile.gettempdir()}/bedledger-{context.applicationId}"
