"""Load feed files as they arrive in a folder.

A file stream notices new files and remembers which ones are done; each file then goes
through the same batch load, in order of arrival. Upserts are idempotent, so a file that
is repeated after a failure leaves the tables as they should be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bedledger.operators.loads import load_hhs_data, load_quality_data

# Default number of files that one step of the stream takes; the rest follow in further steps.
FILES_PER_BATCH = 100


def _load_files(
    spark: SparkSession, folder: str, checkpoint: str, load: Callable[[str], object], files_per_batch: int
) -> StreamingQuery:
    # only names and times are asked for, so the stream itself reads no file content
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select("modificationTime", "path")
    )

    def load_batch(batch: DataFrame, _: int) -> None:
        # files_per_batch names at most; their order decides which row wins, so they go one by one
        for row in batch.orderBy("modificationTime", "path").collect():
            load(row.path)

    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(load_batch)
        .start()
    )


def load_new_hhs_files(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint: str,
    on_reject: str = "abort",
    staging: str | None = None,
    multi_line: bool = False,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Load the weekly feed files that are new since the last call.

    A file that fails under on_reject='abort' is tried again by the next call, before later ones; 'set_aside' goes on.
    """

    def load(path: str) -> None:
        load_hhs_data(spark, path, root, on_reject, staging, multi_line)

    return _load_files(spark, folder, checkpoint, load, files_per_batch)


def load_new_quality_files(
    spark: SparkSession,
    folder: str,
    year: int,
    root: str,
    checkpoint: str,
    on_reject: str = "abort",
    staging: str | None = None,
    multi_line: bool = False,
    files_per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Load the quality feed files of one rating year that are new since the last call."""

    def load(path: str) -> None:
        load_quality_data(spark, path, year, root, on_reject, staging, multi_line)

    return _load_files(spark, folder, checkpoint, load, files_per_batch)
