"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedledger.session import scratch_folder

#: Arrow batches are cut at this many bytes, so that very long texts do not add up in a worker.
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever the driver's copy lies; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "training_data_operators.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def map_batches(
    df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]
) -> DataFrame:
    """`fn` on each Arrow batch of `df`: no shuffle, one batch in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            if isinstance(made, pa.Table):
                yield from made.to_batches()
            elif made is not None:
                yield made

    return map_stream(df, schema, run)


def map_stream(
    df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """`fn` on the Arrow batches of each partition of `df`, in order: no shuffle.

    The session's limit of bytes in an Arrow batch stays set, since Spark reads it when the result is computed.
    """
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def id_bucket(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the text `null`."""
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % modulus


def id_bucket_column(name: str, modulus: int):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("null")).cast("binary")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores added while `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)
