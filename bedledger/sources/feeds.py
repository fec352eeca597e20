"""CSV feeds, read as text by header name.

Nothing is inferred: ids keep their leading zeros, and a column is cast only by the
cleaning step, which can then report the text that did not fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedledger.schema import ARRIVAL, BROKEN_LINE, HHS_COLUMNS, MISSING_TEXTS, QUALITY_RENAMES

_BROKEN_TEXT = "_broken_text"


def _arrival() -> Column:
    """Sortable arrival order: file, then block in the file, then row in the block.

    Only the order of rows within one block comes from monotonically_increasing_id, and
    that order is the same whenever the scan of the block is repeated.
    """
    return F.struct(
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _present(name: str) -> Column:
    c = F.col(f"`{name}`")
    return F.when(~c.isin(MISSING_TEXTS), c).alias(name)


def _read_csv(
    spark: SparkSession, path: str, columns: list[str], multi_line: bool, broken_lines: str
) -> DataFrame:
    if broken_lines not in ("fail", "mark"):
        raise ValueError(f"broken_lines must be 'fail' or 'mark', not {broken_lines!r}")
    csv = (
        spark.read.option("header", True)
        .option("enforceSchema", False)  # match by header name in every file
        .option("escape", '"')
        .option("multiLine", multi_line)  # True makes a file unsplittable
        # fields that are not parsed are not counted either
        .option("columnPruning", False)
        .option("mode", "FAILFAST" if broken_lines == "fail" else "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN_TEXT)
    )
    header = csv.csv(path).columns
    fields = header if broken_lines == "fail" else [*header, _BROKEN_TEXT]
    raw = csv.schema(T.StructType([T.StructField(c, T.StringType()) for c in fields])).csv(path)
    marks = [] if broken_lines == "fail" else [F.col(_BROKEN_TEXT).isNotNull().alias(BROKEN_LINE)]
    return raw.select(*map(_present, columns), *marks, _arrival().alias(ARRIVAL))


def read_hhs_csv(
    spark: SparkSession, path: str, multi_line: bool = False, broken_lines: str = "fail"
) -> DataFrame:
    """Weekly feed: its 16 known columns as text, plus the arrival order.

    A line whose number of fields differs from the header fails the query, or is marked in
    the column `broken_line`.
    """
    return _read_csv(spark, path, HHS_COLUMNS, multi_line, broken_lines)


def read_quality_csv(
    spark: SparkSession, path: str, multi_line: bool = False, broken_lines: str = "fail"
) -> DataFrame:
    """Quality feed: its 6 known columns as text, likewise."""
    return _read_csv(spark, path, list(QUALITY_RENAMES), multi_line, broken_lines)
